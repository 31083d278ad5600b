"""Progressive JPEG: coefficients come back, pixels are those of the transform, and what the digest says."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.llm import jpeg, media


def images(seed, sizes):
    rng = np.random.default_rng(seed)
    kinds = (lambda n: rng.integers(-128, 128, (n, 64)), lambda n: rng.choice([0, 0, 0, 0, 0, 0, 0, 1, -1, 5], (n, 64)), lambda n: np.zeros((n, 64)), lambda n: rng.choice([0] * 40 + [1, -1, -128], (n, 64)), lambda n: rng.integers(32, 122, (n, 64)))
    out = []
    for n in sizes:
        for make in kinds:
            full = np.zeros((jpeg.whole(n), 64), np.int16)
            full[:n] = make(n)
            out.append(full)
    return out


def test_coefficients_come_back(monkeypatch):
    for lanes, blocks in ((4096, 1 << 14), (3, 64)):
        monkeypatch.setattr(jpeg, "LANES", lanes)
        monkeypatch.setattr(jpeg, "BLOCKS", blocks)
        given = images(1, (1, 5, 7, 40))
        found = [jpeg.parse(f) for f in jpeg.encode_blocks(given, [b"n"] * len(given))]
        jpeg.decode_scans(found)
        assert all((x.coefficients == y).all() for x, y in zip(found, given, strict=True))


def test_scans_accumulate():
    """Without the scans of the last bits the coefficients are the true ones but for their last bit."""
    given = images(2, (9,))
    found = [jpeg.parse(f) for f in jpeg.encode_blocks(given, [b""] * len(given))]
    for x in found:
        x.scans = [s for s in x.scans if s.band[2] == 0]
    jpeg.decode_scans(found)
    for x, y in zip(found, given, strict=True):
        assert (x.coefficients[:, 1:] == np.where(y < 0, -(-y >> 1 << 1), y >> 1 << 1)[:, 1:]).all()


def test_pixels():
    image = jpeg.parse(jpeg.encode_blocks([np.zeros((6, 64), np.int16)], [b""])[0])
    assert (jpeg.to_rgb(image) == 128).all() and jpeg.to_rgb(image).shape == (16, 16, 3)
    blocks = np.zeros((6, 64), np.int16)
    blocks[0, 0], blocks[5, 0], blocks[1, 2] = 80, 160, 33
    image = jpeg.parse(jpeg.encode_blocks([blocks], [b""])[0])
    jpeg.decode_scans([image])
    rgb = jpeg.to_rgb(image).astype(float)
    cos = lambda x, u: np.cos((2 * x + 1) * u * np.pi / 16)
    y = np.zeros((16, 16))
    y[:8, :8] = 10
    for r in range(8):
        y[r, 8:] = 33 / 4 * np.sqrt(0.5) * cos(r, 1)
    assert np.abs(rgb[:, :, 0] - np.clip(y + 128 + 1.402 * 20, 0, 255)).max() <= 1 and np.abs(rgb[:, :, 2] - np.clip(y + 128, 0, 255)).max() <= 1


def test_grey_file_without_restarts():
    """A file by hand: one component, one scan of DC, no restart interval."""
    seg = jpeg._segment
    frame = bytes([8, 0, 8, 0, 16, 1, 7, 0x11, 0])
    table = bytes([0x00, 0, 2, *[0] * 14, 4, 0])
    # The first block has category 4 and 1010 (10), the second category 0: bits 00 1010 01, then ones.
    file = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8] * 64)) + seg(0xC2, frame) + seg(0xC4, table) + seg(0xDA, bytes([1, 7, 0, 0, 0, 0])) + bytes([0b00101001]) + b"\xff\xd9"
    image = jpeg.parse(file)
    jpeg.decode_scans([image])
    assert image.coefficients[:, 0].tolist() == [10, 10] and (jpeg.to_rgb(image) == 138).all() and jpeg.to_rgb(image).shape == (8, 16, 3)


def test_other_files_are_refused():
    for bad in (b"", b"GIF89a", b"\xff\xd8" + jpeg._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))):
        with pytest.raises(ValueError):
            jpeg.parse(bad)


def test_digest(spark):
    texts = [None, "", "a", "x" * 64, "é\0\1漢" * 50, "word and word " * 30_000, "a"]
    docs = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("media", F.lit(1))
    got = media.digest(docs).collect()
    stored = {r["text"]: r["media"] for r in media.store(docs).collect()}
    seen = {}
    for r in got:
        matching = [t for i, t in enumerate(texts) if i % 6 == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]]
        raw = (matching[0] or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["payload_bytes"] == len(full) and r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-64:])
        assert r["media_bytes"] == len(stored[matching[0]]) and r["media_sha256"] == hashlib.sha256(stored[matching[0]]).hexdigest()
        seen.setdefault(r["payload_sha256"], set()).add((r["feature"], r["media_sha256"]))
    assert len(got) == len(texts) and all(len(x) == 1 for x in seen.values())
    tensor = media.tensors(media.store(docs)).where("doc_id = 2").first()["image"]
    assert len(tensor["rgb"]) == tensor["height"] * tensor["width"] * 3 and tensor["height"] == 16
    assert media.digest(docs.limit(0)).count() == 0
