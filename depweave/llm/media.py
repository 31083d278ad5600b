"""Media columns: bytes kept as progressive JPEG, read back as coefficients, and as full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm import jpeg
from depweave.llm.common import fresh, struct_udf

#: Bytes that are coded at once; a larger value is coded alone.
GROUP = 1 << 21
BLOCK = 64


def payload(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of BLOCK."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def _groups(values: list, size: Callable[[object], int]) -> Iterator[list]:
    group, held = [], 0
    for v in values:
        group.append(v)
        held += size(v)
        if held >= GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def to_jpeg(values: list[bytes]) -> list[bytes]:
    """One file for each value: every byte of its payload, read as a signed number, is a quantized coefficient.

    A block of 64 bytes is a block of 8 x 8 in zigzag order; the blocks fill Y first, then Cb, then Cr;
    blocks of zeros fill the last row of the image. The comment holds the lengths of value and payload.
    """
    files = []
    for group in _groups(values, len):
        images, notes = [], []
        for v in group:
            full = payload(v)
            n = len(full) // BLOCK
            blocks = np.zeros((jpeg.whole(n), BLOCK), np.int16)
            blocks[:n] = np.frombuffer(full, np.int8).reshape(n, BLOCK)
            images.append(blocks)
            notes.append(b"%d %d" % (len(v), len(full)))
        files += jpeg.encode_blocks(images, notes)
    return files


def read_back(files: list[bytes]) -> Iterator[tuple[int, bytes, jpeg.Image]]:
    """Length of the value, payload and decoded image of each file that ``to_jpeg`` wrote."""
    for group in _groups(files, len):
        images = [jpeg.parse(f) for f in group]
        jpeg.decode_scans(images)
        for image in images:
            n_bytes, size = map(int, image.note.split())
            yield n_bytes, image.coefficients[: size // BLOCK].astype(np.int8).tobytes(), image


def feature(rgb: np.ndarray) -> str:
    """Height and width, then mean and deviation of each channel of a tensor."""
    flat = rgb.reshape(-1, 3)
    mean = flat.mean(axis=0, dtype=np.float64)
    spread = np.sqrt(np.maximum(0, np.square(flat.astype(np.uint16)).mean(axis=0, dtype=np.float64) - mean * mean))
    return f"{rgb.shape[0]}x{rgb.shape[1]};" + ",".join(f"{x:.2f}" for x in mean) + ";" + ",".join(f"{x:.2f}" for x in spread)


def store(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """The rows of docs with ``out``, the text's UTF-8 bytes as a progressive JPEG; null counts as empty.

    A column of docs named like ``out`` is replaced.
    """
    run = struct_udf(lambda texts: [to_jpeg([(t or "").encode("utf-8", "surrogatepass") for t in texts])], [("media", pa.binary())], "media binary")
    name = fresh(docs, "found")
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    return docs.withColumn(name, run(F.col(text))).select(*kept, F.col(f"{name}.media").alias(out))


def tensors(media: DataFrame, column: str = "media", out: str = "image") -> DataFrame:
    """The rows of media with ``out``: ``height, width, rgb``, any progressive JPEG as a tensor of bytes in rows of pixels.

    Null gives null; a file that is no progressive Huffman JPEG of 8 bits fails the job.
    """
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def each(files: list[bytes | None]) -> list[list]:
        found = iter([])
        out = []
        images = []
        for group in _groups([f for f in files if f is not None], len):
            part = [jpeg.parse(f) for f in group]
            jpeg.decode_scans(part)
            images += part
        found = iter(images)
        for f in files:
            image = None if f is None else next(found)
            out.append(None if image is None else {"height": image.height, "width": image.width, "rgb": jpeg.to_rgb(image).tobytes()})
        return [out]

    run = struct_udf(each, [("image", kind)], "image struct<height:int,width:int,rgb:binary>")
    name = fresh(media, "found")
    kept = [c for c in media.columns if c.lower() != out.lower()]
    return media.withColumn(name, run(F.col(column))).select(*kept, F.col(f"{name}.image").alias(out))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document what its stored form holds: lengths, hashes of the payload that is read back and of the file, features of the tensor."""
    kept = store(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]

    def each(files: list[bytes]) -> list[list]:
        cols: list[list] = [[] for _ in fields]
        for n, data, image in read_back(files):
            for c, x in zip(cols, (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), feature(jpeg.to_rgb(image))), strict=True):
                c.append(x)
        return cols

    run = struct_udf(each, fields, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    got = kept.withColumn("r", run(F.col("media")))
    return got.select("doc_id", "r.n_bytes", "r.payload_bytes", "r.payload_sha256", "r.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "r.feature")
