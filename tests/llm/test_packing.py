"""Token ids against the library, and packing against a plain best fit."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depweave.llm import packing, queries
from depweave.llm.packing import OpenBins
from depweave.llm.token_ids import WordIds

DATA = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "It's they'RE we'd I'm", "a.b,c;d", "wait... what?! (no)", "x" * 300, "ÉTÉ über ŒUVRE İstanbul ẞ ß ŉ", "été Å", "１２３ 123 ½ x²", "中文 字 ひらがな", "a b c\u0085d\x1ce",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "tab\there\r\nline", "🙂🙂 ok", "́alone", "Σίσυφος ΟΔΟΣ", "a_b __init__", "\x00\x01", "ª º ǅ", "ʼn ɐa éɐ",
]


def library():
    t = Tokenizer.from_file(FILE)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_are_the_librarys(spark):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect() if r["text"]]
    words, whole = WordIds(FILE), library()
    assert words.by_word
    for t in texts * 2:  # the second time from memory
        assert np.frombuffer(words.ids(t), "<u4").tolist() == whole(t), t
    other = WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word and np.frombuffer(other.ids("Hello there"), "<u4").tolist() == other.whole.encode("Hello there", add_special_tokens=False).ids


def plain_best_fit(lengths, size, limit):
    """Best fit over a list of open bins, looked through one by one."""
    bins, out, opened = [], [], 0
    for n in lengths:
        fit = [b for b in bins if b[1] >= n]
        if fit:
            best = min(b[1] for b in fit)
            found = next(b for b in reversed(bins) if b[1] == best)
            bins.remove(found)
        else:
            found, opened = [opened, size], opened + 1
        place = size - found[1]
        if found[1] > n:
            if len(bins) == limit:
                full = min(b[1] for b in bins)
                bins.remove(next(b for b in reversed(bins) if b[1] == full))
            bins.append([found[0], found[1] - n])
        out.append((found[0], place))
    return out


def test_bitset_is_best_fit_with_a_bound():
    rng = random.Random(5)
    for _ in range(200):
        size, limit = rng.choice([8, 50, 300]), rng.choice([1, 2, 7, 1000])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
        bins, got = OpenBins(size, limit), []
        for n in lengths:
            got.append(bins.put(n))
            assert bins.open <= limit and bins.open == sum(map(len, bins.with_free))
        assert got == plain_best_fit(lengths, size, limit)


def checked(rows, size):
    """That every sequence is filled without gaps; how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by)


def test_query_packs_all_documents(spark):
    rows = queries.op11_packing(spark, DATA).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    whole, by = library(), {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by.keys() == docs.keys()
    for doc, pieces in by.items():
        ids = np.array([*whole(docs[doc] or ""), 1], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces] == [
            (k, k * 4096, len(ids[k * 4096 :][:4096]), zlib.crc32(ids[k * 4096 :][:4096].tobytes())) for k in range(math.ceil(len(ids) / 4096))
        ]
    assert checked(rows, 4096) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1


def test_shards_odd_rows_and_ids(spark):
    texts = [None, "", "same words", "same words", "long " * 9000, *ODD]
    docs = spark.createDataFrame([(None if k % 7 == 0 else k // 2, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, offset string")
    pieces = packing.cut(docs, FILE, size=64, keep_ids=True)
    packed = packing.pack(pieces.withColumn("sequence_id", F.lit("old")), size=64, shard_tokens=1000)
    rows = packed.collect()
    assert len(rows) == pieces.count() and len({r["sequence_id"] >> 32 for r in rows}) > 3  # several shards
    total = sum(r["length"] for r in rows)
    assert checked(rows, 64) <= math.ceil(total / 64) + math.ceil(total / 1000)
    made = packing.sequences(packed).collect()
    at = {(s["sequence_id"], o): s["ids"][o:] for s in made for o in s["doc_starts"]}
    assert sum(s["n_tokens"] for s in made) == total and all(s["n_tokens"] == len(s["ids"]) for s in made)
    assert all(at[r["sequence_id"], r["offset"]][: r["length"]] == r["ids"] for r in rows)
    again = {(r["doc_id"], r["piece"], r["ids_crc32"], r["length"]) for r in packing.pack(pieces, size=64, shard_tokens=1000).collect()}
    assert again == {(r["doc_id"], r["piece"], r["ids_crc32"], r["length"]) for r in rows}
    assert packing.pack(packing.cut(docs.limit(0), FILE)).collect() == []
