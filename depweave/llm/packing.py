"""Best-fit packing of token ids into sequences, with a bounded number of open ones."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import fresh, struct_udf
from depweave.llm.token_ids import word_ids
from depweave.plans.staging import stage

#: Tokens in a sequence, the id that ends a document, and how many sequences a task keeps open.
SIZE, END, OPEN = 4096, 1, 4096
#: Tokens of a shard; each is packed on its own, and may leave one sequence partly filled.
SHARD_TOKENS = 8 << 20
#: Shards have their own range of sequence numbers.
_STRIDE = 1 << 32


class OpenBins:
    """Sequences that are not full, at most ``limit``, in a bitset whose bit n says that one with n tokens of free space is open."""

    def __init__(self, size: int = SIZE, limit: int = OPEN):
        self.size, self.limit = size, limit
        self.bits, self.open, self.opened = 0, 0, 0
        self.with_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.with_free[free]
        found = bins.pop()
        self.open -= 1
        if not bins:
            self.bits ^= 1 << free
        return found

    def put(self, length: int) -> tuple[int, int]:
        """The sequence of a piece and its place there: the one with the least space that is enough, else a new one; before one too many is opened the fullest closes."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.size, self.opened
            self.opened += 1
        left = free - length
        if left:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.with_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.size - free


def cut(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32`` (and ``ids``): the token ids of every row of docs.

    A text's ids are followed by END; those of a null text are END alone. Only what is longer than
    ``size`` is cut; the last piece may be shorter. The words of special tokens in a text are these
    tokens. Repeated rows and rows without an id are documents like others.
    """

    def each(texts: list[str | None]) -> list[list]:
        words, end = word_ids(tokenizer), np.uint32(END).tobytes()
        counts, marks, kept = [], [], []
        for t in texts:
            ids = memoryview(words.ids(t) + end)
            pieces = [ids[k : k + 4 * size] for k in range(0, len(ids), 4 * size)]
            counts.append(len(ids) // 4)
            marks.append([zlib.crc32(p) for p in pieces])
            if keep_ids:
                kept.append([np.frombuffer(p, "<u4").astype(np.int32) for p in pieces])
        return [counts, marks, kept] if keep_ids else [counts, marks]

    fields = [("n", pa.int64()), ("marks", pa.list_(pa.int64()))] + [("ids", pa.list_(pa.list_(pa.int32())))] * keep_ids
    run = struct_udf(each, fields, "n long, marks array<long>" + ", ids array<array<int>>" * keep_ids)
    coded = docs.select(F.col(key).alias("doc_id"), run(F.col(text)).alias("r"))
    rows = coded.select("doc_id", F.col("r.n").alias("n"), *([F.col("r.ids").alias("each")] if keep_ids else []), F.posexplode("r.marks").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * size
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(size), F.col("n") - start).cast("long").alias("length"), "ids_crc32", *([F.get("each", F.col("piece")).alias("ids")] if keep_ids else []))


def pack(pieces: DataFrame, size: int = SIZE, open_bins: int = OPEN, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """pieces (with ``length``, 1 to size) with ``sequence_id`` and ``offset``, the place in the sequence, without gaps from 0.

    Pieces are dealt by a hash of their place in the staged table to shards of about ``shard_tokens``
    tokens, so that no key of the data can make a shard large; in each they arrive longest first.
    A shard is one stream through one task, whose memory is the open sequences. Sequence ids are
    unique over all shards. Other columns stay; ``sequence_id`` and ``offset`` of pieces themselves
    are replaced. No pieces give no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    place, shard = fresh(pieces, "place"), fresh(pieces, "shard")
    kept = stage(pieces.withColumn(place, F.monotonically_increasing_id()), "pieces")
    tokens = kept.agg(F.sum("length")).first()[0] or 0
    shards = max(1, math.ceil(tokens / shard_tokens))
    dealt = kept.withColumn(shard, F.pmod(F.xxhash64(place), F.lit(shards)))
    dealt = dealt.repartitionByRange(shards, shard).sortWithinPartitions(shard, F.col("length").desc(), place)

    names = list(pieces.columns)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for batch in batches:
            ids, offsets = [], []
            for s, n in zip(batch.column(shard).to_pylist(), batch.column("length").to_pylist(), strict=True):
                if s != now:
                    now, bins = s, OpenBins(size, open_bins)
                found, offset = bins.put(n)
                ids.append(s * _STRIDE + found)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return dealt.mapInArrow(put, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_starts`` of packed pieces that keep their ``ids``: what a model is trained on; at most ``size`` tokens a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select(
        "sequence_id", F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["ids"])).cast("long").alias("n_tokens"),
        F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.offset").alias("doc_starts"),
    )
