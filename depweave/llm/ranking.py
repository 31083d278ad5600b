"""Ranked lexical search: the best documents of each item by their words, through trees of documents that share frequent terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.llm.common import struct_udf
from depweave.llm.contamination import normal_words
from depweave.llm.term_tree import Best, Items, build, search
from depweave.plans.staging import stage

#: Documents of an item.
BEST = 20
#: Bytes of item text whose terms are broadcast; a larger set of items is searched in several passes.
ITEM_BYTES = 16 << 20
#: Documents and entries of a tree, and items that are searched together.
TREE_DOCS, TREE_ENTRIES, TOGETHER = 8192, 1_000_000, 512
#: Groups in which an item's documents are ranked before all of them are.
SALT = 64


def vectors(docs: DataFrame, terms: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, terms, tf`` of the documents with at least one term: all of its terms counted, and those in ``terms`` by their places there."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def each(texts: list[str | None]) -> list[list]:
        known, out = shared.value, [[], [], []]
        for t in texts:
            words = normal_words(t)
            counts = Counter(words)
            found = [(known[w], counts[w]) for w in counts.keys() & known.keys()]
            for column, value in zip(out, (len(words), [k for k, _ in found], [c for _, c in found]), strict=True):
                column.append(value)
        return out

    run = struct_udf(each, [("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))], "n long, terms array<int>, tf array<int>")
    return docs.select(F.col(key).alias("doc_id"), run(F.col(text)).alias("r")).select("doc_id", "r.*").where("n > 0")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _best(found: DataFrame, best: int, *by: str) -> DataFrame:
    order = Window.partitionBy("item", *by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _pass(docs: DataFrame, items: list[tuple[int, Counter]], best: int) -> DataFrame:
    """``item, rank, doc_id, score`` for items (number, terms)."""
    terms = sorted(set().union(*(c for _, c in items)))
    kept = stage(vectors(docs, terms), "vectors")
    documents, length = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)  # as many numbers as the items have terms
    for r in kept.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator():
        df[r["t"]] = r["n"]
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(terms), np.int32)
    place[order] = np.arange(len(terms), dtype=np.int32)
    number = {t: k for k, t in enumerate(terms)}
    weighted = [(i, {int(place[number[t]]): c * weight(documents, int(df[number[t]])) for t, c in counts.items()}) for i, counts in items]
    groups = [Items(weighted[k : k + TOGETHER], len(terms)) for k in range(0, len(weighted), TOGETHER)]
    shared = docs.sparkSession.sparkContext.broadcast((place, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, groups = shared.value
        found = [Best(len(g.numbers), best) for g in groups]
        block, entries = [], 0

        def close() -> None:
            nonlocal block, entries
            if block:
                root = build(block, best)
                for g, f in zip(groups, found, strict=True):
                    search(root, g, f)
            block, entries = [], 0

        for batch in batches:
            columns = [batch.column(c) for c in ("terms", "tf")]
            at = columns[0].offsets.to_numpy()
            ids, tf = (c.values.to_numpy(zero_copy_only=False) for c in columns)
            ranks = place[ids]
            for k, (doc, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                here = slice(at[k], at[k + 1])
                if at[k] == at[k + 1]:
                    continue
                by = np.argsort(ranks[here])
                block.append((ranks[here][by], tf[here][by], 75 + 25 * n * documents // length, doc))
                entries += len(by)
                if len(block) >= TREE_DOCS or entries >= TREE_ENTRIES:
                    close()
        close()
        rows = [(g.numbers[k], None if not e[1] else -e[2], e[0]) for g, f in zip(groups, found, strict=True) for k, heap in enumerate(f.heaps) for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["item", "doc_id", "score"])

    tops = kept.mapInArrow(run, "item long, doc_id long, score long")
    few = _best(tops.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))), best, "salt").drop("rank", "salt")
    return _best(few, best)


def search_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", best: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of items the ``best`` documents whose score is above 0, the highest first, of equal ones the least id.

    Terms are words in lower case (letters, digits and all that is not ASCII), of whole texts. The
    score sums, over the item's terms with repeats, a weight that falls with the number of documents
    that have the term, times a share that grows with its count and falls with the document's length.

    Every document is cut down to the items' terms, and its frequent terms come first; a task builds
    trees of such vectors and searches them for all items, keeping the best so far, so that a
    subtree whose bound is too low is not opened. A task sends on ``best`` documents for each item.

    Null and wordless texts are no documents; an item without terms, or with none that occurs, has no
    rows. Each row of items is an item, also if ids repeat or are null; so is each row of docs a
    document. Ids of documents are 64-bit integers; a null one comes after the others.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("item_text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(size / ITEM_BYTES))
    rows = stage(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    parts = []
    for k in range(passes):
        mine = rows.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).select("item", "item_text").toLocalIterator()
        terms = [(r["item"], Counter(normal_words(r["item_text"]))) for r in mine]
        parts.append(_pass(docs, [(i, c) for i, c in terms if c], best))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
