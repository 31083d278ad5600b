"""Near-duplicates: weighted signatures by hashed darts (DartMinHash), banded joining, an exact check, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import fresh, struct_udf
from depweave.llm.contamination import normal_words
from depweave.operators.components import connected_components
from depweave.plans.staging import stage, unstage

SHINGLE, SIMILARITY = 5, 0.8
#: 18 bands of 4 coordinates: a pair of similarity 0.8 shares no band with probability 0.00008.
BANDS, ROWS = 18, 4
#: Later leaders of a bucket are the ids that are the least after these bits are flipped.
ORDERS = (0x5DEECE66D1CE4E5B, 0x2545F4914F6CDD1D)
#: Documents up to which a bucket of several classes is compared pair by pair; a larger one is joined by its rare cells. Both are exact.
SMALL_BUCKET = 16
#: Sizes that differ by less than this ratio are one size class in the join by rare cells.
SIZE_STEP = 1.02
#: Ids up to which candidates, and copies that go, are broadcast to the scan of the texts (some 20 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_PRIME, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(16)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = pow(int(_PRIME), -1, 1 << 64)
    up, down = np.full(size, _PRIME), np.full(size, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


#: Bytes whose words are hashed at once.
_PIECE = 1 << 18


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of a polynomial over all of them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out, first = np.empty(len(words), np.uint64), 0
    ends = np.cumsum(lengths)
    while first < len(words):
        base = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
        codes = np.frombuffer(b"".join(words[first:last]), np.uint8).astype(np.uint64) + _ONE
        up, down = _powers(_PIECE if len(codes) <= _PIECE else len(codes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)])])
        to = ends[first:last] - base
        at = to - lengths[first:last]
        out[first:last] = (sums[to] - sums[at]) * down[at]
        first = last
    return _mix(out ^ lengths.astype(np.uint64))


def cells(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The weighted set of shingles as unit cells, sorted: a shingle that occurs w times has w cells.

    Fewer words than ``size`` are one shingle; no words, none. The Jaccard similarity of two sets of
    cells is the weighted Jaccard similarity of the shingle counts.
    """
    if not words:
        return np.zeros(0, np.uint64)
    hashed = word_hashes(words)
    size = min(size, len(words))
    n = len(words) - size + 1
    rolled = np.full(n, np.uint64(size))
    for k in range(size):
        rolled = rolled * _PRIME + hashed[k : k + n]
    rolled = np.sort(_mix(rolled))
    new = np.ones(n, bool)
    new[1:] = rolled[1:] != rolled[:-1]
    starts = np.flatnonzero(new)
    turn = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return np.sort(np.where(turn > 0, _mix(rolled + turn.astype(np.uint64) * _PRIME), rolled))


def signature(of: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """For each of k coordinates the earliest dart that hits the region of the cells.

    Darts fall on every unit cell at the rate of one per unit of time, the same for all documents,
    as their number, times and coordinates are hashes of the cell. Throwing stops at the time by
    which about k ln k + 2k darts have fallen on all cells; if a coordinate is still empty, the
    time is doubled. So the work grows with the number of cells plus k ln k, not with their product.
    """
    until = (k * np.log(k) + 2 * k) / len(of)
    while True:
        late, found = int(np.ceil(until)), np.zeros(k, np.uint64)
        seen = np.zeros(k, bool)
        seeds = of if late == 1 else (of[None, :] + (np.arange(late, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[:, None]).ravel()
        hours = np.zeros(len(of)) if late == 1 else np.repeat(np.arange(late, dtype=np.float64), len(of))
        seeds = _mix(seeds ^ np.uint64(0xA0761D6478BD642F))
        number = np.searchsorted(_POISSON, (seeds >> np.uint64(11)) * 2.0**-53, "right")
        darts, times, turn = [], [], 0
        while len(seeds):
            has = number > turn
            seeds, hours, number = seeds[has], hours[has], number[has]
            turn += 1
            dart = _mix(seeds + np.uint64(turn * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF))
            time = hours + (dart >> np.uint64(11)) * 2.0**-53
            early = time < until
            darts.append(dart[early])
            times.append(time[early])
        dart, time = np.concatenate(darts), np.concatenate(times)
        dart = dart[np.argsort(-time, kind="stable")]
        place = (_mix(dart ^ _PRIME) % np.uint64(k)).astype(np.int64)
        found[place], seen[place] = dart, True
        if seen.all():
            return found
        until *= 2


def bands(found: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS coordinates."""
    rows = found.reshape(-1, ROWS)
    out = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        out = _mix(out * _PRIME + rows[:, k])
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of cells."""
    total = len(a) + len(b)
    if not total:
        return 0.0
    union = len(np.unique(np.concatenate([a, b])))
    return (total - union) / union


def _mark(text: str | None, words: list[bytes]) -> bytes | None:
    """Equal for texts of the same words in the same order, or, without words, for equal texts."""
    if text is None:
        return None
    return hashlib.md5(b"w" + b" ".join(words) if words else b"t" + text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, same, bands``: same is equal for texts of the same words in the same order (wordless texts: for equal texts)."""

    def each(texts: list[str | None]) -> list[list]:
        same, out = [], []
        for t in texts:
            words = normal_words(t)
            same.append(_mark(t, words))
            out.append(bands(signature(cells(words))).tolist() if words else [])
        return [same, out]

    run = struct_udf(each, [("same", pa.binary()), ("bands", pa.list_(pa.int64()))], "same binary, bands array<long>")
    return docs.select(F.col(key).alias("id"), run(F.col(text)).alias("r")).select("id", "r.same", "r.bands")


def marks(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with ``out``, the ``same`` of their texts."""
    run = struct_udf(lambda texts: [[_mark(t, normal_words(t)) for t in texts]], [("same", pa.binary())], "same binary")
    return docs.withColumn(out, run(F.col(text))["same"])


def buckets(firsts: DataFrame, scratch: list[DataFrame] | None = None) -> DataFrame:
    """``band, id, lead`` of all buckets that several documents share; lead is the least id of the bucket.

    ``firsts``: ``id, bands``, one row for each different text. The leaders are found by partial
    minima and staged, so that the join back can deal a hot bucket over several tasks.
    """
    rows = firsts.select("id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("band", "lead")
    shared = stage(shared, "leaders")
    if scratch is not None:
        scratch.append(shared)
    return rows.join(shared, "band")


def first_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``a < b``: each document with the least of the leaders of its buckets, so at most one pair a document."""
    return members.where("id != lead").groupBy(F.col("id").alias("b")).agg(F.min("lead").alias("a")).select("a", "b")


def leader_pairs(members: DataFrame, part: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of a document and the leader of any of its buckets, where they are not of one class yet."""
    pairs = members.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    of = lambda end: part.select(F.col("node").alias(end), F.col("component").alias(f"class_{end}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")


def later_pairs(members: DataFrame, part: DataFrame) -> DataFrame:
    """Pairs ``a < b`` for the buckets whose documents are not yet one class: each document with three more leaders.

    ``part`` (``node, component``) has the classes so far. The leaders are the greatest id and the
    first in two other orders; only pairs across classes are made, so a large group of copies, which
    its first leader has joined already, makes none.
    """
    of = members.join(part.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("class"))
    flip = lambda c, by: c.bitwiseXOR(F.lit(by))
    mixed = of.groupBy("band").agg(
        F.min("class").alias("c0"), F.max("class").alias("c1"), F.max("id").alias("l0"), *(F.min(flip(F.col("id"), x)).alias(f"l{k}") for k, x in enumerate(ORDERS, 1)),
    ).where("c0 < c1")
    lead = F.array_distinct(F.array("l0", *(flip(F.col(f"l{k}"), x) for k, x in enumerate(ORDERS, 1))))
    pairs = of.join(mixed.select("band", lead.alias("lead")), "band").select("id", "class", F.explode("lead").alias("to")).where("id != to").distinct()
    known = part.select(F.col("node").alias("to"), F.col("component").alias("to_class"))
    across = pairs.join(known, "to", "left").where(F.col("class") != F.coalesce("to_class", "to"))
    return across.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()


def open_pairs(members: DataFrame, part: DataFrame, texts: DataFrame, least: float = SIMILARITY, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Pairs ``a < b`` across classes for the buckets that leaders left with several classes: no link in them is lost.

    ``part`` (``node, component``) has the classes so far. Of three documents every pair has the
    least or the greatest id, so leaders have seen it. Small buckets give all their pairs, larger
    ones those that may be similar by their cells.
    """
    scratch = [] if scratch is None else scratch
    of = members.join(part.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("class"))
    mixed = of.groupBy("band").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.count("*").alias("n")).where("c0 < c1 and n > 3")
    mixed = stage(mixed.select("band", (F.col("n") <= SMALL_BUCKET).alias("small")), "mixed")
    left = stage(of.join(mixed, "band"), "open")
    small = left.where("small")
    pairs = (
        small.select("band", F.col("id").alias("x"), F.col("class").alias("cx"))
        .join(small.select("band", F.col("id").alias("y"), F.col("class").alias("cy")), "band").where("cx < cy")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    scratch += [mixed, left]
    hot = left.where("not small").select("id", "class").distinct()
    if hot.limit(1).count():
        pairs = pairs.unionByName(rare_pairs(texts, stage(hot, "hot"), least, scratch))
    return pairs.distinct()


def rare_pairs(texts: DataFrame, hot: DataFrame, least: float, scratch: list[DataFrame]) -> DataFrame:
    """All pairs of ``hot`` (``id, class``) across classes that may be as similar as ``least``, by a prefix filter.

    Cells are ordered by how many documents of hot have them. Sets of n and m cells and similarity s
    have c (n + m) cells in common, c = s / (1 + s), so the first n - c (n + m) + 1 of the one and
    m - c (n + m) + 1 of the other share a cell. Hence a cell of rank r counts for partners of up to
    (n - r) / c - n cells (``reach``) only, and a text that all have is met by none that is less
    similar. Pairs are made between classes first, so that a large class is not paired with itself.
    """
    wanted = hot.select("id")
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi")
    run = struct_udf(lambda ts: [[cells(normal_words(t)).view(np.int64) for t in ts]], [("cells", pa.list_(pa.int64()))], "cells array<long>")
    sets = stage(texts.select("id", run("text").alias("r")).select("id", "r.cells"), "cells")
    rows = sets.select("id", F.explode("cells").alias("cell"))
    shared = stage(rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    ranked = rows.join(shared, "cell").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "cell"))).alias("in_order"))
    ranked = ranked.join(sets.select("id", F.size("cells").alias("size")), "id").join(hot, "id")
    ranked = ranked.select("id", "class", "size", (F.col("size") - F.size("in_order")).alias("alone"), F.posexplode("in_order").alias("at", "c"))
    reach = F.floor((F.col("size") - F.col("alone") - F.col("at")) * F.lit((1 + least) / least) - F.col("size") + F.lit(1e-6))
    lowest = F.ceil(F.col("size") * F.lit(least) - F.lit(1e-6))
    level = lambda n: F.floor(F.log(n.cast("double")) / F.lit(float(np.log(SIZE_STEP)))).cast("int")
    near = ranked.select("id", "class", "size", F.col("c.cell").alias("cell"), reach.alias("reach"), lowest.alias("lowest")).where("reach >= lowest")
    near = near.select("id", "class", "size", "cell", "reach", level(F.col("size")).alias("k"), F.explode(F.sequence(level(F.col("lowest")), level(F.col("reach")))).alias("to"))
    near = stage(near, "prefixes")
    sides = stage(near.groupBy("cell", "k", "to", "class").agg(F.min("size").alias("size"), F.max("reach").alias("reach")), "sides")
    scratch += [hot, sets, shared, near, sides]
    one = sides.select("cell", "k", "to", F.col("class").alias("cx"), F.col("size").alias("n"), F.col("reach").alias("rx"))
    two = sides.select("cell", F.col("to").alias("k"), F.col("k").alias("to"), F.col("class").alias("cy"), F.col("size").alias("m"), F.col("reach").alias("ry"))
    both = one.join(two, ["cell", "k", "to"]).where("cx < cy and n <= ry and m <= rx").select("cell", "k", "to", "cx", "cy")
    x = near.select("cell", "k", "to", F.col("class").alias("cx"), F.col("id").alias("x"), F.col("size").alias("n"), F.col("reach").alias("rx"))
    y = near.select("cell", F.col("to").alias("k"), F.col("k").alias("to"), F.col("class").alias("cy"), F.col("id").alias("y"), F.col("size").alias("m"), F.col("reach").alias("ry"))
    found = both.join(x, ["cell", "k", "to", "cx"]).join(y, ["cell", "k", "to", "cy"]).where("n <= ry and m <= rx")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def member_texts(docs: DataFrame, members: DataFrame, firsts: DataFrame, scratch: list[DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, text`` of the different texts that share a bucket, staged: read for both ends of every pair, and joined as it is, a leader of very many pairs can be dealt out.

    A text is read from a document that has it, or from all without an id if only these have it; which
    text a document has says its mark, so an id may stand on several.
    """
    wanted = stage(firsts.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", "same", "least"), "wanted")
    scratch.append(wanted)
    few = wanted.count() <= BROADCAST_IDS // 2
    side = F.broadcast if few else lambda df: df
    rows = docs.select(F.col(key).alias("least"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    with_id = rows.join(side(wanted.where("least is not null").select("least").distinct()), "least", "left_semi")
    if wanted.where("least is null").limit(1).count():
        with_id = with_id.unionByName(rows.where("least is null"))
    found = marks(with_id, "text", "same").join(side(wanted.select("node", "same")), "same")
    return stage(found.groupBy(F.col("node").alias("id")).agg(F.min("text").alias("text")), "texts")


def links(texts: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those of the pairs whose texts (``id, text``) are as similar as ``least`` or more, by their whole sets of shingles."""
    both = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in known:
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                known[key] = cells(normal_words(text))
            return known[key]

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True))
            good = [(a, b) for a, b, s, t in rows if similarity(of(a, s), of(b, t)) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in good], pa.int64()), pa.array([x for _, x in good], pa.int64())], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _same_ids(sigs: DataFrame, firsts: DataFrame, scratch: list[DataFrame]) -> DataFrame | None:
    """Links ``a < b`` of the different texts on which one id stands; None if there are none."""
    rows = sigs.where("id is not null and same is not null").select("id", "same")
    several = stage(rows.groupBy("id").agg(F.min("same").alias("s"), F.max("same").alias("t")).where("s < t").select("id"), "several")
    scratch.append(several)
    if not several.limit(1).count():
        return None
    on = rows.join(several, "id", "left_semi").distinct().join(firsts.select("same", "node"), "same")
    least = on.groupBy("id").agg(F.min("node").alias("a"))
    return on.join(least, "id").where("a < node").select("a", F.col("node").alias("b")).distinct()


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``id, same, group, class_id``, staged: a row for each row of docs; group is a number of the class, null for null texts, whose class_id is the id.

    Everything is found between different texts, which have numbers of their own (``node``), and
    only at the end do rows take the class of their text. So it makes no difference which ids are
    missing or repeated.
    """
    sigs = stage(signed(docs, key, text), "signed")
    # Numbers go by the least id of a text, so leaders are the earliest, of which others are copies. They are staged, so they are fixed whatever is lost later.
    firsts = sigs.where("same is not null").groupBy("same", "bands").agg(F.min("id").alias("least"))
    order = F.col("least").asc_nulls_last()
    firsts = stage(firsts.repartitionByRange(order).sortWithinPartitions(order).withColumn("node", F.monotonically_increasing_id()), "firsts")
    scratch: list[DataFrame] = [sigs, firsts]  # staged tables that are read no more once the classes are known
    members = stage(buckets(firsts.where("size(bands) > 0").select(F.col("node").alias("id"), "bands"), scratch), "members")
    texts = member_texts(docs, members, firsts, scratch, key, text)
    asked = stage(first_pairs(members), "pairs")
    found = links(texts, asked, least)
    shared = _same_ids(sigs, firsts, scratch)
    found = stage(found if shared is None else found.unionByName(shared), "links")
    part = connected_components(found, "a", "b")
    # Each step asks for pairs across the classes so far only; the last one leaves no pair that may be a link.
    steps = [lambda: leader_pairs(members, part), lambda: later_pairs(members, part), lambda: open_pairs(members, part, texts, least, scratch)]
    for step in steps:
        pairs = stage(step().join(asked, ["a", "b"], "left_anti"), "pairs")
        scratch += [pairs, found]
        if pairs.limit(1).count():
            more = stage(links(texts, pairs, least), "links")
            scratch.append(more)
            if more.limit(1).count():
                found = found.unionByName(more)
                scratch.append(part)
                part = connected_components(found, "a", "b")
        asked = asked.unionByName(pairs)
    names = part.join(firsts.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("name"))
    of = firsts.select("same", "node", "least").join(part.join(names, "component"), "node", "left")
    of = of.select("same", F.coalesce("component", "node").alias("group"), F.when(F.col("component").isNotNull(), F.col("name")).otherwise(F.col("least")).alias("class_id"))
    rows = stage(sigs.where("same is not null").select("id", "same").join(of, "same").select("id", "same", "group", "class_id"), "grouped")
    bare = sigs.where("same is null").select("id")
    if bare.limit(1).count():
        by_id = rows.where("id is not null").select("id", "class_id").join(bare.distinct(), "id", "left_semi").groupBy("id").agg(F.min("class_id").alias("class_id"))
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        more = bare.join(by_id, "id", "left").select("id", none("binary", "same"), none("long", "group"), F.coalesce("class_id", "id").alias("class_id"))
        both = stage(rows.unionByName(more), "grouped")
        scratch.append(rows)
        rows = both
    for done in (members, texts, asked, part, *scratch):
        unstage(done)
    return rows


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row ``doc_id, class_id`` for each row of docs; a class is named by its least id.

    Two texts are linked if the weighted Jaccard similarity of their 5-word shingles is ``least``
    or more (words: ASCII letters in lower case, digits and all other non-ASCII characters); a
    class is what links connect. Texts of the same words are one text from the start, so that
    thousands of copies are signed and compared as one. Wordless texts, the empty one among them,
    are in one class only with equal texts. A null text is alone. Rows that share an id are one
    document, so their texts are of one class. A row without an id is of the class of its text, like
    any other; a class in which no row has an id has a null name. Ids are of any type that has an order.
    """
    return grouped(docs, key, text, least).select(F.col("id").alias("doc_id"), "class_id")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-copies: of each class the document with the least id stays.

    Of rows that share an id, one of the least text stays. Rows without an id go if a row of their
    class has one; of a class without any, one row stays. Rows without id and text stay.
    """
    found = grouped(docs, key, text)
    id_ = F.col(key)
    copies = found.where("id != class_id").select(F.col("id").alias(key)).distinct()
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    kept = docs.where(id_.isNotNull()).join(copies, key, "left_anti").select(*docs.columns)
    order = F.struct(F.col(text).isNull().alias("none"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = F.struct(*docs.columns).alias("row")
    back = [F.col("row").getField(c).alias(c) for c in docs.columns]
    repeated = found.where("id is not null and id = class_id").groupBy("id").count().where("count > 1").select(F.col("id").alias(key))
    if repeated.limit(1).count():
        once = kept.join(repeated, key, "left_semi").select(id_.alias("id"), whole, order.alias("order")).groupBy("id").agg(F.min_by("row", "order").alias("row"))
        kept = kept.join(repeated, key, "left_anti").select(*docs.columns).unionByName(once.select(*back))
    nameless = docs.where(id_.isNull())
    if nameless.limit(1).count():
        same = fresh(docs, "same")
        stay = found.where("id is null and class_id is null and same is not null").groupBy("group").agg(F.min("same").alias(same)).select(same)
        marked = marks(nameless, text, same)
        first = marked.join(stay, same).select(same, whole, order.alias("order")).groupBy(same).agg(F.min_by("row", "order").alias("row"))
        kept = kept.unionByName(first.select(*back)).unionByName(nameless.where(F.col(text).isNull()))
    return kept
