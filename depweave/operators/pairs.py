"""Pairs of what observes and what declares, counted without a row for each.

A product of two long tables is much larger than both. So an observed key meets packed lists of the
documents that declare it, such rows are dealt by observing document, and a task unpacks the lists
of some documents at a time and counts their pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.columns import ci

#: Pairs that are unpacked at a time. A document's own may be more; they are counted in parts.
PAIRS = 1 << 19
#: Rows that are looked at before pairs are counted.
ROWS = 2048


def packed(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of whole numbers from 0 as bytes, and where each list begins and the last ends. ``firsts``: where lists begin in values, which rise within a list.

    A list is its steps from one number to the next, seven bits a byte; the last byte of a step is below 128.
    """
    steps = np.diff(values, prepend=0)
    steps[firsts] = values[firsts]
    size = np.ones(len(steps), np.int64)
    for k in range(1, 9):
        size += steps >> 7 * k > 0
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[(ends - size)[has] + k] = (steps[has] >> 7 * k & 127) | (size[has] > k + 1).astype(np.int64) << 7
    return out, np.append((ends - size)[firsts], len(out))


def unpacked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` made of lists: their numbers, and how many each has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    ends = data < 128
    starts = np.append(0, np.flatnonzero(ends)[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    steps = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)
    before = np.append(0, np.cumsum(ends))[offsets]
    sums = np.append(0, np.cumsum(steps))
    return sums[1:] - np.repeat(sums[before[:-1]], np.diff(before)), np.diff(before)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each different value, also null, and the values."""
    found = column.combine_chunks().dictionary_encode("encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def parted(id_: str) -> tuple[Column, Column]:
    """What an id begins with, and the number that it ends in; an id without one is its beginning."""
    digits = F.regexp_extract(id_, r"(?:0|[1-9][0-9]{0,17})$", 0)
    return F.left(F.col(id_), F.length(id_) - F.length(digits)).alias("prefix"), F.nullif(digits, F.lit("")).cast("long").alias("number")


def places(declarations: DataFrame, far: list[str] | None = None) -> DataFrame:
    """``target_symbol_key, prefix, packed`` and the columns ``far``: the different documents that declare a key (``symbol_key, document_id``), by what their ids begin with.

    An id that ends in a number is a prefix and that number, any other a prefix alone, with no
    list. A long list comes in several rows. ``far``: columns of declarations that a document has once.
    """
    far = far or []
    rows = declarations.where("symbol_key is not null").select(F.col("symbol_key").alias("target_symbol_key"), *parted("document_id"), *far)
    placed = rows.repartition("target_symbol_key").sortWithinPartitions("target_symbol_key", "prefix", *far, "number")
    out = ["target_symbol_key string", "prefix string", "packed binary", *(f"{c} {t}" for c, t in rows.dtypes if c in far)]
    return placed.mapInArrow(lambda batches: _lists(batches, far), ", ".join(out))


def _lists(batches: Iterator[pa.RecordBatch], far: list[str]) -> Iterator[pa.RecordBatch]:
    """Lists from rows that come sorted; repeated rows are one."""
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not len(rows):
            continue
        number = pc.fill_null(rows["number"], -1).to_numpy()
        of = np.append(True, np.any([np.diff(x) != 0 for x in (number < 0, *(_codes(rows[c])[0] for c in ("target_symbol_key", "prefix", *far)))], axis=0))
        new = of | np.append(True, np.diff(number) != 0)
        new[0] = rows.slice(0, 1).to_pylist() != last
        last = rows.slice(len(rows) - 1).to_pylist()
        at = np.flatnonzero(new)
        if not len(at):
            continue
        of[at[0]] = True  # a list that goes on is another row
        firsts = np.flatnonzero(of[at])
        data, offsets = packed(np.maximum(number[at], 0), firsts)
        lists = pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        chosen = rows.take(at[firsts])
        lists = pc.if_else(pa.array(number[at[firsts]] >= 0), lists, pa.scalar(None, pa.binary()))
        yield from pa.table({"target_symbol_key": chosen["target_symbol_key"], "prefix": chosen["prefix"], "packed": lists} | {c: chosen[c] for c in far}).to_batches()


def counted(
    folded: DataFrame, places: DataFrame, kind: str | None = None, samples: bool = False, near: list[str] | None = None, far: list[str] | None = None, more: DataFrame | None = None,
) -> DataFrame:
    """``source, target, reference_count``: each pair of an observing document and one that declares what it observes, with the sum of ``n``.

    ``folded``: ``source, target_symbol_key, n``. With ``samples`` also ``ordinal, file, line, snippet``, of
    which a pair has those of the least ordinal that is not null, ties by snippet, file and line.
    With ``kind``, a column of folded, a pair has the kind of the greatest sum, ties by upper case, then as it is.
    ``near``, columns of folded, and ``far``, of places, that an observing or a declaring document has once, go along.
    ``more``: ``source, target, n`` of pairs that are known already; without the columns before.
    All rows of an observing document meet in one task, some pairs at a time.
    """
    shown = ["file", "line", "snippet"] if samples else []
    kept = [*(near or []), *(far or []), *shown]
    rows = folded.join(places, "target_symbol_key").select("source", "prefix", "packed", "n", *([kind, ci(kind).alias("_ci")] if kind else []), *(["ordinal"] if samples else []), *kept)
    if more is not None:
        rows = rows.unionByName(more.select("source", *parted("target"), "n"), allowMissingColumns=True)
    order = [F.asc_nulls_last("ordinal"), *(F.asc_nulls_first(c) for c in ("snippet", "file", "line"))] if samples else []
    rows = rows.repartition("source").sortWithinPartitions("source", *order)
    if samples:
        rows = rows.withColumns({c: F.when(F.col("ordinal").isNotNull(), F.col(c)) for c in shown}).drop("ordinal")
    types = dict(rows.dtypes)
    out = [f"source {types['source']}", "target string", *([f"{kind} {types[kind]}"] if kind else []), "reference_count bigint", *(f"{c} {types[c]}" for c in kept)]
    return rows.mapInArrow(lambda batches: _pairs(batches, kind, kept), ", ".join(out))


def _pairs(batches: Iterator[pa.RecordBatch], kind: str | None, shown: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts the pairs of rows that come sorted by source, each time up to the last source that is whole."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = pa.Table.from_batches([batch.slice(at, ROWS)])
            held.append(part)
            size += int(_sizes(part).sum())
            if size >= PAIRS:
                rows = pa.concat_tables(held).combine_chunks()
                new = np.flatnonzero(np.diff(_codes(rows["source"])[0]))
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield from _counts(rows.slice(0, cut), kind, shown)
                held, size = [rows.slice(cut)], 0
    if held:
        yield from _counts(pa.concat_tables(held).combine_chunks(), kind, shown)


def _sizes(rows: pa.Table) -> np.ndarray:
    """Bytes of each list, 1 at least: no list has more numbers."""
    return np.maximum(pc.fill_null(pc.binary_length(rows["packed"]), 1).to_numpy().astype(np.int64), 1)


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, for a row without one its own number or -1, and the row of each."""
    lists = rows["packed"].cast(pa.large_binary()).combine_chunks()
    none = np.flatnonzero(pc.is_null(lists).to_numpy(zero_copy_only=False))
    lists = pc.fill_null(lists, b"") if len(none) else lists
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    data = np.frombuffer(lists.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    numbers, sizes = unpacked(data, offsets - offsets[0])
    single = pc.fill_null(rows["number"], -1).to_numpy()[none] if "number" in rows.column_names else np.full(len(none), -1)
    return np.append(numbers, single), np.append(np.repeat(np.arange(len(lists)), sizes), none)


def _folded(keys: list[np.ndarray], count: np.ndarray, row: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The different keys, the last the least important, with the sum of their counts and their first row."""
    spans = [int(k.max()) + 2 for k in keys]
    one = keys[0]
    if np.prod([float(s) for s in spans]) < 2.0**62:
        for k, span in zip(keys[1:], spans[1:], strict=True):
            one = one * span + (k + 1)
        order = np.argsort(one, kind="stable")
        new = np.diff(one[order]) != 0
    else:
        order = np.lexsort(keys[::-1])
        new = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    at = np.flatnonzero(np.append(True, new))
    return [k[order[at]] for k in keys], np.add.reduceat(count[order], at), row[order[at]]


def _counts(rows: pa.Table, kind: str | None, shown: list[str]) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    n, (prefix, prefixes) = rows["n"].to_numpy(), _codes(rows["prefix"])
    source = np.append(0, np.cumsum(np.diff(_codes(rows["source"])[0]) != 0))
    rank = np.zeros(len(rows), np.int64)
    if kind:
        said = list(zip(rows["_ci"].to_pylist(), rows[kind].to_pylist(), strict=True))
        turn = {x: k for k, x in enumerate(sorted(set(said), key=lambda x: [(v is not None, v or "") for v in x]))}
        rank = np.array([turn[x] for x in said], np.int64)
        kinds = pa.array([x[1] for x in turn], rows[kind].type)
    found = []
    upto = np.cumsum(_sizes(rows))
    cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], PAIRS)), len(rows)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        number, row = _unpacked(rows.slice(lo, hi - lo))
        row = row + lo
        found.append(_folded([source[row], prefix[row], number, rank[row]], n[row], row))
    keys, count, row = found[0]
    if len(found) > 1:
        keys = [np.concatenate(k) for k in zip(*(f[0] for f in found), strict=True)]
        keys, count, row = _folded(keys, np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]))
    s, p, number, rank = keys
    if kind:
        new = np.append(True, (np.diff(s) != 0) | (np.diff(p) != 0) | (np.diff(number) != 0))
        best = np.lexsort((rank, -count, np.cumsum(new)))[np.flatnonzero(new)]
        p, number, rank, row, count = p[new], number[new], rank[best], row[new], np.add.reduceat(count, np.flatnonzero(new))
    digits = pc.if_else(pa.array(number >= 0), pa.array(number).cast(pa.string()), "")
    target = pc.binary_join_element_wise(prefixes.take(pa.array(p)), digits, "")
    columns = {"source": rows["source"].take(pa.array(row)), "target": target}
    if kind:
        columns[kind] = kinds.take(pa.array(rank))
    columns["reference_count"] = pa.array(count)
    columns |= {c: rows[c].take(pa.array(row)) for c in shown}
    yield from pa.table(columns).to_batches(max_chunksize=PAIRS)
