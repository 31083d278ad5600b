"""Conversation structure repair: faults of each turn, and the cheapest edits after which the roles alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import struct_udf
from depweave.llm.edit_lattice import BLANK, DUPLICATE, ENDS, FINE, NOTHING, TRUNCATED, cheapest, replay
from depweave.plans.numbering import numbered
from depweave.plans.staging import stage, unstage

#: Rows of a block: a conversation of more is searched block by block.
BLOCK = 256
#: Long conversations up to which their ids are broadcast to the rows.
BROADCAST_IDS = 100_000
#: White space, ends of sentences, and pairs of role initials that may follow each other.
SPACE, STOPS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")
#: Kinds of damage, of 20.
DROP, EMPTY, UNSTOPPED, REPEAT, AS_USER = range(5)
_NONE = hashlib.sha256(b"").hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, kept`` of conversations with faults put in by crc32(``conv_id:turn``) % 20.

    Nulls are one space, but conv_id and turn stay null as columns. A dropped row is there with
    ``kept`` false, so that its conversation is not forgotten; a repeated one is there twice.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), kind.alias("kind"), word("role").alias("role"), word("text").alias("text"))
    text = F.when(F.col("kind") == EMPTY, F.lit("")).when(F.col("kind") == UNSTOPPED, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == AS_USER, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == REPEAT, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != DROP).alias("kept"), times.alias("_times")).drop("_times")


def faults(turns: list[tuple[str, str]]) -> list[int]:
    """The first fault of each turn (role, text)."""
    seen, out = set(), []
    for turn in turns:
        said = turn[1].strip(SPACE)
        out.append(BLANK if not said else DUPLICATE if turn in seen else TRUNCATED if said[-1] not in STOPS else FINE)
        seen.add(turn)
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FIELDS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", _TURNS)]
_DDL = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _as_turns(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in turns]


def _whole(conversations: list[list[dict]]) -> list[list]:
    """All that is asked about conversations of one block each."""
    found = []
    for c in conversations:
        turns = [(t["role"], t["text"]) for t in c]
        marks, initials = faults(turns), [r[:1] for r, _ in turns]
        cost, audit = cheapest(list(zip(initials, marks, strict=True)))
        found.append((*(marks.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)), _illegal(initials), cost, audit, _as_turns(replay(audit, turns))))
    return [list(x) for x in zip(*found, strict=True)] if found else [[] for _ in _FIELDS]


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _gaps(least: Column, most: Column, different: Column) -> Column:
    """Missing numbers between the least and the most; 0 without numbers."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.coalesce((wide(most) - wide(least) + 1 - wide(different)).try_cast("long"), F.lit(0).cast("long"))


def split(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """rows of conversations of up to ``block`` kept rows, and those of longer ones (None if there are none)."""
    sizes = rows.groupBy(F.col("conv_id").alias("of")).agg(F.count_if("kept").alias("n")).where(F.col("n") > block)
    long = stage(sizes.select("of"), "long")
    known = long.count()
    if not known:
        unstage(long)
        return rows, None
    ids = F.broadcast(long) if known <= BROADCAST_IDS else long
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    return rows.join(ids, same, "left_anti"), rows.where("kept").join(ids, same, "left_semi")


def short_repairs(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired`` of conversations of one block."""
    turn = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "text")
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), turn))).alias("turns"))
    numbers = F.filter(F.col("turns.turn"), lambda t: t.isNotNull())
    gaps = _gaps(F.array_min(numbers), F.array_max(numbers), F.size(F.array_distinct(numbers)))
    said = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    run = struct_udf(_whole, _FIELDS, _DDL)
    return each.select("conv_id", gaps.alias("gaps"), run(said).alias("r")).select("conv_id", "gaps", "r.*")


def _paths(blocks: list[list[dict]]) -> list[list]:
    """Of each block the cheapest edits from every state to every state, and the role initials at its ends."""
    out = [[], [], [], []]
    for b in blocks:
        rows = [(t["role"][:1], t["fault"]) for t in b]
        ways = [{"from": s, "to": e, "cost": w[0], "audit": w[1]} for s in range(4) for e in range(4) if (w := cheapest(rows, s, (e,)))]
        for column, value in zip(out, (rows[0][0], rows[-1][0], _illegal([r for r, _ in rows]), ways), strict=True):
            column.append(value)
    return out


def _follow(conversations: list[list[dict]]) -> list[list]:
    """The cheapest way through the blocks of each conversation: cost, audit of each block, the states it begins with, and illegal pairs."""
    out = [[], [], [], []]
    for blocks in conversations:
        now = {NOTHING: (0, "", (), ())}  # by state: cost, audit so far, audits and beginnings of blocks
        for b in blocks:
            least: dict[int, list] = {}
            for w in b["ways"]:
                if w["from"] in now:
                    least.setdefault(w["to"], []).append((now[w["from"]][0] + w["cost"], w))
            new = {}
            for to, ways in least.items():
                cost = min(c for c, _ in ways)
                audit, way = min(((now[w["from"]][1] + w["audit"], w) for c, w in ways if c == cost), key=lambda x: x[0])
                was = now[way["from"]]
                new[to] = (cost, audit, (was[2], way["audit"]), (was[3], way["from"]))
            now = new
        cost, _, audits, begins = min(now[e] for e in ENDS if e in now)
        chain = [[], []]
        for into, links in zip(chain, (audits, begins), strict=True):
            while links:
                links, value = links
                into.append(value)
            into.reverse()
        across = _illegal_across(blocks)
        for column, value in zip(out, (cost, chain[0], chain[1], across), strict=True):
            column.append(value)
    return out


def _illegal_across(blocks: list[dict]) -> int:
    return sum(b["illegal"] for b in blocks) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(blocks, blocks[1:]))


def long_repairs(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The same for conversations of many blocks: reports without ``repaired``, and ``conv_id, block, repaired``.

    Rows are numbered by ranges of the whole order and cut into blocks; each block is searched from
    every state to every state by a task of its own, and a fold over the blocks picks the way. A
    conversation meets in one task as the short strings of this fold only.
    """
    conv = F.col("conv_id")
    count = numbered(rows.select("conv_id", "turn", "role", "text"), [conv.asc_nulls_first(), *_order()], "n")
    firsts = stage(count.groupBy(conv.alias("of")).agg(F.min("n").alias("first"), F.min("turn").alias("low"), F.max("turn").alias("high")), "firsts")
    count = count.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_IDS // 10 else firsts, conv.eqNullSafe(F.col("of")))
    said = F.rtrim("text", F.lit(SPACE))
    marked = count.select("conv_id", "turn", (F.col("n") - F.col("first")).alias("at"), "role", "text", said.alias("said"), F.sha2("text", 256).alias("h"))
    marked = stage(marked, "marked")
    once = marked.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("t")).agg(F.min("at").alias("seen"))
    both = marked.join(once, conv.eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("t")))
    fault = (
        F.when(F.col("said") == "", BLANK).when(F.col("at") > F.col("seen"), DUPLICATE)
        .when(F.instr(F.lit(STOPS), F.right("said", F.lit(1))) == 0, TRUNCATED).otherwise(FINE)
    )
    rows = both.select("conv_id", F.floor(F.col("at") / block).cast("long").alias("block"), "at", "role", "text", fault.alias("fault"))
    parts = rows.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text", "fault"))).alias("rows"),
        *(F.count_if(F.col("fault") == k).alias(n) for n, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))),
    )
    ways = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    run = struct_udf(_paths, [("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("ways", ways)], "first string, last string, illegal long, ways array<struct<`from`:int,`to`:int,cost:long,audit:string>>")
    parts = stage(parts.withColumn("r", run(F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["fault"].alias("fault"))))), "blocks")
    step = F.struct("block", F.col("r.first").alias("first"), F.col("r.last").alias("last"), F.col("r.illegal").alias("illegal"), F.col("r.ways").alias("ways"))
    follow = struct_udf(_follow, [("cost", pa.int64()), ("audits", pa.list_(pa.string())), ("begins", pa.list_(pa.int32())), ("illegal", pa.int64())], "cost long, audits array<string>, begins array<int>, illegal long")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")))
    whole = stage(whole.withColumn("f", follow("steps")).drop("steps"), "followed")
    turns = marked.where("turn is not null").select("conv_id", "turn").distinct().groupBy(conv.alias("t")).agg(F.count("*").alias("turns"))
    spans = firsts.join(turns, F.col("of").eqNullSafe(F.col("t")), "left")
    gaps = _gaps(F.col("low"), F.col("high"), F.col("turns"))
    report = whole.join(spans, conv.eqNullSafe(F.col("of"))).select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "f.illegal", "f.cost", F.array_join("f.audits", "").alias("audit"),
    )
    chosen = whole.select(conv.alias("of"), F.posexplode(F.arrays_zip(F.col("f.audits").alias("audit"), F.col("f.begins").alias("begin"))).alias("at", "w"))
    mended = parts.join(chosen, conv.eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    edit = struct_udf(
        lambda xs: [[_as_turns(replay(x["audit"], [(t["role"], t["text"]) for t in x["rows"]], x["begin"])) for x in xs]], [("repaired", _TURNS)], "repaired array<struct<role:string,text:string>>",
    )
    return report, mended.select("conv_id", "block", edit(F.struct(F.col("w.audit").alias("audit"), F.col("w.begin").alias("begin"), "rows")).alias("r")).select("conv_id", "block", "r.repaired")


def lines(repaired: Column) -> Column:
    """A repaired conversation as one text, a line ``role:text`` for each turn."""
    return F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def block_hashes(mended: DataFrame) -> DataFrame:
    """``of, sha``: the hash of each conversation's lines, block after block; a conversation is one stream, of which a task holds a batch."""
    rows = mended.where(F.size("repaired") > 0).select(F.col("conv_id").alias("of"), "block", lines(F.col("repaired")).alias("said"))
    rows = rows.repartition("of").sortWithinPartitions("of", "block")
    kind = mended.select(F.col("conv_id").alias("of"), F.lit("").alias("sha")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, schema = None, None, None
        for batch in batches:
            done = []
            schema = pa.schema([batch.schema.field("of"), pa.field("sha", pa.string())])
            for of, said in zip(batch.column("of").to_pylist(), batch.column("said").to_pylist(), strict=True):
                if sums is None or of != now:
                    if sums is not None:
                        done.append((now, sums.hexdigest()))
                    now, sums = of, hashlib.sha256()
                else:
                    sums.update(b"\n")
                sums.update(said.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], schema.field("of").type), pa.array([x for _, x in done], pa.string())], schema=schema)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], schema.field("of").type), pa.array([sums.hexdigest()])], schema=schema)

    return rows.mapInArrow(run, kind)


def report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conversation of ``conv_id, turn, role, text, kept``: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows go by turn, nulls first, then by role and text. A conversation none of whose rows is kept
    has zeros, an empty audit and the hash of nothing. Rows with a null conv_id are one conversation.
    """
    short, long = split(rows, block)
    found = short_repairs(short).withColumn("repaired_sha256", F.sha2(lines(F.col("repaired")), 256)).drop("repaired")
    if long is None:
        return found
    reports, mended = long_repairs(long, block)
    more = reports.join(block_hashes(mended), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return found.unionByName(more.withColumn("repaired_sha256", F.coalesce("sha", F.lit(_NONE))).drop("sha"))


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: ``conv_id, block, turn, role, text``, turns from 0 within each block."""
    short, long = split(rows, block)
    parts = short_repairs(short).select("conv_id", F.lit(0).cast("long").alias("block"), "repaired")
    if long is not None:
        parts = parts.unionByName(long_repairs(long, block)[1])
    return parts.select("conv_id", "block", F.posexplode("repaired").alias("turn", "t")).select("conv_id", "block", "turn", "t.role", "t.text")
