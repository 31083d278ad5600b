"""Chat formatting: every dialogue from the perspective of each of its participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.plans.numbering import numbered
from depweave.plans.staging import stage

#: Turns in a part of a long dialogue.
PART = 256
#: Long dialogues up to which their ids are broadcast to the turns.
BROADCAST_IDS = 100_000
#: The marks of a turn, and how they are written where somebody says them.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SAID_OPEN, SAID_CLOSE = "<\\|im_start|>", "<\\|im_end|>"
SYSTEM = "system"


def _plain(said: Column) -> Column:
    return F.replace(F.replace(said, F.lit(OPEN), F.lit(SAID_OPEN)), F.lit(CLOSE), F.lit(SAID_CLOSE))


def _head(speaker: Column, perspective: Column) -> Column:
    name = F.translate(_plain(speaker), "\n\r", "  ")
    return (
        F.when(speaker == SYSTEM, F.lit(SYSTEM))
        .when(speaker == perspective, F.lit("assistant"))
        .when(speaker == "", F.lit("user"))
        .otherwise(F.concat(F.lit("user name="), name))
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("role"), F.md5("text")]


def _parted(rows: DataFrame, size: int) -> DataFrame:
    """rows with ``part``, and ``system``: what the system says first, in all parts of a dialogue but the first.

    Only dialogues of more than ``size`` turns are numbered, by ranges of the whole order, so that
    one of any length is dealt over tasks.
    """
    conv = F.col("conv_id")
    long = stage(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > size).select(conv.alias("long")), "long")
    none = F.lit(None).cast("string").alias("system")
    known = long.count()
    if not known:
        return rows.select("*", F.lit(0).cast("long").alias("part"), none)
    few = F.broadcast(long) if known <= BROADCAST_IDS else long
    short = rows.join(few, conv.eqNullSafe(F.col("long")), "left_anti").select("*", F.lit(0).cast("long").alias("part"), none)
    count = numbered(rows.join(few, conv.eqNullSafe(F.col("long")), "left_semi"), [conv, *_order()], "n")
    first = count.groupBy(conv.alias("of")).agg(F.min("n").alias("first"))
    system = count.where(F.col("role") == SYSTEM).groupBy(conv.alias("of_system")).agg(F.min_by("text", "n").alias("system"))
    starts = stage(first.join(system, F.col("of").eqNullSafe(F.col("of_system")), "left").drop("of_system"), "starts")
    starts = F.broadcast(starts) if known <= BROADCAST_IDS // 100 else starts
    part = F.floor((F.col("n") - F.col("first")) / size).cast("long")
    parted = count.join(starts, conv.eqNullSafe(F.col("of"))).select(*rows.columns, part.alias("part"), F.when(part > 0, F.col("system")).alias("system"))
    return short.unionByName(parted)


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int | None = PART) -> DataFrame:
    """Rows ``conv_id, perspective, part, n_turns, context, text, targets``: one for each participant and part of a dialogue.

    The participants are all who speak, but for the system and speakers without a name. In a
    participant's rendering their turns are the assistant's, the system stays, and everyone else is
    a user who goes by their name. ``targets`` are the spans to learn (start, end in code points of
    the rendered part, end exclusive): what the assistant says, with the mark that closes the turn.

    A dialogue of up to ``part_turns`` turns is one row for each participant. A longer one comes in
    parts of so many turns, so that rows stay of bounded size; each part after the first begins with
    what the system said first, ``context`` code points that are no part of it, so the parts without
    their context make up the whole dialogue. With None every dialogue is one row.

    Turns go by number, those without a number last, then by speaker and MD5 of the text; rows that
    repeat another's number, speaker and text are that turn once more and count once. A null text is
    an empty one. Marks in what is said or in a name are written with a backslash, line breaks in
    names as spaces, so nobody can open or close a turn. Rows with a null id form a dialogue of their
    own. A dialogue in which nobody with a name speaks has no rows.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    parted = _parted(rows, part_turns) if part_turns else rows.select("*", F.lit(0).cast("long").alias("part"), F.lit(None).cast("string").alias("system"))
    each = F.struct(F.col("turn").isNull().alias("none"), "turn", "role", F.md5("text").alias("h"), "text")
    parts = parted.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(each)).alias("turns"), F.max("system").alias("system"))
    who = rows.where(~F.col("role").isin("", SYSTEM)).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    both = parts.join(who, parts["conv_id"].eqNullSafe(who["of"])).drop("of")
    wrap = lambda head, said: F.concat(F.lit(OPEN), head, F.lit("\n"), _plain(said), F.lit(f"{CLOSE}\n"))
    said = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _head(t["role"], F.col("perspective")), F.lit("\n")).alias("head"),
            F.concat(_plain(t["text"]), F.lit(f"{CLOSE}\n")).alias("body"), (t["role"] == F.col("perspective")).alias("own"),
        ),
    )
    context = F.coalesce(wrap(F.lit(SYSTEM), F.col("system")), F.lit(""))
    start = F.struct(F.length("before").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        begin = done["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        # The line feed after the closing mark belongs to the frame.
        span = F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return both.withColumns({"said": said, "before": context}).select(
        "conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), F.length("before").cast("long").alias("context"),
        F.concat("before", F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["body"])), "")).alias("text"),
        F.aggregate("said", start, step)["spans"].alias("targets"),
    )
