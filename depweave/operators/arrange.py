"""Orders and places that follow from ranks: strips, sections, lanes, springs, step functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.operators.edges import observed
from depweave.operators.graph import kind_rank
from depweave.operators.pairs import counted, places
from depweave.plans.numbering import numbered

#: Groups of nodes in the order in which they are placed.
GROUPS = ("project", "document", "symbol", "package", "assembly", "dll")

#: The length at which an edge of a kind is at rest, and how stiff it is; all others 100 and 0.6.
REST = {
    "contains-document": 180.0, "contains-symbol": 96.0, "project-reference": 220.0, "document-reference": 160.0, "symbol-call": 120.0, "symbol-inheritance": 140.0,
    "symbol-implementation": 140.0, "project-package": 168.0, "project-assembly": 168.0, "project-dll": 168.0, "symbol-creation": 128.0,
}
STIFF = {"contains-document": 0.9, "contains-symbol": 0.9, "project-reference": 0.45}

#: Step functions of a count, as (greatest count, value) from the bottom; the last value has no bound.
SECTION_ROWS = ((24, 6), (96, 10), (None, 14))
SYMBOL_COLUMNS = ((10, 1), (28, 2), (54, 3), (None, 4))
SEED_COLUMNS = ((10, 2), (24, 3), (None, 4))
EXTERNAL_COLUMNS = ((12, 4), (24, 5), (None, 6))
PADDING = ((499, 56), (1399, 84), (None, 120))
ZOOM = ((71, 1.0), (399, 0.72), (1199, 0.52), (None, 0.32))
ZOOM_WITH_SYMBOLS = ((279, 0.64), (899, 0.42), (1799, 0.24), (2999, 0.16), (None, 0.12))
DOCUMENT_COLUMNS = ((4, 1), (10, 2), (20, 4), (40, 5), (None, 6))
DOCUMENT_COLUMNS_WITH_SYMBOLS = ((4, 1), (10, 2), (20, 3), (40, 4), (None, 5))


def ladder(n: Column, steps: tuple, own_below: int | None = None) -> Column:
    """The value of the step that n is on; up to ``own_below`` it is n itself, but 1 at least."""
    out = F.lit(steps[-1][1])
    for most, value in reversed(steps[:-1]):
        out = F.when(n <= most, value).otherwise(out)
    return out if own_below is None else F.when(n <= own_below, F.greatest(F.lit(1), n)).otherwise(out)


def document_columns(n: Column, symbols: bool, widest: Column) -> Column:
    """Columns of a project's documents; without symbols one less for 11 to 20 that are wide."""
    if symbols:
        return ladder(n, DOCUMENT_COLUMNS_WITH_SYMBOLS)
    return F.when((n > 10) & (n <= 20) & (widest > 220), 3).otherwise(ladder(n, DOCUMENT_COLUMNS))


def group_rank(group: Column) -> Column:
    rank = F.lit(len(GROUPS))
    for i, name in enumerate(GROUPS):
        rank = F.when(group == name, i).otherwise(rank)
    return rank


def placement_order(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``seed, peer, place``: neighbours of a seed by group, kind of edge, weight from the top and label.

    ``placed``: ``seed, peer, weight, kind``; ``nodes``: ``id, group, label``.
    """
    rows = placed.join(nodes.select(F.col("id").alias("peer"), "group", "label"), "peer")
    order = Window.partitionBy("seed").orderBy(group_rank(F.col("group")), kind_rank(F.col("kind")), F.desc("weight"), F.lower("label"), "label", "peer")
    return rows.select("seed", "peer", F.row_number().over(order).alias("place"))


def cluster_order(clusters: DataFrame) -> DataFrame:
    """clusters (``seed, direction, lane, kind, weight, context``) with ``place``: within a direction by lane, kind, weight from the top and name."""
    order = Window.partitionBy("seed", "direction").orderBy("lane", kind_rank(F.col("kind")), F.desc("weight"), F.lower("context"), "context")
    return clusters.withColumn("place", F.row_number().over(order))


def springs(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """``source, target, kind, length, stiffness``: the length at which an edge rests and how hard it pulls.

    ``sizes``: ``id, half_width, padding``. Loops and edges of unknown nodes drop out. The length is at least
    64 and leaves 32 beyond what both nodes need; weight stiffens by its logarithm, twofold at most.
    """
    return _springs(edges.where("source <> target").join(_sizes(sizes, "source", 1), "source").join(_sizes(sizes, "target", 2), "target"))


def document_springs(observations: DataFrame, declarations: DataFrame, sizes: DataFrame) -> DataFrame:
    """Springs of the edges between documents (``sizes`` of documents); each end has its size before pairs are made."""
    said = observations.join(_sizes(sizes, "source_document_id", 1), "source_document_id")
    known = declarations.join(_sizes(sizes, "document_id", 2), "document_id")
    found = counted(observed(said, "_w1", "_p1"), places(known, ["_w2", "_p2"]), near=["_w1", "_p1"], far=["_w2", "_p2"])
    return _springs(found.where("source <> target").select("source", "target", F.lit("document-reference").alias("kind"), F.col("reference_count").alias("weight"), "_w1", "_p1", "_w2", "_p2"))


def _sizes(sizes: DataFrame, end: str, p: int) -> DataFrame:
    return sizes.select(F.col("id").alias(end), F.col("half_width").alias(f"_w{p}"), F.col("padding").alias(f"_p{p}"))


def _springs(rows: DataFrame) -> DataFrame:
    pick = lambda table, rest: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col("kind")), F.lit(rest))
    room = F.col("_w1") + F.col("_w2") + F.greatest("_p1", "_p2") + 32.0
    pull = F.least(F.lit(2.0), 1.0 + 0.1 * F.ln(F.greatest(F.lit(1), F.coalesce("weight", F.lit(1))) + 1.0))
    return rows.select("source", "target", "kind", F.greatest(F.lit(64.0), pick(REST, 100.0), room).alias("length"), (pick(STIFF, 0.6) * pull).alias("stiffness"))


def _seats(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with ``i`` (from 0 by label within its key) and ``n`` (how many the key has); no key meets in one task."""
    rows = numbered(nodes, [*keys, F.lower("label"), "label", "id"], "_at")
    spans = rows.groupBy(*keys).agg(F.min("_at").alias("_from"), F.count("*").alias("n"))
    return rows.join(spans, keys).withColumn("i", F.col("_at") - F.col("_from")).drop("_at", "_from")


def sections(counts: DataFrame, cell: float, canvas: float) -> DataFrame:
    """``symbol_kind, left, top, rows``: where the section of each kind stands.

    Sections follow each other by kind, 96 apart, and wrap where the canvas ends. ``counts``:
    ``symbol_kind, n``; kinds are the words of a language, so they are folded in one row.
    """
    rows = ladder(F.col("n"), SECTION_ROWS, own_below=6).cast("double")
    wide, high = F.greatest(F.lit(160.0), F.ceil(F.col("n") / rows) * cell), F.greatest(F.lit(72.0), rows * 46.0)
    line = counts.select("symbol_kind", rows.alias("rows"), wide.alias("wide"), high.alias("high"))
    every = line.agg(F.array_sort(F.collect_list(F.struct(F.lower("symbol_kind").alias("k"), "symbol_kind", "rows", "wide", "high"))).alias("s"))
    half = canvas / 2
    seat = "struct<symbol_kind:string,left:double,top:double,rows:double>"
    zero = F.struct(F.lit(-half).alias("x"), F.lit(32.0).alias("y"), F.lit(0.0).alias("h"), F.array().cast(f"array<{seat}>").alias("out"))

    def put(state: Column, s: Column) -> Column:
        wraps = state["x"] + s["wide"] > half
        x, y = F.when(wraps, -half).otherwise(state["x"]), F.when(wraps, state["y"] + state["h"] + 96.0).otherwise(state["y"])
        h = F.greatest(F.when(wraps, 0.0).otherwise(state["h"]), s["high"])
        here = F.struct(s["symbol_kind"].alias("symbol_kind"), x.alias("left"), y.alias("top"), s["rows"].alias("rows"))
        return F.struct((x + s["wide"] + 96.0).alias("x"), y.alias("y"), h.alias("h"), F.concat(state["out"], F.array(here.cast(seat))).alias("out"))

    return every.select(F.inline(F.aggregate("s", zero, put)["out"]))


def massive(nodes: DataFrame) -> DataFrame:
    """``id, x, y``: projects, documents and externals in centred strips, symbols in sections by kind.

    ``nodes``: the visible ones, ``id, group, label, symbol_kind``. Columns and cells depend on how many there are.
    """
    n = nodes.count()
    many = n >= 1200
    strips = {"project": (-360.0, 260.0, 4 if many else 6, 120.0), "document": (-120.0, 188.0, 6 if many else 8, 92.0), "external": (360.0, 164.0, 8 if many else 6, 84.0)}
    group = F.when(F.col("group").isin("package", "assembly", "dll"), "external").otherwise(F.col("group"))
    seats = _seats(nodes.withColumn("group", group).where(F.col("group").isin(*strips)), ["group"])
    pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for g, v in strips.items() for x in (g, float(v[k])))), F.col("group"))
    per = pick(2).cast("long")
    line, lines = F.floor(F.col("i") / per), F.ceil(F.col("n") / per)
    here = F.least(per, F.col("n") - line * per)
    above = F.when(F.col("group") == "external", 0.0).otherwise((lines - 1) / 2)  # externals grow downwards, the others from their middle
    placed = seats.select("id", ((F.col("i") % per - (here - 1) / 2) * pick(1)).alias("x"), (pick(0) + (line - above) * pick(3)).alias("y"))
    cell, canvas = (124.0, 2200.0) if n >= 1400 else (136.0, 1800.0)
    symbols = _seats(nodes.where("group = 'symbol'").withColumn("symbol_kind", F.coalesce("symbol_kind", F.lit("Unknown"))), ["symbol_kind"])
    at = sections(symbols.groupBy("symbol_kind").agg(F.count("*").alias("n")), cell, canvas)
    column, row = F.floor(F.col("i") / F.col("rows")), F.col("i") % F.col("rows")
    inside = symbols.join(at, "symbol_kind").select("id", (F.col("left") + column * cell + cell / 2).alias("x"), (F.col("top") + row * 46.0 + 23.0).alias("y"))
    return placed.unionByName(inside)
