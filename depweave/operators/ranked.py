"""Windows, caps and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.plans.carry import carried


def retained(snapshots: DataFrame, workspace: str = "workspace", id_: str = "snapshot_id", keep: int = 20) -> DataFrame:
    """The last ``keep`` snapshots of each workspace."""
    last = Window.partitionBy(workspace).orderBy(F.desc(id_))
    return snapshots.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= keep).drop("_n")


def latest(snapshots: DataFrame, workspace: str = "workspace", id_: str = "snapshot_id") -> DataFrame:
    """The row of the greatest id of each workspace."""
    rest = [c for c in snapshots.columns if c != workspace]
    return snapshots.groupBy(workspace).agg(F.max_by(F.struct(*rest), id_).alias("r")).select(workspace, "r.*")


def without_repeats(states: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """States that differ from the one before. A key of many states is dealt over tasks by ranges of the order."""
    placed = carried(states.withColumn("_s", F.struct(state)), [key], order, "_s", "_b", inclusive=False)
    before = F.col(f"_b.{state}")
    return placed.where(~before.eqNullSafe(F.col(state)) | before.isNull()).drop("_b", "_s")


def last_states(states: DataFrame, key: str, order: list[str], keep: int = 80) -> DataFrame:
    """The last ``keep`` states of each key, with ``place`` from 1 on."""
    down = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    kept = states.withColumn("_n", F.row_number().over(down)).where(F.col("_n") <= keep).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def capped_sections(items: DataFrame, keys: list[str], order: list[str], cap: int | None = 96) -> DataFrame:
    """The first ``cap`` items of each section, with ``omitted``: how many are left out. Without a cap, as in sections that are filtered and in those of files, all."""
    if cap is None:
        return items.withColumn("omitted", F.lit(0))
    w = Window.partitionBy(*keys)
    ranked = items.withColumn("_n", F.row_number().over(w.orderBy(*order)))
    totals = items.groupBy(*keys).agg(F.count("*").alias("_t"))
    return ranked.where(F.col("_n") <= cap).join(totals, keys).withColumn("omitted", F.greatest(F.lit(0), F.col("_t") - cap)).drop("_n", "_t")


def top_peers(edges: DataFrame, keys: list[str], peer: str = "peer", ordinal: str = "ordinal", top: int = 12) -> DataFrame:
    """The first ``top`` different peers of each key in the order of edges; the label tells a weight above 1."""
    first = edges.groupBy(*keys, peer).agg(F.min_by(F.struct(ordinal, "label", "weight"), ordinal).alias("r")).select(*keys, peer, "r.*")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)))
    text = F.when(F.col("weight") > 1, F.concat("label", F.lit(" ("), F.col("weight").cast("string"), F.lit(")"))).otherwise(F.col("label"))
    return ranked.where(F.col("rank") <= top).select(*keys, peer, "rank", text.alias("text"))


def last_rows(rows: DataFrame, ordinal: str = "ordinal", keep: int = 2000) -> DataFrame:
    """The last ``keep`` rows, in order."""
    return rows.orderBy(F.desc(ordinal)).limit(keep).orderBy(ordinal)


def recents(opened: DataFrame, path: str = "path", at: str = "at", keep: int = 20) -> DataFrame:
    """Paths, whatever the case, by when they were last opened, the latest first."""
    last = opened.groupBy(F.upper(path).alias("_u")).agg(F.max_by(F.struct(path, at), at).alias("r")).select("r.*")
    return last.orderBy(F.desc(at), path).limit(keep)


def in_line_order(symbols: DataFrame, reloaded: bool = False) -> DataFrame:
    """Symbols with ``place``: within their document by line and name; after a reload by name in upper case."""
    order = ["line", F.upper("name") if reloaded else F.col("name"), "symbol_id"]
    return symbols.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).orderBy("document_id", "place")
