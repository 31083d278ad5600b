"""Numbers rows in an order, over all rows or within keys, without bringing many of them into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.plans.carry import KEY_ROWS
from depweave.plans.staging import stage


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with ``out``: 1, 2, ... in the given order.

    Rows are dealt by ranges of the order and numbered within each; then the sizes of the ranges
    before (one row for each task) are added.
    """
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part, local = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    return placed.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(out, F.col("_before") + local + 1).drop("_p", "_m", "_before")


def largest_key(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def places(df: DataFrame, keys: list[str], order: list[str | Column], out: str, total: str, most: int | None = None, key_rows: int = KEY_ROWS) -> DataFrame:
    """df with ``out``, 1, 2, ... within each key, and ``total``, the rows of the key; both are whole numbers.

    ``most``: rows of the largest key, counted if it is not given. Up to ``key_rows`` a key is one
    window; if any has more, all rows are numbered by ranges of keys and order. Null keys are a key.
    """
    if (largest_key(df, keys) if most is None else most) <= key_rows:
        w = Window.partitionBy(*keys)
        return df.withColumns({out: F.row_number().over(w.orderBy(*order)), total: F.count("*").over(w)})
    rows = numbered(df, [F.col(k).asc_nulls_first() for k in keys] + list(order), "_at")
    spans = rows.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.min("_at").alias("_from"), F.count("*").alias(total))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    both = rows.join(spans, same).withColumn(out, (F.col("_at") - F.col("_from") + 1).cast("int"))
    return both.drop("_at", "_from", *(f"_of_{k}" for k in keys))
