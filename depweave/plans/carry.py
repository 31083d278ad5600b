"""Carries values forward along an order within keys, without bringing a key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.plans.staging import stage


#: Rows of the largest key up to which a key is one window; beyond, the order is cut into ranges. Both give the same.
KEY_ROWS = 1_000_000


def ranged(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """df dealt by ranges of keys and order, staged, with ``_m`` (ascending in that order over all rows) and ``_p``, the range.

    A key of a third of the rows stands in a third of the ranges.
    """
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    return stage(placed, "ranged").withColumn("_p", F.shiftright("_m", 33))


def carried(df: DataFrame, keys: list[str], order: list[str | Column], value: str, out: str, inclusive: bool = True, key_rows: int = KEY_ROWS) -> DataFrame:
    """df with ``out``: the last ``value`` that is not null among the rows of the same keys up to this one, or up to the one before it.

    ``order`` should tell all rows of a key apart. The rows of the largest key are counted first. If
    they are more than ``key_rows``, rows are dealt by ranges of keys and order; the value is carried
    within each range, and the last one of each range into those after it, as long as they go on
    with its key. That takes one row for each range. Null keys are a key.
    """
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    if (df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= key_rows:
        return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)))
    placed = ranged(df, keys, order)
    key = F.struct(*keys)
    upto = Window.partitionBy("_p", *keys).orderBy("_m").rowsBetween(*frame)
    here = placed.withColumn(out, F.last(value, ignorenulls=True).over(upto))
    last = F.struct(key.alias("k"), F.col(value).isNotNull().alias("has"), F.col("_m").alias("m"))
    edges = placed.groupBy("_p").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(value, last).alias("tail"))
    # One row for each range from here on. All ranges that end with a key follow each other.
    run = F.last("tail", ignorenulls=True).over(Window.partitionBy("last").orderBy("_p"))
    before = Window.orderBy("_p")
    entries = edges.withColumn("run", run).select(
        F.col("_p").alias("_q"), "first", F.when(F.lag("last").over(before).eqNullSafe(F.col("first")), F.lag("run").over(before)).alias("entry"),
    )
    entries = F.broadcast(entries.where("entry is not null"))
    both = here.join(entries, F.col("_p") == F.col("_q"), "left")
    return both.withColumn(out, F.coalesce(out, F.when(key.eqNullSafe(F.col("first")), F.col("entry")))).drop("_p", "_m", "_q", "first", "entry")
