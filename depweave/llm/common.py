"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a batch that goes to Python; texts may be long, so a batch of the default 10,000 may be large.
BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the memory of Python workers: at most so many rows are in a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for measuring: crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """Whether labels of a document may be learnt; false for a null id."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def sample_share(column: Column, share: float, seed: int) -> Column:
    """A sample by hash of so large a share, the same rows at every run; exact to a share of 2**-62."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 62)) < F.lit(int(min(1.0, share) * (1 << 62)))


def struct_udf(each: Callable[[list], list[list]], fields: list[tuple[str, pa.DataType]], ddl: str, arrow: bool = False) -> Callable[..., Column]:
    """A column function over one column: ``each`` maps the values of a batch, as a list or
    as they come from Arrow, to a list per field.

    It is marked as not deterministic so that the optimizer never computes it twice.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            got = each(values if arrow else values.to_pylist())
            yield pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, (_, kind) in zip(got, fields, strict=True)], names=[n for n, _ in fields])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ddl).asNondeterministic()
