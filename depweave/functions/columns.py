"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def ci(x: ColumnOrName) -> Column:
    """The key under which texts that differ in case only are equal: upper case, so that ``_`` follows the letters.

    A sharp s has no upper case of one letter and stays.
    """
    return F.translate(F.upper(F.translate(col(x), "ß", "\u0001")), "\u0001", "ß")


def struct_udf(each: Callable[[list], list[list]], fields: list[tuple[str, pa.DataType]], ddl: str) -> Callable[[Column], Column]:
    """A column function: ``each`` maps the values of a batch to a list for each field. It is never computed twice."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.StructArray.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(each(values.to_pylist()), fields, strict=True)], names=[n for n, _ in fields])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ddl).asNondeterministic()
