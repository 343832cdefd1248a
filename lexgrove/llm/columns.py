"""Column names as they come: quoted, and new ones that clash with none."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def every(names: Iterable[str]) -> list[Column]:
    """The columns of these names, whatever characters these have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered_names(df: DataFrame) -> DataFrame:
    """The columns under names by place (c0, c1, ...), which every function of Spark takes; toDF gives names back."""
    return df.toDF(*[f"c{n}" for n in range(len(df.columns))])


#: Rows of a batch on the way to a worker where the session has Spark's own 10000.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends batches of BATCH_ROWS rows, unless it has a setting of its own.

    Texts are long rows: ten thousand of them, in both directions and for each core, are
    what an executor has outside its heap.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


class Texts(NamedTuple):
    """Rows on their way to a function on batches: a text column and columns to keep, all under names by place."""

    rows: DataFrame
    #: The schema of the kept columns.
    schema: StructType
    #: Which column is the text, and how many columns stand before the kept ones.
    at: int
    skip: int


def texts_of(df: DataFrame, keep: Iterable[str], text: str = "text") -> Texts:
    """The text as a string and the columns to keep; a text that is kept as it is travels once."""
    keep = list(keep)
    small_batches(df)
    if text in keep and dict(df.dtypes)[text] == "string":
        rows = numbered_names(df.select(*every(keep)))
        return Texts(rows, rows.schema, keep.index(text), 0)
    rows = numbered_names(df.select(F.col(text).cast("string").alias(fresh(df, "text")), *every(keep)))
    return Texts(rows, StructType(rows.schema.fields[1:]), 0, 1)
