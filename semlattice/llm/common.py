"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.scratch import join_checked, saved

__all__ = ["ARROW_ROWS", "batches_of", "components", "free_name", "hashable", "join_checked", "row_key", "saved", "small_batches", "table"]

#: Rows of one Arrow batch; a batch of the longest texts stays below some hundred MB.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, as a text may have hundreds of KB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside; the session's setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hashable(docs: DataFrame) -> list[Column]:
    """The columns, those that hold maps as text."""
    return [F.to_json(F.struct(F.col(f"`{n}`"))) if "map<" in kind else F.col(f"`{n}`") for n, kind in docs.dtypes]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many '_' before it as it takes to differ from all columns, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key() -> Column:
    """A hash of doc_id and text, by which stages decide on rows."""
    return F.xxhash64(F.lit(11), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
