"""Listings that are stored by rank, so that any page reads the files of its own rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.scratch import folder, numbered

#: Rows of a folder.
BLOCK = 10_000


@dataclass(frozen=True)
class Listing:
    """Rows at path, by folders `block` of equal ranges of ranks; `total` rows in all."""

    spark: SparkSession
    path: str
    total: int
    block: int
    schema: str

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows offset to offset + limit in the listing's order, with total and has_more. Reads one or two folders, however deep the page is."""
        if limit < 1 or offset < 0:
            raise ValueError("limit must be 1 or more, offset 0 or more")
        first, last = offset // self.block, (offset + limit - 1) // self.block
        rows = self.spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/rows").where((F.col("block") >= first) & (F.col("block") <= last) & (F.col("rank") >= offset) & (F.col("rank") < offset + limit))
        return rows.orderBy("rank").drop("block", "rank").withColumn("total", F.lit(self.total).cast("long")).withColumn("has_more", F.lit(self.total > offset + limit))


def listed(rows: DataFrame, order: Sequence[str | Column], path: str | None = None, block: int = BLOCK) -> Listing:
    """Writes the rows by their rank in a total order. Ranks are places within ranges plus the rows of the ranges before: no task sees all rows."""
    spark = rows.sparkSession
    path = path or f"{folder(spark)}/listing-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = numbered(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), "rank").withColumn("block", F.floor(F.col("rank") / block))
    ranked.repartitionByRange(parts, "rank").sortWithinPartitions("rank").write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    schema = StructType([*[f for f in ranked.schema.fields if f.name != "block"], ranked.schema["block"]])
    total = spark.read.schema(schema).parquet(f"{path}/rows").count()
    spark.createDataFrame([(total, block, schema.json())], "total long, block int, schema string").write.mode("overwrite").parquet(f"{path}/meta")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Listing:
    """A listing that was written before."""
    row = spark.read.parquet(f"{path}/meta").first()
    return Listing(spark, path, row["total"], row["block"], row["schema"])
