"""Distinct counts that can be merged and taken apart, as bitmaps over dense ids.

A bitmap holds the ids of one key within one source (an upload, a day) and one range of 32,768 ids.
Bitmaps of several sources are combined by "or", so distinct counts over any choice of sources, with
one withdrawn or one added, come from the stored bitmaps and never from the ids again. They are exact.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(rows: DataFrame, keys: Sequence[str], source: str, ids: str) -> DataFrame:
    """(source, keys, bucket, bits): the ids (long, from 0, best dense) of each key and source. Repeated rows count once; rows without an id drop out.

    Built with partial results in each task, so a key of any share of the rows sends one bitmap for each task and range.
    """
    there = rows.where(F.col(ids).isNotNull())
    return there.groupBy(F.col(source).alias("source"), *keys, F.bitmap_bucket_number(ids).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(ids)).alias("bits"))


def merged(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bucket, bits) over all sources."""
    return maps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(maps: DataFrame, keys: Sequence[str], without: Collection[str] = ()) -> DataFrame:
    """(keys, n): different ids of each key over all sources but those given; a key that has none left is absent."""
    kept = maps.where(~F.col("source").isin(*without)) if without else maps
    return merged(kept, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).cast("long").alias("n"))


def vanishing_counts(maps: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """(keys, n): ids that go with a source, as no other has them, of the keys that lose any."""
    with_it = distinct_counts(maps, keys).withColumnRenamed("n", "before")
    left = distinct_counts(maps, keys, [source])
    both = with_it.hint("merge").join(left, [*keys], "left")
    return both.select(*keys, (F.col("before") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
