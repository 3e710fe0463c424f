import os

import pytest
from pyspark.sql import functions as F

from semlattice.plans import scratch


def test_numbers_are_dense(spark):
    got = scratch.numbered(spark.range(0, 5000, 1, 7).select((F.col("id") * 3).alias("x")).repartition(5))
    assert sorted(r["id"] for r in got.collect()) == list(range(5000)) and sorted(r["x"] for r in got.collect()) == list(range(0, 15000, 3))
    assert scratch.numbered(spark.range(0).withColumnRenamed("id", "x")).count() == 0


def test_ranks_of_a_key_that_spans_ranges(spark):
    rows = spark.range(0, 6000, 1, 6).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 6 == 0, F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"), F.xxhash64("id").alias("v"), "id")
    got = scratch.ranked(rows, ["k"], [F.col("v").desc(), F.col("id")]).collect()
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (-r["v"], r["id"])):
        seen[r["k"]] = want[r["id"]] = seen.get(r["k"], 0) + 1
    assert {r["id"]: r["rank"] for r in got} == want and max(r["rank"] for r in got if r["k"] == "hot") == 4000 and any(r["k"] is None for r in got)
    assert scratch.ranked(rows.limit(0), ["k"], [F.col("v")], keep=["k", "id"]).columns == ["k", "id", "rank"]


def test_discarded_tables_are_gone_and_others_stay(spark, tmp_path):
    one, two = scratch.saved(spark.range(5)), scratch.saved(spark.range(7))
    files = [f.removeprefix("file://") for f in one.inputFiles()]
    scratch.discard(one)
    assert not any(os.path.exists(f) for f in files) and two.count() == 7
    spark.range(3).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError, match="not a table"):
        scratch.discard(spark.read.parquet(f"{tmp_path}/own"))


def test_spread_bounds_the_rows_of_a_task(spark):
    df = spark.range(10_000).coalesce(1)
    out = scratch.spread(df, 10_000, each=1000)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 10_000 and max(sizes) < 1500
    assert scratch.spread(df, 10_000, each=10_000) is df


def test_a_table_is_looked_up_in_tasks_of_bounded_size(spark):
    """One key has half of the rows, some have none that are known; without hub and dealing one task would hold them."""
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("id")).cast("long")
    rows = scratch.saved(spark.range(40_000).select(key.alias("k"), F.col("id").alias("v")).coalesce(8))
    known = scratch.saved(spark.range(0, 40_000, 3).union(spark.range(7, 8)).distinct().select(F.col("id").alias("k"), (F.col("id") * 10).alias("x")))
    for how in ("inner", "left"):
        out = scratch.looked_up(rows, known, "k", 40_000, how, each=2000)
        want = rows.join(known, "k", how)
        assert out.columns == want.columns and sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 8 and max(sizes) < 6000
    assert sorted(map(repr, scratch.looked_up(rows, known, "k", 40_000, "left").collect())) == sorted(map(repr, want.collect()))


def test_rows_are_made_distinct_in_tasks_of_bounded_size(spark):
    df = spark.range(0, 40_000, 1, 20).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 15_000).alias("x"), (F.col("id") % 2).alias("y"))
    out = scratch.distinct_spread(df, 40_000, each=2000)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.distinct().collect()))
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) < 2000


def test_a_table_is_counted_once_for_all_of_its_mappings(spark, tmp_path, monkeypatch):
    """Each count is a job of its own, which takes as long as a small query."""
    from semlattice.plans import tables

    spark.range(30).selectExpr("id as c_custkey", "'x' as c_name", "1.5D as c_acctbal", "'s' as c_mktsegment", "1 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    counted, size = [], tables.size
    monkeypatch.setattr(tables, "size", lambda *a: counted.append(a[-1]) or size(*a))
    assert tables.triples(spark, str(tmp_path), "customer").count() == 30 * 6 + 1
    assert counted == ["customer"]
