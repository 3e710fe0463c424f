"""Tables that cut a plan's lineage, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most bytes of text in the smaller side of a broadcast join.
BROADCAST_BYTES = 64 << 20


def folder(spark: SparkSession) -> str:
    """Where a session's tables go: spark.checkpoint.dir/tables-<application id>.

    It can be deleted as a whole once the application's results are written. If the setting is
    absent, a local session gets a temporary folder; any other is an error, as executors would
    write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, partition_by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Writes the rows to the session's folder and reads them back, so that later reads survive any executor."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def discard(df: DataFrame) -> None:
    """Deletes a table that saved() wrote, once nothing will read it again, not even after an executor is lost."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/tables-{spark.sparkContext.applicationId}/" not in path + "/":
            raise ValueError(f"{path} is not a table of this session")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_checked(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", limit: int = 200_000) -> DataFrame:
    """Broadcasts right only if it has at most `limit` rows and BROADCAST_BYTES of text, counted beforehand; else a sort-merge join."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in right.dtypes if kind in ("string", "binary")), F.lit(0).cast("long"))
    wide = any(kind.startswith(("array", "map", "struct")) for _, kind in right.dtypes)
    n, size = right.select(width.alias("w")).limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    small = n <= limit and size <= BROADCAST_BYTES and not wide
    return left.join(F.broadcast(right), on, how) if small else left.hint("merge").join(right, on, how)


def spread(df: DataFrame, n: int, each: int = 250_000, by: Sequence[str] | None = None) -> DataFrame:
    """The rows over so many tasks that each gets about `each` of the n rows, however few and dense the files are that they come from.

    Rows go by the hash of the columns `by`, of all if not given, so a task that runs again deals them alike. What a task holds while it makes
    its rows' results distinct is then bounded, and does not grow with the table.
    """
    return df if n <= each else df.repartition(-(-n // each), *(by or df.columns))


def distinct_spread(df: DataFrame, n: int, each: int = 250_000) -> DataFrame:
    """The different rows of df, which has n rows at most, made distinct in tasks that each get about `each` rows, however many there are.

    Columns that are one constant in the plan should be made by a union or an explode, else the tasks are dealt anew by Spark.
    A row of very many copies is first made distinct among the copies of every sixteenth task, so that no task gets them all.
    """
    if n <= each:
        return df.dropDuplicates()
    tasks = -(-n // each)
    shared = df.withColumn("distinct_share", F.spark_partition_id() % 16).repartition(tasks, *df.columns, "distinct_share").dropDuplicates()
    return shared.select(df.columns).repartition(tasks, *df.columns).dropDuplicates()


def looked_up(rows: DataFrame, known: DataFrame, on: str, n: int, how: str = "inner", each: int = 250_000) -> DataFrame:
    """The n rows with the columns of known, which has one row for each key, over tasks of about `each` rows.

    Tasks are dealt by number, so that they stay as small however many rows there are; AQE neither joins nor splits such ones. Keys of very many
    rows, in number 16 * n / each at most, are therefore told first: their rows stay where they are and meet known's few rows by broadcast.
    rows and known are read several times and should be written tables. how: inner, or left, where null stays null.
    """
    if n <= each:
        return rows.hint("merge").join(known, on, how)
    tasks = max(-(-n // each), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(16)).alias("share")
    often = rows.select(on, share).where(F.col(on).isNotNull()).repartition(tasks, on, "share").groupBy(on, "share").agg(F.count("*").alias("n")).where(F.col("n") > each // 16)
    often = saved(often.select(on).distinct())
    of_often = join_checked(rows, saved(join_checked(known, often, on, "left_semi")), on)
    others = join_checked(rows, often, on, "left_anti").repartition(tasks, on).hint("merge").join(known, on, how)
    return of_often.unionByName(others)


def numbered(df: DataFrame, column: str = "id") -> DataFrame:
    """The rows with dense numbers from 0, written first so that they never change.

    A row's number is its place in its partition plus the rows of the partitions before, so no
    task sees more than its own rows and the table of partitions, which is broadcast.
    """
    part, place = f"{column}_part", f"{column}_place"
    kept = saved(df.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = kept.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n"))
    return kept.join(F.broadcast(before), part).withColumn(column, F.col(place) + F.col("n")).select(*df.columns, column)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str = "rank", keep: Sequence[str] | None = None) -> DataFrame:
    """Ranks from 1 among the rows of equal keys (null is a key), of which one key may have any share of all rows.

    Rows go to ranges of (keys, order) and are ranked within each range; a key that spans several
    ranges gets the counts of the ranges before as an offset. At most one key spans two neighbouring
    ranges, so the table of offsets has at most two rows for each range and is broadcast. Rows that
    agree in keys and order stand in one range; give the order a last column that parts them.
    keep: the columns that the result needs, by default all.
    """
    part, place, of_key = f"{column}_part", f"{column}_place", f"{column}_key"
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = dealt.select(*(keep or df.columns), F.struct(*keys).alias(of_key), F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place))
    rows = saved(rows)
    edges = rows.groupBy(part).agg(F.min(of_key).alias("low"), F.max(of_key).alias("high")).select(part, F.explode(F.array("low", "high")).alias(of_key))
    spanning = edges.groupBy(of_key).agg(F.count_distinct(part).alias("n")).where("n > 1").select(F.col(of_key).alias("spanning"))
    counts = rows.join(F.broadcast(spanning), F.col(of_key).eqNullSafe(F.col("spanning"))).groupBy("spanning", part).agg(F.count("*").alias("n"))
    before = counts.select("spanning", F.col(part).alias("in_part"), F.sum("n").over(W.partitionBy("spanning").orderBy(part).rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    local = rows.withColumn(column, F.row_number().over(W.partitionBy(part, of_key).orderBy(place)).cast("long"))
    joined = local.join(F.broadcast(before), F.col(of_key).eqNullSafe(F.col("spanning")) & (F.col(part) == F.col("in_part")), "left")
    return joined.withColumn(column, F.col(column) + F.coalesce("before", F.lit(0))).select(*(keep or df.columns), column)
