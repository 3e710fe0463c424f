"""Sharding by jump consistent hashing (Lamping and Veach), in DataFrame functions only.

A document's key and the number of shards alone decide its shard; appending a shard moves
about 1 / (n + 1) of the keys, all of them into the new one. The key seeds a linear
congruential generator of 64 bits; its steps run on decimals of 38 digits, as the products
need up to 126 bits, and the jump (b + 1) * 2^31 / (r + 1) is taken in whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the published generator.
MULTIPLIER, MODULUS = 2862933555777941757, 1 << 64
#: Hash buckets of a shard within which slots are counted; a slot is its bucket's offset plus its place there.
BUCKETS = 4096
#: Copies of one row that a task writes out at a time.
STEP = 10_000


def jump_shard(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among `shards`, and among one more.

    key: bigint; null counts as -1. At most `shards` steps, about ln(shards) of them do work.
    """
    def number(x: int, digits: int) -> Column:
        return F.expr(f"cast({x} as decimal({digits},0))")

    whole = F.coalesce(key.cast("long"), F.lit(-1).cast("long")).cast("decimal(20,0)")
    unsigned = F.when(whole < 0, whole + number(MODULUS, 20)).otherwise(whole).cast("decimal(20,0)")

    def step(acc: Column, _: Column) -> Column:
        nxt = ((acc["k"] * number(MULTIPLIER, 19) + number(1, 1)) % number(MODULUS, 20)).cast("decimal(20,0)")
        jump = lambda k: F.expr("2147483648L") * (acc["j"] + 1)
        high = F.floor(nxt / number(1 << 33, 20)).cast("long")
        moved = F.struct(
            nxt.alias("k"), acc["j"].alias("b"),
            F.floor(jump(nxt).cast("decimal(20,0)") / (high + 1).cast("decimal(20,0)")).cast("long").alias("j"),
        )
        return F.when(acc["j"] < shards, moved).otherwise(acc)

    start = F.struct(unsigned.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    return F.transform(F.array(end), lambda e: F.struct(e["b"].cast("int").alias("shard"), F.when(e["j"] == shards, F.lit(shards)).otherwise(e["b"]).cast("int").alias("grown")))[0]


def with_shards(docs: DataFrame, shards: int, key: str = "doc_id", column: str = "shard") -> DataFrame:
    """docs with the shard of each row; a column of that name is replaced. A null key is placed as -1. A narrow step: nothing is shuffled."""
    return docs.withColumn(column, jump_shard(F.col(key), shards)["shard"])


def placed(docs: DataFrame, shards: int) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs.

    size: UTF-8 bytes of the text plus 16; null text: 16, its checksum is that of an empty text.
    Equal rows are counted before anything is sorted, so a key of very many rows is one row
    until the end. Slots run from 0 without gaps in each shard, by a hash bucket of doc_id and checksum, doc_id (null
    first), checksum and size; so different texts of one doc_id, or of none, are many buckets. Null doc_id: placed as key -1. Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"),
    )
    counted = (
        rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
        .withColumn("to", jump_shard(F.col("doc_id"), shards))
        .withColumn("shard", F.col("to.shard"))
        .withColumn("bucket", F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "text_crc32")), 1, 3), 16, 10).cast("int"))
    )
    offsets = (
        counted.groupBy("shard", "bucket").agg(F.sum("n").alias("in_bucket"))
        .withColumn("offset", F.sum("in_bucket").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
        .select("shard", "bucket", F.coalesce("offset", F.lit(0)).alias("offset"))
    )
    before = F.sum("n").over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1))
    numbered = counted.withColumn("before", F.coalesce(before, F.lit(0))).hint("merge").join(offsets, ["shard", "bucket"])
    # very many copies of one row are written out by many tasks
    few = numbered.where(F.col("n") <= STEP).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = (
        numbered.where(F.col("n") > STEP).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STEP)))).repartition("doc_id", "text_crc32", "part")
        .withColumn("copy", F.explode(F.sequence(F.col("part") * STEP, F.least(F.col("n"), (F.col("part") + 1) * STEP) - 1))).drop("part")
    )
    return (
        few.unionByName(many)
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("before") + F.col("copy")).cast("long").alias("slot"), F.col("to.grown").alias("grown_shard"))
    )


def op10_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39."""
    return placed(table(spark, sf_dir, "documents"), 40)


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
), texts AS (
  SELECT DISTINCT coalesce(text, '') AS text FROM documents
), sums AS (
  SELECT text, CASE WHEN text = '' THEN 0 ELSE xor(4294967295, list_reduce(
      list_transform(range(0, CAST(strlen(text) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
      lambda a, x: xor(a // 256, t[CAST(xor(a % 256, x) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT))) END AS text_crc32
  FROM texts, crc_table
), jump AS (
  SELECT DISTINCT doc_id, CASE WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE CAST(coalesce(doc_id, -1) AS HUGEINT) END AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM documents
  UNION ALL
  SELECT doc_id, n, j, CAST(((j + 1) * 2147483648) // (n // 8589934592 + 1) AS BIGINT)
  FROM (SELECT doc_id, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM jump WHERE j < 40)
), rows AS (
  SELECT doc_id, CAST(coalesce(strlen(d.text), 0) + 16 AS BIGINT) AS size, text_crc32, CAST(b AS INTEGER) AS shard, CAST(CASE WHEN j = 40 THEN 40 ELSE b END AS INTEGER) AS grown_shard,
         CAST('0x' || substr(md5(concat_ws(':', doc_id, text_crc32)), 1, 3) AS INTEGER) AS bucket
  FROM documents d JOIN sums ON coalesce(d.text, '') = sums.text JOIN (SELECT * FROM jump WHERE j >= 40) USING (doc_id)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM rows
"""
