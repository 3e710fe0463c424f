"""A trie of conversations' prefixes, by ROLLUP over blocks of turn columns.

A conversation is cut into blocks of eight turns. A block is one row: the key of the node
before it and a digest of each turn. One ROLLUP over the eight columns within (block, key)
counts all prefixes of all blocks at once; grouping_id() tells a prefix's depth in its block.
The key before a block is a digest of all the turns before it, taken in two levels (blocks,
then stretches of 64 blocks), so no block waits for another and no task sees a long
conversation whole.

Sums over subtrees need no walk through the tree: a node is represented by its smallest
member, a conversation represents the nodes of its path from one depth on, and so the texts
and the childless nodes of a subtree are sums over the node's members, by a second ROLLUP.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import ranked
from .common import saved, table

#: Turns of a block, blocks of a stretch.
WIDTH = 8
STRETCH = 64
#: Ids that are joined into one text before a node's digest is taken.
IDS = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()
_KEYS = [f"t{i}" for i in range(1, WIDTH + 1)]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, turn_key, size): turns of each conversation from position 1 on.

    By turn (null first), then role, text; null role or text: empty. Rows without a conv_id are in no
    conversation and drop out. turn_key: a SHA-256 of role and text. size: code points of the text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("copy"))
    rows = rows.withColumn("turn_key", F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)).withColumn("size", F.length("text").cast("long"))
    order = [F.col(c) for c in ("turn", "role", "text", "copy")]
    return ranked(rows, ["conv"], order, "pos", keep=["conv", "turn_key", "size"])


def shared_starts(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, pos, turn_key, size) and all conversations (conv).

    The first h turns come from conversation conv - conv % group (all if fewer, none if absent), then
    the conversation's own after its first h; h is crc32(conv) % most. A join with a start has at most
    most - 1 turns on one side and `group` conversations on the other.
    """
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string")) % most).withColumn("base", F.col("conv") - F.col("conv") % group)
    starts = convs.select(F.col("conv").alias("base"), F.least("n", F.lit(most - 1)).alias("n_base"))
    convs = saved(convs.hint("merge").join(starts, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")))
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    head = convs.where("taken > 0").hint("merge").join(first, "base").where("pos <= taken").select("conv", "pos", "turn_key", "size")
    tail = turns.hint("merge").join(convs, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "size")
    return head.unionByName(tail), convs.select("conv")


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each block: conv, block, before and after (digests of the turns before it and up to its end), t1..t8, s0..s8, last.

    s0..s8: code points of all turns up to before the block, its first turn and so on. last: no block follows.
    A conversation without turns has an empty block 0.
    """
    rows = turns.unionByName(convs.select("conv", F.lit(1).cast("long").alias("pos"), F.lit(None).cast("string").alias("turn_key"), F.lit(None).cast("long").alias("size")))
    at = (F.col("pos") - 1) % WIDTH
    block = F.floor((F.col("pos") - 1) / WIDTH).cast("long").alias("block")
    one = rows.groupBy("conv", block).agg(
        *[F.max(F.when(at == i, F.col("turn_key"))).alias(k) for i, k in enumerate(_KEYS)],
        *[F.coalesce(F.sum(F.when(at < i, F.col("size"))), F.lit(0)).alias(f"s{i}") for i in range(WIDTH + 1)])
    one = one.withColumn("stretch", F.floor(F.col("block") / STRETCH)).withColumn("digest", F.when(F.col(_KEYS[-1]).isNotNull(), F.sha2(F.concat(*_KEYS), 256)))
    one = saved(one)
    listed = F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("block", "digest"))))
    stretches = one.groupBy("conv", "stretch").agg(F.sum(f"s{WIDTH}").alias("size"), F.max("block").alias("last_block"), F.sha2(F.array_join(F.transform(listed, lambda x: x["digest"]), ""), 256).alias("digest"))
    of_conv = W.partitionBy("conv").orderBy("stretch")
    up_to = of_conv.rowsBetween(W.unboundedPreceding, 0)
    before = of_conv.rowsBetween(W.unboundedPreceding, -1)
    joined = lambda w: F.array_join(F.collect_list("digest").over(w), "")
    # a later stretch's size and digests arrive as running values, never as a list of all turns
    stretches = stretches.select(
        "conv", "stretch", _digest(F.lit("stretch"), joined(before)).alias("stretch_before"), _digest(F.lit("stretch"), joined(up_to)).alias("stretch_after"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"), (F.max("last_block").over(of_conv.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("last_block"))
    within = W.partitionBy("conv", "stretch").orderBy("block")
    to_block, to_end = within.rowsBetween(W.unboundedPreceding, -1), within.rowsBetween(W.unboundedPreceding, 0)
    one = one.select(
        "conv", "block", "stretch", *_KEYS, *[f"s{i}" for i in range(WIDTH + 1)], joined(to_block).alias("digests_before"), joined(to_end).alias("digests_after"),
        F.coalesce(F.sum(f"s{WIDTH}").over(to_block), F.lit(0)).alias("in_stretch"))
    one = one.hint("merge").join(stretches, ["conv", "stretch"])
    full = F.col(_KEYS[-1]).isNotNull()
    ends_stretch = F.col("block") % STRETCH == STRETCH - 1
    after = F.when(ends_stretch, _digest(F.col("stretch_after"), F.lit(""))).otherwise(_digest(F.col("stretch_before"), F.col("digests_after")))
    base = F.col("size_before") + F.col("in_stretch")
    return one.select(
        "conv", "block", _digest(F.col("stretch_before"), F.col("digests_before")).alias("before"), F.when(full, after).alias("after"), *_KEYS,
        *[(base + F.col(f"s{i}")).alias(f"s{i}") for i in range(WIDTH + 1)], (F.col("block") == F.col("last_block")).alias("last"))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def node_key(depth: Column) -> Column:
    """The key of a block's prefix of `depth` turns: that before the block at 0, that at its end at 8, between them a digest."""
    return F.when(depth == 0, F.col("before")).when(depth == WIDTH, F.col("after")).otherwise(_digest(F.col("before"), F.slice(F.array(*_KEYS), 1, depth.cast("int"))))


def rolled(rows: DataFrame, sums: str) -> DataFrame:
    """Prefixes of all blocks with their aggregates: (block, before, after, t1.., depth within the block, the named sums)."""
    names = ", ".join(_KEYS)
    out = rows.sparkSession.sql(
        f"SELECT block, before, {names}, max(after) AS after, grouping_id() AS g, {sums} FROM {{rows}} GROUP BY block, before, ROLLUP({names})", rows=rows)
    # a prefix of d turns leaves 8 - d columns out; of a block's own rows the empty prefix is the block before's last node
    out = out.withColumn("d", (F.lit(WIDTH) - F.round(F.log2(F.col("g") + 1))).cast("int"))
    there = F.when(F.col("d") == 0, F.col("block") == 0)
    for d, k in enumerate(_KEYS, 1):
        there = there.when(F.col("d") == d, F.col(k).isNotNull())
    return out.where(there)


def _picked(prefix: str, at: Column, low: int = 0) -> Column:
    return F.element_at(F.array(*[F.col(f"{prefix}{i}") for i in range(low, WIDTH + 1)]), at + 1 - low)


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): digests of the ascending ids of the conversations that end at a node.

    Ids are dealt out by ranges of (node, id) and joined to texts of at most IDS ids in many tasks. A digest
    itself can only be taken in order: one task reads a node's texts one after the other and keeps none.
    """
    last = rows.where("last").withColumn("d", F.size(F.array_compact(F.array(*_KEYS)))).select(node_key(F.col("d")).alias("node"), "conv")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids = [], batch.column(1).to_pylist()
            for i, node in enumerate(batch.column(0).to_pylist()):
                if not out or out[-1][0] != node or len(out[-1][2]) == IDS:
                    out.append((node, ids[i], []))
                out[-1][2].append(str(ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in out], pa.string()), pa.array([c for _, c, _ in out], pa.int64()), pa.array([",".join(t) for _, _, t in out], pa.string())], ["node", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = running = None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n == node:
                    running.update(b",")
                else:
                    if running:
                        done.append((node, running.hexdigest()))
                    node, running = n, hashlib.sha256()
                running.update(ids.encode())
            yield _pairs(done)
        if running:
            yield _pairs([(node, running.hexdigest())])

    def _pairs(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], ["node", "ends_sha256"])

    joined = last.repartitionByRange(parts, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(texts, "node string, first long, ids string")
    return joined.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(digests, "node string, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv, pos, turn_key, size), positions from 1 without gaps. convs: all conversations, those without
    turns too. No conversations: no rows; otherwise the root is there.
    """
    rows = saved(blocks(turns, convs))
    totals = rows.where("last").select("conv", F.col(f"s{WIDTH}").alias("total"))
    counted = rolled(rows, "count(*) AS n_convs, min(conv) AS conv_id, " + ", ".join(f"max(s{i}) AS s{i}" for i in range(WIDTH + 1)))
    nodes = saved(counted.select(
        node_key(F.col("d")).alias("node"), F.when(F.col("d") > 0, node_key(F.col("d") - 1)).alias("parent"), (F.col("block") * WIDTH + F.col("d")).alias("depth"),
        "conv_id", "n_convs", F.when(F.col("d") > 0, _picked("s", F.col("d") - 1)).otherwise(0).alias("size_before")))
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    nodes = saved(nodes.hint("merge").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # a conversation represents the nodes of its path from one depth on
    own = nodes.groupBy("conv_id").agg(F.min_by("size_before", "depth").alias("own_from"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    per_conv = saved(totals.hint("merge").join(own.withColumnRenamed("conv_id", "conv"), "conv", "left").select("conv", "total", "own_from", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce(F.col("total") - F.col("own_from"), F.lit(0)).alias("own_size")))
    weighed = rolled(rows.select("conv", "block", "before", "after", *_KEYS).hint("merge").join(per_conv, "conv"), "sum(leaf) AS n_leaves, sum(total) AS total, sum(own_size) AS own_size")
    sums = weighed.select(node_key(F.col("d")).alias("node"), "n_leaves", "total", "own_size")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    own_from = per_conv.where("own_from is not null").select(F.col("conv").alias("conv_id"), "own_from")
    out = nodes.hint("merge").join(sums, "node").hint("merge").join(ends(rows), "node", "left").hint("merge").join(parents, "parent", "left").hint("merge").join(own_from, "conv_id")
    # texts of the members from here on, less those of the subtree's nodes once each
    above = F.greatest(F.lit(0), F.col("size_before") - F.col("own_from"))
    saved_tokens = F.col("total") - F.col("n_convs") * F.col("size_before") - (F.col("own_size") - above)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved_tokens.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations whose starts are shared in groups of 100 ids."""
    turns, convs = shared_starts(ordered_turns(table(spark, sf_dir, "conversations")))
    return trie(turns, convs)


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS own FROM turns GROUP BY conv_id
), starts AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS base, CAST(xor(4294967295, list_reduce(
      list_transform(range(1, CAST(length(CAST(conv_id AS VARCHAR)) AS BIGINT) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT)),
      lambda a, x: xor(a // 256, t[CAST(xor(a % 256, x) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT))) % 6 AS BIGINT) AS h
  FROM convs, crc_table
), rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.own[1:s.h], []), s.own[s.h + 1:]) AS path FROM starts s LEFT JOIN convs b ON b.conv_id = s.base
), prefixes AS (
  SELECT conv_id, path, d, path[1:d] AS prefix FROM (SELECT conv_id, path, unnest(range(0, CAST(len(path) AS BIGINT) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT prefix, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len(path)), '') AS ends
  FROM prefixes GROUP BY prefix
), children AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[depth].text) END AS saved FROM nodes n LEFT JOIN children USING (prefix)
), below AS (
  SELECT prefix[1:a] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT prefix, saved, n_children, unnest(range(0, depth + 1)) AS a FROM counted) GROUP BY 1
)
SELECT b.conv_id, b.depth, p.conv_id AS parent_conv_id, b.n_convs, b.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(b.ends) AS ends_sha256
FROM counted b JOIN below USING (prefix) LEFT JOIN nodes p ON b.depth > 0 AND p.prefix = b.prefix[1:b.depth - 1]
"""
