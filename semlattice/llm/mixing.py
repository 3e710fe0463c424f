"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Equal rows are counted and cut into parts of bounded size. Sizes (words) and row counts
   are summed for each source; targets follow from weights.
2. A source's parts are dealt into blocks of nearly equal size by a hash. In each
   round the source's blocks come in another hash-permuted order; full rounds take every
   block, the last round takes leading blocks, its boundary block in part. So draws are
   disjoint within a round, and no document is drawn more than `cap` times.
3. The draws of all sources, as exact quotas, are split among output shards: each node of a
   binary tree over the shards draws from a multivariate hypergeometric distribution how
   many of each source's draws go left. A draw's rank leads it down the tree to its shard.
   Any task can walk the tree alone, as each node's random generator is seeded by its place.
4. Each shard's rows are put in a hash-permuted order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hashable, saved, table

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one row is exploded to at a time; parts of equal rows that are joined with one copy of their row.
STEP, SALT = 10_000, 64


@dataclass(frozen=True)
class Mix:
    """weights: cycle over the sources in code-point order, null last. cap: most times that a source is repeated.

    block_words, block_rows: mean size of a block. shard_blocks: draws of an output shard.
    max_sources: the source table passes through the driver, so its size is checked.
    """

    weights: tuple[float, ...] = (1, 2, 3)
    cap: int = 3
    block_words: int = 20_000
    block_rows: int = 200
    shard_blocks: int = 64
    seed: int = 7
    max_sources: int = 100_000


def targets(sizes: list[int], spec: Mix) -> list[float]:
    """Shares the sum of sizes by weight; what is above cap * size goes to the others by weight, until none is above."""
    weights = [spec.weights[i % len(spec.weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > spec.cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(spec.cap * sizes[i])
            free.discard(i)
        left = float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def keyed(docs: DataFrame, whole: bool) -> DataFrame:
    """doc_id, source, size (words; null text: 0), uid and vid, and docs's own columns as `row`.

    uid: a hash of doc_id and text, by which rows are dealt. vid: another, of all columns if `whole`.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mine = [F.col("doc_id").cast("long"), text]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(1), *mine).alias("uid"), F.xxhash64(F.lit(2), *(hashable(docs) if whole else mine)).alias("vid"),
        F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"),
    )


def units(rows: DataFrame) -> DataFrame:
    """Equal rows of one source as one, with their number n. rows: as keyed() gives them."""
    return rows.groupBy("doc_id", "source", "size", "uid", "vid").agg(F.count("*").alias("n"))


def source_plan(known: DataFrame, spec: Mix) -> pd.DataFrame:
    """One row for each source: rank, source, total, rows, target, blocks, full rounds and the words of the last round. known: units()."""
    grouped = known.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("total"), F.sum("n").alias("rows"))
    plan = grouped.limit(spec.max_sources + 1).toPandas()
    if len(plan) > spec.max_sources:
        raise ValueError(f"more than {spec.max_sources} sources")
    plan["key"] = [(s is None, (s or "").encode("utf-32-be")) for s in plan["source"]]
    plan = plan.sort_values("key", ignore_index=True).drop(columns="key")
    plan["rank"] = range(len(plan))
    plan["target"] = targets([int(x) for x in plan["total"]], spec)
    plan["blocks"] = np.maximum(1, np.maximum(np.ceil(plan["total"] / spec.block_words), np.ceil(plan["rows"] / spec.block_rows))).astype("int64")
    ratio = [t / s if s else 0.0 for t, s in zip(plan["target"], plan["total"], strict=True)]
    plan["rounds"] = [min(spec.cap, int(r + 1e-9)) for r in ratio]
    plan["rest"] = [max(0.0, t - k * s) for t, k, s in zip(plan["target"], plan["rounds"], plan["total"], strict=True)]
    return plan


def _boundary(rows: pd.DataFrame) -> pd.DataFrame:
    """`extra` copies of the parts of a boundary block that fit, in hash order, into what is left of the last round.

    One more copy goes in if that brings the source nearer to its target.
    """
    rows = rows.sort_values(["order", "doc_id", "uid", "vid", "part"], ignore_index=True)
    room, extra = float(rows["room"].iloc[0]), []
    for size, copies in zip(rows["size"], rows["copies"], strict=True):
        extra.append(int(min(copies, room // size)))
        room -= extra[-1] * size
    off = [abs(room - size) if e < c else float("inf") for size, c, e in zip(rows["size"], rows["copies"], extra, strict=True)]
    if min(off) < room:
        extra[off.index(min(off))] += 1
    return rows.assign(extra=extra)[["source_rank", "doc_id", "uid", "vid", "size", "part", "copies", "shards", "extra", "extra_shard"]]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `take` draws are good. NumPy's populations end below 1e9; larger ones by large_hypergeometric()."""
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, take))
    return large_hypergeometric(rng, good, bad, take)


def _log_factorial(n: int) -> Decimal:
    """To some 25 digits after the point: Stirling's series, or the factorial itself below 1000."""
    if n < 1000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return (x + Decimal("0.5")) * x.ln() - x + (2 * Decimal("3.14159265358979323846264338327950288")).ln() / 2 + series


def large_hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """The same distribution for populations of any size, by ratios of uniform numbers (Stadlober).

    A value is drawn from a hat over the distribution and kept with a probability that is the ratio of
    two of the distribution's own weights, whose logarithms are taken to 50 digits.
    """
    total = good + bad
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    with localcontext() as digits:
        digits.prec = 50
        log_weight = lambda x: -(_log_factorial(x) + _log_factorial(good - x) + _log_factorial(take - x) + _log_factorial(bad - take + x))
        mean = Decimal(take) * good / total
        spread = (mean * bad * (total - take) / (Decimal(total) * max(1, total - 1)) + Decimal("0.5")).sqrt()
        # fixed values of the method: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)
        width = Decimal("1.7155277699214135") * spread + Decimal("0.8989161620588988")
        top = log_weight(min(high, max(low, (take + 1) * (good + 1) // (total + 2))))
        while True:
            u, v = 1.0 - rng.random(), rng.random()
            x = math.floor(mean + Decimal("0.5") + width * (Decimal(v) - Decimal("0.5")) / Decimal(u))
            if low <= x <= high and 2 * Decimal(u).ln() <= log_weight(x) - top:
                return x


class Tree:
    """Splits quotas[source] draws among shards; place(source, rank) gives a draw's shard."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.shards, self.seed = shards, seed
        # about 64 MB of nodes; those that a walk meets first are asked for most
        self.node = lru_cache(maxsize=max(64, (64 << 20) // (16 * len(quotas) + 1)))(self._node)
        self.quotas = np.array(quotas, np.int64)

    def _node(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Quotas of the shards lo to hi - 1, and how many of them go to the left half."""
        if (lo, hi) == (0, self.shards):
            mine = self.quotas
        else:
            plo, phi = self._parent(lo, hi)
            above, left = self.node(plo, phi)
            mine = left if lo == plo else above - left
        if hi - lo < 2:
            return mine, mine
        mid = (lo + hi) // 2
        total = int(mine.sum())
        take = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([self.seed, lo, hi])
        # marginal by marginal: a multivariate hypergeometric draw of `take` from the quotas
        left, rest = np.zeros_like(mine), total
        for s, n in enumerate(mine):
            rest -= n
            left[s] = _hypergeometric(rng, int(n), int(rest), int(take)) if take and n else 0
            take -= left[s]
        return mine, left

    def _parent(self, lo: int, hi: int) -> tuple[int, int]:
        a, b = 0, self.shards
        while True:
            mid = (a + b) // 2
            nxt = (a, mid) if hi <= mid else (mid, b)
            if nxt == (lo, hi):
                return a, b
            a, b = nxt

    def place(self, source: int, rank: int) -> int:
        lo, hi = 0, self.shards
        while hi - lo > 1:
            left, mid = self.node(lo, hi)[1][source], (lo + hi) // 2
            if rank < left:
                hi = mid
            else:
                lo, rank = mid, rank - int(left)
        return lo


def _each(spec: Mix) -> Column:
    """Most equal rows in one part."""
    return F.greatest(F.lit(1), F.least(F.lit(spec.block_rows), F.floor(F.lit(spec.block_words) / F.col("size")))).cast("long")


def _parts(known: DataFrame, sources: DataFrame, spec: Mix) -> DataFrame:
    """Units in parts of `copies` equal rows, none above a block's words or rows, each in a block of its source.

    A unit of very many parts is exploded in two steps with an exchange between them.
    """
    rows = (
        # one row for each source, at most max_sources of them
        known.where("size > 0").join(F.broadcast(sources), known["source"].eqNullSafe(sources["source"])).drop("source")
        .withColumn("each", _each(spec)).withColumn("parts", F.ceil(F.col("n") / F.col("each")).cast("long"))
    )
    few = rows.where(F.col("parts") <= STEP).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    many = (
        rows.where(F.col("parts") > STEP).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("parts") - 1) / STEP)))).repartition("uid", "step")
        .withColumn("part", F.explode(F.sequence(F.col("step") * STEP, F.least(F.col("parts"), (F.col("step") + 1) * STEP) - 1))).drop("step")
    )
    return (
        few.unionByName(many).withColumn("copies", F.least(F.col("each"), F.col("n") - F.col("part") * F.col("each"))).drop("each", "parts")
        .withColumn("block", F.pmod(F.xxhash64(F.lit(spec.seed), "doc_id", "uid", "part"), F.col("blocks")))
    )


def draws(known: DataFrame, spec: Mix, plan: pd.DataFrame) -> DataFrame:
    """Rows (source_rank, doc_id, uid, vid, size, part, copies, shards, extra, extra_shard) of the parts that are drawn.

    shards: the shard of each whole draw of the part's copies. extra: of the copies how many
    are drawn once more, by a boundary block, into extra_shard. known: units(), saved.
    """
    spark = known.sparkSession
    columns = ["rank", "source", "blocks", "rounds", "rest"]
    sources = spark.createDataFrame([tuple(x) for x in plan[columns].astype({"source": object}).where(plan[columns].notna(), None).itertuples(index=False)], "source_rank int, source string, blocks long, rounds int, rest double")
    dealt = _parts(known, sources, spec)
    blocks = saved(dealt.groupBy("source_rank", "block", "rounds", "rest").agg(F.sum(F.col("size") * F.col("copies")).alias("words")))
    order = lambda r: F.xxhash64(F.lit(spec.seed), r, "source_rank", "block")
    # blocks of the last round, leading ones in permuted order; a source's blocks are numbered by two levels of hash
    ranked = _cumulated(blocks.withColumn("order", order(F.col("rounds"))))
    cut = ranked.where("before < rest").select("source_rank", "block", F.col("rounds").alias("round"), F.when(F.col("before") + F.col("words") <= F.col("rest"), F.lit(None)).otherwise(F.col("rest") - F.col("before")).alias("room"))
    full = blocks.where("rounds > 0").select("source_rank", "block", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), F.lit(None).cast("double").alias("room"))
    taken = saved(full.unionByName(cut))
    quotas = {r["source_rank"]: r["n"] for r in taken.groupBy("source_rank").agg(F.count("*").alias("n")).collect()}  # one row a source
    total = sum(quotas.values())
    counts, shards = [quotas.get(i, 0) for i in range(len(plan))], max(1, -(-total // spec.shard_blocks))
    numbered = _numbered(taken.withColumn("order", F.xxhash64(F.lit(spec.seed + 1), "round", "source_rank", "block")))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(counts, shards, spec.seed)
        for f in frames:
            f["shard"] = [tree.place(s, r) for s, r in zip(f["source_rank"], f["nr"], strict=True)]
            yield f[["source_rank", "block", "round", "room", "shard"]]

    placed = numbered.mapInPandas(place, "source_rank int, block long, round int, room double, shard int")
    # at most `cap` draws of a block
    of_block = placed.groupBy("source_rank", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("room").isNull(), F.struct("round", "shard")))), lambda x: x["shard"]).alias("shards"),
        F.max("room").alias("room"), F.max(F.when(F.col("room").isNotNull(), F.col("shard"))).alias("extra_shard"),
    )
    rows = dealt.select("source_rank", "block", "doc_id", "uid", "vid", "size", "part", "copies").hint("merge").join(saved(of_block), ["source_rank", "block"])
    names = ["source_rank", "doc_id", "uid", "vid", "size", "part", "copies", "shards", "extra", "extra_shard"]
    boundary = (
        rows.where("room is not null").withColumn("order", F.xxhash64(F.lit(spec.seed + 2), "doc_id", "uid", "part"))
        .groupBy("source_rank", "block").applyInPandas(_boundary, "source_rank int, doc_id long, uid long, vid long, size long, part long, copies long, shards array<int>, extra long, extra_shard int")
    )
    whole = rows.where("room is null").withColumn("extra", F.lit(0).cast("long")).select(names)
    return whole.unionByName(boundary)


def _shards_of(copy: Column) -> Column:
    """Shards to which a part's copy of that number goes, one for each time it is drawn."""
    return F.when(copy < F.col("extra"), F.array_append("shards", F.col("extra_shard"))).otherwise(F.col("shards"))


def _cumulated(blocks: DataFrame) -> DataFrame:
    """blocks with `before`: words of the source's blocks that come earlier in the order; in two levels of 1024 ranges."""
    part = F.shiftrightunsigned(F.col("order") + F.lit(0), 54)
    split = blocks.withColumn("part", part)
    offsets = split.groupBy("source_rank", "part").agg(F.sum("words").alias("in_part")).withColumn(
        "offset", F.coalesce(F.sum("in_part").over(W.partitionBy("source_rank").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    inner = F.sum("words").over(W.partitionBy("source_rank", "part").orderBy("order", "block").rowsBetween(W.unboundedPreceding, -1))
    return split.withColumn("inner", F.coalesce(inner, F.lit(0))).hint("merge").join(offsets.drop("in_part"), ["source_rank", "part"]).withColumn("before", F.col("offset") + F.col("inner"))


def _numbered(taken: DataFrame) -> DataFrame:
    """taken with `nr`: each source's draws numbered from 0 in the order, in two levels."""
    split = taken.withColumn("part", F.shiftrightunsigned(F.col("order") + F.lit(0), 54)).withColumn("words", F.lit(1).cast("long"))
    offsets = split.groupBy("source_rank", "part").agg(F.sum("words").alias("in_part")).withColumn(
        "offset", F.coalesce(F.sum("in_part").over(W.partitionBy("source_rank").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    inner = F.row_number().over(W.partitionBy("source_rank", "part").orderBy("order", "block", "round")) - 1
    return split.withColumn("inner", inner).hint("merge").join(offsets.drop("in_part"), ["source_rank", "part"]).select("source_rank", "block", "round", "room", (F.col("offset") + F.col("inner")).alias("nr"))


def taken_words(docs: DataFrame, spec: Mix = Mix()) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies, shards), one for each row of docs.

    taken: words of the document that the mix takes, repeats counted; at most cap times its
    size. shards: the output shard of each of its draws. Null source: a source of its own.
    Null or empty text: size 0, never drawn. No rows: no rows. Equal rows (one doc_id, source
    and text) are counted and dealt in parts, and drawn apart. Other columns are ignored.
    """
    known = saved(units(keyed(docs, False).drop("row")))
    plan = source_plan(known, spec)
    info = known.sparkSession.createDataFrame([(int(a), b if isinstance(b, str) else None, int(c), float(d)) for a, b, c, d in plan[["rank", "source", "total", "target"]].itertuples(index=False)], "source_rank int, source string, source_size long, target double")
    drawn = draws(known, spec, plan).select("source_rank", "uid", "vid", F.coalesce("doc_id", F.lit(-1)).alias("doc_key"), "part", "shards", "extra", "extra_shard")
    parts = _parts(known, info.withColumn("blocks", F.lit(1).cast("long")), spec).select("source_rank", "uid", "vid", "doc_id", F.coalesce("doc_id", F.lit(-1)).alias("doc_key"), "part", "copies", "size", "source_size", "target")
    shown = (
        parts.hint("merge").join(drawn, ["source_rank", "uid", "vid", "doc_key", "part"], "left").withColumn("extra", F.coalesce("extra", F.lit(0).cast("long")))
        .withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("shards", _shards_of(F.col("copy")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), F.size("shards").alias("copies"), "shards")
    )
    # rows without words are counted and written out again in steps, too
    blank = (
        known.where("size = 0").join(F.broadcast(info), known["source"].eqNullSafe(info["source"]))
        .withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STEP)))).repartition("uid", "step")
        .withColumn("copy", F.explode(F.sequence(F.col("step") * STEP, F.least(F.col("n"), (F.col("step") + 1) * STEP) - 1)))
        .select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies"), F.array().cast("array<int>").alias("shards"))
    )
    return shown.unionByName(blank)


def mixed(docs: DataFrame, spec: Mix = Mix()) -> DataFrame:
    """The mix itself: rows of docs, each as often as drawn (at most cap times), with its columns only.

    Rows of an output shard are shuffled locally; shards follow each other as partitions.
    Null and empty texts have no words, so no mix draws them. Rows that are equal in all
    columns are one row with a number: one of them is sent to the shards of all.
    """
    rows = keyed(docs, True)
    known = saved(units(rows.drop("row")))
    drawn = saved(draws(known, spec, source_plan(known, spec)).select("uid", "vid", "part", "copies", "shards", "extra", "extra_shard"))
    alone = known.where("n = 1 and size > 0").select("uid", "vid").hint("merge").join(drawn, ["uid", "vid"])
    # one exchange of the rows, with a single row's draws or the number of its equals
    told = saved(
        alone.select("uid", "vid", F.lit(0).cast("long").alias("salts"), _shards_of(F.lit(0)).alias("shards"))
        .unionByName(known.where("n > 1 and size > 0").select("uid", "vid", F.ceil(F.ceil(F.col("n") / _each(spec)) / SALT).cast("long").alias("salts"), F.array().cast("array<int>").alias("shards")))
    )
    joined = rows.select("uid", "vid", "row").hint("merge").join(told, ["uid", "vid"])
    single = joined.where("salts = 0").select("uid", "vid", F.lit(0).cast("long").alias("copy"), "row", F.posexplode("shards").alias("nr", "shard"))
    again = (
        joined.where("salts > 0").groupBy("uid", "vid").agg(F.first("row").alias("row"), F.max("salts").alias("salts"))
        .select("uid", "vid", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        .hint("merge").join(drawn.withColumn("salt", F.floor(F.col("part") / SALT)), ["uid", "vid", "salt"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select("uid", "vid", (F.col("part") * spec.block_rows + F.col("copy")).alias("copy"), "row", F.posexplode(_shards_of(F.col("copy"))).alias("nr", "shard"))
    )
    both = single.unionByName(again).withColumn("order", F.xxhash64(F.lit(spec.seed + 3), "uid", "copy", "nr", "shard"))
    return both.repartition("shard").sortWithinPartitions("shard", "order").select("row.*")


def op1_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3, repeating; at most three times a source."""
    return taken_words(table(spark, sf_dir, "documents"), Mix()).select("doc_id", "size", "source_size", "target", "taken", "shards")
