"""Exact top-k search by inner product with multi-resolution segment statistics.

Each vector is cut into 1, 4 and 16 segments, with mean and deviation of every segment. By the
Cauchy-Schwarz inequality a segment's share of the inner product is at most
n * (mean * mean' + deviation * deviation'), equivalently its share of the squared distance
is at least n * ((mean - mean')^2 + (deviation - deviation')^2).

Rows are grouped around pivots, a bounded sample, by their finest statistics. A group's radius
bounds the score of all its rows with a query, so a query is sent only to groups that may
reach its k-th score, which its nearest group has shown before. Within a group candidates go
from coarse to fine, each level over those that the level before has left, and exact scores
are taken for the survivors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table


@dataclass(frozen=True)
class Search:
    """k: results of a query. query_block and row_block: mean rows of a block. levels: segments from coarse to fine.

    pivots: most pivots, a bound on what the driver holds and all tasks get; any number gives the same results.
    """

    k: int = 10
    query_block: int = 512
    row_block: int = 4096
    pivots: int = 1024
    levels: tuple[int, ...] = (1, 4, 16)


def vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the components floor(scale * x) as long; without vectors that are null, empty or hold null, NaN or infinite components."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v")
    )


def segment_statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """For each row sqrt(n) * mean and sqrt(n) * deviation of each segment, so that a product of two rows is a bound."""
    parts = np.array_split(np.arange(v.shape[1]), min(segments, v.shape[1]))
    mean = np.stack([v[:, p].mean(1) * np.sqrt(len(p)) for p in parts], 1)
    deviation = np.stack([v[:, p].std(1) * np.sqrt(len(p)) for p in parts], 1)
    return np.concatenate([mean, deviation], 1)


def _products(rows: np.ndarray, some: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of some rows; where these are most of the rows, all are cheaper than a copy of them."""
    return (rows @ q)[some] if 2 * len(some) > len(rows) else rows[some] @ q


def best(queries: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, rows: np.ndarray, ids: np.ndarray, spec: Search) -> pd.DataFrame:
    """The k best ids of a block for each query whose score may reach the query's floor, each with its best score, ties to smaller ids."""
    q, r = queries.astype(np.float64), rows.astype(np.float64)
    slack = 1e-9 * np.abs(q).sum(1) * (np.abs(r).max(initial=0) + 1) + 1e-6
    levels = [(segment_statistics(q, n), segment_statistics(r, n)) for n in spec.levels] if np.isfinite(floor).any() else []
    exact_in_float = np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * q.shape[1] < 2**53
    several = len(np.unique(ids)) < len(ids)
    out = []
    for i in range(len(q)):
        near = np.flatnonzero(ids != q_ids[i])
        for of_q, of_r in levels if np.isfinite(floor[i]) else []:
            near = near[_products(of_r, near, of_q[i]) + slack[i] >= floor[i]]
        score = _products(r, near, q[i]).astype(np.int64) if exact_in_float else rows[near] @ queries[i]
        keep = score >= floor[i]
        near, score = near[keep], score[keep]
        if len(near) > 4 * spec.k and not several:
            keep = score >= np.partition(score, -spec.k)[-spec.k]
            near, score = near[keep], score[keep]
        first = np.lexsort((ids[near], -score))
        if several:
            first = first[np.sort(np.unique(ids[near[first]], return_index=True)[1])]
        first = first[: spec.k]
        out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[near[first]], "score": score[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})


class Pivots:
    """The pivots' finest statistics by length of vector. Vectors of a length without pivots share 64 groups below 0."""

    def __init__(self, vectors: list[list[int]], spec: Search):
        self.spec, self.of = spec, {}
        for d in {len(v) for v in vectors}:
            nr = [i for i, v in enumerate(vectors) if len(v) == d]
            self.of[d] = (np.array(nr), segment_statistics(np.array([vectors[i] for i in nr], np.float64), spec.levels[-1]))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pivot of each vector, all of one length, and the distance from it."""
        if v.shape[1] not in self.of:
            return np.full(len(v), -1 - v.shape[1] % 64), np.full(len(v), np.inf)
        nr, pivots = self.of[v.shape[1]]
        mine = segment_statistics(v.astype(np.float64), self.spec.levels[-1])
        least = ((pivots * pivots).sum(1) - 2 * mine @ pivots.T).argmin(1)
        return nr[least], np.sqrt(((mine - pivots[least]) ** 2).sum(1))

    def bounds(self, v: np.ndarray, radius: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """Groups that hold rows of this length, and an upper bound of each vector's scores there."""
        if v.shape[1] not in self.of:
            nr = np.array([g for g in (-1 - v.shape[1] % 64,) if g in radius], np.int64)
            return nr, np.full((len(v), len(nr)), np.inf)
        nr, pivots = self.of[v.shape[1]]
        held = np.array([g in radius for g in nr], bool)
        nr, pivots = nr[held], pivots[held]
        mine = segment_statistics(v.astype(np.float64), self.spec.levels[-1])
        reach = np.array([radius[g] for g in nr])
        length, far = np.sqrt((mine * mine).sum(1))[:, None], np.sqrt((pivots * pivots).sum(1))
        return nr, mine @ pivots.T + length * reach + 1e-9 * length * (far + reach) + 1e-6


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of one length of v each, with their vectors as a matrix."""
    for _, part in frame.groupby(frame["v"].map(len)):
        yield part, np.stack(part["v"].to_numpy()).astype(np.int64)


def _score_blocks(queries: DataFrame, rows: DataFrame, spec: Search) -> DataFrame:
    """best() of each pair of a query block and a row block. queries: g, r, q, d, query_id, v, floor. rows: g, r, q, d, vec_id, v."""

    def pair(_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        stack = lambda f: np.stack(f["v"].to_numpy()).astype(np.int64)
        return best(stack(a), a["query_id"].to_numpy(), a["floor"].to_numpy(float), stack(b), b["vec_id"].to_numpy(), spec)

    keys = ["g", "r", "q", "d"]
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score long")


def _blocks(queries: DataFrame, rows: DataFrame, groups: dict[int, tuple[int, float]], spec: Search, first_only: bool) -> DataFrame:
    """Scores of queries (query_id, v, floor, g) with the rows (vec_id, v, g) of their groups g, or with a first block of each group only.

    A group's rows are cut into blocks, and so are its queries; every block of rows meets every block of queries.
    """
    spark = rows.sparkSession
    asked = {r["g"]: r["n"] for r in queries.groupBy("g").agg(F.count("*").alias("n")).collect()}  # as many rows as there are groups
    shape = [(g, 1 if first_only else -(-n // spec.row_block), -(-n // spec.row_block), -(-asked[g] // spec.query_block)) for g, (n, _) in groups.items() if g in asked]
    # at most `pivots` + 64 rows
    cuts = F.broadcast(spark.createDataFrame(shape, "g int, rs int, all_rs int, qs int"))
    part = lambda salt, c, n: F.pmod(F.xxhash64(F.lit(salt), c), F.col(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.join(cuts, "g").withColumn("r", part(2, "vec_id", "all_rs")).where("r < rs").select("g", "r", to("qs").alias("q"), F.size("v").alias("d"), "vec_id", "v")
    sent = queries.join(cuts, "g").withColumn("q", part(1, "query_id", "qs")).select("g", to("rs").alias("r"), "q", F.size("v").alias("d"), "query_id", "v", "floor")
    return _score_blocks(sent, dealt, spec)


def top_k(queries: DataFrame, rows: DataFrame, spec: Search = Search()) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k rows of highest integer inner product for each query.

    queries: query_id and v; rows: vec_id and v, as vectors() gives them. A row with the query's own
    id is no candidate. Ties go to smaller ids. Vectors of another length than the query's
    are no candidates. Equal rows count once. Several vectors with one id are one candidate, or one
    query, whose score is the best of theirs, so a query's vec_ids are distinct. Fewer candidates than k: all of them. No rows: no rows.
    """
    rows, queries = saved(rows.select("vec_id", "v").distinct()), saved(queries.select("query_id", "v").distinct())
    wanted = min(spec.pivots, -(-rows.count() // spec.row_block))
    pivots = Pivots([r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(wanted).collect()], spec)

    def group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, v in _by_length(frame):
                g, far = pivots.nearest(v)
                yield part.assign(g=g, far=far)

    grouped = saved(rows.mapInPandas(group, "vec_id long, v array<long>, g int, far double"))
    # at most `pivots` + 64 rows
    groups = {r["g"]: (r["n"], r["far"]) for r in grouped.groupBy("g").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    radius = {g: far for g, (_, far) in groups.items()}
    full = {g: radius[g] for g, (n, _) in groups.items() if n > spec.k}

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with the group of enough rows whose pivot suits it best."""
        for frame in frames:
            for part, v in _by_length(frame):
                nr, bound = pivots.bounds(v, dict.fromkeys(full, 0.0))
                if len(nr):
                    yield part.assign(floor=-np.inf, g=nr[bound.argmax(1)])

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for each group in which a row may reach its floor."""
        for frame in frames:
            for part, v in _by_length(frame):
                nr, bound = pivots.bounds(v, radius)
                i, j = np.nonzero(bound >= part["floor"].to_numpy(float)[:, None])
                if len(i):
                    yield part.iloc[i].assign(g=nr[j])

    shape, placed = "query_id long, v array<long>, floor double, g int", grouped.select("vec_id", "v", "g")
    one = _blocks(saved(queries.mapInPandas(home, shape)), placed, groups, spec, True)
    floors = one.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count_distinct("vec_id").alias("n")).where(F.col("n") >= spec.k).drop("n")
    known = queries.hint("merge").join(saved(floors), "query_id", "left").select("query_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    found = _blocks(saved(known.mapInPandas(reach, shape)), placed, groups, spec, False)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")


def op5_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 100; ten best of all other vectors."""
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"), rows)


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c q JOIN c ON q.i = c.i AND q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""
