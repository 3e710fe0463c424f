"""Connected components by the large-star and small-star steps of Kiveris et al."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for the undirected edges (a, b); root is the least node of the component.

    Each round is two aggregates with partial results and two joins. The aggregates are written
    before they are joined back: with a plain exchange on either side the join's skewed parts
    can be split, so a hub's edges never meet in one task. Nodes without an edge to another
    node are absent.
    """
    links = saved(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = saved(both.where("b > a").hint("merge").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        down = saved(large.groupBy("a").agg(F.min("b").alias("m")))
        to_least = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        links = saved(large.hint("merge").join(down, "a").select(F.explode(to_least).alias("l")).select("l.a", "l.b").where("a <> b").distinct())
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def with_edges(current: DataFrame, added: DataFrame) -> DataFrame:
    """(node, root) after edges (a, b) were added to a graph of the components `current`.

    Each old component is contracted to its root, so the new edges meet between roots only and the
    rounds see no more than the added edges; an old component is then renamed as a whole.
    """
    at = lambda c: current.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    edges = added.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    rooted = saved(
        edges.hint("merge").join(at("a"), "a", "left").hint("merge").join(at("b"), "b", "left")
        .select("a", "b", F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y")))
    moved = saved(components(rooted.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("old"), F.col("root").alias("new")))
    renamed = lambda df: df.hint("merge").join(moved.withColumnRenamed("old", "root"), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    ends = rooted.select(F.col("a").alias("node"), F.col("x").alias("root")).unionByName(rooted.select(F.col("b").alias("node"), F.col("y").alias("root"))).distinct()
    fresh = ends.hint("merge").join(current.select("node"), "node", "left_anti")
    return saved(renamed(current.select("node", "root")).unionByName(renamed(fresh)))


def without_edges(current: DataFrame, removed: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after edges were removed. current: the components before; edges: all that are left.

    Only components that hold a removed edge are computed again, from their own edges; nodes left without one are absent.
    """
    ends = removed.select(F.col("a").alias("node")).unionByName(removed.select(F.col("b").alias("node"))).distinct()
    touched = saved(current.hint("merge").join(ends, "node", "left_semi").select("root").distinct())
    members = saved(current.hint("merge").join(touched, "root", "left_semi").select("node"))
    # both ends of an edge are in one component
    mine = edges.where("a <> b").select("a", "b").hint("merge").join(members.withColumnRenamed("node", "a"), "a", "left_semi")
    kept = current.hint("merge").join(touched, "root", "left_anti").select("node", "root")
    return saved(kept.unionByName(components(mine)))
