"""Evidence-based equivalence of entities and their canonical ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.config import TRIPLE_COLUMNS
from ..plans.scratch import saved
from .components import components, with_edges, without_edges
from .graph import of, types


def fingerprints(t: DataFrame, cls: str = "Company", text: tuple[str, ...] = ("name", "region"), numbers: tuple[str, ...] = ("revenue", "employees")) -> DataFrame:
    """(s, one column for each property) of the entities that have exactly one value of each; numbers are finite and not negative."""
    wanted = [*text, *numbers]
    one = (
        t.where(F.col("p").isin(wanted) & (F.col("o_kind") == "literal")).join(types(t).where(F.col("class") == cls).select("s"), "s", "left_semi")
        .groupBy("s").agg(*[F.collect_set(F.when(F.col("p") == p, F.col("o"))).alias(p) for p in wanted])
    )
    value = lambda p: F.when(F.size(p) == 1, F.nullif(strip(F.get(p, 0)), F.lit("")))
    number = lambda p: value(p).try_cast("decimal(38,10)")
    out = one.select("s", *[value(p).alias(p) for p in text], *[number(p).alias(p) for p in numbers])
    return out.where(" and ".join([f"`{p}` is not null" for p in wanted] + [f"`{p}` >= 0" for p in numbers]))


def inferred_pairs(prints: DataFrame, t: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """(a, b): same fingerprint, a from the first source and b from the second, each the only one there.

    A side is (source entity, id prefix); both must fit. One aggregate, no self-join.
    """
    sourced = of(t, "sourcedFrom").where(F.col("o").isin(first[0], second[0])).groupBy("s").agg(F.collect_set("o").alias("from"))
    side = lambda x: F.array_contains("from", x[0]) & F.col("s").startswith(x[1])
    keys = [c for c in prints.columns if c != "s"]
    sided = prints.join(sourced, "s").withColumn("in_a", side(first)).withColumn("in_b", side(second))
    only = lambda flag: F.max(F.when(F.col(flag), F.col("s")))
    return (
        sided.groupBy(*keys).agg(F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), only("in_a").alias("a"), only("in_b").alias("b"))
        .where("n_a = 1 and n_b = 1 and a <> b").select("a", "b")
    )


def explicit_pairs(t: DataFrame, cls: str = "Company", predicates: tuple[str, ...] = ("sameAs", "http://www.w3.org/2002/07/owl#sameAs")) -> DataFrame:
    """(a, b) that are stated to be the same, both of the class."""
    members = types(t).where(F.col("class") == cls).select("s")
    stated = t.where(F.col("p").isin(*predicates) & (F.col("o_kind") == "uri")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    return stated.join(members.withColumnRenamed("s", "a"), "a", "left_semi").join(members.withColumnRenamed("s", "b"), "b", "left_semi").where("a <> b").select("a", "b").distinct()


def canonical(pairs: DataFrame) -> DataFrame:
    """(uri, canonical_uri) of all entities in a pair: the least id of the connected component."""
    return components(pairs).select(F.col("node").alias("uri"), F.col("root").alias("canonical_uri"))


def canonical_after(current: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The canonical table (uri, canonical_uri) of the pairs `after`, from that of the pairs `before`.

    Pairs (a, b) that came contract components, pairs that went cause those that held them to be computed again;
    all other rows stay as they are.
    """
    both = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    old, new = saved(both(before)), saved(both(after))
    rooted = current.select(F.col("uri").alias("node"), F.col("canonical_uri").alias("root"))
    stayed = old.hint("merge").join(new, ["a", "b"], "left_semi")
    rooted = without_edges(rooted, old.hint("merge").join(new, ["a", "b"], "left_anti"), stayed)
    rooted = with_edges(rooted, new.hint("merge").join(old, ["a", "b"], "left_anti"))
    return rooted.select(F.col("node").alias("uri"), F.col("root").alias("canonical_uri"))


def new_links(t: DataFrame, pairs: DataFrame, predicate: str = "sameAs") -> DataFrame:
    """sameAs triples of the pairs that aren't stated in either direction yet; none when run again on the result."""
    stated = of(t, predicate).select(F.col("s").alias("a"), F.col("o").alias("b"))
    either = stated.unionByName(stated.select(F.col("b").alias("a"), F.col("a").alias("b")))
    fresh = pairs.distinct().join(either, ["a", "b"], "left_anti")
    text: Column = F.lit(None).cast("string")
    return fresh.select(F.col("a").alias("s"), F.lit(predicate).alias("p"), F.col("b").alias("o"), F.lit("uri").alias("o_kind"), text.alias("o_datatype"), text.alias("o_lang")).select(TRIPLE_COLUMNS)
