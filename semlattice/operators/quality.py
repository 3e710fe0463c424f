"""Data-quality rules over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import types

# Class, predicate, least number of values.
RULES = (("Publication", "name", 1), ("Publication", "year", 1), ("Scholar", "authorOf", 1))


def violations(t: DataFrame, rules: tuple[tuple[str, str, int], ...] = RULES) -> DataFrame:
    """(focus, class, path, found, message) of instances with too few values; one pass for all rules."""
    rule = t.sparkSession.createDataFrame(list(rules), "class string, path string, least int")
    due = types(t).join(F.broadcast(rule), "class")  # a handful of rules
    found = t.where(F.col("p").isin(sorted({p for _, p, _ in rules}))).groupBy("s", F.col("p").alias("path")).agg(F.countDistinct("o", F.coalesce("o_datatype", F.lit(""))).alias("found"))
    return (
        due.join(found, ["s", "path"], "left").withColumn("found", F.coalesce("found", F.lit(0).cast("bigint"))).where("found < least")
        .select(F.col("s").alias("focus"), "class", "path", "found", F.format_string("%s needs at least %d %s", "class", "least", "path").alias("message"))
    )


def report(found: DataFrame) -> DataFrame:
    """One row: conforms, and the number of violations."""
    return found.agg((F.count("*") == 0).alias("conforms"), F.count("*").alias("violations"))


def first_violations(found: DataFrame, n: int = 5) -> DataFrame:
    return found.orderBy("focus", "path").limit(n)


def split_valid(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound triples and rejected ones: terms present, predicate and subject no literals, a known kind."""
    sound = F.coalesce(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & F.col("o_kind").isin("uri", "literal", "blank") & ~F.col("s").startswith('"') & ~F.col("p").startswith("_:"), F.lit(False))
    return t.where(sound), t.where(~sound)
