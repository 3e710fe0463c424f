"""Adding and withdrawing sources with exact ownership of triples.

contributions holds every triple once for each source that states it: (source_id, owner,
partition_id, triple columns). The graph is the distinct view over it, so a withdrawal needs
no reference counts: what another source states stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import not_blank
from ..plans.config import TRIPLE_COLUMNS

CONTRIBUTIONS = ["source_id", "owner", "partition_id", *TRIPLE_COLUMNS]
REMOVABLE = "upload_"


# ---- rows of an upload


def drop_empty_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Without rows all of whose cells are null or blank."""
    return rows.where(F.exists(F.array(*[F.col(c).cast("string") for c in columns]), lambda c: F.coalesce(not_blank(c), F.lit(False))))


def drop_blank_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.coalesce(not_blank(F.col(key).cast("string")), F.lit(False)))


def accepted_tables(tables: DataFrame, allow_generic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tables (class, ...) to use, and refused ones with a reason: tables of no known class, unless allowed."""
    generic = F.lit(False) if allow_generic else F.col("class") == "GenericRecord"
    return tables.where(~generic), tables.where(generic).withColumn("reason", F.lit("no known class"))


def within_quota(rows: DataFrame, max_rows: int = 5000, table: str = "sheet_idx", order: str = "row_idx") -> DataFrame:
    """The first max_rows rows over all tables, in table and row order.

    Rows before a table come from a count for each table, so no window spans all rows; a
    table's rows beyond max_rows are dropped before they are numbered.
    """
    counts = rows.groupBy(table).agg(F.count("*").alias("n"))
    before = counts.select(table, F.coalesce(F.sum("n").over(W.orderBy(table).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a table
    # the first filter lets Spark cut each table to max_rows before the shuffle
    numbered = rows.withColumn("nr", F.row_number().over(W.partitionBy(table).orderBy(order))).where(F.col("nr") <= max_rows).join(before.where(F.col("before") < max_rows), table)
    return numbered.where(F.col("before") + F.col("nr") <= max_rows).drop("before", "nr")


def unique_keys(rows: DataFrame, key: str, number: str) -> DataFrame:
    """rows with unique keys as text: blank and repeated ones become auto<number>, number being each row's own, from 1 in their order.

    If a real key has that form already, as many '_' follow as it takes to be free.
    """
    text = F.col(key).cast("string")
    blank = ~F.coalesce(not_blank(text), F.lit(False))
    ranked = rows.withColumn("__key", F.when(~blank, text))
    # the first row of each key by an aggregate with partial results: blank and very frequent keys meet in no window
    first = ranked.where("__key is not null").groupBy("__key").agg(F.min(number).alias("__first"))
    ranked = ranked.hint("merge").join(first, "__key", "left").withColumn("__again", F.col("__first").isNull() | (F.col(number) > F.col("__first")))
    # real keys of the form auto<number>_*, by number
    taken = rows.select(F.regexp_extract(text, r"^auto([0-9]+)(_*)$", 1).alias("a"), F.length(F.regexp_extract(text, r"^auto([0-9]+)(_*)$", 2)).alias("u")).where("a <> ''").groupBy(F.col("a").try_cast("bigint").alias("__auto")).agg(F.array_sort(F.collect_set("u")).alias("__used"))
    fresh = ranked.join(taken.hint("merge"), F.col(number).cast("bigint") == F.col("__auto"), "left")
    used = F.coalesce("__used", F.array().cast("array<int>"))
    marks = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used))
    auto = F.concat(F.lit("auto"), F.col(number).cast("string"), F.repeat(F.lit("_"), marks))
    return fresh.withColumn(key, F.when(F.col("__again"), auto).otherwise(F.col("__key"))).select(rows.columns)


def quality_report(rows: DataFrame) -> DataFrame:
    """One row from flags kept and truncated: rows in, used, filtered and truncated."""
    return rows.agg(F.count("*").alias("rows_in"), F.count_if(F.col("kept") & ~F.col("truncated")).alias("rows_used"), F.count_if(~F.col("kept")).alias("rows_filtered"), F.count_if(F.col("kept") & F.col("truncated")).alias("rows_truncated"))


def entity_count(triples: DataFrame) -> DataFrame:
    """One row: distinct entities over all tables of a source."""
    return triples.where("p = 'type'").agg(F.countDistinct("s").alias("entities"))


# ---- contributions


def contribute(triples: DataFrame, source_id: str, owner: str | None = None, partition_id: str | None = None) -> DataFrame:
    """A source's distinct triples as rows of contributions."""
    lit = lambda x: F.lit(x).cast("string")
    return triples.dropDuplicates(TRIPLE_COLUMNS).select(lit(source_id).alias("source_id"), lit(owner).alias("owner"), lit(partition_id).alias("partition_id"), *TRIPLE_COLUMNS)


def graph(contributions: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The distinct triples of all contributions, and of a base graph that no withdrawal touches."""
    rows = contributions.select(TRIPLE_COLUMNS)
    return (rows if base is None else rows.unionByName(base.select(TRIPLE_COLUMNS))).dropDuplicates()


def except_triples(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct triples of left that right lacks; nulls are equal."""
    return left.select(TRIPLE_COLUMNS).subtract(right.select(TRIPLE_COLUMNS))


def net_new(triples: DataFrame, current: DataFrame) -> DataFrame:
    return except_triples(triples, current)


def withdraw(contributions: DataFrame, source_id: str) -> DataFrame:
    """contributions without a source; only uploaded ones may be withdrawn."""
    if not source_id.startswith(REMOVABLE):
        raise ValueError(f"{source_id} is not an uploaded source")
    return contributions.where(F.col("source_id") != source_id)


def removable_sources(contributions: DataFrame) -> DataFrame:
    """(source_id, removable, triples): sources, and whether withdraw() takes them."""
    return contributions.groupBy("source_id").agg(F.count("*").alias("triples")).select("source_id", F.col("source_id").startswith(REMOVABLE).alias("removable"), "triples")


def withdrawn_triples(contributions: DataFrame, source_id: str, base: DataFrame | None = None) -> DataFrame:
    """Triples that vanish with the source: no other source and no base has them."""
    return except_triples(contributions.where(F.col("source_id") == source_id), graph(withdraw(contributions, source_id), base))


def visible_to(contributions: DataFrame, owner: str) -> DataFrame:
    """Public triples and the owner's private ones, distinct."""
    return graph(contributions.where(F.col("owner").isNull() | (F.col("owner") == owner)))


def partition_of(contributions: DataFrame, owner: str, partition_id: str | None = None) -> DataFrame:
    mine = contributions.where(F.col("owner") == owner)
    return graph(mine if partition_id is None else mine.where(F.col("partition_id") == partition_id))


def list_partitions(contributions: DataFrame, owner: str, default: str = "user_0") -> DataFrame:
    """(partition_id, triples): an owner's partitions, the default first."""
    mine = contributions.where(F.col("owner") == owner).select("partition_id", *TRIPLE_COLUMNS).distinct()
    return mine.groupBy("partition_id").agg(F.count("*").alias("triples")).orderBy(F.col("partition_id") != default, "partition_id")


def delete_partition(contributions: DataFrame, owner: str, partition_id: str) -> DataFrame:
    return contributions.where(~(F.col("owner").eqNullSafe(owner) & F.col("partition_id").eqNullSafe(partition_id)))
