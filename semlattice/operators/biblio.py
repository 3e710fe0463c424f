"""Nested bibliographic records to relational tables.

works: (topic_idx, pos, topic, and the fields of WORK). First and last occurrences are taken
in the order (topic_idx, pos), carried as columns, never by the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_segment

WORK = (
    "id string, doi string, title string, display_name string, publication_year int, cited_by_count bigint, type string, "
    "primary_location struct<source:struct<id:string,display_name:string,type:string>>, "
    "authorships array<struct<author_position:string,author:struct<id:string,display_name:string,orcid:string>,"
    "institutions:array<struct<id:string,display_name:string,country_code:string>>>>"
)


def pick(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first, or the last, by the order columns. An aggregate, so partial results combine before the shuffle."""
    chosen = (F.max_by if last else F.min_by)(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(chosen.alias("__row")).select("__row.*")


def unique_works(works: DataFrame) -> DataFrame:
    """One row for each work id over all topics, the last wins."""
    return pick(works, ["id"], ["topic_idx", "pos"], last=True)


def authorships(works: DataFrame) -> DataFrame:
    """One row for each authorship with a known author."""
    a = works.select(F.col("id").alias("work"), "topic_idx", "pos", F.posexplode("authorships").alias("author_idx", "a"))
    return a.where("a.author.id is not null").select("work", "topic_idx", "pos", "author_idx", last_segment(F.col("a.author.id")).alias("scholar_id"), F.col("a.author.display_name").alias("name"), F.col("a.author.orcid").alias("orcid"), F.col("a.author_position").alias("position"), "a.institutions")


def institutions(works: DataFrame, seed: DataFrame) -> DataFrame:
    """(openalex_id, name, country, works_count, cited_by_count, h_index): the seed's, then unseen ones of authorships, the first wins."""
    seen = authorships(works).select("topic_idx", "pos", "author_idx", F.posexplode("institutions").alias("inst_idx", "i")).where("i.id is not null")
    none = F.lit(None).cast("bigint")
    rows = seen.select(last_segment(F.col("i.id")).alias("openalex_id"), F.col("i.display_name").alias("name"), F.col("i.country_code").alias("country"), none.alias("works_count"), none.alias("cited_by_count"), none.alias("h_index"), "topic_idx", "pos", "author_idx", "inst_idx")
    fresh = pick(rows, ["openalex_id"], ["topic_idx", "pos", "author_idx", "inst_idx"]).drop("topic_idx", "pos", "author_idx", "inst_idx")
    own = seed.select("openalex_id", "name", "country", "works_count", "cited_by_count", "h_index")
    return own.unionByName(fresh.join(own, "openalex_id", "left_anti"))


def scholars(works: DataFrame) -> DataFrame:
    """(openalex_id, name, orcid), the first occurrence wins."""
    rows = authorships(works).select(F.col("scholar_id").alias("openalex_id"), "name", "orcid", "topic_idx", "pos", "author_idx")
    return pick(rows, ["openalex_id"], ["topic_idx", "pos", "author_idx"]).select("openalex_id", "name", "orcid")


def title_of() -> Column:
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.substring(F.coalesce(filled("display_name"), filled("title"), F.lit("")), 1, 300)


def publications(works: DataFrame, unique: bool = False) -> DataFrame:
    """(openalex_id, doi, title, year, cited_by_count, venue_id, type), the last occurrence wins. unique: works are those of unique_works()."""
    return (works if unique else unique_works(works)).select(last_segment(F.col("id")).alias("openalex_id"), "doi", title_of().alias("title"), F.col("publication_year").alias("year"), "cited_by_count", last_segment(F.col("primary_location.source.id")).alias("venue_id"), "type")


def venues(works: DataFrame) -> DataFrame:
    """(openalex_id, name, type), the last occurrence wins."""
    rows = works.where("primary_location.source.id is not null").select(last_segment(F.col("primary_location.source.id")).alias("openalex_id"), F.col("primary_location.source.display_name").alias("name"), F.col("primary_location.source.type").alias("type"), "topic_idx", "pos")
    return pick(rows, ["openalex_id"], ["topic_idx", "pos"], last=True).select("openalex_id", "name", "type")


def author_of(works: DataFrame, unique: bool = False) -> DataFrame:
    """(scholar_id, pub_id, position): one row for each authorship of each distinct work, repeats kept. unique: works are those of unique_works()."""
    return authorships(works if unique else unique_works(works)).select("scholar_id", last_segment(F.col("work")).alias("pub_id"), "position")


def affiliation(works: DataFrame) -> DataFrame:
    """(scholar_id, inst_id), distinct."""
    rows = authorships(works).select("scholar_id", F.explode("institutions").alias("i")).where("i.id is not null")
    return rows.select("scholar_id", last_segment(F.col("i.id")).alias("inst_id")).distinct()


def published_in(works: DataFrame, unique: bool = False) -> DataFrame:
    """(pub_id, venue_id) of works with a venue. unique: works are those of unique_works()."""
    return publications(works, unique).where("venue_id is not null").select(F.col("openalex_id").alias("pub_id"), "venue_id")


def belongs_to_field(works: DataFrame, fields: DataFrame) -> DataFrame:
    """(pub_id, field_id): distinct topics of each work, by the fields' labels. fields: a dimension (cn_label, openalex_id)."""
    topics = works.select(last_segment(F.col("id")).alias("pub_id"), F.col("topic").alias("cn_label")).where("pub_id is not null").distinct()
    return topics.join(fields.select("cn_label", F.col("openalex_id").alias("field_id")), "cn_label").select("pub_id", "field_id")


def field_dimension(spark, rows: list[tuple[str, str, str, int]]) -> DataFrame:
    """(openalex_id, name, cn_label, level) from settings."""
    return spark.createDataFrame(rows, "openalex_id string, name string, cn_label string, level int")


def reshaped(works: DataFrame, other: str = "其他", key_prefix: str = "") -> DataFrame:
    """One row for each work: first ten authors and their ids, five least distinct institutions, bare DOI, sorted topics."""
    topics = works.groupBy("id").agg(F.array_sort(F.collect_set("topic")).alias("domain"))
    w = unique_works(works.where("id is not null")).drop("topic")
    authors = F.slice(F.filter(F.coalesce("authorships", F.array().cast(dict(works.dtypes)["authorships"])), lambda a: a["author"]["id"].isNotNull()), 1, 10)
    places = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(authors, lambda a: F.coalesce(F.transform(a["institutions"], lambda i: i["display_name"]), F.array().cast("array<string>")))))))
    return w.join(topics, "id", "left").select(
        F.concat(F.lit(key_prefix), last_segment(F.col("id"))).alias("work_id"), title_of().alias("title"), F.col("publication_year").alias("year"), F.replace("doi", F.lit("https://doi.org/"), F.lit("")).alias("doi"), "cited_by_count", "type",
        F.when(F.size(F.coalesce("domain", F.array().cast("array<string>"))) > 0, F.col("domain")).otherwise(F.array(F.lit(other))).alias("domain"),
        F.transform(authors, lambda a: a["author"]["display_name"]).alias("authors"), F.transform(authors, lambda a: last_segment(a["author"]["id"])).alias("author_ids"),
        F.slice(places, 1, 5).alias("institutions"), F.col("primary_location.source.display_name").alias("venue"),
    )


def rejected(works: DataFrame) -> DataFrame:
    """Records without an id or with a blank one: see sound(), counted here."""
    return works.where("id is null or trim(id) = ''").agg(F.count("*").alias("rejected"))


def sound(works: DataFrame) -> DataFrame:
    """The records that the tables are made of: a bad one is left out, the others go on."""
    return works.where("id is not null and trim(id) <> ''")


def known_institutions(rows: DataFrame) -> DataFrame:
    """Institutions under the prepared names."""
    return rows.where("openalex_id is not null").select(F.col("openalex_id").alias("inst_id"), "name", F.col("country").alias("country_code"), "works_count", "cited_by_count", "h_index")


def known_concepts(concepts: DataFrame) -> DataFrame:
    """Concepts with an id, under the prepared names."""
    return concepts.where("openalex_id is not null").select(F.col("openalex_id").alias("field_id"), F.col("en_query").alias("name"), F.col("cn_label").alias("cn_name"))


def filled_up(first: DataFrame, second: DataFrame, group: str, key: str, least: int, replace: bool = False) -> DataFrame:
    """first, and for groups with fewer than `least` rows the second source's rows: those not seen yet, or all in place of the first's."""
    groups = first.select(group).unionByName(second.select(group)).distinct()
    counts = groups.join(first.groupBy(group).agg(F.count("*").alias("n")), group, "left").where(F.coalesce("n", F.lit(0)) < least).select(group)
    extra = second.join(counts, group, "left_semi")
    if replace:
        swapped = extra.select(group).distinct()
        return first.join(swapped, group, "left_anti").unionByName(extra)
    return first.unionByName(extra.join(first.select(group, key).distinct(), [group, key], "left_anti"))


def overwritten(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """old with whole groups replaced by the newer ones."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def author_ids(works: DataFrame, cap: int = 120) -> DataFrame:
    """(scholar_id): distinct authors in order of first occurrence, at most `cap`."""
    first = authorships(works).groupBy("scholar_id").agg(F.min(F.struct("topic_idx", "pos", "author_idx")).alias("at"))
    return first.orderBy("at", "scholar_id").limit(cap).select("scholar_id")
