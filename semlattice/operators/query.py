"""Search, detail, relations, traversals, rankings and trends over the triple table.

canonical: (uri, canonical_uri) of merged entities only; an empty one leaves ids as they are.
All listings have a total order, ties by id.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import holds, unslug
from ..plans.scratch import join_checked, ranked, saved, spread
from .graph import called, canonical_of, labels, least_class, names, of, tail, types

# Relations that an entity's page shows, and the display names of properties.
SHOWN_RELATIONS = ("authorOf", "affiliatedWith", "publishedIn", "belongsToField", "belongsToIndustry", "fundedBy", "coAuthorWith", "cites")
DISPLAY = {
    "name": "name", "openalex_id": "OpenAlex id", "year": "year", "doi": "DOI", "cited_by_count": "citations", "citedByCount": "citations", "country": "country",
    "level": "level", "revenue": "revenue", "employees": "employees", "region": "region", "cnLabel": "Chinese name", "description": "description", "worksCount": "works",
    "hIndex": "h-index", "publishedAt": "published", "size": "size", "license": "license", "url": "address",
}


def no_merges(t: DataFrame) -> DataFrame:
    return t.sparkSession.createDataFrame([], "uri string, canonical_uri string")


def members(t: DataFrame, canonical: DataFrame, cls: str | None = None) -> DataFrame:
    """(s, class, raw): typed entities by canonical id."""
    typed = types(t).withColumn("raw", F.col("s"))
    return canonical_of(typed.where(F.col("class") == cls) if cls else typed, canonical, "s")


def named(t: DataFrame, few: DataFrame, column: str) -> DataFrame:
    """few with `name` of the column's ids. few: the rows of a limit, so they are written once and broadcast; only their labels are looked up."""
    rows = saved(few)
    ids = rows.select(F.col(column).alias("s")).distinct()
    known = names(t.where(F.col("p").isin("name", "cnLabel")).join(F.broadcast(ids), "s", "left_semi")).withColumnRenamed("s", column)
    return rows.join(F.broadcast(known), column, "left").withColumn("name", F.coalesce("name", tail(column)))


def page(df: DataFrame, order: Sequence[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a stable order, with the total and whether more follow."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be 1 or more, offset 0 or more")
    df = saved(df)  # read twice
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), how="cross").withColumn("has_more", F.col("total") > offset + limit)  # total: one row


def page_after(df: DataFrame, key: str, last: str | None, limit: int) -> DataFrame:
    """The page after a key: cost doesn't grow with its depth."""
    return (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(limit)


# ---- lookup and search


def explore_class(t: DataFrame, canonical: DataFrame, cls: str, limit: int = 5) -> DataFrame:
    """First entities of a class by id with name, and the canonical and raw totals."""
    mine = members(t, canonical, cls)
    total = mine.agg(F.countDistinct("s").alias("n"), F.countDistinct("raw").alias("raw_n"))
    first = mine.select("s").distinct().orderBy("s").limit(limit)
    return named(canonical_of(t, canonical, "s"), first, "s").join(F.broadcast(total), how="cross").select("s", "name", "n", "raw_n")  # total: one row


def entities_of_class(t: DataFrame, canonical: DataFrame, cls: str, limit: int = 50) -> DataFrame:
    return explore_class(t, canonical, cls, limit)


def search(t: DataFrame, canonical: DataFrame, keyword: str, cls: str | None = None) -> DataFrame:
    """(s, class, name, cn_names, label): entities any of whose aliases has the keyword in a name; label is the least name hit."""
    typed = members(t, canonical, cls)
    hit = canonical_of(labels(t).where(holds(F.col("label"), F.lit(keyword))), canonical, "s").groupBy("s").agg(F.min("label").alias("label"))
    named = canonical_of(labels(t), canonical, "s").join(hit, "s", "left_semi").groupBy("s").agg(
        F.coalesce(F.min(F.when(~F.col("is_cn"), F.col("label"))), F.min("label")).alias("name"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_cn"), F.col("label")))), "、").alias("cn_names"),
    )
    return typed.groupBy("s").agg(F.min("class").alias("class")).join(hit, "s").join(named, "s").select("s", "class", "name", "cn_names", "label")


def find_entity(t: DataFrame, canonical: DataFrame, cls: str, keyword: str, limit: int = 10, offset: int = 0) -> DataFrame:
    return page(search(t, canonical, keyword, cls), ["s"], limit, offset)


def zero_hit_hint(total: DataFrame, keyword: str) -> DataFrame:
    """One row (total, hint) from the rows of a search: how many there are, and advice if there is none."""
    hint = F.when(F.col("total") == 0, F.lit(f"no entity's name holds '{keyword}'; try a shorter part of it, or list a class"))
    return total.agg(F.count("*").alias("total")).withColumn("hint", hint)


def search_cross_class(t: DataFrame, canonical: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    return page(search(t, canonical, keyword), ["s"], limit)


def search_publications(t: DataFrame, canonical: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    return find_entity(t, canonical, "Publication", keyword, limit)


def entity_detail(t: DataFrame, canonical: DataFrame, ids: DataFrame) -> DataFrame:
    """(uri, kind, p, value, target): properties and relations over all aliases of the ids (column uri)."""
    asked = canonical_of(ids.withColumn("asked", F.col("uri")), canonical, "uri").select("asked", F.col("uri").alias("s"))
    facts = canonical_of(t, canonical, "s").join(asked, "s").select("asked", "p", "o", "o_kind").distinct()
    relation = F.col("o_kind") == "uri"
    # literals and classes need no name: only the other relations are shuffled by their target
    columns = lambda name: [F.col("asked").alias("uri"), F.lit("relation").alias("kind"), "p", name.alias("value"), F.col("o").alias("target")]
    named = called(facts.where(relation & (F.col("p") != "type")), t, "o").select(columns(F.col("name")))
    named = named.unionByName(facts.where(relation & (F.col("p") == "type")).select(columns(tail("o"))))
    return named.unionByName(facts.where(~relation).select(F.col("asked").alias("uri"), F.lit("property").alias("kind"), "p", F.col("o").alias("value"), F.lit(None).cast("string").alias("target")))


def properties_of(t: DataFrame, canonical: DataFrame, ids: DataFrame) -> DataFrame:
    """(uri, label, value): known properties under their display names, several values joined by ' / '."""
    shown = t.sparkSession.createDataFrame(list(DISPLAY.items()), "p string, label string")
    facts = entity_detail(t, canonical, ids).where("kind = 'property'").join(F.broadcast(shown), "p")  # 19 rows
    return facts.groupBy("uri", "label").agg(F.array_join(F.array_sort(F.collect_set("value")), " / ").alias("value"))


def related_to(t: DataFrame, ids: DataFrame) -> DataFrame:
    """(uri, p, target, name, class): outgoing edges of the shown relations."""
    edges = t.where(F.col("p").isin(*SHOWN_RELATIONS) & (F.col("o_kind") == "uri")).join(ids.select(F.col("uri").alias("s")), "s", "left_semi").select(F.col("s").alias("uri"), "p", F.col("o").alias("s"))
    return called(edges.distinct(), t).hint("merge").join(saved(least_class(t)), "s", "left").select("uri", "p", F.col("s").alias("target"), "name", F.coalesce("class", F.lit("Unknown")).alias("class"))


def reverse_related(t: DataFrame, canonical: DataFrame, relation: str) -> DataFrame:
    """(target, s): incoming edges by canonical ids at both ends, distinct."""
    return canonical_of(canonical_of(of(t, relation), canonical, "s"), canonical, "o").select(F.col("o").alias("target"), "s").distinct()


def relations_grouped(t: DataFrame, canonical: DataFrame, ids: DataFrame, shown: int = 20) -> DataFrame:
    """(uri, p, names, n): up to `shown` least names of each relation, and the total."""
    facts = entity_detail(t, canonical, ids).where("kind = 'relation'").select("uri", "p", "target", "value").distinct()
    first = facts.withColumn("nr", F.row_number().over(W.partitionBy("uri", "p").orderBy("value", "target"))).where(F.col("nr") <= shown)
    listed = first.groupBy("uri", "p").agg(F.array_sort(F.collect_list("value")).alias("names"))
    return listed.join(facts.groupBy("uri", "p").agg(F.count("*").alias("n")), ["uri", "p"])


def query_relation(t: DataFrame, canonical: DataFrame, subject_class: str, relation: str, object_class: str) -> DataFrame:
    """(s, s_name, o, o_name): distinct canonical edges between entities of the two classes."""
    pairs = reverse_related(t, canonical, relation).select("s", F.col("target").alias("o"))
    ends = lambda cls, c: members(t, canonical, cls).select(F.col("s").alias(c)).distinct()
    kept = pairs.join(ends(subject_class, "s"), "s", "left_semi").join(ends(object_class, "o"), "o", "left_semi")
    merged = canonical_of(t, canonical, "s")
    return called(called(kept, merged, "s", "s_name"), merged, "o", "o_name").select("s", "s_name", "o", "o_name")


def relation_page(t: DataFrame, canonical: DataFrame, subject_class: str, relation: str, object_class: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of query_relation() by the ends' ids, with the total before the limit."""
    return page(query_relation(t, canonical, subject_class, relation, object_class), ["s", "o"], limit, offset)


# ---- traversals


def publications_for(t: DataFrame, scholar: str = "Scholar", institution: str = "Institution", field: str = "Field", publication: str = "Publication", only: Collection[str] = ("scholar", "institution", "field")) -> DataFrame:
    """(entity, class, pub), distinct, of all scholars, institutions (over their scholars) and fields at once, or of some of these roles only."""
    typed = types(t)
    of_class = lambda cls, c: typed.where(F.col("class") == cls).select(F.col("s").alias(c))
    wrote = of(t, "authorOf").select(F.col("s").alias("a"), F.col("o").alias("pub")).join(of_class(publication, "pub"), "pub", "left_semi")
    parts = []
    if "scholar" in only:
        parts.append(wrote.join(of_class(scholar, "a"), "a", "left_semi").select(F.col("a").alias("entity"), F.lit(scholar).alias("class"), "pub"))
    if "institution" in only:
        at = of(t, "affiliatedWith").select(F.col("s").alias("a"), F.col("o").alias("entity")).join(of_class(scholar, "a"), "a", "left_semi").join(of_class(institution, "entity"), "entity", "left_semi")
        parts.append(at.join(wrote, "a").select("entity", F.lit(institution).alias("class"), "pub"))
    if "field" in only:
        by_field = of(t, "belongsToField").select(F.col("o").alias("entity"), F.col("s").alias("pub")).join(of_class(field, "entity"), "entity", "left_semi")
        parts.append(by_field.join(of_class(publication, "pub"), "pub", "left_semi").select("entity", F.lit(field).alias("class"), "pub"))
    return reduce(DataFrame.unionByName, parts).distinct()


def in_all_scopes(pubs: DataFrame, scopes: DataFrame) -> DataFrame:
    """(question, pub): publications in all scopes (question, entity) of a question, by one count."""
    wanted = scopes.distinct().groupBy("question").agg(F.count("*").alias("need"))
    have = scopes.distinct().join(pubs.select("entity", "pub").distinct(), "entity").groupBy("question", "pub").agg(F.count("*").alias("have"))
    return have.join(wanted, "question").where("have = need").select("question", "pub")


def scholars_of(t: DataFrame, canonical: DataFrame, institution: str, field: str) -> DataFrame:
    """(s) scholars of an institution who have a publication in a field or belong to it."""
    at = reverse_related(t, canonical, "affiliatedWith").where(F.col("target") == institution).select("s")
    in_field = reverse_related(t, canonical, "belongsToField").where(F.col("target") == field).select("s")
    by_work = of(t, "authorOf").join(in_field.select(F.col("s").alias("o")), "o", "left_semi").select("s")
    return at.join(in_field.unionByName(by_work).distinct(), "s", "left_semi").distinct()


def coauthor_edges(t: DataFrame, relation: str = "authorOf", max_authors: int | None = None, block: int = 1000, each: int = 250_000) -> DataFrame:
    """(a, b) in both directions of different authors of one work.

    Works of more than `block` authors are cut into blocks by a hash, as many as their number of authors asks
    for, and each pair of blocks is joined on its own, so that no key holds all of a large work's pairs. All others
    are joined by the work.
    max_authors: leaves out works with more, if given. each: rows of a task, about, and four times as many pairs; both are
    counted and dealt out before they are made distinct, whatever the files' density and the session's number of partitions.
    """
    wrote = of(t, relation).select(F.col("o").alias("pub"), F.col("s").alias("a"))
    wrote = saved(spread(wrote, wrote.count(), each).distinct())
    if max_authors is not None:
        wrote = wrote.join(wrote.groupBy("pub").count().where(F.col("count") <= max_authors).select("pub"), "pub", "left_semi")
    n = wrote.count()
    sizes = saved(spread(wrote, n, each).groupBy("pub").agg(F.count("*").alias("size")))
    large = saved(sizes.select("pub", F.ceil(F.col("size") / block).cast("int").alias("n")).where("n > 1"))
    n_pairs = sizes.agg(F.coalesce(F.sum(F.col("size") * (F.col("size") - 1) / 2), F.lit(0)).cast("long")).first()[0]
    small = wrote if large.isEmpty() else join_checked(wrote, large.select("pub"), "pub", "left_anti")
    small = spread(small, n, each, by=["pub"])
    pairs = small.hint("merge").join(small.withColumnRenamed("a", "b"), "pub").where("a < b").select("a", "b")
    cut = join_checked(wrote, large, "pub").withColumn("mine", F.pmod(F.xxhash64("a"), F.col("n")).cast("int"))
    left = cut.select("pub", "a", F.col("mine").alias("x"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("y"))
    right = cut.select("pub", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x"), F.col("mine").alias("y"))
    if not large.isEmpty():
        pairs = pairs.unionByName(left.hint("merge").join(right, ["pub", "x", "y"]).where("a < b").select("a", "b"))
    pairs = spread(pairs, n_pairs, 4 * each).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def inverse_edges(t: DataFrame, relation: str, inverse: str) -> DataFrame:
    """The relation's edges turned round, under the inverse's name."""
    return t.where((F.col("p") == relation) & (F.col("o_kind") == "uri")).select(F.col("o").alias("s"), F.lit(inverse).alias("p"), F.col("s").alias("o"), "o_kind", "o_datatype", "o_lang")


# ---- aggregates and rankings


def count_by_relation(t: DataFrame, canonical: DataFrame, subject_class: str, relation: str, object_class: str) -> DataFrame:
    """(target, name, n): distinct canonical subjects of each target, most first."""
    pairs = query_relation(t, canonical, subject_class, relation, object_class)
    return pairs.groupBy(F.col("o").alias("target"), F.col("o_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target")


def numeric_summary(t: DataFrame, canonical: DataFrame, cls: str, prop: str, top: int = 20) -> DataFrame:
    """(s, name, value): largest value of each canonical entity, greatest first."""
    values = of(t, prop).select("s", F.col("o").try_cast("double").alias("value")).where("value is not null").withColumnRenamed("s", "raw")
    best = members(t, canonical, cls).join(values, "raw").groupBy("s").agg(F.max("value").alias("value")).orderBy(F.desc("value"), "s").limit(top)
    return named(canonical_of(t, canonical, "s"), best, "s").select("s", "name", "value").orderBy(F.desc("value"), "s")


def numeric_total(t: DataFrame, canonical: DataFrame, cls: str, prop: str) -> DataFrame:
    """One row (total): canonical entities that numeric_summary() ranks."""
    values = of(t, prop).where(F.col("o").try_cast("double").isNotNull()).select(F.col("s").alias("raw")).distinct()
    return members(t, canonical, cls).join(values, "raw").agg(F.count_distinct("s").alias("total"))


def field_matches(t: DataFrame, term: str, cls: str = "Field") -> DataFrame:
    """(s): fields whose name, Chinese name or decoded id contains the term."""
    typed = types(t).where(F.col("class") == cls).select("s")
    by_label = labels(t).where(F.contains("label", F.lit(term))).select("s")
    by_id = typed.where(F.contains(F.coalesce(unslug(F.col("s")), F.col("s")), F.lit(term)))
    return typed.join(by_label.unionByName(by_id).distinct(), "s", "left_semi")


def year_distribution(t: DataFrame, cls: str = "Publication", field: str | None = None, pubs: DataFrame | None = None, relation: str = "belongsToField") -> DataFrame:
    """(year, n) ascending: entities by their least whole-number year; of a field or of given pubs (column pub) only."""
    mine = types(t).where(F.col("class") == cls).select("s")
    if pubs is not None:
        mine = mine.join(pubs.select(F.col("pub").alias("s")).distinct(), "s", "left_semi")
    if field is not None:
        mine = mine.join(of(t, relation).join(field_matches(t, field).select(F.col("s").alias("o")), "o", "left_semi").select("s").distinct(), "s", "left_semi")
    return mine.join(work_years(t, cls), "s").groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


def work_years(t: DataFrame, cls: str = "Publication") -> DataFrame:
    """(s, year): entities of the class with their least whole-number year."""
    year = of(t, "year").select("s", F.when(F.col("o").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim("o").try_cast("int")).alias("year")).where("year is not null").groupBy("s").agg(F.min("year").alias("year"))
    return year.join(types(t).where(F.col("class") == cls).select("s"), "s", "left_semi")


def most_published(t: DataFrame, role: str, top: int, within: str | None = None, **classes: str) -> DataFrame:
    """(entity, n): entities of a role (institution or scholar) by distinct publications, those without any included; of one field only if given.

    Works on terms and on ids alike; classes: what stands for the four classes of publications_for().
    """
    roles = {"scholar": "Scholar", "institution": "Institution", "field": "Field", "publication": "Publication"} | classes
    mine = publications_for(t, **roles, only=(role,)).select("entity", "pub")
    if within is not None:
        in_field = publications_for(t.where((F.col("p") != "belongsToField") | (F.col("o") == within)), **roles, only=("field",))
        mine = mine.join(in_field.select("pub"), "pub", "left_semi")
    everyone = types(t).where(F.col("class") == roles[role]).select(F.col("s").alias("entity"))
    counted = mine.groupBy("entity").agg(F.count("*").alias("n"))
    return everyone.join(counted, "entity", "left").select("entity", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")).orderBy(F.desc("n"), "entity").limit(top)


def institution_ranking(t: DataFrame, top: int = 30, field: str | None = None, **classes: str) -> DataFrame:
    """(entity, name, n): institutions by distinct publications, those without any included; of one field only if given."""
    return named(t, most_published(t, "institution", top, field, **classes), "entity").select("entity", "name", "n").orderBy(F.desc("n"), "entity")


def scholar_ranking(t: DataFrame, top: int = 30, **classes: str) -> DataFrame:
    """(entity, name, n): scholars by distinct publications."""
    first = most_published(t, "scholar", top, **classes).where("n > 0")
    return named(t, first, "entity").select("entity", "name", "n").orderBy(F.desc("n"), "entity")


def papers_per_field(t: DataFrame, relation: str = "belongsToField") -> DataFrame:
    """(name, n): distinct subjects of each field, by the field's name."""
    return called(of(t, relation), t, "o").groupBy("name").agg(F.countDistinct("s").alias("n")).orderBy(F.desc("n"), "name")


def companies_in_industry(t: DataFrame, term: str, top: int = 20) -> DataFrame:
    """(s, name, revenue, employees, total, has_more): companies of industries whose name has the term, most revenue first, unknown last."""
    industries = labels(t).where(holds(F.col("label"), F.lit(term))).join(types(t).where("class = 'Industry'").select("s"), "s", "left_semi").select(F.col("s").alias("o")).distinct()
    companies = of(t, "belongsToIndustry").join(industries, "o", "left_semi").select("s").distinct()
    largest = lambda p: of(t, p).groupBy("s").agg(F.max(F.col("o").try_cast("double")).alias(p))
    listed = called(companies, t).join(largest("revenue"), "s", "left").join(largest("employees"), "s", "left").select("s", "name", "revenue", "employees")
    return page(listed, [F.desc_nulls_last("revenue"), "s"], top)


def industry_members(t: DataFrame, canonical: DataFrame, industry: str) -> DataFrame:
    """(s, name, revenue, employees, n, raw_n): an industry's companies, with canonical and raw totals; revenue to two decimals."""
    edges = of(t, "belongsToIndustry").withColumn("raw", F.col("s"))
    mine = canonical_of(canonical_of(edges, canonical, "s"), canonical, "o").where(F.col("o") == industry)
    total = mine.agg(F.countDistinct("s").alias("n"), F.countDistinct("raw").alias("raw_n"))
    merged = canonical_of(t, canonical, "s")
    last = lambda p: of(merged, p).groupBy("s").agg(F.max("o").alias(p))  # noqa: E731  of several values the last as text
    rows = called(mine.select("s").distinct(), merged).join(last("revenue"), "s", "left").join(last("employees"), "s", "left")
    return rows.join(F.broadcast(total), how="cross").select("s", "name", F.round(F.col("revenue").try_cast("double"), 2).alias("revenue"), F.col("employees").try_cast("bigint").alias("employees"), "n", "raw_n").orderBy(F.desc_nulls_last("revenue"), "s")  # total: one row


def field_members(t: DataFrame, canonical: DataFrame, field: str, classes: Sequence[str] = (), shown: int = 30) -> DataFrame:
    """(s, class, name, total, has_more): what belongs to a field, of the asked classes if any, first by id."""
    mine = reverse_related(t, canonical, "belongsToField").where(F.col("target") == field).join(members(t, canonical).select("s", "class").distinct(), "s")
    mine = mine.where(F.col("class").isin(*classes)) if classes else mine
    return page(called(mine, canonical_of(t, canonical, "s")).select("s", "class", "name"), ["s", "class"], shown)


def scholars_query(t: DataFrame, institution: str | None = None, field: str | None = None, limit: int = 15) -> DataFrame:
    """(s, name, total, has_more): scholars by parts of an institution's or a field's name."""
    out = types(t).where("class = 'Scholar'").select("s")
    for term, relation in ((institution, "affiliatedWith"), (field, "belongsToField")):
        if term is not None:
            ends = labels(t).where(holds(F.col("label"), F.lit(term))).select(F.col("s").alias("o")).distinct()
            out = out.join(of(t, relation).join(ends, "o", "left_semi").select("s").distinct(), "s", "left_semi")
    return page(called(out.distinct(), t), ["s"], limit)


def class_names(t: DataFrame, cls: str = "Industry") -> DataFrame:
    return called(types(t).where(F.col("class") == cls).select("s"), t).select("name").distinct().orderBy("name")


def resolve_by_label(t: DataFrame, term: str, cls: str = "Field") -> DataFrame:
    """(s): the least entity of the class whose label contains the term."""
    return field_matches(t, term, cls).agg(F.min("s").alias("s")).where("s is not null")


# ---- logs


def daily_quota(log: DataFrame, limits: dict[str, int], client: str = "client", cls: str = "cls", ts: str = "ts", tie: str = "id") -> DataFrame:
    """log with `admitted`: the first N requests of a client and day, N by the request's class; an unknown class has none.

    Ranks come from ranges of (client, day, time), so one client's requests may be any share of the log.
    """
    allowed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col(cls)), F.lit(0)) if limits else F.lit(0)
    counted = ranked(log.withColumn("admitted_day", F.to_date(ts)), [client, "admitted_day"], [F.col(ts), F.col(tie)], "admitted_rank")
    return counted.withColumn("admitted", F.col("admitted_rank") <= allowed).select(*log.columns, "admitted")
