"""A dictionary of terms, and the graph over its ids.

Every subject and every object that is no literal gets a dense long id. Ids are dealt out by
ranges of the terms, so they are in the order of the terms: a least id is the least term, and
rankings break ties alike. Joins and aggregates then shuffle eight bytes instead of a text;
ids become terms again at the end, for the rows that are left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import TRIPLE_COLUMNS
from ..plans.scratch import join_checked, looked_up, numbered, saved
from . import bitmaps, query
from .graph import names, tail

#: Triples that a task of the joins with the dictionary gets.
EACH = 250_000


@dataclass(frozen=True)
class Graph:
    """terms: (id, term). edges: (p, s, o, o_kind) of ids. values: (p, s, o, o_kind, o_datatype, o_lang), literals of an id."""

    terms: DataFrame
    edges: DataFrame
    values: DataFrame

    def ids(self, *terms: str) -> dict[str, int]:
        """Ids of a few given terms; -1, which no term has, for an unknown one."""
        found = {r["term"]: r["id"] for r in self.terms.where(F.col("term").isin(*terms)).collect()}
        return {t: found.get(t, -1) for t in terms}


def encoded(t: DataFrame) -> Graph:
    """The dictionary and the triples over it, each written once; edges and values by predicate.

    Tasks are dealt by the number of triples, each about as large however many there are; a term in very many triples is
    brought to them.
    """
    n = t.count()
    parts = max(-(-n // EACH), int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # dealt out by term before they are made distinct: most terms are different, so a task that reads a dense file would hold them all.
    # An object in very many triples goes to several tasks, by their subjects.
    share = F.pmod(F.xxhash64("s"), F.lit(16)).cast("int").alias("share")
    ends = t.select(F.col("s").alias("term"), share).unionByName(t.where("o_kind <> 'literal'").select(F.col("o").alias("term"), share)).where("term is not null")
    nodes = saved(ends.repartition(parts, "term", "share").distinct().select("term").repartition(parts, "term").distinct())
    terms = saved(numbered(nodes.repartitionByRange(parts, "term").sortWithinPartitions("term")))
    known = lambda c: terms.select(F.col("term").alias(c), F.col("id").alias(f"{c}_id"))
    subjects = saved(looked_up(t, known("s"), "s", n, each=EACH).drop("s"))
    linked = subjects.where("o_kind <> 'literal'")
    edges = looked_up(linked, known("o"), "o", linked.count(), each=EACH).select("p", F.col("s_id").alias("s"), F.col("o_id").alias("o"), "o_kind")
    values = subjects.where("o_kind = 'literal'").select("p", F.col("s_id").alias("s"), "o", "o_kind", "o_datatype", "o_lang")
    return Graph(terms, saved(edges, "p"), saved(values, "p"))


def decoded(rows: DataFrame, g: Graph, *columns: str) -> DataFrame:
    """rows, a written table, with the terms of the columns' ids, which stay null where they are."""
    out, n = rows, rows.count()
    for i, c in enumerate(columns):
        known = g.terms.select(F.col("id").alias(c), F.col("term").alias(f"{c}_term"))
        out = looked_up(saved(out) if i else out, known, c, n, "left", EACH).withColumn(c, F.col(f"{c}_term")).drop(f"{c}_term")
    return out.select(rows.columns)


def few_decoded(rows: DataFrame, g: Graph, *columns: str) -> DataFrame:
    """Likewise for the rows of a limit: they are counted, and the dictionary's files are read but not shuffled."""
    out = rows
    for c in columns:
        ids = saved(out.select(F.col(c).alias("id")).distinct())
        known = join_checked(g.terms, ids, "id", "left_semi").select(F.col("id").alias(c), F.col("term").alias(f"{c}_term"))
        out = join_checked(out, known, c, "left").withColumn(c, F.col(f"{c}_term")).drop(f"{c}_term")
    return out.select(rows.columns)


def triples(g: Graph) -> DataFrame:
    """All triples again, as terms."""
    none = F.lit(None).cast("string")
    edges = decoded(g.edges, g, "s", "o").select("s", "p", "o", "o_kind", none.alias("o_datatype"), none.alias("o_lang"))
    return edges.unionByName(decoded(g.values, g, "s").select(TRIPLE_COLUMNS)).select(TRIPLE_COLUMNS)


def named(few: DataFrame, g: Graph, column: str = "entity", name: str = "name") -> DataFrame:
    """The rows of a limit with terms in the column and their names, else the ends of the terms."""
    rows = saved(few)
    ids = rows.select(F.col(column).alias("s")).distinct()
    known = names(join_checked(g.values.where(F.col("p").isin("name", "cnLabel")), ids, "s", "left_semi")).select(F.col("s").alias(column), F.col("name").alias(name))
    return few_decoded(join_checked(rows, known, column, "left"), g, column).withColumn(name, F.coalesce(name, tail(column)))


# ---- the rankings of query.py over ids


def _classes(g: Graph, classes: dict[str, str]) -> dict[str, int]:
    names_of = {"scholar": "Scholar", "institution": "Institution", "field": "Field", "publication": "Publication"} | classes
    ids = g.ids(*names_of.values())
    return {role: ids[cls] for role, cls in names_of.items()}


def institution_ranking(g: Graph, top: int = 30, field: str | None = None, **classes: str) -> DataFrame:
    """As query.institution_ranking."""
    first = query.most_published(g.edges, "institution", top, field if field is None else g.ids(field)[field], **_classes(g, classes))
    return named(first, g).select("entity", "name", "n").orderBy(F.desc("n"), "entity")


def institution_bitmaps(g: Graph, **classes: str) -> DataFrame:
    """Stored bitmaps of the works of each institution's scholars, over ids, by the source that states who is there (null: none)."""
    ids = _classes(g, classes)
    of_class = lambda cls, c: g.edges.where((F.col("p") == "type") & (F.col("o") == ids[cls])).select(F.col("s").alias(c)).distinct()
    edges = lambda p, s, o: g.edges.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
    wrote = edges("authorOf", "a", "pub").hint("merge").join(of_class("publication", "pub"), "pub", "left_semi")
    at = edges("affiliatedWith", "a", "entity").hint("merge").join(of_class("scholar", "a"), "a", "left_semi").hint("merge").join(of_class("institution", "entity"), "entity", "left_semi")
    stated = edges("sourcedFrom", "a", "source").groupBy("a").agg(F.min("source").cast("string").alias("source"))
    return saved(bitmaps.bitmaps(at.hint("merge").join(wrote, "a").hint("merge").join(stated, "a", "left"), ["entity"], "source", "pub"))


def institution_ranking_by_bitmaps(g: Graph, maps: DataFrame, top: int = 30, **classes: str) -> DataFrame:
    """As institution_ranking(), from stored bitmaps; nothing is made distinct again."""
    mine = g.edges.where((F.col("p") == "type") & (F.col("o") == _classes(g, classes)["institution"])).select(F.col("s").alias("entity")).distinct()
    counted = bitmaps.distinct_counts(maps, ["entity"])
    first = mine.hint("merge").join(counted, "entity", "left").select("entity", F.coalesce("n", F.lit(0).cast("long")).alias("n")).orderBy(F.desc("n"), "entity").limit(top)
    return named(first, g).select("entity", "name", "n").orderBy(F.desc("n"), "entity")


def scholar_ranking(g: Graph, top: int = 30, **classes: str) -> DataFrame:
    """As query.scholar_ranking."""
    first = query.most_published(g.edges, "scholar", top, **_classes(g, classes)).where("n > 0")
    return named(first, g).select("entity", "name", "n").orderBy(F.desc("n"), "entity")


def papers_per_field(g: Graph, relation: str = "belongsToField") -> DataFrame:
    """As query.papers_per_field: fields of one name count together, a work once."""
    edges = g.edges.where(F.col("p") == relation).select("s", "o")
    known = saved(names(g.values)).select(F.col("s").alias("o"), "name")
    fields = saved(edges.select("o").distinct())
    fields = fields.hint("merge").join(known, "o", "left").hint("merge").join(g.terms.select(F.col("id").alias("o"), "term"), "o").select("o", F.coalesce("name", tail("term")).alias("name"))
    # a number for each name, so that works are told apart by two longs
    ids = saved(numbered(fields.select("name").distinct(), "nr"))
    of_field = saved(fields.hint("merge").join(ids, "name").select("o", "nr"))
    counted = join_checked(edges, of_field, "o").groupBy("nr").agg(F.count_distinct("s").alias("n"))
    return counted.hint("merge").join(ids, "nr").select("name", "n").orderBy(F.desc("n"), "name")


def relation(g: Graph, relation: str, ends: Sequence[str] = ("Scholar", "Institution")) -> DataFrame:
    """(s, s_name, o, o_name): edges between entities of the two classes, with names, as query.query_relation without merges."""
    ids = g.ids(*ends)
    typed = lambda cls, c: g.edges.where((F.col("p") == "type") & (F.col("o") == ids[cls])).select(F.col("s").alias(c)).distinct()
    edges = g.edges.where(F.col("p") == relation).select("s", "o").distinct().hint("merge").join(typed(ends[0], "s"), "s", "left_semi").hint("merge").join(typed(ends[1], "o"), "o", "left_semi")
    known = saved(names(g.values).select(F.col("s").alias("id"), "name"))
    out = saved(edges)
    for c in ("s", "o"):
        called = saved(out.select(F.col(c).alias("id")).distinct().hint("merge").join(g.terms, "id").hint("merge").join(known, "id", "left").select(F.col("id").alias(c), F.col("term").alias(f"{c}_term"), F.coalesce("name", tail("term")).alias(f"{c}_name")))
        out = out.hint("merge").join(called, c)
    return out.select(F.col("s_term").alias("s"), "s_name", F.col("o_term").alias("o"), "o_name")
