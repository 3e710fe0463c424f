"""Queries over stored forms of the graph: an index of labels, statistics of predicates, a dictionary of terms."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import functions as F

from ..operators import bitmaps, equivalence, graph, mapping, pages, query, terms, textindex, view
from .register import registered
from .scratch import folder, saved
from .tables import CUSTOMER, rows, table, triples


def _stored(spark, sf_dir, *parts, only=None):
    return saved(triples(spark, sf_dir, *parts, only=only), "p")


# ---- substring search by trigrams

_NAMED = """
  n AS (SELECT 'cu_' || c_custkey AS s, 'Scholar' AS class, c_name AS name FROM customer UNION ALL SELECT 'n_' || n_nationkey, 'Institution', n_name FROM nation
    UNION ALL SELECT 'su_' || s_suppkey, 'Company', s_name FROM supplier UNION ALL SELECT DISTINCT 'ind_' || n_name, 'Industry', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def _index(spark, sf_dir):
    t = _stored(spark, sf_dir, "nation", "customer", "supplier", only=("type", "name"))
    return textindex.build(t, query.no_merges(t))


@registered(f"WITH {_NAMED} SELECT s, class, name, name AS label FROM n WHERE contains(lower(name), '00012')")
def search_by_trigrams(spark, sf_dir):
    """Entities whose name holds the keyword, over all classes."""
    return textindex.search(_index(spark, sf_dir), "00012").select("s", "class", "name", "label")


@registered(f"WITH {_NAMED} SELECT s, class, name, name AS label FROM n WHERE contains(lower(name), '_1') AND class = 'Institution'")
def search_by_short_keyword(spark, sf_dir):
    """A keyword of fewer than three characters, in one class."""
    return textindex.search(_index(spark, sf_dir), "_1", "Institution").select("s", "class", "name", "label")


@registered(f"""
  WITH {_NAMED}, h AS (SELECT * FROM n WHERE contains(lower(name), 'nation_2'))
  SELECT s, class, name, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 5 AS has_more FROM h ORDER BY s LIMIT 5
""")
def search_page_by_trigrams(spark, sf_dir):
    return query.page(textindex.search(_index(spark, sf_dir), "NATION_2"), ["s"], 5).select("s", "class", "name", "total", "has_more")


@registered("""
  SELECT 'doc_' || doc_id AS s, 'Dataset' AS class, text AS name, text AS label FROM documents WHERE contains(lower(text), 'license')
""")
def search_texts_by_trigrams(spark, sf_dir):
    """Whole texts as labels."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    none = F.lit(None).cast("string")
    rows = lambda p, o, kind: d.select(F.concat(F.lit("doc_"), "doc_id").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))
    t = saved(rows("type", F.lit("Dataset"), "uri").unionByName(rows("name", F.col("text"), "literal")), "p")
    return textindex.search(textindex.build(t, query.no_merges(t)), "License").select("s", "class", "name", "label")


# ---- statistics of predicates, and patterns in their order

_EDGES = """
  e AS (SELECT 'n_' || n_nationkey AS s, 'type' AS p, 'Institution' AS o FROM nation UNION SELECT 'n_' || n_nationkey, 'name', n_name FROM nation
    UNION SELECT 'cu_' || c_custkey, 'type', 'Scholar' FROM customer UNION SELECT 'cu_' || c_custkey, 'name', c_name FROM customer UNION SELECT 'cu_' || c_custkey, 'affiliatedWith', 'n_' || c_nationkey FROM customer
    UNION SELECT 'n_' || c_nationkey, 'type', 'Institution' FROM customer
    UNION SELECT 'o_' || o_orderkey, 'type', 'Publication' FROM orders UNION SELECT 'o_' || o_orderkey, 'name', CAST(o_orderkey AS VARCHAR) FROM orders UNION SELECT 'cu_' || o_custkey, 'authorOf', 'o_' || o_orderkey FROM orders)
"""


def _edges(spark, sf_dir):
    return _stored(spark, sf_dir, "nation", "customer", "orders", only=("type", "name", "affiliatedWith", "authorOf"))


@registered(f"WITH {_EDGES} SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM e GROUP BY p")
def predicate_statistics(spark, sf_dir):
    return graph.statistics(_edges(spark, sf_dir), exact=True).predicates


@registered(f"WITH {_EDGES} SELECT p, o, count(*) AS n FROM e WHERE p IN (SELECT p FROM e GROUP BY p HAVING count(DISTINCT o) <= 1000) GROUP BY p, o")
def common_objects(spark, sf_dir):
    return graph.statistics(_edges(spark, sf_dir), exact=True).objects


@registered("""
  SELECT 'o_' || o_orderkey AS w, 'cu_' || c_custkey AS c, 'n_' || n_nationkey AS n, c_name AS name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'
""")
def patterns_by_statistics(spark, sf_dir):
    """A selective name stands last in the question and first in the joins; a triple without variables is a filter."""
    t = _edges(spark, sf_dir)
    asked = [("?c", "authorOf", "?w"), ("?c", "name", "?name"), ("?w", "type", "Publication"), ("?c", "affiliatedWith", "?n"), ("n_3", "type", "Institution"), ("?n", "name", "NATION_3")]
    return graph.match(t, asked, sizes=graph.statistics(t)).select("w", "c", "n", "name")


@registered("SELECT 'n_' || n_nationkey AS n FROM nation WHERE false")
def patterns_without_a_fixed_triple(spark, sf_dir):
    """A triple that isn't there leaves no binding."""
    return graph.match(_stored(spark, sf_dir, "nation"), [("n_3", "type", "Scholar"), ("?n", "type", "Institution")])


# ---- rankings over ids


def _encoded(spark, sf_dir, *parts, only=None):
    return terms.encoded(_stored(spark, sf_dir, *parts, only=only))


@registered("""
  SELECT 'n_' || n_nationkey AS entity, n_name AS name, count(DISTINCT o_orderkey) AS n
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY n DESC, entity LIMIT 30
""")
def nation_order_rank_by_ids(spark, sf_dir):
    return terms.institution_ranking(_encoded(spark, sf_dir, "nation", "customer", "orders", only=("type", "name", "authorOf", "affiliatedWith")))


@registered("""
  WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = (SELECT min(p_brand) FROM part))
  SELECT 'n_' || n_nationkey AS entity, n_name AS name, count(DISTINCT l_orderkey) AS n
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY ALL ORDER BY n DESC, entity LIMIT 10
""")
def nation_rank_in_field_by_ids(spark, sf_dir):
    g = _encoded(spark, sf_dir, "nation", "customer", "orders", "brand", only=("type", "name", "authorOf", "affiliatedWith", "belongsToField"))
    brand = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return terms.institution_ranking(g, 10, field="f_" + quote(brand, safe=""))


@registered("SELECT 'cu_' || c_custkey AS entity, c_name AS name, count(DISTINCT o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY n DESC, entity LIMIT 30")
def customer_order_rank_by_ids(spark, sf_dir):
    return terms.scholar_ranking(_encoded(spark, sf_dir, "customer", "orders", only=("type", "name", "authorOf")))


@registered("SELECT p_brand AS name, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def papers_per_field_by_ids(spark, sf_dir):
    return terms.papers_per_field(_encoded(spark, sf_dir, "brand", only=("name", "belongsToField")))


@registered("SELECT 'cu_' || c_custkey AS s, c_name AS s_name, 'n_' || n_nationkey AS o, n_name AS o_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def relation_by_ids(spark, sf_dir):
    return terms.relation(_encoded(spark, sf_dir, "nation", "customer", only=("type", "name", "affiliatedWith")), "affiliatedWith")


@registered(f"WITH {_EDGES} SELECT s, p, o FROM e")
def dictionary_round_trip(spark, sf_dir):
    """All triples over ids, and as terms again."""
    return terms.triples(terms.encoded(_edges(spark, sf_dir))).select("s", "p", "o")


# ---- changes: components, a view with reference counts, listings, distinct counts


@registered("""
  WITH e AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 IN (1, 2)), x AS (SELECT k FROM e UNION SELECT k + 1 FROM e)
  SELECT 'c_' || k AS uri, min('c_' || k) OVER (PARTITION BY k - k % 5) AS canonical_uri FROM x
""")
def canonical_after_changes(spark, sf_dir):
    """Chains of three customers, of which one pair goes and one comes."""
    c = table(spark, sf_dir, "customer")
    pair = lambda a: c.where(f"c_custkey % 5 in ({a}, {a} + 1)").select(F.concat(F.lit("c_"), F.col("c_custkey")).alias("a"), F.concat(F.lit("c_"), F.col("c_custkey") + 1).alias("b"))
    before, after = saved(pair(0)), saved(pair(1))
    return equivalence.canonical_after(equivalence.canonical(before), before, after)


_SHARED = """
  x AS (SELECT 'cu_' || c_custkey AS s, 'type' AS p, 'Scholar' AS o, 'uri' AS o_kind, c_custkey AS k FROM customer UNION ALL SELECT 'cu_' || c_custkey, 'sourcedFrom', 'ds_shared', 'uri', c_custkey FROM customer
    UNION ALL SELECT 'cu_' || c_custkey, 'name', c_name, 'literal', c_custkey FROM customer UNION ALL SELECT 'cu_' || c_custkey, 'revenue', CAST(c_acctbal AS VARCHAR), 'literal', c_custkey FROM customer
    UNION ALL SELECT 'cu_' || c_custkey, 'description', c_mktsegment, 'literal', c_custkey FROM customer UNION ALL SELECT 'cu_' || c_custkey, 'affiliatedWith', 'n_' || c_nationkey, 'uri', c_custkey FROM customer
    UNION ALL SELECT 'n_' || c_nationkey, 'type', 'Institution', 'uri', c_custkey FROM customer),
  a AS (SELECT DISTINCT s, p, o, o_kind FROM x WHERE k % 2 = 0), b AS (SELECT DISTINCT s, p, o, o_kind FROM x WHERE k % 3 = 0)
"""


def _view(spark, sf_dir):
    """Two overlapping sources, the second one compacted, the first one stated twice."""
    c = rows(spark, sf_dir, "customer")
    part = lambda where: mapping.union([mapping.apply_mapping(c.where(where), m, "shared") for m in CUSTOMER])
    v = view.View(spark, f"{folder(spark)}/view-{uuid.uuid4().hex}", buckets=16)
    v.add("upload_b", part("c_custkey % 3 = 0"))
    v.compact()
    v.add("upload_a", part("c_custkey % 2 = 0"))
    v.add("upload_a", part("c_custkey % 2 = 0"))
    return v


@registered(f"WITH {_SHARED} SELECT s, p, o, o_kind, count(*) AS refs FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def view_references(spark, sf_dir):
    """How many sources state each triple; a batch that is run again counts once."""
    return _view(spark, sf_dir).references().select("s", "p", "o", "o_kind", "refs")


@registered(f"WITH {_SHARED} SELECT * FROM b")
def view_after_withdrawal(spark, sf_dir):
    v = _view(spark, sf_dir)
    v.compact()
    v.withdraw("upload_a")
    v.compact()
    return v.graph().select("s", "p", "o", "o_kind")


@registered(f"WITH {_SHARED}, c AS (SELECT DISTINCT s, p, o, o_kind FROM x WHERE k % 5 = 0) SELECT * FROM c UNION SELECT * FROM b")
def view_after_replacement(spark, sf_dir):
    """A source that states other triples than before, after its first ones were compacted."""
    v = _view(spark, sf_dir)
    v.compact()
    v.add("upload_a", mapping.union([mapping.apply_mapping(rows(spark, sf_dir, "customer").where("c_custkey % 5 = 0"), m, "shared") for m in CUSTOMER]))
    return v.graph().select("s", "p", "o", "o_kind")


@registered("""
  SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, true AS has_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET (SELECT CAST(count(*) // 2 AS BIGINT) FROM orders)
""")
def deep_page(spark, sf_dir):
    """A page from the middle of all orders by price, out of a stored listing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    index = pages.listed(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], block=5000)
    return index.page(40, index.total // 2)


def _order_bitmaps(spark, sf_dir):
    """Orders of each brand, by line number as source, as bitmaps over order keys."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("string").alias("line"))
    items = items.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return saved(bitmaps.bitmaps(items, ["p_brand"], "line", "l_orderkey"))


@registered("SELECT p_brand, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def distinct_by_bitmaps(spark, sf_dir):
    return bitmaps.distinct_counts(_order_bitmaps(spark, sf_dir), ["p_brand"])


@registered("SELECT p_brand, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber NOT IN (1, 2) GROUP BY p_brand")
def distinct_without_sources(spark, sf_dir):
    return bitmaps.distinct_counts(_order_bitmaps(spark, sf_dir), ["p_brand"], ["1", "2"])


@registered("""
  WITH x AS (SELECT p_brand, l_orderkey, bool_and(l_linenumber = 1) AS alone FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
  SELECT p_brand, count(*) AS n FROM x WHERE alone GROUP BY p_brand
""")
def distinct_that_vanish(spark, sf_dir):
    return bitmaps.vanishing_counts(_order_bitmaps(spark, sf_dir), ["p_brand"], "1")


@registered("""
  SELECT 'n_' || n_nationkey AS entity, n_name AS name, count(DISTINCT o_orderkey) AS n
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY n DESC, entity LIMIT 30
""")
def nation_rank_by_bitmaps(spark, sf_dir):
    """The ranking of institutions from bitmaps of their works' ids."""
    g = _encoded(spark, sf_dir, "nation", "customer", "orders", only=("type", "name", "authorOf", "affiliatedWith"))
    return terms.institution_ranking_by_bitmaps(g, terms.institution_bitmaps(g))
