"""Queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_bucket
from ..operators import biblio, equivalence, graph, lifecycle, mapping, mentions, quality, query, routing
from ..operators.components import components
from ..sources.tables import decode_nodes, encode_nodes, parse_ntriples, to_ntriples
from .config import EntityMapping, Property
from . import files, intake, merged, stored as stored_forms  # noqa: F401  they register their queries
from .register import QUERIES, SQL, Query, registered
from .scratch import saved
from .tables import CUSTOMER, NATION, rows, table, triples

def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def stored(t: DataFrame) -> DataFrame:
    """The triples as a table by predicate, so that a pattern reads its predicate's files only."""
    return saved(t, "p")


def mapping_id(prefix: str, value: str) -> str:
    return prefix + quote(value, safe="")


# ---- mapping

_CUSTOMER_SQL = """
  SELECT 'cu_' || c_custkey AS s, 'type' AS p, 'Scholar' AS o, 'uri' AS o_kind, CAST(NULL AS VARCHAR) AS o_datatype FROM customer
  UNION ALL SELECT 'cu_' || c_custkey, 'sourcedFrom', 'ds_customer', 'uri', NULL FROM customer
  UNION ALL SELECT 'cu_' || c_custkey, 'name', c_name, 'literal', NULL FROM customer
  UNION ALL SELECT 'cu_' || c_custkey, 'revenue', CAST(c_acctbal AS VARCHAR), 'literal', 'decimal' FROM customer
  UNION ALL SELECT 'cu_' || c_custkey, 'description', c_mktsegment, 'literal', NULL FROM customer
"""
_FIVE = ["s", "p", "o", "o_kind", "o_datatype"]


@registered(f"SELECT DISTINCT * FROM ({_CUSTOMER_SQL})")
def map_customer_triples(spark, sf_dir):
    return mapping.apply_mapping(rows(spark, sf_dir, "customer"), CUSTOMER[0], "customer").dropDuplicates().select(_FIVE)


@registered("""
  SELECT DISTINCT * FROM (
  SELECT 'seg_' || c_mktsegment AS s, 'type' AS p, 'Field' AS o, 'uri' AS o_kind FROM customer
  UNION ALL SELECT 'seg_' || c_mktsegment, 'name', c_mktsegment, 'literal' FROM customer
  UNION ALL SELECT 'cu_' || c_custkey, 'belongsToField', 'seg_' || c_mktsegment, 'uri' FROM customer)
""")
def map_segment_from_value(spark, sf_dir):
    return triples(spark, sf_dir, "segment").select("s", "p", "o", "o_kind")


@registered("""
  SELECT 'doc_' || doc_id AS s, 'type' AS p, 'Dataset' AS o FROM documents UNION SELECT 'doc_' || doc_id, 'sourcedFrom', 'ds_documents' FROM documents
  UNION SELECT 'doc_' || doc_id, 'name', CAST(doc_id AS VARCHAR) FROM documents
  UNION SELECT 'doc_' || doc_id, 'description', substr(text, 1, 1500) FROM documents WHERE trim(text) <> ''
""")
def document_entities(spark, sf_dir):
    return mapping.document_triples(table(spark, sf_dir, "documents"), "documents").dropDuplicates().select("s", "p", "o")


@registered("""
  SELECT 'customer' AS source_id, CAST(7 * count(*) AS BIGINT) AS emitted, CAST(6 * count(*) + count(DISTINCT c_nationkey) AS BIGINT) AS triples FROM customer
  UNION ALL SELECT 'nation', CAST(4 * count(*) AS BIGINT), CAST(4 * count(*) AS BIGINT) FROM nation
""")
def emitted_counts(spark, sf_dir):
    parts = [mapping.union([mapping.apply_mapping(rows(spark, sf_dir, p), m, p) for m in ms]).withColumn("source_id", F.lit(p)) for p, ms in (("customer", CUSTOMER), ("nation", NATION))]
    return mapping.emitted_counts(mapping.union(parts))


@registered("""
  SELECT 'cu_' || c_custkey AS s, 'name' AS p, c_name AS o, 'literal' AS o_kind FROM customer
  UNION SELECT 'cu_' || c_custkey, 'type', 'Scholar', 'uri' FROM customer UNION SELECT 'cu_' || c_custkey, 'sourcedFrom', 'ds_customer', 'uri' FROM customer
  UNION SELECT 'cu_' || c_custkey, 'revenue', CAST(c_acctbal AS VARCHAR), 'literal' FROM customer UNION SELECT 'cu_' || c_custkey, 'description', c_mktsegment, 'literal' FROM customer
  UNION SELECT 'cu_' || c_custkey, 'affiliatedWith', 'n_' || c_nationkey, 'uri' FROM customer UNION SELECT 'n_' || c_nationkey, 'type', 'Institution', 'uri' FROM customer
""")
def ntriples_round_trip(spark, sf_dir):
    """Export as lines and parse them again."""
    good, _ = parse_ntriples(to_ntriples(triples(spark, sf_dir, "customer")))
    return good.select("s", "p", "o", "o_kind").distinct()


@registered("""
  SELECT 'seg_' || c_mktsegment AS s, 'type' AS p, 'Field' AS o, 'uri' AS o_kind FROM customer UNION SELECT 'seg_' || c_mktsegment, 'name', c_mktsegment, 'literal' FROM customer
  UNION SELECT 'cu_' || c_custkey, 'belongsToField', 'seg_' || c_mktsegment, 'uri' FROM customer
""")
def snapshot_round_trip(spark, sf_dir):
    good, _ = decode_nodes(encode_nodes(triples(spark, sf_dir, "segment")))
    return good.select("s", "p", "o", "o_kind")


# ---- statistics and rankings


@registered("""
  WITH n AS (SELECT count(*) AS n FROM nation), c AS (SELECT count(*) AS n FROM customer), o AS (SELECT count(*) AS n FROM orders)
  SELECT CAST(4 * n.n + 6 * c.n + 5 * o.n AS BIGINT) AS triples, CAST(n.n + c.n + o.n AS BIGINT) AS entities FROM n, c, o
""")
def graph_stats(spark, sf_dir):
    return graph.stats(triples(spark, sf_dir, "nation", "customer", "orders"))


@registered("SELECT 'Institution' AS class, count(*) AS n FROM nation UNION ALL SELECT 'Scholar', count(*) FROM customer UNION ALL SELECT 'Field', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'Publication', count(*) FROM orders")
def class_histogram(spark, sf_dir):
    return graph.class_histogram(triples(spark, sf_dir, "nation", "customer", "segment", "orders"))


@registered("""
  SELECT 'n_' || n_nationkey AS entity, n_name AS name, count(DISTINCT o_orderkey) AS n
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY n DESC, entity LIMIT 30
""")
def nation_order_rank(spark, sf_dir):
    """Flagship: institutions by distinct publications of their scholars, those without any included."""
    return query.institution_ranking(stored(triples(spark, sf_dir, "nation", "customer", "orders", only=("type", "name", "authorOf", "affiliatedWith", "belongsToField"))))


@registered("""
  WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = (SELECT min(p_brand) FROM part))
  SELECT 'n_' || n_nationkey AS entity, n_name AS name, count(DISTINCT l_orderkey) AS n
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY ALL ORDER BY n DESC, entity LIMIT 10
""")
def nation_rank_in_field(spark, sf_dir):
    brand = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    t = stored(triples(spark, sf_dir, "nation", "customer", "orders", "brand", only=("type", "name", "authorOf", "affiliatedWith", "belongsToField")))
    return query.institution_ranking(t, 10, field=mapping_id("f_", brand))


@registered("SELECT 'cu_' || c_custkey AS entity, c_name AS name, count(DISTINCT o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY n DESC, entity LIMIT 30")
def customer_order_rank(spark, sf_dir):
    return query.scholar_ranking(stored(triples(spark, sf_dir, "customer", "orders", only=("type", "name", "authorOf", "affiliatedWith", "belongsToField"))))


@registered("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL")
def orders_per_year(spark, sf_dir):
    return query.year_distribution(triples(spark, sf_dir, "orders", only=("type", "year")))


@registered("""
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE contains(p_brand, '1') GROUP BY ALL
""")
def orders_per_year_in_field(spark, sf_dir):
    return query.year_distribution(stored(triples(spark, sf_dir, "orders", "brand", only=("type", "year", "name", "belongsToField"))), field="1")


@registered("""
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE c_nationkey = 3 AND p_brand = (SELECT min(p_brand) FROM part) GROUP BY ALL
""")
def orders_per_year_scoped(spark, sf_dir):
    """Publications of an institution and a field at once, by year."""
    brand = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    t = stored(triples(spark, sf_dir, "nation", "customer", "orders", "brand", only=("type", "year", "authorOf", "affiliatedWith", "belongsToField")))
    scopes = spark.createDataFrame([(1, "n_3"), (1, mapping_id("f_", brand))], "question int, entity string")
    return query.year_distribution(t, pubs=query.in_all_scopes(query.publications_for(t), scopes))


@registered("SELECT 'cu_' || c_custkey AS s, c_name AS name, c_acctbal AS value FROM customer ORDER BY value DESC, s LIMIT 20")
def top_acctbal(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "customer", only=("type", "name", "revenue")))
    return query.numeric_summary(t, query.no_merges(t), "Scholar", "revenue")


@registered("SELECT 'n_' || n_nationkey AS target, n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def count_by_relation(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "nation", "customer", only=("type", "name", "affiliatedWith")))
    return query.count_by_relation(t, query.no_merges(t), "Scholar", "affiliatedWith", "Institution")


@registered("SELECT p_brand AS name, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def papers_per_field(spark, sf_dir):
    return query.papers_per_field(stored(triples(spark, sf_dir, "brand", only=("name", "belongsToField"))))


# ---- search and detail


@registered("""
  WITH h AS (SELECT 'cu_' || c_custkey AS s, 'Scholar' AS class, c_name AS name, c_name AS label FROM customer WHERE contains(lower(c_name), '12'))
  SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY s LIMIT 10 OFFSET 5
""")
def find_customer(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "customer", only=("type", "name")))
    return query.find_entity(t, query.no_merges(t), "Scholar", "12", 10, 5).select("s", "class", "name", "label", "total")


@registered("""
  WITH h AS (SELECT 'cu_' || c_custkey AS s, 'Scholar' AS class, c_name AS name FROM customer WHERE contains(lower(c_name), 'n')
    UNION ALL SELECT 'n_' || n_nationkey, 'Institution', n_name FROM nation WHERE contains(lower(n_name), 'n'))
  SELECT *, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 20 AS has_more FROM h ORDER BY s LIMIT 20
""")
def search_cross_class_page(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "nation", "customer", only=("type", "name")))
    return query.search_cross_class(t, query.no_merges(t), "N").select("s", "class", "name", "total", "has_more")


@registered("""
  SELECT 'cu_' || c_custkey AS s, c_name AS name, (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM customer) AS raw_n FROM customer ORDER BY s LIMIT 5
""")
def explore_class(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "customer", only=("type", "name")))
    return query.explore_class(t, query.no_merges(t), "Scholar")


@registered("""
  WITH c AS (SELECT *, 'cu_' || c_custkey AS uri FROM customer)
  SELECT uri, 'property' AS kind, 'name' AS p, c_name AS value, CAST(NULL AS VARCHAR) AS target FROM c UNION ALL SELECT uri, 'property', 'revenue', CAST(c_acctbal AS VARCHAR), NULL FROM c
  UNION ALL SELECT uri, 'property', 'description', c_mktsegment, NULL FROM c UNION ALL SELECT uri, 'relation', 'type', 'Scholar', 'Scholar' FROM c
  UNION ALL SELECT uri, 'relation', 'sourcedFrom', 'ds_customer', 'ds_customer' FROM c UNION ALL SELECT uri, 'relation', 'affiliatedWith', n_name, 'n_' || n_nationkey FROM c JOIN nation ON c_nationkey = n_nationkey
""")
def entity_detail(spark, sf_dir):
    """Detail of many entities in one job."""
    t = stored(triples(spark, sf_dir, "nation", "customer"))
    ids = table(spark, sf_dir, "customer").select(F.concat(F.lit("cu_"), "c_custkey").alias("uri"))
    return query.entity_detail(t, query.no_merges(t), ids)


@registered("""
  SELECT 'cu_' || c_custkey AS uri, 'property' AS kind, 'name' AS p, c_name AS value, CAST(NULL AS VARCHAR) AS target FROM customer UNION ALL SELECT 'cu_' || c_custkey, 'property', 'revenue', CAST(c_acctbal AS VARCHAR), NULL FROM customer
  UNION ALL SELECT 'cu_' || c_custkey, 'property', 'description', c_mktsegment, NULL FROM customer UNION ALL SELECT 'cu_' || c_custkey, 'relation', 'type', 'Scholar', 'Scholar' FROM customer
  UNION ALL SELECT 'cu_' || c_custkey, 'relation', 'sourcedFrom', 'ds_customer', 'ds_customer' FROM customer
  UNION ALL SELECT 'cu_' || c_custkey, 'relation', 'affiliatedWith', n_name, 'n_' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'n_' || n_nationkey, 'property', 'name', n_name, NULL FROM nation UNION ALL SELECT 'n_' || n_nationkey, 'property', 'level', CAST(n_regionkey AS VARCHAR), NULL FROM nation
  UNION ALL SELECT 'n_' || n_nationkey, 'relation', 'type', 'Institution', 'Institution' FROM nation UNION ALL SELECT 'n_' || n_nationkey, 'relation', 'sourcedFrom', 'ds_nation', 'ds_nation' FROM nation
""")
def entity_detail_all(spark, sf_dir):
    """Detail of all typed entities in one job."""
    t = stored(triples(spark, sf_dir, "nation", "customer"))
    return query.entity_detail(t, query.no_merges(t), graph.types(t).select(F.col("s").alias("uri")))


@registered("""
  SELECT 'cu_' || c_custkey AS uri, 'name' AS label, c_name AS value FROM customer UNION ALL SELECT 'cu_' || c_custkey, 'revenue', CAST(c_acctbal AS VARCHAR) FROM customer
  UNION ALL SELECT 'cu_' || c_custkey, 'description', c_mktsegment FROM customer
""")
def properties_of(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "customer"))
    return query.properties_of(t, query.no_merges(t), graph.types(t).where("class = 'Scholar'").select(F.col("s").alias("uri")))


@registered("""
  SELECT 'cu_' || c_custkey AS uri, 'affiliatedWith' AS p, 'n_' || n_nationkey AS target, n_name AS name, 'Institution' AS class FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def related_to(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "nation", "customer", only=("type", "name", "affiliatedWith")))
    return query.related_to(t, graph.types(t).select(F.col("s").alias("uri")))


@registered("SELECT 'n_' || c_nationkey AS target, 'cu_' || c_custkey AS s FROM customer")
def reverse_related(spark, sf_dir):
    t = triples(spark, sf_dir, "customer", only=("affiliatedWith",))
    return query.reverse_related(t, query.no_merges(t), "affiliatedWith")


@registered("SELECT 'cu_' || o_custkey AS uri, 'authorOf' AS p, count(*) AS n FROM orders GROUP BY o_custkey")
def relations_grouped(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "orders"))
    ids = graph.of(t, "authorOf").select(F.col("s").alias("uri")).distinct()
    return query.relations_grouped(t, query.no_merges(t), ids).select("uri", "p", "n")


@registered("""
  SELECT 'su_' || s_suppkey AS s, s_name AS s_name, 'ind_' || n_name AS o, n_name AS o_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def query_relation(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "supplier", only=("type", "name", "belongsToIndustry")))
    return query.query_relation(t, query.no_merges(t), "Company", "belongsToIndustry", "Industry")


@registered("""
  SELECT 'su_' || s_suppkey AS s, s_name AS name, s_acctbal AS revenue, CAST(NULL AS DOUBLE) AS employees, count(*) OVER () AS total, count(*) OVER () > 20 AS has_more FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE contains(lower(n_name), 'nation_1') ORDER BY revenue DESC, s LIMIT 20
""")
def companies_in_industry(spark, sf_dir):
    return query.companies_in_industry(stored(triples(spark, sf_dir, "supplier", only=("type", "name", "revenue", "employees", "belongsToIndustry"))), "nation_1")


@registered("""
  WITH m AS (SELECT 'su_' || s_suppkey AS s, s_name AS name, s_acctbal AS revenue FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3')
  SELECT s, name, round(revenue, 2) AS revenue, (SELECT count(*) FROM m) AS n, (SELECT count(*) FROM m) AS raw_n FROM m
""")
def industry_members(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "supplier", only=("name", "revenue", "employees", "belongsToIndustry")))
    return query.industry_members(t, query.no_merges(t), "ind_NATION_3").select("s", "name", "revenue", "n", "raw_n")


@registered("SELECT 'cu_' || c_custkey AS s, c_name AS name, count(*) OVER () AS total, count(*) OVER () > 15 AS has_more FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_2') ORDER BY s LIMIT 15")
def scholars_query(spark, sf_dir):
    return query.scholars_query(stored(triples(spark, sf_dir, "nation", "customer", only=("type", "name", "affiliatedWith"))), institution="nation_2")


# ---- patterns


@registered("""
  SELECT 'cu_' || c_custkey AS c, 'n_' || n_nationkey AS n, n_name AS place, c_name AS name, 'o_' || o_orderkey AS work FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN orders ON o_custkey = c_custkey WHERE contains(lower(n_name), 'nation_1')
""")
def pattern_bgp_optional(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "nation", "customer", "orders", only=("name", "affiliatedWith", "authorOf")))
    return graph.match(t, [("?c", "affiliatedWith", "?n"), ("?n", "name", "?place"), ("?c", "name", "?name")], [[("?c", "authorOf", "?work")]], where=F.contains(F.lower("place"), F.lit("nation_1")))


@registered("SELECT count(*) > 0 AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_5'")
def pattern_ask(spark, sf_dir):
    return graph.ask(triples(spark, sf_dir, "nation", "customer", only=("name", "affiliatedWith")), [("?c", "affiliatedWith", "?n"), ("?n", "name", "NATION_5")])


@registered("SELECT 'n_' || c_nationkey AS s, 'hasOrder' AS p, 'o_' || o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey")
def pattern_construct(spark, sf_dir):
    found = graph.match(stored(triples(spark, sf_dir, "customer", "orders", only=("affiliatedWith", "authorOf"))), [("?c", "affiliatedWith", "?n"), ("?c", "authorOf", "?w")])
    return graph.construct(found, [("?n", "hasOrder", "?w")]).select("s", "p", "o")


@registered("""
  WITH x AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), q AS (SELECT DISTINCT a.p AS a, b.p AS b FROM x a JOIN x b ON a.o = b.o AND a.p < b.p)
  SELECT a, b FROM q UNION ALL SELECT b, a FROM q
""")
def part_pairs_in_order(spark, sf_dir):
    """Co-occurrence edges: parts of one order."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("s"), F.lit("authorOf").alias("p"), F.col("l_orderkey").alias("o"))
    return query.coauthor_edges(edges)


@registered("SELECT 'o_' || o_orderkey AS s, 'authoredBy' AS p, 'cu_' || o_custkey AS o FROM orders")
def inverse_edges(spark, sf_dir):
    return query.inverse_edges(triples(spark, sf_dir, "orders", only=("authorOf",)), "authorOf", "authoredBy").select("s", "p", "o")


# ---- quality


@registered("SELECT 'o_' || o_orderkey AS focus, 'Publication' AS class, 'belongsToField' AS path, CAST(0 AS BIGINT) AS found FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_items(spark, sf_dir):
    t = stored(triples(spark, sf_dir, "orders", "brand"))
    return quality.violations(t, (("Publication", "name", 1), ("Publication", "year", 1), ("Publication", "belongsToField", 1))).select("focus", "class", "path", "found")


# ---- equivalence

_SLICES_SQL = """
  WITH f AS (SELECT c_custkey AS k, c_name AS a, c_mktsegment AS b, c_acctbal AS c, c_nationkey AS d FROM customer), one AS (SELECT * FROM f WHERE k % 3 <> 0), two AS (SELECT * FROM f WHERE k % 3 <> 1),
  p AS (SELECT 'c_' || min(one.k) AS a, 'c2_' || min(two.k) AS b FROM one JOIN two USING (a, b, c, d) GROUP BY a, b, c, d HAVING count(DISTINCT one.k) = 1 AND count(DISTINCT two.k) = 1)
"""


def _slices(spark, sf_dir):
    """Two overlapping slices of the customers as two sources of companies."""
    c = table(spark, sf_dir, "customer")  # with negative balances, which a fingerprint refuses
    props = (Property("c_mktsegment", "region"), Property("c_acctbal", "revenue", "decimal"), Property("c_nationkey", "employees", "integer"))
    return saved(mapping.union([
        mapping.entity_triples(c.where("c_custkey % 3 <> 0"), EntityMapping("Company", "c_custkey", "c_{id}", "c_name", props), "one"),
        mapping.entity_triples(c.where("c_custkey % 3 <> 1"), EntityMapping("Company", "c_custkey", "c2_{id}", "c_name", props), "two"),
    ]).dropDuplicates())


@registered(_SLICES_SQL.replace("FROM customer", "FROM customer WHERE c_acctbal >= 0") + "SELECT a, b FROM p")
def equivalence_pairs(spark, sf_dir):
    t = _slices(spark, sf_dir)
    return equivalence.inferred_pairs(equivalence.fingerprints(t), t, ("ds_one", "c_"), ("ds_two", "c2_"))


@registered(_SLICES_SQL.replace("FROM customer", "FROM customer WHERE c_acctbal >= 0") + "SELECT a AS uri, least(a, b) AS canonical_uri FROM p UNION ALL SELECT b, least(a, b) FROM p")
def canonical_components(spark, sf_dir):
    t = _slices(spark, sf_dir)
    return equivalence.canonical(equivalence.inferred_pairs(equivalence.fingerprints(t), t, ("ds_one", "c_"), ("ds_two", "c2_")))


@registered("""
  WITH g AS (SELECT text, min(doc_id) AS root, count(*) AS n FROM documents GROUP BY text)
  SELECT doc_id AS node, root FROM documents JOIN g USING (text) WHERE n > 1
""")
def repeated_text_components(spark, sf_dir):
    """Components of a chain of equal texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    least = d.groupBy("h").agg(F.min("doc_id").alias("b"))
    return components(d.join(least, "h").select(F.col("doc_id").alias("a"), "b"))


# ---- mentions and routing


@registered("""
  WITH t AS (SELECT c_custkey AS text_id, 'of ' || n_name || ' and ' || c_name || '.' AS text, n_name, n_nationkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
  SELECT text_id, 'n_' || n_nationkey AS s, lower(n_name) AS label FROM t UNION ALL SELECT text_id, 'cu_' || text_id, lower(c_name) FROM t
""")
def mentions_longest(spark, sf_dir):
    """NATION_1 stands inside NATION_12: the longest name wins."""
    t = stored(triples(spark, sf_dir, "nation", "customer", only=("type", "name")))
    texts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select(F.col("c_custkey").alias("text_id"), F.format_string("of %s and %s.", "n_name", "c_name").alias("text"))
    return mentions.mentions(texts, t)


@registered("""
  SELECT DISTINCT doc_id AS text_id, 'b_' || item_id AS s FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))
""")
def benchmark_mentions(spark, sf_dir):
    """Items whose whole text stands in a document, as dictionary labels."""
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b_"), "item_id").alias("s"), F.lower("text").alias("key"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return mentions.candidate_spans(d, b).select("text_id", "key").distinct().hint("merge").join(b, "key").select("text_id", "s").distinct()


@registered(None)
def route_conversations(spark, sf_dir):
    """Intents of all turns, with the customers and nations that they mention."""
    t = stored(triples(spark, sf_dir, "nation", "customer", only=("type", "name")))
    texts = table(spark, sf_dir, "conversations").select(F.format_string("%d/%d", "conv_id", "turn").alias("text_id"), "text")
    found = mentions.canonical_mentions(mentions.mentions(texts, t), t, query.no_merges(t)).join(graph.least_class(t), "s")
    return routing.route(texts, saved(found)).select("text_id", "intent", "metric", "keyword")


# ---- lifecycle


@registered("""
  WITH r AS (SELECT c_custkey AS nr, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'auto' || (c_custkey + 7 - c_custkey % 7) ELSE c_mktsegment || c_nationkey END AS k FROM customer),
  x AS (SELECT nr, k, k = '' OR row_number() OVER (PARTITION BY k ORDER BY nr) > 1 AS again FROM r)
  SELECT nr, CASE WHEN again THEN 'auto' || nr || CASE WHEN 'auto' || nr IN (SELECT k FROM r) THEN '_' ELSE '' END ELSE k END AS k FROM x
""")
def make_unique_keys(spark, sf_dir):
    k = F.when(F.expr("c_custkey % 7 = 0"), "").when(F.expr("c_custkey % 11 = 0"), F.concat(F.lit("auto"), F.expr("c_custkey + 7 - c_custkey % 7"))).otherwise(F.concat("c_mktsegment", "c_nationkey"))
    return lifecycle.unique_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("nr"), k.alias("k")), "k", "nr").select("nr", "k")


@registered("""
  WITH r AS (SELECT n_regionkey AS sheet_idx, c_custkey AS row_idx, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
  SELECT sheet_idx, row_idx, c_name FROM (SELECT *, row_number() OVER (ORDER BY sheet_idx, row_idx) AS nr FROM r) WHERE nr <= 5000
""")
def row_quota(spark, sf_dir):
    r = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("sheet_idx")), "c_nationkey")
    return lifecycle.within_quota(r.select("sheet_idx", F.col("c_custkey").alias("row_idx"), "c_name"))


_TWO_SOURCES = "WITH a AS (SELECT * FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT * FROM customer WHERE c_custkey % 3 = 0)"


def _contributions(spark, sf_dir):
    c = rows(spark, sf_dir, "customer")
    part = lambda where, sid, owner: lifecycle.contribute(mapping.union([mapping.apply_mapping(c.where(where), m, "shared") for m in CUSTOMER]), sid, owner, "p_" + sid)
    return saved(part("c_custkey % 2 = 0", "upload_a", "alice").unionByName(part("c_custkey % 3 = 0", "upload_b", None)))


@registered(f"""
  {_TWO_SOURCES}, gone AS (SELECT * FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b))
  SELECT 'cu_' || c_custkey AS s, 'name' AS p, c_name AS o FROM gone UNION ALL SELECT 'cu_' || c_custkey, 'affiliatedWith', 'n_' || c_nationkey FROM gone
""")
def withdraw_source(spark, sf_dir):
    """What vanishes when one of two overlapping sources is withdrawn."""
    return lifecycle.withdrawn_triples(_contributions(spark, sf_dir), "upload_a").where("p in ('name', 'affiliatedWith')").select("s", "p", "o")


@registered("SELECT 'cu_' || c_custkey AS s, c_name AS o FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def visible_to_owner(spark, sf_dir):
    return lifecycle.visible_to(_contributions(spark, sf_dir), "alice").where("p = 'name'").select("s", "o")


@registered(f"{_TWO_SOURCES} SELECT 'p_upload_a' AS partition_id, CAST(6 * count(*) + count(DISTINCT c_nationkey) AS BIGINT) AS triples FROM a")
def list_partitions(spark, sf_dir):
    return lifecycle.list_partitions(_contributions(spark, sf_dir), "alice")


@registered("SELECT c_custkey, CAST(('0x' || substr(sha256(CAST(c_name AS VARCHAR)), 1, 10)) AS BIGINT) % 100000 AS bucket FROM customer")
def stable_buckets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", stable_bucket(F.col("c_name"), 100_000).alias("bucket"))


@registered("""
  SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 1 ELSE 0 END AS admitted FROM events
""")
def daily_quota(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return query.daily_quota(log, {"click": 2, "view": 3, "purchase": 1}, "user_id", "event_type", "ts", "event_id").select("event_id", "admitted")


# ---- nested records


def _works(spark, sf_dir):
    """Orders as nested records: suppliers of their items are authors, suppliers' nations institutions, part brands topics."""
    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"), "l_suppkey")
    place = F.array(F.struct(F.concat(F.lit("https://x/n"), "s_nationkey").alias("id"), F.concat(F.lit("N"), "s_nationkey").alias("display_name"), F.lit("XX").alias("country_code")))
    author = F.struct(F.lit("middle").alias("author_position"), F.struct(F.concat(F.lit("https://x/s"), "l_suppkey").alias("id"), F.col("s_name").alias("display_name"), F.lit(None).cast("string").alias("orcid")).alias("author"), place.alias("institutions"))
    nested = items.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", author.alias("a")))), lambda x: x["a"]).alias("authorships"))
    o = t("orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    venue = F.struct(F.struct(F.concat(F.lit("https://x/v"), "o_orderpriority").alias("id"), F.col("o_orderpriority").alias("display_name"), F.lit("journal").alias("type")).alias("source"))
    return o.select(
        F.expr("cast(o_custkey % 5 as int)").alias("topic_idx"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("topic"), F.concat(F.lit("https://x/w"), "o_orderkey").alias("id"), F.lit(None).cast("string").alias("doi"),
        F.concat(F.lit("t"), "o_orderkey").alias("title"), F.lit("").alias("display_name"), F.year("o_orderdate").alias("publication_year"), F.col("o_custkey").alias("cited_by_count"), F.lit("article").alias("type"), venue.alias("primary_location"), "authorships",
    )


@registered("SELECT 'w' || o_orderkey AS openalex_id, 't' || o_orderkey AS title, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS cited_by_count, 'v' || o_orderpriority AS venue_id FROM orders")
def biblio_publications(spark, sf_dir):
    return biblio.publications(_works(spark, sf_dir)).select("openalex_id", "title", "year", "cited_by_count", "venue_id")


@registered("SELECT 's' || l_suppkey AS scholar_id, 'w' || l_orderkey AS pub_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey")
def biblio_author_of(spark, sf_dir):
    return biblio.author_of(_works(spark, sf_dir)).select("scholar_id", "pub_id")


@registered("SELECT DISTINCT 's' || l_suppkey AS scholar_id, 'n' || s_nationkey AS inst_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey")
def biblio_affiliation(spark, sf_dir):
    return biblio.affiliation(_works(spark, sf_dir))


@registered("SELECT DISTINCT 's' || l_suppkey AS openalex_id, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey")
def biblio_scholars(spark, sf_dir):
    return biblio.scholars(_works(spark, sf_dir)).select("openalex_id", "name")


@registered("SELECT DISTINCT 'v' || o_orderpriority AS openalex_id, o_orderpriority AS name, 'journal' AS type FROM orders")
def biblio_venues(spark, sf_dir):
    return biblio.venues(_works(spark, sf_dir))


@registered("SELECT 'w' || o_orderkey AS pub_id, 'f' || o_orderstatus AS field_id FROM orders WHERE o_orderstatus IN ('O', 'F')")
def biblio_belongs_to_field(spark, sf_dir):
    fields = biblio.field_dimension(spark, [("fO", "open", "O", 0), ("fF", "finished", "F", 0)])
    return biblio.belongs_to_field(_works(spark, sf_dir), fields)


@registered("""
  WITH a AS (SELECT l_orderkey, l_suppkey, s_nationkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS nr FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
  SELECT 'V2w' || o_orderkey AS work_id, CAST(least(count(l_suppkey), 10) AS INTEGER) AS n_authors, CAST(least(count(DISTINCT CASE WHEN nr <= 10 THEN s_nationkey END), 5) AS INTEGER) AS n_institutions, any_value(o_orderstatus) AS domain
  FROM orders LEFT JOIN a ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def biblio_reshaped(spark, sf_dir):
    return biblio.reshaped(_works(spark, sf_dir), key_prefix="V2").select("work_id", F.size("authors").alias("n_authors"), F.size("institutions").alias("n_institutions"), F.array_join("domain", ",").alias("domain"))
