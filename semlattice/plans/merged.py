"""Queries over a graph with merged entities: customers as companies of two overlapping sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import equivalence, graph, mapping, query
from .config import EntityMapping, Property, RelationMapping
from .register import registered
from .scratch import distinct_spread, saved
from .tables import per_row, size, table
from .tables import rows as rows_of

_OWL = "http://www.w3.org/2002/07/owl#sameAs"

#: m: every company under its own id (raw) and its canonical one (s).
_M = """
  WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS seg, c_acctbal AS bal, c_nationkey AS nat FROM customer),
  r AS (SELECT 'c_' || k AS raw, 'one' AS src, * FROM c WHERE k % 3 <> 0 UNION ALL SELECT 'c2_' || k, 'two', * FROM c WHERE k % 3 <> 1),
  p AS (
    SELECT min(CASE WHEN src = 'one' THEN raw END) AS a, min(CASE WHEN src = 'two' THEN raw END) AS b FROM r WHERE bal >= 0 GROUP BY n, seg, bal, nat
    HAVING count(CASE WHEN src = 'one' THEN 1 END) = 1 AND count(CASE WHEN src = 'two' THEN 1 END) = 1
  ),
  canon AS (SELECT a AS raw, least(a, b) AS s FROM p UNION ALL SELECT b, least(a, b) FROM p),
  m AS (SELECT r.*, coalesce(canon.s, r.raw) AS s FROM r LEFT JOIN canon USING (raw)),
  f AS (
    SELECT s, 'property' AS kind, 'name' AS p, n AS value, CAST(NULL AS VARCHAR) AS target FROM m UNION SELECT s, 'property', 'region', seg, NULL FROM m
    UNION SELECT s, 'property', 'revenue', CAST(bal AS VARCHAR), NULL FROM m UNION SELECT s, 'property', 'employees', CAST(nat AS VARCHAR), NULL FROM m
    UNION SELECT s, 'property', 'description', src || ' ' || seg, NULL FROM m
    UNION SELECT s, 'relation', 'type', 'Company', 'Company' FROM m UNION SELECT s, 'relation', 'sourcedFrom', 'ds_' || src, 'ds_' || src FROM m
    UNION SELECT s, 'relation', 'belongsToIndustry', seg, 'ind_' || seg FROM m
  )
"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping slices of the customers as two sources of companies, in industries; descriptions differ by source."""
    props = (Property("c_mktsegment", "region"), Property("c_acctbal", "revenue", "decimal"), Property("c_nationkey", "employees", "integer"), Property("about", "description"))
    parts, n, customers = [], 0, size(spark, sf_dir, "customer")
    for source, prefix, left_out in (("one", "c_", 0), ("two", "c2_", 1)):
        rows = rows_of(spark, sf_dir, "customer", customers).where(f"c_custkey % 3 <> {left_out}").withColumn("about", F.concat(F.lit(source + " "), "c_mktsegment"))
        mappings = (
            EntityMapping("Company", "c_custkey", prefix + "{id}", "c_name", props),
            RelationMapping("belongsToIndustry", "Company", "c_custkey", prefix + "{id}", "Industry", "c_mktsegment", "ind_{id}", from_value=True),
        )
        parts += [mapping.apply_mapping(rows, m, source) for m in mappings]
        n += customers * sum(map(per_row, mappings))
    return saved(distinct_spread(mapping.union(parts), n), "p")


def pairs_of(t: DataFrame) -> DataFrame:
    return equivalence.inferred_pairs(equivalence.fingerprints(t), t, ("ds_one", "c_"), ("ds_two", "c2_"))


def merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph, and the canonical ids of its merged companies."""
    t = companies(spark, sf_dir)
    return t, saved(equivalence.canonical(pairs_of(t)))


def _ids(t: DataFrame) -> DataFrame:
    return graph.types(t).where("class = 'Company'").select(F.col("s").alias("uri")).distinct()


@registered(_M + """
  , h AS (SELECT s, 'Company' AS class, min(n) AS name, min(n) AS label FROM m WHERE contains(lower(n), '1') GROUP BY s)
  SELECT *, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 15 AS has_more FROM h ORDER BY s LIMIT 10 OFFSET 5
""")
def merged_find_entity(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.find_entity(t, canonical, "Company", "1", 10, 5).select("s", "class", "name", "label", "total", "has_more")


@registered(_M + "SELECT s, 'Company' AS class, min(n) AS name, '' AS cn_names, min(n) AS label FROM m WHERE contains(lower(n), '7') GROUP BY s")
def merged_search_entities(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.search(t, canonical, "7", "Company")


@registered(_M + ", h AS (SELECT DISTINCT s FROM m WHERE contains(lower(n), 'nobody')) SELECT count(*) AS total, count(*) = 0 AS has_hint FROM h")
def search_zero_hits(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.zero_hit_hint(query.search(t, canonical, "nobody"), "nobody").select("total", F.col("hint").isNotNull().alias("has_hint"))


@registered(_M + "SELECT s, min(n) AS name, (SELECT count(DISTINCT s) FROM m) AS n, (SELECT count(*) FROM m) AS raw_n FROM m GROUP BY s ORDER BY s LIMIT 5")
def merged_explore_class(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.explore_class(t, canonical, "Company")


@registered(_M + "SELECT s, min(n) AS name, (SELECT count(DISTINCT s) FROM m) AS n, (SELECT count(*) FROM m) AS raw_n FROM m GROUP BY s ORDER BY s LIMIT 50")
def merged_entities_of_class(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.entities_of_class(t, canonical, "Company")


@registered(_M + "SELECT 'Company' AS class, count(DISTINCT s) AS n, count(*) AS raw_n FROM m UNION ALL SELECT 'Industry', count(DISTINCT seg), count(DISTINCT seg) FROM m")
def merged_list_ontology(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return graph.list_ontology(t, canonical)


@registered(_M + "SELECT DISTINCT s, n AS s_name, 'ind_' || seg AS o, seg AS o_name FROM m")
def merged_query_relation(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.query_relation(t, canonical, "Company", "belongsToIndustry", "Industry")


@registered(_M + """
  , q AS (SELECT DISTINCT s, n AS s_name, 'ind_' || seg AS o, seg AS o_name FROM m)
  SELECT *, (SELECT count(*) FROM q) AS total, (SELECT count(*) FROM q) > 20 AS has_more FROM q ORDER BY s, o LIMIT 20
""")
def merged_relation_page(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.relation_page(t, canonical, "Company", "belongsToIndustry", "Industry")


@registered(_M + "SELECT 'ind_' || seg AS target, seg AS name, count(DISTINCT s) AS n FROM m GROUP BY seg")
def merged_count_by_relation(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.count_by_relation(t, canonical, "Company", "belongsToIndustry", "Industry")


@registered(_M + "SELECT DISTINCT 'ind_' || seg AS target, s FROM m")
def merged_reverse_related(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.reverse_related(t, canonical, "belongsToIndustry")


@registered(_M + """
  , i AS (SELECT * FROM m WHERE seg = 'BUILDING')
  SELECT s, min(n) AS name, round(min(bal), 2) AS revenue, CAST(min(nat) AS BIGINT) AS employees, (SELECT count(DISTINCT s) FROM i) AS n, (SELECT count(*) FROM i) AS raw_n FROM i GROUP BY s
""")
def merged_industry_members(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.industry_members(t, canonical, "ind_BUILDING")


@registered(_M + "SELECT m.raw AS uri, f.kind, f.p, f.value, f.target FROM m JOIN f USING (s)")
def merged_entity_detail(spark, sf_dir):
    """Every company's facts over all its aliases."""
    t, canonical = merged(spark, sf_dir)
    return query.entity_detail(t, canonical, _ids(t))


@registered(_M + """
  , l AS (SELECT * FROM (VALUES ('name', 'name'), ('region', 'region'), ('revenue', 'revenue'), ('employees', 'employees'), ('description', 'description')) v(p, label))
  SELECT m.raw AS uri, l.label, string_agg(f.value, ' / ' ORDER BY f.value) AS value FROM m JOIN f USING (s) JOIN l ON l.p = f.p GROUP BY ALL
""")
def merged_properties_of(spark, sf_dir):
    """Merged companies have a description of each source, so several values are joined."""
    t, canonical = merged(spark, sf_dir)
    return query.properties_of(t, canonical, _ids(t))


@registered(_M + "SELECT m.raw AS uri, f.p, string_agg(f.value, ',' ORDER BY f.value) AS names, count(*) AS n FROM m JOIN f USING (s) WHERE f.kind = 'relation' GROUP BY ALL")
def merged_relations_grouped(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.relations_grouped(t, canonical, _ids(t)).select("uri", "p", F.array_join("names", ",").alias("names"), "n")


@registered(_M + "SELECT s, p, coalesce(target, value) AS o FROM f UNION ALL SELECT 'ind_' || seg, 'type', 'Industry' FROM (SELECT DISTINCT seg FROM m) UNION ALL SELECT 'ind_' || seg, 'name', seg FROM (SELECT DISTINCT seg FROM m)")
def merged_predicate_objects(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return graph.predicate_objects(t, canonical).select("s", "p", "o")


@registered(_M + "SELECT a.raw AS uri, b.raw AS alias FROM m a JOIN m b USING (s)")
def merged_aliases(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return graph.aliases(_ids(t), canonical)


@registered(_M + "SELECT raw AS uri, s AS canonical_uri FROM m")
def merged_representative(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return graph.representative(_ids(t), canonical)


@registered(_M + "SELECT s, min(n) AS name, max(bal) AS value FROM m GROUP BY s ORDER BY value DESC, s LIMIT 20")
def merged_numeric_summary(spark, sf_dir):
    t, canonical = merged(spark, sf_dir)
    return query.numeric_summary(t, canonical, "Company", "revenue")


@registered(_M + "SELECT s, 'Company' AS class, min(n) AS name, count(*) OVER () AS total, count(*) OVER () > 30 AS has_more FROM m WHERE seg = 'FURNITURE' GROUP BY s ORDER BY s, class LIMIT 30")
def merged_field_members(spark, sf_dir):
    """Segments as fields: members of one, of the asked class."""
    t, canonical = merged(spark, sf_dir)
    fields = mapping.union([t, t.where("p = 'belongsToIndustry'").withColumn("p", F.lit("belongsToField"))])
    return query.field_members(fields, canonical, "ind_FURNITURE", ("Company",))


def _stated(t: DataFrame, pairs: DataFrame, predicate: str) -> DataFrame:
    """Statements that pairs (a, b) are the same."""
    text = F.lit(None).cast("string")
    return pairs.select(F.col("a").alias("s"), F.lit(predicate).alias("p"), F.col("b").alias("o"), F.lit("uri").alias("o_kind"), text.alias("o_datatype"), text.alias("o_lang"))


@registered(_M + "SELECT a AS s, 'sameAs' AS p, b AS o FROM p WHERE CAST(substr(a, 3) AS BIGINT) % 2 = 1")
def new_same_as_links(spark, sf_dir):
    """Pairs with even keys are stated already, the other way round."""
    t = companies(spark, sf_dir)
    pairs = saved(pairs_of(t))
    known = _stated(t, pairs.where("cast(substr(a, 3) as bigint) % 2 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")), "sameAs")
    return equivalence.new_links(t.unionByName(known), pairs).select("s", "p", "o")


@registered(_M + "SELECT 0 AS links FROM m LIMIT 1")
def same_as_links_again(spark, sf_dir):
    """Adding the links a second time adds none."""
    t = companies(spark, sf_dir)
    pairs = saved(pairs_of(t))
    again = equivalence.new_links(t.unionByName(saved(equivalence.new_links(t, pairs))), pairs)
    return again.agg(F.count("*").cast("int").alias("links"))


@registered(_M + "SELECT DISTINCT 'c_' || k AS a, 'c2_' || k AS b FROM m WHERE k % 3 = 2")
def explicit_same_as_pairs(spark, sf_dir):
    """Statements of both vocabularies between companies; those with an industry at one end are none."""
    t = companies(spark, sf_dir)
    both = table(spark, sf_dir, "customer").where("c_custkey % 3 = 2").select(F.concat(F.lit("c_"), "c_custkey").alias("a"), F.concat(F.lit("c2_"), "c_custkey").alias("b"), F.concat(F.lit("ind_"), "c_mktsegment").alias("ind"), "c_custkey")
    said = [_stated(t, both.where("c_custkey % 2 = 0"), "sameAs"), _stated(t, both.where("c_custkey % 2 = 1"), _OWL), _stated(t, both.select("a", F.col("ind").alias("b")), "sameAs")]
    return equivalence.explicit_pairs(mapping.union([t, *said]))
