"""Queries over files in their several forms, over checks of mappings and uploads, and over counted answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, lifecycle, mapping, mentions, query, routing
from ..operators.upload import upload_tables
from ..sources import tables as sources
from ..sources import turtle
from .config import EntityMapping, Ontology, Property
from .register import registered
from .scratch import folder, saved
from .tables import rows, table, triples


def _path(spark, name: str) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}.{name}"


@registered("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_arrays(spark, sf_dir):
    """Files that hold an array of objects each."""
    path = _path(spark, "json")
    c = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 40).alias("file")).agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))).alias("value"))
    c.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return sources.read(spark, path, schema="c_custkey bigint, c_name string, c_acctbal double")


@registered("SELECT text || chr(10) AS text, count(*) AS n FROM benchmark GROUP BY text")
def text_files(spark, sf_dir):
    """Files that are read as one text each."""
    path = _path(spark, "txt")
    table(spark, sf_dir, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(path)
    return sources.read(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@registered("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_of_orders(spark, sf_dir):
    return sources.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey"))


@registered("SELECT event_id, event_type FROM events")
def table_sink(spark, sf_dir):
    """A table by folders, written twice over."""
    path = _path(spark, "parquet")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    sources.write_table(e.limit(10), path, "event_type")
    sources.write_table(e, path, "event_type")
    return sources.read(spark, path).select("event_id", "event_type")


_BAD = "CASE WHEN c_custkey % 9 = 0 THEN 'x' || c_custkey || ',' || c_name || ',1' WHEN c_custkey % 9 = 1 THEN c_custkey || ',' || c_name WHEN c_custkey % 9 = 2 THEN c_custkey || ',' || c_name || ',1,2' END"


def _csv_lines(spark, sf_dir):
    """Customers as CSV, with a key that is no number, a value too few and one too many."""
    path = _path(spark, "csv")
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 9
    good = F.concat_ws(",", "c_custkey", "c_name", "c_nationkey")
    line = F.when(k == 0, F.concat(F.lit("x"), "c_custkey", F.lit(","), "c_name", F.lit(",1"))).when(k == 1, F.concat_ws(",", "c_custkey", "c_name")).when(k == 2, F.concat(F.concat_ws(",", "c_custkey", "c_name"), F.lit(",1,2"))).otherwise(good)
    c.select(line.alias("key,name,nation")).write.option("header", True).option("quote", "").option("sep", "\t").csv(path)
    return sources.read_checked(spark, path, "csv", "key bigint, name string, nation int")


@registered("SELECT c_custkey AS key, c_name AS name, CAST(c_nationkey AS INTEGER) AS nation FROM customer WHERE c_custkey % 9 > 2")
def csv_kept_records(spark, sf_dir):
    return _csv_lines(spark, sf_dir)[0]


@registered(f"SELECT {_BAD} AS record FROM customer WHERE c_custkey % 9 <= 2")
def csv_rejected_records(spark, sf_dir):
    return _csv_lines(spark, sf_dir)[1].select("record")


def _json_lines(spark, sf_dir):
    """Orders as nested records, some of which are cut off or have a text for a number."""
    path = _path(spark, "jsonl")
    whole = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("author"), F.array("o_orderpriority").alias("topics")).alias("work")))
    line = F.when(F.col("o_orderkey") % 11 == 0, F.substr(whole, F.lit(1), F.length(whole) - 1)).when(F.col("o_orderkey") % 11 == 1, F.concat(F.lit('{"id":"n'), "o_orderkey", F.lit('"}'))).otherwise(whole)
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return sources.read_checked(spark, path, "jsonl", "id bigint, work struct<author:bigint,topics:array<string>>")


@registered("SELECT o_orderkey AS id, o_custkey AS author, o_orderpriority AS topic FROM orders WHERE o_orderkey % 11 > 1")
def nested_kept_records(spark, sf_dir):
    return _json_lines(spark, sf_dir)[0].select("id", F.col("work.author").alias("author"), F.col("work.topics")[0].alias("topic"))


@registered("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 11 = 1) AS of_type FROM orders WHERE o_orderkey % 11 <= 1")
def nested_rejected_records(spark, sf_dir):
    return _json_lines(spark, sf_dir)[1].agg(F.count("*").alias("n"), F.count_if(F.col("record").startswith('{"id":"n')).alias("of_type"))


@registered("""
  SELECT 'cu_' || c_custkey AS s, 'name' AS p, c_name AS o, 'literal' AS o_kind, CAST(NULL AS VARCHAR) AS o_datatype FROM customer UNION SELECT 'cu_' || c_custkey, 'type', 'Scholar', 'uri', NULL FROM customer
  UNION SELECT 'cu_' || c_custkey, 'sourcedFrom', 'ds_customer', 'uri', NULL FROM customer UNION SELECT 'cu_' || c_custkey, 'revenue', CAST(c_acctbal AS VARCHAR), 'literal', 'decimal' FROM customer
  UNION SELECT 'cu_' || c_custkey, 'description', c_mktsegment, 'literal', NULL FROM customer UNION SELECT 'cu_' || c_custkey, 'affiliatedWith', 'n_' || c_nationkey, 'uri', NULL FROM customer
  UNION SELECT 'n_' || c_nationkey, 'type', 'Institution', 'uri', NULL FROM customer
""")
def turtle_round_trip(spark, sf_dir):
    """Written as files grouped by subject, and read again."""
    path = _path(spark, "ttl")
    turtle.write_turtle(triples(spark, sf_dir, "customer"), path)
    return turtle.read_turtle(spark, path)[0].select("s", "p", "o", "o_kind", "o_datatype")


@registered("SELECT 'doc_' || doc_id AS s, text AS o FROM documents WHERE text IS NOT NULL")
def texts_as_turtle(spark, sf_dir):
    """Whole texts as literals."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    none = F.lit(None).cast("string")
    t = d.select(F.concat(F.lit("doc_"), "doc_id").alias("s"), F.lit("description").alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))
    return turtle.parse_turtle(turtle.to_turtle(t))[0].select("s", "o")


# ---- checks


@registered("SELECT 'unknown property ' || column_name AS error FROM information_schema.columns WHERE table_name = 'customer' UNION ALL SELECT 'unknown class Customer'")
def mapping_errors(spark, sf_dir):
    """A mapping that takes the table's own columns for properties, of a class that isn't known."""
    columns = table(spark, sf_dir, "customer").columns
    errors = mapping.validate([EntityMapping("Customer", "c_custkey", "cu_{id}", "c_name", tuple(Property(c, c) for c in columns))])
    return spark.createDataFrame([(e,) for e in errors], "error string")


def _narrow_upload(spark, sf_dir):
    """An upload under an ontology that lacks what is inferred from the columns."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.concat(F.lit("K"), "c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"))
    return upload_tables([("companies", c)], "sheet.csv", "upload_y", ontology=Ontology(classes=("Company", "DataSource", "Industry"), relations={"sourcedFrom": ("Entity", "DataSource")}, properties=("name",)))


@registered("SELECT DISTINCT 'unknown relation belongsToIndustry' AS warning FROM customer")
def upload_warnings(spark, sf_dir):
    """One bad mapping is told, the others go on."""
    return spark.createDataFrame([(w,) for w in sorted(set(_narrow_upload(spark, sf_dir)[2]))], "warning string")


@registered("SELECT 'c_K' || c_custkey AS s, 'name' AS p, c_name AS o FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5000) UNION ALL SELECT 'ds_upload_y', 'name', 'sheet.csv'")
def upload_besides_warnings(spark, sf_dir):
    return _narrow_upload(spark, sf_dir)[0].where("p = 'name'").select("s", "p", "o")


@registered("SELECT 'customer' AS source_id, false AS removable, 6 * count(*) + count(DISTINCT c_nationkey) AS triples FROM customer UNION ALL SELECT 'upload_n', true, CAST(4 * count(*) AS BIGINT) FROM nation")
def removable_sources(spark, sf_dir):
    """Sources with their triples, and whether they may be withdrawn."""
    c = lifecycle.contribute(triples(spark, sf_dir, "customer"), "customer").unionByName(lifecycle.contribute(triples(spark, sf_dir, "nation"), "upload_n", "alice"))
    return lifecycle.removable_sources(c)


# ---- trends, ranks and overviews that questions ask for


_COUNTED = """
  WITH q AS (SELECT CAST(c_custkey AS VARCHAR) AS text_id, c_custkey AS k, c_nationkey AS nat, c_custkey % 5 AS form FROM customer),
  y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
  a AS (SELECT text_id, year, count(*) AS n FROM q JOIN y ON o_custkey = k WHERE form = 0 GROUP BY ALL UNION ALL SELECT text_id, year, count(*) FROM q JOIN y ON c_nationkey = nat WHERE form = 1 GROUP BY ALL),
  r AS (SELECT 'su_' || s_suppkey AS s, s_name AS name, s_acctbal AS v, count(*) OVER () AS total FROM supplier),
  p AS (SELECT 'n_' || n_nationkey AS s, n_name AS name, count(DISTINCT o_orderkey) AS v, count(*) OVER () AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
  c AS (SELECT 'Institution' AS name, (SELECT count(*) FROM nation) AS v UNION ALL SELECT 'Scholar', (SELECT count(*) FROM customer) UNION ALL SELECT 'Publication', (SELECT count(*) FROM orders) UNION ALL SELECT 'Company', (SELECT count(*) FROM supplier)),
  x AS (
    SELECT text_id, 'trend' AS intent, row_number() OVER (PARTITION BY text_id ORDER BY year) AS nr, CAST(year AS VARCHAR) AS name, CAST(n AS DOUBLE) AS value, count(*) OVER (PARTITION BY text_id) AS total FROM a
    UNION ALL SELECT text_id, 'numeric_rank', nr, name, v, total FROM q, (SELECT *, row_number() OVER (ORDER BY v DESC, s) AS nr FROM r) WHERE form = 2 AND nr <= 30
    UNION ALL SELECT text_id, 'relation_rank', nr, name, CAST(v AS DOUBLE), total FROM q, (SELECT *, row_number() OVER (ORDER BY v DESC, s) AS nr FROM p) WHERE form = 3 AND nr <= 30
    UNION ALL SELECT text_id, 'overview', nr, name, CAST(v AS DOUBLE), 4 FROM q, (SELECT *, row_number() OVER (ORDER BY name) AS nr FROM c) WHERE form = 4)
"""


def _counted(spark, sf_dir):
    """Each customer's question: the trend of its works or its nation's, the largest companies, institutions by works, or an overview."""
    only = ("type", "name", "authorOf", "affiliatedWith", "year", "revenue")
    suppliers = mapping.apply_mapping(rows(spark, sf_dir, "supplier"), EntityMapping("Company", "s_suppkey", "su_{id}", "s_name", (Property("s_acctbal", "revenue", "decimal"),)), "supplier", only=only)
    customers = triples(spark, sf_dir, "nation", "customer", "orders", only=only).where("p <> 'revenue'")
    t = saved(mapping.union([customers, suppliers]).dropDuplicates(), "p")
    form = F.col("c_custkey") % 5
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey")  # 25 rows
    text = F.when(form == 0, F.concat("c_name", F.lit(" 的论文趋势"))).when(form == 1, F.concat("n_name", F.lit(" 论文逐年分布"))).when(form == 2, F.lit("营收最高的公司")).when(form == 3, F.lit("机构论文排名")).otherwise(F.lit(""))
    texts = c.select(F.col("c_custkey").cast("string").alias("text_id"), text.alias("text"))
    none = query.no_merges(t)
    found = saved(mentions.canonical_mentions(mentions.mentions(texts, t), t, none))
    return saved(routing.route(texts, found.hint("merge").join(saved(graph.least_class(t)), "s"))), t, none


@registered(_COUNTED + "SELECT text_id, intent, CAST(nr AS INTEGER) AS nr, name, value, total FROM x")
def routed_counts(spark, sf_dir):
    return routing.counted_results(*_counted(spark, sf_dir))


@registered(_COUNTED + """
  , n AS (SELECT *, name || ' (' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || ')' AS shown FROM x WHERE intent = 'trend' OR nr <= 15),
  l AS (SELECT text_id, intent, any_value(total) AS total, CAST(sum(value) AS BIGINT) AS all_of, count(*) AS k, string_agg(shown, '、' ORDER BY nr) AS listed FROM n GROUP BY ALL)
  SELECT text_id, intent, CASE intent WHEN 'trend' THEN total || ' years, ' || all_of || ' records: ' || listed WHEN 'overview' THEN total || ' classes: ' || listed ELSE total || ' ranked, ' || k || ' shown: ' || listed END AS summary FROM l
""")
def routed_count_summaries(spark, sf_dir):
    return routing.counted_result_summaries(*_counted(spark, sf_dir))
