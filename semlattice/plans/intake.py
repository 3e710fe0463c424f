"""Queries over what comes in: files, lists, inferred mappings, uploads, ownership, nested records, rules and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import owner_key
from ..operators import biblio, graph, infer, lifecycle, mapping, mentions, quality, query, routing, view
from ..operators.upload import Upload, upload_tables
from ..sources import tables as sources
from ..streaming import ingest
from .config import EntityMapping, Property, RelationMapping
from .register import registered
from .scratch import folder, saved
from .star import STAR, star_triples
from .tables import CUSTOMER, NATION, rows, table, triples

_CUSTOMER = """
  SELECT 'cu_' || c_custkey AS s, 'type' AS p, 'Scholar' AS o FROM {0} UNION ALL SELECT 'cu_' || c_custkey, 'sourcedFrom', 'ds_{1}' FROM {0} UNION ALL SELECT 'cu_' || c_custkey, 'name', c_name FROM {0}
  UNION ALL SELECT 'cu_' || c_custkey, 'revenue', CAST(c_acctbal AS VARCHAR) FROM {0} UNION ALL SELECT 'cu_' || c_custkey, 'description', c_mktsegment FROM {0}
  UNION ALL SELECT 'cu_' || c_custkey, 'affiliatedWith', 'n_' || c_nationkey FROM {0} UNION ALL SELECT DISTINCT 'n_' || c_nationkey, 'type', 'Institution' FROM {0}
"""


# ---- files


def _path(spark, name: str) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}.{name}"


@registered("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    path = _path(spark, "csv")
    sources.write_csv(table(spark, sf_dir, "customer"), path, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    return sources.tidy(sources.read(spark, path)).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal", "c_mktsegment")


@registered("SELECT doc_id, text, lang FROM documents")
def csv_of_texts(spark, sf_dir):
    """Quotes, commas and line ends inside values."""
    path = _path(spark, "csv")
    sources.write_csv(table(spark, sf_dir, "documents"), path, ["doc_id", "text", "lang"])
    return sources.read(spark, path, schema="doc_id bigint, text string, lang string")


@registered("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    path = _path(spark, "jsonl")
    sources.write_json(table(spark, sf_dir, "conversations"), path)
    return sources.read(spark, path, schema="conv_id bigint, turn bigint, role string, text string")


@registered(" UNION ALL ".join(f"SELECT '{n}' AS source_id, '{n}' AS name, 'parquet' AS kind, count(*) AS rows FROM {n}" for n in ("customer", "documents", "events", "lineitem", "nation", "orders", "part", "supplier")))
def list_sources(spark, sf_dir):
    """A catalog of the tables, less one that is removed."""
    names = ("customer", "documents", "events", "lineitem", "nation", "orders", "part", "region", "supplier")
    catalog = mapping.union([sources.register(spark, n, n, f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names])
    return sources.list_sources(sources.remove_source(catalog, "region")).select("source_id", "name", "kind", "rows")


# ---- lists, whole graphs, a stream


_ITEMS_SQL = "x AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _brands(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return items.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))


_LISTED = RelationMapping("belongsToField", "Publication", "l_orderkey", "o_{id}", "Field", "brands", "f_{id}", from_value=True, multi_object=True)
_LISTED_SQL = f"""
  WITH {_ITEMS_SQL}
  SELECT 'o_' || o AS s, 'belongsToField' AS p, 'f_' || replace(b, '#', '%23') AS o FROM x UNION SELECT 'f_' || replace(b, '#', '%23'), 'type', 'Field' FROM x UNION SELECT 'f_' || replace(b, '#', '%23'), 'name', b FROM x
"""


@registered(_LISTED_SQL)
def map_array_values(spark, sf_dir):
    return mapping.apply_mapping(_brands(spark, sf_dir), _LISTED, "items").dropDuplicates().select("s", "p", "o")


@registered(_LISTED_SQL)
def map_listed_text(spark, sf_dir):
    """Lists as text: of odd orders JSON, of even ones parted by semicolons, with blank items."""
    text = F.when(F.col("l_orderkey") % 2 == 1, F.to_json("brands")).otherwise(F.concat(F.lit(" ;"), F.array_join("brands", " ; "), F.lit(";")))
    return mapping.apply_mapping(_brands(spark, sf_dir).withColumn("brands", text), _LISTED, "items").dropDuplicates().select("s", "p", "o")


_BUILT_SQL = "SELECT DISTINCT * FROM (" + _CUSTOMER.format("customer", "customer") + """
  UNION ALL SELECT 'n_' || n_nationkey, 'type', 'Institution' FROM nation UNION ALL SELECT 'n_' || n_nationkey, 'sourcedFrom', 'ds_nation' FROM nation UNION ALL SELECT 'n_' || n_nationkey, 'name', n_name FROM nation
  UNION ALL SELECT 'n_' || n_nationkey, 'level', CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT 'ds_' || x, 'type', 'DataSource' FROM (VALUES ('customer'), ('nation')) v(x) UNION ALL SELECT 'ds_' || x, 'name', x || 's' FROM (VALUES ('customer'), ('nation')) v(x))
"""


@registered(_BUILT_SQL)
def build_graph(spark, sf_dir):
    """Two sources with their own entities as one graph."""
    return mapping.build_graph([("customer", "customers", rows(spark, sf_dir, "customer"), CUSTOMER), ("nation", "nations", rows(spark, sf_dir, "nation"), NATION)]).select("s", "p", "o")


@registered("SELECT DISTINCT * FROM (" + _CUSTOMER.format("customer", "customer") + " UNION ALL SELECT 'ds_customer', 'type', 'DataSource' UNION ALL SELECT 'ds_customer', 'name', 'customers')")
def stream_of_files(spark, sf_dir):
    """The customers as a stream of three files, appended to contributions; the graph is that of one batch."""
    fed, out = _path(spark, "in"), _path(spark, "out")
    source = table(spark, sf_dir, "customer")
    for part in range(3):
        source.where(F.col("c_custkey") % 3 == part).coalesce(1).write.mode("append").parquet(fed)
    ingest.append_contributions(ingest.stream_source(spark, fed, source.schema.simpleString()[len("struct<"):-1].replace(":", " "), maxFilesPerTrigger="1"), CUSTOMER, "customer", "customers", out, _path(spark, "checkpoint")).awaitTermination()
    return lifecycle.graph(spark.read.parquet(out)).select("s", "p", "o")


@registered("SELECT * FROM (" + _CUSTOMER.format("(SELECT * FROM customer WHERE c_custkey % 2 = 0)", "nobody").replace("'ds_nobody'", "'ds_even'") + " UNION SELECT 'ds_even', 'type', 'DataSource' UNION SELECT 'ds_even', 'name', 'even')")
def stream_into_view(spark, sf_dir):
    """Two streams of files into a view with reference counts, of which one is withdrawn again with all its batches."""
    source = table(spark, sf_dir, "customer")
    schema = source.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    held = view.View(spark, f"{folder(spark)}/view-{uuid.uuid4().hex}", buckets=8)
    for name, odd in (("even", 0), ("odd", 1)):
        fed = _path(spark, "in")
        for part in range(2):
            source.where((F.col("c_custkey") % 2 == odd) & (F.floor(F.col("c_custkey") / 2) % 2 == part)).coalesce(1).write.mode("append").parquet(fed)
        ingest.append_to_view(ingest.stream_source(spark, fed, schema, maxFilesPerTrigger="1"), CUSTOMER, name, name, held, _path(spark, "checkpoint")).awaitTermination()
    held.compact()
    ingest.withdraw_stream(held, "odd")
    return held.graph().select("s", "p", "o")


# ---- inferred mappings


@registered("""
  SELECT 'c_' || c_custkey AS s, 'type' AS p, 'Company' AS o FROM customer UNION ALL SELECT 'c_' || c_custkey, 'sourcedFrom', 'ds_x' FROM customer UNION ALL SELECT 'c_' || c_custkey, 'name', c_name FROM customer
  UNION ALL SELECT 'c_' || c_custkey, 'region', 'R' || c_nationkey FROM customer UNION ALL SELECT 'c_' || c_custkey, 'employees', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'c_' || c_custkey, 'belongsToIndustry', 'ind_' || c_mktsegment FROM customer UNION ALL SELECT DISTINCT 'ind_' || c_mktsegment, 'type', 'Industry' FROM customer UNION ALL SELECT DISTINCT 'ind_' || c_mktsegment, 'name', c_mktsegment FROM customer
""")
def inferred_company_triples(spark, sf_dir):
    """Class, id, label, property and value relation are inferred from the names of the columns."""
    data = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), F.concat(F.lit("R"), "c_nationkey").alias("region"), F.col("c_nationkey").alias("employees"))
    return _inferred(spark, data, "companies.csv").select("s", "p", "o")


@registered("""
  SELECT 'p_' || o_orderkey AS s, 'type' AS p, 'Publication' AS o FROM orders UNION ALL SELECT 'p_' || o_orderkey, 'sourcedFrom', 'ds_x' FROM orders UNION ALL SELECT 'p_' || o_orderkey, 'name', 't' || o_orderkey FROM orders
  UNION ALL SELECT 'p_' || o_orderkey, 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders UNION ALL SELECT 'p_' || o_orderkey, 'affiliatedWith', 'i_' || o_custkey FROM orders UNION ALL SELECT DISTINCT 'i_' || o_custkey, 'type', 'Institution' FROM orders
  UNION ALL SELECT 'p_' || o_orderkey, 'publishedIn', 'v_' || o_orderstatus FROM orders UNION ALL SELECT DISTINCT 'v_' || o_orderstatus, 'type', 'Venue' FROM orders UNION ALL SELECT DISTINCT 'v_' || o_orderstatus, 'name', o_orderstatus FROM orders
""")
def inferred_paper_triples(spark, sf_dir):
    """With a foreign key."""
    data = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.concat(F.lit("t"), "o_orderkey").alias("title"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("inst_id"), F.col("o_orderstatus").alias("journal"))
    return _inferred(spark, data, "papers.csv").select("s", "p", "o")


def _inferred(spark, data: DataFrame, file: str) -> DataFrame:
    catalog = spark.createDataFrame([("x", file, None, i, c) for i, c in enumerate(data.columns)], "source_id string, file string, sheet string, column_idx int, column string")
    found, _ = infer.mappings_of(infer.infer(catalog).collect())  # as many rows as the table has columns
    return mapping.union([mapping.apply_mapping(data, m, "x") for m in found]).dropDuplicates()


# ---- uploads


_QUOTA = 120
_UPLOAD_SQL = f"""
  WITH c AS (SELECT c_custkey AS nr, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'K' || (c_custkey % 50) END AS k, c_name AS n, c_mktsegment AS seg FROM customer),
  keyed AS (SELECT *, row_number() OVER (ORDER BY nr) AS place FROM c WHERE trim(k) <> ''), used AS (SELECT * FROM keyed WHERE place <= {_QUOTA}),
  fixed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY place) > 1 THEN 'auto' || place ELSE k END AS id FROM used)
"""


def _upload(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("K"), F.col("c_custkey") % 50))
    companies = c.select(F.col("c_custkey").alias("row_idx"), key.alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"))
    other = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("row_idx"), F.col("r_name").alias("a"), F.lit("x").alias("b"))
    more = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_idx"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("company_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    return upload_tables([("companies", companies), ("other", other), ("more companies", more)], "sheet.csv", "upload_x", Upload(max_rows=_QUOTA))


@registered(_UPLOAD_SQL + f"""
  , n AS (SELECT (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM keyed) AS k, (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS h, (SELECT count(*) FROM region) AS r)
  SELECT 'companies' AS "table", c AS rows_in, least(k, {_QUOTA}) AS rows_used, c - k AS rows_filtered, greatest(k - {_QUOTA}, 0) AS rows_truncated, CAST(NULL AS VARCHAR) AS reason FROM n
  UNION ALL SELECT 'other', r, CAST(0 AS BIGINT), r, CAST(0 AS BIGINT), 'no known class' FROM n
  UNION ALL SELECT 'more companies', s, greatest(least(h, {_QUOTA} - least(k, {_QUOTA})), 0), s - h, h - greatest(least(h, {_QUOTA} - least(k, {_QUOTA})), 0), NULL FROM n
""")
def upload_report(spark, sf_dir):
    """Empty rows, blank keys, a table of no known class, and a quota that bites."""
    return _upload(spark, sf_dir)[1]


@registered(_UPLOAD_SQL + """
  SELECT 'c_' || id AS s, 'type' AS p, 'Company' AS o FROM fixed UNION ALL SELECT 'c_' || id, 'sourcedFrom', 'ds_upload_x' FROM fixed UNION ALL SELECT 'c_' || id, 'name', n FROM fixed
  UNION ALL SELECT 'c_' || id, 'belongsToIndustry', 'ind_' || seg FROM fixed UNION ALL SELECT DISTINCT 'ind_' || seg, 'type', 'Industry' FROM fixed UNION ALL SELECT DISTINCT 'ind_' || seg, 'name', seg FROM fixed
  UNION ALL SELECT 'ds_upload_x', 'type', 'DataSource' UNION ALL SELECT 'ds_upload_x', 'name', 'sheet.csv'
""")
def upload_contributions(spark, sf_dir):
    return _upload(spark, sf_dir)[0].select("s", "p", "o")


@registered(_UPLOAD_SQL + "SELECT (SELECT count(*) FROM fixed) + (SELECT count(DISTINCT seg) FROM fixed) + 1 AS entities")
def upload_entity_count(spark, sf_dir):
    return lifecycle.entity_count(_upload(spark, sf_dir)[0])


@registered("""
  WITH r AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS sheet_idx, o_orderkey AS row_idx FROM orders)
  SELECT sheet_idx, row_idx FROM (SELECT *, row_number() OVER (ORDER BY sheet_idx, row_idx) AS nr FROM r) WHERE nr <= 700
""")
def row_quota_over_sheets(spark, sf_dir):
    return lifecycle.within_quota(table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("sheet_idx"), F.col("o_orderkey").alias("row_idx")), 700)


# ---- ownership


_TWO = "WITH a AS (SELECT * FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT * FROM customer WHERE c_custkey % 3 = 0), ab AS (SELECT * FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)"


def _owned(spark, sf_dir) -> DataFrame:
    c = rows(spark, sf_dir, "customer")
    part = lambda where, sid, owner: lifecycle.contribute(mapping.union([mapping.apply_mapping(c.where(where), m, "shared") for m in CUSTOMER]), sid, owner, "p_" + sid)
    return saved(part("c_custkey % 2 = 0", "upload_a", "alice").unionByName(part("c_custkey % 3 = 0", "upload_b", None)))


@registered(_TWO + ", gone AS (SELECT * FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b)) SELECT s, p, o FROM (" + _CUSTOMER.format("gone", "shared") + ") EXCEPT SELECT s, p, o FROM (" + _CUSTOMER.format("b", "shared") + ")")
def withdraw_source_whole(spark, sf_dir):
    """All triples that vanish with one of two overlapping sources."""
    return lifecycle.withdrawn_triples(_owned(spark, sf_dir), "upload_a").select("s", "p", "o")


@registered(_TWO + " SELECT DISTINCT s, p, o FROM (" + _CUSTOMER.format("ab", "shared") + ")")
def visible_to_owner_whole(spark, sf_dir):
    return lifecycle.visible_to(_owned(spark, sf_dir), "alice").select("s", "p", "o")


@registered(_TWO + " SELECT s, p, o FROM (" + _CUSTOMER.format("a", "shared") + ")")
def partition_of_owner(spark, sf_dir):
    return lifecycle.partition_of(_owned(spark, sf_dir), "alice", "p_upload_a").select("s", "p", "o")


@registered(_TWO + " SELECT s, p, o FROM (" + _CUSTOMER.format("b", "shared") + ")")
def delete_partition(spark, sf_dir):
    """What is left of the graph."""
    return lifecycle.graph(lifecycle.delete_partition(_owned(spark, sf_dir), "alice", "p_upload_a")).select("s", "p", "o")


@registered(_TWO + ", gone AS (SELECT * FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b)) SELECT s, p, o FROM (" + _CUSTOMER.format("gone", "shared") + ") EXCEPT SELECT s, p, o FROM (" + _CUSTOMER.format("b", "shared") + ")")
def net_new_triples(spark, sf_dir):
    held = _owned(spark, sf_dir)
    return lifecycle.net_new(held.where("source_id = 'upload_a'"), lifecycle.graph(held.where("source_id = 'upload_b'"))).select("s", "p", "o")


@registered("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 3 = 1 THEN '~uid-' || sha256(c_name) ELSE 'guest' END AS owner FROM customer")
def owner_keys(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).when(F.col("c_custkey") % 2 == 0, F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", owner_key(name).alias("owner"))


# ---- patterns and lookups


@registered("SELECT 'cu_' || c_custkey AS c, c_name AS name, 'n_' || n_nationkey AS n, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY place DESC, c LIMIT 25")
def pattern_ordered_page(spark, sf_dir):
    """Patterns in an unlucky order, with order and limit."""
    t = saved(triples(spark, sf_dir, "nation", "customer", only=("name", "affiliatedWith")), "p")
    return graph.match(t, [("?c", "name", "?name"), ("?n", "name", "?place"), ("?c", "affiliatedWith", "?n")], order=[F.desc("place"), "c"], limit=25)


@registered("SELECT 'cu_' || c_custkey AS c, CASE WHEN o_orderkey IS NULL THEN '' ELSE 'o_' || o_orderkey END AS w FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) ON o_custkey = c_custkey")
def pattern_tabulated(spark, sf_dir):
    """Unbound variables are empty text."""
    t = saved(triples(spark, sf_dir, "customer", "orders", only=("name", "authorOf")), "p")
    even = t.where("p <> 'authorOf' or cast(substr(o, 3) as bigint) % 2 = 0")
    return graph.tabulate(graph.match(even, [("?c", "name", "?name")], [[("?c", "authorOf", "?w")]]).where("c like 'cu%'").select("c", "w"))


@registered("SELECT s, p, o FROM (" + _CUSTOMER.format("customer", "customer") + ") WHERE s LIKE 'cu_%'")
def describe_entities(spark, sf_dir):
    t = saved(triples(spark, sf_dir, "customer"), "p")
    return graph.describe(t, graph.types(t).where("class = 'Scholar'").select(F.col("s").alias("uri"))).select("s", "p", "o")


@registered("""
  SELECT DISTINCT 'cu_' || c_custkey AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE c_nationkey = 3 AND p_brand = (SELECT min(p_brand) FROM part)
""")
def scholars_of_both(spark, sf_dir):
    """Scholars of an institution with a publication in a field."""
    brand = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    t = saved(triples(spark, sf_dir, "customer", "orders", "brand", only=("type", "affiliatedWith", "authorOf", "belongsToField")), "p")
    return query.scholars_of(t, query.no_merges(t), "n_3", "f_" + brand.replace("#", "%23"))


_LABELS_SQL = "SELECT 'cu_' || c_custkey AS s, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'cu_' || c_custkey END AS name FROM customer"


@registered(_LABELS_SQL)
def labels_of_entities(spark, sf_dir):
    """A name, else a Chinese name, else the end of the id."""
    data = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("n"), F.when(F.col("c_custkey") % 3 != 2, F.col("c_mktsegment")).alias("cn"))
    t = mapping.apply_mapping(data, EntityMapping("Scholar", "c_custkey", "cu_{id}", "n", (Property("cn", "cnLabel"),)), "x")
    return graph.called(graph.types(t).select("s"), t)


@registered("WITH h AS (SELECT 'o_' || o_orderkey AS s, CAST(o_orderkey AS VARCHAR) AS name FROM orders WHERE contains(CAST(o_orderkey AS VARCHAR), '9')) SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY s LIMIT 20")
def search_publications(spark, sf_dir):
    t = saved(triples(spark, sf_dir, "orders", only=("type", "name")), "p")
    return query.search_publications(t, query.no_merges(t), "9").select("s", "name", "total")


@registered("SELECT min('f_' || replace(p_brand, '#', '%23')) AS s FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(p_brand, '2')")
def resolve_field(spark, sf_dir):
    return query.resolve_by_label(saved(triples(spark, sf_dir, "brand", only=("type", "name")), "p"), "2")


@registered("SELECT DISTINCT n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def industry_names(spark, sf_dir):
    return query.class_names(saved(triples(spark, sf_dir, "supplier", only=("type", "name")), "p"))


# ---- rules


_RULES_SQL = """
  WITH v AS (
    SELECT 'o_' || o_orderkey AS focus, 'Publication' AS class, 'name' AS path FROM orders WHERE o_orderkey % 10 = 0
    UNION ALL SELECT 'o_' || o_orderkey, 'Publication', 'year' FROM orders WHERE o_orderkey % 7 = 0
    UNION ALL SELECT 'cu_' || c_custkey, 'Scholar', 'authorOf' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0)
  )
"""


def _incomplete(spark, sf_dir) -> DataFrame:
    o = rows(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey")).alias("t"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_year")).alias("y"))
    parts = [
        mapping.apply_mapping(o, EntityMapping("Publication", "o_orderkey", "o_{id}", "t", (Property("y", "year", "integer"),)), "orders"),
        mapping.apply_mapping(o.where("o_orderkey % 4 = 0"), RelationMapping("authorOf", "Scholar", "o_custkey", "cu_{id}", "Publication", "o_orderkey", "o_{id}"), "orders"),
        mapping.apply_mapping(rows(spark, sf_dir, "customer"), CUSTOMER[0], "customer"),
    ]
    return saved(mapping.union(parts).dropDuplicates(), "p")


@registered(_RULES_SQL + "SELECT focus, class, path, CAST(0 AS BIGINT) AS found, class || ' needs at least 1 ' || path AS message FROM v")
def quality_violations(spark, sf_dir):
    """The three shipped rules over incomplete entities, whole rows."""
    return quality.violations(_incomplete(spark, sf_dir))


@registered(_RULES_SQL + "SELECT count(*) = 0 AS conforms, count(*) AS violations FROM v")
def quality_report(spark, sf_dir):
    return quality.report(quality.violations(_incomplete(spark, sf_dir)))


@registered(_RULES_SQL + "SELECT focus, class, path FROM v ORDER BY focus, path LIMIT 5")
def quality_first_violations(spark, sf_dir):
    return quality.first_violations(quality.violations(_incomplete(spark, sf_dir))).select("focus", "class", "path")


def _damaged(spark, sf_dir) -> DataFrame:
    t = triples(spark, sf_dir, "orders", only=("name", "authorOf"))
    nr = F.substring("s", 3, 20).try_cast("bigint")
    s = F.when(nr % 5 == 0, F.concat(F.lit('"'), "s")).when(nr % 7 == 0, F.lit(None)).otherwise(F.col("s"))
    return t.where("p = 'name'").select(s.alias("s"), F.when(nr % 11 == 0, F.lit("_:b")).otherwise(F.col("p")).alias("p"), "o", F.when(nr % 13 == 0, F.lit("odd")).otherwise(F.col("o_kind")).alias("o_kind"), "o_datatype", "o_lang")


@registered("SELECT 'o_' || o_orderkey AS s, CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0")
def sound_triples(spark, sf_dir):
    return quality.split_valid(_damaged(spark, sf_dir))[0].select("s", "o")


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def rejected_triples(spark, sf_dir):
    return quality.split_valid(_damaged(spark, sf_dir))[1].select("o")


# ---- nested records


_WORKS_SQL = """
  WITH a AS (SELECT l_orderkey, l_suppkey, s_name, s_nationkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS nr FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey)
"""


def works(spark, sf_dir, again: bool = False) -> DataFrame:
    """Orders as nested records: suppliers of their items are authors, suppliers' nations institutions. again: every fourth comes once more, later, changed."""
    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"), "l_suppkey")
    place = F.array(F.struct(F.concat(F.lit("https://x/n"), "s_nationkey").alias("id"), F.concat(F.lit("N"), "s_nationkey").alias("display_name"), F.lit("XX").alias("country_code")))
    author = F.struct(F.lit("middle").alias("author_position"), F.struct(F.concat(F.lit("https://x/s"), "l_suppkey").alias("id"), F.col("s_name").alias("display_name"), F.lit(None).cast("string").alias("orcid")).alias("author"), place.alias("institutions"))
    ranked = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", author.alias("a"))))
    last = F.size("x") - 1
    with_position = F.transform("x", lambda x, i: x["a"].withField("author_position", F.when(i == 0, "first").when(i == last, "last").otherwise("middle")))
    nested = items.groupBy("l_orderkey").agg(ranked.alias("x")).select(F.col("l_orderkey").alias("o_orderkey"), with_position.alias("authorships"))
    o = t("orders").hint("merge").join(nested, "o_orderkey", "left")

    def record(topic_idx: Column, mark: str) -> list[Column]:
        venue = F.struct(F.struct(F.concat(F.lit("https://x/v"), "o_orderpriority").alias("id"), F.concat(F.lit(mark), "o_orderpriority").alias("display_name"), F.lit("journal").alias("type")).alias("source"))
        return [
            topic_idx.cast("int").alias("topic_idx"), F.col("o_orderkey").alias("pos"), F.concat(F.lit(mark), "o_orderstatus").alias("topic"), F.concat(F.lit("https://x/w"), "o_orderkey").alias("id"), F.concat(F.lit("https://doi.org/10.1/"), "o_orderkey").alias("doi"),
            F.concat(F.lit(mark + "t"), "o_orderkey").alias("title"), F.lit("").alias("display_name"), F.year("o_orderdate").alias("publication_year"), F.col("o_custkey").alias("cited_by_count"), F.lit("article").alias("type"), F.when(F.col("o_orderkey") % 9 != 0, venue).alias("primary_location"), "authorships",
        ]

    first = o.select(record(F.col("o_custkey") % 5, ""))
    return first.unionByName(o.where("o_orderkey % 4 = 0").select(record(F.lit(9), "later "))) if again else first


_MARK = "CASE WHEN o_orderkey % 4 = 0 THEN 'later ' ELSE '' END"


@registered(f"SELECT 'w' || o_orderkey AS openalex_id, {_MARK} || 't' || o_orderkey AS title, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS cited_by_count, CASE WHEN o_orderkey % 9 <> 0 THEN 'v' || o_orderpriority END AS venue_id, 'https://doi.org/10.1/' || o_orderkey AS doi, 'article' AS type FROM orders")
def biblio_publications_last_wins(spark, sf_dir):
    """Repeated works: the later one counts."""
    return biblio.publications(works(spark, sf_dir, True))


@registered("SELECT 'v' || o_orderpriority AS openalex_id, max(CASE WHEN o_orderkey % 4 = 0 THEN 'later ' ELSE '' END) || o_orderpriority AS name, 'journal' AS type FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY o_orderpriority")
def biblio_venues_last_wins(spark, sf_dir):
    return biblio.venues(works(spark, sf_dir, True))


@registered("SELECT 'w' || o_orderkey AS pub_id, 'v' || o_orderpriority AS venue_id FROM orders WHERE o_orderkey % 9 <> 0")
def biblio_published_in(spark, sf_dir):
    return biblio.published_in(works(spark, sf_dir, True))


@registered(_WORKS_SQL + "SELECT 's' || l_suppkey AS scholar_id, 'w' || l_orderkey AS pub_id, CASE WHEN nr = 1 THEN 'first' WHEN nr = count(*) OVER (PARTITION BY l_orderkey) THEN 'last' ELSE 'middle' END AS position FROM a")
def biblio_author_positions(spark, sf_dir):
    return biblio.author_of(works(spark, sf_dir, True))


@registered(_WORKS_SQL + """
  , seed AS (SELECT n_nationkey AS k, 'seed ' || n_name AS name FROM nation WHERE n_nationkey % 2 = 0)
  SELECT 'n' || k AS openalex_id, name, 'ZZ' AS country, CAST(k AS VARCHAR) AS works_count FROM seed
  UNION ALL SELECT DISTINCT 'n' || s_nationkey, 'N' || s_nationkey, 'XX', NULL FROM a WHERE s_nationkey NOT IN (SELECT k FROM seed)
""")
def biblio_institutions(spark, sf_dir):
    """A seed's institutions, then unseen ones of authorships."""
    none = F.lit(None).cast("bigint")
    seed = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("openalex_id"), F.concat(F.lit("seed "), "n_name").alias("name"), F.lit("ZZ").alias("country"), F.col("n_nationkey").cast("bigint").alias("works_count"), none.alias("cited_by_count"), none.alias("h_index"))
    return biblio.institutions(works(spark, sf_dir), seed).select("openalex_id", "name", "country", F.col("works_count").cast("string").alias("works_count"))


@registered(_WORKS_SQL + f"""
  , g AS (SELECT l_orderkey, string_agg(s_name, ',' ORDER BY nr) AS authors, string_agg('s' || l_suppkey, ',' ORDER BY nr) AS author_ids FROM a WHERE nr <= 10 GROUP BY l_orderkey),
  i AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT 'N' || s_nationkey))[1:5], ',') AS institutions FROM a WHERE nr <= 10 GROUP BY l_orderkey)
  SELECT 'V2w' || o_orderkey AS work_id, {_MARK} || 't' || o_orderkey AS title, CAST(year(o_orderdate) AS INTEGER) AS year, '10.1/' || o_orderkey AS doi, o_custkey AS cited_by_count, 'article' AS type,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus || ',later ' || o_orderstatus ELSE o_orderstatus END AS domain, coalesce(authors, '') AS authors, coalesce(author_ids, '') AS author_ids, coalesce(institutions, '') AS institutions,
    CASE WHEN o_orderkey % 9 <> 0 THEN {_MARK} || o_orderpriority END AS venue
  FROM orders LEFT JOIN g ON g.l_orderkey = o_orderkey LEFT JOIN i ON i.l_orderkey = o_orderkey
""")
def biblio_reshaped_rows(spark, sf_dir):
    """Whole rows, lists as text."""
    text = lambda c: F.array_join(c, ",").alias(c)
    return biblio.reshaped(works(spark, sf_dir, True), key_prefix="V2").select("work_id", "title", "year", "doi", "cited_by_count", "type", text("domain"), text("authors"), text("author_ids"), text("institutions"), "venue")


@registered(_WORKS_SQL + ", f AS (SELECT l_suppkey, min((o_custkey % 5, o_orderkey, nr)) AS place FROM a JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey) SELECT 's' || l_suppkey AS scholar_id FROM f ORDER BY place LIMIT 50")
def biblio_author_ids(spark, sf_dir):
    """Distinct authors in order of first occurrence, up to a cap."""
    return biblio.author_ids(works(spark, sf_dir), 50)


@registered("""
  WITH first AS (SELECT c_nationkey AS g, c_custkey AS k, 'first' AS src FROM customer WHERE c_custkey % 4 = 0), second AS (SELECT c_nationkey AS g, c_custkey AS k, 'second' AS src FROM customer),
  few AS (SELECT s.g FROM (SELECT DISTINCT g FROM second) s LEFT JOIN first f ON f.g = s.g GROUP BY s.g HAVING count(f.g) < 2)
  SELECT * FROM first UNION ALL SELECT * FROM second WHERE g IN (SELECT g FROM few) AND k NOT IN (SELECT k FROM first)
""")
def biblio_filled_up(spark, sf_dir):
    """Groups with fewer than two rows get a second source's rows that they lack."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"))
    return biblio.filled_up(c.where("k % 4 = 0").withColumn("src", F.lit("first")), c.withColumn("src", F.lit("second")), "g", "k", 2)


@registered("SELECT c_nationkey AS g, c_custkey AS k, 'old' AS src FROM customer WHERE c_nationkey % 3 <> 0 UNION ALL SELECT c_nationkey, c_custkey, 'new' FROM customer WHERE c_nationkey % 3 = 0 AND c_custkey % 2 = 0 UNION ALL SELECT c_nationkey, c_custkey, 'old' FROM customer WHERE c_nationkey % 3 = 0 AND c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0)")
def biblio_overwritten(spark, sf_dir):
    """Whole groups are replaced by newer ones."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"))
    return biblio.overwritten(c.withColumn("src", F.lit("old")), c.where("g % 3 = 0 and k % 2 = 0").withColumn("src", F.lit("new")), "g")


@registered("SELECT count(*) AS rejected FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 8 = 1")
def biblio_rejected(spark, sf_dir):
    """Works without an id or with a blank one."""
    w = works(spark, sf_dir)
    return biblio.rejected(w.withColumn("id", F.when(F.col("pos") % 8 == 1, F.lit(" ")).when(F.col("pos") % 6 != 0, F.col("id"))))


@registered("SELECT 'n' || n_nationkey AS inst_id, n_name AS name, 'XX' AS country_code FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT 'n' || n_nationkey, 'cn ' || n_name, 'field' FROM nation WHERE n_nationkey % 3 <> 0")
def biblio_prepared_names(spark, sf_dir):
    """Institutions and concepts under the prepared names, those without an id left out."""
    n = table(spark, sf_dir, "nation")
    none = F.lit(None).cast("bigint")
    key = F.concat(F.lit("n"), "n_nationkey")
    places = biblio.known_institutions(n.select(F.when(F.col("n_nationkey") % 4 != 0, key).alias("openalex_id"), F.col("n_name").alias("name"), F.lit("XX").alias("country"), none.alias("works_count"), none.alias("cited_by_count"), none.alias("h_index")))
    concepts = biblio.known_concepts(n.select(F.when(F.col("n_nationkey") % 3 != 0, key).alias("openalex_id"), F.lit("field").alias("en_query"), F.concat(F.lit("cn "), "n_name").alias("cn_label")))
    return places.select("inst_id", "name", "country_code").unionByName(concepts.select(F.col("field_id").alias("inst_id"), F.col("cn_name").alias("name"), F.col("name").alias("country_code")))


_STAR_SQL = _WORKS_SQL + """
  SELECT DISTINCT * FROM (
  SELECT 'institution/n' || s_nationkey AS s, 'type' AS p, 'Institution' AS o FROM a UNION ALL SELECT 'institution/n' || s_nationkey, 'name', 'N' || s_nationkey FROM a UNION ALL SELECT 'institution/n' || s_nationkey, 'country', 'XX' FROM a
  UNION ALL SELECT 'scholar/s' || l_suppkey, 'type', 'Scholar' FROM a UNION ALL SELECT 'scholar/s' || l_suppkey, 'name', s_name FROM a
  UNION ALL SELECT 'publication/w' || o_orderkey, 'type', 'Publication' FROM orders UNION ALL SELECT 'publication/w' || o_orderkey, 'name', 't' || o_orderkey FROM orders UNION ALL SELECT 'publication/w' || o_orderkey, 'doi', 'https://doi.org/10.1/' || o_orderkey FROM orders
  UNION ALL SELECT 'publication/w' || o_orderkey, 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders UNION ALL SELECT 'publication/w' || o_orderkey, 'cited_by_count', CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'venue/v' || o_orderpriority, 'type', 'Venue' FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT 'venue/v' || o_orderpriority, 'name', o_orderpriority FROM orders WHERE o_orderkey % 9 <> 0
  UNION ALL SELECT 'field/f' || x, 'type', 'Field' FROM (VALUES ('O'), ('F')) v(x) UNION ALL SELECT 'field/f' || x, 'name', 'field ' || x FROM (VALUES ('O'), ('F')) v(x) UNION ALL SELECT 'field/f' || x, 'cnLabel', x FROM (VALUES ('O'), ('F')) v(x) UNION ALL SELECT 'field/f' || x, 'level', '0' FROM (VALUES ('O'), ('F')) v(x)
  UNION ALL SELECT 'scholar/s' || l_suppkey, 'authorOf', 'publication/w' || l_orderkey FROM a UNION ALL SELECT 'scholar/s' || l_suppkey, 'affiliatedWith', 'institution/n' || s_nationkey FROM a
  UNION ALL SELECT 'publication/w' || o_orderkey, 'publishedIn', 'venue/v' || o_orderpriority FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT 'publication/w' || o_orderkey, 'belongsToField', 'field/f' || o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F'))
"""


@registered(_STAR_SQL.replace("'venue/v' || o_orderpriority", "'venue/v' || replace(o_orderpriority, ' ', '%20')"))
def star_graph(spark, sf_dir):
    """Nine relational tables as a graph, by the second mapping configuration."""
    w = saved(works(spark, sf_dir))
    none = F.lit(None).cast("bigint")
    seed = table(spark, sf_dir, "nation").where("false").select(F.lit("").alias("openalex_id"), F.lit("").alias("name"), F.lit("").alias("country"), none.alias("works_count"), none.alias("cited_by_count"), none.alias("h_index"))
    fields = biblio.field_dimension(spark, [("fO", "field O", "O", 0), ("fF", "field F", "F", 0)])
    last = saved(biblio.unique_works(w))  # three of the tables are made of it
    nine = {
        "institutions": biblio.institutions(w, seed), "scholars": biblio.scholars(w), "publications": biblio.publications(last, True), "venues": biblio.venues(w), "fields": fields,
        "author_of": biblio.author_of(last, True), "affiliation": biblio.affiliation(w), "published_in": biblio.published_in(last, True), "belongs_to_field": biblio.belongs_to_field(w, fields),
    }
    return star_triples(nine, STAR).where("p <> 'sourcedFrom'").select("s", "p", "o")


# ---- texts


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.format_string("%d/%d", "conv_id", "turn").alias("text_id"), "text")


_WORDS = (("the", "Scholar"), ("and", "Publication"), ("en", "Field"), ("zz", "Venue"))


@registered("SELECT conv_id || '/' || turn AS text_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN '{c}' END" for w, c in _WORDS) + "], lambda x: x IS NOT NULL), ',') AS classes FROM conversations")
def class_mentions(spark, sf_dir):
    return mentions.class_mentions(_turns(spark, sf_dir), _WORDS).select("text_id", F.array_join("classes", ",").alias("classes"))


@registered("""
  WITH t AS (SELECT c_custkey AS k, c_custkey % 4 AS form FROM customer)
  SELECT k AS text_id, CASE WHEN form = 0 THEN '清华大学' WHEN form = 1 THEN 'nation_1' ELSE 'customer' END AS keyword FROM t
""")
def keywords_of_questions(spark, sf_dir):
    """The part of a question that is left without stop phrases."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.lit("请问清华大学的？")).when(k % 4 == 1, F.lit("列出 nation_1 相关")).otherwise(F.lit("帮我 a, customer"))
    return table(spark, sf_dir, "customer").select(k.alias("text_id"), mentions.keyword(text).alias("keyword"))


@registered("""
  SELECT c_custkey AS text_id, 'cu_' || c_custkey AS s, 'https://example.org/resource/cu_' || c_custkey AS label FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 'cu_' || c_custkey, lower(c_name) FROM customer WHERE c_custkey % 2 = 1
""")
def mentions_by_address(spark, sf_dir):
    """A full address of a known entity is taken alone; names count in the other texts."""
    t = saved(triples(spark, sf_dir, "customer", only=("type", "name")), "p")
    k = F.col("c_custkey")
    texts = table(spark, sf_dir, "customer").select(k.alias("text_id"), F.concat(F.lit("about "), "c_name", F.when(k % 2 == 0, F.concat(F.lit(" <https://example.org/resource/cu_"), k, F.lit(">"))).otherwise(F.lit(" at https://example.org/nothing"))).alias("text"))
    return mentions.mentions(texts, t)


@registered("SELECT c_custkey AS text_id, 'i_' || c_nationkey || '_CN' AS s, '清华大学' AS label FROM customer WHERE c_nationkey % 5 = 0 UNION ALL SELECT c_custkey, 'i_' || c_nationkey || '_CN', '清华' FROM customer WHERE c_nationkey % 5 = 1")
def mentions_by_alias(spark, sf_dir):
    """Aliases lead to institutions of the right name and country only. Each nation has a text of its own words and two namesakes."""
    alias = mentions.alias_table(spark)
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    places = nations.crossJoin(F.broadcast(spark.createDataFrame([("CN",), ("US",)], "country string"))).select(F.concat_ws("_", F.lit("i"), "n_nationkey", "country").alias("i"), F.lit("Tsinghua University").alias("n"), "country", "n_nationkey")  # two rows
    t = saved(mapping.apply_mapping(places, EntityMapping("Institution", "i", "{id}", "n", (Property("country", "country"),)), "x").withColumn("nation", F.regexp_extract("s", "i_([0-9]+)_", 1).cast("int")), "p")
    texts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("text_id"), "c_nationkey", F.when(F.col("c_nationkey") % 5 == 0, F.lit("清华大学的论文")).when(F.col("c_nationkey") % 5 == 1, F.lit("清华有哪些学者")).otherwise(F.lit("无")).alias("text"))
    found = mentions.mentions(texts.select("text_id", "text"), t.drop("nation"), alias)
    mine = texts.select("text_id", F.col("c_nationkey").alias("nation"))
    return found.withColumn("nation", F.regexp_extract("s", "i_([0-9]+)_", 1).cast("int")).hint("merge").join(mine, ["text_id", "nation"]).select("text_id", "s", "label")


@registered("""
  WITH d AS (SELECT c_custkey AS k, 'duo ' || lpad(CAST(c_custkey // 2 AS VARCHAR), 12, '0') AS label FROM customer), n AS (SELECT label, count(*) AS n FROM d GROUP BY label)
  SELECT k AS text_id, label, n FROM d JOIN n USING (label) WHERE n > 1
""")
def ambiguous_mentions(spark, sf_dir):
    """Two customers share a name: each text's label leads to both."""
    c = table(spark, sf_dir, "customer").withColumn("duo", F.format_string("Duo %012d", F.floor(F.col("c_custkey") / 2)))
    t = saved(mapping.apply_mapping(c, EntityMapping("Scholar", "c_custkey", "cu_{id}", "duo"), "x"), "p")
    return mentions.ambiguous(mentions.mentions(c.select(F.col("c_custkey").alias("text_id"), F.concat(F.lit("who is "), "duo", F.lit("?")).alias("text")), t))


@registered("SELECT c_custkey AS text_id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'rest' END AS residual FROM customer")
def residual_of_questions(spark, sf_dir):
    """What is left of a question without its mentions and grammar words."""
    t = saved(triples(spark, sf_dir, "customer", only=("type", "name")), "p")
    texts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("text_id"), F.concat("c_name", F.lit(" 的论文有哪些？"), F.when(F.col("c_custkey") % 2 == 1, F.lit("Rest ")).otherwise(F.lit(""))).alias("text"))
    return mentions.residual(texts, saved(mentions.mentions(texts, t))).select("text_id", "residual")


_ASKED_SQL = """
  WITH q AS (SELECT c_custkey AS k, c_custkey % 4 AS form, 'cu_' || c_custkey AS s, c_name AS n, c_nationkey AS nat FROM customer)
"""


def _questions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A question about each customer or its nation, and the graph."""
    t = saved(triples(spark, sf_dir, "nation", "customer", "orders", only=("type", "name", "authorOf", "affiliatedWith")), "p")
    k = F.col("c_custkey") % 4
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey")  # 25 rows
    text = F.when(k == 0, F.concat("c_name", F.lit(" 的论文"))).when(k == 1, F.concat("n_name", F.lit(" 有哪些学者"))).when(k == 2, F.lit("你好")).otherwise(F.lit("机构列表"))
    return c.select(F.col("c_custkey").cast("string").alias("text_id"), text.alias("text")), t


def _routed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts, t = _questions(spark, sf_dir)
    none = query.no_merges(t)
    found = saved(mentions.canonical_mentions(mentions.mentions(texts, t), t, none))
    return saved(routing.route(texts, found.hint("merge").join(graph.least_class(t), "s"))), t, none


@registered(_ASKED_SQL + "SELECT CAST(k AS VARCHAR) AS text_id, CASE form WHEN 0 THEN 'publications' WHEN 1 THEN 'scholars' WHEN 2 THEN 'greeting' ELSE 'list_class' END AS intent FROM q")
def routed_intents(spark, sf_dir):
    return _routed(spark, sf_dir)[0].select("text_id", "intent")


@registered(_ASKED_SQL + """
  SELECT DISTINCT CAST(k AS VARCHAR) AS text_id, 'publications' AS intent, CAST(o_orderkey AS VARCHAR) AS name FROM q JOIN orders ON o_custkey = k WHERE form = 0
  UNION ALL SELECT CAST(k AS VARCHAR), 'scholars', c_name FROM q JOIN customer ON c_nationkey = nat WHERE form = 1
  UNION ALL SELECT CAST(k AS VARCHAR), 'list_class', n_name FROM q, nation WHERE form = 3
""")
def routed_results(spark, sf_dir):
    """What the questions ask for, by the operators that their intents lead to."""
    routed, t, none = _routed(spark, sf_dir)
    return routing.results(routed, t, none)


@registered(_ASKED_SQL + """
  , x AS (SELECT CAST(k AS VARCHAR) AS text_id, c_name AS name FROM q JOIN customer ON c_nationkey = nat WHERE form = 1),
  y AS (SELECT text_id, count(*) AS n, array_to_string(list_sort(list(name))[1:15], '、') AS shown FROM x GROUP BY text_id)
  SELECT text_id, 'scholars' AS intent, CASE WHEN n > 15 THEN n || ' scholars, 15 shown: ' || shown ELSE n || ' scholars: ' || shown END AS summary FROM y
""")
def routed_summaries(spark, sf_dir):
    routed, t, none = _routed(spark, sf_dir)
    return routing.result_summaries(routed.where("intent = 'scholars'"), t, none, called_by=routing.WHAT)
