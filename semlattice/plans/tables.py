"""The driver's tables in the roles of the graph: mappings as settings, operators stay general.

nation: Institution; customer: Scholar; orders: Publication; brands and segments: Field;
supplier: Company; supplier's nation: Industry; documents: Dataset.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import apply_mapping, union
from .config import EntityMapping, Property, RelationMapping
from .scratch import distinct_spread, spread

NATION = (EntityMapping("Institution", "n_nationkey", "n_{id}", "n_name", (Property("n_regionkey", "level", "integer"),)),)
CUSTOMER = (
    EntityMapping("Scholar", "c_custkey", "cu_{id}", "c_name", (Property("c_acctbal", "revenue", "decimal"), Property("c_mktsegment", "description"))),
    RelationMapping("affiliatedWith", "Scholar", "c_custkey", "cu_{id}", "Institution", "c_nationkey", "n_{id}"),
)
SEGMENT = (RelationMapping("belongsToField", "Scholar", "c_custkey", "cu_{id}", "Field", "c_mktsegment", "seg_{id}", from_value=True),)
ORDERS = (
    EntityMapping("Publication", "o_orderkey", "o_{id}", "o_orderkey", (Property("o_year", "year", "integer"),)),
    RelationMapping("authorOf", "Scholar", "o_custkey", "cu_{id}", "Publication", "o_orderkey", "o_{id}"),
)
BRAND = (RelationMapping("belongsToField", "Publication", "l_orderkey", "o_{id}", "Field", "p_brand", "f_{id}", from_value=True),)
SUPPLIER = (
    EntityMapping("Company", "s_suppkey", "su_{id}", "s_name", (Property("s_acctbal", "revenue", "decimal"),)),
    RelationMapping("belongsToIndustry", "Company", "s_suppkey", "su_{id}", "Industry", "n_name", "ind_{id}", from_value=True),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SOURCE = {"segment": "customer", "brand": "lineitem"}


def size(spark: SparkSession, sf_dir: str, part: str) -> int:
    """Rows of the table that a part is made of, by its files' footers."""
    return table(spark, sf_dir, SOURCE.get(part, part)).count()


def per_row(m: EntityMapping | RelationMapping) -> int:
    """Most triples that the mapping makes of a row of single values."""
    return 3 + len(m.properties) if isinstance(m, EntityMapping) else 3


def rows(spark: SparkSession, sf_dir: str, part: str, n: int | None = None) -> DataFrame:
    """The rows that a part's mappings read, over tasks of a bounded number of rows: each becomes several triples that are made distinct.

    n: the part's size(), if it is known.
    """
    t = lambda name: table(spark, sf_dir, name)
    if part == "orders":
        out = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"))
    elif part == "brand":
        out = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("l_orderkey", "p_brand")
    elif part == "supplier":
        out = t("supplier").join(t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    else:
        out = t(SOURCE.get(part, part))
    return spread(out, size(spark, sf_dir, part) if n is None else n)


PARTS = {"nation": NATION, "customer": CUSTOMER, "segment": SEGMENT, "orders": ORDERS, "brand": BRAND, "supplier": SUPPLIER}


def triples(spark: SparkSession, sf_dir: str, *parts: str, only: Collection[str] | None = None) -> DataFrame:
    """Distinct triples of the parts, of the predicates in `only` if given: one union, dealt out by the number of triples that its rows may become."""
    sizes = {p: size(spark, sf_dir, p) for p in dict.fromkeys(parts)}
    read = {p: rows(spark, sf_dir, p, n) for p, n in sizes.items()}
    n = sum(sizes[p] * min(per_row(m), len(only) if only else per_row(m)) for p in parts for m in PARTS[p])
    return distinct_spread(union([apply_mapping(read[p], m, p, only=only) for p in parts for m in PARTS[p]]), n)
