"""Queries that show balances as text, against their SQL on customers with zeros of both signs."""

import duckdb
import pytest

from semlattice.plans import registry

QUERIES = (
    "describe_entities",
    "entity_detail",
    "entity_detail_all",
    "map_customer_triples",
    "merged_entity_detail",
    "merged_predicate_objects",
    "merged_properties_of",
    "ntriples_round_trip",
    "properties_of",
    "stream_of_files",
)


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Twelve customers, of which every third has a balance of 0.0, -0.0 or another."""
    path = tmp_path_factory.mktemp("zeros")
    duckdb.sql(f"""
      COPY (SELECT i AS c_custkey, 'Customer ' || i AS c_name, CAST(i % 2 AS INTEGER) AS c_nationkey, CASE i // 4 WHEN 0 THEN CAST('-0.0' AS DOUBLE) WHEN 1 THEN 0.0 ELSE -0.5 * i END AS c_acctbal,
        'SEGMENT' || i % 2 AS c_mktsegment FROM range(12) r(i)) TO '{path}/customer.parquet' (FORMAT parquet)
    """)
    duckdb.sql(f"COPY (SELECT CAST(i AS INTEGER) AS n_nationkey, 'NATION_' || i AS n_name, 0 AS n_regionkey FROM range(2) r(i)) TO '{path}/nation.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", QUERIES)
def test_a_zero_keeps_its_sign(spark, rows, zeros, name):
    c = duckdb.connect()
    for table in ("customer", "nation"):
        c.execute(f"create view {table} as select * from '{zeros}/{table}.parquet'")
    got = registry.queries()[name](spark, zeros)
    want = c.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert any("-0.0" in r for r in want)
    assert rows(got) == sorted(want, key=repr)
