"""Each query against its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from semlattice.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def same(spark, query, sql):
    """Whether both give the same columns and rows."""
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    text = lambda d: d[sorted(d.columns)].astype(str).replace({"nan": "None", "<NA>": "None"}).sort_values(sorted(d.columns)).reset_index(drop=True)
    a, b = text(query(spark, DATA).toPandas()), text(c.sql(sql).df())
    return a.equals(b)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert same(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_routing_covers_all_turns(spark):
    got = registry.queries()["route_conversations"](spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/conversations.parquet").count() and got.where("intent is null").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_corpus_queries_are_there_or_their_files_are_not():
    """A fault inside the corpus operators must not hide behind the entry file's guard."""
    import __spark_entry__ as e

    root = Path(e.__file__).parent
    there = (root / "semlattice" / "llm").is_dir() and (root / "corpus_pipeline.py").is_file()
    assert sum(n.startswith("op") and "_" in n and n[2:].split("_")[0].isdigit() for n in e.queries()) == (13 if there else 0)
    assert ("pipeline" in e.queries()) == there
