import pytest
from graphs import graph

from semlattice.operators import lifecycle as L
from semlattice.operators.mapping import ingest
from semlattice.plans.config import EntityMapping
from semlattice.streaming.ingest import append_contributions, stream_source

NAMED = EntityMapping("Company", "id", "c_{id}", "name")


def test_withdrawal_is_exact(spark, rows):
    base = graph(spark, ("c_1", "type", "Company"))
    t = graph(spark, ("c_1", "type", "Company"), ("c_1", "name", "ACME"))
    one, two = L.contribute(t, "upload_1"), L.contribute(t, "upload_2")
    assert rows(L.graph(L.withdraw(one, "upload_1"), base)) == rows(base)
    assert rows(L.withdrawn_triples(one, "upload_1", base).select("p")) == [("name",)]
    both = one.unionByName(two)
    assert L.graph(L.withdraw(both, "upload_1")).where("p = 'name'").count() == 1
    assert L.graph(L.withdraw(L.withdraw(both, "upload_1"), "upload_2")).count() == 0
    assert L.net_new(t, base).count() == 1
    with pytest.raises(ValueError):
        L.withdraw(both, "ds_companies")


def test_partitions(spark, rows):
    t = lambda s: graph(spark, (s, "type", "Company"))
    c = L.contribute(t("a"), "x", "alice", "user_0").unionByName(L.contribute(t("b"), "x", "alice", "p1")).unionByName(L.contribute(t("c"), "x", "bob", "p1")).unionByName(L.contribute(t("d"), "x"))
    assert rows(L.visible_to(c, "alice").select("s")) == [("a",), ("b",), ("d",)]
    assert [tuple(r) for r in L.list_partitions(c, "alice").collect()] == [("user_0", 1), ("p1", 1)]
    left = L.delete_partition(c, "alice", "p1")
    assert rows(left.select("s")) == [("a",), ("c",), ("d",)]
    assert L.partition_of(c, "alice", "p1").count() == 1 and L.partition_of(c, "alice").count() == 2


def test_unique_keys(spark):
    df = spark.createDataFrame([(1, "DUP"), (2, "DUP"), (3, "auto2"), (4, None), (5, " "), (6, "auto5_")], "nr int, k string")
    assert [r["k"] for r in L.unique_keys(df, "k", "nr").orderBy("nr").collect()] == ["DUP", "auto2_", "auto2", "auto4", "auto5", "auto5_"]


def test_filters_and_quota(spark, rows):
    df = spark.createDataFrame([(0, 1, "a"), (0, 2, " "), (1, 1, "b"), (1, 2, None)], "sheet_idx int, row_idx int, v string")
    kept = L.drop_empty_rows(df, ["v"])
    assert rows(kept) == [(0, 1, "a"), (1, 1, "b")] and rows(L.drop_blank_keys(df, "v")) == rows(kept)
    assert rows(L.within_quota(kept, 1)) == [(0, 1, "a")] and L.within_quota(df, 3).count() == 3
    ok, refused = L.accepted_tables(spark.createDataFrame([("a", "Company"), ("b", "GenericRecord")], "sheet string, class string"))
    assert ok.count() == 1 and refused.first()["reason"]
    flags = spark.createDataFrame([(True, False), (True, True), (False, False)], "kept boolean, truncated boolean")
    assert tuple(L.quality_report(flags).first()) == (3, 1, 1, 1)


def test_stream_equals_batch(spark, tmp_path, rows):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "A")], "id int, name string").write.mode("append").parquet(src)
    for _ in range(2):
        append_contributions(stream_source(spark, src, "id int, name string"), [NAMED], "upload_s", "S", str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(2, "B")], "id int, name string").write.mode("append").parquet(src) if _ == 0 else None
    batch = ingest(spark.read.parquet(src), [NAMED], "upload_s", "S").dropDuplicates()
    got = L.graph(spark.read.parquet(str(tmp_path / "t")))
    assert rows(got) == rows(batch) and L.entity_count(got).first()[0] == 3
