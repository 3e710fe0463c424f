import pytest

from semlattice.operators import mapping as M
from semlattice.plans.config import EntityMapping, Property, RelationMapping

COMPANY = EntityMapping("Company", "id", "c_{id}", "name", (Property("rev", "revenue", "decimal"), Property("emp", "employees", "integer")))


def test_entity(spark, rows):
    df = spark.createDataFrame([("1", "A;B", "3.5", "x"), (None, "skip", "1", "1"), (" ", "skip", "1", "1")], "id string, name string, rev string, emp string")
    got = rows(M.entity_triples(df, COMPANY, "s").select("s", "p", "o", "o_datatype"))
    assert got == [("c_1", "name", "A;B", None), ("c_1", "revenue", "3.5", "decimal"), ("c_1", "sourcedFrom", "ds_s", None), ("c_1", "type", "Company", None)]


def test_multi_value_zips_labels(spark, rows):
    df = spark.createDataFrame([("1;2", "A;B")], "id string, name string")
    got = rows(M.entity_triples(df, EntityMapping("Company", "id", "c_{id}", "name", multi_value=True), "s").where("p = 'name'").select("s", "o"))
    assert got == [("c_1", "A"), ("c_2", "B")]


def test_relation_from_value(spark, rows):
    df = spark.createDataFrame([("1", "IT;Law"), ("2", None)], "id string, ind string")
    m = RelationMapping("belongsToIndustry", "Company", "id", "c_{id}", "Industry", "ind", "ind_{id}", from_value=True, multi_object=True)
    got = rows(M.relation_triples(df, m, "s").select("s", "p", "o"))
    assert ("c_1", "belongsToIndustry", "ind_Law") in got and ("ind_IT", "name", "IT") in got and ("ind_IT", "type", "Industry") in got and len(got) == 6


def test_validation(spark):
    bad = EntityMapping("Nothing", "id", "x_{id}", None, (Property("a", "colour"),))
    assert M.validate([bad, RelationMapping("knows", "Company", "a", "c_{id}", "Industry", "b", "i_{id}")]) == ["unknown class Nothing", "unknown property colour", "unknown relation knows"]
    with pytest.raises(ValueError, match="unknown class"):
        M.apply_mapping(spark.range(1), bad, "s")


def test_build_is_distinct_and_order_free(spark, rows):
    df = spark.createDataFrame([("1", "A", "1", "2"), ("1", "A", "1", "2")], "id string, name string, rev string, emp string")
    one = [("a", "A", df, [COMPANY])]
    two = [("b", "B", df, [COMPANY])]
    assert rows(M.build_graph(one + two)) == rows(M.build_graph(two + one))
    assert M.build_graph(one).count() == 7
    counts = M.emitted_counts(M.ingest(df, [COMPANY], "a", "A").selectExpr("'a' as source_id", "*")).first()
    assert (counts["emitted"], counts["triples"]) == (12, 7)


def test_documents(spark, rows):
    df = spark.createDataFrame([(1, "x" * 2000), (2, None), (None, "y")], "doc_id long, text string")
    got = M.document_triples(df, "up")
    assert {r["s"]: len(r["o"]) for r in got.where("p = 'description'").collect()} == {"doc_1": 1500}
    assert got.where("p = 'type'").count() == 2
