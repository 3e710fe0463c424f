from semlattice.operators import biblio as B
from semlattice.plans.scratch import saved

SCHEMA = "topic_idx int, pos int, topic string, " + B.WORK


def _author(i, name, *places):
    return ("first", (i and f"https://x/{i}", name, None), [(f"https://x/{p}", p.upper(), "CN") for p in places])


def _work(t, pos, topic, i, title, authors, venue="v1", doi="https://doi.org/10.1/x"):
    return (t, pos, topic, i and f"https://x/{i}", doi, title, None, 2020, 3, "article", ((venue and f"https://x/{venue}", "Venue", "journal"),), authors)


def _works(spark):
    many = [_author(f"a{i}", f"N{i}", "i1", f"i{i}") for i in range(12)]
    return spark.createDataFrame([
        _work(0, 0, "T1", "w1", "old", [_author("a1", "First", "i1"), _author(None, "?", "i99")]),
        _work(0, 1, "T1", "w2", "x" * 400, many, venue=None),
        _work(1, 0, "T2", "w1", "new", [_author("a1", "Second", "i2")]),
        _work(1, 1, None, "w3", None, None),
        _work(1, 2, "T2", None, "no id", []),
    ], SCHEMA)


def test_tables(spark, rows):
    w = _works(spark).where("id is not null")
    pubs = {r["openalex_id"]: r for r in B.publications(w).collect()}
    assert pubs["w1"]["title"] == "new" and len(pubs["w2"]["title"]) == 300 and pubs["w3"]["title"] == "" and pubs["w2"]["venue_id"] is None
    assert dict(rows(B.scholars(w).select("openalex_id", "name")))["a1"] == "First"
    seed = spark.createDataFrame([("i1", "Seed", "CN", 1, 2, 3)], "openalex_id string, name string, country string, works_count long, cited_by_count long, h_index long")
    inst = dict(rows(B.institutions(w, seed).select("openalex_id", "name")))
    assert inst["i1"] == "Seed" and inst["i2"] == "I2" and "i99" not in inst
    assert rows(B.author_of(w).where("pub_id = 'w1'")) == [("a1", "w1", "first")]
    assert rows(B.published_in(w)) == [("w1", "v1"), ("w3", "v1")]
    assert rows(B.belongs_to_field(w, B.field_dimension(spark, [("f1", "One", "T1", 0)]))) == [("w1", "f1"), ("w2", "f1")]
    assert B.affiliation(w).where("scholar_id = 'a1'").count() == 2
    assert B.rejected(_works(spark)).first()[0] == 1 and rows(B.venues(w)) == [("v1", "Venue", "journal")]


def test_tables_of_unique_works(spark, rows):
    w = _works(spark).where("id is not null")
    u = saved(B.unique_works(w))
    for table in (B.publications, B.author_of, B.published_in):
        assert rows(table(u, True)) == rows(table(w))
        assert "Aggregate" not in table(u, True)._jdf.queryExecution().executedPlan().toString()


def test_reshape_and_sets(spark, rows):
    got = {r["work_id"]: r for r in B.reshaped(_works(spark), key_prefix="V2").collect()}
    assert got["V2w1"]["domain"] == ["T1", "T2"] and got["V2w3"]["domain"] == ["其他"] and got["V2w1"]["doi"] == "10.1/x"
    assert len(got["V2w2"]["authors"]) == 10 and len(got["V2w2"]["institutions"]) == 5 and got["V2w3"]["authors"] == []
    f = spark.createDataFrame([("g", 1), ("h", 1), ("h", 2)], "g string, k int")
    s = spark.createDataFrame([("g", 1), ("g", 9), ("h", 7), ("n", 5)], "g string, k int")
    assert rows(B.filled_up(f, s, "g", "k", 2)) == [("g", 1), ("g", 9), ("h", 1), ("h", 2), ("n", 5)]
    assert rows(B.filled_up(f, s.where("k <> 1"), "g", "k", 2, replace=True)) == [("g", 9), ("h", 1), ("h", 2), ("n", 5)]
    assert rows(B.overwritten(f, s.where("g = 'h'"), "g")) == [("g", 1), ("h", 7)]
    assert rows(B.author_ids(_works(spark), 2)) == [("a0",), ("a1",)]
    concepts = spark.createDataFrame([("a", "b", None), ("a", "b", "C1")], "cn_label string, en_query string, openalex_id string")
    assert rows(B.known_concepts(concepts)) == [("C1", "b", "a")]
