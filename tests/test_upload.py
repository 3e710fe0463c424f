from semlattice.operators import lifecycle as L
from semlattice.operators.upload import Upload, upload_tables, upload_texts, usable
from semlattice.plans.config import EntityMapping, Ontology


def _table(spark, columns, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx int, " + ", ".join(f"`{c}` string" for c in columns))


COMPANY = ("company_id", "company_name")


def _ids(c):
    return sorted(r["s"] for r in L.graph(c).where("p = 'type' and o = 'Company'").collect())


def _report(r):
    return [tuple(x)[1:5] for x in r.collect()]


def test_generic_table_is_refused(spark):
    notes = _table(spark, ("note_id", "备注"), ("1", "x"))
    c, report, warnings = upload_tables([("Notes", notes), ("Companies", _table(spark, COMPANY, ("C1", "ACME")))], "up.xlsx", "upload_1")
    assert _ids(c) == ["c_C1"] and _report(report) == [(1, 0, 1, 0), (1, 1, 0, 0)] and report.first()["reason"] and warnings == []
    assert L.graph(L.withdraw(c, "upload_1")).count() == 0


def test_quota_over_tables_and_blank_keys(spark):
    two = [("A", _table(spark, COMPANY, ("C1", "x"))), ("B", _table(spark, COMPANY, ("C2", "y")))]
    c, report, _ = upload_tables(two, "f", "upload_1", Upload(max_rows=1))
    assert _ids(c) == ["c_C1"] and _report(report) == [(1, 1, 0, 0), (1, 0, 0, 1)]
    blank = _table(spark, COMPANY, ("", "x"), ("C1", "y"), ("C2", "z"))
    c, report, _ = upload_tables([("A", blank)], "f", "upload_1", Upload(max_rows=1))
    assert _ids(c) == ["c_C1"] and _report(report) == [(3, 1, 1, 1)]
    c, _, _ = upload_tables([("A", blank)], "f", "upload_1", Upload(skip_empty=False))
    assert _ids(c) == ["c_C1", "c_C2", "c_auto1"]


def test_unique_keys_and_same_entity(spark):
    c, _, _ = upload_tables([("A", _table(spark, COMPANY, ("DUP", "a"), ("DUP", "b"), ("auto2", "c")))], "f", "upload_1")
    assert _ids(c) == ["c_DUP", "c_auto2", "c_auto2_"]
    c, report, _ = upload_tables([("A", _table(spark, COMPANY, ("C1", "a"))), ("B", _table(spark, COMPANY, ("C1", "a")))], "f", "upload_1")
    assert _ids(c) == ["c_C1"] and sum(r[1] for r in _report(report)) == 2


def test_texts_and_warnings(spark):
    c = upload_texts(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id int, text string"), "upload_t", "notes.md")
    assert L.entity_count(L.graph(c)).first()[0] == 3
    good, bad = usable([EntityMapping("Company", "a", "c_{id}"), EntityMapping("Nope", "a", "c_{id}")], Ontology())
    assert len(good) == 1 and bad == ["unknown class Nope"]


def test_rows_of_a_file_in_their_order(spark, tmp_path):
    from pyspark.sql import functions as F

    from semlattice.sources import tables as S

    (tmp_path / "c.csv").write_text("company_id,company_name,tags\nC9,z,a\nC1,y,b\nC5,x,c\n", encoding="utf-8")
    frame = S.with_row_order(S.read(spark, str(tmp_path / "c.csv"))).withColumn("tags", F.array("tags"))
    c, report, _ = upload_tables([("A", frame)], "f", "upload_1", Upload(max_rows=2))
    assert _ids(c) == ["c_C1", "c_C9"] and _report(report) == [(3, 2, 0, 1)]
    both = S.sheets([("a", frame), ("b", spark.createDataFrame([(1, "q")], "company_id int, company_name string"))])
    kinds = dict(both.dtypes)
    assert kinds["tags"] == "array<string>" and kinds["row_idx"].startswith("struct") and kinds["company_id"] == "string"
