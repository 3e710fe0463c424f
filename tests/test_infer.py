from semlattice.operators.infer import infer, mappings_of
from semlattice.operators.mapping import ingest


def _infer(spark, file, *columns):
    df = spark.createDataFrame([("s", file, None, i, c) for i, c in enumerate(columns)], "source_id string, file string, sheet string, column_idx int, column string")
    return infer(df).collect()


def test_companies(spark, rows):
    maps, summary = mappings_of(_infer(spark, "up.csv", "company_id", "company_name", "industry", "employees", "colour"))
    assert summary == {"class": "Company", "id_column": "company_id", "template": "c_{id}", "label_column": "company_name", "properties": 2, "relations": ["belongsToIndustry"], "unmapped": ["colour"]}
    df = spark.createDataFrame([("C1", "ACME", "Logistics", "5", "red")], "company_id string, company_name string, industry string, employees string, colour string")
    got = rows(ingest(df, maps, "up", "Up").select("s", "p", "o"))
    assert ("c_C1", "name", "ACME") in got and ("ind_Logistics", "type", "Industry") in got and ("c_C1", "belongsToIndustry", "ind_Logistics") in got and ("c_C1", "employees", "5") in got


def test_generic_and_keys(spark):
    _, summary = mappings_of(_infer(spark, "p.csv", "project_id", "项目名称", "负责人", "预算"))
    assert summary["class"] == "GenericRecord" and summary["unmapped"] == ["负责人", "预算"] and summary["label_column"] == "项目名称"
    maps, _ = mappings_of(_infer(spark, "scholar.csv", "id", "name", "inst_id", "pub_id"))
    assert [(m.predicate, m.subject_class, m.object_class) for m in maps[1:]] == [("affiliatedWith", "Scholar", "Institution"), ("authorOf", "Scholar", "Publication")]
    maps, _ = mappings_of(_infer(spark, "paper.csv", "id", "title", "scholar_id", "venue_id"))
    assert [(m.predicate, m.subject_class, m.object_class) for m in maps[1:]] == [("authorOf", "Scholar", "Scholar"), ("publishedIn", "Scholar", "Venue")]  # a table that names scholars is one of scholars
    maps, _ = mappings_of(_infer(spark, "corp.csv", "id", "revenue"))
    assert [m.predicate for m in maps[1:]] == ["publishedIn"]  # the keyword "venue" stands in "revenue", and that rule comes first
    assert mappings_of([]) == ([], {})
