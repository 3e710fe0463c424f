import json

from semlattice.operators import quality
from semlattice.plans.config import TRIPLES
from semlattice.sources import tables as S


def test_readers_and_catalog(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("﻿id,name\n1,\"x, y\"\n2,z\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1, "v": 2.5}, {"id": 2, "v": None}]))
    (tmp_path / "c.md").write_text("line 1\nline 2")
    assert rows(S.read(spark, str(tmp_path / "a.csv"))) == [(1, "x, y"), (2, "z")]
    assert S.read(spark, str(tmp_path / "a.csv")).columns == ["id", "name"]
    assert rows(S.tidy(S.read(spark, str(tmp_path / "b.json")))) == [(1, 2.5), (2, None)]
    assert rows(S.read(spark, str(tmp_path / "c.md")))[0][1] == "line 1\nline 2"
    catalog = S.register(spark, "one", "One", str(tmp_path / "a.csv")).unionByName(S.register(spark, "two", "Two", str(tmp_path / "none.csv"))).unionByName(S.register(spark, "three", "Three", str(tmp_path / "x.xyz")))
    assert [(r["source_id"], r["kind"], r["rows"]) for r in S.list_sources(catalog).collect()] == [("one", "csv", 2), ("three", "unparsed", 1), ("two", "unparsed", 1)]
    assert S.remove_source(catalog, "one").count() == 2
    assert S.preview(spark.range(9)).count() == 5


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'a"b,c'), (2, "d\ne")], "k int, v string")
    S.write_csv(df, str(tmp_path / "o.csv"), ["v", "k"])
    assert rows(S.read(spark, str(tmp_path / "o.csv"), "csv")) == [('a"b,c', 1), ("d\ne", 2)]
    S.write_json(df, str(tmp_path / "o.jsonl"))
    assert S.read(spark, str(tmp_path / "o.jsonl"), "jsonl").count() == 2
    S.write_table(df, str(tmp_path / "t"), "k")
    assert S.read(spark, str(tmp_path / "t"), "parquet").where("k = 1").first()["v"] == 'a"b,c'


def test_sheets(spark):
    both = S.sheets([("a", spark.createDataFrame([(1,)], "x int")), ("b", spark.createDataFrame([("q",)], "y string"))])
    assert [tuple(r) for r in both.orderBy("sheet_idx").collect()] == [(0, "a", 1, None), (1, "b", None, "q")]
    mixed = S.sheets([("a", spark.createDataFrame([(1, 2.5)], "x int, z double")), ("b", spark.createDataFrame([("q", 0.5)], "x string, z double"))])
    assert mixed.dtypes[2:] == [("x", "string"), ("z", "double")] and [tuple(r) for r in mixed.orderBy("sheet_idx").collect()] == [(0, "a", "1", 2.5), (1, "b", "q", 0.5)]


def test_ntriples(spark, rows, tmp_path):
    t = spark.createDataFrame([("a", "name", 'q"\\\n\tü', "literal", None, None), ("a", "year", "5", "literal", "integer", None), ("a", "name", "x", "literal", None, "en"), ("a", "type", "Company", "uri", None, None), ("a", "sameAs", "_:b1", "blank", None, None), ("a", "sameAs", "http://other/z", "uri", None, None)], TRIPLES)
    S.write_ntriples(t, str(tmp_path / "g.nt"))
    good, bad = S.read_ntriples(spark, str(tmp_path / "g.nt"))
    assert rows(good) == rows(t) and bad.count() == 0
    good, bad = S.parse_ntriples(spark.createDataFrame([("# note",), ("nonsense",), ("<a> <b> .",)], "value string"))
    assert good.count() == 0 and bad.count() == 2
    good, bad = S.decode_nodes(S.encode_nodes(t))
    assert rows(good) == rows(t) and bad.count() == 0
    broken = spark.createDataFrame([('["literal","x"]', '["uri","p"]', '["uri","o"]'), ('["uri","x"]', '["literal","p"]', '["uri","o"]'), ("[]", None, "x")], "s string, p string, o string")
    assert S.decode_nodes(broken)[1].count() == 3


def test_validity_and_rules(spark):
    from graphs import graph

    t = graph(spark, ("p1", "type", "Publication"), ("p1", "name", "A"), ("p1", "year", 2020), ("p2", "type", "Publication"), ("p2", "name", "B"), ("s1", "type", "Scholar"), ("s1", "authorOf", "p1"), ("s2", "type", "Scholar"))
    found = quality.violations(t)
    assert sorted((r["focus"], r["path"]) for r in found.collect()) == [("p2", "year"), ("s2", "authorOf")]
    assert tuple(quality.report(found).first()) == (False, 2) and quality.first_violations(found, 1).first()["focus"] == "p2"
    assert tuple(quality.report(found.where("false")).first()) == (True, 0)
    good, bad = quality.split_valid(t.unionByName(spark.createDataFrame([('"x"', "p", "o", "uri", None, None), (None, "p", "o", "uri", None, None)], TRIPLES)))
    assert good.count() == 8 and bad.count() == 2


ODD = ["", " ", "a", 'q"\\', "\\n", "line\nfeed\r\t", "\x01\\", "\\u0041", "\\\\u00e9", "é数🙂", "\x85 ", "a;b,c.", "'", "^^<x>", '"@en', "#", "<>{}|^`", "r:x", "_:y", "ends\\"]


def odd_triples(spark):
    literals = [(f"s{i % 4}", "name", o, "literal", None, None) for i, o in enumerate(ODD)] + [("s1", "name", o, "literal", None, "en") for o in ODD[:9]] + [("s1", "year", "5", "literal", "integer", None)]
    nodes = [(f"odd {c}", "knows", f"http://x/{c}", "uri", None, None) for c in ODD if c.strip() and not c.startswith("_:")]
    return spark.createDataFrame([*literals, *nodes, ("s1", "type", "Company", "uri", None, None), ("_:b", "sameAs", "_:c1", "blank", None, None), ("s-1", "http://p/q", "x y", "uri", None, None)], TRIPLES)


def test_all_characters_survive_ntriples_and_turtle(spark, rows, tmp_path):
    from semlattice.sources import turtle

    t = odd_triples(spark)
    good, bad = S.parse_ntriples(S.to_ntriples(t))
    assert rows(good) == rows(t.distinct()) and bad.count() == 0
    for most in (1000, 3):
        good, bad = turtle.parse_turtle(turtle.to_turtle(t, most=most))
        assert rows(good) == rows(t.distinct()) and bad.count() == 0
    turtle.write_turtle(t, str(tmp_path / "g"))
    good, bad = turtle.read_turtle(spark, str(tmp_path / "g"))
    assert rows(good) == rows(t.distinct()) and bad.count() == 0


def test_escapes_by_number_are_read(spark):
    lines = [r'<https://example.org/resource/café> <http://p> "é\U0001F642🙂\\u0041\b\f\'" .', r'<a> <b> "x\q" .']
    got = [r["o"] for r in S.parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"))[0].collect()]
    assert got == ["é🙂🙂\\u0041\b\f'", "xq"] and S.parse_ntriples(spark.createDataFrame([(lines[0],)], "value string"))[0].first()["s"] == "café"


def test_turtle_groups_and_prefixes(spark, rows):
    from semlattice.sources import turtle

    t = spark.createDataFrame([("a", "type", "Company", "uri", None, None), ("a", "name", "x", "literal", None, None), ("a", "name", "y", "literal", None, None)], TRIPLES)
    assert [r["value"] for r in turtle.to_turtle(t).collect()] == ['r:a a o:Company ; o:name "x", "y" .']
    lines = ["@prefix z: <http://z/> .", "", "# a note", 'z:a <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> z:B; z:c "1"^^<http://www.w3.org/2001/XMLSchema#integer>,"2"@de.', "nonsense here", 'r:a o:b "open .']
    good, bad = turtle.parse_turtle(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(good) == [("http://z/a", "http://z/c", "1", "literal", "integer", None), ("http://z/a", "http://z/c", "2", "literal", None, "de"), ("http://z/a", "type", "http://z/B", "uri", None, None)] and bad.count() == 2


def test_bad_records_are_kept_apart(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,v\n1,"x, y",2.5\nz,broken,1\n3,three\n4,four,4,more\n5,,\n', encoding="utf-8")
    good, bad = S.read_checked(spark, str(tmp_path / "a.csv"), "csv", "id int, name string, v double")
    assert rows(good) == [(1, "x, y", 2.5), (5, None, None)]
    assert [r["record"] for r in bad.orderBy("row_idx").collect()] == ["z,broken,1", "3,three", "4,four,4,more"] and bad.first()["row_idx"]["file"].endswith("a.csv")
    (tmp_path / "b.jsonl").write_text('{"id": 1, "w": {"t": ["a", "b"]}}\n{"id": "x"\n{"id": "two"}\n{"id": 4, "w": 5}\n{"id": 6}\n')
    good, bad = S.read_checked(spark, str(tmp_path / "b.jsonl"), "jsonl", "id int, w struct<t:array<string>>")
    assert sorted(r["id"] for r in good.collect()) == [1, 6] and bad.count() == 3
    (tmp_path / "e.jsonl").write_text("")
    good, bad = S.read_checked(spark, str(tmp_path / "e.jsonl"), "jsonl", "id int")
    assert good.count() == bad.count() == 0
