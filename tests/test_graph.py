import pytest
from graphs import company, graph

from semlattice.operators import equivalence as E
from semlattice.operators import graph as G
from semlattice.operators import query as Q
from semlattice.operators.components import components


def _canonical(spark, t):
    return E.canonical(E.inferred_pairs(E.fingerprints(t), t, ("ds_1", "c_"), ("ds_2", "c2_")))


def test_equivalence_and_idempotent_links(spark, rows):
    t = graph(spark, *company("c_1", "ds_1"), *company("c2_1", "ds_2", revenue="100"))
    pairs = E.inferred_pairs(E.fingerprints(t), t, ("ds_1", "c_"), ("ds_2", "c2_"))
    assert rows(pairs) == [("c_1", "c2_1")]
    assert rows(E.canonical(pairs)) == [("c2_1", "c2_1"), ("c_1", "c2_1")]
    links = E.new_links(t, pairs)
    assert links.count() == 1
    assert E.new_links(t.unionByName(links), pairs).count() == 0


@pytest.mark.parametrize("change", [{"region": "BJ"}, {"revenue": "99"}, {"employees": "8"}, {"employees": None}, {"revenue": "nan"}, {"name": " "}])
def test_equivalence_refused(spark, change):
    t = graph(spark, *company("c_1", "ds_1"), *company("c2_1", "ds_2", **change))
    assert _canonical(spark, t).count() == 0


def test_equivalence_needs_unique_sides_and_sources(spark):
    t = graph(spark, *company("c_1", "ds_1"), *company("c_2", "ds_1"), *company("c2_1", "ds_2"))
    assert _canonical(spark, t).count() == 0
    assert _canonical(spark, graph(spark, *company("c_1", "ds_1"), *company("c2_1", "ds_1"))).count() == 0


def test_explicit_pairs_are_companies(spark, rows):
    t = graph(spark, ("a", "type", "Company"), ("b", "type", "Company"), ("s", "type", "Scholar"), ("a", "sameAs", "b"), ("a", "sameAs", "s"))
    assert rows(E.explicit_pairs(t)) == [("a", "b")]


def test_components_of_a_chain_a_hub_and_nothing(spark, rows):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(7, 7), (None, 3)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _school(spark):
    t = [("i1", "type", "Institution"), ("i1", "name", "X"), ("i2", "type", "Institution"), ("f1", "type", "Field"), ("f1", "name", "AI")]
    for s in ("s1", "s2"):
        t += [(s, "type", "Scholar"), (s, "name", s.upper()), (s, "affiliatedWith", "i1")]
    for i in range(35):
        t += [(f"p{i:02}", "type", "Publication"), (f"p{i:02}", "name", "same title"), (f"p{i:02}", "year", 2000 + i % 3), ("s1", "authorOf", f"p{i:02}"), ("s2", "authorOf", f"p{i:02}")]
        t += [(f"p{i:02}", "belongsToField", "f1")] if i < 4 else []
    return graph(spark, *t, ("s1", "authorOf", "untyped"))


def test_publications_scopes_trend_ranking(spark, rows):
    t = _school(spark)
    pubs = Q.publications_for(t)
    assert pubs.where("entity = 'i1'").count() == 35 and pubs.where("entity = 'f1'").count() == 4
    both = Q.in_all_scopes(pubs, spark.createDataFrame([(1, "i1"), (1, "f1")], "question int, entity string"))
    assert both.count() == 4
    assert rows(Q.year_distribution(t, pubs=both)) == [(2000, 2), (2001, 1), (2002, 1)]
    assert rows(Q.year_distribution(t, field="AI")) == [(2000, 2), (2001, 1), (2002, 1)]
    assert [tuple(r) for r in Q.institution_ranking(t).collect()] == [("i1", "X", 35), ("i2", "i2", 0)]
    assert [tuple(r) for r in Q.institution_ranking(t, field="f1").collect()] == [("i1", "X", 4), ("i2", "i2", 0)]
    assert [tuple(r) for r in Q.scholar_ranking(t).collect()] == [("s1", "S1", 35), ("s2", "S2", 35)]
    first = Q.search_publications(t, Q.no_merges(t), "SAME", 30)
    assert first.count() == 30 and first.first()["total"] == 35 and first.first()["has_more"]
    assert rows(Q.coauthor_edges(t)) == [("s1", "s2"), ("s2", "s1")]
    assert Q.coauthor_edges(t, max_authors=1).count() == 0
    assert rows(Q.scholars_of(t, Q.no_merges(t), "i1", "f1")) == [("s1",), ("s2",)]
    assert rows(Q.papers_per_field(t)) == [("AI", 4)]
    assert rows(Q.resolve_by_label(t, "A")) == [("f1",)]
    assert Q.field_members(t, Q.no_merges(t), "f1", ["Publication"]).count() == 4
    assert rows(Q.scholars_query(t, institution="x", field="ai")) == []


def test_aliases_count_once(spark, rows):
    t = graph(spark, *company("c_1", "ds_1"), *company("c2_1", "ds_2"), *company("c_9", "ds_1", name="Other"), ("c_1", "cnLabel", "甲公司"), ("c2_1", "belongsToIndustry", "ind_1"), ("c_1", "belongsToIndustry", "ind_1"), ("ind_1", "type", "Industry"), ("ind_1", "name", "Steel"))
    canon = _canonical(spark, t)
    assert [tuple(r)[:2] for r in Q.find_entity(t, canon, "Company", "甲").collect()] == [("c2_1", "Company")]
    assert rows(G.list_ontology(t, canon)) == [("Company", 2, 3), ("Industry", 1, 1)]
    assert [tuple(r) for r in Q.explore_class(t, canon, "Company").collect()] == [("c2_1", "ACME", 2, 3), ("c_9", "Other", 2, 3)]
    member = Q.industry_members(t, canon, "ind_1").collect()
    assert [(r["s"], r["revenue"], r["employees"], r["n"], r["raw_n"]) for r in member] == [("c2_1", 100.0, 7, 1, 2)]
    assert rows(Q.count_by_relation(t, canon, "Company", "belongsToIndustry", "Industry")) == [("ind_1", "Steel", 1)]
    detail = Q.entity_detail(t, canon, spark.createDataFrame([("c_1",)], "uri string"))
    assert ("c_1", "relation", "belongsToIndustry", "Steel", "ind_1") in rows(detail) and ("c_1", "property", "cnLabel", "甲公司", None) in rows(detail)
    assert ("c_1", "name", "ACME") in rows(Q.properties_of(t, canon, spark.createDataFrame([("c_1",)], "uri string")))
    assert rows(G.aliases(spark.createDataFrame([("c_1",), ("c_9",)], "uri string"), canon)) == [("c_1", "c2_1"), ("c_1", "c_1"), ("c_9", "c_9")]
    assert rows(Q.numeric_summary(t, canon, "Company", "revenue")) == [("c2_1", "ACME", 100.0), ("c_9", "Other", 100.0)]
    assert rows(Q.class_names(t)) == [("Steel",)]
    assert rows(Q.companies_in_industry(t, "steel").select("s")) == [("c2_1",), ("c_1",)]


def test_patterns(spark, rows):
    t = graph(spark, ("a", "type", "Scholar"), ("a", "name", "INSERT"), ("a", "affiliatedWith", "i"), ("b", "affiliatedWith", "i"), ("i", "name", "X"))
    assert G.ask(t, [("a", "name", "?n")]).first()[0] and not G.ask(t, [("z", "name", "?n")]).first()[0]
    assert rows(G.match(t, [("?s", "name", "INSERT")])) == [("a",)]
    got = G.match(t, [("?s", "affiliatedWith", "?i"), ("?i", "name", "?place")], [[("?s", "name", "?n")]])
    assert rows(G.tabulate(got.select("s", "place", "n"))) == [("a", "X", "INSERT"), ("b", "X", "")]
    assert rows(G.construct(got, [("?i", "hosts", "?s")]).select("s", "p", "o")) == [("i", "hosts", "a"), ("i", "hosts", "b")]
    assert G.describe(t, spark.createDataFrame([("a",)], "uri string")).count() == 3
    assert rows(G.scan(t, ("?x", "?p", "?x"))) == []
    assert tuple(G.stats(t).first()) == (5, 1)


def test_patterns_in_any_order(spark, rows):
    t = graph(spark, ("a", "affiliatedWith", "i"), ("b", "affiliatedWith", "j"), ("a", "name", "A"), ("i", "name", "I"), ("j", "name", "J"))
    # the first two share no variable
    got = G.match(t, [("?s", "name", "?n"), ("?i", "name", "?place"), ("?s", "affiliatedWith", "?i")])
    assert got.columns == ["s", "n", "i", "place"] and rows(got) == [("a", "A", "i", "I")]
    assert rows(G.match(t, [("?s", "affiliatedWith", "?i"), ("a", "name", "A")])) == [("a", "i"), ("b", "j")]
    assert G.match(t, [("?s", "affiliatedWith", "?i"), ("a", "name", "other")]).count() == 0
    assert [tuple(r) for r in G.match(t, [("?s", "affiliatedWith", "?i")], order=["i"], limit=1).collect()] == [("a", "i")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    for patterns, optional in (([("?a", "name", "?n"), ("?b", "affiliatedWith", "?i")], []), ([("?a", "name", "?n")], [[("?b", "affiliatedWith", "?i")]])):
        with pytest.raises(ValueError):
            G.match(t, patterns, optional)


def test_authors_in_blocks(spark, rows):
    t = graph(spark, *[(f"s{i}", "authorOf", "p") for i in range(40)], ("s0", "authorOf", "q"), ("s99", "authorOf", "q"))
    want = sorted((f"s{i}", f"s{j}") for i in range(40) for j in range(40) if i != j) + [("s0", "s99"), ("s99", "s0")]
    assert rows(Q.coauthor_edges(t, block=7)) == sorted(want) == rows(Q.coauthor_edges(t))


def test_pairs_go_to_tasks_of_a_bounded_number(spark, rows):
    t = graph(spark, *[(f"s{i}", "authorOf", f"p{i * j % 90}") for i in range(60) for j in range(1, 8)])
    got = Q.coauthor_edges(t, each=30)
    assert rows(got) == rows(Q.coauthor_edges(t))
    # more tasks than the session's four partitions, for works as for pairs
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pub" in plan and "hashpartitioning(a" in plan and plan.count("REPARTITION_BY_NUM") >= 2


def test_names_and_classes_read_their_predicates_only(spark, tmp_path):
    t = graph(spark, ("a", "type", "Scholar"), ("a", "name", "A"), ("a", "year", 1))
    t.write.partitionBy("p").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for df in (G.names(stored), G.least_class(stored), G.called(G.types(stored).select("s"), stored)):
        assert "PartitionFilters: [isnotnull(p" in df._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [p" in df._jdf.queryExecution().executedPlan().toString()


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from semlattice.plans.scratch import folder

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError):
        folder(spark)


def test_broadcast_is_checked_by_bytes(spark):
    from semlattice.plans import scratch

    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "x" * 100)], "k int, v string")
    kind = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in kind(scratch.join_checked(left, right, "k"))
    kept, scratch.BROADCAST_BYTES = scratch.BROADCAST_BYTES, 50
    assert "SortMergeJoin" in kind(scratch.join_checked(left, right, "k"))
    scratch.BROADCAST_BYTES = kept


def test_pages(spark):
    df = spark.range(35)
    p = Q.page(df, ["id"], 10, 30)
    assert [r["id"] for r in p.collect()] == list(range(30, 35)) and not p.first()["has_more"]
    assert [r["id"] for r in Q.page_after(df, "id", 3, 2).collect()] == [4, 5]
    with pytest.raises(ValueError):
        Q.page(df, ["id"], 0)


def test_quota(spark):
    log = spark.createDataFrame([(1, "a", "k", "2024-01-01 01:00:00"), (2, "a", "k", "2024-01-01 02:00:00"), (3, "a", "k", "2024-01-02 01:00:00"), (4, "b", "?", "2024-01-01 01:00:00")], "id int, client string, cls string, ts string")
    assert [r["admitted"] for r in Q.daily_quota(log, {"k": 1}).orderBy("id").collect()] == [True, False, True, False]
