"""The index of labels, patterns by statistics, and the dictionary of terms, against the plain operators."""

import random

import pytest
from graphs import graph
from pyspark.sql import functions as F

from semlattice.operators import graph as G
from semlattice.operators import query as Q
from semlattice.operators import terms as T
from semlattice.operators import textindex as I
from semlattice.plans.config import TRIPLES
from semlattice.plans.scratch import saved


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(3)
    words = ["Acme", "ACME", "İstanbul", "straße", "数据公司", "知识图谱", "a", "🙂ab", "o'Neil", "x\ty", "%_", "n12"]
    rows = []
    for i in range(120):
        rows.append((f"e{i:03}", "type", r.choice(["Company", "Field", "Scholar"]), "uri", None, None))
        for _ in range(r.randint(0, 3)):
            rows.append((f"e{i:03}", r.choice(["name", "name", "cnLabel"]), "".join(r.choice(words) for _ in range(r.randint(0, 3))), "literal", None, None))
    rows += [("untyped", "name", "Acme", "literal", None, None), ("e000", "type", "Field", "uri", None, None)]
    return saved(spark.createDataFrame(rows, TRIPLES), "p")


@pytest.fixture(scope="module")
def merges(spark):
    return spark.createDataFrame([("e001", "e001"), ("e002", "e001"), ("e003", "e001"), ("e050", "e050"), ("e051", "e050")], "uri string, canonical_uri string")


def test_the_index_finds_what_the_search_finds(spark, rows, labelled, merges, monkeypatch, tmp_path):
    monkeypatch.setattr(I, "PART_ROWS", 1)
    monkeypatch.setattr(I, "PARTS", 7)
    I.build(labelled, merges, f"{tmp_path}/index")
    index = I.opened(spark, f"{tmp_path}/index")
    assert index.folders == 7
    for keyword in ("M", "me", "cmea", "数据", "知识图谱", "İ", "🙂a", "\t", "nothing", "acmeacmeacme", ""):
        assert rows(I.search(index, keyword)) == rows(Q.search(labelled, merges, keyword)), keyword
    assert rows(I.search(index, "ac", "Field")) == rows(Q.search(labelled, merges, "ac", "Field"))


def test_a_search_reads_few_files(spark, labelled, monkeypatch):
    many = spark.range(4000).selectExpr("concat('p', id) s", "explode(array(struct('type' p, 'Company' o, 'uri' k), struct('name' p, concat('firm no ', id) o, 'literal' k))) x").selectExpr("s", "x.p", "x.o", "x.k o_kind", "cast(null as string) o_datatype", "cast(null as string) o_lang")
    monkeypatch.setattr(I, "PART_ROWS", 100)
    index = I.build(many, Q.no_merges(many))
    assert index.folders == 40 and I.search(index, "no 3999").count() == 1
    found = I.candidates(index, "no 3999")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # folders by the gram's bucket, row groups by the gram
    assert " IN (8,20,62)]" in plan and "PushedFilters: [In(gram" in plan
    assert I.candidates(index, "zzz").count() == 0 and sum(1 for _ in I.search(index, "firm no").collect()) == 4000


def test_postings_are_the_distinct_grams_of_an_entitys_labels(spark):
    texts = [(1, "aaaaaa"), (1, "aAa"), (1, None), (2, "数据🙂\0\0"), (3, ""), (4, "b"), (5, "İİ xyxyxy")]
    labels = spark.createDataFrame(texts, "entity long, label string").repartition(3)
    want = labels.select(F.explode(I.grams_of(F.lower("label"))).alias("gram"), "entity").where("gram <> ''").distinct().collect()
    got = I.postings_of(labels).select("gram", F.explode("entities"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    # entities of one label are not shuffled
    assert "Exchange" not in _plan(I.postings_of(saved(labels.where("entity > 1"))))


def test_an_empty_index(spark, labelled):
    index = I.build(labelled.where("false"), Q.no_merges(labelled))
    assert I.search(index, "acme").count() == 0 and I.search(index, "").count() == 0


# ---- patterns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics(spark, rows):
    t = graph(spark, ("a", "type", "X"), ("b", "type", "X"), ("c", "type", "Y"), ("a", "knows", "b"), ("a", "knows", "c"))
    s = G.statistics(t, exact=True)
    assert rows(s.predicates) == [("knows", 2, 1, 2), ("type", 3, 3, 2)]
    assert rows(s.objects) == [("knows", "b", 1), ("knows", "c", 1), ("type", "X", 2), ("type", "Y", 1)]


def test_selective_patterns_come_first(spark, rows):
    people = [x for i in range(300) for x in ((f"p{i}", "type", "Person"), (f"p{i}", "livesIn", f"town{i % 30}"), (f"p{i}", "name", f"n{i}"))]
    towns = [x for i in range(30) for x in ((f"town{i}", "type", "Town"), (f"town{i}", "name", f"T{i}"))]
    t = graph(spark, *people, *towns, ("town3", "twinOf", "town4"))
    sizes = G.statistics(t, exact=True)
    asked = [("?p", "name", "?n"), ("?p", "type", "Person"), ("?p", "livesIn", "?t"), ("?t", "twinOf", "?u"), ("?u", "name", "T4")]
    ordered = G._in_order(asked, G._Estimates(sizes, asked))
    assert set(ordered[:2]) == {asked[3], asked[4]} and ordered[2] == asked[2]
    got = G.match(t, asked, sizes=sizes)
    assert rows(got) == rows(G.match(t, asked)) and got.count() == 10
    estimates = G._Estimates(sizes, asked)
    assert estimates.rows(asked[1]) == 300 and estimates.rows(("?x", "type", "Town")) > 0 and estimates.rows(("?x", "nothing", "?y")) == 0


def test_random_patterns_agree_with_and_without_statistics(spark, rows, monkeypatch):
    r = random.Random(8)
    t = graph(spark, *{(f"n{r.randrange(12)}", f"p{r.randrange(4)}", f"n{r.randrange(12)}") for _ in range(90)})
    sizes = G.statistics(t)
    monkeypatch.setattr(G, "REDUCING", 25)
    term = lambda kinds: r.choice([f"?{r.choice('abc')}"] * 3 + kinds)
    done = 0
    while done < 6:
        asked = [(term(["n1", "n2"]), term(["p0", "p1", "p2", "p3"]), term(["n3", "n4"])) for _ in range(r.randint(1, 3))]
        try:
            got = G.match(t, asked, sizes=sizes)
        except ValueError:
            continue
        assert rows(got) == rows(G.match(t, asked)), asked
        done += 1


def test_fixed_triples_are_filters(spark, rows):
    t = graph(spark, ("a", "p", "b"), ("b", "p", "c"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = G.match(t, [("a", "p", "b"), ("?x", "p", "?y")])
        assert "NestedLoop" not in _plan(got) and "Cartesian" not in _plan(got) and "BroadcastExchange" not in _plan(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(got) == [("a", "b"), ("b", "c")]
    assert G.match(t, [("a", "p", "c"), ("?x", "p", "?y")]).count() == 0 and G.match(t, [("a", "p", "c"), ("?x", "p", "?y")]).columns == ["x", "y"]
    assert rows(G.match(t, [("a", "p", "b"), ("b", "p", "c")])) == [(True,)] and G.match(t, [("a", "p", "b"), ("a", "p", "c")]).count() == 0
    assert G.ask(t, [("a", "p", "b")]).first()["answer"] is True and G.ask(t, [("a", "p", "z")]).first()["answer"] is False


# ---- terms


@pytest.fixture(scope="module")
def works(spark):
    r = random.Random(4)
    rows = [(f"i{i}", "type", "Institution") for i in range(6)] + [(f"f{i}", "type", "Field") for i in range(4)] + [(f"f{i}", "name", f"Field {i % 3}") for i in range(4)] + [(f"i{i}", "name", f"Inst {i}") for i in range(5)] + [("i5", "cnLabel", "五")]
    for i in range(40):
        rows += [(f"s{i}", "type", "Scholar"), (f"s{i}", "affiliatedWith", f"i{r.randrange(5)}")] + ([(f"s{i}", "name", f"N{i % 7}")] if i % 3 else [])
    for i in range(90):
        rows += [(f"w{i}", "type", "Publication"), (f"w{i}", "year", 2000 + i % 9)] + [(f"s{r.randrange(40)}", "authorOf", f"w{i}") for _ in range(3)] + [(f"w{i}", "belongsToField", f"f{r.randrange(4)}")]
    return saved(graph(spark, *dict.fromkeys(rows), ("w1", "sameAs", "_:b")), "p")


def test_ids_follow_the_terms_and_lead_back(spark, rows, works):
    g = T.encoded(works)
    ids = [r["term"] for r in g.terms.orderBy("id").collect()]
    assert ids == sorted(ids) and [r["id"] for r in g.terms.orderBy("id").collect()] == list(range(len(ids)))
    assert rows(T.triples(g)) == rows(works.select(TRIPLES.fieldNames())) and g.ids("i1", "absent")["absent"] == -1
    assert dict(g.edges.dtypes)["s"] == dict(g.edges.dtypes)["o"] == "bigint"


def test_rankings_over_ids(spark, rows, works):
    g = T.encoded(works)
    plain = lambda df: [tuple(r) for r in df.collect()]
    assert plain(T.institution_ranking(g)) == plain(Q.institution_ranking(works)) and len(plain(T.institution_ranking(g))) == 6
    assert plain(T.institution_ranking(g, 3, field="f2")) == plain(Q.institution_ranking(works, 3, field="f2"))
    assert plain(T.scholar_ranking(g, 7)) == plain(Q.scholar_ranking(works, 7))
    assert plain(T.papers_per_field(g)) == plain(Q.papers_per_field(works))
    assert rows(T.relation(g, "affiliatedWith")) == rows(Q.query_relation(works, Q.no_merges(works), "Scholar", "affiliatedWith", "Institution"))
    assert T.institution_ranking(g, institution="Nothing").count() == 0


def test_joins_over_ids_shuffle_less_than_half(spark, works):
    """Bytes that the ranking's joins and aggregates shuffle, over stored terms and over stored ids."""
    from pyspark.sql import functions as F

    far = lambda c: F.concat(F.lit("https://example.org/resource/with/a/path/"), c)
    long = saved(works.withColumn("o", F.when((F.col("o_kind") == "uri") & (F.col("p") != "type"), far("o")).otherwise(F.col("o"))).withColumn("s", far("s")), "p")
    g = T.encoded(long)

    def shuffled(df):
        df.collect()
        total, stack = 0, [df._jdf.queryExecution().executedPlan()]
        while stack:
            node = stack.pop()
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                stack.append(node.executedPlan())
                continue
            if name.endswith("QueryStageExec"):
                stack.append(node.plan())
            if name == "ShuffleExchangeExec":
                total += node.metrics().apply("dataSize").value()
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
        return total

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_terms = shuffled(Q.most_published(long, "institution", 30))
        by_ids = shuffled(Q.most_published(g.edges, "institution", 30, **T._classes(g, {})))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < by_ids < by_terms / 2


def test_rankings_over_a_dictionary_of_many_small_tasks(spark, rows, monkeypatch):
    """Tasks are dealt by the number of triples, also where one term stands in very many; both rankings are those over terms."""
    people = [x for i in range(60) for x in ((f"a{i}", "type", "Scholar"), (f"a{i}", "affiliatedWith", f"n{min(i % 7, 2)}"), (f"w{i}", "type", "Publication"), (f"a{i % 11}", "authorOf", f"w{i}"))]
    t = saved(graph(spark, *people, *[(f"n{i}", "type", "Institution") for i in range(4)], *[(f"n{i}", "name", f"Nation {i}") for i in range(4)]), "p")
    monkeypatch.setattr(T, "EACH", 20)
    g = T.encoded(t)
    assert len({f for f in g.edges.inputFiles() if "p=type" in f}) > 4  # more than the session's shuffle partitions
    want = rows(Q.institution_ranking(t))
    assert len(want) == 4 and rows(T.institution_ranking(g)) == want and rows(T.institution_ranking_by_bitmaps(g, T.institution_bitmaps(g))) == want
