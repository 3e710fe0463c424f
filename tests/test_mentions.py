from graphs import graph
from pyspark.sql import functions as F

from semlattice.operators import mentions as M
from semlattice.operators import query as Q
from semlattice.operators import routing as R


def _texts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")


def test_longest_match_and_overlaps(spark, rows):
    t = graph(spark, ("n1", "name", "Nation_1"), ("n12", "name", "NATION_12"), ("x", "name", "12 and"), ("y", "name", "a"))
    assert rows(M.mentions(_texts(spark, "see nation_12 and Nation_1", "nothing", "", None), t)) == [(0, "n1", "nation_1"), (0, "n12", "nation_12")]


def test_texts_of_one_id_are_apart(spark, rows):
    t = graph(spark, ("a", "name", "alpha"), ("b", "name", "alphabet"), ("c", "name", "bet"))
    texts = spark.createDataFrame([(1, "alpha"), (1, "alphabet"), (1, "alphabet")], "text_id int, text string")
    assert rows(M.mentions(texts, t)) == [(1, "a", "alpha"), (1, "b", "alphabet")]


def test_uri_comes_first(spark, rows):
    t = graph(spark, ("c_1", "type", "Company"), ("c_1", "name", "ACME"), ("c_2", "name", "Other"))
    got = M.mentions(_texts(spark, "https://example.org/resource/c_1 or Other"), t)
    assert rows(got.select("text_id", "s")) == [(0, "c_1")]


def test_country_alias(spark, rows):
    t = graph(spark, ("us", "type", "Institution"), ("us", "name", "Northeastern University"), ("us", "country", "US"), ("us", "cnLabel", "东北大学"), ("cn", "type", "Institution"), ("cn", "name", "Northeastern University"), ("cn", "country", "CN"))
    found = M.mentions(_texts(spark, "东北大学有哪些学者", "northeastern university"), t, M.alias_table(spark))
    assert rows(found.select("text_id", "s")) == [(0, "cn"), (1, "cn"), (1, "us")]
    assert rows(M.ambiguous(found)) == [(1, "northeastern university", 2)]


def test_many_keys_of_few_beginnings_are_found_by_an_automaton(spark, rows, monkeypatch):
    keys = spark.createDataFrame([(f"customer#{i:09}",) for i in range(300)] + [("cu",)], "key string")
    texts = _texts(spark, "see Customer#000000012, customer#000000400", "nothing", None)
    monkeypatch.setattr(M, "AUTOMATON_KEYS", 100)
    monkeypatch.setattr(M, "joined_spans", lambda *_: 1 / 0)
    found = M.candidate_spans(texts, keys).select("text_id", "key", "start", "end")
    assert rows(found) == [(0, "cu", 25, 27), (0, "cu", 5, 7), (0, "customer#000000012", 5, 23)]


def _routed(spark, t, *texts):
    from semlattice.operators.graph import least_class

    q = _texts(spark, *texts)
    found = M.canonical_mentions(M.mentions(q, t, M.alias_table(spark)), t, Q.no_merges(t)).join(least_class(t), "s")
    return [r["intent"] for r in R.route(q, found).orderBy("text_id").collect()]


def test_routing(spark):
    t = graph(spark, ("i", "type", "Institution"), ("i", "name", "Tsinghua University"), ("i", "country", "CN"), ("f", "type", "Field"), ("f", "name", "AI"), ("d", "type", "Industry"), ("d", "name", "Steel"))
    got = _routed(spark, t, "你好！", "清华大学校长", "张三是谁", "AI领域论文趋势", "清华大学有哪些论文", "清华大学有哪些学者", "营收最高的公司", "机构论文排名", "有哪些公司", "Steel", "", None)
    assert got == ["greeting", "unsupported", "not_found", "trend", "publications", "scholars", "numeric_rank", "relation_rank", "list_class", "entity_detail", "overview", "overview"]


def test_keyword_and_summary(spark, rows):
    q = _texts(spark, "请问知识图谱的论文有哪些", "的")
    assert [r[0] for r in q.select(M.keyword(q["text"])).collect()] == ["知识图谱", None]
    names = spark.createDataFrame([(1, "list_class", f"n{i:02}") for i in range(20)] + [(2, "x", "only")], "text_id int, intent string, name string")
    got = dict((r["text_id"], r["summary"]) for r in R.summaries(names).collect())
    assert got[2] == "1 found: only" and got[1].startswith("20 found, 15 shown: n00、")
    assert M.class_mentions(_texts(spark, "大学里的学者")).first()["classes"] == ["Scholar", "Institution"]


def test_a_request_is_answered_once(spark, rows, monkeypatch):
    """Askers of one request share its answers, also in several groups; the other questions keep theirs."""
    t = graph(spark, ("n", "type", "Institution"), ("a", "type", "Scholar"), ("a", "name", "A"), ("b", "type", "Scholar"), ("b", "name", "B"), ("a", "affiliatedWith", "n"), ("b", "affiliatedWith", "n"), ("w", "type", "Publication"), ("w", "name", "W"), ("a", "authorOf", "w"))
    asked = [(f"q{i}", "x", "scholars", ["n"], ["Scholar"], None, f"word {i}") for i in range(30)] + [("p", "x", "publications", ["a"], [], None, None), ("c", "x", "list_class", [], ["Scholar"], None, None)]
    routed = spark.createDataFrame(asked + asked[:1], "text_id string, text string, intent string, scopes array<string>, classes array<string>, metric string, keyword string")
    different, _ = R.requests(routed)
    assert different.count() == 3
    monkeypatch.setattr(R, "TOGETHER", 4)
    got = R.results(routed, t, Q.no_merges(t))
    assert rows(got) == sorted([(f"q{i}", "scholars", n) for i in range(30) for n in "AB"] + [("p", "publications", "W"), ("c", "list_class", "A"), ("c", "list_class", "B")], key=repr)
    assert rows(R.result_summaries(routed, t, Q.no_merges(t), called_by=R.WHAT)) == rows(R.summaries(got, called_by=R.WHAT))


def test_answers_are_told_in_tasks_by_their_number(spark, rows, monkeypatch):
    """500 askers of one request with 40 answers: its rows are dealt to several tasks, though few rows are joined."""
    asked = spark.range(501).select(F.when(F.col("id") < 500, "q").otherwise("r").alias("question"), F.col("id").cast("string").alias("text_id"))
    answers = spark.range(40).select(F.lit("q").alias("text_id"), F.lit("scholars").alias("intent"), F.col("id").cast("string").alias("name"))
    plain = rows(R.told(answers, asked))
    monkeypatch.setattr(R, "TOGETHER", 20)
    monkeypatch.setattr(R, "TOLD", 2000)
    out = R.told(answers, asked)
    assert rows(out) == plain and len(plain) == 20_000
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 6 and max(sizes) <= 6000


def test_a_request_of_very_many_answers_is_dealt_out(spark, rows, monkeypatch):
    """40 askers of one request with 4,000 answers: two groups of askers, but many shares of the answers."""
    asked = spark.range(40).select(F.lit("q").alias("question"), F.col("id").cast("string").alias("text_id"))
    answers = spark.range(4000).select(F.lit("q").alias("text_id"), F.lit("scholars").alias("intent"), F.col("id").cast("string").alias("name"))
    monkeypatch.setattr(R, "TOGETHER", 20)
    monkeypatch.setattr(R, "TOLD", 2000)
    out = R.told(answers, asked)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 160_000 and max(sizes) <= 20_000
    assert out.distinct().count() == 160_000 and out.join(asked, "text_id").join(answers.select("name"), "name").count() == 160_000


def test_told_answers_are_written_in_few_bytes(spark, tmp_path, monkeypatch):
    """300 askers of each of two requests with 2,500 answers of long names, which don't fit one dictionary: 1,500,000 rows in less than a byte each."""
    monkeypatch.setattr(R, "TOLD", 250_000)
    asked = spark.range(600).select(F.format_string("q%d", F.col("id") % 2).alias("question"), F.col("id").cast("string").alias("text_id"))
    answers = spark.range(5000).select(F.format_string("q%d", F.col("id") % 2).alias("text_id"), F.lit("scholars").alias("intent"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.col("id").cast("string"), 256)).alias("name"))
    R.told(answers, asked).write.parquet(f"{tmp_path}/told")
    assert spark.read.parquet(f"{tmp_path}/told").distinct().count() == 1_500_000
    written = sum(p.stat().st_size for p in (tmp_path / "told").glob("*.parquet"))
    assert written < 1_500_000, written


def test_both_ways_find_the_same_places(spark, rows, monkeypatch):
    import random

    r = random.Random(4)
    pool = ["alpha", "alphabet", "bet", "数据", "数据集", "İx", "🙂ab", "a b", "ab", "aa"]
    texts = spark.createDataFrame([(i, "".join(r.choice(pool + [" ", "A", "b"]) for _ in range(r.randint(0, 30)))) for i in range(40)] + [(1, None), (2, "")], "text_id int, text string")
    keys = spark.createDataFrame([(k,) for k in [*pool, "Alpha", "x", None, "aa"]], "key string")
    by_automaton = rows(M.candidate_spans(texts, keys))
    assert by_automaton == rows(M.joined_spans(texts, keys.where("length(key) > 1").selectExpr("lower(key) key").distinct())) and len(by_automaton) > 100
    few = keys.where("length(key) > 1").selectExpr("lower(key) key").distinct()
    assert all(rows(M.led_spans(texts, few, lead)) == by_automaton for lead in (2, 3, 16))
    monkeypatch.setattr(M, "AUTOMATON_KEYS", 3)
    assert rows(M.candidate_spans(texts, keys)) == by_automaton
    assert M.candidate_spans(texts, keys.where("false")).count() == 0
