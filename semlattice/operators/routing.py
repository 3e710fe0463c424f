"""Batch routing of questions: intents by ordered rules over what the questions mention, and summaries of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import saved
from . import query
from .graph import called, canonical_of, labels, types
from .mentions import ambiguous, candidate_spans, class_mentions, keyword, residual

# Words that lead to an intent.
GREETING = r"(?i)^(你好|您好|嗨|hello|hi|谢谢|感谢)[！!。？?\s]*$"
UNSUPPORTED = ("生日", "出生", "年龄", "电话", "邮箱", "住址", "校长", "院长", "董事长", "联系方式", "毕业时间", "毕业年份")
WHO = ("是谁", "介绍", "详情", "校友", "毕业生")
TREND = ("趋势", "逐年", "每年", "按年", "分布", "增长")
TREND_STRICT = ("趋势", "逐年", "每年", "按年")
RANKING = ("排名", "最多", "最高", "排行", "最大", "top", "Top")
TITLE = ("论文", "文献", "研究")
METRICS = ((("营收", "收入"), "revenue"), (("员工", "人数"), "employees"), (("引用", "被引"), "cited_by_count"), (("h指数", "h_index"), "hIndex"))
#: What the results of an intent are called.
WHAT = {"publications": "publications", "scholars": "scholars", "entity_detail": "facts", "field_members": "members", "industry_companies": "companies", "list_class": "entities", "search_entities": "entities", "search_publications": "publications"}


def _has(words: tuple[str, ...], c: str = "text") -> Column:
    return F.coalesce(F.array_max(F.array(*[F.contains(c, F.lit(w)) for w in words])), F.lit(False))


def route(questions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(text_id, text, intent, scopes, classes, metric, keyword) of each question (text_id, text).

    mentions: canonical ones (text_id, s, label, class). scopes: the entities mentioned. The
    first rule that holds decides. Null text counts as an empty question. Each intent is then
    one operator over all its questions, joined by text_id.
    """
    asked = questions.select("text_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    scoped = mentions.groupBy("text_id").agg(F.array_sort(F.collect_set("s")).alias("scopes"), F.collect_set("class").alias("kinds"))
    doubt = ambiguous(mentions).groupBy("text_id").agg(F.lit(True).alias("ambiguous"))
    q = residual(class_mentions(asked), mentions).join(scoped, "text_id", "left").join(doubt, "text_id", "left")
    q = q.withColumn("keyword", keyword(F.col("text"))).withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>"))).withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    any_scope, left, ranking = F.size("scopes") > 0, F.col("residual") != "", _has(RANKING)
    asks = lambda c: F.array_contains("classes", c)
    about = lambda c: F.array_contains("kinds", c)
    metric = F.lit(None).cast("string")
    for words, prop in reversed(METRICS):
        metric = F.when(_has(words), F.lit(prop)).otherwise(metric)
    intent = (
        F.when(F.col("text").rlike(GREETING), "greeting")
        .when(_has(UNSUPPORTED), "unsupported")
        .when(F.coalesce("ambiguous", F.lit(False)), "ambiguous")
        .when(~any_scope & _has(WHO), "not_found")
        .when(left & ~ranking & (any_scope | _has(TREND_STRICT)), "not_found")
        .when(_has(TREND), "trend")
        .when(any_scope & asks("Publication") & ~ranking, "publications")
        .when(any_scope & asks("Scholar") & (about("Institution") | about("Field")) & ~ranking, "scholars")
        .when(any_scope & ~ranking & (F.size("classes") == 0), "entity_detail")
        .when(ranking & F.col("metric").isNotNull(), "numeric_rank")
        .when(ranking, "relation_rank")
        .when(about("Industry"), "industry_companies")
        .when(about("Field"), "field_members")
        .when(F.col("keyword").isNotNull() & _has(TITLE), "search_publications")
        .when((F.size("classes") > 0) & left, "not_found")
        .when((F.size("classes") > 0) & any_scope, "unsupported")
        .when(F.size("classes") > 0, "list_class")
        .when(F.col("keyword").isNotNull(), "search_entities")
        .otherwise("overview")
    )
    return q.withColumn("metric", metric).withColumn("intent", intent).select("text_id", "text", "intent", "scopes", "classes", "metric", "keyword")


# ---- questions that ask for the same

#: What decides the answer to a question of an intent; every intent but these is answered by its name alone.
SCOPED = ("publications", "scholars", "entity_detail", "field_members", "industry_companies", "trend")
CLASSED = ("list_class", "relation_rank")
WORDED = ("search_entities", "search_publications")
MEASURED = ("numeric_rank",)
#: Questions with one request that meet a share of its answers in one group of a join.
TOGETHER = 400
#: Rows that a task of told() gives, about.
TOLD = 2_000_000


def requests(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, asked): the different requests as routed questions, and (question, text_id) of who asks for each.

    A request has the columns of route() without a text; text_id is a digest of its intent and of what decides
    its answer, so questions in other words, or of other keywords where none is used, are one request.
    """
    of = lambda kinds, c: F.when(F.col("intent").isin(*kinds), c)
    plain = routed.select(
        F.col("text_id").alias("asker"), "intent", of(SCOPED, F.array_sort(F.array_distinct("scopes"))).alias("scopes"), of(CLASSED, F.array_sort(F.array_distinct("classes"))).alias("classes"),
        of(MEASURED, F.col("metric")).alias("metric"), of(WORDED, F.lower("keyword")).alias("keyword"))
    what = ["intent", "scopes", "classes", "metric", "keyword"]
    keyed = saved(plain.withColumn("text_id", F.sha2(F.to_json(F.struct(*what)), 256)))
    none = F.array().cast("array<string>")
    different = keyed.select("text_id", *what).dropDuplicates(["text_id"]).withColumn("scopes", F.coalesce("scopes", none)).withColumn("classes", F.coalesce("classes", none))
    return saved(different.withColumn("text", F.lit(None).cast("string"))), keyed.select(F.col("text_id").alias("question"), F.col("asker").alias("text_id")).distinct()


def told(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of answers, whose text_id is a request, for each question (question, text_id) that asks for it.

    Askers of one request stand in groups of about TOGETHER, its answers in shares of about TOLD / TOGETHER, and each group meets
    each share on its own: a request of very many questions and very many answers is spread over the tasks, and nothing is shuffled
    after the join. The rows to come are counted before, and beyond TOLD there are as many tasks as they ask for: by the few rows
    that are joined, AQE would make a handful of tasks of them.

    An answer comes with all askers of a group in a row. Parquet then writes one run for them, and the askers' short cycle is packed
    well; the answers of each asker in a row would be a cycle that is too long for that, and may not fit a file's dictionary.
    """
    asked, answers = saved(asked), saved(answers)
    each = answers.groupBy(F.col("text_id").alias("question")).agg(F.count("*").alias("answers"))
    sizes = saved(asked.groupBy("question").agg(F.count("*").alias("askers")).hint("merge").join(each, "question"))
    n = sizes.agg(F.coalesce(F.sum(F.col("askers") * F.col("answers")), F.lit(0))).first()[0]
    parts = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    cells = sizes.select("question", parts("askers", TOGETHER).alias("groups"), parts("answers", max(1, TOLD // TOGETHER)).alias("shares"))
    one_of = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    askers = asked.hint("merge").join(cells, "question").select("question", "text_id", one_of("groups", "text_id").alias("group"), each_of("shares").alias("share"))
    told_to = [c for c in answers.columns if c != "text_id"]
    dealt = answers.withColumnRenamed("text_id", "question").hint("merge").join(cells, "question")
    dealt = dealt.select("question", *told_to, each_of("groups").alias("group"), one_of("shares", *told_to).alias("share"))
    on = ["question", "group", "share"]
    if n > TOLD:
        tasks = max(-(-n // TOLD), int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        askers, dealt = askers.repartition(tasks, *on), dealt.repartition(tasks, *on)
    return dealt.hint("merge").join(askers, on).select(answers.columns)


def results(routed: DataFrame, t: DataFrame, canonical: DataFrame) -> DataFrame:
    """(text_id, intent, name): what the routed questions ask for, all requests of an intent at once.

    publications, scholars: of all the question's scopes; entity_detail, field_members,
    industry_companies: the scopes' values or members; list_class, search_entities and
    search_publications: by the question's classes or keyword. Other intents have no rows.
    A request is answered once, however many questions make it.
    """
    different, asked = requests(routed)
    return told(_results(different, t, canonical), asked)


def result_summaries(routed: DataFrame, t: DataFrame, canonical: DataFrame, shown: int = 15, called_by: dict[str, str] | None = None) -> DataFrame:
    """summaries() of results() for each question; a request is summed up once, so the questions' result rows are never listed."""
    different, asked = requests(routed)
    return told(summaries(_results(different, t, canonical), shown, called_by), asked)


def _results(routed: DataFrame, t: DataFrame, canonical: DataFrame) -> DataFrame:
    """results() of questions that are all different."""
    of_kind = lambda *kinds: routed.where(F.col("intent").isin(*kinds))
    scoped = lambda q: q.select(F.col("text_id").alias("question"), "intent", F.explode("scopes").alias("entity"))
    shaped = lambda df: df.select(F.col("question").alias("text_id"), "intent", "name")
    meant = lambda df, c="s": df.select("question", "intent", F.col(c).alias("s"))
    merged = canonical_of(t, canonical, "s")
    asked = saved(scoped(of_kind("publications", "scholars")))
    works = query.in_all_scopes(query.publications_for(t), asked.where("intent = 'publications'").select("question", "entity"))
    by_work = works.withColumn("intent", F.lit("publications"))
    ends = query.reverse_related(t, canonical, "affiliatedWith").unionByName(query.reverse_related(t, canonical, "belongsToField")).select(F.col("target").alias("entity"), F.col("s").alias("pub")).distinct()
    people = query.in_all_scopes(ends, asked.where("intent = 'scholars'").select("question", "entity")).join(types(t).where("class = 'Scholar'").select(F.col("s").alias("pub")), "pub", "left_semi")
    by_person = people.withColumn("intent", F.lit("scholars"))
    detail = saved(scoped(of_kind("entity_detail")))
    facts = query.entity_detail(t, canonical, detail.select(F.col("entity").alias("uri")).distinct())
    by_fact = detail.join(facts.withColumnRenamed("uri", "entity"), "entity").select("question", "intent", F.concat_ws(": ", "p", "value").alias("name"))
    inside = saved(scoped(of_kind("field_members", "industry_companies")))
    members = query.reverse_related(t, canonical, "belongsToField").unionByName(query.reverse_related(t, canonical, "belongsToIndustry"))
    by_member = inside.join(members.withColumnRenamed("target", "entity"), "entity")
    listed = saved(of_kind("list_class").select(F.col("text_id").alias("question"), "intent", F.explode("classes").alias("class")))
    by_class = listed.join(query.members(t, canonical).select("s", "class").distinct(), "class")
    words = saved(of_kind("search_entities", "search_publications").select(F.col("text_id").alias("question"), "intent", F.lower("keyword").alias("key")))
    # keywords are found in names as mentions are found in texts: by pieces of their lengths
    all_names = query.members(t, canonical).select("s", "class").distinct().join(canonical_of(labels(t), canonical, "s").select("s", "label").distinct(), "s")
    held = candidate_spans(all_names.select(F.col("label").alias("text_id"), F.col("label").alias("text")).distinct(), words.select("key").where(F.length("key") >= 2).distinct())
    hits = held.select(F.col("text_id").alias("label"), "key").distinct().join(all_names, "label").join(words, "key").where((F.col("intent") == "search_entities") | (F.col("class") == "Publication"))
    by_word = hits.select("question", "intent", "s").distinct()
    found = meant(by_work, "pub").unionByName(meant(by_person, "pub"))
    for df in (by_member, by_class, by_word):
        found = found.unionByName(meant(df))
    # names are written and joined once for the entities of all intents
    return shaped(called(found, merged)).unionByName(shaped(by_fact)).distinct()


def summaries(results: DataFrame, shown: int = 15, called_by: dict[str, str] | None = None) -> DataFrame:
    """(text_id, intent, summary) from result rows (text_id, intent, name): total, and up to `shown` distinct least names.

    called_by: what the results of an intent are called, such as WHAT; 'found' where it says nothing.
    Names are ranked before they are listed, so a question of very many results holds `shown` of them in one row.
    """
    some_of = results.where("name is not null").select("text_id", "intent", "name").distinct()
    first = some_of.withColumn("nr", F.row_number().over(W.partitionBy("text_id", "intent").orderBy("name"))).where(F.col("nr") <= shown)
    listed = first.groupBy("text_id", "intent").agg(F.array_sort(F.collect_list("name")).alias("some"))
    counted = results.groupBy("text_id", "intent").agg(F.countDistinct("name").alias("n")).join(listed, ["text_id", "intent"], "left")
    what = F.lit("found")
    for intent, name in (called_by or {}).items():
        what = F.when(F.col("intent") == intent, name).otherwise(what)
    some = F.array_join("some", "、")
    text = F.when(F.col("n") == 0, F.when(what == "found", "nothing found").otherwise(F.concat(F.lit("no "), what))).when(F.col("n") > shown, F.format_string("%d %s, %d shown: %s", "n", what, F.lit(shown), some)).otherwise(F.format_string("%d %s: %s", "n", what, some))
    return counted.select("text_id", "intent", text.alias("summary"))


# ---- trends, rankings and overviews

#: The class whose property a metric is.
METRIC_CLASS = {"revenue": "Company", "employees": "Company", "cited_by_count": "Publication", "hIndex": "Institution"}
#: Relations that a ranking counts, by the class that is ranked: (subjects, relation).
COUNTED = {"Institution": ("Scholar", "affiliatedWith"), "Company": ("Company", "belongsToIndustry"), "Field": ("Publication", "belongsToField")}
COUNTED_OBJECT = {"Institution": "Institution", "Company": "Industry", "Field": "Field"}


def counted_results(routed: DataFrame, t: DataFrame, canonical: DataFrame, top: int = 30) -> DataFrame:
    """(text_id, intent, nr, name, value, total): numbered rows of the questions that ask for trends, ranks or an overview.

    trend: publications by year, of those in all of the question's scopes, of all where it has none. numeric_rank:
    the largest values of the metric. relation_rank: institutions by publications if the question names both, else
    the class it names (institutions if none) by its relation. overview: entities of each class. total: all rows
    there are, of which rankings show `top`. A trend or ranking is computed once, however many questions ask for it.
    """
    different, asked = requests(routed)
    return told(_counted_results(different, t, canonical, top), asked)


def counted_result_summaries(routed: DataFrame, t: DataFrame, canonical: DataFrame, top: int = 30, shown: int = 15) -> DataFrame:
    """counted_summaries() of counted_results() for each question; a request is summed up once."""
    different, asked = requests(routed)
    return told(counted_summaries(_counted_results(different, t, canonical, top), shown), asked)


def _counted_results(routed: DataFrame, t: DataFrame, canonical: DataFrame, top: int) -> DataFrame:
    """counted_results() of questions that are all different."""
    of_kind = lambda kind: routed.where(F.col("intent") == kind)
    parts = []
    # trends
    trend = saved(of_kind("trend").select("text_id", F.explode_outer("scopes").alias("entity")))
    known = saved(types(t).where(F.col("class").isin("Scholar", "Institution", "Field")).select(F.col("s").alias("entity")).distinct())
    scoped = saved(trend.hint("merge").join(known, "entity", "left_semi").select(F.col("text_id").alias("question"), "entity"))
    works = query.in_all_scopes(query.publications_for(t), scoped).select(F.col("question").alias("text_id"), F.col("pub").alias("s"))
    years = saved(query.work_years(t))
    by_scope = works.hint("merge").join(years, "s").groupBy("text_id", "year").agg(F.count("*").alias("value"))
    unscoped = trend.select("text_id", F.lit("trend").alias("intent")).distinct().hint("merge").join(scoped.select(F.col("question").alias("text_id")).distinct(), "text_id", "left_anti")
    everything = saved(years.groupBy("year").agg(F.count("*").alias("value")).withColumn("intent", F.lit("trend")))
    # years: at most one row for each year
    in_years = by_scope.unionByName(unscoped.join(F.broadcast(everything), "intent").select("text_id", "year", "value"))
    of_question = W.partitionBy("text_id")
    parts.append(in_years.select("text_id", F.lit("trend").alias("intent"), F.row_number().over(of_question.orderBy("year")).alias("nr"), F.col("year").cast("string").alias("name"), F.col("value").cast("double").alias("value"), F.count("*").over(of_question).alias("total")))
    # numeric ranks: one ranking for each metric that is asked for
    for (metric,) in sorted(tuple(r) for r in of_kind("numeric_rank").select("metric").distinct().where("metric is not null").collect()):
        ranking = query.numeric_summary(t, canonical, METRIC_CLASS[metric], metric, top)
        total = query.numeric_total(t, canonical, METRIC_CLASS[metric], metric)
        parts.append(_asked(of_kind("numeric_rank").where(F.col("metric") == metric), ranking.select("s", "name", "value"), total))
    # relation ranks: which ranking a question means
    both = F.array_contains("classes", "Publication") & F.array_contains("classes", "Institution")
    kind = F.when(both, "publications")
    for cls in COUNTED:
        kind = kind.when(F.array_contains("classes", cls), cls)
    asked = saved(of_kind("relation_rank").withColumn("kind", kind.otherwise("Institution")))
    for (name,) in sorted(tuple(r) for r in asked.select("kind").distinct().collect()):
        if name == "publications":
            ranking = query.institution_ranking(t, top).select(F.col("entity").alias("s"), "name", F.col("n").alias("value"))
            total = query.members(t, canonical, "Institution").agg(F.countDistinct("raw").alias("total"))
        else:
            counts = saved(query.count_by_relation(t, canonical, COUNTED[name][0], COUNTED[name][1], COUNTED_OBJECT[name]))
            ranking, total = counts.orderBy(F.desc("n"), "target").limit(top).select(F.col("target").alias("s"), "name", F.col("n").alias("value")), counts.agg(F.count("*").alias("total"))
        parts.append(_asked(asked.where(F.col("kind") == name), ranking, total))
    # overview: at most one row for each class
    classes = types(t).groupBy("class").agg(F.count("*").alias("value"))
    parts.append(_asked(of_kind("overview"), classes.select(F.col("class").alias("s"), F.col("class").alias("name"), "value").orderBy("s").limit(1000), classes.agg(F.count("*").alias("total")), by_value=False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _asked(questions: DataFrame, ranking: DataFrame, total: DataFrame, by_value: bool = True) -> DataFrame:
    """Every question with every row of one short ranking (s, name, value), which is written once and broadcast."""
    order = W.orderBy(F.desc("value"), "s") if by_value else W.orderBy("s")
    rows = saved(ranking.withColumn("nr", F.row_number().over(order)).join(F.broadcast(total), how="cross"))  # rows of a limit, and one row
    intent = questions.select("intent").distinct()  # one
    return questions.select("text_id", "intent").join(F.broadcast(rows.join(F.broadcast(intent), how="cross")), "intent").select("text_id", "intent", "nr", "name", F.col("value").cast("double").alias("value"), "total")


def counted_summaries(counted: DataFrame, shown: int = 15) -> DataFrame:
    """(text_id, intent, summary) of counted_results(): years with their sum, ranks and classes with their number, up to `shown` in order."""
    number = lambda c: F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    listed = counted.where((F.col("nr") <= shown) | (F.col("intent") == "trend")).groupBy("text_id", "intent").agg(
        F.array_sort(F.collect_list(F.struct("nr", F.concat("name", F.lit(" ("), number(F.col("value")), F.lit(")")).alias("x")))).alias("some"), F.first("total").alias("total"), F.sum("value").alias("sum"))
    some = F.array_join(F.transform("some", lambda x: x["x"]), "、")
    text = F.when(F.col("intent") == "trend", F.format_string("%d years, %s records: %s", "total", number(F.col("sum")), some)).when(F.col("intent") == "overview", F.format_string("%d classes: %s", "total", some))
    return listed.select("text_id", "intent", text.otherwise(F.format_string("%d ranked, %d shown: %s", "total", F.size("some"), some)).alias("summary"))
