"""Which entities and classes texts mention.

Labels are found without a theta join: by an automaton over all of them where their counted
number and bytes are small, else by pieces of the labels' lengths that are cut where a label's first
characters stand and equi-joined with the dictionary. Accepted spans are folded per text, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import Namespaces
from ..plans.scratch import join_checked, saved
from .graph import canonical_of, labels, least_class, types

try:
    import ahocorasick
except ImportError:  # joins find the same places
    ahocorasick = None

#: Most keys, and bytes of keys, of an automaton: some hundred MB in a Python worker.
AUTOMATON_KEYS, AUTOMATON_BYTES = 200_000, 16 << 20
#: Lengths of beginnings of keys that may make up an automaton, and the longest key that is cut from the text where one stands.
LEADS, LONGEST = (24, 16, 12, 8, 6, 4, 3), 1000

# Chinese names of institutions with their English name and country.
INSTITUTION_ALIASES = {
    "清华大学": ("Tsinghua University", "CN"), "北京大学": ("Peking University", "CN"), "浙江大学": ("Zhejiang University", "CN"), "复旦大学": ("Fudan University", "CN"),
    "上海交通大学": ("Shanghai Jiao Tong University", "CN"), "华东师范大学": ("East China Normal University", "CN"), "南京大学": ("Nanjing University", "CN"),
    "中国科学技术大学": ("University of Science and Technology of China", "CN"), "华中科技大学": ("Huazhong University of Science and Technology", "CN"),
    "武汉大学": ("Wuhan University", "CN"), "中山大学": ("Sun Yat-sen University", "CN"), "西安交通大学": ("Xi'an Jiaotong University", "CN"),
    "哈尔滨工业大学": ("Harbin Institute of Technology", "CN"), "北京理工大学": ("Beijing Institute of Technology", "CN"), "北京航空航天大学": ("Beihang University", "CN"),
    "同济大学": ("Tongji University", "CN"), "天津大学": ("Tianjin University", "CN"), "南开大学": ("Nankai University", "CN"), "四川大学": ("Sichuan University", "CN"),
    "山东大学": ("Shandong University", "CN"), "厦门大学": ("Xiamen University", "CN"), "东南大学": ("Southeast University", "CN"), "吉林大学": ("Jilin University", "CN"),
    "大连理工大学": ("Dalian University of Technology", "CN"), "华南理工大学": ("South China University of Technology", "CN"), "湖南大学": ("Hunan University", "CN"),
    "中南大学": ("Central South University", "CN"), "重庆大学": ("Chongqing University", "CN"), "兰州大学": ("Lanzhou University", "CN"), "东北大学": ("Northeastern University", "CN"),
    "西北工业大学": ("Northwestern Polytechnical University", "CN"), "电子科技大学": ("University of Electronic Science and Technology of China", "CN"),
    "北京邮电大学": ("Beijing University of Posts and Telecommunications", "CN"), "北京师范大学": ("Beijing Normal University", "CN"), "中国人民大学": ("Renmin University of China", "CN"),
    "上海大学": ("Shanghai University", "CN"), "上海海事大学": ("Shanghai Maritime University", "CN"), "深圳大学": ("Shenzhen University", "CN"), "苏州大学": ("Soochow University", "CN"),
    "郑州大学": ("Zhengzhou University", "CN"), "香港大学": ("University of Hong Kong", "HK"), "香港中文大学": ("Chinese University of Hong Kong", "HK"),
    "香港科技大学": ("Hong Kong University of Science and Technology", "HK"), "香港理工大学": ("Hong Kong Polytechnic University", "HK"),
    "新加坡国立大学": ("National University of Singapore", "SG"), "南洋理工大学": ("Nanyang Technological University", "SG"),
    "麻省理工学院": ("Massachusetts Institute of Technology", "US"), "斯坦福大学": ("Stanford University", "US"), "哈佛大学": ("Harvard University", "US"),
    "牛津大学": ("University of Oxford", "GB"), "剑桥大学": ("University of Cambridge", "GB"), "中国科学院": ("Chinese Academy of Sciences", "CN"),
    "中国社会科学院": ("Chinese Academy of Social Sciences", "CN"),
}
SHORT_NAMES = {"北理工": "北京理工大学", "北大": "北京大学", "华东师大": "华东师范大学", "上海交大": "上海交通大学", "复旦": "复旦大学", "浙大": "浙江大学", "清华": "清华大学"}
CLASS_WORDS = (
    ("学者", "Scholar"), ("老师", "Scholar"), ("作者", "Scholar"), ("教授", "Scholar"), ("论文", "Publication"), ("文献", "Publication"), ("文章", "Publication"),
    ("机构", "Institution"), ("学校", "Institution"), ("大学", "Institution"), ("公司", "Company"), ("企业", "Company"), ("厂商", "Company"), ("行业", "Industry"),
    ("产业", "Industry"), ("领域", "Field"), ("方向", "Field"), ("学科", "Field"), ("期刊", "Venue"), ("会议", "Venue"), ("数据集", "Dataset"), ("资料集", "Dataset"), ("数据源", "DataSource"),
)
GRAMMAR = (
    "有哪些", "有什么", "有多少", "哪些", "是什么", "是谁", "列出", "所有", "全部", "清单", "列表", "多少", "几个", "平台", "收录", "请问", "告诉我", "帮我", "查一下",
    "相关", "关于", "研究", "发表", "关联", "机构", "学校", "大学", "学者", "老师", "教授", "作者", "教师", "成员", "校友", "毕业生", "论文", "文献", "文章", "公司", "企业",
    "厂商", "行业", "产业", "领域", "方向", "学科", "期刊", "会议", "数据集", "资料集", "数据源", "都有谁", "谁", "是", "国家", "地区", "营收", "收入", "员工数", "员工", "人数",
    "h指数", "被引次数", "引用次数", "趋势", "逐年", "每年", "增长", "分布", "按年", "详情", "介绍", "的", "有",
)
STOP_PHRASES = ("有哪些", "有什么", "哪些", "是什么", "多少", "请问", "的", "？", "?", "。", "列出", "告诉我", "帮我", "查一下", "查查", "相关", "关于", "研究")


def alias_table(spark) -> DataFrame:
    """(alias, english, country) of the known institutions, short names included."""
    rows = [(a, *x) for a, x in INSTITUTION_ALIASES.items()] + [(a, *INSTITUTION_ALIASES[full]) for a, full in SHORT_NAMES.items()]
    return spark.createDataFrame(rows, "alias string, english string, country string")


def uri_mentions(texts: DataFrame, t: DataFrame, ns: Namespaces = Namespaces()) -> DataFrame:
    """(text_id, s, label): full addresses of typed entities in the texts."""
    found = texts.where(F.contains("text", F.lit("://"))).select("text_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z0-9+.\-]*://[^\s<>\"，。？！]+)"), F.lit(1))).alias("label"))
    local = F.when(F.col("label").startswith(ns.resource), F.substr("label", F.lit(len(ns.resource) + 1))).otherwise(F.col("label"))
    return found.withColumn("s", local).hint("merge").join(types(t).select("s").distinct(), "s", "left_semi").select("text_id", "s", "label").distinct()


def dictionary(t: DataFrame) -> DataFrame:
    """(key, s): lower-cased labels of two characters or more."""
    return labels(t).where(F.length("label") >= 2).select(F.lower("label").alias("key"), "s").distinct()


def with_aliases(entries: DataFrame, t: DataFrame, aliases: DataFrame, cls: str = "Institution") -> DataFrame:
    """The dictionary with the aliases' entities; an alias that is also a label keeps only institutions of the right country."""
    country = t.where("p = 'country'").select("s", F.col("o").alias("country"))
    places = types(t).where(F.col("class") == cls).select("s").join(country, "s")
    by_name = t.where("p = 'name'").select("s", F.lower("o").alias("key")).join(places, "s")
    small = F.broadcast(aliases.select(F.lower("alias").alias("alias"), F.lower("english").alias("key"), "country"))  # the table above
    matched = by_name.join(small, ["key", "country"]).select(F.col("alias").alias("key"), "s")
    direct = entries.join(F.broadcast(aliases.select(F.lower("alias").alias("key"), "country")), "key").join(places, ["s", "country"], "left_semi").select("key", "s")
    others = entries.join(F.broadcast(aliases.select(F.lower("alias").alias("key"))), "key", "left_anti")
    return others.unionByName(matched).unionByName(direct).distinct()


def candidate_spans(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_id, h, key, start, end): every place of a key in a text, upper and lower case alike. h: a hash that parts texts of one text_id.

    Keys of at most AUTOMATON_KEYS and AUTOMATON_BYTES, which are counted, make up one automaton that
    is broadcast and run over the texts where they are: only places of whole keys become rows. More keys
    are found by an automaton of their beginnings, see led_spans(), or where these are too many by joins, see joined_spans().
    """
    distinct = saved(keys.where(F.length("key") >= 2).select(F.lower("key").alias("key")).distinct())
    n, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    if ahocorasick is None:
        return joined_spans(texts, distinct)
    if n > AUTOMATON_KEYS or size > AUTOMATON_BYTES:
        lead, longest = _lead(distinct)
        return led_spans(texts, distinct, lead) if lead and longest <= LONGEST else joined_spans(texts, distinct)
    return automaton_spans(texts, [r["key"] for r in distinct.collect()])


def automaton_spans(texts: DataFrame, keys: Sequence[str] | dict[str, int]) -> DataFrame:
    """candidate_spans() of keys that fit one automaton; their number and bytes are the caller's to bound.

    With a length for each key, rows have `piece` too: so many characters of the text from the key's place, fewer at its end.
    """
    cut = isinstance(keys, dict)
    words = texts.sparkSession.sparkContext.broadcast(dict(keys) if cut else list(keys))
    kind = dict(texts.dtypes)["text_id"]
    low = F.lower("text")
    rows = texts.where("text is not null").select("text_id", F.xxhash64(low).alias("h"), low.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for w in words.value:
            automaton.add_word(w, w)
        if not len(automaton):
            return
        automaton.make_automaton()
        for batch in batches:
            which, found, start, end, piece = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for last, key in automaton.iter(text):
                    which.append(i), found.append(key), start.append(last + 2 - len(key)), end.append(last + 2)
                    if cut:
                        piece.append(text[last + 1 - len(key) : last + 1 - len(key) + words.value[key]])
            at = pa.array(which, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(piece, pa.string())] if cut else [])], ["text_id", "h", "key", "start", "end", *(["piece"] if cut else [])])

    return rows.mapInArrow(run, f"text_id {kind}, h long, key string, start int, end int" + (", piece string" if cut else "")).distinct()


def _lead(keys: DataFrame) -> tuple[int, int]:
    """The greatest of LEADS whose beginnings of keys fit an automaton (0: none), and the longest key. Estimates stay well below the bound."""
    sizes = keys.agg(F.max(F.length("key")).alias("longest"), *[F.approx_count_distinct(F.substring("key", 1, k)).alias(f"n{k}") for k in LEADS]).first()
    fits = [k for k in LEADS if sizes[f"n{k}"] <= AUTOMATON_KEYS // 2 and sizes[f"n{k}"] * 4 * k <= AUTOMATON_BYTES]
    return (fits[0] if fits else 0), sizes["longest"] or 0


def led_spans(texts: DataFrame, keys: DataFrame, lead: int) -> DataFrame:
    """candidate_spans() of any number of keys, whose first `lead` characters fit one automaton.

    Where a beginning stands, the text that follows is cut at the longest key of that beginning, then
    at all their lengths, and these pieces are equi-joined with the keys. Texts are read once and not shuffled.
    """
    starts = saved(keys.select(F.substring("key", 1, lead).alias("lead"), F.length("key").alias("n")).distinct())
    longest = {r["lead"]: r["n"] for r in starts.groupBy("lead").agg(F.max("n").alias("n")).collect()}
    places = automaton_spans(texts, longest)
    pieces = join_checked(places, starts.withColumnRenamed("lead", "key"), "key").where(F.length("piece") >= F.col("n"))
    pieces = pieces.select("text_id", "h", F.substr("piece", F.lit(1), F.col("n")).alias("key"), "start", (F.col("start") + F.col("n")).alias("end"))
    return join_checked(pieces, keys.select("key").distinct(), "key", "left_semi").select("text_id", "h", "key", "start", "end").distinct()


def joined_spans(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """candidate_spans() of any number of keys.

    The first two characters of the keys, with the lengths that follow them, lead to the
    possible places, before any longer piece is cut: only there pieces of these lengths are
    cut from the text and equi-joined with the keys. Tables are broadcast only if they are small.
    """
    starts = keys.select(F.substring("key", 1, 2).alias("lead"), F.length("key").alias("n")).distinct()
    text = texts.select("text_id", F.lower("text").alias("text")).where(F.length("text") >= 2).withColumn("h", F.xxhash64("text"))
    leads = F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.struct(i.alias("i"), F.substr("text", i, F.lit(2)).alias("lead")))
    places = text.select("text_id", "h", F.length("text").alias("size"), F.explode(leads).alias("x")).select("text_id", "h", "size", "x.i", "x.lead")
    led = join_checked(places, starts, "lead").where(F.col("i") + F.col("n") <= F.col("size") + 1).select("text_id", "h", "i", "n").distinct()
    pieces = led.hint("merge").join(text, ["text_id", "h"]).select("text_id", "h", F.col("i").alias("start"), (F.col("i") + F.col("n")).alias("end"), F.substr("text", F.col("i"), F.col("n")).alias("key"))
    return join_checked(pieces, keys.select("key").distinct(), "key", "left_semi").select("text_id", "h", "key", "start", "end")


def accepted_spans(spans: DataFrame) -> DataFrame:
    """(text_id, h, key, start, end): longest first, then by key and place, without overlaps in a text.

    Only spans that overlap, directly or over others, are folded together, so a long text isn't one row.
    """
    kind = "array<struct<rank:int,key:string,start:int,end:int>>"
    order = W.partitionBy("text_id", "h").orderBy("start", "end", "key")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    grouped = (
        spans.distinct().withColumn("new", (F.coalesce(reach, F.col("start")) <= F.col("start")).cast("int"))
        .withColumn("cluster", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    )
    listed = grouped.groupBy("text_id", "h", "cluster").agg(F.array_sort(F.collect_list(F.struct((-F.length("key")).alias("rank"), "key", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("all"))

    def take(kept: Column, span: Column) -> Column:
        free = ~F.exists(kept, lambda k: (span["start"] < k["end"]) & (span["end"] > k["start"]))
        return F.when(free, F.concat(kept, F.array(span))).otherwise(kept)

    return listed.select("text_id", "h", F.explode(F.aggregate("all", F.array().cast(kind), take)).alias("k")).select("text_id", "h", "k.key", "k.start", "k.end")


def mentions(texts: DataFrame, t: DataFrame, aliases: DataFrame | None = None, ns: Namespaces = Namespaces()) -> DataFrame:
    """(text_id, s, label): entities that the texts (text_id, text) mention. Texts with full addresses have those only."""
    by_uri = saved(uri_mentions(texts, t, ns))
    entries = dictionary(t) if aliases is None else with_aliases(dictionary(t), t, aliases)
    rest = join_checked(texts, by_uri.select("text_id").distinct(), "text_id", "left_anti")
    spans = accepted_spans(candidate_spans(rest, entries))
    return spans.select("text_id", "key").distinct().hint("merge").join(entries, "key").select("text_id", "s", F.col("key").alias("label")).unionByName(by_uri)


def canonical_mentions(found: DataFrame, t: DataFrame, canonical: DataFrame) -> DataFrame:
    """(text_id, s, label): canonical ids with a known class, each once for a text, under its longest label."""
    known = found.hint("merge").join(least_class(t), "s", "left_semi")
    return canonical_of(known, canonical, "s").groupBy("text_id", "s").agg(F.min_by("label", F.struct(-F.length("label"), "label")).alias("label"))


def ambiguous(found: DataFrame) -> DataFrame:
    """(text_id, label, n): labels that lead to several entities."""
    return found.groupBy("text_id", F.lower("label").alias("label")).agg(F.countDistinct("s").alias("n")).where("n > 1")


def class_mentions(texts: DataFrame, words: tuple[tuple[str, str], ...] = CLASS_WORDS) -> DataFrame:
    """texts with `classes`: classes whose words occur, in the dictionary's order."""
    hits = F.array(*[F.when(F.contains("text", F.lit(w)), F.lit(c)) for w, c in words])
    return texts.withColumn("classes", F.array_distinct(F.array_compact(hits)))


def _any_of(words: tuple[str, ...]) -> str:
    escape = str.maketrans({c: "\\" + c for c in "?.*+()[]{}|^$\\"})
    first = "".join(sorted({w[0].translate(escape) for w in words}))
    # at any other character no word is tried
    return f"(?=[{first}])(?:" + "|".join(w.translate(escape) for w in sorted(words, key=len, reverse=True)) + ")"


def residual(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts with `residual`: what is left without mentioned labels, grammar words, marks and spaces."""
    named = found.groupBy("text_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("label")).alias("n"), F.lower("label").alias("label")))).alias("labels"))
    bare = F.aggregate(F.coalesce("labels", F.array().cast("array<struct<n:int,label:string>>")), F.lower("text"), lambda acc, x: F.replace(acc, x["label"], F.lit("")))
    return texts.join(named, "text_id", "left").withColumn("residual", F.regexp_replace(F.regexp_replace(bare, _any_of(GRAMMAR), ""), r"[？?。！!，,\s]", "")).drop("labels")


def keyword(text: Column) -> Column:
    """First part of two characters or more once stop phrases are taken out; null if none."""
    bare = F.regexp_replace(text, _any_of(STOP_PHRASES), " ")
    return F.get(F.filter(F.transform(F.split(bare, r"[\s,，、]+"), lambda w: F.trim(w)), lambda w: F.length(w) >= 2), 0)
