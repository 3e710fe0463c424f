"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after numbers and names (capitalised words within a sentence) become typed
placeholders that keep their value aside: <d=12>, <u=km>, <n=alice>. Windows of five
canonical words are hash-joined with those of the benchmark's items. A document has an item's
template if it holds enough of the item's windows. Then the slots are compared: a value of
the item must stand for one and the same value everywhere in that instance, which also
catches questions that were asked anew with other numbers or names. Each alignment of a
document with an item is an instance of its own; one that passes is enough.

Items without a window of enough plain words are joined on windows with the values kept, of
k words or, for shorter items, of all their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, join_checked, row_key, saved, table

#: Units that become a placeholder when they follow a number.
UNITS = "kg|km|cm|mm|mg|lbs?|miles?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|usd|eur|percent|m|g"
#: Scripts written without spaces; each of their characters, with its marks, is a word.
UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))


@dataclass(frozen=True)
class Decontam:
    """k: words in a window. cover: least share of an item's windows. fixed: least number of words in a window that are no placeholders.

    drift: words put in or left out that an instance may have before its windows count as those of another.
    short: an item of fewer words is held only by a document that has these words and no others, as so few stand in many texts by chance.
    """

    k: int = 5
    cover: float = 0.8
    fixed: int = 3
    drift: int = 3
    short: int = 4


def canonical_words(text: Column) -> Column:
    """Lower-cased words and placeholders with values; null text: no words."""
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[<>=]", " ")
    t = F.regexp_replace(t, r"(\p{Ll},? )(\p{Lu}\p{Ll}+)", "$1<n=$2>")
    t = F.lower(F.regexp_replace(t, r"(> )(\p{Lu}\p{Ll}+)", "$1<n=$2>"))
    t = F.regexp_replace(t, r"[0-9]+(?:[.,][0-9]+)*", "<d=$0>")
    t = F.regexp_replace(t, rf"(<d=[0-9.,]+>) ?({UNITS})\b", "$1 <u=$2>")
    # most words begin with a-z, which the first alternative takes without a look at scripts
    letters = rf"[\p{{L}}\p{{M}}&&[^{UNSPACED}]]"
    return F.regexp_extract_all(t, F.lit(rf"[a-z]+{letters}*|<[a-z]=[^<>]*>|[\p{{L}}&&[{UNSPACED}]]\p{{M}}*|{letters}+"), F.lit(0))


def templates(words: Column) -> Column:
    """The words without the placeholders' values."""
    return F.transform(words, lambda w: F.when(w.startswith("<"), F.substring(w, 1, 2)).otherwise(w))


def plain_values(words: Column) -> Column:
    """The words with the placeholders' values in their place."""
    return F.transform(words, lambda w: F.when(w.startswith("<"), F.substring_index(F.substr(w, F.lit(4)), ">", 1)).otherwise(w))


def word_hashes(words: Column) -> Column:
    """A hash of each word, so that a window's hash is one of k numbers."""
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column, k: int) -> Column:
    """struct(place, h) for each run of k words, given their hashes; none for fewer words. hashes: a column of its own, as it is referred to k times."""
    n = F.size(hashes)
    places = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]).alias("h")))


def item_windows(benchmark: DataFrame, spec: Decontam) -> DataFrame:
    """Rows (item_id, windows, n_windows, nr, h): nr numbers an item's distinct windows; the first word also counts as a name.

    Windows with fewer than `fixed` words besides placeholders are left out, and so are items without any window.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), canonical_words(F.col("text")).alias("w")).where("item_id is not null")
    rows = rows.withColumn("t", templates(F.col("w")))
    named = F.when(F.size("w") > 0, F.concat(F.array(F.lit("<n")), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))))
    all_windows = rows.select("item_id", F.explode(F.array(F.struct(F.lit(False).alias("alias"), F.col("t").alias("t")), F.struct(F.lit(True).alias("alias"), F.coalesce(named, F.col("t")).alias("t")))).alias("x")).select("item_id", "x.alias", "x.t")
    windows = all_windows.withColumn("hashes", word_hashes(F.col("t"))).select("item_id", "alias", "t", F.explode(window_hashes(F.col("hashes"), spec.k)).alias("x")).select("item_id", "alias", "t", "x.place", "x.h")
    strong = F.size(F.filter(F.slice("t", F.col("place") + 1, spec.k), lambda w: ~w.startswith("<"))) >= spec.fixed
    own = windows.where(strong & ~F.col("alias")).groupBy("item_id", "h").agg(F.min("place").alias("nr"))
    alias = windows.where(F.col("alias") & (F.col("place") == 0)).join(own.where("nr = 0").select("item_id").distinct().hint("merge"), "item_id", "left_semi").select("item_id", "h", F.lit(0).alias("nr"))
    counted = own.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    return own.unionByName(alias).distinct().hint("merge").join(counted, "item_id")


def weak_windows(benchmark: DataFrame, items: DataFrame, spec: Decontam) -> DataFrame:
    """Rows (item_id, n_words, h, nr, n_windows) of the items that item_windows() leaves out, over plain_values().

    n_words: words of a window, k or all words of a shorter item. Items without any word are left out.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain_values(canonical_words(F.col("text"))).alias("v")).where("item_id is not null and size(v) > 0")
    weak = rows.hint("merge").join(items.select("item_id").distinct(), "item_id", "left_anti").withColumn("n_words", F.least(F.size("v"), F.lit(spec.k))).withColumn("hashes", word_hashes(F.col("v")))
    hashes = F.coalesce(*[F.when(F.col("n_words") == n, window_hashes(F.col("hashes"), n)) for n in range(1, spec.k + 1)])
    own = weak.select("item_id", "n_words", F.explode(hashes).alias("x")).groupBy("item_id", "n_words", F.col("x.h").alias("h")).agg(F.min("x.place").alias("nr"))
    return own.hint("merge").join(own.groupBy("item_id").agg(F.count("*").alias("n_windows")), "item_id")


def _weak_leaks(rows: DataFrame, weak: DataFrame, spec: Decontam) -> DataFrame:
    """Rows (doc_id, item_id, windows, n_windows): weak items of which one alignment holds enough windows. rows: doc_id, text."""
    shaped = rows.select("doc_id", word_hashes(plain_values(canonical_words(F.col("text")))).alias("v"))
    hits = None
    for n in sorted(r["n_words"] for r in weak.select("n_words").distinct().collect()):
        texts = shaped.where(F.size("v") == n) if n < spec.short else shaped
        windows = texts.select("doc_id", F.explode(window_hashes(F.col("v"), n)).alias("x")).select("doc_id", "x.h", "x.place")
        mine = join_checked(windows, weak.where(F.col("n_words") == n), "h").select("doc_id", "item_id", "nr", "place", "n_windows")
        hits = mine if hits is None else hits.unionByName(mine)
    aligned = hits.groupBy("doc_id", "item_id", F.col("place") - F.col("nr")).agg(F.count_distinct("nr").alias("windows"), F.first("n_windows").alias("n_windows"))
    return (
        aligned.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.first("n_windows").alias("n_windows"))
        .where(F.col("windows") >= spec.cover * F.col("n_windows"))
    )


def _slots(words: Column) -> Column:
    """struct(place, kind, value) of the placeholders."""
    placed = F.transform(words, lambda w, i: F.struct(i.alias("place"), F.substring(w, 1, 2).alias("kind"), F.when(w.startswith("<"), F.substr(w, F.lit(4))).alias("value")))
    return F.filter(placed, lambda s: s["value"].isNotNull())


def leaks(docs: DataFrame, benchmark: DataFrame, spec: Decontam = Decontam()) -> DataFrame:
    """Rows (doc_id, item_id, windows, n_windows, cover, reparameterised): items that a document holds.

    windows: distinct windows of the item found in the document. Items of fewer than k words,
    or whose windows all have fewer than `fixed` plain words, are held by documents with the
    same words and values, in one alignment; items of fewer than `short` words only by documents of these words alone.
    Null item_ids and doc_ids and items without words take no part. Null and empty texts hold nothing. Rows with one doc_id are one document; a repeated item_id is one item.
    reparameterised: some value differs from the item's, in the alignment of most first places
    or, if that one is inconsistent, in all others that pass. Other columns are ignored.
    """
    items = saved(item_windows(benchmark, spec))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shaped = rows.select("doc_id", word_hashes(templates(canonical_words(F.col("text")))).alias("t"))
    windows = shaped.select("doc_id", F.explode(window_hashes(F.col("t"), spec.k)).alias("x")).select("doc_id", "x.h", "x.place")
    hits = saved(join_checked(windows, items, "h").groupBy("doc_id", "item_id", "nr", (F.col("place") - F.col("nr")).alias("shift")).agg(F.first("n_windows").alias("n_windows")))
    found = saved(
        hits.groupBy("doc_id", "item_id", "nr").agg(F.min("shift").alias("shift"), F.first("n_windows").alias("n_windows"))
        .groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), F.first("n_windows").alias("n_windows"), F.mode("shift", True).alias("shift"))
        .where(F.col("windows") >= spec.cover * F.col("n_windows"))
    )
    # further alignments: those that hold enough windows by themselves, with what drifted
    own = hits.hint("merge").join(found.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
    around = W.partitionBy("doc_id", "item_id").orderBy("shift").rangeBetween(-spec.drift, spec.drift)
    by_shift = own.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("nr").alias("nrs"), F.count("*").alias("n"), F.first("n_windows").alias("n_windows"))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("nrs").over(around))))
    whole = by_shift.withColumn("covered", covered).withColumn("most", F.max("n").over(around)).where((F.col("n") == F.col("most")) & (F.col("covered") >= spec.cover * F.col("n_windows")))
    first = found.select("doc_id", "item_id", "shift", F.lit(0).alias("later"))
    aligned = saved(first.unionByName(whole.select("doc_id", "item_id", "shift", F.lit(1).alias("later"))).groupBy("doc_id", "item_id", "shift").agg(F.min("later").alias("later")))
    # slots of the found items and documents, laid over each other at each alignment's shift
    item_slots = saved(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.explode(_slots(canonical_words(F.col("text")))).alias("s")).select("item_id", "s.*").distinct())
    wanted = saved(join_checked(found, item_slots.select("item_id").distinct(), "item_id", "left_semi").select("doc_id").distinct())
    doc_slots = join_checked(rows, wanted, "doc_id", "left_semi").select("doc_id", F.explode(_slots(canonical_words(F.col("text")))).alias("s")).select("doc_id", "s.*").distinct()
    laid = (
        join_checked(aligned, item_slots, "item_id")
        .select("doc_id", "item_id", "shift", "kind", F.col("value").alias("asked"), (F.col("place") + F.col("shift")).alias("place"))
        .hint("merge").join(doc_slots, ["doc_id", "kind", "place"])
    )
    by_value = laid.groupBy("doc_id", "item_id", "shift", "kind", "asked").agg((F.min("value") != F.max("value")).alias("mixed"), F.max((F.col("value") != F.col("asked")).cast("int")).alias("other"))
    checked = by_value.groupBy("doc_id", "item_id", "shift").agg(F.max(F.col("mixed").cast("int")).alias("mixed"), F.max("other").alias("other"))
    passed = (
        aligned.hint("merge").join(checked, ["doc_id", "item_id", "shift"], "left").where("coalesce(mixed, 0) = 0")
        .groupBy("doc_id", "item_id").agg(F.min(F.struct("later", F.coalesce("other", F.lit(0)).alias("other")))["other"].alias("other"))
    )
    strong = found.hint("merge").join(passed, ["doc_id", "item_id"]).select("doc_id", "item_id", "windows", "n_windows", (F.col("windows") / F.col("n_windows")).alias("cover"), (F.col("other") > 0).alias("reparameterised"))
    weak = saved(weak_windows(benchmark, items, spec))
    if weak.isEmpty():
        return strong
    return strong.unionByName(_weak_leaks(rows, weak, spec).select("*", (F.col("windows") / F.col("n_windows")).alias("cover"), F.lit(False).alias("reparameterised")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, spec: Decontam = Decontam()) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, each decided by its own text, whatever its doc_id. All columns stay as they are, whatever their names."""
    row = free_name(docs, "row_key")
    told = docs.withColumn(row, row_key())
    gone = saved(leaks(told.select(F.col(row).alias("doc_id"), "text"), benchmark, spec).select(F.col("doc_id").alias(row)).distinct())
    return join_checked(told, gone, row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = rf"""
WITH raw AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), canon AS (
  SELECT side, id, regexp_extract_all(
    regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '[<>=]', ' ', 'g'),
      '(\p{{Ll}},? )(\p{{Lu}}\p{{Ll}}+)', '\1<n=\2>', 'g'), '(> )(\p{{Lu}}\p{{Ll}}+)', '\1<n=\2>', 'g')),
      '[0-9]+(?:[.,][0-9]+)*', '<d=\0>', 'g'), '(<d=[0-9.,]+>) ?({UNITS})\b', '\1 <u=\2>', 'g'),
    '<[a-z]=[^<>]*>|[\p{{L}}\p{{M}}]+') AS w
  FROM raw
), temp AS (
  SELECT side, id, w, list_transform(w, lambda x: CASE WHEN x[1] = '<' THEN x[1:2] ELSE x END) AS t FROM canon WHERE len(w) >= 5
), variants AS (
  SELECT side, id, t, FALSE AS alias FROM temp UNION ALL SELECT side, id, list_concat(['<n'], t[2:]), TRUE FROM temp WHERE side = 'b'
), places AS (
  SELECT side, id, alias, t, unnest(range(0, CAST(len(t) - 4 AS BIGINT))) AS place FROM variants
), win AS (
  SELECT side, id, alias, place, array_to_string(t[place + 1:place + 5], ' ') AS h, len(list_filter(t[place + 1:place + 5], lambda x: x[1] <> '<')) AS fixed FROM places
), own AS (
  SELECT id AS item_id, h, min(place) AS nr FROM win WHERE side = 'b' AND NOT alias AND fixed >= 3 GROUP BY ALL
), items AS (
  SELECT item_id, h, nr FROM own
  UNION SELECT id, h, 0 FROM win WHERE side = 'b' AND alias AND place = 0 AND id IN (SELECT item_id FROM own WHERE nr = 0)
), counted AS (
  SELECT item_id, count(*) AS n_windows FROM own GROUP BY ALL
), hit AS (
  SELECT win.id AS doc_id, item_id, nr, min(place) AS place FROM win JOIN items USING (h) WHERE side = 'd' GROUP BY ALL
), shifts AS (
  SELECT doc_id, item_id, place - nr AS shift, count(*) AS n FROM hit GROUP BY ALL
), shift AS (
  SELECT doc_id, item_id, arg_min(shift, -n * 1000000000 + shift) AS shift, CAST(sum(n) AS BIGINT) AS windows FROM shifts GROUP BY ALL
), found AS (
  SELECT * FROM shift JOIN counted USING (item_id) WHERE windows >= 0.8 * n_windows
), slots AS (
  SELECT DISTINCT side, id, place, substr(x, 1, 2) AS kind, CASE WHEN len(x) > 4 THEN substr(x, 4) END AS value
  FROM (SELECT side, id, unnest(w) AS x, unnest(range(0, CAST(len(w) AS BIGINT))) AS place FROM canon) WHERE x[1] = '<'
), laid AS (
  SELECT f.doc_id, f.item_id, a.kind, a.value AS asked, b.value FROM found f
  JOIN slots a ON a.side = 'b' AND a.id = f.item_id JOIN slots b ON b.side = 'd' AND b.id = f.doc_id AND b.kind = a.kind AND b.place = a.place + f.shift
), by_value AS (
  SELECT doc_id, item_id, kind, asked, min(value) <> max(value) AS mixed, bool_or(value <> asked) AS other FROM laid GROUP BY ALL
), checked AS (
  SELECT doc_id, item_id, bool_or(mixed) AS mixed, bool_or(other) AS other FROM by_value GROUP BY ALL
)
SELECT doc_id, item_id, windows, CAST(n_windows AS BIGINT) AS n_windows, windows / n_windows AS cover, coalesce(other, FALSE) AS reparameterised
FROM found LEFT JOIN checked USING (doc_id, item_id) WHERE NOT coalesce(mixed, FALSE)
"""
