"""Substring search by a stored index of character trigrams.

Three tables. postings: (bucket, gram, entities), for each run of up to three characters the entities in one of
whose lower-cased labels it begins somewhere; runs of fewer than three stand at a label's end. An entity is
in one row of a gram, and a row lists the entities that one task cut at a time. grams: (bucket, gram, n), how many entities have a gram. labels: (part, entity, s,
label, is_cn) with the entities' classes in a table of their own. Postings lie in folders by the
gram's first character and, within a folder, in ranges of grams; labels in folders by ranges of entities.

A keyword's rarest grams are intersected by a count, and only the labels of what is left are read
and checked. So a search reads a few postings files and a few labels files, however many there are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import holds
from ..plans.scratch import folder, join_checked, numbered, saved
from .graph import canonical_of, labels, types

#: Folders of postings.
BUCKETS = 64
#: Grams of a keyword that are intersected, rarest first; the check of the labels makes up for the others.
GRAMS = 3
#: Entities of a folder of labels, about, and folders at most.
PART_ROWS, PARTS = 1 << 16, 4096
#: Postings that are cut from labels at a time.
CUT_ROWS = 1 << 20


_TABLES = {
    "postings": "gram string, entities array<long>, bucket int", "grams": "gram string, n long, bucket int",
    "labels": "entity long, s string, label string, is_cn boolean, part int", "classes": "entity long, class string, part int",
}


@dataclass(frozen=True)
class Index:
    """The tables `postings`, `grams`, `labels` and `classes` below a path; entities 0 to size - 1 lie in so many folders of equal ranges."""

    spark: SparkSession
    path: str
    size: int
    folders: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}")

    def part(self, entity: Column) -> Column:
        return F.floor(entity * self.folders / self.size).cast("int")


def opened(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    row = spark.read.parquet(f"{path}/meta").first()
    return Index(spark, path, row["size"], row["folders"])


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 1)), F.lit(BUCKETS)).cast("int")


def grams_of(text: Column) -> Column:
    """The distinct runs of three characters of a text, and the shorter ones at its end."""
    # the characters are cut once, so that a long text takes time in proportion
    characters = F.filter(F.array(F.split(text, "")), lambda c: F.size(c) > 0)
    after = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    return F.array_distinct(F.flatten(F.transform(characters, lambda c: F.transform(c, lambda x, i: F.concat(x, after(c, i + 1), after(c, i + 2))))))


def _cut(each: int):
    """A function to (gram, entities) from Arrow batches (entity, label): each label's distinct grams, as grams_of() gives them, about `each` listed at a time.

    Three characters are one number of 63 bits (a character's code plus one, 0 where the text ends), so a label's
    grams are made distinct by a sort of numbers; numbers become texts once for each different one.
    """
    def texts(codes, entities):
        order = np.argsort(codes, kind="stable")
        different, starts = np.unique(codes[order], return_index=True)
        grams = ["".join(chr(((c >> s) & 0x1FFFFF) - 1) for s in (42, 21, 0) if (c >> s) & 0x1FFFFF) for c in different.tolist()]
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)), pa.int32()), pa.array(entities[order]))
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), lists], ["gram", "entities"])

    def cut(batches):
        for batch in batches:
            codes, entities, n = [], [], 0
            for entity, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not label:
                    continue
                c = np.zeros(len(label) + 2, np.int64)
                c[:-2] = np.frombuffer(label.encode("utf-32-le"), np.uint32)
                c[:-2] += 1
                codes.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
                entities.append(np.full(len(codes[-1]), entity, np.int64))
                n += len(codes[-1])
                if n >= each:
                    yield texts(np.concatenate(codes), np.concatenate(entities))
                    codes, entities, n = [], [], 0
            if codes:
                yield texts(np.concatenate(codes), np.concatenate(entities))

    return cut


def postings_of(labels: DataFrame) -> DataFrame:
    """(gram, entities) of labels (entity, label), an entity once for a gram. Only entities of several labels have grams that a label alone doesn't make distinct, so only theirs are shuffled."""
    cut = lambda rows: rows.select("entity", F.lower("label").alias("label")).mapInArrow(_cut(CUT_ROWS), "gram string, entities array<long>")
    several = saved(labels.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity"))
    if several.isEmpty():
        return cut(labels)
    again = cut(join_checked(labels, several, "entity", "left_semi")).select("gram", F.explode("entities").alias("entity")).distinct()
    return cut(join_checked(labels, several, "entity", "left_anti")).unionByName(again.select("gram", F.array("entity").alias("entities")))


def build(t: DataFrame, canonical: DataFrame, path: str | None = None) -> Index:
    """Indexes the labels of all typed entities, under their canonical ids, and writes the tables below path.

    Entities are numbered in the order of their ids, by ranges. Rows of one entity or of one gram may be any share
    of all rows: no table holds a list of them all.
    """
    spark = t.sparkSession
    path = path or f"{folder(spark)}/textindex-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    typed = saved(canonical_of(types(t), canonical, "s").distinct())
    mine = saved(canonical_of(labels(t), canonical, "s").distinct())
    entities = typed.select("s").distinct().hint("merge").join(mine.select("s").distinct(), "s", "left_semi")
    entities = saved(numbered(entities.repartitionByRange(parts, "s").sortWithinPartitions("s"), "entity"))
    size = entities.count()
    index = Index(spark, path, max(1, size), max(1, min(PARTS, size // PART_ROWS)))
    spark.createDataFrame([(index.size, index.folders)], "size long, folders int").write.mode("overwrite").parquet(f"{path}/meta")
    entities = entities.withColumn("part", index.part(F.col("entity")))
    rows = saved(mine.hint("merge").join(entities, "s"))

    def put(df: DataFrame, name: str, folder_of: str, *by: str) -> None:
        df.repartitionByRange(parts, folder_of, *by).sortWithinPartitions(folder_of, *by).write.mode("overwrite").partitionBy(folder_of).parquet(f"{path}/{name}")

    put(rows.select("part", "entity", "s", "label", "is_cn"), "labels", "part", "entity")
    put(typed.hint("merge").join(entities, "s").select("part", "entity", "class"), "classes", "part", "entity")
    postings = saved(postings_of(rows.select("entity", "label")).withColumn("bucket", _bucket(F.col("gram"))))
    put(postings.select("bucket", "gram", "entities"), "postings", "bucket", "gram", "entities")
    put(postings.groupBy("bucket", "gram").agg(F.sum(F.size("entities")).alias("n")), "grams", "bucket", "gram")
    return index


def _keys(spark: SparkSession, keyword: str) -> list[tuple[int, str]]:
    """(bucket, gram) of a keyword's full grams; of a shorter keyword, itself. As Spark folds case."""
    low = F.lower(F.lit(keyword))
    cut = F.when(F.length(low) < 3, F.array(low)).otherwise(F.filter(grams_of(low), lambda g: F.length(g) == 3))
    return [(r["bucket"], r["gram"]) for r in spark.range(1).select(F.explode(cut).alias("gram")).select(_bucket(F.col("gram")).alias("bucket"), "gram").collect()]


def candidates(index: Index, keyword: str) -> DataFrame:
    """(entity) that has the keyword's rarest grams; of a keyword below three characters, a gram that begins with it."""
    keys = _keys(index.spark, keyword)
    if len(keys[0][1]) < 3:
        bucket, start = keys[0]
        return index.table("postings").where((F.col("bucket") == bucket) & F.col("gram").startswith(start)).select(F.explode("entities").alias("entity")).distinct()
    any_of = lambda some: F.col("bucket").isin(sorted({b for b, _ in some})) & F.col("gram").isin([g for _, g in some])
    known = sorted((r["n"], r["bucket"], r["gram"]) for r in index.table("grams").where(any_of(keys)).collect())
    if len(known) < len(keys):
        return index.table("postings").where("false").select(F.explode("entities").alias("entity"))
    rare = [(b, g) for _, b, g in known[:GRAMS]]
    rows = index.table("postings").where(any_of(rare)).select(F.explode("entities").alias("entity"))
    return rows.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("entity")


def search(index: Index, keyword: str, cls: str | None = None) -> DataFrame:
    """(s, class, name, cn_names, label): as query.search(), by the index. An empty keyword is in every label."""
    every, classes = index.table("labels"), index.table("classes")
    if keyword:
        found = saved(candidates(index, keyword))
        # at most PARTS numbers; the other folders are not read
        parts = [r["part"] for r in found.select(index.part(F.col("entity")).alias("part")).distinct().collect()]
        every, classes = (join_checked(rows.where(F.col("part").isin(parts)), found, "entity", "left_semi") for rows in (every, classes))
    every = saved(every)
    hits = every.where(holds(F.col("label"), F.lit(keyword))).groupBy("entity").agg(F.min("label").alias("label"))
    named = every.groupBy("entity", "s").agg(
        F.coalesce(F.min(F.when(~F.col("is_cn"), F.col("label"))), F.min("label")).alias("name"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_cn"), F.col("label")))), "、").alias("cn_names"))
    typed = (classes if cls is None else classes.where(F.col("class") == cls)).groupBy("entity").agg(F.min("class").alias("class"))
    return typed.hint("merge").join(hits, "entity").hint("merge").join(named, "entity").select("s", "class", "name", "cn_names", "label")
