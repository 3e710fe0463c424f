"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: each distinct word, word beginning (4 and 5 bytes, for compounds), pair of
neighbouring words and pair with one word between, hashed to 2^20 places; each counts once.
FTRL-proximal gives every coordinate its own rate and, by its L1 term, exact zeros, so the
weights that are left are few and go to all tasks as a sparse vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import free_name, saved, small_batches, table

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Ftrl:
    """sample: most labelled rows that are learnt from, a bound on what one task trains on and on what weights can exist.

    bits: of the hash. alpha, beta, l2: as in McMahan et al. epochs: passes over the sample.
    least_texts: of the sample that have a feature.
    """

    sample: int = 16_000
    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 6
    least_texts: int = 4
    threshold: float = 0.5


def features(words: bw.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of each row, with repeats, and where each row's begin."""
    h, n = words.hashes(), len(words.start)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    shift = np.uint64(64 - bits)
    kinds, rows = [h >> shift], [row]
    length = words.end - words.start
    for size, salt in ((4, 0x51ED270B), (5, 0x2545F491)):
        long = np.flatnonzero(length > size)
        kinds.append(bw.mix(words.hashes(words.start[long], words.start[long] + size) + np.uint64(salt)) >> shift)
        rows.append(row[long])
    for gap, salt in ((1, 0x9E3779B1), (2, 0x85EBCA6B)):
        if n > gap:
            pair = bw.mix(h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + h[gap:] + np.uint64(salt)) >> shift
            same = row[:-gap] == row[gap:]
            kinds.append(pair[same])
            rows.append(row[:-gap][same])
    place, owner = np.concatenate(kinds).astype(np.int32), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return place[order], np.searchsorted(owner[order], np.arange(len(words.counts) + 1))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, y) of at most `limit` labelled rows that aren't held out, in hash order; rows without doc_id or label don't count."""
    chosen = saved(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most `limit` rows of 12 bytes
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def one_row_each(rows: DataFrame, value: str) -> DataFrame:
    """(doc_id, y, value): of several rows with one doc_id the one whose value has the least hash, so the sample's bound holds."""
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min_by(value, F.struct(F.xxhash64(value), value)).alias(value))


def train(rows: list[tuple[np.ndarray, int]], spec: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that aren't zero. rows: distinct places of a text, and its label. The bias is place 2^bits."""
    size = (1 << spec.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = spec.l1
    texts = np.zeros(size, np.int64)
    for at, _ in rows:
        texts[at] += 1
    rows = [(at[texts[at] >= spec.least_texts], y) for at, y in rows]

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((spec.beta + np.sqrt(n[at])) / spec.alpha + spec.l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for epoch in range(spec.epochs):
        for i in np.random.default_rng([17, epoch]).permutation(len(rows)):
            at, y = rows[i]
            at = np.append(at, size - 1)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / spec.alpha * w
            n[at] += g * g
    w = weights(np.arange(size))
    return np.flatnonzero(w), w[w != 0]


def fit(docs: DataFrame, labels: DataFrame, spec: Ftrl = Ftrl(), label: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """The sparse weights, learnt in one task from the bounded sample; its features are extracted by many.

    Of rows that share a doc_id one is learnt from. Without labels: a bias only.
    """
    small_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(2)
            for words in bw.slices(batch.column(1), bw.NON_SPACE):
                place, at = features(words, spec.bits)
                distinct = [np.unique(place[a:b]).astype(np.int32).tobytes() for a, b in zip(at, at[1:], strict=False)]
                part = slice(words.rows.start, words.rows.stop)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), y.slice(part.start, part.stop - part.start), pa.array(distinct, pa.binary())], ["doc_id", "y", "places"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        place, value = train([(np.frombuffer(p, np.int32), y) for p, y in zip(frame["places"], frame["y"], strict=True)], spec)
        return pd.DataFrame({"place": place, "value": value})

    rows = labelled(docs, labels, label, spec.sample).mapInArrow(extract, "doc_id long, y int, places binary")
    learnt = one_row_each(rows, "places").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda f: learn(f), "place long, value double").toPandas()
    return learnt["place"].to_numpy(np.int64), learnt["value"].to_numpy(np.float64)


def _scorer(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], spec: Ftrl) -> Callable[[], Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]]]:
    """For a task: a function that gives the scores of an Arrow column's texts in slices, each with its first row."""
    size = 1 << spec.bits
    place, value = weights
    bias = float(value[place == size].sum())
    sparse = docs.sparkSession.sparkContext.broadcast((place[place < size], value[place < size]))

    def weigh() -> Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]]:
        dense = np.zeros(size, np.float32)
        dense[sparse.value[0]] = sparse.value[1]

        def each(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
            for words in bw.slices(texts, bw.NON_SPACE):
                at_place, at = features(words, spec.bits)
                w = dense[at_place]
                live = np.flatnonzero(w)  # few, as most weights are zero
                owner = np.searchsorted(at, live, "right") - 1
                key = np.unique(owner.astype(np.int64) << (spec.bits + 1) | at_place[live])
                total = np.bincount(key >> (spec.bits + 1), dense[key & (size - 1)], minlength=len(words.counts)) + bias
                yield words.rows.start, 1 / (1 + np.exp(-np.clip(total, -30, 30)))

        return each

    return weigh


def scores(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], spec: Ftrl = Ftrl()) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs, from whole texts.

    Null or empty text: the score of a text without features. Null doc_id: scored likewise. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    weigh = _scorer(docs, weights, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = weigh()
        for batch in batches:
            for first, score in each(batch.column(1)):
                n = len(score)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(score), pa.array((score >= spec.threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, spec: Ftrl = Ftrl()) -> DataFrame:
    """The rows of docs that aren't predicted toxic, each decided by its own text, whatever its doc_id. One narrow pass; all columns stay as they are, whatever their names."""
    small_batches(docs.sparkSession)
    weigh, nr = _scorer(docs, fit(docs, labels, spec), spec), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = weigh()
        for batch in batches:
            clean = np.concatenate([s < spec.threshold for _, s in score(batch.column(nr))]) if len(batch) else np.zeros(0, bool)
            yield batch.select(range(nr)).filter(pa.array(clean))

    # the text once more under a name of its own, as a string
    return docs.withColumn(free_name(docs, "text_as_string"), F.col("text").cast("string")).mapInArrow(run, docs.schema)


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the labels that aren't held out; all documents are scored."""
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
