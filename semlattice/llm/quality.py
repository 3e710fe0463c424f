"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded (shares of byte
classes, word lengths, distinct words, a signed random projection of its words), passed
through a small layer, and gated attention (tanh times sigmoid, as in Ilse et al.) weighs the
passages; the weighted representation gives the document's score. Only document labels are
learnt from, by Adam on the logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import small_batches, table
from .toxicity import SCHEMA, held_out, labelled, one_row_each

PASSAGE = 64
PROJECTIONS = 8
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", "#$%&*@^~", "|", "<>{}[]()=/\\_+", "-:;\"'`", "\t\r\x0b\x0c")


def _class_of() -> np.ndarray:
    out = np.full(256, len(_CLASSES), np.int64)  # control bytes
    for i, chars in enumerate(_CLASSES):
        out[[ord(c) for c in chars]] = i
    out[0x80:] = len(_CLASSES) + 1
    return out


CLASS_OF = _class_of()
N_CLASSES = len(_CLASSES) + 2
N_FEATURES = N_CLASSES + 5 + PROJECTIONS


@dataclass(frozen=True)
class Mil:
    """sample: most labelled rows that are learnt from. hidden, attention: widths. least: score from which 1 is predicted."""

    sample: int = 6_000
    hidden: int = 16
    attention: int = 8
    epochs: int = 40
    batch: int = 256
    rate: float = 0.01
    decay: float = 1e-4
    least: float = 0.3


def encode(words: bw.Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and where each row's passages begin. A row without words has no passage."""
    per_row = -(-words.counts // PASSAGE)
    at = np.concatenate([[0], np.cumsum(per_row)])
    n = int(at[-1])
    if not n:
        return np.zeros((0, N_FEATURES), np.float32), at
    row = np.repeat(np.arange(len(per_row)), per_row)
    first = words.first[row] + (np.arange(n) - at[row]) * PASSAGE
    end = np.minimum(first + PASSAGE, words.first[row + 1])
    begin_byte = words.start[first]
    # bytes up to the next passage's first word or the row's end
    end_byte = np.where(end < words.first[row + 1], words.start[np.minimum(end, len(words.start) - 1)], words.row_at[row + 1])
    count = end - first
    size = end_byte - begin_byte
    passage_of_byte = np.repeat(np.arange(n), size)
    where = np.repeat(begin_byte - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    shares = np.bincount(passage_of_byte * N_CLASSES + CLASS_OF[words.data[where]], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / size[:, None]
    # words of consecutive passages are consecutive
    h = words.hashes()
    passage = np.repeat(np.arange(n), count)
    length = (words.end - words.start).astype(np.float64)
    heads = first
    mean = np.add.reduceat(length, heads) / count
    spread = np.sqrt(np.maximum(np.add.reduceat(length * length, heads) / count - mean * mean, 0))
    _, one_of_each = np.unique(h ^ bw.mix(passage.astype(np.uint64)), return_index=True)
    distinct = np.bincount(passage[one_of_each], minlength=n) / count
    again = np.zeros(len(h))
    again[1:] = h[1:] == h[:-1]
    repeated = np.add.reduceat(again, heads) / count
    signs = [np.add.reduceat(((h >> np.uint64(i)) & np.uint64(1)).astype(np.float64) * 2 - 1, heads) / np.sqrt(count) for i in range(PROJECTIONS)]
    return np.column_stack([shares, np.log1p(count), mean / 10, spread / 10, distinct, repeated, *signs]).astype(np.float32), at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Parameters: standardisation, W b1 (encoder), V U w (gated attention), c b (score)."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.p = parts

    @classmethod
    def new(cls, x: np.ndarray, spec: Mil) -> "Model":
        rng = np.random.default_rng(5)
        d, h, a = N_FEATURES, spec.hidden, spec.attention
        mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(d), np.ones(d))
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        return cls({"mean": mean.astype(np.float64), "scale": scale.astype(np.float64), "W": draw(d, h), "b1": np.zeros(h), "V": draw(h, a), "U": draw(h, a), "w": draw(a), "c": draw(h), "b": np.zeros(1)})

    def forward(self, x: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> tuple:
        """Logits of bags that each have passages, and what the gradients need."""
        p = self.p
        xs = np.clip((x - p["mean"]) / p["scale"], -8, 8)
        e = np.tanh(xs @ p["W"] + p["b1"])
        t, g = np.tanh(e @ p["V"]), _sigmoid(e @ p["U"])
        s = (t * g) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, heads), counts))
        a = s / np.repeat(np.add.reduceat(s, heads), counts)
        z = np.add.reduceat(a[:, None] * e, heads)
        return z @ p["c"] + p["b"][0], (xs, e, t, g, a, z)

    def gradients(self, kept: tuple, heads: np.ndarray, counts: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        """d: the loss's derivative by each logit."""
        p, (xs, e, t, g, a, z) = self.p, kept
        dz = np.repeat(d[:, None] * p["c"], counts, axis=0)
        da = (dz * e).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, heads), counts))
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        de = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - e * e)
        return {"W": xs.T @ de, "b1": de.sum(0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}

    def scores(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A score for each bag; a bag without passages has the zero representation."""
        counts = np.diff(at)
        full = np.flatnonzero(counts)
        logits = np.full(len(counts), self.p["b"][0])
        if len(full):
            logits[full] = self.forward(x, at[:-1][full], counts[full])[0]
        return _sigmoid(logits)


def train(bags: list[tuple[np.ndarray, int]], spec: Mil) -> Model:
    """bags: passages and label of each document of the sample."""
    bags = [b for b in bags if len(b[0])]
    model = Model.new(np.concatenate([b[0] for b in bags]) if bags else np.zeros((0, N_FEATURES)), spec)
    if not bags:
        return model
    share = np.clip(np.mean([y for _, y in bags]), 0.01, 0.99)
    model.p["b"][0] = np.log(share / (1 - share))
    names = ("W", "b1", "V", "U", "w", "c", "b")
    m1, m2, step = {k: np.zeros_like(model.p[k]) for k in names}, {k: np.zeros_like(model.p[k]) for k in names}, 0
    for epoch in range(spec.epochs):
        order = np.random.default_rng([29, epoch]).permutation(len(bags))
        rate = spec.rate * (0.2 if epoch >= spec.epochs * 3 // 4 else 1)
        for i in range(0, len(order), spec.batch):
            part = [bags[j] for j in order[i : i + spec.batch]]
            counts = np.array([len(b[0]) for b in part])
            heads = np.cumsum(counts) - counts
            logits, kept = model.forward(np.concatenate([b[0] for b in part]).astype(np.float64), heads, counts)
            d = (_sigmoid(logits) - np.array([b[1] for b in part])) / len(part)
            step += 1
            for k, g in model.gradients(kept, heads, counts, d).items():
                g = g + spec.decay * model.p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                model.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, spec: Mil = Mil(), label: str = "quality") -> Model:
    """Passages are encoded by many tasks; one task learns from the bounded sample and gives back a few thousand numbers.

    Of rows that share a doc_id one is learnt from.
    """
    small_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in bw.slices(batch.column(1), bw.NON_SPACE):
                x, at = encode(words)
                part = slice(words.rows.start, words.rows.stop)
                columns = [batch.column(i).slice(part.start, part.stop - part.start) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["doc_id", "y", "passages"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        bags = [(np.frombuffer(x, np.float32).reshape(-1, N_FEATURES), y) for x, y in zip(frame["passages"], frame["y"], strict=True)]
        return pd.DataFrame([(k, list(v.shape), v.reshape(-1).tolist()) for k, v in train(bags, spec).p.items()], columns=["name", "shape", "numbers"])

    rows = labelled(docs, labels, label, spec.sample).mapInArrow(extract, "doc_id long, y int, passages binary")
    parts = one_row_each(rows, "passages").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda f: learn(f), "name string, shape array<int>, numbers array<double>").collect()
    if not parts:
        return train([], spec)
    return Model({r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in parts})


def scores(docs: DataFrame, model: Model, spec: Mil = Mil()) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs, from whole texts.

    Null or empty text: the score of an empty bag. Null doc_id: scored likewise. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    parts = model.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(parts)
        for batch in batches:
            for words in bw.slices(batch.column(1), bw.NON_SPACE):
                score = own.scores(*encode(words))
                n = len(score)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.rows.start, n), batch.column(2).slice(words.rows.start, n), pa.array(score), pa.array((score >= spec.least).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)


def op4_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the labels that aren't held out; all documents are scored."""
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
