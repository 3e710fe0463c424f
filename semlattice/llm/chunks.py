"""Substring duplicates by content-defined chunking with a gear rolling hash.

A text is cut after words at which the gear hash of the last 16 bytes (h = 2 h + G[byte]
modulo 2^16) falls below a bound, so cuts depend on near content only: an insertion changes
the chunks it touches and no others. A word whose gear hash is the least of all words at most
`near` words away ends a chunk too: so the least of each period of a repeating stretch does,
and long stretches without a hash below the bound are cut by their content as well. There is
no least or largest chunk, which would carry an insertion's effect further. Runs of `unit` consecutive chunks are deduplicated by a digest
of 96 bits from two hashes; in each document, units that other documents have too are merged into
spans. A span ends at cuts, so it holds nearly all of a passage, and a passage must be some words
longer than `min_words` to be found for sure; the README has the miss rate by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import saved, small_batches, table

_GEAR = (bw.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
_GEAR[0x41:0x5B] = _GEAR[0x61:0x7B]


@dataclass(frozen=True)
class Chunking:
    """mean_words: of a chunk. unit: consecutive chunks that are compared as one. min_words: of a span that is reported.

    near: words on either side among which a least gear hash ends a chunk. window: bytes and bits of the gear hash,
    8, 16 or 32; with a smaller one cuts agree sooner after a passage begins.
    """

    mean_words: int = 4
    unit: int = 3
    min_words: int = 20
    near: int = 3
    window: int = 16


def gear(words: bw.Words, window: int) -> np.ndarray:
    """The gear hash at each word's last byte, over at most `window` bytes of its own row."""
    h = _GEAR[words.data]
    s = 1
    while s < window:
        older = h[:-s] << np.uint32(s)
        h[s:] += older
        s *= 2
    at = h[words.end - 1] if len(words.end) else np.zeros(0, np.uint32)
    # what the rows before have left goes out; bits beyond the window's hold older bytes
    begin = np.repeat(words.row_at[:-1], words.counts)
    age = words.end - begin
    early = np.flatnonzero((age < window) & (begin > 0))
    at[early] -= h[begin[early] - 1] << age[early].astype(np.uint32)
    return at & np.uint32((1 << window) - 1)


def least_nearby(h: np.ndarray, words: bw.Words, near: int) -> np.ndarray:
    """Whether no word of the same row at most `near` words away has a smaller hash; equal ones all count."""
    least = np.ones(len(h), bool)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    for s in range(1, min(near, len(h) - 1) + 1):
        same = row[s:] == row[:-s]
        least[s:] &= ~same | (h[s:] <= h[:-s])
        least[:-s] &= ~same | (h[:-s] <= h[s:])
    return least


def units(words: bw.Words, spec: Chunking) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, both digests, first word and end word (counted in the row) of each unit. A row of fewer chunks is one unit."""
    n = len(words.start)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.int32), none, none
    h = gear(words, spec.window)
    cut = (h < np.uint32((1 << spec.window) // spec.mean_words)) | least_nearby(h, words, spec.near)
    cut[words.first[1:][words.counts > 0] - 1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    row = np.searchsorted(words.first, first, "right") - 1
    chunks = np.bincount(row, minlength=len(words.counts))
    to = np.repeat(np.cumsum(chunks), chunks)  # end of the row's chunks
    index = np.arange(len(first))
    head = index == np.repeat(np.cumsum(chunks) - chunks, chunks)
    keep = (index + spec.unit <= to) | head
    end_chunk = np.minimum(index + spec.unit, to)[keep] - 1
    begin, end = words.start[first[keep]], words.end[last[end_chunk]]
    digest = bw.mix(words.hashes(begin, end) + np.minimum(spec.unit, (to - index)[keep]).astype(np.uint64))
    check = (words.second_hashes(begin, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    base = words.first[row[keep]]
    return row[keep], digest, check, first[keep] - base, last[end_chunk] + 1 - base


def unit_rows(docs: DataFrame, spec: Chunking, spans: bool) -> DataFrame:
    """Units of all rows: (digest, check, doc_id) and, if asked for, (text_id, first_word, end_word)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for words in bw.slices(batch.column(1), bw.NON_SPACE):
                row, digest, check, first, end = units(words, spec)
                at = words.rows.start + row
                columns = [digest.view(np.int64), check, ids[at], *([texts[at], first.astype(np.int32), end.astype(np.int32)] if spans else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["digest", "check", "doc_id", "text_id", "first_word", "end_word"][: len(columns)])

    text = F.col("text").cast("string")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.xxhash64(text) if spans else F.lit(0).cast("long")).alias("text_id"))
    return rows.mapInArrow(run, "digest long, check int, doc_id long" + (", text_id long, first_word int, end_word int" if spans else ""))


def repeated_spans(docs: DataFrame, spec: Chunking = Chunking()) -> DataFrame:
    """Rows (doc_id, first_word, end_word, n_words, first_doc, is_first): spans that stand in other documents too.

    Words: runs without ASCII white space, counted from 0; A-Z count as a-z; white space
    between the words is compared too. first_doc: least doc_id that has a part of the span;
    is_first: it is the row's own, so a deduplication keeps it here. Repeats within one
    document alone are no spans. Null or blank text: no spans. Null doc_id: takes no part.
    Rows with one doc_id are one document. Other columns are ignored.
    """
    # written before it is joined back, so that a hot digest's part of the join can be split
    shared = saved(
        unit_rows(docs, spec, spans=False).groupBy("digest", "check").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc < last_doc").select("digest", "check", "first_doc")
    )
    found = unit_rows(docs, spec, spans=True).hint("merge").join(shared, ["digest", "check"]).drop("digest", "check").distinct()
    by_text = W.partitionBy("doc_id", "text_id").orderBy("first_word", "end_word")
    islands = (
        found.withColumn("reach", F.max("end_word").over(by_text.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("new", (F.col("reach").isNull() | (F.col("first_word") >= F.col("reach"))).cast("int"))
        .withColumn("island", F.sum("new").over(by_text.rowsBetween(W.unboundedPreceding, 0)))
    )
    return (
        islands.groupBy("doc_id", "text_id", "island").agg(F.min("first_word").cast("long").alias("first_word"), F.max("end_word").cast("long").alias("end_word"), F.min("first_doc").alias("first_doc"))
        .withColumn("n_words", F.col("end_word") - F.col("first_word")).where(F.col("n_words") >= spec.min_words)
        .select("doc_id", "first_word", "end_word", "n_words", "first_doc", (F.col("doc_id") == F.col("first_doc")).alias("is_first"))
    )


def op8_chunk_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 20 words or more that documents share."""
    return repeated_spans(table(spark, sf_dir, "documents"))
