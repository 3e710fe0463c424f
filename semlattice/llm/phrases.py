"""Frequent phrases and their collocation scores by SETM, set-oriented mining over stored relations.

Relation k holds the occurrences of k-word groups, sorted by piece and position. It is stored in
blocks, each of one language and of whole texts, so no piece spans two blocks; a gap in the
positions parts two pieces. Every length is one round:

1. the groups of the relation are counted, per block first, then over all blocks;
2. the relation is semi-joined with the groups that are frequent;
3. what is left is merge-joined with itself at adjacent positions: the group at a position and
   the one at the next overlap in all words but their first and last, and give a group that is one
   word longer. The result is the next relation, stored again.

Groups have dense ids; a group of k + 1 words is the pair of its first k words' id and its last
word's id, so nothing is compared by hash. Counts of one block are joined back by (block, group),
which has at most one row for each block and group however frequent the group is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import discard, numbered
from .bytewords import slices
from .common import ARROW_ROWS, batches_of, join_checked, saved, table

#: Bytes of texts of a block, about; one longer text is a block of its own.
BLOCK_BYTES = 24 << 20
_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_PIECE_ENDS
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_RELATION = "block long, lang string, at binary, code binary, local int, word string, first long, last long, n long"


@dataclass(frozen=True)
class Mining:
    """least: occurrences that make a phrase frequent. longest: words. percent: a phrase drops out if a longer one around it has that share of its count. top: phrases of a language."""

    least: int = 100
    longest: int = 5
    percent: int = 100
    top: int = 2000


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Positions and word codes of all words of the texts, and the words by code. A null text has no words.

    Positions rise by one within a piece and by more from piece to piece.
    """
    found, codes, base = [], [], 0
    words: list[pa.Array] = []
    for part in slices(texts, _WORD):
        size = part.end - part.start
        ends = np.concatenate([[0], np.cumsum(_PIECE_ENDS[part.data])])
        row = np.repeat(np.arange(len(part.counts)), part.counts)
        gap = np.ones(len(part.start), np.int64)
        gap[1:] += (ends[part.start[1:]] > ends[part.end[:-1]]) | (row[1:] != row[:-1])
        gap[:1] += 1
        found.append(base + np.cumsum(gap))
        base = int(found[-1][-1]) if len(gap) else base
        inside = _WORD[part.data]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        words.append(pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[part.data[inside]])]))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.large_string())
    coded = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    # the most frequent words get the least codes, which take less room
    order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return np.concatenate(found), rank[codes], coded.dictionary.take(pa.array(order))


def _relation_row(block: int, lang: str, at: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    """Positions as differences, and codes."""
    return _batch(block=[block], lang=[lang], at=[packed(np.diff(at, prepend=0))], code=[packed(code)])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^31: how many, then four planes of their bytes, of which the higher ones are mostly zeros, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    size = 4 * int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").reshape(-1)


def _batch(**columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "lang": pa.string(), "at": pa.binary(), "code": pa.binary(), "local": pa.int32(), "word": pa.string(), "first": pa.int64(), "last": pa.int64(), "n": pa.int64()}
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[k], kind) if k in columns and not isinstance(columns[k], pa.Array) else columns[k].cast(kind) if k in columns else pa.nulls(n, kind) for k, kind in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


def _constant(value: object, n: int, kind: pa.DataType) -> pa.Array:
    return pa.repeat(pa.scalar(value, kind), n)


def first_relation(docs: DataFrame) -> DataFrame:
    """Relation 1: for each block a row (block, lang, at, code), and a row (block, lang, local, word, n) for each of its words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part"))

    def blocks(tables: list[pa.RecordBatch], nr: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(tables)
        lang = whole["lang"].combine_chunks().dictionary_encode()
        of = lang.indices.to_numpy(zero_copy_only=False)
        for i, name in enumerate(lang.dictionary.to_pylist()):
            at, code, words = occurrences(whole["text"].combine_chunks().filter(pa.array(of == i)))
            if len(at):
                block = (whole["part"][0].as_py() << 32) + nr + i
                yield _relation_row(block, name, at, code)
                n, size = np.bincount(code, minlength=len(words)), len(words)
                yield _batch(block=_constant(block, size, pa.int64()), lang=_constant(name, size, pa.string()), local=np.arange(size, dtype=np.int32), word=words, n=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, nr = [], 0, 0
        for batch in batches:
            kept.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from blocks(kept, nr)
                nr += sum(b.num_rows for b in kept)
                kept, size = [], 0
        if kept:
            yield from blocks(kept, nr)

    with batches_of(docs.sparkSession, ARROW_ROWS):
        return saved(rows.mapInArrow(run, _RELATION), compression="zstd")


def frequent_words(relation: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, f) of the words with f >= least; (lang, n) of all words."""
    counts = relation.where("local is not null").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = saved(counts)
    words, totals = saved(numbered(counts.where(F.col("f") >= least))), saved(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    discard(counts)
    return words, totals


def frequent_groups(relation: DataFrame, least: int) -> DataFrame:
    """(id, first, last, f): groups of a relation with f >= least. first: id of the group without its last word, last: that word's id."""
    counts = relation.where("local is not null").groupBy("first", "last").agg(F.sum("n").alias("f"))
    return saved(numbered(counts.where(F.col("f") >= least)))


def next_relation(relation: DataFrame, groups: DataFrame, on: list[str], last: Column) -> DataFrame:
    """The relation semi-joined with its frequent groups, merge-joined with itself at adjacent positions.

    on: the columns that identify a group. last: the id of a frequent group's last word. The rows of the result
    are like those of the relation: (block, lang, at, code) and, for each group of a block, (block, local, first, last, n).
    """
    here = join_checked(relation.where("local is not null").select("block", "local", *on), groups.select(*on, "id", last.alias("last_id")), on, "left")
    known = here.groupBy("block").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("local", "id", "last_id"))).alias("known")).where(F.size("known") > 0)
    known = known.select("block", *[F.col(f"known.{c}").alias(c) for c in ("local", "id", "last_id")])
    rows = relation.where("at is not null").select("block", "lang", "at", "code").hint("merge").join(known, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, lang, at, code = (batch.column(c)[i].as_py() for c in range(4))
                local, ids, last_ids = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(4, 7))
                yield from extended(block, lang, np.cumsum(unpacked(at), dtype=np.int32), unpacked(code), local, ids, last_ids)

    # a row holds a whole block
    with batches_of(relation.sparkSession, 1):
        return saved(rows.select("block", "lang", "at", "code", "local", "id", "last_id").mapInArrow(run, _RELATION), compression="zstd")


def extended(block: int, lang: str, at: np.ndarray, code: np.ndarray, local: np.ndarray, ids: np.ndarray, last_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Steps 2 and 3 for one block. local: the codes that are frequent in it, with their groups' and last words' ids."""
    # numbers of a block fit four bytes; only pairs of them need eight
    place = np.full(int(max(code.max(), local.max())) + 1, -1, np.int32)
    place[local] = np.arange(len(local), dtype=np.int32)
    group = place[code]
    known = group >= 0
    at, group = at[known], group[known]
    meets = at[1:] == at[:-1] + 1
    at = at[:-1][meets]
    if not len(at):
        return
    word_ids, word = np.unique(last_ids, return_inverse=True)
    key = group[:-1][meets].astype(np.int64) * len(word_ids) + word[group[1:][meets]]
    del group, meets, known
    pairs, code, n = np.unique(key, return_inverse=True, return_counts=True)
    del key
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    code = rank[code]
    yield _relation_row(block, lang, at, code)
    for a in range(0, len(pairs), 1 << 17):
        part = pairs[a : a + (1 << 17)]
        yield _batch(block=_constant(block, len(part), pa.int64()), local=rank[a : a + len(part)], first=ids[part // len(word_ids)], last=word_ids[part % len(word_ids)], n=n[a : a + len(part)])


def frequent_phrases(docs: DataFrame, spec: Mining) -> tuple[DataFrame, DataFrame]:
    """(words: ids, phrase, lang, f, k) of all phrases of 1 to spec.longest words with f >= spec.least, and (lang, n)."""
    relation = first_relation(docs)
    words, totals = frequent_words(relation, spec.least)
    level = words.select("id", F.array("id").alias("words"), F.col("word").alias("phrase"), "lang", "f", F.lit(1).alias("k"))
    levels, groups, on, last = [level], words, ["lang", "word"], F.col("id")
    for k in range(2, spec.longest + 1):
        relation, done = next_relation(relation, groups, on, last), relation
        discard(done)
        groups, on, last = frequent_groups(relation, spec.least), ["first", "last"], F.col("last")
        before = level.select(F.col("id").alias("first"), "words", "phrase", "lang")
        ends = words.select(F.col("id").alias("last"), "word")
        level = saved(
            groups.hint("merge").join(before, "first").hint("merge").join(ends, "last")
            .select("id", F.concat("words", F.array("last")).alias("words"), F.concat_ws(" ", "phrase", "word").alias("phrase"), "lang", "f", F.lit(k).alias("k")))
        levels.append(level)
    discard(relation)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.drop("id"), totals


def collocations(docs: DataFrame, spec: Mining = Mining()) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's best phrases of two words and more.

    Null lang: `und`. Null, empty and blank texts have no words; all other columns are ignored, and a
    repeated row counts as often as it stands there. Cutting a phrase of count a into parts of counts l
    and r gives floor(1000 * a * n / (l * r)), n being the language's words; the lowest cut counts, the
    first of equal ones. Phrases inside a longer one with spec.percent of their count drop out.
    """
    phrases, totals = frequent_phrases(docs, spec)
    phrases = saved(phrases)
    several = phrases.where("k > 1")
    counts = phrases.select(F.col("words").alias("part"), F.col("f").alias("part_f"))
    cuts = several.select("words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("words", "cut", F.slice("words", F.lit(1), F.col("cut")).alias("left"), F.slice("words", F.col("cut") + 1, F.col("k")).alias("right"))
    cuts = cuts.hint("merge").join(counts.select(F.col("part").alias("left"), F.col("part_f").alias("l")), "left")
    cuts = cuts.hint("merge").join(counts.select(F.col("part").alias("right"), F.col("part_f").alias("r")), "right").select("words", "cut", "l", "r")
    # every part of a longer phrase, with the longer one's count
    spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> slice(words, i, m))))")
    inside = several.where("k > 2").select(F.explode(spans).alias("words"), F.col("f").alias("longer")).groupBy("words").agg(F.max("longer").alias("longer"))
    left = several.hint("merge").join(inside, "words", "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(spec.percent) * F.col("f")))
    # products of three counts need more than 64 bits
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    scored = (
        left.hint("merge").join(cuts, "words").join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals.hint("merge"), "lang")
        .withColumn("up", wide("f", 18) * F.lit(1000).cast("decimal(4,0)")).withColumn("up", F.col("up").cast("decimal(20,0)") * wide("n", 18)).withColumn("down", wide("l", 19) * wide("r", 18))
        .withColumn("score", F.expr("up div down")))
    best = scored.groupBy("lang", "phrase", "f", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("f").desc(), "phrase"))
    return (
        best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= spec.top)
        .select("lang", "rank", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", F.col("best.score").alias("score")))


def op12_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two to five words that occur 100 times or more."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^ \t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS part FROM documents)
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) t(k) WHERE len(w) >= k)
), counts AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), frequent AS (
  SELECT * FROM counts WHERE f >= 100
), cuts AS (
  SELECT lang, phrase, k, w, f, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, cut, (1000 * CAST(c.f AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS score, n
  FROM cuts c JOIN totals USING (lang)
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), parts AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, w, f, m, unnest(range(1, k - m + 2)) AS i FROM frequent, range(2, 5) t(m) WHERE k > m) GROUP BY 1, 2
), kept AS (
  SELECT b.* FROM best b LEFT JOIN parts p USING (lang, phrase) WHERE p.longer IS NULL OR 100 * p.longer < 100 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
