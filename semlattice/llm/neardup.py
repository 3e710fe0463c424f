"""MinHash near-duplicates by a multi-index Hamming join.

Each document's set of word shingles gets a signature of K symbols of 16 bits (the least
value of K random orders of the set). Two sets of similarity J agree in a symbol with
probability J, so the distance (number of unlike symbols) of a pair at the threshold is
binomial; the join's distance limit t lies 4.5 standard deviations above its mean. The
symbols are cut into m = ceil((t + 1) / 2) chunks: by the pigeonhole principle any pair
within distance t has a chunk with at most one unlike symbol. Each chunk is therefore
looked up once for every symbol that may be the unlike one, with that symbol left out,
so that all pairs within t share a key. Pairs that share a key are then confirmed on
their full shingle sets.

Large groups: equal word sequences are first folded into one, and of keys with the same
members one is looked at. The members of a key are compared by their signatures, and those
within t of each other make up coarse groups, which no similar pair leaves; a key that texts
share by chance joins nothing. Pairs are confirmed inside coarse groups. Both steps work in
blocks of bounded size, only on what is not connected yet, and a block gives back a spanning
forest of links, never all of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import components, free_name, hashable, join_checked, row_key, saved, small_batches

#: Largest number of members and of bytes of shingle sets in one block of a coarse group, and of members of a key.
BLOCK_ROWS, BLOCK_BYTES, KEY_ROWS = 1024, 24 << 20, 2048


@dataclass(frozen=True)
class NearDup:
    """k: words in a shingle. percent: pairs with 100 * intersection >= percent * union are linked. symbols: K."""

    k: int = 5
    percent: int = 80
    symbols: int = 96

    @cached_property
    def distance(self) -> int:
        p = 1 - self.percent / 100
        return min(self.symbols - 1, math.ceil(self.symbols * p + 4.5 * math.sqrt(self.symbols * p * (1 - p))))

    @cached_property
    def chunks(self) -> list[range]:
        m = (self.distance + 2) // 2
        cuts = [i * self.symbols // m for i in range(m + 1)]
        return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def signatures(self, sets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """K symbols for each row whose set isn't empty."""
        rng = np.random.default_rng(20240607)
        a = rng.integers(0, 1 << 32, self.symbols, np.uint64).astype(np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, self.symbols, np.uint64).astype(np.uint32)
        heads = at[:-1][np.diff(at) > 0]
        low = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
        out = np.empty((len(heads), self.symbols), np.uint16)
        for i in range(self.symbols if len(heads) else 0):
            x = low * a[i] + b[i]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[:, i] = (np.minimum.reduceat(x, heads) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One key for each chunk and symbol left out: every symbol has its turn, so K keys a row."""
        salt = bw.mix(np.arange(1, 65536 * 2, 2, dtype=np.uint64)[: self.symbols] * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        terms = bw.mix(signatures.astype(np.uint64) + np.uint64(1)) * salt
        out = np.empty(signatures.shape, np.uint64)
        for c in self.chunks:
            whole = terms[:, c.start : c.stop].sum(1, dtype=np.uint64)
            for s in c:
                out[:, s] = bw.mix(whole - terms[:, s] + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        return out


def _sequence_digests(words: bw.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's whole word sequence."""
    h, at = words.hashes(), words.first
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        place = np.arange(len(h), dtype=np.int64) - np.repeat(at[:-1], np.diff(at))
        terms = bw.mix(h ^ np.uint64(salt)) * (bw.mix(place.astype(np.uint64) + np.uint64(salt)) | np.uint64(1))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        out.append(bw.mix(sums[at[1:]] - sums[at[:-1]] + words.counts.astype(np.uint64)))
    return out[0], out[1]


def _list_column(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))


def fingerprints(docs: DataFrame, spec: NearDup) -> DataFrame:
    """Rows (doc_id, d1, d2, n_shingles, keys, signature), one for each row of docs; no keys and no signature for an empty set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in bw.slices(batch.column(1), bw.NON_SPACE):
                sets, at = bw.shingles(words, spec.k)
                d1, d2 = _sequence_digests(words)
                n = np.diff(at)
                signatures = spec.signatures(sets, at)
                keys = spec.keys(signatures)
                filled = np.where(n > 0, spec.symbols, 0)
                key_at = np.concatenate([[0], np.cumsum(filled)])
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * key_at).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(signatures))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.rows.start, len(n)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n.astype(np.int64)), _list_column(keys.reshape(-1), key_at), raw],
                    ["doc_id", "d1", "d2", "n_shingles", "keys", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, d1 long, d2 long, n_shingles long, keys array<long>, signature binary"
    )


def _members(docs: DataFrame, wanted: DataFrame, spec: NearDup) -> DataFrame:
    """Signatures and shingle sets of the rows of docs that stand for their word sequence in a coarse group."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).hint("merge").join(wanted, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in bw.slices(batch.column(1), bw.NON_SPACE):
                sets, at = bw.shingles(words, spec.k)
                part = slice(words.rows.start, words.rows.stop)
                filled = np.flatnonzero(np.diff(at) > 0)
                signatures = spec.signatures(sets, at)
                rest = [c.slice(part.start, part.stop - part.start).take(pa.array(filled)) for c in (batch.column(0), batch.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array([x.tobytes() for x in signatures], pa.binary()), pa.array([sets[at[r] : at[r + 1]].tobytes() for r in filled], pa.binary())],
                    ["node", "root", "signature", "shingles"],
                )

    return chosen.select("node", "text", "root").mapInArrow(run, "node long, root long, signature binary, shingles binary")


class _Forest:
    """Connected members of a block; labels are whole arrays, so that a row is compared with unconnected ones only."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        self.label[self.label == max(x, y)] = min(x, y)


def block_links(nodes: np.ndarray, side: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], spec: NearDup) -> list[tuple[int, int]]:
    """A spanning forest of the links between the rows of side 0 and all rows (or of side 0 and side 1, if there is a side 1)."""
    n = len(nodes)
    if n == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True)) if (signatures[0] != signatures[1]).sum() <= spec.distance else 0
        return [(nodes[0], nodes[1])] if both * 100 >= spec.percent * (len(a) + len(b) - both) else []
    sizes = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(values), bool)
    forest, links = _Forest(n), []
    across = side.any()
    for a in np.flatnonzero(side == 0):
        others = forest.label != forest.label[a]
        if across:
            others &= side == 1
        else:
            others[: a + 1] = False
        # sizes bound the similarity before anything else is looked at
        others &= (100 * np.minimum(sizes, sizes[a]) >= spec.percent * np.maximum(sizes, sizes[a]))
        near = np.flatnonzero(others)
        near = near[(signatures[near] != signatures[a]).sum(1) <= spec.distance]
        if not len(near):
            continue
        mine = ids[at[a] : at[a + 1]]
        mark[mine] = True
        for part in np.array_split(near, math.ceil(sizes[near].sum() / 4e6)):
            n_part = sizes[part]
            begin = np.concatenate([[0], np.cumsum(n_part)[:-1]])
            where = np.repeat(at[part] - begin, n_part) + np.arange(n_part.sum())
            both = np.add.reduceat(mark[ids[where]].astype(np.int64), begin)
            for b in part[both * 100 >= spec.percent * (n_part + sizes[a] - both)]:
                if forest.label[a] != forest.label[b]:
                    forest.join(a, b)
                    links.append((nodes[a], nodes[b]))
        mark[mine] = False
    return links


def close_links(nodes: np.ndarray, side: np.ndarray, signatures: np.ndarray, spec: NearDup) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the distance limit: of the rows of side 0 with all rows, or with side 1, if there is one."""
    if len(nodes) == 2:
        return [(nodes[0], nodes[1])] if (signatures[0] != signatures[1]).sum() <= spec.distance else []
    forest, links = _Forest(len(nodes)), []
    across = side.any()
    for a in np.flatnonzero(side == 0):
        others = forest.label != forest.label[a]
        if across:
            others &= side == 1
        else:
            others[: a + 1] = False
        near = np.flatnonzero(others)
        for b in near[(signatures[near] != signatures[a]).sum(1) <= spec.distance]:
            if forest.label[a] != forest.label[b]:
                forest.join(a, b)
                links.append((nodes[a], nodes[b]))
    return links


def _in_blocks(rows: DataFrame, group: str, columns: list[str], work: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """Links (a, b) that work(nodes, side, *columns) finds in each pair of blocks of each group. rows: group, node, n (blocks of the group) and the columns.

    A group is cut into blocks by a hash of the node; each pair of blocks is one piece of work.
    """
    dealt = (
        rows.withColumn("mine", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("n")).cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        .select(group, "node", *columns, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
        .repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")
    )

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        keys = rows[[group, "lo", "hi"]].to_numpy()
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        held = [rows[c].to_numpy() for c in ("node", "side", *columns)]
        for i, j in zip([0, *ends], [*ends, len(rows)], strict=True):
            if j - i > 1:
                out += work(*[c[i:j] for c in held])
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the last key, which the next frame may go on with
        for frame in frames:
            whole = pd.concat([*held, frame], ignore_index=True) if held else frame
            last = whole.iloc[-1]
            tail = (whole[group] == last[group]) & (whole["lo"] == last["lo"]) & (whole["hi"] == last["hi"])
            if not tail.all():
                yield cut(whole[~tail])
            held = [whole[tail]]
        if held:
            yield cut(held[0])

    return dealt.mapInPandas(run, "a long, b long")


def _symbols(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1)


def _coarse(same: DataFrame, spec: NearDup) -> DataFrame:
    """(node, root): groups of texts that share a key and are within the distance limit, directly or over others. same: node, keys, signature; saved."""
    keyed = same.select("node", F.explode("keys").alias("key"))
    # aggregates are written before they are joined back, so that a hot key's part of the join can be split
    shared = saved(
        keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("h2"))
        .where("least < most")
    )
    one = saved(shared.groupBy("least", "most", "n", "h1", "h2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("n")))
    members = keyed.hint("merge").join(one, "key").hint("merge").join(same.select("node", "signature"), "node")
    return components(_in_blocks(members, "key", ["signature"], lambda nodes, side, raw: close_links(nodes, side, _symbols(raw), spec)))


def _confirmed(members: DataFrame, spec: NearDup) -> DataFrame:
    """Links (a, b) between members of a coarse group, each confirmed on the full sets."""
    sizes = members.groupBy("root").agg(F.count("*").alias("rows"), F.sum(F.length("shingles")).alias("bytes"))
    n_blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    blocks = saved(sizes.where("rows > 1").select("root", n_blocks.alias("n")))

    def work(nodes: np.ndarray, side: np.ndarray, raw: np.ndarray, shingles: np.ndarray) -> list[tuple[int, int]]:
        return block_links(nodes, side, _symbols(raw), [np.frombuffer(x, np.uint64) for x in shingles], spec)

    return _in_blocks(members.hint("merge").join(blocks, "root"), "root", ["signature", "shingles"], work)


def near_duplicates(docs: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs.

    Words are runs without ASCII white space, with A-Z lower-cased. component_id is the
    least doc_id that similar pairs lead to, kept says that it is the row's own.
    Null or blank text: no shingles, linked with nothing. Fewer than k words: the whole
    sequence is the only shingle. Rows of one doc_id count as one document. Null doc_id:
    linked with nothing, component_id null, kept true. Other columns of docs are ignored.
    """
    prints = saved(fingerprints(docs, spec))
    same = saved(
        prints.where("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("signature").alias("signature")).drop("d1", "d2")
    )
    coarse = saved(_coarse(same, spec))
    links = _confirmed(saved(_members(docs, coarse, spec)), spec)
    repeated = saved(
        prints.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("most"))
        .where("b < most").select("d1", "d2", "b")
    )
    copies = (
        prints.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("a"), "d1", "d2").hint("merge")
        .join(repeated, ["d1", "d2"]).where("a <> b").select("a", "b")
    )
    groups = components(links.unionByName(copies))
    return (
        prints.select("doc_id", "n_shingles").hint("merge").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    )


def keep_one(docs: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates that of the least doc_id (null last). Columns are those of docs.

    Rows are told apart by a hash of doc_id and text, so rows of null or of one doc_id are compared
    like others. Of rows with one doc_id and one text one stays, that whose columns have the
    least hash. Rows without words all stay.
    """
    row = free_name(docs, "row_key")
    told = docs.withColumn(row, row_key())
    found = saved(
        near_duplicates(told.select(F.col(row).alias("doc_id"), "text"), spec).where("n_shingles > 0")
        .groupBy(F.col("doc_id").alias(row)).agg(F.first("component_id").alias("root"), F.count("*").alias("n"))
    )
    mine = [F.col(f"`{c}`") for c in docs.columns]
    several = saved(found.groupBy("root").agg(F.count("*").alias("m")).where("m > 1").select("root"))
    members = saved(found.select(row, "root").hint("merge").join(several, "root"))
    ids = join_checked(told.select(row, F.col("doc_id").cast("long").alias("id")), members, row)
    stays = ids.groupBy("root").agg(F.min_by(row, F.struct(F.col("id").isNull(), "id", row)).alias(row))
    gone = saved(members.select(row).hint("merge").join(stays.select(row), row, "left_anti"))
    again = saved(found.where("n > 1").select(row).hint("merge").join(gone, row, "left_anti"))
    rest = join_checked(told, gone, row, "left_anti")
    if again.isEmpty():
        return rest.select(mine)
    once = join_checked(rest, again, row, "left_anti").select(mine)
    all_of = F.struct(*mine)
    one = join_checked(told, again, row, "left_semi").groupBy(row).agg(F.min_by(all_of, F.xxhash64(*hashable(docs))).alias("whole")).select("whole.*")
    return once.unionByName(one)


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, 85 %."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(k=3, percent=85, symbols=64))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) >= 1 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), sized AS (
  SELECT doc_id, s, CAST(coalesce(len(s), 0) AS BIGINT) AS n FROM sets
), items AS (
  SELECT doc_id, n, unnest(s) AS g FROM sized
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS na, b.n AS nb, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs WHERE 100 * c >= 85 * (na + nb - c)
  UNION ALL SELECT y, x FROM pairs WHERE 100 * c >= 85 * (na + nb - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x
), least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)
"""
