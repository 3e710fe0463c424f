"""Token ids of a public tokenizer in files of Simple-8b words.

Texts are cut at places which the tokenizer's own split never crosses, whatever stands around
them, so each different piece is encoded once and looked up afterwards: before a space that
no white space follows, between a letter and . , ; : ! or ?, and after a line feed between
other characters. Texts that hold an added token are encoded whole.

File format (one binary value for each file, little-endian):
  "S8B1", uint32 documents, uint64 ids, uint32 ids of a block, uint32 blocks
  int64 doc_id, uint8 null flag and uint32 n_tokens of each document
  uint32 first word and uint32 escapes before each block, and both totals
  uint64 words, uint32 escaped ids
Each block of ids is packed on its own. A word's upper 4 bits are a selector of how many ids
of how many bits its lower 60 bits hold, the first id lowest. Ids are stored plus one; a
stored 0 is an escape: the id itself stands in the list of escaped ids (it needs more than
20 bits). A word that is not full at a block's end is padded with zeros, which no decoder reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, small_batches, table

#: Ids in a word and bits of an id, by selector.
SELECTORS = ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1))
_COUNT = np.array([c for c, _ in SELECTORS])
_BITS = np.array([b for _, b in SELECTORS])
MAGIC = b"S8B1"
BLOCK = 1024


def _bytes(*values: int | str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[v if isinstance(v, int) else ord(v) for v in values]] = True
    return out


_WHITE = _bytes(*range(0x09, 0x0E), *range(0x1C, 0x21))
#: White space, or the first byte of characters some of which are white space.
_MAYBE_WHITE = _WHITE | _bytes(0xC2, 0xE1, 0xE2, 0xE3)
_LETTER = _bytes(*range(0x41, 0x5B), *range(0x61, 0x7B))
_MARK = _bytes(*".,;:!?")
#: Stands before a piece without a leading space when many pieces make up one string; the split cuts on both sides of it.
_APART = " .\n"
#: Most pieces that a Python worker remembers, about 200 bytes each; beyond it those go that came in one file only.
MEMO = 800_000


@dataclass(frozen=True)
class Tokens:
    """tokenizer: path of its file. end: id put after each document. file_bytes: of texts in one file, about; part_bytes: in one task.

    added: a literal of the tokenizer's added tokens, such as <|endoftext|>, gets that token's id, as in the
    library by default; otherwise it is text like any other.
    """

    tokenizer: str
    end: int = 2
    file_bytes: int = 6 << 20
    part_bytes: int = 128 << 20
    added: bool = False


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escaped ids, first word of each block and escapes before each block (both with the total at the end)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    # each block is followed by room for one more word's zeros, so no word reaches into the next block
    pitch = BLOCK + 64
    held = np.zeros(blocks * BLOCK, np.uint32)
    high = np.zeros(blocks * BLOCK, bool)
    high[:n] = ids >= (1 << 20) - 1
    escaped = ids[high[:n]].astype(np.uint32)
    held[:n] = ids
    held[:n] += np.uint32(1)
    held[high] = 0
    stored = np.zeros((blocks, pitch), np.uint32)
    stored[:, :BLOCK] = held.reshape(blocks, BLOCK)
    stored = stored.reshape(-1)
    escape_at = np.concatenate([[0], np.cumsum(high.reshape(blocks, BLOCK).sum(1))])
    # the most ids that a word may hold from each place on: runs of narrow ids, by doubling
    best = np.zeros(len(stored), np.int8)
    for s, (count, bits) in enumerate(SELECTORS[1:], 1):
        run = np.ones(len(stored), bool) if bits >= 20 else stored < (1 << bits)
        have = 1
        while have < count:
            step = min(have, count - have)
            run[:-step] &= run[step:]
            have += step
        run[len(run) - count + 1 :] = False
        if not run.any():
            break
        best[run] = s
    # all blocks take their words in step
    place = np.arange(blocks) * pitch
    end = place + np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    taken = np.zeros(len(stored), bool)
    while len(place):
        taken[place] = True
        place = place + _COUNT[best[place]]
        live = place < end
        place, end = place[live], end[live]
    start = np.flatnonzero(taken)
    selector = best[start].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        at, body = start[mine], np.zeros(len(mine), np.uint64)
        for j in range(count if len(mine) else 0):
            body |= stored[at + j].astype(np.uint64) << np.uint64(j * bits)
        words[mine] |= body
    block_at = np.searchsorted(start, np.arange(blocks + 1) * pitch)
    return words, escaped, block_at, escape_at


def unpack(words: np.ndarray, escaped: np.ndarray, block_at: np.ndarray, escape_at: np.ndarray, n: int) -> np.ndarray:
    """The ids again. Whole arrays at once; the offsets would let any block be decoded alone."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[selector]
    # the last word of a block may be padded
    total = np.concatenate([[0], np.cumsum(counts)])
    held = np.minimum(BLOCK, n - np.arange(len(block_at) - 1) * BLOCK)
    surplus = total[block_at[1:]] - total[block_at[:-1]] - held
    last = block_at[1:] - 1
    counts = counts.copy()
    counts[last] -= surplus
    at = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    body = words & np.uint64((1 << 60) - 1)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(mine) else 0):
            full = mine[counts[mine] > j] if j else mine
            out[at[full] + j] = (body[full] >> np.uint64(j * bits)) & mask
    gaps = np.flatnonzero(out == 0)
    out = out.astype(np.int64) - 1
    out[gaps] = escaped
    return out.astype(np.uint32)


def to_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, escaped, block_at, escape_at = pack(ids)
    n = len(counts)
    return b"".join([
        MAGIC, struct.pack("<IQII", n, len(ids), BLOCK, len(block_at) - 1),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), counts.astype("<u4").tobytes(),
        block_at.astype("<u4").tobytes(), escape_at.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escaped.astype("<u4").tobytes(),
    ])


def from_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, n_tokens of each document, and all ids."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    n, n_ids, block, blocks = struct.unpack_from("<IQII", raw, 4)
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    at = 4 + struct.calcsize("<IQII")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, nulls, counts = take("<i8", n), take("u1", n), take("<u4", n)
    block_at, escape_at = take("<u4", blocks + 1).astype(np.int64), take("<u4", blocks + 1).astype(np.int64)
    words, escaped = take("<u8", int(block_at[-1])), take("<u4", int(escape_at[-1]))
    return [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], counts.astype(np.int64), unpack(words, escaped, block_at, escape_at, n_ids)


def cuts(data: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Where the pieces of UTF-8 texts begin, and the end. row_at: where each text begins, and the end."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[row_at] = True
    space = np.flatnonzero(data[:-1] == 0x20)
    begins[space[~_MAYBE_WHITE[data[space + 1]]]] = True
    mark = np.flatnonzero(_MARK[data[2:]]) + 2
    before, older = data[mark - 1], data[mark - 2]
    # U+00C0 to U+017F but two signs are letters of two bytes; a byte from 0x80 on follows its own first byte
    accented = (older >= 0xC3) & (older <= 0xC5) & (before >= 0x80) & ~((older == 0xC3) & ((before == 0x97) | (before == 0xB7)))
    begins[mark[_LETTER[before] | accented]] = True
    line = np.flatnonzero(data[1:-1] == 0x0A) + 1
    begins[line[(data[line - 1] < 0x80) & ~_WHITE[data[line - 1]] & ~_MAYBE_WHITE[data[line + 1]]] + 1] = True
    return np.flatnonzero(begins)


class Encoder:
    """The tokenizer with a bounded memory of pieces; one for each Python worker and tokenizer."""

    kept: dict[tuple[str, bool], "Encoder"] = {}

    @classmethod
    def of(cls, path: str, added: bool = False) -> "Encoder":
        if (path, added) not in cls.kept:
            cls.kept[path, added] = cls(path, added)
        return cls.kept[path, added]

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        #: texts that hold one of these are encoded whole
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        #: byte-level tokens have a character for each byte
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.memo: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)

    def forget_rare(self) -> None:
        """Keeps the pieces that were asked for again after they had been encoded, or none if even these are too many."""
        keep = np.flatnonzero(self.again)
        keep = keep if len(keep) <= MEMO // 2 else keep[:0]
        pieces = list(self.memo)
        self.memo = {pieces[i]: nr for nr, i in enumerate(keep.tolist())}
        size = np.diff(self.at)[keep]
        self.ids = self.ids[_ranges(self.at[keep], size)]
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.again = np.zeros(len(keep), bool)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    def joined(self, pieces: list[bytes], apart: str, many: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Likewise for pieces, many in one string with `apart` before each; the byte lengths of the ids tell which belong to a piece."""
        gap = apart.encode()
        ids, _ = self.whole([(gap + gap.join(pieces[i : i + many])).decode() for i in range(0, len(pieces), many)])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(size + len(gap))
        byte_at = np.cumsum(self.bytes_of[ids])
        first, last = (np.searchsorted(byte_at, x, "left") + 1 for x in (end - size, end))
        first[(end - size) == 0] = 0
        return ids[_ranges(first, last - first)], last - first

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes new pieces and remembers them."""
        groups: tuple[list[bytes], list[bytes], list[bytes]] = ([], [], [])
        for p in pieces:
            spaced = p[0] == 0x20 and len(p) > 1
            groups[2 if _MAYBE_WHITE[p[1 if spaced else 0]] else 0 if spaced else 1].append(p)
        parts = [self.joined(groups[0], ""), self.joined(groups[1], _APART), self.whole([p.decode() for p in groups[2]])]
        self.memo.update(zip(chain.from_iterable(groups), range(len(self.memo), len(self.memo) + len(pieces)), strict=True))
        self.ids = np.concatenate([self.ids, *[ids for ids, _ in parts]])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate([n for _, n in parts]))])
        self.again = np.concatenate([self.again, np.zeros(len(pieces), bool)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without added tokens, and where each text's begin."""
        texts = texts.cast(pa.large_binary())
        row_at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if row_at[0] == row_at[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(row_at), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[row_at[0] : row_at[-1]]
        row_at = row_at - row_at[0]
        cut = cuts(data, row_at)
        coded = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.memo.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = number < 0
        self.again[number[~new]] = True
        if new.any():
            fresh = [pieces[i] for i in np.flatnonzero(new)]
            self.learn(fresh)
            number[new] = np.fromiter(map(self.memo.__getitem__, fresh), np.int64, len(fresh))
        which = number[coded.indices.to_numpy()]
        size = np.diff(self.at)[which]
        id_at = np.concatenate([[0], np.cumsum(size)])
        return self.ids[_ranges(self.at[which], size)], id_at[np.searchsorted(cut, row_at)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        if len(self.memo) > MEMO:
            self.forget_rare()
        held = np.zeros(len(texts), bool)
        for literal in self.literals:
            held |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False).astype(bool)
        if not held.any():
            return self._encode(texts)
        own, own_at = self._encode(texts.filter(pa.array(~held)))
        others, n_others = self.whole(texts.filter(pa.array(held)).to_pylist())
        counts = np.zeros(len(texts), np.int64)
        counts[~held], counts[held] = np.diff(own_at), n_others
        out = np.empty(counts.sum(), np.uint32)
        out[np.repeat(~held, counts)], out[np.repeat(held, counts)] = own, others
        return out, np.concatenate([[0], np.cumsum(counts)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def token_files(docs: DataFrame, spec: Tokens) -> DataFrame:
    """Rows (part, nr, n_docs, n_ids, payload): files in ascending doc_id order (null first), by part and nr.

    Null text: an empty one, so its only id is the end. Equal doc_ids: ordered by a hash of the text.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // spec.part_bytes))
    dealt = rows.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, nr = Encoder.of(spec.tokenizer, spec.added), 0
        for batch in batches:
            texts = batch.column(1)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + spec.file_bytes, "right")))
                ids, id_at = encoder.encode(texts.slice(at, to - at))
                # the end id after each document
                n = np.diff(id_at)
                out = np.full(len(ids) + len(n), spec.end, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                payload = to_file(batch.column(0).slice(at, to - at).to_pylist(), n + 1, out)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, 1), pa.array([nr], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([len(out)], pa.int64()), pa.array([payload], pa.binary())], ["part", "nr", "n_docs", "n_ids", "payload"])
                at, nr = to, nr + 1

    return dealt.select("doc_id", "text", "part").mapInArrow(run, "part int, nr int, n_docs long, n_ids long, payload binary")


def read_tokens(files: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files' contents. files: saved, as token_files() gives them.

    start: ids of all documents before. Running sums go by part first and by file within a
    part, so no task sees more than the parts, or the files of one part.
    """
    sizes = files.select("part", "nr", "n_ids")
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("of_part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    by_file = sizes.withColumn("of_file", F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("nr").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = by_file.hint("merge").join(by_part, "part").select("part", "nr", (F.col("of_part") + F.col("of_file")).alias("base"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, nr, payload in zip(frame["part"], frame["nr"], frame["payload"], strict=True):
                doc_ids, counts, ids = from_file(payload)
                at = np.concatenate([[0], np.cumsum(counts)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
                yield pd.DataFrame({"part": part, "nr": nr, "doc_id": pd.array(doc_ids, "Int64"), "own": at[:-1], "n_tokens": counts, "ids_crc32": crc})

    read = files.select("part", "nr", "payload").mapInPandas(run, "part int, nr int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return read.hint("merge").join(starts, ["part", "nr"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op6_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of 50,257 ids; literals of added tokens get their ids. Files are written to the shared folder and read back."""
    import public_tokenizers

    files = saved(token_files(table(spark, sf_dir, "documents"), Tokens(public_tokenizers.path("byte_bpe_50k.json"), added=True)))
    return read_tokens(files)
