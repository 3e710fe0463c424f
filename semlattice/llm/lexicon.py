"""Byte-level BPE with a lexicon of frequent words as a minimal acyclic transducer.

The words of all texts are counted. Those frequent enough to fit the lexicon are compiled into an
acyclic automaton that shares beginnings and endings: words come in sorted order, and a state is
frozen, or replaced by an equal frozen one, as soon as no later word can change it. Each arc holds
how many words lie before it, so the sum along a word's path is its number in sorted order, and the
number leads to its token ids. The file is memory-mapped by all Python workers of a machine.

Words that the lexicon lacks are merged by the tokenizer's own ranks, many at a time, so which
words it holds changes no result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import folder
from .common import ARROW_ROWS, batches_of, saved, table
from .tokenfile import _ranges, cuts

MAGIC = b"MAT1"
#: Bytes of texts that are cut and looked up at a time.
PART_BYTES = 8 << 20
#: Steps of a doubling of counts, by which the least count of the lexicon's words is chosen.
STEPS = 8
#: Words of more bytes than this are merged one at a time.
SHORT = 48
_NEVER = np.int64(1 << 40)


@dataclass(frozen=True)
class Lexicon:
    """tokenizer: path of its file. words: at most so many in the lexicon. word_bytes: at most so many bytes each; so it has at most words * word_bytes of text."""

    tokenizer: str
    words: int = 131_072
    word_bytes: int = 48


# ---- the tokenizer's own tables


class Merges:
    """Ranks of pairs of tokens, the bytes of each token, and the split into words, from the tokenizer's file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        tokenizer = Tokenizer.from_file(path)
        vocab = model["vocab"]
        self.vocab = vocab
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = len(vocab)
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # a byte-level token has one character for each byte
        char = byte_characters()
        known = [(i, bytes(char[c] for c in t)) for t, i in vocab.items()] + [(i, t.encode()) for t, i in self.added.items()]
        self.bytes = [b""] * (max(i for i, _ in known) + 1)
        for i, raw in known:
            self.bytes[i] = raw
        self.spelt = Spelling(self.bytes)
        self.decimal = Spelling([b"%d," % i for i in range(len(self.bytes))])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NEVER if it doesn't merge. A token below 0 merges with nothing."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], _NEVER)

    def merged(self, words: list[str]) -> list[list[int]]:
        """Token ids of words as the split gives them (one character for each byte)."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, high in ((0, 8), (8, 16), (16, SHORT)):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            for a in range(0, len(some), 1 << 14):
                part = some[a : a + (1 << 14)]
                for i, ids in zip(part, self._many([words[i] for i in part], high), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > SHORT):
            out[i] = self._long(words[i])
        return out

    def _many(self, words: list[str], width: int) -> list[list[int]]:
        """All words step by step: the leftmost pair of least rank of each word is merged at once."""
        tokens = np.full((len(words), width), -1, np.int64)
        for i, w in enumerate(words):
            tokens[i, : len(w)] = [self.vocab[c] for c in w]
        ranks = np.full((len(words), width), _NEVER)
        ranks[:, :-1] = self.ranks(tokens[:, :-1], tokens[:, 1:])
        live = np.arange(len(words))
        column = np.arange(width)
        while len(live):
            j = ranks[live].argmin(1)
            least = ranks[live, j]
            live, j, least = live[least < _NEVER], j[least < _NEVER], least[least < _NEVER]
            if not len(live):
                break
            moved = column > j[:, None]
            old_t, old_r = tokens[live], ranks[live]
            old_t[np.arange(len(live)), j] = self.made[least]
            new_t, new_r = np.full_like(old_t, -1), np.full_like(old_r, _NEVER)
            new_t[:, :-1], new_r[:, :-1] = old_t[:, 1:], old_r[:, 1:]
            t, r = np.where(moved, new_t, old_t), np.where(moved, new_r, old_r)
            row = np.arange(len(live))
            right = np.where(j + 1 < width, t[row, np.minimum(j + 1, width - 1)], -1)
            r[row, j] = self.ranks(t[row, j], right)
            left = j > 0
            r[row[left], j[left] - 1] = self.ranks(t[row[left], j[left] - 1], t[row[left], j[left]])
            tokens[live], ranks[live] = t, r
        return [t[: n].tolist() for t, n in zip(tokens, (tokens >= 0).sum(1), strict=True)]

    def _long(self, word: str) -> list[int]:
        """One long word, with a heap of its pairs."""
        import heapq

        tokens = [self.vocab[c] for c in word]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        pairs = self.ranks(np.array(tokens[:-1]), np.array(tokens[1:]))
        heap = [(int(r), i, tokens[i], tokens[i + 1]) for i, r in enumerate(pairs.tolist()) if r < _NEVER]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            if 0 <= i and after[i] < len(tokens):
                pair = (tokens[i], tokens[after[i]])
                if pair not in known:
                    known[pair] = int(self.ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
                if known[pair] < _NEVER:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            k = after[i] if tokens[i] == a else len(tokens)
            if k == len(tokens) or tokens[k] != b:
                continue
            tokens[i], tokens[k] = int(self.made[rank]), -1
            after[i] = after[k]
            if after[i] < len(tokens):
                before[after[i]] = i
            push(before[i])
            push(i)
        return [t for t in tokens if t >= 0]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that hold no added token, one after the other, and how many each has."""
        words = [[w for w, _ in self.split(t)] for t in texts]
        ids = self.merged([w for ws in words for w in ws])
        n, at, flat = [], 0, []
        for ws in words:
            mine = [i for part in ids[at : at + len(ws)] for i in part]
            flat += mine
            n.append(len(mine))
            at += len(ws)
        return np.array(flat, np.uint32), np.array(n, np.int64)


class Spelling:
    """A string of bytes for each id, gathered for many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings one after the other, and where each begins, and the end."""
        size = self.size[ids]
        return self.data[_ranges(self.at[ids], size)], np.concatenate([[0], np.cumsum(size)])


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable bytes are themselves, the others count on from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@cache
def merges(path: str) -> Merges:
    """One for each Python worker and tokenizer."""
    return Merges(path)


# ---- the automaton


def compiled(words: list[bytes], ids: list[np.ndarray]) -> bytes:
    """The file of a minimal automaton of distinct words in ascending order, with their ids.

    Little-endian: "MAT1"; numbers of states, arcs, words and ids; arcs in order of state and byte as uint64 (state * 256
    + byte), their targets and the words before them as uint32; whether a state ends a word; first id of each word, all ids.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    frozen: dict[tuple, int] = {}

    def freeze(path: list[tuple[int, int, int]], down_to: int) -> None:
        """Replaces the states of the last word's path below a depth by equal ones, deepest first."""
        while len(path) > down_to:
            state, byte, target = path.pop()
            same = frozen.setdefault((final[target], *arcs[target].items()), target)
            if same != target:
                arcs[state][byte] = same

    path: list[tuple[int, int, int]] = []
    last = b""
    for word in words:
        if path and word <= last or not word:
            raise ValueError("words must be distinct, ascending and not empty")
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        freeze(path, shared)
        state = path[-1][2] if path else 0
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        last = word
    freeze(path, 0)
    # states that are still reached get numbers, the root 0; children are frozen before their parents
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for target in arcs[stack.pop()].values():
            if target not in number:
                number[target] = len(number)
                order.append(target)
                stack.append(target)
    below: dict[int, int] = {}
    for state in _children_first(order, arcs):
        below[state] = final[state] + sum(below[t] for t in arcs[state].values())
    key, target, skipped = [], [], []
    for state in order:
        before = int(final[state])
        for byte, t in sorted(arcs[state].items()):
            key.append(number[state] * 256 + byte)
            target.append(number[t])
            skipped.append(before)
            before += below[t]
    at = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    return b"".join([
        MAGIC, struct.pack("<IIII", len(order), len(key), len(words), int(at[-1])), np.array(key, "<u8").tobytes(), np.array(target, "<u4").tobytes(), np.array(skipped, "<u4").tobytes(),
        np.array([final[s] for s in order], "u1").tobytes(), at.astype("<u4").tobytes(), np.concatenate([*ids, np.zeros(0, np.uint32)]).astype("<u4").tobytes()])


def _children_first(states: list[int], arcs: list[dict[int, int]]) -> list[int]:
    done: set[int] = set()
    out: list[int] = []
    for root in states:
        stack = [(root, False)]
        while stack:
            state, seen = stack.pop()
            if seen:
                out.append(state)
            elif state not in done:
                done.add(state)
                stack.append((state, True))
                stack += [(t, False) for t in arcs[state].values() if t not in done]
    return out


class Automaton:
    """A compiled file, read in place."""

    def __init__(self, raw: np.ndarray | bytes):
        data = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a lexicon")
        self.states, arcs, self.words, n_ids = struct.unpack("<IIII", bytes(data[4:20]))
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.ndarray(count, kind, data, at)
            at += out.nbytes
            return out

        self.key, self.target, self.skipped = take("<u8", arcs), take("<u4", arcs), take("<u4", arcs)
        self.final, self.at, self.ids = take("u1", self.states), take("<u4", self.words + 1), take("<u4", n_ids)

    def numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word data[start : start + size], -1 for those that the lexicon lacks. All words take a step at a time."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.key):
            return out
        live = np.flatnonzero(size > 0)
        state, number = np.zeros(len(live), np.uint64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state * np.uint64(256) + data[start[live] + step]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            there = self.key[arc] == key
            live, arc, number = live[there], arc[there], number[there] + self.skipped[arc[there]]
            state = self.target[arc].astype(np.uint64)
            step += 1
            ends = size[live] == step
            good = ends & (self.final[state.astype(np.int64)] == 1)
            out[live[good]] = number[good]
            live, state, number = live[~ends], state[~ends], number[~ends]
        return out


_mapped: dict[str, Automaton] = {}


def mapped(name: str) -> Automaton:
    """The lexicon that Spark has brought to this machine under that name, memory-mapped."""
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = Automaton(np.memmap(SparkFiles.get(name), np.uint8, "r"))
    return _mapped[name]


# ---- texts


@dataclass
class Cut:
    """Texts as words: the distinct ones (data, start, size), which of them stands at each place, and where each text's places begin."""

    words: pa.Array
    which: np.ndarray
    text_at: np.ndarray


def cut(texts: pa.Array) -> Cut:
    """Words are what lies between places that the tokenizer's split never crosses; a word may hold a mark or white space too."""
    texts = texts.cast(pa.large_binary())
    row_at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if row_at[0] == row_at[-1]:
        return Cut(pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(row_at), np.int64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[row_at[0] : row_at[-1]]
    row_at = row_at - row_at[0]
    places = cuts(data, row_at)
    coded = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    return Cut(coded.dictionary, coded.indices.to_numpy(), np.searchsorted(places, row_at))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about PART_BYTES; one longer text is a part of its own. The text is the last column."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.columns[-1]).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _segments(texts: pa.Array, literals: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without added tokens, the text that each belongs to, and the added token before it (-1: none)."""
    held = np.zeros(len(texts), bool)
    for literal in literals:
        held |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False).astype(bool)
    if not held.any():
        return texts, np.arange(len(texts)), np.full(len(texts), -1)
    out, of, before = [], [], []
    for i, text in enumerate(texts.to_pylist()):
        if not held[i]:
            out.append(text), of.append(i), before.append(-1)
            continue
        rest, token = text, -1
        while True:
            hits = [(rest.find(x), k) for k, x in enumerate(literals) if x in rest]
            place, k = min(hits, default=(len(rest), -1))
            out.append(rest[:place]), of.append(i), before.append(token)
            if k < 0:
                break
            rest, token = rest[place + len(literals[k]) :], k
    return pa.array(out, pa.string()), np.array(of), np.array(before)


def encode(texts: pa.Array, tables: Merges, lexicon: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and where each text's begin, and the end."""
    literals = list(tables.added)
    parts, of, before = _segments(texts, literals)
    words = cut(parts)
    offsets = np.frombuffer(words.words.buffers()[1], np.int64)[: len(words.words) + 1] if len(words.words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.words.buffers()[2], np.uint8) if len(words.words) else np.zeros(0, np.uint8)
    number = lexicon.numbers(data, offsets[:-1], np.diff(offsets))
    lacking = np.flatnonzero(number < 0)
    fresh, n_fresh = tables.pieces([w.decode() for w in words.words.take(pa.array(lacking)).to_pylist()])
    # ids of the lexicon first, then those of the words just merged
    start, size = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
    known = number[number >= 0]
    start[number >= 0], size[number >= 0] = lexicon.at[known], lexicon.at[known + 1].astype(np.int64) - lexicon.at[known]
    start[lacking], size[lacking] = len(lexicon.ids) + np.cumsum(n_fresh) - n_fresh, n_fresh
    sources = np.concatenate([lexicon.ids, fresh]).astype(np.uint32)
    ids = sources[_ranges(start[words.which], size[words.which])]
    id_at = np.concatenate([[0], np.cumsum(size[words.which])])[words.text_at]
    if (before >= 0).any():
        # an added token stands before the ids of its segment
        token = np.array([tables.added[x] for x in literals], np.uint32)
        ids = np.insert(ids, id_at[:-1][before >= 0], token[before[before >= 0]])
        id_at = id_at + np.concatenate([[0], np.cumsum(before >= 0)])
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    return ids, id_at[first]


def digests(ids: np.ndarray, id_at: np.ndarray, tables: Merges) -> tuple[list[str], list[str]]:
    """SHA-256 of each text's ids in decimals, comma-joined, and of its ids' decoded text in UTF-8."""
    decimals, d_at = tables.decimal.of(ids)
    spelt, s_at = tables.spelt.of(ids)
    decimals, spelt = memoryview(np.ascontiguousarray(decimals)), memoryview(np.ascontiguousarray(spelt))
    listed, decoded = [], []
    for a, b in zip(id_at.tolist(), id_at[1:].tolist(), strict=False):
        listed.append(hashlib.sha256(decimals[int(d_at[a]) : max(int(d_at[b]) - 1, int(d_at[a]))]).hexdigest())
        text = bytes(spelt[int(s_at[a]) : int(s_at[b])]).decode("utf-8", "replace")
        decoded.append(hashlib.sha256(text.encode()).hexdigest())
    return listed, decoded


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all texts; counted in parts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            words = cut(part.column(0))
            n = np.bincount(words.which, minlength=len(words.words))
            yield pa.RecordBatch.from_arrays([words.words.cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, spec: Lexicon) -> DataFrame:
    """The words of the largest counts, at most spec.words of them, each of at most spec.word_bytes.

    The least count is that of a step of a scale of STEPS steps for each doubling, so that a table of
    some hundred rows decides and nothing is sorted.
    """
    step = F.floor(F.log2("n") * STEPS).cast("int")
    short = counts.where(F.octet_length("word") <= spec.word_bytes)
    sizes = short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in sizes:
        total += row["words"]
        if total > spec.words:
            break
        least = row["step"]
    return short.where(step >= least) if least is not None else short.where("false")


def lexicon_file(words: DataFrame, spec: Lexicon) -> bytes:
    """The lexicon of these words, of proven size, compiled in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = merges(spec.tokenizer)
        found = sorted(w for batch in batches for w in batch.column(0).to_pylist())
        ids, n = tables.pieces([w.decode() for w in found])
        payload = compiled(found, np.split(ids, np.cumsum(n)[:-1]) if found else [])
        yield pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], ["payload"])

    rows = words.select("word").coalesce(1).mapInArrow(run, "payload binary").collect()
    return bytes(rows[0]["payload"]) if rows else compiled([], [])


def shared_file(spark: SparkSession, payload: bytes) -> str:
    """Writes a file beside the session's tables and has Spark bring it to every machine that runs tasks; returns its name there."""
    name = f"lexicon-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(payload))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def coded(docs: DataFrame, spec: Lexicon) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Texts are encoded as the tokenizer's library does without special tokens of its own (literals of
    added tokens get their ids) and decoded again from the ids alone. A null text is an empty one and
    has no ids; null and repeated doc_ids keep their rows; all other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with batches_of(docs.sparkSession, ARROW_ROWS):
        counts = saved(word_counts(docs.select(text.alias("text"))))
    name = shared_file(docs.sparkSession, lexicon_file(frequent(counts, spec), spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, lexicon = merges(spec.tokenizer), mapped(name)
        for part in _parts(batches):
            ids, id_at = encode(part.column(1), tables, lexicon)
            listed, decoded = digests(ids, id_at, tables)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(id_at), pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    with batches_of(docs.sparkSession, ARROW_ROWS):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
        return saved(rows)


def op11_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of 50,257 ids, encoded and decoded."""
    import public_tokenizers

    return coded(table(spark, sf_dir, "documents"), Lexicon(public_tokenizers.path("byte_bpe_50k.json")))
