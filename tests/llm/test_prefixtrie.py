"""The trie against one that is walked in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from semlattice.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string, before string, pos int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_paths(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_trie(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    ends = {node: ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(node)) for node, cs in members.items()}
    return sorted(
        (min(cs), len(node), min(members[node[:-1]]) if node else -1, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends[node].encode()).hexdigest())
        for node, cs in members.items())


def got(spark, rows):
    df = spark.createDataFrame([(*r, 5, "x", "y", 3) for r in rows], SCHEMA)
    out = P.trie(*P.shared_starts(P.ordered_turns(df)))
    assert out.columns == COLUMNS
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, out.collect()))


def test_small_trees(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "ünï", "数据🙂", "", None])) for c in [*range(0, 40), *range(97, 140), 205, 206, 301] for t in range(r.randint(1, 20))]
    rows += [(c, t, "user", "same") for c in (400, 401, 402, 403) for t in range(30)]
    rows += rows[:50] + [(None, 1, "user", "lost"), (7, None, "user", "first"), (7, None, "user", "also first"), (8, 3, "user", "tie"), (8, 3, "assistant", "tie")]
    assert got(spark, rows) == plain_trie(plain_paths(rows))


def test_long_conversations_across_blocks_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(P, "STRETCH", 3)
    monkeypatch.setattr(P, "IDS", 4)
    r = random.Random(6)
    stem = [("user" if i % 2 else "assistant", f"turn {i}" * r.randint(0, 3)) for i in range(160)]
    # copies of one conversation, some cut short at and around ends of blocks and stretches, some of which go on elsewhere
    rows = []
    for k, n in enumerate([160, 160, 160, 7, 8, 9, 16, 17, 23, 24, 25, 48, 49, 100, 100, *[24] * 15]):
        c = 1000 + 100 * k  # its own base
        rows += [(c, t, *stem[t]) for t in range(n)]
        if k % 3 == 0:
            rows += [(c, 500 + t, "user", f"other {k % 2} {t}") for t in range(r.randint(0, 30))]
    assert got(spark, rows) == plain_trie(plain_paths(rows))


def test_conversations_without_turns(spark):
    """Conversation 1 has fewer turns than it would take from an absent one."""
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(1, 60)}
    bare = [c for c in h if h[c] >= 2][:4]
    rows = [(c, 0, "user", "only") for c in bare]
    assert got(spark, rows) == plain_trie(plain_paths(rows)) and len(got(spark, rows)) == 1
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "x")]) == []


def test_one_rollup_counts_all_blocks(spark):
    rows = P.blocks(*P.shared_starts(P.ordered_turns(spark.createDataFrame([(1, 1, "u", "x", 1, "x", "y", 3)], SCHEMA))))
    plan = P.rolled(rows, "count(*) AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "Python" not in plan


@pytest.mark.parametrize("n", [1, 4096, 4097])
def test_ids_of_a_node_in_several_texts(spark, n):
    rows = [(100 * c, 0, "user", "hello") for c in range(n)]
    ends = {r["depth"]: r["ends_sha256"] for r in P.trie(*P.shared_starts(P.ordered_turns(spark.createDataFrame([(*r, 5, "x", "y", 3) for r in rows], SCHEMA)))).collect()}
    assert ends == {0: P.NO_IDS, 1: hashlib.sha256(",".join(str(100 * c) for c in range(n)).encode()).hexdigest()}
