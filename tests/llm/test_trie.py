"""Operator 13 against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pricelens.llm import prefix_trie
from pricelens.llm.prefix_trie import running

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[n] for n in below) or 1
        saved[node] = sum(saved[n] for n in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(whole[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(6)
    rows = []
    for c in list(range(0, 120)) + [300, 301, 455]:  # 455 has no base
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é中", "a longer text"])))
    rows += [(c, t, "user", f"copy {t}") for c in range(500, 560) for t in range(12)]  # copies
    rows += [(700 + c, t, "user", f"copy {t}" if t < c else f"own {c}") for c in range(40) for t in range(40)]  # a caterpillar
    rows += [(900, None, "system", "first"), (900, 5, None, "x"), (900, -1, "user", None), (901, 0, None, None), (902, 0, "", ""), (None, 0, "user", "lost")]
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_trie(spark, talks, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    turns = spark.createDataFrame([(*r, 1, "x") for r in talks], SCHEMA + ", depth int, k1 string").repartition(5)
    assert rows_of(prefix_trie.prefix_trie(turns)) == brute(talks)


def test_long_conversation_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    rows = [(100, t, "user", f"t{t}") for t in range(1500)] + [(101, t, "user", f"t{t}" if t < 700 else "other") for t in range(900)]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_repeated_rows_and_equal_turns(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(2, 0, "user", "a")] * 3 + [(3, 0, "user", "a"), (3, 0, "user", "b"), (4, 0, "user", "b"), (4, 0, "user", "a")]
    got = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    # three rows are three turns; equal turn numbers are ordered alike in every conversation
    assert [r[:4] for r in got if r[1] == 0] == [(1, 0, None, 4)]
    again = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2)))
    assert got == again


def test_turnless_and_empty(spark):
    # a conversation whose few turns all fall within its share, without a base, is rebuilt without turns
    gone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(gone, 0, "user", "a"), (gone, 1, "user", "b")]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).count() == 0


def test_components_halve(spark, talks):
    """No conversation's path meets more components than its weight has binary digits, and each is met in one stretch."""
    prefix = prefix_trie.prefixes(prefix_trie.numbered(spark.createDataFrame(talks, SCHEMA)))
    nodes = prefix_trie.trie_nodes(prefix)
    along = prefix_trie.stretches(prefix, nodes).collect()
    tops = defaultdict(set)
    for r in along:
        tops[r.top].add(r["class"])
    assert all(len(v) == 1 for v in tops.values()) and max(r["class"] for r in along) <= len(bin(len(talks) * 2))


def test_running_sums(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(prefix_trie, "BLOCK", 5)
    rows = spark.range(1, 41).selectExpr("id % 2 as k", "id as place", "id * 7 as v")
    up = {(r.k, r.place): r.s for r in running(rows, ["k"], "place", {"s": F.col("v")}, F.sum).collect()}
    down = {(r.k, r.place): r.s for r in running(rows, ["k"], "place", {"s": F.col("v")}, F.sum, upward=False).collect()}
    for k, p in up:
        mine = [7 * i for i in range(1, 41) if i % 2 == k]
        assert up[k, p] == sum(v for v in mine if v <= 7 * p) and down[k, p] == sum(v for v in mine if v >= 7 * p)
