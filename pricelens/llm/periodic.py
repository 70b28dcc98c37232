"""Operator 12: runs (maximal periodic stretches of words) by a Kruskal pass over descending LCPs.

The words of a batch of texts become numbers. Prefix doubling sorts the suffixes of every text; neighbours in
that order that share at least six words are edges, weighted by their longest common prefix (LCP). Edges are
taken by falling LCP: union-find joins the two suffix classes, whose positions are kept in order, the smaller
set going into the larger. Two positions of different classes that become neighbours, at a distance p of at
most the LCP L, seed a run: the words from the first on have period p over p + L words. Where the word before
both differs (or there is none) this is the whole run; otherwise the run was seeded one word earlier.

p is the smallest period: were there a smaller one, p would be its multiple and a position of the same class
would lie between the two. Seeds are therefore confirmed when all edges of their LCP have been taken. A run
of at least max(12, 2 p) words has L >= 6, so shorter LCPs are never looked at.

Null and empty texts, and texts of white space, have no words: no runs, four nulls, hashes of nothing. Texts of
any length are whole; each is worked on alone, in memory in proportion to its words. Rows that share a doc_id each get
a row. A row without an id is not rewritten by ``rewrite``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import map_batches

#: Words of the shortest run, and so of the shortest common prefix that can seed one.
SHORTEST = 12
LEAST_LCP = SHORTEST // 2
#: Bytes of text worked on together.
TOGETHER = 4 << 20

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each text has. White space is \\x20 and \\x09-\\x0D."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words = parts.flatten()
    filled = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(filled)])
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return words.filter(pa.array(filled)), np.diff(before[offsets])


def rewrite(counts: np.ndarray, codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each word the word of the batch that takes its place: texts whose code ends in 0 repeat a stretch."""
    first = np.cumsum(counts) - counts
    g = codes // 10
    chosen = known & (codes % 10 == 0) & (counts > 0)
    a = np.where(chosen, g % np.maximum(counts, 1), 0)
    p = 1 + (counts - a) // (3 + g % 8)
    text = np.repeat(np.arange(len(counts)), counts)
    i = np.arange(len(text)) - first[text]
    moved = chosen[text] & (i >= a[text])
    return first[text] + np.where(moved, a[text] + (i - a[text]) % p[text], i)


def suffix_order(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours u, v in the suffix order of each text that share LEAST_LCP words or more, and their LCP."""
    n = len(ids)
    rank = np.full(n + 1, -1, np.int64)
    key = text.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    rank[order] = _group_starts(key[order])
    levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # width, positions in groups of several, their group
    active, width = _in_groups(rank, order), 1
    while len(active):
        levels.append((width, active, rank[active]))
        # sort the members of each group by what follows; a position past its text's end comes first
        after = active + width
        follow = np.where((after < n) & (text[np.minimum(after, n - 1)] == text[active]), rank[np.minimum(after, n)], -1)
        at = np.lexsort((follow, rank[active]))
        member, group, follow = active[at], rank[active][at], follow[at]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        begins = np.flatnonzero(new)
        head = np.concatenate([[True], group[1:] != group[:-1]])
        within = np.arange(len(member)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        rank[member] = group + within[begins][np.cumsum(new) - 1]
        sizes = np.diff(np.append(begins, len(member)))
        active, width = member[np.repeat(sizes > 1, sizes)], width * 2
    if not levels:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # ranks are final: neighbours by rank that were in one group at the width nearest below LEAST_LCP
    _, base, group = next(x for x in reversed(levels) if x[0] <= max(1, 1 << (LEAST_LCP.bit_length() - 1)))
    at = np.lexsort((rank[base], group))
    base, group = base[at], group[at]
    same = np.flatnonzero(group[1:] == group[:-1])
    u, v = base[same], base[same + 1]
    lcp = np.zeros(len(u), np.int64)
    scratch = np.full(n + 1, -1, np.int64)
    for width, positions, group in reversed(levels):
        scratch[positions] = group
        x = scratch[np.minimum(u + lcp, n)]
        lcp += np.where((x >= 0) & (x == scratch[np.minimum(v + lcp, n)]), width, 0)
        scratch[positions] = -1
    enough = lcp >= LEAST_LCP
    return u[enough], v[enough], lcp[enough]


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the first place with its value."""
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _in_groups(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Positions whose rank another position has too."""
    sizes = np.bincount(rank[order], minlength=len(order))
    return order[sizes[rank[order]] > 1]


def seeds(u: np.ndarray, v: np.ndarray, lcp: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, LCP) that become neighbours in the class joined at that LCP, no further apart than it."""
    by = np.lexsort((-lcp, text[u])) if len(u) else np.zeros(0, np.int64)
    places = np.unique(np.concatenate([u, v]))
    left, right = np.searchsorted(places, u[by]).tolist(), np.searchsorted(places, v[by]).tolist()
    weight, owner = lcp[by].tolist(), text[u[by]].tolist()
    sets: list[list[int] | None] = [[p] for p in places.tolist()]
    parent = list(range(len(sets)))
    out: list[tuple[int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []  # of this LCP: root, i, j

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def confirm(length: int) -> None:
        for r, i, j in waiting:
            members = sets[root(r)]
            at = bisect_left(members, i) + 1
            if at < len(members) and members[at] == j:
                out.append((i, j, length))
        waiting.clear()

    last, last_owner = 0, -1
    for a, b, length, whose in zip(left, right, weight, owner):
        if waiting and (length != last or whose != last_owner):
            confirm(last)
        last, last_owner = length, whose
        a, b = root(a), root(b)
        large, small = sets[a], sets[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b], sets[b] = a, None
        at, before = 0, -1
        for n, x in enumerate(small):
            at = bisect_left(large, x, at)
            if at and large[at - 1] != before and x - large[at - 1] <= length:
                waiting.append((a, large[at - 1], x))
            if at < len(large) and large[at] - x <= length and (n + 1 == len(small) or small[n + 1] > large[at]):
                waiting.append((a, x, large[at]))
            large.insert(at, x)
            at, before = at + 1, x
    if waiting:
        confirm(last)
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def find_runs(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start (word of the batch), length and period of every run, by text, start and period."""
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(ids):
        return (np.zeros(0, np.int64),) * 4
    i, j, lcp = seeds(*suffix_order(ids, text), text)
    whole = (i == (np.cumsum(counts) - counts)[text[i]]) | (ids[i - 1] != ids[j - 1])
    whole &= lcp + j - i >= SHORTEST
    i, period, length = i[whole], (j - i)[whole], (lcp + j - i)[whole]
    by = np.lexsort((period, i))
    return text[i][by], i[by], length[by], period[by]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def collapse(texts: pa.Array, codes: np.ndarray, known: np.ndarray) -> dict[str, list]:
    """The columns of SCHEMA, without doc_id, for texts that ``rewrite`` has changed."""
    words, counts = split_words(texts)
    place = rewrite(counts, codes, known)
    ids = pc.dictionary_encode(words).indices.to_numpy()[place]
    first = np.cumsum(counts) - counts
    text, start, length, period = find_runs(ids, counts)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([first, [len(ids)]])]
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), words.take(pa.array(place[kept]))), pa.scalar(" ", pa.large_string()))
    start -= first[text]
    bounds = np.searchsorted(text, np.arange(len(counts) + 1))
    best = np.lexsort((period, start, -length, text))
    out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")[1:]}
    for a, b, rest in zip(bounds[:-1].tolist(), bounds[1:].tolist(), joined.to_pylist(), strict=True):
        top = best[a] if b > a else None
        values = (None,) * 4 if top is None else (int(start[top]), int(length[top]), int(period[top]), int(1000 * length[top] // period[top]))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()))
        for name, value in zip(out, (b - a, *values, _sha(lines.encode()), _sha(rest.encode()))):
            out[name].append(value)
    return out


def collapse_documents(docs: DataFrame) -> DataFrame:
    """Runs and the hash of the collapsed text of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code")
            found = collapse(batch.column("text"), pc.fill_null(codes, 0).to_numpy(zero_copy_only=False), pc.is_valid(codes).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{k: pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in found.items()}})

    ident = F.col("doc_id").cast("long")
    return map_batches(docs.select(ident, "text", F.crc32(ident.cast("string").cast("binary")).alias("code")), run, SCHEMA, size=TOGETHER)
