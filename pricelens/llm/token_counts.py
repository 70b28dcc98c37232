"""Operator 5: token counts by rank-synchronous array merging.

A batch of distinct pre-tokens is one ragged array of symbol ids. In each round every pre-token looks
for its lowest-ranked adjacent pair and replaces all its occurrences at once, left to right; pre-tokens
without a pair leave the array. The count is the number of symbols that survive. Merging all
occurrences at once equals merging one by one because no pair that contains a new symbol ranks before
the pair that made it; the vocabulary is checked for that.

Special strings inside texts count as one token each, as the tokenizers library does by default. Null and
empty texts have no tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.chunks import ChunkCache
from pricelens.llm.common import map_batches, text_list

#: Symbols of pre-tokens that are merged together.
BATCH_SYMBOLS = 1 << 18
_NONE = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, extra = [""] * 256, 0
    for b in range(256):
        if b in printable:
            names[b] = chr(b)
        else:
            names[b] = chr(256 + extra)
            extra += 1
    return names


class MergeTable:
    """Pairs of symbols by rank, looked up in whole arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        made: dict[str, int] = {}
        for rank, (left, right) in enumerate(merges):
            if left + right in made or any(len(part) > 1 and part not in made for part in (left, right)):
                raise ValueError(f"merge {rank} comes before its parts or is made twice")
            made[left + right] = rank
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.product = np.array([vocab[a + b] for a, b in merges], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte string when no pair can be merged."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        counts = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        which = np.arange(len(tokens))
        while len(symbols):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            rank = np.full(len(symbols), _NONE, np.int32)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[ends - 1] = _NONE
            best = np.minimum.reduceat(rank, starts)
            row = np.repeat(np.arange(len(lengths)), lengths)
            chosen = (rank == best[row]) & (rank != _NONE)
            # of overlapping occurrences ("aaa") every second one is merged, from the left
            at = np.flatnonzero(chosen)
            run_start = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
            offset = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[offset % 2 == 0]
            symbols[at] = self.product[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            lengths = np.add.reduceat(keep, starts, dtype=np.int64)
            counts[which] = lengths
            active = (best != _NONE) & (lengths > 1)
            keep &= np.repeat(active, ends - starts)
            symbols, lengths, which = symbols[keep], lengths[active], which[active]
        return counts


class TokenCounter:
    """Counts of one tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = MergeTable(model["vocab"], merges)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(pattern).findall
        self.cache = ChunkCache(self._count_units)

    def _pretokens(self, chunk: str) -> tuple[list[str], int]:
        """Pre-tokens of a chunk, and how many special tokens it holds."""
        if chunk[:1] == " " and chunk[1:].isalpha():
            return [chunk], 0
        if self.special is None or not self.special.search(chunk):
            return self.split(chunk), 0
        pieces = self.special.split(chunk)
        return [t for p in pieces for t in self.split(p)], len(pieces) - 1

    def _count_units(self, parts: list[str]) -> list[int]:
        cut = [self._pretokens(p) for p in parts]
        distinct = sorted(set().union(*(t for t, _ in cut))) if cut else []
        known: dict[str, int] = {}
        batch, held = [], 0
        for token in [*distinct, None]:
            if batch and (token is None or held >= BATCH_SYMBOLS):
                known.update(zip(batch, self.table.count([t.encode() for t in batch]).tolist(), strict=True))
                batch, held = [], 0
            if token is not None:
                batch.append(token)
                held += len(token)
        return [sum(map(known.__getitem__, t)) + n for t, n in cut]

    def count(self, texts: list[str]) -> list[int]:
        return self.cache.sums(texts)


@lru_cache(maxsize=2)
def counter_of(path: str, pattern: str) -> TokenCounter:
    """One counter per worker process, kept from task to task."""
    return TokenCounter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, pattern)
        for batch in batches:
            texts = text_list(batch)
            n_tokens = counter.count(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_()),
            })

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
