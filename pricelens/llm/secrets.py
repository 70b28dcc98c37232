"""Operator 11: secrets by fixed patterns and by formats inferred from them.

1. Every whole text is searched with the three base patterns; their matches are the labelled credentials. The same
   pass takes the text's other candidates: runs of 16 or more credential characters that no match touches.
2. A bounded sample of the distinct labelled values of each kind, and one of the candidates, become prefix trees. Their states
   are merged where the counts of what follows are statistically compatible (red and blue states, Hoeffding
   bounds, also for all that follows), which leaves one small probabilistic automaton for each kind and one
   for ordinary text.
3. Every candidate is scored: the log-likelihood under the best kind's automaton, less that under the one of ordinary text.
   At ``LEAST_ODDS`` or more its span is added, as kind ``inferred``.

A base span covers the whole match; positions are code points. Null texts count as empty. Without labelled values
of a kind there is no automaton for it, without any nothing is added; without candidates every character of ordinary text
is equally likely. Values above 256 characters are scored like any other but teach nothing. Rows that share a
doc_id each get a row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import first_by_hash, map_batches, materialize

#: Kinds in their order, each with its pattern, the least length, and the group whose length and value count.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 24, 0),
}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
INFERRED = "inferred"
#: Texts that match none of these (linear time) hold neither a base match nor a candidate.
ASSIGN_HINT = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
OTHER_HINT = r"[A-Za-z0-9+/_-]{16}"
#: Distinct values of each kind, and of candidates, that are learned from.
EXAMPLES = 2_000
LONGEST_EXAMPLE = 256
#: Chance that two compatible states look different, by test.
ALPHA = 0.01
#: Weight of symbols not seen in a state, as visits, shared by the characters of candidates and the end.
UNSEEN = 0.5
ALPHABET = 67
#: Natural log of the likelihood ratio from which a candidate counts as a credential.
LEAST_ODDS = math.log(1_000_000)


class Automaton:
    """A probabilistic automaton: per state the visits, the ends, and per symbol the count and the next state."""

    def __init__(self, values: Iterable[str]):
        """The frequency prefix tree of ``values``, its compatible states merged."""
        self.visits, self.ends, self.next, self.depth = [0], [0], [{}], [0]
        for value in values:
            state = 0
            self.visits[0] += 1
            for symbol in value:
                step = self.next[state].setdefault(symbol, [0, len(self.visits)])
                if step[1] == len(self.visits):
                    for column, new in ((self.visits, 0), (self.ends, 0), (self.next, {}), (self.depth, self.depth[state] + 1)):
                        column.append(new)
                step[0] += 1
                state = step[1]
                self.visits[state] += 1
            self.ends[state] += 1
        self._merge()
        self._logs()

    def _merge(self) -> None:
        red, bound = [0], math.sqrt(0.5 * math.log(2 / ALPHA))
        blue = {step[1]: (0, symbol) for symbol, step in self.next[0].items()}
        while blue:
            state = min(blue, key=lambda s: (self.depth[s], -self.visits[s], blue[s]))
            parent, symbol = blue.pop(state)
            match = next((r for r in red if self._compatible(r, state, bound)), None)
            if match is None:
                red.append(state)
            else:
                self.next[parent][symbol][1] = match
                self._fold(match, state)
            known = set(red)
            blue = {step[1]: (r, symbol) for r in red for symbol, step in self.next[r].items() if step[1] not in known}
        self.states = red

    def _compatible(self, one: int, other: int, bound: float) -> bool:
        """Whether ends and following symbols of both, and of all that follows both, can have the same chances."""
        left = [(one, other)]
        while left:
            a, b = left.pop()
            n, m = self.visits[a], self.visits[b]
            apart = bound * (n**-0.5 + m**-0.5)
            if abs(self.ends[a] / n - self.ends[b] / m) >= apart:
                return False
            here, there = self.next[a], self.next[b]
            for symbol in here.keys() | there.keys():
                x, y = here.get(symbol), there.get(symbol)
                if abs((x[0] if x else 0) / n - (y[0] if y else 0) / m) >= apart:
                    return False
                if x and y and x[1] != y[1]:
                    left.append((x[1], y[1]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a tree, which nothing else leads to, to a state and those behind it."""
        left = [(into, tree)]
        while left:
            a, b = left.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for symbol, (count, state) in self.next[b].items():
                step = self.next[a].get(symbol)
                if step is None:
                    self.next[a][symbol] = [count, state]
                else:
                    step[0] += count
                    left.append((step[1], state))

    def _logs(self) -> None:
        """Keep of the states what scoring needs, with natural logs of the chances."""
        self.table: dict[int, tuple[dict[str, tuple[float, int]], float, float]] = {}
        for state in self.states:
            whole = self.visits[state] + UNSEEN
            log = lambda count: math.log((count + UNSEEN / ALPHABET) / whole)
            self.table[state] = ({s: (log(c), to) for s, (c, to) in self.next[state].items()}, log(0), log(self.ends[state]))
        del self.visits, self.ends, self.next, self.depth

    def score(self, value: str) -> float:
        """Log-likelihood of ``value``; an unseen symbol leaves the state as it is."""
        state, total = 0, 0.0
        steps, missing, end = self.table[0]
        for symbol in value:
            step = steps.get(symbol)
            if step is None:
                total += missing
            else:
                total += step[0]
                if step[1] != state:
                    state = step[1]
                    steps, missing, end = self.table[state]
        return total + end


class Formats:
    """Automata of credentials by kind, and that of ordinary text."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        self.kinds = {k: Automaton(v) for k, v in labelled.items() if v}
        self.ordinary = Automaton(ordinary) if ordinary else None

    def odds(self, value: str) -> float:
        """How many times likelier, as natural log, a credential's automaton makes ``value`` than ordinary text."""
        if not self.kinds:
            return -math.inf
        plain = self.ordinary.score(value) if self.ordinary else -(len(value) + 1) * math.log(ALPHABET)
        return max(a.score(value) for a in self.kinds.values()) - plain


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of every base match, in order."""
    out = []
    for n, kind in enumerate(KINDS):
        pattern, least, group = PATTERNS[kind]
        out += [(m.start(), n, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of the runs of credential characters that no base match touches."""
    out, at, end = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            end = max(end, taken[at][2])
            at += 1
        if end <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


_SPANS = "spans array<struct<start:long,kind:int,stop:long,value:string>>"
_OTHERS = "others array<struct<start:long,stop:long,value:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates of every row; texts are read once."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("value", pa.string())]))
    other = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            hit = pc.or_(pc.match_substring_regex(column, ASSIGN_HINT), pc.match_substring_regex(column, OTHER_HINT)).to_numpy(zero_copy_only=False)
            found, rest = [[] for _ in hit], [[] for _ in hit]
            for n in hit.nonzero()[0].tolist():
                text = column[n].as_py()
                found[n] = base_spans(text)
                rest[n] = candidates(text, found[n])
            as_spans = [[{"start": s, "kind": k, "stop": e, "value": v} for s, k, e, v in x] for x in found]
            as_others = [[{"start": s, "stop": e, "value": v} for s, e, v in x] for x in rest]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(as_spans, span), pa.array(as_others, other)], names=["doc_id", "spans", "others"])

    return materialize(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, {_SPANS}, {_OTHERS}"), "secrets-scan")


def train(scanned: DataFrame) -> Formats:
    """Automata from at most EXAMPLES distinct values of each kind and as many candidates, drawn by a hash."""

    def drawn(values: DataFrame) -> list[str]:
        distinct = materialize(values.filter(F.length("value").between(1, LONGEST_EXAMPLE)).distinct(), "secrets-values")
        return sorted(r.value for r in first_by_hash(distinct, F.xxhash64("value"), EXAMPLES, distinct.count()).collect())

    spans = scanned.select(F.explode("spans").alias("s")).select("s.kind", "s.value")
    return Formats({k: drawn(spans.filter(F.col("kind") == n).select("value")) for n, k in enumerate(KINDS)}, drawn(scanned.select(F.explode("others").alias("s")).select("s.value")))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_inferred of every row of ``docs``."""
    scanned = scan(docs)
    formats = train(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = defaultdict(list)
            for base, others in zip(batch.column("spans").to_pylist(), batch.column("others").to_pylist(), strict=True):
                kept = [(s["start"], s["kind"], s["stop"]) for s in base]
                added = [(s["start"], len(KINDS), s["stop"]) for s in others if formats.odds(s["value"]) >= LEAST_ODDS]
                for n, kind in enumerate(KINDS):
                    columns[f"n_{kind}"].append(sum(k == n for _, k, _ in kept))
                columns["base_sha256"].append(hashlib.sha256(_joined(kept).encode()).hexdigest())
                columns["spans"].append(_joined(sorted(kept + added)))
                columns["n_inferred"].append(len(added))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{k: pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in columns.items()}})

    return map_batches(scanned, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inferred long")


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, INFERRED)[k]}:{s}:{e}" for s, k, e in spans)
