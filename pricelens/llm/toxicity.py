"""Operator 9: toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words, the first letters of words (so that inflected forms meet), and how many different words of
a text share such a beginning. The terms that tell labels
apart, by a chi-squared test on the labelled sample, make up the vocabulary; their document frequencies are
counted over all documents. Labelled examples lie in blocks of an inverted index; for each term a block
knows its greatest weight. A query's upper bound for a block is the sum of its weights times these maxima;
blocks are searched in falling order of bounds until no bound exceeds the k-th cosine found, so the cosines
are exact and most blocks are never opened. Neighbours vote with weights that fall with distance, votes are
calibrated by leaving each example out, and the nearest example and the shared terms are given as evidence.

Examples are at most ``max_rows`` labelled documents by a hash of the id, never of the held-out fold. Texts
without any vocabulary term, null and empty ones included, get the calibrated share of such examples. Equal
cosines are settled by the order of the index. Without examples of both kinds every score is the share of
toxic labels (0 without labels). Rows that share a doc_id are scored each by its own text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import crc_of_id, discard, give_back, map_batches, materialize, partitions, text_list
from pricelens.llm.quality import labelled

MAX_ROWS = 20_000
#: Vocabulary: at most so many terms, in at least so many examples, with at least this chi-squared.
MAX_TERMS, LEAST_EXAMPLES, LEAST_CHI = 1024, 4, 20.0
#: Letters of a word's beginnings that are terms too.
PREFIXES = (4, 5, 6)
#: Different words of a text with the same beginning are counted up to this.
LEVELS = 3
NEIGHBOURS, SOFTEN, BLOCK = 24, 0.1, 64
#: Examples that stand as dense rows at a time while the driver builds and calibrates the index.
DENSE = 512
THRESHOLD = 0.7
#: Distinct terms or chunks held by one task at a time.
HELD = 400_000
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()) + "«»“”„‘’…–—¿¡"


def word_of(chunk: str) -> str:
    """The word of one lower-case chunk without white space; empty for numbers and marks."""
    word = chunk.strip(_MARKS)
    return "" if word.isdigit() else word


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in PREFIXES if len(word) >= n]


def level_terms(forms: dict[str, int]) -> list[str]:
    """Terms for a beginning that several different words of a text share: ``stem*2``, ``stem*3``."""
    return [f"{stem}{level}" for stem, n in forms.items() if n > 1 for level in range(2, min(n, LEVELS) + 1)]


def text_terms(text: str) -> set[str]:
    words = {word_of(c) for c in set(text.lower().split())} - {""}
    forms = Counter(b for w in words for b in beginnings(w))
    return words.union(forms, level_terms(forms))


class TermReader:
    """Counts of vocabulary terms in whole texts; chunks are looked up once per task."""

    def __init__(self, terms: list[str]):
        self.ids = {t: i for i, t in enumerate(terms)}
        self.stems = {t[: t.index("*") + 1] for t in terms if "*" in t}
        self.known: dict[str, tuple[str, list[str]] | None] = {}

    def _look_up(self, chunk: str) -> tuple[str, list[str]] | None:
        """The word and its known beginnings, if the vocabulary has any of them."""
        word = word_of(chunk)
        stems = [b for b in beginnings(word) if b in self.stems]
        return (word, stems) if stems or word in self.ids else None

    def counts(self, text: str) -> dict[int, int]:
        if len(self.known) > HELD:
            self.known.clear()
        chunks = Counter(text.lower().split())
        known = self.known
        for c in chunks:
            if c not in known:
                known[c] = self._look_up(c)
        found: Counter[str] = Counter()
        words: dict[str, list[str]] = {}
        for c, n in chunks.items():
            if (hit := known[c]) is not None:
                word, stems = hit
                words[word] = stems
                found[word] += n
                for b in stems:
                    found[b] += n
        if not words:
            return {}
        found.update(level_terms(Counter(b for stems in words.values() for b in stems)))
        return {self.ids[t]: n for t, n in found.items() if t in self.ids}


def choose_terms(texts: DataFrame, max_terms: int = MAX_TERMS) -> list[str]:
    """The terms of labelled texts (text, y) that depend most on the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial counts; rows of no term carry the number of texts."""
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))], names=["term", "n", "toxic"])
            held.clear()
            return batch

        for batch in batches:
            for text, y in zip(text_list(batch), batch.column("y").to_pylist(), strict=True):
                for term in text_terms(text) | {""}:
                    seen = held.setdefault(term, [0, 0])
                    seen[0] += 1
                    seen[1] += y
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    counts = materialize(map_batches(texts.select("text", "y"), run, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "toxicity-terms")
    total = counts.filter("term = ''").first()
    if total is None or total["toxic"] in (0, total["n"]):
        return []
    rows, toxic = float(total["n"]), float(total["toxic"])
    n, a = F.col("n").cast("double"), F.col("toxic").cast("double")
    chi = F.pow(a * rows - n * toxic, F.lit(2.0)) * rows / (n * (rows - n) * toxic * (rows - toxic))
    ranked = counts.filter((F.col("term") != "") & (F.col("n") >= LEAST_EXAMPLES) & (F.col("n") < rows)).withColumn("chi", chi).filter(F.col("chi") >= LEAST_CHI)
    return [r["term"] for r in ranked.orderBy(F.desc("chi"), "term").limit(max_terms).collect()]  # at most ``max_terms`` rows


def count_terms(docs: DataFrame, terms: list[str], keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, and vocabulary terms with their counts (term, tf: arrays in ascending order of term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader(terms)
        for batch in batches:
            found = [sorted(reader.counts(t).items()) for t in text_list(batch)]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in keep),
                pa.array([[t for t, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32())),
            ], names=[*keep, "terms", "tf"])

    types = dict(docs.dtypes)
    return map_batches(docs.select(*keep, "text"), run, ", ".join(f"{c} {types[c]}" for c in keep) + ", terms array<int>, tf array<int>")


def unit_rows(terms: list[list[int]], tf: list[list[int]], idf: np.ndarray) -> np.ndarray:
    """Dense rows of TF-IDF weights, of length one where any term is present."""
    out = np.zeros((len(terms), len(idf)), np.float64)
    lengths = [len(t) for t in terms]
    if sum(lengths):
        row, col = np.repeat(np.arange(len(terms)), lengths), np.concatenate([np.asarray(t, np.int64) for t in terms if len(t)])
        out[row, col] = (1 + np.log(np.concatenate([np.asarray(t, float) for t in tf if len(t)]))) * idf[col]
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        out /= np.where(norm > 0, norm, 1)
    return out


@dataclass
class BlockIndex:
    """Postings of the examples by block, and each block's greatest weight of each term."""

    idf: np.ndarray
    doc_ids: np.ndarray
    toxic: np.ndarray
    row: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, doc_ids: np.ndarray, toxic: np.ndarray, vectors: np.ndarray | Iterable[np.ndarray], idf: np.ndarray) -> BlockIndex:
        """``vectors``: dense rows, all or some at a time, of which only the postings are held."""
        most, strongest, rows, terms, weights, seen = [np.zeros(0)], [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)], 0
        for part in [vectors] if isinstance(vectors, np.ndarray) else vectors:
            if len(part):
                most.append(part.max(axis=1))
                strongest.append(part.argmax(axis=1))
                row, term = np.nonzero(part)
                rows.append(row + seen)
                terms.append(term)
                weights.append(part[row, term])
                seen += len(part)
        # examples with the same strongest term share blocks, so that maxima are tight
        order = np.lexsort((doc_ids, -np.concatenate(most), np.concatenate(strongest))) if len(doc_ids) else np.zeros(0, int)
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        row = place[np.concatenate(rows)]
        by_row = np.argsort(row, kind="stable")
        return cls(idf, doc_ids[order], toxic[order].astype(float), row[by_row], np.concatenate(terms)[by_row], np.concatenate(weights)[by_row])

    def dense(self, low: int, high: int) -> np.ndarray:
        """The examples low to high - 1 as dense rows."""
        a, b = np.searchsorted(self.row, [low, high])
        out = np.zeros((high - low, len(self.idf)))
        out[self.row[a:b] - low, self.term[a:b]] = self.weight[a:b]
        return out

    def open(self) -> None:
        """Block maxima and the posting lists by block, made once per task."""
        self.blocks = -(-len(self.doc_ids) // BLOCK)
        self.maxima = np.zeros((len(self.idf), self.blocks))
        np.maximum.at(self.maxima, (self.term, self.row // BLOCK), self.weight)
        starts = np.searchsorted(self.row, np.arange(self.blocks + 1) * BLOCK)
        self.lists = []
        for block, (low, high) in enumerate(zip(starts[:-1], starts[1:])):
            terms, at = np.unique(self.term[low:high], return_inverse=True)
            weights = np.zeros((len(terms), BLOCK))
            weights[at, self.row[low:high] - block * BLOCK] = self.weight[low:high]
            self.lists.append((terms, weights))

    def search(self, queries: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and index rows (-1: none) of the k nearest examples with a common term; ``skip``: a row to leave out per query."""
        best = np.full((len(queries), k), 0.0)
        rows = np.full((len(queries), k), -1)
        if not self.blocks or not len(queries):
            return best, rows
        bounds = queries @ self.maxima
        order = np.argsort(-bounds, axis=1, kind="stable")
        open_ = np.flatnonzero(bounds.any(axis=1))
        for turn in range(self.blocks):
            block = order[open_, turn]
            # small allowance for rounding: a bound must not fall below a cosine that it bounds
            useful = bounds[open_, block] * (1 + 1e-12) > best[open_, -1]
            open_, block = open_[useful], block[useful]
            if not len(open_):
                break
            for b in np.unique(block):
                at = open_[block == b]
                terms, weights = self.lists[b]
                cosine = queries[np.ix_(at, terms)] @ weights
                lanes = b * BLOCK + np.arange(BLOCK)
                if skip is not None:
                    cosine[lanes[None, :] == skip[at, None]] = 0.0
                merged = np.concatenate([best[at], np.minimum(cosine, 1.0)], axis=1)
                ids = np.concatenate([rows[at], np.broadcast_to(lanes, cosine.shape)], axis=1)
                top = np.argsort(-merged, axis=1, kind="stable")[:, :k]
                best[at], rows[at] = np.take_along_axis(merged, top, 1), np.take_along_axis(ids, top, 1)
        return best, np.where(best > 0, rows, -1)


@dataclass
class Voter:
    """Index with the calibration of its votes."""

    terms: list[str]
    index: BlockIndex
    share: float
    bare: float
    steps: np.ndarray
    values: np.ndarray

    def votes(self, cosine: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Share of toxic neighbours, weighted by 1 / (distance + SOFTEN), with one far neighbour of the average kind."""
        weight = np.where(rows >= 0, 1 / (1 - cosine + SOFTEN), 0.0)
        toxic = self.index.toxic[np.maximum(rows, 0)] if len(self.index.toxic) else np.zeros(rows.shape)
        far = 1 / (1 + SOFTEN)
        return ((weight * toxic).sum(axis=1) + far * self.share) / (weight.sum(axis=1) + far)

    def score(self, cosine: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(cosine), self.bare)
        calibrated = np.interp(self.votes(cosine, rows), self.steps, self.values)
        return np.where((rows >= 0).any(axis=1), calibrated, self.bare)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps nearest to y over ascending x (pool adjacent violators), as points to interpolate."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, modulus: int = 3, held_out: int = 1) -> tuple[list[str], DataFrame]:
    """The vocabulary and the examples' term counts (doc_id, y, terms, tf)."""
    sample = labelled(labels, "toxic", modulus, held_out, max_rows)
    # at most ``max_rows`` ids; their texts are read once more below, so they are written
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    texts = materialize(texts, "toxicity-examples")
    terms = choose_terms(texts)
    return terms, count_terms(texts, terms, ("doc_id", "y")).dropDuplicates(["doc_id"])


def make_voter(terms: list[str], examples: DataFrame, documents: int, frequency: dict[int, int]) -> Voter:
    """Examples are at most ``max_rows`` rows of at most MAX_TERMS counts."""
    rows = examples.toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(float)
    idf = np.log((1 + documents) / (1 + np.array([frequency.get(t, 0) for t in range(len(terms))], float))) + 1
    held = np.array([len(t) > 0 for t in rows["terms"]], bool)
    share = float(y.mean()) if len(y) else 0.0
    some = rows[held]
    found, tf = some["terms"].tolist(), some["tf"].tolist()
    index = BlockIndex.build(some["doc_id"].to_numpy(), y[held], (unit_rows(found[a : a + DENSE], tf[a : a + DENSE], idf) for a in range(0, len(found), DENSE)), idf)
    index.open()
    bare = float((y[~held].sum() + share) / ((~held).sum() + 1))
    voter = Voter(terms, index, share, bare, np.zeros(0), np.zeros(0))
    if len(index.doc_ids) > 1:
        n = len(index.doc_ids)
        votes = np.concatenate([voter.votes(*index.search(index.dense(a, min(a + DENSE, n)), NEIGHBOURS, np.arange(a, min(a + DENSE, n)))) for a in range(0, n, DENSE)])
        voter.steps, voter.values = isotonic(votes, index.toxic)
    return voter


def vote(counts: DataFrame, voter: Voter, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` with score, neighbour_id, neighbour_cosine and evidence (shared terms, strongest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = voter.index
        index.open()
        for batch in batches:
            queries = unit_rows(batch.column("terms").to_pylist(), batch.column("tf").to_pylist(), index.idf)
            cosine, rows = index.search(queries, NEIGHBOURS)
            nearest = rows[:, 0]
            near = np.flatnonzero(nearest >= 0)
            evidence: list[list[str]] = [[] for _ in nearest]
            for i in near.tolist():
                part = slice(*np.searchsorted(index.row, [nearest[i], nearest[i] + 1]))
                product = queries[i, index.term[part]] * index.weight[part]
                evidence[i] = [voter.terms[index.term[part][j]] for j in np.argsort(-product, kind="stable") if product[j] > 0]
            ids = np.where(nearest >= 0, index.doc_ids[np.maximum(nearest, 0)] if len(index.doc_ids) else -1, -1)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in keep), pa.array(voter.score(cosine, rows), pa.float64()),
                pa.array(ids, pa.int64(), mask=nearest < 0), pa.array(cosine[:, 0], pa.float64(), mask=nearest < 0), pa.array(evidence, pa.list_(pa.string())),
            ], names=[*keep, "score", "neighbour_id", "neighbour_cosine", "evidence"])

    types = dict(counts.dtypes)
    return map_batches(counts.select(*keep, "terms", "tf"), run, ", ".join(f"{c} {types[c]}" for c in keep) + ", score double, neighbour_id long, neighbour_cosine double, evidence array<string>", rows=512)


def document_frequency(counts: DataFrame, size: int) -> dict[int, int]:
    """Documents of each term; every task counts its own rows, so at most ``size`` rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.int32()), "n": pa.array(total[terms])})

    found = map_batches(counts.select("terms"), run, "term int, n long", rows=10_000).groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in found.collect()}  # at most MAX_TERMS rows


def corpus_voter(counts: DataFrame, terms: list[str], examples: DataFrame) -> Voter:
    """A voter whose document frequencies come from all of ``counts``."""
    return make_voter(terms, examples, counts.count(), document_frequency(counts, len(terms)))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbour_id, neighbour_cosine, evidence of every row."""
    terms, examples = train(docs, labels, max_rows=max_rows, modulus=modulus, held_out=held_out)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(count_terms(plain, terms, ("doc_id",)), "toxicity-counts")
    # the counts are far smaller than the texts, so their few files are dealt out for the search
    scored = vote(counts.repartition(partitions(docs.sparkSession), "doc_id"), corpus_voter(counts, terms, examples), ("doc_id",))
    return scored.select("doc_id", (crc_of_id("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbour_id", "neighbour_cosine", "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, corpus: DataFrame, *, threshold: float = THRESHOLD, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; examples come from the labelled rows of ``corpus``."""
    terms, examples = train(corpus, labels, modulus=modulus, held_out=held_out)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(count_terms(plain, terms, ("doc_id",)), "toxicity-counts")
    voter = corpus_voter(counts, terms, examples)
    discard(counts, examples)
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter.index.open()
        reader = TermReader(terms)
        for batch in batches:
            found = [sorted(reader.counts(t).items()) for t in text_list(batch)]
            queries = unit_rows([[t for t, _ in f] for f in found], [[n for _, n in f] for f in found], voter.index.idf)
            yield batch.filter(pa.array(voter.score(*voter.index.search(queries, NEIGHBOURS)) < threshold))

    return map_batches(docs, run, docs.schema)
