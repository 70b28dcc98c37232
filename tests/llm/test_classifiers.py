"""Operators 3 and 9: held-out accuracy, the parts against brute force; the pipeline against brute force."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricelens.llm import quality, toxicity
from pricelens.llm.common import materialize, table

from .test_duplicates import SPACE, brute_components, brute_print
from .test_tokens import check_packing, word_ids

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables are not here")


def test_tree_finds_the_cut():
    g, h, n = np.array([1.0, 1, 1, -1, -1]), np.ones(5), np.full(5, 50)
    step = quality.line_tree(g, h, n)
    assert (step[:3] > 0).all() and (step[3:] < 0).all()


def test_additive_model_learns_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_model_of_one_kind():
    assert quality.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5
    assert quality.fit(np.zeros((5, 2)), np.ones(5)).score(np.zeros((1, 2)))[0] > 0.99


@needs_data
def test_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    extra = docs.select("doc_id", "text", F.lit(1).alias("score"), F.lit("x").alias("y")).unionByName(spark.createDataFrame([(None, None, 1, "x"), (5_000, "", 1, "x")], "doc_id long, text string, score int, y string"))
    got = quality.score_documents(extra, quality.train(extra, labels)).toPandas()
    assert len(got) == docs.count() + 2 and got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9


def test_block_search_is_exact():
    rng = np.random.default_rng(4)
    vectors = rng.uniform(size=(700, 40)) * (rng.uniform(size=(700, 40)) < 0.1)
    vectors = vectors[vectors.any(axis=1)]
    vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    index = toxicity.BlockIndex.build(np.arange(len(vectors)), np.zeros(len(vectors)), vectors, np.ones(40))
    index.open()
    cosine, rows = index.search(vectors[:100], 8)
    exact = np.sort(vectors[:100] @ vectors.T, axis=1)[:, ::-1][:, :8]
    assert np.allclose(cosine, np.maximum(exact, 0), atol=1e-12) and (rows[:, 0] >= 0).all()


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]


@needs_data
def test_toxicity(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    extra = docs.select("doc_id", "text", F.lit(1).alias("terms")).unionByName(spark.createDataFrame([(None, None, 1), (5_000, "", 1), (5_001, "stupid idiot " * 300, 1)], "doc_id long, text string, terms int"))
    got = toxicity.score_documents(extra, labels).toPandas()
    assert len(got) == docs.count() + 3 and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.93 and (held.predicted[held.toxic == 0]).mean() < 0.02
    assert got[got.doc_id == 5_001].predicted.item() == 1 and got[got.doc_id == 5_000].predicted.item() == 0


def test_classifiers_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs, quality.train(docs, labels)).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score_documents(some, labels).collect()] == [0, 0]


def brute_near(texts):
    """Components of five-word Jaccard similarity 0.8, by all pairs."""

    def held(text):
        words = [w for w in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, label = [held(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and (a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0):
                label = [label[j] if x == label[i] else x for x in label]
    return label


@needs_data
def test_pipeline(spark):
    """Every stage on the rows its predecessor kept, against a plain version of the same decisions."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    plain = docs.toPandas()
    copies = plain.head(40).assign(doc_id=lambda d: d.doc_id + 10_000)
    odd = [(20_000, None, "en", "s", 0), (20_001, "", "en", "s", 0), (None, plain.text[3], "en", "s", 1), (20_002, plain.text[4], "en", "s", 1), (20_002, plain.text[4], "en", "s", 1)]
    docs = materialize(docs.unionByName(spark.createDataFrame(copies)).unionByName(spark.createDataFrame(odd, docs.schema)), "test-docs")
    rows = [tuple(r) for r in docs.collect()]

    model = quality.train(table(spark, SF, "documents"), labels)
    rows = [r for r, s in zip(rows, model.score(np.array([quality.features(r[1] or "") for r in rows]))) if s >= 0.3]
    step = materialize(stages["quality"](spark, docs, SF), "test-1")
    assert sorted(map(tuple, step.collect()), key=repr) == sorted(rows, key=repr) and step.columns == docs.columns

    terms, examples = toxicity.train(table(spark, SF, "documents"), labels)
    reader = toxicity.TermReader(terms)
    counts = [reader.counts(r[1] or "") for r in rows]
    voter = toxicity.make_voter(terms, examples, len(rows), {t: sum(t in c for c in counts) for t in range(len(terms))})
    found = [sorted(c.items()) for c in counts]
    scores = voter.score(*voter.index.search(toxicity.unit_rows([[t for t, _ in f] for f in found], [[n for _, n in f] for f in found], voter.index.idf), toxicity.NEIGHBOURS))
    rows = [r for r, s in zip(rows, scores) if s < 0.7]
    step = materialize(stages["toxicity"](spark, step, SF), "test-2")
    assert sorted(map(tuple, step.collect()), key=repr) == sorted(rows, key=repr)

    first: dict = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(re.sub(SPACE, " ", r[1] or ""), r)
    rows = list(first.values())
    step = materialize(stages["exact copies"](spark, step, SF), "test-3")
    assert sorted(map(tuple, step.collect()), key=repr) == sorted(rows, key=repr)

    least: dict = {}
    for r, c in zip(rows, brute_near([r[1] for r in rows])):
        if c not in least or ((r[0] is None, r[0] or 0) < (least[c][0] is None, least[c][0] or 0)):
            least[c] = r
    rows = list(least.values())
    step = materialize(stages["near copies"](spark, step, SF), "test-4")
    assert sorted(map(tuple, step.collect()), key=repr) == sorted(rows, key=repr)

    ids = {r[0]: i for r, i in zip(rows, word_ids([r[1] for r in rows]).values())}
    assert check_packing(stages["packing"](spark, step, SF).collect(), ids) < 0.02
