"""Operators 11 and 12 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pricelens.llm import periodic, queries, secrets

SPACE = r"[\x20\x09-\x0D]+"
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# periodic runs


def brute_runs(words):
    runs = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                runs.append((start, i - start + q, q))
    return sorted(r for r in runs if not any(q < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, q in runs))


def brute_collapse(doc_id, text):
    words = [w for w in re.split(SPACE, text or "") if w]
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@given(st.lists(st.lists(st.integers(0, 3), max_size=70), min_size=1, max_size=4), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_runs(texts, period):
    texts = [*texts, (texts[0] + [7])[:period] * 5]
    counts = np.array([len(t) for t in texts])
    ids = np.array([w for t in texts for w in t], np.int64)
    text, start, length, q = periodic.find_runs(ids, counts)
    first = np.cumsum(counts) - counts
    got = [[] for _ in texts]
    for t, s, n, p in zip(text.tolist(), start.tolist(), length.tolist(), q.tolist()):
        got[t].append((s - int(first[t]), n, p))
    assert got == [brute_runs(t) for t in texts]


def test_collapse_documents(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "one", "a " * 40, "x y\tz\n" * 9 + "x y", "ä  b " * 30 + "c " * 20 + "Ä b " * 8, "w w " * 13]
    texts += [" ".join(rng.choices("ab", k=rng.randint(0, 300))) for _ in range(60)]
    texts += [" ".join(rng.choices(["u", "v", "w", "x"], k=40)) + " pq" * rng.randint(0, 30) for _ in range(60)]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(5, texts[5], "c", 2), (5, "other", "c", 3), (None, "r s " * 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code string, n_runs long").repartition(3)
    assert rows_of(periodic.collapse_documents(docs)) == sorted((brute_collapse(r[0], r[1]) for r in rows), key=repr)
    assert periodic.collapse_documents(docs.limit(0)).count() == 0


def test_long_text_is_one_run(spark):
    text = "k " * 400_000 + "end " + "tail " * 11
    got = periodic.collapse_documents(spark.createDataFrame([(3, text)], "doc_id long, text string")).first()
    assert (got.n_runs, got.start, got.length, got.period) == (1, 0, 400_000, 1) and got.collapsed_sha256 == sha("k end " + " ".join(["tail"] * 11))


# secrets

HEX = "0123456789abcdef"


def brute_base(text):
    found = []
    for n, (kind, pattern, least, group) in enumerate((
        ("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
        ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0),
    )):
        found += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(found)


def key(rng, n, alphabet=HEX):
    return "".join(rng.choices(alphabet, k=n))


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(8)
    prose = lambda n: " ".join(key(rng, rng.randint(2, 20), "etaoinshrdlu") for _ in range(n))
    rows = [(i, f"{prose(30)} password={key(rng, 18)} {prose(9)} Token: \"{key(rng, 40)}\" é{prose(3)}") for i in range(150)]
    rows += [(200 + i, f"{prose(12)} AKIA{key(rng, 16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')} {prose(12)}") for i in range(150)]
    rows += [(400 + i, prose(60)) for i in range(100)]
    rows += [(600 + i, f"ü {prose(5)} {key(rng, 20)} {prose(5)}") for i in range(20)]  # no base pattern matches these
    rows += [(700, None), (701, ""), (702, "secret=token:abcdefgh token=abc passwd : 'a.b-c/d_=' API_KEY=AKIA0000"), (703, "tokenſ=abcdefg ſecret=abcdefg apiKey=xxxxxx"), (704, "f" * 23 + "g" + "0" * 24)]
    return rows + [(None, rows[0][1]), (3, rows[3][1]), (3, "x")]


def test_find_secrets(spark, leaks):
    docs = spark.createDataFrame([(*r, "s", 0) for r in leaks], "doc_id long, text string, spans string, kind int").repartition(4)
    got = secrets.find_secrets(docs).collect()
    base = {}
    for d, t in leaks:
        base.setdefault(d, []).append(brute_base(t or ""))
    as_text = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    want = sorted(((d, *[sum(s[3] == k for s in b) for k in secrets.KINDS], sha(as_text(b))) for d, bs in base.items() for b in bs), key=repr)
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=repr) == want
    for r in got:
        spans = [s for s in r.spans.split(",") if s]
        kept = [s for s in spans if not s.startswith("inferred:")]
        assert sha(",".join(kept)) == r.base_sha256 and len(spans) - len(kept) == r.n_inferred
    inferred = {r.doc_id: r.n_inferred for r in got if r.doc_id is not None}
    assert sum(inferred[600 + i] for i in range(20)) >= 19 and not any(inferred[400 + i] for i in range(100))
    again = secrets.find_secrets(docs.repartition(2))
    assert rows_of(again) == sorted(map(tuple, got), key=repr)


def test_spans_equal_plain_scoring(spark, leaks):
    """The query's spans are those of base matches and candidates scored one by one."""
    docs = spark.createDataFrame(leaks, "doc_id long, text string")
    labelled, ordinary = {k: set() for k in secrets.KINDS}, set()
    for _, t in leaks:
        taken = brute_base(t or "")
        for n, kind in enumerate(secrets.KINDS):
            pattern, least, group = secrets.PATTERNS[kind]
            labelled[kind] |= {m[group] for m in pattern.finditer(t or "") if len(m[group]) >= least}
        ordinary |= {m[0] for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", t or "") if not any(s < m.end() and m.start() < e for s, _, e, _ in taken)}
    formats = secrets.Formats({k: sorted(v) for k, v in labelled.items()}, sorted(ordinary))
    want = []
    for d, t in leaks:
        spans = [(s, n, e, k) for s, n, e, k in brute_base(t or "")]
        spans += [(m.start(), 3, m.end(), "inferred") for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", t or "") if m[0] in ordinary and not any(s < m.end() and m.start() < e for s, _, e, _ in spans if _ != 3) and formats.odds(m[0]) >= secrets.LEAST_ODDS]
        want.append((d, ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))))
    assert sorted(((r.doc_id, r.spans) for r in secrets.find_secrets(docs).collect()), key=repr) == sorted(want, key=repr)


def test_automaton_learns_a_format():
    rng = random.Random(2)
    made = lambda: "AB" + key(rng, 2, "xy") + "-" + key(rng, 10, "0123")
    learned = secrets.Automaton([made() for _ in range(800)])
    assert len(learned.table) < 30  # the tree has thousands of states
    inside = [learned.score(made()) for _ in range(100)]
    assert min(inside) > learned.score("ABzz-0123012301") + 5 and min(inside) > learned.score("xy" * 7) + 5
    # chances of all continuations of a state add up to less than one
    for steps, missing, end in learned.table.values():
        assert np.exp([p for p, _ in steps.values()] + [end]).sum() <= 1 + 1e-9 and missing < 0


def test_no_labels_no_documents(spark):
    docs = spark.createDataFrame([(1, "abcdefabcdefabcdefabcdefXYZ0123456789"[:20]), (2, None)], "doc_id long, text string")
    assert [(r.spans, r.n_inferred) for r in secrets.find_secrets(docs).orderBy("doc_id").collect()] == [("", 0), ("", 0)]
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_queries_read_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert rows_of(queries.op12_periodic(spark, SF)) == sorted((brute_collapse(r.doc_id, r.text) for r in docs), key=repr)
    got = {r.doc_id: r for r in queries.op11_secrets(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        spans = brute_base(r.text or "")
        assert got[r.doc_id].base_sha256 == sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans))
