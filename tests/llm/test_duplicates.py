"""Operators 4, 6, 7 and 10 against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from pricelens.llm import ann, components, exact_dedup, near_copies, simhash, url_filter

SPACE = r"[\x20\x09-\x0D]+"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(30)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    rows += [(100 + i, base[0].replace(" ", " \n\t" if i % 2 else " ", 3), "hot") for i in range(60)]  # copies
    rows += [(200 + i, base[1] + f" w{i % 7}", "s") for i in range(40)]  # near copies
    rows += [(300, None, "s"), (301, "", "s"), (302, " ", "s"), (303, "  \n", "s"), (None, base[2], "s"), (None, "only one", "s"), (7, base[7], "s"), (7, base[7], "s"), (8, "other text", "s"), (400, "One", "s"), (401, "one", "s"), (402, "a b", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)


@given(st.lists(st.integers(0, 10**6), max_size=80), st.integers(0, 20))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values, shift):
    data = np.unique(np.array(values, np.uint64))
    assert exact_dedup.golomb_decode(exact_dedup.golomb_encode(data, shift), len(data), shift).tolist() == data.tolist()


def test_exact_duplicates(docs):
    groups = defaultdict(list)
    source = [(r.doc_id, re.sub(SPACE, " ", r.text or "")) for r in docs.collect()]
    for d, t in source:
        groups[t].append(d)
    smallest = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(((d, smallest[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in source), key=repr)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_every_equal_fingerprint_is_a_suspect(spark):
    prints = spark.range(4000).selectExpr("id as row", "if(id < 1500, 42, if(id < 1600, id div 2, id * 7919 * 104729 * 1299709)) as fp")
    marked = exact_dedup.mark_suspects(prints, 4000).join(prints, "row").collect()
    count = defaultdict(int)
    for r in marked:
        count[r.fp] += 1
    assert len(marked) == 4000 and all(r.suspect for r in marked if count[r.fp] > 1)
    assert sum(r.suspect for r in marked if count[r.fp] == 1 and r.row >= 1600) < 20


def test_drop_copies(docs):
    left = exact_dedup.drop_copies(docs).collect()
    assert len(left) == len({re.sub(SPACE, " ", r.text or "") for r in docs.collect()}) and left[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert {r.doc_id for r in left} >= {0, 1, 2, 7, 8, 300, 302}


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = label[i], label[int(j)]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash(docs):
    source = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    label = brute_components([p for _, p in source])
    least = {c: min((d for (d, _), x in zip(source, label) if x == c and d is not None), default=None) for c in set(label)}
    assert rows_of(simhash.near_duplicates(docs)) == sorted(((d, f"{p:016x}", least[c]) for (d, p), c in zip(source, label)), key=repr)
    left = simhash.drop_near_copies(docs).collect()
    assert len(left) == len(set(label)) and {c for c in least.values() if c is not None} <= {r.doc_id for r in left}


def test_near_copies_stage(spark, monkeypatch):
    """The pipeline's stage against five-word Jaccard of all pairs, over edits from light to heavy."""
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "TILE", 8)
    rng = np.random.default_rng(9)
    texts = [None, "", " ", "a b", "A  b", "a b c d e", "one two three four five six"]
    hot = [f"h{i}" for i in range(60)]  # a passage that many texts hold
    for base in range(12):
        words = [f"b{base}x{i}" for i in range(150)] + (hot if base % 2 else [])
        for copy in range(6):
            changed = list(words)
            for at in rng.choice(len(words), copy + base % 3, replace=False):
                changed[at] = f"c{copy}"
            texts.append(" ".join(changed))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (3, "a b"), (500, texts[20])]

    def held(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, label = [held(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                label = [label[j] if x == label[i] else x for x in label]
    least = sorted(min((d for (d, _), x in zip(rows, label) if x == c and d is not None)) for c in set(label))
    stage = dict(corpus_pipeline.STAGES)["near copies"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == least and 20 < len(least) < len(rows) - 20


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_bit_sliced_pairs(values, radius):
    near = [v ^ (1 << (k % 64)) for k, v in enumerate(values)]
    data = np.array(values + near + values[:3], np.uint64)
    got = {(int(a), int(b)) for i, j in simhash.near_pairs(data, np.full(len(data), len(data)), radius) for a, b in zip(i, j)}
    assert got == {(i, j) for i in range(len(data)) for j in range(i + 1, len(data)) if int(data[i] ^ data[j]).bit_count() <= radius}


def test_large_bucket_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = np.random.default_rng(1)
    prints = sorted({int(sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 4), replace=False))) for _ in range(150)} | {3 << 60, (3 << 60) | 6})
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    got = {r.node: r.component for r in components.connected_components(simhash.links(nodes)).collect()}
    label = brute_components(prints)
    for i, a in enumerate(prints):
        for j, b in enumerate(prints):
            x, y = (int(np.uint64(v).astype(np.int64)) for v in (a, b))
            assert (label[i] == label[j]) == (got.get(x, x) == got.get(y, y))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(5, 5), (None, 3), (300, 301), (301, 300)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}, 300: 300, 301: 300}
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_url_filter(spark):
    rows = [
        (1, "https://a.example.net/fr/1#x", '<LINK rel="canonical" href="https://b.org/x">'), (2, "https://b.org/x", "<meta http-equiv=refresh content='0; url=/y'>"),
        (3, "https://b.org/y?q#z", None), (4, "https://b.org/y", ""), (5, None, "x"), (6, "nope", None), (7, "http://WWW.Example.com/en/1", '<link href="https://b.org/y" rel=canonical>'),
        (8, "https://com/", ""), (9, "https://xcom/", ""), (10, "https://a.example.com/en", ""), (11, "https://a.example.com/en/?x", ""), (12, "https://x.com?a/", None), (4, "https://b.org/y", ""),
        (13, "https://c.org/d/e", '<link rel=canonical href="f">'), (14, "https://c.org/d/f", ""), (15, "", ""), (None, "https://q.net/es/", ""),
    ]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "node")).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "a.example.net", "/fr/1", "net/fr/", "block"), (2, "b.org", "/x", None, "block"), (3, "b.org", "/y", None, "allow"), (4, "b.org", "/y", None, "block"), (4, "b.org", "/y", None, "block"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (8, "com", "/", "com/", "allow"), (9, "xcom", "/", None, "allow"),
        (10, "a.example.com", "/en", "com/", "allow"), (11, "a.example.com", "/en/", "example.com/en/", "block"), (12, "x.com", "", None, "allow"), (13, "c.org", "/d/e", None, "allow"),
        (14, "c.org", "/d/f", None, "allow"), (15, "", "", None, "allow"), (None, "q.net", "/es/", "net/es/", "block"),
    ], key=repr)


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "https://a.net/fr/", "<link rel=canonical href='https://b.org/'>")], "page_id long, url string, html string")
    plan = url_filter.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    vectors = [(i, (centers[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)]
    hot = rng.normal(size=16).tolist()
    vectors += [(2000 + i, hot) for i in range(700)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [None] * 16), (9400, [1.0] * 4), (None, hot)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids = np.array([i for i, v in vectors[:2200]])
    data = np.array([v for _, v in vectors[:2200]])
    found = wanted = 0
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    for q, rows in got.items():
        far = np.sqrt(((data - data[ids == q][0]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, far)) if ids[k] != q][:10]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and all(far[ids == v][0] == s for _, v, s in rows)
        found += len({v for _, v, _ in rows} & {int(ids[k]) for k in order})
        wanted += len(order)
        if q >= 2000:
            assert [v for _, v, _ in rows] == [int(ids[k]) for k in order]
    assert found >= 0.9 * wanted


def test_ratio_alone_decides_the_lists():
    rng = np.random.default_rng(8)
    centroids, points = rng.normal(size=(300, 32)), rng.normal(size=(40, 32))
    far = ((points[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    want = [set(np.flatnonzero(row <= row.min() * ann.REACH**2).tolist()) for row in far]
    assert max(map(len, want)) > 100
    assert [set(p.tolist()) for p in ann.probes(ann.CentroidGraph.build(centroids), points) if len(p) > 48] == [w for w in want if len(w) > 48]


def test_neighbours_of_few(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ann.nearest(frame([])).count() == 0 and ann.nearest(frame([(0, [1.0, 2.0])])).count() == 0
    assert rows_of(ann.nearest(frame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (100, [1.0, 3.0]), (1, [1.0, 2.0])]))) == [(0, 1, 1, 0.0), (0, 2, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0)]


def test_small_clump_finds_ten(spark):
    """A query that lies on the centroid of a list of three still gets its ten neighbours, exact ones."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        places = rng.normal(size=(10, 8))
        vectors = [(2 * (290 * n + i) + 1, places[n]) for n in range(9) for i in range(290)] + [(100, places[9]), (10_001, places[9]), (10_003, places[9])]
        rows = sorted(ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<double>")).collect(), key=lambda r: r["rank"])
        far = sorted((float(np.sqrt(((v - places[9]) ** 2).sum())), i) for i, v in vectors if i != 100)[:10]
        assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(100, n + 1, i) for n, (_, i) in enumerate(far)]


def test_neighbours_of_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_PER_LIST", 2)
    rows = spark.range(3000).selectExpr("id as vec_id", "array(1.0D, 2.0D + id div 2999) as embedding")
    got = ann.nearest(rows).collect()
    assert len(got) == 300 and all(r.score == 0.0 for r in got) and {r.vec_id for r in got if r.query_id == 0} == set(range(1, 11))


def test_neighbours_over_slots_and_blocks(spark, monkeypatch):
    """Many slots, blocks and parts of lists give what one of each gives, copies and ties included."""
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.integers(0, 4, 6)]) for i in range(900)] + [(5000 + i, [1.0] * 6) for i in range(300)]
    frame = spark.createDataFrame([(i, v) for i, v in vectors if any(v)], "vec_id long, embedding array<float>")
    once = rows_of(ann.nearest(frame))
    for name, value in (("PART_ROWS", 32), ("BLOCK_ROWS", 3), ("SLOT_ROWS", 40)):
        monkeypatch.setattr(ann, name, value)
    assert rows_of(ann.nearest(frame)) == once and len(once) == 120


def test_block_holds_the_nearest():
    rng = np.random.default_rng(6)
    points, vectors, ids = rng.integers(0, 3, (40, 5)).astype(float), rng.integers(0, 3, (600, 5)).astype(float), rng.permutation(600)
    block = ann.Block(np.arange(40), points, [np.array([1, 3])] * 39 + [np.array([3])], 10)
    for number, a in ((1, 0), (1, 100), (2, 200), (3, 300), (3, 450)):
        block.meet(number, ids[a : a + 100], vectors[a : a + 100])
    for q in range(40):
        read = [k for k in range(600) if (k < 200 and q < 39) or 300 <= k < 400 or 450 <= k < 550]
        far = sorted((float(np.sqrt(((vectors[k] - points[q]) ** 2).sum())), int(ids[k])) for k in read if ids[k] != q)[:10]
        assert list(zip(block.dist[q].tolist(), block.found[q].tolist())) == far


def test_near_copies_start_from_simhash(spark):
    """Operator 7's components give the first pairs: one word of many differs, the SimHash by two bits at most."""
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"z{i}" for i in range(300))]
    bits = [simhash.fingerprint(t, 5) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= simhash.RADIUS and near_copies.shingles(texts[0]).tolist() != near_copies.shingles(texts[1]).tolist()
    prints = near_copies.prints_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5)
    pairs = near_copies.alike_by_simhash(prints.select("fp", "sim")).collect()
    own = {r.doc_id: r.fp for r in prints.collect()}
    assert [{bytes(p.member), bytes(p.centre)} for p in pairs] == [{bytes(own[0]), bytes(own[1])}]


def test_common_shingles_stand_last_however_few_of_the_texts_hold_them(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 5, raising=False)  # what a fixed sample is to many texts
    phrase = " ".join(f"common{i}" for i in range(12))
    texts = [" ".join(f"own{d}x{i}" for i in range(60)) + (f" {phrase}" if d % 16 == 0 else "") for d in range(200)]
    prints = near_copies.prints_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5)
    held = set(near_copies.shingles(phrase).tolist())
    assert not [r.doc_id for r in prints.collect() if held & set(r.prefix)]


@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=400), st.sets(st.integers(-(2**63), 2**63 - 1), max_size=60), st.integers(0, 400))
@settings(max_examples=40, deadline=None)
def test_maps_differ_in_no_more_bits_than_sets_in_shingles(held, more, kept):
    other = set(sorted(held)[:kept]) | more
    a, b = [near_copies.map_of(np.array(sorted(s), np.int64)) for s in (held, other)]
    assert len(a) == len(near_copies.MAP) and sum(int(w).bit_count() for w in (a ^ b).view(np.uint64)) <= len(held ^ other)


@pytest.mark.parametrize("long", [0, near_copies.LONG])
def test_last_join_alone_finds_all_near_copies(spark, monkeypatch, long):
    """Without the rounds before it, with and without the count in L buckets."""
    for name, value in (("STARS", 0), ("DRAWS", 0), ("LONG", long)):
        monkeypatch.setattr(near_copies, name, value)
    test_near_copies_stage(spark, monkeypatch)


def test_last_join_makes_no_rows_of_texts_that_only_share_passages(spark):
    """Of 150 texts of one form, each with two words of its own, all pairs meet in buckets; only a text and its copy are similar."""
    form = [f"form{i}" for i in range(64)]
    texts = [" ".join([*form[:20], f"own{d}", *form[21:40], f"name{d}", *form[41:]]) for d in range(150)]
    texts += [t + " end" for t in texts[:5]]
    prints = near_copies.prints_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).cache()
    own = {bytes(r.fp): r.doc_id for r in prints.collect()}
    nodes = prints.selectExpr("fp", "1 as rows", *near_copies.MAP)
    bucket = near_copies.buckets_of(prints, nodes).cache()
    every = bucket.alias("x").join(bucket.alias("y"), "h").filter("x.fp < y.fp").count()  # what the join made
    met = near_copies.meetings(bucket, nodes).collect()
    assert every > 150 * 149 / 2 and len(met) < 155
    assert {(k, 150 + k) for k in range(5)} <= {tuple(sorted((own[bytes(r.centre)], own[bytes(r.member)]))) for r in met}
