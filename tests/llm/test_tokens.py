"""Operators 1, 2, 5 and 8 against the public tokenizer libraries."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pricelens.llm import byte_bpe, chunks, packing, token_counts, token_store

TEXTS = [
    "", None, " ", "\n", "  a", "a  b \n c\t\td", "x <|endoftext|> y<|endoftext|>z", "A" * 3000, "aaa aaaa aaaaa", "foo!\x1c\x1d! bar\xa0\xa0 baz", "   q  ",
    "日本語 テキスト 😀😀", "I'll don't 'tis 123 4567", "a \n\n b\n \nc ", "Größe, Straße. ÉCOLE!! ΟΔΟΣ école", "the the the\nthe,", "the the the\nthe,", "x" * 200 + " " + "word, " * 900,
]
MULTI, GPT, WORD = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "x", 1.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n double")


def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(MULTI), special_tokens={})


@given(st.text(alphabet=st.sampled_from("ab Zé\n\t.,!'1́\x1c <|>"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_chunks_rejoin(text):
    for regular in chunks.are_regular([text]):
        if regular:
            assert "".join(map(chunks.chunk_of, chunks.split_keys([text]).to_pylist()[0])) == text


@given(st.lists(st.text(alphabet=st.sampled_from("ab Zé\n\t.,!'1́\x1c <|>Σ"), max_size=60), max_size=6))
@settings(max_examples=100, deadline=None)
def test_ids_of_any_text(texts):
    from pricelens.llm.hf_ids import tokenizer_of

    for path in (GPT, WORD):
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert [i.tolist() for i in tokenizer_of(path).encode(texts)] == want
    codec = byte_bpe.codec_of(MULTI, P.PATTERN)
    assert [i.tolist() for i in codec.encode(texts)] == tik().encode_ordinary_batch(texts)


def test_ids_where_case_matters():
    from pricelens.llm.hf_ids import tokenizer_of

    texts = ["a <|EndOfText|> b", "<|STARTOFTEXT|>", "J\u030c H\u0331 J\u030cA", "A\u0301 FÜR Für", "İI ΟΔΟΣ Kelvin \u212a", "The END", "İ<", "aİ. b", "\u0958!", "\ufb1d, x"]
    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in tokenizer_of(WORD).encode(texts)] == want


@given(st.lists(st.text(alphabet=st.sampled_from("JHaT \u030c\u0331\u0301ÜéΣİ\n.<|>"), max_size=40), max_size=6))
@settings(max_examples=200, deadline=None)
def test_ids_of_capitals_and_marks(texts):
    from pricelens.llm.hf_ids import tokenizer_of

    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in tokenizer_of(WORD).encode(texts)] == want


@pytest.mark.parametrize("path", [GPT, WORD])
def test_ids_do_not_depend_on_how_many_units_are_encoded_at_once(monkeypatch, path):
    from pricelens.llm import hf_ids

    monkeypatch.setattr(hf_ids, "UNITS", 3)
    texts = [*(t or "" for t in TEXTS), " ".join(f"word{i}," for i in range(50)), ""]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in hf_ids.FileTokenizer(path).encode(texts)] == want


def test_byte_bpe(docs):
    got = sorted(map(tuple, byte_bpe.encode_documents(docs, MULTI, P.PATTERN, with_ids=True).collect()), key=repr)
    enc, want = tik(), []
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        data = np.array(ids, "<u4").tobytes()
        want.append((i if i != 5 else None, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, (t or "").encode()))
    assert [(*g[:5], bytes(g[5])) for g in got] == sorted(want, key=repr)


def test_model_needs_all_bytes():
    with pytest.raises(ValueError):
        byte_bpe.sentencepiece_model({b"a": 0})


def test_token_counts(docs):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, GPT, P.PATTERN, 1024).collect()}
    want = {(i if i != 5 else None, len((t or "").encode()), len(e.ids), len(e.ids) > 1024) for i, (t, e) in enumerate(zip(TEXTS, Tokenizer.from_file(GPT).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)))}
    assert got == want and any(w[3] for w in want)


def test_merge_table_rejects_unordered_merges():
    vocab = {c: i for i, c in enumerate(token_counts.byte_alphabet())} | {"ab": 256, "abc": 257}
    with pytest.raises(ValueError):
        token_counts.MergeTable(vocab, [("ab", "c"), ("a", "b")])


def test_token_store(spark, docs):
    got = sorted(map(tuple, token_store.read_store(*token_store.write_store(docs, GPT, length=64)).collect()), key=lambda r: r[1])
    rows = sorted(((i if i != 5 else None, t) for i, t in enumerate(TEXTS)), key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for (i, _), e in zip(rows, Tokenizer.from_file(GPT).encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        ids = [*e.ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_sequence_file_views(tmp_path):
    path = str(tmp_path / "x.arrow")
    with pa.OSFile(path, "wb") as sink:
        writer = token_store.SequenceWriter(sink, pa.uint16(), 8)
        for k in range(0, 1000, 10):
            writer.append(np.arange(k, k + 10, dtype="<u4"))
        writer.append(np.array([7], "<u4"))
        writer.close()
    source = pa.memory_map(path)
    file = token_store.SequenceFile(source)
    ids, mask = file.sequence(70)
    assert ids.to_pylist() == list(range(560, 568)) and all(mask.to_pylist())
    start = source.size() and ids.buffers()[1].address
    whole = source.read_buffer(source.size())
    assert whole.address <= start < whole.address + whole.size  # a view of the mapped file
    assert file.sequence(125)[1].to_pylist() == [True] + [False] * 7
    with pytest.raises(ValueError):
        list(file.slices(np.array([1000]), np.array([2])))


def check_packing(rows, ids, window=4096):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(by) == set(ids)
    for doc, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[doc])
    used = padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        used += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, used)


def word_ids(texts):
    return {i: np.array([*e.ids, 2], "<u4") for i, e in enumerate(Tokenizer.from_file(WORD).encode_batch([t or "" for t in texts], add_special_tokens=False))}


def test_packing(spark):
    rng = np.random.default_rng(3)
    texts = [*TEXTS, *(" ".join(["word"] * int(n)) for n in rng.integers(1, 9000, 60)), "a " * 4095, "a " * 4096, "a " * 8191]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD, end_id=2).collect()
    assert check_packing(got, word_ids(texts)) < 0.01
    assert {r.sequence_id % 3 for r in got} == {0, 1, 2}


def test_packing_of_nothing_and_repeats(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORD, end_id=2).collect() == []
    got = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string"), WORD, end_id=2).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got for _ in [0] if r.start == 0) == [(0, 1), (1, 3), (1, 3)]


def test_packing_plan():
    combos = packing.combinations(16, 3)
    assert len(combos) == len({tuple(c) for c in combos.tolist()}) and (combos.sum(axis=1) == 16).all()
    assert len(combos) == sum(1 for a in range(17) for b in range(a + 1) for c in range(b + 1) if a + b + c == 16 and a)
    histogram = np.zeros(17, np.int64)
    histogram[[10, 6, 4, 8]] = [100, 110, 45, 20]  # fits exactly: 100 of (10, 6), 20 of (8, 4, 4), 5 of (6, 6, 4)
    plan = packing.make_plan(histogram)
    assert (plan.used <= histogram).all() and plan.used.sum() > 0.9 * histogram.sum()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_documents(empty, MULTI, P.PATTERN).count() == 0
    assert token_counts.count_tokens(empty, GPT, P.PATTERN, 10).count() == 0
    assert token_store.read_store(*token_store.write_store(empty, GPT)).count() == 0
