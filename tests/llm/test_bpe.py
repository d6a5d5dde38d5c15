import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import bpe as B, token_counts as C

POOL = ["a", "b", "the", " ", "  ", "\n", "\r\n", "'s", "'", "é", "日本", "1", "23", "!", "--", "'re", "\t", "_", "A" * 5, "ab" * 7, "　", "🙂", "\x1c", "'ll", " '", "foo", "'t", "'v", "'d"]
texts = st.lists(st.sampled_from(POOL), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(1, 25))
def test_tree_concatenation_equals_whole(text, n):
    b = B.bpe()
    want = b.core.encode_ordinary(text)
    assert b.encode(text) == want
    parts = [B.Piece(text[i : i + n], b.core.encode_ordinary(text[i : i + n])) for i in range(0, len(text), n)]
    while len(parts) > 1:
        parts = [b.concatenate(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    assert (parts[0].tokens if parts else []) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abetsin", min_size=1, max_size=300), st.integers(1, 12))
def test_long_pretokens(text, leaf):
    b = B.bpe()
    assert b.tree(text.encode(), leaf) == b.whole(text.encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), texts), max_size=8))
def test_counts_equal_encoding(column):
    b = B.bpe()
    known = C.make_table(["the", " the", "foo"], b)
    got = C.counts(pa.array(column, pa.string()), known, b, {})
    assert got.tolist() == [len(b.core.encode_ordinary(t or "")) for t in column]


def rows():
    rng = random.Random(2)
    words = " ".join(rng.choice(POOL) for _ in range(30_000))
    unsplit = "".join(rng.choice("abcdefgh") for _ in range(70_000))
    return [(1, None), (None, "the text"), (2, ""), (3, words), (3, words), (4, unsplit), (5, " " * 40_000), (6, "<|endoftext|>"), (7, "a" * 100_000 + " é"), (8, "é" * 33_000)]


def test_documents_of_any_length(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 as tokens", "'k' as key", "2 as piece")
    b = B.bpe()
    want = sorted((str(d), None if t is None else b.encode(t)) for d, t in rows())
    got = B.encode(df)
    assert sorted((str(r.doc_id), None if r.tokens is None else list(r.tokens)) for r in got.collect()) == want
    assert all(r.round_trip in (True, None) and (r.n_tokens is None or r.n_tokens == len(r.tokens)) for r in got.collect())
    back = B.decode(got).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t) for d, t in rows())
    n = sorted((str(r.doc_id), r.n_tokens) for r in C.count_tokens(df).collect())
    assert n == [(d, None if t is None else len(t)) for d, t in want]
    for f in (B.encode, C.count_tokens):
        assert f(df.limit(0)).collect() == []


def test_counts_equal_tokens_on_the_table(spark, sf):
    n = {r.doc_id: r.n_tokens for r in C.query(spark, sf).collect()}
    assert n == {r.doc_id: r.n_tokens for r in B.query(spark, sf).collect()}


def test_large_texts_and_a_full_cache(monkeypatch):
    b = B.bpe()
    monkeypatch.setattr(C, "CACHE", 2)
    t = ["some words here and there", "other words"]
    assert C.counts(pa.array(t), C.make_table([], b), b, {}).tolist() == [len(b.encode(x)) for x in t]
    monkeypatch.setattr(C, "LARGE", 3)
    assert C.counts(pa.array(t), C.make_table([], b), b, {}).tolist() == [len(b.encode(x)) for x in t]
