import itertools
import random

import numpy as np
import pyarrow as pa
from loomgraph.llm import components, simhash_dedup as S
from loomgraph.llm.text import lowered, words_of

WORDS = [f"{a}{b}{c}" for a in ("al", "be", "co", "du", "em", "fi") for b in ("ra", "so", "ti", "vu", "wel") for c in ("n", "st", "ck", "r", "ly", "d")]


def make_docs(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    base = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(40)]
    docs = list(base)
    for t in base[:15]:
        for _ in range(3):
            w = t.split()
            for i in rng.sample(range(len(w)), len(w) // 30):
                w[i] = word()
            docs.append(" ".join(w))
    docs += base[:5]
    return [(i, t) for i, t in enumerate(docs)]


def brute_groups(docs):
    high, low, n = S.fingerprint_arrays(pa.array([t for _, t in docs]))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        d = int(high[i] ^ high[j]).bit_count() + int(low[i] ^ low[j]).bit_count()
        if n[i] and n[j]:
            same = d <= S.RADIUS and min(n[i], n[j]) >= S.LENGTH_RATIO * max(n[i], n[j])
        else:
            same = d == 0 and n[i] == n[j]
        if same:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    return {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_words_agree_across_chunks_and_rows(monkeypatch):
    from loomgraph.llm import text

    a = words_of(*lowered(pa.array(["Ab cd-ef", None, "", "gh\nÉté", "gh"])))
    assert [int(x) for x in a[1] - a[0]] == [2, 2, 2, 2, 5, 2]
    assert a[2][3] == a[2][5]
    monkeypatch.setattr(text, "CHUNK", 3)
    monkeypatch.setattr(text, "_POW", [])
    b = words_of(*lowered(pa.array(["Ab cd-ef", None, "", "gh\nÉté", "gh"])))
    assert all((x == y).all() for x, y in zip(a, b))


def test_code_covers_and_anchors_meet():
    code = S.hamming_codewords()
    assert len(code) == 4096
    v = np.arange(1 << 16, dtype=np.uint32)
    nearest = np.full(1 << 16, 99, dtype=np.uint8)
    for c in code:
        nearest = np.minimum(nearest, np.bitwise_count(v ^ np.uint32(c)))
    assert nearest.max() == 1
    at, anchors = S.anchor_lists()
    lists = lambda x: set(anchors[at[x] : at[x + 1]].tolist())
    flips = [0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i in range(16) for j in range(i))]
    # the code is linear: what holds of the blocks around one codeword, and so of a coset leader each, holds of all
    every = np.split(anchors, at[1:-1])
    masks = np.zeros((1 << 16, len(code) // 64), dtype=np.uint64)
    spot = np.searchsorted(code, anchors)
    np.bitwise_or.at(masks, (np.repeat(np.arange(1 << 16), np.diff(at)), spot // 64), np.uint64(1) << (spot % 64).astype(np.uint64))
    assert len(every) == 1 << 16
    for flip in flips:
        for lo in range(0, 1 << 16, 1 << 13):
            x = np.arange(lo, lo + (1 << 13))
            assert (masks[x] & masks[x ^ flip]).any(axis=1).all()
    number, partners = S.offset_partners()
    rng = random.Random(0)
    for flip in flips:
        x = rng.randrange(1 << 16)
        both = sorted(lists(x) & lists(x ^ flip))
        asked = [int(number[x ^ flip ^ a]) in partners[number[x ^ a]] for a in both]
        assert 1 <= sum(asked) <= 2


def test_groups_equal_brute_force(spark):
    docs = make_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in S.near_duplicate_groups(df).collect()}
    assert got == brute_groups(docs)
    planted = [i for i in range(40, 85)]
    assert sum(i in got for i in planted) >= 0.95 * len(planted)
    assert all(i not in got for i in range(15, 40))


def test_anchors_taken_apart_equal_brute_force(spark, monkeypatch):
    docs = make_docs(6)
    high, low, n = S.fingerprint_arrays(pa.array([t for _, t in docs]))
    monkeypatch.setattr(S, "APART", 2)
    rng, flips = np.random.default_rng(2), []
    for _ in range(400):
        h, x = int(high[0]), int(low[0])
        for b in rng.choice(128, rng.integers(0, 30), replace=False).tolist():
            h, x = (h ^ (1 << b), x) if b < 64 else (h, x ^ (1 << (b - 64)))
        flips.append((h, x))
    high, low = (np.concatenate([a, np.array(b, np.uint64)]) for a, b in zip((high, low), zip(*flips)))
    n = np.concatenate([n, rng.integers(50, 200, 400)]).astype(np.int32)
    order = np.argsort(n, kind="stable")
    high, low, n = high[order], low[order], n[order]
    ids, at = np.arange(len(n)), S.anchor_lists()
    edges: list = []
    for k in range(S.BLOCKS):
        block = ((high if k < 4 else low) >> np.uint64(16 * (k % 4))).astype(np.int64) & 0xFFFF
        row = np.repeat(ids, np.diff(at[0])[block])
        anchor = np.concatenate([at[1][at[0][b] : at[0][b + 1]] for b in block.tolist()])
        for a in np.unique(anchor).tolist():
            r = row[anchor == a]
            for fresh in (0, len(r) // 2):  # as one batch, and as a second that follows half of the rows
                if fresh:
                    S._spanning(high[r[:fresh]], low[r[:fresh]], n[r[:fresh]], r[:fresh], 0, edges, (k << 16) | a)
                S._spanning(high[r], low[r], n[r], r, fresh, edges if fresh else [], (k << 16) | a)

    def groups(pairs):
        label = list(range(len(n)))
        for _ in range(len(n)):
            before = list(label)
            for u, v in pairs:
                label[u] = label[v] = min(label[u], label[v])
            if label == before:
                return label

    dist = np.bitwise_count(high[:, None] ^ high[None, :]) + np.bitwise_count(low[:, None] ^ low[None, :])
    want = (dist <= S.RADIUS) & (np.minimum.outer(n, n) >= S.LENGTH_RATIO * np.maximum.outer(n, n) - 1e-9)
    assert groups(edges) == groups(np.argwhere(want).tolist())


def test_streamed_anchors_equal_one_batch(spark):
    docs = make_docs(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = {r.doc_id: r.group_id for r in S.near_duplicate_groups(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_groups(docs)


def test_edge_rows(spark):
    long = " ".join(WORDS) * 300
    rows = [(1, None, "x"), (None, "same text here", "x"), (2, "", "x"), (3, "", "x"), (4, "!!!", None), (5, "!!!", "y"), (6, "???", "y"), (7, long, "y"), (8, long, "y"), (9, "one", "z"), (9, "one", "z"), (10, "unique words only", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string").withColumnsRenamed({"rep": "group_id"}).selectExpr("*", "'c' as gone", "'c' as __gone", "1 as rep", "2 as size", "3 as node")
    got = {r.doc_id: r.group_id for r in S.near_duplicate_groups(df).collect()}
    assert got == {2: 2, 3: 2, 4: 4, 5: 4, 7: 7, 8: 7}
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 6, 7, 9, 9, 10]
    assert S.near_duplicate_groups(df.limit(0)).collect() == []
    assert S.keep_one(df.limit(0)).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {101: 100, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
