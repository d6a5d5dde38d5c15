import random
import re

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import line_dedup as L

WORDS = "the of and to in is on river mountain engine violet quarry lantern orbit pepper saddle thimble umbrella walnut yonder zephyr".split()


def tokens(line):
    return frozenset(re.findall(r"[0-9a-z\x80-\U0010ffff]+", line.lower()))


def brute(rows):
    lines = [(d, i, tokens(x)) for d, t in rows if d is not None and t is not None for i, x in enumerate(t.split("\n"))]
    gone = set()
    for d, i, s in lines:
        for e, j, r in lines:
            if s and r and (e, j) < (d, i) and len(s & r) * L.DEN >= len(s | r) * L.NUM:
                gone.add((d, i))
                break
    return gone


def found(df):
    return {(r.doc_id, r.line) for r in L.repeated_lines(df).collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(50)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randint(1, 8)):
            w = rng.choice(pool).split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_hot_words_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT", 2)
    rows = corpus(5)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_small_batches_equal_brute_force(spark):
    rows = corpus(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1, max_size=30), st.sets(st.integers(0, 40), min_size=1, max_size=30))
def test_filters_lose_no_match(a, b):
    import numpy as np

    if len(a & b) * L.DEN < len(a | b) * L.NUM:
        return
    text = pa.array([" ".join(f"w{x}" for x in s) for s in (a, b)])
    x = L.Lines(text, np.full(L.SKETCH, 8, np.uint8))
    for rare in (8, 250):  # a rare word, and a hot one, whose postings are split by length
        x = L.Lines(text, np.full(L.SKETCH, rare, np.uint8))
        (_, pa_, ka), (_, pb, kb) = x.prefix(np.array([0])), x.prefix(np.array([1]))
        assert set(ka.tolist()) & set(kb.tolist())
    shared = [(i, j) for i, k in zip(pa_, ka) for j, m in zip(pb, kb) if k == m]
    assert shared
    i, j = min(shared)
    assert L._passes(x.size[:1], x.size[1:], np.array([i]), np.array([j]), x.bitmap[:1], x.bitmap[1:]).all()


def test_edge_rows(spark):
    long = "\n".join(f"line number {i} of a very long text with words" + str(i) for i in range(3000))
    rows = [(1, None, 7), (None, "a b c", 7), (2, "", 0), (3, "\n\n", 2), (4, "!!\n!!", 5), (5, "a b c\nx\nA  B, c", 1), (6, "X\r\nnew", 6), (6, "X\r\nnew", 6), (7, long, 9), (8, long, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumns({c: df_lit() for c in ("line", "lines", "of", "__gone", "__doc", "n", "word")})
    got = found(df)
    assert {x for x in got if x[0] < 7} == {(5, 2), (6, 0)}
    assert {x for x in got if x[0] == 8} == {(8, i) for i in range(3000)}
    out = L.without_repeated_lines(df)
    assert out.columns == df.columns and out.count() == len(rows)
    texts = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    assert texts[5, 7] == "a b c\nx" and texts[6, 3] == "new" and texts[8, 0] == "" and texts[4, 5] == "!!\n!!" and texts[1, 7] is None and texts[None, 7] == "a b c"
    assert L.without_repeated_lines(df.limit(0)).collect() == []


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_oracle_on_the_table(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = dict(c.execute(L.ORACLE).fetchall())
    got = {r.doc_id: r.text for r in L.query(spark, sf).collect()}
    assert got == want
