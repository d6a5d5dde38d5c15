import random

from loomgraph.llm import decontaminate as D

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "tu") for b in ("ban", "den", "fil", "gor", "hum", "jax", "kel")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def split(t):
    import pyarrow as pa
    from loomgraph.llm.text import lowered, words_of

    s, e, h = words_of(*lowered(pa.array([t])))
    return h, e - s


def brute(docs, items):
    out = {}
    for d, t in docs:
        h, length = split(t)
        for i, q in items:
            ih, il = split(q)
            ish, iw = D.weighted_shingles(ih, il)
            fp, size = D.simhash(ish, iw), len(ih)
            counts = {}
            for s in ish.tolist():
                counts[s] = counts.get(s, 0) + 1
            best = None
            for s in range(max(1, len(h) - size + 1)):
                sh, w = D.weighted_shingles(h[s : s + size], length[s : s + size])
                d2 = (D.simhash(sh, w) ^ fp).bit_count() if len(sh) else 99
                if d2 <= D.RADIUS:
                    sim = D.similarity(sh, w, counts, dict(zip(ish.tolist(), iw.tolist())))
                    if sim >= D.MIN_SIMILARITY and (best is None or (-sim, s) < (-best[3], best[0])):
                        best = (s, min(size, len(h) - s), d2, sim)
            if best:
                out[d, i] = best
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(i, text(rng, rng.choice((1, 2, 3, 12, 20, 33)))) for i in range(12)]
    docs = [(d, text(rng, rng.randint(1, 120))) for d in range(30)]
    for d in range(30, 50):
        q = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            q[rng.randrange(len(q))] = rng.choice(WORDS)
        docs.append((d, text(rng, rng.randint(0, 40)) + " " + ", ".join(q).upper() + "! " + text(rng, rng.randint(0, 40))))
    docs.append((50, " ".join(items[11][1].split()[:-1])))
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.distance, r.similarity) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)
    assert len(got) > 10


def test_repetitive_texts_equal_brute_force(spark):
    rng = random.Random(21)
    few = ["ba", "bo", "dus"]
    some = lambda n: " ".join(rng.choice(few) for _ in range(n))
    items = [(i, some(rng.choice((1, 2, 3, 5, 9, 14)))) for i in range(12)] + [(12, "ba " * 8)]
    docs = [(d, some(rng.randint(1, 60))) for d in range(40)] + [(40, "ba " * 50), (41, "ba")]
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.distance, r.similarity) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and len(got) > 100


def test_several_passes_give_the_same(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(D.contaminated(docs, bench).collect())
    monkeypatch.setattr(D, "PASS_CHARS", 3000)
    assert sorted(D.contaminated(docs, bench).collect()) == one and one


def test_edge_rows(spark):
    rng = random.Random(9)
    q = text(rng, 20)
    long = text(rng, 50_000) + " " + q
    docs = spark.createDataFrame([(1, None, 0), (None, q, 0), (2, "", 1), (3, q, 1), (3, q, 1), (4, long, 1), (5, "...", 1)], "doc_id long, text string, item_id int").withColumnRenamed("item_id", "similarity").selectExpr("*", "'c' as gone", "'c' as __gone", "1 as n_words")
    bench = spark.createDataFrame([(1, q), (1, q), (2, None), (3, ""), (None, q)], "item_id long, text string")
    got = D.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in got) == [(3, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0)]
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5]
    assert D.contaminated(docs.limit(0), bench).collect() == []
    assert D.contaminated(docs, bench.limit(0)).collect() == []
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 7


def test_finds_all_that_are_similar_enough(spark):
    rng = random.Random(17)
    items = [(i, text(rng, rng.randint(15, 59))) for i in range(40)]
    docs = []
    for d in range(120):
        q = rng.choice(items)[1].split()
        for at in rng.sample(range(len(q)), d % 5):
            q[at] = rng.choice(WORDS)
        docs.append((d, text(rng, rng.randint(0, 30)) + " " + " ".join(q) + " " + text(rng, rng.randint(0, 30))))
    want = {}
    for d, t in docs:
        h, length = split(t)
        for i, q in items:
            sh, w = D.weighted_shingles(*split(q))
            counts = {x: sh.tolist().count(x) for x in sh.tolist()}
            n = len(q.split())
            sims = [D.similarity(*D.weighted_shingles(h[s : s + n], length[s : s + n]), counts, dict(zip(sh.tolist(), w.tolist()))) for s in range(max(1, len(h) - n + 1))]
            if max(sims) >= D.MIN_SIMILARITY:
                want[d, i] = max(sims)
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
    assert sum(s < 0.75 for s in want.values()) >= 10
