"""All pairs: by blocks and chunks, against joins of all with all."""

import random

from pyspark.sql import functions as F

from loomgraph import model as M
from loomgraph.operators import code
from loomgraph.operators import similarity as S
from loomgraph.plans import registry


def test_best_dense_neighbours(spark, monkeypatch):
    """Blocks of 64 rows; equal and opposite vectors, none, zeros, nulls and other lengths among them."""
    monkeypatch.setattr(S, "BLOCK", 64)
    r = random.Random(3)
    rows = [(i, i % 2, [r.choice((-1.0, 0.5, 1.0, 2.0)) for _ in range(5)]) for i in range(400)]
    rows += [(400, 0, [0.0] * 5), (401, 0, None), (402, None, [1.0] * 5), (403, 1, [1.0, None, 0.0, 0.0, 0.0]), (404, 1, [1.0, 2.0]), (405, 1, [-1.0, -2.0]), (406, 7, [1.0] * 5), (407, 0, [float("nan"), 1.0, 1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, grp int, vector array<float>")
    a, b = v.select(F.col("id").alias("i"), "grp", F.col("vector").alias("x")), v.select(F.col("id").alias("j"), "grp", F.col("vector").alias("y"))
    want = S.top_similar(a.join(b, "grp").where("i <> j").select("i", "j", S.dense_cosine(F.col("x"), F.col("y")).alias("score")), 3, float("-inf"))
    one = lambda df: sorted((r.i, r.rank, r.j, str(r.score)) for r in df.collect())
    assert one(S.top_dense(v, 3)) == one(want)


def test_dense_neighbours_meet_in_blocks(spark, sf):
    assert "FlatMapGroupsInArrow" in registry.queries()["cosine_top"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_tests_and_functions(spark, monkeypatch):
    """More functions than a chunk holds; names of one IRI are paired once."""
    monkeypatch.setattr(code, "CHUNK", 3)
    names = [(p, n) for p in "abcdefgh" for n in ("test_x", "x", "testX", "X", "test_other")] + [("a", n) for n in ("test_u__v", "test_u_v", "u_v", "u__v")] + [("b", "u_v")]
    found = spark.createDataFrame([("r", p, "function", n, None) for p, n in [*names, *names[:3]]] + [("s", "a", "function", "x", None)], "repository string, path string, kind string, name string, raw string")
    rows = [tuple(r) for r in code.tests(found).select("s", "p", "o").collect()]
    t, f = [(p, n) for p, n in set(names) if n.startswith("test")], set(names)
    i = lambda p, n: f"{M.INST}r/{p}/function/{n.replace('__', '_')}"
    pairs = {(i(*a), i(*b)) for a in t for b in f if a[1][4:].lstrip("_").lower() == b[1].lower()}
    assert sorted(rows) == sorted([(s, M.KG + "tests", o) for s, o in pairs] + [(o, M.KG + "isTestedBy", s) for s, o in pairs])


def test_pairs_are_not_shuffled(spark, sf):
    """Nothing is exchanged above the join but the few pairs whose IRIs stand for several names."""
    p = registry.queries()["tests_edges"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    top = p.split("Union")[0]
    assert "Union" in p and "Exchange" not in top and "Aggregate" not in top and "Exchange" not in p.split("Union")[1].split("SortMergeJoin")[0]
