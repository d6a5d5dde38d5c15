import heapq
import random
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import sharding as S


def loads_by_heap(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    got = Counter()
    for s in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + s, i))
        got[s, i] += 1
    return got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=200), st.integers(1, 5))
def test_dealing_runs_is_popping_one_by_one(sizes, shards):
    got = Counter()
    for size, used, upto in S.deal(sorted(Counter(sizes).items(), reverse=True), shards):
        for i, n in zip(used, [b - a for a, b in zip([0, *upto], upto)]):
            got[size, i] += n
    assert got == loads_by_heap(sizes, shards)


def test_groups_stay_together_and_balance(spark):
    rng = random.Random(1)
    rows = [(i, f"g{rng.randrange(300)}", rng.randint(0, 50)) for i in range(3000)]
    out = S.assign(spark.createDataFrame(rows, "id long, group string, size int"), 8).collect()
    assert len(out) == len(rows)
    shard, weight = {}, Counter()
    group = {i: g for i, g, _ in rows}
    for r in out:
        assert shard.setdefault(group[r.id], r.shard) == r.shard
    sizes = Counter()
    for _, g, s in rows:
        sizes[g] += max(s, 1)
        weight[shard[g]] += max(s, 1)
    want = Counter()
    for (s, i), n in loads_by_heap(sizes.values(), 8).items():
        want[i] += s * n
    assert weight == want


def test_edge_rows(spark):
    rows = [(1, None, 3), (2, None, 3), (None, "a", None), (3, "a", 0), (4, "", 5), (4, "", 5), (5, "x" * 100_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").selectExpr("*", "1 as size", "2 as `group`", "3 as id")
    got = S.shard_documents(df, 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.shard)
    assert len(got) == 7 and by[1] == by[2] and by[3] == by[None] and by[5] == {0} and all(len(s) == 1 for s in by.values())
    assert S.shard_documents(df.limit(0)).collect() == []


def test_oracle_on_the_table(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(c.execute(S.ORACLE).fetchall()) == sorted((r.doc_id, r.shard) for r in S.query(spark, sf).collect())
