"""Longest-processing-time sharding: groups that must stay together, largest first, go to the least loaded shard.

Only sizes decide where a group goes, so the heap need not see the groups: it is driven by the histogram of group sizes,
whose length is bounded by the largest size and by the root of twice the total, not by the number of groups. A run of
equal sizes that is long against the number of shards is dealt at once, by finding the level to which it fills them,
which is what popping and pushing one by one comes to.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.state import cut, sized, table

SHARDS = 64
BROADCAST_ROWS = 200_000


def deal(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """For (size, count) by falling size: (size, shards that get some, how many groups it and those before it got)."""
    load = np.zeros(shards, dtype=object)
    out = []
    for size, count in sizes:
        if count <= 4 * shards:
            heap = [(x, i) for i, x in enumerate(load)]
            heapq.heapify(heap)
            got = np.zeros(shards, dtype=object)
            for _ in range(count):
                x, i = heap[0]
                heapq.heapreplace(heap, (x + size, i))
                got[i] += 1
        else:
            given = lambda level: np.array([max(0, -(-(level - x) // size)) for x in load], dtype=object)
            lo, hi = int(min(load)), int(max(load)) + size * count
            while lo < hi:  # the highest level below which no more than count groups fit
                level = (lo + hi + 1) // 2
                lo, hi = (level, hi) if given(level).sum() <= count else (lo, level - 1)
            got = given(lo)
            for i in sorted(range(shards), key=lambda i: (load[i] + got[i] * size, i))[: count - int(got.sum())]:
                got[i] += 1
        load = load + got * size
        used = [i for i in range(shards) if got[i]]
        out.append((size, used, np.cumsum([int(got[i]) for i in used]).tolist()))
    return out


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(id, shard) from (id, group, size): all rows of a group go to one shard.

    A row weighs its size, at least 1, as does one whose size is null; groups are dealt by falling weight to the shard
    of the smallest load and, of equal loads, of the smallest number. Of groups of equal weight, which are
    interchangeable, those of smaller key get the smaller of the shards dealt to them. A null group is a group. Rows may
    repeat, each counting; ids may be null. An empty table gives no rows; with fewer groups than shards some stay empty.
    """
    spark = rows.sparkSession
    weighed = rows.select("id", F.coalesce("group", F.lit(b"")).alias("group"), F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(1)), F.lit(1)).alias("size"))
    groups = cut(weighed.groupBy("group").agg(F.sum("size").alias("size")))
    histogram = [(r[0], r[1]) for r in groups.groupBy("size").count().orderBy(F.desc("size")).collect()]
    plan = spark.createDataFrame(deal(histogram, shards), "size long, shards array<int>, upto array<long>")
    rank = F.row_number().over(Window.partitionBy("size").orderBy("group"))
    placed = groups.withColumn("rank", rank).join(sized(plan, len(histogram), BROADCAST_ROWS), "size")
    placed = placed.select("group", F.expr("element_at(shards, 1 + size(filter(upto, u -> u < rank)))").alias("shard"))
    return weighed.join(placed, "group").select("id", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard): documents of equal text stay together; a document weighs its characters, at least 1.

    Null texts are one group. Other columns are not looked at. See assign() for the rest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text_col)).alias("group"), F.length(text_col).alias("size"))
    return assign(rows, shards).select(F.col("id").alias("doc_id"), "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


ORACLE = f"""
with recursive groups as (
  select coalesce(md5(text), '') as g, sum(greatest(coalesce(length(text), 1), 1))::bigint as size from documents group by 1),
ordered as (select *, row_number() over (order by size desc, g) as i, row_number() over (partition by size order by g) as k from groups),
dealt(i, size, shard, loads) as (
  select 0::bigint, 0::bigint, 0::bigint, list_transform(range({SHARDS}), lambda x: 0::bigint)
  union all
  select o.i, o.size, p.at, list_transform(p.loads, lambda x, j: case when j = p.at then x + o.size else x end)
  from (select i, loads, list_position(loads, list_min(loads))::bigint as at from dealt) p join ordered o on o.i = p.i + 1),
ranked as (select size, shard - 1 as shard, row_number() over (partition by size order by shard) as k from dealt where i > 0)
select d.doc_id, r.shard::int as shard
from documents d join ordered o on o.g = coalesce(md5(d.text), '') join ranked r on r.size = o.size and r.k = o.k
"""
