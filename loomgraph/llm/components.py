"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

The least neighbour of a node is an aggregate that is joined to its edges, not a window: a hub's rows are combined on
the map side and its join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.state import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
    pairs = low.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return pairs.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(u, v), where root is the smallest node that it is connected with.

    Self-loops and rows with a null are ignored; repeated edges count once; roots themselves have no row. Each round is
    cut at the checkpoint folder; the number of rounds grows with the logarithm of the longest chain.
    """
    # each step reads its edges twice, so what they come from is cut first
    e = cut(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    e = cut(_small(e))
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        e = cut(_small(cut(_large(e))))
