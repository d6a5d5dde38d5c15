"""Property paths: sequences, alternatives, transitive closures, breadth-first neighbourhoods."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import SUBCLASS, iri


#: A hierarchy's closure of at most so many pairs is broadcast; and the most tasks that spread() makes.
BROADCAST_PAIRS, MOST_TASKS = 20_000, 2_000


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the session's own; in local mode, where it is unset, a new one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut at the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, each: int = 1 << 18) -> DataFrame:
    """df by keys in at least as many tasks as its shuffles have, and a task for each so many bytes that it reads.

    For small rows that start much work each, as a file's text that is parsed: a small table is read in a task or two,
    and what they make of it would stay with them. Also for what a task holds by key, which then doesn't grow with the
    table. An explicit number isn't coalesced.
    """
    session = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism, min(size // each, MOST_TASKS))
    return df.repartition(n, *keys)


def edges(triples: DataFrame, *predicates: str) -> DataFrame:
    """(src, dst) of the given predicates' triples."""
    return triples.where(F.col("p").isin(*(iri(p) for p in predicates))).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def hierarchy(triples: DataFrame) -> DataFrame:
    return edges(triples, SUBCLASS).select(F.col("src").alias("sub"), F.col("dst").alias("sup")).distinct()


def sequence(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """(src, dst) of paths through edges of each step in turn; as many rows as there are paths."""
    out = first
    for step in rest:
        out = out.select("src", F.col("dst").alias("__mid")).join(step.select(F.col("src").alias("__mid"), "dst"), "__mid").select("src", "dst")
    return out


def inverse(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def transitive_closure(e: DataFrame, reflexive: bool = True, starts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): the least number of steps between connected nodes; cycles are no matter.

    Each round extends only what the last one found, and drops what is known by an anti join; every fourth round is cut
    at the checkpoint folder. reflexive adds each node, of starts if that is given, with depth 0.
    """
    e = e.select("src", "dst").where("src is not null and dst is not null").distinct()
    nodes = e.select(F.col("src").alias("n")).union(e.select(F.col("dst").alias("n"))) if starts is None else starts.select(F.col(starts.columns[0]).alias("n"))
    nodes = nodes.where("n is not null").distinct()
    e = cut(e)
    frontier = nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"))
    known = frontier
    found = [frontier.select("src", "dst", F.lit(0).alias("depth"))] if reflexive else []
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("src", F.col("dst").alias("__mid")).join(e.select(F.col("src").alias("__mid"), "dst"), "__mid").select("src", "dst").distinct()
        if not reflexive and depth == 1:
            known = step.limit(0)
        frontier = cut(step.join(known, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
        found.append(frontier.select("src", "dst", F.lit(depth).alias("depth")))
        if depth % 4 == 0:
            known = cut(known)
    out = (found[0] if found else frontier.select("src", "dst", F.lit(1).alias("depth")))
    for f in found[1:]:
        out = out.union(f)
    return out


def class_closure(h: DataFrame, limit: int = 200_000) -> DataFrame:
    """(sub, sup, depth), reflexive and transitive, of a class hierarchy (sub, sup).

    A hierarchy of at most limit edges, whose closure has at most ten times as many pairs, is closed on the driver, as
    hierarchies are small; a larger, deeper or denser one by joins.
    """
    rows = h.select("sub", "sup").distinct().limit(limit + 1).collect()
    spark = h.sparkSession
    by_joins = lambda: transitive_closure(h.select(F.col("sub").alias("src"), F.col("sup").alias("dst"))).select(F.col("src").alias("sub"), F.col("dst").alias("sup"), "depth")
    if len(rows) > limit:
        return by_joins()
    up: dict[str, list[str]] = {}
    for a, b in rows:
        up.setdefault(a, []).append(b)
        up.setdefault(b, [])
    out = []
    for start in sorted(up):
        depth, layer, seen = 0, [start], {start}
        while layer:
            out += [(start, x, depth) for x in layer]
            if len(out) > 10 * max(limit, 1):
                return by_joins()
            layer = sorted({y for x in layer for y in up[x]} - seen)
            seen.update(layer)
            depth += 1
    pairs = spark.createDataFrame(out, "sub string, sup string, depth int")
    return F.broadcast(pairs) if len(out) <= BROADCAST_PAIRS else pairs


def superclass_chain(h: DataFrame, cls: str) -> list[str]:
    """cls and its superclasses to the top, by the smallest parent where there are several; stops at a cycle."""
    out = [iri(cls)]
    while True:  # a look-up for each level, so that the hierarchy isn't collected
        up = h.where(F.col("sub") == out[-1]).agg(F.min("sup")).first()[0]
        if up is None or up in out:
            return out
        out.append(up)


def neighbourhood(e: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth) within that many steps of any start, in either direction; starts have depth 0."""
    both = e.select("src", "dst").union(inverse(e)).where("src <> dst").distinct()
    frontier = starts.select(F.col(starts.columns[0]).alias("node")).distinct()
    found = frontier.select("node", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(found.select("node"), "node", "left_anti"))
        found = found.union(frontier.select("node", F.lit(d).alias("depth")))
    return found
