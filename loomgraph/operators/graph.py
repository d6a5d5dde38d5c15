"""Graph views: degrees, density, filters, clusters, layouts, centrality, exchange formats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.paths import cut


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, in_degree, out_degree, degree) of each node of edges(src, dst), or of nodes(id), where those without edges have 0."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    out = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    if nodes is not None:
        out = nodes.select("id").distinct().join(out, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def node_size(degree: Column, extra: int = 0) -> Column:
    return F.greatest(F.lit(5), F.least(F.lit(20), 2 * degree + extra))


def statistics(nodes: DataFrame, edges: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: nodes, edges, clusters, mean degree, and density, which is 0 for at most one node."""
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct(cluster).alias("clusters"))
    both = n.crossJoin(edges.agg(F.count("*").alias("edges")))
    pairs = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    return both.select("nodes", "edges", "clusters", F.round(F.when(F.col("nodes") > 0, 2.0 * F.col("edges") / F.col("nodes")).otherwise(0.0), 6).alias("mean_degree"), F.round(F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / pairs).otherwise(0.0), 9).alias("density"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in nodes(id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def clusters(nodes: DataFrame, by: str, color: str | None = None) -> DataFrame:
    """(cluster, size, members[, color]): members in order; the smallest color."""
    aggs = [F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("members")]
    if color:
        aggs.append(F.min(color).alias("color"))
    return nodes.groupBy(F.col(by).alias("cluster")).agg(*aggs)


def filtered(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, in_clusters: list[str] | None = None, least_centrality: float | None = None, search: str | None = None, most: int | None = None, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes that pass every given filter, the most central of them, and the edges among them."""
    if types:
        nodes = nodes.where(F.col("type").isin(*types))
    if in_clusters:
        nodes = nodes.where(F.col("cluster").isin(*in_clusters))
    if least_centrality is not None:
        nodes = nodes.where(F.col("centrality") >= least_centrality)
    if search:
        nodes = nodes.where(F.lower("name").contains(search.lower()))
    if most is not None:
        nodes = nodes.orderBy(F.desc("centrality"), "id").limit(most)
    edges = induced(edges, nodes)
    if edge_types:
        edges = edges.where(F.col("type").isin(*edge_types))
    return nodes, edges


_KINDS = [(("repository",), "repository", 20), (("file", "sourcefile"), "file", 12), (("function", "functiondefinition"), "function", 8), (("class", "classdefinition"), "class", 10)]
_EDGE_KINDS = [(("invokes", "callsFunction"), "calls", 0.8), (("extendsType",), "extends", 0.9), (("implementsInterface",), "implements", 0.9), (("hasFile", "belongsToRepository"), "contains", 1.0)]


def node_kind(local: Column) -> Column:
    """Struct (kind, size) by the local name of a class; concept, 10 for others."""
    low = F.lower(local)
    out = None
    for names, kind, size in _KINDS:
        x = F.struct(F.lit(kind).alias("kind"), F.lit(size).alias("size"))
        out = F.when(low.isin(*names), x) if out is None else out.when(low.isin(*names), x)
    return out.otherwise(F.struct(F.lit("concept").alias("kind"), F.lit(10).alias("size")))


def edge_kind(local: Column) -> Column:
    """Struct (kind, weight) by the local name of a predicate; depends_on, 0.5 for others."""
    out = None
    for names, kind, weight in _EDGE_KINDS:
        x = F.struct(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
        out = F.when(local.isin(*names), x) if out is None else out.when(local.isin(*names), x)
    return out.otherwise(F.struct(F.lit("depends_on").alias("kind"), F.lit(0.5).alias("weight")))


def _ranked(nodes: DataFrame, *by: str) -> DataFrame:
    """Position from 0 among nodes of the same by, or among all: a layout is of what fits a screen."""
    w = Window.partitionBy(*by).orderBy("id")
    return nodes.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))


def grid_layout(nodes: DataFrame, spacing: float = 100.0) -> DataFrame:
    side = F.ceil(F.sqrt("__n"))
    return _ranked(nodes).select("id", ((F.col("__i") % side) * spacing).alias("x"), (F.floor(F.col("__i") / side) * spacing).alias("y"))


def circular_layout(nodes: DataFrame, radius: float = 300.0) -> DataFrame:
    angle = F.col("__i") * (2 * math.pi) / F.col("__n")
    return _ranked(nodes).select("id", F.round(radius * F.cos(angle), 6).alias("x"), F.round(radius * F.sin(angle), 6).alias("y"))


def hierarchical_layout(nodes: DataFrame, level: str, spacing: float = 100.0, height: float = 150.0) -> DataFrame:
    """Levels one below the other, each centred."""
    return _ranked(nodes, level).select("id", ((F.col("__i") - (F.col("__n") - 1) / 2) * spacing).alias("x"), (F.col(level) * height).alias("y"))


def cluster_layout(nodes: DataFrame, cluster: str, radius: float = 400.0, inner: float = 80.0) -> DataFrame:
    """Clusters on a circle, in order of name, each with its nodes on a circle of its own."""
    names = nodes.select(cluster).distinct()
    placed = names.withColumn("__c", F.row_number().over(Window.orderBy(cluster)) - 1).withColumn("__m", F.count("*").over(Window.partitionBy()))
    a, b = F.col("__c") * (2 * math.pi) / F.col("__m"), F.col("__i") * (2 * math.pi) / F.col("__n")
    return _ranked(nodes, cluster).join(placed, cluster).select("id", F.round(radius * F.cos(a) + inner * F.cos(b), 6).alias("x"), F.round(radius * F.sin(a) + inner * F.sin(b), 6).alias("y"))


def betweenness(edges: DataFrame, pivots: int = 100, directed: bool = False) -> DataFrame:
    """(id, centrality): shares of shortest paths through each node, from pivots nodes of the smallest hash, scaled to all.

    Brandes' algorithm for all pivots at once: a breadth-first wave of joins counts paths, and a wave back adds up
    dependencies level by level. Nodes that no shortest path passes have 0.
    """
    e = edges.select("src", "dst")
    e = cut((e if directed else e.union(e.select("dst", "src"))).where("src <> dst").distinct())
    nodes = cut(e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct())
    n = nodes.count()
    k = min(pivots, n)
    starts = nodes.orderBy(F.xxhash64("id"), "id").limit(k)
    layer = cut(starts.select(F.col("id").alias("pivot"), "id", F.lit(1.0).alias("paths")))
    seen, layers = layer.select("pivot", "id"), [layer]
    while True:
        step = layer.join(e, layer["id"] == e["src"]).select("pivot", F.col("dst").alias("id"), "paths")
        layer = cut(step.join(seen, ["pivot", "id"], "left_anti").groupBy("pivot", "id").agg(F.sum("paths").alias("paths")))
        if layer.isEmpty():
            break
        layers.append(layer)
        seen = cut(seen.union(layer.select("pivot", "id")))
    below = layers[-1].withColumn("dependency", F.lit(0.0))
    parts = []
    for layer in reversed(layers[:-1]):
        up = e.join(below.select("pivot", F.col("id").alias("dst"), F.col("paths").alias("q"), "dependency"), "dst")
        sums = layer.join(up.withColumnRenamed("src", "id"), ["pivot", "id"], "left").groupBy("pivot", "id").agg(F.first("paths").alias("paths"), F.coalesce(F.sum(F.col("paths") / F.col("q") * (1 + F.col("dependency"))), F.lit(0.0)).alias("dependency"))
        below = cut(sums)
        parts.append(below.where("pivot <> id").select("id", "dependency"))
    scale = 1.0 / ((n - 1) * (n - 2)) * (n / k) if n > 2 else 0.0  # each unordered pair counts from both ends
    if not parts:
        return nodes.select("id", F.lit(0.0).alias("centrality"))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    total = every.groupBy("id").agg((F.sum("dependency") * scale).alias("centrality"))
    return nodes.join(total, "id", "left").select("id", F.round(F.coalesce("centrality", F.lit(0.0)), 9).alias("centrality"))


def xml_text(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _document(rows: list[DataFrame], head: str, joints: list[str], tail: str, by: str = "\n") -> DataFrame:
    """One row with a whole document: what each frame's column line has, in order, between fixed parts."""
    out = None
    for r in rows:
        one = r.agg(F.array_join(F.sort_array(F.collect_list("line")), by).alias("part"))
        out = one.select(F.concat(F.lit(head), "part").alias("document")) if out is None else out.crossJoin(one).select(F.concat("document", F.lit(joints.pop(0)), "part").alias("document"))
    return out.select(F.concat("document", F.lit(tail)).alias("document"))


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _document([nodes.select(F.to_json(F.struct("*")).alias("line")), edges.select(F.to_json(F.struct("*")).alias("line"))], '{"nodes":[', ['],"edges":['], "]}", ",")


def to_cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.to_json(F.struct(F.struct("*").alias("data"))).alias("line"))
    m = edges.select(F.to_json(F.struct(F.struct(F.concat_ws("-", "src", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target")).alias("data"))).alias("line"))
    return _document([n, m], '{"elements":{"nodes":[', ['],"edges":['], "]}}", ",")


_GRAPHML = "http://graphml.graphdrawing.org/" + "xmlns"
_XML = '<?xml version="1.0"' + ' encoding="UTF-8"?>\n'


def to_gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('" label="'), xml_text(F.col("name")), F.lit('"/>')).alias("line"))
    m = edges.select(F.concat(F.lit('<edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("dst")), F.lit('"/>')).alias("line"))
    return _document([n, m], _XML + '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>\n', ["\n</nodes><edges>\n"], "\n</edges></graph></gexf>")


def to_graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('"><data key="name">'), xml_text(F.col("name")), F.lit("</data></node>")).alias("line"))
    m = edges.select(F.concat(F.lit('<edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("dst")), F.lit('"/>')).alias("line"))
    head = _XML + f'<graphml xmlns="{_GRAPHML}"><key id="name" for="node" attr.name="name" attr.type="string"/><graph edgedefault="directed">\n'
    return _document([n, m], head, ["\n"], "\n</graph></graphml>")
