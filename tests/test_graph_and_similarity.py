import json
import math
import xml.dom.minidom

from pyspark.sql import functions as F

from loomgraph import model as M
from loomgraph.operators import graph as G
from loomgraph.operators import similarity as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def small(spark):
    nodes = spark.createDataFrame([("a", "A&<b>", "file", "x", 0.9), ("b", "B", "class", "x", 0.5), ("c", 'C"', "file", "y", 0.1), ("d", "D", "file", "y", 0.7)], "id string, name string, type string, cluster string, centrality double")
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "has"), ("a", "c", "calls")], "src string, dst string, type string")
    return nodes, edges


def test_degrees_and_statistics(spark):
    nodes, edges = small(spark)
    assert rows(G.degrees(edges, nodes)) == [("a", 0, 2, 2), ("b", 1, 1, 2), ("c", 2, 0, 2), ("d", 0, 0, 0)]
    s = G.statistics(nodes, edges).first()
    assert (s.nodes, s.edges, s.clusters, s.density) == (4, 3, 2, 0.5)
    assert G.statistics(nodes.limit(1), edges.limit(0)).first().density == 0
    assert spark.range(1).select(G.node_size(F.lit(1)), G.node_size(F.lit(50)), G.node_size(F.lit(4), 5)).first()[0:3] == (5, 20, 13)


def test_filters(spark):
    nodes, edges = small(spark)
    n, e = G.filtered(nodes, edges, types=["file"], most=2)
    assert rows(n.select("id")) == [("a",), ("d",)] and e.count() == 0
    n, e = G.filtered(nodes, edges, least_centrality=0.1, in_clusters=["x", "y"], edge_types=["calls"])
    assert rows(e.select("src", "dst")) == [("a", "b"), ("a", "c")]
    assert rows(G.filtered(nodes, edges, search="b")[0].select("id")) == [("a",), ("b",)]


def test_kinds(spark):
    df = spark.createDataFrame([("SourceFile",), ("ClassDefinition",), ("Other",)], "x string").select(G.node_kind(F.col("x")).alias("k")).select("k.*")
    assert [tuple(r) for r in df.collect()] == [("file", 12), ("class", 10), ("concept", 10)]
    df = spark.createDataFrame([("invokes",), ("extendsType",), ("hasFile",), ("x",)], "x string").select(G.edge_kind(F.col("x")).alias("k")).select("k.*")
    assert [tuple(r) for r in df.collect()] == [("calls", 0.8), ("extends", 0.9), ("contains", 1.0), ("depends_on", 0.5)]


def test_documents_are_well_formed(spark):
    nodes, edges = small(spark)
    assert len(json.loads(G.to_json(nodes, edges).first()[0])["nodes"]) == 4
    assert len(json.loads(G.to_cytoscape(nodes, edges).first()[0])["elements"]["edges"]) == 3
    for f in (G.to_gexf, G.to_graphml):
        d = xml.dom.minidom.parseString(f(nodes, edges).first()[0])
        assert len(d.getElementsByTagName("node")) == 4 and len(d.getElementsByTagName("edge")) == 3
    assert json.loads(G.to_json(nodes.limit(0), edges.limit(0)).first()[0]) == {"nodes": [], "edges": []}


def test_betweenness_of_a_path_and_a_star(spark):
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    got = {r.id: r.centrality for r in G.betweenness(path).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: round(4 / 6, 9), 4: 0.5, 5: 0.0}
    star = spark.createDataFrame([(0, i) for i in range(1, 6)], "src long, dst long")
    got = {r.id: r.centrality for r in G.betweenness(star).collect()}
    assert got[0] == 1.0 and sum(got.values()) == 1.0
    square = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "src long, dst long")
    assert {round(r.centrality, 6) for r in G.betweenness(square).collect()} == {round(1 / 6, 6)}


def features(spark):
    fn, cl = M.KG + "FunctionDefinition", M.KG + "ClassDefinition"
    raw = [("i1", M.TYPE, fn, "iri"), ("i1", M.LABEL, "parse json file", "lit"), ("i1", M.NOTE, "reads a json file quickly", "lit"), ("i2", M.TYPE, fn, "iri"), ("i2", M.LABEL, "parse xml file", "lit"), ("i2", M.NOTE, "reads an xml file slowly", "lit"), ("i3", M.TYPE, cl, "iri"), ("i3", M.LABEL, "user account", "lit"), ("i3", M.NOTE, "holds account data", "lit"), ("i3", M.KG + "hasLanguage", "python", "lit")]
    return S.instance_features(M.typed(spark.createDataFrame([(*r, None) for r in raw], "s string, p string, o string, o_kind string, o_type string")))


def test_features(spark):
    f = {r.s: r for r in features(spark).collect()}
    assert f["i3"].text == "user account holds account data python" and f["i1"].predicates == [M.TYPE]


def test_blend(spark):
    f = features(spark)
    w = S.tfidf(f, "s", "text", min_df=1, max_df=1.0)
    norms = {r.id: r.n for r in w.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()}
    assert all(math.isclose(n, 1) for n in norms.values())
    pairs = {(r.i, r.j): r.score for r in S.blended_pairs(f, w, all_pairs=True).collect()}
    assert pairs["i1", "i2"] > pairs["i1", "i3"] and pairs["i1", "i2"] == pairs["i2", "i1"] and pairs["i1", "i3"] == 0.2
    assert set(S.blended_pairs(f, w).select("i").toPandas().i) == {"i1", "i2"}
    scaled = S.scaled_by_centrality(S.blended_pairs(f, w), spark.createDataFrame([("i1", 1.0)], "id string, centrality double"))
    got = {(r.i, r.j): r.score for r in scaled.collect()}
    assert math.isclose(got["i1", "i2"], 1.5 * pairs["i1", "i2"]) and math.isclose(got["i2", "i1"], pairs["i1", "i2"])


def test_tfidf_of_nothing(spark):
    df = spark.createDataFrame([(1, "the of"), (2, "")], "id long, t string")
    assert S.tfidf(df, "id", "t").collect() == []


def test_top(spark):
    m = [("0", "2", 0.8), ("0", "1", 0.3), ("0", "3", 0.3), ("1", "0", 0.05), ("2", "2", 1.0), ("1", "3", 0.1)]
    got = S.top_similar(spark.createDataFrame(m, "i string, j string, score double"), 2)
    assert rows(got) == [("0", "1", 0.3, 2), ("0", "2", 0.8, 1), ("1", "3", 0.1, 1)]
    assert S.see_also(got).count() == 3


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Zeta alpha zeta the the the beta alpha x1"), (2, None)], "id long, t string")
    assert rows(S.keywords(df, "id", "t", 2).select("word", "n", "rank")) == [("alpha", 2, 2), ("zeta", 2, 1)]
