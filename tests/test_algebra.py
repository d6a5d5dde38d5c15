import pytest
from pyspark.sql import functions as F

from loomgraph import model as M
from loomgraph.operators import aggregates as AG
from loomgraph.operators import algebra as A
from loomgraph.operators import paths as P
from loomgraph.plans import catalogue as C


@pytest.fixture(scope="module")
def triples(spark):
    rows = [
        ("r1", M.TYPE, M.KG + "Repository", "iri", None), ("r1", M.LABEL, "Repo one", "lit", "string"), ("r1", M.KG + "hasFile", "f1", "iri", None), ("r1", M.KG + "hasFile", "f2", "iri", None), ("f1", M.TYPE, M.KG + "SourceFile", "iri", None), ("f2", M.TYPE, M.KG + "File", "iri", None),
        ("f1", M.LABEL, "main.py", "lit", "string"), ("g1", M.TYPE, M.KG + "FunctionDefinition", "iri", None), ("g1", M.KG + "isCodePartOf", "f1", "iri", None), ("g1", M.KG + "hasCyclomaticComplexity", "12", "lit", "nonNegativeInteger"), ("g1", M.NOTE, "computes totals", "lit", "string"), ("g1", M.KG + "self", "g1", "iri", None),
        ("g2", M.TYPE, M.KG + "FunctionDefinition", "iri", None), ("g2", M.KG + "hasCyclomaticComplexity", "not a number", "lit", "integer"), ("r1", M.LABEL, "Repo one", "lit", "string"), (None, "p", "o", "lit", None),
    ]
    return M.typed(spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_type string")).cache()


@pytest.fixture(scope="module")
def closure(spark):
    h = spark.createDataFrame([(M.KG + a, M.KG + b) for a, b in (("SourceFile", "File"), ("File", "Thing"), ("FunctionDefinition", "CodeEntity"), ("Loop1", "Loop2"), ("Loop2", "Loop1"))], "sub string, sup string")
    return P.class_closure(h)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_graph_is_a_set_with_typed_values(triples):
    assert triples.count() == 14
    assert triples.where("o_num = 12").count() == 1 and triples.where("o_num is null and o_type = 'integer'").count() == 1


def test_patterns(triples):
    assert rows(A.match(triples, ("?r", "kg:hasFile", "?f"), ("?f", "rdf:type", "kg:File"))) == [("f2", "r1")] or rows(A.match(triples, ("?r", "kg:hasFile", "?f"), ("?f", "rdf:type", "kg:File")).select("r", "f")) == [("r1", "f2")]
    assert rows(A.pattern(triples, "?x", "kg:self", "?x")) == [("g1",)]
    assert A.pattern(triples, "?s", "kg:hasFile|kg:isCodePartOf", "?o").count() == 3
    assert A.match(triples, ("r1", "kg:hasFile", "f1")).count() == 1
    cross = A.match(triples, ("?a", "rdf:type", "kg:Repository"), ("?b", "rdf:type", "kg:File"))
    assert rows(cross.select("a", "b")) == [("r1", "f2")]


def test_optional_union_minus_exists(triples):
    files = A.match(triples, ("r1", "kg:hasFile", "?f"))
    labelled = A.optional(files, A.match(triples, ("?f", "rdfs:label", "?l")))
    assert rows(labelled.select("f", F.coalesce("l", F.lit("-")))) == [("f1", "main.py"), ("f2", "-")]
    assert rows(A.minus(files, A.match(triples, ("?f", "rdfs:label", "?l")))) == [("f2",)]
    assert rows(A.exists(files, A.match(triples, ("?f", "rdfs:label", "?l")))) == [("f1",)]
    both = A.union(files, A.match(triples, ("?g", "kg:isCodePartOf", "?f")))
    assert both.count() == 3 and both.where("g is null").count() == 2
    assert rows(A.values(files, "f", ["f2"])) == [("f2",)]


def test_construct_delete_upsert(triples, spark):
    made = A.construct(A.match(triples, ("?r", "kg:hasFile", "?f")), ("?f", "kg:in", "?r"), ("?r", "kg:known", "kg:yes"))
    assert rows(made) == [("f1", M.KG + "in", "r1"), ("f2", M.KG + "in", "r1"), ("r1", M.KG + "known", M.KG + "yes")]
    assert A.delete(triples, p="rdf:type").count() == 9 and A.delete(triples).count() == 0
    fresh = spark.createDataFrame([("g1", M.NOTE, "new")], "s string, p string, o string")
    after = A.upsert(triples, fresh)
    assert after.count() == 14 and rows(after.where(F.col("p") == M.NOTE).select("s", "o")) == [("g1", "new")]
    assert A.append(triples, fresh.union(fresh)).count() == 15


def test_regex_guards_unbound(spark):
    df = spark.createDataFrame([("Ab",), (None,)], "x string")
    assert [r[0] for r in df.select(A.regex(F.col("x"), "^a")).collect()] == [True, False]


def test_closure_survives_cycles(spark, closure):
    got = {(r.sub[len(M.KG) :], r.sup[len(M.KG) :], r.depth) for r in closure.collect()}
    assert ("SourceFile", "Thing", 2) in got and ("Loop1", "Loop1", 0) in got and ("Loop1", "Loop2", 1) in got and len(got) == 13
    h = closure.where("depth = 1").select("sub", "sup")
    by_joins = P.class_closure(h, limit=1)
    assert rows(by_joins.select("sub", "sup", "depth")) == rows(closure)
    assert P.superclass_chain(h, "kg:SourceFile") == [M.KG + "SourceFile", M.KG + "File", M.KG + "Thing"]
    assert P.superclass_chain(h, "kg:Loop1") == [M.KG + "Loop1", M.KG + "Loop2"]


def test_transitive_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5)], "src long, dst long")
    assert rows(P.transitive_closure(e).where("src = 2")) == [(2, 1, 2), (2, 2, 0), (2, 3, 1), (2, 4, 2)]
    assert rows(P.transitive_closure(e, reflexive=False).where("src = 2")) == [(2, 1, 2), (2, 2, 3), (2, 3, 1), (2, 4, 2)]
    one = spark.createDataFrame([(1,)], "n long")
    assert rows(P.transitive_closure(e, starts=one, max_depth=1)) == [(1, 1, 0), (1, 2, 1)]
    assert rows(P.neighbourhood(e, one, 1)) == [(1, 0), (2, 1), (3, 1)]
    assert rows(P.sequence(e, e, P.inverse(e)).where("src = 1")) == [(1, 2)]


def test_counts_and_sums(triples, closure):
    assert C.count_of(triples, closure, "kg:File").first().n == 2
    assert C.exact_count(triples, "kg:File").first().n == 1
    assert AG.count_classes(triples, closure, {"files": "kg:File", "code": "kg:CodeEntity", "none": "kg:Issue"}).first() == (2, 2, 0)
    assert C.complexity_summary(triples, closure).first().total == 12
    none = triples.limit(0)
    assert C.complexity_summary(none, closure).first() == (0.0, 0.0)
    assert C.dashboard(none, closure).first().files == 0


def test_search_defaults(triples, closure):
    got = C.search(triples, closure, "total").collect()
    assert [tuple(r) for r in got] == [("g1", "Unknown", "functiondefinition", "Unknown", 0, 0.5)]
    assert C.search(triples, closure, "main", cls="kg:File").count() == 1 and C.search(triples, closure, "main", cls="kg:CodeEntity").count() == 0
    assert C.search(triples, closure, "files", limit=0).count() == 1


def test_profile(triples):
    got = {(r.cls, r.p): (r.n, r.frequency, r.cardinality) for r in AG.class_profile(triples).collect()}
    assert got[M.KG + "Repository", M.KG + "hasFile"] == (1, "100%", "multiple")
    assert got[M.KG + "FunctionDefinition", M.NOTE] == (1, "50%", "single")


def test_numbered(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("v")).repartition(7)
    got = AG.numbered(df, [F.col("v")]).collect()
    assert all(r.v == r.id for r in got) and len(got) == 1000


def test_closure_of_a_deep_hierarchy_is_closed_by_joins(spark):
    chain = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}") for i in range(8)], "sub string, sup string")
    want = sorted(map(tuple, P.class_closure(chain).collect()))
    assert len(want) == 45 and sorted(map(tuple, P.class_closure(chain, 8).collect())) == want == sorted(map(tuple, P.class_closure(chain, 4).collect()))
    dense = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}") for i in range(30)], "sub string, sup string")
    assert P.class_closure(dense, 30).count() == 31 * 32 // 2
    assert P.superclass_chain(chain, "c05") == ["c05", "c06", "c07", "c08"]


def test_large_predicates_are_written_by_several_tasks(spark, tmp_path):
    from loomgraph.sources import rdf

    t = spark.createDataFrame([(f"s{i}", "p", "o") for i in range(100)] + [("s", "q", "o")], "s string, p string, o string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts small ones together
    rdf.write_store(t.selectExpr("*", "'literal' as o_kind", "cast(null as string) as o_type", "cast(null as double) as o_num", "cast(null as timestamp) as o_ts"), f"{tmp_path}/s", 20)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "s" / "p=p").glob("*.parquet"))) > 1 and rdf.read_store(spark, f"{tmp_path}/s").count() == 101
