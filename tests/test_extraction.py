import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph import model as M
from loomgraph.operators import annotate, build_files, code, commits, documents
from loomgraph.sources import files, git, rdf
from loomgraph.streaming import ingest

PY = '''import os, json as j
from a.b import c

X: int = 1

class Base:
    pass

@deco
class Foo(Base):
    """Doc."""
    size: float = 2.0

    def bar(self, a: int, *rest) -> str:
        y = a  # note
        if a and y:
            helper(y)
        return self.size

def helper(z):
    return X

def test_helper():
    helper(1)
'''
JAVA = "import java.util.List;\npublic class A extends B implements C, D {\n  private int count = 0;\n  /* block\n  note */\n  public String name(int x) { return \"\"; } // tail\n}\ninterface C {}\n"


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("r", "m.py", "m.py", ".py", PY), ("r", "A.java", "A.java", ".java", JAVA), ("r", "bad.py", "bad.py", ".py", "def ("), ("r", "n.py", "n.py", ".py", None)]
    return spark.createDataFrame(rows, "repository string, path string, filename string, extension string, text string")


@pytest.fixture(scope="module")
def found(sources):
    return code.with_metrics(code.constructs(sources)).cache()


def test_python_constructs(found):
    py = {(r.kind, r.name, r.parent): r for r in found.where("path = 'm.py'").collect()}
    bar = py["function", "bar", "Foo"]
    assert bar["items"] == ["self", "a", "rest"] and bar.type == "str" and (bar.start_line, bar.end_line) == (14, 18) and bar.canonical_name == "Foo.bar" and bar.lines == 5
    assert py["class", "Foo", None]["items"] == ["Base"] and ("field", "size", "Foo") in py and ("variable", "y", "bar") in py and ("variable", "X", None) in py
    assert ("parameter", "a", "bar") in py and ("call", "helper", "bar") in py and ("decorator", "deco", "Foo") in py and py["import", "json", None]["items"] == ["j"]
    assert sum(k[:2] == ("function", "bar") for k in py) == 1
    assert found.where("path in ('bad.py', 'n.py')").count() == 0


def test_java_constructs(found):
    java = {(r.kind, r.name): r for r in found.where("path = 'A.java'").collect()}
    a = java["class", "A"]
    assert a.type == "B" and a["items"] == ["C", "D"] and a.start_line == 2 and a.access == "public"
    assert java["function", "name"].type == "String" and java["variable", "count"].type == "int" and ("import", "java.util.List") in java and ("interface", "C") in java


BODIES = """class A {
  // } not the end
  int f(int x) {
    if (x > 0) { return '}'; }
    return x;
  }
}
class B {
  int f(int x) {
    return x;
  }
}
"""


def test_bodies_and_lines():
    rows = {(k, n, p): (a, b, raw) for k, n, p, a, b, raw, _, _ in code.pattern_constructs(BODIES, "java")}
    assert rows["class", "A", None][:2] == (1, 7) and rows["function", "f", "A"][:2] == (3, 6) and rows["function", "f", "B"][:2] == (9, 11)
    assert rows["function", "f", "A"][2].endswith("return x;\n  }")
    see = lambda text, family: [(k, n, p, a, b) for k, n, p, a, b, *_ in code.pattern_constructs(text, family)]
    assert see("class A\n  def f(x)\n    if x\n      1\n    end\n  end\nend\n", "ruby") == [("class", "A", None, 1, 7), ("function", "f", "A", 2, 6)]
    assert see("f() {\n  echo '}' # }\n}\nX=1\n. lib.sh\n", "bash") == [("function", "f", None, 1, 3), ("variable", "X", None, 4, 4), ("import", "lib.sh", None, 5, 5)]
    assert see(".a { color: red }\n@mixin m($x) {\n}\n$w: 1;\n@use 'z';\n", "css") == [("class", "a", None, 1, 1), ("function", "m", None, 2, 3), ("variable", "$w", None, 4, 4), ("import", "z", None, 5, 5)]
    assert see("protocol P {\n  func g() -> Int\n}\nstruct S {\n}\n", "swift") == [("interface", "P", None, 1, 3), ("function", "g", "P", 2, 2), ("struct", "S", None, 4, 5)]
    assert see("object O {\n  def f(x: Int): Int = {\n    x\n  }\n}\n", "scala") == [("module", "O", None, 1, 5), ("function", "f", "O", 2, 4)]
    assert see("local x = require('m')\nfunction f(a)\n  return a\nend\n", "lua") == [("variable", "x", None, 1, 1), ("import", "m", None, 1, 1), ("function", "f", None, 2, 4)]
    assert see('<script src="a.js"></script>\n<p id="top">', "html") == [("import", "a.js", None, 1, 1), ("variable", "top", None, 2, 2)]
    assert see("interface I {\n  int f(int x);\n}", "java")[0][:5] == ("interface", "I", None, 1, 3)
    assert see("class Open {\n  void f() {\n", "java") == [("class", "Open", None, 1, 2), ("function", "f", "Open", 2, 2)]


def test_equal_comments_keep_apart(spark):
    text = "/* a */ x\n/* a\nb */\ny /* a */\n"
    got = documents.comments(spark.createDataFrame([("r", "a.js", ".js", text)], "repository string, path string, extension string, text string"))
    assert sorted((r.raw, r.start_line, r.end_line) for r in got.collect()) == [("a", 1, 1), ("a", 4, 4), ("a\nb", 2, 3)]


def test_relations(found):
    short = lambda df, p: {(r.s.split("/id/")[1], r.o.split("/id/")[1]) for r in df.where(F.col("p") == M.KG + p).collect()}
    i = code.inheritance(found)
    assert ("r/m.py/class/Foo", "r/m.py/class/Base") in short(i, "extendsType") and ("r/A.java/class/A", "external/B") in short(i, "extendsType") and ("r/A.java/class/A", "r/A.java/interface/C") in short(i, "implementsInterface")
    assert short(code.calls(found), "callsFunction") == {("r/m.py/function/bar", "r/m.py/function/helper"), ("r/m.py/function/test_helper", "r/m.py/function/helper")}
    assert ("r/m.py/call/helper", "r/m.py/var/y") in short(code.declaration_usage(found), "usesDeclaration")
    assert short(code.tests(found), "tests") == {("r/m.py/function/test_helper", "r/m.py/function/helper")}
    assert ("r/m.py/function/helper", "r/m.py/var/X") in short(code.manipulations(found), "manipulates")
    assert ("r/m.py", "module/a.b") in short(code.module_imports(found), "imports")
    styled = code.with_metrics(code.constructs(found.sparkSession.createDataFrame([("r", "s.js", ".js", "class Theme {}\nfunction paint() {\n  return new Theme();\n}\nfunction other() {}\n")], "repository string, path string, extension string, text string")))
    assert short(code.stylings(styled), "styles") == {("r/s.js/function/paint", "r/s.js/class/Theme")}
    types = {(r.construct, r.type, r.context, r.primitive) for r in code.type_relations(found).collect()}
    assert {("X", "int", "variable_declaration", True), ("bar.a", "int", "function_parameter", True), ("bar", "str", "function_return", True), ("Foo.size", "float", "class_field", True)} <= types
    access = {(r.function, r.attribute, r.context) for r in code.access_relations(found).collect()}
    assert {("bar", "size", "field_access"), ("bar", "y", "variable_access")} <= access


def test_construct_triples(found):
    t = code.construct_triples(found)
    bar = {r.p.split("#")[1]: r.o for r in t.where(F.col("s").endswith("/function/bar")).collect()}
    assert bar["hasCyclomaticComplexity"] != "1" and bar["isCodePartOf"].endswith("/r/m.py") and bar["startsAtLine"] == "14" and "isStatic" not in bar
    assert t.where("o is null").count() == 0


def test_comments(sources):
    got = {(r.path, r.raw, r.start_line, r.end_line) for r in documents.comments(sources).collect()}
    assert {("m.py", "note", 15, 15), ("m.py", "Doc.", 11, 11), ("A.java", "tail", 6, 6), ("A.java", "block\n  note", 4, 5)} <= got
    assert documents.comment_triples(documents.comments(sources)).count() > 10


MD = "# One\n\npara one\nmore\n\n## Two\n- a\n- b\n  1. c\n\n```py\ncode\n```\n> quote\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\nThree\n=====\n***\nlast"


def test_markdown(spark):
    e = documents.markdown(spark.createDataFrame([("d", MD), ("e", ""), ("f", None)], "id string, t string"), "id", "t")
    by = {r.position: r for r in e.where("doc = 'd'").collect()}
    kinds = [by[i].kind for i in sorted(by)]
    assert kinds == ["document", "heading", "paragraph", "heading", "bullet_list", "list_item", "list_item", "ordered_list", "list_item", "code", "quote", "table", "heading", "rule", "paragraph"]
    assert by[3].level == 2 and by[by[3].parent].text == "One" and by[2].text == "para one\nmore" and by[by[8].parent].parent == 6 and by[12].level == 1 and by[12].parent == 0
    assert [r.kind for r in e.where("doc = 'e'").collect()] == ["document"] and e.where("doc = 'f'").count() == 0
    assert documents.markdown_triples(e).where(F.col("p") == M.KG + "hasHeadingLevel").count() == 3


def test_document_kind(spark):
    df = spark.createDataFrame([("docs/README.md",), ("CONTRIBUTING.md",), ("src/x.py",)], "p string")
    assert [r[0] for r in df.select(documents.document_kind(F.col("p"))).collect()] == ["Readme", "ContributionGuideline", None]


def test_dependencies(spark):
    rows = [
        ("r", "package.json", json.dumps({"dependencies": dict(foo="1.0.0"), "devDependencies": dict(bar="2.0.0")})), ("r", "x/composer.json", '{"require": {"php": ">=8"}}'), ("r", "requirements.txt", "# c\na==1\nb>=2,<3\nc<=4\nd~=5\n\ne"), ("r", "Gemfile", 'gem "rails", "7.0"\ngem "pg"\nsource "x"'), ("r", "go.mod", "module m\nrequire a.b/c v1.2\n"),
        ("r", "Cargo.toml", '[dependencies]\nserde = "1"\n[dependencies.tokio]\n[dev-dependencies.rand]'), ("r", "broken/package.json", "{"), ("r", "other.txt", "a==1"), ("s", "package.json", '{"dependencies": {"foo": "9"}}'),
    ]
    df = spark.createDataFrame([(a, b, b.split("/")[-1], t) for a, b, t in rows], "repository string, path string, filename string, text string")
    got = {}
    for r in build_files.dependencies(df).orderBy("path", "position").collect():
        got.setdefault((r.repository, r.path), []).append((r.name, r.version))
    assert got == {
        ("r", "package.json"): [("foo", "1.0.0"), ("bar", "2.0.0")], ("r", "x/composer.json"): [("php", ">=8")], ("r", "requirements.txt"): [("a", "1"), ("b", ">=2,<3"), ("c", "<=4"), ("d", ""), ("e", "")], ("r", "Gemfile"): [("rails", "7.0"), ("pg", "")], ("r", "go.mod"): [("a.b/c", "v1.2")], ("r", "Cargo.toml"): [("tokio", ""), ("rand", "")], ("s", "package.json"): [("foo", "9")],
    }
    t = build_files.dependency_triples(build_files.dependencies(df))
    assert t.where(F.col("p") == M.KG + "specifiesDependency").count() == 14


def test_frameworks(spark):
    df = spark.createDataFrame([("r", "a.py", ".py", "import flask\nfrom django.db import x"), ("r", "b.java", ".java", "import org.springframework.X;\nimport org.junit.Test;"), ("r", "c.js", ".js", "const r = require('react')"), ("r", "d.cs", ".cs", "using Moq;"), ("r", "e.py", ".py", None)], "repository string, path string, extension string, text string")
    got = {(r.path, r.name) for r in build_files.frameworks(df).collect()}
    assert got == {("a.py", "flask"), ("a.py", "django"), ("b.java", "spring"), ("b.java", "junit"), ("c.js", "react"), ("d.cs", "moq")}
    assert build_files.framework_triples(build_files.frameworks(df)).count() > 0


def test_commit_triples(spark):
    rows = [("repo1", "abc123", "Fix #42 now", 0, "ALICE  doe", ["file1.py"], None), ("repo1", "def456", "More", 1, "Alice Doe", [], None), ("repo1", "eee", None, None, " ", None, None)]
    c = commits.with_references(spark.createDataFrame(rows, commits.COMMIT))
    assert [r.contributor for r in commits.contributors(c).collect()] == ["Alice Doe"]
    t = commits.triples(c)
    n = lambda p, o: t.where((F.col("p") == p) & (F.col("o") == M.KG + o)).count()
    assert (n(M.TYPE, "Commit"), n(M.TYPE, "Issue"), n(M.TYPE, "Contributor"), n(M.TYPE, "FileModification"), n(M.TYPE, "Repository")) == (3, 1, 1, 1, 1)
    assert t.where(F.col("p") == M.KG + "fixesIssue").count() == 1 and t.where(F.col("o_ts").isNotNull()).count() == 2


def test_git_log(spark, tmp_path):
    repo = tmp_path / "one"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann B", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.txt").write_text("x")
    run("add", "."), run("commit", "-qm", "First #7")
    (tmp_path / "none").mkdir()
    got = git.read_commits(spark, str(tmp_path)).collect()
    assert [(r.repo_name, r.commit_message, r.commit_author, r.modified_files, r.issue_references) for r in got] == [("one", "First #7", "Ann B", ["a.txt"], ["7"])]


def test_file_walk(spark, tmp_path):
    for p, t in {"r1/src/a.py": b"x=1\n", "r1/node_modules/z.js": b"no", "r1/README.md": b"# \xff\xfehi", "r2/i.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x05\0\0\0\x07", "top.txt": b"t"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t)
    f = files.read_files(spark, str(tmp_path))
    by = {(r.repository, r.path): r for r in f.collect()}
    assert set(by) == {("r1", "src/a.py"), ("r1", "README.md"), ("r2", "i.png")} and by["r1", "src/a.py"].extension == ".py" and by["r1", "src/a.py"].size_bytes == 4
    assert files.file_count(f).first().n == 3 and files.repositories(f).count() == 2 and files.supported(f, [".PY"]).count() == 1
    assert f.where("extension = '.md'").select(files.as_text(F.col("content"))).first()[0] == "# hi"
    assert tuple(f.where("extension = '.png'").select(files.image_size(F.col("content")).alias("i")).first().i) == ("PNG", 5, 7)
    t = files.triples(files.classified(f))
    assert {r.o.split("#")[1] for r in t.where(F.col("p") == M.TYPE).collect()} == {"Repository", "SourceFile", "DocumentationFile", "ImageFile"}
    assert t.where(F.col("p") == M.KG + "modified").where("o_ts is not null").count() == 3


def some_triples(spark):
    raw = [("http://a", "http://p", "http://o", "iri", None), ("http://a", "http://q", 'say "hi"\n\\x', "lit", "string"), ("http://b", "http://n", "5", "lit", "integer")]
    return M.typed(spark.createDataFrame(raw, "s string, p string, o string, o_kind string, o_type string"))


def test_round_trips(spark, tmp_path):
    t = some_triples(spark)
    want = sorted(map(str, t.collect()))
    rdf.write_ntriples(t, str(tmp_path / "nt"))
    assert sorted(map(str, rdf.read_ntriples(spark, str(tmp_path / "nt")).collect())) == want
    rdf.write_store(t, str(tmp_path / "store"))
    assert sorted(map(str, rdf.read_store(spark, str(tmp_path / "store")).collect())) == want
    rdf.write_csv(t, str(tmp_path / "csv"))
    assert sorted(r.Object for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"', multiLine=True).collect()) == sorted(r.o for r in t.collect())
    rdf.write_json(t, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert rdf.rdf_xml(t).count() == 3
    rdf.clear_store(spark, str(tmp_path / "store2"))
    assert spark.read.parquet(str(tmp_path / "store2")).count() == 0


def test_turtle(spark, tmp_path):
    (tmp_path / "x.ttl").write_text('@prefix ex: <http://e/> .\n# c\nex:a a ex:T ; ex:p "v \\"q\\"", "w"@en ;\n  ex:n 5 .\n<http://b> ex:d "2020-01-01T00:00:00"^^xsd:dateTime .\n')
    got = sorted((r.s, r.p, r.o, r.o_type) for r in rdf.read_turtle(spark, str(tmp_path / "x.ttl")).collect())
    assert got == [("http://b", "http://e/d", "2020-01-01T00:00:00", "dateTime"), ("http://e/a", "http://e/n", "5", "integer"), ("http://e/a", "http://e/p", 'v "q"', "string"), ("http://e/a", "http://e/p", "w", "string"), ("http://e/a", M.TYPE, "http://e/T", None)]


OWL = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o">
<owl:Class rdf:about="http://x#Bar"><rdfs:subClassOf rdf:resource="http://x#Foo"/><rdfs:label xml:lang="en">Bar</rdfs:label></owl:Class>
<owl:Class rdf:about="http://x#Foo"><rdfs:label>Foo</rdfs:label></owl:Class>
<owl:ObjectProperty rdf:about="http://x#hasValue"><rdfs:domain rdf:resource="http://x#Foo"/><owl:inverseOf rdf:resource="http://x#isValueOf"/></owl:ObjectProperty>
<owl:DatatypeProperty rdf:about="http://x#hasData"><rdfs:label>data</rdfs:label></owl:DatatypeProperty></rdf:RDF>"""


def test_ontology(spark, tmp_path):
    (tmp_path / "o.owl").write_text(OWL)
    t = rdf.read_ontology(spark, str(tmp_path / "o.owl"))
    has = lambda s, p, o: t.where((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)).count() == 1
    assert has("http://x#Bar", M.SUBCLASS, "http://x#Foo") and has("http://x#Bar", M.LABEL, "Bar") and has("http://x#hasValue", M.INVERSE, "http://x#isValueOf") and has("http://x#Foo", M.LABEL, "Foo")
    assert {r.kind: r.names for r in rdf.catalogue(t).collect()} == {"classes": ["Bar", "Foo"], "object_properties": ["hasValue"], "data_properties": ["hasData"]}


def test_annotation(spark):
    raw = [("i1", M.TYPE, M.KG + "F", "iri"), ("i1", M.LABEL, "load <x>", "lit"), ("i1", M.KG + "hasSourceCodeSnippet", "def load(): pass", "lit"), ("i2", M.TYPE, M.KG + "G", "iri"), ("i2", M.LABEL, "class thing", "lit"), ("i1", M.KG + "uses", "i2", "iri")]
    t = M.typed(spark.createDataFrame([(*r, None) for r in raw], "s string, p string, o string, o_kind string, o_type string"))
    notes = {r.s: r.o for r in annotate.annotated(t, {M.KG + "F": "{label} is here and {{specific_function}} for {missing}nobody"}, "{label}, a {class_name}, to {specific_purpose}").collect()}
    assert notes["i1"] == "load &lt;x&gt; is here and implements a specific operation for nobody."
    assert notes["i2"] == "class thing, a G, to define object blueprints and data structures."
    assert [r.sentence for r in annotate.relation_sentences(t).collect()] == ["load <x> uses class thing"]
    assert annotate.instances(t, {M.KG + "F": ""}).count() == 1
    links = annotate.linked(spark.createDataFrame([(1, "See the Class Thing, please")], "id long, note string"), spark.createDataFrame([("i2", "class thing"), ("i3", "thing else")], "s string, label string"))
    assert [(r.label, r.target) for r in links.collect()] == [("class thing", "i2")]
    s = spark.createDataFrame([('def f():\n  """Says hi."""',), ("x = 1  # why",), ("\n  y = 2",), ("",)], "x string")
    assert [r[0] for r in s.select(annotate.snippet_summary(F.col("x"))).collect()] == ["Says hi.", "why", "y = 2", ""]


def test_streams(spark, tmp_path, sf):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.txt").write_text("<http://a> <http://p> <http://o> .\n<http://a> <http://p> <http://o> .\nnoise\n")
    q = ingest.write_store(ingest.read_triples(spark, str(src)).drop("arrived"), str(out), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 1
    events = spark.read.parquet(f"{sf}/events.parquet")
    w = ingest.windowed_counts(events, "ts", "event_type", "1 day")
    assert w.agg(F.sum("n")).first()[0] == events.count()
    s = ingest.sessions(events, "ts", "user_id")
    assert s.agg(F.sum("n")).first()[0] == events.count()
    (tmp_path / "p").mkdir()
    spark.createDataFrame([("j", "scan", 10), ("j", "write", 60), ("k", "scan", 5), ("j", "scan", 20)], "job string, stage string, percent int").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "p"))
    stream = ingest.progress(spark.readStream.schema("job string, stage string, percent int").parquet(str(tmp_path / "p")))
    q = stream.writeStream.format("memory").queryName("progress").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.job, r.stage, r.percent) for r in spark.sql("select * from progress").collect()} == {("j", "write", 60), ("k", "scan", 5)}
