"""The fixed catalogue of queries over a knowledge graph of software, each a function of triples and class closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.search import flexible_pattern
from loomgraph.functions.text import language_of, local_name
from loomgraph.model import LABEL, NOTE, OBJECT_PROPERTY, TYPE, iri
from loomgraph.operators import algebra as A
from loomgraph.operators import graph as G
from loomgraph.operators.aggregates import count_classes, percent_of_total
from loomgraph.operators.paths import edges, transitive_closure

#: Names of the counts of each board, and their classes.
DASHBOARD = {
    "repositories": "kg:Repository", "files": "kg:File", "source_files": "kg:SourceFile", "documentation_files": "kg:DocumentationFile", "asset_files": "kg:AssetFile", "entities": "kg:CodeEntity", "functions": "kg:FunctionDefinition",
    "classes": "kg:ClassDefinition", "interfaces": "kg:InterfaceDefinition", "attributes": "kg:AttributeDeclaration", "variables": "kg:VariableDeclaration", "parameters": "kg:Parameter", "documentation": "kg:Documentation", "commits": "kg:Commit", "issues": "kg:Issue", "contributors": "kg:Contributor",
}
CODEBASE = {k: DASHBOARD[k] for k in ("repositories", "files", "source_files", "documentation_files", "asset_files")}
ENTITIES = {k: DASHBOARD[k] for k in ("functions", "classes", "interfaces", "attributes", "variables", "parameters")}
DOCUMENTATION = {"documentation": "kg:Documentation", "readmes": "kg:Readme", "code_comments": "kg:CodeComment", "api_documentation": "kg:APIDocumentation"}
DEVELOPMENT = {k: DASHBOARD[k] for k in ("commits", "issues", "contributors")}
ASSETS = {"images": "kg:ImageFile", "audio": "kg:AudioFile", "video": "kg:VideoFile", "fonts": "kg:FontFile"}
RELATIONSHIPS = ["kg:hasFile", "kg:belongsToRepository", "kg:isCodePartOf", "kg:invokes", "kg:extendsType", "kg:implementsInterface", "kg:hasRepository", "kg:imports", "kg:authoredBy", "kg:modifies", "kg:isAbout", "kg:declares", "kg:hasType", "kg:tests"]
COMPLEXITY = "kg:hasCyclomaticComplexity"


def count_of(triples: DataFrame, closure: DataFrame, cls: str) -> DataFrame:
    """One row: different instances of a class, subclasses included."""
    return A.instances(triples, closure, cls).agg(F.countDistinct("s").alias("n"))


def exact_count(triples: DataFrame, cls: str) -> DataFrame:
    return A.match(triples, ("?s", TYPE, cls)).agg(F.countDistinct("s").alias("n"))


def relationships(triples: DataFrame) -> DataFrame:
    """One row: triples whose predicate is declared an object property."""
    declared = A.match(triples, ("?p", TYPE, OBJECT_PROPERTY)).distinct()
    return triples.join(declared, "p", "left_semi").agg(F.count("*").alias("n"))


def imports(triples: DataFrame) -> DataFrame:
    return A.match(triples, ("?s", "kg:imports", "?o")).agg(F.count("*").alias("n"))


def complexity_summary(triples: DataFrame, closure: DataFrame, cls: str = "kg:FunctionDefinition") -> DataFrame:
    """One row: mean and sum of complexity over instances, each as often as it has a type below the class; 0 for none."""
    rows = A.natural(A.instances(triples, closure, cls), A.match_numeric(triples, COMPLEXITY, "c"))
    return rows.agg(F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("total"))


def language_distribution(triples: DataFrame, digits: int = 2) -> DataFrame:
    """(language, n, percent) of files by extension."""
    files = A.match(triples, ("?file", "kg:hasExtension", "?ext")).distinct()
    n = files.groupBy(language_of(F.col("ext")).alias("language")).agg(F.count("*").alias("n"))
    return percent_of_total(n, "n", digits)


def dashboard(triples: DataFrame, closure: DataFrame) -> DataFrame:
    """All of a dashboard in one row: class counts share one scan and one shuffle."""
    row = count_classes(triples, closure, DASHBOARD)
    for name, df in (("relationships", relationships(triples)), ("imports", imports(triples))):
        row = row.crossJoin(df.withColumnRenamed("n", name))
    c = complexity_summary(triples, closure)
    return row.crossJoin(c.select(F.col("mean").alias("mean_complexity"), F.col("total").alias("total_complexity")))


def organizations(triples: DataFrame) -> DataFrame:
    """(org, label, repositories): with the repositories' names in order; a missing label is the end of the IRI."""
    rows = A.match(triples, ("?org", TYPE, "kg:Organization"), ("?org", "kg:hasRepository", "?repo"))
    rows = A.optional(A.optional(rows, A.match(triples, ("?org", LABEL, "?label"))), A.match(triples, ("?repo", LABEL, "?name")))
    name = lambda label, i: F.coalesce(label, F.substring_index(i, "/", -1))
    return rows.groupBy("org", name(F.col("label"), F.col("org")).alias("label")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(name(F.col("name"), F.col("repo")))), ",").alias("repositories"))


def organization(triples: DataFrame, closure: DataFrame, org: str) -> DataFrame:
    """One row: repositories, files and links from the code of an organization's files to other nodes."""
    repos = A.match(triples, (org, "kg:hasRepository", "?repo")).distinct()
    files = A.natural(repos, A.match(triples, ("?repo", "kg:hasFile", "?s")))
    typed = files.join(A.instances(triples, closure, "kg:File").distinct(), "s", "left_semi")
    code = A.natural(files, A.match(triples, ("?code", "kg:isCodePartOf", "?s")))
    links = code.join(triples.where("o_kind = 'iri'").select(F.col("s").alias("code")), "code")
    one = repos.agg(F.count("*").alias("repositories")).crossJoin(typed.agg(F.countDistinct("s").alias("files")))
    return one.crossJoin(links.agg(F.count("*").alias("relationships")))


def repositories(triples: DataFrame, org: str | None = None) -> DataFrame:
    """(repo, name, updated): with the latest change of any file."""
    rows = A.match(triples, ("?repo", TYPE, "kg:Repository"), ("?repo", LABEL, "?name"))
    if org:
        rows = A.exists(rows, A.match(triples, (org, "kg:hasRepository", "?repo")))
    times = A.match(triples, ("?repo", "kg:hasFile", "?file"), ("?file", "kg:modified", "?time"))
    return A.optional(rows, times.select("repo", "time")).groupBy("repo", "name").agg(F.max("time").alias("updated"))


def repository_rollup(triples: DataFrame) -> DataFrame:
    """(repo, files, entities, mean_complexity, language, contributors, note): what concerns files is one aggregate of one join, the rest one each."""
    repos = A.match(triples, ("?repo", TYPE, "kg:Repository")).distinct()
    files = A.match(triples, ("?repo", "kg:hasFile", "?file"))
    ext = A.match(triples, ("?file", "kg:hasExtension", "?ext")).groupBy("file").agg(F.min("ext").alias("ext"))
    rows = files.join(ext, "file", "left").join(A.match(triples, ("?code", "kg:isCodePartOf", "?file")), "file", "left").join(A.match_numeric(triples, COMPLEXITY, "c", "code"), "code", "left")
    of_files = rows.groupBy("repo").agg(F.countDistinct("file").alias("files"), F.countDistinct("code").alias("entities"), F.round(F.avg("c"), 6).alias("mean_complexity"), F.min("ext").alias("ext"))
    people = A.natural(A.match(triples, ("?commit", "kg:inRepository", "?repo")), A.match(triples, ("?commit", "kg:authoredBy", "?person"))).groupBy("repo").agg(F.countDistinct("person").alias("contributors"))
    notes = A.match(triples, ("?repo", NOTE, "?note")).groupBy("repo").agg(F.min("note").alias("note"))
    out = repos
    for part in (of_files, people, notes):
        out = out.join(part, "repo", "left")
    return out.na.fill(0, ["files", "entities", "contributors"]).na.fill(0.0, ["mean_complexity"]).withColumn("language", language_of(F.col("ext"))).drop("ext")


def search(triples: DataFrame, closure: DataFrame, text: str, limit: int = 50, cls: str | None = None, repository: str | None = None) -> DataFrame:
    """Entities whose label or note a query finds; see search_rows() for the columns."""
    return search_rows(triples, closure, flexible_pattern(text), limit, cls, repository)


def search_rows(triples: DataFrame, closure: DataFrame, pattern: str, limit: int, cls: str | None = None, repository: str | None = None) -> DataFrame:
    """(s, name, kind, repository, line, confidence): the first limit, by subject, of 1 to 200.

    Labels and notes are searched first; one property table of the subjects found stands for the optional parts of the
    pattern. Defaults: name Unknown, kind unknown, line 0, confidence 0.5, repository Unknown.
    """
    found = triples.where(F.col("p").isin(iri(LABEL), iri(NOTE))).where(A.regex(F.col("o"), pattern)).select("s").distinct()
    wide = A.property_table(triples.join(found, "s", "left_semi"), {TYPE: "type", LABEL: "label", NOTE: "note", "kg:belongsToRepository": "repo", "kg:startsAtLine": "line", "kg:hasConfidence": "confidence"})
    hits = wide.where("type is not null").where(A.regex(F.col("label"), pattern) | A.regex(F.col("note"), pattern))
    if cls:
        hits = hits.join(A.instances(triples, closure, cls).distinct(), "s", "left_semi")
    if repository:
        hits = hits.where(F.col("repo") == iri(repository))
    rows = hits.select(
        "s", F.coalesce("label", F.lit("Unknown")).alias("name"), F.coalesce(F.lower(local_name(F.col("type"))), F.lit("unknown")).alias("kind"), F.coalesce(F.substring_index("repo", "/", -1), F.lit("Unknown")).alias("repository"),
        F.coalesce(F.expr("try_cast(line as int)"), F.lit(0)).alias("line"), F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(0.5)).alias("confidence"),
    )
    return rows.orderBy("s").limit(min(max(limit, 1), 200))


def graph_nodes(triples: DataFrame, limit: int | None = 100) -> DataFrame:
    """(id, name, kind, size, cluster): one row an entity, by smallest type; the first limit by id."""
    wide = A.property_table(triples, {TYPE: "type", LABEL: "label", "kg:belongsToRepository": "cluster"}).where("type is not null")
    if limit is not None:
        wide = wide.orderBy("s").limit(limit)
    k = G.node_kind(local_name(F.col("type")))
    return wide.select(F.col("s").alias("id"), F.coalesce("label", local_name(F.col("s"))).alias("name"), k["kind"].alias("kind"), k["size"].alias("size"), F.coalesce("cluster", F.lit("none")).alias("cluster"))


def graph_edges(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, kind, weight) among nodes(id)."""
    links = triples.where((F.col("o_kind") == "iri") & (F.col("p") != TYPE)).select(F.col("s").alias("src"), F.col("o").alias("dst"), "p")
    k = G.edge_kind(local_name(F.col("p")))
    return G.induced(links, nodes).select("src", "dst", k["kind"].alias("kind"), k["weight"].alias("weight")).distinct()


def entity(triples: DataFrame, subject: str) -> DataFrame:
    """(direction, p, other, label): what an entity points at and what points at it, with labels of the others."""
    out = A.match(triples, (subject, "?p", "?other")).select(F.lit("out").alias("direction"), "p", "other")
    back = A.match(triples, ("?other", "?p", subject)).select(F.lit("in").alias("direction"), "p", "other")
    return A.optional(A.union(out, back), A.match(triples, ("?other", LABEL, "?label")))


def complexity_by_file(triples: DataFrame, most: int = 50) -> DataFrame:
    """(file, functions, complexity, lines): files by total complexity; those that lack a figure are left out.

    Files of the same name in different repositories count as one.
    """
    code = A.match(triples, ("?s", "kg:isCodePartOf", "?path")).select("s", F.regexp_replace("path", "^.*[/]([^/]+)$", "$1").alias("file"))
    figure = lambda rows, k, v: rows.select("s", F.lit(k).alias("figure"), v.cast("double").alias("v"))
    figures = figure(A.match(triples, ("?s", TYPE, "kg:FunctionDefinition")), 0, F.lit(1.0))
    figures = figures.union(figure(A.match_numeric(triples, COMPLEXITY, "c"), 1, F.col("c"))).union(figure(A.match_numeric(triples, "kg:hasLineCount", "l"), 2, F.col("l")))
    of = lambda k: F.when(F.col("figure") == k, F.col("v"))
    rows = A.natural(code, figures).groupBy("file").agg(F.count(of(0)).alias("functions"), F.sum(of(1)).alias("complexity"), F.sum(of(2)).alias("lines"))
    return rows.where("functions > 0 and complexity is not null and lines is not null").orderBy(F.desc("complexity"), "file").limit(most)


def complexity_totals(triples: DataFrame, most: int = 50) -> DataFrame:
    by_file = complexity_by_file(triples, most)
    return by_file.agg(F.round(F.avg("complexity"), 6).alias("mean_of_files"), F.count_if(F.col("complexity") > 10).alias("complex_files"))


def overall_complexity(triples: DataFrame) -> DataFrame:
    rows = A.natural(A.match(triples, ("?s", TYPE, "kg:FunctionDefinition")), A.match_numeric(triples, COMPLEXITY, "c"))
    return rows.agg(F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("mean"), F.count("*").alias("functions"))


def complexity_distribution(triples: DataFrame) -> DataFrame:
    c = F.col("c")
    bucket = F.when(c <= 5, "low").when(c <= 10, "medium").when(c <= 20, "high").otherwise("very high")
    return A.match_numeric(triples, COMPLEXITY, "c").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def complexity_analytics(triples: DataFrame, closure: DataFrame) -> DataFrame:
    c = A.match_numeric(triples, COMPLEXITY, "c").agg(F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("mean"), F.count_if(F.col("c") > 10).alias("complex"))
    lines = A.match_numeric(triples, "kg:hasLineCount", "l").agg(F.coalesce(F.sum("l"), F.lit(0.0)).alias("lines"))
    return c.crossJoin(lines)


def trends(triples: DataFrame, closure: DataFrame, at: Column | None = None) -> DataFrame:
    """The current counts as one point in time."""
    now = F.current_timestamp() if at is None else at
    return count_classes(triples, closure, {"files": "kg:File", "entities": "kg:CodeEntity"}).select(F.date_format(now, "yyyy-MM-dd").alias("day"), "files", "entities")


def health(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count("*").alias("n"))


def export_rows(triples: DataFrame, limit: int = 1000) -> DataFrame:
    return triples.select("s", "p", "o").orderBy("s", "p", "o").limit(limit)


def all_nodes(triples: DataFrame, limit: int = 10_000) -> DataFrame:
    wide = A.property_table(triples, {TYPE: "type", LABEL: "label"}).where("type is not null")
    return wide.orderBy("s").limit(limit)


def all_edges(triples: DataFrame, limit: int = 50_000) -> DataFrame:
    rows = triples.where((F.col("o_kind") == "iri") & ~F.col("p").isin(TYPE, iri("rdfs:subClassOf")))
    return rows.select("s", "p", "o").orderBy("s", "p", "o").limit(limit)


def node_details(triples: DataFrame, subject: str) -> DataFrame:
    return A.match(triples, (subject, "?p", "?o"))


def search_nodes(triples: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """Labels that hold a text, last first."""
    rows = A.match(triples, ("?s", LABEL, "?label")).where(F.lower("label").contains(text.lower()))
    return rows.orderBy(F.desc("label"), F.desc("s")).limit(limit)


def cluster_nodes(triples: DataFrame, cluster: str) -> DataFrame:
    return A.match(triples, ("?s", "kg:belongsToRepository", cluster)).distinct()


def neighbours(triples: DataFrame, subject: str, limit: int = 50) -> DataFrame:
    out = triples.where((F.col("s") == iri(subject)) & (F.col("o_kind") == "iri")).select(F.col("o").alias("node"), "p")
    back = A.match(triples, ("?node", "?p", subject))
    return A.union(out, back.select("node", "p")).orderBy("node", "p").limit(limit)


def code_parts(triples: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst, depth): code parts at any depth below each."""
    return transitive_closure(edges(triples, "kg:hasCodePart"), reflexive=False, max_depth=depth)


def newest_per_repository(triples: DataFrame) -> DataFrame:
    rows = A.match(triples, ("?repo", "kg:hasFile", "?file"), ("?file", "kg:modified", "?time"))
    w = Window.partitionBy("repo").orderBy(F.desc("time"), "file")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("repo", "file", "time")
