"""Dependencies of build files and frameworks of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip, uri_safe
from loomgraph.model import INST, KG, from_structs, link, value

FRAMEWORKS = {
    "js": "react vue angular express next nuxt gatsby svelte jquery lodash moment axios redux mobx graphql",
    "py": "django flask fastapi tornado bottle pyramid cherrypy numpy pandas matplotlib scikit-learn tensorflow pytorch",
    "java": "spring hibernate junit mockito log4j slf4j jackson gson okhttp retrofit dagger guice",
    "cs": "asp.net entity nhibernate nunit moq log4net serilog newtonsoft system.text.json mediatr autofac",
}
_USED = {"js": r"(?i)import.*{0}|require\(['\"]{0}|from ['\"]{0}['\"]", "py": r"(?i)import.*{0}|from {0}", "java": r"(?i)import.*{0}", "cs": r"(?i)using.*{0}"}
_LANGUAGE = {".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".py": "py", ".java": "java", ".cs": "cs"}
_KIND = {"js": "JavaScriptFramework", "py": "PythonFramework", "java": "JavaFramework", "cs": "DotNetFramework"}
_PAIR = "array<struct<name:string,version:string>>"


def _of_maps(text: Column, *keys: str) -> Column:
    parsed = F.from_json(text, "struct<" + ",".join(f"`{k}`:map<string,string>" for k in keys) + ">")
    one = lambda k: F.transform(F.coalesce(F.map_entries(parsed[k]), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version")))
    return F.concat(*(one(k) for k in keys))


def _of_lines(text: Column, name: str, version: Column | str | None = None, where: str | None = None, group: int = 1) -> Column:
    """Pairs from each line that matches the pattern name, by its first group, and version, by its own."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.rlike(where or name))
    ver = lambda x: F.regexp_extract(x, version, 1) if isinstance(version, str) else F.lit("")
    return F.filter(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, name, group).alias("name"), ver(x).alias("version"))), lambda p: p["name"] != "")


def dependency_list(filename: Column, text: Column) -> Column:
    """Array of (name, version), in order, of a build file; empty for a file that isn't one or can't be read.

    A requirement's == is left out of its version, other bounds are kept; Cargo dependencies count where they have a
    table of their own.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.startswith("#"))
    requirement = lambda x: F.struct(
        F.when(x.contains("=="), F.substring_index(x, "==", 1)).otherwise(F.regexp_extract(x, r"^(.*?)(?:>=|<=|~=|!=|$)", 1)).alias("name"),
        F.when(x.contains("=="), F.regexp_extract(x, r"==(.*)$", 1)).otherwise(F.regexp_extract(x, r"((?:>=|<=).*)$", 1)).alias("version"),
    )
    empty = F.array().cast(_PAIR)
    found = (
        F.when(filename.contains("package.json"), _of_maps(text, "dependencies", "devDependencies").cast(_PAIR))
        .when(filename.contains("composer.json"), _of_maps(text, "require", "require-dev").cast(_PAIR))
        .when(filename.contains("requirements.txt"), F.filter(F.transform(lines, requirement), lambda p: p["name"] != "").cast(_PAIR))
        .when(filename.contains("Gemfile"), _of_lines(text, r'^gem [^"]*"([^"]*)"', r'^gem [^"]*"[^"]*"[^"]*"([^"]*)"').cast(_PAIR))
        .when(filename.contains("go.mod"), _of_lines(text, r"^require\s+(\S+)\s+\S+", r"^require\s+\S+\s+(\S+)").cast(_PAIR))
        .when(filename.contains("Cargo.toml"), _of_lines(text, r"^\[(?:dev-)?dependencies\.(.+)\]$").cast(_PAIR))
    )
    return F.coalesce(found, empty)


def dependencies(files: DataFrame) -> DataFrame:
    """(repository, path, position, name, version) of files(repository, path, filename, text)."""
    d = dependency_list(F.col("filename"), F.col("text"))
    return files.select("repository", "path", F.posexplode(d).alias("position", "d")).select("repository", "path", "position", "d.name", "d.version")


def framework_list(language: str, text: Column) -> Column:
    """Names of the frameworks that a text of that language brings in."""
    tests = [F.when(text.rlike(_USED[language].format(f.replace(".", r"\."))), f) for f in FRAMEWORKS[language].split()]
    return F.coalesce(F.filter(F.array(*tests), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def frameworks(files: DataFrame) -> DataFrame:
    """(repository, path, name, kind) of files(repository, path, extension, text)."""
    out = None
    for language, kind in _KIND.items():
        here = files.where(F.col("extension").isin(*(e for e, x in _LANGUAGE.items() if x == language)))
        part = here.select("repository", "path", F.explode(framework_list(language, F.col("text"))).alias("name"), F.lit(kind).alias("kind"))
        out = part if out is None else out.union(part)
    return out


def dependency_triples(found: DataFrame) -> DataFrame:
    """Triples of dependencies(): the first version that a repository gives is the package's there."""
    rows = found.groupBy("repository", "name").agg(F.min(F.struct("path", "position", "version")).alias("first"), F.collect_set("path").alias("paths"))
    package = F.concat(F.lit(INST + "package/"), uri_safe(F.col("name")))
    file = F.concat(F.lit(INST), uri_safe(F.col("repository")), F.lit("/"), uri_safe(F.col("path")))
    each = rows.select("repository", "name", "first", F.explode("paths").alias("path"))
    return from_structs(each, link(package, "rdf:type", F.lit(KG + "SoftwarePackage")), value(package, "rdfs:label", F.col("name")), value(package, "kg:hasVersion", F.nullif(F.col("first.version"), F.lit(""))), link(file, "kg:specifiesDependency", package), link(package, "kg:isDependencyOf", file))


def framework_triples(found: DataFrame) -> DataFrame:
    f = F.concat(F.lit(INST + "framework/"), uri_safe(F.col("name")))
    file = F.concat(F.lit(INST), uri_safe(F.col("repository")), F.lit("/"), uri_safe(F.col("path")))
    return from_structs(found, link(f, "rdf:type", F.concat(F.lit(KG), "kind")), value(f, "rdfs:label", F.col("name")), link(file, "kg:usesFramework", f), link(f, "kg:isFrameworkFor", file))
