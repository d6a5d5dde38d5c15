"""Source trees as tables of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import extension, file_basename, first_match, uri_safe, uri_safe_path
from loomgraph.model import INST, KG, from_structs, link, value

#: Folders whose contents are left out.
EXCLUDED = "node_modules .git __pycache__ .venv venv dist build target vendor .idea .vscode .next coverage .cache .tox".split()
CARRIERS = [
    ("DocumentationFile", r"(?i)(^|/)(readme|changelog|contributing|license|copying|authors)[^/]*$|\.(md|rst|adoc|txt)$"),
    ("TestFile", r"(?i)(^|/)tests?/|(^|/)test_[^/]*\.py$|\.(test|spec)\.[jt]sx?$"),
    ("BuildScript", r"(?i)(^|/)(package\.json|requirements[^/]*\.txt|composer\.json|gemfile|go\.mod|cargo\.toml|pom\.xml|build\.gradle|makefile|dockerfile[^/]*)$"),
    ("SourceFile", r"(?i)\.(py|js|jsx|ts|tsx|java|cs|cpp|c|h|go|rs|rb|php|swift|kt|sql|sh|html|css)$"),
    ("ImageFile", r"(?i)\.(png|jpe?g|gif|svg|webp|ico|bmp)$"), ("AudioFile", r"(?i)\.(mp3|wav|ogg|flac)$"), ("VideoFile", r"(?i)\.(mp4|webm|avi|mov)$"), ("FontFile", r"(?i)\.(ttf|otf|woff2?)$"),
    ("ConfigurationFile", r"(?i)\.(json|ya?ml|toml|ini|cfg|xml|env)$"),
]


def read_files(spark: SparkSession, root: str, excluded: list[str] | None = None, content: bool = True) -> DataFrame:
    """(repository, path, filename, extension, size_bytes, modified, content) of each file below root/repository.

    Without content no file is opened. Files in excluded folders, and those that lie in no repository, are left out;
    files that can't be read are skipped where the session's ignoreCorruptFiles says so.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    inner = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    rel = F.expr(f"substring(__p, {len(base) + 2})")
    df = raw.withColumn("__p", inner).withColumn("__r", rel)
    parts = F.split("__r", "/")
    df = df.where((F.size(parts) > 1) & ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*(F.lit(x) for x in (EXCLUDED if excluded is None else excluded)))))
    cols = [F.element_at(parts, 1).alias("repository"), F.array_join(F.slice(parts, 2, F.size(parts)), "/").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")]
    out = df.select(*cols, *(["content"] if content else []))
    return out.withColumns({"filename": file_basename(F.col("path")), "extension": extension(F.col("path"))})


def repositories(files: DataFrame) -> DataFrame:
    return files.select("repository").distinct()


def file_count(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n"))


def supported(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Files of the given extensions, each path of a repository once."""
    return files.where(F.col("extension").isin(*(e.lower() for e in extensions))).dropDuplicates(["repository", "path"])


def as_text(content: Column, characters: int | None = None) -> Column:
    """UTF-8 text, what isn't UTF-8 left out; the first characters of it."""
    whole = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return whole if characters is None else F.substring(whole, 1, characters)


def image_size(content: Column) -> Column:
    """Struct (format, width, height) from the header of a PNG, GIF or BMP; nulls for anything else. Stays in the JVM."""
    head = F.hex(F.substring(content, 1, 32))
    at = lambda i, n: F.substring(head, 2 * i + 1, 2 * n)
    big = lambda i, n: F.conv(at(i, n), 16, 10).cast("int")
    little = lambda i, n: F.conv(F.concat(*(at(i + k, 1) for k in reversed(range(n)))), 16, 10).cast("int")
    kind = F.when(head.startswith("89504E47"), "PNG").when(head.startswith("47494638"), "GIF").when(head.startswith("424D"), "BMP").when(head.startswith("FFD8FF"), "JPEG")
    return F.struct(kind.alias("format"), F.when(kind == "PNG", big(16, 4)).when(kind == "GIF", little(6, 2)).when(kind == "BMP", little(18, 4)).alias("width"), F.when(kind == "PNG", big(20, 4)).when(kind == "GIF", little(8, 2)).when(kind == "BMP", little(22, 4)).alias("height"))


def media_type(ext: Column) -> Column:
    kinds = {"image": "png jpg jpeg gif svg webp ico bmp", "audio": "mp3 wav ogg flac", "video": "mp4 webm avi mov", "font": "ttf otf woff woff2"}
    bare = F.regexp_replace(ext, r"^\.", "")
    out = None
    for name, exts in kinds.items():
        c = bare.isin(*exts.split())
        out = F.when(c, name) if out is None else out.when(c, name)
    return out


def classified(files: DataFrame, rules: list[tuple[str, str]] | None = None, default: str = "File", ignored: list[str] | None = None, by: str = "path") -> DataFrame:
    """files with ontology_class and confidence of the first rule that by matches."""
    c = first_match(F.col(by), CARRIERS if rules is None else rules, default, ignored)
    return files.withColumn("__c", c).withColumns({"ontology_class": F.col("__c")["name"], "confidence": F.col("__c")["confidence"]}).drop("__c")


def file_iri(repository: Column, path: Column) -> Column:
    return F.concat(F.lit(INST), uri_safe(repository), F.lit("/"), uri_safe_path(path))


def triples(files: DataFrame) -> DataFrame:
    """Triples of classified files: one pass, a row for each."""
    f, repo = file_iri(F.col("repository"), F.col("path")), F.concat(F.lit(INST), uri_safe(F.col("repository")))
    rows = files.where("ontology_class is not null").dropDuplicates(["repository", "path"])
    return from_structs(
        rows, link(repo, "rdf:type", F.lit(KG + "Repository")), value(repo, "rdfs:label", F.col("repository")), link(repo, "kg:hasFile", f), link(f, "kg:belongsToRepository", repo), link(f, "rdf:type", F.concat(F.lit(KG), "ontology_class")),
        value(f, "rdfs:label", F.col("filename")), value(f, "kg:hasExtension", F.col("extension")), value(f, "kg:hasSize", F.col("size_bytes"), "nonNegativeInteger"), value(f, "kg:hasPath", F.col("path")),
        value(f, "kg:modified", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss"), "dateTime"),
    )


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
