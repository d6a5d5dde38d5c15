"""Reading and writing triples: N-Triples, a subset of Turtle, RDF/XML ontologies, CSV, JSON, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.model import CLASS, DATA_PROPERTY, LABEL, OBJECT_PROPERTY, OWL, PREFIXES, RDF, RDFS, SUBCLASS, TYPE, XSD, typed

_LINE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@[A-Za-z-]+)?)\s*\.\s*$'
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def _escaped(c: Column) -> Column:
    for a, b in _ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _unescaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in _ESCAPES[1:]:
        c = F.replace(c, F.lit(b), F.lit(a))
    return F.replace(c, F.lit("\x00"), F.lit("\\"))


def ntriples(triples: DataFrame) -> DataFrame:
    """(line): one statement each."""
    kind = F.when(F.col("o_type").isNotNull() & (F.col("o_type") != "string"), F.concat(F.lit("^^<" + XSD), "o_type", F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), kind))
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), obj, F.lit(" .")).alias("line"))


def parse_ntriples(lines: DataFrame, column: str = "value", distinct: bool = True) -> DataFrame:
    """Triples of a column of statements; lines that are none, comments included, are left out. On a stream, where removing repeats needs a watermark, distinct is to be False."""
    part = lambda i: F.regexp_extract(F.col(column), _LINE, i)
    iri = F.col(column).rlike(r"^\s*<[^>]*>\s+<[^>]*>\s+<")
    rows = lines.where(F.col(column).rlike(_LINE))
    kind = F.when(part(5) == "", F.lit("string")).otherwise(F.substring_index(part(5), "#", -1))
    return typed(rows.select(part(1).alias("s"), part(2).alias("p"), F.when(iri, part(3)).otherwise(_unescaped(part(4))).alias("o"), F.when(iri, "iri").otherwise("lit").alias("o_kind"), F.when(~iri, kind).alias("o_type")), distinct)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)


def write_turtle(triples: DataFrame, path: str) -> None:
    """Turtle, one statement a line with full IRIs, which any reader of it takes."""
    write_ntriples(triples, path)


_TOKEN = r'(<[^>]*>|"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\]|\\.)*"|@prefix|@base|@[A-Za-z-]+|\^\^|[;,.\[\]()](?=\s|$|[;,.\[\]()<"])|[^\s;,<>"\[\]()]+(?<!\.)|\.)'


def parse_turtle(text: str) -> list[tuple]:
    """(s, p, o, o_kind, o_type) of a Turtle document without blank nodes in brackets and collections."""
    import re

    prefixes, out = dict(PREFIXES), []
    tokens = [t for line in [re.sub(r'(?m)^\s*#.*$', "", text)] for t in re.findall(_TOKEN, line)]
    at = 0

    def term(tok: str) -> str:
        if tok.startswith("<"):
            return tok[1:-1]
        if tok == "a":
            return TYPE
        head, _, tail = tok.partition(":")
        return prefixes.get(head, head + ":") + tail

    while at < len(tokens):
        if tokens[at] == "@prefix":
            prefixes[tokens[at + 1].rstrip(":")] = tokens[at + 2][1:-1]
            at += 4
            continue
        s = term(tokens[at])
        at += 1
        while at < len(tokens) and tokens[at] != ".":
            if tokens[at] == ";":
                at += 1
                continue
            p = term(tokens[at])
            at += 1
            while True:
                tok = tokens[at]
                at += 1
                if tok.startswith('"'):
                    body = tok[3:-3] if tok.startswith('"""') else tok[1:-1]
                    body = body.replace("\\n", "\n").replace("\\t", "\t").replace('\\"', '"').replace("\\\\", "\\")
                    kind = "string"
                    if at < len(tokens) and tokens[at] == "^^":
                        kind = term(tokens[at + 1]).rsplit("#", 1)[-1]
                        at += 2
                    elif at < len(tokens) and tokens[at].startswith("@"):
                        at += 1
                    out.append((s, p, body, "lit", kind))
                elif re.fullmatch(r"[+-]?\d+(\.\d+)?|true|false", tok):
                    out.append((s, p, tok, "lit", "boolean" if tok in ("true", "false") else "decimal" if "." in tok else "integer"))
                else:
                    out.append((s, p, term(tok), "iri", None))
                if at < len(tokens) and tokens[at] == ",":
                    at += 1
                    continue
                break
        at += 1
    return out


_RAW = "s string, p string, o string, o_kind string, o_type string"


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files, each parsed by one task: prefixes hold for a whole file."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [t for content in f["value"] for t in parse_turtle(content)]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "o_kind", "o_type"])

    return typed(spark.read.text(path, wholetext=True).mapInPandas(run, _RAW))


_RESOURCE = T.StructType([T.StructField("_rdf:resource", T.StringType()), T.StructField("_rdf:about", T.StringType()), T.StructField("_VALUE", T.StringType())])
_NODE = T.StructType(
    [T.StructField("_rdf:about", T.StringType()), T.StructField("_rdf:ID", T.StringType()), T.StructField("rdfs:subClassOf", T.ArrayType(_RESOURCE)), T.StructField("rdfs:label", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_xml:lang", T.StringType())])))]
    + [T.StructField(n, T.ArrayType(_RESOURCE)) for n in ("rdfs:domain", "rdfs:range", "owl:inverseOf", "rdfs:subPropertyOf")]
)


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """Triples of an RDF/XML ontology: classes, properties, their labels, parents, domains, ranges and inverses."""
    out = None
    for tag, cls in (("owl:Class", CLASS), ("owl:ObjectProperty", OBJECT_PROPERTY), ("owl:DatatypeProperty", DATA_PROPERTY)):
        df = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(_NODE).load(path)
        node = F.coalesce(F.col("`_rdf:about`"), F.concat(F.lit("#"), F.col("`_rdf:ID`")))
        rows = df.where(node.isNotNull()).withColumn("__s", node)
        parts = [rows.select(F.col("__s").alias("s"), F.lit(TYPE).alias("p"), F.lit(cls).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))]
        for name, p in (("rdfs:subClassOf", SUBCLASS), ("rdfs:domain", RDFS + "domain"), ("rdfs:range", RDFS + "range"), ("owl:inverseOf", OWL + "inverseOf"), ("rdfs:subPropertyOf", RDFS + "subPropertyOf")):
            each = rows.select("__s", F.explode(F.col(f"`{name}`")).alias("x"))
            parts.append(each.select(F.col("__s"), F.lit(p), F.coalesce(F.col("x").getField("_rdf:resource"), F.col("x").getField("_rdf:about")), F.lit("iri"), F.lit(None).cast("string")))
        labels = rows.select("__s", F.explode(F.col("`rdfs:label`")).alias("x"))
        parts.append(labels.select("__s", F.lit(LABEL), F.col("x").getField("_VALUE"), F.lit("lit"), F.lit("string")))
        for part in parts:
            out = part if out is None else out.union(part)
    return typed(out)


def catalogue(ontology: DataFrame) -> DataFrame:
    """(kind, names): sorted local names of classes, object and data properties."""
    kind = F.when(F.col("o") == CLASS, "classes").when(F.col("o") == OBJECT_PROPERTY, "object_properties").when(F.col("o") == DATA_PROPERTY, "data_properties")
    rows = ontology.where(F.col("p") == TYPE).select(kind.alias("kind"), F.regexp_extract("s", r"([^#/]+)$", 1).alias("name")).where("kind is not null and name <> ''")
    return rows.groupBy("kind").agg(F.sort_array(F.collect_set("name")).alias("names"))


def write_store(triples: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Parquet by predicate, so that a pattern with a constant predicate reads its folder only.

    A predicate of more than rows_per_file triples is written by several tasks, by the hash of its subjects.
    """
    large = triples.groupBy("p").count().where(F.col("count") > rows_per_file).collect()  # few, as predicates are
    parts = F.lit(1)
    for r in large:
        parts = F.when(F.col("p") == r[0], -(-r[1] // rows_per_file)).otherwise(parts)
    triples.repartition("p", F.pmod(F.xxhash64("s"), parts)).write.mode("overwrite").partitionBy("p").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("s", "p", "o", "o_kind", "o_type", "o_num", "o_ts")


def clear_store(spark: SparkSession, path: str) -> None:
    from loomgraph.model import empty_triples

    empty_triples(spark).write.mode("overwrite").parquet(path)


def write_csv(triples: DataFrame, path: str, limit: int | None = 1000) -> None:
    """Subject,Predicate,Object with every field quoted; the first limit in order."""
    rows = triples.select(F.col("s").alias("Subject"), F.col("p").alias("Predicate"), F.col("o").alias("Object")).orderBy("Subject", "Predicate", "Object")
    (rows if limit is None else rows.limit(limit)).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_json(triples: DataFrame, path: str) -> None:
    triples.write.mode("overwrite").json(path)


def rdf_xml(triples: DataFrame) -> DataFrame:
    """(line): a description element for each triple, to stand within rdf:RDF."""
    from loomgraph.operators.graph import xml_text

    space, name = F.regexp_extract("p", r"^(.*[#/])[^#/]+$", 1), F.regexp_extract("p", r"([^#/]+)$", 1)
    body = F.when(F.col("o_kind") == "iri", F.concat(F.lit(' rdf:resource="'), xml_text(F.col("o")), F.lit('"/>'))).otherwise(F.concat(F.lit(">"), xml_text(F.col("o")), F.lit("</n:"), name, F.lit(">")))
    return triples.select(F.concat(F.lit('<rdf:Description rdf:about="'), xml_text(F.col("s")), F.lit('"><n:'), name, F.lit(' xmlns:n="'), space, F.lit('"'), body, F.lit("</rdf:Description>")).alias("line"))


RDF_XML_HEAD = f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF}">'
