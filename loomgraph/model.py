"""Namespaces, the triple schema, and IRIs as pure functions of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KG = "https://example.org/kg#"
INST = "https://example.org/id/"
_W3 = "http://www.w3.org/"
RDF = _W3 + "1999/02/22-rdf-syntax-ns#"
RDFS = _W3 + "2000/01/rdf-schema#"
OWL = _W3 + "2002/07/owl#"
XSD = _W3 + "2001/XMLSchema#"
SKOS = _W3 + "2004/02/skos/core#"
PREFIXES = {"kg": KG, "inst": INST, "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "skos": SKOS}

TYPE, LABEL, SUBCLASS, SEE_ALSO = RDF + "type", RDFS + "label", RDFS + "subClassOf", RDFS + "seeAlso"
NOTE = SKOS + "editorialNote"
SUBPROPERTY, INVERSE = RDFS + "subPropertyOf", OWL + "inverseOf"
OBJECT_PROPERTY, DATA_PROPERTY, CLASS = OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "Class"

TRIPLES = T.StructType(
    [
        T.StructField("s", T.StringType()),
        T.StructField("p", T.StringType()),
        T.StructField("o", T.StringType()),
        T.StructField("o_kind", T.StringType()),
        T.StructField("o_type", T.StringType()),
        T.StructField("o_num", T.DoubleType()),
        T.StructField("o_ts", T.TimestampNTZType()),
    ]
)
_NUMERIC = ("integer", "nonNegativeInteger", "positiveInteger", "decimal", "double", "float", "long", "int")


def iri(name: str) -> str:
    """kg:hasFile -> its full IRI; anything without a known prefix as it is."""
    head, colon, tail = name.partition(":")
    return PREFIXES[head] + tail if colon and head in PREFIXES else name


def typed(raw: DataFrame, distinct: bool = True) -> DataFrame:
    """Triples with their shadow columns from (s, p, o, o_kind, o_type).

    As a set, as a graph is, unless distinct is False, which spares a shuffle where the rows are known to differ.
    """
    kind = F.coalesce("o_kind", F.lit("iri"))
    number = F.when(F.col("o_type").isin(*_NUMERIC), F.expr("try_cast(o as double)"))
    time = F.when(F.col("o_type").isin("dateTime", "date"), F.expr("try_cast(o as timestamp_ntz)"))
    rows = raw.where("s is not null and p is not null and o is not null")
    rows = rows.select("s", "p", "o", kind.alias("o_kind"), "o_type", number.alias("o_num"), time.alias("o_ts"))
    return rows.dropDuplicates(["s", "p", "o", "o_kind", "o_type"]) if distinct else rows


def empty_triples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRIPLES)


def link(s: Column, p: str, o: Column) -> Column:
    """A triple whose object is an IRI, as a struct; see from_structs()."""
    return F.struct(s.alias("s"), F.lit(iri(p)).alias("p"), o.cast("string").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))


def value(s: Column, p: str, o: Column, o_type: str = "string") -> Column:
    """A triple whose object is a literal, as a struct."""
    return F.struct(s.alias("s"), F.lit(iri(p)).alias("p"), o.cast("string").alias("o"), F.lit("lit").alias("o_kind"), F.lit(o_type).alias("o_type"))


def from_structs(df: DataFrame, *triples: Column) -> DataFrame:
    """Triples from each row of df, one for each struct whose subject and object aren't null: one pass, no union."""
    rows = df.select(F.explode(F.array(*triples)).alias("t")).select("t.*")
    return typed(rows)
