"""Annotation: templates over properties, links to labels, sentences about relations, summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.prose import clean_note
from loomgraph.functions.text import local_name, property_key
from loomgraph.model import LABEL, NOTE, TYPE

DEFAULT_TEMPLATE = "{label} is a {class_name} that {specific_function}."
_CONTEXT = {
    "import": ("imports external dependencies", "enable access to external libraries and modules"), "def": ("implements a specific operation", "encapsulate reusable logic and operations"), "class": ("defines a class structure", "define object blueprints and data structures"),
    "comment": ("provides code documentation", "document code behavior and purpose"), "other": ("serves a specific role", "contribute to system functionality"),
}


def snippet_kind(snippet: Column) -> Column:
    """What a piece of code is, by how it starts; null for null."""
    return F.when(snippet.rlike("^(import|from) "), "import").when(snippet.rlike("^(def|function) "), "def").when(snippet.contains("class"), "class").when(snippet.rlike("^(//|#)"), "comment").when(snippet.isNotNull(), "other")


def context(snippet: Column, parent: Column, label: Column) -> Column:
    """Struct (specific_function, specific_purpose, specific_role) of a snippet, its parent and its label, whose words take precedence over the snippet's purpose."""
    kind = snippet_kind(snippet)
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in _CONTEXT.items() for x in (k, v[i]))), kind)
    low = F.lower(label)
    said = F.when(low.contains("import"), _CONTEXT["import"][1]).when(low.contains("var"), "store and manage data values").when(low.contains("func"), _CONTEXT["def"][1]).when(low.contains("class"), _CONTEXT["class"][1]).when(low.contains("comment"), _CONTEXT["comment"][1])
    role = F.when(parent.contains("function"), "function implementation").when(parent.contains("class"), "class definition").when(parent.contains("file"), "file organization").when(parent.isNotNull(), "system component")
    return F.struct(F.coalesce(pick(0), F.lit(_CONTEXT["other"][0])).alias("specific_function"), F.coalesce(said, pick(1)).alias("specific_purpose"), role.alias("specific_role"))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rendered(template: str, values: Column) -> Column:
    """A template with each {name} or {{name}} replaced by the map's value, escaped for HTML; '' where it has none."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}|\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), html_escape(F.coalesce(F.element_at(values, F.lit(m[1] or m[2])), F.lit("")))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def instances(triples: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(s, cls) of the instances of each class that has a template."""
    return triples.where((F.col("p") == TYPE) & F.col("o").isin(*templates)).select("s", F.col("o").alias("cls"))


def annotated(triples: DataFrame, templates: dict[str, str], default: str | None = None) -> DataFrame:
    """(s, p, o) notes: for each instance its class's template over its properties, cleaned.

    Properties go by their local names; of several values the smallest counts. With default, classes without a template
    use that. Two shuffles do all instances at once.
    """
    types = triples.where(F.col("p") == TYPE).groupBy("s").agg(F.min("o").alias("cls"))
    if default is None:
        types = types.where(F.col("cls").isin(*templates))
    props = triples.where(F.col("p") != TYPE).groupBy("s", property_key(F.col("p")).alias("k")).agg(F.min("o").alias("v"))
    table = props.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    rows = types.join(table, "s", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,string>")))
    get = lambda k: F.element_at("m", F.lit(k))
    c = context(get("hasSourceCodeSnippet"), get("isCodePartOf"), get("label"))
    base = F.create_map(F.lit("class_name"), local_name(F.col("cls")), *(x for n in ("specific_function", "specific_purpose", "specific_role") for x in (F.lit(n), F.coalesce(c[n], F.lit("")))))
    known = F.map_concat(F.map_filter("m", lambda k, v: ~k.isin("class_name", "specific_function", "specific_purpose", "specific_role")), base)
    note = None
    for cls, template in templates.items():
        text = rendered(template, known)
        note = F.when(F.col("cls") == cls, text) if note is None else note.when(F.col("cls") == cls, text)
    last = rendered(default, known) if default is not None else F.lit(None)
    note = last if note is None else note.otherwise(last)
    return rows.select("s", F.lit(NOTE).alias("p"), clean_note(note).alias("o"), F.lit("lit").alias("o_kind"), F.lit("string").alias("o_type"))


def relation_sentences(triples: DataFrame) -> DataFrame:
    """(s, sentence): what each node is linked with, by label."""
    labels = triples.where(F.col("p") == LABEL).groupBy("s").agg(F.min("o").alias("label"))
    links = triples.where((F.col("o_kind") == "iri") & (F.col("p") != TYPE)).select("s", "p", "o")
    rows = links.join(labels.select(F.col("s").alias("o"), F.col("label").alias("other")), "o").join(labels, "s", "left")
    words = F.lower(F.regexp_replace(local_name(F.col("p")), "([a-z])([A-Z])", "$1 $2"))
    return rows.select("s", F.concat_ws(" ", F.coalesce("label", local_name(F.col("s"))), words, "other").alias("sentence"))


def linked(notes: DataFrame, labels: DataFrame, longest: int = 4) -> DataFrame:
    """(id, label, target): where a note's words, up to longest of them, are the label of a node.

    A join of the notes' word runs with the labels, in the place of named-entity recognition.
    """
    words = F.split(F.lower(F.regexp_replace("note", r"[^\p{L}\p{N}\s]", " ")), r"\s+")
    rows = notes.select("id", F.filter(words, lambda w: w != "").alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("w", i, n), " "))))
    grams = rows.select("id", F.explode(F.array_distinct(runs)).alias("label"))
    return grams.join(labels.select(F.lower("label").alias("label"), F.col("s").alias("target")), "label").select("id", "label", "target").distinct()


def snippet_summary(snippet: Column) -> Column:
    """The first doc string or comment of a piece of code; else its first line that isn't blank."""
    doc = F.nullif(F.regexp_extract(snippet, r'(?s)(?:"""|' + r"''')\s*(.*?)\s*(?:" + '"""|' + r"''')", 1), F.lit(""))
    comment = F.nullif(F.regexp_replace(F.regexp_extract(snippet, r"(?m)(?:^|\s)(?:#+|//+)\s*(.+)$", 1), r"\s+$", ""), F.lit(""))
    line = F.nullif(F.regexp_extract(snippet, r"(?m)^\s*(\S.*?)\s*$", 1), F.lit(""))
    return F.coalesce(doc, comment, line, F.lit(""))
