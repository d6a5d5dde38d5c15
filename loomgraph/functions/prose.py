"""Generated prose: cleaning notes, readability, sentiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip

_STRIPPED = [r"(?s)```.*?```", r"`[^`]+`", r"class\s+[A-Za-z_]\w*[\s]*[{][^}]*[}]", r"def\s+[A-Za-z_]\w*[\s]*[(][^)]*[)][\s]*:[^:]*:", r"function\s+[A-Za-z_]\w*[\s]*[(][^)]*[)][\s]*[{][^}]*[}]", r"import\s+[^;]+;", r"from\s+[^;]+;"]
#: Stock phrases and what they come to, in the order in which they are replaced.
PHRASES = [tuple(x.split(" > ")) for x in """
is a fundamental component within the codebase > contributes to the codebase
is intrinsically linked to > is part of
plays a crucial role > serves a purpose
fundamental component > component
essential functionality > functionality
necessary code elements > code elements
available for execution > available
overall structure and organization > system structure
proper functionality and system coherence > system functionality
vital role in the codebase > role in the codebase
important component within the codebase > component in the codebase
provides essential functionality and structure > provides functionality
crucial for maintaining proper structure > helps maintain structure
ensures proper functionality > supports functionality
is a core element within the codebase > is part of the codebase
specifically representing the act of > represents
core component within > component in
represents the entity named > represents
with a canonical name of > with canonical name
and a simple name of > with simple name
While its canonical name is > Its canonical name is
it can also be described by its text value > it has text value
written in > implemented in
has a canonical name of > has canonical name
""".strip().splitlines()]  # fmt: skip


def clean_note(c: Column, longest: int = 300) -> Column:
    """A note without code, stock phrases and sentences that share more than three words with one before.

    Longer than longest it is cut to two sentences. Texts of fewer than 10 characters and nulls stay as they are.
    """
    kept = reduce(lambda a, p: F.regexp_replace(a, p, ""), _STRIPPED[:2], c)
    kept = reduce(lambda a, p: F.regexp_replace(a, p, ""), _STRIPPED[2:], strip(kept))
    kept = reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), PHRASES, kept)
    sentences = F.filter(F.transform(F.split(kept, r"\. "), strip), lambda x: x != "")
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    none = F.array().cast("array<string>")
    fresh = lambda acc, x: ~F.exists(acc, lambda y: (x == y) | (F.size(F.array_intersect(words(x), words(y))) > 3))
    unique = F.aggregate(sentences, none, lambda acc, x: F.when(fresh(acc, x), F.array_append(acc, x)).otherwise(acc))
    note = F.array_join(unique, ". ")
    note = F.when((note != "") & ~note.endswith("."), F.concat(note, F.lit("."))).otherwise(note)
    parts = F.split(note, r"\. ")
    note = F.when((F.length(note) > longest) & (F.size(parts) > 2), F.concat(F.array_join(F.slice(parts, 1, 2), ". "), F.lit("."))).otherwise(note)
    note = strip(F.regexp_replace(F.regexp_replace(note, "`", ""), r"\s+", " "))
    return F.when(F.length(strip(c)) < 10, c).otherwise(note)


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\p{L}+(?:['-]\p{L}+)*"), 0)


def flesch(c: Column) -> Column:
    """Reading ease: 206.835 - 1.015 words per sentence - 84.6 syllables per word, syllables being runs of vowels."""
    words = F.greatest(F.size(_words(c)), F.lit(1))
    sentences = F.greatest(F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^.!?]*\p{L}[^.!?]*"), 0)), F.lit(1))
    syllables = F.greatest(F.size(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[aeiouyáéíóúàèùâêîôûäöü]+"), 0)), F.lit(1))
    return F.round(206.835 - 1.015 * words / sentences - 84.6 * syllables / words, 4)


def reading_level(score: Column) -> Column:
    levels = [(90, "very easy"), (80, "easy"), (70, "fairly easy"), (60, "standard"), (50, "fairly difficult"), (30, "difficult")]
    out = F.when(score >= levels[0][0], levels[0][1])
    for least, name in levels[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("very difficult")


_VALENCE = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "best": 3.2, "better": 1.9, "nice": 1.8, "love": 3.2, "like": 1.5, "useful": 1.9, "clean": 1.7, "simple": 1.0, "fast": 1.0, "reliable": 1.8, "robust": 1.6, "happy": 2.7, "helpful": 1.8, "improve": 1.9, "improved": 2.1, "success": 2.7, "secure": 1.4,
    "bad": -2.5, "worse": -2.1, "worst": -3.1, "terrible": -2.1, "awful": -2.0, "hate": -2.7, "error": -1.7, "errors": -1.4, "fail": -2.5, "failed": -2.3, "failure": -2.3, "bug": -1.3, "broken": -2.1, "slow": -1.0, "ugly": -2.3, "stupid": -2.4, "idiot": -2.3, "worthless": -1.9, "pathetic": -2.7, "disgusting": -2.4, "trash": -1.5, "scum": -2.5, "loser": -2.4, "moron": -2.2, "problem": -1.7, "wrong": -2.1, "insecure": -1.8,
}


def sentiment(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, score, sentiment): the sum of the words' valences, normalised by its root; from 0.05 on positive or negative."""
    values = docs.sparkSession.createDataFrame(sorted(_VALENCE.items()), "word string, valence double")
    words = docs.select(F.col(id_col).alias("id"), F.explode(_words(F.lower(F.col(text_col)))).alias("word"))
    total = words.join(F.broadcast(values), "word").groupBy("id").agg(F.sum("valence").alias("total"))  # a fixed lexicon
    score = F.coalesce(F.round(F.col("total") / F.sqrt(F.col("total") * F.col("total") + 15), 4), F.lit(0.0))
    out = docs.select(F.col(id_col).alias("id")).join(total, "id", "left").select("id", score.alias("score"))
    return out.withColumn("sentiment", F.when(F.col("score") >= 0.05, "positive").when(F.col("score") <= -0.05, "negative").otherwise("neutral"))
