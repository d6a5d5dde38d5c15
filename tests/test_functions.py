import pytest
from pyspark.sql import functions as F

from loomgraph.functions import prose
from loomgraph.functions import text as T
from loomgraph.functions.search import flexible_pattern, singular_or_plural, valid_iri


def one(spark, f, *values):
    """f of columns that hold values."""
    df = spark.range(1).select(*(F.lit(v).cast("string").alias(f"c{i}") for i, v in enumerate(values)))
    return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first().x


@pytest.mark.parametrize(
    "f, values, want",
    [
        (T.token_count, ["def foo(x, y): return x + y"], 7),
        (T.token_count, ["a = 1 # comment\nb = 2 // another"], 4),
        (T.token_count, [""], 0),
        (T.token_count, [None], 0),
        (T.line_count, [""], 0),
        (T.line_count, [None], 0),
        (T.line_count, ["a\nb\nc"], 3),
        (T.file_line_count, ["a\nb\n"], 2),
        (T.imported_names, ["from math import sqrt, pow"], ["sqrt", "pow"]),
        (T.imported_names, ["import os"], ["os"]),
        (T.imported_names, ["import os as o, sys"], ["os", "sys"]),
        (T.imported_names, ["print('hello')"], []),
        (T.complexity, ["\n".join(x + ": pass" for x in ("if x", "for i in range(3)", "try", "except"))], 10),
        (T.complexity, [""], 1),
        (T.complexity, [None], 1),
        (T.canonical_name, ["Baz", "bar"], "Baz.bar"),
        (T.canonical_name, [None, "bar"], "bar"),
        (T.canonical_name, ["Baz", None], ""),
        (T.access_modifier, ["public class Foo", "Foo"], "public"),
        (T.access_modifier, ["def _x(): pass", "_x"], "private"),
        (T.access_modifier, ["", "_hidden"], None),
        (T.heading_level, ["h2"], 2),
        (T.heading_level, ["hX"], None),
        (T.uri_safe, ["a b//c?é__x "], "a_b//c_é_x"),
        (T.uri_safe_path, ["/a b//c d/"], "a_b/c_d"),
        (T.local_name, ["http://x/y#Z"], "Z"),
        (T.local_name, ["http://x/y"], "y"),
        (T.property_key, ["http://x#has-part"], "has_part"),
        (T.truncate_label, ["x" * 60], "x" * 60),
        (T.truncate_label, ["word " * 20], ("word " * 12).rstrip()[:59] + "..."),
        (T.truncate_label, ["y" * 70], "y" * 60 + "..."),
        (T.clean_label, ["some_long-name"], "Some Long Name"),
        (T.clean_label, ["single"], "Single"),
        (T.issue_references, ["fixes #12 and #7"], ["12", "7"]),
        (T.is_fix, ["Resolved it"], True),
        (T.contributor_name, ["  JANE   SMITH "], "Jane Smith"),
        (T.contributor_name, ["   "], ""),
        (T.contributor_name, [None], ""),
        (T.remote_url, ["git@host.org:a/b.git"], "https://host.org/a/b"),
        (T.remote_url, ["ssh://git@host.org:22/a/b.git"], "https://host.org/a/b"),
        (T.commit_label, ["abcdef0123", "First\nline"], "abcdef0: First line"),
        (T.license_id, ["x SPDX-License-Identifier: EPL-2.0"], "EPL-2.0"),
        (T.license_id, ["the MIT license"], "MIT"),
        (T.license_id, ["none"], ""),
        (T.base_image, ["# c\nFROM python:3.12 AS x\nRUN y"], "python:3.12"),
        (T.endpoints, ["call('/api/users') and \"/api/a/{id}\" and '/api/users'"], ["/api/users", "/api/a/{id}"]),
        (T.http_verbs, ["we post, then GET"], ["GET", "POST"]),
        (T.extension, ["a/b/.hidden"], ""),
        (T.extension, ["a/b.C/x.tar.GZ"], ".gz"),
        (T.guideline_rules, ["- You must test\n- hello\n2. Never push"], ["You must test", "Never push"]),
        (T.is_primitive, ["List[int]"], True),
        (T.is_primitive, ["Widget"], False),
    ],
)
def test_values(spark, f, values, want):
    assert one(spark, f, *values) == want


def test_first_match(spark):
    rules = [("Code", r".*\.py$"), ("Text", r".*\.txt$")]
    names = ["a.py", "b.txt", "ignore_me.py", "c.bin"]
    got = [tuple(one(spark, lambda c, d=d: T.first_match(c, rules, d, ["ignore_me"]), n)) for d in ("Other", None) for n in names]
    assert got == [("Code", "high"), ("Text", "high"), (None, "ignored"), ("Other", "low"), ("Code", "high"), ("Text", "high"), (None, "ignored"), (None, "unknown")]


def test_sections(spark):
    got = one(spark, T.decision_sections, "# Title\n## Status\nAccepted\n## Context\nWe had\nthis\n## Decision\nDo it")
    assert tuple(got) == ("Accepted", "We had\nthis", "Do it", None)


def test_rounding(spark):
    df = spark.range(1)
    assert df.select(T.half_even(F.lit(2.5), 0).alias("x"), T.epoch_iso(F.lit(0)).alias("t")).first() == (2.0, "1970-01-01T00:00:00")
    assert one(spark, lambda c: T.language_of(c), ".py") == "Python" and one(spark, lambda c: T.language_of(c), ".zig") == "zig"


@pytest.mark.parametrize("query, text, hit", [("libraries", "a library", True), ("js files", "JavaScript thing", True), ("py", "pythons", True), ("files", "anything", True), ("red widgets", "a red small widget", True), ("red widgets", "widget red", False), ("???", "what???", True), ("class", "glass", True), ("boxes", "box", False)])
def test_flexible_pattern(spark, query, text, hit):
    assert one(spark, lambda c: c.rlike("(?i)" + flexible_pattern(query)), text) is hit
    assert singular_or_plural("bus") == "bus?" and singular_or_plural("is") == "is(?:e?s)?"


def test_iris():
    assert valid_iri("https://a.org/x#y") and not valid_iri("javascript:x") and not valid_iri("http://a.org/<x>") and not valid_iri("")


def test_clean_note(spark):
    note = "`code` It plays a crucial role. It plays a crucial role. This one is about something else entirely. ```x```"
    assert one(spark, prose.clean_note, note) == "It serves a purpose. This one is about something else entirely."
    assert one(spark, prose.clean_note, "short") == "short" and one(spark, prose.clean_note, None) is None
    long = ". ".join(f"{w} " * 40 for w in ("alpha", "beta", "gamma")) + "."
    assert one(spark, prose.clean_note, long).count("gamma") == 0
    assert one(spark, prose.clean_note, "the fundamental component here is written in C") == "the component here is implemented in C."


def test_readability_and_sentiment(spark):
    easy, hard = one(spark, prose.flesch, "The cat sat. The dog ran."), one(spark, prose.flesch, "Institutional organisational characterisation necessitates interdisciplinary deliberation.")
    assert easy > 90 > hard
    assert spark.range(1).select(prose.reading_level(F.lit(95)), prose.reading_level(F.lit(65)), prose.reading_level(F.lit(3))).first()[0:3] == ("very easy", "standard", "very difficult")
    df = spark.createDataFrame([(1, "great and useful"), (2, "terrible failure"), (3, "a table"), (4, None)], "id long, t string")
    assert {r.id: r.sentiment for r in prose.sentiment(df, "id", "t").collect()} == {1: "positive", 2: "negative", 3: "neutral", 4: "neutral"}
