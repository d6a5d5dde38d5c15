"""Free text to a search pattern, built on the driver."""

from __future__ import annotations

import re

from loomgraph.functions.text import regex_escape

#: Words that a query may drop.
OPTIONAL = {f"{w}{s}" for w in ("commit", "file", "function", "code", "doc", "issue") for s in ("", "s")} | {"class", "classes", "documentation"}
EXPANSIONS = {
    "js": "javascript node", "ts": "typescript", "py": "python", "php": "laravel symfony composer", "docs": "documentation readme", "code": "codes coding source", "css": "stylesheet style",
    "html": "markup template", "sql": "database query", "api": "endpoint service", "config": "configuration settings", "test": "testing spec unit", "json": "config data", "md": "markdown readme",
}


def singular_or_plural(word: str) -> str:
    """A pattern for a word in either number."""
    if word.lower().endswith("ies"):
        return regex_escape(word[:-3]) + "(?:y|ies)"
    if word.lower().endswith("s") and len(word) > 2:
        return regex_escape(word[:-1]) + "s?"
    return regex_escape(word) + "(?:e?s)?"


def flexible_pattern(query: str) -> str:
    """A pattern that finds the query's words in order, in either number, with related terms; some words may be missing.

    To be searched for without regard to case. A query without words stands for itself.
    """
    words = re.findall(r"[\w+-]+", query, re.ASCII)
    if not words:
        return regex_escape(query)
    out = []
    for word in words:
        one = singular_or_plural(word)
        if related := EXPANSIONS.get(word.lower()):
            one = "(?:" + "|".join([one, *(singular_or_plural(w) for w in related.split())]) + ")"
        out.append(rf"(?:\b{one}\b.*)?" if word.lower() in OPTIONAL else rf"\b{one}\b.*")
    pattern = "".join(out)
    return pattern[:-2] if pattern.endswith(".*") else pattern


def valid_iri(text: str) -> bool:
    """Whether text can stand in a query as an IRI: http(s), a host, and none of the characters that end one."""
    return bool(re.fullmatch(r"https?://[^\s<>\"{}|\\^`/]+[^\s<>\"{}|\\^`]*", text or ""))
