"""Markdown elements and code comments."""

from __future__ import annotations

import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import anchored, decision_sections, endpoints, guideline_rules, http_verbs, uri_safe
from loomgraph.model import INST, KG, from_structs, link, value

ELEMENT = "doc string, position int, parent int, kind string, level int, start_line int, text string"
DOCUMENT_KINDS = [("Readme", r"(?i)(?:.*/)?readme"), ("Changelog", r"(?i)(?:.*/)?(?:changelog|history)"), ("ContributionGuideline", r"(?i)(?:.*/)?contributing"), ("ArchitecturalDecision", r"(?i)(?:.*/)?adrs?/|(?:.*/)?adr[-_]?\d"), ("APIDocumentation", r"(?i)(?:.*/)?(?:api|openapi|swagger)"), ("License", r"(?i)(?:.*/)?licen[cs]e")]
_SLASH = ".js .mjs .jsx .ts .tsx .java .c .cpp .cs .go .rs".split()
_HASH = ".sh .bash .zsh .ps1 .rb .pl .lua .r".split()


def markdown_elements(text: str) -> list[tuple]:
    """(position, parent, kind, level, start_line, text) of a Markdown text's blocks; the document itself is 0.

    Blocks hang below the last heading of a smaller level, list items below their list, nested lists below their item.
    """
    out: list[tuple] = [(0, None, "document", 0, 1, "")]
    headings: list[tuple[int, int]] = [(0, 0)]  # level, position
    lists: list[tuple[int, int, int]] = []  # indent, list, item
    lines = text.split("\n")
    at = 0

    def add(kind: str, parent: int, level: int, line: int, body: str) -> int:
        out.append((len(out), parent, kind, level, line, body))
        return len(out) - 1

    while at < len(lines):
        line, start = lines[at], at + 1
        top = headings[-1][1]
        if not line.strip():
            at += 1
            continue
        if m := re.match(r"\s{0,3}(```+|~~~+)\s*(\S*)", line):
            body = []
            at += 1
            while at < len(lines) and not lines[at].strip().startswith(m[1]):
                body.append(lines[at])
                at += 1
            at += 1
            add("code", lists[-1][2] if lists and line.startswith(" ") else top, 0, start, "\n".join(body))
            continue
        if m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            level, lists = len(m[1]), []
            while headings[-1][0] >= level:
                headings.pop()
            headings.append((level, add("heading", headings[-1][1], level, start, m[2])))
            at += 1
            continue
        if m := re.match(r"(\s*)([-*+]|\d+[.)])\s+(.*)", line):
            indent = len(m[1].expandtabs(4))
            while lists and lists[-1][0] > indent:
                lists.pop()
            if not lists or lists[-1][0] < indent:
                kind = "ordered_list" if m[2][0].isdigit() else "bullet_list"
                lists.append((indent, add(kind, lists[-1][2] if lists else top, 0, start, ""), 0))
            item = add("list_item", lists[-1][1], 0, start, m[3])
            lists[-1] = (lists[-1][0], lists[-1][1], item)
            at += 1
            continue
        if line.lstrip().startswith(">"):
            body = []
            while at < len(lines) and lines[at].lstrip().startswith(">"):
                body.append(lines[at].lstrip()[1:].strip())
                at += 1
            add("quote", top, 0, start, "\n".join(body))
            continue
        if "|" in line and at + 1 < len(lines) and re.match(r"\s*\|?[\s:|-]*-[\s:|-]*$", lines[at + 1]):
            body = []
            while at < len(lines) and "|" in lines[at]:
                body.append(lines[at])
                at += 1
            add("table", top, 0, start, "\n".join(body))
            continue
        if re.match(r"\s{0,3}([-*_])(\s*\1){2,}\s*$", line):
            lists = []
            add("rule", top, 0, start, "")
            at += 1
            continue
        body = [line.strip()]
        at += 1
        if at < len(lines) and re.match(r"\s{0,3}(=+|-+)\s*$", lines[at]):
            level = 1 if "=" in lines[at] else 2
            while headings[-1][0] >= level:
                headings.pop()
            headings.append((level, add("heading", headings[-1][1], level, start, body[0])))
            at += 1
            continue
        while at < len(lines) and lines[at].strip() and not re.match(r"\s{0,3}(#{1,6}\s|```|~~~|>)|\s*([-*+]|\d+[.)])\s", lines[at]):
            body.append(lines[at].strip())
            at += 1
        if lists and line.startswith(" "):
            add("paragraph", lists[-1][2], 0, start, "\n".join(body))
        else:
            lists = []
            add("paragraph", top, 0, start, "\n".join(body))
    return out


def markdown(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The elements of each document, flat: a row points at its parent's position."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, *e) for d, t in zip(f["doc"], f["text"]) for e in markdown_elements(t)]
            out = pd.DataFrame(rows, columns=["doc", "position", "parent", "kind", "level", "start_line", "text"])
            yield out.astype({"parent": "Int32"})

    return docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).where("text is not null").mapInPandas(run, ELEMENT)


def markdown_triples(elements: DataFrame) -> DataFrame:
    cls = F.concat(F.lit(KG), F.regexp_replace(F.initcap(F.regexp_replace("kind", "_", " ")), " ", ""))
    doc = F.concat(F.lit(INST + "doc/"), uri_safe(F.col("doc")))
    at = lambda c: F.when(c == 0, doc).otherwise(F.concat(doc, F.lit("/element/"), c.cast("string")))
    e = at(F.col("position"))
    return from_structs(elements, link(e, "rdf:type", cls), value(e, "kg:hasTextValue", F.nullif("text", F.lit(""))), value(e, "kg:hasHeadingLevel", F.when(F.col("kind") == "heading", F.col("level")), "positiveInteger"), value(e, "kg:startsAtLine", F.col("start_line"), "positiveInteger"), link(e, "kg:isDocumentPartOf", at(F.col("parent"))), link(at(F.col("parent")), "kg:hasDocumentPart", e))


def python_comments(code: str) -> list[tuple]:
    """(raw, start_line, end_line) of comments and of strings that stand alone."""
    out = []
    alone = True
    try:
        for tok in tokenize.generate_tokens(io.StringIO(code).readline):
            if tok.type == tokenize.COMMENT:
                out.append((tok.string.lstrip("#").strip(), tok.start[0], tok.end[0]))
            elif tok.type == tokenize.STRING and alone:
                body = re.sub(r"^[rRbBuUfF]*('''|\"\"\"|'|\")|('''|\"\"\"|'|\")$", "", tok.string)
                out.append((body.strip(), tok.start[0], tok.end[0]))
                alone = False
            elif tok.type in (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING):
                alone = True
            else:
                alone = False
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    return out


def comments(files: DataFrame) -> DataFrame:
    """(repository, path, raw, start_line, end_line) of the comments of files(repository, path, extension, text).

    Python is tokenised; the others are read by patterns, in the JVM. Unknown extensions have none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r, p, *c) for r, p, t in zip(f["repository"], f["path"], f["text"]) for c in python_comments(t)]
            yield pd.DataFrame(rows, columns=["repository", "path", "raw", "start_line", "end_line"])

    rows = files.where("text is not null")
    python = rows.where("extension = '.py'").select("repository", "path", "text").mapInPandas(run, "repository string, path string, raw string, start_line int, end_line int")

    def lines(exts: list[str], pattern: str) -> DataFrame:
        each = rows.where(F.col("extension").isin(*exts)).select("repository", "path", F.posexplode(F.split("text", "\n")).alias("line", "x")).where(F.col("x").rlike(pattern))
        raw = F.regexp_replace(F.regexp_extract("x", pattern + "(.*)", 1), r"^\s+|\s+$", "")
        return each.select("repository", "path", raw, F.col("line") + 1, F.col("line") + 1)

    # what lies between the comments says how many lines are before each, so that equal ones keep apart
    pattern = r"(?s)/\*.*?\*/"
    block = rows.where(F.col("extension").isin(*_SLASH)).select("repository", "path", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("found"))
    breaks = lambda x: F.size(F.split(x, "\n", -1)) - 1
    before = lambda i: F.concat(F.slice("gaps", F.lit(1), i + 1), F.slice("found", F.lit(1), i))
    first = F.aggregate(before(F.col("i")), F.lit(1), lambda a, x: a + breaks(x))
    block = block.select("*", F.posexplode("found").alias("i", "x"))
    body = F.regexp_replace(F.expr("substring(x, 3, length(x) - 4)"), r"^\s+|\s+$", "")
    blocks = block.select("repository", "path", body, first, first + F.size(F.split("x", "\n")) - 1)
    return python.union(lines(_SLASH, "//+")).union(blocks).union(lines(_HASH, "#+"))


def comment_triples(found: DataFrame) -> DataFrame:
    file = F.concat(F.lit(INST), uri_safe(F.col("repository")), F.lit("/"), uri_safe(F.col("path")))
    c = F.concat(file, F.lit("/comment/"), F.col("start_line").cast("string"))
    return from_structs(found, link(c, "rdf:type", F.lit(KG + "CodeComment")), value(c, "kg:hasTextValue", F.col("raw")), value(c, "kg:startsAtLine", F.col("start_line"), "positiveInteger"), value(c, "kg:endsAtLine", F.col("end_line"), "positiveInteger"), link(c, "kg:isCodePartOf", file), link(file, "kg:hasCodePart", c))


def document_kind(path: Column) -> Column:
    """The kind of document that a path, from its start, stands for; null if it is none."""
    return F.coalesce(*(F.when(path.rlike(anchored(p)), name) for name, p in DOCUMENT_KINDS))


def document_facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, endpoints, verbs, decision, rules)."""
    t = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc"), endpoints(t).alias("endpoints"), http_verbs(t).alias("verbs"), decision_sections(t).alias("decision"), guideline_rules(t).alias("rules"))
