"""HTML extraction with site templates removed: subtrees that recur across many pages of a host are deleted.

Each element's subtree is hashed from its tag, attributes, texts and children. Spark counts, for each host, on how
many different pages a subtree occurs; copies of a page, which agree in all their subtrees, count as one. Those that
reach MIN_PAGES, however many pages the host has, are its template, and are cut out before the text is taken. Inline
elements in running text (beside text in their block) are not counted: words in bold recur without being a template.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.state import cut, table
from loomgraph.llm.text import slices

MIN_PAGES = 5
#: Of the host's pages. 0: what recurs on many pages doesn't depend on how large the host is.
MIN_SHARE = 0.0
#: Most template subtrees that are broadcast, 8 bytes each; beyond it they are joined to the pages.
BROADCAST_ROWS = 2_000_000

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_SKIPPED = frozenset("script style head title noscript iframe template textarea svg".split())
BLOCKS = frozenset("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: The page as a whole, and what has no text.
_UNCOUNTED = _VOID | {"html", "body"}
_BREAKS = BLOCKS | {"br", "body", "html"}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
_SCOPES = frozenset("ul ol dl table body html div section article nav aside header footer main blockquote td th".split())


class Node:
    __slots__ = ("tag", "key", "children", "hash", "counted")

    def __init__(self, tag: str, key: str):
        self.tag, self.key, self.children, self.hash = tag, key, [], 0
        self.counted = False


def parse(page: str) -> Node:
    """A tree of a page, however malformed: end tags of what isn't open are ignored but for p and br, open elements end with their parent."""
    root = Node("#root", "")
    stack = [root]
    opened: defaultdict[str, int] = defaultdict(int)
    at, size = 0, len(page)

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag in ("p", "br"):  # these, without a beginning, stand for an empty paragraph and for a break
                stack[-1].children.append(Node(tag, ""))
            continue
        if tag in BLOCKS and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in _SCOPES:
                    break
        if tag in _CLOSES and any(opened[x] for x in _CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        node = Node(tag, m[3].strip())
        stack[-1].children.append(node)
        if tag in _RAW and not m[3].endswith("/"):
            end = _RAW[tag].search(page, at)
            node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in _VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def digest(root: Node) -> list[Node]:
    """Hashes of all subtrees, set from the leaves up; returns the elements that may be templates, the outer ones first."""
    order, counted = [root], []
    running = {id(root): False}
    for node in order:  # grows as it goes: no recursion, so that depth is no limit
        inside = (running[id(node)] and node.tag not in BLOCKS) or any(isinstance(c, str) and not c.isspace() for c in node.children)
        for c in node.children:
            if not isinstance(c, str) and c.tag not in _SKIPPED:
                order.append(c)
                running[id(c)] = inside
                c.counted = c.tag in BLOCKS or not (inside or c.tag in _UNCOUNTED)
    for node in reversed(order):
        parts = [node.tag, node.key]
        for c in node.children:
            if isinstance(c, str):
                if text := " ".join(c.split()):
                    parts.append(text)
            elif c.tag not in _SKIPPED:
                parts.append(f"\0{c.hash}")
        node.hash = xxhash.xxh64_intdigest("\1".join(parts)) >> 1
    for node in order:
        if node.counted:
            counted.append(node)
    return counted


def text_of(root: Node, gone: set[int]) -> tuple[str, int]:
    """(text, number of outermost subtrees cut out): blocks on lines of their own, white space squeezed."""
    out: list[str] = []
    cut_out = 0
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag in _SKIPPED:
            continue
        if x.counted and x.hash in gone:
            cut_out += 1
            out.append("\0" if x.tag in _BREAKS else " ")
            continue
        if x.tag in _BREAKS:
            out.append("\0")
            todo.append("\0")
        todo.extend(reversed(x.children))
    lines = (" ".join(html.unescape(line).split()) for line in "".join(out).split("\0"))
    return "\n".join(x for x in lines if x), cut_out


def host_of(url: F.Column) -> F.Column:
    """The host of an address in lower case, without user, port and a leading www.; '' where there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def _key(host: str, h: int) -> int:
    """Of a subtree on a host, as a signed 64-bit integer."""
    k = xxhash.xxh64_intdigest(f"{host}\0{h}")
    return k - (1 << 64) if k >> 63 else k


def subtrees(pages: DataFrame) -> DataFrame:
    """(row, host, key, page) of each different counted subtree of each row of pages(row, host, html); page is a hash of
    the page's content, and a key of null stands for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                rows, hosts, keys, roots = [], [], [], []
                for row, host, page in zip(*(b.column(c).to_pylist() for c in ("row", "host", "html"))):
                    root = parse(page)
                    found = [None, *{_key(host, x.hash) for x in digest(root)}]
                    keys += found
                    rows += [row] * len(found)
                    hosts += [host] * len(found)
                    roots += [root.hash] * len(found)
                yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(roots, pa.int64())], names=["row", "host", "key", "page"])

    return pages.mapInArrow(run, "row long, host string, key long, page long")


def templates(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(key) of each subtree that reaches both limits on its host, from subtrees()."""
    counted = found.select("host", "key", "page").distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    counted = cut(counted.where(f"key is null or n >= {int(min_pages)}"))  # used twice below, and small
    total = counted.where("key is null").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    often = counted.where("key is not null")
    return often.join(total, F.col("host") == F.col("h")).where(F.col("n") >= min_share * F.col("pages")).select("key")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, host, text, removed): the text of each row's page without its host's template.

    removed counts the subtrees cut out, not those within them. Scripts, styles, the head and the like have no text. A
    null page has a null text and 0 removed; an empty one has an empty text. Pages without a host are one host's.
    Repeated rows are one page as to counting, and each has its row in the result. A very long page is parsed whole.
    An empty table has no rows. Ids are integers and may be null. Other columns are not looked at.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    keyed = rows.withColumn("row", F.xxhash64("host", "html"))
    found = subtrees(keyed.where("html is not null").select("row", "host", "html"))
    template = cut(templates(found, min_pages, min_share))
    few = template.count() <= BROADCAST_ROWS
    shared = None
    if few:
        keys = np.sort(template.toArrow().column("key").to_numpy())
        shared = pages.sparkSession.sparkContext.broadcast(keys)
    else:
        mine = found.where("key is not null").select("row", "key").distinct().join(template, "key").groupBy("row").agg(F.collect_set("key").alias("gone"))
        keyed = keyed.join(mine, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value if few else None
        for whole in batches:
            for b in slices(whole, "html"):
                texts, removed = [], []
                lists = [None] * b.num_rows if few else b.column("gone").to_pylist()
                for host, page, own in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), lists):
                    if page is None:
                        texts.append(None)
                        removed.append(0)
                        continue
                    root = parse(page)
                    hashes = [x.hash for x in digest(root)]
                    keys = [_key(host, h) for h in hashes]
                    if few:
                        at = np.minimum(np.searchsorted(every, keys), max(len(every) - 1, 0)) if len(every) else []
                        gone = {h for h, k, p in zip(hashes, keys, at) if every[p] == k}
                    else:
                        mine = set(own or ())
                        gone = {h for h, k in zip(hashes, keys) if k in mine}
                    text, n = text_of(root, gone)
                    texts.append(text)
                    removed.append(n)
                yield pa.record_batch([b.column("page_id"), b.column("host"), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["page_id", "host", "text", "removed"])

    return keyed.select("page_id", "host", "html", *([] if few else ["gone"])).mapInArrow(run, "page_id long, host string, text string, removed int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
