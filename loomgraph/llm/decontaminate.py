"""Benchmark decontamination: windows of an item's size that hold enough of its shingles, verified exactly.

For each benchmark item every window of a document with as many words as the item is a candidate. What decides is the
weighted Jaccard similarity of the multisets of word shingles. A window is only verified if it passes a bound that loses
nothing: a similarity of at least MIN_SIMILARITY with an item needs so much shingle weight in common that the window
must hold a certain number of the item's shingles, heaviest first. An inverted index of the items' shingles gives the
places of all of them in a text, and with them the pairs of window and item that reach the bound.

The distance of the SimHash fingerprints is reported for each find. It isn't a condition: windows of similarity 0.6
differ by about 15 of 64 bits on average, so that a radius that is narrow enough for an index loses most of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.state import table, unused
from loomgraph.llm.text import lowered, mix, rows_of, shingles, slices, words_of

SHINGLE = 3
#: Bits by which a find's fingerprint may differ from the item's: all of them.
RADIUS = 64
MIN_SIMILARITY = 0.6
LONGEST_WEIGHT = 12
#: Text of the benchmark, in characters, that one pass over the documents holds in memory.
PASS_CHARS = 32_000_000


def weighted_shingles(h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of each run of SHINGLE words, or of all words where there are fewer; a weight is the sum of the words' lengths, of which each counts at most LONGEST_WEIGHT."""
    k = min(SHINGLE, len(h))
    if not k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.minimum(length, LONGEST_WEIGHT).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(w)))
    return shingles(h, k), total[k:] - total[:-k]


def bits_of(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(mix(h, 3).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def simhash(h: np.ndarray, w: np.ndarray) -> int:
    sums = (2 * bits_of(h).astype(np.int64) - 1) * w[:, None]
    return int(np.packbits(sums.sum(axis=0) > 0).view(">u8")[0])


def similarity(h: np.ndarray, w: np.ndarray, other: dict[int, int], weights: dict[int, int]) -> float:
    """Weighted Jaccard of two multisets of shingles: the sum of weight x smaller count over weight x larger count."""
    here, count = np.unique(h, return_counts=True)
    mine = dict(zip(here.tolist(), count.tolist()))
    weight = dict(zip(h.tolist(), w.tolist())) | weights
    both = either = 0
    for s in mine.keys() | other.keys():
        a, b = mine.get(s, 0), other.get(s, 0)
        both += weight[s] * min(a, b)
        either += weight[s] * max(a, b)
    return both / either if either else 0.0


class Index:
    """The items of a benchmark as arrays: sizes, bounds, and their shingles by item and by value."""

    def __init__(self, items: list[tuple[int, str]]):
        data, offsets = lowered(pa.array([t for _, t in items], pa.large_string()))
        start, end, h = words_of(data, offsets)
        cut = np.searchsorted(start, offsets)
        kept = np.flatnonzero(cut[1:] > cut[:-1])
        self.ids = [items[i][0] for i in kept.tolist()]
        first, self.size = cut[:-1][kept], (cut[1:] - cut[:-1])[kept]
        length = np.concatenate(([0], np.cumsum(np.minimum(end - start, LONGEST_WEIGHT))))
        owner, shingle, weight = [], [], []
        for k in range(1, SHINGLE + 1):
            mine = np.flatnonzero(np.minimum(self.size, SHINGLE) == k)
            n = self.size[mine] - k + 1
            at = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            owner.append(np.repeat(mine, n))
            shingle.append(shingles(h, k)[at] if len(at) else np.zeros(0, np.uint64))
            weight.append(length[at + k] - length[at])
        owner, shingle, weight = (np.concatenate(x) for x in (owner, shingle, weight))
        self.total = np.bincount(owner, weight, minlength=len(kept)).astype(np.int64)
        order = np.lexsort((-weight, owner))
        heaviest = np.cumsum(weight[order])
        heaviest -= np.concatenate(([0], np.cumsum(self.total)))[owner[order]]
        self.least = np.bincount(owner[order], heaviest < MIN_SIMILARITY * self.total[owner[order]] - 1e-9, minlength=len(kept)).astype(np.int64) + 1
        order = np.lexsort((shingle, owner))
        owner, shingle, weight = owner[order], shingle[order], weight[order]
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])))) if len(owner) else np.zeros(0, np.int64)
        self.values, self.counts, self.weights, owner = shingle[new], np.diff(np.append(new, len(shingle))), weight[new], owner[new]
        #: the sorted shingles of item i, with their counts and weights, are those from at[i] to at[i + 1]
        self.at = np.searchsorted(owner, np.arange(len(kept) + 1))
        #: by shingle length: a filter, the sorted shingles, and the items of each as a CSR list
        self.known: dict[int, tuple] = {}
        for k in range(1, SHINGLE + 1):
            mine = np.minimum(self.size[owner], SHINGLE) == k if len(owner) else np.zeros(0, bool)
            if mine.any():
                values, of = self.values[mine], owner[mine]
                order = np.argsort(values, kind="stable")
                distinct, first = np.unique(values[order], return_index=True)
                filter_ = np.zeros(1 << 22, dtype=bool)
                filter_[(distinct & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
                self.known[k] = (np.packbits(filter_), distinct, np.append(first, len(order)), of[order])

    def hits(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, index of the shingle) of the shingles of length k that some item has."""
        filter_, distinct, _, _ = self.known[k]
        sh = shingles(h, k)
        slot = (sh & np.uint64((1 << 22) - 1)).astype(np.int64)
        at = np.flatnonzero((filter_[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
        p = np.minimum(np.searchsorted(distinct, sh[at]), len(distinct) - 1)
        ok = distinct[p] == sh[at]
        return at[ok], p[ok]

    def windows(self, k: int, at: np.ndarray, shingle: np.ndarray, words: int) -> dict[int, np.ndarray]:
        """By item the first words of the windows of a text that hold as many of its shingles as its bound asks."""
        _, _, first, owner = self.known[k]
        n = first[shingle + 1] - first[shingle]
        item = owner[np.repeat(first[shingle] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place = np.repeat(at, n)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        out: dict[int, np.ndarray] = {}
        edge = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True]))) if len(item) else []
        for s, e in zip(edge[:-1], edge[1:]):
            i = int(item[s])
            need, size = int(self.least[i]), int(self.size[i])
            if e - s < need:
                continue
            span = min(size, words) - k + 1  # shingles of a window
            p = place[s:e]
            lo, hi = np.maximum(p[need - 1 :] - span + 1, 0), np.minimum(p[: len(p) - need + 1], max(0, words - size))
            lo, hi = lo[lo <= hi], hi[lo <= hi]
            if len(lo):  # both ascend: what is left is each interval's part beyond the one before
                lo[1:] = np.maximum(lo[1:], hi[:-1] + 1)
                length = np.maximum(hi - lo + 1, 0)
                out[i] = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
        return out

    def common(self, i: int, sh: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
        """The weight that item i and each window of span shingles from starts have in common, in one pass over the text.

        An occurrence counts in those windows that hold it and fewer than the item's number of the same before it: those
        that begin after the occurrence which is that many places earlier.
        """
        values, counts, weights = (x[self.at[i] : self.at[i + 1]] for x in (self.values, self.counts, self.weights))
        base = int(starts[0])
        part = sh[base : int(starts[-1]) + span]
        which = np.minimum(np.searchsorted(values, part), len(values) - 1)
        place = np.flatnonzero(values[which] == part)
        place = place[np.argsort(which[place], kind="stable")]
        which = which[place]
        back = np.arange(len(place)) - counts[which]
        same = (back >= 0) & (which[np.maximum(back, 0)] == which)
        begin = np.maximum(np.where(same, place[np.maximum(back, 0)] + 1, 0), place - span + 1)
        change = np.bincount(begin, weights[which], minlength=len(part) + 1) - np.bincount(place + 1, weights[which], minlength=len(part) + 1)
        return np.cumsum(change)[starts - base].astype(np.int64)

    def search(self, h: np.ndarray, length: np.ndarray, windows: dict[int, np.ndarray]) -> list[tuple]:
        """(item, first word, words, distance, similarity): the best window for each item, the earliest of equal ones."""
        best: dict[int, tuple] = {}
        by_size: dict[int, tuple] = {}
        for i, starts in windows.items():
            item, size = self.ids[i], int(self.size[i])
            k = min(SHINGLE, size)
            if k not in by_size:
                w = np.concatenate(([0], np.cumsum(np.minimum(length, LONGEST_WEIGHT).astype(np.int64))))
                by_size[k] = (shingles(h, k), np.concatenate(([0], np.cumsum(w[k:] - w[:-k]))))
            sh, total = by_size[k]
            span = min(size, len(h)) - k + 1
            both = self.common(i, sh, starts, span)
            sims = both / (total[starts + span] - total[starts] + self.total[i] - both)
            at = int(sims.argmax())
            s, sim = int(starts[at]), float(sims[at])
            if sim >= MIN_SIMILARITY and (item not in best or (-sim, s) < (-best[item][4], best[item][1])):
                mine = slice(self.at[i], self.at[i + 1])
                theirs = simhash(self.values[mine], self.weights[mine] * self.counts[mine])
                ours = simhash(*weighted_shingles(h[s : s + size], length[s : s + size]))
                best[item] = (item, s, min(size, len(h) - s), (ours ^ theirs).bit_count(), sim)
        return list(best.values())


def _one_pass(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index(items))  # built once; a worker unpacks it once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            out: list[tuple] = []
            for b in slices(whole, "text") if index.ids else ():
                data, offsets = lowered(b.column("text"))
                start, end, h = words_of(data, offsets)
                cut = np.searchsorted(start, offsets)
                ids = b.column("doc_id")
                wanted: dict[int, dict[int, np.ndarray]] = {}
                for k in index.known:
                    at, shingle = index.hits(h, k)
                    row = rows_of(start[at], offsets)
                    inside = at + k <= cut[row + 1]  # not those that run into the next text
                    at, shingle, row = at[inside], shingle[inside], row[inside]
                    edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else []
                    for s, e in zip(edge[:-1], edge[1:]):
                        r = int(row[s])
                        wanted.setdefault(r, {}).update(index.windows(k, at[s:e] - cut[r], shingle[s:e], int(cut[r + 1] - cut[r])))
                for r, windows in wanted.items():
                    s, e = int(cut[r]), int(cut[r + 1])
                    out += [(ids[r].as_py(), *x) for x in index.search(h[s:e], (end - start)[s:e], windows)]
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"])

    return docs.mapInArrow(run, "doc_id long, item_id long, first_word int, n_words int, distance int, similarity double")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): the best window of each document for each item.

    A row says that the window of n_words words from first_word (from 0) has a weighted Jaccard similarity of at least
    MIN_SIMILARITY with the item; of equally similar windows the first counts. distance is that of the fingerprints.
    A document shorter than the item is one window. Null ids, null texts and texts without words match nothing, nor do
    null items and items without words. An item_id that occurs more than once counts once, by its best window; so does
    a doc_id within each of its rows. A very long text is searched whole. With an empty table on either side the result
    is empty. Ids are integers. Other columns are not looked at.

    The benchmark's size is measured first. Each pass over the documents broadcasts at most PASS_CHARS characters of
    it; a larger benchmark takes several passes, whose results are disjoint by item.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, math.ceil(chars / PASS_CHARS))
    found = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        here = _one_pass(plain, [(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()])
        found = here if found is None else found.union(here)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a passage of the benchmark. Rows without an id or text stay."""
    name = unused("gone", docs)
    gone = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
