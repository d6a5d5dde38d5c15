"""Near duplicates of documents: 128-bit SimHash fingerprints, compared per anchor of a covering code.

A fingerprint is cut into 8 blocks of 16 bits. Two fingerprints within distance RADIUS = 23 differ in at most two bits
of some block, by pigeonhole. The anchors of a block are the 4096 words of a binary code of length 16 (the Hamming code
of length 15 with a free bit) whose covering radius is 1. Of two blocks at a distance of at most 2 there is a block in
the middle, within 1 of each; its anchor is within 1 of it, so within 2 of both. Replicating each fingerprint to the
anchors within 2 (the covering radius plus half the block's threshold of 2, 8.6 anchors on average) therefore
brings every pair within RADIUS together under some anchor, and nothing else need be compared.

Not all rows of an anchor have to be compared with each other. A row's block differs from the anchor by one of 137
offsets, and two blocks are within the tolerance only if their offsets are. As the code is linear, the other anchors
under which two blocks meet depend on their offsets alone, so that a fixed table says under which one of them the two
are compared. That leaves 8 x 137 / 65,536 = 1.7 % of the pairs of random fingerprints, of which those of unlike length
fall away: the order of the comparisons is still n squared, with a small factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.components import components
from loomgraph.llm.state import cut, table, unused
from loomgraph.llm.text import lowered, mix, rows_of, slices, words_of

BLOCKS, BITS, TOLERANCE = 8, 16, 2
RADIUS = BLOCKS * (TOLERANCE + 1) - 1
#: Fewest words of the shorter of two near duplicates, as a share of the longer one's.
LENGTH_RATIO = 0.8
LONGEST_WEIGHT = 12
#: Rows of an anchor from which it pays to take them apart by offset; the result is the same.
APART = 16_384


def fingerprint_arrays(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, n_words) of each text. A word weighs the root of its count times its length, at most 12."""
    n = len(text)
    data, offsets = lowered(text)
    start, end, h = words_of(data, offsets)
    row = rows_of(start, offsets)
    n_words = np.bincount(row, minlength=n).astype(np.int32)
    high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(h):
        key = (row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(first, len(key)))
        pick = order[first]
        weight = np.sqrt(count) * np.minimum(end[pick] - start[pick], LONGEST_WEIGHT)
        weight = np.rint(weight * 16).astype(np.int32)
        r = row[pick]
        for lo in range(0, len(pick), 1 << 15):
            hi = min(len(pick), lo + (1 << 15))
            part, rr = h[pick[lo:hi]], r[lo:hi]
            at = np.flatnonzero(np.concatenate(([True], rr[1:] != rr[:-1])))
            both = np.stack([mix(part, 1), mix(part, 2)], axis=1).astype(">u8").view(np.uint8)
            bits = np.unpackbits(both, axis=1).astype(np.int32) * (2 * weight[lo:hi, None])
            sums = np.add.reduceat(bits, at, axis=0) - np.add.reduceat(weight[lo:hi], at)[:, None]
            if lo == 0:
                total = np.zeros((n, 128), np.int64)
            total[rr[at]] += sums
        packed = np.packbits(total > 0, axis=1).view(">u8").astype(np.uint64)
        high, low = packed[:, 0].copy(), packed[:, 1].copy()
    for i in np.flatnonzero(n_words == 0):
        both = xxhash.xxh128_intdigest(text[int(i)].as_py() or "")
        high[i], low[i] = both >> 64, both & ((1 << 64) - 1)
    return high, low, n_words


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, high, low, n_words). Rows without an id or a text have no fingerprint.

    A text without words gets a hash of its exact characters and n_words 0, so that only equal ones agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                high, low, n = fingerprint_arrays(b.column("text"))
                yield pa.record_batch([b.column("doc_id"), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(n)], names=["doc_id", "high", "low", "n_words"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return plain.mapInArrow(run, "doc_id long, high long, low long, n_words int")


def hamming_codewords() -> np.ndarray:
    """The 4096 words of 16 bits whose first 15 bits have no parity error in the Hamming code of length 15."""
    v = np.arange(1 << 15)
    syndrome = np.zeros_like(v)
    for i in range(15):
        syndrome ^= np.where((v >> i) & 1, i + 1, 0)
    code = v[syndrome == 0]
    return np.sort(np.concatenate([code, code | (1 << 15)]))


def offset_partners() -> tuple[np.ndarray, list[np.ndarray]]:
    """(offset number of each 16-bit value or -1, offset numbers that each offset is compared with).

    Blocks A ^ u and A ^ v also meet under the anchor A ^ c, with offsets u ^ c and v ^ c, for each codeword c that leaves
    both within 2. Of these pairs of offsets the least, as an unordered pair, stands for all; a pair may equal itself
    under several anchors, if c = u ^ v, and then is compared under each of them.
    """
    flips = np.array(sorted([0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i in range(16) for j in range(i))], key=lambda x: (x.bit_count(), x)))
    number = np.full(1 << 16, -1, np.int16)
    number[flips] = np.arange(len(flips))
    code = hamming_codewords()
    code = code[np.bitwise_count(code) <= 4]
    partners = []
    for a, u in enumerate(flips.tolist()):
        mine = []
        for b, v in enumerate(flips.tolist()):
            if (u ^ v).bit_count() > TOLERANCE:
                continue
            x, y = number[code ^ u].astype(int), number[code ^ v].astype(int)
            both = (x >= 0) & (y >= 0)
            least = (np.minimum(x, y)[both] * 1000 + np.maximum(x, y)[both]).min()
            if min(a, b) * 1000 + max(a, b) == least:
                mine.append(b)
        partners.append(np.array(mine))
    return number, partners


_PARTNERS: list = []


def anchor_lists() -> tuple[np.ndarray, np.ndarray]:
    """CSR lists: the codewords within covering radius 1 plus half the tolerance, of each of the 65,536 blocks."""
    flips = [0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i in range(16) for j in range(i))]
    assert 1 + TOLERANCE // 2 == 2
    code = hamming_codewords()
    near = (code[:, None] ^ np.array(flips)[None, :]).ravel()
    anchor = np.repeat(code, len(flips))
    order = np.argsort(near, kind="stable")
    at = np.searchsorted(near[order], np.arange((1 << 16) + 1))
    return at, anchor[order]


def replicate(points: DataFrame) -> DataFrame:
    """(key, high, low, n_words, id): a row for each anchor of each block; key holds the block and the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors = anchor_lists()
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                high, low = (b.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
                keys, rows = [], []
                for k in range(BLOCKS):
                    block = ((high if k < 4 else low) >> np.uint64(16 * (k % 4))).astype(np.int64) & 0xFFFF
                    n = at[block + 1] - at[block]
                    row = np.repeat(np.arange(len(block)), n)
                    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    keys.append((anchors[at[block][row] + inside] | (k << 16)).astype(np.int32))
                    rows.append(row)
                row = np.concatenate(rows)
                yield pa.record_batch([pa.array(np.concatenate(keys))] + [b.column(c).take(pa.array(row)) for c in ("high", "low", "n_words", "id")], names=["key", "high", "low", "n_words", "id"])

    return points.mapInArrow(run, "key int, high long, low long, n_words int, id long")


def _candidates(high: np.ndarray, low: np.ndarray, top: np.ndarray, fresh: int, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, rows to compare them with), by tiles; both sorted."""
    size = len(high)
    step, wide = 256, 4096
    if size < APART:
        for a in range(0, size, step):
            b = min(size, a + step)
            lo, hi = max(a, fresh if b <= fresh else a), int(top[b - 1])
            for c in range(lo, hi, wide):
                yield np.arange(a, b), np.arange(c, min(hi, c + wide))
        return
    if not _PARTNERS:
        _PARTNERS.extend(offset_partners())
    number, partners = _PARTNERS
    k = key >> 16
    block = ((high if k < 4 else low) >> np.uint64(16 * (k % 4))).astype(np.int64) & 0xFFFF
    offset = number[block ^ (key & 0xFFFF)]
    order = np.argsort(offset, kind="stable")
    edge = np.searchsorted(offset[order], np.arange(len(partners) + 1))
    groups = [order[edge[g] : edge[g + 1]] for g in range(len(partners))]
    for g, rows in enumerate(groups):
        if not len(rows):
            continue
        others = np.sort(np.concatenate([groups[x] for x in partners[g]])) if len(partners[g]) else np.zeros(0, np.int64)
        others = others[np.searchsorted(others, fresh) :]  # the later of two rows is a fresh one
        narrow = max(8, min(step, len(rows) // 24))  # of like length, so that the window of the others is narrow
        for a in range(0, len(rows), narrow):
            part = rows[a : a + narrow]
            lo, hi = np.searchsorted(others, (part[0], top[part[-1]]))
            for c in range(lo, hi, wide):
                yield part, others[c : min(hi, c + wide)]


def _spanning(high: np.ndarray, low: np.ndarray, n: np.ndarray, ids: np.ndarray, fresh: int, out: list, key: int) -> None:
    """Edges that connect what matches among rows of one anchor sorted by n; pairs of two rows before fresh are known."""
    size = len(ids)
    label = np.arange(size)
    top = np.searchsorted(n, np.floor(n / LENGTH_RATIO + 1e-9), side="right")

    def root(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for rows, others in _candidates(high, low, top, fresh, key):
        dist = np.bitwise_count(high[rows, None] ^ high[None, others])
        dist += np.bitwise_count(low[rows, None] ^ low[None, others])
        i, j = np.nonzero(dist <= RADIUS)
        i, j = rows[i], others[j]
        ok = (i < j) & (j >= fresh) & (j < top[i])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        while True:  # labels of rows that were merged before
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        pairs = np.unique(np.stack([label[i], label[j]], axis=1), axis=0)
        for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            x, y = root(x), root(y)
            if x != y:
                label[max(x, y)] = min(x, y)
                out.append((ids[x], ids[y]))


def matches(replicas: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the same ids as all pairs within RADIUS and LENGTH_RATIO under some anchor do.

    Rows arrive sorted by anchor and length; only those of the current anchor whose length still allows a match are
    held, so a hot anchor is streamed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("key", "high", "low", "n_words", "id")]
            if not len(cols[0]):
                continue
            fresh_from = 0
            if held is not None and held[0][0] == cols[0][0]:
                fresh_from = len(held[0])
                cols = [np.concatenate(x) for x in zip(held, cols)]
            key, high, low, n, ids = cols
            high, low = high.view(np.uint64), low.view(np.uint64)
            edge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            out: list = []
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if e - s > 1:
                    _spanning(high[s:e], low[s:e], n[s:e], ids[s:e], fresh_from if s == 0 else 0, out, int(key[s]))
            s = int(edge[-2])
            s += int(np.searchsorted(n[s:], np.ceil(n[-1] * LENGTH_RATIO - 1e-9)))
            held = [c[s:].copy() for c in cols]
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return replicas.repartition("key").sortWithinPartitions("key", "n_words").mapInArrow(run, "u long, v long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) of each document that has a near duplicate; group_id is the smallest doc_id of its group.

    Two documents are near duplicates if their fingerprints are within RADIUS = 23 of 128 bits and the shorter has at
    least LENGTH_RATIO of the longer one's words; groups are the connected components. Documents without words, the
    empty one included, are duplicates only of documents with the same text. Null texts and null ids belong to no
    group. A doc_id that occurs in several rows is one document as to this result: its rows stand or fall together.
    A very long text is fingerprinted whole. An empty table has no groups. Ids are integers. Other columns are not
    looked at.
    """
    fp = fingerprints(docs, id_col, text_col)
    fp = cut(fp)
    # aggregates and joins rather than windows: a text with very many copies is combined on the map side, and its join split
    points = cut(fp.groupBy("high", "low", "n_words").agg(F.min("doc_id").alias("id")))
    found = components(matches(replicate(points.where("n_words > 0"))))
    groups = cut(points.join(found, F.col("id") == F.col("node"), "left").select("high", "low", "n_words", F.coalesce("root", "id").alias("group_id")))
    # a repeated doc_id with different texts may be in two groups; it then is in the lesser one
    grouped = cut(fp.join(groups, ["high", "low", "n_words"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id")))
    shared = grouped.groupBy("group_id").count().where("count > 1").select("group_id")
    return grouped.join(shared, "group_id").select("doc_id", "group_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are in a group but aren't its smallest doc_id. Rows without an id or text stay."""
    name = unused("gone", docs)
    gone = near_duplicate_groups(docs, id_col, text_col).where("doc_id <> group_id").select(F.col("doc_id").alias(name))
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
