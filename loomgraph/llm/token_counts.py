"""Token counts by a two-tier look-up on the map side, without a shuffle of pre-tokens.

First tier: a broadcast open-addressing table of hash and length, in tokens, of the FREQUENT most frequent pre-tokens.
Each task counts all its pre-tokens and hands on its CANDIDATES most frequent ones, from whose sums the table is made;
its size is fixed. Second tier: what the table lacks is looked up in a cache of the Python worker, and encoded where that
lacks it too. Either tier gives exact lengths; the table only saves work.

The counts behind the table are approximate: pre-tokens that occur once in a slice aren't counted, a task that holds very
many drops the rarer half, and it hands on CANDIDATES only. Texts of over LARGE bytes aren't counted for the table, and
bypass both tiers: they are encoded whole, which gives the same numbers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bpe import VOCABULARY, Bpe, bpe
from loomgraph.llm.state import table
from loomgraph.llm.text import mix, slices, string_parts

FREQUENT = 1 << 16
CANDIDATES = 1 << 12
CACHE = 1 << 19
#: A text of more bytes is encoded piecewise rather than looked up.
LARGE = 8 << 20
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_state: dict = {}


def classes() -> np.ndarray:
    """The class of each code point, as the vocabulary's pattern tells them apart."""
    if "classes" not in _state:
        kinds = {"L": _LETTER, "N": _NUMBER}
        out = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], dtype=np.uint8)
        out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _state["classes"] = out
    return _state["classes"]


def pretokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts of pre-tokens with the end appended, offset of each text in code points with the end)."""
    data, at = string_parts(text)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    offsets = lead[at]
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(code)
    if not n:
        return code, np.zeros(1, np.int64), offsets
    kind = classes()[code]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    start = border.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start[:n])
    after = np.append(run[1:], n)
    # white space before something else: its last character stands alone or, if it is a blank, goes with what follows
    inner = (kind[run] == _SPACE) & ~border[after]
    last = after[inner] - 1
    start[last] = True
    start[after[inner]] = code[last] != 0x20
    # contractions
    single = run[(code[run] == 39) & (after - run == 1)]
    single = single[start[single] & (single + 1 < n)]
    single = single[~border[single + 1]]
    c1 = code[single + 1]
    one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
    c2 = np.where(single + 2 < n, code[np.minimum(single + 2, n - 1)], 0)
    two = (((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108)) & ~border[np.minimum(single + 2, n)]
    for chosen, size in ((single[one], 2), (single[two], 3)):
        start[chosen + 1] = False
        rest = chosen[chosen + size < n] + size
        start[rest[kind[rest] == _LETTER]] = True
    start[n] = True
    return code, np.flatnonzero(start), offsets


def hashed(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of code points between starts."""
    n = len(code)
    if len(starts) < 2:
        return np.zeros(0, np.uint64)
    if "powers" not in _state or len(_state["powers"][0]) <= n:
        base = 0x9E3779B97F4A7C15
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            factors = np.full(max(n, 1 << 21) + 1, b, dtype=np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        _state["powers"] = tuple(made)
    power, inverse = _state["powers"]
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[:n])))
        return mix((total[starts[1:]] - total[starts[:-1]]) * inverse[starts[:-1]] + np.diff(starts).astype(np.uint64))


class Table:
    """Hash to length, open addressing with linear probing, at most half full."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        self.mask = (1 << max(4, int(2 * max(1, len(keys))).bit_length())) - 1
        self.keys, self.lengths = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        for k, v in zip(keys.tolist(), lengths.tolist()):
            at = k & self.mask
            while self.lengths[at]:
                at = (at + 1) & self.mask
            self.keys[at], self.lengths[at] = k, v

    def find(self, h: np.ndarray) -> np.ndarray:
        """The lengths; 0 for what isn't there."""
        out = np.zeros(len(h), np.int32)
        left, at = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            here = self.lengths[at]
            same = (self.keys[at] == h[left]) & (here > 0)
            out[left[same]] = here[same]
            on = ~same & (here > 0)
            left, at = left[on], (at[on] + 1) & self.mask
        return out


def _strings(code: np.ndarray, starts: np.ndarray, which: np.ndarray) -> list[str]:
    return [code[starts[i] : starts[i + 1]].tobytes().decode("utf-32-le") for i in which.tolist()]


def frequent(docs: DataFrame) -> DataFrame:
    """(pretoken, n) of the FREQUENT pre-tokens of the largest sums over the tasks' lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                if b.column("text").nbytes > LARGE:
                    continue  # encoded piecewise anyway
                code, starts, _ = pretokens(b.column("text"))
                h, first, n = np.unique(hashed(code, starts), return_index=True, return_counts=True)
                often = n > 1
                for k, i, c in zip(h[often].tolist(), first[often].tolist(), n[often].tolist()):
                    if k in total:
                        total[k][0] += c
                    else:
                        total[k] = [c, code[starts[i] : starts[i + 1]].tobytes()]
                if len(total) > 1 << 18:  # the rarer half goes; what is frequent comes again
                    middle = sorted(c for c, _ in total.values())[len(total) // 2]
                    total = {k: v for k, v in total.items() if v[0] > middle}
        best = sorted(total.items(), key=lambda x: (-x[1][0], x[0]))[:CANDIDATES]
        yield pa.record_batch([pa.array([v[1].decode("utf-32-le") for _, v in best], pa.string()), pa.array([v[0] for _, v in best], pa.int64())], names=["pretoken", "n"])

    lists = docs.select("text").mapInArrow(run, "pretoken string, n long")
    return lists.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(FREQUENT)


def make_table(words: list[str], b: Bpe) -> Table:
    if not words:
        return Table(np.zeros(0, np.uint64), np.zeros(0, np.int32))
    code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    return Table(hashed(code, starts), np.array([len(b.tree(w.encode())) for w in words], np.int32))


def counts(text: pa.Array, known: Table, b: Bpe, cache: dict[int, int]) -> np.ndarray:
    if text.nbytes > LARGE:
        return np.array([len(b.encode(t)) for t in text.to_pylist()], np.int64)
    code, starts, offsets = pretokens(text)
    h = hashed(code, starts)
    length = known.find(h)
    missing = np.flatnonzero(length == 0)
    if len(missing):
        values, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
        got = np.array([cache.get(k, 0) for k in values.tolist()], np.int32)
        for i in np.flatnonzero(got == 0).tolist():
            at = missing[first[i]]
            got[i] = len(b.tree(code[starts[at] : starts[at + 1]].tobytes().decode("utf-32-le").encode()))
            if len(cache) >= CACHE:
                cache.clear()
            cache[int(values[i])] = int(got[i])
        length[missing] = got[back]
    total = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
    return np.diff(total[np.searchsorted(starts, offsets)])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): the number of tokens of each row's whole text; 0 for an empty text, null for a null one.

    Rows may repeat and ids may be null. Strings that name special tokens are ordinary text. An empty table gives no
    rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = [r[0] for r in frequent(rows).collect()]  # FREQUENT rows at most
    shared = docs.sparkSession.sparkContext.broadcast(make_table(words, bpe(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, cache = bpe(path), _state.setdefault(("cache", path), {})
        for whole in batches:
            for part in slices(whole, "text"):
                text = part.column("text")
                n = counts(text, shared.value, b, cache)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64(), mask=text.is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
