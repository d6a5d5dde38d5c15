"""BPE encoding and decoding, with tree concatenation of long texts.

A text of up to SPLIT_CHARS characters is encoded in one go. A longer one is cut into pieces of PIECE_CHARS characters,
wherever that falls, which tasks encode in parallel; neighbours are then concatenated in a tree. At each join the last
pre-token of the left side and a growing number of the right side's are encoded anew, until a pre-token ends where one
of the right side does: from there on both agree exactly, as they do before. Pre-tokens of more than LEAF_BYTES bytes
are themselves encoded as a tree of halves; at their joins windows of tokens grow on both sides until the window's first
and last tokens are those that stood there before. A token sequence whose neighbours are all compatible is the BPE
encoding of its bytes, so that agreement at both ends proves the whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.state import table
from loomgraph.llm.text import slices, string_parts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokens of that vocabulary; white space is spelled out, as libraries differ in what \s means.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT_CHARS = 32_768
PIECE_CHARS = 16_384
LEAF_BYTES = 1024
#: Characters from its start that may decide where a pre-token ends besides its own and the next: those of 'll.
LOOKAHEAD = 3


class Bpe:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))

    def whole(self, piece: bytes) -> list[int]:
        return self.core._encode_single_piece(piece)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring byte strings, of which left and right are the encodings."""
        w = 1
        while True:
            a, b = left[-w:], right[:w]
            middle = self.whole(b"".join(self.bytes[t] for t in a) + b"".join(self.bytes[t] for t in b))
            if (w >= len(left) or middle[0] == a[0]) and (w >= len(right) or middle[-1] == b[-1]):
                return left[: len(left) - len(a)] + middle + right[len(b) :]
            w *= 2

    def tree(self, piece: bytes, leaf: int = LEAF_BYTES) -> list[int]:
        """The encoding of one pre-token, however long."""
        parts = [self.whole(piece[i : i + leaf]) for i in range(0, len(piece), leaf)]
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode(self, text: str, long_run: bool = True) -> list[int]:
        """The encoding of a text; long_run False vouches that no pre-token exceeds LEAF_BYTES."""
        if not long_run:
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self.tree(m.group().encode())
        return out

    def decode(self, tokens: list[int]) -> str:
        return self.core.decode_bytes(tokens).decode("utf-8")

    def concatenate(self, left: Piece, right: Piece) -> Piece:
        """The piece of two neighbouring texts."""
        if not left.text or not right.text:
            return left if left.text else right
        last = left.last_pretoken(self)
        head = left.text[last:]
        ends = (m.end() for m in self.pattern.finditer(right.text))
        taken, window = [], 4
        while True:
            for _, e in zip(range(window), ends):
                taken.append(e)
            everything = taken[-1] == len(right.text)
            text = head + right.text[: taken[-1]]
            known = {len(head) + e for e in taken}
            found = [m.end() for m in self.pattern.finditer(text)]
            # an end is certain if a pre-token and LOOKAHEAD characters follow it in the window, or nothing follows at all
            meet = next((e for e in found if e in known and (everything or e + LOOKAHEAD <= len(text) and e < found[-1])), None)
            if meet is not None:
                break
            window *= 2
        before = left.tokens[: left.tokens_to(self, last)]
        after = right.tokens[right.tokens_to(self, meet - len(head)) :]
        first = taken[0]
        if found[0] == len(head) + first == meet and len(text[:meet].encode()) > LEAF_BYTES:
            middle = self.join(left.tokens[len(before) :], right.tokens[: len(right.tokens) - len(after)])
        else:
            cuts = [0, *(e for e in found if e <= meet)]
            middle = [t for s, e in zip(cuts, cuts[1:]) for t in self.tree(text[s:e].encode())]
        return Piece(left.text + right.text, before + middle + after)


class Piece:
    def __init__(self, text: str, tokens: list[int]):
        self.text, self.tokens = text, tokens

    def last_pretoken(self, bpe: Bpe) -> int:
        """The last place where a pre-token starts whatever follows the text; those before it are final.

        Looks back from the end to a place where one ends in any context.
        """
        span = 256
        while True:
            at = max(0, len(self.text) - span)
            start = at
            if at:
                m = _CERTAIN.search(self.text, at)
                start = m.end() if m and m.end() < len(self.text) else -1
            if start >= 0:
                last = start
                for m in bpe.pattern.finditer(self.text, start):
                    last = m.start()
                    if last + LOOKAHEAD > len(self.text):
                        break
                return last
            span *= 4

    def tokens_to(self, bpe: Bpe, chars: int) -> int:
        """How many tokens there are before a character at which a pre-token starts, counted from the nearer end."""
        if chars * 2 <= len(self.text):
            want, n, k = len(self.text[:chars].encode()), 0, 0
            while n < want:
                n += len(bpe.bytes[self.tokens[k]])
                k += 1
            return k
        want, n, k = len(self.text[chars:].encode()), 0, len(self.tokens)
        while n < want:
            k -= 1
            n += len(bpe.bytes[self.tokens[k]])
        return k


#: After a letter that no letter follows, or a digit that no digit follows, a pre-token ends whatever came before.
_CERTAIN = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")

_loaded: dict[str, Bpe] = {}


def bpe(path: str = VOCABULARY) -> Bpe:
    """The vocabulary's encoder, one per Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def long_runs(text: pa.Array) -> np.ndarray:
    """Whether each text has more than LEAF_BYTES bytes in a row that all are, or all aren't, ASCII white space."""
    data, offsets = string_parts(text)
    out = np.zeros(len(text), dtype=bool)
    if len(data):
        space = (data <= 32) & ((data == 32) | (data >= 9) & (data <= 13))
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = np.unique(np.concatenate((change, offsets)))
        run = np.flatnonzero(np.diff(edge) > LEAF_BYTES)
        out[np.searchsorted(offsets, edge[run], side="right") - 1] = True
    return out


def _lists(tokens: list) -> pa.Array:
    sizes = np.fromiter((len(t) for t in tokens if t is not None), np.int64)
    full = np.zeros(len(tokens) + 1, np.int32)
    here = np.array([t is not None for t in tokens], dtype=bool)
    full[1:][here] = sizes
    flat = np.fromiter((x for t in tokens if t is not None for x in t), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(full, dtype=np.int32)), pa.array(flat), mask=pa.array(~here))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip), one row for each row of docs.

    tokens are those of the whole text encoded at once, however long it is; round_trip says that decoding gives the text
    back. An empty text has no tokens; a null one has null tokens, null n_tokens and null round_trip. Strings that name
    special tokens are ordinary text. Rows may repeat, and ids may be null. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.length("text") > SPLIT_CHARS

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for whole in batches:
            for part in slices(whole, "text"):
                long_run = long_runs(part.column("text"))
                texts = part.column("text").to_pylist()
                tokens = [None if t is None else b.encode(t, r) for t, r in zip(texts, long_run.tolist())]
                n = pa.array([None if t is None else len(t) for t in tokens], pa.int32())
                same = pa.array([None if t is None else b.decode(k) == t for t, k in zip(texts, tokens)], pa.bool_())
                yield pa.record_batch([part.column("doc_id"), n, _lists(tokens), same], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k, t in zip(whole.column("key").to_pylist(), whole.column("text").to_pylist()):
                parts = [t[i : i + PIECE_CHARS] for i in range(0, len(t), PIECE_CHARS)]
                yield pa.record_batch([pa.array([k] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts)], names=["key", "piece", "text"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        for whole in batches:
            for part in slices(whole, "text"):
                tokens = [b.encode(t, r) for t, r in zip(part.column("text").to_pylist(), long_runs(part.column("text")).tolist())]
                yield pa.record_batch([*part.columns, _lists(tokens)], names=["key", "piece", "text", "tokens"])

    def joined(group: pa.Table) -> pa.Table:
        b = bpe(path)
        group = group.sort_by("piece")
        parts = [Piece(t, k) for t, k in zip(group.column("text").to_pylist(), group.column("tokens").to_pylist())]
        while len(parts) > 1:
            parts = [b.concatenate(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        same = b.decode(parts[0].tokens) == parts[0].text
        return pa.table({"key": group.column("key")[:1], "n_tokens": pa.array([len(parts[0].tokens)], pa.int32()), "tokens": _lists([parts[0].tokens]), "round_trip": pa.array([same])})

    long_rows = rows.where(is_long).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    parts = long_rows.select("key", "text").mapInArrow(pieces, "key string, piece int, text string").dropDuplicates(["key", "piece"])
    found = parts.mapInArrow(encoded, "key string, piece int, text string, tokens array<int>").groupBy("key").applyInArrow(joined, "key string, n_tokens int, tokens array<int>, round_trip boolean")
    kind = "doc_id long, n_tokens int, tokens array<int>, round_trip boolean"
    return rows.where(~F.coalesce(is_long, F.lit(False))).mapInArrow(short, kind).union(long_rows.select("doc_id", "key").join(found, "key").select("doc_id", "n_tokens", "tokens", "round_trip"))


def decode(tokens: DataFrame, tokens_col: str = "tokens", out_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """tokens with a column of the texts that its lists of ids stand for; null for a null list.

    Ids that the vocabulary lacks are an error. Bytes that aren't UTF-8, as a cut list may have, become U+FFFD.
    """

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        b = bpe(path)
        return pa.array([None if t is None else b.core.decode_bytes(t).decode("utf-8", "replace") for t in ids.to_pylist()], pa.string())

    return tokens.withColumn(out_col, text(F.col(tokens_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), path=os.environ.get("LOOMGRAPH_VOCABULARY", VOCABULARY))
