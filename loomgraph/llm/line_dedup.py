"""Line dedup: an exact set-similarity self-join of all lines of a corpus, after which later matches are removed.

A line is the set of its words. Words are ordered by rarity: by the rounded logarithm of their number in the corpus, as
a one-row count sketch of SKETCH slots has it, then by hash. Any total order gives exact results; the sketch has a fixed
size, so it can be broadcast however large the corpus is. Its counts are never too low: a word whose slot counts 1
occurs once and needs no posting.

1. Postings of each line's prefix go to the words (prefix filter). Under a word, lines of equal sets collapse to the
   earliest, whose later copies are removed; the others are tested by length, position and a 64-bit parity bitmap, whose
   distance is at most that of the sets. Lines that pass with some partner are candidates. A line of fewer than SHORT
   words matches equal sets only, so it goes to its set's hash instead of to a word. The postings of a word that counts
   HOT or more are split by bands of length, of which a line is in two, so that no task gets all lines of such a word.
2. Candidates' postings go to the words again, now with their sets, and a line is removed as soon as an earlier one
   with a Jaccard similarity of at least NUM / DEN is verified; copies in large groups so cost one verification each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.state import cut, sized, table, unused
from loomgraph.llm.text import lowered, mix, rows_of, slices, words_of

#: Jaccard similarity from which lines match.
NUM, DEN = 9, 10
SKETCH_BITS = 22
SKETCH = 1 << SKETCH_BITS
#: Words of a line from which another set can be similar enough: one word more, or one replaced.
SHORT = -(-NUM // (DEN - NUM))
#: Occurrences of a word in the corpus from which its postings are split by length.
HOT = 1 << 15
#: Lines that match are in the same band or in adjacent ones; a little wider than need be, as logarithms are rounded.
BAND = float(np.log(DEN / NUM) * 1.001)
#: Most affected lines, of all documents, that are broadcast; beyond it the join is shuffled.
BROADCAST_LINES = 1_000_000


def rarity(docs: DataFrame) -> np.ndarray:
    """For each slot of the sketch, 0 if it counts one word, else 8 times the binary logarithm of its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                slot = (words_of(*lowered(b.column("text")))[2] & np.uint64(SKETCH - 1)).astype(np.int64)
                np.add.at(total, slot, 1)
        slot = np.flatnonzero(total)
        for lo in range(0, len(slot), 1 << 16):
            part = slot[lo : lo + (1 << 16)]
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["slot", "n"])

    counts = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = counts.select("slot", F.least(F.lit(255), F.floor(F.log2("n") * 8)).cast("short").alias("q")).toArrow()
    out = np.zeros(SKETCH, dtype=np.uint8)
    out[got.column("slot").to_numpy()] = got.column("q").to_numpy()
    return out


class Lines:
    """The lines of some texts that have words: text row, number, and sorted set of words as (rarity, hash) ranks."""

    def __init__(self, text: pa.Array, rare: np.ndarray):
        data, offsets = lowered(text)
        start, _, h = words_of(data, offsets)
        row = rows_of(start, offsets)
        breaks = np.flatnonzero(data == 10)
        before = np.searchsorted(breaks, offsets[:-1])
        line = np.searchsorted(breaks, start)
        rank = (rare[(h & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
        spot = line + row
        if len(spot) and spot[-1] < 1 << 22:
            order = np.argsort((spot.astype(np.uint64) << np.uint64(42)) | (rank >> np.uint64(22)))
            # the few whose truncated ranks are equal have to be put in order
            s, r = spot[order], rank[order]
            if ((s[1:] == s[:-1]) & (r[1:] < r[:-1])).any():
                order = np.lexsort((rank, spot))
        else:
            order = np.lexsort((rank, spot))
        spot, rank, h = spot[order], rank[order], h[order]
        new = np.ones(len(rank), dtype=bool)
        new[1:] = (rank[1:] != rank[:-1]) | (spot[1:] != spot[:-1])
        spot, self.rank, h, order = spot[new], rank[new], h[new], order[new]
        self.first = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1]))) if len(spot) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, len(spot)))
        one = order[self.first]
        self.row = row[one]
        self.number = line[one] - before[self.row]
        if len(self.first):
            with np.errstate(over="ignore"):
                self.set_hash = np.add.reduceat(mix(h, 5), self.first)
            self.bitmap = np.bitwise_xor.reduceat(np.uint64(1) << (mix(h, 6) >> np.uint64(58)), self.first)
        else:
            self.set_hash = self.bitmap = np.zeros(0, np.uint64)

    def prefix(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, position, key) of each posting of the chosen lines; words that occur once have none."""
        n = self.size[chosen]
        p = n - -(-n * NUM // DEN) + 1
        at = np.repeat(chosen, p)
        position = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        rank = self.rank[self.first[at] + position]
        count = rank >> np.uint64(56)
        at, position, rank, count = at[count > 0], position[count > 0], rank[count > 0], count[count > 0]
        short = self.size[at] < SHORT
        key = np.where(short, mix(self.set_hash[at], 8), mix(rank, 9))
        hot = np.flatnonzero((count >= np.uint64(8 * np.log2(HOT))) & ~short)
        if len(hot):
            band = (np.log(self.size[at[hot]]) / BAND).astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                lower, upper = (mix(rank[hot] + mix(band + np.uint64(k), 10), 9) for k in (0, 1))
            key[hot] = lower
            at, position, key = np.append(at, at[hot]), np.append(position, position[hot]), np.append(key, upper)
        return at, position, key


def _passes(n1, n2, p1, p2, b1, b2) -> np.ndarray:
    """Length, positional and bitmap filters for pairs that share the words at positions p1 and p2."""
    total = n1 + n2
    overlap = -(-NUM * total // (NUM + DEN))
    lengths = np.minimum(n1, n2) * DEN >= np.maximum(n1, n2) * NUM
    room = 1 + np.minimum(p1, p2) + np.minimum(n1 - p1, n2 - p2) - 1
    return lengths & (room >= overlap) & (np.bitwise_count(b1 ^ b2) <= total - 2 * overlap)


def _grouped(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches sorted by word, put together so that none ends within a word's rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = whole.column("word").to_numpy()
        end = int(np.searchsorted(key, key[-1]))
        if end:
            yield whole.slice(0, end)
            held = [whole.slice(end)]
            rows = whole.num_rows - end
            least = max(1 << 16, 2 * rows)
        else:
            held, least = [whole], 2 * rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _copies_and_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by word, size, set, document and line."""
    for b in _grouped(batches):
        word, doc, line, n, pos, sets, bits = (b.column(c).to_numpy() for c in ("word", "doc_id", "line", "n", "pos", "set_hash", "bitmap"))
        same = np.zeros(len(word), dtype=bool)
        same[1:] = (word[1:] == word[:-1]) & (n[1:] == n[:-1]) & (sets[1:] == sets[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(word))))
        again = same & (pos == 0) & ((doc != doc[head]) | (line != line[head]))
        keep = np.flatnonzero(~same)
        word, n, pos, bits = word[keep], n[keep].astype(np.int64), pos[keep].astype(np.int64), bits[keep].view(np.uint64)
        marked = np.zeros(len(word), dtype=bool)
        group = np.concatenate(([0], np.cumsum(word[1:] != word[:-1])))
        left = np.arange(len(word))
        for lag in range(1, len(word)):
            left = left[left + lag < len(word)]
            if lag & (lag - 1) == 0:  # now and then the words go all of whose lines are marked
                left = left[np.bincount(group, ~marked)[group[left]] > 0]
            other = left + lag
            ok = (word[left] == word[other]) & (n[left] * DEN >= n[other] * NUM)
            left, other = left[ok], other[ok]
            if not len(left):
                break
            todo = ~(marked[left] & marked[other])
            i, j = left[todo], other[todo]
            hit = _passes(n[i], n[j], pos[i], pos[j], bits[i], bits[j])
            marked[i[hit]] = marked[j[hit]] = True
        chosen = keep[marked]
        at = np.concatenate([np.flatnonzero(again), chosen])
        copy = np.arange(len(at)) < again.sum()
        yield pa.record_batch([pa.array(doc[at]), pa.array(line[at]), pa.array(copy)], names=["doc_id", "line", "copy"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From candidates' postings sorted by word, document and line."""
    for b in _grouped(batches, 1 << 13):
        word, doc, line, n, pos, bits = (b.column(c).to_numpy() for c in ("word", "doc_id", "line", "n", "pos", "bitmap"))
        n, pos, bits = n.astype(np.int64), pos.astype(np.int64), bits.view(np.uint64)
        sets = b.column("words")
        held: dict[int, np.ndarray] = {}

        def words(k: int) -> np.ndarray:
            if k not in held:
                held[k] = np.frombuffer(sets[k].as_buffer(), dtype=np.uint64)
            return held[k]

        gone = np.zeros(len(word), dtype=bool)
        left = np.arange(len(word))
        for lag in range(1, len(word)):
            left = left[(left >= lag) & ~gone[left]]
            left = left[word[left] == word[left - lag]]
            if not len(left):
                break
            i = left - lag
            hit = _passes(n[i], n[left], pos[i], pos[left], bits[i], bits[left]) & ((doc[i] != doc[left]) | (line[i] != line[left]))
            for x in left[hit].tolist():
                both = len(np.intersect1d(words(x), words(x - lag), assume_unique=True))
                gone[x] = both * DEN >= (n[x] + n[x - lag] - both) * NUM
        yield pa.record_batch([pa.array(doc[gone]), pa.array(line[gone])], names=["doc_id", "line"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line) of each line, numbered from 0, that matches an earlier one, by document and then by line.

    Lines match if the Jaccard similarity of their sets of words is at least NUM / DEN; it is of no account whether the
    earlier line is itself removed. Lines without words match nothing. Lines of rows without an id or text aren't
    looked at. Rows of equal doc_id hold the same line at the same place, neither of which is earlier. An empty table
    has no matches. A very long text is read whole, and a very long line is a set like any other. Ids are integers.
    Other columns are not looked at.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(rarity(plain))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                x = Lines(b.column("text"), shared.value)
                at, position, key = x.prefix(np.arange(len(x.first)))
                doc = b.column("doc_id").to_numpy()[x.row]
                cols = (key.view(np.int64), doc[at], x.number[at].astype(np.int32), x.size[at].astype(np.int32), position.astype(np.int32), x.set_hash[at].view(np.int64), x.bitmap[at].view(np.int64))
                yield pa.record_batch([pa.array(c) for c in cols], names=["word", "doc_id", "line", "n", "pos", "set_hash", "bitmap"])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                x = Lines(b.column("text"), shared.value)
                wanted = b.column("lines")
                rows = np.repeat(np.arange(b.num_rows), np.diff(wanted.offsets.to_numpy()))
                pairs = (rows.astype(np.int64) << 32) | wanted.flatten().to_numpy()
                chosen = np.flatnonzero(np.isin((x.row.astype(np.int64) << 32) | x.number, pairs))
                at, position, key = x.prefix(chosen)
                doc = b.column("doc_id").to_numpy()[x.row]
                sets = {k: x.rank[x.first[k] : x.first[k] + x.size[k]].tobytes() for k in chosen.tolist()}
                cols = (key.view(np.int64), doc[at], x.number[at].astype(np.int32), x.size[at].astype(np.int32), position.astype(np.int32), x.bitmap[at].view(np.int64))
                yield pa.record_batch([*(pa.array(c) for c in cols), pa.array([sets[k] for k in at.tolist()], pa.binary())], names=["word", "doc_id", "line", "n", "pos", "bitmap", "words"])

    order = ["word", "n", "set_hash", "doc_id", "line"]
    found = plain.mapInArrow(postings, "word long, doc_id long, line int, n int, pos int, set_hash long, bitmap long").repartition("word").sortWithinPartitions(*order).mapInArrow(_copies_and_candidates, "doc_id long, line int, copy boolean")
    found = cut(found)
    wanted = found.where("not copy").groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    wanted = cut(wanted)
    total = wanted.agg(F.sum(F.size("lines"))).first()[0] or 0
    again = plain.join(sized(wanted, total, BROADCAST_LINES), "doc_id").select("doc_id", "text", "lines")
    near = again.mapInArrow(with_sets, "word long, doc_id long, line int, n int, pos int, bitmap long, words binary").repartition("word").sortWithinPartitions("word", "doc_id", "line").mapInArrow(_verified, "doc_id long, line int")
    return found.where("copy").select("doc_id", "line").union(near).distinct()


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with those lines taken out of their texts; every row stays, if only with an empty text.

    A column n_chars, if there is one, gets the length of a text that changed. See repeated_lines() for the rest.
    """
    of, lines = unused("of", docs), unused("lines", docs)
    gone = cut(repeated_lines(docs, id_col, text_col).groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("line").alias(lines)))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(lines, i)), "\n")
    total = gone.agg(F.sum(F.size(lines))).first()[0] or 0
    out = docs.join(sized(gone, total, BROADCAST_LINES), docs[id_col].cast("long") == F.col(of), "left")
    out = out.withColumn(text_col, F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lines).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.drop(of, lines)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs)


#: Both sides take words as runs of ASCII letters and digits and of other characters beyond ASCII.
ORACLE = r"""
with lines as (
  select doc_id, unnest(range(len(parts)))::int as line, unnest(parts) as body
  from (select doc_id, string_split(text, chr(10)) as parts from documents)),
sets as (
  select doc_id, line, list_distinct(regexp_extract_all(lower(body), '[0-9a-z\x{80}-\x{10FFFF}]+')) as s from lines),
firsts as (
  select list_sort(s) as s, len(s) as n, min((doc_id, line)) as o, row_number() over () as id from sets where len(s) > 0 group by 1, 2),
words as (select id, n, unnest(s) as w from firsts),
rank as (select w, count(*) as c from words group by w),
ordered as (select id, n, w, row_number() over (partition by id order by c, w) as pos from words join rank using (w)),
prefix as (select id, n, w from ordered where pos <= n - ceil(n * 9 / 10.0) + 1),
pairs as (
  select distinct a.id as x, b.id as y from prefix a join prefix b on a.w = b.w and a.id < b.id
  and least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 9),
scored as (
  select a.o as ao, b.o as bo, a.id as ai, b.id as bi, len(list_intersect(a.s, b.s)) as common, a.n + b.n as total
  from pairs join firsts a on a.id = x join firsts b on b.id = y),
later as (select distinct case when ao > bo then ai else bi end as id from scored where common * 10 >= (total - common) * 9),
gone as (
  select s.doc_id, s.line from sets s join firsts f on list_sort(s.s) = f.s
  where (s.doc_id, s.line) > f.o or f.id in (select id from later)),
kept as (select l.* from lines l anti join gone g on l.doc_id = g.doc_id and l.line = g.line)
select d.doc_id, coalesce(string_agg(k.body, chr(10) order by k.line), '') as text
from documents d left join kept k using (doc_id) group by d.doc_id
"""
