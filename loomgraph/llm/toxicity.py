"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: density of each lexicon category, how near hits are to a second-person pronoun, hits' local concentration,
share of capitals and of words in capitals, rates of exclamation marks, question marks, repeated and other marks, and
rates of obfuscated spelling (letters replaced by digits or signs, words spelled letter by letter).

A hand-written lexicon knows a few words of a few languages. Two more are learned from the labelled rows, of words and
of stems (a word's first STEM bytes): those that toxic documents hold more often than others, weighted by the smoothed
logarithm of the odds. Their density, number, nearness to a pronoun, concentration and highest weight are features too.
A labelled row is described by lexicons that were learned without its fold, so that it doesn't vouch for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.gbt import Boosted, fit, isotonic
from loomgraph.llm.state import cut, table, unused
from loomgraph.llm.text import lowered, mix, rows_of, slices, string_parts, words_of

#: Bound on the labelled rows that the classifier is fitted on: those whose doc_id has the smallest hash.
TRAIN_ROWS = 20_000
#: Calibrated probability from which a document is toxic.
THRESHOLD = 0.5
NEAR = 5
#: Parts of the labelled rows; each is described by lexicons that are learned from the others.
FOLDS = 5
#: Bytes of a word that are its stem; shorter words have none.
STEM = 4
#: Fewest toxic documents of a learned entry, and how many standard errors its log-odds are above 0 at least.
LEAST_TOXIC, LEAST_Z = 3, 2.0
#: Added to each count before the odds are taken.
SMOOTHING = 0.5

LEXICON = {
    "insult": "idiot idiots moron morons loser losers clown clowns scum trash stupid pathetic worthless disgusting imbecile imbeciles cretin dimwit dumb dumbass fool freak creep pig swine vermin lowlife scumbag halfwit nitwit retard retarded coward liar garbage ugly "
    "idiote idiotes imbécile crétin débile abruti connard connasse salope ordure dégueulasse idiotin dummkopf trottel arschloch depp schwachkopf abschaum drecksau idiota idiotas estúpido estúpida imbécil tonto basura escoria asqueroso asquerosa gilipollas",
    "profanity": "fuck fucking fucked fucker shit shitty bullshit crap bitch bitches bastard bastards asshole assholes ass damn damned dick prick cunt piss pissed whore slut putain merde bordel scheiße scheisse verdammt mierda joder puta cabrón coño",
    "threat": "kill killed strangle stab shoot murder slaughter destroy exterminate eradicate rape smash despise loathe tuer crever töten umbringen sterben matar morir",
}
SECOND_PERSON = "you your yours yourself yourselves ya u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer tú ti tus usted ustedes vosotros vuestro"
FEATURES = [*(f"{c}_density" for c in LEXICON), "any_hits_log", "local_hits", "second_person_density", "hits_near_you", "nearness", "capital_share", "capital_words", "exclamations", "questions", "repeated_marks", "other_marks", "obfuscated_density", "spelled_density", "mixed_words", "words_log", "word_length"]
LEARNED = [f"{kind}_{what}" for kind in ("word", "stem") for what in ("density", "weight_log", "hits_log", "near_you", "local", "highest", "surest")]
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$", b"oieastas"):
    _LEET[_a] = _b


def hashes(words: str) -> np.ndarray:
    data, offsets = lowered(pa.array(words.split()))
    return np.unique(words_of(data, offsets)[2])


class Words:
    def __init__(self) -> None:
        self.categories = [hashes(w) for w in LEXICON.values()]
        self.all = np.unique(np.concatenate(self.categories))
        self.you = hashes(SECOND_PERSON)
        self.plain = {w for line in LEXICON.values() for w in line.split()}


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), dtype=bool)
    p = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[p] == h


def _nearest(at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distance of each position to the nearest of other, both sorted."""
    if not len(other):
        return np.full(len(at), 1 << 30)
    p = np.searchsorted(other, at)
    left = np.abs(at - other[np.maximum(p - 1, 0)])
    return np.minimum(left, np.abs(other[np.minimum(p, len(other) - 1)] - at))


class Parsed:
    """The words of some texts: bytes, place, hash, row and the hash of the stem, 0 where there is none."""

    def __init__(self, text: pa.Array):
        self.n = len(text)
        self.data, self.offsets = lowered(text)
        self.start, self.end, self.words = words_of(self.data, self.offsets)
        self.row = rows_of(self.start, self.offsets)
        self.count = np.bincount(self.row, minlength=self.n)
        self.stems = np.zeros(len(self.start), np.uint64)
        long = np.flatnonzero(self.end - self.start >= STEM)
        head = np.zeros(len(long), np.uint64)
        for i in range(STEM):
            head = (head << np.uint64(8)) | self.data[self.start[long] + i].astype(np.uint64)
        self.stems[long] = mix(head, 11) | np.uint64(1)

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.words, self.stems


@dataclass
class Lexicon:
    """Learned entries: sorted hashes, their log-odds and those in standard errors."""

    known: np.ndarray
    weight: np.ndarray
    sureness: np.ndarray


def lexicon(known: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Lexicon:
    """The entries worth keeping, from sorted hashes and the numbers of toxic and clean documents that hold each."""
    a = SMOOTHING
    weight = np.log((toxic + a) / (n_toxic + 2 * a)) - np.log((clean + a) / (n_clean + 2 * a))
    sureness = weight / np.sqrt(1 / (toxic + a) + 1 / (clean + a))
    kept = (toxic >= LEAST_TOXIC) & (sureness >= LEAST_Z)
    return Lexicon(known[kept], weight[kept], sureness[kept])


def occurrences(p: Parsed) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for stems (row, hash), each pair once."""
    out = []
    for h in p.kinds():
        order = np.lexsort((h, p.row))
        row, h = p.row[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        new &= h != 0
        out.append((row[new], h[new]))
    return out


def learned_features(p: Parsed, lexicons: tuple[Lexicon, Lexicon], words: Words) -> np.ndarray:
    per_word = 100 / np.maximum(p.count, 1)
    place = np.arange(len(p.row)) + p.row * 1000
    you = place[_in(p.words, words.you)]
    columns = []
    for h, x in zip(p.kinds(), lexicons):
        highest, surest, local = np.zeros(p.n), np.zeros(p.n), np.zeros(p.n)
        hit = np.flatnonzero(_in(h, x.known))
        at, row = place[hit], p.row[hit]
        which = np.searchsorted(x.known, h[hit])
        weight = np.bincount(row, x.weight[which], minlength=p.n)
        close = np.bincount(row, _nearest(at, you) <= NEAR, minlength=p.n)
        np.maximum.at(highest, row, x.weight[which])
        np.maximum.at(surest, row, x.sureness[which])
        np.maximum.at(local, row, np.searchsorted(at, at + 20, side="right") - np.arange(len(at)))
        columns += [weight * per_word, np.log1p(weight), np.log1p(np.bincount(row, minlength=p.n)), close * per_word, local, highest, surest]
    return np.stack(columns, axis=1)


def features(text: pa.Array, words: Words, parsed: Parsed | None = None) -> np.ndarray:
    n = len(text)
    raw, raw_at = string_parts(text)
    p = parsed or Parsed(text)
    data, offsets, start, end, h, row, count = p.data, p.offsets, p.start, p.end, p.words, p.row, p.count
    per_word = 100 / np.maximum(count, 1)
    length = np.maximum(np.diff(raw_at), 1)

    def by_row(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row[flags], minlength=n)

    def by_byte(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[raw_at[1:]] - total[raw_at[:-1]]

    hit, you = _in(h, words.all), _in(h, words.you)
    # positions with a gap wider than any window between texts
    place = np.arange(len(h)) + row * 1000
    at, near = place[hit], np.zeros(n)
    gap = _nearest(at, place[you])
    close = np.bincount(row[hit], gap <= NEAR, minlength=n)
    np.maximum.at(near, row[hit], 1 / (1 + np.minimum(gap, 99)))
    local = np.zeros(n)
    np.maximum.at(local, row[hit], np.searchsorted(at, at + 20, side="right") - np.arange(len(at)))

    letters = by_byte((raw | 32) - 97 < 26)
    capital = (raw >= 65) & (raw <= 90)
    all_caps = np.zeros(0)
    raw_start, raw_end, _ = words_of(raw, raw_at) if len(raw) != len(data) else (start, end, None)
    capitals_to = np.concatenate(([0], np.cumsum(capital)))
    all_caps = (capitals_to[raw_end] - capitals_to[raw_start] == raw_end - raw_start) & (raw_end - raw_start > 1)
    caps_words = np.bincount(rows_of(raw_start, raw_at)[all_caps], minlength=n)
    bang, ask = raw == 33, raw == 63
    repeated = np.zeros(len(raw), dtype=bool)
    if len(raw):
        repeated[1:] = (raw[1:] == raw[:-1]) & (bang | ask | (raw == 46))[1:]
    other = np.isin(raw, np.frombuffer(b"#$%&*@~^|", np.uint8))

    digit = (data >= 48) & (data <= 57)
    digits_to = np.concatenate(([0], np.cumsum(digit)))
    inside = digits_to[end] - digits_to[start]
    mixed = (inside > 0) & (inside < end - start) & (end - start < 30)
    leet = _LEET[data]
    ls, le, lh = words_of(leet, offsets) if (leet != data).any() else (start, end, h)
    lhit = _in(lh, words.all)
    disguised = np.zeros(n)
    if lhit.any():
        changed = np.concatenate(([0], np.cumsum(leet != data)))
        disguised = np.bincount(rows_of(ls, offsets)[lhit & (changed[le] > changed[ls])], minlength=n)
    spelled = np.zeros(n)
    single = (end - start == 1) & ~digit[start] if len(start) else np.zeros(0, bool)
    if single.any():
        follows = np.zeros(len(start), dtype=bool)
        follows[1:] = single[1:] & single[:-1] & (start[1:] - end[:-1] == 1) & (row[1:] == row[:-1])
        first = np.flatnonzero(single & ~follows)
        for s in first[np.append(follows, False)[first + 1]].tolist():
            e = s + 1
            while e < len(start) and follows[e]:
                e += 1
            if e - s > 2 and bytes(data[start[s:e]]).decode("latin-1") in words.plain:
                spelled[row[s]] += 1
    columns = [by_row(_in(h, c)) * per_word for c in words.categories]
    columns += [np.log1p(by_row(hit)), local, by_row(you) * per_word, close * per_word, near]
    columns += [by_byte(capital) / np.maximum(letters, 1), caps_words * per_word, by_byte(bang) * 100 / length, by_byte(ask) * 100 / length, by_byte(repeated) * 100 / length, by_byte(other) * 100 / length]
    columns += [disguised * per_word, spelled * per_word, by_row(mixed) * per_word, np.log1p(count), np.bincount(row, end - start, minlength=n) / np.maximum(count, 1)]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    trees: Boosted
    knots: np.ndarray
    levels: np.ndarray
    lexicons: tuple[Lexicon, Lexicon]

    def score(self, text: pa.Array, words: Words) -> np.ndarray:
        p = Parsed(text)
        x = np.concatenate([features(text, words, p), learned_features(p, self.lexicons, words)], axis=1)
        return np.interp(self.trees.raw(x), self.knots, self.levels)


def learn_lexicons(rows: DataFrame) -> list[tuple[Lexicon, Lexicon]]:
    """Lexicons of words and stems learned from rows(y, fold, text): for each fold those without it, then those of all.

    Spark counts, for each word and stem, the documents of each fold and label that hold it; what too few toxic ones
    hold is dropped before the rest comes to the driver, so that this is bounded by the labelled rows.
    """

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                cell = (b.column("fold").to_numpy() * 2 + b.column("y").to_numpy()).astype(np.int64)
                for kind, (row, h) in enumerate(occurrences(Parsed(b.column("text")))):
                    order = np.lexsort((cell[row], h))
                    h, c = h[order], cell[row][order]
                    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))) if len(h) else np.zeros(0, np.int64)
                    n = np.diff(np.append(first, len(h)))
                    yield pa.record_batch([pa.array(np.full(len(first), kind, np.int32)), pa.array(h[first].view(np.int64)), pa.array(c[first].astype(np.int32)), pa.array(n)], names=["kind", "hash", "cell", "n"])

    cells = 2 * FOLDS
    found = rows.select("y", "fold", "text").mapInArrow(run, "kind int, hash long, cell int, n long").groupBy("kind", "hash").agg(*(F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(cells)))
    found = found.where(" + ".join(f"n{c}" for c in range(1, cells, 2)) + f" >= {LEAST_TOXIC}").toArrow()
    totals = {r[0]: r[1] for r in rows.groupBy((F.col("fold") * 2 + F.col("y")).alias("cell")).count().collect()}
    total = np.array([totals.get(c, 0) for c in range(cells)]).reshape(FOLDS, 2)
    kind, h = found.column("kind").to_numpy(), found.column("hash").to_numpy().view(np.uint64)
    n = np.stack([found.column(f"n{c}").to_numpy() for c in range(cells)], axis=1).reshape(len(h), FOLDS, 2)
    order = np.argsort(h)
    kind, h, n = kind[order], h[order], n[order]
    every, out = n.sum(axis=1), []
    for fold in [*range(FOLDS), None]:
        own, size = (every, total.sum(axis=0)) if fold is None else (every - n[:, fold], total.sum(axis=0) - total[fold])
        out.append(tuple(lexicon(h[kind == k], own[kind == k, 1], own[kind == k, 0], int(size[1]), int(size[0])) for k in (0, 1)))
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model fitted on at most rows labelled documents: three of four for the trees, the others for calibration.

    Labels other than 0 and 1 and null texts are left out; a doc_id with several labels has the largest; of a doc_id
    with several texts the first in order counts. With no label, or labels of one class only, the score of every text
    is the share of toxic ones, 0 if there is none, but less than THRESHOLD: nothing is rejected untaught.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    one = cut(one.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "text"))
    lexicons = learn_lexicons(one)
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches):
        words = Words()
        for whole in batches:
            for b in slices(whole, "text"):
                p, fold = Parsed(b.column("text")), b.column("fold").to_numpy()
                x = np.concatenate([features(b.column("text"), words, p), np.zeros((p.n, len(LEARNED)))], axis=1)
                for f in np.unique(fold).tolist():
                    x[fold == f, len(FEATURES) :] = learned_features(p, shared.value[f], words)[fold == f]
                yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = one.mapInArrow(run, "doc_id long, y int, x array<double>").toArrow()
    ids, y = got.column("doc_id").to_numpy(), got.column("y").to_numpy().astype(float)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, len(FEATURES) + len(LEARNED)))
    order = np.argsort(ids)
    ids, y, x = ids[order], y[order], x[order]
    if len(y) < 8 or y.min() == y.max():
        share = min(float(y.mean()) if len(y) else 0.0, THRESHOLD - 1e-9)
        return Model(Boosted(0.0), np.array([0.0]), np.array([share]), lexicons[-1])
    held = np.arange(len(y)) % 4 == 3
    if y[~held].min() == y[~held].max() or y[held].min() == y[held].max():
        held = np.zeros(len(y), dtype=bool)
    trees = fit(x[~held], y[~held])
    part = held if held.any() else ~held
    return Model(trees, *isotonic(trees.raw(x[part]), y[part]), lexicons[-1])


def scorer(model: Model, spark: SparkSession):
    """An Arrow function from a column of texts to calibrated probabilities; null for a null text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        words, model = Words(), shared.value
        out = [model.score(b.column(0), words) for b in slices(pa.record_batch([text], names=["t"]), "t")]
        return pa.array(np.concatenate(out) if out else [], pa.float64(), mask=text.is_null().to_numpy(zero_copy_only=False))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic) of every row: the calibrated probability, and whether it reaches THRESHOLD.

    A null text has a null score and isn't toxic; an empty one is scored as a text without words. Repeated rows get
    equal scores. A very long text is scored whole. Ids are integers and may be null. An empty table has no rows; what
    empty labels do is said in train(). Other columns are not looked at.
    """
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col), docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col)).alias("score"))
    return plain.select("doc_id", F.round("score", 6).alias("score"), F.coalesce(F.col("score") >= THRESHOLD, F.lit(False)).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the toxic ones, with the columns that docs has, whatever their names. Null texts stay."""
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col), docs.sparkSession)
    name = unused("score", docs)
    return docs.withColumn(name, score(F.col(text_col))).where(F.col(name).isNull() | (F.col(name) < THRESHOLD)).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
