"""Similarity of instances: TF-IDF cosine, type and predicate overlap, their blend, and the best few of each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.model import LABEL, NOTE, SEE_ALSO, TYPE

STOP_WORDS = sorted(set("a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself me more most my myself no nor not of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves".split()))
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"


def instance_features(triples: DataFrame) -> DataFrame:
    """(s, type, label, note, predicates, text) of each subject with a type.

    predicates is the set of those with an IRI as object, the type's included; text is the label, the note and every
    other value, in order of predicate and value. Of several types, labels or notes the smallest counts.
    """
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    rest = F.sort_array(F.collect_list(F.when(~F.col("p").isin(TYPE, LABEL, NOTE), F.struct("p", "o"))))
    df = triples.groupBy("s").agg(one(TYPE).alias("type"), one(LABEL).alias("label"), one(NOTE).alias("note"), F.sort_array(F.collect_set(F.when(F.col("o_kind") == "iri", F.col("p")))).alias("predicates"), F.transform(rest, lambda x: x["o"]).alias("rest"))
    return df.where("type is not null").select("s", "type", "label", "note", "predicates", F.concat_ws(" ", "label", "note", "rest").alias("text"))


def terms(docs: DataFrame, id_col: str, text_col: str, bigrams: bool = True, stop_words: list[str] | None = None) -> DataFrame:
    """(id, term, tf): words of two or more characters in lower case, without stop words, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), 0)
    stop = F.array(*(F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)))
    kept = F.filter(words, lambda w: ~F.array_contains(stop, w)) if stop_words is None or stop_words else words
    df = docs.select(F.col(id_col).alias("id"), kept.alias("w"))
    every = F.col("w")
    if bigrams:
        pairs = F.when(F.size("w") > 1, F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(1))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
        every = F.concat("w", pairs)
    return df.select("id", F.explode(every).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, bigrams: bool = True, min_df: int = 2, max_df: float = 0.8, max_terms: int | None = 1000, stop_words: list[str] | None = None) -> DataFrame:
    """(id, term, weight) of unit length per document.

    Terms in fewer than min_df or more than max_df of the documents are left out; of the rest the max_terms most
    frequent stay, by number of occurrences and then by name. idf is ln((1 + n) / (1 + df)) + 1.
    """
    tf = terms(docs, id_col, text_col, bigrams, stop_words)
    n = docs.agg(F.count("*").alias("n"))
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n))  # one row
    vocabulary = vocabulary.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if max_terms is not None:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_terms)
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    raw = tf.join(vocabulary.select("term", idf.alias("idf")), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def cosine_pairs(weights: DataFrame) -> DataFrame:
    """(i, j, cosine) of all pairs i < j that share a term: a join of the inverted index with itself.

    Only pairs that share a term are ever formed; terms in most documents should have been left out by max_df.
    """
    a = weights.select("term", F.col("id").alias("i"), F.col("weight").alias("x"))
    b = weights.select("term", F.col("id").alias("j"), F.col("weight").alias("y"))
    return a.join(b, "term").where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def type_similarity(a: Column, b: Column) -> Column:
    """1 for equal class names, 0.5 where one holds the other, else 0."""
    x, y = F.lower(F.regexp_replace(a, "^.*[#/]", "")), F.lower(F.regexp_replace(b, "^.*[#/]", ""))
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.5).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def blended_pairs(features: DataFrame, weights: DataFrame, all_pairs: bool = False) -> DataFrame:
    """(i, j, score) of ordered pairs: half the cosine, three tenths the type's, two tenths the predicates' similarity.

    By default of pairs that share a term, which the inverted index yields; with all_pairs of every pair that shares a
    predicate, too. As all instances have a type that is every pair there is, so it is for small sets only.
    """
    pairs = cosine_pairs(weights)
    f = features.select("s", "type", "predicates")
    if all_pairs:
        by_predicate = f.select(F.col("s").alias("i"), F.explode("predicates").alias("p"))
        shared = by_predicate.join(by_predicate.select(F.col("i").alias("j"), "p"), "p").where("i < j").select("i", "j").distinct()
        pairs = shared.join(pairs, ["i", "j"], "full_outer")
    a = f.select(F.col("s").alias("i"), F.col("type").alias("ta"), F.col("predicates").alias("pa"))
    b = f.select(F.col("s").alias("j"), F.col("type").alias("tb"), F.col("predicates").alias("pb"))
    score = 0.5 * F.coalesce("cosine", F.lit(0.0)) + 0.3 * type_similarity(F.col("ta"), F.col("tb")) + 0.2 * jaccard(F.col("pa"), F.col("pb"))
    half = pairs.join(a, "i").join(b, "j").select("i", "j", score.alias("score"))
    return half.union(half.select("j", "i", "score"))


def scaled_by_centrality(pairs: DataFrame, centrality: DataFrame) -> DataFrame:
    """Scores of row i times 1 plus half its centrality(id, centrality)."""
    c = centrality.select(F.col("id").alias("i"), "centrality")
    return pairs.join(c, "i", "left").select("i", "j", (F.col("score") * (1 + 0.5 * F.coalesce("centrality", F.lit(0.0)))).alias("score"))


def top_similar(pairs: DataFrame, k: int = 3, least: float = 0.1) -> DataFrame:
    """(i, j, score, rank): the k best of each i from least on, the smaller j first where scores are equal."""
    w = Window.partitionBy("i").orderBy(F.desc("score"), "j")
    return pairs.where((F.col("i") != F.col("j")) & (F.col("score") >= least)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def see_also(top: DataFrame) -> DataFrame:
    return top.select(F.col("i").alias("s"), F.lit(SEE_ALSO).alias("p"), F.col("j").alias("o"), F.lit("iri").alias("o_kind"))


def dense_cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers of the same length; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_dense(vectors: DataFrame, k: int) -> DataFrame:
    """(i, j, score, rank): the k rows of greatest dense_cosine() to each row of vectors(id, grp, vector), of its group, the smaller j first of equal ones.

    All pairs of a group are compared, a block of rows with a block of rows in a task: as products of matrices, after which
    what comes within SLACK of the k-th best is scored again exactly. A block is 4 MB at most, and a slice of its products 16 MB.
    Rows without group, id or vector, or with a null in it, have no score, nor have vectors of different lengths.
    """
    session = vectors.sparkSession
    rows = vectors.where("id is not null and grp is not null and vector is not null and not exists(vector, x -> x is null)")
    rows = rows.select("id", "grp", F.col("vector").cast("array<double>").alias("v"), F.size("vector").alias("d"))
    most = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(1 << 19) / F.greatest("d", F.lit(1))))).cast("int")
    w = Window.partitionBy("grp", "d")
    rows = rows.withColumns({"at": F.floor((F.row_number().over(w.orderBy("id")) - 1) / most).cast("int"), "last": F.floor((F.count("*").over(w) - 1) / most).cast("int")})
    cells = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("last")), lambda x: F.array(F.struct(F.col("at").alias("a"), x.alias("b"), F.lit(True).alias("asks")), F.struct(x.alias("a"), F.col("at").alias("b"), F.lit(False).alias("asks"))))))
    rows = rows.select("id", "grp", "d", "v", cells.alias("c")).select("id", "grp", "d", "v", "c.*")
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    id_type = vectors.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        d = table.column("d")[0].as_py()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
        i, j, score = _best(ids[asks], flat[asks], ids[~asks], flat[~asks], k)
        return pa.table({"i": pa.array(i, table.schema.field("id").type), "j": pa.array(j, table.schema.field("id").type), "score": pa.array(score, pa.float64(), from_pandas=False)})

    found = rows.repartition(n, "grp", "d", "a", "b").groupBy("grp", "d", "a", "b").applyInArrow(run, f"i {id_type}, j {id_type}, score double")
    return top_similar(found, k, float("-inf"))


#: Rows of a block at most, and how far a product of matrices may be from the exact score.
BLOCK, SLACK = 8192, 1e-9


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, summed one component after the other, as dense_cosine() does."""
    out = np.zeros(len(x))
    for c in range(x.shape[1]):
        out += x[:, c] * y[:, c]
    return out


def _best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the k best candidates for each query, and of more where scores are equal beyond rounding."""
    with np.errstate(all="ignore"):
        order = np.argsort(cid, kind="stable")
        cid, c = cid[order], c[order]
        if len(c) and c.shape[1]:
            # of equal vectors, whose scores are equal, those of the k + 1 smallest ids are enough
            _, same = np.unique(np.ascontiguousarray(c).view(f"V{8 * c.shape[1]}").ravel(), return_inverse=True)
            by = np.argsort(same, kind="stable")
            first = np.r_[True, same[by][1:] != same[by][:-1]]
            step = first | np.r_[True, cid[by][1:] != cid[by][:-1]]
            number = np.cumsum(step)
            kept = np.sort(by[number - np.maximum.accumulate(np.where(first, number, 0)) <= k])
            cid, c = cid[kept], c[kept]
        qn, cn = np.sqrt(_dots(q, q)), np.sqrt(_dots(c, c))
        unit, units = q / qn[:, None], (c / cn[:, None]).T
        out = []
        for at in range(0, len(q), most := max(1, (1 << 21) // max(len(c), 1))):
            part = slice(at, at + most)
            near = unit[part] @ units
            odd = ~np.isfinite(near)
            near[odd] = -np.inf
            left, right = np.searchsorted(cid, qid[part], "left"), np.searchsorted(cid, qid[part], "right")
            for r in np.nonzero(right > left)[0]:
                near[r, left[r] : right[r]] = -np.inf
                odd[r, left[r] : right[r]] = False
            least = np.partition(near, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(near), -np.inf)
            a, b = np.nonzero((near >= (least - SLACK)[:, None]) & (near > -np.inf) | odd)
            score = _dots(q[part][a], c[b]) / (below := qn[part][a] * cn[b])
            fine = below != 0
            a, b, score = a[fine], b[fine], score[fine]
            by = np.lexsort((cid[b], -np.where(np.isnan(score), np.inf, score), a))
            a, b, score = a[by], b[by], score[by]
            top = np.arange(len(a)) - np.searchsorted(a, a) < k
            out.append((qid[part][a[top]], cid[b[top]], score[top]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (qid[:0], qid[:0], np.zeros(0))


def keywords(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, word, n, rank): the k most frequent words of letters that aren't stop words; the first to occur of equal ones."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}_]+"), 0)
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(words).alias("at", "word"))
    rows = rows.where(F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").isin(*STOP_WORDS))
    counted = rows.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "word", "n", "rank")
