import numpy as np
import pyarrow as pa
from loomgraph.llm import gbt, toxicity as X


def test_features_see_what_they_should():
    w = X.Words()
    t = ["you are an idiot", "an idiot far from any of those words that address", "1d10t!", "i d i o t", "ALL CAPS HERE!!", "", None, "plain words", "st1mul4te", "you stup1d"]
    f = dict(zip(X.FEATURES, X.features(pa.array(t), w).T))
    assert f["insult_density"][0] == 25 and f["nearness"][0] > f["nearness"][1] == 0.01
    assert f["obfuscated_density"][[2, 9]].min() > 0 and f["obfuscated_density"][[0, 8]].max() == 0
    assert f["spelled_density"].tolist()[3] > 0 and f["spelled_density"].sum() == f["spelled_density"][3]
    assert f["capital_words"][4] == 100 and f["repeated_marks"][4] > 0
    assert np.isfinite(np.stack(list(f.values()))).all()


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = gbt.fit(x[:3000], y[:3000])
    assert ((m.raw(x[3000:]) > 0) == y[3000:]).mean() > 0.97
    knots, levels = gbt.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(levels) >= 0).all() and np.interp(2.5, knots, levels) == 0.5 and levels[-1] == 1


def test_held_out_accuracy(spark, sf):
    """Against the labels of the rows that the model wasn't fitted on, by language."""
    sf = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas()
    lang = docs.select("doc_id", "lang").toPandas()
    got = X.score_documents(docs, train).toPandas().merge(test, on="doc_id", suffixes=("", "_label")).merge(lang, on="doc_id")
    toxic, clean = got[got.toxic_label == 1], got[got.toxic_label == 0]
    assert len(toxic) > 200
    assert toxic.toxic.mean() >= 0.9 and clean.toxic.mean() <= 0.01
    assert toxic.groupby("lang").toxic.mean().min() >= 0.7


def test_lexicons_are_learned_without_the_rows_own_fold(spark):
    """A word of the toxic rows of a single fold is in the lexicon of all rows and in that of no fold but the others."""
    rows = [(int(i % 2), i // 2 % X.FOLDS, f"zorg{'' if i // 2 % X.FOLDS else ' frumblewick'}" if i % 2 else "plain") for i in range(400)]
    found = X.learn_lexicons(spark.createDataFrame(rows, "y int, fold int, text string"))
    everywhere, single = (int(X.hashes(w)[0]) for w in ("zorg", "frumblewick"))
    assert all(everywhere in words.known.tolist() for words, _ in found)
    assert [single in words.known.tolist() for words, _ in found] == [False, *[True] * X.FOLDS]
    assert not any(int(X.hashes("plain")[0]) in words.known.tolist() for words, _ in found)
    p = X.Parsed(pa.array(["you zorg and zorg", "nothing", None, ""]))
    f = dict(zip(X.LEARNED, X.learned_features(p, found[-1], X.Words()).T))
    assert f["word_near_you"].tolist() == [50, 0, 0, 0] and f["word_local"].tolist() == [2, 0, 0, 0] and f["stem_highest"][0] > 0


def test_edge_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(900_001, None), (None, "you idiot you moron"), (900_002, ""), (900_003, "word " * 200_000 + "idiot " * 20_000), (900_004, "x"), (900_004, "x")], "doc_id long, text string")
    mine = docs.select("doc_id", "text").union(extra)
    mine = mine.selectExpr("*", "'a' as score", "1 as toxic", "'b' as __score", "2 as y", "3 as fold")
    got = [r for r in X.score_documents(mine, labels).collect() if r.doc_id is None or r.doc_id > 900_000]
    by = {r.doc_id: r for r in got}
    assert by[900_001].score is None and not by[900_001].toxic and not by[900_002].toxic and by[900_003].toxic and by[None].toxic and len(got) == 6
    kept = X.drop_toxic(mine, labels)
    assert kept.columns == mine.columns and {900_001, 900_002, 900_004} <= {r.doc_id for r in kept.collect()}
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert not any(r.toxic for r in X.score_documents(mine, few).collect())
    assert not any(r.toxic for r in X.score_documents(mine, labels.where("toxic = 1")).collect())
    assert X.score_documents(mine.limit(0), labels).collect() == []
