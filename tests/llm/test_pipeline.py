import corpus_pipeline as P
from loomgraph.llm import bpe, decontaminate, line_dedup, simhash_dedup, toxicity


def test_stages_take_effect_one_after_the_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} if "text" in x.columns else None for x in (docs, out))
        if name == "toxicity":
            assert set(before) - set(after) == {r.doc_id for r in toxicity.score_documents(docs, labels).collect() if r.toxic}
        if name == "line_dedup":
            from tests.llm.test_line_dedup import brute

            gone = brute(list(before.items()))
            assert after == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in before.items()}
        if name == "simhash_near_dedup":
            from tests.llm.test_near_dedup import brute_groups

            groups = brute_groups(sorted(before.items()))
            assert set(after) == {d for d in before if groups.get(d, d) == d}
        if name == "benchmark_decontamination":
            assert set(before) - set(after) == {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
            seen.append(out.count())
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    b = bpe.bpe()
    assert {r.doc_id: list(r.tokens) for r in docs.collect()} == {d: b.encode(t) for d, t in before.items()}
    assert sorted(P.run(spark, sf).collect()) == sorted(docs.collect())
    assert line_dedup and simhash_dedup


def test_edge_rows_of_each_stage(spark, sf, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns pass every stage; empty tables do, too."""
    from pyspark.sql import functions as F

    clash = {c: F.lit("c") for c in ("score", "lines", "of", "gone", "__gone", "__doc", "tokens", "n_tokens", "key", "row", "node", "u")}
    words = " ".join(f"w{i}x" for i in range(30_000))
    rows = [(1, None), (None, "no id here"), (2, ""), (3, ""), (4, "!!!"), (5, "one line\nand two"), (5, "one line\nand two"), (6, words), (7, "one line\nanother thing entirely")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    few = f"{tmp_path}/few"
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{few}/{t}.parquet")
    for d in (sf, few):
        got = {name: stage(spark, docs, d) for name, stage in P.STAGES}
        assert all(got[n].columns == docs.columns for n, _ in P.STAGES[:-1])
        ids = {n: sorted((r.doc_id or 0) for r in x.collect()) for n, x in got.items()}
        everything = [0, 1, 2, 3, 4, 5, 5, 6, 7]
        assert ids["toxicity"] == ids["line_dedup"] == ids["benchmark_decontamination"] == everything
        assert ids["simhash_near_dedup"] == [0, 1, 2, 4, 5, 5, 6, 7]
        texts = {r.doc_id: r.text for r in got["line_dedup"].collect()}
        assert texts[7] == "another thing entirely" and texts[5] == "one line\nand two" and texts[1] is None and texts[6] == words
        assert {5, 6, 7} <= set(ids["bpe"])
        for _, stage in P.STAGES:
            assert stage(spark, docs.limit(0), d).collect() == []
