"""A corpus pipeline over documents: each stage applies one operator and hands its rows to the next as Parquet.

For all stages: doc_id is an integer or null; a row whose id or text is null is never dropped, and only encoded as far as
bpe.encode() says; an empty text is a document like others, of which the near duplicates' stage keeps one; a very long
text is worked on whole; rows that repeat, id and all, are kept or dropped together; a tie goes to the smallest doc_id;
columns besides doc_id and text are passed on, whatever their names, until the last stage. An empty table gives one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, decontaminate, line_dedup, simhash_dedup, state, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels table, rejects go.

    Null texts stay. With labels that are empty or of one class nothing goes.
    """
    return toxicity.drop_toxic(docs, state.table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line of the corpus go from the texts; every document stays, if only with an empty text.

    Earlier is by doc_id, then by line; of lines under one doc_id and number, as in repeated rows, neither is earlier.
    """
    return line_dedup.without_repeated_lines(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Texts without words are duplicates of equal texts only. Null ids and null texts belong to no group and stay.
    """
    return simhash_dedup.keep_one(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null ids and null texts stay. With an empty benchmark nothing goes.
    """
    return decontaminate.drop_contaminated(docs, state.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every document that is left."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", reject_contaminated),
    ("bpe", tokenize),
]

#: The classifier, the fingerprints and the encoding can't be written in SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it return is written to the shared checkpoint folder and reread.

    The rows that it returns are still read from that folder, so it stays until the cluster's owner clears it. Nulls,
    empty and long texts, ties, repeated rows, empty tables and clashing columns are as said above.
    """
    docs = state.table(spark, sf_dir, "documents")
    folder = f"{state.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
