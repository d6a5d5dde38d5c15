"""Streams: triples without repeats, windows over events, the latest of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.sources.rdf import parse_ntriples


def read_triples(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Triples of N-Triples files as they arrive, each once within the delay."""
    lines = spark.readStream.format("text").load(path)
    found = parse_ntriples(lines, distinct=False).withColumn("arrived", F.current_timestamp())
    return found.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["s", "p", "o"])


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, end, key, n, total) of tumbling or sliding windows; late rows beyond the delay are dropped on a stream."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("__t", delay)
    w = F.window("__t", size, slide) if slide else F.window("__t", size)
    out = rows.groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of runs of rows of a key that are less than gap apart."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("__t", delay)
    out = rows.groupBy(F.session_window("__t", gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def progress(updates: DataFrame) -> DataFrame:
    """(job, stage, percent) of each job's furthest state, from updates(job, stage, percent): state is kept per job."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, percent = state.get if state.exists else ("", -1)
        for f in frames:
            for s, p in zip(f["stage"], f["percent"]):
                if p > percent:
                    stage, percent = s, int(p)
        state.update((stage, percent))
        yield pd.DataFrame({"job": [key[0]], "stage": [stage], "percent": [percent]})

    return updates.groupBy("job").applyInPandasWithState(run, "job string, stage string, percent int", "stage string, percent int", "update", GroupStateTimeout.NoTimeout)


def write_store(triples: DataFrame, path: str, checkpoint: str):
    """Appends a stream of triples to Parquet by predicate, each batch once."""
    return triples.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("p").outputMode("append").trigger(availableNow=True).start()
