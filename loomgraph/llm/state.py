"""Cutting lineage and choosing between a broadcast and a shuffle by measured size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir, or, where that is unset and in local mode only, a new one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
        sc.setCheckpointDir(folder)
        current = sc._jsc.sc().getCheckpointDir()
    return folder or current.get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its measured number of rows is within limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def unused(name: str, *tables: DataFrame) -> str:
    """name, with underscores at its end until no column of the tables is called so."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
