"""Odd and large values: queries against their SQL over tables of a few rows."""

import duckdb
from pyspark.sql import functions as F

from loomgraph.plans import registry


def same(spark, folder, name, **tables):
    """Rows of a query over tables that are written to folder, after a look whether its SQL gives the same."""
    duck = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        duck.execute(f"create or replace view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(folder))
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = sorted(map(repr, (tuple(r) for r in got.select(*names).collect())))
    assert rows == sorted(map(repr, want.fetchall()))
    return got.collect()


def test_access_of_texts_that_say_nothing(spark, tmp_path):
    rows = [(1, "", "en"), (2, None, "en"), (3, "", "_x"), (4, None, None), (5, "PUBLİC STİTIC", "_x"), (6, "a static", None), (7, "STİTIC statİc", "de"), (8, "private", "de")]
    got = same(spark, tmp_path, "access_modifiers", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.doc_id: (r.access, r.is_static) for r in got}[1] == ("public", False)


def test_times_beyond_four_digits_of_years(spark, tmp_path):
    rows = [(k, 1, x) for k, x in ((0, "1995-01-02 03:04:05"), (3_000_000, None), (9_000_000, "2000-02-29 00:00:00"), (-719_600, "1999-01-01 00:00:00"), (-1_000_000, "x"), (None, "1999-01-01 00:00:00"))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, day string").select("l_orderkey", "l_linenumber", F.expr("try_cast(day as timestamp_ntz)").alias("l_shipdate"))
    got = {r.l_orderkey: r for r in same(spark, tmp_path, "epoch_and_primitive", lineitem=lines)}
    assert got[9_000_000].at.startswith("26") and got[9_000_000].primitive is False


def test_primitive_names_are_looked_for_in_the_rows(spark, tmp_path):
    """A type in place of the date is told from another: the rows decide, not a constant."""
    lines = spark.createDataFrame([(1, 1, "List[Number]"), (2, 1, "Widget"), (3, 1, None)], "l_orderkey long, l_linenumber int, l_shipdate string")
    got = {r.l_orderkey: r.primitive for r in same(spark, tmp_path, "epoch_and_primitive", lineitem=lines)}
    assert got == {1: True, 2: False, 3: None}
