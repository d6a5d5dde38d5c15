"""Counts over a triple table: statistics, class profiles, fused class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import property_key
from loomgraph.model import TYPE, iri
from loomgraph.operators.paths import cut, edges, spread


def graph_stats(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("p").alias("predicates"), F.countDistinct("o").alias("objects"))


def distinct_instances(triples: DataFrame, closure: DataFrame) -> DataFrame:
    """(s, sup): each subject once with each class of closure(sub, sup) that it has or is below one that it has.

    Types of classes in closure are shuffled by subject, a row for each; what classes above add is made different where
    it then lies, so that neither a class nor the task that reads much of a table holds more than its share.
    """
    pairs = closure.select("sub", "sup")
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("sub")).join(pairs.select("sub"), "sub", "left_semi")
    return spread(types, "s", each=1 << 24).join(pairs, "sub").select("s", "sup").distinct()


def class_counts(triples: DataFrame, closure: DataFrame) -> DataFrame:
    """(cls, n): for every class the different instances of it and its subclasses, all in one aggregation."""
    return distinct_instances(triples, closure).groupBy(F.col("sup").alias("cls")).agg(F.count("s").alias("n"))


def count_classes(triples: DataFrame, closure: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row with the number of different instances of each class, subclasses included, by name: one scan for all."""
    rows = distinct_instances(triples, closure.where(F.col("sup").isin(*(iri(c) for c in names.values()))))
    return rows.agg(*(F.count_if(F.col("sup") == iri(c)).alias(n) for n, c in names.items()))


def class_properties(triples: DataFrame) -> DataFrame:
    """(cls, properties): the sorted set of predicates that instances of each class have, types aside."""
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("cls")).distinct()
    return types.join(triples.where(F.col("p") != TYPE).select("s", "p").distinct(), "s").groupBy("cls").agg(F.sort_array(F.collect_set("p")).alias("properties"))


def class_profile(triples: DataFrame) -> DataFrame:
    """(cls, p, n, share, frequency, cardinality): how many instances of a class have a property, and whether any has it more than once."""
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("cls")).distinct()
    total = types.groupBy("cls").agg(F.count("*").alias("total"))
    per = triples.where(F.col("p") != TYPE).groupBy("s", "p").agg(F.count("*").alias("c"))
    prof = types.join(per, "s").groupBy("cls", "p").agg(F.count("*").alias("n"), F.max("c").alias("most"))
    share = F.col("n") / F.col("total")
    text = F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))
    return prof.join(total, "cls").select("cls", "p", "n", F.round(share, 6).alias("share"), text.alias("frequency"), F.when(F.col("most") > 1, "multiple").otherwise("single").alias("cardinality"))


def property_snake_names(props: DataFrame) -> DataFrame:
    return props.withColumn("key", property_key(F.col("p")))


def percent_of_total(df: DataFrame, count: str, digits: int = 2) -> DataFrame:
    """df with each row's share of the column's sum, in percent."""
    return df.withColumn("percent", F.round(F.col(count) * 100.0 / F.sum(count).over(Window.partitionBy()), digits))


def histogram(df: DataFrame, value: Column, buckets: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """(bucket, n): rows by the first bucket whose condition holds."""
    expr = None
    for name, condition in buckets:
        expr = F.when(condition, name) if expr is None else expr.when(condition, name)
    return df.where(value.isNotNull()).groupBy(expr.otherwise(otherwise).alias("bucket")).agg(F.count("*").alias("n"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; order should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def numbered(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """Rows numbered from 1 in the given order.

    Rows are sorted by range in parallel and counted by partition; each partition then adds what lies before it, so that
    no single task sees all rows.
    """
    ordered = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))  # so that both uses see the same
    part = F.shiftrightunsigned("__at", 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    rows = ordered.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row for each partition
    return rows.withColumn(name, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("__at", "__part", "__before")


def label_index(triples: DataFrame, label: str) -> DataFrame:
    """(label, s) by lower-case label; of several subjects the largest."""
    return triples.where(F.col("p") == label).groupBy(F.lower("o").alias("label")).agg(F.max("s").alias("s"))


def relationship_histogram(triples: DataFrame, predicates: list[str]) -> DataFrame:
    rows = triples.where(F.col("p").isin(*(iri(p) for p in predicates)))
    return rows.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p")


def materialise_inverses(triples: DataFrame, inverses: list[tuple[str, str]]) -> DataFrame:
    """Triples with the reverse of each that has an inverse property."""
    out = triples.select("s", "p", "o")
    for a, b in inverses:
        for p, q in ((a, b), (b, a)):
            out = out.union(edges(triples, p).select(F.col("dst").alias("s"), F.lit(iri(q)).alias("p"), F.col("src").alias("o")))
    return out.distinct()


def materialise_superclasses(triples: DataFrame, closure: DataFrame) -> DataFrame:
    """Type triples with one for each class above."""
    return distinct_instances(triples, closure).select("s", F.lit(TYPE).alias("p"), F.col("sup").alias("o"))
