"""Keeping tables of records: children replaced, parents removed with what hangs on them, defaults, samples and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of the touched parents are those of ``new``; all others stay."""
    return old.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def without(parents: DataFrame, gone: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """Parents and their children without the parents that are gone."""
    keys = gone.select(key).distinct()
    return [x.join(keys, key, "left_anti") for x in (parents, *children)]


def with_defaults(config: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``known`` are added where ``config`` has none."""
    return config.unionByName(known.join(config, key, "left_anti"))


def as_json(rows: DataFrame) -> DataFrame:
    """A line of JSON per row, large numbers as text."""
    kept = [F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString() == "bigint" else F.col(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("json"))


def every_kth(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spread over their order."""
    w = Window.partitionBy(key)
    step = F.ceil(F.count(F.lit(1)).over(w) / most)
    return rows.withColumn("__at", F.row_number().over(w.orderBy(order)) - 1).withColumn("__step", step).where("__at % __step = 0").drop("__at", "__step")


def grouped(entries: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """The entries of each key as a list in their order."""
    return entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("entries"))


def highest(entries: DataFrame, key: str, order: str, score: str, *with_it: str) -> DataFrame:
    """The highest score of each key with what belongs to it; of equal scores the first counts."""
    best = F.max_by(F.struct(score, *with_it), F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o")))
    return entries.groupBy(key).agg(best.alias("best")).select(key, "best.*")


def first_known(value: str, order: str, unknown: str = "unknown") -> Column:
    """The first value that is not the word for none."""
    return F.expr(f"min_by({value}, `{order}`) FILTER (WHERE {value} <> '{unknown}')")


def counters(outcomes: DataFrame, *words: str) -> DataFrame:
    """How many rows had each outcome, in one row."""
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("outcome") == w).alias(w) for w in words))


def prefer(first: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Rows of the first table that has a key."""
    return reduce(lambda a, b: a.unionByName(b.join(a, key, "left_anti")), others, first)


def coverage(expected: DataFrame, found: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """Filled share of each key's expected number, and whether it falls short."""
    n = expected.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    ratio = F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(1.0)
    return n.withColumn("ratio", ratio).withColumn("short", F.col("ratio") < least)
