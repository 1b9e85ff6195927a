"""The master table: score feeds applied to it, snapshots compared with it, and reports on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply_kev(master: DataFrame, kev: DataFrame) -> DataFrame:
    """Exploited flag by a full replacement: only ids in the current list are flagged."""
    return master.join(kev.select("cve_id", F.lit(True).alias("is_kev")).distinct(), "cve_id", "left").withColumn("is_kev", F.coalesce("is_kev", F.lit(False)))


def not_found(master: DataFrame, feed: DataFrame) -> DataFrame:
    return feed.join(master.where("cve_id is not null"), "cve_id", "left_anti")


def apply_epss(master: DataFrame, epss: DataFrame, column: str = "score_milli") -> DataFrame:
    """One score per id, the highest of a repeated one; a master the feed no longer has keeps its score."""
    scores = epss.groupBy("cve_id").agg(F.max(column).alias("__new"))
    old = F.col(column) if column in master.columns else F.lit(None)
    return master.join(scores, "cve_id", "left").withColumn(column, F.coalesce("__new", old)).drop("__new")


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def delta_cursor(jobs: DataFrame) -> DataFrame:
    """Per source, when its last completed run ended."""
    return jobs.groupBy("source").agg(F.expr("max(completed_at) FILTER (WHERE status = 'completed')").alias("cursor"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows over old ones by key, with what happened to each; of new rows that repeat a key the greatest counts."""
    cols = [c for c in old.columns if c != key]
    once = new.groupBy(key).agg(F.max(F.struct(*cols)).alias("row")).select(key, "row.*")
    o, n = old.withColumn("__o", F.lit(1)).alias("o"), once.withColumn("__n", F.lit(1)).alias("n")
    return o.join(n, key, "full").select(
        key,
        *(F.when(F.col("n.__n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in cols),
        F.when(F.col("o.__o").isNull(), "inserted").when(F.col("n.__n").isNotNull(), "updated").otherwise("kept").alias("disposition"),
    )


def prune(previous: DataFrame, seen: DataFrame, key: str, complete: bool, strikes: int = 3) -> DataFrame:
    """Missing counters after a snapshot; a row is gone at ``strikes``. Empty or partial snapshots change nothing."""
    if not complete or seen.isEmpty():
        return previous
    marked = previous.join(seen.select(key, F.lit(True).alias("__seen")).distinct(), key, "left")
    return marked.withColumn("missing_runs", F.when(F.col("__seen"), 0).otherwise(F.col("missing_runs") + 1)).where(F.col("missing_runs") < strikes).drop("__seen")


def evaluate(expected: DataFrame, actual: DataFrame, by: str, ident: str) -> DataFrame:
    """True and false positives and false negatives per ``by``, with precision and recall (1 where undefined)."""
    both = expected.select(by, ident, F.lit(1).alias("e")).distinct().join(actual.select(by, ident, F.lit(1).alias("a")).distinct(), [by, ident], "full")
    n = both.groupBy(by).agg(F.count_if((F.col("e") == 1) & (F.col("a") == 1)).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    ratio = lambda d: F.when(d == 0, F.lit(1.0)).otherwise(F.col("tp") / d)
    return n.withColumn("precision", ratio(F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp") + F.col("fn")))


def totals(counts: DataFrame) -> DataFrame:
    """One row over all counts of ``evaluate``: sums, precision and recall (1 where undefined), F1 (0 where both are 0), and how many passed."""
    passed = F.count_if((F.col("fp") == 0) & (F.col("fn") == 0))
    n = counts.agg(F.count(F.lit(1)).alias("versions"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")), passed.alias("passed"))
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(1.0)
    rated = n.withColumn("precision", share("fp")).withColumn("recall", share("fn")).withColumn("failed", F.col("versions") - F.col("passed"))
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def split_cves(found: DataFrame, ident: str = "external_id") -> tuple[DataFrame, DataFrame]:
    """Rows with a CVE as their id, which can be compared, and the others, which are reported apart."""
    is_cve = F.coalesce(F.col(ident).rlike(r"(?i)^CVE-\d{4}-\d+\z"), F.lit(False))
    return found.where(is_cve), found.where(~is_cve)
