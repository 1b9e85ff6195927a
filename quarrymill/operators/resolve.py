"""Masters derived from the records of all sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

COLUMNS = ("source_id", "cve_id", "severity", "summary", "published_at", "modified_at")


def master_key(cve_id, own_id):
    return F.coalesce(cve_id, own_id)


def resolve(osv: DataFrame, nvd: DataFrame, advisories: DataFrame) -> DataFrame:
    """One master for each CVE id, or for each source id without one. Inputs hold ``COLUMNS``.

    Where an NVD record exists its severity and summary hold, even if null; else the first that is not null, of OSV
    records before advisories and then by source id. One aggregation, combined before its shuffle; a record that gains
    a CVE id moves to that master, and its former one has no records left.
    """
    kinds = (("nvd", 0, nvd), ("osv", 1, osv), ("advisory", 2, advisories))
    rows = reduce(DataFrame.unionByName, (d.select(*COLUMNS, F.lit(k).alias("kind"), F.lit(n).alias("turn")) for k, n, d in kinds))
    of = lambda kind, column: F.when(F.col("kind") == kind, F.col(column))
    first = lambda column: F.min(F.when(F.col(column).isNotNull(), F.struct("turn", "source_id", column)))[column]
    with_nvd = F.max(F.col("kind") == "nvd")
    return (
        rows.groupBy(master_key(F.col("cve_id"), F.col("source_id")).alias("master_key"))
        .agg(
            F.max("cve_id").alias("cve_id"),
            F.min(of("osv", "source_id")).alias("osv_id"),
            F.min(F.when(F.col("cve_id").isNull(), of("advisory", "source_id"))).alias("advisory_id"),
            *(F.when(with_nvd, F.max(of("nvd", k))).otherwise(first(k)).alias(k) for k in ("severity", "summary")),
            F.min("published_at").alias("published_at"),
            F.when(with_nvd, F.max(of("nvd", "modified_at"))).otherwise(F.max("modified_at")).alias("modified_at"),
            F.count(F.lit(1)).alias("n_records"),
        )
        .where("master_key is not null")
    )


def orphans(before: DataFrame, now: DataFrame) -> DataFrame:
    """Masters that no record leads to any more."""
    return before.join(now.select("master_key"), "master_key", "left_anti")


def follow_renames(links: DataFrame, renames: DataFrame) -> DataFrame:
    """``links`` (child, master, seq) with ``end``: the master that each leads to after all renames.

    ``renames``: old, new, seq (unique): at seq all that old leads to moves to new. A link made later than a
    rename isn't moved by it, as a master may come to life again. Chains are resolved by doubling, in as many rounds
    as the logarithm of the longest one; they always end, as seq grows along them.
    """
    # Few renames leave from one master, so that a master with many children is joined, not gathered.
    leaving = renames.groupBy(F.col("old").alias("key")).agg(F.sort_array(F.collect_list("seq")).alias("seqs"))
    first = F.get(F.filter("seqs", lambda s: s > F.col("seq")), 0)
    follow = lambda rows: rows.join(leaving, "key", "left").withColumn("next", first).drop("seqs")
    jumps = written(follow(renames.select(F.col("new").alias("key"), "seq")).select(F.col("seq").alias("at"), F.coalesce("next", "seq").alias("to")), "renames")
    moving = True
    while moving:
        step = jumps.alias("a").join(jumps.alias("b"), F.col("a.to") == F.col("b.at"))
        jumps = written(step.select("a.at", "b.to", (F.col("a.to") != F.col("b.to")).alias("moved")), "renames")
        moving = not jumps.where("moved").isEmpty()
    final = jumps.join(renames.select(F.col("seq").alias("to"), F.col("new").alias("target")), "to").select(F.col("at").alias("next"), "target")
    out = follow(links.select("child", F.col("master").alias("key"), "seq")).join(final, "next", "left")
    return out.select("child", F.col("key").alias("master"), "seq", F.coalesce("target", "key").alias("end"))


def renames_of(arrivals: DataFrame) -> DataFrame:
    """(old, new, seq): masters of a source's own id that give way to a CVE's.

    ``arrivals``: seq (unique), source, source_id, cve_id, one row each time that a record is imported. A record that had no
    CVE id and now has one takes all that leads to its own master along, unless that one has given way since the
    record was last imported.
    """
    own = Window.partitionBy("source", "source_id").orderBy("seq")
    rows = arrivals.select("seq", "source", "source_id", "cve_id", F.lag("seq").over(own).alias("since"), F.lag("cve_id").over(own).alias("former"))
    moves = rows.where("since is not null and former is null and cve_id is not null")
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast("array<struct<seq: bigint, since: bigint, new: string>>").alias("kept"))
    fits = lambda acc, m: m["since"] > acc["last"]
    step = lambda acc, m: F.struct(F.when(fits(acc, m), m["seq"]).otherwise(acc["last"]).alias("last"), F.when(fits(acc, m), F.concat(acc["kept"], F.array(m))).otherwise(acc["kept"]).alias("kept"))
    by_old = moves.groupBy(F.col("source_id").alias("old")).agg(F.sort_array(F.collect_list(F.struct("seq", "since", F.col("cve_id").alias("new")))).alias("m"))
    kept = by_old.select("old", F.explode(F.aggregate("m", start, step)["kept"]).alias("m"))
    return kept.select("old", F.col("m.new").alias("new"), F.col("m.seq").alias("seq"))


def masters_in_order(arrivals: DataFrame) -> DataFrame:
    """The masters after all ``arrivals`` (seq, kind, source, source_id, cve_id, severity, score, vector, summary, published_at, modified_at).

    For a CVE: an NVD record overwrites all but published_at, also with nulls; OSV
    records fill what is null then, and move modified_at forward only; an advisory makes a master of its
    values where there is none, and is linked to it otherwise. Without a CVE id, the last record of the id holds, but for published_at of
    OSV, which stays as first set. Masters that have given way to a CVE's are not there, unless a record made them anew.
    """
    gone = renames_of(arrivals).groupBy(F.col("old").alias("master_key")).agg(F.max("seq").alias("gone"))
    rows = arrivals.withColumn("master_key", F.coalesce("cve_id", "source_id")).join(gone, "master_key", "left")
    rows = rows.where(F.col("cve_id").isNotNull() | F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).drop("gone")
    nvd, osv = F.col("kind") == "nvd", F.col("kind") == "osv"
    last_nvd = F.max(F.when(nvd, F.col("seq"))).alias("last_nvd")
    head = rows.groupBy("master_key").agg(last_nvd, F.min("seq").alias("first"), F.max("seq").alias("last"))
    rows = rows.join(head, "master_key")
    seq = F.col("seq")
    at = lambda test, c: F.max_by(F.when(test, F.col(c)), F.when(test, seq))
    filled = lambda c: F.min_by(F.when(osv & F.col(c).isNotNull() & (seq > F.coalesce("last_nvd", F.lit(-1))), F.col(c)), F.when(osv & F.col(c).isNotNull() & (seq > F.coalesce("last_nvd", F.lit(-1))), seq))
    base = lambda c: at(seq == F.coalesce("last_nvd", "first"), c)
    own = F.max("cve_id").isNull()
    latest = lambda c: at(seq == F.col("last"), c)
    created = at(seq == F.col("first"), "published_at")
    ever = F.min_by(F.when(osv & F.col("published_at").isNotNull(), F.col("published_at")), F.when(osv & F.col("published_at").isNotNull(), seq))
    newest = F.max(F.when(osv & (seq > F.coalesce("last_nvd", F.lit(-1))), F.col("modified_at")))
    return rows.groupBy("master_key").agg(
        F.max("cve_id").alias("cve_id"),
        *(F.when(own, latest(c)).otherwise(F.coalesce(base(c), filled(c))).alias(c) for c in ("severity", "score", "summary")),
        F.when(own, F.when(F.max(osv), F.lit(None)).otherwise(latest("vector"))).otherwise(F.when(F.max("last_nvd").isNotNull(), base("vector")).otherwise(at((seq == F.col("first")) & ~osv, "vector"))).alias("vector"),
        F.when(own & ~F.max(osv), latest("published_at")).when(own, created).otherwise(F.coalesce(created, ever)).alias("published_at"),
        F.when(own & ~F.max(osv), F.lit(None)).when(own, latest("modified_at")).otherwise(F.greatest(at(seq == F.col("last_nvd"), "modified_at"), newest)).alias("modified_at"),
    )
