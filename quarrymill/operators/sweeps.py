"""Sweeps against independent truth: which versions a page, an index or the stored rows say are affected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import versions as V


def release_entries(index: DataFrame, majors: list[int]) -> DataFrame:
    """(cve_id, major, patched) for each CVE and each of ``majors`` that a row's ``vulnerable`` text names whole ('20.x || 18.x').

    ``index``: cve (a list), vulnerable, patched ('^20.11.1 || ^18.20.1'). patched is the version of that major line
    which fixes the CVE, the last one if several are stated; null if none is. Rows without CVE ids or vulnerable text give none.
    """
    clauses = lambda text: F.transform(F.split(text, r"\|\|"), lambda x: F.trim(x))
    major = lambda x: F.regexp_extract(x, r"^(\d+)\.x\z", 1).try_cast("int")
    named = F.filter(F.transform(clauses(F.col("vulnerable")), major), lambda m: m.isin(majors))
    form = r"^\^(\d+)\.(\d+)\.(\d+)"
    fixes = F.filter(clauses(F.coalesce("patched", F.lit(""))), lambda x: x.rlike(form))
    rows = index.where("vulnerable <> ''").select(F.explode("cve").alias("cve_id"), named.alias("majors"), fixes.alias("fixes"))
    rows = rows.select("cve_id", F.explode(F.array_distinct("majors")).alias("major"), "fixes")
    own = F.filter("fixes", lambda x: x.startswith(F.concat(F.lit("^"), F.col("major").cast("string"), F.lit("."))))
    return rows.select("cve_id", "major", F.regexp_extract(F.try_element_at(own, F.lit(-1)), r"^\^(\d+\.\d+\.\d+)", 1).alias("patched"))


def release_points(entries: DataFrame) -> DataFrame:
    """(version, reasons) at which a sweep asks: each patched version, the one before it, and the start of each major line."""
    fixed, before = F.col("patched"), V.bump_last_number(F.col("patched"), -1)
    say = lambda text: F.concat("cve_id", F.lit(text), F.col("major").cast("string"), F.lit(".x"))
    at = F.array(
        F.struct(fixed.alias("version"), say(": fixed in ").alias("reason")), F.struct(before.alias("version"), say(": before the fix in ").alias("reason")),
        F.struct(F.concat(F.col("major").cast("string"), F.lit(".0.0")).alias("version"), F.concat(F.lit("start of "), F.col("major").cast("string"), F.lit(".x")).alias("reason")),
    )
    rows = entries.select(F.inline(at)).where("version is not null")
    return rows.groupBy("version").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def _last_fixes(entries: DataFrame) -> DataFrame:
    """(major, cve_id, patched): the last fix, by rpm's order, that a CVE's entries for a major line state; null if one states none."""
    last = F.max(F.struct(F.col("patched").isNull().alias("open"), V.rpm_evr(F.col("patched")).alias("k"), "patched"))
    return entries.groupBy("major", F.upper("cve_id").alias("cve_id")).agg(last.alias("last")).select("major", "cve_id", "last.patched")


def _affected_by(versions: DataFrame, fixes: DataFrame) -> DataFrame:
    """Versions, each once, with the rows of ``fixes`` (major, patched) for their major line that are not patched, or patched later."""
    v = versions.select("version").distinct().select("version", F.regexp_extract("version", r"^\s*(\d+)", 1).try_cast("int").alias("major"), V.rpm_evr(F.col("version")).alias("k"))
    e = fixes.withColumn("end", F.when(F.col("patched").isNotNull(), V.rpm_evr(F.col("patched"))))
    return v.join(e, "major").where("end is null or k < end")


def release_truth(versions: DataFrame, entries: DataFrame) -> DataFrame:
    """(version, cve_id): CVEs whose entry for the version's major line is not patched, or patched later by rpm's order."""
    return _affected_by(versions, _last_fixes(entries)).select("version", "cve_id")


def release_counts(versions: DataFrame, entries: DataFrame) -> DataFrame:
    """(version, n_cves, least): how many CVEs ``release_truth`` has for a version, and the least of them.

    CVEs are counted by their last fix before versions meet them, so no pair of version and CVE is made.
    """
    fixes = _last_fixes(entries).groupBy("major", "patched").agg(F.count(F.lit(1)).alias("n"), F.min("cve_id").alias("least"))
    return _affected_by(versions, fixes).groupBy("version").agg(F.sum("n").alias("n_cves"), F.min("least").alias("least"))


def release_ranges(entries: DataFrame) -> DataFrame:
    """(cve_id, affected): the same truth as one set of intervals of integer forms for each CVE."""
    line = F.concat(F.col("major").cast("string"), F.lit(".x"))
    own = F.when(F.col("patched").isNull(), C.npm_intervals(line)).otherwise(C.intersection(C.npm_intervals(line), C.npm_intervals(F.concat(F.lit("<"), "patched"))))
    return entries.groupBy(F.upper("cve_id").alias("cve_id")).agg(F.flatten(F.collect_set(own)).alias("x")).select("cve_id", C.union(F.col("x")).alias("affected"))


def first_range_decides(versions: DataFrame, ranges: DataFrame, open_start: bool = False) -> DataFrame:
    """(version, cve_id, pos): the first of a CVE's ranges, in the page's order, that a version is in.

    ``ranges``: cve_id, pos, introduced, last_affected and listed (versions named one by one). A range's list is
    looked at first. A start without integer form (null too) makes the range say nothing, or, with ``open_start``, leaves
    it open; an end without one leaves it open; ends are inclusive. A version without integer form is in lists alone.

    Ranges meet versions by major version where they have both ends, so that a page with many versions isn't joined with all.
    """
    v = versions.select("version", V.normalize_version(F.col("version")).alias("v"))
    r = ranges.withColumns({"lo": V.normalize_version(F.col("introduced")), "hi": V.normalize_version(F.col("last_affected"))})
    named = v.join(r.select("cve_id", "pos", F.explode("listed").alias("version")), "version").select("version", "cve_id", "pos")
    low, high = F.floor(F.col("lo") / V.MAJOR), F.floor(F.col("hi") / V.MAJOR)
    narrow = (high >= low) & (high - low < 64)
    wide = F.array(F.lit(None).cast("bigint"))
    dealt = r.where(F.col("lo").isNotNull() | F.lit(open_start)).withColumn("major", F.explode(F.when(narrow, F.sequence(low, high)).otherwise(wide)))
    inside = (F.col("lo").isNull() | (F.col("v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi")))
    known = v.where("v is not null").withColumn("major", F.floor(F.col("v") / V.MAJOR))
    near = known.join(dealt.where("major is not null"), "major").where(inside)
    far = known.drop("major").join(dealt.where("major is null").drop("major"), inside)
    hits = named.unionByName(near.select("version", "cve_id", "pos")).unionByName(far.select("version", "cve_id", "pos"))
    return hits.groupBy("version", "cve_id").agg(F.min("pos").alias("pos"))


def segments(pages: DataFrame, mark: str, text: str = "html") -> DataFrame:
    """(…, nth, before, hit): for each match of ``mark`` the text since the match before it, that one included, and the text from it on."""
    own = [c for c in pages.columns if c != text]
    parts = pages.withColumn("parts", F.split(text, f"(?={mark})"))
    # A page that begins with a match has no text before it.
    parts = parts.withColumn("parts", F.when(F.col(text).rlike(f"^(?:{mark})"), F.concat(F.array(F.lit("")), "parts")).otherwise(F.col("parts")))
    rows = parts.select(*own, "parts", F.posexplode(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).alias("nth", "hit"))
    return rows.select(*own, "nth", F.get("parts", F.col("nth")).alias("before"), "hit")


def sample(rows: DataFrame, strata: list[str], order: list[str], size: int) -> DataFrame:
    """The first ``size`` rows of each stratum in a total order.

    The rank's limit is applied in each partition before the shuffle, so at most ``size`` rows of a stratum leave a
    partition, and nothing is sorted as a whole.
    """
    w = Window.partitionBy(*strata).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= size).drop("nth")


def distro_points(affected: DataFrame, prefix: str, size: int = 500) -> DataFrame:
    """Points at which stored rows of an ecosystem are asked for: ecosystem, package_name, version, id, expected, reason.

    ``affected``: row_id, ecosystem, package_name, id, versions (a list), introduced_version, fixed_version,
    last_affected_version. ``size`` rows with a list give their first version; as many with a range only
    give its end and the version beside it. Rows without id or point give none.
    """
    listed = F.size(F.coalesce("versions", F.array().cast("array<string>"))) > 0
    bounded = F.coalesce("introduced_version", "fixed_version", "last_affected_version").isNotNull()
    kind = F.when(listed, "list").when(bounded, "range")
    chosen = sample(affected.where(F.col("ecosystem").startswith(prefix)).withColumn("kind", kind).where("kind is not null"), ["kind"], ["row_id"], size)
    point = lambda version, expected, reason: F.struct(version.alias("version"), F.lit(expected).alias("expected"), F.lit(reason).alias("reason"))
    fixed, last = F.nullif(F.col("fixed_version"), F.lit("")), F.nullif(F.col("last_affected_version"), F.lit(""))
    points = (
        F.when(F.col("kind") == "list", F.array(point(F.get("versions", F.lit(0)), True, "listed")))
        .when(fixed.isNotNull(), F.array(point(fixed, False, "fixed"), point(V.bump_last_number(fixed, -1), True, "before fixed")))
        .when(last.isNotNull(), F.array(point(last, True, "last affected"), point(V.bump_last_number(last, 1), False, "after last affected")))
    )
    return chosen.where("id is not null").select("row_id", "ecosystem", "package_name", "id", F.inline(points)).where("version <> ''")


def check_points(points: DataFrame, affected: DataFrame) -> DataFrame:
    """Each point with ``found`` (any stored row of its id has the version, by list or by dpkg's order) and tp, fp, fn."""
    p = points.withColumn("point", F.monotonically_increasing_id()) if "point" not in points.columns else points
    a = affected.select("ecosystem", "package_name", "id", "versions", "introduced_version", "fixed_version", "last_affected_version")
    hit = V.dpkg_row_matches(F.col("version"), F.col("versions"), F.col("introduced_version"), F.col("fixed_version"), F.col("last_affected_version"))
    own = [c for c in p.columns if c != "point"]
    got = p.join(a, ["ecosystem", "package_name", "id"], "left").groupBy(*own, "point").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found")).drop("point")
    flag = lambda test: test.cast("int")
    e, f = F.col("expected"), F.col("found")
    return got.select("*", flag(e & f).alias("tp"), flag(~e & f).alias("fp"), flag(e & ~f).alias("fn"))


def totals(checked: DataFrame, by: Column | str) -> DataFrame:
    return checked.groupBy(by).agg(F.count(F.lit(1)).alias("points"), *(F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")))
