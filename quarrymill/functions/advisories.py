"""Small parsers of advisory fields: severities, identifiers, dates, markup and version-range texts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vendor severities and what they stand for.
SEVERITIES = {"critical": "CRITICAL", "important": "HIGH", "high": "HIGH", "moderate": "MEDIUM", "medium": "MEDIUM", "low": "LOW"}


def severity(word: Column) -> Column:
    """Known words by the table; others in capitals."""
    return F.coalesce(F.create_map(*map(F.lit, chain(*SEVERITIES.items())))[F.lower(word)], F.upper(word))


def severity_from_score(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW")


def cve_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(CVE-\d{4}-\d+)"), 1))


def first_cve(aliases: Column, upstream: Column) -> Column:
    pick = lambda a: F.get(F.filter(a, lambda x: x.startswith("CVE-")), F.lit(0))
    return F.coalesce(pick(aliases), pick(upstream))


def day_month_year(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("d MMMM yyyy"))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def fixed_comment(comment: Column) -> Column:
    """(package, version) of 'package is earlier than version'."""
    form = r"(?i)^(.+?)\s+is earlier than\s+(.+)\z"
    return F.when(comment.rlike(form), F.struct(F.regexp_extract(comment, form, 1).alias("package"), F.trim(F.regexp_extract(comment, form, 2)).alias("version")))


def _range(start=None, end=None, last=None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(text(start).alias("start"), text(end).alias("end"), text(last).alias("last"))


def dashed_ranges(text: Column) -> Column:
    """'1.0-1.4, 2.1' as ranges with inclusive ends."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d"))

    def one(p: Column) -> Column:
        cut = F.split(p, "-")
        return _range(F.trim(cut[0]), None, F.trim(F.coalesce(F.get(cut, F.lit(1)), cut[0])))

    return F.transform(parts, one)


def spoken_range(text: Column) -> Column:
    """'A to B', 'A before B', 'below B', 'B and earlier' or a single version."""
    num = r"(\d[\w.]*)"
    got = lambda form, k: F.regexp_extract(text, form, k)
    to, before, below, earlier, single = rf"^\s*{num}\s+(?:to|through)\s+{num}", rf"^\s*{num}\s+before\s+{num}", rf"(?i)^\s*(?:below|before)\s+{num}", rf"(?i)^\s*{num}\s+and\s+earlier", rf"^\s*{num}\s*\z"
    return (
        F.when(text.rlike(to), _range(got(to, 1), None, got(to, 2)))
        .when(text.rlike(before), _range(got(before, 1), got(before, 2)))
        .when(text.rlike(below), _range(None, got(below, 1)))
        .when(text.rlike(earlier), _range(None, None, got(earlier, 1)))
        .when(text.rlike(single), _range(got(single, 1), None, got(single, 1)))
    )


def event_ranges(events: Column) -> Column:
    """(introduced, fixed, last_affected) from an ordered list of events with those fields.

    An introduction opens a range, emitting one left open before it; a fix or a
    last affected version closes it; what is open at the end is emitted.
    """
    none = F.lit(None).cast("string")
    row = lambda i, f, x: F.struct(i.alias("introduced"), f.alias("fixed"), x.alias("last_affected"))
    start = F.struct(none.alias("at"), F.array().cast("array<struct<introduced: string, fixed: string, last_affected: string>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        left = F.when(acc["at"].isNotNull(), F.array_append(acc["out"], row(acc["at"], none, none))).otherwise(acc["out"])
        closed = F.array_append(acc["out"], row(acc["at"], e["fixed"], F.when(e["fixed"].isNull(), e["last_affected"])))
        opens, closes = e["introduced"].isNotNull(), e["fixed"].isNotNull() | e["last_affected"].isNotNull()
        return F.struct(F.when(opens, e["introduced"]).when(closes, none).otherwise(acc["at"]).alias("at"), F.when(opens, left).when(closes, closed).otherwise(acc["out"]).alias("out"))

    return F.aggregate(events, start, step, lambda acc: F.when(acc["at"].isNotNull(), F.array_append(acc["out"], row(acc["at"], none, none))).otherwise(acc["out"]))
