"""Advisories of vendors who publish them as HTML pages: entries in page order, grouped by CVE id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pages as G
from ..operators.sweeps import segments

# Severities by the vendors' words, what marks an entry, its heading and the section it is in, and what a version begins with.
SEVERITIES = {"critical": "CRITICAL", "important": "HIGH", "high": "HIGH", "moderate": "MEDIUM", "medium": "MEDIUM", "low": "LOW"}
AFFECTS = r"(?i:Affects:\s*[^\n<])"
HEADING = r"(?is)<strong>.*?</strong>.*?(?=</p>|<p\b)"
SECTION = r'<h3 id="Fixed_in_Apache_Tomcat_([\d.A-Za-z]+)">'
VERSION = r"^\d+\.\d+"
_RANGE = "array<struct<introduced: string, last_affected: string>>"


def _range(introduced: Column, last: Column) -> Column:
    return F.struct(introduced.alias("introduced"), last.alias("last_affected"))


def affects_range(text: Column) -> Column:
    """(introduced, last_affected) of 'X to Y' or of one version X; null for other texts. The end is inclusive."""
    text = F.trim(F.regexp_replace(text, r"(?i)^Apache\s+Tomcat\s+", ""))
    both, one = r"(?i)^([\d.A-Za-z-]+)\s+to\s+([\d.A-Za-z-]+)", r"^([\d.A-Za-z-]+)"
    start, end, single = F.regexp_extract(text, both, 1), F.regexp_extract(text, both, 2), F.regexp_extract(text, one, 1)
    return F.when(start.rlike(VERSION) & end.rlike(VERSION), _range(start, end)).when(single.rlike(VERSION), _range(single, single))


def listed_ranges(text: Column) -> Column:
    """Ranges of '0.6.18-1.25.2, 1.5.10'; parts that begin with no version are left out."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    form = r"^([^-]+)-(.*)\z"

    def one(p: Column) -> Column:
        start, end = F.trim(F.regexp_extract(p, form, 1)), F.trim(F.regexp_extract(p, form, 2))
        return F.when(start.rlike(VERSION) & end.rlike(VERSION), _range(start, end)).when(p.rlike(VERSION), _range(p, p))

    return F.array_compact(F.transform(parts, one))


_ENTRY = ("page", "pos", "cve_id", "word", "introduced", "last_affected", "version_fixed")


def sectioned_entries(pages: DataFrame) -> DataFrame:
    """Entries of pages (page, html) with a line 'Affects: …' behind each heading, in sections by fixed version.

    An entry reaches from the line before its own; CVE ids and severity count only in its heading. The fixed version is
    that of the last section that begins before the line.
    """
    rows = segments(pages.select("page", "html"), AFFECTS)
    section = F.try_element_at(F.regexp_extract_all("before", F.lit(SECTION), 1), F.lit(-1))
    so_far = Window.partitionBy("page").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("version_fixed", F.last(section, ignorenulls=True).over(so_far))
    heading = F.regexp_extract("before", HEADING, 0)
    word = F.nullif(F.lower(F.regexp_extract(heading, r"(?i)\b(Critical|Important|Moderate|Low)\b", 1)), F.lit(""))
    got = affects_range(F.regexp_extract("hit", r"(?i)^Affects:\s*([^\n<]+)", 1))
    rows = rows.select("page", F.col("nth").alias("pos"), F.explode(F.array_distinct(F.regexp_extract_all(heading, F.lit(r"(CVE-\d{4}-\d+)"), 1))).alias("cve_id"), word.alias("word"), got.alias("r"), "version_fixed")
    return rows.where("r is not null").select("page", "pos", "cve_id", "word", "r.*", "version_fixed")


def list_entries(pages: DataFrame) -> DataFrame:
    """Entries of pages (page, html) that are items of a list with 'Vulnerable:', 'Not vulnerable:' and 'Severity:' lines.

    A range's fixed version is the listed one that is exactly one behind its end.
    """
    rows = pages.select("page", F.posexplode(F.split("html", "(?i)</li>")).alias("block", "b"))
    line = lambda text, name: F.regexp_extract(text, rf"(?i){name}:\s*([^\n<]+)", 1)
    ranges = listed_ranges(F.trim(line(F.regexp_replace("b", r"(?i)Not vulnerable:[^\n<]*", ""), "Vulnerable")))
    word = F.nullif(F.lower(F.regexp_extract("b", r"(?i)Severity:\s*(\w+)", 1)), F.lit(""))
    rows = rows.select("page", "block", F.array_distinct(F.regexp_extract_all("b", F.lit(r"(CVE-\d{4}-\d+)"), 1)).alias("cves"), word.alias("word"), G.not_vulnerable(line(F.col("b"), "Not vulnerable")).alias("fixes"), ranges.alias("ranges"))
    rows = rows.select("page", "block", F.explode("cves").alias("cve_id"), "word", "fixes", "ranges").select("page", "block", "cve_id", "word", "fixes", F.posexplode("ranges").alias("nth", "r"))
    return rows.select("page", F.struct("block", "nth").alias("pos"), "cve_id", "word", "r.*", G.fix_after(F.col("r.last_affected"), F.col("fixes")).alias("version_fixed"))


def by_cve(entries: DataFrame) -> DataFrame:
    """(cve_id, severity, page, products): entries of each CVE in order, of equal ranges the first; the first severity that is known.

    A word that the table of severities doesn't know makes it null, but 'unknown' is passed over.
    """
    at = F.struct("page", "pos")
    first = entries.groupBy("cve_id", "introduced", "last_affected").agg(F.min(F.struct(at.alias("at"), "version_fixed")).alias("e"))
    product = F.struct(F.col("e.at").alias("at"), "introduced", "last_affected", F.col("e.version_fixed").alias("version_fixed"))
    listed = first.groupBy("cve_id").agg(F.transform(F.array_sort(F.collect_list(product)), lambda p: p.dropFields("at")).alias("products"))
    known = F.col("word").isNotNull() & (F.col("word") != "unknown")
    heads = entries.groupBy("cve_id").agg(F.min("page").alias("page"), F.min(F.when(known, F.struct(at.alias("at"), "word")))["word"].alias("word"))
    table = F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair))
    return heads.join(listed, "cve_id").select("cve_id", table[F.col("word")].alias("severity"), "page", "products")
