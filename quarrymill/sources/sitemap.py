"""Advisories of a vendor who lists all of them in a sitemap, the latest in RSS, and the rest by their pages' titles alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages as G
from ..functions.advisories import cve_ids

_ITEM = "array<struct<guid: struct<_VALUE: string>, title: string, link: string, pubDate: string, description: string>>"
_RSS = f"channel struct<item: {_ITEM}>"
# Where the vendor's advisories are, and how their ids begin.
ADDRESS, IDENT = "https://www.sophos.com/en-us/security-advisories", r"security-advisories/(sophos-sa-[^<\s\"]+)"


def sitemap_ids(texts: DataFrame) -> DataFrame:
    """(ident): distinct ids of sitemap texts (text)."""
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(IDENT), 1)).alias("ident")).distinct()


def rss_items(texts: DataFrame) -> DataFrame:
    """(ident, title, link, published, description) of RSS texts (text); of items that share an id the last counts."""
    rows = texts.select(F.from_xml("text", _RSS).alias("d")).select(F.posexplode("d.channel.item").alias("pos", "i"))
    last = rows.where("i.guid._VALUE <> ''").groupBy(F.col("i.guid._VALUE").alias("ident")).agg(F.max_by("i", "pos").alias("i"))
    return last.select("ident", "i.title", "i.link", F.col("i.pubDate").alias("published"), "i.description")


def ids_in(ident: Column) -> Column:
    """CVE ids that an advisory's id spells, as 'sophos-sa-cve-2020-9363'."""
    spaced = F.regexp_replace(F.replace(ident, F.lit("-"), F.lit(" ")), r"(?i)cve ", "CVE-")
    return cve_ids(F.regexp_replace(spaced, r"CVE-(\d{4}) (\d+)", "CVE-$1-$2"))


def known_severity(description: Column) -> Column:
    return G.known_severity(F.trim(F.nullif(F.regexp_extract(description, r"(?i)<strong>Severity:</strong>\s*([^<]+)", 1), F.lit(""))))


def product(title: Column) -> Column:
    """'… in Sophos Firewall Software (CVE-…)' as 'Sophos Firewall', and 'Sophos' where no product is named."""
    name = F.regexp_extract(title, r"(?i)\bin\s+Sophos\s+(.+?)(?:\s+Firmware|\s+Software|\s*\(CVE|\s*\||\s*$)", 1)
    return F.when(name != "", F.concat(F.lit("Sophos "), F.trim(name))).otherwise("Sophos")


def advisories(sitemap: DataFrame, rss: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(advisories, failed). A row for each listed id and CVE id (one without any has one row).

    ``sitemap``: ident. ``rss``: as ``rss_items`` gives it; what it has holds. ``pages`` (ident, html): landed pages of the others; their
    title holds, CVE ids come from the id, else the title, else the page's text. ``failed`` has the ids that neither
    has; an advisory without title and CVE id is left out.
    """
    none = F.array().cast("array<string>")
    some = lambda *c: F.coalesce(*(F.when(F.size(x) > 0, x) for x in c), none)
    r = rss.select("ident", F.struct(F.coalesce("title", F.lit("")).alias("title"), "link", "published", F.coalesce("description", F.lit("")).alias("description")).alias("r"))
    p = pages.where("html is not null").groupBy("ident").agg(F.max("html").alias("html"))
    rows = sitemap.select("ident").distinct().join(r, "ident", "left").join(p, "ident", "left")
    failed = rows.where("r is null and html is null").select("ident")

    head = F.nullif(F.regexp_extract("html", "<title>([^<]+)</title>", 1), F.lit(""))
    page_title = F.trim(F.regexp_replace(head, r"\s*\|\s*Sophos\s*\z", ""))
    in_page = F.when(page_title != "", cve_ids(G.strip_tags(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "))))
    of_page = some(ids_in(F.col("ident")), cve_ids(page_title), F.coalesce(in_page, none))
    is_new = F.col("r").isNotNull()
    told = rows.select(
        "ident", F.when(is_new, F.col("r.title")).otherwise(page_title).alias("title"),
        F.when(is_new, cve_ids(F.concat(F.col("r.title"), F.lit(" "), F.col("r.description")))).otherwise(of_page).alias("cves"),
        F.when(is_new, known_severity(F.col("r.description"))).alias("severity"), F.when(is_new, F.try_to_timestamp(F.regexp_replace("r.published", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))).alias("published_at"),
        F.when(is_new, G.page_address(F.coalesce("r.link", F.concat(F.lit(ADDRESS + "/"), "ident")))).otherwise(F.concat(F.lit(ADDRESS + "/"), "ident")).alias("url"),
    )
    kept = told.where("title <> '' or size(cves) > 0").withColumn("cve_id", F.explode_outer("cves"))
    out = kept.select(
        G.per_cve(F.col("ident"), F.col("cve_id")).alias("external_id"), "cve_id", F.col("title").alias("summary"), "severity", "url", "published_at",
        product(F.coalesce(F.nullif("title", F.lit("")), "ident")).alias("product"), F.coalesce(F.lower("title").startswith("resolved"), F.lit(False)).alias("patch_available"),
    )
    return out, failed
