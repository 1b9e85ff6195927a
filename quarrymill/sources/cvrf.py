"""CVRF 1.1 documents: product trees of any depth, vulnerabilities, and a vendor's collections in either format."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.advisories import severity_from_score
from ..storage import written
from . import csaf

SCHEMA = (
    "DocumentTracking struct<InitialReleaseDate: string>, Vulnerability array<struct<CVE: string, Notes: struct<Note: array<struct<_VALUE: string, _Type: string>>>, "
    "ProductStatuses: struct<Status: array<struct<_Type: string, ProductID: array<string>>>>, CVSSScoreSets: struct<ScoreSet: array<struct<BaseScore: string, Vector: string>>>>>, _corrupt_record string"
)


def collect_products(text: str) -> list[tuple[str, str, str | None]]:
    """(product id, product, version) below the product tree, in the tree's order; a branch's own ids come before those of branches below.

    Product and version are the names of the nearest branches of these types, the
    branch itself included. A stack holds what is in force, so depth is free. Texts that are no XML have none.
    """
    found, stack, open_names = [], [], []  # stack: (path, product, version, branches so far)
    parser = ET.XMLPullParser(("start", "end"))
    try:
        parser.feed(text.encode())
        parser.close()
        for event, e in parser.read_events():
            tag = e.tag.rsplit("}", 1)[-1]
            if tag == "ProductTree":
                stack = [[(), None, None, 0]] if event == "start" else []
            elif tag == "Branch" and stack:
                if event == "end":
                    stack.pop()
                    continue
                path, product, version, seen = stack[-1]
                stack[-1][3] += 1
                kind, name = e.get("Type"), e.get("Name")
                stack.append([(*path, seen), name if kind == "Product Name" and name is not None else product, name if kind == "Product Version" and name is not None else version, 0])
            elif tag == "FullProductName" and event == "start" and stack:
                open_names.append((stack[-1][0], e.get("ProductID"), *stack[-1][1:3]))
    except ET.ParseError:
        return []
    for _, ident, product, version in sorted(open_names, key=lambda x: x[0]):
        if ident and product:
            found.append((ident, product, version))
    return found


def _products(batches):
    for batch in batches:
        rows = [(i, k, *x) for i, text in zip(*(batch.column(n).to_pylist() for n in ("id", "text")), strict=True) for k, x in enumerate(collect_products(text or ""))]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "pos", "product_id", "product", "version"])


def product_map(documents: DataFrame) -> DataFrame:
    """(id, product_id, product, version) of CVRF documents (id, text); of a repeated id the tree's last counts."""
    rows = documents.select("id", "text").mapInArrow(_products, "id string, pos long, product_id string, product string, version string")
    return rows.groupBy("id", "product_id").agg(F.max_by(F.struct("product", "version"), "pos").alias("v")).select("id", "product_id", "v.*")


def read_cvrf(documents: DataFrame) -> DataFrame:
    """(id, published_at, vuln, v) with a row per vulnerability that has a CVE id; documents that do not parse give none."""
    d = documents.select("id", F.from_xml("text", SCHEMA).alias("d")).where("d is not null and d._corrupt_record is null")
    return d.select("id", F.try_to_timestamp("d.DocumentTracking.InitialReleaseDate").alias("published_at"), F.posexplode("d.Vulnerability").alias("vuln", "v")).where("v.CVE <> ''")


def _number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?\d*\.?\d+)", 1).try_cast("double")


def cvrf_advisories(documents: DataFrame) -> DataFrame:
    """A row per document and CVE, as ``csaf_advisories`` gives them; entries of one CVE make one row.

    It has the affected products of all entries in order, the first of the highest scores and the first details.
    """
    v = written(read_cvrf(documents), "entries")
    rows = v.select("id", F.col("v.CVE").alias("cve_id"), "vuln", F.explode("v.ProductStatuses.Status").alias("s")).where("s._Type = 'Known Affected'")
    rows = rows.select("id", "cve_id", "vuln", F.posexplode("s.ProductID").alias("nth", "product_id")).join(product_map(documents).hint("merge"), ["id", "product_id"])
    first = rows.groupBy("id", "cve_id", "product", "version").agg(F.min(F.struct("vuln", "nth")).alias("at"))
    p = F.struct(*csaf._product(F.col("product"), exact=F.nullif(F.col("version"), F.lit("")), patch=F.lit(True)))
    listed = first.groupBy("id", "cve_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", p.alias("p")))), lambda x: x["p"]).alias("products"))

    score = _number(F.col("s.BaseScore"))
    scores = v.select("id", F.col("v.CVE").alias("cve_id"), "vuln", F.posexplode("v.CVSSScoreSets.ScoreSet").alias("nth", "s")).where(score.isNotNull())
    best = scores.groupBy("id", "cve_id").agg(F.max_by(F.struct(score.alias("score"), F.col("s.Vector").alias("vector")), F.struct(score, -F.col("vuln"), -F.col("nth"))).alias("best"))
    details = F.regexp_replace(F.get(F.filter("v.Notes.Note", lambda n: n["_Type"] == "Details"), 0)["_VALUE"], r"^\s+|\s+\z", "")
    told = v.withColumn("details", F.nullif(details, F.lit("")))
    heads = told.groupBy("id", F.col("v.CVE").alias("cve_id")).agg(F.min("published_at").alias("published_at"), F.expr("min_by(details, vuln) FILTER (WHERE details IS NOT NULL)").alias("details"))
    none = F.lit(None).cast("string")
    return heads.join(best.hint("merge"), ["id", "cve_id"], "left").join(listed.hint("merge"), ["id", "cve_id"]).select(
        "published_at", F.concat("id", F.lit("-"), "cve_id").alias("external_id"), "cve_id", F.coalesce("details", F.concat(F.upper("id"), F.lit(": "), "cve_id")).alias("summary"),
        severity_from_score(F.col("best.score")).alias("severity"), F.col("best.score").alias("score"), F.col("best.vector").alias("vector"),
        F.concat(F.lit("https://www.oracle.com/security-alerts/"), "id", F.lit(".html")).alias("url"), none.alias("workaround"), none.alias("solution"), "products",
    )


def collection_of(link: Column) -> Column:
    """The collection that a link of the vendor's feed names, null if it names none."""
    return F.nullif(F.regexp_extract(link, r"security-alerts/(cpu\w+)\.html", 1), F.lit(""))


def cpu_advisories(links: DataFrame, csaf_documents: DataFrame, cvrf_documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(advisories, failed): rows of all linked collections, of the CSAF document where it can be read and else of the CVRF one.

    ``failed`` has the collections that neither format has.
    """
    wanted = links.select(collection_of(F.col("link")).alias("id")).where("id is not null").distinct()
    linked = wanted.hint("merge")
    new = written(csaf.read_csaf(csaf_documents.join(linked, "id", "left_semi")), "csaf")
    old = cvrf_documents.where(F.from_xml("text", SCHEMA)["_corrupt_record"].isNull()).select("id", "text")
    old = written(old.join(linked, "id", "left_semi").join(new.select("id").hint("merge"), "id", "left_anti"), "cvrf")
    rows = csaf.advisories(new, "oracle").unionByName(cvrf_advisories(old))
    have = new.select("id").unionByName(old.select("id")).distinct()
    return rows, wanted.join(have.hint("merge"), "id", "left_anti")
