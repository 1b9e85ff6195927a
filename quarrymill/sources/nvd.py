"""NVD records: score, summary and affected version ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ecosystems as E
from ..functions import versions as V
from ..operators.trees import unfold

_MATCH = "array<struct<vulnerable: boolean, criteria: string, versionStartIncluding: string, versionStartExcluding: string, versionEndIncluding: string, versionEndExcluding: string>>"
_SCORE = "array<struct<cvssData: struct<baseScore: double, vectorString: string, baseSeverity: string>, baseSeverity: string>>"
SCHEMA = (
    "id string, published string, lastModified string, descriptions array<struct<lang: string, value: string>>, "
    f"metrics struct<cvssMetricV31: {_SCORE}, cvssMetricV40: {_SCORE}, cvssMetricV2: {_SCORE}>, configurations variant"
)


def cvss(metrics: Column) -> Column:
    """(score, vector, severity) of the first of versions 3.1, 4.0 and 2."""
    first = [F.get(metrics[k], 0) for k in ("cvssMetricV31", "cvssMetricV40", "cvssMetricV2")]
    picked = [F.when(m.isNotNull(), F.struct(m["cvssData"]["baseScore"].alias("score"), m["cvssData"]["vectorString"].alias("vector"), F.coalesce(m["cvssData"]["baseSeverity"], m["baseSeverity"]).alias("severity"))) for m in first]
    return F.coalesce(*picked)


def english(descriptions: Column) -> Column:
    return F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), 0)["value"]


def matches(records: DataFrame) -> DataFrame:
    """(id, m): vulnerable matches of all nodes, at any depth; operators and negation are not evaluated."""

    def node(v: Column) -> Column:
        return F.struct(F.try_variant_get(v, "$.cpeMatch", _MATCH).alias("matches"), F.try_variant_get(v, "$.children", "array<variant>").alias("branches"))

    nodes = F.flatten(F.transform(F.col("configurations").try_cast("array<variant>"), lambda c: F.coalesce(F.try_variant_get(c, "$.nodes", "array<variant>"), F.array().cast("array<variant>"))))
    roots = records.select("id", F.explode(nodes).alias("v")).select("id", node(F.col("v")).alias("n")).select("id", "n.*")
    return unfold(roots, ["id"], lambda v, _: node(v)).select("id", F.explode("matches").alias("m")).where("m.vulnerable")


def affected(records: DataFrame) -> DataFrame:
    """A row for each vulnerable match: its names, bounds and their integer forms.

    A match without bounds is the version in its name. A range of one version takes up an update or rc qualifier of
    the name. An excluded start counts as included in the integer form.
    """
    found = matches(records).withColumn("p", E.parse_listed_cpe(F.col("m.criteria"))).where("p is not null")
    bound = {k: F.nullif(F.col(f"m.version{k}"), F.lit("")) for k in ("StartIncluding", "StartExcluding", "EndIncluding", "EndExcluding")}
    point = F.when(F.coalesce(*bound.values()).isNull(), F.col("p.version"))
    update = F.get(F.split("m.criteria", ":"), 6)
    base = bound["StartIncluding"]
    number, rc = F.regexp_extract(update, r"(?i)^update_?(\d+)$", 1), F.regexp_extract(update, r"(?i)^rc(\d*)$", 1)
    qualified = F.when(
        bound["StartExcluding"].isNull() & bound["EndExcluding"].isNull() & (base == bound["EndIncluding"]),
        F.when(number != "", F.concat(base, F.lit("_"), number)).when(F.lower(update).rlike("^rc[0-9]*$"), F.concat(base, F.lit("-rc"), rc)),
    )
    return found.select(
        "id", F.col("m.criteria").alias("cpe"), F.col("p.vendor").alias("vendor"), F.col("p.product").alias("package_name"), E.vendor_ecosystem(F.col("p.vendor")).alias("ecosystem"),
        F.coalesce(qualified, base, point).alias("start_including"), bound["StartExcluding"].alias("start_excluding"),
        F.coalesce(qualified, bound["EndIncluding"], point).alias("end_including"), bound["EndExcluding"].alias("end_excluding"),
    ).select(
        "*", V.normalize_version(F.coalesce("start_including", "start_excluding")).alias("introduced_int"),
        V.normalize_version(F.col("end_excluding")).alias("fixed_int"), V.normalize_version(F.col("end_including")).alias("last_affected_int"),
    )
