"""Readers of landed feed snapshots, with explicit schemas and, but for the criteria of OVAL, without row-level functions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pages import FINISHED, UNFINISHED

EVENTS = "array<struct<introduced: string, fixed: string, last_affected: string>>"
OSV = (
    "id string, modified string, published string, summary string, aliases array<string>, upstream array<string>, "
    f"affected array<struct<package: struct<ecosystem: string, name: string, purl: string>, ranges: array<struct<type: string, events: {EVENTS}>>, versions: array<string>>>, "
    "database_specific struct<severity: string>, _corrupt_record string"
)
KEV = "vulnerabilities array<struct<cveID: string, vendorProject: string, product: string, dateAdded: string, dueDate: string, shortDescription: string, requiredAction: string>>"
EPSS = "cve string, epss string, percentile string"
CVE = "struct<_VALUE: string, _cvss3: string>"
CRITERION = "array<struct<_comment: string>>"
CRITERIA = f"struct<criterion: {CRITERION}, criteria: array<struct<criterion: {CRITERION}, criteria: array<struct<criterion: {CRITERION}>>>>>"
OVAL = (
    "_id string, _class string, metadata struct<title: string, reference: array<struct<_source: string, _ref_id: string, _ref_url: string>>, "
    f"advisory: struct<severity: string, cve: array<{CVE}>>>, criteria {CRITERIA}"
)


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per file; records that do not parse are kept with _corrupt_record set, for the counters."""
    return spark.read.schema(OSV).json(path, multiLine=True, mode="PERMISSIVE", pathGlobFilter="*.json", recursiveFileLookup=True)


def modified_since(records: DataFrame, since: str) -> DataFrame:
    return records.where(F.col("modified").isNull() | (F.col("modified") > since))


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(KEV).json(path, multiLine=True).select(F.inline("vulnerabilities"))
    return rows.withColumnRenamed("cveID", "cve_id")


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(EPSS).csv(path, header=True, comment="#")
    scored = rows.select(F.col("cve").alias("cve_id"), F.col("epss").try_cast("double").alias("score"), F.col("percentile").try_cast("double").alias("percentile"))
    return scored.where("cve_id like 'CVE-%' and score is not null and not isnan(score)")


def read_oval(spark: SparkSession, path: str) -> DataFrame:
    """Patch definitions of an OVAL file (bz2 too), split by row tag; criteria three levels deep (oval_fixes reads all)."""
    return spark.read.schema(OVAL).format("xml").option("rowTag", "definition").load(path).where("_class = 'patch'")


_MARKUP = re.compile(r"""<!--.*?-->|<(/?)(criteria|criterion)\b((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)>""", re.S)
_COMMENT = re.compile(r"""\bcomment=(?:"([^"]*)"|'([^']*)')""")
_MODULE = re.compile(r"^Module\s+\S+:(\S+)\s+is enabled$", re.I)


def collect_criteria(definition: str) -> list[tuple[str, str | None]]:
    """(comment, module label) of each criterion below the first criteria element, at any depth.

    A label holds on its own level and below it, where the last one of a level
    counts, and not for siblings; a level's own criteria come before nested ones.
    """
    top, path = None, []  # a level: its comments, its nested levels
    for m in _MARKUP.finditer(re.sub(UNFINISHED, FINISHED.format(r"\1"), definition)):
        closing, name, attributes, empty = m.groups()
        if name == "criteria" and closing:
            path.pop()
            if not path:
                break
        elif name == "criteria":
            level: tuple[list, list] = ([], [])
            if path:
                path[-1][1].append(level)
            else:
                top = level
            path.append(level)
            if empty:
                path.pop()
                if not path:
                    break
        elif name and not closing and path:
            found = _COMMENT.search(attributes)
            if found:
                path[-1][0].append(found[1] if found[1] is not None else found[2])
    out, todo = [], [(top, None)] if top else []
    while todo:
        (comments, nested), label = todo.pop()
        for comment in comments:
            got = _MODULE.match(comment)
            label = got[1] if got else label
        out += [(comment, label) for comment in comments]
        todo += [(level, label) for level in reversed(nested)]
    return out


def _criteria(batches):
    for batch in batches:
        rows = [(i, k, *x) for i, text in zip(*(batch.column(n).to_pylist() for n in ("id", "text")), strict=True) for k, x in enumerate(collect_criteria(text))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "pos", "comment", "module"])


def oval_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of the patch definitions of OVAL files."""
    text = F.regexp_extract("value", r"(?s)<definition\b[^>]*>.*", 0)
    found = spark.read.text(path, lineSep="</definition>").select(text.alias("text")).where(F.col("text").rlike(r"""^<definition\b[^>]*\bclass=["']patch["']"""))
    return found.select(F.regexp_extract("text", r"""^<definition\b[^>]*\bid=["']([^"']*)""", 1).alias("id"), "text")


def fixes_of(definitions: DataFrame) -> DataFrame:
    """A row per definition and fixed package and version, with the module in scope and the lowest affected version.

    Of repeated packages and versions of a definition the first counts.
    """
    from ..functions.advisories import fixed_comment
    from ..functions.versions import bare_floor, module_floor, strip_epoch

    rows = definitions.select("id", "text").mapInArrow(_criteria, "id string, pos long, comment string, module string").withColumn("fix", fixed_comment(F.col("comment")))
    fixes = rows.where("fix is not null").select("id", F.trim("fix.package").alias("package"), strip_epoch(F.col("fix.version")).alias("version_end"), "pos", "module")
    first = fixes.groupBy("id", "package", "version_end").agg(F.min_by("module", "pos").alias("module"), F.min("pos").alias("pos"))
    end = F.col("version_end")
    return first.withColumn("version_start", F.coalesce(module_floor(F.col("module"), end), bare_floor(F.col("package"), end)))


def oval_fixes(spark: SparkSession, path: str) -> DataFrame:
    """The fixes of the patch definitions of OVAL files."""
    return fixes_of(oval_definitions(spark, path))


# Per vendor, how its feed marks references to its own advisories.
OVAL_REFERENCES = {"red-hat": "RHSA", "oracle-linux": "elsa"}
_HEAD = f"metadata struct<title: string, reference: array<struct<_source: string, _ref_id: string, _ref_url: string>>, advisory: struct<severity: string, cve: array<{CVE}>>>"


def oval_advisories(definitions: DataFrame, vendor: str) -> DataFrame:
    """A row per definition and CVE (one without CVEs has one row), with the fixed packages in page order.

    The advisory's id is that of the vendor's own reference, else it is read from
    the definition's id; definitions without an id or without packages give no row.
    """
    from ..functions.advisories import severity
    from ..functions.pages import per_cve, score_and_vector

    head = F.from_xml(F.concat(F.regexp_extract("text", r"(?s)^.*?</metadata>", 0), F.lit("</definition>")), _HEAD)["metadata"]
    own = F.get(F.filter("head.reference", lambda r: r["_source"] == OVAL_REFERENCES[vendor]), 0)
    number = r":def:(\d{4})(\d+)$"
    year, rest = F.regexp_extract("id", number, 1), F.regexp_extract("id", number, 2)
    if vendor == "red-hat":
        kind = F.upper(F.regexp_extract("id", r"com\.redhat\.(rh[a-z]+):", 1))
        from_id = F.when((kind != "") & (year != ""), F.concat(kind, F.lit("-"), year, F.lit(":"), rest))
    else:
        from_id = F.when(year != "", F.concat(F.lit("ELSA-"), year, F.lit("-"), rest))
    text = F.lit(None).cast("string")
    product = F.struct(
        "pos", F.lit(vendor).alias("vendor"), F.col("package").alias("product"), "version_start", "version_end", text.alias("version_fixed"), text.alias("last_affected"),
        F.array().cast("array<string>").alias("versions"),
    )
    packages = fixes_of(definitions).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(product)), lambda p: p.dropFields("pos")).alias("products"))
    heads = definitions.select("id", head.alias("head")).where("head is not null").withColumn("own", own).withColumn("advisory_id", F.coalesce("own._ref_id", from_id))
    cves = F.filter(F.coalesce("head.advisory.cve", F.array()), lambda v: v["_VALUE"].startswith("CVE-"))
    rows = heads.where("advisory_id is not null").join(packages, "id").withColumn("cve", F.explode_outer(cves)).withColumn("cvss", score_and_vector(F.col("cve._cvss3")))
    return rows.select(
        per_cve(F.col("advisory_id"), F.col("cve._VALUE")).alias("external_id"), F.col("cve._VALUE").alias("cve_id"), F.col("cvss.score").alias("score"), F.col("cvss.vector").alias("vector"),
        F.col("head.title").alias("summary"), severity(F.col("head.advisory.severity")).alias("severity"), F.col("own._ref_url").alias("url"), "products",
    )


def advisory_ranges(advisories: DataFrame) -> DataFrame:
    """A row per advisory and product with integer bounds; a fixed version is the end where no end is stated."""
    from ..functions.versions import normalize_version

    p = advisories.select("external_id", F.explode("products").alias("p")).select("external_id", "p.*")
    return p.withColumns(
        {
            "vendor": F.trim("vendor"), "product": F.trim("product"), "version_start_int": normalize_version(F.col("version_start")),
            "version_end_int": normalize_version(F.coalesce("version_end", "version_fixed")), "last_affected_int": normalize_version(F.col("last_affected")),
        }
    )


def osv_ranges(records: DataFrame) -> DataFrame:
    """A row per version range, and one per package that only lists versions, with integer bounds."""
    from ..functions.advisories import event_ranges
    from ..functions.versions import normalize_version

    a = records.select("id", F.explode("affected").alias("a")).select("id", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package_name"), "a.ranges", F.coalesce("a.versions", F.array().cast("array<string>")).alias("versions"))
    kept = a.select("id", "ecosystem", "package_name", "versions", F.explode("ranges").alias("r")).where(F.col("r.type").isin("SEMVER", "ECOSYSTEM"))
    ranged = kept.select("id", "ecosystem", "package_name", F.lower("r.type").alias("kind"), "versions", F.inline(event_ranges(F.col("r.events"))))
    none = F.lit(None).cast("string")
    listed = a.where("ranges is null and size(versions) > 0").select(
        "id", "ecosystem", "package_name", F.lit("versions").alias("kind"), "versions", none.alias("introduced"), none.alias("fixed"), none.alias("last_affected")
    )
    return ranged.unionByName(listed).withColumns({f"{c}_int": normalize_version(F.col(c)) for c in ("introduced", "fixed", "last_affected")})
