"""Queries over what a collector lands, pages and archives, made here of the given tables, and the same results in SQL."""

from __future__ import annotations

import zipfile
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import archives, nvd, nvd_pages
from ..storage import new_folder
from .documents import fill
from .queries import view

c = F.col

_CVE = (
    '<"cve":<"id":"CVE-2024-{o}","configurations":[<"nodes":[{repeat("[", o % 7)}<"cpeMatch":[<"vulnerable":true,"criteria":"cpe:2.3:a:acme:pkg{o % 200}:*:*:*:*:*:*:*:*","versionEndExcluding":"{o % 9 + 1}.{o % 5}.0">,'
    '<"vulnerable":false,"criteria":"cpe:2.3:o:acme:os:*:*:*:*:*:*:*:*">]>{repeat("]", o % 7)}]>]>>'
)


def _cve():
    """A record whose node lies up to six levels deep."""
    text = F.translate(fill(_CVE.replace('repeat("[", o % 7)', "repeat('@', o % 7)").replace('repeat("]", o % 7)', "repeat('^', o % 7)")), "<>", "{}")
    return F.replace(F.replace(text, F.lit("@"), F.lit('{"operator":"OR","children":[')), F.lit("^"), F.lit("]}"))


def pages(spark, d):
    step = nvd_pages.millis(datetime(1970, 1, 1, tzinfo=UTC) + nvd_pages.WINDOW + nvd_pages.STEP)
    rows = view(spark, d, "SELECT o_orderkey AS o, o_orderdate AS at FROM orders").withColumn("ms", F.unix_millis(c("at").cast("timestamp")))
    first, last = rows.agg(F.min("ms"), F.max("ms")).first()
    rows = rows.withColumn("w", F.floor((c("ms") - F.lit(first)) / step))
    nth = F.row_number().over(Window.partitionBy("w").orderBy("o")) - 1
    placed = rows.withColumn("start", nth - nth % nvd_pages.PAGE).join(rows.groupBy("w").agg(F.count(F.lit(1)).alias("total")), "w")
    made = placed.groupBy("w", "start").agg(F.min("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", _cve().alias("cve")))), lambda x: x["cve"]), ",").alias("cves"))
    text = F.concat(F.lit('{"startIndex":'), "start", F.lit(',"totalResults":'), "total", F.lit(',"vulnerabilities":['), "cves", F.lit("]}"))
    root = new_folder(spark, "nvd-pages")
    made.select((F.lit(first) + c("w") * step).alias("window"), "start", text.alias("value")).write.partitionBy("window", "start").text(root)
    iso = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None).isoformat()
    found = nvd_pages.read_windows(spark, root, iso(first), iso(last + 1))
    return nvd.affected(nvd_pages.records(found)).select("id", "package_name", "end_excluding", "fixed_int")


def _zip(root: str, size: int):
    """Archives of at most ``size`` entries, one after the other."""

    def run(batches):
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        part, n, out, archive = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if n % size == 0:
                    if archive is not None:
                        archive.close()
                        out.close()
                    out = system.open_output_stream(f"{base}/{part:05d}-{n // size:05d}.zip")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(name, text)
                n += 1
        if archive is not None:
            archive.close()
            out.close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return run


_RECORD = '<"id":"OSV-{o}","modified":"2024-01-{lpad(o % 28 + 1, 2, 0)}T00:00:00Z","affected":[<"package":<"ecosystem":"npm","name":"pkg{o % 200}">>]'


def _entries(spark, d):
    rows = view(spark, d, "SELECT o_orderkey AS o FROM orders")
    text = F.concat(F.translate(fill(_RECORD), "<>", "{}"), F.when(c("o") % 50 != 0, "}").otherwise(""))
    rows = rows.select(F.concat(F.lit("npm/OSV-"), c("o").cast("string"), F.when(c("o") % 10 == 1, ".txt").otherwise(".json")).alias("name"), text.alias("text"))
    root = new_folder(spark, "archives")
    rows.mapInArrow(_zip(root, 5000), "n long").agg(F.sum("n")).collect()
    return archives.zip_entries(spark, f"{root}/*.zip")


def archive(spark, d):
    rows = archives.archive_records(_entries(spark, d))
    return archives.by_package(rows, "npm").select("id", "modified", F.col("affected")[0]["package"]["name"].alias("package_name"))


def archive_counts(spark, d):
    return archives.archive_counts(_entries(spark, d), "2024-01-15T00:00:00Z")


#: name → (query, SQL)
QUERIES = {
    "nvd_pages": (pages, """SELECT 'CVE-2024-' || o AS id, 'pkg' || (o%200) AS package_name, (o%9 + 1) || '.' || (o%5) || '.0' AS end_excluding, CAST((o%9 + 1)*1000000000 + (o%5)*1000000 AS BIGINT) AS fixed_int
      FROM (SELECT CAST(o_orderkey AS BIGINT) AS o FROM orders)"""),
    "osv_archive": (archive, """SELECT 'OSV-' || o_orderkey AS id, '2024-01-' || lpad(CAST(o_orderkey%28 + 1 AS varchar), 2, '0') || 'T00:00:00Z' AS modified, 'pkg' || (o_orderkey%200) AS package_name
      FROM orders WHERE o_orderkey%10 <> 1 AND o_orderkey%50 <> 0"""),
    "osv_archive_counts": (archive_counts, """SELECT count(*) AS total, count(*) FILTER (o%50 <> 0 AND o%28 >= 15) AS succeeded, count(*) FILTER (o%50 <> 0 AND o%28 < 15) AS skipped, count(*) FILTER (o%50 = 0) AS failed
      FROM (SELECT o_orderkey AS o FROM orders WHERE o_orderkey%10 <> 1)"""),
}
