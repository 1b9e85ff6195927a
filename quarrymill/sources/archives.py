"""Zip archives of JSON records: entries streamed one by one, large archives dealt to many tasks."""

from __future__ import annotations

import json
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feeds

#: Uncompressed bytes of the entries that one group of rows stands for.
GROUP_BYTES = 32 << 20
_BATCH_BYTES = 4 << 20
MALWARE = "osv/malicious/"
_BAD = (zipfile.BadZipFile, zlib.error, pa.ArrowInvalid, EOFError, NotImplementedError, RuntimeError, UnicodeDecodeError)


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _list(suffix: str, prefix: str):
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, group, held = [], 0, 0
                try:
                    with _open(path) as f, zipfile.ZipFile(f) as z:
                        for i, e in enumerate(z.infolist()):
                            if e.filename.endswith(suffix) and e.filename.startswith(prefix):
                                rows.append((path, i, group, None))
                                held += e.file_size
                                if held >= GROUP_BYTES:
                                    group, held = group + 1, 0
                except _BAD as error:
                    rows = [(path, None, 0, str(error))]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "entry", "part", "error"])

    return run


_ENTRIES = "path string, name string, text string, error string"


def _read(batches):
    rows, size, now, archive, source = [], 0, None, None, None

    def flush():
        cols = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "name", "text", "error"])

    for batch in batches:
        for path, entry, error in zip(*(batch.column(n).to_pylist() for n in ("path", "entry", "error")), strict=True):
            if entry is None:
                rows.append((path, None, None, error))
                continue
            if path != now:
                if archive is not None:
                    archive.close()
                    source.close()
                source, now = _open(path), path
                archive = zipfile.ZipFile(source)
            info = archive.infolist()[entry]
            try:
                text = archive.read(info).decode("utf-8")
                json.loads(text)
                rows.append((path, info.filename, text, None))
                size += len(text)
            except (*_BAD, ValueError) as error_:
                rows.append((path, info.filename, None, str(error_)))
            if size >= _BATCH_BYTES:
                yield flush()
                size = 0
    if rows:
        yield flush()
    if archive is not None:
        archive.close()
        source.close()


def zip_entries(spark: SparkSession, path: str, suffix: str = ".json", prefix: str = "") -> DataFrame:
    """A row per entry of the archives at ``path`` whose name fits: path, name, text, and error where it can't be read.

    Names and places come from the archives' directories, so others are not
    inflated; a task holds one entry and a batch of few megabytes. An archive
    that is none has one row with an error and no name.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    listed = files.mapInArrow(_list(suffix, prefix), "path string, entry long, part long, error string")
    dealt = listed.repartition("path", "part").sortWithinPartitions("path", "entry")
    return dealt.mapInArrow(_read, _ENTRIES)


def _kept(entries: DataFrame, since: str | Column | None) -> DataFrame:
    schema = feeds.OSV.removesuffix(", _corrupt_record string")
    rows = entries.select("path", "name", F.from_json("text", schema).alias("r"), "error")
    failed = F.col("error").isNotNull() | F.col("r.id").isNull()
    old = F.lit(False) if since is None else F.coalesce(F.to_timestamp("r.modified") <= F.to_timestamp(F.lit(since) if isinstance(since, str) else since), F.lit(False))
    return rows.withColumn("outcome", F.when(failed, "failed").when(old, "skipped").otherwise("succeeded"))


def archive_records(entries: DataFrame, since: str | Column | None = None) -> DataFrame:
    """OSV records of entries; with ``since``, those changed after it and those that don't say when."""
    return _kept(entries, since).where("outcome = 'succeeded'").select("r.*")


def archive_counts(entries: DataFrame, since: str | Column | None = None) -> DataFrame:
    """One row: total, succeeded, skipped and failed entries."""
    return _kept(entries, since).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("outcome") == w).alias(w) for w in ("succeeded", "skipped", "failed")))


def by_id(records: DataFrame, ident: str) -> DataFrame:
    return records.where(F.col("id") == ident)


def by_package(records: DataFrame, ecosystem: str, name: str | None = None) -> DataFrame:
    """Records that affect a package, or any of the ecosystem."""
    fits = lambda a: (a["package"]["ecosystem"] == ecosystem) & (F.lit(True) if name is None else a["package"]["name"] == name)
    return records.where(F.exists("affected", fits))
