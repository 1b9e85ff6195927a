"""A data source of NVD pages: windows of publication or change dates as a batch, all pages as a resumable stream.

    spark.dataSource.register(NvdPages)
    spark.read.format("nvd_pages").option("path", …).option("start", …).option("end", …).load()
    spark.readStream.format("nvd_pages").option("path", …).load()

Pages are JSON answers that a collector has landed, one in each folder: below
``path``, ``window=<milliseconds of its start>/start=<index of its first
result>`` for windows, ``start=<index>`` alone for the stream. ``open_page`` is
the one method that knows this; a subclass may fetch pages from elsewhere.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import nvd

#: The longest range of dates that one request may ask for, and how far the next one starts behind it.
WINDOW = timedelta(days=120)
STEP = timedelta(milliseconds=1)
PAGE = 2000
RETRIES, FIRST_WAIT = 3, 2.0
SCHEMA = "id string, start_index long, cve string"


def windows(start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    out = []
    while start < end:
        stop = min(start + WINDOW, end)
        out.append((start, stop))
        start = stop + STEP
    return out


def millis(t: datetime) -> int:
    return round((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(milliseconds=1))


def transient(error: BaseException) -> bool:
    """Lost connections, timeouts and answers of 500 and above pass; others do not."""
    return isinstance(error, (ConnectionError, TimeoutError)) or getattr(error, "status", 0) >= 500


def with_retry(get, retries: int = RETRIES, wait: float = FIRST_WAIT):
    """The value of ``get``; a transient error is tried again after 2, 4, … seconds, the last one is raised."""
    for attempt in range(1, retries + 1):
        try:
            return get()
        except Exception as error:
            if attempt == retries or not transient(error):
                raise
            time.sleep(wait * 2 ** (attempt - 1))
    raise ValueError("retries must be positive")


def _batch(start: int, items: list) -> pa.RecordBatch:
    cves = [v["cve"] for v in items]
    return pa.RecordBatch.from_arrays(
        [pa.array([c.get("id") for c in cves], pa.string()), pa.array(range(start, start + len(cves)), pa.int64()), pa.array([json.dumps(c) for c in cves], pa.string())], names=["id", "start_index", "cve"]
    )


class _Window(InputPartition):
    def __init__(self, start: int):
        self.start = start


class _Windows(DataSourceReader):
    """A partition per window, which asks for page after page until all results are there."""

    def __init__(self, source: NvdPages):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        date = lambda name: datetime.fromisoformat(self.source.options[name]).replace(tzinfo=UTC)
        return [_Window(millis(a)) for a, _ in windows(date("start"), date("end"))] or [_Window(-1)]

    def read(self, partition: _Window) -> Iterator[pa.RecordBatch]:
        at, total = 0, 0 if partition.start < 0 else 1
        while at < total:
            page = self.source.page(at, partition.start)
            total, items = page["totalResults"], page["vulnerabilities"]
            if not items and at < total:
                raise ValueError(f"no results at {at} of {total}")
            yield _batch(at, items)
            at += len(items)


class _Span(InputPartition):
    def __init__(self, page: int, start: int, end: int):
        self.page, self.start, self.end = page, start, end


class _Stream(DataSourceStreamReader):
    """The offset is the number of results read, so a page that has grown goes on where it was left."""

    def __init__(self, source: NvdPages):
        self.source = source

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        known, at, size = set(self.source.landed()), 0, int(self.source.options.get("pageSize", PAGE))
        while at in known:
            if at + size in known:
                at += size
                continue
            n = len(self.source.page(at)["vulnerabilities"])  # the last page alone
            at += n
            if not n:
                break
        return {"next": at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pages = sorted(p for p in self.source.landed() if p < end["next"])
        spans = zip(pages, [*pages[1:], end["next"]], strict=True)
        return [_Span(p, max(p, start["next"]), stop) for p, stop in spans if stop > start["next"]]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        items = self.source.page(partition.page)["vulnerabilities"]
        yield _batch(partition.start, items[partition.start - partition.page : partition.end - partition.page])


class NvdPages(DataSource):
    """Rows (id, start_index, cve); start_index is the place among the window's, or all, results, cve the record as JSON."""

    @classmethod
    def name(cls) -> str:
        return "nvd_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Windows(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)

    def _root(self):
        return fs.FileSystem.from_uri(self.options["path"])

    def open_page(self, index: int, window: int | None) -> dict:
        system, base = self._root()
        folder = f"{base}/start={index}" if window is None else f"{base}/window={window}/start={index}"
        found = [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        if not found:
            if index == 0:  # nothing happened in this window
                return {"totalResults": 0, "vulnerabilities": []}
            raise FileNotFoundError(folder)
        with system.open_input_stream(found[0]) as f:
            return json.loads(f.read())

    def page(self, index: int, window: int | None = None) -> dict:
        return with_retry(lambda: self.open_page(index, window), wait=float(self.options.get("wait", FIRST_WAIT)))

    def landed(self) -> list[int]:
        """Where the landed pages of the stream start."""
        system, base = self._root()
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return [int(f.base_name.removeprefix("start=")) for f in found if f.base_name.startswith("start=")]


def records(pages: DataFrame) -> DataFrame:
    """Records with the fields that ``nvd.affected`` and ``nvd.cvss`` read; those without id are left out."""
    return pages.select(F.from_json("cve", nvd.SCHEMA).alias("r")).select("r.*").where("id is not null")


def read_windows(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    spark.dataSource.register(NvdPages)
    return spark.read.format("nvd_pages").option("path", path).option("start", start).option("end", end).load()


def follow_pages(spark: SparkSession, path: str, target: str, checkpoint: str, page_size: int = PAGE) -> None:
    """Appends all results landed since the last call to the table at ``target``.

    A call that was stopped, also within a page, is carried on by the next one with the same checkpoint.
    """
    spark.dataSource.register(NvdPages)
    rows = spark.readStream.format("nvd_pages").option("path", path).option("pageSize", page_size).load()
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
