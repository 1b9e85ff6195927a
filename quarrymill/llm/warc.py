"""Operator 2: WARC archives with one gzip member per record and an offset index.

Three passes over files in the shared folder, none of which shuffles payloads:

1. ``_write_raw``: each input partition writes its pages as WARC records, as
   one monolithic gzip stream per archive of bounded size and record count,
   and returns a small row per record (archive, ordinal, digest, length).
2. From those rows alone it is decided which records are revisits: the least
   page_id of equal payloads stays a response.
3. ``_normalise``: an archive is inflated once as a stream, every record is
   rewritten as a gzip member of its own (revisits without their payload, with
   the digest and the refers-to id), and a sidecar index of offsets is written.
   ``read_archives`` then reads records by offset.

Files are written under a name of the attempt and renamed when complete, so
lost executors and repeated tasks leave whole files only. Raw archives keep the
attempt in their name and are removed by the driver once all are normalised, so
a task that is repeated finds its input again. Archives hold at most ``MAX_BYTES`` of payload or ``MAX_RECORDS`` records plus one record.

Defined results: a null html is an empty payload; payloads below ``MIN_BYTES``
bytes are never revisits; of repeated page_ids with equal payloads all are the
response (ties cannot be told apart by id); rows with a null page_id are never
referred to and, like any other, revisit an equal payload; an empty table
writes no archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, new_path

MIN_BYTES = 100
MAX_BYTES = 32 << 20
MAX_RECORDS = 20_000
DATE = "2024-01-01T00:00:00Z"
_BLOCK = 1 << 20
_RAW = "archive string, ordinal int, page_id long, payload_bytes long, payload_digest string"


def _open(root: str):
    system, base = fs.FileSystem.from_uri(root)
    system.create_dir(base, recursive=True)
    return system, base


class _File:
    """A file that appears under its name only when it is complete."""

    def __init__(self, system, path: str):
        self.system, self.path, self.draft = system, path, f"{path}.{uuid.uuid4().hex}.part"
        self.out = system.open_output_stream(self.draft, compression=None)

    def close(self):
        self.out.close()
        if self.system.get_file_info(self.path).type == fs.FileType.NotFound:
            self.system.move(self.draft, self.path)
        else:  # a repeated task has written the same before
            self.system.delete_file(self.draft)


def record(kind: str, page_id, url: str | None, digest: bytes, length: int, payload: bytes | None, refers_to=None) -> bytes:
    """A WARC/1.1 record; its block is an HTTP response whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Stream:
    """Records of a gzip stream, in any number of members, inflated block by block."""

    def __init__(self, source):
        self.source, self.buffer, self.inflater, self.rest = source, bytearray(), None, b""

    def _more(self) -> bool:
        raw = self.rest or self.source.read(_BLOCK)
        if not raw:
            return False
        if self.inflater is None or self.inflater.eof:
            self.inflater = zlib.decompressobj(31)
        self.buffer += self.inflater.decompress(raw, _BLOCK)
        self.rest = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        return True

    def _until(self, mark: bytes) -> int:
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return -1
        return at

    def __iter__(self):
        while (at := self._until(b"\r\n\r\n")) >= 0:
            lines = bytes(self.buffer[:at]).decode("utf-8").split("\r\n")
            head = dict(x.split(": ", 1) for x in lines[1:])
            end = at + 4 + int(head["Content-Length"])
            while len(self.buffer) < end + 4:
                if not self._more():
                    raise ValueError("truncated WARC record")
            block = bytes(self.buffer[at + 4 : end])
            del self.buffer[: end + 4]
            http, _, payload = block.partition(b"\r\n\r\n")
            length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
            yield head, length, payload


def _page_id(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "None" else int(value)


def _write_raw(root: str):
    def run(batches):
        system, base = _open(root)
        part = TaskContext.get().partitionId()
        number, file, deflater, used, rows = 0, None, None, 0, []

        def close():
            nonlocal file
            file.out.write(deflater.flush())
            file.close()
            file = None
            cols = list(zip(*rows, strict=True))
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["archive", "ordinal", "page_id", "payload_bytes", "payload_digest"])

        for batch in batches:
            for page_id, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").cast(pa.binary()).to_pylist(), strict=True):
                if file is None:
                    name = f"{part:06d}-{number:05d}-{uuid.uuid4().hex[:8]}.raw.gz"
                    file, deflater, used, rows, number = _File(system, f"{base}/{name}"), zlib.compressobj(1, zlib.DEFLATED, 31), 0, [], number + 1
                payload = html or b""
                digest = hashlib.sha256(payload)
                file.out.write(deflater.compress(record("response", page_id, url, digest.digest(), len(payload), payload)))
                rows.append((name, len(rows), page_id, len(payload), digest.hexdigest()))
                used += len(payload)
                if used >= MAX_BYTES or len(rows) >= MAX_RECORDS:
                    yield close()
        if file is not None:
            yield close()

    return run


def _normalise(raw_root: str, root: str):
    """Rewrite one archive: a gzip member for each record, and the index beside it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (system, base), (_, raw_base) = _open(root), _open(raw_root)
        name = pdf["archive"].iloc[0]
        refers = {int(o): int(r) for o, r in zip(pdf["ordinal"], pdf["refers_to"], strict=True) if not pd.isna(r)}
        target = name[:12] + ".warc.gz"
        out, offset, index = _File(system, f"{base}/{target}"), 0, []
        with system.open_input_stream(f"{raw_base}/{name}", compression=None) as source:
            for ordinal, (head, length, payload) in enumerate(Stream(source)):
                digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha256:"))
                kind = "revisit" if ordinal in refers else "response"
                page_id = _page_id(head["WARC-Record-ID"])
                member = gzip.compress(
                    record(kind, page_id, head.get("WARC-Target-URI"), digest, length, None if kind == "revisit" else payload, refers.get(ordinal)), 1, mtime=0
                )
                out.out.write(member)
                index.append((offset, len(member), page_id))
                offset += len(member)
        out.close()
        side = _File(system, f"{base}/{target}.idx")
        side.out.write("".join(json.dumps(x) + "\n" for x in index).encode())
        side.close()
        return pd.DataFrame({"archive": [target], "records": [len(index)]})

    return run


def _read(root: str):
    """Records of archives, each read and inflated on its own from its offset in the index."""

    def run(batches):
        system, base = _open(root)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with system.open_input_stream(f"{base}/{name}.idx", compression=None) as side:
                    index = [json.loads(x) for x in side.read().decode().splitlines()]
                rows = []
                with system.open_input_file(f"{base}/{name}") as source:
                    for offset, size, _ in index:
                        source.seek(offset)
                        head, length, payload = next(iter(Stream(pa.BufferReader(source.read(size)))))
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha256:")).hex()
                        kind, refers = head["WARC-Type"], head.get("WARC-Refers-To")
                        if kind == "response":
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: payload at {offset} does not match its digest")
                            length = len(payload)
                        rows.append((_page_id(head["WARC-Record-ID"]), length, digest, kind, _page_id(refers) if refers else None, name, offset))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def write_archives(pages: DataFrame, root: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as normalised archives below ``root``: (archive, records)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    raw_root = f"{root}/raw"
    raw = materialise(pages.mapInArrow(_write_raw(raw_root), _RAW), "warc-raw")
    # A row here stands for much work, so the number of tasks follows from the archives.
    tasks = max(1, 2 * raw.select("archive").distinct().count())
    firsts = (
        raw.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "first")
    )
    revisits = (
        raw.select("archive", "ordinal", "page_id", "payload_digest", "payload_bytes")
        .join(firsts, "payload_digest", "left")
        .select("archive", "ordinal", F.when((F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    )
    dealt = revisits.repartition(tasks, "archive").groupBy("archive")
    out = materialise(dealt.applyInPandas(_normalise(raw_root, root), "archive string, records int"), "warc-archives")
    system, base = _open(raw_root)
    system.delete_dir(base)
    return out


def read_archives(archives: DataFrame, root: str) -> DataFrame:
    """A row for each record of the archives."""
    return archives.mapInArrow(
        _read(root), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
    )


def archive_pages(pages: DataFrame, root: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages to archives, then read them back."""
    root = root or new_path(pages.sparkSession, "warc")
    archives = write_archives(pages, root, min_bytes)
    return read_archives(archives.repartition(max(1, archives.count())), root)
