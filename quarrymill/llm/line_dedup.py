"""Operator 1: line deduplication with keep bitmaps.

Every long line of every document becomes one small row: the 128-bit hash of
its normalised key, the document and the position. These rows are
range-partitioned by (hash, document) with a secondary sort by document
(largest first) and position, and each partition is streamed once: the first
document of a hash's run keeps its lines, later occurrences are dropped once
enough documents have been seen. No text is shuffled for the decision.

A very common line spans many partitions. Only the first and the last run of
a partition can be cut by a partition's edge; their undecided rows are written
out as "open", with one summary row for each such run (documents, largest
document). The summaries, two for each partition at most, are added up and
broadcast to settle the open rows. So no task holds a hot line's rows.

Dropped positions come back as one zlib-compressed bitmap per document that
has any (bit i: line i stays; lines beyond the bitmap stay).

Defined results: null or empty text is one empty line; documents are told
apart by doc_id, and rows that repeat a doc_id count once; a repeated doc_id
with other text is judged by its own lines; rows with a null doc_id take no
part and keep all lines; ties cannot occur, as all of a document's lines of a
key are kept or dropped together; an empty table gives an empty result. A
column of the input that is named like a result column is replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import by_place, materialise

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = b" \t\n\x0b\x0c\r"

DROP, OPEN, SUMMARY = 0, 1, 2
_OUT = "kind byte, h1 long, h2 long, doc long, ver long, pos int, n_lines int, docs long"


def _long_lines(min_chars: int):
    """Hash of each line whose key has at least ``min_chars`` characters, with its place."""

    def run(batches):
        for batch in batches:
            doc, ver = batch.column("doc").to_numpy(), batch.column("ver").to_numpy()
            digests, row, pos, sizes = bytearray(), [], [], np.zeros(len(doc), np.int32)
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                lines = (text or b"").split(b"\n")
                sizes[i] = len(lines)
                for at, line in enumerate(lines):
                    if len(line) >= min_chars:
                        key = line.strip(SPACE).lower()
                        if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
                            digests += xxhash.xxh3_128_digest(key)
                            row.append(i)
                            pos.append(at)
            halves, row = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2), np.array(row, np.int64)
            cols = [halves[:, 0], halves[:, 1], doc[row], ver[row], np.array(pos, np.int32), sizes[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "doc", "ver", "pos", "n_lines"])

    return run


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class _Run:
    """The run of one hash that a partition's stream is in."""

    def __init__(self, key, first: bool):
        self.key, self.open, self.docs, self.top, self.last, self.held = key, first, 0, None, None, []


def _decide(min_docs: int):
    """Stream sorted rows; see the module's text for what comes out."""
    names = ("doc", "ver", "pos", "n_lines")

    def rows(kind, key, cols):
        n = len(cols[0])
        return [np.full(n, kind, np.int8), np.full(n, key[0]), np.full(n, key[1]), *cols, np.zeros(n, np.int64)]

    def take(run: _Run, cols, out):
        """Add rows of the same hash, sorted by document, to the run."""
        doc = cols[0]
        if run.top is None:
            run.top = int(doc[0])
        run.docs += int((doc[1:] != doc[:-1]).sum()) + (run.last != doc[0])
        run.last = doc[-1]
        if run.open:
            out.append(rows(OPEN, run.key, cols))
            return
        run.held.append(cols)
        if run.docs >= min_docs:
            for held in run.held:
                later = held[0] != run.top
                if later.any():
                    out.append(rows(DROP, run.key, [c[later] for c in held]))
            run.held = []

    def summary(run: _Run, out):
        """The rows held back (too few documents so far) become open."""
        for held in run.held:
            out.append(rows(OPEN, run.key, held))
        out.append([np.array([SUMMARY], np.int8), *(np.array([v], np.int64) for v in (*run.key, run.top, 0)), np.zeros(1, np.int32), np.zeros(1, np.int32), np.array([run.docs])])

    def batch_of(out):
        types = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        cols = [pa.array(np.concatenate([o[i] for o in out]), t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(cols, names=["kind", "h1", "h2", "doc", "ver", "pos", "n_lines", "docs"])

    def run(batches):
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            cols = [batch.column(c).to_numpy() for c in names]
            edge = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(h1)]))
            out: list = []
            # Runs of fewer rows than documents needed, that begin and end inside the batch, drop nothing.
            busy = ends - starts >= min_docs
            busy[[0, -1]] = True
            for a, b in zip(starts[busy], ends[busy], strict=True):
                key = (int(h1[a]), int(h2[a]))
                if current is None or current.key != key:
                    if current is not None and current.open:
                        summary(current, out)
                    current = _Run(key, current is None)
                take(current, [c[a:b] for c in cols], out)
            if out:
                yield batch_of(out)
        if current is not None:
            summary(current, out := [])
            yield batch_of(out)

    return run


def _to_bitmap(positions: list, lines: int) -> bytes:
    keep = np.ones(lines, np.uint8)
    keep[np.asarray(positions, np.int64)] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def bitmap_bits(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")


@F.pandas_udf(T.BinaryType())
def _pack(positions: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([_to_bitmap(p, n) for p, n in zip(positions, lines, strict=True)])


@F.pandas_udf(T.StringType())
def _apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t, b):
        if b is None:
            return None
        keep = bitmap_bits(b)
        return "\n".join(line for i, line in enumerate((t or "").split("\n")) if i >= len(keep) or keep[i])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def dropped_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, ver, pos, n_lines) of each line to drop; ver is a hash of the text, for ids that repeat."""
    texts = docs.where(F.col(doc).isNotNull()).select(
        F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("ver"), F.col(text).alias("text")
    )
    lines = texts.mapInArrow(_long_lines(min_chars), "h1 long, h2 long, doc long, ver long, pos int, n_lines int")
    # Written first, as the range partitioner reads its input twice: once for a sample.
    lines = materialise(lines, "lines")
    order = ["h1", "h2", F.desc("doc")]
    streamed = materialise(
        lines.repartitionByRange(*order).sortWithinPartitions(*order, "ver", "pos").mapInArrow(_decide(min_docs), _OUT), "line-runs"
    )
    runs = streamed.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc").alias("top"))
    # Two rows for each partition at most, whatever the data.
    settled = (
        streamed.where(F.col("kind") == OPEN)
        .drop("docs")
        .join(F.broadcast(runs), ["h1", "h2"])
        .where((F.col("docs") >= min_docs) & (F.col("doc") != F.col("top")))
    )
    cols = ["doc", "ver", "pos", "n_lines"]
    return streamed.where(F.col("kind") == DROP).select(*cols).unionByName(settled.select(*cols))


def keep_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, ver, n_dropped, keep_bitmap) of each document that loses lines."""
    gone = dropped_lines(docs, doc, text, min_chars, min_docs)
    return (
        gone.groupBy("doc", "ver")
        .agg(F.collect_set("pos").alias("pos"), F.first("n_lines").alias("n_lines"))
        .select("doc", "ver", F.size("pos").cast("long").alias("n_dropped"), _pack("pos", "n_lines").alias("keep_bitmap"))
    )


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with n_lines, n_dropped, keep_bitmap (null: all stay) and kept_text, which take the place of own columns so named."""
    columns, own = by_place(docs)
    rows = docs.select(*columns)
    bits = keep_bitmaps(rows, own[doc], own[text], min_chars, min_docs)
    joined = rows.join(bits, (F.col(own[doc]).cast("long") == F.col("doc")) & (F.xxhash64(own[text]) == F.col("ver")), "left")
    body = F.col(own[text])
    whole = F.coalesce(body, F.lit(""))
    new = {
        "n_lines": F.size(_lines(body)).cast("long"),
        "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long"),
        "keep_bitmap": F.col("keep_bitmap"),
        "kept_text": F.coalesce(_apply(F.when(F.col("keep_bitmap").isNotNull(), whole), F.col("keep_bitmap")), whole),
    }
    return joined.select(*(F.col(o).alias(c) for c, o in own.items() if c not in new), *(v.alias(n) for n, v in new.items()))
