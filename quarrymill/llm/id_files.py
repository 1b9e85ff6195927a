"""Operator 11: token ids as binary files, frequency-ranked, in a byte-aligned code with control bytes apart.

Ids are replaced by their rank, so that the 256 most frequent take one byte.
Of every four ranks a control byte holds the four lengths (two bits each, one
to four bytes); control bytes and data bytes of a block lie apart, so both are
found by table lookup on whole arrays, without a loop over ids.

1. ``_encode``: documents become ids, written once to the shared folder.
2. Ids are counted over all documents; the counts, one for each id of the
   tokenizer at most, are ranked by (count descending, id) and stored beside
   the files.
3. ``_write``: rows are range-partitioned and sorted by (doc_id, ids), so the
   files, in the order of their numbers, hold all documents in ascending order.
4. ``read_files`` reads the files back, block by block.

A file starts with ``MAGIC``; each block is a ``_HEAD`` (documents, ids, data
bytes), the doc_ids (int64), one byte each that tells null ids, the lengths
(uint32), the control bytes and the data bytes. Numbers are little-endian. A
block ends with a document, after ``BLOCK_IDS`` ids or ``BLOCK_DOCS`` documents, so a task holds about
a block and one text.

Files appear under their names only when they are complete, and a repeated
task writes the same bytes.

Defined results: a null text has no ids but the end id; repeated rows are
stored each on its own, those of one doc_id in the order of their ids; null
doc_ids come first; an empty table writes no file and gives no rows; other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import _groups, encode_texts
from .storage import materialise, new_path
from .warc import _File, _open

MAGIC = b"RANKIDS1"
BLOCK_IDS = 1 << 16
BLOCK_DOCS = 1 << 14
_HEAD = struct.Struct("<IQQ")
_RANKS = "ranks.u4"

#: Lengths of the four numbers of each control byte, and which of their sixteen bytes are stored.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
STORED = (np.arange(4) < LENGTHS[:, :, None]).reshape(256, 16)
#: Where each of the sixteen bytes lies behind the place of the first (those that are not stored: at 0, and masked).
PLACE = np.where(STORED, np.cumsum(STORED, axis=1) - 1, 0)
TOTAL = LENGTHS.sum(axis=1)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    padded = np.zeros(-(-len(numbers) // 4) * 4, "<u4")
    padded[: len(numbers)] = numbers
    codes = ((padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)).reshape(-1, 4)
    control = (codes << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), padded.view(np.uint8).reshape(-1, 16)[STORED[control]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack`` was given."""
    codes = np.frombuffer(control, np.uint8)
    starts = np.cumsum(TOTAL[codes]) - TOTAL[codes]
    stored = np.frombuffer(data, np.uint8)
    if len(stored) != TOTAL[codes].sum():
        raise ValueError("control bytes and data bytes do not fit")
    found = stored[starts[:, None] + PLACE[codes]] * STORED[codes] if n else np.empty((0, 16), np.uint8)
    return found.astype(np.uint8).reshape(-1).view("<u4")[:n]


def block(keys: list, lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return b"".join(
        (
            _HEAD.pack(len(keys), len(ranks), len(data)),
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([k is None for k in keys], np.uint8).tobytes(),
            np.array(lengths, "<u4").tobytes(),
            control,
            data,
        )
    )


def blocks(source):
    """(doc_ids, lengths, ranks) of each block of an open file."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of ranked ids")
    while head := source.read(_HEAD.size):
        docs, n, size = _HEAD.unpack(head)
        keys, none = np.frombuffer(source.read(8 * docs), "<i8"), np.frombuffer(source.read(docs), np.uint8)
        lengths = np.frombuffer(source.read(4 * docs), "<u4")
        control = source.read(-(-n // 4))
        yield [None if z else k for k, z in zip(keys.tolist(), none.tolist(), strict=True)], lengths, unpack(control, source.read(size), n)


def width_of(path: str) -> str:
    """Type in which ids travel between tasks."""
    return "<u2" if max(Tokenizer.from_file(path).get_vocab().values(), default=0) < 1 << 16 else "<u4"


def _encode(path: str, end_id: int, width: str):
    def run(batches):
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _groups(texts):
                ids = [np.concatenate((i, end)).astype(width).tobytes() for i in encode_texts(path, texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array(ids, pa.binary())], names=["key", "ids"])

    return run


def _count(width: str):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                found = np.bincount(np.frombuffer(ids, width))
                short, long = sorted((total, found), key=len)
                total = long.copy()
                total[: len(short)] += short
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return run


def rank_ids(counts: DataFrame) -> np.ndarray:
    """Ids by rank. As many rows as the tokenizer has ids come to the driver, at most."""
    rows = counts.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy("<u4")


def _read_ranks(root: str) -> np.ndarray:
    system, base = _open(root)
    with system.open_input_stream(f"{base}/{_RANKS}", compression=None) as f:
        return np.frombuffer(f.read(), "<u4")


def _write(root: str, width: str):
    def run(batches):
        by_rank = _read_ranks(root)
        ranks = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        part, out, keys, held, n, docs, ids_written = TaskContext.get().partitionId(), None, [], [], 0, 0, 0
        system, base = _open(root)
        name = f"ids-{part:06d}.bin"

        def flush():
            nonlocal keys, held, n
            out.out.write(block(keys, list(map(len, held)), ranks[np.concatenate(held)]))
            keys, held, n = [], [], 0

        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if out is None:
                    out = _File(system, f"{base}/{name}")
                    out.out.write(MAGIC)
                keys.append(key)
                held.append(np.frombuffer(ids, width))
                n, docs, ids_written = n + len(held[-1]), docs + 1, ids_written + len(held[-1])
                if n >= BLOCK_IDS or len(keys) >= BLOCK_DOCS:
                    flush()
        if out is not None:
            if keys:
                flush()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [docs], "ids": [ids_written]})

    return run


_MANIFEST = "part long, file string, docs long, ids long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_files(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """(folder, manifest): one row per file with its number, name, documents and ids.

    ``tokenizer``: path of a tokenizer file that driver and executors can open; ``end_id`` is one of its ids.
    """
    spark, width = docs.sparkSession, width_of(tokenizer)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    encoded = materialise(rows.mapInArrow(_encode(tokenizer, end_id, width), "key long, ids binary"), "ids", "zstd")
    root = new_path(spark, "id-files")
    by_rank = rank_ids(encoded.mapInArrow(_count(width), "id long, n long"))
    system, base = _open(root)
    table = _File(system, f"{base}/{_RANKS}")
    table.out.write(by_rank.tobytes())
    table.close()
    ordered = encoded.repartitionByRange("key", "ids").sortWithinPartitions("key", "ids")
    return root, materialise(ordered.mapInArrow(_write(root, width), _MANIFEST), "id-manifest")


def _read(root: str, with_ids: bool):
    def run(batches):
        system, base = _open(root)
        by_rank = _read_ranks(root)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with system.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for keys, lengths, ranks in blocks(f):
                        ids, ends = by_rank[ranks], np.cumsum(lengths, dtype=np.int64)
                        texts = np.split(ids, ends[:-1])
                        cols = [pa.array(keys, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(t.tobytes()) for t in texts], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            cols, names = [*cols, pa.array([t.astype(np.int64) for t in texts], pa.list_(pa.int64()))], [*names, "ids"]
                        yield pa.RecordBatch.from_arrays(cols, names=names)
                        start += int(ends[-1])

    return run


def read_files(spark: SparkSession, root: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per stored document: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids.

    The manifest has a row for each task that wrote; it alone comes to the driver.
    """
    files = sorted(manifest.select("part", "file", "ids").collect())
    starts = [0, *accumulate(f["ids"] for f in files)]
    rows = [(f["part"], f["file"], s) for f, s in zip(files, starts, strict=False)]
    listed = spark.createDataFrame(rows, "part long, file string, start long").repartitionByRange(max(1, len(rows)), "part")
    return listed.select("file", "start").mapInArrow(_read(root, with_ids), _DOCS + ", ids array<long>" * with_ids)
