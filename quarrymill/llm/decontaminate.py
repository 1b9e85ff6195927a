"""Operator 8: benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts (questions and answers) are normalised to words joined by one
blank; every window of ``size`` consecutive words goes into an automaton, and
each document's normalised text is scanned once. Matches are word-aligned
because every pattern begins and ends with the separating blank. Hits are
mapped back to character offsets of the original text.

The automaton is built on each Python worker from a broadcast pattern list.
A benchmark is a curated set; its size is nevertheless checked: patterns are
cut into groups of at most ``bound`` bytes and a partition is scanned with one
group at a time, so memory stays bounded for any benchmark.

Defined results: null texts and texts without words have no words and no hit;
an item without words or id has no window; repeated items count once by item_id;
rows with equal ids are scanned on their own; an empty benchmark or table
gives zero hits or no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import by_place, quoted

WINDOW = 10
PATTERN_BYTES = 32 << 20

# A byte is part of a word if it is an ASCII letter or digit or belongs to a non-ASCII character.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(text: bytes, size: int) -> list[str]:
    w = words(text)
    if not w:
        return []
    return [" " + b" ".join(w[i : i + size]).decode("latin-1") + " " for i in range(max(1, len(w) - size + 1))]


def pattern_groups(items: list[tuple], size: int, bound: int = PATTERN_BYTES) -> list[dict]:
    """Dicts of window → (number of words, item ids), each of at most ``bound`` pattern bytes."""
    groups, used = [{}], 0
    found: dict[str, set] = {}
    for item, text in items:
        for w in windows((text or "").encode(), size):
            found.setdefault(w, set()).add(item)
    for w, ids in found.items():
        if used + len(w) > bound and groups[-1]:
            groups.append({})
            used = 0
        groups[-1][w] = (w.count(" ") - 1, tuple(sorted(ids)))
        used += len(w)
    return groups


def automaton(group: dict) -> ahocorasick.Automaton | None:
    if not group:
        return None
    a = ahocorasick.Automaton()
    for w, value in group.items():
        a.add_word(w, value)
    a.make_automaton()
    return a


def scan(text: bytes, machines: list) -> tuple[int, np.ndarray, set]:
    """Number of words, which of them are hit, and the ids of the items that occur."""
    w = words(text)
    line = " " + b" ".join(w).decode("latin-1") + " "
    matches, ids = [], set()
    for machine in machines:
        for end, (n, items) in machine.iter(line) if machine else ():
            matches.append((end, n))
            ids.update(items)
    if not matches:
        return len(w), np.zeros(0, bool), ids
    ends = np.cumsum([len(x) + 1 for x in w])  # index in `line` of the blank behind each word
    last = np.searchsorted(ends, [end for end, _ in matches])
    edges = np.zeros(len(w) + 1, np.int64)
    np.add.at(edges, last + 1 - np.array([n for _, n in matches]), 1)
    np.add.at(edges, last + 1, -1)
    return len(w), np.cumsum(edges[:-1]) > 0, ids


def spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets [start, end) of the original text."""
    if not len(hit):
        return []
    at = np.array([m.span() for m in _WORD.finditer(text.translate(_FOLD))])
    # UTF-8 continuation bytes carry no character of their own.
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(chars[at[a, 0]]), "end": int(chars[at[b - 1, 1]])} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_BUILT: dict = {}


def _machine(shared, token: str, k: int):
    """The automaton of the k-th group; one is kept for each Python worker."""
    key = (token, k)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(shared.value[k])
    return _BUILT[key]


def _scan_all(shared, token: str, groups: int, keep: list[str], out: pa.Schema):
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("__text").cast(pa.binary()).to_pylist()]
            rows: list = [None] * len(texts)
            for k in range(max(1, groups)):
                machine = [_machine(shared, token, k)]
                for i, t in enumerate(texts):
                    n, hit, ids = scan(t, machine)
                    if rows[i] is not None:
                        _, before, seen = rows[i]
                        hit = hit if not len(before) else before if not len(hit) else hit | before
                        ids |= seen
                    rows[i] = (n, hit, ids)
            digests = [hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest() for _, _, ids in rows]
            cols = [
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([int(h.sum()) for _, h, _ in rows], pa.int64()),
                pa.array([len(ids) for _, _, ids in rows], pa.int64()),
                pa.array(digests, pa.string()),
                pa.array([spans(t, h) for t, (_, h, _) in zip(texts, rows, strict=True)], out.field("hit_spans").type),
            ]
            kept = [batch.column(c).cast(out.field(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *cols], schema=out)

    return run


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep: list[str] | None = None, text: str = "text", bound: int = PATTERN_BYTES
) -> DataFrame:
    """The ``keep`` columns of every document with n_words, n_hit, n_items, items_sha256, hit_spans and contaminated.

    Kept columns whose names clash with a result column are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T.StructType.fromDDL("n_words long, n_hit long, n_items long, items_sha256 string, hit_spans array<struct<start: long, end: long>>")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {*new.names, "contaminated"}]
    groups = pattern_groups([(r[0], r[1]) for r in benchmark.where("item_id is not null").select("item_id", "text").toLocalIterator()], size, bound)
    shared = docs.sparkSession.sparkContext.broadcast(groups)
    columns, own = by_place(docs, keep)
    rows = docs.select(*columns, F.col(quoted(text)).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *new.fields])
    out = rows.mapInArrow(_scan_all(shared, uuid.uuid4().hex, len(groups), [*own.values()], to_arrow_schema(schema)), schema)
    return out.select(*(F.col(o).alias(c) for c, o in own.items()), *new.names, (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their own columns."""
    columns, own = by_place(docs)
    marked = scan_documents(docs.select(*columns), benchmark, size, text=own["text"])
    return marked.where(~F.col("contaminated")).select(*(F.col(o).alias(c) for c, o in own.items()))
