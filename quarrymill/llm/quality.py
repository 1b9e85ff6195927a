"""Operator 4: a quality classifier by nearest-neighbour voting.

Features of a text are its lower-cased words and the outlines of its words
(runs of capitals, small letters, digits and each sign), hashed to a fixed
number of columns, with damped counts. Words and outlines are scaled to equal
length each. A latent-semantic projection (randomised SVD) is fitted on at most
``SAMPLE`` labelled texts: that documented bound makes the broadcast (the
projection and one labelled vector for each sampled text) a few megabytes
whatever the corpus. Every text is then scored on its own: cosines with all
labelled vectors by exact blocked products, and a vote of the ``NEIGHBOURS``
nearest, weighted by similarity.

Defined results: a null or empty text has no features and scores the share of
good labels in the sample; so does every text if nothing is labelled (0.5 if
there is no label at all). Labels of documents that occur several times count
for each. Cosines are compared to five decimals; ties among neighbours go to
the one that comes first in the sample's order. Texts of any length are read
whole; an empty table gives no rows; repeated rows are scored each on its own.
Only text is read for a score; kept columns named like a result are left out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import by_place

SAMPLE = 4000
WORD_COLUMNS = 3072
OUTLINE_COLUMNS = 1024
RANK = 48
NEIGHBOURS = 25
POWER = 16
THRESHOLD = 0.7
SEED = 7
_BLOCK = 512
_CACHED = 1 << 18

_OUTLINE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_REPEAT = re.compile(rb"(.)\1+")


class Features:
    """Hashed features of texts; remembers a bounded number of column numbers."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _columns(self, counted: Counter, mark: bytes, width: int) -> np.ndarray:
        if len(self.known) > _CACHED:
            self.known.clear()
        known, out = self.known, np.empty(len(counted), np.int64)
        for i, w in enumerate(counted):
            key = mark + w
            if (at := known.get(key)) is None:
                known[key] = at = xxhash.xxh3_64_intdigest(key) % width
            out[i] = at
        return out

    def row(self, text: bytes) -> np.ndarray:
        """Two blocks of unit length (or zero): words, then outlines."""
        out = np.zeros(WORD_COLUMNS + OUTLINE_COLUMNS, np.float32)
        words = Counter(text.lower().split())
        shapes = Counter(_REPEAT.sub(rb"\1", text.translate(_OUTLINE)).split())
        for counted, mark, width, start in ((words, b"w", WORD_COLUMNS, 0), (shapes, b"s", OUTLINE_COLUMNS, WORD_COLUMNS)):
            if counted:
                n = np.bincount(self._columns(counted, mark, width), np.fromiter(counted.values(), float, len(counted)), width)
                n = np.log1p(n) if mark == b"w" else np.sqrt(n)
                out[start : start + width] = n / np.linalg.norm(n)
        return out


def is_held_out(doc: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _rows(batches):
    features = Features()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        sparse = [features.row(t or b"") for t in texts]
        at = [np.flatnonzero(r).astype(np.int32) for r in sparse]
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array(at, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(sparse, at, strict=True)], pa.list_(pa.float32()))],
            names=["quality", "at", "value"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text") -> dict:
    """Projection, labelled vectors and votes from at most ``sample`` labelled documents that are not held out."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col(doc).isNotNull() & ~is_held_out(doc))
        .select(F.col(doc).alias("__id"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("__id"), "__id", "quality")
        .limit(sample)
    )
    # At most ``sample`` rows on the broadcast side.
    rows = docs.select(F.col(doc).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id")
    found = (
        rows.orderBy(F.xxhash64("__id"), "__id", "quality", "text").limit(sample).select("text", "quality")
        .mapInArrow(_rows, "quality int, at array<int>, value array<float>").toArrow().to_pydict()
    )
    y = np.array(found["quality"], np.float32)
    x = np.zeros((len(y), WORD_COLUMNS + OUTLINE_COLUMNS), np.float32)
    for i, (at, value) in enumerate(zip(found["at"], found["value"], strict=True)):
        x[i, at] = value
    df = (x > 0).sum(0)
    idf = np.log((1 + len(y)) / (1 + df)).astype(np.float32) + 1 if len(y) else np.ones(x.shape[1], np.float32)
    x *= idf
    rng, rank = np.random.default_rng(SEED), min(RANK, max(1, len(y)))
    base = np.linalg.qr(x @ rng.standard_normal((x.shape[1], rank)).astype(np.float32))[0] if len(y) else np.zeros((0, rank), np.float32)
    for _ in range(4 if len(y) else 0):
        base = np.linalg.qr(x @ (x.T @ base))[0]
    _, _, vt = np.linalg.svd(base.T @ x, full_matrices=False) if len(y) else (None, None, np.zeros((rank, x.shape[1]), np.float32))
    projection = (vt.T * idf[:, None]).astype(np.float32)
    vectors = x @ vt.T
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return {"projection": projection, "vectors": vectors.astype(np.float32), "y": y, "prior": float(y.mean()) if len(y) else 0.5}


def vote(model: dict, rows: np.ndarray) -> np.ndarray:
    """Scores of a block of feature rows."""
    y, prior = model["y"], model["prior"]
    out = np.full(len(rows), prior)
    z = rows @ model["projection"]
    norm = np.linalg.norm(z, axis=1)
    ok = np.flatnonzero(norm > 1e-9)
    if not len(y) or not len(ok):
        return out
    # Rounded, so that equal neighbours tie however the product was blocked.
    cosine = np.round((z[ok] / norm[ok, None]) @ model["vectors"].T, 5)
    k = min(NEIGHBOURS, len(y))
    near = np.argsort(-cosine, axis=1, kind="stable")[:, :k] if len(y) <= k else _nearest(cosine, k)
    weight = np.clip(np.take_along_axis(cosine, near, 1), 1e-6, 1).astype(np.float64) ** POWER
    out[ok] = (weight * y[near]).sum(1) / weight.sum(1)
    return np.clip(out, 0, 1)


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, ties to the smaller column."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, 1).min(1)
    tied = np.flatnonzero((cosine >= least[:, None]).sum(1) > k)
    near[tied] = np.argsort(-cosine[tied], axis=1, kind="stable")[:, :k]
    return near


def _score(shared, keep: list[str], names: list[str]):
    def run(batches):
        features, model = Features(), shared.value
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            scores = [vote(model, np.stack([features.row(t or b"") for t in texts[a : a + _BLOCK]])) for a in range(0, len(texts), _BLOCK)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=names)

    return run


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, doc: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """The ``keep`` columns of every document with held_out, score and predicted."""
    new = {"held_out", "score", "predicted"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    model = model or fit(docs, labels, doc=doc, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns, own = by_place(docs, keep)
    rows = docs.select(*columns, is_held_out(doc).alias("held_out"), F.col(text).alias("__text"))
    kept = [*own.values(), "held_out"]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(_score(shared, kept, [*kept, "score"]), schema)
    return scored.select(*(F.col(o).alias(c) for c, o in own.items()), "score", "held_out", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    columns, own = by_place(docs)
    marked = score_documents(docs.select(*columns), labels, doc=own["doc_id"], text=own["text"], model=fit(docs, labels))
    return marked.where("predicted = 1").select(*(F.col(o).alias(c) for c, o in own.items()))
