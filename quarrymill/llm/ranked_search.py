"""Operator 13: ranked lexical search over impact-ordered postings, score at a time.

1. ``_forward``: each document becomes its number of terms and the counts of
   the terms that the items ask for; document and term statistics are sums
   over these rows.
2. ``_search``: a task takes its documents in shards and builds, for each
   term, postings grouped by exact impact, largest first. The groups of an
   item's terms are processed in descending order of what they add to a score,
   in rounds that double. When no unseen document and only few seen ones can
   still reach the k-th place, as the next groups of all terms bound what may
   be added, the scores of these few are completed from their own terms.
   Without that proof all groups are processed.
3. The k best of each shard are exact, so those of all shards hold the k best.

Postings of a frequent term are dealt out with their documents, so no term is
one task's work, and documents are not shuffled. Items are a stated query set;
they are taken in blocks of about ``ITEM_BYTES``, one after the other, so what
tasks are sent is bounded for any number of items (one item is sent whole).

Defined results: a null text has no terms; a document without terms is not
counted; each row is a document, repeated ones have a rank each; documents
without id come after others of equal score; equal items count once, those of
one id and different texts are ranked apart; items without terms and empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise

K = 20
ITEM_BYTES = 4 << 20
#: A shard has about so many postings, or documents.
SHARD_POSTINGS = 4 << 20
SHARD_DOCS = 1 << 16
#: Postings of the first round.
ROUND = 1024

# Bytes that belong to no term become blanks; A-Z become small.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    return 75 + 25 * n * n_docs // total


def _forward(ids: dict):
    def run(batches):
        for batch in batches:
            sizes, widths, at, tfs = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = terms(text or b"")
                counts = Counter(found)
                asked = [t for t in counts if t in ids]
                sizes.append(len(found))
                widths.append(len(asked))
                at += map(ids.__getitem__, asked)
                tfs += map(counts.__getitem__, asked)
            ends = pa.array(np.cumsum([0, *widths]), pa.int32())
            cols = [batch.column("key"), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, tfs))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "terms", "tfs"])

    return run


def _statistics(size: int):
    """(term, number of documents that hold it), with the documents and terms of the partition under -1 and -2."""

    def run(batches):
        df, docs, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *seen.tolist()], pa.int64()), pa.array([docs, total, *df[seen].tolist()], pa.int64())], names=["what", "n"])

    return run


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Shard:
    """Postings of some documents, grouped by term and exact impact, the largest impact of a term first."""

    def __init__(self, n: np.ndarray, widths: np.ndarray, at: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, total: int):
        self.docs, self.widths, self.at = len(n), widths, at
        self.begin = np.cumsum(widths) - widths
        of = np.repeat(np.arange(self.docs), widths)
        m = length_factor(n, n_docs, total)[of]
        self.impact = weights[at] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m))
        order = np.lexsort((-self.impact, at))
        self.doc, term, impact = of[order], at[order], self.impact[order]
        new = np.flatnonzero(np.diff(term, prepend=-1).astype(bool) | np.diff(impact, prepend=-1).astype(bool))
        self.g_start, self.g_impact = new, impact[new]
        self.g_size = np.diff(new, append=len(term))
        self.g_of = np.searchsorted(term[new], np.arange(len(weights) + 1))

    def complete(self, docs: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Whole scores of documents from their own terms."""
        widths = self.widths[docs]
        at = _spans(self.begin[docs], widths)
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), widths), factors[self.at[at]] * self.impact[at])
        return out

    def candidates(self, item: np.ndarray, repeats: np.ndarray, k: int, first: int = ROUND) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents that may be among the k best, their whole scores, how many postings were processed)."""
        lo, hi = self.g_of[item], self.g_of[item + 1]
        groups, of = _spans(lo, hi - lo), np.repeat(np.arange(len(item)), hi - lo)
        adds = self.g_impact[groups] * repeats[of]
        order = np.argsort(-adds, kind="stable")
        order = order[: np.count_nonzero(adds)]
        groups, of, adds = groups[order], of[order], adds[order]
        seen = np.cumsum(self.g_size[groups])
        by_term = [adds[of == t] for t in range(len(item))]
        done, at, reach, score = np.zeros(len(item), np.int64), 0, first, np.zeros(self.docs, np.int64)
        factors = np.zeros(len(self.g_of), np.int64)
        factors[item] = repeats
        while at < len(groups):
            end = max(at + 1, int(np.searchsorted(seen, reach, side="right")))
            now = groups[at:end]
            sizes = self.g_size[now]
            np.add.at(score, self.doc[_spans(self.g_start[now], sizes)], np.repeat(adds[at:end], sizes))
            done += np.bincount(of[at:end], minlength=len(item))
            at, reach = end, 2 * max(reach, int(seen[end - 1]))
            left = sum(int(a[d]) for a, d in zip(by_term, done.tolist(), strict=True) if d < len(a))
            touched = np.flatnonzero(score)
            if not left or len(touched) < k:
                continue
            least = np.partition(score[touched], len(touched) - k)[len(touched) - k]
            if left < least:
                may = touched[score[touched] + left >= least]
                if self.widths[may].sum() <= seen[-1] - seen[at - 1]:
                    return may, self.complete(may, factors), int(seen[at - 1])
        touched = np.flatnonzero(score)
        return touched, score[touched], int(seen[-1]) if len(seen) else 0


_FOUND = "item int, doc_id long, score long"


def _search(items: list, weights: np.ndarray, n_docs: int, total: int, k: int):
    def shard(rows: list):
        table = pa.Table.from_batches(rows).combine_chunks()
        key, lists = table.column("key"), {c: table.column(c).combine_chunks() for c in ("terms", "tfs")}
        null = key.is_null().to_numpy()
        keys = key.fill_null(0).to_numpy()
        widths = np.diff(lists["terms"].offsets.to_numpy()).astype(np.int64)
        made = Shard(table.column("n").to_numpy(), widths, *(lists[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs")), weights, n_docs, total)
        for i, (at, repeats) in enumerate(items):
            docs, scores, _ = made.candidates(at, repeats, k)
            best = np.lexsort((keys[docs], null[docs], -scores))[:k]
            best = best[scores[best] > 0]
            at = docs[best]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i, np.int32)), pa.array(keys[at], mask=null[at]), pa.array(scores[best])], names=["item", "doc_id", "score"])

    def run(batches):
        held, docs, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            docs, postings = docs + len(batch), postings + len(batch.column("terms").flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield from shard(held)
                held, docs, postings = [], 0, 0
        if held:
            yield from shard(held)

    return run


def _block(docs: DataFrame, texts: list[bytes], k: int) -> DataFrame | None:
    """item (place in ``texts``), doc_id, score: for each item, its best documents of each shard."""
    counts = [Counter(terms(t)) for t in texts]
    ids = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
    if not ids:
        return None
    forward = materialise(docs.mapInArrow(_forward(ids), "key long, n long, terms array<int>, tfs array<int>"), "forward")
    # One row for each term of this block and two more come to the driver.
    known = {r["what"]: r["n"] for r in forward.mapInArrow(_statistics(len(ids)), "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    n_docs, total = known.get(-1, 0), known.get(-2, 0)
    if not n_docs:
        return None
    weights = np.array([weight(n_docs, known.get(i, 0)) for i in range(len(ids))], np.int64)
    items = [(np.array([ids[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
    return forward.where("n > 0 and size(terms) > 0").mapInArrow(_search(items, weights, n_docs, total, k), _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """The ``item`` column with rank, doc_id and score: the k best documents of each item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    asked = items.select(F.col(f"`{item}`").alias("id"), F.col(f"`{query}`").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // ITEM_BYTES
    kind = asked.schema["id"].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("block int, " + _FOUND).fields]))
    for b in range(blocks):
        chosen = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # about ITEM_BYTES
        found = _block(rows, [r["text"].encode() for r in chosen], k)
        if found is not None:
            ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(chosen)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", kind)]))
            out = out.unionByName(found.join(F.broadcast(ids), "item").select("id", F.lit(b).alias("block"), *T.StructType.fromDDL(_FOUND).names))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Of an item's candidates from all shards, sixteen parts are cut to the best first.
    part = Window.partitionBy("block", "item", F.pmod(F.hash("doc_id"), F.lit(16))).orderBy(*order)
    best = out.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select(F.col("id").alias(item), "rank", "doc_id", "score")
