"""Operator 7: exact n-gram Jaccard join by parity sketches.

A document's shingles are dealt by hash to the cells of a sketch, and each cell
is the XOR of its shingles' hashes: a parity word. A shingle that only one of
two documents has changes one cell, so the number of cells that differ is at
most the symmetric difference. Sets with a Jaccard similarity of 0.8 or more
have a symmetric difference of at most a quarter of the smaller set, while a
sketch has clearly more occupied cells than that; so (pigeonhole) similar
documents share occupied cells. The cell count is fixed per size band (four
times as large each); a set just above a band's upper edge has a sketch in that
band as well. Below ``SMALL`` shingles every shingle is a cell.

Of a document's cells only the rarest few need to be joined: as many as could
all be spoilt, plus one. Rarity is judged by a list of frequent shingles,
gathered over all documents; it orders the cells and drops none, so it decides
cost and never results.

Then, without emitting all pairs of a group:

1. Texts with equal words form classes; one document of each class takes part.
2. Documents that share a cell are a bucket. Each is verified against the
   bucket centre (least id) it shares most cells with: at most one pair each.
3. Buckets that lie within one component are done. Of what is left, pairs of
   different components are compared by size and by the Hamming distance of
   1024-bit parity sketches, in blocks of bounded size, and then verified, so
   no link between different components is lost.

A sketch with too few occupied cells would weaken the guarantee; with the cell
counts used, its chance is below 1e-30 for any document.

Defined results: null and empty texts have no shingles and are linked with
nothing; equal texts are linked; very long texts are described whole; rows that repeat a doc_id are one node; a
null doc_id is never linked and its component is null; ties for a centre go to
the least id; an empty table gives an empty result. Other columns are not read, so they may
have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frequent import most_frequent
from .shingles import ascii_words, mix, shingle_set
from .storage import by_place, discard, materialise

#: Similarity is at least NUM / DEN.
NUM, DEN = 4, 5
SMALL = 64
GROWTH = 4
#: Cells for each shingle of a band's smallest set.
CELLS = 2
#: Entries of the list of frequent shingles; it only orders cells.
FREQUENT = 1 << 16
#: Shingles after which a partition's counts are flushed, which bounds a worker's memory.
FLUSH = 1 << 21
SALTS = 64
#: Share of the counted texts from which on a cell's bucket is dealt to several tasks.
SALTED = 64
BLOCK = 128
SKETCH_BITS = 1024


def bands(n: int) -> list[tuple[int, int, int]]:
    """(band, cells, cells to join) for each band a set of ``n`` shingles has a sketch in; 0 cells: each shingle is one."""
    low, band = SMALL, 0
    while n >= low:
        low, band = low * GROWTH, band + 1
    # low is now the first size above the set's own band.
    out = [(band, 0 if band == 0 else CELLS * low // GROWTH, (n // DEN if band == 0 else n // 4) + 1)]
    edge = low // GROWTH
    if band and NUM * n <= DEN * (edge - 1):  # a smaller partner may be in the band below
        out.append((band - 1, 0 if band == 1 else CELLS * edge // GROWTH, (n // DEN if band == 1 else 2 * n // 9) + 1))
    return out


def _counts(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, counts = frequent
    if not len(keys):
        return np.ones(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, counts[at], 1)


def cells(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells to join, and how many counted texts each may be shared by (at most)."""
    keys, shared = [], []
    for band, count, take in bands(len(hashes)):
        seen = _counts(hashes, frequent)
        with np.errstate(over="ignore"):
            if count == 0:
                key, least = mix(hashes + np.uint64(band)), seen
            else:
                cell = hashes % np.uint64(count)
                order = np.argsort(cell, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], np.diff(cell[order]) != 0)))
                word = np.bitwise_xor.reduceat(mix(hashes)[order], starts)
                least = np.minimum.reduceat(seen[order], starts)
                key = mix(word + cell[order][starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band))
        first = np.lexsort((key, least))[:take]
        keys.append(key[first])
        shared.append(least[first])
    return np.concatenate(keys), np.concatenate(shared)


def parity_bits(hashes: np.ndarray) -> bytes:
    return np.packbits(np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _texts(batch, column="text") -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


_DOC, _FREQUENT = 0, 1
_FIRST = "kind byte, id long, ver long, f1 long, f2 long, n long"


def _describe(batches):
    """A row per document (class hashes and set size), and rows of shingles that several texts here share."""
    held, size, seen = [], 0, set()

    def flush():
        nonlocal held, size, seen
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        keys, n = keys[n > 2].view(np.int64), n[n > 2]
        held, size, seen = [], 0, set()
        zero = np.zeros(len(keys), np.int64)
        return _batch([np.full(len(keys), _FREQUENT, np.int8), keys, zero, zero, zero, n])

    def _batch(cols):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "id", "ver", "f1", "f2", "n"])

    for batch in batches:
        hashes, counts = bytearray(), []
        for text in _texts(batch):
            words = ascii_words(text)
            digest = xxhash.xxh3_128_digest(b" ".join(words))
            hashes += digest
            found = shingle_set(words)
            counts.append(len(found))
            if len(found) and digest not in seen:
                seen.add(digest)
                held.append(found)
                size += len(found)
                if size >= FLUSH:
                    yield flush()
        f = np.frombuffer(bytes(hashes), np.int64).reshape(-1, 2)
        kind = np.full(len(counts), _DOC, np.int8)
        yield _batch([kind, batch.column("id"), batch.column("ver"), f[:, 0], f[:, 1], np.array(counts, np.int64)])
    if held:
        yield flush()


def _emit(shared):
    def run(batches):
        frequent = shared.value
        for batch in batches:
            out = [[], [], []]

            def flush(out=out):
                key, ident, salt = (np.concatenate(c) for c in out)
                for c in out:
                    c.clear()
                return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ident), pa.array(salt)], names=["key", "id", "salt"])

            rows = 0
            for ident, text in zip(batch.column("id").to_pylist(), _texts(batch), strict=True):
                found = shingle_set(ascii_words(text))
                if not len(found):
                    continue
                key, common = cells(found, frequent)
                salt = np.where(common >= SALTED, ident % SALTS + 1, 0).astype(np.int8)
                for c, v in zip(out, (key, np.full(len(key), ident, np.int64), salt), strict=True):
                    c.append(v)
                rows += len(key)
                if rows > 1 << 17:
                    yield flush()
                    rows = 0
            if rows:
                yield flush()

    return run


def _shared_only(batches):
    """Rows of keys that several rows have (salted keys: all), from rows sorted by key."""
    last = None  # a row held back until its successor is seen
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ident, salt = (batch.column(c).to_numpy() for c in ("key", "id", "salt"))
        if last is not None:
            key, ident, salt = (np.concatenate((a, b)) for a, b in zip(last, (key, ident, salt), strict=True))
        same = key[1:] == key[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False])) | (salt > 0)
        # The last row's fate may hang on the next batch; if it is kept already, its successor still needs to see it.
        give = keep.copy()
        give[-1] = False
        if last is not None and held_given:
            give[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(key[give]), pa.array(ident[give])], names=["key", "id"])
        last, held_given = [c[-1:] for c in (key, ident, salt)], False
        if keep[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(key[-1:]), pa.array(ident[-1:])], names=["key", "id"])
            held_given = True


def _verify(batches):
    for batch in batches:
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        last, a, keep = None, None, np.zeros(len(u), bool)
        for i, (x, y) in enumerate(zip(_texts(batch, "text_u"), _texts(batch, "text_v"), strict=True)):
            if x != last:
                last, a = x, shingle_set(ascii_words(x))
            keep[i] = similar(a, shingle_set(ascii_words(y)))
        yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])


def _describe_sketch(batches):
    for batch in batches:
        sets = [shingle_set(ascii_words(t)) for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_bits(s) for s in sets], pa.binary())], names=["id", "n", "bits"]
        )


def _compare_block(part, ident, comp, n, bits):
    """Pairs of a block (part 0 with part 1, or within part 0 alone) that size and sketch allow."""
    left = np.flatnonzero(part == 0)
    right = np.flatnonzero(part == 1)
    alone = not len(right)
    right = left if alone else right
    low, high = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
    fits = (comp[left][:, None] != comp[right][None, :]) & (DEN * low >= NUM * high)
    if alone:
        fits &= ident[left][:, None] < ident[right][None, :]
    i, j = np.nonzero(fits)
    if not len(i):
        return i, j
    words = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
    i, j = left[i], right[j]
    apart = np.bitwise_count(words[i] ^ words[j]).sum(1)
    # The symmetric difference of similar sets is at most a ninth of the summed sizes.
    ok = 9 * apart.astype(np.int64) <= n[i] + n[j]
    return ident[i[ok]], ident[j[ok]]


def _compare(batches):
    """Candidate pairs from rows sorted by (key, i, j); a group has at most two blocks' rows."""
    names = ["key", "i", "j", "part", "id", "comp", "n", "bits"]
    held = None

    def pairs(cols):
        edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        for a, b in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(cols[0])])), strict=True):
            if b - a > 1:
                u, v = _compare_block(*(c[a:b] for c in cols[3:]))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    for batch in batches:
        cols = [np.array(batch.column(c).to_pylist(), object) if c == "bits" else batch.column(c).to_numpy() for c in names]
        if held is not None:
            cols = [np.concatenate((a, b)) for a, b in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        # The last group may go on in the next batch.
        at = len(cols[0]) - 1
        same = (cols[0] == cols[0][at]) & (cols[1] == cols[1][at]) & (cols[2] == cols[2][at])
        start = int(np.argmax(same))
        yield from pairs([c[:start] for c in cols]) if start else ()
        held = [c[start:] for c in cols]
    if held is not None:
        yield from pairs(held)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    b = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    return pairs.join(b, "v").join(a, "u").mapInArrow(_verify, "u long, v long")


def _roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with comp, the root of their id."""
    return rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def _buckets_left(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components."""
    marked = _roots(shared, roots)
    open_keys = marked.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("m")).where("a <> b").select("key", "m")
    return marked.join(open_keys, "key")


def similar_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.xxhash64(text).alias("ver"), F.col(text).alias("text"))
    first = materialise(rows.mapInArrow(_describe, _FIRST), "jaccard-first")
    described = first.where(F.col("kind") == _DOC).drop("kind")
    linked = described.where("n > 0 and id is not null")
    classes = linked.groupBy("f1", "f2").agg(F.min(F.struct("id", "ver")).alias("rep")).select("f1", "f2", "rep.id", "rep.ver")
    classes = materialise(classes, "jaccard-classes")

    # At most FREQUENT rows, however many texts there are.
    counted = materialise(first.where(F.col("kind") == _FREQUENT).groupBy(F.col("id").alias("h")).agg(F.sum("n").alias("c")), "jaccard-counts")
    top = most_frequent(counted, [tuple(r) for r in counted.groupBy("c").count().collect()], FREQUENT)
    discard(counted)
    keys = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], top["c"].to_numpy(np.int64)[order]))

    own = rows.join(classes.select("id", "ver"), ["id", "ver"], "left_semi").select("id", "text")
    emitted = own.mapInArrow(_emit(frequent), "key long, id long, salt byte")
    shared = materialise(
        emitted.repartition("key", "salt").sortWithinPartitions("key", "salt", "id").mapInArrow(_shared_only, "key long, id long"), "jaccard-shared"
    )
    texts = materialise(own.join(shared.select("id").distinct(), "id", "left_semi"), "jaccard-texts")

    # First each document against the centre it shares most cells with.
    centres = shared.groupBy("key").agg(F.min("id").alias("centre"))
    votes = shared.join(centres, "key").where("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "centre")).alias("best")).select(F.col("best.centre").alias("u"), F.col("id").alias("v"))
    links = materialise(_verified(best, texts), "jaccard-links")
    roots = components(links)

    # Then what is left between components, in blocks.
    left = materialise(_buckets_left(shared, roots), "jaccard-left")
    discard(shared)
    discard(links)
    sketches = materialise(texts.join(left.select("id").distinct(), "id", "left_semi").mapInArrow(_describe_sketch, "id long, n long, bits binary"), "jaccard-sketches")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own_block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    placed = (
        left.join(sketches, "id")
        .withColumn("b", own_block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), (F.col("b") > F.col("other")).cast("int").alias("part"), "id", "comp", "n", "bits")
    )
    candidates = (
        placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "part", "id").mapInArrow(_compare, "u long, v long").distinct()
    )
    more = materialise(_verified(candidates, texts), "jaccard-links")
    for spent in (left, sketches, texts):
        discard(spent)
    # Of a component found first, its star edges stand for its links.
    roots = components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))

    of_class = _roots(classes, roots).select("f1", "f2", "comp")
    known = described.join(of_class, ["f1", "f2"], "left")
    return known.select(
        F.col("id").alias(doc),
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("comp")).otherwise(F.col("id")).alias("component_id"),
    )


#: Keys (of eight bytes) that are sent to all tasks; more are joined by a shuffle.
KEYS_AT_HAND = 1 << 20


def _at_hand(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= KEYS_AT_HAND else keys


def keep_representatives(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates and, of each component, the one with the least id (null comes last).

    Rows are told apart by id and text: repeated rows count as one document, of
    which one row stays, and texts that share an id are judged each on its own.
    """
    columns, own = by_place(docs)
    docs = docs.select(*columns)
    doc, text = own[doc], own[text]
    rows = docs.withColumn("__key", F.xxhash64(F.col(doc).isNull(), F.col(doc).cast("long"), F.col(text).isNull(), F.col(text)))
    found = similar_documents(rows, "__key", text)
    named = rows.groupBy("__key").agg(F.min(F.col(doc).cast("long")).alias("id"), F.count(F.lit(1)).alias("n"))
    judged = materialise(named.join(found.select("__key", "component_id").distinct(), "__key"), "jaccard-judged")
    discard(found)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__key", "n")).alias("least")
    kept = materialise(judged.groupBy("component_id").agg(least).select("least.__key", "least.n"), "jaccard-kept")
    gone = materialise(judged.join(kept.where("n = 1"), "__key", "left_anti").select("__key"), "jaccard-gone")
    many = materialise(kept.where("n > 1").select("__key"), "jaccard-repeated")
    discard(judged)
    discard(kept)
    # Most documents stay and few are repeated: texts are dealt out only where what goes is too much to send.
    once = rows.join(_at_hand(gone), "__key", "left_anti")
    again = rows.join(_at_hand(many), "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.select(*docs.columns).unionByName(again).select(*(F.col(o).alias(c) for c, o in own.items()))
