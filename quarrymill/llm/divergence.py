"""Operator 12: how the sources of a language differ in their terms, by mergeable radix tries.

1. ``_count``: each partition counts the terms of its documents in a radix trie
   of UTF-8 bytes for each language; a leaf has the number of documents and a
   counter for each source. Tries of more than ``LEAVES`` terms are handed on
   and new ones begun, so memory is bounded.
2. A trie is cut into subtries by prefix. Rows are range-partitioned and sorted
   by (language, prefix), and ``_merge`` merges the subtries of one prefix at a
   time. Prefixes of more than ``RANGE_LEAVES`` terms are cut further before,
   so a language or a first letter that holds most terms is dealt to many tasks.
   Walking a merged trie gives the terms in UTF-8 order; those in enough
   documents are kept, in blocks.
3. Totals are sums over blocks. ``_audit`` goes over each block once and gives,
   for each task, one sum for each pair of sources and the best candidates of
   each group, equal values in UTF-8 order.

For each language the result has a row for each ordered pair of its sources,
so a block's work is as large as that, per term; sources are taken ``TILE`` at
a time, which bounds the table of sums. All numbers are 64-bit integers, exact
up to 9 * 10^15 counted terms.

Defined results: null text, lang and source are empty strings; each row counts
as a document, also repeated ones; a group without terms has zero counts; a
language without kept terms has pairs of value 0; a language with one source
has no pairs; a term of any length counts; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import gc
from collections import Counter
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

MIN_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
#: Distinct (source, term) counts and trie leaves that a counting task holds.
COUNTS = 300_000
LEAVES = 200_000
#: Bytes of a prefix at first, and terms of all partial tries above which one is cut further.
PREFIX = 3
RANGE_LEAVES = 500_000
BLOCK = 4096
TILE = 256
_CELLS = 1 << 20

# Bytes that belong to no term become blanks; A-Z become small.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Node:
    """A node of a radix trie: the bytes on its edge, children by first byte, and, where a term ends, its counts."""

    __slots__ = ("counts", "docs", "kids", "label")

    def __init__(self, label: bytes = b"", kids: dict | None = None, docs: int = 0, counts: dict | None = None):
        self.label, self.kids, self.docs, self.counts = label, {} if kids is None else kids, docs, counts


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _split(parent: Node, kid: Node, k: int) -> Node:
    """Puts a node at the k-th byte of a child's edge."""
    upper = Node(kid.label[:k], {kid.label[k]: kid})
    kid.label = kid.label[k:]
    parent.kids[upper.label[0]] = upper
    return upper


def _leaf(node: Node, docs: int, counts: dict) -> None:
    node.docs += docs
    if node.counts is None:
        node.counts = counts
    else:
        for source, n in counts.items():
            node.counts[source] = node.counts.get(source, 0) + n


def insert(root: Node, term: bytes, docs: int, counts: dict) -> None:
    node, rest = root, term
    while rest:
        kid = node.kids.get(rest[0])
        if kid is None:
            node.kids[rest[0]] = Node(rest, None, docs, counts)
            return
        k = _shared(kid.label, rest)
        node = kid if k == len(kid.label) else _split(node, kid, k)
        rest = rest[k:]
    _leaf(node, docs, counts)


def build(leaves) -> Node:
    """The trie of (term, documents, counts), terms distinct and in the order of bytes: each begins on the path of the one before."""
    root, before = Node(), b""
    path, ends = [root], [0]  # nodes from the root to the last leaf, and how many bytes lead to the end of each
    for term, docs, counts in leaves:
        k = _shared(before, term)
        while ends[-1] > k:
            kid = path.pop()
            ends.pop()
            if ends[-1] < k:
                path.append(_split(path[-1], kid, k - ends[-1]))
                ends.append(k)
        leaf = path[-1].kids[term[k]] = Node(term[k:], None, docs, counts)
        path.append(leaf)
        ends.append(len(term))
        before = term
    return root


def merge(root: Node, other: Node) -> None:
    """Adds all of ``other`` to ``root``; nodes of ``other`` may become part of it."""
    stack = [(root, other)]
    while stack:
        a, b = stack.pop()
        if b.counts is not None:
            _leaf(a, b.docs, b.counts)
        for first, kid in b.kids.items():
            mine = a.kids.get(first)
            if mine is None:
                a.kids[first] = kid
                continue
            k = _shared(mine.label, kid.label)
            if k < len(mine.label):
                mine = _split(a, mine, k)
            if k < len(kid.label):
                kid.label, kid = kid.label[k:], Node(b"", {kid.label[k]: kid})
            stack.append((mine, kid))


def walk(root: Node):
    """(term, documents, counts) in the order of bytes."""
    stack = [(root, b"")]
    while stack:
        node, path = stack.pop()
        path += node.label
        if node.counts is not None:
            yield path, node.docs, node.counts
        stack += [(node.kids[b], path) for b in sorted(node.kids, reverse=True)]


def cut(root: Node, depth: int):
    """(prefix, subtrie) for the terms of each prefix of ``depth`` bytes, a shorter term being a prefix of its own."""
    stack = [(root, b"")]
    while stack:
        node, path = stack.pop()
        path += node.label
        if len(path) >= depth:
            yield path[:depth], Node(path, node.kids, node.docs, node.counts)
            continue
        if node.counts is not None:
            yield path, Node(path, None, node.docs, node.counts)
        stack += [(kid, path) for kid in node.kids.values()]


_TRIE = "lang string, prefix binary, depth int, leaves long, labels binary, lens array<int>, kids array<int>, docs array<long>, widths array<int>, names array<string>, at array<int>, counts array<long>"
_TRIE_ARROW = pa.schema(
    [("lang", pa.string()), ("prefix", pa.binary()), ("depth", pa.int32()), ("leaves", pa.int64()), ("labels", pa.binary()), ("lens", pa.list_(pa.int32())), ("kids", pa.list_(pa.int32())),
     ("docs", pa.list_(pa.int64())), ("widths", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("at", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)


def dump(node: Node) -> dict:
    """A trie as flat arrays, nodes in preorder; ``widths`` has the number of counters of each node."""
    labels, lens, kids, docs, widths, names, at, counts, stack = [], [], [], [], [], {}, [], [], [node]
    while stack:
        n = stack.pop()
        labels.append(n.label)
        lens.append(len(n.label))
        kids.append(len(n.kids))
        docs.append(n.docs)
        if n.counts:
            widths.append(len(n.counts))
            for source in n.counts:
                if source not in names:
                    names[source] = len(names)
                at.append(names[source])
            counts += n.counts.values()
        else:
            widths.append(0)
        if n.kids:
            stack += n.kids.values()
    leaves = sum(w > 0 for w in widths)
    return {"leaves": leaves, "labels": b"".join(labels), "lens": lens, "kids": kids, "docs": docs, "widths": widths, "names": list(names), "at": at, "counts": counts}


def load(row: dict) -> Node:
    """The trie of ``dump``'s arrays, below an empty root."""
    root, names, labels = Node(), row["names"], row["labels"]
    begin = c = 0
    stack = [[root, 1]]
    for size, kids, docs, width in zip(row["lens"], row["kids"], row["docs"], row["widths"], strict=True):
        counts = {names[a]: n for a, n in zip(row["at"][c : c + width], row["counts"][c : c + width], strict=True)} if width else None
        node = Node(labels[begin : begin + size], None, docs, counts)
        begin, c = begin + size, c + width
        top = stack[-1]
        top[0].kids[node.label[0]] = node
        top[1] -= 1
        if not top[1]:
            stack.pop()
        if kids:
            stack.append([node, kids])
    return root


def _arrays(held: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; values of a list column are converted all at once."""
    cols = []
    for f in schema:
        values = [row[f.name] for row in held]
        if pa.types.is_list(f.type):
            ends = np.cumsum([0, *map(len, values)])
            cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(chain.from_iterable(values)), f.type.value_type)))
        else:
            cols.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _dicts(batch: pa.RecordBatch):
    """Rows of a batch; values of a list column are converted all at once."""
    cols = []
    for col in batch.columns:
        if pa.types.is_list(col.type):
            flat = col.flatten()
            values = flat.to_numpy().tolist() if pa.types.is_integer(flat.type) else flat.to_pylist()
            ends = (col.offsets.to_numpy() - col.offsets[0].as_py()).tolist()
            cols.append([values[a:b] for a, b in pairwise(ends)])
        else:
            cols.append(col.to_pylist())
    for row in zip(*cols, strict=True):
        yield dict(zip(batch.schema.names, row, strict=True))


def _rows(made, size: int = 512):
    held = []
    for row in made:
        held.append(row)
        if len(held) >= size:
            yield _arrays(held, _TRIE_ARROW)
            held = []
    if held:
        yield _arrays(held, _TRIE_ARROW)


def _subtries(tries: dict, depth: int):
    for lang, root in tries.items():
        for prefix, node in cut(root, depth):
            yield {"lang": lang, "prefix": prefix, "depth": depth} | dump(node)


def _uncollected(task):
    """A task over tries without the search for cycles: no node refers back, and searching all of them again and again takes a fifth of the time."""

    def run(batches):
        collecting = gc.isenabled()
        gc.disable()
        try:
            yield from task(batches)
        finally:
            if collecting:
                gc.enable()

    return run


def _count(depth: int, leaves: int, most: int):
    @_uncollected
    def run(batches):
        tries, groups, holders, n_leaves = {}, {}, {}, 0

        def to_tries() -> int:
            new = 0
            for lang, docs in holders.items():
                counts = {t: {} for t in docs}
                for (of, source), counted in groups.items():
                    if of == lang:
                        for term, n in counted.items():
                            counts[term][source] = n
                built = build((term, docs[term], counts[term]) for term in sorted(counts))
                if lang in tries:
                    merge(tries[lang], built)
                else:
                    tries[lang] = built
                new += len(counts)
            groups.clear()
            holders.clear()
            return new

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms(text)
                groups.setdefault((lang, source), Counter()).update(found)
                holders.setdefault(lang, Counter()).update(set(found))
            if sum(map(len, groups.values())) > most:
                n_leaves += to_tries()
                if n_leaves > leaves:
                    yield from _rows(_subtries(tries, depth))
                    tries, n_leaves = {}, 0
        to_tries()
        yield from _rows(_subtries(tries, depth))

    return run


def _recut(depth: int):
    @_uncollected
    def run(batches):
        for batch in batches:
            yield from _rows(out for row in _dicts(batch) for out in _subtries({row["lang"]: load(row)}, depth))

    return run


_BLOCK = "lang string, size long, terms array<string>, widths array<int>, names array<string>, sums array<long>, at array<int>, counts array<long>"
_BLOCK_ARROW = pa.schema(
    [("lang", pa.string()), ("size", pa.int64()), ("terms", pa.list_(pa.string())), ("widths", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)


def _block(lang: str, kept: list) -> pa.RecordBatch:
    names, at, counts = {}, [], []
    for _, found in kept:
        for source, n in found.items():
            at.append(names.setdefault(source, len(names)))
            counts.append(n)
    sums = np.zeros(len(names), np.int64)
    np.add.at(sums, at, counts)
    row = {"lang": lang, "size": len(kept), "terms": [t.decode() for t, _ in kept], "widths": [len(f) for _, f in kept], "names": list(names), "sums": sums.tolist(), "at": at, "counts": counts}
    return _arrays([row], _BLOCK_ARROW)


def _merge(min_docs: int):
    @_uncollected
    def run(batches):
        root, now, kept = None, None, []

        def close():
            return [(t, counts) for t, docs, counts in walk(root) if docs >= min_docs]

        for batch in batches:
            for row in _dicts(batch):
                key = row["lang"], row["prefix"]
                if root is not None and key == now:
                    merge(root, load(row))
                    continue
                if root is not None:
                    kept += close()
                    if kept and (key[0] != now[0] or len(kept) >= BLOCK):
                        yield _block(now[0], kept)
                        kept = []
                root, now = load(row), key
        if root is not None and (kept := kept + close()):
            yield _block(now[0], kept)

    return run


def share(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exactly, by long division in steps of 1000."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Sums:
    """Sums over terms for pairs of one language's sources, and the best terms of each of them, for one tile."""

    def __init__(self, row: dict, tile: int):
        self.sources, self.n, self.kept = row["sources"], np.array(row["totals"], np.int64), row["kept"]
        self.rows = range(row["tile"] * tile, min(len(self.sources), (row["tile"] + 1) * tile))
        self.at = {s: i for i, s in enumerate(self.sources)}
        self.values = np.zeros((len(self.rows), len(self.sources)), np.int64)
        self.best: list = [[] for _ in self.rows]

    def add(self, row: dict, top: int) -> None:
        where = np.array([self.at[s] for s in row["names"]], np.int64)[row["at"]]
        counts, term = np.array(row["counts"], np.int64), np.repeat(np.arange(row["size"]), row["widths"])
        step = max(1, _CELLS // len(self.sources))
        for begin in range(0, row["size"], step):
            lo, hi = np.searchsorted(term, (begin, begin + step))
            table = np.zeros((min(step, row["size"] - begin), len(self.sources)), np.int64)
            table[term[lo:hi] - begin, where[lo:hi]] = counts[lo:hi]
            p = share(table, self.n + self.kept)
            q = share(table.sum(axis=1), self.n.sum() + self.kept)
            for k, s in enumerate(self.rows):
                own = p[:, s]
                self.values[k] += distance(own[:, None], p).sum(axis=0)
                at = np.flatnonzero((table[:, s] > 0) & (own > q))
                f = distance(own[at], q[at])
                first = np.argsort(-f, kind="stable")[:top]  # terms of a block are in UTF-8 order
                found = [(-v, row["terms"][begin + i]) for v, i in zip(f[first].tolist(), at[first].tolist(), strict=True)]
                self.best[k] = sorted(self.best[k] + found)[:top]

    def rows_out(self, lang: str) -> pa.RecordBatch:
        out = [(self.sources[s], "pair", t, v) for k, s in enumerate(self.rows) for t, v in zip(self.sources, self.values[k].tolist(), strict=True) if t != self.sources[s]]
        out += [(self.sources[s], "term", t, -v) for k, s in enumerate(self.rows) for v, t in self.best[k]]
        cols = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True))], names=["lang", "source", "part", "item", "value"])


def _audit(top: int, tile: int, tables: int = 8):
    def run(batches):
        held = {}
        for batch in batches:
            for row in _dicts(batch):
                key = row["lang"], row["tile"]
                if key not in held and len(held) >= tables:
                    for (lang, _), sums in held.items():
                        yield sums.rows_out(lang)
                    held = {}
                if key not in held:
                    held[key] = _Sums(row, tile)
                held[key].add(row, top)
        for (lang, _), sums in held.items():
            yield sums.rows_out(lang)

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Blocks of the terms of each language in at least ``min_docs`` documents, in UTF-8 order, with their counts in each source."""
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), text)
    depth, small = PREFIX, []
    part = materialise(rows.mapInArrow(_count(depth, LEAVES, COUNTS), _TRIE), "tries")
    while True:
        sizes = part.groupBy("lang", "prefix").agg(F.sum("leaves").alias("all"), F.max("leaves").alias("most"))
        wide = sizes.where((F.col("all") > RANGE_LEAVES) & (F.col("most") > 1)).select("lang", "prefix")
        if wide.isEmpty():
            break
        depth *= 2
        small.append(part.join(wide, ["lang", "prefix"], "left_anti"))
        part = materialise(part.join(wide, ["lang", "prefix"], "left_semi").mapInArrow(_recut(depth), _TRIE), "tries")
    for more in small:
        part = part.unionByName(more)
    ordered = part.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return materialise(ordered.mapInArrow(_merge(min_docs), _BLOCK), "terms")


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each other source and the most telling terms are from each source."""
    blocks = kept_terms(docs, min_docs)
    counted = blocks.select("lang", F.explode(F.arrays_zip("names", "sums")).alias("x")).groupBy("lang", F.col("x.names").alias("source")).agg(F.sum("x.sums").alias("total"))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = materialise(groups.join(counted, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("x"))
    langs = listed.join(blocks.groupBy("lang").agg(F.sum("size").alias("kept")), "lang").select(
        "lang", "kept", F.col("x.source").alias("sources"), F.col("x.total").alias("totals"), F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(x) - 1) div {TILE} as int)"))).alias("tile")
    )
    found = materialise(blocks.join(langs, "lang").mapInArrow(_audit(top, TILE), "lang string, source string, part string, item string, value long"), "divergence")

    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    # Of a group's candidates from all tasks, sixteen parts are cut to the best first.
    salted = Window.partitionBy("lang", "source", F.pmod(F.hash("item"), F.lit(16))).orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(ranked)
