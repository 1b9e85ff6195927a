"""Operator 6: approximate nearest neighbours by sharded HNSW graphs.

Equal vectors form a class with its least ids (as many as a result can need),
so copies, however many, take one place in a graph. Classes are dealt by hash
to shards of about ``SHARD`` vectors; a hierarchical navigable small-world
graph is built for each shard and stored as one row of flat neighbour arrays.
Query blocks meet every shard's row; each shard returns its best, and they are
merged by exact distance. A shard's row is sent once for ``CHUNK`` blocks, which
then stream past it: a task holds one shard and one block of queries.

Graphs are built and searched for a batch of points at a time with numpy.

Defined results: vectors that are null or zero, or hold null or non-finite
components, take no part; -0 equals 0; vectors of different lengths are never
compared; ties go to the smaller id; a repeated id with the same vector counts
once; other columns are not read, so they may have any name; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

TOP = 10
SHARD = 4096
M = 16
EF_BUILD = 64
EF_SEARCH = 96
_BATCH = 64
_QUERIES = 256
#: Blocks of queries for which a shard's row is sent once.
CHUNK = 64


def _levels(ids: np.ndarray) -> np.ndarray:
    """Level of each point, from a hash of its id: each next level holds one point in M."""
    u = np.array([(xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True)) + 1) / 2.0**64 for i in ids])
    return np.minimum(np.floor(-np.log(u) / np.log(M)), 8).astype(np.int64)


class Graph:
    """links[level] is an (n, width) array of neighbours, filled with -1."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None):
        self.x, self.levels = np.ascontiguousarray(vectors, np.float64), levels
        n = len(vectors)
        # The highest points come first, so the search always starts at point 0.
        self.links = links or [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k in range(int(levels.max()) + 1 if n else 0)]
        if links is None:
            self._build()

    def _distance(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of points (-1: infinite)."""
        d = self.x[at] - q[:, None, :]
        return np.where(at < 0, np.inf, np.einsum("ijk,ijk->ij", d, d))

    def _beam(self, q: np.ndarray, start: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best points and distances that a best-first walk finds from the start points, for each query."""
        rows = np.arange(len(q))
        points = np.full((len(q), ef), -1, np.int64)
        points[:, : start.shape[1]] = start[:, :ef]
        dist = self._distance(q, points)
        order = np.argsort(dist, axis=1, kind="stable")
        points, dist = np.take_along_axis(points, order, 1), np.take_along_axis(dist, order, 1)
        done = np.zeros(points.shape, bool)
        seen = np.zeros((len(q), len(self.x)), bool)
        np.put_along_axis(seen, np.maximum(points, 0), True, 1)
        alive = rows
        while len(alive):
            wait = np.where(done[alive] | (points[alive] < 0), np.inf, dist[alive])
            best = wait.argmin(1)
            alive = alive[np.isfinite(wait[np.arange(len(alive)), best])]
            if not len(alive):
                break
            best = np.where(done[alive] | (points[alive] < 0), np.inf, dist[alive]).argmin(1)
            done[alive, best] = True
            near = self.links[level][points[alive, best]].astype(np.int64)
            fresh = (near >= 0) & ~seen[alive[:, None], np.maximum(near, 0)]
            near = np.where(fresh, near, -1)
            seen[np.repeat(alive, fresh.sum(1)), near[fresh]] = True
            d = self._distance(q[alive], near)
            all_d, all_p = np.concatenate((dist[alive], d), 1), np.concatenate((points[alive], near), 1)
            all_f = np.concatenate((done[alive], np.zeros(d.shape, bool)), 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
            dist[alive], points[alive], done[alive] = (np.take_along_axis(a, order, 1) for a in (all_d, all_p, all_f))
        return points, dist

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros((len(q), 1), np.int64)
        for level in range(len(self.links) - 1, 0, -1):
            start = self._beam(q, start, level, 1)[0]
        return self._beam(q, start, 0, min(ef, max(1, len(self.x))))

    def _build(self):
        n = len(self.x)
        a = 1
        while a < n:
            b = min(n, a + min(_BATCH, a))  # a batch is never larger than the graph it is put into
            new = np.arange(a, b)
            q = self.x[new]
            start = np.zeros((len(new), 1), np.int64)
            among = np.einsum("ijk,ijk->ij", q[:, None] - q[None], q[:, None] - q[None])
            for level in range(len(self.links) - 1, -1, -1):
                here = self.levels[new] >= level
                found, dist = self._beam(q, start, level, EF_BUILD if here.any() else 1)
                if here.any():
                    peers = np.where(here[None, :] & (new[None, :] < new[:, None]), new[None, :], -1)
                    points = np.concatenate((found, peers), 1)[here]
                    dist = np.concatenate((dist, np.where(peers < 0, np.inf, among)), 1)[here]
                    self._link(new[here], points, dist, level)
                start = found[:, :EF_BUILD]
            a = b

    def _link(self, new: np.ndarray, points: np.ndarray, dist: np.ndarray, level: int):
        """Link new points to a varied choice of what was found, both ways."""
        table = self.links[level]
        order = np.argsort(dist, axis=1, kind="stable")
        points, dist = np.take_along_axis(points, order, 1), np.take_along_axis(dist, order, 1)
        for node, p, d in zip(new, points, dist, strict=True):
            p = p[np.isfinite(d) & (self.levels[np.maximum(p, 0)] >= level)]
            chosen = self._varied(node, p, M)
            table[node, : len(chosen)] = chosen
            for c in chosen:
                row = table[c]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                else:
                    all_p = np.append(row, node)
                    diff = self.x[all_p] - self.x[c]
                    all_p = all_p[np.argsort(np.einsum("ij,ij->i", diff, diff), kind="stable")]
                    kept = self._varied(c, all_p, len(row))
                    row[:] = -1
                    row[: len(kept)] = kept

    def _varied(self, node: int, p: np.ndarray, limit: int) -> np.ndarray:
        """Of points sorted by distance, first those that are nearer to the node than to one chosen before, then the rest."""
        if len(p) <= limit:
            return p
        p = p[: 2 * limit]
        diff = self.x[p] - self.x[node]
        own = np.einsum("ij,ij->i", diff, diff)
        among = self.x[p] @ self.x[p].T
        square = np.diag(among)
        among = square[:, None] + square[None, :] - 2 * among
        chosen, rest = [], []
        for i in range(len(p)):
            (chosen if len(chosen) < limit and not (among[i, chosen] < own[i]).any() else rest).append(i)
        return p[(chosen + rest)[:limit]]


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    levels = _levels(pdf["rep"].to_numpy())
    order = np.argsort(-levels, kind="stable")
    x, levels, members = x[order], levels[order], pdf["ids"].to_numpy()[order]
    graph = Graph(x, levels)
    counts = np.array([len(m) for m in members], np.int32)
    return pd.DataFrame(
        {
            "dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "vectors": [x.tobytes()], "levels": [levels.tobytes()], "links": [[t.tobytes() for t in graph.links]],
            "members": [np.concatenate([np.asarray(m, np.int64) for m in members]).tobytes()], "counts": [counts.tobytes()],
        }
    )


_INDEX = "dim int, shard int, vectors binary, levels binary, links array<binary>, members binary, counts binary"


def _search(top: int, ef: int):
    def run(batches):
        graph = None
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                if r["queries"] is None:  # a shard; the blocks behind it are asked of it
                    x, levels = np.frombuffer(r["vectors"], np.float64).reshape(-1, dim), np.frombuffer(r["levels"], np.int64)
                    links = [np.frombuffer(t, np.int32).reshape(len(x), -1) for t in r["links"]]
                    graph = Graph(x, levels, links)
                    ends = np.cumsum(np.frombuffer(r["counts"], np.int32))
                    members = np.frombuffer(r["members"], np.int64)
                    continue
                ids, q = np.array(r["query_ids"], np.int64), np.frombuffer(r["queries"], np.float64).reshape(-1, dim)
                points, _ = graph.search(q, max(ef, top + 1))
                out = ([], [], [])
                for i, p in zip(range(len(ids)), points, strict=True):
                    p = p[p >= 0]
                    d = np.sqrt(((graph.x[p] - q[i]) ** 2).sum(1))
                    size = ends[p] - np.where(p > 0, ends[p - 1], 0)
                    vec = np.concatenate([members[ends[k] - s : ends[k]] for k, s in zip(p, size, strict=True)])
                    d = np.repeat(d, size)
                    own = vec != ids[i]
                    vec, d = vec[own], d[own]
                    best = np.lexsort((vec, d))[:top]
                    out[0].append(np.full(len(best), ids[i]))
                    out[1].append(vec[best])
                    out[2].append(d[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return run


def _classes(vectors: DataFrame, top: int) -> DataFrame:
    """(dim, vector, rep, ids) of each distinct vector, with its top + 1 least ids."""
    # The limit on the row number is applied before the shuffle too, so a hot vector sends few rows.
    w = Window.partitionBy("dim", "vector").orderBy("vec_id")
    few = vectors.distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top + 1)
    return few.groupBy("dim", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0])


def usable(embeddings: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    ok = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return embeddings.select(F.col(ident).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null").where(ok).withColumn("dim", F.size("vector"))


def build(vectors: DataFrame, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """One row of flat arrays for each shard, in the shared folder."""
    classes = materialise(_classes(vectors, top), "hnsw-classes")
    sizes = classes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = classes.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("rep"), "shards").cast("int")).drop("shards")
    # A shard is much work, whatever its bytes, so the number of tasks follows from the shards.
    tasks = max(1, 2 * (sizes.agg(F.sum("shards")).first()[0] or 0))
    return materialise(dealt.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(_build_shard, _INDEX), "hnsw-index")


def nearest(embeddings: DataFrame, queries: DataFrame, top: int = TOP, shard: int = SHARD, ef: int = EF_SEARCH, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for each query row, without the query itself."""
    index = build(usable(embeddings, ident, vector), top, shard)
    places = index.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = usable(queries, ident, vector).dropDuplicates(["vec_id", "vector"])
    n = asked.count()
    blocks = (
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n // _QUERIES + 1)).cast("int"))
        .groupBy("dim", "block").applyInPandas(_pack_queries, "dim int, block int, query_ids array<long>, queries binary")
        .join(F.broadcast(places), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
        .withColumn("chunk", F.floor(F.col("block") / CHUNK).cast("int"))
    )
    chunks = n // _QUERIES // CHUNK + 1
    shards = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("block", F.lit(-1))
    meet = shards.unionByName(blocks, allowMissingColumns=True).repartition(max(1, 2 * chunks * index.count()), "dim", "shard", "chunk")
    found = meet.sortWithinPartitions("dim", "shard", "chunk", "block").mapInArrow(_search(top, ef), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "query_ids": [pdf["vec_id"].tolist()], "queries": [x.tobytes()]})
