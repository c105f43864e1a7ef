"""Approximate nearest neighbours by balanced posting lists.

Centroids of a balanced tree of two-means splits (fitted on a bounded sample) head posting lists. Every vector is indexed: in its nearest list and,
near a boundary, in further ones. A query finds lists by best-first search in an in-memory graph of the centroids, pruned by distance ratio.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tersloom.llm.common import table, written

#: Vectors that centroids and the ratio are fitted on, at most, chosen by hash.
SAMPLE = 12_000
#: Mean vectors of a list, and the most lists; centroids and their graph stay a few MB.
LIST_SIZE, MOST_LISTS = 128, 4096
#: Lists that a vector is put in, at most, and the distance ratio up to which it is.
REPLICAS, BOUNDARY = 4, 1.15
DEGREE = 24
#: Rows that one task scans, about: small lists share a task, which gives each query k rows in all; a larger list is split by hash of vec_id,
#: so that one vector's many copies are never one task's.
TASK_ROWS = 16_384
#: Share of the sample's true neighbours that the searched lists must hold when the ratio is fitted.
FIT_RECALL = 0.955


@dataclass
class Index:
    centroids: np.ndarray
    edges: list[np.ndarray]
    ratio: float
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # primary rows of each list

    def lists_of(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (row, list): the nearest list first, then others within the ratio, if no list chosen before is nearer to them than the vector."""
        c = self.centroids
        for i in range(0, len(x), 512):
            b = x[i : i + 512]
            d = np.sqrt(np.maximum((b * b).sum(1)[:, None] - 2 * b @ c.T + (c * c).sum(1)[None], 0))
            near = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
            dn = np.take_along_axis(d, near, 1)
            take = dn <= BOUNDARY * dn[:, :1]
            for j in range(1, near.shape[1]):
                for e in range(j):
                    between = np.sqrt(((c[near[:, e]] - c[near[:, j]]) ** 2).sum(1))
                    take[:, j] &= ~(take[:, e] & (between < 0.5 * dn[:, j]))
            r, k = np.nonzero(take)
            yield r + i, near[r, k]

    def search(self, q: np.ndarray, least: int) -> list[int]:
        """Lists in order of distance whose centroid is within the ratio of the nearest; more, until they hold ``least`` vectors."""
        c = self.centroids
        entry = int(((c[self.entries] - q) ** 2).sum(1).argmin())
        begin = int(self.entries[entry])
        d0 = float(np.sqrt(((c[begin] - q) ** 2).sum()))
        seen = {begin}
        frontier, found, best, held = [(d0, begin)], [], d0, 0
        slack = 0
        while frontier:
            d, k = heapq.heappop(frontier)
            outside = d > self.ratio * best
            if outside and held >= least:
                slack += 1
                if slack > DEGREE:  # the frontier lies outside; a few more steps find lists behind it
                    break
            else:
                found.append((d, k))
                held += int(self.sizes[k])
            new = [n for n in self.edges[k].tolist() if n not in seen]
            if new:
                seen.update(new)
                for n, dist in zip(new, np.sqrt(((c[new] - q) ** 2).sum(1)).tolist(), strict=True):
                    best = min(best, dist)
                    heapq.heappush(frontier, (dist, n))
        found.sort()
        out, held = [], 0
        for d, k in found:
            if d > self.ratio * best and held >= least:
                break
            out.append(k)
            held += int(self.sizes[k])
        return out

    @property
    def entries(self) -> np.ndarray:
        n = len(self.centroids)
        return np.arange(0, n, max(1, n // 16))


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Two-means splits at the median, so leaves hold equal numbers; leaf means."""
    leaves = [np.arange(len(x))]
    rng = np.random.default_rng(5)
    while len(leaves) < lists:
        leaves.sort(key=len, reverse=True)
        big = leaves.pop(0)
        if len(big) < 2:
            leaves.append(big)
            break
        v = x[big]
        a, b = v[rng.integers(len(v))], None
        b = v[((v - a) ** 2).sum(1).argmax()]
        a = v[((v - b) ** 2).sum(1).argmax()]
        for _ in range(8):
            side = ((v - a) ** 2).sum(1) - ((v - b) ** 2).sum(1)
            cut = np.argsort(side, kind="stable")
            half = len(v) // 2
            a, b = v[cut[:half]].mean(0), v[cut[half:]].mean(0)
        leaves += [big[cut[:half]], big[cut[half:]]]
    return np.stack([x[i].mean(0) for i in leaves if len(i)])


def centroid_graph(c: np.ndarray) -> list[np.ndarray]:
    """Each centroid's nearest ones, and the reverse edges; a ring keeps the graph connected."""
    n = len(c)
    d = np.maximum((c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)[None], 0)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, : min(DEGREE, n - 1)]
    out: list[set[int]] = [set(r.tolist()) for r in near]
    for i, r in enumerate(near):
        for j in r.tolist():
            out[j].add(i)
        out[i] |= {(i + 1) % n, (i - 1) % n} - {i}
    return [np.array(sorted(s), np.int64) for s in out]


def fit(x: np.ndarray, total: int, k: int = 10) -> Index:
    """Centroids, graph, and the smallest ratio at which the lists within it hold FIT_RECALL of the true neighbours of sample queries."""
    lists = int(min(MOST_LISTS, max(1, round(total / LIST_SIZE)), max(1, len(x) // 4)))
    c = balanced_centroids(x, lists) if len(x) else np.zeros((1, 1))
    index = Index(c, centroid_graph(c), 1.0)
    if len(x) < 2 or len(c) < 2:
        return index
    where: list[list[int]] = [[] for _ in x]
    for rows, at in index.lists_of(x):
        for r, a in zip(rows.tolist(), at.tolist(), strict=True):
            where[r].append(a)
    need = []
    for i in range(0, len(x), max(1, len(x) // 250)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        dc = np.sqrt(((c - x[i]) ** 2).sum(1))
        for j in np.argsort(d, kind="stable")[: min(k, len(x) - 1)]:
            need.append(min(dc[a] for a in where[j]) / max(dc.min(), 1e-12))
    index.ratio = float(np.quantile(need, FIT_RECALL)) * 1.01
    return index


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows and their vectors in double precision: not null, not zero, without null or non-finite components, of the index' dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at, flat = np.asarray(column.offsets), np.asarray(pc.fill_null(column.values.cast(pa.float64()), float("nan")))
    rows = np.flatnonzero(np.asarray(column.is_valid()) & (np.diff(at) == dim))
    x = flat[at[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    good = np.isfinite(x).all(1) & x.any(1)
    return rows[good], x[good]


def best_of(ids: np.ndarray, d: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The ``k`` nearest distinct ids with their smallest distances, ties to the smaller id. Only a front of the rows is sorted, a larger one if it holds too few ids."""
    m = k * REPLICAS
    while True:
        front = np.arange(len(d)) if m >= len(d) else np.flatnonzero(d <= np.partition(d, m - 1)[m - 1])
        front = front[np.lexsort((ids[front], d[front]))]
        best: dict[int, float] = {}
        for i, x in zip(ids[front].tolist(), d[front].tolist(), strict=True):
            best.setdefault(i, x)
        if len(best) >= k or m >= len(d):
            return list(best.items())[:k]
        m *= 8


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose vec_id is divisible by ``every``, ties to the smaller vec_id.

    Score: Euclidean distance in double precision on the original vectors. Lists meet their queries in a co-group by task, which gives each
    query's ``k`` best of all its lists there, so rows between the stages are at most k for each query and TASK_ROWS rows; copies of a vector are split by hash.
    Vectors that are null, empty, zero, of another dimension, or hold null or non-finite components take no part; a null vec_id neither. Repeated
    vec_ids give their smallest distance and count once, however many there are; a query's own id is never its candidate. Fewer candidates than k: all of
    them. Ties go to the smaller vec_id. An empty table gives no rows. Vectors of any length are used whole; other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).filter("vec_id is not null and x is not null")
    total = v.count()
    picked = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow().column("x").combine_chunks()
    lens = [len(x) for x in picked.to_pylist() if x]
    dim = max(set(lens), key=lambda n: (lens.count(n), n)) if lens else 1
    index = fit(_matrix(picked, dim)[1], total, k)
    shared = spark.sparkContext.broadcast(index)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                s = b.slice(i, 2048)
                rows, x = _matrix(s.column(1), dim)
                ids = np.asarray(s.column(0))[rows] if len(rows) else np.zeros(0, np.int64)
                for r, lists in shared.value.lists_of(x):
                    first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(first), pa.array(ids[r], pa.int64()), pa.array([x[j].tobytes() for j in r.tolist()], pa.binary())], names=["list", "first", "vec_id", "v"])

    postings = written(v.mapInArrow(post, "list int, first boolean, vec_id long, v binary"), "postings")
    # one row a list; a vec_id that is given more than once counts once, for a query needs k of them
    owned = postings.filter("first").select("list", "vec_id").distinct().groupBy("list").agg(F.count("*").alias("own"))
    sizes = postings.groupBy("list").agg(F.count("*").alias("n")).join(owned, "list", "left").select("list", "n", F.coalesce("own", F.lit(0)).alias("own")).collect()
    index.sizes = np.zeros(len(index.centroids), np.int64)
    rows_of = np.zeros(len(index.centroids), np.int64)
    for r in sizes:
        index.sizes[r["list"]], rows_of[r["list"]] = r["own"], r["n"]
    base, parts, room, task = [], [], 0, -1  # a list's first task, and its number of tasks
    for n in rows_of.tolist():
        if n > TASK_ROWS:
            base.append(task + 1)
            parts.append(-(-n // TASK_ROWS))
            task, room = task + parts[-1], 0
        else:
            if n > room:
                task, room = task + 1, TASK_ROWS
            base.append(task if task >= 0 else 0)
            parts.append(1)
            room -= n
    ready = spark.sparkContext.broadcast((index, base, parts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base, parts = ready.value
        for b in batches:
            rows, x = _matrix(b.column(1), dim)
            ids = np.asarray(b.column(0))
            out = []
            for r, q in zip(rows.tolist(), x, strict=True):
                at: dict[int, list[int]] = {}
                for n in index.search(q, k + 1):
                    for p in range(parts[n]):
                        at.setdefault(base[n] + p, []).append(n)
                out += [(t, int(ids[r]), q.tobytes(), lists) for t, lists in at.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32())))], names=["task", "query_id", "q", "lists"])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.asarray(left.column("list").combine_chunks(), np.int64)
        order = np.argsort(at, kind="stable")
        at, ids = at[order], np.asarray(left.column("vec_id").combine_chunks(), np.int64)[order]
        rows: list[tuple] = []
        if len(ids) and right.num_rows:
            x = np.frombuffer(b"".join(left.column("v").to_pylist()), np.float64).reshape(len(ids), -1)[order]
            for qid, q, lists in zip(right.column("query_id").to_pylist(), right.column("q").to_pylist(), right.column("lists").to_pylist(), strict=True):
                mine = np.concatenate([np.arange(*np.searchsorted(at, [n, n + 1])) for n in lists])
                mine = mine[ids[mine] != qid]
                d = np.sqrt(((x[mine] - np.frombuffer(q, np.float64)) ** 2).sum(1))
                # a vector in several lists, and rows that share a vec_id, count once
                rows += [(qid, i, dist) for i, dist in best_of(ids[mine], d, k)]
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())})

    task_of = F.element_at(F.array(*(F.lit(int(t)) for t in base)), F.col("list") + 1) + F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*(F.lit(int(n)) for n in parts)), F.col("list") + 1)).cast("int")
    p = postings.withColumn("task", task_of).select("task", "list", "vec_id", "v")
    q = v.filter(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(ask, "task int, query_id long, q binary, lists array<int>")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    found = p.groupBy("task").cogroup(q.groupBy("task")).applyInArrow(scan, schema)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
