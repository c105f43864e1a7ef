"""Shared pieces: scratch tables in the shared folder, salted lookups, vectorised tokenising, connected components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this package: runs without ASCII white space.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


# --------------------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a session in a single process (tests) gets a temporary folder, set as such; on a
    cluster, where executors would not see each other's files, this raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tersloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tersloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a Parquet table to the shared folder and read it again. The shuffle files of the write go as soon as it ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tersloom_path = path  # type: ignore[attr-defined]
    return out


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting holds inside the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that nothing will read again."""
    path = getattr(df, "_tersloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def swept(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans and generated classes of ended queries, and with them their shuffle files, would else stay until its heap is full.
    Then give the system what the driver's native heap has freed: compilers and class loaders allocate there, and the C library keeps what they free."""
    gc.collect()
    spark._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Whether the driver's Java machine could give its freed native memory back (HotSpot on Linux from 17.0.9 on; others go on without)."""
    jvm = spark._jvm
    try:
        # the server's class is not open to calls from outside, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return "Trim native heap" in invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the session's Arrow batches, if still of the default 10,000 rows, become batches of 1,000: whole texts are long rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- words, vectorised

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**k and p**-k modulo 2**64 for k < n; kept per worker."""
    if len(_powers[0]) < n:
        size = max(n, 5 << 17)
        for i, base in enumerate((_P, _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(a, out=a)
            _powers[i] = a
    return _powers[0][:n], _powers[1][:n]


class Words:
    """All words of some texts: where they start and end in ``buf``, their hashes, and ``first[i]``: the first of text i."""

    def __init__(self, texts: list[bytes], alnum: bool = False, lower: bool = True):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(lens)])[:-1] if len(texts) else np.zeros(0, np.int64)
        inside = _ALNUM[self.buf] if alnum else ~_SPACE[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        low = _LOWER[self.buf] if lower else self.buf
        up, down = powers(len(self.buf))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[low] * down)])
            self.hash = mix((total[self.end] - total[self.start]) * up[self.start])
        self._total, self._up = total, up
        self.first = np.append(np.searchsorted(self.start, self.at), len(self.start))

    def prefix(self, k: int) -> np.ndarray:
        """Hashes of the words' first k bytes; 0 for shorter words."""
        z = self.start + k
        ok = z <= self.end
        with np.errstate(over="ignore"):
            h = mix((self._total[np.minimum(z, self.end)] - self._total[self.start]) * self._up[self.start] + _U(k))
        return np.where(ok, h, _U(0))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null: empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text at most; a longer text stands alone, whole."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col.cast(pa.binary())), 0))
        begin, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > begin and total + n > limit:
                yield b.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield b.slice(begin)


# --------------------------------------------------------------------------- connected components


def stars_only(edges: DataFrame) -> bool:
    """Whether every u of the edges (u, v), u > v, has a single v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("low")).filter("n > 1 or n = 1 and low = 0").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable. Alternating large-star and small-star rounds.

    Every round is two aggregations by key with partial results before the shuffle; a hub's neighbours are never gathered into one row.
    Each round's edges are written to the shared folder, so that neither lineage nor plans grow.
    Nodes without an edge are not returned, nor are edges from or to null. Ends when every node that has a smaller neighbour has one only, which has none
    itself: then each component is a star around its smallest node. Every round before moves an edge's end to a smaller node, so it does end, and the
    number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    edges = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc")
    while not stars_only(e):
        # large star: neighbours above u go to the smallest in u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: neighbours below u, and u, go to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low2, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(j.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = written(small, "cc")
        dropped(e)
        e = new
    swept(spark)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._tersloom_path = e._tersloom_path  # type: ignore[attr-defined]
    return out
