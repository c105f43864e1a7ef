"""Sharding by fixed virtual slots: records hash into thousands of slots; a small versioned map sends slots to shards."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersloom.llm.common import scratch_path, table, written

#: Slots never change in number; only the map from slot to shard does. The map is the one thing collected: this many rows.
SLOTS = 4096
#: Parts of a slot that are numbered apart.
PARTS = 16
MAP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("bytes", T.LongType())])


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 (null: of the empty text, 0), virtual_slot (by doc_id; null ids by their text)."""
    t = F.coalesce(F.col(text), F.lit(""))
    key = F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(t))
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot, pre-aggregated before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[tuple[int, int, int, int]]:
    """Version 1: largest slot first, each to the lightest shard; ties to the smaller number."""
    heap = [(0, k) for k in range(shards)]
    out = []
    for s in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, k = heapq.heappop(heap)
        out.append((1, s, k, sizes.get(s, 0)))
        heapq.heappush(heap, (load + sizes.get(s, 0), k))
    return sorted(out, key=lambda r: r[1])


def rebalanced(old: list[tuple[int, int, int, int]], shards: int, sizes: dict[int, int] | None = None) -> list[tuple[int, int, int, int]]:
    """The next version of the map for a grown number of shards: slots move only from shards above the new mean, only into new shards."""
    version = max(r[0] for r in old) + 1
    size = {r[1]: (sizes or {}).get(r[1], r[3]) for r in old}
    where = {r[1]: r[2] for r in old}
    have = max(where.values()) + 1
    load = [0] * max(shards, have)
    for s, k in where.items():
        load[k] += size[s]
    mean = sum(load) / shards
    for new in range(have, shards):
        # small slots are tried too, so the new shard comes as near to the mean as the slots allow
        for s in sorted(where, key=lambda s: (-size[s], s)):
            k = where[s]
            if k < have and load[k] - size[s] >= mean * 0.995 and load[new] + size[s] <= mean:
                load[k] -= size[s]
                load[new] += size[s]
                where[s] = new
    return [(version, s, where[s], size[s]) for s in sorted(where)]


def map_frame(spark: SparkSession, rows: list[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, MAP_SCHEMA)


# --------------------------------------------------------------------------- the stored map


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the map that are stored whole below ``path``, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(root):
        return []
    names = [s.getPath() for s in store.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v")]
    done = [p for p in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[1:]) for p in done)


def save_map(spark: SparkSession, path: str, rows: list[tuple[int, int, int, int]]) -> int:
    """Stores a version as a table of its own; a version that exists is never changed (this raises)."""
    version = rows[0][0]
    map_frame(spark, rows).coalesce(1).write.mode("errorifexists").parquet(f"{path}/v{version}")
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, int, int, int]]:
    """A stored version, the latest by default: (version, virtual_slot, shard, bytes), one row a slot."""
    version = versions(spark, path)[-1] if version is None else version
    return sorted((tuple(r) for r in spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v{version}").collect()), key=lambda r: r[1])


def rebalance(spark: SparkSession, path: str, shards: int, sizes: dict[int, int] | None = None) -> int:
    """Edits the latest stored map for a grown number of shards, and for new slot sizes if given, and stores it as the next version."""
    return save_map(spark, path, rebalanced(load_map(spark, path), shards, sizes))


def sharded(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row with its shard, and ``slot``: its place in the shard, gapless from 0.

    Law ``bytes``: shards come near equal bytes. The slot map is stored below ``map_path`` (a new folder in the shared one by default): its latest version
    decides; where there is none, one is made from the slots' bytes (at most ``slots`` rows reach the driver) and stored as version 1. Places are found in
    three levels: a shard's slots follow each other, a slot's parts (PARTS of them, by hash of the row) follow each other, and rows are numbered inside
    their part only, so no task ever holds a shard or a slot. Slots hash doc_id, so copies of one text, or a hot source, spread evenly; a record
    larger than a fair share cannot be cut and makes its shard larger.
    Null texts have size 1; null ids hash by text; repeated rows are all kept and numbered; an empty table gives no rows; texts of any length
    count whole; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    path = map_path or scratch_path(spark, "slot-map")
    rows = sized(docs, doc_id, text, slots).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("part")), F.lit(PARTS)).cast("int"))
    parts = written(rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "slots")
    per_slot = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in parts.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()}
    if not versions(spark, path):
        save_map(spark, path, first_map({s: b for s, (b, _) in per_slot.items()}, shards, slots))
    begin, upto = [], {}
    for version, s, k, _ in load_map(spark, path):
        begin.append((version, s, k, upto.get(k, 0)))
        upto[k] = upto.get(k, 0) + per_slot.get(s, (0, 0))[1]
    m = map_frame(spark, begin).withColumnRenamed("bytes", "first_place")
    earlier = Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.join(F.broadcast(m), "virtual_slot").select("virtual_slot", "part", "shard", "version", (F.col("first_place") + F.coalesce(F.sum("rows").over(earlier), F.lit(0))).alias("first_place"))
    inside = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_n", F.row_number().over(inside) - 1).join(first, ["virtual_slot", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_place") + F.col("_n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
