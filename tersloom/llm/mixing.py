"""Mixing sources to target weights: hash-threshold histograms, no sort of the corpus. [native]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersloom.llm.common import WORD_SPLIT, table, written

# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2
#: Buckets of each histogram level: 2**12 rows a source, whatever the corpus' size.
LEVEL_BITS = 12


def n_words(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    parts = F.split(text, WORD_SPLIT)  # an empty string stands before leading or after trailing white space
    edge = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]$"), 1).otherwise(0)
    only = F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(parts) - edge).otherwise(0)
    return F.coalesce(only, F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also target. Weighted shares of 150 % of everything, cut at twice a source's size, the excess reshared by weight.

    Water filling in closed form: ordered by cap / weight, the sources below the level are those that are cut. One row a source;
    sources are few beside records (their list is one row a source), so ranking them in one task is bounded by the number of sources.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in WEIGHTS)), (F.col("k") % len(WEIGHTS) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    r = sizes.withColumn("k", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * MOST_TIMES)
    r = r.withColumn("total", F.sum("source_size").over(everything) * (SHARE_PERCENT / 100))
    before = Window.orderBy(F.col("cap") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("cut_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the level if this source were the first that is not cut
    r = r.withColumn("level", (F.col("total") - F.col("cut_before")) / F.col("w_left"))
    r = r.withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("k"), F.col("level")))).over(everything)
    level = first["level"]
    return r.select("source", "source_size", F.when(level.isNull() | (level * F.col("w") > F.col("cap")), F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def rank_hash(doc_id: Column, seed: int) -> Column:
    """60 bits of md5, the same in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, whole_rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for every row; with ``whole_rows`` also the row itself, as the struct ``row``.

    Each document is taken ``floor(target / source_size)`` times whole; the rest of the budget goes to the documents of lowest hash.
    Words are summed by source and the hash's top 12 bits, then, inside the one boundary bucket of each source, by the next 12 bits;
    thresholds are nested. Only the second level's boundary bucket (a 2**-24 part of a source's rows on average, a hot source included) is
    put in hash order, and the document on the boundary gives the words still missing. Rows never move: each is filtered against its source's thresholds.
    Null texts have size 0 and take 0. Rows with equal doc_id share a hash and are ordered by size, and equal ones share what is left evenly by rank.
    Null sources are one source, last. An empty table gives no rows. Texts of any length count whole. Other columns, whatever their names, are not read (with
    ``whole_rows`` they are carried along). Reruns agree: nothing depends on partitions.
    """
    bits, top = LEVEL_BITS, 60
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *([F.struct(*(F.col(c) for c in docs.columns)).alias("row")] if whole_rows else []))
    d = d.withColumn("h", rank_hash(F.col("doc_id"), seed))
    d = d.withColumn("b1", F.shiftright("h", top - bits)).withColumn("b2", F.shiftright("h", top - 2 * bits).bitwiseAND((1 << bits) - 1))
    hist1 = d.groupBy("source", "b1").agg(F.sum("size").alias("words"))
    goal = targets(hist1.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = goal.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("times") * F.col("source_size"))
    # small tables of one row a source: as tables their size is known, so Spark broadcasts them below its threshold only
    goal = written(goal, "goal")
    up1 = Window.partitionBy("source").orderBy("b1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c1 = hist1.withColumn("upto", F.sum("words").over(up1)).join(goal.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g")))
    #: the boundary bucket holds the word number `rest`
    t1 = c1.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))).select("source", F.col("b1").alias("t1"), (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest1"))
    t1 = written(t1, "first-thresholds")
    in1 = d.select("source", "size", "b1", "b2").join(t1.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")) & (F.col("b1") == F.col("t1")))
    hist2 = in1.groupBy("source", "b2").agg(F.sum("size").alias("words"), F.first("rest1").alias("rest1"))
    up2 = Window.partitionBy("source").orderBy("b2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t2 = hist2.withColumn("upto", F.sum("words").over(up2)).filter((F.col("upto") > F.col("rest1")) & (F.col("upto") - F.col("words") <= F.col("rest1"))).select("source", F.col("b2").alias("t2"), (F.col("rest1") - (F.col("upto") - F.col("words"))).alias("rest2"))
    # one row a source: thresholds, and what the last bucket still gives
    cuts = goal.alias("g").join(t1.withColumnRenamed("source", "s1"), F.col("g.source").eqNullSafe(F.col("s1")), "left").join(t2.withColumnRenamed("source", "s2"), F.col("g.source").eqNullSafe(F.col("s2")), "left").select(F.col("g.source").alias("gs"), "source_size", "target", "times", "t1", "t2", "rest2")
    e = d.join(written(cuts, "thresholds"), F.col("source").eqNullSafe(F.col("gs")))
    below = F.col("t1").isNull() | (F.col("b1") < F.col("t1")) | ((F.col("b1") == F.col("t1")) & (F.col("t2").isNull() | (F.col("b2") < F.col("t2"))))
    at = (F.col("b1") == F.col("t1")) & (F.col("b2") == F.col("t2"))
    keep = ["doc_id", "size", "source_size", "target", *(["row"] if whole_rows else [])]
    once = F.when(F.coalesce(below, F.lit(False)) & F.col("t1").isNotNull(), F.col("size")).otherwise(0)
    sure = e.filter(~F.coalesce(at, F.lit(False))).select(*keep, (F.col("times") * F.col("size") + once).alias("taken"))
    up3 = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = e.filter(at).withColumn("before", F.coalesce(F.sum("size").over(up3), F.lit(0)))
    edge = edge.select(*keep, (F.col("times") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest2") - F.col("before")))).alias("taken"))
    return sure.unionByName(edge)


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document's row comes as often as it is taken whole; one that is taken in part comes once more, with
    its first words only and n_chars to match (one such row a source at most). Documents that are not taken, such as empty texts, go."""
    m = mixed(docs, whole_rows=True).filter("taken > 0")
    m = m.withColumn("whole", F.expr("cast(taken div size as int)")).withColumn("part", F.expr("cast(taken % size as int)"))
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.expr("whole + if(part > 0, 1, 0)"))))
    cut = F.expr("copy > whole")
    pieces = F.split(F.col("row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # a word each, with the white space before it
    m = m.withColumn("text", F.when(cut, F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("part"), F.lit(1))), "")).otherwise(F.col("row.text")))
    cols = {"text": F.col("text"), "n_chars": F.when(cut, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return m.select(*(cols.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


_SQL_MIX = r"""
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS k, source_size * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM src),
walk AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cut_before,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left FROM ranked),
lev AS (SELECT *, (total - cut_before) / w_left AS level FROM walk),
pick AS (SELECT arg_min(level, cap / w) AS level FROM lev WHERE level * w <= cap),
goal AS (SELECT source, source_size, CASE WHEN p.level IS NULL OR p.level * w > cap THEN cap::DOUBLE ELSE p.level * w END AS target FROM ranked CROSS JOIN pick p),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM goal),
run AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.times, round(p.target)::BIGINT - p.times * p.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)"""

OP8_SQL = f"""
WITH {_SQL_MIX}
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM run
"""
