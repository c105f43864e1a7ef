"""Queries on usage logs, benchmark runs and the evaluation, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersloom.functions import scores as S
from tersloom.functions import text as X
from tersloom.operators import documents as D
from tersloom.operators import nodes as N
from tersloom.plans.common import PARAS_SQL, SQUEEZE_SQL, USAGE_SQL, documents, paragraphs, spread, table, usage
from tersloom.plans.text_queries import plain_nodes

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _date():
    return F.substring("ts", 1, 10)


def _sums() -> list:
    return [F.count("*").alias("calls"), F.sum("input_tok").alias("input_tok"), F.sum("output_tok").alias("output_tok"), F.sum("saved").alias("saved")]


def usage_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*_sums()).withColumn("saved_pct", F.round(S.percent(F.col("saved"), F.col("input_tok")), 6))


_SUMS_SQL = "count(*)::BIGINT AS calls, sum(input_tok)::BIGINT AS input_tok, sum(output_tok)::BIGINT AS output_tok, sum(saved)::BIGINT AS saved, round(CASE WHEN sum(input_tok) = 0 THEN 0.0::DOUBLE ELSE sum(saved)::DOUBLE / sum(input_tok) * 100.0::DOUBLE END, 6) AS saved_pct"


@query(f"WITH {USAGE_SQL} SELECT ts[1:10] AS date, agent, {_SUMS_SQL} FROM log GROUP BY 1, 2")
def usage_daily(spark: SparkSession, sf: str) -> DataFrame:
    return usage_by(usage(spark, sf).withColumn("date", _date()), "date", "agent")


@query(f"WITH {USAGE_SQL} SELECT coalesce(d, 'total') AS date, {_SUMS_SQL} FROM (SELECT *, ts[1:10] AS d FROM log) GROUP BY ROLLUP (d)")
def usage_total(spark: SparkSession, sf: str) -> DataFrame:
    """Days and the grand total in one aggregation."""
    t = usage(spark, sf).withColumn("date", _date()).rollup("date").agg(*_sums())
    return t.withColumn("date", F.coalesce("date", F.lit("total"))).withColumn("saved_pct", F.round(S.percent(F.col("saved"), F.col("input_tok")), 6))


@query(f"WITH {USAGE_SQL} SELECT ts[1:10] AS date, {_SUMS_SQL} FROM log WHERE agent = 'click' AND project = 'p1' AND ts[1:10] BETWEEN '2024-01-05' AND '2024-01-20' AND contains(lower(file), 'file1') GROUP BY 1")
def usage_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Equality, date range and case-insensitive file filters."""
    t = usage(spark, sf).withColumn("date", _date())
    t = t.filter((F.col("agent") == "click") & (F.col("project") == "p1") & F.col("date").between("2024-01-05", "2024-01-20") & F.lower("file").contains("file1"))
    return usage_by(t, "date")


@query("SELECT n_nationkey::BIGINT AS asked, least(n_nationkey * 10, 90)::BIGINT AS days FROM nation")
def days_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("asked"), F.least(F.col("n_nationkey") * 10, F.lit(90)).cast("long").alias("days"))


@query(f"WITH {USAGE_SQL} SELECT DISTINCT 'project' AS field, coalesce(nullif(project, ''), 'unknown') AS value FROM log UNION SELECT DISTINCT 'agent', coalesce(nullif(agent, ''), 'unknown') FROM log")
def usage_filter_values(spark: SparkSession, sf: str) -> DataFrame:
    u = usage(spark, sf)
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("unknown")).alias("value")) for f in ("project", "agent")))
    return u.select(F.explode(pairs).alias("x")).select("x.*").distinct()


@query(f"WITH {USAGE_SQL} SELECT {_SUMS_SQL.replace(', 6)', ', 2)')}, count(DISTINCT file)::BIGINT AS files, count(DISTINCT agent)::BIGINT AS agents, count(DISTINCT ts[1:10])::BIGINT AS days FROM log")
def usage_kpis(spark: SparkSession, sf: str) -> DataFrame:
    t = usage(spark, sf).withColumn("date", _date()).agg(*_sums(), F.countDistinct("file").alias("files"), F.countDistinct("agent").alias("agents"), F.countDistinct("date").alias("days"))
    return t.withColumn("saved_pct", F.round(S.percent(F.col("saved"), F.col("input_tok")), 2))


@query(f"WITH {USAGE_SQL} SELECT ts[1:10] AS date, count(*)::BIGINT AS calls, sum(input_tok)::BIGINT AS input_tok, round(avg(reduction_pct) FILTER (WHERE fidelity = 'semantic'), 4) AS semantic, round(avg(reduction_pct) FILTER (WHERE fidelity = 'compressed'), 4) AS compressed FROM log GROUP BY 1")
def fidelity_daily(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda f: F.round(F.avg(F.when(F.col("fidelity") == f, F.col("reduction_pct"))), 4).alias(f)
    return usage(spark, sf).groupBy(_date().alias("date")).agg(F.count("*").alias("calls"), F.sum("input_tok").alias("input_tok"), mean("semantic"), mean("compressed"))


@query(f"WITH {USAGE_SQL} SELECT agent, project, count(*)::BIGINT AS calls FROM log GROUP BY 1, 2")
def usage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return usage(spark, sf).groupBy("agent", "project").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "agent", "project")


@query(f"WITH {USAGE_SQL}, h AS (SELECT ts[12:13]::INT AS hour, count(*) AS n FROM log WHERE agent = 'error' GROUP BY 1) SELECT r.range AS hour, coalesce(n, 0)::BIGINT AS calls FROM range(24) r LEFT JOIN h ON h.hour = r.range")
def hour_hist(spark: SparkSession, sf: str) -> DataFrame:
    """All 24 hours, zeros too; the range side has 24 rows."""
    h = usage(spark, sf).filter("agent = 'error'").groupBy(F.expr("try_cast(substring(ts, 12, 2) AS bigint)").alias("hour")).agg(F.count("*").alias("n"))
    return spark.range(24).withColumnRenamed("id", "hour").join(h, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("calls"))


# Half-open bins.
REDUCTION_BINS = ((0, "<0"), (5, "0-5"), (10, "5-10"), (20, "10-20"), (30, "20-30"), (50, "30-50"))
TOKEN_CAPS = (128, 512, 1024, 2048, 4096, 8192, 32768)


def binned(c, bins, rest):
    first = F.when(c < bins[0][0], bins[0][1])
    return reduce(lambda w, b: w.when(c < b[0], b[1]), bins[1:], first).otherwise(rest)


@query(f"WITH {USAGE_SQL} SELECT CASE WHEN reduction_pct < 0 THEN '<0' WHEN reduction_pct < 5 THEN '0-5' WHEN reduction_pct < 10 THEN '5-10' WHEN reduction_pct < 20 THEN '10-20' WHEN reduction_pct < 30 THEN '20-30' WHEN reduction_pct < 50 THEN '30-50' ELSE '50+' END AS bin, count(*)::BIGINT AS n FROM log GROUP BY 1")
def reduction_hist(spark: SparkSession, sf: str) -> DataFrame:
    return usage(spark, sf).groupBy(binned(F.col("reduction_pct"), REDUCTION_BINS, "50+").alias("bin")).agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT greatest(1, ceil(length(text) / 4.0))::BIGINT AS tok FROM documents) SELECT CASE WHEN tok < 128 THEN '<128' WHEN tok < 512 THEN '<512' WHEN tok < 1024 THEN '<1024' WHEN tok < 2048 THEN '<2048' WHEN tok < 4096 THEN '<4096' WHEN tok < 8192 THEN '<8192' WHEN tok < 32768 THEN '<32768' ELSE 'more' END AS bin, count(*)::BIGINT AS n FROM t GROUP BY 1")
def token_hist(spark: SparkSession, sf: str) -> DataFrame:
    t = documents(spark, sf).select(X.token_count("text").alias("tok"))
    return t.groupBy(binned(F.col("tok"), [(c, f"<{c}") for c in TOKEN_CAPS], "more").alias("bin")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- benchmark runs

_BENCH_SQL = f"""
{USAGE_SQL},
bench AS (SELECT agent AS run_id, ts, file, format, input_tok, greatest(input_tok - input_tok // 4, 0) AS semantic_tok, input_tok // 2 AS compressed_tok, (k * 13 % 41 + 1) * 10 AS semantic_us, 60.0::DOUBLE + k % 41 AS word_coverage,
  (input_tok::DOUBLE / ((k * 13 % 41 + 1) * 10)) * 1000.0::DOUBLE AS tok_per_ms FROM log1)"""
_BENCH_SQL = _BENCH_SQL.replace("log0 AS (SELECT strftime", "log0 AS (SELECT k, strftime").replace("log AS (SELECT *,", "log1 AS (SELECT *,")


def bench_log(spark: SparkSession, sf: str) -> DataFrame:
    """A benchmark log made of events: a run for each event type."""
    k = F.get_json_object("props", "$.k").cast("long")
    u = table(spark, sf, "events").select("event_id", k.alias("k"), F.col("event_type").alias("run_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.concat(F.lit("file"), (F.col("user_id") % 50).cast("string"), F.lit(".md")).alias("file"), F.element_at(F.array(F.lit("plaintext"), F.lit("markdown"), F.lit("html")), (k % 3 + 1).cast("int")).alias("format"), F.floor("value").cast("long").alias("input_tok"))
    b = u.withColumn("semantic_tok", F.greatest(F.col("input_tok") - F.expr("input_tok div 4"), F.lit(0))).withColumn("compressed_tok", F.expr("input_tok div 2"))
    b = b.withColumn("semantic_us", (F.col("k") * 13 % 41 + 1) * 10).withColumn("word_coverage", 60.0 + F.col("k") % 41)
    return b.withColumn("tok_per_ms", S.tokens_per_ms(F.col("input_tok"), F.col("semantic_us")))


@query(f"""WITH {_BENCH_SQL} SELECT CASE WHEN word_coverage = 100 THEN '100' WHEN word_coverage >= 95 THEN '95-100' WHEN word_coverage >= 80 THEN '80-95' ELSE '<80' END AS bucket, count(*)::BIGINT AS n FROM bench GROUP BY 1""")
def coverage_buckets(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("word_coverage")
    return bench_log(spark, sf).groupBy(F.when(c == 100, "100").when(c >= 95, "95-100").when(c >= 80, "80-95").otherwise("<80").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {_BENCH_SQL}, l AS (SELECT format, list_sort(list(tok_per_ms)) AS v FROM bench GROUP BY format)
SELECT format, round(v[1], 6) AS least, round(v[(round(0.25 * (len(v) - 1)) + 1)::INT], 6) AS p25, round(v[(round(0.5 * (len(v) - 1)) + 1)::INT], 6) AS p50, round(v[(round(0.75 * (len(v) - 1)) + 1)::INT], 6) AS p75, round(v[len(v)], 6) AS most FROM l""")
def boxplot(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest-rank numbers a format. Ranks come from counts of distinct values, summed up in order, so a format's values are never one row."""
    from pyspark.sql import Window

    v = bench_log(spark, sf).groupBy("format", F.col("tok_per_ms").alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("format").orderBy("v")
    r = v.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("format")))
    at = lambda p: F.round(F.lit(p / 100.0) * (F.col("n") - 1)).cast("long")
    pick = lambda p, name: F.round(F.min(F.when(F.col("upto") > at(p), F.col("v"))), 6).alias(name)
    return r.groupBy("format").agg(pick(0, "least"), pick(25, "p25"), pick(50, "p50"), pick(75, "p75"), pick(100, "most"))


_RUN_SQL = "count(*)::BIGINT AS files, round(100.0::DOUBLE - sum(semantic_tok)::DOUBLE / sum(input_tok) * 100.0::DOUBLE, 6) AS sem_pct, round(100.0::DOUBLE - sum(compressed_tok)::DOUBLE / sum(input_tok) * 100.0::DOUBLE, 6) AS cmp_pct, round(avg(tok_per_ms), 4) AS tok_per_ms, round(avg(word_coverage), 6) AS coverage"


def _runs(df: DataFrame, *keys: str) -> DataFrame:
    pct = lambda c: F.round(X.reduction_pct(F.sum("input_tok"), F.sum(c)), 6)
    return df.groupBy(*keys).agg(F.count("*").alias("files"), pct("semantic_tok").alias("sem_pct"), pct("compressed_tok").alias("cmp_pct"), F.round(F.avg("tok_per_ms"), 4).alias("tok_per_ms"), F.round(F.avg("word_coverage"), 6).alias("coverage"), F.min("ts").alias("ts"))


@query(f"WITH {_BENCH_SQL} SELECT run_id, {_RUN_SQL}, min(ts) AS ts FROM bench GROUP BY run_id")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(bench_log(spark, sf), "run_id")


@query(f"WITH {_BENCH_SQL} SELECT file, round(100.0::DOUBLE - semantic_tok::DOUBLE / input_tok * 100.0::DOUBLE, 2) AS sem_pct, round(tok_per_ms, 2) AS speed, CASE WHEN 100.0 - semantic_tok::DOUBLE / input_tok * 100.0 >= 20 THEN 'good' WHEN 100.0 - semantic_tok::DOUBLE / input_tok * 100.0 >= 5 THEN 'ok' ELSE 'low' END AS class FROM bench WHERE input_tok > 0")
def scatter(spark: SparkSession, sf: str) -> DataFrame:
    p = X.reduction_pct(F.col("input_tok"), F.col("semantic_tok"))
    return bench_log(spark, sf).filter("input_tok > 0").select("file", F.round(p, 2).alias("sem_pct"), F.round("tok_per_ms", 2).alias("speed"), X.pct_class(p).alias("class"))


@query(f"WITH {_BENCH_SQL}, f AS (SELECT unnest(['plaintext', 'markdown', 'html', 'other']) AS format) SELECT f.format, count(b.format)::BIGINT AS n FROM f LEFT JOIN bench b ON f.format = b.format GROUP BY 1")
def format_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed formats, zeros too; four rows against the aggregate."""
    n = bench_log(spark, sf).groupBy("format").agg(F.count("*").alias("c"))
    f = spark.range(1).select(F.explode(F.array(*map(F.lit, ("plaintext", "markdown", "html", "other")))).alias("format"))
    return f.join(n, "format", "left").select("format", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


@query(f"WITH {_BENCH_SQL} SELECT {_RUN_SQL}, round(sum(input_tok)::DOUBLE / sum(semantic_us) * 1000.0::DOUBLE, 6) AS throughput FROM bench")
def grand_summary(spark: SparkSession, sf: str) -> DataFrame:
    b = bench_log(spark, sf)
    pct = lambda c: F.round(X.reduction_pct(F.sum("input_tok"), F.sum(c)), 6)
    return b.agg(F.count("*").alias("files"), pct("semantic_tok").alias("sem_pct"), pct("compressed_tok").alias("cmp_pct"), F.round(F.avg("tok_per_ms"), 4).alias("tok_per_ms"), F.round(F.avg("word_coverage"), 6).alias("coverage"), F.round(S.tokens_per_ms(F.sum("input_tok"), F.sum("semantic_us")), 6).alias("throughput"))


@query("SELECT event_type, list_sort([e.v1, e.v2, e.v3])[2] AS median FROM (SELECT event_type, min(value) AS v1, max(value) AS v2, round(avg(value), 6) AS v3 FROM events GROUP BY 1) e")
def median_of_three(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.round(F.avg("value"), 6).alias("c"))
    return e.select("event_type", F.get(F.array_sort(F.array("a", "b", "c")), F.lit(1)).alias("median"))


# --------------------------------------------------------------------------- evaluation


@query(f"""
WITH {PARAS_SQL},
shown AS (SELECT doc_id, string_agg({SQUEEZE_SQL.format('text')}, chr(10) ORDER BY idx) AS b FROM paras WHERE idx % 2 = 0 GROUP BY doc_id),
w AS (SELECT d.doc_id, b, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: strlen(x) > 5 AND regexp_full_match(x, '\\p{{L}}+'))) AS ws FROM documents d JOIN shown USING (doc_id))
SELECT doc_id, round(CASE WHEN len(ws) = 0 THEN 100.0::DOUBLE ELSE len(list_filter(ws, lambda x: contains(b, x)))::DOUBLE / len(ws) * 100.0::DOUBLE END, 6) AS coverage FROM w""")
def word_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many words every second paragraph still holds."""
    d = plain_nodes(spark, sf).filter(F.size("nodes") > 0)
    d = N.render_nodes(d.withColumn("nodes", F.filter("nodes", lambda n: n["idx"] % 2 == 0)))
    return d.select("doc_id", F.round(S.word_coverage(F.col("text"), F.array_join("lines", "\n")), 6).alias("coverage"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html || '<!-- open', '(?s)<!--.*?(?:-->|\z)', '', 'g'), '(?s)<script.*?(?:</script>|\z)', '', 'g'), '(?s)<style.*?(?:</style>|\z)', '', 'g') AS text FROM pages")
def noncontent_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", S.without_noncontent(F.concat("html", F.lit("<!-- open"))).alias("text"))


@query("SELECT doc_id, fidelity, CASE fidelity WHEN 'semantic' THEN 4096 WHEN 'compressed' THEN 2048 END::BIGINT AS budget FROM documents CROSS JOIN (VALUES ('semantic'), ('compressed'), ('lossless')) f(fidelity)")
def config_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Each document under three settings, by exploding a constant of three."""
    settings = F.array(*(F.struct(F.lit(f).alias("fidelity"), F.lit(b).cast("long").alias("budget")) for f, b in (("semantic", 4096), ("compressed", 2048), ("lossless", None))))
    return documents(spark, sf).select("doc_id", F.explode(settings).alias("s")).select("doc_id", "s.*")


@query(f"""WITH {_BENCH_SQL}, g AS (SELECT run_id, 100.0::DOUBLE - sum(semantic_tok)::DOUBLE / sum(input_tok) * 100.0::DOUBLE AS red, avg(word_coverage) AS cov, sum(input_tok)::DOUBLE / sum(semantic_us) * 1000.0 AS thr, sum(compressed_tok)::DOUBLE / sum(input_tok) AS los FROM bench GROUP BY 1)
SELECT run_id, round(0.40::DOUBLE * least(greatest(red / 40.0, 0), 1) + 0.30::DOUBLE * least(greatest(cov / 100.0, 0), 1) + 0.15::DOUBLE * CASE WHEN thr > 0 THEN least(greatest(log10(thr) / 3.0, 0), 1) ELSE 0 END + 0.15::DOUBLE * least(greatest(2.0 - los, 0), 1), 6) AS score FROM g""")
def composite(spark: SparkSession, sf: str) -> DataFrame:
    g = bench_log(spark, sf).groupBy("run_id").agg(F.sum("input_tok").alias("i"), F.sum("semantic_tok").alias("s"), F.sum("compressed_tok").alias("c"), F.sum("semantic_us").alias("us"), F.avg("word_coverage").alias("cov"))
    return g.select("run_id", F.round(S.composite(X.reduction_pct(F.col("i"), F.col("s")), F.col("cov"), S.tokens_per_ms(F.col("i"), F.col("us")), F.col("c"), F.col("i")), 6).alias("score"))


@query()
def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation over the corpus: three settings of each document in one pass, then one row of sums and the composite score (without timing)."""
    d = spread(paragraphs(spark, sf))
    for name, fidelity, budget in (("sem", "semantic", 4096), ("cmp", "compressed", 2048), ("los", "lossless", None)):
        d = D.transpile(d, fidelity=fidelity, budget=budget).withColumnRenamed("output_tok", f"{name}_tok").withColumnRenamed("content", f"{name}_text").drop("error")
        d = d.drop(f"{name}_text") if name != "los" else d
        d = d.drop("input_tok") if name != "los" else d
    d = d.select("input_tok", "sem_tok", "cmp_tok", "los_tok", S.word_coverage(F.col("text"), F.col("los_text")).alias("coverage"))
    g = d.agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("input_tok", "sem_tok", "cmp_tok", "los_tok")), F.round(F.avg("coverage"), 6).alias("coverage"))
    red = X.reduction_pct(F.col("input_tok"), F.col("sem_tok"))
    return g.withColumn("sem_pct", F.round(red, 6)).withColumn("score", F.round(S.composite(red, F.col("coverage"), F.lit(1000.0), F.col("los_tok"), F.col("input_tok")), 6))


@query("SELECT l_returnflag AS best, count(*)::BIGINT AS wins, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def judge_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Means and win counts of judged rows."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("best")).agg(F.count("*").alias("wins"), F.round(F.avg("l_quantity"), 6).alias("mean"))


# --------------------------------------------------------------------------- scalar functions


@query("""SELECT page_id, CASE WHEN length(url) > 20 THEN left(url, 19) || '…' ELSE url END AS short, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped,
  replace(html, '</', '<' || chr(92) || '/') AS script, trim(replace(format('{:,}', page_id * 12345), ',', ' ')) AS spaced FROM pages""")
def scalar_strings(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", X.shortened("url", 20).alias("short"), X.html_escape(h).alias("escaped"), X.script_safe(h).alias("script"), X.spaced_thousands(F.col("page_id") * 12345).alias("spaced"))


@query("SELECT o_orderkey, strftime(make_date((o_orderkey % 40000)::INT), '%Y-%m-%d') AS day, strftime(to_timestamp((o_orderkey * 7919)::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(to_timestamp((o_orderkey * 7919)::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%d_%H-%M-%S') AS run FROM orders")
def scalar_dates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    iso = X.iso_second(k * 7919)
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(F.date_from_unix_date((k % 40000).cast("int")), "yyyy-MM-dd").alias("day"), iso.alias("iso"), X.run_id(iso).alias("run"))


@query(f"WITH {USAGE_SQL} SELECT 'n' AS kind, count(*)::BIGINT AS n FROM log WHERE input_tok > 50 AND regexp_matches(file, '(1|2)[.]md$') GROUP BY 1")
def hook_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """A size threshold and a set of endings, as one filter."""
    return usage(spark, sf).filter((F.col("input_tok") > 50) & F.col("file").rlike("(1|2)[.]md$")).groupBy(F.lit("n").alias("kind")).agg(F.count("*").alias("n"))
