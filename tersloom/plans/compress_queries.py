"""Queries on compression, symbols and rendering, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersloom import model as M
from tersloom.functions import text as X
from tersloom.operators import documents as D
from tersloom.operators import nodes as N
from tersloom.plans.common import DATA_STOPWORDS, PARAS_SQL, SQUEEZE_SQL, TOKENS_SQL, documents, paragraphs, spread, table
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


@query(f"""
WITH t AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS tok, unnest(['lossless', 'semantic', 'compressed']) AS fidelity FROM documents),
r AS (SELECT *, tok::DOUBLE / 400 AS ratio FROM t)
SELECT doc_id, fidelity, greatest(CASE WHEN ratio < 0.6 THEN 0 WHEN ratio < 0.8 THEN 1 WHEN ratio < 0.95 THEN 2 ELSE 3 END, CASE WHEN fidelity = 'compressed' THEN 1 ELSE 0 END)::BIGINT AS stage FROM r""")
def compression_stage(spark: SparkSession, sf: str) -> DataFrame:
    t = documents(spark, sf).select("doc_id", X.token_count("text").alias("tok")).withColumn("fidelity", F.explode(F.array(*map(F.lit, M.FIDELITIES))))
    return t.select("doc_id", "fidelity", X.stage(F.col("tok"), F.lit(400), F.col("fidelity")).cast("long").alias("stage"))


_PRUNE_SQL = f"""{PARAS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance, idx) AS rk, count(*) OVER (PARTITION BY doc_id) AS n, max(importance) OVER (PARTITION BY doc_id) AS top FROM paras),
cut AS (SELECT doc_id, importance AS cutoff FROM ranked WHERE rk = n // 5 + 1),
cand AS (SELECT r.*, n > 1 AND cutoff < top AND importance <= cutoff AS low FROM ranked r JOIN cut USING (doc_id)),
pruned AS (SELECT *, low AND sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) <= greatest(2 * n // 5, 1) AS gone FROM cand)"""


@query(f"WITH {_PRUNE_SQL} SELECT doc_id, idx::BIGINT AS idx, text FROM pruned WHERE NOT gone")
def prune_paras(spark: SparkSession, sf: str) -> DataFrame:
    return N.prune(plain_nodes(spark, sf)).select("doc_id", F.explode("nodes").alias("n")).select("doc_id", F.col("n.idx").cast("long").alias("idx"), "n.text")


@query(f"WITH {PARAS_SQL} SELECT doc_id, min(idx)::BIGINT AS idx, text FROM paras GROUP BY doc_id, text")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first of equal paragraphs of a document, found in its own array."""
    d = plain_nodes(spark, sf).withColumn("texts", F.transform("nodes", lambda n: n["text"]))
    return d.select("doc_id", F.posexplode("texts").alias("idx", "text"), "texts").filter(F.expr("array_position(texts, text) = idx + 1")).select("doc_id", F.col("idx").cast("long").alias("idx"), "text")


_SIG = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))"


@query(f"""
WITH {PARAS_SQL},
per AS (SELECT doc_id, list([{_SIG}] ORDER BY idx) AS sigs FROM paras GROUP BY doc_id),
kept AS (SELECT doc_id, len(sigs)::BIGINT AS n, list_reduce(sigs, lambda acc, s: CASE WHEN len(list_filter(acc, lambda k: len(list_intersect(k, s[1]))::DOUBLE / len(list_distinct(list_concat(k, s[1]))) >= 0.85)) > 0 THEN acc ELSE list_concat(acc, s) END) AS k FROM per)
SELECT doc_id, n, len(k)::BIGINT AS kept FROM kept""")
def fuzzy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = plain_nodes(spark, sf).filter(F.size("nodes") > 0).withColumn("n", F.size("nodes").cast("long"))
    return N.dedup(d).select("doc_id", "n", F.size("nodes").cast("long").alias("kept"))


@query(f"""
WITH {PARAS_SQL}, s AS (SELECT doc_id, idx, {_SIG} AS sig FROM paras)
SELECT a.doc_id, a.idx::BIGINT AS i, b.idx::BIGINT AS j, round(len(list_intersect(a.sig, b.sig))::DOUBLE / len(list_distinct(list_concat(a.sig, b.sig))), 9) AS jaccard
FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.idx < b.idx WHERE len(list_intersect(a.sig, b.sig))::DOUBLE / len(list_distinct(list_concat(a.sig, b.sig))) >= 0.3""")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs among all paragraphs of each document, compared inside its array."""
    d = plain_nodes(spark, sf).withColumn("s", F.transform("nodes", lambda n: F.array_distinct(X.tokens_of(F.lower(n["text"])))))
    i = d.select("doc_id", "s", F.posexplode("s").alias("i", "a"))
    p = i.select("doc_id", "i", "a", F.posexplode("s").alias("j", "b")).filter("i < j").withColumn("jaccard", N.jaccard(F.col("a"), F.col("b"))).filter("jaccard >= 0.3")
    return p.select("doc_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("jaccard", 9).alias("jaccard"))


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of a region as one list node."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("items"))
    return n.select("n_regionkey", F.array(N.node(F.lit(0), F.lit("list"), ordered=F.col("n_regionkey") % 2 == 0, items=F.col("items"))).alias("nodes"))


@query("SELECT n_regionkey, 'para' AS kind, string_agg(n_name, ', ' ORDER BY n_name) AS text, 0.5::DOUBLE AS importance FROM nation GROUP BY n_regionkey")
def collapse_lists(spark: SparkSession, sf: str) -> DataFrame:
    n = N.collapse_lists(_lists(spark, sf)).select("n_regionkey", F.explode("nodes").alias("n"))
    return n.select("n_regionkey", "n.kind", "n.text", F.col("n.importance").cast("double").alias("importance"))


@query("SELECT n_regionkey, string_agg(CASE WHEN n_regionkey % 2 = 0 THEN rn || '. ' ELSE '- ' END || n_name, chr(10) ORDER BY n_name) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn FROM nation) GROUP BY n_regionkey")
def list_render(spark: SparkSession, sf: str) -> DataFrame:
    return N.render_nodes(_lists(spark, sf)).select("n_regionkey", F.get("lines", F.lit(0)).alias("shown"))


@query(r"""
WITH t AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))::BIGINT AS k, CASE WHEN doc_id % 2 = 0 THEN 'sql' ELSE 'code' END AS lang FROM documents)
SELECT doc_id, CASE WHEN k > 0 THEN '[' || lang || ' ' || k || 'L]' ELSE '' END AS text, CASE WHEN k > 0 THEN round(0.3::FLOAT::DOUBLE, 6) ELSE 0.0 END AS importance FROM t""")
def code_summary(spark: SparkSession, sf: str) -> DataFrame:
    code = N.node(F.lit(0), F.lit("code"), text=F.col("text"), lang=F.when(F.col("doc_id") % 2 == 0, "sql"))
    d = N.summarize_code(documents(spark, sf).select("doc_id", F.array(code).alias("nodes"))).select("doc_id", F.get("nodes", F.lit(0)).alias("n"))
    return d.select("doc_id", "n.text", F.round(F.col("n.importance").cast("double"), 6).alias("importance"))


@query(r"SELECT doc_id, trim(CASE WHEN regexp_extract(text, '(?s)^(.*?[.!?])', 1) <> '' THEN regexp_extract(text, '(?s)^(.*?[.!?])', 1) ELSE text END, ' ' || chr(9) || chr(10) || chr(13)) AS sentence FROM documents")
def first_sentence_simple(spark: SparkSession, sf: str) -> DataFrame:
    """The first mark ends the sentence, whatever stands around it; columns only."""
    return documents(spark, sf).select("doc_id", N.first_sentence_simple("text").alias("sentence"))


@query("SELECT doc_id, ['Dr. ', 'Mr. ', 'e.g. '][(doc_id % 3 + 1)::INT] || 'Smith ' || doc_id || ' paid $' || doc_id || '.50, e.g. to us' || ['.', '!', '?'][(doc_id % 7 % 3 + 1)::INT] AS first_sentence FROM documents")
def first_sentence_abbrev(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel on texts that begin with an abbreviation and a decimal, another in each row."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    k = F.col("doc_id")
    head = F.concat(pick(("Dr. ", "Mr. ", "e.g. "), k % 3), F.lit("Smith "), k.cast("string"), F.lit(" paid $"), k.cast("string"), F.lit(".50, e.g. to us"), pick(".!?", k % 7 % 3), F.lit(" "))
    return D.first_sentences(documents(spark, sf).withColumn("text", F.concat(head, "text"))).select("doc_id", "first_sentence")


@query()
def first_sentence(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel on every document's own text."""
    return D.first_sentences(documents(spark, sf)).select("doc_id", "first_sentence")


def _compressed(spark: SparkSession, sf: str, fidelity: str) -> DataFrame:
    d = plain_nodes(spark, sf).withColumn("current_tokens", X.token_count("text"))
    return D.compress_nodes(d, budget=400, fidelity=fidelity, stopwords=DATA_STOPWORDS)


@query()
def compress_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return _compressed(spark, sf, "semantic").select("doc_id", F.size("nodes").cast("long").alias("before"), F.size("compressed").cast("long").alias("after"), N.total_char_len("compressed").cast("long").alias("bytes"))


@query()
def compress_compressed(spark: SparkSession, sf: str) -> DataFrame:
    return _compressed(spark, sf, "compressed").select("doc_id", F.size("nodes").cast("long").alias("before"), F.size("compressed").cast("long").alias("after"), N.total_char_len("compressed").cast("long").alias("bytes"))


@query(f"WITH {PARAS_SQL} SELECT doc_id, count(*)::BIGINT AS kept FROM paras GROUP BY doc_id")
def compress_lossless(spark: SparkSession, sf: str) -> DataFrame:
    d = plain_nodes(spark, sf).withColumn("current_tokens", X.token_count("text"))
    return D.compress_nodes(d, budget=10, fidelity="lossless").filter(F.size("compressed") > 0).select("doc_id", F.size("compressed").cast("long").alias("kept"))


@query()
def budget_loop(spark: SparkSession, sf: str) -> DataFrame:
    d = D.transpile(spread(paragraphs(spark, sf)), fidelity="semantic", budget=120)
    return d.select("doc_id", "input_tok", "output_tok", (F.col("output_tok") <= 120).alias("fits"))


# --------------------------------------------------------------------------- symbols

_TERMS_SQL = r"""
words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS n FROM words WHERE strlen(term) >= CASE WHEN strlen(term) = length(term) THEN 3 ELSE 2 END GROUP BY doc_id, term),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM tf WHERE n >= 3) WHERE rank <= 50),
roi AS (SELECT *, greatest(1, ceil(length(term) / 4.0))::BIGINT AS tokens FROM top),
paying AS (SELECT * FROM roi WHERE tokens > 1 AND n * (tokens - 1) > tokens + 5),
sym AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS rank, term FROM paying)"""


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return N.term_counts(plain_nodes(spark, sf))


@query(f"WITH {_TERMS_SQL} SELECT doc_id, term, n FROM tf")
def term_freq(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


@query(f"WITH {_TERMS_SQL} SELECT doc_id, term, n, rank::BIGINT AS rank FROM top")
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return N.top_terms(_counts(spark, sf)).select("doc_id", "term", "n", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TERMS_SQL} SELECT doc_id, term, n, tokens FROM paying")
def roi_gate(spark: SparkSession, sf: str) -> DataFrame:
    return N.paying(N.top_terms(_counts(spark, sf))).select("doc_id", "term", "n", F.col("tokens").cast("long").alias("tokens"))


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return N.symbols(N.paying(N.top_terms(_counts(spark, sf))))


@query(f"WITH {_TERMS_SQL} SELECT doc_id, '<D>' || chr(10) || string_agg(chr((57343 + rank)::INT) || '=' || term, chr(10) ORDER BY rank) || chr(10) || '</D>' || chr(10) AS dict FROM sym GROUP BY doc_id")
def symbol_dict(spark: SparkSession, sf: str) -> DataFrame:
    return N.dict_block(_symbols(spark, sf))


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    d = _symbols(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sym", "term"))).alias("terms"))
    return D.encode_texts(documents(spark, sf).join(d, "doc_id", "left"), "text", "terms")


@query()
def encode_body(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("doc_id", F.size(F.coalesce("terms", F.array())).cast("long").alias("terms"), F.length("encoded").cast("long").alias("chars"), X.token_count("encoded").cast("long").alias("tokens"))


@query("SELECT doc_id, true AS same FROM documents")
def roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return D.decode_texts(_encoded(spark, sf), "encoded", "terms").select("doc_id", (F.col("decoded") == F.col("text")).alias("same"))


# --------------------------------------------------------------------------- rendering


def _table(df: DataFrame, key: str, sort: str, cells: list[str]) -> DataFrame:
    row = F.struct(F.col(sort).alias("_o"), *(F.col(c).cast("string").alias(c) for c in cells))
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return g.select(key, N.linearize_table(F.array(*map(F.lit, cells)), F.transform("r", lambda x: F.array(*(x[c] for c in cells)))).alias("shown"))


@query("SELECT n_regionkey, string_agg('[' || rn || '] n_nationkey:' || n_nationkey || ', n_name:' || n_name, chr(10) ORDER BY rn) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) WHERE rn <= 5 GROUP BY n_regionkey")
def table_keyval(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return _table(table(spark, sf, "nation").withColumn("rn", F.row_number().over(w)).filter("rn <= 5"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"])


@query("SELECT p_brand, 'p_partkey|p_name' || chr(10) || string_agg(p_partkey || '|' || trim(p_name), chr(10) ORDER BY p_partkey) AS shown FROM part GROUP BY p_brand HAVING count(*) > 5")
def table_pipe(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    many = p.groupBy("p_brand").count().filter("count > 5").select("p_brand")
    return _table(p.join(many, "p_brand", "left_semi"), "p_brand", "p_partkey", ["p_partkey", "p_name"])


@query("SELECT r_regionkey, repeat('#', (r_regionkey % 6 + 1)::INT) || ' ' || r_name AS shown FROM region")
def header_render(spark: SparkSession, sf: str) -> DataFrame:
    h = N.node(F.lit(0), F.lit("header"), level=F.col("r_regionkey") % 6 + 1, text=F.concat(F.lit(" "), "r_name", F.lit("\t")))
    return N.render_nodes(table(spark, sf, "region").select("r_regionkey", F.array(h).alias("nodes"))).select("r_regionkey", F.get("lines", F.lit(0)).alias("shown"))


@query(f"WITH {PARAS_SQL} SELECT doc_id, idx::BIGINT AS idx, {SQUEEZE_SQL.format('text')} AS shown FROM paras")
def para_render(spark: SparkSession, sf: str) -> DataFrame:
    return N.render_nodes(plain_nodes(spark, sf)).select("doc_id", F.posexplode("lines").alias("idx", "shown")).withColumn("idx", F.col("idx").cast("long"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'select 1' || chr(10) || '' || chr(10) || 'from t' WHEN o_orderkey % 3 = 1 THEN '#!/bin/sh' || chr(10) || 'run ' || o_orderkey ELSE '# kept' || chr(10) || '' || chr(10) || 'x' END AS body FROM orders")
def code_comment_strip(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.when(k % 3 == 0, "select 1\n-- note\n\n\n\nfrom t").when(k % 3 == 1, F.concat(F.lit("#!/bin/sh\n  # note\nrun "), k.cast("string"))).otherwise("# kept\n\n \nx\n")
    lang = F.when(k % 3 == 0, "sql").when(k % 3 == 1, "sh")
    return table(spark, sf, "orders").select("o_orderkey", N.strip_comments(body, lang).alias("body"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'is here' WHEN c_custkey % 4 = 2 THEN c_name || 's differ' ELSE 'On ' || c_name END AS para FROM customer")
def header_dup_strip(spark: SparkSession, sf: str) -> DataFrame:
    k, h = F.col("c_custkey") % 4, F.col("c_name")
    para = F.when(k == 0, h).when(k == 1, F.concat(h, F.lit("  is here"))).when(k == 2, F.concat(h, F.lit("s differ"))).otherwise(F.concat(F.lit("On "), h))
    nodes = F.array(N.node(F.lit(0), F.lit("header"), level=F.lit(2), text=h), N.node(F.lit(1), F.lit("para"), text=para, importance=F.lit(1.0)))
    return N.render_nodes(table(spark, sf, "customer").select("c_custkey", nodes.alias("nodes")), fidelity="semantic").select("c_custkey", F.get("lines", F.lit(1)).alias("para"))


@query("SELECT s_suppkey, 't: ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || 'k: [a, b ' || s_suppkey || ']' ELSE chr(10) || 's: short' END AS yaml FROM supplier")
def yaml_header(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", N.yaml_header(F.col("s_name"), F.when(k % 2 == 0, "").otherwise("short"), F.when(k % 2 == 0, F.concat(F.lit("a , b "), k.cast("string")))).alias("yaml"))


@query(f"WITH {PARAS_SQL} SELECT doc_id, '<B>' || chr(10) || string_agg({SQUEEZE_SQL.format('text')}, chr(10) ORDER BY idx) || chr(10) || '</B>' AS content FROM paras GROUP BY doc_id")
def bridge_document(spark: SparkSession, sf: str) -> DataFrame:
    """Plain text, lossless, in columns only."""
    return N.render_nodes(plain_nodes(spark, sf).filter(F.size("nodes") > 0)).select("doc_id", N.bridge("lines").alias("content"))


@query(f"WITH {PARAS_SQL} SELECT doc_id, '<B>' || chr(10) || string_agg({SQUEEZE_SQL.format('text')}, chr(10) ORDER BY idx) || chr(10) || '</B>' AS content FROM paras GROUP BY doc_id")
def transpile_lossless(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel's whole pipeline against the same SQL as the columns'."""
    return D.transpile(spread(paragraphs(spark, sf)), fidelity="lossless", budget=None).filter(F.trim("text") != "").select("doc_id", "content")


def _sizes(d: DataFrame, key: str) -> DataFrame:
    return d.select(key, "input_tok", "output_tok", F.round(X.reduction_pct(F.col("input_tok"), F.col("output_tok")), 6).alias("reduction_pct"))


@query()
def transpile_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(D.transpile(spread(documents(spark, sf)), fidelity="semantic", budget=4096), "doc_id")


@query()
def transpile_compressed(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(D.transpile(spread(paragraphs(spark, sf)), fidelity="compressed", budget=2048), "doc_id")


@query()
def transpile_html(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(D.transpile(spread(table(spark, sf, "pages").select("page_id", "html")), "html", "html", "semantic", 4096), "page_id")


@query()
def transpile_markdown(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("## "), "role", F.lit("\n\n"), "text", F.lit("\n\n- one\n- two\n")).alias("text"))
    return _sizes(D.transpile(spread(c), kind="markdown", fidelity="semantic", budget=256), "id")


@query(f"""
WITH {PARAS_SQL},
shown AS (SELECT doc_id, idx, {SQUEEZE_SQL.format('text')} AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM paras),
run AS (SELECT *, 1 + sum(greatest(1, ceil(length(s) / 4.0))) OVER (PARTITION BY doc_id ORDER BY idx) AS spent FROM shown),
cuts AS (SELECT *, spent >= 200 AS cut, coalesce(lag(spent) OVER (PARTITION BY doc_id ORDER BY idx) >= 200, false) AS after FROM run),
body AS (SELECT doc_id, idx + 1 AS sequence, CASE WHEN cut OR idx = n - 1 THEN s || chr(10) || '</B>' ELSE s END AS content, cut OR idx = n - 1 AS is_final FROM cuts WHERE NOT after),
al AS (SELECT * FROM body UNION ALL SELECT DISTINCT doc_id, 0, '<B>', false FROM paras)
SELECT doc_id, sequence::BIGINT AS sequence, content, greatest(1, ceil(length(content) / 4.0))::BIGINT AS token_count, is_final FROM al""")
def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lossless chunks in columns and windows: a chunk stays if the tokens before it are below the budget."""
    r = N.render_nodes(plain_nodes(spark, sf)).filter(F.size("lines") > 0).select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("idx", "s"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    r = r.withColumn("spent", F.lit(1) + F.sum(X.token_count("s")).over(w)).withColumn("before", F.lag("spent").over(w)).filter("before is null or before < 200")
    final = (F.col("spent") >= 200) | (F.col("idx") == F.col("n") - 1)
    body = r.select("doc_id", (F.col("idx") + 1).alias("sequence"), F.when(final, F.concat("s", F.lit("\n</B>"))).otherwise(F.col("s")).alias("content"), final.alias("is_final"), "idx")
    both = F.array(F.struct(F.col("sequence"), F.col("content"), F.col("is_final")), F.struct(F.lit(0).alias("sequence"), F.lit("<B>").alias("content"), F.lit(False).alias("is_final")))
    c = body.select("doc_id", F.explode(F.when(F.col("idx") == 0, both).otherwise(F.slice(both, 1, 1))).alias("c")).select("doc_id", "c.*")
    return c.select("doc_id", F.col("sequence").cast("long").alias("sequence"), "content", X.token_count("content").cast("long").alias("token_count"), "is_final")


SQL["stream_chunks_kernel"] = SQL["stream_chunks"]


@query()
def stream_chunks_kernel(spark: SparkSession, sf: str) -> DataFrame:
    c = D.stream_chunks(spread(paragraphs(spark, sf)).filter(F.trim("text") != "").select("doc_id", "text"), fidelity="lossless", budget=200)
    return c.select("doc_id", F.col("sequence").cast("long").alias("sequence"), "content", F.col("token_count").cast("long").alias("token_count"), "is_final")


@query()
def stream_chunks_semantic(spark: SparkSession, sf: str) -> DataFrame:
    c = D.stream_chunks(spread(paragraphs(spark, sf)).select("doc_id", "text"), fidelity="semantic", budget=300, strict_final=True)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count_if("is_final").alias("finals"))


@query(f"""
WITH {_PRUNE_SQL},
body AS (SELECT doc_id, string_agg({SQUEEZE_SQL.format('text')}, chr(10) ORDER BY idx) AS b FROM pruned WHERE NOT gone GROUP BY doc_id),
o AS (SELECT doc_id, {TOKENS_SQL.format("'<B>' || chr(10) || b || chr(10) || '</B>'")} AS output_tok FROM body),
i AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS input_tok FROM documents)
SELECT doc_id, input_tok, output_tok, round(100.0::DOUBLE - output_tok::DOUBLE / input_tok * 100.0::DOUBLE, 6) AS reduction_pct FROM i JOIN o USING (doc_id)""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to pruned, rendered text and what it saved: one map stage of column expressions, no shuffle, no Python."""
    d = N.parse_plaintext(spread(documents(spark, sf)).withColumn("raw", F.col("text")).withColumn("text", F.replace(X.strip_pua("text"), F.lit("\n"), F.lit("\n\n"))))
    d = N.render_nodes(N.prune(d).filter(F.size("nodes") > 0))
    return d.select("doc_id", X.token_count("raw").cast("long").alias("input_tok"), X.token_count(N.bridge("lines")).cast("long").alias("output_tok")).withColumn("reduction_pct", F.round(X.reduction_pct(F.col("input_tok"), F.col("output_tok")), 6))
