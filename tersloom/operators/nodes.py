"""Parsing, compression and rendering as column operators on nested node arrays: no shuffle, no Python.

Each function takes a DataFrame and adds or replaces a column; stages are separate columns, so Catalyst evaluates a shared step once.
Nodes are ``tersloom.model.NODE``; the order of a document is the order of its array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersloom import model as M
from tersloom.functions import text as X
from tersloom.functions.text import let


def node(idx: Column, kind: Column, *, level=None, text=None, importance=None, headers=None, rows=None, lang=None, ordered=None, items=None, key=None) -> Column:
    given = {"idx": idx, "kind": kind, "level": level, "text": text, "importance": importance, "headers": headers, "rows": rows, "lang": lang, "ordered": ordered, "items": items, "key": key}
    return F.struct(*((F.lit(None) if given[f.name] is None else given[f.name]).cast(f.dataType).alias(f.name) for f in M.NODE.fields))


def with_fields(n: Column, **new: Column) -> Column:
    return F.struct(*((new[f.name] if f.name in new else n[f.name]).cast(f.dataType).alias(f.name) for f in M.NODE.fields))


def importance(place: Column, chars: Column, after_header: Column) -> Column:
    """In 32-bit floats and in this order of operations: equal sums in real numbers may differ as floats."""
    f = lambda x: F.lit(x).cast("float")
    pos = F.when(place == 0, f(1.0)).when(place == 1, f(0.95)).when(place == 2, f(0.9)).when(place <= 5, f(0.8)).when(place <= 10, f(0.65)).otherwise(f(0.5))
    size = F.when(chars <= 15, f(0.3)).when(chars <= 40, f(0.55)).when(chars <= 80, f(0.75)).when(chars <= 200, f(0.9)).otherwise(f(1.0))
    head = F.when(after_header, f(1.0)).otherwise(f(0.0))
    return F.greatest(f(0.1), F.least(f(1.0), (pos * f(0.5) + size * f(0.4)) + head * f(0.1)))


# --------------------------------------------------------------------------- parsing


def parse_plaintext(df: DataFrame, text: str = "text", out: str = "nodes") -> DataFrame:
    """Blocks at blank lines; ``# `` and ``## `` blocks are headers, others paragraphs with their line ends as blanks.
    A paragraph's number among paragraphs is its place less the headers before it, so no running state is needed."""
    blocks = F.filter(F.transform(F.split(F.col(text), "\n\n"), X.trim), lambda b: b != "")
    level_of = lambda b: F.when(b.startswith("# "), 1).when(b.startswith("## "), 2).otherwise(0)

    def with_heads(bs: Column, heads: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            level = level_of(b)
            place = i - F.size(F.filter(heads, lambda h: h < i))
            body = F.replace(b, F.lit("\n"), F.lit(" "))
            fresh = (i == 0) | (level_of(F.get(bs, i - 1)) > 0)
            head = node(i, F.lit("header"), level=level, text=X.trim(F.when(level == 1, F.substr(b, F.lit(3))).otherwise(F.substr(b, F.lit(4)))))
            return F.when(level > 0, head).otherwise(node(i, F.lit("para"), text=body, importance=importance(place, F.length(body), fresh)))

        return F.transform(bs, one)

    heads_of = lambda bs: F.filter(F.transform(bs, lambda b, i: F.when(level_of(b) > 0, i).otherwise(-1)), lambda i: i >= 0)
    return df.withColumn(out, let(blocks, lambda bs: let(heads_of(bs), lambda heads: with_heads(bs, heads))))


_BLOCK_TAG = r"(?i)<\s*/?(?:" + "|".join(M.BLOCK_ELEMENTS) + r")(?=[\s/>])[^>]*>"


def html_text(c: Column | str) -> Column:
    """Comments, scripts and styles go with their content, block tags become a space, other tags vanish; entities are decoded and ``& < >`` escaped again.

    Named entities beyond the common ones stay as they are here; the kernel knows all.
    """
    c = F.regexp_replace(X.col(c), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    c = F.regexp_replace(c, _BLOCK_TAG, " ")
    c = F.regexp_replace(c, r"(?s)<[/!?a-zA-Z][^>]*>", "")
    # The named entities that are decoded here.
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&nbsp;", "\xa0"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\xa0", "&nbsp;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def html_title(c: Column | str) -> Column:
    return F.nullif(X.trim(F.regexp_extract(X.col(c), r"(?is)<title>(.*?)</title>", 1)), F.lit(""))


def html_description(c: Column | str) -> Column:
    tags = F.filter(F.regexp_extract_all(X.col(c), F.lit("(?i)<meta[^>]*>"), 0), lambda t: t.rlike("(?i)name=(?:\"description\"|'description')"))
    values = F.filter(F.transform(tags, lambda t: X.trim(X.attribute(t, "content"))), lambda v: v != "")
    return F.get(values, F.lit(0))


_FRONT = r"(?s)\A---\r?\n(.*?)\n(?:---|\.\.\.)[^\n]*(?:\n|\z)(.*)\z"


def front_matter(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``meta`` (array of key and value, in order) and ``body``."""
    c = F.col(text)
    has = c.rlike(_FRONT)
    d = df.withColumn("_lines", F.transform(F.split(F.regexp_extract(c, _FRONT, 1), "\n"), X.trim)).withColumn("body", F.when(has, F.regexp_extract(c, _FRONT, 2)).otherwise(c))

    def pair(line: Column) -> Column:
        key = F.lower(X.trim(F.regexp_extract(line, r"^([^:]*):", 1)))
        value = F.regexp_replace(F.regexp_replace(X.trim(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)), r'^"+|"+$', ""), "^'+|'+$", "")
        name = F.when(key == "title", "title").when(key.isin("summary", "description"), "summary").when(key.isin("keywords", "tags"), "keywords")
        return F.struct(name.alias("key"), value.alias("value"))

    lines = F.filter("_lines", lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))
    pairs = F.filter(F.transform(lines, pair), lambda p: p["key"].isNotNull() & (p["value"] != ""))
    return d.withColumn("meta", F.when(has, pairs).otherwise(F.filter(pairs, lambda p: F.lit(False)))).drop("_lines")


def get_metadata(nodes: Column | str, key: str) -> Column:
    return F.get(F.filter(X.col(nodes), lambda n: (n["kind"] == "metadata") & (n["key"] == key)), F.lit(0))["text"]


def char_len(n: Column) -> Column:
    """Bytes of a node's text, whatever its kind."""
    size = lambda a: F.coalesce(F.aggregate(a, F.lit(0), lambda s, x: s + F.octet_length(x)), F.lit(0))
    cells = F.coalesce(F.aggregate(n["rows"], F.lit(0), lambda s, r: s + size(r)), F.lit(0))
    return F.coalesce(F.octet_length(n["text"]), F.lit(0)) + size(n["items"]) + size(n["headers"]) + cells


def total_char_len(nodes: Column | str) -> Column:
    return F.aggregate(X.col(nodes), F.lit(0), lambda s, n: s + char_len(n))


# --------------------------------------------------------------------------- compression


def strip_stopwords(df: DataFrame, nodes: str = "nodes", words=M.STOPWORDS) -> DataFrame:
    return df.withColumn(nodes, F.transform(nodes, lambda n: F.when(n["kind"].isin("para", "header"), with_fields(n, text=X.strip_stopwords(n["text"], words))).otherwise(n)))


def prune(df: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Drops the least important fifth of paragraphs, in document order, two fifths at most."""
    is_para = lambda n: n["kind"] == "para"
    values = lambda ns: F.array_sort(F.transform(F.filter(ns, is_para), lambda n: n["importance"]))

    def low(ns: Column, imp: Column) -> Column:
        """Places of the paragraphs to drop."""
        n = F.size(imp)
        most = F.greatest(F.floor(2 * n / 5), F.lit(1)).cast("int")

        def cut_at(cut: Column) -> Column:
            at = F.filter(F.transform(ns, lambda x, i: F.when(is_para(x) & (x["importance"] <= cut), i)), lambda i: i.isNotNull())
            return F.when((n > 1) & (cut < F.get(imp, n - 1)), F.slice(at, F.lit(1), most)).otherwise(F.array().cast("array<int>"))

        return let(F.get(imp, F.least(F.floor(n / 5), n - 1).cast("int")), cut_at)

    kept = lambda ns, gone: F.filter(ns, lambda x, i: ~F.array_contains(gone, i))
    return df.withColumn(nodes, let(F.col(nodes), lambda ns: let(let(values(ns), lambda imp: low(ns, imp)), lambda gone: kept(ns, gone))))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def dedup(df: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Greedy, in document order: a paragraph goes if its set of lower-cased tokens is near one that was kept. Sizes are compared before sets."""
    sets = lambda ns: F.transform(ns, lambda n: F.when(n["kind"] == "para", F.array_distinct(X.tokens_of(F.lower(n["text"])))))

    def step(acc: Column, s: Column) -> Column:
        near = F.exists(acc["kept"], lambda k: (F.lit(M.NEAR_DUPLICATE) * F.greatest(F.size(k), F.size(s)) <= F.least(F.size(k), F.size(s)) + F.lit(1e-9)) & (jaccard(k, s) >= M.NEAR_DUPLICATE))
        counts = s.isNotNull() & (F.size(s) > 0)
        gone = F.coalesce(counts & near, F.lit(False))
        return F.struct(F.when(counts & ~gone, F.array_append(acc["kept"], s)).otherwise(acc["kept"]).alias("kept"), F.array_append(acc["gone"], gone).alias("gone"))

    start = F.struct(F.array().cast("array<array<string>>").alias("kept"), F.array().cast("array<boolean>").alias("gone"))
    kept = lambda ns, gone: F.filter(ns, lambda n, i: ~F.get(gone, i))
    return df.withColumn(nodes, let(F.col(nodes), lambda ns: let(F.aggregate(sets(ns), start, step)["gone"], lambda gone: kept(ns, gone))))


def collapse_lists(df: DataFrame, nodes: str = "nodes") -> DataFrame:
    return df.withColumn(nodes, F.transform(nodes, lambda n: F.when((n["kind"] == "list") & (F.size(n["items"]) > 0), node(n["idx"], F.lit("para"), text=F.array_join(n["items"], ", "), importance=F.lit(0.5))).otherwise(n)))


def non_blank_lines(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda x: X.trim(x) != ""))


def summarize_code(df: DataFrame, nodes: str = "nodes") -> DataFrame:
    def one(n: Column) -> Column:
        k = non_blank_lines(n["text"])
        note = F.concat(F.lit("["), F.coalesce(n["lang"], F.lit("code")), F.lit(" "), k.cast("string"), F.lit("L]"))
        return F.when(n["kind"] == "code", node(n["idx"], F.lit("para"), text=F.when(k > 0, note).otherwise(""), importance=F.when(k > 0, 0.3).otherwise(0.0))).otherwise(n)

    return df.withColumn(nodes, F.transform(nodes, one))


def first_sentence_simple(c: Column | str) -> Column:
    """Up to the first sentence end, for texts without abbreviations and decimals."""
    c = X.col(c)
    got = F.regexp_extract(c, rf"(?s)^(.*?[.{M.SENTENCE_ENDS}])", 1)
    return X.trim(F.when(got != "", got).otherwise(c))


# --------------------------------------------------------------------------- rendering


def linearize_table(headers: Column, rows: Column) -> Column:
    cut = lambda r: F.least(F.size(headers), F.size(r))
    pairs = lambda r: F.zip_with(F.slice(headers, F.lit(1), cut(r)), F.slice(r, F.lit(1), cut(r)), lambda h, v: F.concat(X.trim(h), F.lit(":"), X.trim(v)))
    few = F.transform(rows, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.array_join(pairs(r), ", ")))
    bars = lambda r: F.array_join(F.transform(r, X.trim), "|")
    many = F.concat(F.array(bars(headers)), F.transform(rows, bars))
    return F.when(F.size(rows) == 0, "").when(F.size(rows) <= 5, F.array_join(few, "\n")).otherwise(F.array_join(many, "\n"))


def strip_comments(body: Column, lang: Column) -> Column:
    """Comment lines of known languages go; of a run of blank lines the first stays."""
    lines = F.transform(F.split(F.regexp_replace(body, r"\r?\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    comment = lambda x: (lang.isin(M.SLASH_LANGS) & X.trim(x).startswith("//")) | (lang.isin(M.HASH_LANGS) & X.trim(x).startswith("#") & ~X.trim(x).startswith("#!")) | (lang.isin(list(M.DASH_LANGS)) & X.trim(x).startswith("--"))
    left = F.filter(lines, lambda x: ~F.coalesce(comment(x), F.lit(False)))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("blank"))

    def step(acc: Column, x: Column) -> Column:
        blank = X.trim(x) == ""
        return F.struct(F.when(blank & acc["blank"], acc["out"]).otherwise(F.array_append(acc["out"], x)).alias("out"), blank.alias("blank"))

    return F.array_join(F.aggregate(left, start, step)["out"], "\n")


def without_header(para: Column, header: Column) -> Column:
    """A paragraph without the header it repeats at its start."""
    h, p = X.trim(header), X.trim(para)
    rest = F.substr(p, F.length(h) + 1)
    repeats = (h != "") & p.startswith(h) & ((rest == "") | rest.rlike(f"^[{X.WS}]"))
    return F.when(F.coalesce(repeats, F.lit(False)), X.trim(rest)).otherwise(p)


def render_nodes(df: DataFrame, nodes: str = "nodes", fidelity: str = "lossless", out: str = "lines") -> DataFrame:
    """``lines``: each node's rendered text without symbols, empty for metadata."""
    shrink = fidelity != "lossless"

    def one(ns: Column, n: Column, i: Column) -> Column:
        para = X.squeeze(n["text"])
        if shrink:
            before = F.when(i > 0, F.get(ns, i - 1))
            para = F.when(F.coalesce(before["kind"] == "header", F.lit(False)), without_header(para, before["text"])).otherwise(para)
        body = strip_comments(n["text"], n["lang"]) if shrink else n["text"]
        code = F.concat(F.lit("```"), F.coalesce(n["lang"], F.lit("")), F.lit("\n"), X.trim(body), F.lit("\n```"))
        items = F.transform(n["items"], lambda x, k: F.concat(F.when(n["ordered"], F.concat((k + 1).cast("string"), F.lit(". "))).otherwise("- "), X.trim(x)))
        return (
            F.when(n["kind"] == "header", F.concat(F.repeat(F.lit("#"), n["level"]), F.lit(" "), X.trim(n["text"])))
            .when(n["kind"] == "para", para)
            .when(n["kind"] == "table", linearize_table(n["headers"], n["rows"]))
            .when(n["kind"] == "code", code)
            .when(n["kind"] == "list", F.array_join(items, "\n"))
            .otherwise("")
        )

    def shown(ns: Column) -> Column:
        return F.transform(ns, lambda n, i: one(ns, n, i))

    return df.withColumn(out, let(F.col(nodes), shown))


def yaml_header(title: Column, summary: Column, keywords: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    list_ = F.array_join(F.transform(F.split(some(keywords), ","), X.trim), ", ")
    return F.concat_ws("\n", F.concat(F.lit("t: "), some(title)), F.concat(F.lit("s: "), some(summary)), F.concat(F.lit("k: ["), list_, F.lit("]")))


def bridge(lines: Column | str, header: Column | None = None, symbols: Column | None = None) -> Column:
    body = X.trim(F.array_join(F.filter(X.col(lines), lambda x: x != ""), "\n"))
    head = F.lit("") if header is None else F.when(X.trim(header) != "", F.concat(F.lit("<H>\n"), X.trim(header), F.lit("\n</H>\n"))).otherwise("")
    return F.concat(F.coalesce(symbols, F.lit("")) if symbols is not None else F.lit(""), head, F.lit("<B>\n"), body, F.lit("\n</B>"))


# --------------------------------------------------------------------------- symbols


def term_counts(df: DataFrame, key: str = "doc_id", nodes: str = "nodes") -> DataFrame:
    """(key, term, n): white-space tokens of paragraphs, headers and list items of at least 3 bytes, or 2 if not ASCII.

    Tokens of one document are counted where the document is; only (document, term) sums are shuffled."""
    texts = F.flatten(F.transform(nodes, lambda n: F.when(n["kind"].isin("para", "header"), F.array(n["text"])).when(n["kind"] == "list", n["items"]).otherwise(F.array().cast("array<string>"))))
    terms = df.select(key, F.explode(F.flatten(F.transform(texts, X.tokens_of))).alias("term"))
    long_enough = F.octet_length("term") >= F.when(F.octet_length("term") == F.length("term"), 3).otherwise(2)
    return terms.filter(long_enough).groupBy(key, "term").agg(F.count("*").alias("n"))


def top_terms(counts: DataFrame, key: str = "doc_id", least: int = M.MIN_FREQ, most: int = M.MAX_TERMS) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    return counts.filter(F.col("n") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def paying(terms: DataFrame, cost: int = M.PUA_TOKEN_COST) -> DataFrame:
    t = X.token_count("term")
    return terms.withColumn("tokens", t).filter((F.col("tokens") > cost) & (F.col("n") * (F.col("tokens") - cost) > cost + F.col("tokens") + 4))


def symbols(accepted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rank, sym, term): private-use characters in order of acceptance."""
    w = Window.partitionBy(key).orderBy("rank")
    return accepted.withColumn("rank", F.row_number().over(w)).select(key, "rank", X.symbol(F.col("rank")).alias("sym"), "term")


def dict_block(symbols_: DataFrame, key: str = "doc_id") -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("rank", "sym", "term")))
    body = F.array_join(F.transform(lines, lambda x: F.concat(x["sym"], F.lit("="), x["term"])), "\n")
    return symbols_.groupBy(key).agg(F.concat(F.lit("<D>\n"), body, F.lit("\n</D>\n")).alias("dict"))
