"""The document engine: fixtures with exact results, columns against the kernel, SQL against DuckDB, scans, sinks and streams."""

import datetime
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tersloom import kernel as K
from tersloom import model as M
from tersloom import sql
from tersloom.functions import scores as S
from tersloom.functions import text as X
from tersloom.operators import documents as D
from tersloom.operators import nodes as N
from tersloom.plans import catalogue
from tersloom.sources import scans, sinks
from tersloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def paras(*values):
    return [K.Node("para", f"text number {i}", importance=v) for i, v in enumerate(values)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Smith confirmed the results. More follows.", "Dr. Smith confirmed the results."),
        ("U.S. patent no. 1234. Filed in 2024.", "U.S. patent no. 1234."),
        ("e.g. machine learning. Next.", "e.g. machine learning."),
        ("i.e. the model output. Next.", "i.e. the model output."),
        ("See Fig. 3 for details. Next.", "See Fig. 3 for details."),
        ("This costs $3.50 per unit. Next.", "This costs $3.50 per unit."),
        ("Tell us. We will respond.", "Tell us."),
        ("最初の文。次の文。", "最初の文。"),
        ("पहला वाक्य। दूसरा।", "पहला वाक्य।"),
        ("no end here ", "no end here"),
    ],
)
def test_first_sentence(text, want):
    assert K.first_sentence(text) == want


def test_tokens_and_stages(spark):
    assert (K.token_count(""), K.token_count("\ue000" * 4), K.token_count("こんにちは"), K.token_count("hello"), K.token_count("ا" * 33)) == (1, 4, 3, 2, 12)
    assert [K.stage_of(n, 100, "semantic") for n in (50, 70, 85, 96)] == [0, 1, 2, 3] and K.stage_of(5, 100, "compressed") == 1 and K.stage_of(1, 0, "semantic") == 3
    texts = ["", "hello world", "ا" * 33, "こんにちは mixed text", "a" * 7, "한국어 😀 هذا नमस्ते"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.token_count("t")).collect()]
    assert got == [K.token_count(t) for t in texts]


def test_compressor():
    assert len(K.prune(paras(0.9, 0.5, 0.1, 0.05, 0.02))) == 3
    assert len(K.prune(paras(0.5))) == 1 and len(K.prune(paras(0.5, 0.5, 0.5))) == 3
    assert len(K.prune(paras(*[0.5] * 8, 0.6, 0.6))) >= 6
    near = [K.Node("para", t, importance=0.5) for t in ("one two three four five six seven", "one two three four five six seven", "other words here")]
    assert len(K.dedup(near)) == 2
    s = K.Stopwords()
    assert s.strip("the throughput goes through it") == "the throughput goes it" and s.strip("그리고 나서 그리고나서") == "나서 그리고나서" and s.strip("éabout x") == "éx"
    nodes = [K.Node("para", "First one. Second.", importance=0.9), K.Node("list", items=["a", "b", "c"], ordered=False), K.Node("code", "x = 1\n\ny = 2", lang="python")]
    got = K.compress(nodes, 100, 98, "compressed")
    assert {"a, b, c", "[python 2L]"} & {n.text for n in got} and all(n.kind == "para" for n in got)
    assert K.compress(nodes, 100, 98, "lossless") is nodes


def test_rendering_and_symbols():
    assert K.linearize_table(["id", "val"], [["1", "a"], ["2"]]) == "[1] id:1, val:a\n[2] id:2"
    assert K.linearize_table(["id", "val"], [[str(i), f"v{i}"] for i in range(6)]).split("\n")[:2] == ["id|val", "0|v0"]
    head = [K.Node("header", "API Endpoints", 2), K.Node("para", "API Endpoints are here", importance=1.0)]
    assert "## API Endpoints\nare here" in K.render(head, "semantic", {}) and "API Endpoints are here" in K.render(head, "lossless", {})
    assert K.strip_comments("// a\nlet x;\n\n\n\ny", "rust") == "let x;\n\ny" and K.strip_comments("#!/x\n# y\nz", "sh") == "#!/x\nz" and K.strip_comments("# y", None) == "# y"
    d = K.SymbolDict()
    d.intern("ab"), d.intern("abc"), d.intern("ab")
    assert len(d) == 2 and d.encode("abcab") == "\ue001\ue000" and d.decode(d.encode("abcab x")) == "abcab x"
    full = K.SymbolDict({str(i): chr(M.PUA_FIRST + i) for i in range(M.PUA_LAST - M.PUA_FIRST + 1)})
    with pytest.raises(K.SymbolOverflow):
        full.intern("one more")
    assert "<D>" in K.transpile(" ".join(["x" * 40] * 8)) and "<D>" not in K.transpile("API endpoint " * 5)
    assert K.yaml_header([K.Node("metadata", "[a, b]", key="keywords")]) == "k: [[a, b]]"
    with pytest.raises(K.InputTooLarge):
        K.transpile("a" * (M.MAX_INPUT_BYTES + 1))


def test_html_and_front_matter():
    out = K.transpile("<p>hello &#xE000; world</p>hello<br/>world<title>T</title><meta name='description' content='D'>", "html", "semantic")
    assert "\ue000" not in out and "helloworld" not in out and out.startswith("<H>\nt: T\ns: D\n</H>")
    assert K.front_matter("---\ntitle: 'x'\n...\nbody")[1] == "body" and K.front_matter("---\n---\nbody") == ([], "---\n---\nbody") and K.front_matter("---\ntitle: x")[0] == []


def test_html_nodes_entities_without_semicolon(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    heads = ["a&amp;&amp", "b&copy", "c &quot;d&quot;", "e&copy2024", "f&ampg;", "h&amp;amp;amp"]
    rows = [(i, f"<html><title>{h}</title><body><h1>{h}</h1><p>x &middot; y</p></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("html_nodes", "html_text"):
        assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    assert K.html_text("a&amp</h1>") == "a&amp; " and K.html_text("a&amp</h1>", closed=True) == "a&amp;amp " and K.html_text("&#233;&#xE9;&eacute;&nosuch;", closed=True) == "ééé&amp;nosuch;"


MD = """# Head *x*

Para **bold** `code` [link](http://a "t") ![alt](i.png)
wrapped ~~gone~~ &amp; <b>raw</b>.

- foo
  bar
- baz
  - inner
- after

| a | b |
|---|:-:|
| 1 | 2 |

```rust,ignore
let x = 1;
```

Setext
------
> quote

<!-- no -->

    indented
"""


def test_markdown():
    got = [(n.kind, n.text if n.kind not in ("list", "table") else n.items or [n.headers, *n.rows]) for n in K.parse(MD, "markdown")]
    assert got == [("header", "Head x"), ("para", "Para bold code link alt wrapped gone & raw."), ("list", ["inner"]), ("table", [["a", "b"], ["1", "2"]]), ("code", "let x = 1;"), ("header", "Setext"), ("para", "quote"), ("code", "indented")]
    flat = K.parse("- foo\n  bar\n- baz\n", "markdown")
    assert flat[0].items == ["foobar", "baz"]


words = st.lists(st.sampled_from("alpha beta gamma delta about through Dr. 3.5 # ## é 漢字 x".split()), min_size=0, max_size=12).map(" ".join)
texts = st.lists(words, max_size=8).map("\n\n".join)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 200))
def test_properties(text, budget):
    nodes = K.parse(text, "plaintext")
    out = K.transpile(text, "plaintext", "lossless")
    assert all(w in out for w in text.split() if w not in ("#", "##"))
    assert len(K.compress(nodes, budget, budget, "semantic")) <= len(nodes)
    stages = [K.stage_of(n, budget, "semantic") for n in range(0, 2 * budget, max(1, budget // 10))]
    assert stages == sorted(stages)
    terms = K.intern(nodes)
    assert K.SymbolDict(terms).decode(K.encode(text, terms)) == text
    chunks = K.stream(text, "plaintext", "semantic", budget, strict_final=True)
    assert [c["sequence"] for c in chunks] == list(range(len(chunks))) and chunks[-1]["is_final"]


def test_columns_are_the_kernel(spark):
    texts = ["# Title\n\nTitle goes on\n\n\n\n para two \nwrapped\n\n## Sub\n\nlast", "", "one\n\none\n\ntwo words here", *[r[0].replace("\n", "\n\n") for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]]
    df = N.parse_plaintext(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i")
    for t, r in zip(texts, df.collect(), strict=True):
        assert [(n["kind"], n["text"], n["level"], n["importance"]) for n in r["nodes"]] == [(n.kind, n.text, n.level, n.importance) for n in K.parse(t, "plaintext")]
    for fn, kernel in ((N.prune, K.prune), (N.dedup, K.dedup), (N.strip_stopwords, lambda ns: [K.replace(n, text=K.Stopwords().strip(n.text)) for n in ns])):
        for t, r in zip(texts, fn(df).orderBy("i").collect(), strict=True):
            assert [n["text"] for n in r["nodes"]] == [n.text for n in kernel(K.parse(t, "plaintext"))]
    for fidelity in ("lossless", "semantic"):
        got = N.render_nodes(df, fidelity=fidelity).select("i", N.bridge("lines").alias("b")).orderBy("i").collect()
        assert [r["b"] for r in got] == [K.render(K.parse(t, "plaintext"), fidelity, {}) for t in texts]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 20)], "doc_id int, text string")
    out = D.transpile(df, fidelity="semantic", budget=10).orderBy("doc_id").collect()
    assert out[0]["content"] == "<B>\n\n</B>" and out[2]["input_tok"] == 5
    big = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("a"), M.MAX_INPUT_BYTES + 1).alias("text"))
    assert D.transpile(big).first()["error"] == "input_too_large" and D.stream_chunks(big).first()["error"] == "input_too_large"
    assert D.parse_documents(df.limit(0)).count() == 0


def test_sql_results(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    bad = []
    for name, f in catalogue.queries().items():
        got = f(spark, SF).toPandas()
        if name not in catalogue.oracle_sql():
            assert len(got)
            continue
        want = con.execute(catalogue.oracle_sql()[name]).df()
        cols = sorted(got.columns)
        rows = lambda d: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=repr)  # noqa: B023, E731
        if cols != sorted(want.columns) or rows(got) != rows(want):
            bad.append(name)
    assert not bad


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md/b.md").write_text("# B")
    (tmp_path / "md/a.md").write_text("# A\n\ntext")
    (tmp_path / "md/c.HTML").write_text("<p>")
    got = scans.directory(spark, str(tmp_path / "md"), "md", "markdown").collect()
    assert [r["text"] for r in got] == ["# A\n\ntext", "# B"], got
    assert {r["format"] for r in scans.whole_files(spark, str(tmp_path / "md")).collect()} == {"markdown"}
    assert scans.sections(spark, str(tmp_path), [("md", "md", "markdown"), ("no", "txt", "plaintext")]).count() == 2
    day = datetime.date(2026, 5, 9)
    line = {"ts": "2026-05-09T01:00:00Z", "agent": "a", "file": "f", "format": "markdown", "fidelity": "semantic", "input_tok": 10, "output_tok": 5, "reduction_pct": 50.0, "saved": 5}
    (tmp_path / f"{day}.jsonl").write_text(json.dumps(line) + "\nnot json\n" + json.dumps({"ts": "2026-05-09T02:00:00Z", "agent": "b"}) + "\n")
    assert scans.usage_days(spark, str(tmp_path), 3, day).count() == 2 and scans.usage_days(spark, str(tmp_path), 3, day, strict=True).count() == 1
    assert scans.run_logs(spark, str(tmp_path / "none")).count() == 0
    out = D.transpile(spark.createDataFrame([("hello world",)], "text string"))
    assert json.loads(sinks.as_json(out).first()["value"])["reduction_pct"].count(".") == 1
    sinks.append_usage(scans.usage_days(spark, str(tmp_path), 1, day), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_text(out, str(tmp_path / "txt"))
    sinks.write_csv(out.select("input_tok"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_streams(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(20).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.document_stream(spark, str(tmp_path / "in"), docs.schema, files=2)
    jobs.run_to_end(jobs.transpiled(stream, fidelity="semantic", budget=100).select("doc_id", "output_tok"), "out_docs", str(tmp_path / "cp1"))
    assert spark.table("out_docs").count() == 20
    jobs.run_to_end(jobs.chunks(jobs.document_stream(spark, str(tmp_path / "in"), docs.schema).select("doc_id", "text"), fidelity="lossless", budget=50), "out_chunks", str(tmp_path / "cp2"))
    assert spark.table("out_chunks").filter("sequence = 0").count() == 20
    rows = [(f"2026-05-{d:02d}T0{h}:00:00Z", "a", 10, 5, 5) for d in (1, 2, 3) for h in (1, 2)]
    spark.createDataFrame(rows, "ts string, agent string, input_tok long, output_tok long, saved long").coalesce(1).write.parquet(str(tmp_path / "use"))
    use = spark.readStream.schema("ts string, agent string, input_tok long, output_tok long, saved long").parquet(str(tmp_path / "use"))
    jobs.run_to_end(jobs.daily_usage(use), "out_use", str(tmp_path / "cp3"), "complete")
    assert {(r["date"], r["calls"]) for r in spark.table("out_use").collect()} == {("2026-05-01", 2), ("2026-05-02", 2), ("2026-05-03", 2)}


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("select token_count('hello'), first_sentence('Dr. X came. Then.'), strip_stopwords('walk through it'), transpile('a b', 'plaintext', 'lossless', null)").first()
    assert tuple(r) == (2, "Dr. X came.", "walk it", "<B>\na b\n</B>")
    assert spark.sql("select kind, text from parse_document('# H\n\npara', 'markdown')").count() == 2


def test_scores(spark):
    r = spark.range(1).select(S.composite(F.lit(40.0), F.lit(100.0), F.lit(1000.0), F.lit(10), F.lit(10)).alias("full"), S.composite(F.lit(40.0), F.lit(0.0), F.lit(0.0), F.lit(20), F.lit(10)).alias("red"), S.nearest_rank(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), 50).alias("p50")).first()
    assert (round(r["full"], 9), round(r["red"], 9), r["p50"]) == (1.0, 0.4, 3.0)
