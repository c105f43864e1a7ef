"""Brute-force versions, round trips and odd rows for the operators of tersloom.llm."""

import hashlib
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tersloom.llm import ann, bpe, jaccard, lines, mixing, quality, queries, sharding, toxicity, urls, warc
from tersloom.llm.common import Words, connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, h long, key string"
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, "en", "s" if sources is None else sources[i], None if t is None else len(t), "clash", 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "one", "one two three", "long " * 30_000, "same text here again", "same text here again", "\u00a0 \u2003é", "a\x0bb\x0cc\r\nd", "<|endoftext|> it's 'LL"]


def odd(spark):
    return docs_frame(spark, ODD, ids=[None, 1, 2, 3, 3, 5, 6, 6, 8, 9, 10])


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return [f"w{int(r.paretovariate(0.6)) % vocab}x{r.randrange(40)}" for _ in range(n)]


def near_copies(seed=3):
    """Texts with copies at many distances, a common passage, and unrelated ones."""
    r = random.Random(seed)
    out = []
    passage = words(30, 99)
    for g in range(25):
        base = words(r.randrange(20, 200), g)
        if g % 3 == 0:
            base = base[:10] + passage + base[10:]
        out.append(" ".join(base))
        for _ in range(r.randrange(0, 6)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = f"new{r.randrange(10_000)}"
            out.append((" " if r.random() < 0.5 else "\n").join(w).upper() if r.random() < 0.1 else " ".join(w))
    r.shuffle(out)
    return out


def brute_components(texts, ids, n, percent):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    comp = {}
    for i in range(len(texts)):
        comp.setdefault(find(i), []).append(ids[i])
    return {ids[i]: (len(sets[i]), min(comp[find(i)])) for i in range(len(texts))}


def test_words_and_components(spark):
    texts = [b"Ab cd\tef", b"", b"  cd ", "é\x85x".encode()]
    w = Words(texts)
    assert np.diff(w.first).tolist() == [3, 0, 1, 1]
    assert w.hash[1] == w.hash[3] and w.hash[0] == Words([b"aB"]).hash[0] and len(set(w.hash.tolist())) == 4
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    import collections

    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node, c in got.items():
        seen, todo = {node}, [node]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert min(seen) == c


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_brute_force(spark, n, percent):
    texts = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(docs_frame(spark, texts), n, percent).collect()}
    assert got == brute_components(texts, list(range(len(texts))), n, percent)
    assert len({c for _, c in got.values()}) < len(texts)


@pytest.mark.parametrize("dense", [0, 4])
def test_jaccard_large_block(spark, monkeypatch, dense):
    """A large group of near copies of which many pairs just fail: the exhaustive part must find what pivots miss."""
    r = random.Random(8)
    base = words(120, 1)
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"new{r.randrange(10_000)}"
        texts.append(" ".join(w))
    for k, v in (("BLOCK_FEW", 4), ("BLOCK_ALL", 8), ("DENSE", dense)):
        monkeypatch.setattr(jaccard, k, v)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.joined(docs_frame(spark, texts)).collect()}
    assert got == brute_components(texts, list(range(len(texts))), 4, 85)


def test_jaccard_odd(spark):
    got = [tuple(r) for r in jaccard.joined(odd(spark)).select("doc_id", "n_shingles", "component_id").collect()]
    assert len(got) == len(ODD)
    assert (None, 0, None) in got and (1, 0, 1) in got and (2, 0, 2) in got and got.count((6, 1, 6)) == 2
    assert (5, 1, 5) in got
    assert jaccard.joined(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_short_copies(spark, n, percent):
    """Equal texts of fewer than n words are one class, whatever texts follow them."""
    short = ["one", "one two", "one two three", "rare1", "common rare2"]
    texts = [t for k in range(6) for s in short for t in (s, " ".join(["common"] * (3 * k) + [f"u{k}", s, f"v{k}"] * 3))]
    want = brute_components(texts, list(range(len(texts))), n, percent)
    frame = docs_frame(spark, texts)
    for docs in (frame.coalesce(1), frame.repartition(7)):
        got = {r["doc_id"]: r for r in jaccard.joined(docs, n, percent).collect()}
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
        for s in short:
            assert len({got[i]["class_id"] for i, t in enumerate(texts) if t == s}) == 1


def test_jaccard_repeated_ids(spark):
    """Rows that share a doc_id but not a text are documents each, however they are dealt; equal rows are copies."""
    x, y = words(60, 1), words(60, 2)
    near = lambda w: " ".join([*w[:-1], "end"])
    texts, ids = [" ".join(x), " ".join(y), near(x), near(y), " ".join(x), " ".join(words(50, 5)), " ".join(words(50, 5)), near(y) + " "], [5, 5, 9, 8, 5, 4, 4, 3]
    want = sorted([(5, 5), (5, 3), (9, 5), (8, 3), (5, 5), (4, 4), (4, 4), (3, 3)])
    for parts in (1, 3, 5):
        got = jaccard.joined(docs_frame(spark, texts, ids=ids).repartition(parts)).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == want


def simple_similarity(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return 1 - d[-1] / max(len(a), len(b))


def test_line_dedup_brute_force(spark):
    r = random.Random(4)
    texts, base = [], [" ".join(words(r.randrange(8, 40), 1000 + k, 2000)) for k in range(30)]
    base.append(" ".join(words(300, 77, 2000)))  # more than one segment
    for _ in range(60):
        rows = []
        for _ in range(r.randrange(1, 5)):
            w = r.choice(base).split()
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = f"y{r.randrange(99)}"
            rows.append("  ".join(w).upper() if r.random() < 0.2 else " ".join(w))
        texts.append("\n".join(rows + [""] * r.randrange(2)))
    docs = docs_frame(spark, texts)
    removed = {(x["doc_id"], n) for x in lines.line_decisions(docs).collect() for n in x["removed"]}
    occ = [((i, k), " ".join(t.lower().split())) for i, d in enumerate(texts) for k, t in enumerate(d.split("\n")) if t.strip()]
    hashes = {(x["d"], x["line_no"]): (x["s1"], x["s2"]) for x in lines.simhashed(lines.exploded(docs, "doc_id", "text")).collect()}
    first = {}
    for at, t in occ:
        first.setdefault(t, at)
    distinct = list(first.items())
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(hashes[a], hashes[b], strict=True))
    sure, may = {t: {t} for t in first}, {t: {t} for t in first}
    for (a, pa_), (b, pb) in combinations(distinct, 2):
        if simple_similarity(a, b) >= 0.8:
            for groups, ok in ((sure, bits(pa_, pb) <= 3), (may, True)):
                if ok and groups[a] is not groups[b]:
                    groups[a] |= groups[b]
                    for t in groups[a]:
                        groups[t] = groups[a]
    for at, t in occ:
        if at != min(first[x] for x in sure[t]):
            assert at in removed  # an exact copy, or so near that a block is shared for certain
        if at == min(first[x] for x in may[t]):
            assert at not in removed  # the first of all that could be linked
    assert any(len(g) > 1 for g in sure.values())
    # and one pair of a longer chain stays in each group
    kept = {t for at, t in occ if at not in removed}
    assert all(kept & may[t] for t in first)


def test_line_dedup_repeated_rows(spark):
    """Rows that repeat an id and a text, or null ids with equal texts, are one document: lines of any length are kept once and removed elsewhere."""
    texts, ids, want = [], [], []
    for k, n in enumerate((40, 64, 100, 127, 128, 300)):
        for first, null in ((10 * k, False), (None, True)):
            texts += [" ".join(f"w{n}x{i}{null}" for i in range(n))] * 3
            ids += [first, first, 10 * k + 1 + null]
            want += [(first, []), (first, []), (10 * k + 1 + null, [0])]
    got = [(r["doc_id"], r["removed"]) for r in lines.line_decisions(docs_frame(spark, texts, ids=ids)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_line_dedup_recall(spark):
    """Recall against brute-force edit similarity: pairs of lines with some words changed, or a typo in some, that are similar at 0.8 or more."""
    r = random.Random(12)
    texts, kinds = [], []
    for n in (10, 20, 50):
        for changed in (1, n // 5):
            for typo in (False, True):
                for _ in range(60):
                    a = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9))) for _ in range(n)]
                    b = list(a)
                    for i in r.sample(range(n), changed):
                        b[i] = b[i][:1] + "0" + b[i][2:] if typo else "".join(r.choice("0123456789") for _ in b[i])
                    if simple_similarity(" ".join(a), " ".join(b)) >= 0.8:
                        texts += [" ".join(a), " ".join(b)]
                        kinds.append((n, changed, typo))
    got = {x["doc_id"]: x["n_removed"] for x in lines.line_decisions(docs_frame(spark, texts)).collect()}
    assert not any(got[i] for i in range(0, len(texts), 2))
    recall = {k: np.mean([got[2 * i + 1] for i, x in enumerate(kinds) if x == k]) for k in set(kinds)}
    print(sorted(recall.items()))
    assert min(recall.values()) >= 0.8 and np.mean([got[2 * i + 1] for i in range(len(kinds))]) >= 0.9


def test_simhash_is_the_majority(spark):
    """Of the line's distinct words, or of the SKETCH words with the smallest hashes."""
    texts = [" ".join(words(n, n, 5000)) for n in (1, 2, 5, 63, 64, 65, 126, 127, 128, 300, 1000)]
    frame = docs_frame(spark, texts)
    got = {x["d"]: (x["s1"], x["s2"]) for x in lines.simhashed(lines.exploded(frame, "doc_id", "text")).collect()}
    h = {r["w"]: (r["a"], r["b"]) for r in frame.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("a")).withColumn("b", F.xxhash64("a")).collect()}
    for i, t in enumerate(texts):
        w = sorted({h[x] for x in t.split()})[: lines.SKETCH]
        for k in (0, 1):
            want = 0
            for j in range(56):
                if sum((x[k] & (1 << 64) - 1) >> j & 1 for x in w) > len(w) // 2:
                    want |= 1 << j
            assert got[i][k] == want


def test_edit_similarity(spark):
    """The bounds before the whole distance change no verdict: lines with words changed, added, removed, moved and repeated, at all similarities."""
    r = random.Random(9)
    pairs = []
    for _ in range(400):
        vocab = [f"v{i}" * r.randrange(1, 4) for i in range(r.choice([4, 30, 400]))]
        a = [r.choice(vocab) for _ in range(r.randrange(1, 60))]
        b = list(a)
        for _ in range(r.randrange(0, 1 + len(a) // 3)):
            i = r.randrange(len(b)) if b else 0
            b[i : i + r.choice([0, 1, 1, 2])] = r.choice([[], [r.choice(vocab)], [f"n{r.randrange(99)}é"], [f"n{r.randrange(99)}", "q"]])
        x, y = " ".join(a), " ".join(b)
        if x and y and x != y:
            pairs.append((x, y))
    rows = [(2 * i + k, 0, k, i, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    f = spark.createDataFrame(rows, "l1 long, d long, line_no int, i long, norm string")
    texts = f.select(F.struct("l1", F.col("l1").alias("s1"), F.col("l1").alias("s2")).alias("x"), F.struct(F.col("i").alias("d"), F.lit(0).cast("long").alias("th"), "line_no").alias("id"), "norm")
    both = texts.select(F.col("id.d").alias("i"), "id", "x")
    asked = both.filter("id.line_no = 0").select("i", "x").join(both.filter("id.line_no = 1").select("i", F.col("x").alias("y")), "i").select("x", "y")
    got = {r["b"]["d"] for r in lines.verified(asked, texts).collect()}
    want = {i for i, (x, y) in enumerate(pairs) if simple_similarity(x, y) >= 0.8 - 1e-12}
    assert got == want and 50 < len(want) < len(pairs) - 50


def test_line_dedup_odd(spark):
    got = lines.line_decisions(odd(spark)).collect()
    assert len(got) == len(ODD) and sum(r["n_lines"] for r in got) == 9
    assert lines.line_decisions(odd(spark).limit(0)).count() == 0
    cut = lines.without_duplicate_lines(docs_frame(spark, ["a b\nc d", "c d\n\ne f", "A  b", None, ""])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in cut] == [(0, "a b\nc d", 7), (1, "\ne f", 4), (3, None, None), (4, "", 0)]


def test_quality(spark):
    text = "\n".join(["This is a whole sentence with some words in it, and it ends well.", "Home | About | Contact | Login", "All rights reserved.", "short one"] + [f"Sentence number {i} stands here, and it is not like any of the others at all." for i in range(5)])
    got = quality.cleaned_lines(docs_frame(spark, [text])).first()
    assert got["kept"] and (got["lost_punctuation"], got["lost_navigation"], got["lost_boilerplate"]) == (1, 1, 1) or got["lost_punctuation"] == 2
    assert "Login" not in got["text"] and "rights" not in got["text"] and "Sentence number 4" in got["text"]
    junk = "\n".join(["menu item here"] * 30)
    assert not quality.cleaned_lines(docs_frame(spark, [junk])).first()["kept"]
    rows = quality.cleaned_lines(odd(spark)).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows if r["n_words"] < 50)
    long = next(r for r in rows if r["doc_id"] == 5)
    assert (long["n_words"], long["n_repeat_words"], long["base_failed"]) == (30_000, 30_000, True)
    assert quality.cleaned_lines(odd(spark).limit(0)).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()["op3_toxicity"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    x = got[got.held_out]
    assert ((x.score < 0.7) & (x.toxic == 0)).sum() >= 0.97 * (x.toxic == 0).sum()
    assert ((x.score >= 0.7) & (x.toxic == 1)).sum() >= 0.5 * (x.toxic == 1).sum()
    assert x[x.toxic == 1].score.mean() > x[x.toxic == 0].score.mean() + 0.3


def test_toxicity_chain_and_spans(spark):
    r = np.random.default_rng(2)
    e, trans, start = r.normal(size=7), r.normal(size=(2, 2)), r.normal(size=2)
    first, length = np.array([0, 3]), np.array([3, 4])
    m = toxicity.forward_backward(e, first, length, trans, start)
    for a, n in zip(first, length, strict=True):
        p = np.zeros(n)
        z = 0.0
        for s in np.ndindex(*[2] * n):
            v = np.exp(start[s[0]] + sum(e[a + t] * s[t] for t in range(n)) + sum(trans[s[t], s[t + 1]] for t in range(n - 1)))
            z += v
            p += v * np.array(s)
        assert np.allclose(p / z, m[a : a + n])
    texts = [f"the a{k} {w} b{k} home. and c{k} {w2} d{k}" for k, (w, w2) in enumerate([("fine", "good")] * 120 + [("vile", "filth")] * 40)]
    model = toxicity.fit([t.encode() for t in texts], np.array([0] * 120 + [1] * 40))
    got = toxicity.scored(docs_frame(spark, ["now é vile thing", None, "a good day", ""]), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in got] == [1, 0, 0, 0] and got[1]["score"] == got[3]["score"]
    assert "now é vile thing"[got[0]["spans"][0]["start"] : got[0]["spans"][0]["end"]] == "vile"
    assert len(toxicity.scored(odd(spark), model).collect()) == len(ODD)
    # rows that share an id and their labels: the same model, however the rows are dealt
    docs = docs_frame(spark, texts + [texts[3] + " twice", None], ids=[*range(160), 3, 7])
    labels = spark.createDataFrame([(i, int(i >= 120)) for i in range(160)] + [(5, 0), (None, 1), (9, None), (999, 1)], "doc_id long, toxic int")
    one, two = (toxicity.fitted(d, labels) for d in (docs.coalesce(1), docs.repartition(5)))
    assert all(np.array_equal(x, y) for x, y in zip((*one.vocab, *one.theta, one.doc), (*two.vocab, *two.theta, two.doc), strict=True))
    assert toxicity.scored(docs_frame(spark, ["now vile thing", "nice thing"]), one).filter("predicted = 1").count() == 1
    assert toxicity.scored(odd(spark), toxicity.fitted(docs.limit(0), labels)).filter("score is null").count() == 0
    empty = toxicity.fit([], np.zeros(0, np.int64))
    assert toxicity.scored(odd(spark), empty).filter("score is null").count() == 0


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    passage = " ".join(words(300, 5))
    texts = [*ODD, passage, "Head " + passage, passage + " tail", passage[:900] + "ÀÉ " + passage[900:], "x" * 5000, "ΑΣ Σ ΟΔΟΣ. ① ½ ﬁ Å", "\u0301 a\u0301 \u1100\u1161 <|startoftext|>x", "é" * 3000, passage]
    got = bpe.encoded(docs_frame(spark, texts), bpe.vocabulary(), with_ids=True)
    rows = {r["doc_id"]: r for r in bpe.decode(got, bpe.vocabulary()).collect()}
    assert len(rows) == len(texts)
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        r = rows[i]
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == raw and r["ids_sha256"] == hashlib.sha256(raw).hexdigest(), x
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encoded(odd(spark).limit(0), bpe.vocabulary()).count() == 0


def test_chunks_are_content_defined():
    a = " ".join(words(2000, 1)).encode()
    b = b"other words before " + a
    x, y = bpe.Chunks([a]), bpe.Chunks([b])
    assert len(set(x.hash.tolist()) & set(y.hash.tolist())) > 0.9 * len(x.hash)
    assert b"".join(x.buf[s:e].tobytes() for s, e in zip(x.start, x.end, strict=True)) == a


def test_ann(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[100] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0]), (None, x[0].tolist())]
    rows += [(5000 + i, x[3].tolist()) for i in range(600)]  # one vector's many copies
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    ids = np.array([i for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)])
    m = np.array([v for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)], float)
    hits = []
    for q in ids[ids % 100 == 0]:
        i = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((m - m[i]) ** 2).sum(1))
        d[i] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and len(set(g.vec_id)) == 10
        assert np.allclose(g.score, [d[np.flatnonzero(ids == v)[0]] for v in g.vec_id], rtol=1e-12)
        hits.append(np.isin(want, g.vec_id).mean())
    assert np.mean(hits) >= 0.9
    # rows that share a vec_id crowd nothing out; columns with clashing names
    crowd = [(i, v.tolist(), "clash", 1) for i, v in enumerate(x[:800])] + [(7, (x[0] + 0.001 * r.normal(size=16)).astype(np.float32).tolist(), "clash", 1)] * 60
    g = ann.nearest(spark.createDataFrame(crowd, "vec_id long, embedding array<float>, list string, x long")).toPandas()
    g = g[g.query_id == 0].sort_values("rank")
    assert len(g) == 10 and g.vec_id.iloc[0] == 7 and g.vec_id.is_unique
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")).toPandas()
    assert few.sort_values("rank").vec_id.tolist() == [2, 1]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sharding(spark, tmp_path):
    texts = [" ".join(words(random.Random(i).randrange(1, 300), i)) for i in range(800)]
    got = sharded = sharding.sharded(docs_frame(spark, texts)).toPandas()
    assert sorted(got.doc_id) == list(range(800)) and set(got.shard) <= set(range(16)) and set(got.law) == {"bytes"}
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    import zlib

    assert all(zlib.crc32(texts[r.doc_id].encode()) == r.text_crc32 and len(texts[r.doc_id].encode()) + 1 == r.size for r in sharded.itertuples())
    rows = sharding.sharded(odd(spark)).toPandas()
    assert len(rows) == len(ODD) and rows["size"].min() == 1
    assert sharding.sharded(odd(spark).limit(0)).count() == 0
    # brute force: the stored map and the place of every row
    def by_hand(frame, path):
        slots = {v: k for _, v, k, _ in sharding.load_map(spark, path)}
        got = sharding.sharded(frame, map_path=path).toPandas()
        assert all(slots[r.virtual_slot] == r.shard for r in got.itertuples())
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        return got

    path = str(tmp_path / "map")
    before = sharding.sharded(docs_frame(spark, texts), map_path=path).toPandas()
    assert sharding.versions(spark, path) == [1] and set(before.map_version) == {1}
    assert sharding.rebalance(spark, path, 17) == 2 and sharding.versions(spark, path) == [1, 2]
    after = by_hand(docs_frame(spark, texts).repartition(5), path)
    both = before.merge(after, on="doc_id")
    assert set(after.map_version) == {2} and 0 < (both.shard_x != both.shard_y).mean() < 0.12 and set(both.shard_y[both.shard_x != both.shard_y]) == {16}
    with pytest.raises(Exception):
        sharding.save_map(spark, path, sharding.load_map(spark, path, 1))
    old = sharding.first_map({i: (i * 37) % 101 + 1 for i in range(4096)}, 16)
    new = sharding.rebalanced(old, 17)
    assert {r[0] for r in new} == {2} and all(b[2] in (a[2], 16) for a, b in zip(old, new, strict=True))
    loads = [sum(r[3] for r in new if r[2] == k) for k in range(17)]
    assert max(loads) < 1.02 * min(loads)


def test_mixing(spark):
    r = random.Random(3)
    texts = [" ".join(["w"] * r.randrange(0, 60)) for _ in range(900)]
    sources = [r.choice(["a", "b", "c", "d", None]) if i > 300 else "a" for i in range(900)]
    got = mixing.mixed(docs_frame(spark, texts, sources=sources)).toPandas()
    again = mixing.mixed(docs_frame(spark, texts, sources=sources).repartition(7)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    got["source"] = [sources[i] for i in got.doc_id]
    assert (got["taken"] <= 2 * got["size"]).all() and (got["size"] == [len(texts[i].split()) for i in got.doc_id]).all()
    sizes = {s: g["size"].sum() for s, g in got.groupby("source", dropna=False)}
    names = sorted([s for s in sizes if isinstance(s, str)]) + [s for s in sizes if not isinstance(s, str)]
    weight = dict(zip(names, [5, 2, 1, 5, 2], strict=True))
    target, left, open_ = {s: 0.0 for s in names}, 1.5 * sum(sizes.values()), set(names)
    while True:  # the excess is reshared by weight until none is above
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= above
    for s, g in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else next(x for x in names if not isinstance(x, str))
        assert np.isclose(g["target"].iloc[0], target[s]) and abs(g["taken"].sum() - target[s]) <= 1
    mix = mixing.mixture(docs_frame(spark, texts, sources=sources)).toPandas()
    assert sum(len(t.split()) for t in mix.text) == got["taken"].sum() and list(mix.columns) == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert mixing.mixed(odd(spark)).count() == len(ODD) and mixing.mixed(odd(spark).limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://WWW.Example.com/en/x.html?utm_a=1#f"), (2, None), (3, "no scheme"), (4, "x://a://b/c"), (5, "http://notexample.com/en/"), (6, "http://m.site.org/p/"), (7, "https://www.site.org/p.html?ref=z&q=1"), (8, "http://site.org/p"), (8, "http://site.org/p"), (9, "http://a.net/es"), (10, "http://a.net/es/")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, block string, w0 long")
    listed = spark.createDataFrame([("https://site.org/p/",), (None,), ("http://a.net/es",)], "url string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_verdicts(pages, listed).collect()}
    assert got == {(1, "www.example.com", "/en/x.html", "www.example.com/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a:", "//b/c", None, "allow"), (5, "notexample.com", "/en/", "com/", "allow"), (6, "m.site.org", "/p/", None, "block"), (7, "www.site.org", "/p.html", None, "allow"), (8, "site.org", "/p", None, "block"), (9, "a.net", "/es", None, "block"), (10, "a.net", "/es/", "net/es/", "block")}
    assert urls.url_verdicts(pages.limit(0), listed).count() == 0 and urls.url_verdicts(pages, listed.limit(0)).count() == len(rows)
    # the filter never loses a listed key, even when it is far too small
    many = spark.range(3000).select(F.concat(F.lit("http://h.org/"), "id").alias("url"), F.col("id").alias("page_id"))
    out = urls.url_verdicts(many, many.filter("page_id % 3 = 0"), blocks=4).toPandas()
    assert ((out.verdict == "block") == (out.page_id % 3 == 0)).all()


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" + "z" * 3000
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, None), (4, "", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", "q" * 150), (8, "n", "q" * 150), (2, "twice", big), *((100 + i, f"http://{i}", f"<p>{i}</p>" * 40) for i in range(40))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")
    path = str(tmp_path / "w")
    warc.write_warc(pages.coalesce(2), path)
    got = warc.read_warc(spark, path, range_bytes=700).collect()  # ranges cut records, and payloads hold record heads
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["record_type"] == "response" and bytes(by[1]["payload"]).decode() == big
    assert by[2]["record_type"] == "revisit" and by[2]["refers_to"] == 1 and by[2]["payload"] is None and by[2]["payload_bytes"] == len(big.encode())
    assert by[5]["record_type"] == by[6]["record_type"] == "response" and by[4]["payload_bytes"] == by[3]["payload_bytes"] == 0
    assert by[None]["record_type"] == "revisit" and by[None]["refers_to"] == 8 and by[8]["record_type"] == "response"
    only = warc.read_warc(spark, path, payload=False).filter("record_type = 'revisit'")
    assert "warc" in only._jdf.queryExecution().toString().lower() and only.count() == sum(r["record_type"] == "revisit" for r in got)
    assert warc.read_warc(spark, path).filter(F.col("url").isin("http://a", "http://7")).count() == 2
    reader = warc.WarcReader({})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 3)])) == [GreaterThan(("page_id",), 3)] and reader.want == {"record_type": {"response"}}
    assert warc.round_trip(pages).count() == len(rows) and warc.round_trip(pages.limit(0)).count() == 0


def test_sql(spark):
    sf = SF
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want, got = con.execute(sql).df(), queries.queries()[name](spark, sf).toPandas()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        rows = lambda d: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=repr)  # noqa: B023, E731
        assert rows(got) == rows(want), name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        seen.append(docs.toPandas())
        docs = spark.createDataFrame(seen[-1]) if len(seen[-1]) else docs
    first = seen[0]
    assert all(list(x.columns) == list(first.columns) for x in seen[:-1])
    assert len(first) >= len(seen[1]) >= len(seen[2]) >= len(seen[3]) > 0.5 * len(first)
    kept = seen[3]
    comp = brute_components(kept.text.tolist(), kept.doc_id.tolist(), 5, 80)
    assert all(c == i for i, (_, c) in comp.items())
    assert len(seen[5]) == len(seen[4]) and set(seen[5].columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert corpus_pipeline.run(spark, SF).count() == len(seen[5])


def test_line_verification_is_exact(spark, monkeypatch):
    """The cheap bounds decide as the whole distance does: runs of one word, moved parts, insertions, typos, equal and empty rests; for lines cut to pieces too."""
    import random

    from tersloom.llm import lines as L

    r = random.Random(11)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 8))) for _ in range(60)]
    rows, pairs = [], []
    for n in (1, 3, 10, 40, 120):
        for kind in range(8):
            a = [w for w in r.choices(words, k=n) for _ in range(5 if kind == 7 else 1)]
            share = (0, 0.03, 0.12, 0.2, 0.25, 0.1, 0.05, 0.05)[kind]
            change = lambda w: r.choice([r.choice(words), f"{w} {r.choice(words)}", "", w + "é"])
            b = " ".join(" ".join(change(w) if r.random() < share else w for w in a).split()) or "x"
            if kind == 5:
                b = " ".join(reversed(b.split()))
            k = len(rows)
            rows += [(k, k, " ".join(a)), (k + 1, k + 1, b)]
            pairs.append((k + 1, k))
    texts, asked = spark.createDataFrame(rows, "x long, id long, norm string"), spark.createDataFrame(pairs, "x long, y long")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    text = {x: t for x, _, t in rows}
    want = {(x, y) for x, y in pairs if 5 * distance(text[x], text[y]) <= max(len(text[x]), len(text[y]))}
    assert 0 < len(want) < len(pairs)
    for cells in (L.CELLS, -1):
        monkeypatch.setattr(L, "CELLS", cells)
        assert {(x, y) for x, y in L.verified(asked, texts).select("x", "y").collect()} == want
    assert L.verified(asked.limit(0), texts).count() == 0


def test_components_end_at_stars(spark, monkeypatch):
    """Stars need no round: the edges are written once (a round that changed nothing was run and written before)."""
    from tersloom.llm import common

    tables = []
    monkeypatch.setattr(common, "written", lambda df, name, f=common.written: tables.append(name) or f(df, name))
    edges = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    assert dict(map(tuple, common.connected_components(edges([(2, 1), (1, 3), (5, 4)])).collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert tables == ["cc"]
    for pairs in ([(3, 1), (3, 2)], [(2, 1), (3, 2)], [(4, 3), (4, 2), (3, 1)]):  # two smaller neighbours, a path, both
        assert {x.component for x in common.connected_components(edges(pairs)).collect()} == {1}


def test_native_heap_is_trimmed(spark, monkeypatch):
    """A sweep also gives back what the driver's native heap has freed (it only collected garbage before)."""
    from tersloom.llm import common

    assert common.trimmed(spark)
    done = []
    monkeypatch.setattr(common, "trimmed", lambda s: done.append(s))
    common.swept(spark)
    assert done == [spark]


def test_one_pair_of_two_components(spark, monkeypatch):
    """Of the pairs between two components one is verified, the others only if it gives no link; every link counts (all pairs were verified before)."""
    texts = {1: "a b c d e f g h i j", 2: "a b c d e f g h i k", 3: "a b c d e f g h i l", 4: "q r s t u v w x y z", 5: "a b c d e f g h m n"}
    x = lambda i: (i, 0, 0, len(texts[i]))
    line = "struct<l1: long, s1: long, s2: long, len: int>"
    known = spark.createDataFrame([(x(i), (i, 0, 0), t) for i, t in texts.items()], f"x {line}, id struct<d: long, th: long, line_no: int>, norm string")
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    groups = frame([(x(1), x(1)), (x(2), x(1))], f"node {line}, component {line}")
    asked, real = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda p, t: asked.append(p.count()) or real(p, t))
    pairs = frame([(x(3), x(1), 4), (x(3), x(2), 5), (x(4), x(1), 1), (x(4), x(2), 2), (x(5), x(3), 9)], f"x {line}, y {line}, bits int")
    got = {r["node"]["l1"]: r["component"]["l1"] for r in lines.joined(pairs, groups, known).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1} and asked == [3, 1]
