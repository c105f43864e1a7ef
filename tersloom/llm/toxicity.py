"""Toxicity by a two-state linear-chain conditional random field over tokens; forward-backward marginals give document scores and spans.

Tokens are lower-cased runs of letters, digits and non-ASCII bytes; a chain is a sentence (cut at line ends and ``.!?``, and after 256 tokens).
Token labels come from labelled documents: a word is offending if it stands in many different contexts of toxic documents and hardly ever elsewhere.
Counting contexts, not occurrences, keeps the words of one much-copied toxic document from counting as offending. Offending stems are found in the
same way from the first 4, 5 and 6 bytes, so inflected forms that no labelled document holds are tagged too. Features: the word and those stems.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersloom.llm.common import Words, mix, small_batches, table, texts_of

#: Labelled documents that the model is fitted on, at most; they are chosen by hash and go to one task.
SAMPLE = 2000
LONGEST_CHAIN = 256
THRESHOLD = 0.7
_K = np.uint64(0x9E3779B97F4A7C15)
PREFIXES = (4, 5, 6)
_BREAK = np.zeros(256, bool)
_BREAK[[10, 33, 46, 63]] = True


@dataclass
class Model:
    vocab: list[np.ndarray]  # sorted hashes of words, and of each prefix
    theta: list[np.ndarray]  # state 1 against state 0
    bias: float
    trans: np.ndarray  # 2 x 2
    start: np.ndarray  # 2
    doc: np.ndarray  # weights of 1, the largest marginal's logit, log1p of the summed evidence, the same for each 100 tokens


def units(w: Words) -> list[np.ndarray]:
    """The hashes of each token's features; 0: no such feature."""
    return [w.hash, *(w.prefix(k) for k in PREFIXES)]


def chains(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of each chain."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.concatenate([[0], np.cumsum(_BREAK[w.buf])])
    new = np.ones(n, bool)
    new[1:] = seen[w.start[1:]] > seen[w.end[:-1]]
    new[w.first[:-1][w.first[:-1] < n]] = True
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    if length.max() > LONGEST_CHAIN:
        place = np.arange(n) - np.repeat(first, length)
        first = np.flatnonzero(new | (place % LONGEST_CHAIN == 0))
        length = np.diff(np.append(first, n))
    return first, length


def forward_backward(e: np.ndarray, first: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of state 1 for every token; with ``pairs`` also expected transitions (2 x 2) and the log partition sum."""
    n = len(e)
    psi = np.exp(np.clip(e, -30, 30))
    a = np.exp(trans)
    order = np.argsort(-length, kind="stable")
    s, size = first[order], length[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps + 1), "left")
    alpha, beta0, beta1 = np.zeros(n), np.ones(n), np.ones(n)
    log_z = 0.0
    p1 = p0 = np.zeros(0)
    for t in range(steps):
        idx = s[: active[t]] + t
        if t:
            q0, q1 = p0[: active[t]], p1[: active[t]]
            a0, a1 = q0 * a[0, 0] + q1 * a[1, 0], (q0 * a[0, 1] + q1 * a[1, 1]) * psi[idx]
        else:
            a0, a1 = np.full(len(idx), math.exp(start[0])), math.exp(start[1]) * psi[idx]
        z = a0 + a1
        p0, p1 = a0 / z, a1 / z
        alpha[idx] = p1
        if pairs:
            log_z += np.log(z).sum()
    for t in range(steps - 2, -1, -1):
        idx = s[: active[t + 1]] + t
        n0, n1 = beta0[idx + 1], beta1[idx + 1] * psi[idx + 1]
        b0, b1 = a[0, 0] * n0 + a[0, 1] * n1, a[1, 0] * n0 + a[1, 1] * n1
        z = b0 + b1
        beta0[idx], beta1[idx] = b0 / z, b1 / z
    up = alpha * beta1
    m = up / (up + (1 - alpha) * beta0)
    if not pairs:
        return m
    last = np.zeros(n, bool)
    last[first + length - 1] = True
    i = np.flatnonzero(~last)
    x = np.stack([(1 - alpha[i]) * a[0, 0] * beta0[i + 1], (1 - alpha[i]) * a[0, 1] * psi[i + 1] * beta1[i + 1], alpha[i] * a[1, 0] * beta0[i + 1], alpha[i] * a[1, 1] * psi[i + 1] * beta1[i + 1]])
    return m, (x / x.sum(0)).sum(1).reshape(2, 2), log_z


def offending(words: np.ndarray, context: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Hashes of words or stems whose distinct contexts are toxic far more often than chance allows."""
    with np.errstate(over="ignore"):
        once = np.unique(mix(words * _K ^ context) ^ toxic, return_index=True)[1]
    w, at = np.unique(words[once], return_inverse=True)
    n = np.bincount(at)
    k = np.bincount(at, weights=toxic[once].astype(float))
    p = min(max(float(toxic[once].mean()), 1e-3), 0.5) if len(once) else 0.5
    q = np.clip(k / n, 1e-9, 1 - 1e-9)
    gain = n * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p)))  # Chernoff's exponent
    return w[(w != 0) & (q >= 0.6) & (gain >= math.log(len(w) + 1) + 5)]


def pieces(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Stretches of about a quarter megabyte: the tokeniser's arrays are many times its text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 120) -> Model:
    """Seeds, then the chain's weights by penalised likelihood (Adam, fixed number of full rounds), then a logistic document score."""
    doc, feats, context, first, length, n = [], [[] for _ in range(1 + len(PREFIXES))], [], [], [], 0
    for begin, part in pieces(texts):
        w = Words(part, alnum=True)
        k = len(w.hash)
        before, after = np.concatenate([[np.uint64(0)], w.hash[:-1]])[:k], np.concatenate([w.hash[1:], [np.uint64(0)]])[:k]
        with np.errstate(over="ignore"):
            context.append(mix(before * _K + after))
        for held, f in zip(feats, units(w), strict=True):
            held.append(f)
        doc.append(np.repeat(np.arange(begin, begin + len(part)), np.diff(w.first)))
        f, size = chains(w)
        first.append(f + n)
        length.append(size)
        n += k
    whole = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
    feats, context, first, length = [whole(f, np.uint64) for f in feats], whole(context, np.uint64), whole(first, np.int64), whole(length, np.int64)
    tox = labels[whole(doc, np.int64)].astype(bool) if n else np.zeros(0, bool)
    y = np.zeros(n, bool)
    for f in feats if n else ():
        y |= np.isin(f, offending(f, context, tox.astype(np.uint64)))
    y &= tox
    has = np.add.reduceat(y.astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
    # chains with a labelled token, and three times as many others, by hash
    others = np.flatnonzero(~has)
    others = others[np.argsort(mix(others.astype(np.uint64)), kind="stable")][: max(1000, 3 * int(has.sum()))]
    pick = np.sort(np.concatenate([np.flatnonzero(has), others]))
    idx = np.concatenate([np.arange(f, f + k) for f, k in zip(first[pick], length[pick], strict=True)]).astype(np.int64) if len(pick) else np.zeros(0, np.int64)
    k_first = np.concatenate([[0], np.cumsum(length[pick])])[:-1].astype(np.int64)
    k_len = length[pick]
    found = [np.unique(f[idx], return_inverse=True) for f in feats]
    vocab, at = [v for v, _ in found], [i for _, i in found]
    yy = y[idx].astype(float)
    theta, bias, trans, start = [np.zeros(len(v)) for v in vocab], np.zeros(1), np.zeros((2, 2)), np.zeros(2)
    params, lr = [*theta, bias, trans, start], 0.15
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    begins, ends = np.zeros(len(yy), bool), np.zeros(len(yy), bool)
    if len(pick):
        begins[k_first] = True
        ends[k_first + k_len - 1] = True
    inner = np.flatnonzero(~ends)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (yy[inner].astype(int), yy[inner + 1].astype(int) if len(inner) else inner), 1)
    for step in range(1, (rounds if len(pick) else 0) + 1):
        m, pairs, _ = forward_backward(sum(t[i] for t, i in zip(theta, at, strict=True)) + bias[0], k_first, k_len, trans, start, pairs=True)
        d = yy - m
        own = [(np.bincount(i, weights=d, minlength=len(t)) - 0.05 * t) * (v != 0) for t, i, v in zip(theta, at, vocab, strict=True)]
        grads = [*own, np.array([d.sum()]) - 0.01 * bias, seen_pairs - pairs - 0.01 * trans, np.array([-d[begins].sum(), d[begins].sum()]) - 0.01 * start]
        for p, g, a, b in zip(params, grads, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    model = Model(vocab, theta, float(bias[0]), trans, start, np.zeros(4))
    x = [features(Words(part, alnum=True), model)[0] for _, part in pieces(texts)]
    model.doc = logistic(np.concatenate([np.zeros((0, 3)), *x]), labels.astype(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton steps on the penalised likelihood; a single class gives its smoothed rate."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def features(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Three features for each text, and every token's marginal."""
    n, docs = len(w.hash), len(w.at)
    x = np.zeros((docs, 3))
    x[:, 0] = math.log(1e-9)
    if not n:
        return x, np.zeros(0)
    e = np.full(n, model.bias)
    for h, v, t in zip(units(w), model.vocab, model.theta, strict=True):
        if len(v):
            at = np.minimum(np.searchsorted(v, h), len(v) - 1)
            e += np.where(v[at] == h, t[at], 0.0)
    m = forward_backward(e, *chains(w), model.trans, model.start)
    some = np.flatnonzero(np.diff(w.first))
    top = np.clip(np.maximum.reduceat(m, w.first[some]), 1e-9, 1 - 1e-9)
    # evidence of a noisy or; marginals below 5 % are noise that a long text would add up
    total = np.add.reduceat(np.where(m >= 0.05, -np.log1p(-np.minimum(m, 1 - 1e-6)), 0.0), w.first[some])
    x[some, 0], x[some, 1], x[some, 2] = np.log(top / (1 - top)), np.log1p(total), np.log1p(100 * total / (np.diff(w.first)[some] + 20))
    return x, m


def spans(w: Words, m: np.ndarray, i: int) -> list[dict]:
    """Code-point offsets of runs of tokens with a marginal of 0.5 or more."""
    a, z = w.first[i], w.first[i + 1]
    hit = np.flatnonzero(m[a:z] >= 0.5) + a
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1) + 1
    points = lambda at: int(((w.buf[w.at[i] : at] & 0xC0) != 0x80).sum())
    return [{"start": points(w.start[g[0]]), "end": points(w.end[g[-1]])} for g in np.split(hit, cut)]


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled documents with crc32(doc_id) mod 3 other than 1, chosen by hash of doc_id. The ids come from the
    labels alone, so the broadcast is bounded. Of rows that share a doc_id the smallest text counts, of their labels the largest; null ids and labels are left out."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = ids.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("label").cast("int").alias("label"))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    """The model of a sample. One task gets the sample's rows, ``most`` at most, and sends the fitted model; the driver never holds a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True))
        model = fit([x for _, x, _ in rows], np.array([y for _, _, y in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = sample(docs, labels, label, most).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got["model"]) if got else fit([], np.zeros(0, np.int64))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (array of start and end in code points) for every row; one pass, no shuffle.

    Null and empty texts have no token and get the score of a text without an offending token. Repeated rows score alike; an empty table gives no rows;
    other columns are ignored. Memory is bounded by one text. A null doc_id is not held out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in small_batches(batches, "text"):
            w = Words(texts_of(b.column(1)), alnum=True)
            x, m = features(w, model)
            score = 1 / (1 + np.exp(-np.clip(model.doc[0] + x @ model.doc[1:], -30, 30)))
            found = [spans(w, m, i) if x[i, 1] else [] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "score", "spans"])

    out = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, all columns kept; nothing is shuffled, so repeated or null ids do no harm."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in small_batches(batches, "text"):
            x, _ = features(Words(texts_of(b.column(b.schema.get_field_index("text"))), alnum=True), model)
            score = 1 / (1 + np.exp(-np.clip(model.doc[0] + x @ model.doc[1:], -30, 30)))
            yield b.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
