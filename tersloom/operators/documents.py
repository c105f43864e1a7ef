"""Whole-document operators: Markdown and HTML parsing, the budget loop, symbol encoding and chunk streams, in Arrow batches of the scalar kernel.

These steps scan with state or loop until a budget is met, which columns cannot; each document is independent, so nothing is shuffled. Batches are
cut by bytes, so memory follows the largest document, which the input limit bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersloom import kernel as K
from tersloom import model as M

BATCH_BYTES = 4 << 20


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column).cast(pa.binary())), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > BATCH_BYTES:
                yield b.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield b.slice(begin)


def _mapped(df: DataFrame, inputs: list, fn: Callable, fields: list[T.StructField]) -> DataFrame:
    """All columns of ``df``, and those of ``fn(text, ...)`` for each row; a raised InputTooLarge becomes the value of ``error``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = df.columns
    names = [f.name for f in fields]
    schema = T.StructType([*df.schema.fields, *fields])
    kinds = list(to_arrow_schema(T.StructType(fields)))
    n_in, n_keep = len(inputs), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, n_keep):
            args = [b.column(n_keep + i).to_pylist() for i in range(n_in)]
            rows = []
            for values in zip(*args, strict=True):
                try:
                    rows.append(fn(*values))
                except K.InputTooLarge:
                    rows.append({"error": "input_too_large"})
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], *(pa.array([r.get(f.name) for r in rows], f.type) for f in kinds)], names=[*keep, *names])

    return df.select(*keep, *(c.alias(f"_in{i}") for i, c in enumerate(inputs))).mapInArrow(run, schema)


def _text(c) -> F.Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def parse_documents(df: DataFrame, text: str = "text", kind="plaintext", closed: bool = False) -> DataFrame:
    """Adds ``nodes`` and ``error``; ``kind``: a format's name, or a column of them; ``closed``: HTML entities without a semicolon stay text."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def one(t: str, k: str) -> dict:
        if len(t.encode()) > M.MAX_INPUT_BYTES:
            raise K.InputTooLarge
        return {"nodes": [n.row(i) for i, n in enumerate(K.parse(K.strip_pua(t), k, closed))]}

    return _mapped(df, [_text(text), kind], one, [T.StructField("nodes", M.NODES), T.StructField("error", T.StringType())])


def compress_nodes(df: DataFrame, nodes: str = "nodes", budget: int = 4096, current="current_tokens", fidelity: str = "semantic", stopwords=M.STOPWORDS) -> DataFrame:
    """Adds ``compressed``: one pass of the compressor at ``current`` tokens."""
    words = K.Stopwords(stopwords)

    def one(_: str, ns: list[dict], now: int) -> dict:
        return {"compressed": [n.row(i) for i, n in enumerate(K.compress([K.node_of(x) for x in ns or ()], budget, now, fidelity, words))]}

    return _mapped(df, [F.lit(""), F.col(nodes), F.col(current)], one, [T.StructField("compressed", M.NODES)])


def transpile(df: DataFrame, text: str = "text", kind="plaintext", fidelity: str = "semantic", budget: int | None = 4096, stopwords=M.STOPWORDS) -> DataFrame:
    """Adds ``content``, ``input_tok``, ``output_tok`` and ``error``: the whole pipeline for each row."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    words = K.Stopwords(stopwords)

    def one(t: str, k: str) -> dict:
        before = K.token_count(t)
        out = K.transpile(t, k, fidelity, budget, words)
        return {"content": out, "input_tok": before, "output_tok": K.token_count(out)}

    fields = [T.StructField("content", T.StringType()), T.StructField("input_tok", T.LongType()), T.StructField("output_tok", T.LongType()), T.StructField("error", T.StringType())]
    return _mapped(df, [_text(text), kind], one, fields)


def stream_chunks(df: DataFrame, text: str = "text", kind="plaintext", fidelity: str = "semantic", budget: int = 4096, terms: dict[str, str] | None = None, strict_final: bool = False) -> DataFrame:
    """A row for each chunk of each document, in ``sequence``; an oversized document gives one row with its error."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    fields = [T.StructField("chunks", M.CHUNKS), T.StructField("error", T.StringType())]
    made = _mapped(df, [_text(text), kind], lambda t, k: {"chunks": K.stream(t, k, fidelity, budget, terms, strict_final)}, fields)
    return made.select("*", F.explode_outer("chunks").alias("chunk")).select(*df.columns, "chunk.*", "error")


def first_sentences(df: DataFrame, text: str = "text", out: str = "first_sentence") -> DataFrame:
    return _mapped(df, [_text(text)], lambda t: {out: K.first_sentence(t)}, [T.StructField(out, T.StringType())])


def encode_texts(df: DataFrame, text: str, terms: str, out: str = "encoded") -> DataFrame:
    """``terms``: array of structs of sym and term. Leftmost-longest replacement of terms by their symbols."""
    return _mapped(df, [_text(text), F.col(terms)], lambda t, ds: {out: K.encode(t, {d["term"]: d["sym"] for d in ds or ()})}, [T.StructField(out, T.StringType())])


def decode_texts(df: DataFrame, text: str, terms: str, out: str = "decoded") -> DataFrame:
    return _mapped(df, [_text(text), F.col(terms)], lambda t, ds: {out: K.SymbolDict({d["term"]: d["sym"] for d in ds or ()}).decode(t)}, [T.StructField(out, T.StringType())])


def bpe_tokens(df: DataFrame, text: str = "text", ranks: str | None = None, pattern: str | None = None, out: str = "bpe_tok") -> DataFrame:
    """Adds byte-pair tokens by a rank file (at least 1); null without a rank file, as where that feature is not built in."""
    if not ranks:
        return df.withColumn(out, F.lit(None).cast("long"))

    def count(t: str) -> dict:
        return {out: max(1, len(_encoding(ranks, pattern).encode_ordinary(t)))}

    return _mapped(df, [_text(text)], count, [T.StructField(out, T.LongType())])


_encodings: dict = {}


def _encoding(ranks: str, pattern: str):
    if ranks not in _encodings:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[ranks] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[ranks]
