"""Names, limits and schemas of the document model: documents are rows, nodes a nested array in document order."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the format.
MAX_INPUT_BYTES = 10 * 1024 * 1024
PUA_FIRST, PUA_LAST = 0xE000, 0xF8FF
PUA_TOKEN_COST = 1
FORMATS = ("plaintext", "markdown", "html")
FIDELITIES = ("lossless", "semantic", "compressed")
MIN_FREQ, MAX_TERMS = 3, 50
PRUNE_SHARE, MOST_PRUNED = 0.20, 0.40
NEAR_DUPLICATE = 0.85
STAGE_LIMITS = (0.60, 0.80, 0.95)
CHANNEL_SIZE = 32
STREAM_SWITCH = 0.80

NODE = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("kind", T.StringType()),  # header para table code list metadata
        T.StructField("level", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("importance", T.FloatType()),
        T.StructField("headers", T.ArrayType(T.StringType())),
        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("lang", T.StringType()),
        T.StructField("ordered", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("key", T.StringType()),
    ]
)
NODES = T.ArrayType(NODE)
CHUNK = T.StructType([T.StructField("sequence", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("token_count", T.IntegerType()), T.StructField("is_final", T.BooleanType())])
CHUNKS = T.ArrayType(CHUNK)

USAGE_LOG = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("ts", "agent", "project", "file", "format", "fidelity")]
    + [T.StructField("input_tok", T.LongType()), T.StructField("output_tok", T.LongType()), T.StructField("reduction_pct", T.DoubleType()), T.StructField("saved", T.LongType())]
)
BENCH_LOG = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("ts", "run_id", "file", "format")]
    + [T.StructField(n, T.LongType()) for n in ("input_bytes", "input_tok", "semantic_tok", "compressed_tok", "lossless_tok")]
    + [T.StructField(n, T.DoubleType()) for n in ("sem_pct", "cmp_pct", "los_pct")]
    + [T.StructField(n, T.LongType()) for n in ("semantic_us", "compressed_us")]
    + [T.StructField(n, T.DoubleType()) for n in ("tok_per_ms", "word_coverage")]
)

# Code points that make up 2, 3 or 1 characters of a token; all others 4.
TWO_PER_TOKEN = (
    (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xAC00, 0xD7FF), (0x1100, 0x11FF), (0xA960, 0xA97F),
    (0x20000, 0x2A6DF), (0x2A700, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x30000, 0x323AF), (0x1F300, 0x1F9FF), (0x1FA00, 0x1FAFF),
)
THREE_PER_TOKEN = ((0x0600, 0x06FF), (0x0750, 0x077F), (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0B80, 0x0BFF), (0x0E00, 0x0E7F))

# Stopwords that weigh more than one token.
STOPWORDS = (
    "about", "after", "before", "between", "through", "during", "within", "without", "being", "would", "shall", "should", "might", "could", "these", "those",
    "그리고", "하지만", "그러나", "따라서", "그래서", "그런데", "게다가", "왜냐하면", "그러므로", "이처럼", "이렇게",
)

# Abbreviations whose period ends no sentence.
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof sr jr vs etc eg ie fig eq no vol us am pm gen sgt capt lt col inc ltd corp dept est govt assn al approx appt apt ave blvd cot def div fx min max misc "
    "mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec st nd rd th".split()
)
# Sentence ends other than the period.
SENTENCE_ENDS = "!?。！？।॥۔።᙮꓿︒﹒．"

# Elements whose tags become a space.
BLOCK_ELEMENTS = "p div section article aside header footer main nav h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption table thead tbody tfoot tr th td br hr".split()

# Languages by comment mark.
SLASH_LANGS = "rust go java javascript js typescript ts c cpp csharp cs swift kotlin scala".split()
HASH_LANGS = "python py ruby rb perl pl r shell bash sh yaml yml toml".split()
DASH_LANGS = ("sql",)
