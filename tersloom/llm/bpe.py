"""BPE encoding and decoding by content-defined chunk reuse.

Rolling-hash chunks that occur more than once in the corpus are encoded once; a document is put together from their ids, and what lies
around each chunk join is encoded anew. A chunk gives only its core, from its first to its last white space: the tokenizer's words never span
ASCII white space, so the re-encoded stretch between two cores agrees exactly with the whole text's encoding.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersloom.llm.common import _BYTES, mix, powers, small_batches, table, texts_of

#: Mean bytes of a chunk, and bytes that the rolling hash sees.
MEAN_CHUNK = 256
WINDOW = 32
#: Blocks of 256 bits of the broadcast filter of shared chunks (2 MB). If it fills up at some scale, more chunks count as shared; results stay.
BLOCKS = 1 << 16
#: Words of one generation of a worker's cache; there are two.
CACHE_WORDS = 200_000


# letters of ASCII and Latin-1 in UTF-8, with a comma or stop at the end
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[.,]?")


class Encoder:
    """The library's ids for any bytes, by white-space-delimited words; a bounded cache holds words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        size = self.t.get_vocab_size(with_added_tokens=True)
        self.names = [(self.t.id_to_token(i) or "").encode() for i in range(size)]
        rules = json.loads(self.t.to_str())
        suffix = (rules["model"].get("end_of_word_suffix") or "\0").encode()
        self.is_end = np.array([x.endswith(suffix) for x in self.names])
        self.lower = "Lowercase" in json.dumps(rules.get("normalizer"))
        if not self.lower:
            self.words = bytes.split  # type: ignore[method-assign]

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        """White-space-delimited words; A-Z in lower case, as the tokenizer has them, unless that could make a special token's name."""
        return text.split() if b"<|" in text else text.lower().split()

    def learn(self, texts: list[bytes]) -> None:
        """Encode the words of some texts that the cache lacks. When it is full, the words of the last generation stay if they come again."""
        every = set().union(*map(self.words, texts))
        need = every - self.cache.keys()
        if len(self.cache) + len(need) > CACHE_WORDS:
            self.old, self.cache = self.cache, {}
            need = every
        if self.old:
            for w in need & self.old.keys():
                self.cache[w] = self.old[w]
            need = need - self.cache.keys()
        plain = list(filter(_PLAIN.fullmatch, need)) if self.lower and self.is_end.any() else []
        for i in range(0, len(plain), 1024):
            part = plain[i : i + 1024]
            ids = np.array(self.t.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            # a run of letters ends with one word-end token, and so does a comma or stop behind it
            upto = np.cumsum([1 + (w[-1] < 97) for w in part])
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == upto[-1] and ends[-1] == len(ids):
                raw, cut = ids.tobytes(), [0, *(4 * ends[upto - 1]).tolist()]
                self.cache.update(zip(part, (raw[u:v] for u, v in zip(cut, cut[1:], strict=False)), strict=True))
        rest = list(need - self.cache.keys())
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for w, e in zip(part, self.t.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a text whose words are known."""
        return b"".join(map(self.cache.__getitem__, self.words(text)))

    def decoded(self, ids: bytes) -> bytes:
        """What the library's decode(ids, skip_special_tokens=False) gives: no decoder is set, so tokens joined by blanks."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Chunks:
    """Content-defined chunks of some texts: text i has chunks first[i] to first[i + 1], from start to end in buf, with 64-bit hashes."""

    def __init__(self, texts: list[bytes], mean: int = MEAN_CHUNK):
        joined = b"".join(texts)
        self.buf = buf = np.frombuffer(joined, np.uint8)
        n = len(buf)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.at = at
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * down[:n])])
            if n > WINDOW:
                h = mix((total[WINDOW:] - total[:-WINDOW]) * up[: n - WINDOW + 1])
                cut = np.flatnonzero((h & np.uint64(mean - 1)) == 0) + WINDOW
            else:
                cut = np.zeros(0, np.int64)
            # a window lies inside one text, and a cut before a character's first byte
            owner = np.searchsorted(at, cut, "right") - 1
            cut = cut[(cut - at[owner] >= WINDOW)]
            for _ in range(3):
                inside = cut[cut < n]
                cut = np.concatenate([inside + ((buf[inside] & 0xC0) == 0x80), cut[cut >= n]])
            edges = np.unique(np.concatenate([at, cut]))
            self.start, self.end = edges[:-1], edges[1:]
            self.hash = mix((total[self.end] - total[self.start]) * up[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, at)

    def core(self, k: int) -> tuple[int, int]:
        """From the first to the last white space of chunk k; empty if it has none."""
        b = self.buf[self.start[k] : self.end[k]]
        ws = np.flatnonzero((b == 32) | ((b >= 9) & (b <= 13)))
        return (int(self.start[k] + ws[0]), int(self.start[k] + ws[-1])) if len(ws) > 1 else (0, 0)


def in_filter(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether all eight bits of each hash are set in its block; words: blocks x 8 of 32 bits."""
    block = (h & np.uint64(len(words) - 1)).astype(np.int64)
    ok = np.ones(len(h), bool)
    for i in range(8):
        bit = ((h >> np.uint64(16 + 5 * i)) & np.uint64(31)).astype(np.uint32)
        ok &= (words[block, i] >> bit) & 1 == 1
    return ok


def chunk_filter(docs: DataFrame, blocks: int = BLOCKS) -> np.ndarray:
    """Blocked Bloom filter of the chunks that occur twice or more; counts cover all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            h, c = np.unique(Chunks(texts_of(b.column(0))).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    n = docs.select("text").mapInArrow(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1")
    bits = n.groupBy(F.expr(f"h & {blocks - 1}L").alias("block")).agg(*(F.expr(f"bit_or(shiftleft(1L, cast((shiftrightunsigned(h, {16 + 5 * i}) & 31L) as int)))").alias(f"w{i}") for i in range(8)))
    words = np.zeros((blocks, 8), np.uint32)
    for r in bits.toLocalIterator():  # at most `blocks` rows
        words[r[0]] = [r[i + 1] for i in range(8)]
    return words


_KEY = "binary"


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids as binary) for every row.

    1. Chunks are counted by hash; those seen twice or more go into a filter of fixed size that is broadcast to the workers.
    2. Texts of chunks that pass are gathered by a 128-bit key, one of each, and encoded once.
    3. Documents without such a chunk are encoded where they are. The others move once, one of each text, and take their chunks' ids by key;
       a chunk that many texts share is a small row on the skewed side of a join that adaptive execution can split.
    Null text: as empty, no token. Equal texts are put together once; repeated rows all come back; null ids stay null; an empty table gives no rows;
    other columns are ignored; a text of any length is encoded whole.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    keyed = d.select("doc_id", F.unhex(F.md5("text")).alias("tkey"), "text")
    shared = spark.sparkContext.broadcast(chunk_filter(d, blocks))
    outs = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")

    def finished(e: Encoder, ids: bytes) -> tuple:
        row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decoded(ids)).hexdigest())
        return (*row, ids) if with_ids else row

    def columns(rows: list[tuple]) -> list[pa.Array]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]
        return [pa.array([r[i] for r in rows], kinds[i]) for i in range(4 if with_ids else 3)]

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def texts_of_shared(batches):
        seen: set[bytes] = set()
        for b in small_batches(batches, "text"):
            c = Chunks(texts_of(b.column(0)))
            rows = {}
            for k in np.flatnonzero(in_filter(c.hash, shared.value)).tolist():
                a, z = c.core(k)
                if z > a:
                    body = c.buf[a:z].tobytes()
                    key = hashlib.blake2b(body, digest_size=16).digest()
                    if key not in seen:
                        rows[key] = body
            seen.update(rows)
            if len(seen) > 50_000:  # a key that comes again is dropped in the aggregation
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.binary())], names=["key", "body"])

    def encode_chunks(batches):
        e = encoder(path)
        for b in small_batches(batches, "body"):
            texts = b.column(1).to_pylist()
            e.learn(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.ids(x) for x in texts], pa.binary())], names=["key", "ids"])

    def alone(batches):
        e = encoder(path)
        for b in small_batches(batches, "text"):
            texts = texts_of(b.column(1))
            c = Chunks(texts)
            hit = np.concatenate([[0], np.cumsum(in_filter(c.hash, shared.value))])
            mine = [i for i in range(len(texts)) if hit[c.first[i + 1]] == hit[c.first[i]]]
            e.learn([texts[i] for i in mine])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(mine, pa.int64())), *columns([finished(e, e.ids(texts[i])) for i in mine])], names=["doc_id", *names])

    def with_shared(batches):
        for b in small_batches(batches, "text"):
            c = Chunks(texts_of(b.column(1)))
            hit = np.concatenate([[0], np.cumsum(in_filter(c.hash, shared.value))])
            yield b.filter(pa.array(hit[c.first[1:]] > hit[c.first[:-1]]))

    def places(batches):
        for b in small_batches(batches, "text"):
            texts, tkeys = texts_of(b.column(1)), b.column(0).to_pylist()
            c = Chunks(texts)
            rows: list[tuple] = []
            owner = np.searchsorted(c.first, np.arange(len(c.hash)), "right") - 1
            for k in np.flatnonzero(in_filter(c.hash, shared.value)).tolist():
                a, z = c.core(k)
                if z > a:
                    i = owner[k]
                    rows.append((tkeys[i], a - int(c.at[i]), z - int(c.at[i]), hashlib.blake2b(c.buf[a:z].tobytes(), digest_size=16).digest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.binary(), pa.int32(), pa.int32(), pa.binary()))], names=["tkey", "a", "z", "key"])

    def put_together(batches):
        e = encoder(path)
        for b in small_batches(batches, "text"):
            todo = []
            for body, got in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                known, between, upto = [], [], 0
                for p in got or ():  # sorted by place
                    between.append(body[upto : p["a"]])
                    known.append(p["ids"])
                    upto = p["z"]
                todo.append(([*between, body[upto:]], [*known, b""]))
            e.learn([x for between, _ in todo for x in between])
            # re-encoded from core to core
            rows = [finished(e, b"".join([y for x, ids in zip(between, known, strict=True) for y in (e.ids(x), ids)])) for between, known in todo]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns(rows)], names=["tkey", *names])

    known = d.select("text").mapInArrow(texts_of_shared, "key binary, body binary").dropDuplicates(["key"]).mapInArrow(encode_chunks, "key binary, ids binary")
    once = keyed.select("tkey", "text").mapInArrow(with_shared, "tkey binary, text string").dropDuplicates(["tkey"])
    found = once.mapInArrow(places, "tkey binary, a int, z int, key binary").join(known, "key").groupBy("tkey").agg(F.array_sort(F.collect_list(F.struct("a", "z", "ids"))).alias("got"))
    done = once.join(found, "tkey", "left").select("tkey", "text", "got").mapInArrow(put_together, f"tkey binary, {outs}")
    direct = d.mapInArrow(alone, f"doc_id {kind}, {outs}")
    return direct.unionByName(keyed.select("doc_id", "tkey").join(done, "tkey").select("doc_id", *names))


def decode(ids: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded text of little-endian 32-bit ids; null stays null."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        e = encoder(path)
        for b in batches:
            got = [None if x is None else e.decoded(x) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary()).cast(pa.string())], names=[*b.schema.names, out])

    return ids.mapInArrow(run, StructType([*ids.schema.fields, StructField(out, StringType())]))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary())
