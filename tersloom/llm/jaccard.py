"""N-gram Jaccard join with vertical partitioning: the global n-gram order is cut into fragments, partial overlaps are counted in each, and summed per pair.

A gram is a 64-bit key: its frequency class above a hash. Keys in rising order put rare grams first, so a document's prefix holds its rarest.
Frequency classes come from counts over all documents: words by a fixed number of cells, and grams that a part of the corpus repeats.
Any order gives the same links; this one keeps frequent passages and common words out of the prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersloom.llm.common import Words, connected_components, dropped, mix, small_batches, table, texts_of, written
from tersloom.llm.urls import bloom_filter, passing

#: Vertical fragments of the order; equal parts of every frequency class.
FRAGMENTS = 8
#: Cells of the word counts, and the least share of words (documents) from which a cell (gram) counts as frequent: both bound what is broadcast.
CELLS = 1 << 18
WORD_SHARE = 1e-5
GRAM_SHARE = 1 / 500
#: Members of a large block that are compared in one task: so many that the pivots did not hold, against so many of all.
BLOCK_FEW, BLOCK_ALL = 256, 1024
#: Pairs in doubt for each member of a task up to which they are sent as pairs.
DENSE = 4
_U = np.uint64
_MUL = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for the n words from each word on, and how many of them each text has: those of text i begin at w.first[i]. A text of fewer words has one, of all its words."""
    size = np.diff(w.first)
    h = np.concatenate([w.hash, np.zeros(n, np.uint64)])
    with np.errstate(over="ignore"):
        out = np.full(len(w.hash), _U(n))
        for j in range(n):
            out = mix(out * _MUL[j % 5] + h[j : len(h) - n + j])
        for i in np.flatnonzero((size > 0) & (size < n)).tolist():
            one = np.full(1, _U(size[i]))
            for x in w.hash[w.first[i] : w.first[i + 1]]:
                one = mix(one * _MUL[0] + x)
            out[w.first[i]] = one[0]
    return out, np.where(size >= n, size - n + 1, np.minimum(size, 1))


class Order:
    """Frequency classes: 0 to 63 by the words' cells, and above them by the count of a frequent gram."""

    def __init__(self, cells: np.ndarray, frequent: np.ndarray, counts: np.ndarray):
        self.cells = cells  # uint8: log2 class of each cell, 0 for rare
        at = np.argsort(frequent)
        self.frequent, self.cls = frequent[at], (64 + np.minimum(63, np.log2(np.maximum(counts[at], 1)) * 2)).astype(np.uint64)

    def keys(self, w: Words, n: int) -> Iterator[np.ndarray]:
        """Sorted distinct keys of each text."""
        g, size = shingles(w, n)
        c = np.concatenate([self.cells[(w.hash >> _U(40)) & _U(CELLS - 1)], np.zeros(n, np.uint8)]).astype(np.uint64)
        cls = np.minimum(sum(c[j : len(c) - n + j] for j in range(n)), _U(63))
        short = np.diff(w.first)
        for i in np.flatnonzero((short > 0) & (short < n)).tolist():  # their own words only, not those of the next text
            cls[w.first[i]] = min(63, int(c[w.first[i] : w.first[i + 1]].sum()))
        if len(self.frequent) and len(g):
            at = np.minimum(np.searchsorted(self.frequent, g), len(self.frequent) - 1)
            cls = np.where(self.frequent[at] == g, self.cls[at], cls)
        k = (cls << _U(56)) | (g >> _U(8))
        for i, m in enumerate(size.tolist()):
            yield np.unique(k[w.first[i] : w.first[i] + m])


def learned_order(docs: DataFrame, n: int) -> Order:
    """Counts over all documents. Each task sends the cells and grams that are frequent in one of its stretches of documents; sums below the shares
    are dropped, so that at most 1 / WORD_SHARE cells and (grams of a document) / GRAM_SHARE grams reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        cells, words, rows, size = np.zeros(CELLS, np.int64), 0, 0, 0

        def flush():
            nonlocal cells, words, rows, size
            out = []
            k = np.flatnonzero(cells >= max(2, WORD_SHARE * words / 2))
            out.append((np.zeros(len(k), np.int32), k.astype(np.int64), cells[k]))
            if held:
                g, c = np.unique(np.concatenate(held), return_counts=True)
                k = c >= max(3, GRAM_SHARE * rows / 2)
                out.append((np.ones(int(k.sum()), np.int32), g[k].view(np.int64), c[k]))
            out.append((np.full(2, 2, np.int32), np.array([0, 1]), np.array([words, rows])))
            held.clear()
            cells, words, rows, size = np.zeros(CELLS, np.int64), 0, 0, 0
            for kind, key, count in out:
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(count)], names=["kind", "key", "n"])

        for b in small_batches(batches, "text"):
            w = Words(texts_of(b.column(0)))
            cells += np.bincount(((w.hash >> _U(40)) & _U(CELLS - 1)).astype(np.int64), minlength=CELLS)
            words += len(w.hash)
            rows += b.num_rows
            g, m = shingles(w, n)
            place = np.arange(len(g)) - np.repeat(w.first[:-1], np.diff(w.first))
            held.append(g[place < np.repeat(m, np.diff(w.first))])
            size += len(g)
            if size > 2_000_000:
                yield from flush()
        yield from flush()

    sums = written(docs.select("text").mapInArrow(counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words, rows = (sums.filter(f"kind = 2 and key = {k}").select("n").first() or [0] for k in (0, 1))
    keep = sums.filter(f"(kind = 0 and n >= {WORD_SHARE * words[0]!r}) or (kind = 1 and n >= {GRAM_SHARE * rows[0] / 4!r})").toArrow()
    dropped(sums)
    kind, key, count = (np.asarray(keep.column(c)) for c in ("kind", "key", "n"))
    cells = np.zeros(CELLS, np.uint8)
    m = kind == 0
    cells[key[m]] = np.clip(np.log2(np.maximum(count[m] / max(1e-9, WORD_SHARE * words[0]), 1)) + 1, 1, 15).astype(np.uint8)
    m = kind == 1
    return Order(cells, key[m].astype(np.int64).view(np.uint64), count[m])


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def fragment_of(keys: np.ndarray) -> np.ndarray:
    return (((keys & _U((1 << 56) - 1)) >> _U(40)) * _U(FRAGMENTS) >> _U(16)).astype(np.int64)


def fine_counts(keys: np.ndarray) -> bytes:
    """How many keys lie in each of F finer fragments, four to eight on average, a byte each; F is a power of two. The sum of the smaller counts bounds
    the overlap of two sets from above. Empty if a count would not fit: such a set is never ruled out."""
    bits = min(16, max(0, len(keys).bit_length() - 3))
    n = np.bincount(((keys & _U((1 << 56) - 1)) >> _U(56 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64), minlength=1 << bits)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else b""


#: Coarse fragments whose key counts ride on every row of a block, a byte each: 255 stands for 255 or more.
COARSE = 16


def coarse_counts(keys: np.ndarray) -> list[int]:
    """The counts in two 64-bit integers."""
    n = np.bincount(((keys & _U((1 << 56) - 1)) >> _U(52)).astype(np.int64), minlength=COARSE)
    return np.minimum(n, 255).astype(np.uint8).view(np.int64).tolist()


def coarse_bound(x: str, y: str) -> str:
    """SQL: upper bound of the overlap of two sets by their coarse counts q1 and q2; where both counts of a fragment are full it says nothing."""
    byte = lambda r, i: f"(shiftrightunsigned({r}q{1 + i // 8}, {8 * (i % 8)}) & 255L)"
    least = " + ".join(f"if({byte(x, i)} = 255 and {byte(y, i)} = 255, {x}n, least({byte(x, i)}, {byte(y, i)}))" for i in range(COARSE))
    return f"({least})"


def most_overlap(a: bytes, b: bytes) -> int | None:
    """Upper bound of the overlap; None: unknown."""
    if not a or not b:
        return None
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(1)
    return int(np.minimum(x, y).sum())


def joined(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row: the smallest doc_id reachable by links of a Jaccard similarity of ``percent`` or more.

    1. Equal sets are one class (128-bit fingerprint); all later work is on classes, named by 64 bits of it, so copies never meet in pairs, and rows that
       share a doc_id but not a text are classes each.
    2. Classes meet in blocks by the grams of their prefixes. In each block every member is compared with two pivots: rows by member, not by pair.
       Counts in coarse fragments, which ride on the rows, and in fine ones rule out most pairs (upper bounds, so none that links). For the others the
       sets are fetched: partial overlaps are counted by fragment and summed per pair.
    3. What pivots link is one component. Only blocks whose members are still apart go on: members outside a block's largest component meet all
       others of another component in tasks of at most BLOCK_FEW by BLOCK_ALL members by fine counts. A task whose pairs in doubt are few beside its
       members sends those pairs, which are compared once, as above; a denser one sends its members, whose partial overlaps are then counted inside
       one task. No link is lost and no partner capped: two members of one block are compared, or both are in one component.
    Words are lower-cased in A-Z only. Fewer words than n: one shingle. No words, null or empty text: n_shingles 0, component is the own doc_id.
    Repeated rows are copies; rows that share a doc_id but not a text are documents each, with their own links; a null doc_id joins no links and has a null
    component; an empty table gives no rows; texts of any length are taken whole; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = spark.sparkContext.broadcast(learned_order(d, n))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in small_batches(batches, "text"):
            size, prints, heads, fine, q1, q2 = [], [], [], [], [], []
            for i, k in zip(b.column(0).to_pylist(), order.value.keys(Words(texts_of(b.column(1))), n), strict=True):
                size.append(len(k))
                prints.append(hashlib.blake2b(k.tobytes(), digest_size=16).digest() if len(k) else None)
                # rows that a task meets again bring no prefix again
                new = len(k) and i is not None and (i, prints[-1]) not in seen
                heads.append(k[: prefix_length(len(k), percent)].view(np.int64) if new else None)
                fine.append(fine_counts(k) if new else None)
                x, y = coarse_counts(k)
                q1.append(x)
                q2.append(y)
                if new:
                    seen.add((i, prints[-1]))
            if len(seen) > 50_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(fine, pa.binary()), pa.array(q1, pa.int64()), pa.array(q2, pa.int64())], names=["doc_id", "n", "fp", "head", "fine", "q1", "q2"])

    sets = written(d.mapInArrow(prefixes, "doc_id long, n long, fp binary, head array<long>, fine binary, q1 long, q2 long"), "sets")
    classes = written(sets.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", "first", F.xxhash64("fp").alias("rep")), "classes")
    # one row of each class carries the prefix on; a copy that passes the filter of fixed size by chance is the same node, so no exact join is needed
    own = sets.filter("head is not null").withColumn("row", F.xxhash64("doc_id", "fp"))
    own = passing(own, "row", bloom_filter(classes.select(F.xxhash64("first", "fp").alias("row")), "row")).filter("maybe_listed").withColumn("rep", F.xxhash64("fp"))
    every = own.select("rep", "n", "q1", "q2", F.explode("head").alias("key"))
    shared = written(every.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    member = passing(every, "key", bloom_filter(shared, "key")).filter("maybe_listed").drop("maybe_listed").join(shared, "key")
    member = written(member.select("key", "rep", "n", "q1", "q2", "m"), "members")
    fine = written(own.select("rep", "fine").dropDuplicates(["rep"]), "fine")
    dropped(shared)
    slim = written(sets.select("doc_id", "n", "fp"), "slim")
    dropped(sets)
    sets = slim

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in small_batches(batches, "text"):
            prints, frag, packed = [], [], []
            for k in order.value.keys(Words(texts_of(b.column(0))), n):
                fp = hashlib.blake2b(k.tobytes(), digest_size=16).digest()
                if fp in seen:
                    continue
                seen.add(fp)
                f = fragment_of(k)
                at = np.argsort(f, kind="stable")
                k, f = k[at], f[at]
                cut = np.searchsorted(f, np.arange(FRAGMENTS + 1))
                for j in range(FRAGMENTS):
                    if cut[j + 1] > cut[j]:
                        prints.append(fp)
                        frag.append(j)
                        packed.append(k[cut[j] : cut[j + 1]].tobytes())
            if len(seen) > 50_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(frag, pa.int32()), pa.array(packed, pa.binary())], names=["fp", "frag", "seg"])

    def segments_of(ids: DataFrame, name: str) -> DataFrame:
        """The sets of some classes, by fragment; texts that a filter of fixed size rules out never move."""
        ids = written(classes.join(ids, "rep", "left_semi").select("first"), "ids")
        maybe = passing(d.filter("doc_id is not null"), "doc_id", bloom_filter(ids, "first")).filter("maybe_listed").select("text")
        # a text that passes by chance gives sets that no pair asks for; moving all texts for an exact join would cost more
        out = written(maybe.mapInArrow(segments, "fp binary, frag int, seg binary").select(F.xxhash64("fp").alias("rep"), "frag", "seg"), name)
        dropped(ids)
        return out

    pairs = written(not_ruled_out(star_pairs(member, percent), fine, percent), "pairs")
    segs = segments_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "segments")
    links = written(overlaps(pairs, segs, percent), "links")
    dropped(segs)
    component = connected_components(links)
    doubts = written(in_doubt(apart(member, component), fine, percent), "doubts")
    for x in (component, member, fine):
        dropped(x)
    # blocks share most of their pairs: each is compared once
    again = doubts.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"), F.col("n").alias("na"), F.col("other_n").alias("nb")).distinct().join(pairs, ["a", "b"], "left_anti")
    again = written(again.select("a", "b", "na", "nb"), "again")
    dense = doubts.filter("other is null").select("key", "f", "g", "asks", "rep", "n", "comp")
    segs = segments_of(again.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(dense.select("rep")).distinct(), "segments")
    more = written(overlaps(again, segs, percent).unionByName(exhausted(dense, segs, percent)), "more")
    component = connected_components(links.unionByName(more))
    for x in (pairs, links, doubts, again, segs, more):
        dropped(x)
    linked = written(classes.join(component.select(F.col("node").alias("rep"), "component"), "rep").select("fp", "first", "component"), "linked")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = classes.select("fp", "first").join(linked.join(least, "component").select("fp", "least"), "fp", "left").select("fp", "first", F.coalesce("least", "first").alias("component"))
    out = sets.select("doc_id", "n", "fp").join(named, "fp", "left")
    some = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.coalesce("component", "doc_id")).alias("component_id"), F.when(some, F.coalesce("first", "doc_id")).alias("class_id"))


def _size_ok(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def star_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): each member with its block's two pivots, those of the smallest and the largest hash, unless sizes or coarse counts rule the pair out."""
    row = F.struct(F.xxhash64("key", "rep").alias("h"), "rep", "n", "q1", "q2")
    ends = blocks.groupBy("key").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    j = blocks.join(ends, "key").select(F.struct("rep", "n", "q1", "q2").alias("me"), F.explode(F.array("lo", "hi")).alias("it"))
    j = j.filter(f"me.rep <> it.rep and {_size_ok('me.n', 'it.n', percent)}")
    j = j.filter(f"{100 + percent} * {coarse_bound('me.', 'it.')} >= {percent} * (me.n + it.n)")
    first = F.col("me.rep") > F.col("it.rep")
    return j.select(F.greatest("me.rep", "it.rep").alias("a"), F.least("me.rep", "it.rep").alias("b"), F.when(first, F.col("me.n")).otherwise(F.col("it.n")).alias("na"), F.when(first, F.col("it.n")).otherwise(F.col("me.n")).alias("nb")).distinct()


def not_ruled_out(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """The pairs whose fine counts leave room for the least overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = [(m := most_overlap(x, y)) is None or m >= least_overlap(p, q, percent) for x, y, p, q in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), na, nb, strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

    j = pairs.join(fine.select(F.col("rep").alias("a"), F.col("fine").alias("fa")), "a").join(fine.select(F.col("rep").alias("b"), F.col("fine").alias("fb")), "b")
    return j.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(run, "a long, b long, na long, nb long")


def overlaps(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that link: partial overlaps by fragment, summed per pair and held against the least overlap of both sizes."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(got, pa.int64())], names=["a", "b", "na", "nb", "frag", "part"])

    sa = segs.select(F.col("rep").alias("a"), "frag", F.col("seg").alias("seg_a"))
    sb = segs.select(F.col("rep").alias("b"), "frag", F.col("seg").alias("seg_b"))
    both = pairs.join(sa, "a").join(sb, ["b", "frag"]).select("a", "b", "na", "nb", "frag", "seg_a", "seg_b")
    parts = both.mapInArrow(partial, "a long, b long, na long, nb long, frag int, part long")
    # the largest of a fragment: tasks that meet the same set give its fragments more than once
    total = parts.groupBy("a", "b", "na", "nb", "frag").agg(F.max("part").alias("part")).groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return total.filter(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def apart(member: DataFrame, component: DataFrame) -> DataFrame:
    """The rows of blocks of four or more whose members are not all in one component, with their components. Blocks of two or three are done: their pivots were all their members."""
    c = member.filter("m > 3").join(component.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    mixed = c.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    return c.join(mixed, "key").select("key", "rep", "n", "m", "comp")


def _tasks(rows: DataFrame, fn, schema: str) -> DataFrame:
    """Runs ``fn`` on the rows (dicts) of each task (key, f, g); a task has at most about BLOCK_FEW asking and BLOCK_ALL other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        held, now = [], None
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out: list[tuple] = []
                for r in b.slice(i, 256).to_pylist():
                    at = (r["key"], r["f"], r["g"])
                    if at != now and held:
                        out += fn(held)
                        held = []
                    now = at
                    held.append(r)
                if out:
                    yield from send(out)
        if held:
            yield from send(fn(held))

    names = [x.split()[0] for x in schema.split(", ")]
    kind = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kind[x.split()[1]] for x in schema.split(", ")]

    def send(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    t = F.xxhash64("key", "f", "g")
    return rows.withColumn("t", t).repartition("t").sortWithinPartitions("t", "key", "f", "g", "asks").drop("t").mapInArrow(run, schema)


def in_doubt(blocks: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """What fine counts cannot keep apart: pairs (rep, n, other, other_n), or, of a task with more than DENSE pairs a member, its members (key, f, g, asks, rep, n, comp)."""
    per = blocks.groupBy("key", "comp").agg(F.count("*").alias("k"))
    main = per.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("m")).select("key", F.col("top.comp").alias("main"), F.col("m").alias("all"), (F.col("m") - F.col("top.k")).alias("few"))
    j = blocks.select("key", "rep", "n", "comp").join(main, "key").join(fine, "rep")
    j = j.withColumn("cf", F.ceil(F.col("few") / BLOCK_FEW).cast("int")).withColumn("ca", F.ceil(F.col("all") / BLOCK_ALL).cast("int"))
    h = F.xxhash64("rep", F.lit("block"))
    left = j.filter("comp <> main").select("key", "rep", "n", "comp", "fine", F.lit(True).alias("asks"), F.pmod(h, F.col("cf")).cast("int").alias("f"), F.explode(F.sequence(F.lit(0), F.col("ca") - 1)).alias("g"))
    right = j.select("key", "rep", "n", "comp", "fine", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("cf") - 1)).alias("f"), F.pmod(h, F.col("ca")).cast("int").alias("g"))

    def keep(rows: list[dict]) -> list[tuple]:
        asks, rest = [r for r in rows if r["asks"]], [r for r in rows if not r["asks"]]
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(rest):
            by_length.setdefault(len(r["fine"]), []).append(i)
        sizes, comps = np.array([r["n"] for r in rest], np.int64), np.array([r["comp"] for r in rest], np.int64)
        grid = {k: np.frombuffer(b"".join(rest[i]["fine"] for i in at), np.uint8).reshape(len(at), k) for k, at in by_length.items()}
        found: list[np.ndarray] = []
        for x in asks:
            ok = (comps != x["comp"]) & (100 * np.minimum(sizes, x["n"]) >= percent * np.maximum(sizes, x["n"]))
            mine = np.frombuffer(x["fine"], np.uint8)
            for k, at in by_length.items():
                at = np.array(at)
                if not ok[at].any() or not k or not len(mine):
                    continue
                m = min(k, len(mine))
                a, b = mine.reshape(m, -1).sum(1), grid[k].reshape(len(at), m, -1).sum(2)
                need = -(-percent * (x["n"] + sizes[at]) // (100 + percent))
                ok[at] &= np.minimum(a, b).sum(1) >= need
            found.append(np.flatnonzero(ok))
        if sum(map(len, found)) <= DENSE * len(rows):
            pairs = {(x, rest[i]["rep"]) if x > rest[i]["rep"] else (rest[i]["rep"], x): (r["n"], rest[i]["n"]) if x > rest[i]["rep"] else (rest[i]["n"], r["n"]) for r, at in zip(asks, found, strict=True) for x in (r["rep"],) for i in at.tolist()}
            return [(0, 0, 0, None, a, na, 0, b, nb) for (a, b), (na, nb) in pairs.items()]
        every = np.unique(np.concatenate(found))
        chosen = [x for x, at in zip(asks, found, strict=True) if len(at)] + [rest[i] for i in every.tolist()]
        return [(r["key"], r["f"], r["g"], r["asks"], r["rep"], r["n"], r["comp"], None, None) for r in chosen]

    return _tasks(left.unionByName(right), keep, "key long, f int, g int, asks boolean, rep long, n long, comp long, other long, other_n long")


def exhausted(doubts: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of different components in each task; a task gives at most a spanning forest of what it finds, so its rows are bounded by its members."""
    whole = segs.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("frag", "seg"))).alias("segs"))

    def compare(rows: list[dict]) -> list[tuple]:
        asks, rest = [r for r in rows if r["asks"]], [r for r in rows if not r["asks"]]
        comp = {r["rep"]: r["comp"] for r in rows}
        out = []
        if not asks or not rest:
            return out
        sizes = np.array([r["n"] for r in rest], np.int64)
        index, owner = [], []
        for f in range(FRAGMENTS):
            mine = [next((s["seg"] for s in r["segs"] if s["frag"] == f), b"") for r in rest]
            keys, who = np.frombuffer(b"".join(mine), np.uint64), np.repeat(np.arange(len(rest)), [len(x) // 8 for x in mine])
            at = np.argsort(keys, kind="stable")
            index.append(keys[at])
            owner.append(who[at])
        for x in asks:
            total = np.zeros(len(rest), np.int64)
            for f, seg in {s["frag"]: s["seg"] for s in x["segs"]}.items():  # partial overlaps with all others, by fragment
                k = np.frombuffer(seg, np.uint64)
                lo, hi = np.searchsorted(index[f], k, "left"), np.searchsorted(index[f], k, "right")
                spans = [owner[f][a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]
                if spans:
                    total += np.bincount(np.concatenate(spans), minlength=len(rest))
            for i in np.flatnonzero(100 * total >= percent * (x["n"] + sizes - total)).tolist():
                y = rest[i]
                if comp[x["rep"]] != comp[y["rep"]]:
                    out.append((max(x["rep"], y["rep"]), min(x["rep"], y["rep"])))
                    old, new = comp[x["rep"]], comp[y["rep"]]
                    comp = {r: new if c == old else c for r, c in comp.items()}
        return out

    return _tasks(doubts.join(whole, "rep"), compare, "a long, b long").distinct()


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each component: the smallest doc_id, and of rows that share it that of the smallest text. Texts without a word, and
    null ids, stay; an empty table gives no rows; further columns are carried along."""
    got = joined(docs, n, percent).filter("doc_id = component_id and n_shingles > 0").select(F.col("doc_id").alias("_id")).distinct()
    counts = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.filter(counts).join(got, F.col("doc_id") == F.col("_id"), "left_semi")
    kept = kept.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*docs.columns), F.col("text")).alias("_row")).select("_row.*")
    return kept.unionByName(docs.filter(~counts))
