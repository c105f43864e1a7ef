"""Line dedup: SimHash of normalised lines, pigeonhole blocks and MinHash planes, edit similarity, one occurrence kept of each connected group. [native]

Only DataFrame functions. A line's features are its distinct words: a separator or article that a line repeats would else outvote the rest. A line of
more than SKETCH distinct words is hashed by those of the smallest hashes, a sample that similar lines share; texts are compared whole. Word hashes are
added up in byte lanes of longs (eight sums for 56 bits), so a line is one aggregated row, and the majority of every bit is read off with a few integer
operations.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersloom.llm.common import connected_components, dropped, swept, table, written
from tersloom.llm.urls import bloom_filter, passing

#: Words that a line is hashed by, at most: the distinct ones with the smallest hashes. A byte lane counts to 127.
SKETCH = 64
#: Four blocks of 28 bits: lines whose hashes differ in at most three bits always share one.
BLOCKS, BLOCK_BITS = 4, 28
#: Minima of the words' hashes under this many squared orders (products with odd numbers), 12 bits of each; lines that share a fifth of them, along a line of the affine plane, meet.
PLANE, MINIMUM_BITS = 5, 12
_ORDERS = [int.from_bytes(hashlib.blake2b(b"%d" % i, digest_size=4).digest(), "big") >> 1 | 1 for i in range(PLANE**2)]
#: The SimHash blocks (0), and the plane's classes of parallel lines. Candidates are looked for in one group at a time, so that few rows are on disk at once.
BANDS = 1 + PLANE + 1
PASSES = [[0, 1, 2], [3, 4], [5, 6]]
#: Pairs that meet and differ in more bits than this are chance: unrelated lines differ in 56 on average, lines of a similarity of 0.8 in about 22.
MOST_BITS = 36
#: Least edit similarity: 1 - distance / longer length.
SIMILARITY = 0.8
#: Members of a block that one row of a split block's smaller side is compared with, about.
SPLIT = 2048
#: Salts of the join that finds the copies of a line: one line may be a third of all lines.
SALTS = 16
#: What tells a line: 176 bits of its words, and its length, which rules most chance pairs out before anything is fetched.
LINE = ["l1", "s1", "s2", "len"]
_ONES = 0x0001010101010101
_HIGH = 0x0080808080808080
_NO_ID = -(2**63)
_LOW = (1 << 32) - 1


def document_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(d, th): a document's id and its text's hash. A null id is the smallest one, and its hash differs from that of a document that has this id."""
    return F.coalesce(doc_id.cast("long"), F.lit(_NO_ID)), F.xxhash64(F.coalesce(text, F.lit("")), doc_id.isNull())


def exploded(docs: DataFrame, doc_id: str, text: str, asked: DataFrame | None = None) -> DataFrame:
    """d, th, line_no, norm of every line that has a word: norm is the line's words in lower case with one blank between them. ``asked``: only documents
    that pass a filter of these keys (column ``doc``).

    Case and white space are settled a document at a time; the pattern runs only where some white space is no single blank or line end."""
    d, th = document_key(F.col(doc_id), F.col(text))
    rows = docs.select(d.alias("d"), th.alias("th"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if asked is not None:
        rows = passing(rows.withColumn("doc", F.xxhash64("d", "th")), "doc", bloom_filter(asked, "doc")).filter("maybe_listed")
    rows = rows.select("d", "th", F.lower("t").alias("t"))
    other = reduce(lambda a, b: a | b, (F.contains("t", F.lit(x)) for x in ("  ", "\t", "\x0b", "\f", "\r")))
    rows = rows.select("d", "th", F.when(other, F.regexp_replace("t", r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col("t")).alias("t"))
    rows = rows.select("d", "th", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    return rows.select("d", "th", "line_no", F.trim("line").alias("norm")).filter("norm <> ''")


def packed(minima: list[Column]) -> list[Column]:
    """k0, k1 ...: the last bits of PLANE minima each."""
    low = (1 << MINIMUM_BITS) - 1
    return [reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(minima[PLANE * x + y].bitwiseAND(F.lit(low)).cast("long"), MINIMUM_BITS * y) for y in range(PLANE))).alias(f"k{x}") for x in range(PLANE)]


def simhashed(lines: DataFrame) -> DataFrame:
    """d, th, line_no, l1, l2 (128 bits of the normalised line), len (its characters), s1, s2 (56 bits each), k0 to k4 (minima of the words, see packed) of every line. Every row
    of ``lines`` is added up by itself, so a document that is given twice counts no word twice: its lines come out as equal rows."""
    words = F.slice(F.sort_array(F.array_distinct(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)))), 1, SKETCH)
    own = ["d", "th", "line_no", "l1", "l2", "len"]
    w = lines.select("d", "th", "line_no", F.xxhash64("norm").alias("l1"), F.xxhash64("norm", F.lit("2")).alias("l2"), F.length("norm").alias("len"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    w = w.select("row", *own, F.explode("words").alias("h1")).withColumn("h2", F.xxhash64("h1"))
    lanes = [F.sum(F.expr(f"shiftrightunsigned(h{k}, {i}) & {_ONES}L")).alias(f"a{k}{i}") for k in (1, 2) for i in range(8)]
    least = [F.min(F.expr(f"cast(((h1 & 2147483647L) * {c}L) & 2147483647L as int)")).alias(f"m{i}") for i, c in enumerate(_ORDERS)]
    sums = w.groupBy("row", *own).agg(F.count("*").alias("n"), *lanes, *least)

    def majority(k: int) -> Column:
        """Bit j is set if more than half of the words have it: lane count > n div 2."""
        return reduce(lambda x, y: x.bitwiseOR(y), (F.expr(f"shiftleft(shiftrightunsigned((a{k}{i} + (127 - n div 2) * {_ONES}L) & {_HIGH}L, 7), {i})") for i in range(8)))

    return sums.select(*own, majority(1).alias("s1"), majority(2).alias("s2"), *packed([F.col(f"m{i}") for i in range(len(_ORDERS))]))


def band_keys(band: int) -> list[Column]:
    """Band 0: block number and bits of the SimHash. Others: PLANE minima along each of a class of parallel lines of the plane."""
    if band == 0:
        low = (1 << BLOCK_BITS) - 1
        return [F.expr(f"(shiftrightunsigned(s{1 + i // 2}, {BLOCK_BITS * (i % 2)}) & {low}L) + {i << BLOCK_BITS}L") for i in range(BLOCKS)]
    if band == BANDS - 1:
        return [F.xxhash64(f"k{x}", F.lit(band * PLANE + x)) for x in range(PLANE)]
    low = (1 << MINIMUM_BITS) - 1
    at = lambda x, i: F.expr(f"shiftrightunsigned(k{x}, {MINIMUM_BITS * (((band - 1) * x + i) % PLANE)}) & {low}L")
    return [F.xxhash64(*(at(x, i) for x in range(PLANE)), F.lit(band * PLANE + i)) for i in range(PLANE)]


def blocks(lines: DataFrame, bands: list[int]) -> DataFrame:
    """key, x: a row for each line and block; x = (l1, s1, s2, len) tells a line."""
    return lines.select(F.struct(*LINE).alias("x"), F.explode(F.array(*(k for b in bands for k in band_keys(b)))).alias("key"))


def allowed(x: Column, y: Column) -> Column:
    """The largest edit distance of similar lines of these lengths."""
    return F.floor(F.greatest(x, y) * F.lit(round(1 - SIMILARITY, 9)) + F.lit(1e-9)).cast("int")


def bits_between(x: str, y: str) -> Column:
    return F.expr(f"bit_count({x}.s1 ^ {y}.s1) + bit_count({x}.s2 ^ {y}.s2)")


def may_be_similar(x: str, y: str) -> Column:
    """Few bits differ, and the lengths differ by no more than similar lines can."""
    n, m = F.col(f"{x}.len"), F.col(f"{y}.len")
    return (bits_between(x, y) <= MOST_BITS) & (F.abs(n - m) <= allowed(n, m))


def stars(distinct: DataFrame, bands: list[int], name: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: (x, y, bits), each member of a block with its pivot if they may be similar, and (key, n, x), the members of all blocks of three or
    more. A block's pivot is its smallest by a hash of block and line, so the blocks of one group of
    copies have different pivots: a line that one pivot is too far from is compared with others."""
    every = blocks(distinct, bands)
    crowded = written(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "crowded")
    # a filter of fixed size keeps rows of keys that are alone from moving; the exact join leaves out the rest
    member = passing(every, "key", bloom_filter(crowded, "key")).filter("maybe_listed").select("key", "x").join(crowded, "key")
    member = written(member.select("key", "n", "x"), f"members-{name}")
    dropped(crowded)
    pivot = member.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "x").alias("h"), "x")).alias("p")).select("key", F.col("p.x").alias("p"))
    near = member.join(pivot, "key").filter(F.expr("x <> p") & may_be_similar("x", "p")).select("x", F.col("p").alias("y"), bits_between("x", "p").alias("bits"))
    out = written(near.groupBy("x", "y").agg(F.min("bits").alias("bits")), f"stars-{name}")
    swept(distinct.sparkSession)
    return out, member


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, th, line_no of every line that repeats an earlier occurrence exactly (normalised) or nearly.

    1. Equal normalised lines fall together by hash with map-side partial results; a line in a third of all documents is one row then.
    2. Distinct lines meet by blocks of the SimHash and by minima of their words. In each block every member is compared with a pivot. Pairs that differ in
       few bits and whose lengths allow the similarity are verified by edit similarity on their texts, which are fetched through a broadcast Bloom filter of fixed size and an exact join: first
       each line's closest pivot, then the other pivots that this leaves in another component: of the pairs between two components one at first (see ``joined``).
    3. Members outside the largest component of a block meet all members of other components. Pairs within a component need no verdict, so a hot block of
       alike lines stays linear, and no pair that shares a block, differs in few bits and would join two components is missed. Pairs in which most words
       differ (a typo in every word) share no minima and meet by chance only.
    4. Of each component the line with the smallest first occurrence stays; lines without a link take part in no join.
    """
    hashed = written(simhashed(exploded(docs, doc_id, text)), "lines")
    first = F.min(F.struct("d", "th", "line_no")).alias("id")
    distinct = written(hashed.groupBy("l1", "l2").agg(F.count("*").alias("n"), F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.min("len").alias("len"), *(F.min(f"k{x}").alias(f"k{x}") for x in range(PLANE)), first), "distinct")
    found = [stars(distinct, bands, str(i)) for i, bands in enumerate(PASSES)]
    near = written(ordered(reduce(DataFrame.unionByName, (s for s, _ in found))).groupBy("x", "y").agg(F.min("bits").alias("bits")), "near")
    for s, _ in found:
        dropped(s)
    texts, ids = texts_of(near, distinct, docs, doc_id, text)
    # two lines may be each other's closest pivots
    either = near.select("x", "y", "bits").unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"), "bits"))
    closest = written(ordered(either.groupBy("x").agg(F.min(F.struct("bits", "y")).alias("best")).select("x", "best.y", "best.bits")).select("x", "y").distinct(), "closest")
    links = written(verified(closest, texts).select("x", "y"), "links")
    groups = connected_components(links, "x", "y")
    groups = joined(near.join(closest, ["x", "y"], "left_anti"), groups, texts)
    apart = written(between_blocks(reduce(DataFrame.unionByName, (m.filter("n > 2") for _, m in found)), groups), "apart")
    more = written(apart.join(near, ["x", "y"], "left_anti"), "more")
    nodes = ids
    for t in (texts, near, closest, links, apart, *(m for _, m in found)):
        dropped(t)
    if not more.isEmpty():
        texts, others = texts_of(more, distinct, docs, doc_id, text)
        groups = joined(more, groups, texts)
        nodes = ids.unionByName(others).dropDuplicates(["x"])
        dropped(texts)
    named_ids = written(groups.select(F.col("node").alias("x"), "component").join(nodes, "x"), "nodes")
    # of each component the first occurrence stays; told by ids, no two of which are equal, so no task holds a large component
    kept = named_ids.groupBy("component").agg(F.min("id").alias("id")).select("id")
    nearly = named_ids.select("id").join(kept, "id", "left_anti").select("id.*")
    copied = distinct.filter("n > 1").select("l1", "l2", "id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    exactly = hashed.withColumn("salt", F.pmod(F.xxhash64("d", "line_no"), F.lit(SALTS)).cast("int")).join(copied, ["l1", "l2", "salt"]).filter(F.struct("d", "th", "line_no") != F.col("id")).select("d", "th", "line_no")
    out = written(exactly.unionByName(nearly).distinct(), "dups")
    for t in (hashed, more, distinct, groups, named_ids, ids, *([others] if nodes is not ids else [])):
        dropped(t)
    return out


def joined(pairs: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """``groups`` (node, component) with the links among ``pairs`` (x, y, bits). One link joins two components, so of the pairs between two the one of the
    fewest bits is verified first, the others only if these are still apart then."""
    apart = written(between(pairs, groups), "open")
    best = written(apart.groupBy("cx", "cy").agg(F.min(F.struct("bits", "x", "y")).alias("best")).select("cx", "cy", "best.x", "best.y"), "best")
    links = written(verified(best, texts).select("cx", "cy"), "links")
    after = connected_components(links, "cx", "cy")
    rest = named(named(apart.join(best, ["x", "y"], "left_anti"), "cx", after, "dx"), "cy", after, "dy").filter("dx <> dy").select("x", "y", "cx", "cy")
    rest = written(rest, "rest")
    if not rest.isEmpty():
        dropped(after)
        after = connected_components(links.unionByName(verified(rest, texts).select("cx", "cy")), "cx", "cy")
    to = after.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = groups.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # what is in no group yet is a component of one line
    out = written(moved.unionByName(after.join(groups, "node", "left_anti").select("node", "component")), "groups")
    for t in (apart, best, links, rest, after, groups):
        dropped(t)
    return out


def named(rows: DataFrame, column: str, components: DataFrame, out: str) -> DataFrame:
    """Adds the component of a line; a line without a link is its own."""
    return rows.join(components.select(F.col("node").alias(column), F.col("component").alias(out)), column, "left").withColumn(out, F.coalesce(out, column))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"), "bits")


def between(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs (x, y, bits) of different components, and these: cx, cy, cx > cy."""
    apart = named(named(pairs, "x", components, "cx"), "y", components, "cy").filter("cx <> cy")
    return apart.select("x", "y", "bits", F.greatest("cx", "cy").alias("cx"), F.least("cx", "cy").alias("cy"))


def between_blocks(members: DataFrame, components: DataFrame) -> DataFrame:
    """(x, y), x > y: the members outside their block's largest component with all members of the block in other components that may be similar.
    A block is split by the hash of its members into a part for each SPLIT of them, and the asking members go to all parts: no task holds a hot block."""
    m = written(named(members, "x", components, "c"), "named")
    of = m.groupBy("key", "c").agg(F.count("*").alias("k"), F.max("n").alias("n")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.max("n").alias("n"))
    of = of.filter(F.col("top.k") < F.col("n")).select("key", F.col("top.c").alias("main"))
    m = m.join(of, "key")
    parts = F.expr(f"cast(n div {SPLIT} as int)")
    asking = m.filter("c <> main").select("key", "x", "c", "main", F.explode(F.sequence(F.lit(0), parts)).alias("part"))
    others = m.select("key", F.col("x").alias("y"), F.col("c").alias("cy"), F.pmod(F.xxhash64("x"), parts + 1).cast("int").alias("part"))
    # of two asking members the larger asks
    pairs = asking.join(others, ["key", "part"]).filter((F.col("c") != F.col("cy")) & may_be_similar("x", "y") & ((F.col("cy") == F.col("main")) | (F.col("x") > F.col("y"))))
    return ordered(pairs.select("x", "y", bits_between("x", "y").alias("bits"))).distinct()


def texts_of(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(x, id, norm), and (x, id): the first occurrence and the normal form of each distinct line in ``pairs``."""
    asked = pairs.select(F.explode(F.array("x", "y")).alias("x")).distinct()
    ids = written(distinct.select(F.struct(*LINE).alias("x"), "id").join(asked, "x").groupBy("x").agg(F.min("id").alias("id")), "ids")
    lines = exploded(docs, doc_id, text, ids.select(F.xxhash64("id.d", "id.th").alias("doc"))).withColumn("at", F.xxhash64("d", "th", "line_no"))
    maybe = passing(lines, "at", bloom_filter(ids.select(F.xxhash64("id.d", "id.th", "id.line_no").alias("at")), "at")).filter("maybe_listed")
    some = maybe.select(F.struct("d", "th", "line_no").alias("id"), "norm")
    out = written(some.join(ids, "id").select("x", "id", "norm").dropDuplicates(["x"]), "texts")
    return out, ids


#: Words of the pieces that lines of equal word counts are compared by.
PIECE = 4
#: Words of a shingle that is an anchor if it stands once in each of two lines.
ANCHOR = 3
#: Parts of the allowed distance that are tried first where there are no anchors: the distance's cost grows with its bound.
BOUNDS = (8, 3)
#: Lines whose length times the allowed distance is no more than this are compared at once: cutting them to pieces would cost more.
CELLS = 1 << 15


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: what reads them is not pushed through the generator, where it would compute them again."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def stretch(words: str, begin: str, end: str) -> str:
    """The text of some words in a row. ``slice`` would copy all words for each stretch, so they are picked one by one."""
    return f"array_join(transform(if({begin} < {end}, sequence({begin}, {end} - 1), cast(array() as array<int>)), q -> get({words}, q)), ' ')"


def apart(spans: str, bound: str = "allowed") -> str:
    """Sum of the distances of stretches (a0, a1, b0, b1) of va and vb, or a number above ``allowed``, as if one is beyond ``bound``. One side without a word lacks a blank, too."""
    d = f"levenshtein({stretch('va', 'p.a0', 'p.a1')}, {stretch('vb', 'p.b0', 'p.b1')}, {bound})"
    # -1, beyond the bound, becomes allowed + 1, written so that the distance is computed once
    return f"aggregate({spans}, 0, (s, p) -> if(s > allowed, s, s + if((p.a0 < p.a1) <> (p.b0 < p.b1), 1, 0) + pmod({d}, allowed + 2)))"


def longest(spans: str) -> str:
    """Sum of the lengths of the stretches' longer sides, which their distances do not exceed."""
    length = lambda v, x: f"aggregate(if(p.{x}0 < p.{x}1, sequence(p.{x}0, p.{x}1 - 1), cast(array() as array<int>)), 0, (n, q) -> n + length(get({v}, q)) + 1)"
    return f"aggregate({spans}, 0, (s, p) -> if(s > allowed, s, s + greatest({length('va', 'a')}, {length('vb', 'b')})))"


def trimmed(spans: str) -> str:
    """The stretches without the words that both sides begin and end with: a run of one word is an insertion then."""
    least = "least(p.a1 - p.a0, p.b1 - p.b0)"
    # the false one at the end stands behind all equal words
    equal = lambda most, a, b: f"cast(array_position(concat(transform(if({most} > 0, sequence(0, {most} - 1), cast(array() as array<int>)), q -> get(va, {a}) = get(vb, {b})), array(false)), false) - 1 as int)"
    ahead = f"transform({spans}, p -> struct(p.a0, p.a1, p.b0, p.b1, {equal(least, 'p.a0 + q', 'p.b0 + q')} as same))"
    begun = f"transform({ahead}, p -> struct(p.a0 + p.same as a0, p.a1, p.b0 + p.same as b0, p.b1))"
    behind = f"transform({begun}, p -> struct(p.a0, p.a1, p.b0, p.b1, {equal(least, 'p.a1 - 1 - q', 'p.b1 - 1 - q')} as same))"
    return f"transform({behind}, p -> struct(p.a0, p.a1 - p.same as a1, p.b0, p.b1 - p.same as b1))"


def anchors(j: DataFrame) -> DataFrame:
    """Adds spans: the stretches of va and vb between words of anchors that stand in the same order, without pairs of one equal word each; null where anchors
    are missing or stand in another order.

    Both sides' shingles, sorted together by hash, show those that stand once in each. A place that does not lie between those of its neighbours is a chance
    match. Stretches are compared by their texts, so equal hashes of unequal shingles do no harm. Places of both sides are packed in longs, which are
    sorted and told apart without comparing rows."""
    high, low = lambda e: f"shiftright({e}, 32)", lambda e: f"({e} & {_LOW}L)"
    # a shingle's hash, its side and its place in one long
    each = lambda v, side: f"transform({v}, (w, i) -> shiftleft(xxhash64(w, {', '.join(f'get({v}, i + {k})' for k in range(1, ANCHOR))}) & {(1 << 30) - 1}L, 33) + {side << 32}L + i)"
    j = once(j, both=F.expr(f"sort_array(concat({each('va', 0)}, {each('vb', 1)}))"))
    # of equal hashes the side 0 sorts before the side 1
    own = f"{high('e')} & 1 = 0 and {high('get(both, i + 1)')} = {high('e')} + 1 and not shiftright(get(both, i - 1), 33) <=> shiftright(e, 33) and not shiftright(get(both, i + 2), 33) <=> shiftright(e, 33)"
    found = f"filter(transform(both, (e, i) -> if({own}, shiftleft({low('e')}, 32) + {low('get(both, i + 1)')}, null)), e -> e is not null)"
    # the words of an anchor, and the place behind it
    places = f"flatten(transform({found}, e -> transform(sequence(0, {ANCHOR}), k -> shiftleft(least({high('e')} + k, size(va)), 32) + least({low('e')} + k, size(vb)))))"
    j = once(j, met=F.expr(f"sort_array(array_distinct({places}))")).drop("both")
    rising = lambda e, f: f"nvl({low(e)} <= {low(f)}, true)"
    j = once(j, kept=F.expr(f"filter(met, (e, i) -> {rising('get(met, i - 1)', 'e')} and {rising('e', 'get(met, i + 1)')})")).drop("met")
    ordered = f"size(kept) > 0 and forall(sequence(0, size(kept) - 1), i -> {rising('get(kept, i - 1)', 'get(kept, i)')})"
    j = once(j, cuts=F.expr(f"if({ordered}, concat(kept, array(shiftleft(cast(size(va) as bigint), 32) + size(vb))), null)")).drop("kept")
    last = "nvl(get(cuts, i - 1), 0L)"
    same = f"get(cuts, i) = {last} or (get(cuts, i) = {last} + {(1 << 32) + 1}L and get(va, cast({high(last)} as int)) = get(vb, cast({low(last)} as int)))"
    span = ", ".join(f"cast({part(e)} as int) as {v}{k}" for v, part in (("a", high), ("b", low)) for k, e in enumerate((last, "get(cuts, i)")))
    j = once(j, ends=F.expr(f"transform(filter(sequence(0, size(cuts) - 1), i -> not ({same})), i -> struct({span}))")).drop("cuts")
    return once(j, spans=F.expr(trimmed("ends"))).drop("ends")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """x, y, a, b (their first occurrences) and any other columns of the pairs whose normalised lines have an edit similarity of at least SIMILARITY.

    Lines that differ in some words of equal places are settled by these words, short lines are compared at once. Of others the words that both lines begin and end with are cut off, which changes no distance. What is left is no
    farther apart than its longer side is long, and no farther than the stretches between anchors (see ``anchors``) together, nor than the longer sides of
    these. Lines of equal word counts are no farther apart than their pieces of PIECE words together. What these bounds leave open takes the whole distance, whose cost is a length times a bound,
    so without anchors small bounds are tried first.
    """
    j = pairs.join(texts, "x").join(texts.select(F.col("x").alias("y"), F.col("id").alias("id2"), F.col("norm").alias("norm2")), "y")
    more = [c for c in pairs.columns if c not in ("x", "y")]
    j = j.select("x", "y", *more, "id", "id2", "norm", "norm2", allowed(F.length("norm"), F.length("norm2")).alias("allowed")).filter(F.abs(F.length("norm") - F.length("norm2")) <= F.col("allowed"))
    j = once(j, brief=F.expr(f"cast(greatest(length(norm), length(norm2)) as long) * allowed <= {CELLS}"))
    # word by word: lines of equal word counts of which some words were exchanged need no more than the distances of these
    j = once(j, wa=F.split("norm", " "), wb=F.split("norm2", " "))
    by_words = "aggregate(zip_with(wa, wb, (v, w) -> if(v = w, 0, levenshtein(v, w))), 0, (n, d) -> n + d)"
    unlike = "aggregate(zip_with(wa, wb, (v, w) -> if(v = w, 0, 1)), 0, (n, d) -> n + d)"
    j = once(j, by_words=F.expr(f"if(size(wa) <> size(wb) or {unlike} > allowed, false, {by_words} <= allowed)"))
    j = once(j, at_once=F.expr(f"if(by_words, true, if(brief, levenshtein(norm, norm2, allowed div {BOUNDS[0]}) >= 0 or levenshtein(norm, norm2, allowed) >= 0, null))")).filter("at_once is null or at_once")
    none = "cast(array() as array<string>)"
    j = once(j, ua=F.expr(f"if(at_once, {none}, wa)"), ub=F.expr(f"if(at_once, {none}, wb)")).drop("norm", "norm2", "wa", "wb", "by_words", "brief").withColumnsRenamed({"ua": "wa", "ub": "wb"})
    differ = lambda p, q: F.array_position(F.zip_with(p, q, lambda v, w: v.eqNullSafe(w)), F.lit(False)).cast("int")
    j = once(j, ahead=differ("wa", "wb"), behind=differ(F.reverse("wa"), F.reverse("wb")), shorter=F.least(F.size("wa"), F.size("wb")))
    j = once(j, head=F.expr("if(ahead = 0, shorter, ahead - 1)"))
    j = once(j, tail=F.expr("least(shorter - head, if(behind = 0, shorter, behind - 1))"))
    j = once(j, va=F.expr("slice(wa, head + 1, size(wa) - head - tail)"), vb=F.expr("slice(wb, head + 1, size(wb) - head - tail)")).drop("wa", "wb")
    j = once(j, ta=F.array_join("va", " "), tb=F.array_join("vb", " "))
    # a side of which nothing is left lacks the other's words and a blank
    j = once(j, seen=F.expr("""case when at_once then true when size(va) = 0 and size(vb) = 0 then true when size(va) = 0 or size(vb) = 0 then length(ta) + length(tb) < allowed
        when greatest(length(ta), length(tb)) <= allowed then true end"""))
    j = once(j, ua=F.expr(f"if(seen is null, va, {none})"), ub=F.expr(f"if(seen is null, vb, {none})")).drop("va", "vb").withColumnsRenamed({"ua": "va", "ub": "vb"})
    j = anchors(j)
    at = lambda i: f"cast(least({i} * {PIECE}, size(va)) as int)"
    pieces = f"transform(sequence(0, (size(va) - 1) div {PIECE}), i -> struct({at('i')} as a0, {at('(i + 1)')} as a1, {at('i')} as b0, {at('(i + 1)')} as b1))"
    tried = " ".join(f"when spans is null and levenshtein(ta, tb, allowed div {b}) >= 0 then true" for b in BOUNDS)
    similar = f"""case when seen is not null then seen when spans is not null and {longest('spans')} <= allowed then true
        when size(va) = size(vb) and {apart(pieces)} <= allowed then true when spans is not null and {apart('spans', f'allowed div {BOUNDS[0]}')} <= allowed then true
        when spans is not null and {apart('spans')} <= allowed then true {tried} else levenshtein(ta, tb, allowed) >= 0 end"""
    j = once(j, similar=F.expr(similar))
    return j.filter("similar").select("x", "y", *more, F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b"))


def line_decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines (lines with a word), n_removed, removed (line numbers from 0, ascending) for every row.

    Null and empty texts have no line. Lines without a word are never removed; a line of any length is compared whole. Rows that repeat an id and a text
    are one document and get the same decision; rows that share an id only are documents each; null ids are the smallest. Ties cannot arise: the kept
    occurrence is the smallest (id, text hash, line). An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gone = duplicate_lines(docs).groupBy("d", "th").agg(F.array_sort(F.collect_list("line_no")).alias("removed"))
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\f\r")) != "")).cast("long")
    d, th = document_key(F.col("doc_id"), F.col("text"))
    j = docs.select("doc_id", d.alias("d"), th.alias("th"), n.alias("n_lines")).join(gone, ["d", "th"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return j.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """The documents with their repeated lines cut out, same columns; n_chars follows the text. A document that loses all its words goes: each of its
    lines stands elsewhere. Other documents, empty and null texts stay as they are. Repeated rows, null ids, long lines and an empty table: as in
    ``line_decisions``; further columns of any name are carried along."""
    gone = duplicate_lines(docs).groupBy("d", "th").agg(F.collect_list("line_no").alias("gone"))
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    d, th = document_key(F.col("doc_id"), F.col("text"))
    j = docs.select(row, d.alias("d"), th.alias("th")).join(gone, ["d", "th"], "left")
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    j = j.withColumn("left", F.when(F.col("gone").isNotNull(), left)).filter(F.col("gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.coalesce("left", "row.text"), "n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast("long")) if "n_chars" in docs.columns else None}
    return j.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_decisions(table(spark, sf_dir, "documents"))
