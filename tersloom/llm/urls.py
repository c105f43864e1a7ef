"""URL filters: rules by host and path, then a blocked Bloom filter of listed canonical URLs before an exact join. [native]"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersloom.llm.common import table

# Fixed values of the contract: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# Query parameters that only track.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
#: Blocks of the Bloom filter, at 8 words of 32 bits each: 65,536 rows of at most 72 bytes, whatever the list's size.
BLOCKS = 1 << 16
LANES = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    h = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Without scheme, ``www.`` or ``m.``, fragment, tracking parameters, ``index``/``.html`` endings and the last slash; null stays null."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(?:^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html?$", ""), r"/+$", "")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


# --------------------------------------------------------------------------- blocked Bloom filter


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _lane_bit(key: Column, lane: int) -> Column:
    """One of 32 bits for each lane, from a hash that the block does not use."""
    h = F.xxhash64(key, F.lit("lane"))
    return F.shiftright(h, 5 * lane).bitwiseAND(F.lit(31)).cast("int")


def bloom_filter(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """(block, w0..w7): at most ``blocks`` rows. Lanes are or-ed map-side first, so a key's copies cost nothing."""
    k = F.col(key)
    ones = keys.filter(k.isNotNull()).select(_block(k, blocks).alias("block"), *(_lane_bit(k, i).alias(f"b{i}") for i in range(LANES)))
    return ones.groupBy("block").agg(*(F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(LANES)))


def passing(rows: DataFrame, key: str, bloom: DataFrame, blocks: int = BLOCKS, flag: str = "maybe_listed") -> DataFrame:
    """Adds a boolean: false only if the key is surely not in the list. The filter is broadcast; its rows are bounded by ``blocks``."""
    k = F.col(key)
    b = bloom.select(F.col("block").alias("_block"), *(F.col(f"w{i}").alias(f"_w{i}") for i in range(LANES)))
    # both hashes once a row; every lane then reads the same value
    probed = rows.withColumn("_at", _block(k, blocks)).withColumn("_bits", F.xxhash64(k, F.lit("lane")))
    hit = reduce(lambda x, y: x & y, (F.expr(f"shiftright(_w{i}, cast(shiftright(_bits, {5 * i}) & 31 as int)) & 1L") == 1 for i in range(LANES)))
    joined = probed.join(F.broadcast(b), (F.col("_at") == F.col("_block")) & k.isNotNull(), "left")
    return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(flag))


def url_verdicts(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", listed_url: str = "url", rules=RULES, blocks: int = BLOCKS) -> DataFrame:
    """page_id, host, path, canonical, rule, verdict for every row of ``pages``.

    The longest fitting rule decides; without one, a page whose canonical URL is that of a listed URL is blocked, any other allowed.
    Only canonical URLs that pass the broadcast Bloom filter enter the exact join; all others never leave their task. The exact side is
    distinct, so a URL on many pages multiplies nothing, and its pages are a skewed outer side that adaptive execution can split.
    Null url: empty host and path, no rule, allow. Repeated rows stay. An empty list or table gives allow or no rows. URLs of any length are judged whole.
    Other columns, whatever their names, are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    keys = listed.select(canonical(F.col(listed_url)).alias("canonical")).filter("canonical is not null").distinct()
    flagged = passing(rows, "canonical", bloom_filter(keys, "canonical", blocks), blocks)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a later, longer one overrides
        fit = fits(F.col("host"), F.col("path"), r)
        rule, verdict = F.when(fit, F.lit(r[0] + r[1])).otherwise(rule), F.when(fit, F.lit(r[2])).otherwise(verdict)
    judged = flagged.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    # rules decide before the join: only what no rule fits and the filter passes needs the exact list
    unsure = F.col("maybe_listed") & F.col("by_rule").isNull()
    exact = judged.filter(unsure).join(keys.withColumn("on_list", F.lit(True)), "canonical", "left")
    sure = judged.filter(~unsure).withColumn("on_list", F.lit(None).cast("boolean"))
    out = sure.unionByName(exact)
    return out.select("page_id", "host", "path", "canonical", "rule", F.coalesce("by_rule", F.when(F.col("on_list"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page. The list: the URLs of the pages whose page_id is divisible by 20, as a stated block list."""
    pages = table(spark, sf_dir, "pages")
    return url_verdicts(pages, pages.filter("page_id % 20 = 0")).select("page_id", "host", "path", "rule", "verdict")


_SQL_PARTS = r"""
parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS q
  FROM pages),
canon AS (
  SELECT page_id, url, host, path,
    CASE WHEN url IS NULL THEN NULL ELSE regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical
  FROM parts)"""

OP9_SQL = f"""
WITH {_SQL_PARTS},
listed AS (SELECT DISTINCT canonical FROM canon WHERE page_id % 20 = 0 AND canonical IS NOT NULL),
judged AS (
  SELECT c.*, l.canonical IS NOT NULL AS on_list,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM canon c LEFT JOIN listed l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN on_list THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
