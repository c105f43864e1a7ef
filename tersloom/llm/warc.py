"""WARC archives: written by Spark's own text writer, read by a Python data source with pushed-down header predicates."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from tersloom.llm.common import scratch_path, table, written

END = "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: A file is cut into byte ranges of this size; each range reads the records that begin in it.
RANGE_BYTES = 32 << 20
#: Salts for the lookup of a payload's first record: copies of one payload may be a third of all rows.
SALTS = 16


# --------------------------------------------------------------------------- writing


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null: response) for every row.

    Of equal payloads of at least 100 bytes the smallest page_id is the response; further rows with that very page_id are responses too;
    rows with a null page_id revisit it, and are responses where no copy has a page_id.
    Only (digest, page_id) is aggregated, map-side first; the lookup back is salted.
    """
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = p.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    # as a table its size is known: a small one is broadcast below Spark's threshold and no page moves; a larger one is joined by shuffle
    firsts = written(firsts.select("payload_digest", "first_id"), "firsts")
    firsts = firsts.select(F.col("payload_digest").alias("_d"), "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = p.withColumn("_s", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    j = salted.join(firsts, (F.col("payload_digest") == F.col("_d")) & (F.col("_s") == F.col("_salt")), "left")
    return j.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to"))


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")


def records(rows: DataFrame) -> DataFrame:
    """One column ``value``: a WARC/1.1 record without its closing two line ends, which the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, payload)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"),
        F.lit("\r\nWARC-Target-URI: "), _clean(F.col("url")),
        F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives by Spark's text writer: on any file system it knows, and committed whole, so a lost executor leaves no half file."""
    records(decided(pages)).write.option("lineSep", END).text(path)


# --------------------------------------------------------------------------- reading

SCHEMA = "page_id long, url string, record_type string, payload_digest string, refers_to long, content_length long, payload_bytes long, payload binary"
_COLUMN_OF = {"record_type": "warc-type", "payload_digest": "warc-payload-digest", "url": "warc-target-uri"}


def _opened(uri: str):
    import pyarrow.fs as fs

    if re.match(r"^[a-z0-9+.-]+:", uri):
        store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    else:
        store, path = fs.LocalFileSystem(), uri
    return store, path


class WarcRange(InputPartition):
    def __init__(self, uri: str, begin: int, end: int):
        self.uri, self.begin, self.end = uri, begin, end


class WarcReader(DataSourceReader):
    """Options: files (one URI a line, with its length after a tab), payload ("false": every payload is skipped, null), range_bytes."""

    def __init__(self, options: dict):
        self.files = [x.rsplit("\t", 1) for x in options.get("files", "").split("\n") if x]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.want: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in _COLUMN_OF:
                self._narrow(name, {f.value})
            elif isinstance(f, In) and name in _COLUMN_OF:
                self._narrow(name, set(f.value))
            elif isinstance(f, IsNotNull) and name in _COLUMN_OF:
                pass  # these headers are never null in a record
            else:
                yield f  # Spark evaluates what is not pushed

    def _narrow(self, name: str, values: set) -> None:
        self.want[name] = self.want[name] & values if name in self.want else values

    def partitions(self) -> list[WarcRange]:
        out = []
        for uri, length in self.files:
            n = int(length)
            out += [WarcRange(uri, a, min(a + self.range_bytes, n)) for a in range(0, n, self.range_bytes)]
        return out

    def read(self, part: WarcRange | None) -> Iterator[tuple]:
        if part is None:  # no files, so no ranges
            return
        store, path = _opened(part.uri)
        with store.open_input_file(path) as f:
            yield from self._records(f, part.begin, part.end)

    def _records(self, f, begin: int, end: int) -> Iterator[tuple]:
        at = 0 if begin == 0 else _next_record(f, begin)
        while at < end:
            f.seek(at)
            head, body = _header(f, at)
            if head is None:
                return
            length = int(head.get("content-length", 0))
            at = body + length + len(END)
            row = {"record_type": head.get("warc-type"), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:"), "url": head.get("warc-target-uri", "")}
            if any(row[k] not in v for k, v in self.want.items()):
                continue  # decided by the header; the block is neither read nor decoded
            yield (_page(head.get("warc-record-id")), row["url"], row["record_type"], row["payload_digest"], _page(head.get("warc-refers-to")), length, *self._payload(f, body, length, row["record_type"]))

    def _payload(self, f, body: int, length: int, kind: str) -> tuple[int | None, bytes | None]:
        f.seek(body)
        got = b""
        if self.payload:
            got = f.read(length)
            cut = got.find(END.encode())
        else:
            while (cut := got.find(END.encode())) < 0 and len(got) < length:
                got += f.read(min(512, length - len(got)))
        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", got[: cut + 2])
        size = int(m[1]) if m else length - cut - len(END)
        return size, (got[cut + len(END) :] if self.payload and kind != "revisit" else None)


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _header(f, at: int) -> tuple[dict | None, int]:
    """Headers of the record at ``at`` (names in lower case), and where its block begins."""
    got = f.read(1024)
    while (cut := got.find(END.encode())) < 0:
        more = f.read(4096)
        if not more:
            return None, at
        got += more
    lines = got[:cut].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, at + cut + len(END)


def _next_record(f, begin: int) -> int:
    """The first true record start at or after ``begin``. A payload may hold the same bytes, so a start counts only if the chain of
    lengths from it reaches another start or the end of the file."""
    mark = END.encode() + b"WARC/1."
    size = f.size()
    at, tail = max(0, begin - len(END)), b""
    base = at
    while True:
        f.seek(base + len(tail))
        got = f.read(1 << 20)
        if not got:
            return size
        tail += got
        k = tail.find(mark)
        while k >= 0:
            start = base + k + len(END)
            if start >= begin and _chained(f, start, size):
                return start
            k = tail.find(mark, k + 1)
        base, tail = base + len(tail) - len(mark) + 1, tail[-(len(mark) - 1) :]


def _chained(f, start: int, size: int, links: int = 2) -> bool:
    at = start
    for _ in range(links):
        f.seek(at)
        try:
            head, body = _header(f, at)
        except ValueError:
            return False
        if head is None or "warc-type" not in head or not head.get("content-length", "").isdigit():
            return False
        at = body + int(head["content-length"]) + len(END)
        if at >= size:
            return at == size
    f.seek(at)
    return f.read(5) == b"WARC/"


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tersloom_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of all files below ``path``. Filters on record_type, payload_digest and url are pushed into the reader.

    Files are listed by Spark's Hadoop layer, so any store it knows can be listed; bytes are read through Arrow's file systems.
    A payload is null for revisits and where ``payload`` is false; payload_bytes is always that of the full payload.
    """
    spark.dataSource.register(WarcSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # read when the plan is made, which is after this returns
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files = [(s.getPath().toString(), s.getLen()) for s in store.listStatus(root) if s.isFile() and s.getLen() and s.getPath().getName()[0] not in "_."]
    return spark.read.format("tersloom_warc").option("files", "\n".join(f"{u}\t{n}" for u, n in sorted(files))).option("payload", str(payload).lower()).option("range_bytes", str(range_bytes)).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive of every row to the shared folder and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses: bytes and digest are of the payload that was read. Revisits have no payload; both come from their headers.
    Null html is the empty payload; null page_id and url come back null and empty; payloads below 100 bytes are always responses;
    an empty table gives no rows; repeated rows are records each; payloads of any length are written and read whole; other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    got = read_warc(spark, path).filter("record_type = 'response'").select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    again = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return got.unionByName(again)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
