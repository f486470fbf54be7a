"""WARC archives of pages, and their capture index merged from sorted runs.

Archives are written by Spark's text sink with CRLF as the line end, which is
how WARC separates records, one gzip file per task.  They are read as lines, a
file by one task in order, and cut into records by Content-Length alone, so
nothing in a payload can be taken for a header.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from statewalk.llm.common import whole
from statewalk.operators.joins import lookup_join
from statewalk.sources.store import cut

CRLF = "\r\n"
#: Entries that a reading task sorts at once, and entries aimed at per merging task.
RUN_ROWS = 50_000
MERGE_ROWS = 200_000

# fixed values: strings of the WARC 1.1 and HTTP formats
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

INDEX = pa.schema(
    [
        ("run", pa.string()),
        ("url_key", pa.string()),
        ("captured", pa.string()),
        ("id", pa.string()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
    ]
)
INDEX_DDL = (
    "run string, url_key string, captured string, id string, url string, record_type string, "
    "refers_to string, payload_digest string, payload_bytes bigint"
)


# --- writing ----------------------------------------------------------------


def sha1_base32(text: Column) -> Column:
    """Base32 of the SHA-1: every five hex digits are four base-32 digits."""
    digest = F.sha1(text.cast("binary"))
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def capture_time(id: str) -> Column:
    """A stand-in for pages without one: seconds after 2024 began, by id or its hash; no time zone enters."""
    number = F.coalesce(F.col(id).try_cast("bigint"), F.xxhash64(F.col(id).cast("string")))
    seconds = F.when(F.col(id).isNull(), 0).otherwise(F.pmod(number, F.lit(366 * 86400)))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")
    clock = [F.lpad(F.floor(seconds / unit % size).cast("string"), 2, "0") for unit, size in ((3600, 24), (60, 60), (1, 60))]
    return F.concat(day, F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))


def with_record_types(pages: DataFrame, id: str, html: str, min_bytes: int) -> DataFrame:
    """Adds payload, n_bytes, digest and first: the least id with the same payload, if repeated."""
    payload = whole(html)
    digest = sha1_base32(payload)
    repeated = (
        pages.select(F.col(id).alias("id"), digest.alias("digest"), F.octet_length(payload).alias("n_bytes"))
        .where(F.col("n_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    rows = pages.withColumn("payload", payload).withColumn("digest", digest).withColumn("n_bytes", F.octet_length("payload"))
    rows = lookup_join(rows, cut(repeated), "digest", "left")
    return rows.withColumn("first", F.when(F.col("n_bytes") >= min_bytes, F.col("first")))


def write_archives(
    pages: DataFrame, location: str, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0
) -> None:
    """One WARC record per row of `pages`, in gzip files under `location`.

    Of rows with equal payloads of at least `min_bytes` bytes the one with the
    least id is a response, the others are revisits that refer to it; rows that
    share that id, and rows whose payload has no id at all, are responses.  Null
    pages have an empty payload; null ids and urls leave their header empty or
    out; ids may be text; other columns are not looked at.
    """
    named = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = with_record_types(named, "id", "html", min_bytes)
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(F.lit(HTTP_HEAD), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    nothing = F.lit("")
    record = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text_id, F.lit(">"))),
        line("WARC-Date", capture_time("id")),
        F.coalesce(line("WARC-Target-URI", address), nothing),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
                line("WARC-Profile", F.lit(PROFILE)),
            ),
        ).otherwise(nothing),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(CRLF),  # the sink adds the second one
    )
    rows.select(record.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(location)


# --- reading ----------------------------------------------------------------


def records(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, from the lines of whole archives."""
    for version in lines:
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        headers = {}
        for line in lines:
            if not line:
                break
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            headers[name] = value
        left, parts = int(headers["Content-Length"]), []
        for line in lines:
            parts.append(line)
            left -= len(line)
            if left <= 0:
                break
            left -= 2
        if left or next(lines, None) != b"":
            raise ValueError("a record is not as long as it says")
        yield headers, b"\r\n".join(parts)


def url_key(url: str) -> str:
    """The address with its host reversed, so that captures of a site sort together."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}".lower()


def index_entry(headers: dict[str, str], block: bytes) -> tuple:
    """(url_key, captured, id, url, record_type, refers_to, digest, bytes) of a record.

    Length and digest of a response are those of the payload as read; a revisit
    has none, so its headers tell them.
    """
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["WARC-Type"]
    if kind == "response":
        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    else:
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(http.rpartition(b"Content-Length: ")[2])
    page = headers["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    refers = headers.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
    url = headers.get("WARC-Target-URI")
    captured = headers["WARC-Date"].translate({ord(c): None for c in "-:TZ"})
    return url_key(url or ""), captured, page or None, url, kind, refers or None, digest, size


def capture_runs(spark: SparkSession, location: str) -> DataFrame:
    """The index of all archives as locally sorted runs of up to RUN_ROWS captures."""
    lines = spark.read.option("lineSep", CRLF).text(location).select(F.col("value").cast("binary").alias("value"))

    def sorted_run(name: str, entries: list[tuple]) -> pa.RecordBatch:
        entries.sort(key=lambda e: (e[0], e[1], e[2] or ""))
        columns = list(zip(*entries))
        arrays = [pa.array([name] * len(entries))] + [pa.array(c, f.type) for c, f in zip(columns, list(INDEX)[1:])]
        return pa.RecordBatch.from_arrays(arrays, schema=INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, entries, n = TaskContext.get().partitionId(), [], 0
        for headers, block in records(v.as_py() for batch in batches for v in batch.column("value")):
            entries.append(index_entry(headers, block))
            if len(entries) == RUN_ROWS:
                yield sorted_run(f"{task}-{n}", entries)
                entries, n = [], n + 1
        if entries:
            yield sorted_run(f"{task}-{n}", entries)

    return lines.mapInArrow(run, INDEX_DDL)


# --- merging ----------------------------------------------------------------


class LoserTree:
    """Merges sorted lists; each inner node keeps the loser of its match.

    Taking the least entry replays the matches on one way from leaf to root:
    log2(k) comparisons, whatever the number k of runs.
    """

    END = (1,)

    def __init__(self, runs: list[list]):
        self.runs = [iter(run) for run in runs]
        self.k = len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k else -1

    def _next(self, run: int):
        entry = next(self.runs[run], None)
        return self.END if entry is None else (0, entry)

    def _play(self, node: int) -> int:
        """The winner of the matches below `node`; leaves stand at k to 2k - 1."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.k and self.heads[self.winner] is not self.END:
            run = self.winner
            yield self.heads[run][1]
            self.heads[run] = self._next(run)
            node = (run + self.k) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[run]:
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def merge_runs(runs: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """All captures in the order of (url_key, captured, id), over ranges of that key.

    Ranges are cut by the whole key, so a site or an address with very many
    captures spreads over tasks.  A task gets its range of every run one after
    the other, each in order, and merges them; it holds about `merge_rows` slim
    entries.
    """
    n = max(1, -(-runs.count() // merge_rows))
    key = ["url_key", "captured", "id"]
    dealt = runs.repartitionByRange(n, *key).sortWithinPartitions("run", *key)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, INDEX).combine_chunks()
        columns = [table.column(c).to_pylist() for c in ("run", *key)]
        slices: list[list] = []
        last = None
        for at, (name, *entry) in enumerate(zip(*columns)):
            if name != last:
                slices.append([])
                last = name
            slices[-1].append((entry[0], entry[1], entry[2] or "", at))
        order = [entry[3] for entry in LoserTree(slices)]
        yield from table.take(pa.array(order, pa.int64())).to_batches(10_000)

    return dealt.mapInArrow(merge, INDEX_DDL)


def read_index(spark: SparkSession, location: str, id_type: str | DataType = "bigint") -> DataFrame:
    """The capture history of all archives under `location`, globally ordered.

    Columns: url_key, captured, id, url, record_type, refers_to, payload_digest,
    payload_bytes.  Archives without records give an empty index.
    """
    merged = merge_runs(cut(capture_runs(spark, location)))
    return merged.select(
        "url_key", "captured", F.col("id").cast(id_type).alias("id"), "url", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"), "payload_digest", "payload_bytes",
    )
