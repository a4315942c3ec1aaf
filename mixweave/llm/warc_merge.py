"""WARC archives and their external index merge.

Pages become WARC records, one gzip member each, and tasks pack members into blocks that Spark's text
writer puts out uncompressed, so that archives land through the commit protocol in any store that
Spark reads. The writer's line separator is the zero byte in which a gzip member's length ends.
Payloads of some size that occur again become revisit records. Reading an archive back gives one
sorted run of captures; runs are dealt by ranges of (URL key, time, page) that are small enough for a
task's memory, and each range merges its pieces of runs with a loser tree, which yields capture
histories in global order. A capture's offset and length name its record's member in the archive.

Defined results: null html is an empty payload; pages with the smallest page_id of a payload are
responses, also where that id repeats; null ids count as larger than any; a null url is stored as
empty; repeated rows give a record each; an empty table gives no captures; other columns are ignored.
A very long page is a block of its own, and an archive is cut by bytes, not by records; a task holds
one archive or one range of captures.
"""

from __future__ import annotations

import hashlib
import io
import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_dimension, slices, stage, stage_path

#: Payloads with fewer bytes are always written whole.
MIN_REVISIT_BYTES = 100
#: Compressed bytes of a block, unless a single record has more, and blocks of an archive file.
BLOCK_BYTES, ARCHIVE_BLOCKS = 4 << 20, 8
#: Bytes of the captures that a merging task holds, and captures of a batch.
RANGE_BYTES = 16 << 20
PIECE_ROWS = 2_000
EPOCH = 1704067200
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FIELDS = [("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
SCHEMA = "urlkey string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to to pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select("page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    groups = sized.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = stage(groups.where("n > 1").select("payload_digest", "first"), "warc-again")
    joined = join_dimension(sized, again, "payload_digest", F.coalesce(F.col("page_id").cast("string"), F.col("url")))
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _one_line(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "%0D"), "\n", "%0A")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record_text() -> Column:
    """A planned row as a WARC record."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _header("Content-Length", F.col("payload_bytes")), F.lit("\r\n"))
    whole = F.col("record_type") == "response"
    block_bytes = F.octet_length(http) + F.when(whole, F.col("payload_bytes")).otherwise(0)
    key = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url"), F.col("payload_digest")))
    uuid = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    captured = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))),
        _header("WARC-Date", captured), _header("WARC-Target-URI", _one_line(F.col("url"))), _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(~whole, F.lit(REVISIT_PROFILE))), _header("X-Page-Id", F.col("page_id")), _header("X-Refers-To-Page-Id", F.col("refers_to")), _header("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _header("Content-Length", block_bytes), F.lit("\r\n"), http, F.when(whole, F.col("html")).otherwise(F.lit("")), F.lit(END),
    )


def gzip_member(record: bytes) -> bytes:
    """A record as a gzip member that ends in a zero byte; an empty member follows where it doesn't."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = z.compress(record) + z.flush()
    return member if member[-1] == 0 else member + gzip_member(b"")


def blocks_of(records: Iterable[bytes], most: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Members in blocks of at most so many bytes, without the zero byte that ends a block."""
    held, size = [], 0
    for record in records:
        member = gzip_member(record)
        if held and size + len(member) > most:
            yield b"".join(held)[:-1]
            held, size = [], 0
        held.append(member)
        size += len(member)
    if held:
        yield b"".join(held)[:-1]


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, block_bytes: int = BLOCK_BYTES) -> None:
    """Write a record per page to WARC files under path, a gzip member each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (v.as_py() for b in slices(batches) for v in b.column(0).cast(pa.binary()))
        for block in blocks_of(records, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["value"])

    blocks = plan_records(pages, min_bytes).select(record_text().alias("value")).mapInArrow(run, "value binary")
    blocks.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", ARCHIVE_BLOCKS).text(path)


def url_key(url: str) -> str:
    """Host labels from the top down, then path and query, all in lower case."""
    rest = url.split("://", 1)[-1].split("#", 1)[0].lower()
    cut = next((i for i, c in enumerate(rest) if c in "/?"), len(rest))
    host = rest[:cut].rpartition("@")[2].removeprefix("www.")
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:] or "/")


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that holds anything."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out, end, step = zlib.decompressobj(31), [], at, 1 << 12
        while not z.eof:
            if end >= len(view):
                raise ValueError(f"member at {at} is cut off")
            out.append(z.decompress(view[end : end + step]))
            end, step = min(end + step, len(view)), 1 << 16
        end -= len(z.unused_data)
        content = b"".join(out)
        if content:
            yield at, end - at, content
        at = end


def read_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one WARC record."""
    stream = io.BytesIO(content)
    if not stream.readline().startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode().partition(":")
        headers[name.lower()] = value.strip()
    block = stream.read(n := int(headers["content-length"]))
    if len(block) != n or stream.read() != END.encode():
        raise ValueError("a WARC record's length is wrong")
    return headers, block


def capture_of(archive: str, offset: int, length: int, content: bytes) -> tuple:
    headers, block = read_record(content)
    number = lambda name: int(headers[name]) if name in headers else None
    digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), number("x-payload-length")
    if headers["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"{archive}: payload of the record at {offset} is damaged")
    url = headers["warc-target-uri"]
    return url_key(url), headers["warc-date"], number("x-page-id"), url, size, digest, headers["warc-type"], number("x-refers-to-page-id"), archive, offset, length


def order_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], names=[n for n, _ in FIELDS])


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives under path, each archive's in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                archive = batch.column(0)[i].as_py().rpartition("/")[2]
                rows = sorted((capture_of(archive, *m) for m in members(batch.column(1)[i].as_py())), key=order_key)
                for a in range(0, len(rows), PIECE_ROWS):
                    yield _batch(rows[a : a + PIECE_ROWS])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def loser_tree(runs: list[Iterator], key: Callable) -> Iterator:
    """Merge sorted iterators: each inner node holds the loser of its match, the root the winner."""
    k = len(runs)
    if not k:
        return
    done = (1,)
    heads = [next(r, done) for r in runs]
    keys = [(h is done, key(h) if h is not done else (), i) for i, h in enumerate(heads)]
    losers = [-1] * k
    winner = -1
    for i in range(k):  # play each run in; an empty place waits for its second player
        node, player = (i + k) // 2, i
        while node > 0:
            if losers[node] == -1:
                losers[node], player = player, -1
                break
            if keys[losers[node]] < keys[player]:
                losers[node], player = player, losers[node]
            node //= 2
        if player != -1:
            winner = player
    while not keys[winner][0]:
        yield heads[winner]
        head = next(runs[winner], done)
        heads[winner] = head
        keys[winner] = (head is done, key(head) if head is not done else (), winner)
        node, player = (winner + k) // 2, winner
        while node > 0:
            if keys[losers[node]] < keys[player]:
                losers[node], player = player, losers[node]
            node //= 2
        winner = player


def merge_pieces(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Merge a stream of pieces of sorted runs: a new run begins where the order falls back."""
    runs: list[list[tuple]] = []
    last = None
    for row in rows:
        k = order_key(row)
        if last is None or k < last:
            runs.append([])
        last = k
        runs[-1].append(row)
    yield from loser_tree([iter(r) for r in runs], order_key)


def merge_index(runs: DataFrame) -> DataFrame:
    """Captures in global order: partition after partition, and within each by key, time and page.

    Ranges are as many as keep each in a task's memory; no two captures have equal keys, so any
    number of captures of one address can be dealt to several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in slices(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []
        for row in merge_pieces(rows):
            out.append(row)
            if len(out) >= PIECE_ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    size = runs.agg(F.sum(F.octet_length("urlkey") + F.octet_length("url") + 200).alias("bytes")).first()["bytes"] or 0
    ranges = max(1, math.ceil(size / RANGE_BYTES), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return runs.repartitionByRange(ranges, "urlkey", "captured", "page_id", "archive", "offset").mapInArrow(run, SCHEMA)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as WARC, read the archives back, and return the merged capture index."""
    spark = pages.sparkSession
    path = path or stage_path(spark, "warc")
    write_archives(pages, path)
    return merge_index(stage(sorted_runs(spark, path), "warc-runs"))


def warc_query(pages: DataFrame) -> DataFrame:
    return archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = f"""
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY 1
), joined AS (
  SELECT s.*, first, first IS NOT NULL AND (page_id IS NULL OR page_id > first) AS again FROM sized s LEFT JOIN firsts f ON s.payload_digest = f.payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to FROM joined
"""
