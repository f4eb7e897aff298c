"""Write pages as WARC archives, read them back, and merge their indexes into one ordered history.

Writing. Pages with equal payloads (SHA-1 of the UTF-8 bytes) are told apart by digests alone; the one with the
largest id becomes a response record, the others revisit records that refer to it. A record is a string whose
bytes Spark's text writer stores as they are; the separator of lines is the empty lines that end a record. So
archives go through Spark's own output, to any store it can write, with whatever codec is asked for.

Reading. Archives are bounded, read whole as binary rows and parsed by Content-Length, so payloads may hold anything. Pages are
written by classes of size (CLASSES), each with so many records a file that a file holds at most 64 MB of payloads, or one
record. Digests are taken anew from the payloads read.

Index. Each archive yields one capture run, sorted by URL key, time and id. Runs are dealt by ranges of that key;
within a range a loser tree merges its runs, and the ranges one after the other are the history in global order.
A range is bounded by the range partitioning, not by a host: ids make the keys unique.

Null payloads and urls count as empty, null dates as the epoch. Rows with equal ids and payloads are equal captures. A null id
is always a response. Empty tables give an empty history. Only the columns named are looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.llm.common import Scratch, pieces, remove
from stmtflow.plans.materialize import materialize
from stmtflow.session import work_dir

#: Payloads of up to so many bytes go so many to a file; larger ones go one by one.
CLASSES = ((1 << 14, 4096), (1 << 20, 64))
RANGE_ROWS = 50_000
END = "\r\n\r\n"
#: The date of records whose page has none.
EPOCH = "1970-01-01T00:00:00Z"
DIGITS_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SALTS = 32
BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: each 5 hex digits are 4 digits of base 32."""
    parts = [
        F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", DIGITS_32)


def revisits(pages: DataFrame, scratch: Scratch, key: str = "page_id", html: str = "html") -> DataFrame:
    """(_id, _digest, _last) of the pages that repeat the payload of a page with a larger id."""
    digest = base32(F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")))
    slim = scratch(pages.select(F.col(key).alias("_id"), digest.alias("_digest")), "digests").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    last = slim.groupBy("_digest").agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    dealt = last.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return scratch(slim.join(dealt, ["_digest", "_salt"]).filter("_id <> _last").select("_id", "_digest", "_last").distinct(), "revisits")


def records(pages: DataFrame, again: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None) -> DataFrame:
    """One row per page: key and `value`, its WARC record without the closing empty lines. `captured` names a timestamp."""
    payload = F.coalesce(F.col(html), F.lit(""))
    date = F.lit(EPOCH)
    if captured is not None:
        utc = F.to_utc_timestamp(F.col(captured).cast("timestamp"), pages.sparkSession.conf.get("spark.sql.session.timeZone"))
        date = F.date_format(F.coalesce(utc, F.timestamp_micros(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    cut = pages.select(F.col(key).alias("_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"), payload.alias("_payload"), date.alias("_date"))
    cut = cut.withColumns({"_digest": base32(F.sha1(F.col("_payload").cast("binary"))), "_size": F.octet_length("_payload")})
    known = cut.join(again, ["_id", "_digest"], "left")
    again = F.col("_last").isNotNull()
    # A line feed in a url would end a header; such bytes are percent-encoded here and decoded when read.
    safe_url = F.regexp_replace(F.regexp_replace(F.regexp_replace("_url", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("_date")),
        F.concat(F.lit("WARC-Target-URI: "), safe_url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest")),
        F.concat(F.lit("WARC-X-Payload-Length: "), F.col("_size").cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("_last").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit("0")).otherwise(F.col("_size").cast("string"))),
    )
    return known.select(
        F.col("_id").alias(key),
        F.concat(header, F.lit(END), F.when(again, F.lit("")).otherwise(F.col("_payload"))).alias("value"),
    )


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None
) -> None:
    """Gzipped WARC files below `path`, a folder for each class of size."""
    scratch = Scratch(pages.sparkSession, "warc")
    again = revisits(pages, scratch, key, html)
    size = F.coalesce(F.octet_length(html), F.lit(0))
    above = -1
    for number, (most, each) in enumerate([*CLASSES, (None, 1)]):
        own = pages.filter((size > above) & (size <= most) if most is not None else size > above)
        out = records(own, again, key, url, html, captured).select("value")
        out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", each).text(f"{path}/size-{number}")
        above = most
    scratch.clear()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, memoryview]]:
    """(headers, offset, payload) of each record of an uncompressed archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at : body - 4].decode("utf-8").split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(head["Content-Length"])
        yield head, at, view[body : body + size]
        at = body + size + 4


def url_key(url: str) -> str:
    """Host parts in reverse, then path and query, as capture indexes sort them."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.lower().split(":")[0].split("."))) + ")" + slash + path


INDEX = "url_key string, captured string, page_id bigint, run string, seq bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint"


def capture_runs(archives: DataFrame) -> DataFrame:
    """One sorted run per archive. Takes Spark's binaryFile rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def number(name: str) -> int | None:
            digits = name.removeprefix("<urn:page:").removesuffix(">")
            return int(digits) if digits else None

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py()
                data = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
                rows = []
                for head, _, payload in parse(data):
                    uri = head["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    kind = head["WARC-Type"]
                    if kind == "response":
                        digest, size, refers = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), None
                    else:
                        digest, size, refers = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-X-Payload-Length"]), number(head["WARC-Refers-To"])
                    rows.append((url_key(uri), head["WARC-Date"], number(head["WARC-Record-ID"]), uri, kind, digest, size, refers))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
                cols = list(zip(*rows)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cols[0], pa.string()),
                        pa.array(cols[1], pa.string()),
                        pa.array(cols[2], pa.int64()),
                        pa.array([path] * len(rows), pa.string()),
                        pa.array(range(len(rows)), pa.int64()),
                        pa.array(cols[3], pa.string()),
                        pa.array(cols[4], pa.string()),
                        pa.array(cols[5], pa.string()),
                        pa.array(cols[6], pa.int64()),
                        pa.array(cols[7], pa.int64()),
                    ],
                    names=[c.split()[0] for c in INDEX.split(", ")],
                )

    return archives.select("path", "content").mapInArrow(read, INDEX)


def loser_tree(runs: list[list]) -> Iterator[tuple]:
    """The elements of sorted runs in merged order; equal ones from the earlier run first.

    Inner nodes hold the losers of the matches below them, so a new head plays one match per level.
    """
    k = len(runs)
    head = [(0, r[0], i) if r else (1, (), i) for i, r in enumerate(runs)]
    at, losers, winners = [0] * k, [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if head[a] < head[b] else (b, a)
    best = winners[1] if k > 1 else 0
    while k and head[best][0] == 0:
        yield head[best][1]
        at[best] += 1
        head[best] = (0, runs[best][at[best]], best) if at[best] < len(runs[best]) else (1, (), best)
        node = (best + k) // 2
        while node:
            if head[losers[node]] < head[best]:
                best, losers[node] = losers[node], best
            node //= 2


def merge_runs(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The capture runs as one history: partitions in order, rows in order within them, numbered by `place`."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        runs: dict[str, list] = {}
        columns = [rows.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "run", "seq")]
        for i, (url, when, page, run, seq) in enumerate(zip(*columns)):
            runs.setdefault(run, []).append((url, when, page is not None, page or 0, seq, i))
        # A range's rows of one run are in order as written, but batches of runs may be mixed.
        order = [row[-1] for row in loser_tree([sorted(r, key=lambda x: x[4]) for _, r in sorted(runs.items())])]
        out = rows.take(pa.array(order)).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    n = pieces(index.count(), range_rows)
    ranges = index.repartitionByRange(n, "url_key", "captured", "page_id", "seq")
    return ranges.mapInArrow(merged, INDEX + ", place bigint")


def archive_history(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None, path: str | None = None
) -> DataFrame:
    """Write all pages as archives, read them back and return the merged index.

    Archives stay at `path` when it is given, else they go when their runs have been read. `captured` names a timestamp
    column, the records' date.
    """
    spark = pages.sparkSession
    place = path or work_dir(spark, "warc")
    write_archives(pages, place, key, url, html, captured)
    archives = spark.read.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(place)
    runs = materialize(capture_runs(archives), "capture-runs")
    if path is None:
        remove(spark, place)
    return merge_runs(runs)
