"""WARC archives of pages, and an index of captures merged from sorted runs.

Archives are written by Spark's own text writer, so a task that runs twice leaves one file, and any store that Spark
writes to will do. Records are text (headers and a UTF-8 payload), ended by two line breaks as the format asks. Reading
follows the length in each header, never the payload's content.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import saved, table
from cutline.plans.pooled import lookup
from cutline.sources.workdir import shared_folder

RECORDS = 2000  # in an archive, at most
EPOCH = 1_600_000_000  # captures without a time of their own are dated a second apart from here
SECONDS = 1_000_000_000  # and start again after so many, so that any id gives a year of four digits
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hex_digits: str) -> str:
    """SQL: base 32 of a SHA-1 in hexadecimal, twenty bits at a time."""
    groups = []
    for i in range(8):
        bits = f"CAST(conv(substr({hex_digits}, {5 * i + 1}, 5), 16, 10) AS INT)"
        groups += [f"substr('{_BASE32}', 1 + (shiftright({bits}, {s}) & 31), 1)" for s in (15, 10, 5, 0)]
    return f"concat({', '.join(groups)})"


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, its size and digest, and the page whose record holds the payload (itself for responses).

    Of equal payloads of at least ``least`` bytes the largest page_id is the response. The choice is a combined
    maximum per digest; the way back lets adaptive execution split a hot payload.
    """
    rows = pages.selectExpr(
        "CAST(page_id AS BIGINT) AS page_id", "coalesce(CAST(url AS STRING), '') AS url", "coalesce(html, '') AS html"
    ).selectExpr("*", "octet_length(html) AS size", "sha1(html) AS sha")
    best = rows.groupBy("sha", "size").agg(F.max("page_id").alias("best"))
    return lookup(rows, best, ["sha", "size"]).withColumn(
        "best", F.expr(f"CASE WHEN size >= {least} THEN best ELSE page_id END")
    )


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """One record per page: responses with their payload, revisits with a reference; gzip, ``RECORDS`` each at most."""
    clean = "regexp_replace(url, '[\\\\x00-\\\\x20\\\\x7F]', '%20')"
    # a time without a zone, so that the session's zone does not matter; the id counts seconds within some thirty years
    after = f"make_dt_interval(0, 0, 0, CAST({EPOCH} + pmod(coalesce(page_id, 0), {SECONDS}) AS DECIMAL(18, 6)))"
    stamp = f"date_format(TIMESTAMP_NTZ'1970-01-01 00:00:00' + {after}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    rows = decide(pages, least).withColumn("revisit", F.expr("NOT (page_id <=> best)"))
    http = "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', size, '\\r\\n\\r\\n')"
    rows = rows.withColumn("http", F.expr(http)).withColumn("digest", F.expr(_base32("sha")))
    head = f"""concat(
        'WARC/1.1\\r\\nWARC-Type: ', if(revisit, 'revisit', 'response'),
        '\\r\\nWARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS STRING), ''), '>\\r\\nWARC-Target-URI: ', {clean},
        '\\r\\nWARC-Date: ', {stamp}, '\\r\\nWARC-Payload-Digest: sha1:', digest,
        if(revisit, concat('\\r\\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest',
                           '\\r\\nWARC-Refers-To: <urn:page:', coalesce(CAST(best AS STRING), ''), '>'), ''),
        '\\r\\nContent-Type: application/http; msgtype=response\\r\\nContent-Length: ',
        octet_length(http) + if(revisit, 0, size), '\\r\\n\\r\\n', http, if(revisit, '', html))"""
    rows.selectExpr(f"{head} AS value").write.options(
        lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=RECORDS
    ).text(path)


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if not lines[0].startswith("WARC/") or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no record at {at}")
        yield at, head, data[start:stop]
        at = stop + 4


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then path; scheme, www and fragment are left out."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    labels = [x for x in host.lower().split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (slash + path if slash else "/")


def _page(reference: str | None) -> int | None:
    digits = (reference or "").rpartition(":")[2].rstrip(">")
    return int(digits) if digits else None


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run per archive: its captures sorted by key, time and page; payloads are checked against their digests."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = zlib.decompress(content.as_py(), wbits=47)
            run = []
            for offset, head, block in records(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b": ")[2])
                digest = head["WARC-Payload-Digest"].partition(":")[2]
                if head["WARC-Type"] == "response":
                    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload at {offset} of {path} is damaged")
                page = _page(head["WARC-Record-ID"])
                run.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], -1 if page is None else page, page, size,
                            digest, head["WARC-Type"], _page(head.get("WARC-Refers-To")), path, offset))
            run.sort(key=lambda r: r[:3])
            if run:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*run), kinds)], names=_NAMES)


_NAMES = ["url_key", "captured", "tie", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "place"]
_SCHEMA = "url_key string, captured string, tie long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long"


def loser_tree(runs: list[list]) -> Iterator:
    """Merge sorted runs: inner nodes hold the losers of a tournament, so each row costs one path to the root."""
    k = len(runs)
    heads = [0] * k
    key = lambda i: (heads[i] >= len(runs[i]), runs[i][heads[i]] if heads[i] < len(runs[i]) else None, i)

    def beats(i: int, j: int) -> bool:
        a, b = key(i), key(j)
        return a[0] < b[0] if a[0] != b[0] else a[2] < b[2] if a[0] or a[1] == b[1] else a[1] < b[1]

    losers = [-1] * k
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while k and heads[best] < len(runs[best]):
        yield runs[best][heads[best]]
        heads[best] += 1
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range: its runs, each in order, become one history; memory holds one range."""
    runs: dict[str, list] = {}
    part = None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            part = row[0]
            runs.setdefault(row[9], []).append((row[1:4], row[10], row[4:]))  # order: key, place in the archive
    merged = list(loser_tree(list(runs.values())))
    for at in range(0, len(merged), 5000):
        some = merged[at : at + 5000]
        cells = [(part, at + i, r[0][0], r[0][1], *r[2]) for i, r in enumerate(some)]
        names = ["range_no", "position", *_NAMES[:2], *_NAMES[3:]]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells), kinds)], names=names)


def capture_index(spark: SparkSession, archives: str) -> DataFrame:
    """Read archives back: one row per record, globally ordered by (range_no, position), that is by key and time.

    Ranges are cut by key, time and page, so that one host or one address can span many of them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(archives).select("path", "content")
    runs = saved(files.mapInArrow(_index, _SCHEMA), "runs")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = (
        runs.repartitionByRange(tasks, "url_key", "captured", "tie").withColumn("range_no", F.spark_partition_id())
        .select("range_no", *_NAMES).sortWithinPartitions("archive", "url_key", "captured", "tie")
    )
    return ranges.mapInArrow(_merge, "range_no int, position long, " + _SCHEMA.replace("tie long, ", ""))


def roundtrip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write a record per page, read the archives back: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to`` and the capture's place in the merged index.

    A NULL payload is empty, a NULL address too. Rows with the same id and payload are the response each. A NULL id
    is kept, and is a revisit if an equal payload has an id. No rows give no archives and no rows.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archives(pages, path, least)
    return capture_index(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range_no", "position"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(table(spark, sf_dir, "pages"))
