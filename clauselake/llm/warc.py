"""Web archives with revisit records, and capture histories merged from locally sorted runs.

Every task writes its pages as gzip-compressed WARC records into archives of bounded size.  Of records with equal
payloads one is a response and the others are revisits that refer to it.  Reading an archive back gives one run:
its captures sorted by URL key and timestamp.  Runs are cut at the same range borders by a range exchange, and each
range is merged from its slices of the runs by a loser tree, so the ranges in order are the capture history of all
archives, and no task holds more than its range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm.common import join_groups, record_batch, scratch, sliced
from clauselake.llm.tokens import _files

ARCHIVE_BYTES = 64 << 20
"""Payload bytes per archive, but for a longer payload."""

RANGE_CAPTURES = 200_000
"""Captures that one range of the merge is planned for."""

LEVEL = 1
"""Compression of the records."""

READ = 1 << 20

# fixed values of the format
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_CAPTURE = datetime(2020, 1, 1, tzinfo=UTC)


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1, without a label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, then path and query in lower case; "-" without a URL."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path.rstrip('/') or '/'}{query}".lower()


def capture_time(page_id: int | None) -> str:
    """The timestamp of a page: pages are taken as captured one second apart, in the order of their ids."""
    offset = (page_id or 0) % (10**10)
    return (FIRST_CAPTURE + timedelta(seconds=offset)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One gzip member with a response (payload inside) or a revisit (headers only)."""
    body = payload if kind == "response" else b""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = "null" if page_id is None else str(page_id)
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", capture_time(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", _clean(url)))
    if kind == "revisit":
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines.append(("Content-Length", str(len(head) + len(body))))
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    return gzip.compress(text + head + body + b"\r\n\r\n", LEVEL, mtime=0)


def _members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and content of each gzip member of a stream."""
    held, offset = b"", 0
    while True:
        unzip, parts, length = zlib.decompressobj(31), [], 0
        if not held:
            held = stream.read(READ)
            if not held:
                return
        while not unzip.eof:
            if not held:
                held = stream.read(READ)
                if not held:
                    raise ValueError(f"an archive ends inside the record at {offset}")
            parts.append(unzip.decompress(held))
            length += len(held) - len(unzip.unused_data)
            held = unzip.unused_data
        yield offset, length, b"".join(parts)
        offset += length


def _named(value: str | None) -> int | None:
    return None if value in (None, "<urn:page:null>") else int(value[len("<urn:page:"):-1])


def captures(stream) -> Iterator[dict]:
    """The records of an archive as captures; payload sizes and digests of responses are taken from the payloads."""
    for offset, length, data in _members(stream):
        head, _, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if first.encode() != VERSION:
            raise ValueError(f"no WARC record at {offset}")
        fields = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        kind = fields["WARC-Type"]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
            raise ValueError(f"the payload at {offset} does not fit its digest")
        url = fields.get("WARC-Target-URI")
        yield {
            "url_key": url_key(url), "timestamp": fields["WARC-Date"], "page_id": _named(fields["WARC-Record-ID"]),
            "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": _named(fields.get("WARC-Refers-To")), "offset": offset, "length": length,
        }


class LoserTree:
    """k-way merge of sorted sequences: inner nodes keep the losers, so the next item costs one path to the root."""

    def __init__(self, runs: Sequence[Sequence], key=lambda item: item):
        self._runs, self._key = runs, key
        self._at = [0] * len(runs)
        k = max(1, len(runs))
        self._heads = [self._head(i) for i in range(len(runs))] or [(1, (), 0)]
        self._losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._heads[b] < self._heads[a]:
                a, b = b, a
            winners[node], self._losers[node] = a, b
        self._winner = winners[1] if k > 1 else 0

    def _head(self, run: int) -> tuple:
        """Comparable head of a run: runs that have ended lose to all others, equal keys go by run."""
        at = self._at[run]
        return (0, self._key(self._runs[run][at]), run) if at < len(self._runs[run]) else (1, (), run)

    def __iter__(self) -> Iterator:
        while self._heads[self._winner][0] == 0:
            run = self._winner
            yield self._runs[run][self._at[run]]
            self._at[run] += 1
            self._heads[run] = self._head(run)
            winner, node = run, (run + len(self._losers)) // 2
            while node > 0:
                loser = self._losers[node]
                if self._heads[loser] < self._heads[winner]:
                    self._losers[node], winner = winner, loser
                node //= 2
            self._winner = winner


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, record_type and refers_to of every page.

    Of pages with equal payloads of at least least_bytes the one with the largest id is the response; rows that repeat
    that id are responses too, and so are all rows without an id if none has one.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        pages["html"].cast("string").alias("html")).withColumn("digest", F.sha1(payload))
    sizes = rows.select("digest", "page_id", F.octet_length(payload).alias("n_bytes"))
    groups = sizes.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(
        F.count("*").alias("n_rows"), F.max("page_id").alias("response_id")).filter("n_rows > 1")
    total = pages.count()
    joined = join_groups(rows, groups, "digest", "n_rows", total, "page_id")
    repeats = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select("page_id", "url", "html", F.when(repeats, "revisit").otherwise("response").alias("record_type"),
                         F.when(repeats, F.col("response_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as WARC archives and return the stored list of them: path, n_records.

    A task that runs twice writes archives of other names; only those in the committed list count.
    """
    fields = "path string, n_records long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        out, name, count, size = None, "", 0, 0
        for batch in sliced(batches, "html"):
            for page_id, url, html, kind, refers in zip(*(batch.column(c).to_pylist() for c in (
                    "page_id", "url", "html", "record_type", "refers_to"))):
                payload = (html or "").encode()
                if out is not None and size + len(payload) > archive_bytes:
                    out.close()
                    yield record_batch(schema, path=[name], n_records=[count])
                    out = None
                if out is None:
                    name, count, size = posixpath.join(base, f"pages-{uuid.uuid4().hex}.warc.gz"), 0, 0
                    out = files.open_output_stream(name, compression=None)
                out.write(record(page_id, url, payload, payload_digest(payload), kind, refers))
                count, size = count + 1, size + len(payload)
        if out is not None:
            out.close()
            yield record_batch(schema, path=[name], n_records=[count])

    listed = f"{folder}/list"
    decided(pages).mapInArrow(run, fields).write.parquet(listed)
    return pages.sparkSession.read.schema(fields).parquet(listed)


CAPTURE = ("url_key string, timestamp string, page_id long, url string, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, offset long, length long, archive string")
SORT = ("url_key", "timestamp", "page_id", "archive", "offset")


def _key(row: dict) -> tuple:
    return row["url_key"], row["timestamp"], -1 if row["page_id"] is None else row["page_id"], row["archive"], row["offset"]


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    kinds = {"page_id": number, "payload_bytes": number, "refers_to": number, "offset": number, "length": number}
    schema = pa.schema([(name, kinds.get(name, text)) for name in (c.split()[0] for c in CAPTURE.split(", "))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def sorted_runs(archives: DataFrame, folder: str) -> DataFrame:
    """The captures of every archive, read back from it: one run per archive, sorted by URL key and timestamp."""
    spark = archives.sparkSession
    spread = archives.repartition(max(spark.sparkContext.defaultParallelism, archives.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_stream(path, compression=None) as stream:
                    rows = [c | {"archive": path} for c in captures(stream)]
                if len(rows) != expected:
                    raise ValueError(f"{path} has {len(rows)} records, not {expected}")
                rows.sort(key=_key)
                for k in range(0, len(rows), 10_000):
                    yield _arrow(rows[k: k + 10_000])

    return spread.select("path", "n_records").mapInArrow(run, CAPTURE)


def merged_history(runs: DataFrame, n_captures: int, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """All captures in the order of URL key and timestamp: ranges of keys, each merged from its slices of the runs."""
    ranges = max(runs.sparkSession.sparkContext.defaultParallelism, -(-n_captures // range_captures))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                slices.setdefault(row["archive"], []).append(row)
        for part in slices.values():
            if any(_key(a) > _key(b) for a, b in zip(part, part[1:])):  # the exchange may deliver a run's blocks in any order
                part.sort(key=_key)
        held: list[dict] = []
        for row in LoserTree(list(slices.values()), _key):
            held.append(row)
            if len(held) == 10_000:
                yield _arrow(held)
                held = []
        if held:
            yield _arrow(held)

    return runs.repartitionByRange(ranges, *SORT).mapInArrow(run, CAPTURE)


def capture_history(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as archives to a new folder and return their merged capture history, read from the archives.

    Columns: url_key, timestamp, page_id, url, payload_bytes, payload_digest, record_type, refers_to, offset, length,
    archive.  A null html is an empty payload, a null URL has the key "-", a null page_id stays null, and an empty
    table gives no captures.
    """
    folder = scratch(spark, "warc")
    archives = write_archives(pages, folder)
    n = archives.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    path = f"{folder}/runs"
    sorted_runs(archives, folder).write.parquet(path)
    return merged_history(spark.read.schema(CAPTURE).parquet(path), n)
