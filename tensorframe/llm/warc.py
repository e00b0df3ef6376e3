"""WARC archives and their capture index.

Pages are written as WARC/1.1 records, a payload equal to another of at least
`least_bytes` bytes as a revisit of the capture with the largest page_id.  Each
record is a gzip member of its own, so that a capture's place in its archive
(file, offset, length) is enough to fetch it.  Spark's own writer writes the
archives into the shared folder, one after about `archive_bytes` bytes: members
are values of its text source, whose line separator is a zero byte, which is the
byte that each member ends with (the highest one of the length of what it packs,
which is kept below 2^24 by splitting a record into members where need be).

Each archive yields a locally sorted run of captures (URL key, timestamp).  Runs
are range-partitioned, into as many ranges as keep a range below RANGE_ROWS rows
on average, and merged k ways by a loser tree in each range, which gives globally
ordered capture histories; memory follows a range, not the runs.

Defined cases: null html is an empty payload; a null url gets a urn of the page;
of equal payloads, all rows with the largest page_id are responses, null ids
count as smallest; repeated rows are repeated records; an empty table gives no
archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorframe.llm.common import materialize, scratch_path, slices, tidy

END = "\r\n\r\n"
LEAST_BYTES = 1000
#: Captures have no time of their own: page_id seconds after this one.
EPOCH = 1_704_067_200
#: Of packed records in an archive, and of a member's content.
ARCHIVE_BYTES = 64_000_000
MEMBER_BYTES = 16_000_000
#: Captures that one task merges.
RANGE_ROWS = 100_000
#: Rows of a run that are taken out of its columns at a time.
HEADS = 64


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """A string column: a record without the empty line that ends it."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha1("html"))
    # Only digests that occur twice, so that most rows meet nothing; counts are combined before they are dealt.
    groups = p.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("of"), "last")
    p = p.join(groups, (F.col("digest") == F.col("of")) & (F.col("bytes") >= least_bytes), "left")
    revisit = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    body = F.when(revisit, "").otherwise(F.col("html"))
    return p.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Date: "), F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "), F.coalesce(_one_line(F.col("url")), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("last")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block) + F.octet_length(body),
        F.lit(END), block, body,
    ).alias("value"))


def _one_line(url: Column) -> Column:
    """White space and controls can't stand in a header field."""
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")


def members(record: bytes, most: int = MEMBER_BYTES) -> list[bytes]:
    """A record as gzip members, one unless it is very long."""
    return [gzip.compress(record[at : at + most], 6, mtime=0) for at in range(0, len(record), most)]


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives below path, in a folder for each number that a task's archives have."""

    def run(batches):
        number = held = 0
        for part in slices(batches):
            done, numbers = [], []
            for x in part.column(0).to_pylist():
                packed = members((x + END).encode())
                if held > archive_bytes:
                    number, held = number + 1, 0
                held += sum(map(len, packed))
                for m in packed:
                    if m[-1]:
                        raise ValueError("a member must be shorter than 2^24 bytes")
                    done.append(m[:-1])
                    numbers.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), pa.array(numbers, pa.int32())], names=["value", "archive"])

    packed = records(pages, least_bytes).mapInArrow(tidy(run), "value binary, archive int")
    # As a string only in name: the writer hands its bytes on as they are.
    packed.select(F.col("value").cast("string").alias("value"), "archive").write.partitionBy("archive").option("lineSep", "\0").text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (fields in lower case, block) of an unpacked archive, one at a time."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != END.encode():
            raise ValueError("a record is cut short")
        yield fields, block


def _missing(held: bytes) -> int:
    """How much of a record (and the empty line after it) is not there yet, as far as can be told."""
    head, there, rest = held.partition(END.encode())
    if not there:
        return 1
    return int(re.search(rb"(?mi)^content-length: *(\d+)", head)[1]) + len(END) - len(rest)


def unpacked(archive, step: int = 16_384) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, fields and block of each record of a packed archive."""
    archive = memoryview(archive)
    at = start = 0
    parts: list[bytes] = []
    while at < len(archive):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(archive):
                raise ValueError("an archive is cut short")
            parts.append(member.decompress(archive[at : at + step]))
            at += step
        at = min(at, len(archive)) - len(member.unused_data)
        held = b"".join(parts)
        if _missing(held) > 0:
            parts = [held]
            continue
        for fields, block in parse(io.BytesIO(held)):
            yield start, at - start, fields, block
        start, parts = at, []
    if parts:
        raise ValueError("a record is cut short")


def record_at(archive, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Fields and block of the record at a capture's place in its archive."""
    return next(r[2:] for r in unpacked(memoryview(archive)[offset : offset + length]))


_port = re.compile(r":(80|443)$")


def url_key(url: str) -> str:
    """Host parts from last to first, then path and query, in lower case."""
    if url.startswith("urn:"):
        return url
    try:
        parts = urlsplit(url.lower())
    except ValueError:
        return url.lower()
    host = _port.sub("", parts.netloc.rpartition("@")[2]).removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(digits) if digits else None


CAPTURE = T.StructType([
    T.StructField("url_key", T.StringType()), T.StructField("ts", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("run", T.StringType()), T.StructField("nth", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archives' captures; each archive's are a sorted run.  Payloads are held against their digests."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for nth, (offset, length, fields, block) in enumerate(unpacked(content.as_buffer())):
                    head, _, payload = block.partition(END.encode())
                    size = int(re.search(rb"(?m)^Content-Length: (\d+)", head)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                    url = fields["warc-target-uri"]
                    rows.append((url_key(url), fields["warc-date"], _page(fields["warc-record-id"]), url, size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), "/".join(name.split("/")[-2:]), nth, offset, length))
                rows.sort(key=_order)
                for at in range(0, len(rows), 5000):
                    yield _batch(rows[at : at + 5000])

    # An empty table has no archive, and its folder nothing that could be read.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(tidy(run), CAPTURE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(CAPTURE)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[type(f.dataType)]) for c, f in zip(columns, CAPTURE.fields, strict=True)], names=CAPTURE.names)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of the match below it."""

    def __init__(self, runs: list, key) -> None:
        self.key, self.runs = key, [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [self._pull(i) for i in range(self.k)]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i, filling=True)

    def _pull(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, i: int, filling: bool = False) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            other = self.losers[node]
            if filling and other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                winner, self.losers[node] = other, winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and self.heads[i := self.losers[0]] is not None:
            yield self.heads[i][1]
            self.heads[i] = self._pull(i)
            self._play(i)


def merge_runs(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures (a table) in global order: ranges of (key, time, page), in each the runs' slices merged."""
    spark = captures.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // range_rows))

    def run(batches):
        # A run's slice stays in columns; only the rows at the tree's leaves, HEADS a run, are Python's.
        runs: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:
            names = np.array(b.column(8).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    runs.setdefault(names[lo], []).append(b.slice(lo, hi - lo))

        def rows(pieces):
            for b in pieces:
                for at in range(0, b.num_rows, HEADS):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, HEADS).columns), strict=True)

        out = []
        for row in LoserTree([rows(pieces) for pieces in runs.values()], _order):
            out.append(row)
            if len(out) == 5000:
                yield _batch(out)
                out = []
        yield _batch(out)

    # A shuffle may mix the rows that one task sends, so each run's slice is put in its order again.  Captures alike in key,
    # time and page (as those without a url or page are) go by run and place, at which their range can be cut, too.
    return captures.repartitionByRange(n, "url_key", "ts", "page_id", "run", "nth").sortWithinPartitions("run", "url_key", "ts", F.col("page_id").asc_nulls_first(), "nth").mapInArrow(tidy(run), CAPTURE)


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the pages to archives in the shared folder, read these back, and give their ordered captures."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, least_bytes)
    return merge_runs(materialize(read(spark, path), "captures"))


def digests(pages: DataFrame) -> DataFrame:
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p),
r AS (SELECT *, payload_bytes >= {LEAST_BYTES} AND last IS NOT NULL AND (page_id IS NULL OR page_id < last) AS again FROM g)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM r
"""
