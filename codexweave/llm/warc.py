"""WARC archives: writing, reading back, and an index merged from locally sorted runs.

Writing.  Payload digests decide which records are revisits.  Only ids and digests of large payloads are shuffled for that; a payload itself moves only
if it is the response that others revisit (or, rarely, taken for one).  Each task sorts its records by URL key and
timestamp and packs them into segments of about `segment_bytes`; each segment becomes one gzip file, written
by Spark's text sink (a lost task is written again).  A file is thus a locally sorted capture run.

Reading.  Each file is parsed by its records' content lengths, so payloads may hold anything.

Index.  The entries of all runs are range-partitioned by URL key, timestamp and page; in every
partition a loser tree merges the parts of the runs.  Partitions are in order too, so the result is
one ordered capture history.  A URL with very many captures spreads over partitions by time.

Records.  Of records with equal payloads of `revisit_bytes` or more the one with the largest page id is the response,
others are revisits of it; smaller payloads are all responses.

Defined results: null html is an empty payload; null url an empty key; null timestamp the epoch.  Rows with the same
(largest) page id and payload are all responses.  If all page ids of equal payloads are null, all are responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, maybe_among, measured, numbered, place, remove, salted_join, shuffle_partitions

END = "\r\n\r\n"
ENTRY = "url_key string, ts string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, run string, seq long, at long, length long"


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query: sorts captures by site."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\d*\.", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.coalesce(F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), F.lower(rest)), F.lit(""))


def decide(pages: DataFrame, id_col: str, url_col: str, html_col: str, ts: Column | None, revisit_bytes: int) -> DataFrame:
    """Adds record type and reference; revisits have no html.  Equal payloads are reduced to their largest id before anything is joined."""
    html, id_ = F.coalesce(place(pages, html_col), F.lit("")), place(pages, id_col)
    if ts is None:  # the table has no capture time: one capture a second, by page id
        ts = F.timestamp_seconds(F.lit(1704067200) + id_)
    rows = numbered(pages).select(id_.alias("page_id"), F.coalesce(place(pages, url_col), F.lit("")).alias("url"), F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")).alias("ts"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("digest"))
    count = F.count(F.lit(1))
    large, seen = measured(rows.drop("html").filter(F.col("payload_bytes") >= revisit_bytes), n=count)
    first, several = measured(large.groupBy("digest").agg(F.max("page_id").alias("master"), F.count("*").alias("n")).filter("n > 1 and master is not null"), n=count)
    flagged = maybe_among(rows, "digest", first.select("digest"), several["n"]).withColumn("__among", F.col("__among") & (F.col("payload_bytes") >= revisit_bytes))
    copied = salted_join(large, first.select("digest", "master"), ["digest"], seen["n"], counts=first.select("digest", "n"), salt=["page_id", "url"])
    revisits = copied.filter(~F.col("master").eqNullSafe(F.col("page_id")))
    # Large payloads that may be copies and yet are responses: the masters, and those that the bitmap took for copies.
    key = F.xxhash64("page_id", "digest")
    alarms = maybe_among(large, "digest", first.select("digest"), several["n"]).filter("__among").join(first.select("digest"), "digest", "left_anti")
    masters = first.select(F.col("master").alias("page_id"), "digest")
    responses, n = measured(alarms.select("page_id", "digest").unionByName(masters).select(key.alias("__response")).distinct(), n=count)
    near = maybe_among(flagged.filter("__among").drop("__among").withColumn("__key", key), "__key", responses, n["n"]).filter("__among")
    moved = near.join(responses, F.col("__key") == F.col("__response"), "left_semi")
    none = F.lit(None).cast("long")
    out = [df.select("page_id", "url", "ts", "payload_bytes", "digest", F.lit("response").alias("record_type"), none.alias("refers_to"), "html") for df in (flagged.filter(~F.col("__among")), moved)]
    out.append(revisits.select("page_id", "url", "ts", "payload_bytes", "digest", F.lit("revisit").alias("record_type"), F.col("master").cast("long").alias("refers_to"), F.lit(None).cast("string").alias("html")))
    every = reduce(DataFrame.unionByName, out)
    return every.select(url_key(F.col("url")).alias("url_key"), "*")


def record(row: dict[str, Any]) -> bytes:
    """One record without the blank lines that end it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["html"] or "").encode()
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {name(row['page_id'])}",
        f"WARC-Date: {row['ts']}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}",
    ]
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(row['refers_to'])}"]
    key = re.sub(r"[\x00-\x1f\x7f]", " ", row["url_key"])
    head += [f"X-URL-Key: {key}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END.encode() + block


def _packing(segment_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary()).cast(pa.large_string()).cast(pa.string())], names=["value"])
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(record({k: batch.column(k)[i].as_py() for k in batch.schema.names}))
                size += len(held[-1])
                if size >= segment_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts: Column | None = None, revisit_bytes: int = 1000, segment_bytes: int = 8 << 20) -> None:
    """Records of all pages as gzip files in `path`.  `ts`: a column over numbered(pages); without it, one capture a second by page id."""
    records = decide(pages, id_col, url_col, html_col, ts, revisit_bytes).sortWithinPartitions("url_key", "ts", "page_id")
    records.mapInArrow(_packing(segment_bytes), "value string").write.option("lineSep", END).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def parse(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of each record."""
    at = 0
    while at < len(raw):
        body = raw.index(b"\r\n\r\n", at) + 4
        lines = raw[at : body - 4].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        end = body + int(fields["Content-Length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield at, end + 4 - at, fields, raw[body:end]
        at = end + 4


def _number(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def entry(fields: dict[str, str], block: bytes) -> dict[str, Any]:
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {"url_key": fields["X-URL-Key"], "ts": fields["WARC-Date"], "page_id": _number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": _number(fields.get("WARC-Refers-To")), "payload_bytes": length, "payload_digest": stated}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """An index entry for every record of the archives, with its run (file) and place in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [entry(fields, block) | {"run": name, "seq": i, "at": at, "length": n} for i, (at, n, fields, block) in enumerate(parse(gzip.decompress(content.as_py())))]
                yield pa.RecordBatch.from_pylist(rows, schema=ENTRY_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, ENTRY)


ENTRY_SCHEMA = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64()}[f.split()[1]]) for f in ENTRY.split(", ")])


class LoserTree:
    """Merges sorted sequences; each step costs one comparison per level."""

    def __init__(self, runs: Sequence[Iterator[Any]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int) -> None:
        """Let leaf i climb; the loser of each match stays at its node, the winner goes on (node 0 holds the champion)."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while the tree is being built, the first to come waits here
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[Any]:
        while self.k and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def merge_index(entries: DataFrame, partitions: int, rows: int | None = None, rows_per_partition: int = 100_000) -> DataFrame:
    """All entries in order of URL key, timestamp and page, merged from the runs; the partitions are in order, too.

    `partitions` at least; more of them if `rows` would give one more than `rows_per_partition`.
    """
    n = max(partitions, -(-(rows or 0) // rows_per_partition))
    order = ["url_key", "ts", "page_id", "run", "seq"]
    dealt = entries.repartitionByRange(n, *order).sortWithinPartitions("run", "seq")
    names = entries.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # entries of one partition; rows_per_partition bounds them
        if not held:
            return
        part = pa.Table.from_batches(held)
        columns = [part.column(c).to_pylist() for c in order]
        runs, lo = [], 0
        of = columns[3]
        for hi in range(1, len(of) + 1):
            if hi == len(of) or of[hi] != of[lo]:
                runs.append(iter([(columns[0][i], columns[1][i], columns[2][i] is not None, columns[2][i] or 0, columns[4][i], i) for i in range(lo, hi)]))
                lo = hi
        merged = part.take(pa.array([x[-1] for x in LoserTree(runs)], pa.int64())).combine_chunks()
        yield from merged.select(names).to_batches()

    return dealt.mapInArrow(run, entries.schema)


def capture_index(pages: DataFrame, path: str | None = None, **options: Any) -> DataFrame:
    """Write pages as archives, read them back, merge the index.

    The archives stay in `path`; without one they are written to the shared folder and removed when they have been read.  Every page
    gives one entry, repeated rows too; an empty table gives none.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    at = path or f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(pages, at, **options)
    entries, seen = measured(read_archives(spark, at), n=F.count(F.lit(1)))  # parsed once
    if path is None:
        remove(spark, at)
    return merge_index(entries, shuffle_partitions(spark), seen["n"])
