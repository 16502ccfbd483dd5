"""WARC archives: a record per page written as one gzip member each, and a sequential reader.

The writer is Spark's own text sink, so it reaches any store: a record's bytes are a string column
that is written untouched. The sink ends each row with its separator; a gzip member of less than
16 MB ends with a zero byte, so the separator is that zero and the file is a plain row of members.
Larger members keep theirs and are followed by one zero of padding, which gzip readers skip.

The reader takes a file from front to back: it feeds zlib step by step, starts a new member where
one ends, frames payloads by Content-Length and checks each payload's digest against its header.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest page id
is the response and the others revisit it. It is found by a map-side maximum per digest; only
digests that occur twice meet the pages again, in a join that can be split.

Defined cases: a null html is an empty payload; a null or odd URL is written percent-encoded, an
empty one as ``-``; pages with a null id keep a null id and never become the target of a revisit
while another page has one; repeated rows are records of their own, of which all copies of the
largest id are responses; an empty table gives no records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.llm.text import bounded_batches, table
from seriesmill.session import scratch_dir

MIN_REVISIT = 1000
#: Records and bytes in an archive file at most (a longer record has its own): a file is one row for its reader.
FILE_RECORDS, FILE_BYTES = 5000, 32 << 20
#: Deflate level of a member.
LEVEL = 1
STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan(pages: DataFrame) -> DataFrame:
    """Pages with digest, record type and the page that a revisit refers to."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
    )
    long_enough = F.octet_length("payload") >= MIN_REVISIT
    twice = (
        rows.where(long_enough)
        .groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "last")
    )
    joined = rows.join(twice, "digest", "left")
    older = long_enough & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(older, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(older, F.col("last")).alias("refers_to"),
    )


def _quoted(url: str | None) -> str:
    raw = (url or "-").encode("utf-8", "surrogatepass")
    return "".join(chr(c) if 33 <= c <= 126 else f"%{c:02X}" for c in raw) or "-"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit carries the length and digest of the full payload, not its bytes."""
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if pd.isna(page_id) else int(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_quoted(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        lines.insert(3, f"WARC-Refers-To: <urn:page:{int(refers_to)}>")
        lines.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _members(file_records: int, file_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, records, size = 0, 0, 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                data = member(record(*row))
                if records == file_records or records and size + len(data) > file_bytes:
                    file, records, size = file + 1, 0, 0
                records, size = records + 1, size + len(data)
                out.append((file, data[:-1] if data[-1] == 0 else data))
            yield pd.DataFrame(out, columns=["file", "data"])

    return run


def write(pages: DataFrame, path: str, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Write the pages as archive files of at most so many records and bytes, where the plan left them."""
    bounded_batches(pages.sparkSession, 100)
    data = plan(pages).mapInPandas(_members(file_records, file_bytes), "file int, data binary")
    data = data.select("file", F.col("data").cast("string").alias("value"))
    data.write.partitionBy("file").option("lineSep", "\0").text(path)


def members(steps: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of gzip members one after another; zero bytes between members are padding."""
    unpack, parts, rest = None, [], b""
    for step in steps:
        rest += step
        while rest:
            if unpack is None:
                rest = rest.lstrip(b"\0")
                if not rest:
                    break
                unpack = zlib.decompressobj(31)
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
            if not unpack.eof:
                rest = b""
                break
            yield b"".join(parts)
            unpack, parts = None, []
    if unpack is not None:
        raise ValueError("the archive ends inside a record")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, framed by Content-Length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("ascii").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the record")
    return headers, rest[:size]


def _number(text: str | None) -> int | None:
    digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for content in pdf["content"]:
            out = []
            for data in members(content[k : k + STEP] for k in range(0, len(content), STEP)):
                headers, block = parsed(data)
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"digest of {headers['WARC-Record-ID']} doesn't fit")
                own, other = _number(headers["WARC-Record-ID"]), _number(headers.get("WARC-Refers-To"))
                out.append((own, int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], other))
                if len(out) == 2000:
                    yield _rows(out)
                    out = []
            yield _rows(out)


def _rows(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=[x.split()[0] for x in READ.split(", ")])
    return frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in a folder."""
    bounded_batches(spark)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(_records, READ)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)


ORACLE_SQL = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
sized AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS payload_digest FROM rows),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last_id
  FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last_id IS NULL OR last_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last_id <> page_id THEN last_id END AS refers_to
FROM firsts
"""
