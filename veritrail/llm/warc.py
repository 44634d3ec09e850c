"""Operator 6: WARC archives written by Spark, and read back by boundary-chain verification.

Writing: one record a page, as text with the record trailer for a line separator, so that any file system
Spark knows can hold the archives. Equal payloads of at least ``MIN_REVISIT`` bytes are stored once.
Reading: each task looks for the record magic in its archives and emits every candidate with the offset
of its successor. Magic strings inside payloads give candidates too; pointer jumping from the start of each
file keeps the candidates that a chain of records reaches, in a logarithmic number of joins.

A null html is an empty payload; a null url an empty one. Rows with equal payloads that share the largest
page_id are all responses. A null page_id ranks below all others. An empty table gives an empty result.
Line breaks in a url become spaces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.storage import materialize, new_path

MIN_REVISIT = 1000
#: Bounds the size of an archive, which one task reads: so many records of payloads up to LARGE bytes, or so many larger ones.
RECORDS_PER_FILE, LARGE, LARGE_PER_FILE = 500, 1 << 19, 4
MAGIC, TRAILER = b"WARC/1.0\r\n", "\r\n\r\n"
_CANDIDATE = pa.schema(
    [("file", pa.string()), ("pos", pa.int64()), ("next", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def _header(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to gzipped archives under ``path``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_replace("url", "[\r\n]+", " "), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    # Only ids and digests are grouped; payloads meet the few groups that have copies.
    ids = rows.where(F.col("size") >= MIN_REVISIT).select("page_id", "sha", "size")
    copied = ids.groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(copied, ["sha", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", urn("page_id")),
        _header("WARC-Date", date),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        F.when(revisit, _header("WARC-Refers-To", urn("first"))).otherwise(""),
        _header("Content-Type", "application/http; msgtype=response"),
        _header("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    records = rows.withColumn("block", block).select("size", F.concat(head, F.col("block")).alias("value"))
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for kept, most in (("size <= ", RECORDS_PER_FILE), ("size > ", LARGE_PER_FILE))[: 1 + (largest > LARGE)]:
        records.where(f"{kept}{LARGE}").select("value").write.mode("append").option("lineSep", TRAILER).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def parse_candidate(data: bytes, pos: int) -> dict | None:
    """The record that would start at ``pos``, or None where no whole record can."""
    end = data.find(b"\r\n\r\n", pos)
    if end < 0:
        return None
    lines = data[pos:end].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not head.get("content-length", "").isdecimal():
        return None
    start, length = end + 4, int(head["content-length"])
    follows = start + length + len(TRAILER)
    if follows > len(data) or data[start + length : follows] != TRAILER.encode():
        return None
    block = data[start : start + length]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    if head.get("warc-type") == "revisit":
        stated = re.search(rb"(?im)^content-length: *(\d+)", http)
        size, digest = int(stated[1]) if stated else None, head.get("warc-payload-digest", "").removeprefix("sha1:")
    return {"pos": pos, "next": follows, "page_id": _page(head.get("warc-record-id", "")), "record_type": head.get("warc-type"), "refers_to": _page(head.get("warc-refers-to", "")), "payload_bytes": size, "payload_digest": digest}


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the archives that looks like a record, with where its successor would start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()
                data = zlib.decompress(raw, 47) if raw[:2] == b"\x1f\x8b" else raw
                found = [parse_candidate(data, m.start()) for m in re.finditer(re.escape(MAGIC), data)]
                found = [x | {"file": name} for x in found if x]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=_CANDIDATE)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, pos long, next long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string")


def reachable(links: DataFrame) -> DataFrame:
    """(file, pos) of the links (file, pos, next) that a chain from position 0 reaches, by pointer jumping."""
    jump, seen = links.select("file", "pos", "next"), links.where("pos = 0").select("file", "pos")
    count = -1
    while True:
        step = seen.join(jump, ["file", "pos"]).select("file", F.col("next").alias("pos"))
        grown = materialize(seen.union(step).distinct())
        if (now := grown.count()) == count:
            return grown
        seen, count = grown, now
        onward = jump.select("file", F.col("pos").alias("next"), F.col("next").alias("after"))
        jump = materialize(jump.join(onward, ["file", "next"]).select("file", "pos", F.col("after").alias("next")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The true records of the archives under ``path``."""
    found = materialize(candidates(spark, path))
    return found.join(reachable(found), ["file", "pos"], "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
         max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
FROM d
"""
