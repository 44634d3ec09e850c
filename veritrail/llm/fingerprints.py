"""Operator 10: document fingerprints by winnowing.

Hashes of ``GRAM`` code points roll over the text; of each ``WINDOW`` neighbouring ones the least is kept, the
rightmost on ties, with its position. Two texts that share ``GRAM + WINDOW - 1`` code points in a row
keep at least one hash in common, at places that the positions tell.

A text shorter than a window keeps the least of its hashes, one shorter than a gram the hash of all of it, and
an empty or null text nothing. Likeness is the Jaccard similarity of the hashes as fingerprints hold them (32 bits);
two empty fingerprints are alike (1), an empty and another one are not (0).
A null doc_id ranks below all others; rows that share an id are ordered by a hash of the text. The next document of
a table's only row is itself. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import bound_text_batches, gram_hashes, mix64
from veritrail.llm.repeats import anchors

GRAM, WINDOW = 12, 20
_LOWEST = -(2**63)


def winnow(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing keeps, by position."""
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lifted = mix64((points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    if not lifted.size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if lifted.size < GRAM + WINDOW - 1:
        grams = gram_hashes(lifted, min(GRAM, lifted.size))
        last = grams.size - 1 - int(np.argmin(grams[::-1]))
        return grams[last : last + 1], np.array([last])
    start, _, shift, grams = anchors(lifted, GRAM + WINDOW - 1, GRAM)
    return grams, start + shift


def fingerprint_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Ten hexadecimal digits each: 32 bits of the hash, and the gap from the position before (less than 256)."""
    out = np.empty((hashes.size, 5), np.uint8)
    out[:, :4] = (hashes >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = np.diff(positions, prepend=0)
    return out.tobytes().hex()


def marks_of(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes, with the bits that a fingerprint has of them."""
    return np.unique(hashes >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    if not a.size and not b.size:
        return 1.0
    same = np.intersect1d(a, b, assume_unique=True).size
    return same / (a.size + b.size - same)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``, array of (hash, position)."""

    @F.pandas_udf("array<struct<hash:long,position:long>>")
    def marks(texts: pd.Series) -> pd.Series:
        kept = [winnow(t) for t in texts]
        return pd.Series([[{"hash": h, "position": p} for h, p in zip(hs.view(np.int64).tolist(), ps.tolist(), strict=True)] for hs, ps in kept])

    return docs.withColumn("fingerprint", marks(F.col(text)))


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key; the document before a row is its next one in descending order."""
    before, before_set = "", np.empty(0, np.uint64)
    for batch in batches:
        rows = []
        for halo, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py() or ""
            hashes, positions = winnow(text)
            own = marks_of(hashes)
            if not halo:
                cut = len(text) // 3
                edited = text[: len(text) - cut] + before[:cut]
                e_hashes, e_positions = winnow(edited)
                digest = hashlib.sha256(edited.encode()).hexdigest()
                rows.append((doc, len(text), digest, fingerprint_text(hashes, positions), fingerprint_text(e_hashes, e_positions), likeness(own, marks_of(e_hashes)), likeness(own, before_set)))
            before, before_set = text, own
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)


class Ranges:
    """Ranges of (key, hash) in order. A key with the share of several ranges is parted by the hash."""

    def __init__(self, cuts: list[float], whole: set[float]) -> None:
        self.bounds, times = np.unique(np.array(cuts, np.float64), return_counts=True)
        self.times = np.where(np.isin(self.bounds, np.array(sorted(whole))), times, 1)
        self.before = np.r_[0, np.cumsum(self.times)]

    def of(self, keys: pd.Series, hashes: pd.Series) -> np.ndarray:
        x = keys.to_numpy().astype(np.float64)
        place = np.searchsorted(self.bounds, x, side="right")
        if not self.bounds.size:
            return place
        at = np.maximum(place - 1, 0)
        times = np.where((place > 0) & (self.bounds[at] == x), self.times[at], 1)
        part = np.minimum(((hashes.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64 * times).astype(np.int64), times - 1)
        return np.where(times > 1, self.before[at] + 1 + part, self.before[place])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text, and their likeness.

    Documents are dealt by ranges of ids, each with a copy of the last document of the range before it. An id that
    very many rows share, or the null id, takes several ranges.
    """
    spark = docs.sparkSession
    bound_text_batches(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"), F.xxhash64("text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select("key").approxQuantile("key", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    often = [x for x, n in zip(*np.unique(np.array(cuts, np.float64), return_counts=True), strict=True) if n > 1]
    # At most one row a range; ids that only look alike as doubles aren't parted.
    alike = docs.select("key", F.col("key").cast("double").alias("x")).where(F.col("x").isin(often)).groupBy("x").agg(F.min("key").alias("low"), F.max("key").alias("high")) if often else None
    ranges = Ranges(cuts, {x for x, low, high in alike.collect() if low == high} if often else set())

    @F.pandas_udf("int")
    def own_range(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(keys, hashes), dtype="int32")

    # One row a range.
    last = sorted(docs.select("key", "h", own_range("key", "h").alias("r")).groupBy("r").agg(F.max(F.struct("key", "h")).alias("top")).collect())
    onward = {tuple(top): last[(i + 1) % len(last)][0] for i, (_, top) in enumerate(last)}

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        ends = zip(ranges.of(keys, hashes).tolist(), keys.tolist(), hashes.tolist(), strict=True)
        return pd.Series([[r] + ([onward[k, h]] if (k, h) in onward else []) for r, k, h in ends])

    dealt = docs.select("*", F.posexplode(places("key", "h")).alias("copy", "r")).withColumn("halo", F.col("copy") == 1)
    # The first range's copy holds the greatest key; it still goes first.
    dealt = dealt.repartition("r").sortWithinPartitions("r", F.desc("halo"), "key", "h", "text")
    return dealt.select("halo", "doc_id", "text").mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
