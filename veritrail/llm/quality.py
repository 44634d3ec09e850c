"""Operator 4: a quality classifier by importance resampling.

Generative models over hashed n-grams give each document the logarithm of its importance weight, the probability
of its n-grams in the target text over that in the raw text; Gumbel top-k samples documents in proportion to
weight, without replacement and at temperature 1.

The n-grams are words and pairs of words, and those of what words look like (letters, digits and marks, with how
often each shape occurs, and how often words repeat the one before), each counted once a document. Counts over all
documents are the base of every model. The target model is that of labelled good documents; the raw text is a
mixture of the target, toxic documents and documents of low quality, in the proportions of the labels, so that
its model is the mixture of theirs. A model's rate of an n-gram is its count over what the base makes expect, both
with ``PRIOR`` added; log ratios between two models shrink by their sampling variance, so that chance differences
of many n-grams don't add up. Since the raw text holds the target, weights are at most 1 / (its proportion).

At most ``MAX_LABELLED`` labelled documents are used; statistics cover all documents. How many documents are
sampled is a parameter; by default it is the labels' share of good ones of all documents.

A null or empty text has no n-grams and weight 1. Null ids and extra columns are kept. Labels whose quality
or toxic is null do not count; of several labels the worst counts. Repeated rows share their sample key; where
ties straddle the last place, the least ids and texts go in. An empty table gives an empty result; without labels
of both kinds nothing is told apart, and all is kept unless a number is given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import COUNTS_SQL, WordTable, bound_text_batches, count_chunks, gram_hashes, mix64, summed_chunks, unpacked, worker_cache
from veritrail.storage import materialize, new_path, stage_tables, write

#: Buckets of words and shapes, and as many again of pairs of words.
BITS = 20
BUCKETS = 2 << BITS
#: Labelled documents that models are fitted on, at most.
MAX_LABELLED = 200_000
#: Counts added to observed and expected ones; multiples of the sampling variance by which log ratios shrink.
PRIOR, SHRINK = 10.0, 16.0
SEED = 29
GOOD, TOXIC, POOR = range(3)
#: The column of a text's buckets, and the largest gap that two bytes hold, less one.
FEATURES, _GAP = "__features", 65_535
_ASCII_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KINDS = bytes.maketrans(bytes(range(97, 123)) + bytes(range(128, 256)) + bytes(range(65, 91)) + b"123456789", b"a" * 154 + b"A" * 26 + b"0" * 9)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_COUNTS = pa.schema([("chunk", pa.int32()), ("slot", pa.int64()), ("counts", pa.binary())])


def shape(word: bytes) -> bytes:
    """Letters, capitals and digits as one sign each, runs of a sign as one."""
    return _RUNS.sub(rb"\1", word.translate(_KINDS))


def _word(word: bytes) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(word.lower().strip(_ASCII_MARKS)), xxhash.xxh3_64_intdigest(shape(word))


def features(text: str | None) -> np.ndarray:
    """Buckets of the distinct n-grams of a text."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.int64)
    stems, shapes = worker_cache("quality", lambda: WordTable(_word, "QQ")).look(words)
    kinds, times = np.unique(shapes, return_counts=True)
    pairs = len(words) - 1
    again = int((stems[1:] == stems[:-1]).sum())
    # How often a word repeats the one before, as a share and as a number, each a feature.
    told = [10 * again // max(1, pairs), 100 + again.bit_length(), 200 + int(20 * again > pairs)]
    grams = [
        mix64(stems),
        mix64(kinds + np.floor(np.log2(times)).astype(np.uint64) * np.uint64(77777) + np.uint64(3)),
        gram_hashes(shapes, 2) + np.uint64(1),
        mix64(np.array(told, np.uint64) + np.uint64(1000)),
    ]
    single = np.concatenate(grams) >> np.uint64(64 - BITS)
    double = (gram_hashes(stems, 2) >> np.uint64(64 - BITS)) + np.uint64(1 << BITS)
    return np.unique(np.concatenate([single, double])).astype(np.int64)


def packed(found: np.ndarray) -> bytes:
    """Sorted buckets as gaps of two bytes, of which _GAP says that the gap goes on."""
    gaps = np.diff(found, prepend=0)
    more, rest = np.divmod(gaps, _GAP)
    out = np.full(found.size + int(more.sum()), _GAP, np.uint16)
    out[np.arange(found.size) + np.cumsum(more)] = rest
    return out.tobytes()


def buckets(raw: bytes) -> np.ndarray:
    """What :func:`packed` was given."""
    gaps = np.frombuffer(raw, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != _GAP]


def featured(docs: DataFrame, *without: str) -> DataFrame:
    """``docs`` (text, ...) with their texts' buckets, and without some columns, written: working them out costs far more than reading them again."""

    @F.pandas_udf("binary")
    def of(texts):
        import pandas as pd

        return pd.Series([packed(features(t)) for t in texts], dtype=object)

    bound_text_batches(docs.sparkSession)
    return materialize(docs.withColumn(FEATURES, of(F.col("text"))).drop(*without))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counts of documents by n-gram: over all texts, and over those of each kind of label."""
    counts = np.zeros((4, BUCKETS), np.int32)
    for batch in batches:
        for raw, kind in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = buckets(raw.as_py())
            counts[0][found] += 1
            if kind is not None:
                counts[1 + kind][found] += 1
    chunks = count_chunks(counts, TaskContext.get().partitionId())
    if chunks:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunks, strict=True), _COUNTS, strict=True)], schema=_COUNTS)


@dataclass
class Model:
    """Log ratios over the target by bucket (a row for each further part of the raw text), and all parts' shares, the target's first."""

    ratios: np.ndarray
    shares: np.ndarray

    def log_weight(self, found: np.ndarray) -> float:
        parts = self.ratios[:, found].sum(axis=1, dtype=np.float64)
        return -float(np.logaddexp.reduce(np.log(self.shares) + np.r_[0.0, parts]))


def log_ratios(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Shrunk log ratios of the models of rows 2.. over that of row 1; row 0 has the counts of all text. ``totals``: of each row, over all n-grams."""
    expected = counts[0] * (totals[1:, None] / totals[0])
    rates = np.log((counts[1:] + PRIOR) / (expected + PRIOR))
    off = rates[1:] - rates[0]
    variance = 1 / (counts[2:] + PRIOR) + 1 / (counts[1] + PRIOR)
    return off**3 / (off**2 + SHRINK * variance)


def kinds_of(labels: DataFrame) -> DataFrame:
    """(__id, kind) for at most MAX_LABELLED labelled ids, chosen by hash; the worst kind of each."""
    kind = F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 0, POOR).otherwise(GOOD)
    told = labels.where("quality is not null and toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id"))
    # Toxic before poor before good.
    worst = told.agg(F.min((kind + 2) % 3).alias("kind")).withColumn("kind", (F.col("kind") + 1) % 3)
    return worst.orderBy(F.xxhash64("__id"), "__id").limit(MAX_LABELLED)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model for ``docs`` (doc_id, text; as :func:`featured` gives them or not) and ``labels`` (doc_id, quality, toxic); None where
    labels tell nothing apart."""
    docs = docs if FEATURES in docs.columns else featured(docs.select("doc_id", "text"))
    # At most MAX_LABELLED ids.
    told = docs.select("doc_id", FEATURES).join(F.broadcast(materialize(kinds_of(labels))), F.col("doc_id") == F.col("__id"), "left")
    numbers = dict(told.where("kind is not null").groupBy("kind").count().collect())
    shares = np.array([numbers.get(k, 0) for k in (GOOD, TOXIC, POOR)], np.float64)
    if not shares[GOOD] or not shares[1:].any():
        return None
    parts = told.select(FEATURES, F.col("kind").cast("int")).mapInArrow(_count, COUNTS_SQL)
    chunks = summed_chunks(materialize(parts), told.rdd.getNumPartitions()).collect()
    totals = sum(counts.sum(axis=1) for _, counts in unpacked(chunks, 4))
    used = shares > 0
    rows = np.r_[True, used]
    ratios = np.zeros((int(used.sum()) - 1, BUCKETS), np.float32)
    for place, counts in unpacked(chunks, 4):
        ratios[:, place] = log_ratios(counts[rows], totals[rows])
    return Model(ratios, shares[used] / shares.sum())


def log_weight(found: Column, model: Model | None) -> Column:
    """The log importance weight of a text by its buckets."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def weigh(rows):
        import pandas as pd

        return pd.Series([model.log_weight(buckets(raw)) if raw else 0.0 for raw in rows], dtype="float64")

    return weigh(found)


def uniform(seed: int, *identity: str) -> Column:
    """A seeded number between 0 and 1."""
    return (F.shiftrightunsigned(F.xxhash64(*identity, F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)


def gumbel_key(weight: Column, seed: int, *identity: str) -> Column:
    """Log weight plus seeded Gumbel noise."""
    return weight - F.log(-F.log(uniform(seed, *identity)))


def kth_largest(keys: DataFrame, k: int, buckets: int = 4096, small: int = 10_000) -> float:
    """The k-th largest of ``keys`` (key), by histograms over ever narrower ranges."""
    low, high, above = *keys.agg(F.min("key"), F.max("key")).first(), 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        if low == high:
            return low
        slot = F.least(F.floor((F.col("key") - low) / (high - low) * buckets), F.lit(buckets - 1)).cast("int")
        rows = inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for row in sorted(rows, key=lambda r: -r["slot"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        low, high = row["low"], row["high"]
        if row["n"] <= small:
            own = sorted((r["key"] for r in keys.where((F.col("key") >= low) & (F.col("key") <= high)).collect()), reverse=True)
            return own[k - above - 1]


def weigh(docs: DataFrame, model: Model | None, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, ...; as :func:`featured` gives them or not) with log_weight and sample_key; columns of these names are replaced."""
    docs = docs if FEATURES in docs.columns else featured(docs)
    keyed = docs.withColumn("log_weight", log_weight(F.col(FEATURES), model)).drop(FEATURES)
    return keyed.withColumn("sample_key", gumbel_key(F.col("log_weight"), seed, "doc_id", "text"))


def top(keyed: DataFrame, k: int, *ties: str) -> DataFrame:
    """The ``k`` rows of ``keyed`` with the largest sample_key; among ties those first by ``ties``."""
    if k <= 0:
        return keyed.limit(0)
    least = kth_largest(keyed.select(F.col("sample_key").alias("key")), k)
    above, level = keyed.where(F.col("sample_key") > least), keyed.where(F.col("sample_key") == least)
    room = k - above.count()
    return keyed.where(F.col("sample_key") >= least) if level.count() <= room else above.union(level.orderBy(*ties).limit(room))


def how_many(keyed: DataFrame, model: Model | None, k: int | None) -> int:
    n = keyed.count()
    return min(k, n) if k is not None else n if model is None else round(float(model.shares[GOOD]) * n)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The sampled rows of ``docs`` (doc_id, text, ...) with log_weight and sample_key."""
    path = new_path(docs.sparkSession)
    # Texts are written twice, and their buckets once: those of the first writing go before the sample is taken.
    with stage_tables(docs.sparkSession):
        docs = featured(docs)
        model = fit(docs, labels)
        # Weighing costs more than writing the rows that it keeps and reading them again.
        keyed = weigh(docs, model, seed)
        write(keyed, path)
    keyed = docs.sparkSession.read.schema(keyed.schema).parquet(path)
    return top(keyed, how_many(keyed, model, k), "doc_id", "text")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Keys need a number from the text, and no text is written.
    docs = featured(docs.withColumn("noise", uniform(SEED, "doc_id", "text")), "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weighed = docs.select("doc_id", log_weight(F.col(FEATURES), model).alias("log_weight"), "noise")
    keyed = materialize(weighed.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log("noise"))).alias("sample_key")))
    return top(keyed, how_many(keyed, model, None), "doc_id")
