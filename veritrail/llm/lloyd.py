"""Operator 13: product quantization by Lloyd rounds whose sums are kept up to date by differences.

Components become integers, so that sums are exact in any order. Vectors are cut into ``PARTS`` parts; each part
position has a codebook of its own. Assignments are written with the vectors. Of each round only those parts
count whose entry has changed: they are taken from the entry they leave and added to the one they join, first within
each task, and these differences alone are shuffled and added to the running sums. What reaches the driver is the
sums of all entries, whose size the codebook fixes.

Dropped: vectors that are null or hold null or non-finite components. The vector with the smallest id gives the
length; vectors of another length get neither code nor error. Where the length isn't a multiple of ``PARTS``,
parts differ by one component at most; parts of no component have index 0. Integers beyond 2^24 in size
count as 2^24. Rows with a null id come last where ids order the first entries; repeated rows count each, and rows of one id are
ordered by their integers. Fewer vectors than entries give as many entries. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.topk import finite
from veritrail.storage import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Larger integers count as this.
MOST = 1 << 24
#: Rows whose distances are worked out at a time.
STEP = 4096


@dataclass
class Codebooks:
    """Entries of each part position: ``entries[p]`` is (entries x components)."""

    cuts: list[int]
    entries: list[np.ndarray]

    @classmethod
    def of(cls, first: np.ndarray, parts: int) -> Codebooks:
        """The codebooks that hold the parts of the ``first`` vectors (rows)."""
        cuts = [first.shape[1] * p // parts for p in range(parts + 1)]
        return cls(cuts, [first[:, a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) of the vectors' parts."""
        codes, dists = np.zeros((len(x), len(self.entries)), np.uint8), np.zeros((len(x), len(self.entries)), np.int64)
        for p, entries in enumerate(self.entries):
            part = x[:, self.cuts[p] : self.cuts[p + 1]]
            # Doubles hold these products exactly, unless components are very large.
            kind = np.float64 if part.size and float(max(np.abs(part).max(), np.abs(entries).max())) ** 2 * part.shape[1] < 2**49 else np.int64
            part, entries = part.astype(kind), entries.astype(kind)
            for a in range(0, len(x), STEP):
                rows = part[a : a + STEP]
                # The part's own square is the same for each entry: it decides nothing, and is added afterwards.
                far = (entries * entries).sum(axis=1) - 2 * (rows @ entries.T)
                best = far.argmin(axis=1)
                codes[a : a + STEP, p] = best
                dists[a : a + STEP, p] = far[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)
        return codes, dists

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q array<long>) of vectors whose components are all finite."""
    q = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-MOST)), F.lit(MOST)).cast("long"))
    return vectors.where(finite("embedding")).select("vec_id", "label", q.alias("q"))


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have the length, their vectors)."""
    column = batch.column(batch.schema.get_field_index("q"))
    whole = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == dim)
    return whole, column.take(pa.array(whole)).flatten().to_numpy().reshape(len(whole), dim)


def _assigned(table: DataFrame, books: Codebooks) -> DataFrame:
    """The table with new codes and their error; the codes so far become ``before``."""
    kinds = dict(table.dtypes)
    given = "code" in kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, x = _matrix(batch, books.cuts[-1])
            codes, dists = books.assign(x)
            out, error = [None] * batch.num_rows, [None] * batch.num_rows
            for at, code, e in zip(whole.tolist(), codes, dists.sum(axis=1).tolist(), strict=True):
                out[at], error[at] = code.tobytes(), e
            before = batch.column(batch.schema.get_field_index("code")) if given else pa.nulls(batch.num_rows, pa.binary())
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label", "q")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.binary()), before, pa.array(error, pa.int64())], names=["vec_id", "label", "q", "code", "before", "error"])

    return table.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<long>, code binary, before binary, error long")


def _differences(table: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, place, value): what parts whose entry has changed add to and take from sums and, at place -1, counts."""
    parts, most, cuts = len(books.entries), max(len(e) for e in books.entries), books.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((cuts[-1], most), np.int64), np.zeros((parts, most), np.int64)
        for batch in batches:
            whole, x = _matrix(batch, cuts[-1])
            if not len(whole):
                continue
            now, was = (np.frombuffer(b"".join((c or b"\0" * parts) for c in batch.column(batch.schema.get_field_index(name)).take(pa.array(whole)).to_pylist()), np.uint8).reshape(-1, parts) for name in ("code", "before"))
            fresh = batch.column(batch.schema.get_field_index("before")).take(pa.array(whole)).is_null().to_numpy(zero_copy_only=False)
            for p in range(parts):
                moved = fresh | (now[:, p] != was[:, p])
                for rows, entry, sign in ((moved, now, 1), (moved & ~fresh, was, -1)):
                    to = entry[rows, p]
                    counts[p] += sign * np.bincount(to, minlength=most)
                    for c in range(cuts[p], cuts[p + 1]):
                        np.add.at(sums[c], to, sign * x[rows, c])
        part_of = np.repeat(np.arange(parts), np.diff(cuts))
        c, e = np.nonzero(sums)
        p, f = np.nonzero(counts)
        columns = (np.concatenate([part_of[c], p]), np.concatenate([e, f]), np.concatenate([c - np.array(cuts)[part_of[c]], np.full(len(p), -1)]), np.concatenate([sums[c, e], counts[p, f]]))
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in columns], names=["part", "entry", "place", "value"])

    moved = table.where("code is not null and (before is null or code <> before)").select("q", "code", "before")
    return moved.mapInArrow(run, "part long, entry long, place long, value long")


def _means(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Codebooks of the running sums; their rows are as many as the codebooks have numbers and entries."""
    found = {(r["part"], r["entry"], r["place"]): r["value"] for r in sums.collect()}
    entries = [e.copy() for e in books.entries]
    for p, part in enumerate(entries):
        for e in range(len(part)):
            if n := found.get((p, e, -1), 0):
                part[e] = [found.get((p, e, place), 0) // n for place in range(part.shape[1])]
    return Codebooks(books.cuts, entries)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code binary, error), codebooks) for (vec_id, label, q), as :func:`quantized` gives them; no
    codebooks where there are no vectors."""
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    first = vectors.orderBy(*by_id).select("q").limit(1).collect()
    if not first:
        return vectors.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None
    dim = len(first[0]["q"])
    start = [r["q"] for r in vectors.where(F.size("q") == dim).orderBy(*by_id).select("q").limit(entries).collect()]
    books, table, sums = Codebooks.of(np.array(start, np.int64).reshape(len(start), dim), parts), vectors, None
    for _ in range(rounds):
        table = materialize(_assigned(table.select("vec_id", "label", "q", *(["code"] if sums else [])), books))
        change = _differences(table, books)
        sums = materialize((sums.unionByName(change) if sums else change).groupBy("part", "entry", "place").agg(F.sum("value").alias("value")))
        books = _means(books, sums)
    return _assigned(table.select("vec_id", "label", "q", *(["code"] if sums else [])), books).select("vec_id", "label", "code", "error"), books


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, q array<long>): vectors made of their codes' entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if c is None else [int(v) for p, e in enumerate(c) for v in books.entries[p][e]] for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["vec_id", "q"])

    return codes.select("vec_id", "code").mapInArrow(run, f"vec_id {dict(codes.dtypes)['vec_id']}, q array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes, books = train(quantized(vectors))
    codes = materialize(codes)
    # Sums by label are partial in each task and joined back, so that a label of very many rows is no group.
    whole = codes.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    both = codes.join(whole, F.col("label").eqNullSafe(F.col("l")))
    return both.select(F.col("vec_id").cast("long").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _round(i: int) -> str:
    """SQL of a round: parts to entries of codebooks c{i}, and codebooks c{i+1}."""
    return f"""a{i} AS (SELECT vec_id, part, any_value(x) AS x, min(d) AS d, arg_min(entry, row(d, entry)) AS entry FROM (
  SELECT p.vec_id, p.part, p.x, c.entry, CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{i} c USING (part)) GROUP BY vec_id, part)""" + (
        "" if i == ROUNDS else f""",
s{i} AS (SELECT part, entry, list(m ORDER BY pos) AS x FROM (
  SELECT part, entry, pos, CAST(floor(CAST(sum(x[pos]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{i}, range(1, len(x) + 1) t(pos) GROUP BY part, entry, pos) GROUP BY part, entry),
c{i + 1} AS (SELECT c.part, c.entry, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN s{i} s USING (part, entry))"""
    )


SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, list_slice(q, CAST(len(q) * part // {PARTS} AS BIGINT) + 1, CAST(len(q) * (part + 1) // {PARTS} AS BIGINT)) AS x FROM v, range({PARTS}) r(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {ENTRIES}),
c0 AS (SELECT part, entry, x FROM p JOIN f USING (vec_id)),
{", ".join(_round(i) for i in range(ROUNDS + 1))},
k AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), k
"""
