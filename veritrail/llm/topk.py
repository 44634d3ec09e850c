"""Operator 7: exact top-k inner products, pruned by segment means and deviations, coarse to fine.

Vectors are cut into blocks of bounded size; each pair of a query block and a candidate block is one
row of an equi-join, so no task gathers more than two blocks and its queries' best scores. Blocks are as large as
memory allows, since what is shuffled falls with their size.
For a segment of ``n`` components with means ``a, b`` and deviations ``s, t``, the inner product is at
most ``n * (a*b + s*t)``: the distance bound from segment statistics, written for scores. Few wide segments
are tried first, more narrow ones for what survives, and the exact product last.

Null vectors and vectors with null or non-finite components take no part; nor do rows with a null id, which no
result could name. Vectors are compared within one length only. Rows that share the query's id are the query's own;
repeated rows are candidates each, and a query id with several vectors is asked once for each. Scores beyond 64
bits count as the nearest 64-bit number. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.storage import materialize

QUERY_BLOCK, VECTOR_BLOCK = 4096, 8192
#: Of longer vectors a block holds fewer, so that it has no more numbers than with vectors of so many components.
BLOCK_COMPONENTS = 128
#: Queries whose bounds are held at a time.
BOUND_BLOCK = 256
#: Share of candidates up to which those left are picked one query at a time.
FEW = 1 / 16
LEVELS = (4, 16, 32)
_FOUND = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_LEAST, _MOST = -(2**63), 2**63 - 1


def finite(vec: str):
    """Whether the vector and its components are neither null nor infinite nor no number."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def quantize(vectors: DataFrame, scale: int = 256, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, q array<long>): components times ``scale``, rounded down."""
    q = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col(key).isNotNull() & finite(vec)).select(F.col(key).cast("long").alias("vec_id"), q.alias("q"))


def _blocks(vectors: DataFrame, size: int, prefix: str) -> tuple[DataFrame, int]:
    # Rows get their numbers when they are written, so that blocks are the same whenever a task is run again; repeated ids are dealt out too.
    numbered = materialize(vectors.withColumn("at", F.monotonically_increasing_id()))
    held = numbered.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("components")).first()
    n = max(1, -(-held["n"] // size), -(-held["components"] // (size * BLOCK_COMPONENTS)))
    block = F.pmod(F.xxhash64("vec_id", "at"), F.lit(n)).cast("int").alias(f"{prefix}b")
    rows = F.collect_list(F.struct("vec_id", F.xxhash64("q").alias("key"), "q"))
    packed = numbered.groupBy(F.size("q").alias("dim"), block).agg(rows.alias("rows"))
    return packed.select("dim", f"{prefix}b", F.col("rows.vec_id").alias(f"{prefix}_ids"), F.col("rows.key").alias(f"{prefix}_keys"), F.flatten("rows.q").alias(f"{prefix}_flat")), n


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, scaled so that their inner product bounds that of the vectors."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    means = [p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts]
    return np.stack(means + [p.std(axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1)


def _exact(cand: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products: through doubles where those are exact, as Python's integers where 64 bits may not do."""
    bound = float(np.abs(cand.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, query.size)
    if bound < 2**53:
        return (cand.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return cand @ query
    return np.array([min(max(x, _LEAST), _MOST) for x in (cand.astype(object) * query.astype(object)).sum(axis=1)], np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if scores.size > k:
        keep = scores >= np.partition(scores, scores.size - k)[scores.size - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_block(q_ids, q_keys, queries, c_ids, cands, k: int, held: dict) -> None:
    """Bring ``held`` (query id and key to best scores and ids) up to date with one block of candidates."""
    if not c_ids.size:
        return
    y = cands.astype(np.float64)
    theirs = [segment_features(y, s) for s in LEVELS]
    reach = np.abs(y).max(initial=0)
    far = reach * y.shape[1]
    none = np.empty(0, np.int64)
    for a in range(0, q_ids.size, BOUND_BLOCK):
        asked, x = queries[a : a + BOUND_BLOCK], queries[a : a + BOUND_BLOCK].astype(np.float64)
        keys = list(zip(q_ids[a : a + BOUND_BLOCK].tolist(), q_keys[a : a + BOUND_BLOCK], strict=True))
        ours = [segment_features(x, s) for s in LEVELS]
        most = np.abs(x).max(initial=0) * far
        slack = 1e-9 * (1 + most)
        bound = ours[0] @ theirs[0].T + slack
        least = np.full(len(keys), -np.inf)
        for i, key in enumerate(keys):
            scores, ids = held.get(key, (none, none))
            if scores.size < k:
                first = np.argpartition(-bound[i], min(4 * k, c_ids.size - 1))[: 4 * k + 1]
                first = first[c_ids[first] != key[0]]
                scores, _ = best_of(np.concatenate([scores, _exact(cands[first], asked[i])]), np.concatenate([ids, c_ids[first]]), k)
            if scores.size >= k:
                least[i] = scores[-1]
        alive = bound >= least[:, None]
        for mine, other in zip(ours[1:], theirs[1:], strict=True):
            # Where many are left, one product of matrices costs less than to pick them.
            if alive.mean() > FEW:
                alive &= mine @ other.T + slack >= least[:, None]
                continue
            for i in range(len(keys)):
                left = np.flatnonzero(alive[i])
                alive[i, left] = other[left] @ mine[i] + slack >= least[i]
        alive &= c_ids != q_ids[a : a + BOUND_BLOCK, None]
        # Doubles hold these products exactly.
        products = x @ y.T if most < 2**53 and alive.mean() > FEW else None
        for i, key in enumerate(keys):
            scores, ids = held.get(key, (none, none))
            left = np.flatnonzero(alive[i] if products is None else alive[i] & (products[i] >= least[i]))
            exact = _exact(cands[left], asked[i]) if products is None else products[i, left].astype(np.int64)
            held[key] = best_of(np.concatenate([scores, exact]), np.concatenate([ids, c_ids[left]]), k)


def _flat(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name))[row].values.to_numpy(zero_copy_only=False)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for (vec_id, q) rows of ``queries`` against all of ``vectors``, as :func:`quantize` gives them."""
    cands, n_cand = _blocks(vectors, VECTOR_BLOCK, "c")
    asks, n_ask = _blocks(queries.dropDuplicates(["vec_id", "q"]), QUERY_BLOCK, "q")
    cands = cands.drop("c_keys")
    cands = cands.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_ask - 1))))
    asks = asks.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, c_ids = _flat(batch, "q_ids", row), _flat(batch, "c_ids", row)
                search_block(q_ids, _flat(batch, "q_keys", row).tolist(), _flat(batch, "q_flat", row).reshape(q_ids.size, -1), c_ids, _flat(batch, "c_flat", row).reshape(c_ids.size, -1), k, held)
        if held:
            counts = [s.size for s, _ in held.values()]
            keys = (np.repeat(np.array([key[i] for key in held], np.int64), counts) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, np.concatenate([i for _, i in held.values()]), np.concatenate([s for s, _ in held.values()]))], schema=_FOUND)

    # Spark takes blocks to be no more than the table they were made of, however often they are repeated, and would send all of them
    # through the driver. As many tasks as shuffles have, however few bytes the blocks are.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asks, cands = (x.repartition(tasks, "dim", "qb", "cb") for x in (asks, cands))
    found = asks.hint("merge").join(cands.hint("merge"), ["dim", "qb", "cb"]).mapInArrow(run, "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = quantize(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"), 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  , a.q FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
