"""Operator 12: approximate nearest neighbours by multi-index hashing.

Unit vectors become binary codes of ``BITS`` signs under rotations learned on a bounded sample (alternately the
codes' signs and the rotation that brings the vectors nearest to them). A code is split into substrings of 16 bits, each of which
is an index of its own. If two codes differ in at most r bits, r = m * a + b with m substrings, they differ
in at most a bits in one of the first b + 1 substrings or in at most a - 1 in one of the others; probing these buckets so finds
every code within r. Codes alone travel in blocks of bounded size, each pair of a query block and a code block one row of an
equi-join; the vectors of the codes within the radius are then fetched by joins, and ranked by cosine.

A query's radius is its distance to the nearest few codes of a bounded sample of all codes: as many as the
sample's share of ``PROBED``, and more than ``k``. So at least k neighbours are found wherever there are so many.

Equal vectors are one class and one code; of each class the k + 1 smallest ids are kept, since no more can be
among a query's k nearest, its own id left out. Rows with equal id and vector count once. No part take vectors that are null, zero or
hold null or non-finite components (or whose square is no positive double), and rows with a null id. Vectors are compared within one length
only. Rows that share the query's id are the query's own; an id with several vectors asks once for each. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.topk import finite
from veritrail.storage import materialize

#: Bits of a code and of a substring.
BITS, KEY = 256, 16
SUBSTRINGS, WORDS = BITS // KEY, BITS // 64
#: Of all codes, about as many lie within a query's radius.
PROBED = 512
#: Vectors that rotations are learned on (and their bytes, at most), codes that radii are taken from, and rounds of learning.
LEARNED, LEARNED_BYTES, RADIUS_CODES, LEARNING_ROUNDS = 16_384, 32 << 20, 32_768, 12
QUERY_BLOCK, CODE_BLOCK = 1024, 16_384
#: Sampled codes that a query's distances are worked out to at a time.
STEP = 4096
#: Numbers of 16 bits in order of how many bits they have, and where each weight begins.
_WEIGHT = np.bitwise_count(np.arange(1 << KEY, dtype=np.uint32)).astype(np.uint8)
_MASKS = np.argsort(_WEIGHT, kind="stable").astype(np.uint16)
_BALL = np.cumsum(np.bincount(_WEIGHT))


def vectors_of(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, norm), each pair of id and vector once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    whole = rows.where(F.col("vec_id").isNotNull() & finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return whole.distinct().withColumn("norm", F.sqrt(square)).where("norm > 0 and norm < double('Infinity')")


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(cls, v, norm, ids): distinct vectors with the k + 1 smallest ids of each."""
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.withColumn("first", first).where(F.col("first") <= k + 1)
    packed = few.groupBy("v").agg(F.first("norm").alias("norm"), F.collect_list("vec_id").alias("ids"))
    return packed.withColumn("cls", F.monotonically_increasing_id())


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = LEARNING_ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(centre, projections (components x bits)) of the sample's unit vectors (rows)."""
    rnd, dim = np.random.default_rng(seed), sample.shape[1]
    centre = sample.mean(axis=0)
    x = sample - centre
    base = np.eye(dim)
    if dim > bits:
        # Signs of the directions that vary most.
        base = np.linalg.eigh(x.T @ x)[1][:, -bits:]
    x, out = x @ base, []
    while sum(r.shape[1] for r in out) < bits:
        turn = np.linalg.qr(rnd.standard_normal((base.shape[1], base.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(x.T @ np.where(x @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        out.append(base @ turn)
    return centre, np.concatenate(out, axis=1)[:, :bits]


def encode(unit: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Codes (rows x WORDS) of unit vectors, which may be shorter than those learned from: the rest counts as zero."""
    centre, turns = model
    full = np.zeros((len(unit), len(centre)))
    full[:, : unit.shape[1]] = unit
    return np.packbits((full - centre) @ turns >= 0, axis=1).view(np.uint64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _coded(table: DataFrame, model) -> DataFrame:
    """The table with its vectors' codes, array<long>."""
    given = [f"{c} {kind}" for c, kind in table.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, norm = _column(batch, "v"), _column(batch, "norm").to_numpy()
            lengths, codes = v.value_lengths().to_numpy(), np.zeros((batch.num_rows, WORDS), np.uint64)
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                codes[rows] = encode(v.take(pa.array(rows)).flatten().to_numpy().reshape(-1, dim) / norm[rows, None], model)
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, WORDS, dtype=np.int32)), pa.array(codes.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "code"])

    return table.mapInArrow(run, ", ".join([*given, "code array<long>"]))


def _codes(flat: np.ndarray) -> np.ndarray:
    return flat.view(np.uint64).reshape(-1, WORDS)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


class Index:
    """Codes by each of their substrings; ``within`` gives those that differ from a code in at most ``radius`` bits."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, keys = codes, codes.view(np.uint16)
        self.order = [np.argsort(keys[:, s], kind="stable") for s in range(SUBSTRINGS)]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(keys[:, s], minlength=1 << KEY))]) for s in range(SUBSTRINGS)]
        self.used = [np.flatnonzero(np.diff(starts)).astype(np.uint16) for starts in self.starts]

    def buckets(self, s: int, key: np.uint16, radius: int) -> np.ndarray:
        """Keys of substring ``s`` that occur within the radius: all that lie so near, or all there are, whichever are fewer."""
        if _BALL[radius] < self.used[s].size:
            return _MASKS[: _BALL[radius]] ^ key
        return self.used[s][_WEIGHT[self.used[s] ^ key] <= radius]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        share, more = divmod(min(radius, BITS), SUBSTRINGS)
        met, keys = np.zeros(len(self.codes), bool), code.view(np.uint16)
        for s in range(SUBSTRINGS):
            near = min(share - (s > more), KEY)
            if near < 0:
                break
            at = self.buckets(s, keys[s], near).astype(np.int64)
            a, n = self.starts[s][at], self.starts[s][at + 1] - self.starts[s][at]
            a, n = a[n > 0], n[n > 0]
            places = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if n.size else np.empty(0, np.int64)
            met[self.order[s][places]] = True
        found = np.flatnonzero(met)
        return found[distances(self.codes[found], code) <= radius]


def _radii(asks: DataFrame, sample: dict[int, np.ndarray], share: float, probed: int, k: int) -> DataFrame:
    """The queries with the radius of each, from sampled codes by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = np.full(batch.num_rows, BITS, np.int64), _column(batch, "dim").to_numpy()
            for i, code in enumerate(_codes(_column(batch, "code").flatten().to_numpy())):
                codes = sample.get(int(dims[i]), np.empty((0, WORDS), np.uint64))
                rank = max(k + 1, int(np.ceil(probed * share)))
                if len(codes) >= rank:
                    far = np.concatenate([distances(codes[a : a + STEP], code) for a in range(0, len(codes), STEP)])
                    out[i] = np.partition(far, rank - 1)[rank - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "radius"])

    return asks.mapInArrow(run, ", ".join([*(f"{c} {kind}" for c, kind in asks.dtypes), "radius long"]))


def _pairs(asks: DataFrame, codes: DataFrame, n_asks: int, n_codes: int) -> DataFrame:
    """(ask, cls) of the codes within each query's radius."""
    n_ask, n_code = max(1, -(-n_asks // QUERY_BLOCK)), max(1, -(-n_codes // CODE_BLOCK))
    # Numbers were given when the tables were written, so that blocks are the same whenever a task is run again.
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = asks.groupBy("dim", block("ask", n_ask).alias("qb")).agg(F.collect_list(F.struct("ask", "code", "radius")).alias("r")).select("dim", "qb", F.col("r.ask").alias("asks"), F.flatten("r.code").alias("q"), F.col("r.radius").alias("radii"))
    coded = codes.groupBy("dim", block("cls", n_code).alias("cb")).agg(F.collect_list(F.struct("cls", "code")).alias("r")).select("dim", "cb", F.col("r.cls").alias("classes"), F.flatten("r.code").alias("c"))
    # As many tasks as there are pairs, or as shuffles have: blocks are small, and else a few tasks would take them all.
    tasks = min(n_ask * n_code, int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_code - 1)))).repartition(tasks, "dim", "qb", "cb")
    coded = coded.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_ask - 1)))).repartition(tasks, "dim", "qb", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = lambda name, row=row, batch=batch: _column(batch, name)[row].values.to_numpy()
                index, classes, asks_ = Index(_codes(part("c"))), part("classes"), part("asks")
                for ask, code, radius in zip(asks_.tolist(), _codes(part("q")), part("radii").tolist(), strict=True):
                    found = index.within(code, radius)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(found.size, ask, np.int64)), pa.array(classes[found])], names=["ask", "cls"])

    return asked.join(coded, ["dim", "qb", "cb"]).select("asks", "q", "radii", "classes", "c").mapInArrow(run, "ask long, cls long")


def _sampled(table: DataFrame, n: int, *columns: str) -> list:
    """``n`` rows, the same whenever asked for."""
    return table.orderBy(F.xxhash64("cls"), "cls").limit(n).select(*columns).collect()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, probed: int = PROBED) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``queries`` against ``vectors``, both (vec_id, v, norm) as :func:`vectors_of` gives them."""
    classes = materialize(classes_of(vectors, k))
    asks = materialize(queries.withColumn("ask", F.monotonically_increasing_id()))
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    model = np.zeros(0), np.zeros((0, BITS))
    if size["n"]:
        learned = np.zeros((min(size["n"], LEARNED, max(BITS, LEARNED_BYTES // (8 * size["dim"]))), size["dim"]))
        for i, row in enumerate(_sampled(classes, len(learned), "v", "norm")):
            learned[i, : len(row["v"])] = np.array(row["v"]) / row["norm"]
        model = learn(learned)
        del learned
    dim = F.size("v").alias("dim")
    codes = materialize(_coded(classes, model).select("cls", dim, "code"))
    sample: dict[int, list] = {}
    for row in _sampled(codes, RADIUS_CODES, "dim", "code"):
        sample.setdefault(row["dim"], []).append(row["code"])
    share = min(1.0, RADIUS_CODES / max(1, size["n"]))
    by_dim = {d: _codes(np.array(c, np.int64).ravel()) for d, c in sample.items()}
    asked = materialize(_radii(_coded(asks, model).select("ask", dim, "code"), by_dim, share, probed, k))
    pairs = _pairs(asked, codes, asks.count(), size["n"])
    both = pairs.join(asks.select("ask", F.col("vec_id").alias("query_id"), F.col("v").alias("x"), F.col("norm").alias("x_norm")), "ask").join(classes, "cls")
    dot = F.aggregate(F.zip_with("x", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    others = F.filter("ids", lambda i: i != F.col("query_id"))
    scored = both.select("ask", "query_id", (dot / (F.col("x_norm") * F.col("norm"))).alias("score"), F.explode(others).alias("vec_id"))
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = vectors_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)
