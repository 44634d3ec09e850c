"""Operator 2: documents whose word shingles have a Jaccard similarity of 0.8 or more, as components of links.

Documents with the same words are one class, and classes are compared. Shingles are ordered rare-first by a
sketch of counts over all documents; a class is indexed by the prefix of its order that any set similar enough
must meet. Candidates that share a prefix shingle pass a length and a positional filter as pairs, then a
filter on counts by hash range, then the suffix filter and the exact overlap, once a pair.

Groups of near copies never give all their pairs. First each class is compared with one hub for each of its
prefix shingles and sizes; then only classes that the links so far leave in different components are, and there
the smaller set of a pair needs only the shorter prefix that a set at least as large must meet.

A shingle in very many classes is never gathered: tasks that meet it often send its rows around the shuffle that
finds shared shingles, and what is known of a shingle comes from aggregates that are joined back.

Words are lower-cased in A-Z only and split at ASCII white space. Fewer words than a shingle has are one
shingle; no words (or a null text) give the empty set, which links with nothing. Rows with a null id take
part, and their component is the least id in it, null where there is none. Repeated rows link with each other.
Shingles and classes are told apart by hashes of 57 and 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import arrow_batches, bit_filter, bound_text_batches, count_chunks, gram_hashes, mix64, summed_chunks, unpacked, word_hashes, worker_cache
from veritrail.operators.components import connected_components
from veritrail.storage import materialize

WORDS = 5
#: Similarity as a fraction.
UP, DOWN = 4, 5
#: Counters of the sketch (a power of two), hash ranges of the overlap bound, fewest and most bits of the class filter (powers of two).
SKETCH_BITS, RANGES, FILTER_BITS = 23, 256, (23, 28)
#: Prefix shingles a task holds, and classes that make a shingle dense among them.
_HELD, DENSE = 500_000, 8
#: Rows of an Arrow batch where each carries whole sets.
VERIFY_BATCH = 500

_PROFILE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("ranges", pa.binary()), ("chunk", pa.int32()), ("slot", pa.int64()), ("counts", pa.binary())])
_PROFILE_SQL = "doc_id long, text_hash long, cls long, n int, ranges binary, chunk int, slot long, counts binary"
#: Rows of a prefix: a shingle of a class; one that is dense in its task, and a sign that it is.
PLAIN, DENSE_ROW, SIGN = range(3)
_PREFIX = pa.schema([("k", pa.int64()), ("tok", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("i", pa.int32()), ("kind", pa.int32())])
_PREFIX_SQL = "k long, tok long, cls long, n int, i int, kind int"
_SET = pa.schema([("cls", pa.int64()), ("toks", pa.binary())])


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct shingle hashes of a sequence of words."""
    return np.unique(gram_hashes(word_hashes(words), min(WORDS, len(words)))) if words else np.empty(0, np.uint64)


def class_of(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[list[bytes]]:
    for text in batch.column(column):
        yield (text.as_py() or "").encode().lower().split()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end the task's share of the sketch."""
    worker_cache("near_duplicates", dict)
    sketch, held, size = np.zeros(1 << SKETCH_BITS, np.int32), [], 0

    def pour():
        if held:
            slots, times = np.unique(np.concatenate(held) & np.uint64((1 << SKETCH_BITS) - 1), return_counts=True)
            sketch[slots.astype(np.int64)] += times
            held.clear()

    for batch in batches:
        out = []
        for doc_id, text_hash, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2), strict=True):
            found = shingles(words)
            held.append(found)
            size += found.size
            ranges = np.minimum(np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes() if found.size else None
            out.append((doc_id, text_hash, class_of(words) if words else None, found.size, ranges, None, None, None))
            if size >= _HELD:
                pour()
                size = 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PROFILE, strict=True)], schema=_PROFILE)
    pour()
    chunks = count_chunks(sketch[None], TaskContext.get().partitionId())
    if chunks:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*[[None] * len(chunks)] * 5, *zip(*chunks, strict=True)], _PROFILE, strict=True)], schema=_PROFILE)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Counts as steps of half a power of two, up to 63."""
    return np.minimum(np.log2(np.maximum(counts, 1)) * 2, 63).astype(np.uint8)


def ordered_tokens(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as integers whose order is rare-first: the level of the count, then 57 bits of the hash."""
    level = levels[(found & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(57)) | (found >> np.uint64(7)))


def prefix_size(n: int) -> int:
    return n - -(-UP * n // DOWN) + 1


def least_overlap(n: Column, m: Column) -> Column:
    return F.ceil(F.lit(UP) * (n + m) / F.lit(UP + DOWN))


def index_size(n: Column) -> Column:
    """Elements of a set's order that any set at least as large, and similar enough, must meet."""
    return n - F.ceil(F.lit(2 * UP) * n / F.lit(UP + DOWN)) + 1


def _prefixes(levels) -> object:
    def emit(parts: list[tuple]) -> pa.RecordBatch:
        sizes = [p for *_, p in parts]
        toks, cls, n = np.concatenate([t for t, *_ in parts]), np.repeat([c for _, c, *_ in parts], sizes), np.repeat([n for _, _, n, _ in parts], sizes)
        i = np.concatenate([np.arange(p) for p in sizes])
        found, at, times = np.unique(toks, return_inverse=True, return_counts=True)
        dense, signs = times[at] >= DENSE, found[times >= DENSE]
        spread = mix64((toks + cls.view(np.uint64)).astype(np.uint64)).view(np.int64)
        zero = np.zeros(signs.size, np.int64)
        columns = [np.where(dense, spread, toks), toks, cls, n, i, np.where(dense, DENSE_ROW, PLAIN)]
        more = [signs, signs, zero, zero, zero, zero + SIGN]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(columns, more, strict=True), _PREFIX, strict=True)], schema=_PREFIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts, size = [], 0
        for batch in batches:
            for words in _texts(batch, 0):
                if not words or (cls := class_of(words)) in seen:
                    continue
                seen.add(cls)
                toks = ordered_tokens(shingles(words), levels.value)
                p = prefix_size(toks.size)
                parts.append((toks[:p].view(np.int64), cls, toks.size, p))
                size += p
                if size >= _HELD:
                    yield emit(parts)
                    parts, size = [], 0
            if len(seen) > 100_000:
                seen.clear()
        if parts:
            yield emit(parts)

    return run


def _sets(levels, bits) -> object:
    """The whole sets of the classes whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        wanted = bits.value
        mask = 8 * len(wanted) - 1
        for batch in batches:
            out = []
            for words in _texts(batch, 0):
                if not words or (cls := class_of(words)) in seen or not wanted[(cls & mask) >> 3] << (cls & 7) & 128:
                    continue
                seen.add(cls)
                out.append((cls, ordered_tokens(shingles(words), levels.value).tobytes()))
            if len(seen) > 100_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SET, strict=True)], schema=_SET)

    return run


def class_filter(classes: DataFrame) -> bytes:
    """A filter that has the bit of every class in ``classes`` (cls): some 16 bits for each, within FILTER_BITS."""
    classes = materialize(classes)
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * classes.count()).bit_length()))
    return bit_filter(classes.select(F.col("cls").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")), bits)


def suffix_distance(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """A lower bound of the number of elements in one of two sorted sets only: both are parted at the middle
    of one, and sizes of the parts compared, ``depth`` times over."""
    if depth == 0 or not x.size or not y.size:
        return abs(x.size - y.size)
    at = y.size // 2
    cut = int(np.searchsorted(x, y[at]))
    met = cut < x.size and x[cut] == y[at]
    return suffix_distance(x[:cut], y[:at], depth - 1) + suffix_distance(x[cut + met :], y[at + 1 :], depth - 1) + (not met)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """The suffix filter, then the exact test, for sorted sets."""
    least = -(-UP * (x.size + y.size) // (UP + DOWN))
    if x.size + y.size - suffix_distance(x, y, 2) < 2 * least:
        return False
    at = np.searchsorted(y, x)
    at[at == y.size] = y.size - 1
    same = int((y[at] == x).sum())
    return DOWN * same >= UP * (x.size + y.size - same)


def _by_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose counts by hash range allow the overlap; a count of 255 may be any larger one."""
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        x, y = (np.frombuffer(b"".join(get(c).to_pylist()), np.uint8).reshape(-1, RANGES) for c in ("ra", "rb"))
        most = np.minimum(x, y)
        n, m = (get(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
        keep = ((UP + DOWN) * most.sum(axis=1, dtype=np.int64) >= UP * (n + m)) | (most == 255).any(axis=1)
        yield batch.filter(pa.array(keep)).select(["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(get("ta"), get("tb"), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, levels) -> tuple[DataFrame, DataFrame]:
    """(pairs that were tried, links among them), of distinct candidate pairs (a, b)."""
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("ranges").alias(f"r{s}"), F.col("n").alias(f"n{s}"))
    spark = texts.sparkSession
    pairs = materialize(pairs)
    some = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_by_ranges, "a long, b long"))
    bits = spark.sparkContext.broadcast(class_filter(some.select(F.explode(F.array("a", "b")).alias("cls")).distinct()))
    whole = lambda s: sets.select(F.col("cls").alias(s), F.col("toks").alias(f"t{s}"))
    with arrow_batches(spark, VERIFY_BATCH):
        sets = materialize(texts.mapInArrow(_sets(levels, bits), "cls long, toks binary").dropDuplicates(["cls"]))
        links = materialize(some.join(whole("a"), "a").join(whole("b"), "b").mapInArrow(_verify, "a long, b long"))
    return pairs, links


def _fits(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Length and positional filter for a shared token at i and j."""
    return (F.lit(DOWN) * F.least(n, m) >= F.lit(UP) * F.greatest(n, m)) & (F.least(n - i, m - j) >= least_overlap(n, m))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, component) for ``docs`` (doc_id, text).

    ``text_hash`` is xxhash64 of the text, by which rows that share an id are known; ``component`` names the
    component where ids don't, and is null for empty sets.
    """
    spark = docs.sparkSession
    bound_text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = docs.select("text")
    profile = materialize(docs.mapInArrow(_profile, _PROFILE_SQL))
    rows = profile.where("chunk is null").select("doc_id", "text_hash", "cls", "n")
    classes = profile.where("chunk is null and cls is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"))
    # The sketch has a fixed number of counters, whatever the corpus.
    chunks = summed_chunks(profile.where("chunk is not null").select("chunk", "slot", "counts"), docs.rdd.getNumPartitions())
    table = np.zeros(1 << SKETCH_BITS, np.uint8)
    for place, counts in unpacked(chunks.collect()):
        table[place] = levels_of(counts[0])
    levels = spark.sparkContext.broadcast(table)

    same = Window.partitionBy("k")
    shared = texts.mapInArrow(_prefixes(levels), _PREFIX_SQL)
    plain = F.when(F.col("kind") == PLAIN, F.col("cls"))
    met = (F.min(plain).over(same) != F.max(plain).over(same)) | (F.max("kind").over(same) == SIGN)
    shared = materialize(shared.withColumn("met", met).where(f"kind = {DENSE_ROW} or kind = {PLAIN} and met").select("tok", "cls", "n", "i"))

    # The hub of a group is the class that shares most with others, such as the text that copies were made from:
    # one of all sizes, and one for each class's own range of sizes (of which there are few).
    central = shared.join(shared.groupBy("tok").agg(F.count("*").alias("df")), "tok").groupBy("cls").agg(F.sum("df").alias("c"))
    ranked = shared.join(central, "cls").withColumn("size", F.floor(F.log("n") / F.log(F.lit(DOWN / UP))).cast("int"))
    sized = ranked.groupBy("tok", "size").agg(F.max(F.struct("c", "cls", "n", "i")).alias("hub"))
    hubs = sized.groupBy("tok").agg(F.max("hub").alias("any"), F.map_from_entries(F.collect_list(F.struct("size", "hub"))).alias("sized"))
    hubs = ranked.join(hubs, "tok").withColumn("hub", F.explode(F.array("any", F.col("sized")[F.col("size")])))
    hubs = hubs.where(F.col("hub.cls") != F.col("cls")).where(_fits(F.col("n"), F.col("i"), F.col("hub.n"), F.col("hub.i")))
    ordered = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    tried, links = _links(hubs.select(*ordered(F.col("cls"), F.col("hub.cls"))).distinct(), classes, texts, levels)
    parts = materialize(connected_components(links))

    label = parts.select(F.col("node").alias("cls"), F.col("component").alias("label"))
    labelled = shared.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    apart = labelled.groupBy("tok").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("tok")
    open_ = materialize(labelled.join(apart, "tok").dropDuplicates(["tok", "cls"]))
    x, y = open_.alias("x"), open_.where(F.col("i") < index_size(F.col("n"))).alias("y")
    larger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cls") > F.col("y.cls")))
    unlinked = (F.col("x.tok") == F.col("y.tok")) & larger & (F.col("x.label") != F.col("y.label"))
    fits = _fits(F.col("x.n"), F.col("x.i"), F.col("y.n"), F.col("y.i"))
    rest = x.join(y, unlinked & fits).select(*ordered(F.col("x.cls"), F.col("y.cls"))).distinct().join(tried, ["a", "b"], "left_anti")
    _, more = _links(rest, classes, texts, levels)
    component = connected_components(links.union(more)).select(F.col("node").alias("cls"), F.col("component").alias("label"))

    # What is known of a class is worked out class by class; rows, of which one may have very many, are joined once.
    firsts = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first")).join(component, "cls", "left").withColumn("component", F.coalesce("label", "cls"))
    least = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    known = materialize(firsts.select("cls", "component").join(least, "component"))
    return rows.join(known, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "component")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r(a, b) AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (
  SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
