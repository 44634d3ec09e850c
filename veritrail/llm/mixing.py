"""Operator 5: mixing sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that each belongs to). A flow takes words
from patterns to the quotas of their sources; each further repetition of a pattern costs more than the last,
so that words are repeated only where fresh ones do not do. Within a pattern, documents are taken whole in a
seeded order until the flow is met, and one more whose size comes closest to what is missing.
The choice is a threshold on a hash for each pattern, so that texts are never shuffled for it.

A null text has size 0. A null source is a source of its own, last in order. Rows with the same id and text
share their decision; null ids are told apart by their text. An empty table gives an empty mix.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from veritrail.llm.common import bound_text_batches, worker_cache
from veritrail.storage import materialize

#: Membership patterns up to which plans are broadcast; larger ones are joined by shuffles.
MAX_PATTERNS = 5_000
WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 17
#: Ends and further documents of a pattern that are tried together to meet what is missing.
NEAR, NEXT = 32, 256
#: Below all hash ranges, which are the upper 12 bits.
_BELOW = -2049


@F.pandas_udf(LongType())
def word_count(texts: pd.Series) -> pd.Series:
    worker_cache("mixing", dict)
    return texts.map(lambda t: len(t.encode().split()) if t else 0).astype("int64")


def fill_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Share ``total`` by weight; what would exceed ``most`` times a source's size is shared among the others."""
    targets: dict = {}
    left, weight = total, sum(weights[s] for s in sizes)
    # Sources fill in order of the share by weight at which they are full.
    order = sorted(sizes, key=lambda s: most * sizes[s] / weights[s])
    for i, s in enumerate(order):
        if left * weights[s] / weight <= most * sizes[s]:
            return targets | {t: left * weights[t] / weight for t in order[i:]}
        targets[s] = float(most * sizes[s])
        left -= targets[s]
        weight -= weights[s]
    return targets


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, epochs: int) -> dict[tuple, int]:
    """Words taken of each pattern. Epoch e of a pattern costs e - 1 a word.

    All costs are at the start of a path, so that shortest paths are found by opening one epoch after the other;
    those of one cost are augmented together, by blocking flows over levels.
    """
    arcs: list[list[int]] = []  # to, room; the reverse of arc i is arc i ^ 1
    place = {s: 2 + i for i, s in enumerate(quotas)}
    first = 2 + len(place)
    at: list[list[int]] = [[] for _ in range(first + len(patterns))]

    def arc(a, b, room):
        at[a].append(len(arcs))
        at[b].append(len(arcs) + 1)
        arcs.extend([[b, room], [a, 0]])

    for i, pattern in enumerate(patterns):
        arc(0, first + i, 0)
        for s in pattern:
            arc(first + i, place[s], patterns[pattern] * epochs)
    starts = [i for i in at[0]]
    for s, quota in quotas.items():
        arc(place[s], 1, quota)

    def levels() -> list[int]:
        level, reached = [-1] * len(at), [0]
        level[0] = 0
        for a in reached:
            for i in at[a]:
                b, room = arcs[i]
                if room and level[b] < 0:
                    level[b] = level[a] + 1
                    reached.append(b)
        return level

    for _ in range(epochs):
        for i, size in zip(starts, patterns.values(), strict=True):
            arcs[i][1] += size
        while (level := levels())[1] >= 0:
            tried, path, a = [0] * len(at), [], 0
            while True:
                if a == 1:
                    room = min(arcs[i][1] for i in path)
                    for i in path:
                        arcs[i][1] -= room
                        arcs[i ^ 1][1] += room
                    path, a = [], 0
                while tried[a] < len(at[a]):
                    i = at[a][tried[a]]
                    if arcs[i][1] and level[arcs[i][0]] == level[a] + 1:
                        path.append(i)
                        a = arcs[i][0]
                        break
                    tried[a] += 1
                else:
                    if not path:
                        break
                    a = arcs[path.pop() ^ 1][0]
                    tried[a] += 1
    return {p: arcs[i ^ 1][1] for p, i in zip(patterns, starts, strict=True)}


def split_flow(patterns: dict[tuple, int], quotas: dict, epochs: int) -> dict[tuple, int]:
    """``min_cost_flow`` of each group of patterns that share sources; a source with one pattern of its own needs no search."""
    parent, place = {s: s for s in quotas}, {s: i for i, s in enumerate(quotas)}

    def root(s):
        while parent[s] != s:
            parent[s] = s = parent[parent[s]]
        return s

    for first, *others in filter(None, patterns):
        for s in others:
            parent[root(s)] = root(first)
    groups: dict = {}
    for pattern in patterns:
        if pattern:
            groups.setdefault(root(pattern[0]), {})[pattern] = patterns[pattern]
    flow = dict.fromkeys(patterns, 0)
    for group in groups.values():
        if len(group) == 1 and len(pattern := next(iter(group))) == 1:
            flow[pattern] = min(quotas[pattern[0]], group[pattern] * epochs)
        else:
            inside = {s for p in group for s in p}
            flow |= min_cost_flow(group, {s: quotas[s] for s in sorted(inside, key=place.__getitem__)}, epochs)
    return flow


def _code_points(sources) -> list:
    return sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]


def _ends(slim: DataFrame, rest: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(__pattern, upto_h, fill_h): rows up to one hash, and one more, whose sizes come closest to ``rest``.

    Counts by hash range show where the running sum passes ``rest``. Of the rows there, the last NEAR ends before
    that place and the first NEXT rows after it are tried together: a bounded number for each pattern.
    """
    slim = slim.withColumn("bucket", F.shiftright("__h", 52).cast("int"))
    running = Window.partitionBy("__pattern").orderBy("bucket")
    coarse = slim.groupBy("__pattern", "bucket").agg(F.sum("size").alias("sum"), F.count("*").alias("n")).withColumns({"upto": F.sum("sum").over(running), "rank": F.sum("n").over(running)})
    rest = small(rest)
    coarse = coarse.join(rest, "__pattern")
    place = coarse.where("upto > rest").groupBy("__pattern").agg(F.min(F.struct("bucket", "rank", "n")).alias("place"))
    near = coarse.join(small(place), "__pattern")
    low = near.where(F.col("rank") <= F.col("place.rank") - F.col("place.n") - NEAR).groupBy("__pattern").agg(F.max(F.struct("bucket", "upto")).alias("low"))
    high = near.where(F.col("rank") >= F.col("place.rank") + NEXT).groupBy("__pattern").agg(F.min("bucket").alias("high"))
    region = place.join(rest, "__pattern").join(low, "__pattern", "left").join(high, "__pattern", "left")
    region = region.select("__pattern", "rest", F.coalesce("low.bucket", F.lit(_BELOW)).alias("low"), F.coalesce("low.upto", F.lit(0)).alias("before"), F.coalesce("high", F.lit(-_BELOW)).alias("high"))
    order = Window.partitionBy("__pattern").orderBy("__h")
    rows = slim.join(small(region), "__pattern").where("bucket > low and bucket <= high").withColumn("upto", F.col("before") + F.sum("size").over(order)).withColumn("taken", F.col("upto") <= F.col("rest"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("__pattern", "taken").orderBy(F.when(F.col("taken"), -F.col("upto")).otherwise(F.col("upto")), F.when(F.col("taken"), -F.col("__h")).otherwise(F.col("__h")))))
    start = region.select("__pattern", "rest", F.when(F.col("low") == _BELOW, F.lit(-(2**63))).otherwise(F.shiftleft(F.col("low").cast("long") + 1, 52) - 1).alias("upto_h"), F.col("before").alias("upto"))
    heads = rows.where("taken").where(F.col("at") <= NEAR).select("__pattern", "rest", F.col("__h").alias("upto_h"), "upto").union(start)
    fills = rows.where("not taken").where(F.col("at") <= NEXT).select("__pattern", F.col("__h").alias("fill_h"), "size")
    fills = fills.union(region.select("__pattern", F.lit(None).cast("long"), F.lit(0).cast("long")))
    off = F.abs(F.col("rest") - F.col("upto") - F.col("size"))
    best = heads.join(fills, "__pattern").groupBy("__pattern").agg(F.min(F.struct(off.alias("off"), (-F.col("upto")).alias("least"), "upto_h", "fill_h")).alias("best"))
    return best.select("__pattern", "best.upto_h", "best.fill_h")


def mix(docs: DataFrame, sources: Column | None = None, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size and target (of the first source) and copies.

    ``sources``: an array of the sources of each row where they overlap, else the column source is it.
    ``weights``: by order of the sources, over and over, or a dict.
    """
    bound_text_batches(docs.sparkSession)
    own = F.array(F.col("source")) if sources is None else F.array_sort(F.array_distinct(sources))
    marked = docs.withColumns({"size": word_count("text"), "__pattern": F.to_json(own), "__h": F.xxhash64("doc_id", "text", F.lit(seed))})
    spark = docs.sparkSession
    slim = materialize(marked.select("size", "__pattern", "__h").groupBy("__pattern", "__h").agg(F.sum("size").alias("size")))
    sums = slim.groupBy("__pattern").agg(F.sum("size")).collect()
    small = F.broadcast if len(sums) <= MAX_PATTERNS else lambda rows: rows
    patterns = {tuple(json.loads(p)): n for p, n in sums}
    names = {tuple(json.loads(p)): p for p, _ in sums}
    order = _code_points({s for p in patterns for s in p})
    sizes = dict.fromkeys(order, 0)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    weight = weights if isinstance(weights, dict) else {s: weights[i % len(weights)] for i, s in enumerate(order)}
    targets = fill_targets(sizes, weight, share * sum(patterns.values()), epochs)
    flow = split_flow(patterns, {s: round(t) for s, t in targets.items()}, epochs)

    # Whole epochs, then words of one more: which documents, is found in hash order, coarse then fine.
    plan = [(names[p], sizes[p[0]] if p else 0, targets[p[0]] if p else 0.0, flow[p] // n if n else 0, flow[p] % n if n else 0) for p, n in patterns.items()]
    plan = spark.createDataFrame(plan, "__pattern string, source_size long, target double, epochs long, rest long")
    ends = _ends(slim, plan.where("rest > 0").select("__pattern", "rest"), small)
    plan = plan.drop("rest").join(ends, "__pattern", "left")
    # One row a pattern.
    chosen = marked.join(small(plan), "__pattern", "left")
    more = (F.col("__h") <= F.col("upto_h")) | (F.col("__h") == F.col("fill_h"))
    copies = F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long")
    return chosen.withColumn("copies", copies).drop("__pattern", "__h", "upto_h", "fill_h", "epochs")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
