"""Transactions (txid, ts, inputs, outputs: arrays of (address, value), ordinal): clusters, mixers and chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.scalars import clamp
from veritrail.operators import successors
from veritrail.operators.components import ONE_TASK_EDGES, connected_components
from veritrail.storage import materialize

#: Steps of a chain, at most.
LONGEST = 100
TRANSACTION = "txid string, ts string, inputs array<struct<address:string,value:double>>, outputs array<struct<address:string,value:double>>, ordinal long"


def common_input_clusters(txs: DataFrame) -> DataFrame:
    """(address, cluster): addresses spent together, named by the least of them. Addresses that only receive are not in it."""
    ins = txs.select(F.element_at(F.transform("inputs", lambda i: i["address"]), 1).alias("a"), F.explode("inputs").alias("i")).select("a", F.col("i.address").alias("b"))
    return connected_components(ins).select(F.col("node").alias("address"), F.col("component").alias("cluster"))


def flow(txs: DataFrame) -> DataFrame:
    """(txid, source, target, in_value, out_value, ts): every input with every output of a transaction."""
    return txs.select("txid", "ts", F.explode("inputs").alias("i"), "outputs").select("txid", "ts", "i", F.explode("outputs").alias("o")).select("txid", F.col("i.address").alias("source"), F.col("o.address").alias("target"), F.col("i.value").alias("in_value"), F.col("o.value").alias("out_value"), "ts")


def flow_totals(txs: DataFrame, tasks: int) -> DataFrame:
    """(source, target, n, value): flows of two addresses, dealt out to ``tasks`` tasks. Nearly each has two of its own, so that
    summing them up ahead of the shuffle would hold them all and save nothing."""
    dealt = flow(txs).select("source", "target", "out_value").repartition(tasks, "source", "target")
    return dealt.groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("out_value").alias("value"))


def trace(txs: DataFrame, seed: str, direction: str = "forward", max_hops: int = 4) -> DataFrame:
    """(txid, source, target, value, ts, hop): all flows out of (or, backward, into) addresses fewer than ``max_hops`` away."""
    here, there, value = ("source", "target", "out_value") if direction == "forward" else ("target", "source", "in_value")
    edges = materialize(flow(txs))
    frontier = seen = txs.sparkSession.createDataFrame([(seed,)], "address string")
    flows = edges.limit(0).withColumn("hop", F.lit(0))
    for hop in range(1, max_hops + 1):
        step = materialize(edges.join(frontier, edges[here] == frontier["address"], "left_semi"))
        flows = flows.unionByName(step.withColumn("hop", F.lit(hop)))
        frontier = materialize(step.select(F.col(there).alias("address")).distinct().join(seen, "address", "left_anti"))
        seen = seen.unionByName(frontier)
    return flows.select("txid", "source", "target", F.col(value).alias("value"), "ts", F.col("hop").cast("long").alias("hop"))


def mixers(txs: DataFrame, min_in: int = 3, min_out: int = 3, uniformity: float = 0.1) -> DataFrame:
    """Transactions of many inputs and many outputs of like value."""
    # Spark puts what a column is made of into each use of it, and into each step of a fold over values; a row of its own is worked out once.
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    sides = F.struct(F.size("inputs").alias("n_in"), F.size("outputs").alias("n_out"), F.transform("outputs", lambda o: o["value"]).alias("values"))
    wide = txs.select("txid", once(sides, "s")).where((F.col("s.n_in") >= min_in) & (F.col("s.n_out") >= min_out)).select("txid", "s.*")
    add = lambda acc, v: acc + v
    wide = wide.select("*", once(F.aggregate("values", F.lit(0.0), add) / F.size("values"), "mean")).where("mean > 0")
    variance = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + (v - F.col("mean")) * (v - F.col("mean"))) / F.size("values")
    out = wide.select("*", once(F.sqrt(variance) / F.col("mean"), "cv")).where(F.col("cv") <= uniformity)
    return out.select("txid", F.col("n_in").cast("long").alias("n_inputs"), F.col("n_out").cast("long").alias("n_outputs"), "cv", clamp(F.lit(0.6) + (F.lit(uniformity) - F.col("cv")), 0.0, 0.95).alias("score"))


def demix(txs: DataFrame, mixer_ids: DataFrame | None = None, amount_tol: float = 0.05) -> DataFrame:
    """Inputs and outputs of mixers with nearly the same value; the more outputs an input fits, the less each counts."""
    ids = mixers(txs).select("txid") if mixer_ids is None else mixer_ids.select("txid").distinct()
    ins = txs.join(ids, "txid", "left_semi").select("txid", "outputs", F.posexplode("inputs").alias("at", "i")).where("i.value > 0")
    both = ins.select("txid", "at", F.col("i.address").alias("input"), F.col("i.value").alias("input_value"), F.explode("outputs").alias("o")).select("txid", "at", "input", "input_value", F.col("o.address").alias("output"), F.col("o.value").alias("output_value"))
    rel = F.abs(F.col("output_value") - F.col("input_value")) / F.col("input_value")
    near = both.withColumn("rel", rel).where(F.col("rel") <= amount_tol).withColumn("ambiguity", F.count("*").over(Window.partitionBy("txid", "at")))
    base = F.when(F.col("ambiguity") == 1, 0.7).otherwise(clamp(F.lit(0.7) / F.col("ambiguity") + F.lit(0.2), 0.0, 0.7))
    return near.select("txid", "input", "output", "input_value", "output_value", "ambiguity", clamp(base * (F.lit(1.0) - F.col("rel")), 0.0, 0.9).alias("confidence"))


def peel_steps(txs: DataFrame, ratio: float = 3.0) -> DataFrame:
    """(txid, ordinal, remainder, remainder_value, peel, peel_value) of transactions with one small and one large output."""
    a, b = F.element_at("outputs", 1), F.element_at("outputs", 2)
    first = a["value"] >= b["value"]
    two = txs.where(F.size("outputs") == 2).select("txid", "ordinal", F.when(first, a).otherwise(b).alias("big"), F.when(first, b).otherwise(a).alias("small"))
    return two.where((F.col("small.value") > 0) & (F.col("big.value") >= F.lit(ratio) * F.col("small.value"))).select("txid", "ordinal", F.col("big.address").alias("remainder"), F.col("big.value").alias("remainder_value"), F.col("small.address").alias("peel"), F.col("small.value").alias("peel_value"))


def peel_chains(txs: DataFrame, min_len: int = 2, ratio: float = 3.0, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(txids, peels, length): chains of peel steps, each spent first by the next; starts inside a found chain are passed over.

    Up to ``one_task`` steps are followed by one task, more by :mod:`veritrail.operators.successors`, with the same result."""
    steps = materialize(peel_steps(txs, ratio))
    spender = txs.select("txid", "ordinal", F.explode("inputs").alias("i")).groupBy(F.col("i.address").alias("remainder")).agg(F.min(F.struct("ordinal", "txid")).alias("s")).select("remainder", F.col("s.txid").alias("next_id"))
    onward = steps.join(spender, "remainder").join(steps.select(F.col("txid").alias("next_id")), "next_id", "left_semi").select("txid", "next_id")
    linked = materialize(steps.join(onward, "txid", "left").select(F.col("txid").alias("id"), "ordinal", "peel", "next_id"))
    if linked.count() <= one_task:
        return linked.coalesce(1).mapInPandas(_followed(min_len), "txids array<string>, peels array<string>, length long")
    # Most steps are no other's next one, and what follows them is known from their next one.
    inner = materialize(linked.join(linked.select(F.col("next_id").alias("id")).where("id is not null").distinct(), "id", "left_semi"))
    ways = successors.jumps(inner, LONGEST)
    ahead = F.when(F.col("next_id").isNull(), 0).otherwise(F.least(F.col("ahead") + 1, F.lit(LONGEST - 1))).cast("long").alias("reach")
    follow = ways[-1].select(F.col("id").alias("next_id"), "ahead")
    rows = successors.ranked(linked, "ordinal", "id").join(follow, "next_id", "left").select("id", "rank", "next_id", ahead, "peel")
    rows = materialize(rows.withColumn("able", F.col("reach") + 1 >= min_len))
    starts = successors.chain_starts(rows).join(rows.select("id", "next_id", "reach"), "id")
    held = linked.select("id", "next_id", F.struct(F.col("id").alias("row"), "peel").alias("held"))
    return successors.walked(starts, held, ways, LONGEST).select(F.col("w.row").alias("txids"), F.col("w.peel").alias("peels"), F.size("w").cast("long").alias("length"))


def _followed(min_len: int):
    """The chains of all steps, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame({c: [] for c in ("id", "ordinal", "peel", "next_id")})]).sort_values(["ordinal", "id"])
        ids, peels = rows["id"].tolist(), rows["peel"].tolist()
        place = {x: i for i, x in enumerate(ids)}
        after = [place.get(x, -1) for x in rows["next_id"].tolist()]
        used, out = bytearray(len(ids)), []
        for start in range(len(ids)):
            if used[start]:
                continue
            walk, at = [], start
            while at >= 0 and len(walk) < LONGEST:
                walk.append(at)
                at = after[at]
            if len(walk) >= min_len:
                for i in walk:
                    used[i] = 1
                out.append(([ids[i] for i in walk], [peels[i] for i in walk], len(walk)))
        yield pd.DataFrame(out, columns=["txids", "peels", "length"])

    return run
