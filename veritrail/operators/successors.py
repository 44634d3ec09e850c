"""Chains over rows that each have one successor: which rows start a chain, and where each chain goes.

Rows are taken in order of ``rank`` (whole numbers, all different); a row that no earlier chain goes through starts one, if
it is ``able`` to, and goes on for ``reach`` steps. Whether a row is passed so depends on the rows before it. Rows without undecided
ones before them, and all that follow without a fork, are decided in one round, as streams sorted along the chains; what
reaches a fork is summed up by it, so that each round at least halves the number of loose ends. Rings, which have no beginning, come last, each
held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.operators.components import connected_components
from veritrail.storage import materialize

#: What rows of chains are known by while they are worked on.
LIVE = ["id", "rank", "next_id", "reach", "able"]


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``rank``, their place in order from 0: places within ranges, and what the ranges before hold."""
    ranged = materialize(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    # A row a range.
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1
    return ranged.join(F.broadcast(before), "__range").withColumn("rank", place + F.col("before")).drop("__range", "before")


def jumps(steps: DataFrame, most: int) -> list[DataFrame]:
    """For 1, 2, 4, ... steps until ``most``: (id, to, ahead), the row so far on, if there is one, and how many rows follow within
    that many steps. ``steps`` is (id, next_id), of which null means none."""
    out = [materialize(steps.select("id", F.col("next_id").alias("to"), F.when(F.col("next_id").isNotNull(), 1).otherwise(0).cast("long").alias("ahead")))]
    while 1 << len(out) - 1 < most:
        then = out[-1].select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("ahead").alias("more"))
        out.append(materialize(out[-1].join(then, "to", "left").select("id", F.col("then").alias("to"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"))))
    return out


#: Rows of a stretch that chains share are held together, 2 to this power.
HELD_BITS = 4


def walked(starts: DataFrame, rows: DataFrame, ways: list[DataFrame], most: int) -> DataFrame:
    """``starts`` (id, next_id, reach, ...) with ``w``: what is ``held`` by the rows (id, next_id, held) of each chain, in order.

    Chains that go on to one row share what follows it, which is put together once: stretches of 16 rows by doubling, and the
    stretches by jumps (:func:`jumps` of at least the rows that are others' next ones). So a chain's rows are arrays, shuffled a few times in all.
    """
    goal = starts.where("reach > 0").groupBy(F.col("next_id").alias("head")).agg(F.max("reach").alias("reach"))
    goal = materialize(goal)
    follow = rows.join(rows.select(F.col("next_id").alias("id")).where("id is not null").distinct(), "id", "left_semi")
    part = materialize(follow.select("id", F.array("held").alias("part")))
    for jump in ways[:HELD_BITS]:
        then = part.select(F.col("id").alias("to"), F.col("part").alias("more"))
        both = part.join(jump.select("id", "to"), "id").join(then, "to", "left")
        part = materialize(both.select("id", F.when(F.col("more").isNull(), F.col("part")).otherwise(F.concat("part", "more")).alias("part")))
    last = F.floor((F.col("reach") - 1) / (1 << HELD_BITS)).cast("long")
    at = goal.select("head", F.col("head").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at"))
    for k, jump in enumerate(ways[HELD_BITS:]):
        here = F.shiftright("at", k).bitwiseAND(1) == 1
        moved = at.where(here).join(jump.select(F.col("id").alias("row"), "to"), "row").select("head", F.col("to").alias("row"), "at")
        at = materialize(at.where(~here).unionByName(moved))
    each = at.join(part.withColumnRenamed("id", "row"), "row").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    after = each.select(F.col("head").alias("next_id"), F.flatten("parts.part").alias("after"))
    own = starts.join(rows.select("id", "held"), "id").join(after, "next_id", "left")
    onward = F.when(F.col("reach") > 0, F.slice("after", F.lit(1), F.col("reach").cast("int")))
    return own.withColumn("w", F.concat(F.array("held"), F.coalesce(onward, F.array().cast(after.schema["after"].dataType)))).drop("held", "after")


class _Passing:
    """The chains that go through the rows of a stretch: for each number of steps left, the least rank of such a chain."""

    def __init__(self) -> None:
        self.left: dict[int, int] = {}

    def add(self, rem: int, rank: int) -> None:
        if rem >= 0:
            self.left[rem] = min(rank, self.left.get(rem, rank))

    def decide(self, rank: int, reach: int, able: bool) -> bool:
        """Whether the row starts a chain; then on to the next."""
        starts = able and not any(q < rank for q in self.left.values())
        self.left = {rem - 1: q for rem, q in self.left.items() if rem}
        if starts:
            self.add(reach - 1, rank)
        return starts


_OUT = "id string, starts boolean, to string, rem long, rank long"


def _decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (head, at): what starts a chain, and what each stretch hands on."""
    head, passing, to = None, _Passing(), None

    def handed() -> list[tuple]:
        return [(None, None, to, rem, q) for rem, q in passing.left.items()] if to is not None else []

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.head != head:
                out += handed()
                head, passing = row.head, _Passing()
            for rem, q in zip(row.rems, row.ranks, strict=True):
                passing.add(int(rem), int(q))
            out.append((row.id, passing.decide(row.rank, row.reach, row.able), None, None, None))
            to = row.next_id
        yield pd.DataFrame(out, columns=["id", "starts", "to", "rem", "rank"])
    yield pd.DataFrame(handed(), columns=["id", "starts", "to", "rem", "rank"])


def _ring(rows: pd.DataFrame) -> pd.DataFrame:
    """A ring's rows that start chains: in order of rank, those that no chain has passed by then."""
    rows = rows.sort_values("rank")
    at = {x: i for i, x in enumerate(rows["id"])}
    after = [at[x] for x in rows["next_id"]]
    ranks, passed = rows["rank"].tolist(), [[] for _ in at]

    def go(i: int, rem: int, rank: int) -> None:
        for _ in range(rem + 1):
            passed[i].append(rank)
            i = after[i]

    for i, (rems, by) in enumerate(zip(rows["rems"], rows["ranks"], strict=True)):
        for rem, rank in zip(rems, by, strict=True):
            go(i, int(rem), int(rank))
    starts = []
    for i, (reach, able) in enumerate(zip(rows["reach"].tolist(), rows["able"].tolist(), strict=True)):
        starts.append(bool(able and not any(q < ranks[i] for q in passed[i])))
        if starts[-1]:
            go(after[i], reach - 1, ranks[i])
    return pd.DataFrame({"id": rows["id"], "starts": starts, "to": None, "rem": np.nan, "rank": np.nan}).astype({"rem": "Int64", "rank": "Int64"})


def chain_starts(rows: DataFrame) -> DataFrame:
    """(id) of the rows (id text, rank, next_id, reach, able) that start chains. ``reach`` never goes beyond the end, and
    ``next_id`` is a row's id or null."""
    live = materialize(rows.select(*LIVE))
    spark = rows.sparkSession
    inbox = spark.createDataFrame([], "id string, rem long, rank long")
    starts = spark.createDataFrame([], "id string")
    while not live.isEmpty():
        into = live.where("next_id is not null").groupBy(F.col("next_id").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("up"))
        # A stretch begins where no row comes before, or several do.
        way = materialize(live.join(into, "id", "left").select("id", F.when(F.col("n") == 1, F.col("up")).otherwise(F.col("id")).alias("head"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("at"), F.col("n").isNull().alias("loose"), (F.coalesce("n", F.lit(0)) != 1).alias("there")))
        size = way.count()
        if way.where("loose").isEmpty():
            break
        for _ in range(size.bit_length()):
            if way.where("not there").isEmpty():
                break
            far = way.select(F.col("id").alias("head"), F.col("head").alias("h"), F.col("at").alias("a"), F.col("loose").alias("l"), F.col("there").alias("t"))
            onward = lambda own, new: F.when(F.col("there"), F.col(own)).otherwise(F.col(new)).alias(own)
            way = materialize(way.join(far, "head").select("id", onward("head", "h"), F.when(F.col("there"), F.col("at")).otherwise(F.col("at") + F.col("a")).alias("at"), onward("loose", "l"), (F.col("there") | F.col("t")).alias("there")))
        found = materialize(_with_inbox(live, inbox).join(way.where("there and loose").select("id", "head", "at"), "id").repartition("head").sortWithinPartitions("head", "at").mapInPandas(_decided, _OUT))
        starts = starts.unionByName(found.where("starts").select("id"))
        done = found.where("id is not null").select("id")
        live = materialize(live.join(done, "id", "left_anti"))
        handed = found.where("to is not null").select(F.col("to").alias("id"), "rem", "rank")
        inbox = materialize(inbox.join(done, "id", "left_anti").unionByName(handed).groupBy("id", "rem").agg(F.min("rank").alias("rank")))
    if not live.isEmpty():
        ring = connected_components(live.select(F.col("id").alias("a"), F.col("next_id").alias("b"))).withColumnRenamed("node", "id")
        starts = starts.unionByName(_with_inbox(live, inbox).join(ring, "id").groupBy("component").applyInPandas(lambda rows: _ring(rows), _OUT).where("starts").select("id"))
    return starts


def _with_inbox(live: DataFrame, inbox: DataFrame) -> DataFrame:
    """Rows with the chains that come to them, of which there is one for each number of steps left."""
    held = inbox.groupBy("id").agg(F.collect_list("rem").alias("rems"), F.collect_list("rank").alias("ranks"))
    empty = lambda c: F.coalesce(c, F.array().cast("array<long>")).alias(c)
    return live.join(held, "id", "left").select(*LIVE, empty("rems"), empty("ranks"))
