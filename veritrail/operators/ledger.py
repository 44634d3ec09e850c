"""The ledger: transfers (id, src, dst, amount, ts_micros, ...), a row each; either side may be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000


def money(amount: Column | str, window: WindowSpec | None = None) -> Column:
    """Sum of amounts; a missing amount counts as 0.

    Amounts are summed as decimals of ten places, so that the sum doesn't depend on the order of rows. Where one is too
    large for that (1e18 and more, or not finite), the sum is that of the doubles.
    """
    amount = F.coalesce(F.col(amount) if isinstance(amount, str) else amount, F.lit(0.0)).cast("double")
    over = (lambda c: c.over(window)) if window is not None else lambda c: c
    fits = F.abs(amount) < 1e18
    exact = over(F.try_sum(F.when(fits, amount).otherwise(0.0).cast("decimal(28,10)")))
    return F.when(over(F.min(fits)) & exact.isNotNull(), exact.cast("double")).otherwise(over(F.sum(amount)))


def entities(transfers: DataFrame) -> DataFrame:
    """(entity), each once."""
    return transfers.select(F.explode(F.array("src", "dst")).alias("entity")).where("entity is not null").distinct()


def entity_events(transfers: DataFrame) -> DataFrame:
    """(entity, ts_micros): a row for each side of a transfer; one to oneself gives two."""
    return transfers.select(F.explode(F.array("src", "dst")).alias("entity"), "ts_micros").where("entity is not null")


def outgoing(transfers: DataFrame) -> DataFrame:
    return transfers.where("src is not null").groupBy(F.col("src").alias("entity")).agg(F.count("*").alias("n_out"), money("amount").alias("total_out"))


def incoming(transfers: DataFrame) -> DataFrame:
    return transfers.where("dst is not null").groupBy(F.col("dst").alias("entity")).agg(F.count("*").alias("n_in"), money("amount").alias("total_in"))


def pairs(transfers: DataFrame) -> DataFrame:
    """(src, dst, n, amount) of transfers with both sides."""
    return transfers.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"), money("amount").alias("amount"))


def degrees(transfers: DataFrame) -> DataFrame:
    """(entity, degree, in_degree, out_degree, volume): distinct neighbours, transfers each way, and their value."""
    # Sums by two neighbours first, once for both of them: then a neighbour is a row, and no set of them is held.
    swapped = F.coalesce(F.col("src") > F.col("dst"), F.lit(False))
    ends = transfers.select(F.when(swapped, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(swapped, F.col("src")).otherwise(F.col("dst")).alias("b"), F.when(swapped, 0).otherwise(1).alias("there"), "amount")
    two = ends.groupBy("a", "b").agg(F.sum("there").alias("there"), F.sum(1 - F.col("there")).alias("back"), money("amount").alias("part"))
    side = lambda own, other, n_in, n_out: F.struct(F.col(own).alias("entity"), F.when(F.col(other) != F.col(own), F.col(other)).alias("other"), F.col(n_in).alias("n_in"), F.col(n_out).alias("n_out"))
    each = two.select(F.explode(F.array(side("a", "b", "back", "there"), side("b", "a", "there", "back"))).alias("s"), "part").select("s.*", "part").where("entity is not null")
    return each.groupBy("entity").agg(F.count("other").alias("degree"), F.sum("n_in").alias("in_degree"), F.sum("n_out").alias("out_degree"), money("part").alias("volume"))
