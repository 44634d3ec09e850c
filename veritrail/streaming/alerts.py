"""Alerts over a stream of transfers (id, src, dst, amount, ts timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watchlist_alerts(stream: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Transfers with a watched entity (entity) on either side, as they arrive: a stream-static join."""
    sides = stream.select("id", "src", "dst", "amount", "ts", F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity"))
    return sides.join(watchlist.select("entity").distinct(), "entity")


def near_threshold_counts(stream: DataFrame, threshold: float = 10000.0, band_frac: float = 0.10, min_count: int = 3, window: str = "72 hours", slide: str = "12 hours", late: str = "24 hours") -> DataFrame:
    """Receivers with several deposits just under a threshold in a sliding window that pass it together.
    Deposits later than ``late`` are not counted."""
    near = stream.withWatermark("ts", late).where((F.col("amount") >= threshold * (1 - band_frac)) & (F.col("amount") < threshold) & F.col("dst").isNotNull())
    per = near.groupBy(F.window("ts", window, slide), "dst").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return per.where((F.col("n") >= min_count) & (F.col("total") >= threshold)).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "dst", "n", "total")
