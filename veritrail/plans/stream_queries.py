"""Alerts of whole tables replayed as a stream, against the batch detectors' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.plans.ledger_queries import ORACLES as LEDGER
from veritrail.plans.views import brisk, event_ledger, transfers
from veritrail.storage import new_path
from veritrail.streaming import stateful

#: After all rows of the tables, so that the watermark passes these; a row that the alerts keep, since only those move it.
END = 7_258_118_400_000_000
_ROW = "src string, dst string, amount double, ts timestamp"


def replayed(s, rows, alerts):
    """What ``alerts`` says of the rows (src, dst, amount, ts_micros), read as a stream of files to their end."""
    stateful.use_rocksdb(s)
    path = new_path(s, "replay")
    timed = rows.select("src", "dst", F.col("amount").cast("double").alias("amount"), F.timestamp_micros("ts_micros").alias("ts"))
    timed.write.parquet(f"{path}/in")
    s.createDataFrame([("nobody", "nobody", 9500.0)], "src string, dst string, amount double").withColumn("ts", F.timestamp_micros(F.lit(END))).write.mode("append").parquet(f"{path}/in")
    stream = s.readStream.schema(_ROW).parquet(f"{path}/in")
    found = alerts(stream)
    # State is kept in as many parts as shuffles have when a stream begins, each with a store and a worker of its own.
    key = "spark.sql.shuffle.partitions"
    before = s.conf.get(key)
    s.conf.set(key, str(min(int(before), 2 * s.sparkContext.defaultParallelism)))
    running = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
        s.conf.set(key, before)
    return s.read.schema(found.schema).parquet(f"{path}/out")


def structuring(s, d):
    """The strongest alert of each receiver: what the batch detector finds."""
    found = replayed(s, brisk(transfers(s, d)), stateful.structuring_alerts)
    best = found.groupBy("entity").agg(F.min(F.struct((-F.col("near_band_count")).alias("n"), "ts_micros", "window_total")).alias("b"))
    return best.select("entity", (-F.col("b.n")).alias("near_band_count"), F.col("b.window_total").alias("window_total"))


def burst(s, d):
    """The alert of each user's last event, where there is one: what the batch detector finds over all events."""
    rows = event_ledger(s, d)
    last = rows.groupBy(F.col("src").alias("entity")).agg(F.max("ts_micros").alias("ts_micros"))
    return replayed(s, rows, stateful.burst_alerts).join(last, ["entity", "ts_micros"]).drop("ts_micros")


QUERIES = {"stream_structuring": structuring, "stream_burst": burst}
ORACLES = {
    "stream_structuring": f"SELECT entities AS entity, near_band_count, window_total FROM ({LEDGER['structuring']})",
    "stream_burst": f"SELECT entities AS entity, peak_events_in_window, baseline_events_per_window, spike_ratio FROM ({LEDGER['burst_velocity']})",
}
