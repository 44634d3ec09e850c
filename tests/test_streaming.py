"""Stateful alerts over a replayed ledger find what the batch detectors find, late rows included."""

import random

import pytest
from pyspark.sql import functions as F

from veritrail.operators import detectors
from veritrail.streaming import stateful

HOUR = 3_600_000_000
START = 1_767_225_600_000_000


@pytest.fixture(scope="module")
def ledger():
    """Rows in an order that is up to ten hours late, a week of two entities' bursts and deposits under the threshold."""
    rnd = random.Random(21)
    rows = []
    for i in range(160):
        ts = START + rnd.randrange(20 * 24) * HOUR + rnd.randrange(3) * 1_000_000
        rows.append((f"t{i}", rnd.choice("ab"), rnd.choice(["x", "y", "z", None]), rnd.choice([9500.0, 9100.5, 9999.99, 8000.0, 10000.0]), ts))
    rows += [(f"b{i}", "burst", "y", 5.0, START + 200 * HOUR + i * 60_000_000) for i in range(12)] + [("b", "burst", None, 1.0, START), ("c", "burst", None, 1.0, START + 450 * HOUR)]
    rows.sort(key=lambda r: r[4] + rnd.randrange(10) * HOUR)
    return rows


def replay(spark, tmp_path, rows, alerts, name):
    stateful.use_rocksdb(spark)
    schema = "id string, src string, dst string, amount double, ts_micros long"
    for i in range(0, len(rows), 30):
        part = spark.createDataFrame(rows[i : i + 30], schema).withColumn("ts", F.timestamp_micros("ts_micros")).drop("ts_micros").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = alerts(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_structuring(spark, tmp_path, ledger):
    end = [("end", "nobody", "nobody", 9500.0, START + 60 * 24 * HOUR)]
    found = replay(spark, tmp_path, ledger + end, stateful.structuring_alerts, "structuring_alerts")
    best = found.groupBy("entity").agg(F.min(F.struct((-F.col("near_band_count")).alias("n"), "ts_micros", "window_total")).alias("b"))
    got = {r["entity"]: (-r["b"]["n"], r["b"]["window_total"]) for r in best.collect()}
    batch = detectors.structuring(spark.createDataFrame(ledger, "id string, src string, dst string, amount double, ts_micros long"))
    assert got == {r["entities"][0]: (r["near_band_count"], r["window_total"]) for r in batch.collect()} and got


def test_burst(spark, tmp_path, ledger):
    end = [("end", "nobody", None, 1.0, START + 60 * 24 * HOUR)]
    found = replay(spark, tmp_path, ledger + end, stateful.burst_alerts, "burst_alerts")
    rows = spark.createDataFrame(ledger, "id string, src string, dst string, amount double, ts_micros long")
    last = {r["entity"]: r["t"] for r in rows.select(F.explode(F.array("src", "dst")).alias("entity"), "ts_micros").groupBy("entity").agg(F.max("ts_micros").alias("t")).collect()}
    got = {r["entity"]: (r["peak_events_in_window"], r["spike_ratio"]) for r in found.collect() if r["ts_micros"] == last[r["entity"]]}
    want = {r["entities"][0]: (r["peak_events_in_window"], pytest.approx(r["spike_ratio"])) for r in detectors.burst_velocity(rows).collect()}
    assert got == want and "burst" in got


def test_too_late(spark, tmp_path):
    """A row behind the watermark is dropped; the others' alert stays."""
    near = lambda i, hour: (f"n{i}", "a", "x", 9500.0, START + hour * HOUR)
    rows = [near(0, 1000), near(1, 1001), near(2, 1002), ("far", "a", "q", 9500.0, START + 1100 * HOUR)]
    filler = [("f%d" % i, "a", "q", 1.0, START + 1100 * HOUR) for i in range(26)]
    late = [near(3, 1003), ("end", "a", "q", 9500.0, START + 3000 * HOUR)]
    found = replay(spark, tmp_path, rows + filler + late, stateful.structuring_alerts, "late_alerts").where("entity = 'x'").collect()
    assert [(r["near_band_count"], r["window_total"]) for r in found] == [(3, 28500.0)]


def test_state_is_hardly_asked():
    """First events of an entity are only written, and those out of the window go together."""
    import pandas as pd
    from veritrail.streaming.stateful import _Burst

    class Kept:
        def __init__(self):
            self.rows, self.calls = {}, {}

        def __getattr__(self, name):
            def call(*args):
                self.calls[name] = self.calls.get(name, 0) + 1
                key = args[0] if args else None
                if name == "exists":
                    return bool(self.rows)
                if name == "get":
                    return self.rows[0]
                if name == "update":
                    self.rows[0] = key
                if name == "containsKey":
                    return key in self.rows
                if name == "getValue":
                    return self.rows[key]
                if name == "updateValue":
                    self.rows[key] = args[1]
                if name == "removeKey":
                    del self.rows[key]
                if name == "iterator":
                    return iter(list(self.rows.items()))
                if name == "clear":
                    self.rows.clear()

            return call

    class Handle:
        getMapState = getValueState = lambda self, *_: Kept()
        registerTimer = lambda self, _: None

    class Times:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    state = _Burst(1000, 5, 3.0)
    state.init(Handle())
    times = [10_000 * i for i in range(1, 51)]
    list(state.handleInputRows(("a",), iter([pd.DataFrame({"ts_micros": times, "amount": [1.0] * 50})]), Times(0)))
    assert state.events.calls == {"updateValue": 50}
    list(state.handleExpiredTimer(("a",), Times(1000), None))
    assert set(state.events.rows) == {(500_000,)} and state.past.get()[2] == 50 and "removeKey" not in state.events.calls
    list(state.handleInputRows(("a",), iter([pd.DataFrame({"ts_micros": [2_000_000, 2_000_000], "amount": [1.0, 2.0]})]), Times(1000)))
    list(state.handleInputRows(("a",), iter([pd.DataFrame({"ts_micros": [2_000_000], "amount": [4.0]})]), Times(1000)))
    assert state.events.rows[(2_000_000,)][0] == 3 and float(state.events.rows[(2_000_000,)][1]) == 7.0
