"""Alerts of single entities with exact rolling windows, by keyed state and event-time timers.

Rows wait in state until the watermark has passed them, and are then judged in order of time, so that late rows (up to the
watermark's delay) count as if they had come in time; later ones are dropped. State needs a store that can hold maps:
:func:`use_rocksdb` sets it for queries that start afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from veritrail.operators.ledger import HOUR

_TENTH = Decimal("1e-10")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Rolling(StatefulProcessor):
    """Events of one entity: a map of times to how many and how much, of those that wait and those within the window; what
    is known of all before; and the time of the earliest that waits, for which there is a timer."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "ts long", "n long, total string")
        self.past = handle.getValueState("past", "last long, first long, events long, peak long")
        self.due = handle.getValueState("due", "ts long")

    def _wait(self, ts: int) -> None:
        self.due.update((ts,))
        self.handle.registerTimer(-(-ts // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed, fresh = timerValues.getCurrentWatermarkInMs() * 1000, {}
        for batch in rows:
            for ts, amount in zip(batch["ts_micros"].tolist(), batch["amount"].tolist(), strict=True):
                if ts > passed:
                    n, total = fresh.get(ts, (0, Decimal(0)))
                    more = Decimal(repr(float(amount))).quantize(_TENTH, ROUND_HALF_UP) if amount == amount else Decimal(0)
                    fresh[ts] = n + 1, total + more
        # Each look at the state is a message to the JVM: there is nothing to look for where no event has been yet.
        known = bool(fresh) and (self.due.exists() or self.past.exists())
        for ts, (n, total) in fresh.items():
            before, sum_before = self.events.getValue((ts,)) if known and self.events.containsKey((ts,)) else (0, "0")
            self.events.updateValue((ts,), (before + n, str(Decimal(sum_before) + total)))
        if fresh and (not self.due.exists() or min(fresh) < self.due.get()[0]):
            self._wait(min(fresh))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.due.exists() or self.due.get()[0] > until:
            # Its events went with those of an earlier timer.
            yield pd.DataFrame()
            return
        last, first, count, peak = self.past.get() if self.past.exists() else (None, None, 0, 0)
        held = sorted((ts, n, Decimal(total)) for (ts,), (n, total) in self.events.iterator())
        out, start, n_in, total_in = [], 0, 0, Decimal(0)
        for ts, n, total in held:
            if ts > until:
                break
            n_in, total_in = n_in + n, total_in + total
            while held[start][0] < ts - self.window:
                n_in, total_in, start = n_in - held[start][1], total_in - held[start][2], start + 1
            if last is None or ts > last:
                last, first, count, peak = ts, ts if first is None else first, count + n, max(peak, n_in)
                out += self.judge(key[0], ts, n_in, float(total_in), first, count, peak)
        self.past.update((last, first, count, peak))
        gone = sum(ts < last - self.window for ts, *_ in held)
        if 2 * gone > len(held):
            # Fewer messages than one for each that goes.
            self.events.clear()
            for ts, n, total in held[gone:]:
                self.events.updateValue((ts,), (n, str(total)))
        else:
            for ts, *_ in held[:gone]:
                self.events.removeKey((ts,))
        waiting = [ts for ts, *_ in held if ts > until]
        if waiting:
            self._wait(waiting[0])
        else:
            self.due.clear()
        yield pd.DataFrame(out)

    def judge(self, entity: str, ts: int, n: int, total: float, first: int, count: int, peak: int) -> list[dict]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Structuring(_Rolling):
    def __init__(self, window: int, threshold: float, min_count: int) -> None:
        super().__init__(window)
        self.threshold, self.min_count = threshold, min_count

    def judge(self, entity, ts, n, total, first, count, peak):
        fits = n >= self.min_count and total >= self.threshold
        return [{"entity": entity, "ts_micros": ts, "near_band_count": n, "window_total": total}] if fits else []


class _Burst(_Rolling):
    def __init__(self, window: int, min_events: int, spike_factor: float) -> None:
        super().__init__(window)
        self.min_events, self.spike_factor = min_events, spike_factor

    def judge(self, entity, ts, n, total, first, count, peak):
        if count < self.min_events or peak < self.min_events or ts == first:
            return []
        baseline = count / ((ts - first) / float(self.window))
        ratio = peak / baseline
        return [{"entity": entity, "ts_micros": ts, "peak_events_in_window": peak, "baseline_events_per_window": baseline, "spike_ratio": ratio}] if ratio >= self.spike_factor else []


def _micros(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts_micros", F.unix_micros("ts"))


def structuring_alerts(stream: DataFrame, threshold: float = 10000.0, band_frac: float = 0.10, min_count: int = 3, window_hours: float = 72.0, late: str = "24 hours") -> DataFrame:
    """(entity, ts_micros, near_band_count, window_total): deposits with which those just under the threshold pass it together
    in the window that ends there. The strongest of an entity is the batch detector's."""
    near = _micros(stream.withWatermark("ts", late)).where((F.col("amount") >= threshold * (1.0 - band_frac)) & (F.col("amount") < threshold) & F.col("dst").isNotNull())
    keyed = near.select(F.col("dst").alias("entity"), "ts", "ts_micros", "amount").groupBy("entity")
    return keyed.transformWithStateInPandas(_Structuring(int(window_hours * HOUR), threshold, min_count), "entity string, ts_micros long, near_band_count long, window_total double", "Append", "EventTime")


def burst_alerts(stream: DataFrame, window_hours: float = 24.0, min_events: int = 5, spike_factor: float = 3.0, late: str = "24 hours") -> DataFrame:
    """(entity, ts_micros, peak_events_in_window, baseline_events_per_window, spike_ratio): transfers after which the batch
    detector would find their entity, over all its transfers so far."""
    sides = _micros(stream.withWatermark("ts", late)).select(F.explode(F.array("src", "dst")).alias("entity"), "ts", "ts_micros", "amount").where("entity is not null")
    return sides.groupBy("entity").transformWithStateInPandas(_Burst(int(window_hours * HOUR), min_events, spike_factor), "entity string, ts_micros long, peak_events_in_window long, baseline_events_per_window double, spike_ratio double", "Append", "EventTime")
