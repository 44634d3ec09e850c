"""Detectors that need a ledger's rows by entity: seven of the eleven typologies.

Each returns typed columns with ``entities`` (array) and the unrounded ``score``; :func:`as_findings` makes
one shape of them. Scores are leads for review.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.scalars import band, clamp, finding_id
from veritrail.operators.ledger import DAY, HOUR, entity_events, money


#: What a finding says of itself: a format, and the features that fill it.
EVIDENCE = {
    "structuring": ("%d deposits just under the threshold, %.0f in one window, %.1f times the threshold", "near_band_count", "window_total", "aggregate_ratio"),
    "layering": ("%d onward transfers, from %.0f to %.0f", "hops", "start_amount", "end_amount"),
    "pass_through": ("received %.0f and sent on %.0f, after %.1f hours as a rule", "total_in", "total_out", "median_hold_hours"),
    "round_tripping": ("%d entities in a ring, %.0f out and %.0f back", "cycle_len", "origin_amount", "return_amount"),
    "trade_value_anomaly": ("paid %.0f for goods of %.0f, off by %.2f of their value", "paid", "goods_value", "deviation"),
    "shell_nominee": ("%d entities move %.0f among themselves and %.0f beyond", "cluster_size", "internal_value", "external_value"),
    "funnel_account": ("%d sources in %d regions, %d destinations, %.0f received", "source_count", "region_count", "dest_count", "total_in"),
    "sanctions_nexus": ("%d transfers away from a listed entity", "hops_to_watchlist"),
    "burst_velocity": ("%d events in one window, %.1f times the usual number", "peak_events_in_window", "spike_ratio"),
    "dormancy_activation": ("silent for %.0f days after %d events, then %d more", "dormant_days", "prior_events", "post_events"),
    "periodicity": ("%d events every %.1f hours, with a variation of %.2f", "events", "mean_interval_hours", "interval_cv"),
}


def evidence(typology: str) -> Column:
    """A sentence on a finding of a known typology, else null."""
    if typology not in EVIDENCE:
        return F.lit(None).cast("string")
    text, *names = EVIDENCE[typology]
    kinds = ["long" if k == "d" else "double" for k in re.findall(r"%[.\d]*([df])", text)]
    return F.format_string(text, *(F.col(n).cast(k) for n, k in zip(names, kinds, strict=True)))


def as_findings(found: DataFrame, typology: str) -> DataFrame:
    """(id, typology, entities, score, severity, features as JSON, evidence as a sentence)."""
    features = [c for c in found.columns if c not in ("entities", "score")]
    score = F.round("score", 4)
    return found.select(finding_id(F.lit(typology), F.col("entities")).alias("id"), F.lit(typology).alias("typology"), "entities", score.alias("score"), band(score).alias("severity"), F.to_json(F.struct(*features)).alias("features"), evidence(typology).alias("evidence"))


def structuring(transfers: DataFrame, threshold: float = 10000.0, band_frac: float = 0.10, min_count: int = 3, window_hours: float = 72.0) -> DataFrame:
    """Deposits just under a threshold that pass it together within a rolling window."""
    low = threshold * (1.0 - band_frac)
    near = transfers.where(F.col("dst").isNotNull() & (F.col("amount") >= low) & (F.col("amount") < threshold))
    window = Window.partitionBy("dst").orderBy("ts_micros").rangeBetween(-int(window_hours * HOUR), 0)
    rolling = near.select("dst", "ts_micros", F.count("*").over(window).alias("n"), money("amount", window).alias("total"))
    best = rolling.where((F.col("n") >= min_count) & (F.col("total") >= threshold)).groupBy("dst").agg(F.min(F.struct((-F.col("n")).alias("n"), "ts_micros", "total")).alias("best"))
    out = best.select("dst", (-F.col("best.n")).alias("near_band_count"), F.col("best.total").alias("window_total"))
    ratio = F.col("window_total") / F.lit(threshold)
    score = clamp(F.lit(0.45) + F.lit(0.08) * (F.col("near_band_count") - min_count) + F.lit(0.15) * F.least(ratio - 1.0, F.lit(2.0)))
    return out.select(F.array("dst").alias("entities"), score.alias("score"), "near_band_count", "window_total", ratio.alias("aggregate_ratio"), F.lit(float(threshold)).alias("threshold"), F.lit(low).alias("band_low"))


def next_outflow(transfers: DataFrame) -> DataFrame:
    """(entity, ts_micros, next_out): for each inflow the first outflow at or after it."""
    ins = transfers.where("dst is not null").select(F.col("dst").alias("entity"), "ts_micros", F.lit(None).cast("long").alias("out_ts"))
    outs = transfers.where("src is not null").select(F.col("src").alias("entity"), "ts_micros", F.col("ts_micros").alias("out_ts"))
    onward = Window.partitionBy("entity").orderBy("ts_micros").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return ins.unionByName(outs).withColumn("next_out", F.first("out_ts", ignorenulls=True).over(onward)).where("out_ts is null").drop("out_ts")


def pass_through(transfers: DataFrame, hold_hours: float = 48.0, forward_frac: float = 0.80, min_amount: float = 0.0) -> DataFrame:
    """Accounts that forward most of what they receive, soon."""
    ins = transfers.where("dst is not null").groupBy(F.col("dst").alias("entity")).agg(money("amount").alias("total_in"))
    outs = transfers.where("src is not null").groupBy(F.col("src").alias("entity")).agg(money("amount").alias("total_out"))
    flows = ins.where((F.col("total_in") > 0) & (F.col("total_in") >= min_amount)).join(outs, "entity").withColumn("forward_fraction", F.col("total_out") / F.col("total_in"))
    flows = flows.where(F.col("forward_fraction") >= forward_frac)
    by_hold = Window.partitionBy("entity").orderBy("hold")
    # The upper median: the middle of the sorted holds, by rank, so that no list is gathered.
    holds = next_outflow(transfers).where("next_out is not null").select("entity", (F.col("next_out") - F.col("ts_micros")).alias("hold"))
    holds = holds.withColumns({"at": F.row_number().over(by_hold), "n": F.count("*").over(Window.partitionBy("entity"))})
    median = holds.where(F.col("at") == F.floor(F.col("n") / 2) + 1).select("entity", (F.col("hold") / F.lit(float(HOUR))).alias("median_hold_hours"))
    out = flows.join(median.where(F.col("median_hold_hours") <= hold_hours), "entity")
    score = clamp(F.lit(0.4) + F.lit(0.3) * F.least(F.col("forward_fraction"), F.lit(1.0)) + F.lit(0.2) * (F.lit(1.0) - F.col("median_hold_hours") / F.lit(hold_hours)))
    return out.select(F.array("entity").alias("entities"), score.alias("score"), "total_in", "total_out", "forward_fraction", "median_hold_hours")


def trade_value_anomaly(transfers: DataFrame, min_deviation: float = 0.30) -> DataFrame:
    """Payments far from the stated value of the goods."""
    out = transfers.where("goods_value > 0 and amount is not null").withColumn("deviation", (F.col("amount") - F.col("goods_value")) / F.col("goods_value"))
    out = out.where(F.abs("deviation") >= min_deviation)
    score = clamp(F.lit(0.4) + F.lit(0.4) * F.least(F.abs("deviation"), F.lit(1.5)) / F.lit(1.5))
    direction = F.when(F.col("deviation") > 0, "over-invoicing").otherwise("under-invoicing")
    return out.select(F.array("src", "dst").alias("entities"), score.alias("score"), F.col("amount").alias("paid"), "goods_value", "deviation", direction.alias("direction"), "counterparty_country")


def funnel_account(transfers: DataFrame, min_sources: int = 5, min_regions: int = 3, max_dests: int = 2) -> DataFrame:
    """Many sources in, few destinations out."""
    region = F.when(F.col("counterparty_country") != "", F.col("counterparty_country"))
    ins = transfers.where("dst is not null").groupBy(F.col("dst").alias("entity")).agg(F.countDistinct("src").alias("source_count"), F.countDistinct(region).alias("region_count"), money("amount").alias("total_in"))
    outs = transfers.where("src is not null").groupBy(F.col("src").alias("entity")).agg(F.countDistinct("dst").alias("dest_count"))
    out = ins.where(F.col("source_count") >= min_sources).join(outs, "entity").where(F.col("dest_count").between(1, max_dests) & ((F.col("region_count") == 0) | (F.col("region_count") >= min_regions)))
    score = clamp(F.lit(0.45) + F.lit(0.04) * (F.col("source_count") - min_sources) + F.lit(0.05) * F.col("region_count") + F.lit(0.1) * (F.lit(max_dests + 1) - F.col("dest_count")))
    return out.select(F.array("entity").alias("entities"), score.alias("score"), "source_count", "region_count", "dest_count", "total_in")


def burst_velocity(transfers: DataFrame, window_hours: float = 24.0, min_events: int = 5, spike_factor: float = 3.0) -> DataFrame:
    """Entities with one window far busier than their own average."""
    events = entity_events(transfers).where("ts_micros > 0")
    window = Window.partitionBy("entity").orderBy("ts_micros").rangeBetween(-int(window_hours * HOUR), 0)
    per = events.withColumn("n", F.count("*").over(window)).groupBy("entity").agg(F.count("*").alias("events"), F.max("n").alias("peak_events_in_window"), (F.max("ts_micros") - F.min("ts_micros")).alias("span"))
    per = per.where((F.col("events") >= min_events) & (F.col("span") > 0) & (F.col("peak_events_in_window") >= min_events))
    per = per.withColumn("baseline_events_per_window", F.col("events") / (F.col("span") / F.lit(window_hours * HOUR)))
    per = per.withColumn("spike_ratio", F.col("peak_events_in_window") / F.col("baseline_events_per_window")).where(F.col("spike_ratio") >= spike_factor)
    score = clamp(F.lit(0.4) + F.lit(0.12) * F.least(F.col("spike_ratio") - F.lit(spike_factor), F.lit(5.0)))
    return per.select(F.array("entity").alias("entities"), score.alias("score"), "peak_events_in_window", "baseline_events_per_window", "spike_ratio", F.lit(float(window_hours)).alias("window_hours"))


def dormancy_activation(transfers: DataFrame, dormancy_days: float = 90.0, min_prior: int = 2, burst_after: int = 3) -> DataFrame:
    """The first long gap of an entity that activity follows."""
    order = Window.partitionBy("entity").orderBy("ts_micros")
    events = entity_events(transfers).where("ts_micros > 0")
    gaps = events.select("entity", (F.col("ts_micros") - F.lag("ts_micros").over(order)).alias("gap"), (F.row_number().over(order) - 1).cast("long").alias("prior"), F.count("*").over(Window.partitionBy("entity")).alias("n"))
    good = gaps.where((F.col("gap") >= int(dormancy_days * DAY)) & (F.col("prior") >= min_prior) & (F.col("n") - F.col("prior") >= burst_after))
    first = good.groupBy("entity").agg(F.min(F.struct("prior", "gap", "n")).alias("g")).select("entity", (F.col("g.gap") / F.lit(float(DAY))).alias("dormant_days"), F.col("g.prior").alias("prior_events"), (F.col("g.n") - F.col("g.prior")).alias("post_events"))
    score = clamp(F.lit(0.45) + F.lit(0.1) * F.least(F.col("dormant_days") / F.lit(dormancy_days), F.lit(3.0)) + F.lit(0.03) * (F.col("post_events") - burst_after))
    return first.select(F.array("entity").alias("entities"), score.alias("score"), "dormant_days", "prior_events", "post_events")


def periodicity(transfers: DataFrame, min_events: int = 6, cv_threshold: float = 0.15) -> DataFrame:
    """Entities whose gaps hardly vary. The variation is worked out in whole milliseconds, exactly."""
    times = entity_events(transfers).where("ts_micros > 0").distinct()
    gap = F.floor((F.col("ts_micros") - F.lag("ts_micros").over(Window.partitionBy("entity").orderBy("ts_micros"))) / 1000).cast("decimal(18,0)")
    gaps = times.withColumn("gap", gap)
    per = gaps.groupBy("entity").agg(F.count("*").alias("events"), F.count("gap").alias("n"), F.sum("gap").cast("decimal(19,0)").alias("s1"), F.sum((F.col("gap") * F.col("gap")).cast("decimal(36,0)")).cast("decimal(38,0)").alias("s2"))
    per = per.where((F.col("events") >= min_events) & (F.col("s1") > 0))
    spread = (F.col("n").cast("decimal(10,0)") * F.col("s2")).cast("decimal(38,0)") - (F.col("s1") * F.col("s1")).cast("decimal(38,0)")
    per = per.withColumn("interval_cv", F.sqrt(spread.cast("double")) / F.col("s1").cast("double")).where(F.col("interval_cv") <= cv_threshold)
    score = clamp(F.lit(0.4) + F.lit(0.4) * (F.lit(1.0) - F.col("interval_cv") / F.lit(cv_threshold)))
    return per.select(F.array("entity").alias("entities"), score.alias("score"), "events", (F.col("s1").cast("double") / F.col("n") / F.lit(3600000.0)).alias("mean_interval_hours"), "interval_cv")
