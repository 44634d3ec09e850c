"""Ledger and detector queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions.scalars import ntz_micros, parse_micros
from veritrail.operators import detectors, ledger
from veritrail.plans.views import BRISK, EVENTS, FUNNELS, TICKS, TRANSFERS, brisk, event_ledger, funnels, named, slow_events, table, ticks, transfers


def _money(amount: str) -> str:
    return f"CAST(sum(CAST(coalesce({amount}, 0) AS DECIMAL(18,2))) AS DOUBLE)"


def _clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def parse_epoch(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise(""))
    return rows.select("event_id", parse_micros(text).alias("ts_micros"))


QUERIES = {
    "ledger_entities": lambda s, d: ledger.entities(transfers(s, d)),
    "ledger_pairs": lambda s, d: ledger.pairs(transfers(s, d)),
    "ledger_degree": lambda s, d: ledger.degrees(transfers(s, d)),
    "ledger_in_out": lambda s, d: ledger.incoming(transfers(s, d)).join(ledger.outgoing(transfers(s, d)), "entity", "full"),
    "parse_epoch": parse_epoch,
    "structuring": lambda s, d: named(detectors.structuring(brisk(transfers(s, d)))),
    "pass_through": lambda s, d: named(detectors.pass_through(brisk(transfers(s, d)))),
    "trade_value_anomaly": lambda s, d: named(detectors.trade_value_anomaly(transfers(s, d))),
    "funnel_account": lambda s, d: named(detectors.funnel_account(funnels(s, d))),
    "burst_velocity": lambda s, d: named(detectors.burst_velocity(event_ledger(s, d))),
    "dormancy_activation": lambda s, d: named(detectors.dormancy_activation(slow_events(s, d))),
    "periodicity": lambda s, d: named(detectors.periodicity(ticks(s, d))),
}

STRUCTURING_SQL = f"""
roll AS (
  SELECT dst, ts_micros, count(*) OVER w AS n, CAST(sum(CAST(amount AS DECIMAL(28,10))) OVER w AS DOUBLE) AS total FROM brisk
  WHERE amount >= 9000 AND amount < 10000
  WINDOW w AS (PARTITION BY dst ORDER BY ts_micros RANGE BETWEEN {72 * ledger.HOUR} PRECEDING AND CURRENT ROW)),
top_window AS (
  SELECT dst, n, total FROM roll WHERE n >= 3 AND total >= 10000
  QUALIFY row_number() OVER (PARTITION BY dst ORDER BY n DESC, ts_micros, total) = 1),
structuring AS (
  SELECT dst AS entities, {_clamp("0.45e0 + 0.08e0 * (n - 3) + 0.15e0 * least(total / 10000e0 - 1, 2e0)")} AS score,
         n AS near_band_count, total AS window_total, total / 10000e0 AS aggregate_ratio, 10000e0 AS threshold, 9000e0 AS band_low FROM top_window)"""

FUNNEL_SQL = f"""
f_in AS (
  SELECT dst AS entity, count(DISTINCT src) AS source_count, count(DISTINCT nullif(counterparty_country, '')) AS region_count, {_money("amount")} AS total_in
  FROM funnels GROUP BY dst),
f_out AS (SELECT src AS entity, count(DISTINCT dst) AS dest_count FROM funnels GROUP BY src),
funnel AS (
  SELECT entity AS entities, {_clamp("0.45e0 + 0.04e0 * (source_count - 5) + 0.05e0 * region_count + 0.1e0 * (3 - dest_count)")} AS score,
         source_count, region_count, dest_count, total_in
  FROM f_in JOIN f_out USING (entity) WHERE source_count >= 5 AND dest_count BETWEEN 1 AND 2 AND (region_count = 0 OR region_count >= 3))"""

TRADE_SQL = f"""
dev AS (SELECT *, (amount - goods_value) / goods_value AS deviation FROM transfers WHERE goods_value > 0 AND amount IS NOT NULL),
trade AS (
  SELECT src || '|' || dst AS entities, {_clamp("0.4e0 + 0.4e0 * least(abs(deviation), 1.5e0) / 1.5e0")} AS score, amount AS paid, goods_value, deviation,
         CASE WHEN deviation > 0 THEN 'over-invoicing' ELSE 'under-invoicing' END AS direction, counterparty_country
  FROM dev WHERE abs(deviation) >= 0.3e0)"""

ORACLES = {
    "ledger_entities": f"WITH {TRANSFERS} SELECT src AS entity FROM transfers UNION SELECT dst FROM transfers",
    "ledger_pairs": f"WITH {TRANSFERS} SELECT src, dst, count(*) AS n, {_money('amount')} AS amount FROM transfers GROUP BY src, dst",
    "ledger_degree": f"""WITH {TRANSFERS},
e AS (SELECT src AS entity, dst AS other, 1 AS o, amount FROM transfers UNION ALL SELECT dst, src, 0, amount FROM transfers)
SELECT entity, count(DISTINCT CASE WHEN other <> entity THEN other END) AS degree, CAST(sum(1 - o) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, {_money('amount')} AS volume
FROM e GROUP BY entity""",
    "ledger_in_out": f"""WITH {TRANSFERS},
i AS (SELECT dst AS entity, count(*) AS n_in, {_money('amount')} AS total_in FROM transfers GROUP BY dst),
o AS (SELECT src AS entity, count(*) AS n_out, {_money('amount')} AS total_out FROM transfers GROUP BY src)
SELECT entity, n_in, total_in, n_out, total_out FROM i FULL JOIN o USING (entity)""",
    "parse_epoch": """SELECT event_id, epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 3 = 1 THEN 7200000000 ELSE 0 END AS ts_micros FROM events""",
    "structuring": f"WITH {TRANSFERS}, {BRISK}, {STRUCTURING_SQL} SELECT * FROM structuring",
    "pass_through": f"""WITH {TRANSFERS}, {BRISK},
i AS (SELECT dst AS entity, CAST(sum(CAST(amount AS DECIMAL(28,10))) AS DOUBLE) AS total_in FROM brisk GROUP BY dst),
o AS (SELECT src AS entity, CAST(sum(CAST(amount AS DECIMAL(28,10))) AS DOUBLE) AS total_out FROM brisk GROUP BY src),
outs AS (SELECT DISTINCT src AS entity, ts_micros AS out_ts FROM brisk),
h AS (
  SELECT t.dst AS entity, outs.out_ts - t.ts_micros AS hold FROM brisk t ASOF JOIN outs ON t.dst = outs.entity AND t.ts_micros <= outs.out_ts),
m AS (SELECT entity, list_sort(list(hold))[len(list(hold)) // 2 + 1] / {float(ledger.HOUR)!r}e0 AS median_hold_hours FROM h GROUP BY entity),
r AS (SELECT entity, total_in, total_out, total_out / total_in AS forward_fraction, median_hold_hours FROM i JOIN o USING (entity) JOIN m USING (entity) WHERE total_in > 0)
SELECT entity AS entities, {_clamp("0.4e0 + 0.3e0 * least(forward_fraction, 1e0) + 0.2e0 * (1 - median_hold_hours / 48e0)")} AS score, total_in, total_out, forward_fraction, median_hold_hours
FROM r WHERE forward_fraction >= 0.8e0 AND median_hold_hours <= 48""",
    "trade_value_anomaly": f"WITH {TRANSFERS}, {TRADE_SQL} SELECT * FROM trade",
    "funnel_account": f"WITH {FUNNELS}, {FUNNEL_SQL} SELECT * FROM funnel",
    "burst_velocity": f"""WITH {EVENTS},
c AS (
  SELECT entity, ts_micros, count(*) OVER (PARTITION BY entity ORDER BY ts_micros RANGE BETWEEN {24 * ledger.HOUR} PRECEDING AND CURRENT ROW) AS n FROM ev WHERE ts_micros > 0),
p AS (SELECT entity, count(*) AS k, max(n) AS peak, max(ts_micros) - min(ts_micros) AS span FROM c GROUP BY entity),
r AS (SELECT *, k / (span / {float(24 * ledger.HOUR)!r}e0) AS base FROM p WHERE k >= 5 AND span > 0 AND peak >= 5)
SELECT entity AS entities, {_clamp("0.4e0 + 0.12e0 * least(peak / base - 3, 5e0)")} AS score, peak AS peak_events_in_window, base AS baseline_events_per_window, peak / base AS spike_ratio, 24e0 AS window_hours
FROM r WHERE peak / base >= 3""",
    "dormancy_activation": f"""WITH {EVENTS},
g AS (
  SELECT entity, 45 * (ts_micros - lag(ts_micros) OVER w) AS gap, row_number() OVER w - 1 AS prior, count(*) OVER (PARTITION BY entity) AS n FROM ev WHERE ts_micros > 0
  WINDOW w AS (PARTITION BY entity ORDER BY ts_micros)),
f AS (SELECT * FROM g WHERE gap >= {90 * ledger.DAY} AND prior >= 2 AND n - prior >= 3 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY prior) = 1)
SELECT entity AS entities, {_clamp(f"0.45e0 + 0.1e0 * least(gap / {float(ledger.DAY)!r}e0 / 90e0, 3e0) + 0.03e0 * (n - prior - 3)")} AS score,
       gap / {float(ledger.DAY)!r}e0 AS dormant_days, prior AS prior_events, n - prior AS post_events FROM f""",
    "periodicity": f"""WITH {TICKS},
t AS (SELECT DISTINCT entity, ts_micros FROM ev WHERE ts_micros > 0),
g AS (SELECT entity, CAST((ts_micros - lag(ts_micros) OVER (PARTITION BY entity ORDER BY ts_micros)) // 1000 AS HUGEINT) AS gap FROM t),
p AS (SELECT entity, count(*) AS events, count(gap) AS n, sum(gap) AS s1, sum(gap * gap) AS s2 FROM g GROUP BY entity),
r AS (SELECT *, sqrt(CAST(n * s2 - s1 * s1 AS DOUBLE)) / CAST(s1 AS DOUBLE) AS cv FROM p WHERE events >= 6 AND s1 > 0)
SELECT entity AS entities, {_clamp("0.4e0 + 0.4e0 * (1 - cv / 0.15e0)")} AS score, events, CAST(s1 AS DOUBLE) / n / 3600000e0 AS mean_interval_hours, cv AS interval_cv
FROM r WHERE cv <= 0.15e0""",
}
