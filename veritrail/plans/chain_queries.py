"""Transaction, infrastructure and screening queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators import chain, infra, screening
from veritrail.plans.views import table, tasks_for


def transactions(s, d):
    """Orders as transactions: suppliers pay in, parts are paid; values are 400 and a rounded thousandth, so that outputs look alike."""
    # Spark would deal lines out by their bytes; the pairs and arrays made of them are many times as large.
    lines = table(s, d, "lineitem")
    lines = lines.repartition(tasks_for(lines), "l_orderkey").join(table(s, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(key)).alias("k"), F.min(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("ts"))
    value = lambda x: F.round(x["l_extendedprice"] / 1000) + 400.0
    inputs = F.transform("k", lambda x: F.struct(F.concat(F.lit("S"), x["l_suppkey"].cast("string"), F.lit("-"), (F.col("l_orderkey") % 7).cast("string")).alias("address"), value(x).alias("value")))
    outputs = F.transform("k", lambda x: F.struct(F.concat(F.lit("P"), x["l_partkey"].cast("string")).alias("address"), (value(x) + 1.0).alias("value")))
    return rows.select(F.col("l_orderkey").cast("string").alias("txid"), "ts", inputs.alias("inputs"), outputs.alias("outputs"), F.col("l_orderkey").alias("ordinal"))


def peeling(s, d):
    """Orders as a spending graph: each spends its customer's address and pays the customer's next one and a clerk."""
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    pay = lambda a, v: F.struct(a.alias("address"), v.alias("value"))
    c = lambda n: F.concat(F.lit("C"), n.cast("string"))
    inputs = F.array(pay(c(F.col("o_custkey")), F.col("o_totalprice")))
    outputs = F.array(pay(F.concat(F.lit("K"), (F.col("o_orderkey") % 100).cast("string")), F.col("o_totalprice") * 0.1), pay(c(F.col("o_custkey") + 1), F.col("o_totalprice") * 0.8))
    return rows.select(F.col("o_orderkey").cast("string").alias("txid"), F.lit("2026-01-01T00:00:00").alias("ts"), inputs.alias("inputs"), outputs.alias("outputs"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 3 == 0, "ethereum").otherwise("bitcoin").alias("asset"))


def observations(s, d):
    """Pages as observations of addresses by host; events of a user as an address's times."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(s, d, "pages").select(F.concat(F.lit("10.0.0."), F.col("page_id").cast("string")).alias("ip"), F.lit("2026-01-01T00:00:00").alias("ts"), F.lit(None).cast("string").alias("asn"), F.lit(None).cast("string").alias("cert_sha256"), F.array(host).alias("domains"), F.array().cast("array<int>").alias("ports"), F.array(F.when(F.col("page_id") % 3 == 0, F.lit("web")).otherwise(F.lit("vpn"))).alias("tags"), F.col("page_id").alias("ordinal"))


def activity(s, d):
    return table(s, d, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ip"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_id").alias("ordinal"))


def sdn(s, d):
    rows = [("acme holdings", "P1", ["Customer#000000007", "  customer#000000011 "], {"crypto": ["s3-1", "S4-2", "nowhere"]}, 0), ("Customer#000000009", "P2", None, {"crypto": ["S9-3"]}, 1)]
    return s.createDataFrame(rows, screening.SDN)


def enriched(s, d):
    lists = [observations(s, d).where(F.col("ordinal") % n == 0).select("ip") for n in (5, 7)]
    return infra.enrich(observations(s, d), tor=lists[0], proxy=lists[1]).select("ip", F.array_join("tags", ",").alias("tags"), "anonymized")


QUERIES = {
    "common_input_clusters": lambda s, d: chain.common_input_clusters(transactions(s, d)),
    "flow_expansion": lambda s, d: chain.flow_totals(transactions(s, d), tasks_for(table(s, d, "lineitem"))),
    "trace_forward": lambda s, d: chain.trace(peeling(s, d), "C100", "forward"),
    "trace_backward": lambda s, d: chain.trace(peeling(s, d), "C100", "backward"),
    "mixer": lambda s, d: chain.mixers(transactions(s, d)),
    "demix": lambda s, d: chain.demix(transactions(s, d)),
    "peel_steps": lambda s, d: chain.peel_steps(peeling(s, d)),
    "peel_chain": lambda s, d: chain.peel_chains(peeling(s, d)).withColumns({"txids": F.array_join("txids", ">"), "peels": F.array_join("peels", ">")}),
    "enrich_anonymizer": enriched,
    "infra_clusters": lambda s, d: infra.fingerprint_clusters(observations(s, d)),
    "temporal_signature": lambda s, d: infra.temporal_signatures(activity(s, d)),
    "coactivity": lambda s, d: infra.coactivity(activity(s, d)),
    "screen_addresses": lambda s, d: screening.screen_addresses(chain.common_input_clusters(transactions(s, d)), sdn(s, d)),
    "screen_names": lambda s, d: screening.screen_names(table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("ordinal")), sdn(s, d)),
}

_TX = """l AS (SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, round(l_extendedprice / 1000) + 400e0 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
i AS (SELECT l_orderkey AS k, CAST(l_orderkey AS VARCHAR) AS txid, 'S' || l_suppkey || '-' || (l_orderkey % 7) AS address, v AS value,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM l),
o AS (SELECT l_orderkey AS k, CAST(l_orderkey AS VARCHAR) AS txid, 'P' || l_partkey AS address, v + 1e0 AS value,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM l)"""
# Values are whole numbers, so that sums are exact in any order but for the squares, which are taken in order.
_MIX = """v AS (SELECT k, txid, list(value ORDER BY pos) AS vals FROM o GROUP BY k, txid HAVING count(*) >= 3),
m AS (SELECT *, list_sum(vals) / len(vals) AS mean FROM v),
c AS (SELECT txid, len(vals) AS n, sqrt(list_reduce(list_prepend(0e0, list_transform(vals, lambda x: (x - mean) * (x - mean))), lambda a, b: a + b) / len(vals)) / mean AS cv FROM m WHERE mean > 0),
mixer AS (SELECT txid, n AS n_inputs, n AS n_outputs, cv, greatest(0e0, least(0.95e0, 0.6e0 + (0.1e0 - cv))) AS score FROM c WHERE cv <= 0.1e0)"""
_PEEL = """f AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS txid, 'C' || o_custkey AS source, 'K' || (o_orderkey % 100) AS target, o_totalprice AS in_value, o_totalprice * 0.1e0 AS out_value FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'C' || o_custkey, 'C' || (o_custkey + 1), o_totalprice, o_totalprice * 0.8e0 FROM orders)"""


def _trace(here: str, there: str, value: str) -> str:
    return f"""WITH RECURSIVE {_PEEL},
n0 AS (SELECT 'C100' AS a), n1 AS (SELECT DISTINCT {there} AS a FROM f JOIN n0 ON {here} = a WHERE {there} NOT IN (SELECT a FROM n0)),
n2 AS (SELECT DISTINCT {there} AS a FROM f JOIN n1 ON {here} = a WHERE {there} NOT IN (SELECT a FROM n0 UNION SELECT a FROM n1)),
n3 AS (SELECT DISTINCT {there} AS a FROM f JOIN n2 ON {here} = a WHERE {there} NOT IN (SELECT a FROM n0 UNION SELECT a FROM n1 UNION SELECT a FROM n2)),
n AS (SELECT a, CAST(1 AS BIGINT) AS hop FROM n0 UNION ALL SELECT a, 2 FROM n1 UNION ALL SELECT a, 3 FROM n2 UNION ALL SELECT a, 4 FROM n3)
SELECT txid, source, target, {value} AS value, '2026-01-01T00:00:00' AS ts, hop FROM f JOIN n ON {here} = a"""


_HOST = r"regexp_extract(url, '^https?://([^/]+)', 1)"
ORACLES = {
    "common_input_clusters": f"""WITH RECURSIVE {_TX},
h AS (SELECT DISTINCT i.address AS a, j.address AS b FROM i JOIN i j ON i.k = j.k AND i.pos = 1),
u AS (SELECT a, b FROM h UNION SELECT b, a FROM h),
r(a, b) AS (SELECT DISTINCT a, min(b) OVER (PARTITION BY a) FROM u UNION SELECT u.b, r.b FROM r JOIN u ON u.a = r.a WHERE r.b < u.b)
SELECT a AS address, least(a, min(b)) AS cluster FROM r GROUP BY a""",
    "flow_expansion": f"WITH {_TX} SELECT i.address AS source, o.address AS target, count(*) AS n, sum(o.value) AS value FROM i JOIN o USING (k) GROUP BY 1, 2",
    "trace_forward": _trace("source", "target", "out_value"),
    "trace_backward": _trace("target", "source", "in_value"),
    "mixer": f"WITH {_TX}, {_MIX} SELECT * FROM mixer",
    "demix": f"""WITH {_TX}, {_MIX},
x AS (SELECT i.txid, i.pos, i.address AS input, o.address AS output, i.value AS input_value, o.value AS output_value, abs(o.value - i.value) / i.value AS rel
      FROM i JOIN mixer USING (txid) JOIN o ON o.k = i.k WHERE i.value > 0),
y AS (SELECT *, count(*) OVER (PARTITION BY txid, pos) AS ambiguity FROM x WHERE rel <= 0.05e0)
SELECT txid, input, output, input_value, output_value, ambiguity,
       greatest(0e0, least(0.9e0, CASE WHEN ambiguity = 1 THEN 0.7e0 ELSE greatest(0e0, least(0.7e0, 0.7e0 / ambiguity + 0.2e0)) END * (1e0 - rel))) AS confidence FROM y""",
    "peel_steps": """SELECT CAST(o_orderkey AS VARCHAR) AS txid, o_orderkey AS ordinal, 'C' || (o_custkey + 1) AS remainder, o_totalprice * 0.8e0 AS remainder_value, 'K' || (o_orderkey % 100) AS peel, o_totalprice * 0.1e0 AS peel_value
FROM orders WHERE o_totalprice > 0""",
    "enrich_anonymizer": """WITH t AS (SELECT page_id, list_sort(list_distinct(list_filter([CASE WHEN page_id % 3 = 0 THEN 'web' ELSE 'vpn' END, CASE WHEN page_id % 5 = 0 THEN 'tor-exit' END, CASE WHEN page_id % 7 = 0 THEN 'proxy' END], lambda x: x IS NOT NULL))) AS tags FROM pages)
SELECT '10.0.0.' || page_id AS ip, array_to_string(tags, ',') AS tags, list_has_any(tags, ['tor-exit', 'tor', 'vpn', 'proxy']) AS anonymized FROM t""",
    "infra_clusters": f"""WITH p AS (SELECT '10.0.0.' || page_id AS ip, {_HOST} AS host FROM pages) SELECT ip, min(ip) OVER (PARTITION BY host) AS cluster FROM p""",
    "temporal_signature": """WITH t AS (SELECT 'U' || user_id AS ip, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, event_id FROM events),
h AS (SELECT ip, hour, count(*) AS k, min(event_id) AS first FROM t GROUP BY ip, hour),
p AS (SELECT ip, arg_min(hour, row(-k, first)) AS peak_hour, string_agg(hour || ':' || k, ',' ORDER BY hour) AS hours FROM h GROUP BY ip)
SELECT ip, count(*) AS n, count(DISTINCT day) AS active_days, any_value(peak_hour) AS peak_hour, any_value(hours) AS hours FROM t JOIN p USING (ip) GROUP BY ip""",
    "coactivity": """WITH t AS (SELECT DISTINCT 'U' || user_id AS ip, CAST(ts AS DATE) AS day FROM events)
SELECT x.ip AS a, y.ip AS b, count(*) AS shared_days, greatest(0e0, least(1e0, 0.3e0 + 0.2e0 * count(*))) AS confidence FROM t x JOIN t y ON x.day = y.day AND x.ip < y.ip GROUP BY 1, 2 HAVING count(*) >= 2""",
    "screen_addresses": f"""WITH {_TX}, s(listed, sdn_name, program) AS (VALUES ('s3-1', 'acme holdings', 'P1'), ('S4-2', 'acme holdings', 'P1'), ('nowhere', 'acme holdings', 'P1'), ('S9-3', 'Customer#000000009', 'P2'))
SELECT DISTINCT address, listed, sdn_name, program, 1e0 AS confidence FROM i JOIN s ON lower(address) = lower(listed)""",
    "screen_names": """WITH s(matched, sdn_name, program) AS (VALUES ('acme holdings', 'acme holdings', 'P1'), ('Customer#000000007', 'acme holdings', 'P1'), ('  customer#000000011 ', 'acme holdings', 'P1'), ('Customer#000000009', 'Customer#000000009', 'P2'))
SELECT c_name AS name, matched, sdn_name, program, 0.85e0 AS confidence FROM customer JOIN s ON lower(c_name) = trim(lower(matched))""",
}
