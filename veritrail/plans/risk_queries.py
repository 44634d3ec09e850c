"""Risk, fusion and case queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions.scalars import make_id
from veritrail.operators.graph import add_nodes
from veritrail.operators import case, chain, detectors, fusion, infra, metrics, risk, screening, traversal
from veritrail.plans.chain_queries import observations, peeling, sdn
from veritrail.plans.ledger_queries import FUNNEL_SQL, STRUCTURING_SQL, TRADE_SQL
from veritrail.plans.views import BRISK, FUNNELS, TRANSFERS, brisk, funnels, rings, table, transfers
from veritrail.sources import exports, planted
from veritrail.storage import materialize


def findings(s, d, rows=None):
    """Structuring, trade and funnel findings, over one reading of the transfers; scores unrounded."""
    rows = materialize(transfers(s, d)) if rows is None else rows
    parts = {"structuring": detectors.structuring(brisk(rows)), "trade_value_anomaly": detectors.trade_value_anomaly(rows), "funnel_account": detectors.funnel_account(funnels(s, d))}
    out = None
    for name, found in parts.items():
        one = found.select(F.concat(F.lit(name + ":"), F.array_join("entities", "|"), F.lit(":"), F.col("score").cast("string")).alias("id"), F.lit(name).alias("typology"), "entities", "score")
        out = one if out is None else out.unionByName(one)
    return out


def entity_rows(s, d):
    return risk.entity_risk(findings(s, d)).drop("contributions").withColumn("typologies", F.array_join("typologies", ","))


def network_rows(s, d):
    # The transfers that findings read are written for them anyway.
    rows = materialize(transfers(s, d))
    return risk.network_risk(findings(s, d, rows), traversal.components(rows)).withColumn("typologies", F.array_join("typologies", ","))


def top_findings(s, d):
    return risk.prioritized(findings(s, d).drop("id").withColumn("id", F.array_join("entities", "|")).drop("entities").distinct(), 50)


def linkages(s, d):
    rows = [("C10", "C400", "10.0.0.1", None, "report", 0.7, 0), ("C20", None, "10.0.0.2", "10.0.0.9", None, None, 1), ("nobody", None, "10.0.0.3", None, None, None, 2)]
    return s.createDataFrame(rows, fusion.LINKAGE)


def listed(s, d):
    return s.createDataFrame([("listed person", "P1", [], {"crypto": ["c30", "C40"]}, 0)], sdn(s, d).schema)


def graph(s, d):
    txs = peeling(s, d)
    return fusion.build_graph(txs, observations(s, d), linkages(s, d), listed(s, d))


def known_customers(s, d):
    """Customers as nodes, under the ids of their addresses, of which the graph has nearly all; some come twice."""
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    node = rows.select(make_id("crypto-address", F.concat(F.lit("C"), (F.col("k") * 2).cast("string"))).alias("id"), F.lit("person").alias("type"), F.col("c_name").alias("label"), F.col("k").alias("ordinal"))
    return node.unionByName(node.withColumns({"label": F.concat(F.lit("again "), "label"), "ordinal": F.col("ordinal") + 1}))


def merged_nodes(s, d):
    return add_nodes(graph(s, d)[0], known_customers(s, d))


def actors(s, d):
    return fusion.threat_actors(fusion.actor_members(*graph(s, d)))


def case_summary(s, d):
    made = case.build_case(rings(s, d))
    return s.createDataFrame([made.summary()])


def planted_recall(s, d):
    """The detectors with default parameters over a ledger of a case of each kind for each supplier."""
    rows, truth, listed_ = planted.ledgers(table(s, d, "supplier").select(F.col("s_suppkey").alias("key")))
    return metrics.typology_recall(case.run_detectors(rows, listed_), truth)


def planted_scores(s, d):
    """Wallet clusters, mixers, infrastructure and screening of cases planted for each customer, clean and noisy."""
    keys, out = table(s, d, "customer").select(F.col("c_custkey").alias("key")), None
    obs, groups = planted.observations(s)
    entry = s.createDataFrame([("listed", "P", [], {"crypto": ["O0-1", "M0-2", "unseen"]}, 0)], screening.SDN)
    listed_ = planted.copies(entry.select(F.explode("addresses.crypto").alias("address")), keys, "address")
    sdn_rows = listed_.select(F.lit("listed").alias("name"), F.lit("P").alias("program"), F.array().cast("array<string>").alias("aka"), F.struct(F.array("address").alias("crypto")).alias("addresses"), F.lit(0).cast("long").alias("ordinal"))
    for noisy in (False, True):
        txs, wallets, mixed = planted.many_transactions(keys, noisy)
        clusters = materialize(chain.common_input_clusters(txs))
        both = {
            "clusters": metrics.pairwise_scores(clusters.select(F.col("address").alias("member"), "cluster"), wallets),
            "mixers": metrics.label_scores(chain.mixers(txs).select(F.col("txid").alias("label")), mixed),
            "screening": metrics.label_scores(screening.screen_addresses(clusters, sdn_rows).select(F.lower("address").alias("label")), listed_.where("address not like 'unseen%'").select(F.lower("address").alias("label"))),
        }
        if not noisy:
            # Certificates and domains are a key's own, as addresses are.
            own = lambda c: F.concat(c, F.lit("-"), F.regexp_extract("ip", "-([^-]*)$", 1))
            seen = planted.copies(obs, keys, "ip").withColumns({"cert_sha256": own(F.col("cert_sha256")), "domains": F.transform("domains", own)})
            both["infrastructure"] = metrics.pairwise_scores(infra.fingerprint_clusters(seen).select(F.col("ip").alias("member"), "cluster"), planted.copies(groups, keys, "member", "cluster"))
        for name, scores in both.items():
            one = scores.withColumn("name", F.lit(f"{name}, {'noisy' if noisy else 'clean'}"))
            out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "planted_recall": planted_recall,
    "planted_scores": planted_scores,
    "entity_risk": entity_rows,
    "network_risk": network_rows,
    "prioritized_findings": top_findings,
    "fusion_nodes": lambda s, d: graph(s, d)[0],
    "fusion_edges": lambda s, d: graph(s, d)[1],
    "threat_actors": actors,
    "graph_nodes": merged_nodes,
    "event_attributes": lambda s, d: exports.misp_attributes(merged_nodes(s, d)),
    "case_summary": case_summary,
}

_FINDINGS = f"""{TRANSFERS}, {BRISK}, {FUNNELS}, {STRUCTURING_SQL}, {TRADE_SQL}, {FUNNEL_SQL},
finding AS (
  SELECT 'structuring' AS typology, entities, score, 0.75e0 AS weight FROM structuring
  UNION ALL SELECT 'trade_value_anomaly', entities, score, 0.7e0 FROM trade
  UNION ALL SELECT 'funnel_account', entities, score, 0.8e0 FROM funnel)"""
_ENTITY = f"""{_FINDINGS},
each AS (SELECT typology, unnest(string_split(entities, '|')) AS entity, greatest(0e0, least(1e0, weight * score)) AS c FROM finding),
best AS (SELECT entity, typology, max(c) AS c FROM each GROUP BY entity, typology),
per AS (SELECT entity, list_sort(list(c)) AS w, count(*) AS k, string_agg(typology, ',' ORDER BY typology) AS typologies FROM best GROUP BY entity),
nor AS (SELECT *, 1e0 - list_reduce(list_prepend(1e0, list_transform(w, lambda x: 1e0 - x)), lambda a, b: a * b) AS base FROM per),
risk AS (SELECT entity, greatest(0e0, least(1e0, base + least(0.05e0 * (k - 1), 0.15e0))) AS risk, k, typologies, least(0.05e0 * (k - 1), 0.15e0) AS bonus, base FROM nor)"""


def _band(x: str) -> str:
    return f"CASE WHEN {x} >= 0.8e0 THEN 'HIGH' WHEN {x} >= 0.5e0 THEN 'MODERATE' WHEN {x} > 0 THEN 'LOW' ELSE 'NONE' END"


def _digest(n: str, total: str, mixed: str) -> str:
    return f"concat_ws('-', {n}, {total}, {mixed})"


def _id(kind: str, value: str) -> str:
    return f"'{kind}--' || substr(sha1('{kind}:' || {value}), 1, 16)"


_BITS = "CAST('0x' || substr(sha1(x), 1, 15) AS BIGINT)"
# Every address is spent alone, so that wallet clusters have one member each; pages of a host are one cluster.
_FUSED = f"""a AS (SELECT 'C' || o_custkey AS x FROM orders UNION SELECT 'C' || (o_custkey + 1) FROM orders UNION SELECT 'K' || (o_orderkey % 100) FROM orders),
w AS (SELECT x, {_id('wallet-cluster', _digest('1', _BITS, _BITS))} AS cluster FROM a),
p AS (SELECT '10.0.0.' || page_id AS x, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
h AS (SELECT host, {_digest('count(*)', f'sum({_BITS})', f'bit_xor({_BITS})')} AS members FROM p GROUP BY host),
i AS (SELECT x, {_id('infra-cluster', 'members')} AS cluster FROM p JOIN h USING (host))"""
_TIES = """l(one, two, confidence, evidence) AS (VALUES ('C10', '10.0.0.1', 0.7e0, 'report'), ('C10', 'C400', 0.7e0, 'report'), ('C20', '10.0.0.2', 0.6e0, 'investigation'), ('10.0.0.2', '10.0.0.9', 0.6e0, 'investigation')),
k AS (SELECT x, cluster FROM w UNION ALL SELECT x, cluster FROM i)"""

_NODES = f"""s AS (
  SELECT DISTINCT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'ethereum' ELSE 'bitcoin' END AS asset, unnest(['C' || o_custkey, 'C' || (o_custkey + 1), 'K' || (o_orderkey % 100)]) AS x FROM orders),
v AS (SELECT x, asset, count(*) AS n FROM s GROUP BY x, asset),
chain AS (SELECT x, arg_min(asset, row(-n, asset)) AS chain FROM v GROUP BY x),
node AS (
  SELECT cluster AS id, 'wallet-cluster' AS type, cluster AS label, NULL AS chain FROM w UNION SELECT {_id('crypto-address', 'x')}, 'crypto-address', x, chain FROM w JOIN chain USING (x)
  UNION SELECT cluster, 'infrastructure-cluster', cluster, NULL FROM i UNION SELECT {_id('ip-address', 'x')}, 'ip-address', x, NULL FROM i
  UNION SELECT {_id('sanctioned-entity', "'listed person'")}, 'sanctioned-entity', 'listed person', NULL FROM w WHERE x IN ('C30', 'C40'))"""
_MERGED = f"""known AS (SELECT {_id('crypto-address', "('C' || (c_custkey * 2))")} AS id, c_name AS label FROM customer),
merged AS (SELECT * FROM node UNION ALL SELECT id, 'person', label, NULL FROM known WHERE id NOT IN (SELECT id FROM node))"""

ORACLES = {
    # The planted truth: each case is found; a transaction of two owners makes one cluster of eight of their two of four.
    "planted_recall": """WITH t(typology, k) AS (VALUES ('structuring', 1), ('layering', 6), ('pass_through', 1), ('round_tripping', 3), ('trade_value_anomaly', 2), ('shell_nominee', 3), ('funnel_account', 1), ('burst_velocity', 1), ('dormancy_activation', 1), ('periodicity', 1), ('sanctions_nexus', 1)),
p AS (SELECT typology, CAST(k * count(*) AS BIGINT) AS planted FROM t, supplier GROUP BY typology, k)
SELECT typology, planted, planted AS recovered, 1e0 AS recall FROM p UNION ALL SELECT 'macro', CAST(sum(planted) AS BIGINT), CAST(sum(planted) AS BIGINT), 1e0 FROM p""",
    "planted_scores": """SELECT name, precision, recall, f1, CAST(tp * n AS BIGINT) AS tp, CAST(fp * n AS BIGINT) AS fp, fn FROM (SELECT count(*) AS n FROM customer), (VALUES
  ('clusters, clean', 1e0, 1e0, 1e0, 48, 0, CAST(0 AS BIGINT)), ('mixers, clean', 1e0, 1e0, 1e0, 2, 0, 0), ('screening, clean', 1e0, 1e0, 1e0, 2, 0, 0), ('infrastructure, clean', 1e0, 1e0, 1e0, 24, 0, 0),
  ('clusters, noisy', 0.75e0, 1e0, 0.8571e0, 48, 16, 0), ('mixers, noisy', 1e0, 1e0, 1e0, 2, 0, 0), ('screening, noisy', 1e0, 1e0, 1e0, 2, 0, 0)) v(name, precision, recall, f1, tp, fp, fn)""",
    "entity_risk": f"WITH {_ENTITY} SELECT entity, risk, {_band('risk')} AS risk_band, k AS typology_count, typologies, bonus AS diversity_bonus, base AS base_noisy_or FROM risk",
    "network_risk": f"""WITH RECURSIVE {_ENTITY},
u AS (SELECT src AS a, dst AS b FROM transfers UNION SELECT dst, src FROM transfers),
r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
comp AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a),
num AS (SELECT component, row_number() OVER (ORDER BY component) AS i, count(*) AS size FROM comp GROUP BY component),
flag AS (SELECT component, count(*) AS k, max(risk) AS peak, sum(CAST(risk AS DECIMAL(28,10))) AS total, count(*) FILTER (risk >= 1) AS sure, sum(CASE WHEN risk < 1 THEN CAST(ln(1e0 - risk) AS DECIMAL(28,10)) END) AS logs
         FROM comp JOIN risk ON node = entity GROUP BY component),
types AS (SELECT component, list_sort(list_distinct(flatten(list(string_split(typologies, ','))))) AS t FROM comp JOIN risk ON node = entity GROUP BY component),
net AS (SELECT *, CASE WHEN sure > 0 THEN 1e0 ELSE round(1e0 - exp(CAST(logs AS DOUBLE)), 6) END AS nr FROM flag JOIN types USING (component) JOIN num USING (component))
SELECT 'network-' || i AS network_id, component, size, k AS flagged_entities, nr AS network_risk, {_band('nr')} AS network_risk_band, peak AS peak_entity_risk,
       round(CAST(total AS DOUBLE) / k, 6) AS mean_entity_risk, array_to_string(t, ',') AS typologies FROM net""",
    "prioritized_findings": f"WITH {_FINDINGS} SELECT DISTINCT typology, score, entities AS id FROM finding ORDER BY score DESC, typology, id LIMIT 50",
    "threat_actors": f"""WITH RECURSIVE {_FUSED}, {_TIES},
e AS (SELECT m.cluster AS a, n.cluster AS b FROM l JOIN k m ON one = m.x JOIN k n ON two = n.x UNION SELECT cluster, {_id('sanctioned-entity', "'listed person'")} FROM w WHERE x IN ('C30', 'C40')),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a AS node, min(b) AS part FROM r GROUP BY a),
g AS (SELECT part, count(*) FILTER (node LIKE 'wallet%') AS n_wallets, count(*) FILTER (node LIKE 'infra%') AS n_infra, count(*) FILTER (node LIKE 'sanctioned%') AS n_sanctions FROM m GROUP BY part),
c AS (SELECT *, list_sort(list_filter([CASE WHEN n_wallets > 0 THEN 0.6e0 END, CASE WHEN n_infra > 0 THEN 0.5e0 END, CASE WHEN n_wallets > 0 AND n_infra > 0 THEN 0.6e0 END, CASE WHEN n_sanctions > 0 THEN 0.9e0 END], lambda x: x IS NOT NULL)) AS ws FROM g),
z AS (SELECT *, 1e0 - list_reduce(list_prepend(1e0, list_transform(ws, lambda x: 1e0 - x)), lambda a, b: a * b) AS raw FROM c WHERE n_sanctions > 0 OR n_wallets + n_infra >= 2)
SELECT {_id('threat-actor', 'part')} AS id, n_wallets, n_infra, n_sanctions, round(raw, 4) AS confidence, {_band('raw')} AS confidence_band FROM z""",
    "fusion_nodes": f"WITH {_FUSED}, {_NODES} SELECT * FROM node",
    "graph_nodes": f"WITH {_FUSED}, {_NODES}, {_MERGED} SELECT * FROM merged",
    "event_attributes": f"""WITH {_FUSED}, {_NODES}, {_MERGED},
q AS (SELECT *, sha1(unhex('{exports.NAMESPACE.replace("-", "")}') || encode(CASE WHEN type = 'ip-address' THEN 'attr:ip:' || label ELSE 'attr:wallet:' || lower(label) END)) AS h FROM merged WHERE type IN ('crypto-address', 'ip-address'))
SELECT concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS uuid,
       CASE WHEN type = 'ip-address' THEN 'ip-dst' WHEN chain = 'ethereum' THEN 'eth' ELSE 'btc' END AS type, CASE WHEN type = 'ip-address' THEN 'Network activity' ELSE 'Financial fraud' END AS category, true AS to_ids, label AS value FROM q""",
    "fusion_edges": f"""WITH {_FUSED}, {_TIES}
SELECT {_id('crypto-address', 'x')} AS source, cluster AS target, 'member-of' AS relation, 0.9e0 AS confidence, 'common inputs' AS evidence FROM w
UNION ALL SELECT {_id('ip-address', 'x')}, cluster, 'member-of', 0.8e0, 'shared certificate or domain' FROM i
UNION ALL SELECT {_id('crypto-address', 'x')}, {_id('sanctioned-entity', "'listed person'")}, 'sanctioned-as', 1e0, 'sanctions list' FROM w WHERE x IN ('C30', 'C40')
UNION ALL SELECT m.cluster, n.cluster, 'controlled-by-same-actor', confidence, evidence FROM l JOIN k m ON one = m.x JOIN k n ON two = n.x""",
}
