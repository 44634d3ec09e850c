"""Findings, graphs and cases as JSON, CSV, STIX 2.1, MISP, text and HTML.

Objects are built as rows by Spark; only :func:`lines`-sized reports (a case's top rows) come to the driver.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.scalars import uuid5
from veritrail.operators.case import Case
from veritrail.operators.graph import by_type

NAMESPACE = "6f1c2d0e-5a7b-4d38-9c41-2b8e7f60a913"
CREATED, PRODUCER = "2026-01-01T00:00:00.000Z", "veritrail"
#: STIX confidence by band (fixed values).
CONFIDENCE = {"HIGH": 85, "MODERATE": 60, "LOW": 30, "NONE": 5}
#: Attribute types of chains (fixed values); others are taken for btc.
MISP_TYPES = {"bitcoin": "btc", "ethereum": "eth", "monero": "xmr"}


def _sid(kind: str, value):
    return F.concat(F.lit(f"{kind}--"), uuid5(NAMESPACE, F.concat(F.lit(f"{kind}:"), value)))


def _told(findings: DataFrame):
    """The sentence of each finding where there is one, else its features."""
    return F.coalesce("evidence", "features") if "evidence" in findings.columns else F.col("features")


def findings_json(findings: DataFrame, path: str) -> None:
    findings.write.json(path)


def findings_csv(findings: DataFrame, path: str) -> None:
    """Seven fixed columns; entities are joined by a pipe."""
    rationale = F.concat(F.lit("pattern consistent with "), F.regexp_replace("typology", "_", " "))
    findings.select("id", "typology", "severity", "score", F.array_join("entities", "|").alias("entities"), _told(findings).alias("evidence"), rationale.alias("rationale")).write.option("header", True).csv(path)


def stix_objects(findings: DataFrame, created: str = CREATED) -> DataFrame:
    """(object): STIX objects as JSON, an identity, and an indicator and a note for each finding."""
    identity = _sid("identity", F.lit(PRODUCER))
    common = [F.lit("2.1").alias("spec_version"), F.lit(created).alias("created"), F.lit(created).alias("modified"), identity.alias("created_by_ref")]
    quoted = F.transform("entities", lambda e: F.concat(F.lit("x-entity:value = '"), F.regexp_replace(F.coalesce(e, F.lit("unknown")), "'", "\\\\\\\\'"), F.lit("'")))
    pattern = F.concat(F.lit("["), F.when(F.size("entities") > 0, F.array_join(quoted, " OR ")).otherwise("x-entity:value = 'unknown'"), F.lit("]"))
    level = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.col("severity")]
    indicator = F.struct(F.lit("indicator").alias("type"), _sid("indicator", F.col("id")).alias("id"), *common, F.concat_ws(": ", "typology", F.array_join("entities", ", ")).alias("name"), F.lit("stix").alias("pattern_type"), pattern.alias("pattern"), F.lit(created).alias("valid_from"), F.coalesce(level, F.lit(5)).alias("confidence"), F.array(F.lit("suspicious-activity")).alias("labels"))
    note = F.struct(F.lit("note").alias("type"), _sid("note", F.col("id")).alias("id"), *common, F.concat(F.lit("Evidence for "), "typology").alias("abstract"), _told(findings).alias("content"), F.array(_sid("indicator", F.col("id"))).alias("object_refs"))
    objects = findings.select(F.explode(F.array(F.to_json(indicator), F.to_json(note))).alias("object"))
    who = F.struct(F.lit("identity").alias("type"), F.lit("2.1").alias("spec_version"), identity.alias("id"), F.lit(created).alias("created"), F.lit(created).alias("modified"), F.lit(PRODUCER).alias("name"), F.lit("system").alias("identity_class"))
    return findings.sparkSession.range(1).select(F.to_json(who).alias("object")).unionByName(objects)


def graph_stix_objects(nodes: DataFrame, edges: DataFrame, actors: DataFrame, tied: DataFrame, created: str = CREATED) -> DataFrame:
    """(object): indicators of addresses, threat actors, and what is attributed to them (``tied``: actor, type, member)."""
    identity = _sid("identity", F.lit(PRODUCER))
    common = [F.lit("2.1").alias("spec_version"), F.lit(created).alias("created"), F.lit(created).alias("modified"), identity.alias("created_by_ref")]
    wallet = F.col("type") == "crypto-address"
    key = F.concat(F.when(wallet, "wallet:").otherwise("ip:"), "label")
    pattern = F.concat(F.when(wallet, "[x-crypto-address:value = '").otherwise("[ipv4-addr:value = '"), "label", F.lit("']"))
    label = F.when(wallet, "malicious-activity").otherwise("anonymization")
    indicator = F.struct(F.lit("indicator").alias("type"), _sid("indicator", key).alias("id"), *common, F.col("label").alias("name"), F.lit("stix").alias("pattern_type"), pattern.alias("pattern"), F.lit(created).alias("valid_from"), F.array(label).alias("labels"))
    out = by_type(nodes, "crypto-address", "ip-address").select(F.to_json(indicator).alias("object"))
    actor = F.struct(F.lit("threat-actor").alias("type"), _sid("threat-actor", F.col("id")).alias("id"), *common, F.concat(F.lit("Threat actor "), F.substring("id", -8, 8)).alias("name"), F.array(F.lit("criminal-enterprise")).alias("labels"), F.round(F.col("confidence") * 100).cast("int").alias("confidence"))
    out = out.unionByName(actors.select(F.to_json(actor).alias("object")))
    members = edges.where("relation = 'member-of'").join(nodes.select(F.col("id").alias("source"), "type", "label"), "source")
    own = tied.join(actors.select(F.col("id").alias("actor")), "actor", "left_semi").where("type <> 'sanctioned-entity'")
    tied = own.select("actor", F.col("member").alias("target")).join(members, "target")
    relation = F.struct(F.lit("relationship").alias("type"), _sid("relationship", F.concat_ws(":", "actor", key)).alias("id"), *common, F.lit("attributed-to").alias("relationship_type"), _sid("indicator", key).alias("source_ref"), _sid("threat-actor", F.col("actor")).alias("target_ref"))
    return out.unionByName(tied.select(F.to_json(relation).alias("object")))


def misp_attributes(nodes: DataFrame, chain: str = "bitcoin") -> DataFrame:
    """(uuid, type, category, to_ids, value) of addresses, by their chain; ``chain`` where they have none."""
    wallet = F.col("type") == "crypto-address"
    uid = uuid5(NAMESPACE, F.when(wallet, F.concat(F.lit("attr:wallet:"), F.lower("label"))).otherwise(F.concat(F.lit("attr:ip:"), "label")))
    types = F.create_map(*[F.lit(x) for kv in MISP_TYPES.items() for x in kv])
    on_chain = F.coalesce(types[F.coalesce("chain", F.lit(chain))], F.lit("btc"))
    kind, category = F.when(wallet, on_chain).otherwise("ip-dst"), F.when(wallet, "Financial fraud").otherwise("Network activity")
    return by_type(nodes, "crypto-address", "ip-address").select(uid.alias("uuid"), kind.alias("type"), category.alias("category"), F.lit(True).alias("to_ids"), F.col("label").alias("value"))


def write_bundle(objects: DataFrame, path: str) -> None:
    """One JSON object a line, which a bundle's ``objects`` are."""
    objects.select(F.col("object").alias("value")).write.text(path)


def write_document(sections: list[tuple[str, DataFrame]], end: str, path: str) -> None:
    """One JSON document as text: each section's opening, then its objects (object) with commas between, then ``end``.

    Part files hold it in the order of their names, so that the document is their concatenation, of any size.
    """
    spark = sections[0][1].sparkSession
    out = spark.createDataFrame([(2 * len(sections), "", end)], "at int, object string, value string")
    for i, (opening, objects) in enumerate(sections):
        # Equal objects are counted, so that the one without a comma is one of them.
        each = objects.groupBy("object").agg(F.count("*").cast("int").alias("n")).select("object", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
        first = each.agg(F.min("object").alias("first"))
        out = out.unionByName(spark.createDataFrame([(2 * i, "", opening)], "at int, object string, value string"))
        comma = F.when((F.col("object") == F.col("first")) & (F.col("copy") == 1), "").otherwise(",")
        # The least object is one row.
        out = out.unionByName(each.join(F.broadcast(first)).select(F.lit(2 * i + 1).alias("at"), "object", F.concat(comma, F.col("object")).alias("value")))
    out.orderBy("at", "object").select("value").write.text(path)


def stix_bundle(objects: DataFrame, path: str, created: str = CREATED) -> None:
    """A bundle of STIX objects (object)."""
    head = objects.sparkSession.range(1).select(_sid("bundle", F.lit(f"{PRODUCER}:{created}"))).first()[0]
    write_document([(f'{{"type":"bundle","id":"{head}","objects":[', objects)], "]}", path)


def misp_event(nodes: DataFrame, actors: DataFrame, path: str, info: str = "attribution", date: str = "2026-01-01", chain: str = "bitcoin") -> None:
    """An event with an attribute for each address; tagged where an actor is sanctioned."""
    uid = nodes.sparkSession.range(1).select(uuid5(NAMESPACE, F.lit(f"event:{info}{date}"))).first()[0]
    tags = ["tlp:amber"] + ["ofac:sanctioned"] * (not actors.where("n_sanctions > 0").isEmpty())
    event = {"uuid": uid, "info": info, "date": date, "threat_level_id": "2", "analysis": "1", "distribution": "1", "Orgc": {"name": PRODUCER}, "Tag": [{"name": t} for t in tags]}
    attributes = misp_attributes(nodes, chain).select(F.to_json(F.struct("*")).alias("object"))
    write_document([('{"Event":' + json.dumps(event)[:-1] + ',"Attribute":[', attributes)], "]}}", path)


def graph_document(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph's entities and edges."""
    rows = lambda df: df.select(F.to_json(F.struct("*")).alias("object"))
    write_document([('{"entities":[', rows(nodes)), ('],"edges":[', rows(edges))], "]}", path)


def graph_report(nodes: DataFrame, edges: DataFrame, actors: DataFrame, members: DataFrame, top: int = 20, listed: int = 20) -> dict:
    """How large a fused graph is, its most certain actors, and the first members of each kind of these."""
    best = _top(actors, top, F.desc("confidence"), "id")
    place = F.row_number().over(Window.partitionBy("actor", "type").orderBy("member"))
    some = members.where(F.col("actor").isin([a["id"] for a in best])).withColumn("at", place).where(F.col("at") <= listed)
    named = [r.asDict() for r in some.orderBy("actor", "type", "at").collect()]
    for a in best:
        a["members"] = {kind: [r["member"] for r in named if r["actor"] == a["id"] and r["type"] == kind] for kind in ("wallet-cluster", "infrastructure-cluster", "sanctioned-entity")}
    return {"entities": nodes.count(), "edges": edges.count(), "threat_actors": actors.count(), "actors": best}


def render_graph_text(made: dict) -> str:
    out = [f"{made['entities']} entities, {made['edges']} edges, {made['threat_actors']} threat actors", ""]
    for i, a in enumerate(made["actors"], 1):
        out.append(f"{i}. {a['id']}  confidence {a['confidence']:.2f} {a['confidence_band']}")
        for name, kind, n in (("wallets", "wallet-cluster", a["n_wallets"]), ("infrastructure", "infrastructure-cluster", a["n_infra"]), ("sanctioned", "sanctioned-entity", a["n_sanctions"])):
            if n:
                out.append(f"   {name} ({n}): {', '.join(a['members'][kind])}{', ...' * (n > len(a['members'][kind]))}")
    return "\n".join([*out, "", "Leads for human review, not determinations.", ""])


def _top(df: DataFrame, n: int, *order) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).limit(n).collect()]


def report(case: Case, entities: int = 40, findings: int = 80) -> dict:
    """The head of a case, small enough for a driver."""
    return {
        "summary": case.summary(),
        "entity_risk": _top(case.entity_risk.drop("contributions"), entities, F.desc("risk"), "entity"),
        "network_risk": _top(case.network_risk, 10, F.desc("network_risk"), "network_id"),
        "brokers": _top(case.brokers, 10, F.desc("broker_score"), F.desc("betweenness"), "entity"),
        "findings": _top(case.findings, findings, F.desc("score"), "typology", "id"),
        "merges": _top(case.merges, 20, "canonical"),
    }


def render_json(made: dict) -> str:
    return json.dumps(made, indent=2, sort_keys=True, default=str)


def render_text(made: dict) -> str:
    """Who, what and how: five entities, twelve findings, the first broker and network."""
    out = [f"CASE {made['summary']['case']}", "", "Entities:"]
    out += [f"  {r['entity']}  risk {r['risk']:.2f} {r['risk_band']}  ({', '.join(r['typologies'])})" for r in made["entity_risk"][:5]] or ["  none above the reporting threshold"]
    out += [f"  merged into {m['canonical']}: {', '.join(m['members'])}" for m in made["merges"]]
    out += ["", "Leads:"] + ([f"  [{f['severity']}] {f['typology']}: {', '.join(map(str, f['entities']))}; {f.get('evidence') or f['features']}" for f in made["findings"][:12]] or ["  none"])
    out += ["", "Structure:"]
    out += [f"  broker {b['entity']} (score {b['broker_score']:.2f}, betweenness {b['betweenness']:.4f})" for b in made["brokers"][:1]]
    out += [f"  {n['network_id']}: {n['flagged_entities']} of {n['size']} entities flagged, risk {n['network_risk']:.2f} {n['network_risk_band']}" for n in made["network_risk"][:1]]
    return "\n".join([*out, "", "Leads for human review, not determinations.", ""])


def render_html(made: dict) -> str:
    """One page without outside resources; everything is escaped."""
    esc = lambda x: html.escape(str(x), quote=True)

    def rows(items, cells) -> str:
        return "".join("<tr>" + "".join(f"<td>{c}</td>" for c in cells(i)) + "</tr>" for i in items)

    bar = lambda score: f'<svg width="160" height="10"><rect width="{160 * max(0.0, min(1.0, score)):.0f}" height="10" fill="#c33"/></svg>'
    risks = rows(made["entity_risk"][:40], lambda r: (esc(r["entity"]), bar(r["risk"]), f"{r['risk']:.2f}", esc(r["risk_band"]), esc(", ".join(r["typologies"]))))
    leads = rows(made["findings"][:80], lambda f: (esc(f["typology"]), esc(", ".join(map(str, f["entities"]))), f"{f['score']:.2f}", esc(f["severity"]), esc(f.get("evidence") or f["features"])))
    total = rows(sorted(made["summary"].items()), lambda kv: (esc(kv[0]), esc(kv[1])))
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Case {esc(made['summary']['case'])}</title></head><body><h1>Case {esc(made['summary']['case'])}</h1><table>{total}</table><h2>Entities</h2><table>{risks}</table><h2>Leads</h2><table>{leads}</table></body></html>"
