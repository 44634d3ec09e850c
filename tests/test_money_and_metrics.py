"""Sums of money, scores against planted truth, documents and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from veritrail import cli
from veritrail.operators import case, chain, detectors, fusion, infra, ledger, metrics, screening
from veritrail.sources import exports, planted


def sums(spark, amounts):
    rows = spark.createDataFrame([(a,) for a in amounts], "amount double")
    return rows.agg(ledger.money("amount").alias("s")).first()["s"]


def test_money(spark):
    assert sums(spark, [0.004, 0.004]) == 0.008
    assert sums(spark, [1e-8] * 3) == 3e-8
    assert sums(spark, [0.1] * 10) == 1.0
    assert sums(spark, [2e16, 1.0]) == 2e16 + 1
    assert sums(spark, [1e300, 1e300]) == 2e300
    assert sums(spark, [float("inf"), 1.0]) == float("inf")
    assert sums(spark, [None, 2.5]) == 2.5


def test_small_and_large_amounts_are_found(spark):
    rows = spark.createDataFrame([("a", "x", "m", 4e-5, 10), ("b", "m", "y", 3.9e-5, 20), ("c", "x", "n", 3e17, 10), ("d", "n", "y", 3e17, 20)], "id string, src string, dst string, amount double, ts_micros long")
    got = {r["entities"][0]: r["total_in"] for r in detectors.pass_through(rows).collect()}
    assert got == {"m": 4e-5, "n": 3e17}
    near = spark.createDataFrame([(str(i), "s", "d", 9.5e-4, i) for i in range(3)], "id string, src string, dst string, amount double, ts_micros long")
    assert [r["window_total"] for r in detectors.structuring(near, threshold=1e-3).collect()] == [pytest.approx(2.85e-3)]


def test_pairwise_scores_against_pairs(spark):
    ours = {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "z": 9}
    theirs = {"a": 5, "b": 5, "c": 6, "d": 6, "e": 7, "y": 5}
    pairs = lambda x: {(p, q) for p in x for q in x if p < q and x[p] == x[q]}
    found, real = pairs(ours), pairs(theirs)
    frame = lambda x: spark.createDataFrame(list(x.items()), "member string, cluster int")
    got = metrics.pairwise_scores(frame(ours), frame(theirs)).first()
    assert (got["tp"], got["fp"], got["fn"]) == (len(found & real), len(found - real), len(real - found))
    some = metrics.pairwise_scores(frame(ours), frame(theirs), spark.createDataFrame([("d",), ("e",)], "member string")).first()
    assert (some["tp"], some["fp"], some["fn"]) == (0, 1, 0)
    none = metrics.label_scores(spark.createDataFrame([], "label string"), spark.createDataFrame([], "label string")).first()
    assert (none["precision"], none["recall"], none["f1"]) == (1.0, 1.0, 1.0)


def document(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_documents(spark, tmp_path):
    txs, _, _ = planted.transactions(spark)
    obs = spark.createDataFrame([("1.1.1.1", "2026-01-01T00:00:00", None, "c", ["d"], [], [], 0)], infra.OBSERVATION)
    ties = spark.createDataFrame([("o0-0", None, "1.1.1.1", None, "tip", 0.7, 0)], fusion.LINKAGE)
    listed = spark.createDataFrame([("someone", "P", [], {"crypto": ["o0-1"]}, 0)], screening.SDN)
    nodes, edges = fusion.build_graph(txs, obs, ties, listed)
    members = fusion.actor_members(nodes, edges)
    actors = fusion.threat_actors(members)
    exports.graph_document(nodes, edges, str(tmp_path / "graph"))
    graph = document(tmp_path / "graph")
    assert len(graph["entities"]) == nodes.count() and {e["relation"] for e in graph["edges"]} == {"member-of", "controlled-by-same-actor", "sanctioned-as"}
    exports.stix_bundle(exports.graph_stix_objects(nodes, edges, actors, members), str(tmp_path / "stix"))
    bundle = document(tmp_path / "stix")
    assert bundle["type"] == "bundle" and {o["type"] for o in bundle["objects"]} >= {"indicator", "threat-actor", "relationship"}
    exports.misp_event(nodes, actors, str(tmp_path / "misp"))
    event = document(tmp_path / "misp")["Event"]
    assert len(event["Attribute"]) == nodes.where("type in ('crypto-address', 'ip-address')").count() and {"name": "ofac:sanctioned"} in event["Tag"]
    exports.misp_event(nodes.limit(0), actors.limit(0), str(tmp_path / "none"))
    assert document(tmp_path / "none")["Event"]["Attribute"] == []
    text = exports.render_graph_text(exports.graph_report(nodes, edges, actors, members))
    assert "1 threat actors" in text and "o0-1" not in text.splitlines()[0]


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    rows, _, _ = planted.ledger(spark)
    items = [{"id": r["id"], "src": r["src"], "dst": r["dst"], "amount": r["amount"], "ts": r["t"]} for r in rows.withColumn("t", F.date_format(F.timestamp_micros("ts_micros"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).collect()]
    path = tmp_path / "ledger.json"
    path.write_text(json.dumps(items))
    assert cli.main(["typologies", "--ledger", str(path), "--stix", str(tmp_path / "s"), "--csv", str(tmp_path / "c")]) == 0
    assert "structuring" in capsys.readouterr().out
    assert document(tmp_path / "s")["type"] == "bundle"
    assert cli.main(["trace-funds", "--ledger", str(path), "--src", "layer-0", "--dst", "layer-3"]) == 0
    assert "layer-1" in capsys.readouterr().out
    assert cli.main(["sources-stats"]) == 0
    assert cli.main(["sources-intel", "--cache", str(tmp_path / "cache"), "--offline"]) == 0
    assert "offline" in capsys.readouterr().err
    with pytest.raises(RuntimeError, match="offline"):
        cli.main(["sources-fetch", "--name", "cisa_kev", "--cache", str(tmp_path / "cache"), "--offline"])
    assert cli.main(["resolve", "--ledger", str(path)]) == 0


def test_planted_cases_are_risky(spark):
    rows, truth, listed = planted.ledger(spark)
    found = case.run_detectors(rows, listed, enabled=["structuring", "funnel_account", "sanctions_nexus"])
    said = {(r["typology"], r["entities"][0]): r["evidence"] for r in found.collect()}
    assert said["structuring", "smurf"] == "4 deposits just under the threshold, 38200 in one window, 3.8 times the threshold"
    assert said["sanctions_nexus", "helper"] == "1 transfers away from a listed entity"
    assert metrics.typology_recall(found, truth.where("typology in ('structuring', 'funnel_account')")).where("typology = 'macro'").first()["recall"] == 1.0
    txs, _, _ = planted.transactions(spark)
    assert max(r["length"] for r in chain.peel_chains(txs).collect()) == 4
