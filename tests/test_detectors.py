"""Detectors on small ledgers, positive and negative."""

import pytest
from pyspark.sql import functions as F

from veritrail.operators import case, detectors, ledger, risk, traversal

HOUR = 3_600_000_000
SCHEMA = "id string, src string, dst string, amount double, ts_micros long, counterparty_country string, goods_value double"


def ledger_of(spark, *rows):
    """Rows (src, dst, amount, hour[, country, goods])."""
    full = [(f"t{i}", r[0], r[1], None if r[2] is None else float(r[2]), 0 if r[3] is None else 1_700_000_000_000_000 + int(r[3] * HOUR), *(list(r[4:]) + [None, None])[:2]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def hits(df):
    return sorted(tuple(r["entities"]) for r in df.collect())


def test_structuring(spark):
    split = [("a", "x", 9500, 2 * i) for i in range(4)]
    assert hits(detectors.structuring(ledger_of(spark, *split))) == [("x",)]
    assert hits(detectors.structuring(ledger_of(spark, ("a", "x", 50000, 0)))) == []
    assert hits(detectors.structuring(ledger_of(spark, *split[:2]))) == []
    far = [("a", "x", 9500, 100 * i) for i in range(4)]
    assert hits(detectors.structuring(ledger_of(spark, *far))) == []


def test_pass_through(spark):
    assert hits(detectors.pass_through(ledger_of(spark, ("a", "m", 10000, 0), ("m", "b", 9500, 2)))) == [("m",)]
    assert hits(detectors.pass_through(ledger_of(spark, ("a", "m", 10000, 0), ("m", "b", 1000, 2)))) == []
    assert hits(detectors.pass_through(ledger_of(spark, ("a", "m", 10000, 0), ("m", "b", 9500, 100)))) == []
    tie = detectors.pass_through(ledger_of(spark, ("a", "m", 100, 0), ("m", "b", 100, 0))).first()
    assert tie["median_hold_hours"] == 0


def test_trade(spark):
    rows = [("a", "b", 100000, 0, "X", 20000.0), ("c", "d", 5000, 0, "X", 100000.0), ("e", "f", 105000, 0, "X", 100000.0), ("g", "h", 1, 0), ("i", None, 9, 0, "X", 1.0), ("j", "k", None, 0, "X", 5.0)]
    found = {r["entities"][0]: r["direction"] for r in detectors.trade_value_anomaly(ledger_of(spark, *rows)).collect()}
    assert found == {"a": "over-invoicing", "c": "under-invoicing", "i": "over-invoicing"}


def test_funnel(spark):
    into = [(f"s{i}", "f", 100, i, f"R{i}") for i in range(5)]
    assert hits(detectors.funnel_account(ledger_of(spark, *into, ("f", "d", 400, 9)))) == [("f",)]
    assert hits(detectors.funnel_account(ledger_of(spark, *into, *[("f", f"d{i}", 1, 9) for i in range(5)]))) == []
    assert hits(detectors.funnel_account(ledger_of(spark, *[(r[0], "f", 100, r[3]) for r in into], ("f", "d", 400, 9)))) == [("f",)]
    assert hits(detectors.funnel_account(ledger_of(spark, *[(*r[:4], "R") for r in into], ("f", "d", 400, 9)))) == []


def test_burst(spark):
    assert ("x",) in hits(detectors.burst_velocity(ledger_of(spark, ("x", None, 1, 1), *[("x", None, 1, 1001 + 0.3 * i) for i in range(8)])))
    assert hits(detectors.burst_velocity(ledger_of(spark, *[("x", None, 1, 100 * i + 1) for i in range(9)]))) == []


def test_dormancy(spark):
    late = [("x", None, 1, 2 + 24 * 120 + i) for i in range(4)]
    assert hits(detectors.dormancy_activation(ledger_of(spark, ("x", None, 1, 1), ("x", None, 1, 2), *late))) == [("x",)]
    assert hits(detectors.dormancy_activation(ledger_of(spark, *[("x", None, 1, 24 * i + 1) for i in range(9)]))) == []


def test_periodicity(spark):
    assert hits(detectors.periodicity(ledger_of(spark, *[("x", None, 1, 24 * i + 1) for i in range(8)]))) == [("x",)]
    assert hits(detectors.periodicity(ledger_of(spark, *[("x", None, 1, i**3 + 1) for i in range(8)]))) == []


def test_undated_rows_take_no_part_in_time(spark):
    undated = ledger_of(spark, *[("x", "y", 1, None) for _ in range(9)])
    for detect in case.TEMPORAL.values():
        assert detect(undated).count() == 0


def test_round_tripping(spark):
    cycle = [("o", "a", 1000, 0), ("a", "b", 990, 1), ("b", "o", 980, 2)]
    assert [sorted(h) for h in hits(traversal.round_tripping(ledger_of(spark, *cycle)))] == [["a", "b", "o"]]
    assert hits(traversal.round_tripping(ledger_of(spark, *cycle[:2]))) == []
    assert hits(traversal.round_tripping(ledger_of(spark, ("o", "a", 1000, 0), ("a", "b", 100, 1), ("b", "o", 10, 2)))) == []
    assert hits(traversal.round_tripping(ledger_of(spark, ("a", "b", 1, 0), ("b", "a", 1, 1), ("c", "c", 1, 1)))) == []


def test_layering(spark):
    chain = [(f"n{i}", f"n{i + 1}", 1000, 5 * i) for i in range(5)]
    found = traversal.layering(ledger_of(spark, *chain)).collect()
    assert [(r["hops"], r["entities"]) for r in found] == [(5, [f"n{i}" for i in range(6)])]
    assert traversal.layering(ledger_of(spark, *chain[:2])).count() == 0


def test_shell(spark):
    full = [(a, b, 10, 0) for a in "abc" for b in "abc" if a != b]
    found = traversal.shell_nominee(ledger_of(spark, *full, ("a", None, 1, 0))).first()
    assert found["entities"] == ["a", "b", "c"] and found["external_value"] == 1.0
    assert traversal.shell_nominee(ledger_of(spark, *full, ("a", None, 100, 0))).count() == 0


def test_nexus(spark):
    rows = ledger_of(spark, ("w", "n1", 1, 0), ("n1", "n2", 1, 0), ("n2", "n3", 1, 0))
    watch = spark.createDataFrame([("w",), ("unknown",)], "entity string")
    found = {r["entities"][0]: r["score"] for r in traversal.sanctions_nexus(rows, watch).collect()}
    assert set(found) == {"n1", "n2"} and found["n1"] > found["n2"]
    assert traversal.sanctions_nexus(rows, watch.limit(0)).count() == 0


def test_paths(spark):
    rows = ledger_of(spark, ("A", "B", 100, 0), ("B", "C", 40, 1), ("C", "D", 70, 2), ("C", "A", 1, 2))
    found = traversal.path_of_funds(rows, "A", "D").collect()
    assert [(r["route"], r["hops"], r["bottleneck"], r["total"]) for r in found] == [(["A", "B", "C", "D"], 3, 40.0, 210.0)]
    assert traversal.path_of_funds(rows, "A", "nobody").count() == 0
    assert traversal.path_of_funds(rows, "A", "A").count() == 0
    twice = ledger_of(spark, ("A", "B", 1, 0), ("A", "B", 2, 0), ("B", "D", 3, 0))
    assert traversal.path_of_funds(twice, "A", "D").count() == 2


def test_one_sided_rows(spark):
    rows = ledger_of(spark, ("a", None, 5, 0), (None, "b", 7, 0), ("a", "b", None, 0))
    assert {r["entity"] for r in ledger.entities(rows).collect()} == {"a", "b"}
    assert [tuple(r) for r in ledger.pairs(rows).collect()] == [("a", "b", 1, 0.0)]


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert case.run_detectors(empty).count() == 0
    assert case.build_case(empty).summary()["findings"] == 0


def test_risk(spark):
    findings = spark.createDataFrame([("f1", "structuring", ["a"], 0.8), ("f2", "structuring", ["a", None], 0.6), ("f3", "unheard_of", ["a", "b"], 1.0)], "id string, typology string, entities array<string>, score double")
    rows = {r["entity"]: r for r in risk.entity_risk(findings).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["risk"] == pytest.approx(1 - (1 - 0.6) * (1 - 0.5) + 0.05)
    assert rows["a"]["contributions"][0]["finding_id"] == "f1"
    parts = spark.createDataFrame([("a", "a"), ("b", "a"), ("z", "z")], "node string, component string")
    net = risk.network_risk(findings, parts).collect()
    assert [(n["network_id"], n["size"], n["flagged_entities"]) for n in net] == [("network-1", 2, 2)]


def test_finding_ids(spark):
    from veritrail.functions.scalars import finding_id, uuid5

    import uuid

    df = spark.createDataFrame([(["b", "a"], ["a", "b"])], "x array<string>, y array<string>")
    one, two = df.select(finding_id(F.lit("t"), F.col("x")), finding_id(F.lit("t"), F.col("y"))).first()
    assert one == two
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert spark.range(1).select(uuid5(space, F.lit("name"))).first()[0] == str(uuid.uuid5(uuid.UUID(space), "name"))
