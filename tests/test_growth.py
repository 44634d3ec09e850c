"""Steps that grew faster than their input."""

import random

from pyspark.sql import functions as F

from tests.conftest import SF
from veritrail.functions.names import similarity
from veritrail.operators import case, chain, infra, ledger, metrics, resolution, successors, traversal
from veritrail.plans import registry, views
from veritrail.sources import onchain, planted


def test_names_of_series_against_all_pairs(spark):
    rnd = random.Random(5)
    names = {f"{head} {rnd.randrange(10**6):06d}" for head in ("account holder", "account holders", "depot") for _ in range(25)}
    names |= {f"{a} {b} trade" for a in ("north", "northe", "south") for b in ("gate", "gates", "road", "roads")} | {"depot 12 3", "depot 1 23", "dep12ot 3", "account holder"}
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = rows.select(F.col("name").alias("a")).crossJoin(rows.select(F.col("name").alias("b"))).where("a < b").withColumn("s", similarity(F.col("a"), F.col("b"))).where("s >= 0.82")
    want = {tuple(r) for r in pairs.collect()}
    assert len(want) > 12
    # "depot 12 3" and "depot 1 23" have the same bigrams and other normal forms.
    assert ("depot 1 23", "depot 12 3", 1.0) in want
    for series in (3, 1000):
        assert {tuple(r) for r in resolution.similar_pairs(rows, series=series).collect()} == want


def test_summary_without_brokers(spark, monkeypatch):
    rows = spark.createDataFrame([("1", "a", "b", 5.0, 1, None, None), ("2", "b", "c", 6.0, 2, None, None)], "id string, src string, dst string, amount double, ts_micros long, counterparty_country string, goods_value double")
    asked = []
    monkeypatch.setattr(traversal, "top_brokers", lambda transfers, k=10: asked.append(k))
    made = case.build_case(rows)
    assert made.summary()["entities"] == 3 and not asked
    made.brokers  # noqa: B018
    assert asked == [10]


def test_chains_share_what_follows(spark):
    """Many chains that go on to one row hold that row's stretch once until the end."""
    n = 40
    nodes = [(f"n{i}", f"n{i + 1}" if i + 1 < n else None, f"v{i}") for i in range(n)]
    leaves = [(f"l{i}-{k}", f"n{i}", "leaf") for i in range(0, n, 7) for k in range(3)]
    rows = spark.createDataFrame(nodes + leaves, "id string, next_id string, v string")
    ways = successors.jumps(rows, 100)
    reach = {f"l{i}-{k}": min(n - i, 25 + k) for i in range(0, n, 7) for k in range(3)} | {f"n{n - 1}": 0}
    starts = spark.createDataFrame([(x, dict((a, b) for a, b, _ in nodes + leaves)[x], r) for x, r in reach.items()], "id string, next_id string, reach long")
    held = rows.select("id", "next_id", F.struct("id", "v").alias("held"))
    found = {r["id"]: [x["id"] for x in r["w"]] for r in successors.walked(starts, held, ways, 100).collect()}
    assert found == {x: [x] + ([f"n{j}" for j in range(int(x[1:].split("-")[0]), int(x[1:].split("-")[0]) + r)] if r else []) for x, r in reach.items()}


def test_degrees_of_loops_and_single_sides(spark):
    rows = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", 4.0), (None, "a", 8.0), ("b", None, 16.0), ("c", "b", None)], "src string, dst string, amount double")
    assert {tuple(r) for r in ledger.degrees(rows).collect()} == {("a", 1, 3, 2, 19.0), ("b", 2, 2, 2, 19.0), ("c", 1, 0, 1, 0.0)}


def test_shared_days_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(infra, "BLOCK", 3)
    rnd = random.Random(3)
    seen = {f"U{i}": {f"2026-01-{d:02d}" for d in range(1, 10) if rnd.random() < 0.4} for i in range(25)}
    rows = [(ip, f"{d}T00:00:00", 0) for ip, days in seen.items() for d in days]
    found = {tuple(r)[:3] for r in infra.coactivity(spark.createDataFrame(rows, "ip string, ts string, ordinal long")).collect()}
    assert found == {(a, b, len(seen[a] & seen[b])) for a in seen for b in seen if a < b and len(seen[a] & seen[b]) >= 2}


def test_shared_days_of_many_days(spark, monkeypatch):
    """Days fill several words of bits, and lists of them never become Python's objects."""
    import pyarrow as pa

    monkeypatch.setattr(infra, "BLOCK", 8)
    rnd = random.Random(4)
    days = [f"{y}-{m:02d}-{d:02d}" for y in (2025, 2026) for m in range(1, 4) for d in range(1, 28)]
    seen = {f"U{i}": {d for d in days if rnd.random() < share} for i, share in enumerate([0.9] * 8 + [0.1] * 12 + [0.02] * 20)}
    rows = spark.createDataFrame([(ip, f"{d}T00:00:00", 0) for ip, ds in seen.items() for d in ds], "ip string, ts string, ordinal long")
    for least in (1, 2, 70, 140):
        found = {tuple(r)[:3] for r in infra.coactivity(rows, least).collect()}
        want = {(a, b, len(seen[a] & seen[b])) for a in seen for b in seen if a < b and len(seen[a] & seen[b]) >= least}
        assert found == want and (want or least == 140)
    held = pa.list_(pa.struct([("ip", pa.string()), ("ranks", pa.list_(pa.int32()))]))
    side = lambda *x: pa.array([[{"ip": ip, "ranks": ranks} for ip, ranks in x]], held)
    table = pa.table({"rank": pa.array([1], pa.int32()), "a_block": [0], "a": side(("x", [0, 1, 2]), ("é", [1, 2])), "b_block": [1], "b": side(("y", [0, 1, 3]), ("b", [1, 2]))})

    class Watched:
        num_rows = 1
        __getitem__ = lambda self, c: table[c]

    assert infra._shared(2)(Watched()).to_pylist() == [{"a": "b", "b": "x", "shared_days": 2}, {"a": "b", "b": "é", "shared_days": 2}]


def test_transactions_do_not_hold_their_block(spark):
    docs = spark.createDataFrame([('{"result":{"timestamp":"0x10","transactions":[{"hash":"h","from":"a","to":"b","value":"0xde0b6b3a7640000"}]}}',)], "value string")
    made = onchain.evm_block(docs)
    assert [(r["txid"], r["ts"], r["inputs"][0]["value"]) for r in made.collect()] == [("h", "16", 1.0)]
    # The time is worked out below the step that makes a row of each transaction.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan[plan.index("Generate explode"):]


def test_planted_copies_are_not_broadcast(spark):
    """Spark takes what is exploded to be as small as its keys: such sides of scores were broadcast whole."""
    keys = spark.range(50).select(F.col("id").alias("key")).coalesce(1)
    one = spark.createDataFrame([("a", "x"), ("b", "x")], "member string, cluster string")
    made = planted.copies(one, keys, "member", "cluster")
    assert made.count() == 100 and len(set(made.select(F.input_file_name()).distinct().collect())) > 1
    scores = metrics.pairwise_scores(made, made)
    assert "BroadcastHashJoin" not in scores._jdf.queryExecution().executedPlan().toString()
    assert tuple(scores.first())[3:] == (50, 0, 0)
    labels = lambda *x: spark.createDataFrame([(v,) for v in x], "label string")
    assert tuple(metrics.label_scores(labels("a", "a", "b", None), labels("b", "c", None)).first())[3:] == (1, 2, 2)


def test_transfers_are_read_once(spark):
    """What a query gives is made of tables that it wrote: transfers are not put together again for each use."""
    for name in ("sanctions_nexus", "network_risk"):
        made = registry.QUERIES[name](spark, SF)
        assert not [f for f in made.inputFiles() if "lineitem" in f], name


def test_watched_that_do_not_occur(spark):
    rows = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", None), ("w", "w")], "src string, dst string")
    watched = spark.createDataFrame([("a",), ("w",), ("nobody",), (None,), ("a",)], "entity string")
    assert {(r["entities"][0], r["hops_to_watchlist"]) for r in traversal.sanctions_nexus(rows, watched).collect()} == {("b", 1), ("c", 2)}


def test_mixers_fold_values_once(spark):
    """A fold inside the step of another one is work that grows with the square of a transaction's outputs."""
    rows = [("t", "x", [("a", 1.0)] * 3, [("b", 5.0), ("c", 5.5), ("d", 4.5)], 0), ("u", "x", [("a", 1.0)] * 3, [("b", 5.0), ("c", 50.0), ("d", 1.0)], 1), ("v", "x", None, [("b", 5.0)] * 3, 2)]
    made = chain.mixers(spark.createDataFrame(rows, chain.TRANSACTION))
    assert [(r["txid"], r["n_inputs"], r["n_outputs"], round(r["cv"], 6)) for r in made.collect()] == [("t", 3, 3, 0.081650)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("aggregate(") <= 2


def test_flows_are_dealt_out_by_rows(spark, monkeypatch):
    """Tasks grow with the lines, and each pair of addresses is summed up once it has been dealt out."""
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    lines = views.table(spark, SF, "lineitem")
    assert views.tasks_for(lines) == -(-lines.count() // 100) > 2 * spark.sparkContext.defaultParallelism
    txs = registry.QUERIES["flow_expansion"]
    plan = txs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    tail = plan[: plan.index("Exchange")]
    assert tail.count("HashAggregate") == 2 and "REPARTITION_BY_NUM" in plan
    small = chain.flow_totals(spark.createDataFrame([("t", "", [("a", 1.0), ("a", 2.0)], [("x", 3.0), ("y", None)], 0), ("u", "", [("a", 1.0)], [("x", 4.0)], 1), ("v", "", None, [("x", 4.0)], 2)], chain.TRANSACTION), 3)
    assert {tuple(r) for r in small.collect()} == {("a", "x", 3, 10.0), ("a", "y", 2, None)}


def test_sweeps_deal_out_numbers(spark, monkeypatch):
    """No table of a sweep holds names, and a wave is looked at only where others have changed since."""
    written, keep = [], traversal.materialize

    def materialize(df, *by):
        written.append(df.dtypes)
        return keep(df, *by)

    monkeypatch.setattr(traversal, "materialize", materialize)
    rows = spark.createDataFrame([(f"C{i}", f"S{j}") for i in range(6) for j in range(2)], "src string, dst string")
    got = {r["entity"]: r["community"] for r in traversal.communities(rows, one_task=0).collect()}
    assert got == {r["entity"]: r["community"] for r in traversal.communities(rows, one_task=10**9).collect()}
    sweeps = [t for t in written if [c for c, _ in t] == ["entity", "label", "moved"]]
    assert sweeps and all(kind == "int" for t in sweeps for c, kind in t if c != "moved")
    # All agree after one sweep: customers are looked at once more, suppliers are not.
    assert len(sweeps) == 3
