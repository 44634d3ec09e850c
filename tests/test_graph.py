"""Graph operators against brute force on random graphs."""

import random
from collections import Counter, deque

import numpy as np
from pyspark.sql import functions as F

from tests.test_detectors import ledger_of
from veritrail.operators import fusion, graph, infra, screening, traversal
from veritrail.operators.chain import common_input_clusters, peel_chains
from veritrail.operators.components import connected_components
from veritrail.operators.resolution import resolve_entities
from veritrail.sources.readers import path_graph


def brute_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def test_components(spark):
    rnd = random.Random(3)
    for one_task in (0, 10_000):
        for _ in range(3):
            edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)]
            df = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
            assert {r["node"]: r["component"] for r in connected_components(df, one_task=one_task).collect()} == brute_components(edges)


def test_long_path(spark):
    for one_task in (0, 1_000_000):
        txs = path_graph(spark, 300)
        ends = txs.selectExpr("inputs[0].address as a", "inputs[1].address as b")
        found = connected_components(ends, one_task=one_task)
        assert found.count() == 301 and found.select("component").distinct().count() == 1
    assert common_input_clusters(txs).select("cluster").distinct().count() == 1
    assert peel_chains(txs).count() == 0


def graph_of(rnd, n, m):
    names = [f"n{i:02d}" for i in range(n)]
    return [(rnd.choice(names), rnd.choice(names), 1, i) for i in range(m)]


def adjacency(rows):
    adj = {}
    for a, b, *_ in rows:
        adj.setdefault(a, set())
        adj.setdefault(b, set())
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def swept(adj, sweeps):
    """Each node's community after label propagation in order of names: the least member of those with its label."""
    label = {x: x for x in adj}
    for _ in range(sweeps):
        old = dict(label)
        for x in sorted(adj):
            votes = Counter(label[y] for y in adj[x])
            if votes:
                label[x] = min(k for k in votes if votes[k] == max(votes.values()))
        if label == old:
            break
    least = {}
    for x in sorted(label):
        least.setdefault(label[x], x)
    return {x: least[label[x]] for x in label}


def brute_shares(adj):
    want = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, count, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            v = queue.popleft()
            for w in adj[v]:
                if w not in dist:
                    dist[w], count[w] = dist[v] + 1, 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        share = dict.fromkeys(dist, 0.0)
        for w in sorted(dist, key=dist.get, reverse=True):
            for v in adj[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += count[v] / count[w] * (1 + share[w])
            if w != s:
                want[w] += share[w]
    return want


def many_graphs(seed, count=200):
    """``count`` random graphs of up to 20 nodes in one ledger, apart by name."""
    rnd = random.Random(seed)
    return [[(f"g{g:03d}-{a}", f"g{g:03d}-{b}", x, i) for a, b, x, i in graph_of(rnd, *rnd.choice([(2, 1), (6, 7), (12, 16), (20, 24), (20, 60)]))] for g in range(count)]


def test_betweenness_of_200_graphs(spark):
    graphs = many_graphs(5)
    got = {r["entity"]: r["share"] for r in traversal.path_shares(ledger_of(spark, *sum(graphs, []))).collect()}
    want = {x: v for rows in graphs for x, v in brute_shares(adjacency(rows)).items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 * max(1, want[x]) for x in want)
    one = {r["entity"]: r["betweenness"] for r in traversal.betweenness(ledger_of(spark, *graphs[3])).collect()}
    n = len(one)
    assert all(abs(v - want[x] / max(1, (n - 1) * (n - 2))) < 1e-6 for x, v in one.items())


def test_communities_of_200_graphs(spark):
    graphs = many_graphs(6)
    want = {x: c for rows in graphs for x, c in swept(adjacency(rows), 8).items()}
    for one_task in (0, 10**9):
        found = traversal.communities(ledger_of(spark, *sum(graphs, [])), max_iter=8, one_task=one_task)
        assert {r["entity"]: r["community"] for r in found.collect()} == want


def test_components_of_200_graphs(spark):
    graphs = many_graphs(7)
    edges = [(a, b) for rows in graphs for a, b, *_ in rows]
    rnd = random.Random(9)
    edges += [(f"p{i:04d}", f"p{i + 1:04d}") for i in rnd.sample(range(1500), 1500)]
    df = spark.createDataFrame(edges, "a string, b string").repartition(7)
    for one_task in (0, 60):
        assert {r["node"]: r["component"] for r in connected_components(df, one_task=one_task).collect()} == brute_components(edges)


def test_next_hops(spark):
    rnd = random.Random(10)
    rows = [(rnd.choice("abcd"), rnd.choice(["a", "b", "c", "d", None]), rnd.choice([100, 101, 124.9, 125, 126, 80, 75, 0, 1e9, None]), rnd.randrange(500)) for _ in range(160)]
    for tol in (0.0, 0.25, 1.0):
        got = {r["id"]: r["next_id"] for r in traversal.next_hops(ledger_of(spark, *rows), amount_tol=tol).collect()}
        want = {}
        for i, (_, dst, amount, hour) in enumerate(rows):
            fits = [(abs((r[2] or 0) - amount) / amount, f"t{j}") for j, r in enumerate(rows) if dst is not None and amount and r[0] == dst and 0 <= r[3] - hour <= 168 and abs((r[2] or 0) - amount) / amount <= tol] if amount else []
            if fits:
                want[f"t{i}"] = min(fits)[1]
        assert got == want and want


def test_busy_account(spark):
    """An account with 20,000 transfers in and as many out, of amounts all over, within a few weeks."""
    hub = spark.range(20_000).selectExpr("concat('i', id) id", "'a' src", "'hub' dst", "pow(10, 1 + (id * 7919 % 20000) / 4000.0) amount", "id * 100000000 ts_micros")
    out = spark.range(20_000).selectExpr("concat('o', id) id", "'hub' src", "'b' dst", "pow(10, 1 + (id * 104729 % 20000) / 4000.0) amount", "id * 100000000 + 1 ts_micros")
    assert traversal.next_hops(hub.unionByName(out)).count() > 10_000


def test_coactivity(spark):
    rnd = random.Random(11)
    days = [f"2026-01-{d:02d}" for d in range(1, 31)] + [f"2026-0{m}-{d:02d}" for m in (2, 3, 4) for d in range(1, 29)]
    rows = {(f"ip{i:02d}", d) for i in range(40) for d in [days[0], days[1], *rnd.sample(days, rnd.randrange(12))] if rnd.random() < 0.9} | {("once", days[0])}
    obs = spark.createDataFrame([(ip, d + "T10:00:00") for ip, d in rows for _ in range(rnd.randrange(1, 3))] + [(None, days[0] + "T1"), ("ip00", "no time")], "ip string, ts string")
    of = {}
    for ip, d in rows:
        of.setdefault(ip, set()).add(d)
    for least in (1, 2, 3, 5):
        want = {(a, b): len(of[a] & of[b]) for a in of for b in of if a < b and len(of[a] & of[b]) >= least}
        assert {(r["a"], r["b"]): r["shared_days"] for r in infra.coactivity(obs, least).collect()} == want and want


def test_graph_builder(spark):
    first = spark.createDataFrame([("x", "ip-address", "1"), ("y", "ip-address", "2")], "id string, type string, label string")
    more = spark.createDataFrame([("x", "person", "late", 1), ("z", "person", "second", 5), ("z", "person", "first", 2), (None, "person", "n", 0)], "id string, type string, label string, ordinal long")
    nodes = graph.add_nodes(first, more, first.withColumn("label", F.lit("again")))
    assert {(r["id"], r["type"], r["label"], r["chain"]) for r in nodes.collect()} == {("x", "ip-address", "1", None), ("y", "ip-address", "2", None), ("z", "person", "first", None)}
    assert graph.by_type(nodes, "person").count() == 1
    edge = spark.createDataFrame([("x", "y", "r", 0.5, "e")] * 2, "source string, target string, relation string, confidence double, evidence string")
    assert graph.add_edges(edge, edge).count() == 4
    pay = lambda a: [{"address": a, "value": 1.0}]
    txs = spark.createDataFrame([(pay("a"), pay("b"), "bitcoin"), (pay("a"), pay("a"), "ethereum"), (pay("a"), [], "ethereum"), (pay("b"), [], "monero"), (pay("c"), [], None)], "inputs array<struct<address:string,value:double>>, outputs array<struct<address:string,value:double>>, asset string")
    assert {(r["address"], r["chain"]) for r in graph.address_chains(txs).collect()} == {("a", "ethereum"), ("b", "bitcoin")}


def test_fusion_ids(spark):
    """A cluster's id depends on its set of members alone; the plan gathers no array of them."""
    txs = path_graph(spark, 50)
    none = [spark.createDataFrame([], schema) for schema in (infra.OBSERVATION, fusion.LINKAGE, screening.SDN)]
    ids = lambda t: {r["id"] for r in fusion.build_graph(t, *none)[0].where("type = 'wallet-cluster'").collect()}
    assert ids(txs) == ids(txs.orderBy(F.desc("ordinal")).repartition(5)) and len(ids(txs)) == 51
    assert ids(txs) != ids(txs.where("ordinal <> 20"))
    nodes, edges = fusion.build_graph(txs, *none)
    assert not any("collect_" in df._jdf.queryExecution().toString() for df in (nodes, edges))


def test_cycles(spark):
    rnd = random.Random(8)
    for _ in range(3):
        rows = [(a, b, rnd.choice([100, 110, 300]), h) for a, b, _, h in graph_of(rnd, 8, 16)]
        want = set()

        def walk(path, first, rows=rows, want=want):
            for a, b, amount, _ in rows:
                if a != path[-1] or a == b:
                    continue
                if b == path[0] and len(path) >= 3 and abs(amount - first) <= 0.35 * first:
                    want.add(frozenset(path))
                elif b not in path and len(path) < 5:
                    walk([*path, b], first if first is not None else amount)

        for start in {r[0] for r in rows}:
            walk([start], None)
        got = {frozenset(r["entities"]) for r in traversal.round_tripping(ledger_of(spark, *rows), max_len=5).collect()}
        assert got == want


def brute_paths(rows, src, dst, max_paths, max_len):
    """Simple paths, shortest first, then by names and ids: every one is made."""
    found, paths = [], [((src,), ())]
    for _ in range(max_len):
        paths = [((*route, b), (*ids, f"t{i}")) for route, ids in paths for i, (a, b, *_) in enumerate(rows) if a == route[-1] and b not in route and route[-1] != dst]
        found += sorted((p for p in paths if p[0][-1] == dst), key=lambda p: list(zip(p[0][1:], p[1], strict=True)))
    return [(">".join(route), ">".join(ids)) for route, ids in found[:max_paths]] if src != dst else []


def test_paths_against_all_of_them(spark, monkeypatch):
    rnd = random.Random(12)
    for n, m, most, limit in ((6, 14, (1, 2, None), 4), (8, 16, (2, None), 30), (7, 18, (1_000, None), 5)):
        monkeypatch.setattr(traversal, "FOLLOWED", most, raising=False)
        rows = graph_of(rnd, n, m)
        got = traversal.path_of_funds(ledger_of(spark, *rows), "n00", "n01", limit, 5).collect()
        want = brute_paths(rows, "n00", "n01", limit, 5)
        assert sorted((">".join(r["route"]), ">".join(r["edges"])) for r in got) == sorted(want) and want
        amounts = [x for _, _, x, _ in rows]
        assert all(r["hops"] == len(r["edges"]) and r["total"] == sum(amounts[int(i[1:])] for i in r["edges"]) for r in got)


def test_few_paths_are_followed(spark, monkeypatch):
    """No step makes more paths than are followed, and none goes where no end of the length is; before, all of up to four hops were made."""
    written, keep = [], traversal.materialize

    def materialize(df, *by):
        out = keep(df, *by)
        if "route" in df.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(traversal, "materialize", materialize)
    rows = [(f"C{i}", f"S{j}", 1, 0) for i in range(12) for j in range(6)] + [(f"S{j}", f"C{i}", 1, 0) for i in range(12) for j in range(6) if (i, j) != (11, 0) and i != 10] + [("S0", "C10", 2, 0)]
    got = traversal.path_of_funds(ledger_of(spark, *rows), "C0", "C10", 3).collect()
    assert [r["route"] for r in got][:1] == [["C0", "S0", "C10"]] and [r["hops"] for r in got] == [2, 4, 4]
    assert max(written) <= 6 * 10


def test_pairs_two_apart(spark):
    pairs = lambda *rows: spark.createDataFrame(rows, "src string, dst string")
    rnd = random.Random(13)
    for m in (1, 2, 3, 4, 6, 9):
        rows = [(a, b) for a, b, *_ in graph_of(rnd, 5, m) if a != b] or [("a", "b")]
        ends = [(a, d) for a, b in rows for c, d in rows if b == c and a != d]
        assert traversal.two_apart(pairs(*rows)) == min(ends, default=None)
    # What the least sender pays to pays back to it alone.
    assert traversal.two_apart(pairs(("a", "b"), ("b", "a"), ("c", "b"), ("c", "d"))) == ("c", "a")


def test_names(spark):
    names = ["Acme Trading LLC", "ACME Trading, L.L.C.", "acct_1", "acct_2", "Zeta", "", None, "Beta Corp", "beta corporation"]
    got = {r["name"]: r["canonical"] for r in resolve_entities(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got["acct_1"] != got["acct_2"] and got["Beta Corp"] == got["beta corporation"] == "Beta Corp"
    assert got["Acme Trading LLC"] == got["ACME Trading, L.L.C."] and "" not in got


def test_betweenness_by_searches_and_by_joins(spark, monkeypatch):
    """Few links are held by tasks that share the searches, without levels of rows; many are joined, with the same shares."""
    graphs = many_graphs(9, 40)
    ledger = ledger_of(spark, *sum(graphs, []))
    joined = {r["entity"]: r["share"] for r in traversal.path_shares(ledger, held_links=0).collect()}
    monkeypatch.setattr(traversal, "_shares_by_joins", lambda near: 1 / 0)
    held = {r["entity"]: r["share"] for r in traversal.path_shares(ledger).collect()}
    assert held.keys() == joined.keys() and any(held.values())
    assert all(abs(held[e] - joined[e]) < 1e-9 for e in held)


def test_searches_of_many_sources_at_once(monkeypatch):
    """Sources that are searched together have the shares that each has alone; nodes with very many links are summed up in parts."""
    monkeypatch.setattr(traversal, "GATHERED", 16, raising=False)
    for seed, (n, m) in enumerate([(2, 1), (30, 40), (60, 60), (40, 300)]):
        rng = np.random.default_rng(seed)
        pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (m, 2)).tolist() if p[0] != p[1]} | {(0, i) for i in range(1, n if seed > 1 else 2)}
        names = {x: i for i, x in enumerate(sorted({x for p in pairs for x in p}))}
        ends = np.array(sorted((names[x], names[y]) for a, b in pairs for x, y in ((a, b), (b, a))))
        for width in (1, 3, 64):
            sources = range(1 if len(names) > 2 else 0, len(names), 2)
            got = traversal._shares_together(ends[:, 0], ends[:, 1], len(names), sources, width)
            assert np.allclose(got, traversal._shares_of(ends[:, 0], ends[:, 1], len(names), sources), rtol=1e-12, atol=0)


def test_searches_hold_a_component(spark, monkeypatch):
    """No task holds links of components that it doesn't search, and one component that is too large doesn't send the others to joins."""
    monkeypatch.setattr(traversal, "SMALL_PARTS", 10, raising=False)
    monkeypatch.setattr(traversal, "TOGETHER", 8, raising=False)
    rows = [(f"g{g}-{a}", f"g{g}-{b}", x, i) for g in range(3) for a, b, x, i in graph_of(random.Random(g), 14, 30)] + [("p0", "p1", 1, 0), ("q0", "q1", 1, 0), ("q1", "q2", 1, 0), ("lone", None, 1, 0)]
    rows += [("hub", f"leaf{i:02d}", 1, 0) for i in range(60)]
    adj = adjacency([r for r in rows if r[1] is not None]) | {"lone": set()}
    joined, by_joins = [], traversal._shares_by_joins
    monkeypatch.setattr(traversal, "_shares_by_joins", lambda near: joined.append(near.count()) or by_joins(near))
    got = {r["entity"]: r["share"] for r in traversal.path_shares(ledger_of(spark, *rows), held_links=100).collect()}
    want = brute_shares(adj)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 * max(1, want[x]) for x in want)
    assert joined == [120]
