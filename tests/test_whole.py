"""The queries see every entity; paths and betweenness against brute force."""

import pytest

from tests.conftest import SF
from veritrail.plans import registry
from veritrail.plans.views import transfers


@pytest.fixture(scope="module")
def edges(spark):
    return [tuple(r) for r in transfers(spark, SF).select("src", "dst", "id").collect()]


@pytest.mark.parametrize("name", ["connected_components", "communities", "centrality"])
def test_every_entity_is_there(spark, edges, name):
    column = "node" if name == "connected_components" else "entity"
    found = [r[column] for r in registry.QUERIES[f"{name}"](spark, SF).collect()]
    assert sorted(found) == sorted({x for a, b, _ in edges for x in (a, b)})


def test_paths_of_all_transfers(spark, edges):
    found = registry.QUERIES["path_of_funds"](spark, SF).collect()
    by_src = {}
    for a, b, i in edges:
        by_src.setdefault(a, []).append((b, i))
    start, end = min((a, c) for a, b, _ in edges for c, _ in by_src.get(b, ()) if a != c)
    assert end not in {b for b, _ in by_src[start]}
    two = sorted(((b, i), (c, j)) for b, i in by_src[start] for c, j in by_src.get(b, ()) if c == end)
    assert 0 < len(two)
    want = [(f"{start}>{b}>{c}", f"{i}>{j}") for (b, i), (c, j) in two[:5]]
    assert [(r["route"], r["edges"]) for r in found if r["hops"] == 2] == want
    assert len(found) == 5


def test_betweenness_of_all_transfers(spark, edges):
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    walks = {}
    for s in near:
        depth, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        walks[s] = depth, paths
    n = len(near)
    # A node lies between two others if the distances add up; the share is that of the shortest paths through it.
    found = {r["entity"]: r["betweenness"] for r in registry.QUERIES["centrality"](spark, SF).collect()}
    for v in sorted(near)[::12]:
        dv, pv = walks[v]
        share = sum(
            walks[s][1][v] * pv[t] / walks[s][1][t]
            for s in near if s != v and v in walks[s][0]
            for t in walks[s][0] if t not in (s, v) and t in dv and walks[s][0][v] + dv[t] == walks[s][0][t]
        )
        assert found[v] == pytest.approx(share / ((n - 1) * (n - 2)), abs=2e-6)
