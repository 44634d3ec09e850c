"""Operator 5 with more membership patterns than a broadcast takes."""

import itertools
import random
import time

import pytest

from tests.conftest import SF
from veritrail.llm import mixing


def brute_flow(patterns, quotas, epochs):
    """(most words, least cost for these), over all ways to share patterns among their sources."""
    ways = [[w for w in itertools.product(range(n * epochs + 1), repeat=len(p)) if sum(w) <= n * epochs] for p, n in patterns.items()]
    best = (0, 0)
    for way in itertools.product(*ways):
        taken, cost = dict.fromkeys(quotas, 0), 0
        for (p, n), words in zip(patterns.items(), way, strict=True):
            for s, w in zip(p, words, strict=True):
                taken[s] += w
            cost += sum(max(0, sum(words) - e * n) for e in range(1, epochs))
        if all(taken[s] <= q for s, q in quotas.items()):
            best = max(best, (sum(taken.values()), -cost))
    return best


def test_flow_is_the_cheapest_of_the_largest():
    rnd = random.Random(2)
    for _ in range(60):
        patterns = {p: rnd.randint(1, 3) for p in rnd.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)], 3)}
        quotas = {s: rnd.randint(0, 6) for s in "abc" if any(s in p for p in patterns)}
        flow = mixing.min_cost_flow(patterns, quotas, 2)
        assert (sum(flow.values()), -sum(max(0, flow[p] - n) for p, n in patterns.items())) == brute_flow(patterns, quotas, 2)


def test_many_sources_take_seconds():
    rnd = random.Random(4)
    names = [f"s{i}" for i in range(20_000)]
    patterns = {(s,): rnd.randint(1, 9_999) for s in names} | {tuple(sorted(rnd.sample(names, 2))): rnd.randint(1, 999) for _ in range(4_000)}
    sizes = {s: 0 for s in names}
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    began = time.monotonic()
    targets = mixing.fill_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(patterns.values()), 2)
    flow = mixing.split_flow(patterns, {s: round(t) for s, t in targets.items()}, 2)
    assert time.monotonic() - began < 30
    assert sum(targets.values()) == pytest.approx(1.5 * sum(patterns.values()))
    assert all(0 <= flow[p] <= 2 * n for p, n in patterns.items())


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + len((d["text"] or "").encode().split())
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # Pour the total in until nothing moves.
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: (total - sum(full.values())) * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s: 2.0 * sizes[s] for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    want = full | share
    taken = dict.fromkeys(order, 0)
    by_id = {d["doc_id"]: d for d in docs}
    got = mixing.query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(by_id)
    for r in got:
        d = by_id[r["doc_id"]]
        assert r["size"] == len((d["text"] or "").encode().split()) and r["source_size"] == sizes[d["source"]]
        assert r["target"] == pytest.approx(want[d["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[d["source"]] += r["taken"]
    for s in order:
        # Documents are taken whole, and the table is small.
        texts = sorted(r["size"] for r in got if by_id[r["doc_id"]]["source"] == s and r["size"])
        assert abs(taken[s] - want[s]) <= max(texts[len(texts) // 2], 0.01 * want[s])


def test_very_long_texts(spark):
    rows = [(1, "w " * 200_000, "a"), (2, "x", "a"), (3, "y z", "b")]
    got = {r["doc_id"]: (r["size"], r["copies"]) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {d: n for d, (n, _) in got.items()} == {1: 200_000, 2: 1, 3: 2} and got[3][1] == 2


def test_split_flow_is_the_whole_flow():
    rnd = random.Random(3)
    for _ in range(200):
        sources = "abcdefgh"[: rnd.randint(1, 8)]
        patterns = {tuple(sorted(rnd.sample(sources, rnd.randint(0, min(2, len(sources)))))): rnd.randint(0, 20) for _ in range(rnd.randint(0, 7))}
        quotas = {s: rnd.randint(0, 40) for s in sources if any(s in p for p in patterns)}
        assert mixing.split_flow(patterns, quotas, 2) == mixing.min_cost_flow(patterns, quotas, 2)


def test_more_sources_than_a_broadcast_takes(spark):
    n = mixing.MAX_PATTERNS + 200
    rows = [(i, "a b c d", f"site{i % n}") for i in range(2 * n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 2 * n
    want = {r["source"]: min(round(r["target"]), 2 * r["source_size"]) for r in got}
    taken = dict.fromkeys(want, 0)
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
    assert len(taken) == n
    assert max(abs(taken[s] - want[s]) for s in want) <= 2


def test_both_joins_agree(spark, monkeypatch):
    rows = [(i, " ".join("w" * (i % 7 + 1)), f"s{i % 9}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(tuple, mixing.mix(docs).select("doc_id", "copies").collect()))
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "copies").collect())) == few
