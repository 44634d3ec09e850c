"""Layering and peel chains, whose order matters, against brute force."""

import random

import pytest
from veritrail.operators import chain, successors, traversal

HOUR = 3_600_000_000


def brute_layers(rows, min_len, tol=0.25, gap=168 * HOUR):
    """Chains by the definition; rows: (id, src, dst, amount, ts)."""

    def onward(row):
        fits = [(abs(r[3] - row[3]) / row[3], r[0], r) for r in rows if r[1] == row[2] and 0 <= r[4] - row[4] <= gap and abs(r[3] - row[3]) <= tol * row[3]] if row[2] is not None and row[3] > 0 else []
        return min(fits)[2] if fits else None

    used, out = set(), set()
    for start in sorted(rows, key=lambda r: (r[4], r[0])):
        if start[0] in used or start[1] is None:
            continue
        walk, met = [start], {start[1], start[2]}
        while (after := onward(walk[-1])) is not None and after[2] not in met and len(walk) <= 100:
            walk.append(after)
            met.add(after[2])
        if len(walk) >= min_len:
            used |= {r[0] for r in walk}
            out.add(tuple(r[0] for r in walk))
    return out


@pytest.mark.parametrize("one_task", [0, 10**9])
def test_layering(spark, one_task):
    rnd = random.Random(12)
    for _ in range(3 if one_task else 2):
        rows = [(f"e{i:03d}", f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}", float(rnd.choice([100, 110, 95, 300])), rnd.randrange(400) * HOUR) for i in range(120)]
        rows = [r for r in rows if r[1] != r[2]]
        got = traversal.layering(spark.createDataFrame(rows, "id string, src string, dst string, amount double, ts_micros long"), min_len=3, one_task=one_task).collect()
        assert {tuple(r["edges"]) for r in got} == brute_layers(rows, 3) and len(got) == len({tuple(r["edges"]) for r in got})


def brute_peels(txs, ratio=3.0):
    """Chains by the definition; txs: (txid, inputs, outputs, ordinal), sides as (address, value)."""
    step = {}
    for txid, _, outs, _ in txs:
        if len(outs) == 2:
            big, small = outs if outs[0][1] >= outs[1][1] else outs[::-1]
            if small[1] > 0 and big[1] >= ratio * small[1]:
                step[txid] = big[0]
    spender = {}
    for txid, ins, _, _ in sorted(txs, key=lambda t: t[3]):
        for address, _ in ins:
            spender.setdefault(address, txid)
    used, out = set(), set()
    for txid, *_ in sorted(txs, key=lambda t: t[3]):
        walk, at = [], txid
        while at in step and txid not in used and len(walk) < 100:
            walk.append(at)
            at = spender.get(step[at])
        if len(walk) >= 2:
            used |= set(walk)
            out.add(tuple(walk))
    return out


@pytest.mark.parametrize("one_task", [0, 10**9])
def test_peel_chains(spark, one_task):
    rnd = random.Random(13)
    for _ in range(3 if one_task else 2):
        txs = []
        for i in range(90):
            outs = [(f"a{rnd.randrange(60)}", float(rnd.choice([90, 80, 5]))), (f"a{rnd.randrange(60)}", float(rnd.choice([10, 4, 50])))][: rnd.choice([2, 2, 2, 1])]
            txs.append((f"t{i:02d}", [(f"a{rnd.randrange(60)}", 100.0)], outs, i))
        side = lambda x: [{"address": a, "value": v} for a, v in x]
        df = spark.createDataFrame([(t, "2026-01-01T00:00:00", side(i), side(o), n) for t, i, o, n in txs], chain.TRANSACTION)
        got = chain.peel_chains(df, one_task=one_task).collect()
        assert {tuple(r["txids"]) for r in got} == brute_peels(txs) and got


def test_starts_of_forests(spark):
    """200 random forests, some with rings, at once: forks, long stretches in and against order, and rows that start nothing."""
    rnd, rows, want = random.Random(14), [], set()
    for f in range(200):
        n, ring = rnd.choice([1, 3, 8, 30]), f % 10 == 0
        order = rnd.sample(range(n), n) if f % 3 else list(range(n))
        after = [None if i == n - 1 else rnd.choice([i + 1, i + 1, min(n - 1, i + rnd.randrange(1, 5))]) for i in range(n)]
        if ring:
            after[-1] = rnd.randrange(n)
        reach = []
        for i in range(n):
            steps, at, most = 0, i, rnd.choice([2, 5, 40])
            while after[at] is not None and steps < most:
                steps, at = steps + 1, after[at]
            reach.append(steps)
        able = [rnd.random() < 0.9 and r >= 1 for r in reach]
        passed = set()
        for i in sorted(range(n), key=lambda i: order[i]):
            if able[i] and i not in passed:
                want.add(f"{f}-{i}")
                at = i
                for _ in range(reach[i] + 1):
                    passed.add(at)
                    at = after[at]
        rows += [(f"{f}-{i}", order[i] * 200 + f, None if after[i] is None else f"{f}-{after[i]}", reach[i], able[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, rank long, next_id string, reach long, able boolean")
    assert {r["id"] for r in successors.chain_starts(df).collect()} == want


def test_long_stretch(spark):
    """One chain of 3,000 steps in order: a start each 100 steps, found in one round."""
    n = 3000
    df = spark.range(n).selectExpr("cast(id as string) id", "id rank", f"if(id < {n - 1}, cast(id + 1 as string), null) next_id", f"least(99, {n - 1} - id) reach", "true able")
    assert sorted(int(r["id"]) for r in successors.chain_starts(df).collect()) == list(range(0, n, 100))
