"""Collocations, nearest neighbours and vector codes against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SF
from veritrail.llm import lloyd, neighbours, phrases, registry

# 11. Phrase collocations

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_collocations(docs, least, top=2000):
    """docs: (text, lang); by the definition, on strings."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang or "und"] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang or "und"][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and b >= least and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items() if len(q) > 1)
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(rnd, n):
    words = ["Ab", "ab", "cd", "éf", "x\x1cy", "日本", "it's", "z"]
    phrase = ["one two three four", "Two\t three", "cd  ab", "éf z z z"]
    make = lambda: "".join(rnd.choice([*words, *phrase]) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for _ in range(rnd.choice([0, 1, 5, 40])))
    return [(make(), rnd.choice(["en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("shard", [7, 50_000])
def test_collocations(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    rnd = random.Random(31)
    docs = texts(rnd, 150)
    docs += docs[:3] + [(None, "en"), (None, None), ("", "de"), (" \t\n", "en"), ("a b " * 40_000 + "w" * 300_000 + " a b", "und"), ("same same same same same", "xx")]
    df = spark.createDataFrame([(i, t, lang, 1, 2, "s") for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, n long, h0 long, shard string").repartition(3)
    got = sorted(tuple(r) for r in phrases.top_collocations(df, min_count=4).collect())
    assert got == brute_collocations(docs, 4) and len(got) > 20
    assert [r[:3] for r in sorted(tuple(r) for r in phrases.top_collocations(df, top=2, min_count=4).collect())] == [r[:3] for r in got if r[1] <= 2]


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.top_collocations(empty).count() == 0
    assert phrases.top_collocations(spark.createDataFrame([(1, "a b", "en")], empty.schema)).count() == 0


def test_word_numbers():
    """A word has one number wherever it stands, also across stretches; langs and words are told apart."""
    rnd = random.Random(32)
    vocabulary = [bytes(rnd.choices(b"abcdefgh\xc3\xa9", k=rnd.randint(1, 12))) for _ in range(3000)] + [b"q" * 400_000]
    text = rnd.choices(vocabulary, k=120_000) + [b"q" * 400_000]
    w = phrases.Words.of("en", [b" ".join(text)], 0)
    numbers = dict(zip(text, w.numbers.tolist(), strict=True))
    assert [numbers[t] for t in text] == w.numbers.tolist() and len(set(numbers.values())) == len(numbers)
    assert not set(phrases.Words.of("de", [b" ".join(vocabulary)], 0).numbers.tolist()) & set(numbers.values())


def test_perfect_hash():
    rnd = np.random.default_rng(33)
    for size in (0, 1, 2, 1000, 30_000):
        n = rnd.integers(1, 5, size)
        keys = [np.where(i < n, rnd.integers(0, 40 if size < 1000 else 2**63, size), 0).astype(np.uint64) for i in range(4)]
        rows, first = np.unique(np.stack([*keys, n.astype(np.uint64)], axis=1), axis=0, return_index=True)
        keys, n = [k[first] for k in keys], n[first]
        for table in (made := phrases.PerfectHash(keys, n), phrases.PerfectHash.unpacked(made.packed())):
            assert sorted(table.slots(keys, n).tolist()) == list(range(len(rows))) and len(table) == len(rows)
            other = [k ^ np.uint64(1 << 40) for k in keys]
            assert (table.slots(other, n) == -1).all()


# 12. Approximate nearest neighbours


def brute_nearest(rows, k=5, every=50):
    """rows: (vec_id, vector or None); (query_id, vector) to ranked (vec_id, score)."""
    whole = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in whole:
        if q % every == 0:
            norm = lambda v: math.sqrt(sum(a * a for a in v))
            scored = [(-sum(a * b for a, b in zip(x, y, strict=True)) / (norm(x) * norm(y)), i) for i, y in whole if i != q and len(y) == len(x)]
            out[q, x] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_neighbours(spark):
    """With fewer codes than a radius holds, all are found: equal to brute force."""
    rnd = random.Random(34)
    vector = lambda d=8: [float(np.float32(rnd.gauss(0, 1))) for _ in range(d)]
    same, scaled = vector(), vector()
    rows = [(i, vector()) for i in range(300)] + [(i, same) for i in range(400, 520)] + [(600 + i, [x * 2.0**i for x in scaled]) for i in range(6)] + [(700 + i, vector(3)) for i in range(4)]
    rows += [(50, vector()), rows[3], rows[100], (None, vector()), (800, None), (850, [0.0] * 8), (900, [math.nan] + [0.0] * 7), (950, [math.inf] + [1.0] * 7), (1000, [None] + [1.0] * 7), (1050, []), (1100, vector(5))]
    df = spark.createDataFrame([(i, v, 1, 2.0, [3]) for i, v in rows], "vec_id long, embedding array<float>, cls int, norm double, ids array<int>").repartition(3)
    vectors = neighbours.vectors_of(df)
    got = defaultdict(list)
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = defaultdict(list)
    for (q, _), found in brute_nearest(rows).items():
        want[q] += [(rank, i, pytest.approx(s, abs=1e-12)) for rank, (i, s) in enumerate(found, 1)]
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v, key=lambda x: x[:2]) for q, v in want.items() if v}
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_index_finds_all_within():
    rnd = np.random.default_rng(35)
    codes = rnd.integers(0, 2**64, (500, neighbours.WORDS), dtype=np.uint64)
    codes[100:200] = codes[0] ^ (rnd.random((100, neighbours.WORDS * 64)) < 0.05).astype(np.uint8).reshape(100, -1, 8).dot(1 << np.arange(8)).astype(np.uint8).view(np.uint64).reshape(100, -1)
    index = neighbours.Index(codes)
    for code in (codes[0], codes[150], codes[499]):
        for radius in (0, 1, 7, 15, 16, 17, 40, 110, 128, 256):
            assert index.within(code, radius).tolist() == np.flatnonzero(neighbours.distances(codes, code) <= radius).tolist()


def test_recall(spark):
    """At least 0.9 with radii that hold a part of the codes."""
    sf = SF.replace("0.001", "0.1")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = neighbours.vectors_of(spark.read.parquet(f"{sf}/embeddings.parquet"))
    got = defaultdict(set)
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), probed=100).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = n = 0
    for i, (q, _) in enumerate(rows):
        if q % 50 == 0:
            s = x @ x[i]
            s[i] = -2
            best = {rows[j][0] for j in np.argsort(-s)[:5]}
            hit, n = hit + len(best & got[q]), n + 5
    assert hit / n >= 0.9 and n >= 200


# 13. Vector codes


def brute_lloyd(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, integers) in order of vec_id, of one length; (codes, errors, codebooks)."""
    dim = len(rows[0][1])
    cuts = [dim * p // parts for p in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    split = [cut(v) for _, v in rows]
    books = [[list(s[p]) for s in split[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e, p=p, s=s: (far(s[p], books[p][e]), e)) for p in range(parts)] for s in split]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [s[p] for s, c in zip(split, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    return codes, [sum(far(s[p], books[p][c[p]]) for p in range(parts)) for s, c in zip(split, codes, strict=True)], books


@pytest.mark.parametrize("dim", [32, 21, 5])
def test_lloyd(spark, dim):
    rnd = random.Random(dim)
    rows = [(i * 3 - 40, [float(np.float32(rnd.gauss(0, 1))) for _ in range(dim)], rnd.choice([1, 2, None])) for i in range(150)]
    rows += [(5000 + i, rows[7][1], 1) for i in range(40)] + [(7, rows[3][1], 2), (7, rows[3][1], 2), (None, rows[5][1], 9)]
    odd = [(9000, None, 1), (9001, [math.nan] * dim, 1), (9002, [None] * dim, 1), (9003, [math.inf] * dim, 1)]
    short = [(9100, [0.5] * (dim + 1), 4)]
    df = spark.createDataFrame([(i, v, label, 1, 2, b"x") for i, v, label in [*rows, *odd, *short]], "vec_id long, embedding array<float>, label int, part int, entry int, code binary").repartition(4)
    codes, books = lloyd.train(lloyd.quantized(df))
    whole = sorted(([i, [math.floor(256 * x) for x in v], label] for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want, errors, final = brute_lloyd([r[:2] for r in whole])
    got = Counter((r["vec_id"], r["label"], bytes(r["code"]) if r["code"] is not None else None, r["error"]) for r in codes.collect())
    assert got == Counter([(r[0], r[2], bytes(c), e) for r, c, e in zip(whole, want, errors, strict=True)] + [(9100, 4, None, None)])
    assert [e.tolist() for e in books.entries] == final
    assert books.digest() == hashlib.sha256(",".join(str(x) for p in final for e in p for x in e).encode()).hexdigest()
    made = {r["vec_id"]: r["q"] for r in lloyd.decode(codes.where("vec_id > 4000"), books).collect()}
    assert made[9100] is None and all(len(v) == dim for i, v in made.items() if i < 9000)


def test_lloyd_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    codes, books = lloyd.train(lloyd.quantized(spark.createDataFrame([], schema)))
    assert codes.count() == 0 and books is None
    one, books = lloyd.train(lloyd.quantized(spark.createDataFrame([(1, [1e30, -1e30], None)], schema)))
    assert one.first()["error"] == 0 and books.entries[15].tolist() == [[-lloyd.MOST]]


def test_label_errors(spark):
    rows = registry.QUERIES["op13_lloyd_codes"](spark, SF).collect()
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label").collect()}
    sums = Counter()
    for r in rows:
        sums[labels[r["vec_id"]]] += r["error"]
    assert all(r["label_error"] == sums[labels[r["vec_id"]]] for r in rows) and len(rows) == len(labels)
