"""Operators for training data against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tests.conftest import SF, oracle_rows, rows_of
from veritrail.llm import fingerprints, mixing, near_duplicates, packing, quality, registry, repeats, substring_dedup, suffix_dedup, token_counts, topk, warc

DOCS = "doc_id long, text string, source string, n long, start long, cls long"
VOCAB = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, rows):
    """(doc_id, text[, source]) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", 7, 8, 9) for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, oracle, name):
    assert rows_of(registry.QUERIES[name](spark, SF)) == oracle_rows(oracle, registry.ORACLES[name])


def long_text(rnd, n, words="alpha beta gamma delta eps zeta eta theta iota kappa".split()):
    return " ".join(rnd.choice(words) for _ in range(n))


# 1. Packing


def check_packing(docs, pieces, size=packing.SEQUENCE):
    tokenizer = Tokenizer.from_file(VOCAB)
    want = Counter()
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), size):
            part = ids[a : a + size]
            want[(doc, a, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces) == want
    fill = defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill[r["sequence_id"]] == r["offset"]
        fill[r["sequence_id"]] += r["length"]
    assert not fill or max(fill.values()) <= size
    return sum(size - n for n in fill.values() if n & (n - 1)) / max(1, sum(fill.values()))


def test_packing(spark):
    rnd = random.Random(1)
    rows = [(i, long_text(rnd, rnd.choice([0, 3, 50, 400, 3000]))) for i in range(60)] + [(1, "repeated id"), (None, None), (70, ""), (71, "<|endoftext|>É it's 3.14... ½ \x1c a"), (72, "word " * 5000)]
    pieces = packing.pack(docs_of(spark, rows), VOCAB).collect()
    assert check_packing(rows, pieces) < 0.05
    assert packing.pack(docs_of(spark, []), VOCAB).count() == 0


def test_ids_are_the_tokenizers():
    """Cached words give the tokenizer's ids, also where letters change or gain marks by normalization."""
    rnd = random.Random(5)
    tokenizer, ids = Tokenizer.from_file(VOCAB), packing.WordIds(open(VOCAB, encoding="utf-8").read())
    pool = [*"abxyIJTK .,!?'\"-_<|>09%&\n\t", *"\u0130\u0131\u0307\u0301\u0308\u030c\u0338\u00e9\u00df\u1e9e\u03a3\u03c2\u01c5\ufb01\u65e5\u093f\uac00\u1100\u1161\u11a8\u00bd\u2167\u200d\u00a0\u2028\u0345\u0149\u212a\u2126\x1c\x85", "\U0001f600", "\U0001d538", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "\u0130."]
    letters = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(60_000):
        if i % 2:
            text = "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9)))
        else:
            text = "".join(rnd.choice(letters) if rnd.random() < 0.5 else rnd.choice("a.! x(") for _ in range(rnd.randint(1, 6)))
        assert np.frombuffer(packing.token_bytes(text, ids), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(docs, registry.QUERIES["op1_packing"](spark, SF).collect()) < 0.05


def test_least_squares():
    combos = packing.combinations(16)
    assert all(sum(c) == 16 for c in combos.tolist())
    histogram = np.zeros(17)
    histogram[[4, 6, 10, 12]] = [30, 10, 10, 10]
    x = packing.nonnegative_least_squares(combos, histogram)
    again = np.bincount(combos.reshape(-1), weights=np.repeat(x, 3), minlength=17)
    again[0] = 0
    # At the optimum no combination would lower the error, and those in use are at rest.
    slope = np.where(combos > 0, (again - histogram)[combos], 0).sum(axis=1)
    assert x.min() >= 0 and slope.min() > -0.01 and abs(x @ slope) < 0.1


# 2. Near duplicates


def brute_near(rows):
    sets = []
    for _, text in rows:
        w = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return sorted((str(d), len(sets[i]), str(min((x for x in least[root(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))


def near_rows(rnd, n):
    base = [long_text(rnd, rnd.randint(1, 120)) for _ in range(n // 6)]
    rows = []
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            words[rnd.randrange(len(words))] = rnd.choice(["NEW", "alpha", "x"])
        rows.append((i, " ".join(words[: rnd.choice([None, -1, -3])] or words)))
    return rows


def test_near_duplicates(spark):
    rnd = random.Random(4)
    rows = near_rows(rnd, 150) + [(500, None), (501, ""), (502, "One  two\tTHREE"), (503, "one two three"), (504, "É a b c d e"), (505, "é a b c d e"), (None, "one two three"), (500, "unique words here that nothing else has at all")]
    got = near_duplicates.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_near(rows)
    assert near_duplicates.near_duplicates(docs_of(spark, [])).count() == 0


def test_one_large_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    rnd = random.Random(9)
    base, rows = long_text(rnd, 200).split(), []
    for i in range(150):
        words = list(base)
        for _ in range(4):
            words[rnd.randrange(200)] = f"w{rnd.random()}"
        rows.append((i, " ".join(words)))
    tried = []
    plain = near_duplicates._links

    def counted(pairs, *rest):
        out = plain(pairs, *rest)
        tried.append(out[0].count())
        return out

    monkeypatch.setattr(near_duplicates, "_links", counted)
    got = near_duplicates.near_duplicates(docs_of(spark, [*rows, (150, " ".join(base))])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_near([*rows, (150, " ".join(base))])
    assert sum(tried) < 2500


def test_similarity_filters_lose_nothing():
    rnd = np.random.default_rng(2)
    for _ in range(500):
        x = np.unique(rnd.integers(0, 60, rnd.integers(1, 50)).astype(np.uint64))
        y = np.unique(np.concatenate([rnd.choice(x, min(x.size, 40)), rnd.integers(0, 60, rnd.integers(1, 8)).astype(np.uint64)]))
        same, both = np.intersect1d(x, y).size, np.union1d(x, y).size
        assert near_duplicates.suffix_distance(x, y, 3) <= both - same
        assert near_duplicates.similar(x, y) == (5 * same >= 4 * both)


# 3. Token counts


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts(spark, fallback):
    rnd = random.Random(6)
    letters = "abc日é"
    vocabulary = [("▁", -3.0), *{("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))), float(-rnd.randint(1, 4))): 0 for _ in range(9)}]
    vocabulary = list({p: (p, s) for p, s in vocabulary}.values())
    texts = ["".join(rnd.choice(letters) if rnd.random() < 0.8 else " " for _ in range(40)) for _ in range(60)]
    extra = [(f"<0x{b:02X}>", -50.0) for b in range(256)] if fallback else []
    whole = [("<unk>", -50.0), *vocabulary, *extra]
    oracle = Tokenizer(models.Unigram(whole, unk_id=0, byte_fallback=fallback))
    oracle.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, "ab"), (902, "a" * 3000)]
    # The unknown score follows the least score of the whole vocabulary.
    got = token_counts.count_tokens(docs_of(spark, rows), [*vocabulary, ("\x00\x00", -50.0)], fallback).collect()
    want = {str(i): len(oracle.encode(" ".join(t.split()), add_special_tokens=False).ids) if t and t.split() else 0 for i, t in rows}
    assert {str(r["doc_id"]): r["n_tokens"] for r in got} == want
    assert token_counts.count_tokens(docs_of(spark, []), vocabulary).count() == 0


# 4. Quality


def brute_weights(rows, kinds):
    """Log weights by the definition; ``rows``: texts, ``kinds``: 0 good, 1 toxic, 2 poor or None of each."""
    grams = [quality.features(t).tolist() for t in rows]
    counts = [Counter(g for gs, k in zip(grams, kinds, strict=True) if part is None or k == part for g in gs) for part in (None, 0, 1, 2)]
    sums = [sum(c.values()) for c in counts]
    shares = [kinds.count(k) / sum(k is not None for k in kinds) for k in (0, 1, 2)]
    out = []
    for gs in grams:
        raw = shares[0]
        for k in (1, 2):
            total = 0.0
            for g in gs:
                rate = [(counts[1 + j][g] + quality.PRIOR) / (counts[0][g] * sums[1 + j] / sums[0] + quality.PRIOR) for j in (0, k)]
                off = np.log(rate[1] / rate[0])
                spread = 1 / (counts[1][g] + quality.PRIOR) + 1 / (counts[1 + k][g] + quality.PRIOR)
                total += off**3 / (off**2 + quality.SHRINK * spread)
            raw += shares[k] * np.exp(total)
        out.append(-np.log(raw))
    return out


def quality_rows(rnd):
    good = [(i, long_text(rnd, 60)) for i in range(400)]
    toxic = [(1000 + i, long_text(rnd, 30) + " rotten awful " + long_text(rnd, 30)) for i in range(120)]
    poor = [(2000 + i, long_text(rnd, 10) + " AAA$$ %%% 99 x!" * 10) for i in range(120)]
    return good, toxic, poor


def test_quality(spark):
    rnd = random.Random(11)
    good, toxic, poor = quality_rows(rnd)
    told = [(i, 1, 0) for i, _ in good[:200]] + [(i, 1, 1) for i, _ in toxic[:60]] + [(i, 0, 0) for i, _ in poor[:60]]
    labels = spark.createDataFrame([*told, (None, 1, 0), (5, None, None), (1000, 1, 0)], "doc_id long, quality int, toxic int")
    rows = good + toxic + poor + [(None, None), (3000, ""), (3001, "é日 " * 30_000)]
    docs = docs_of(spark, rows)
    kinds = {i: (1 if x else 2 if not q else 0) for i, q, x in told}
    want = brute_weights([t for _, t in rows], [kinds.get(i) for i, _ in rows])
    keyed = quality.weigh(docs, quality.fit(docs, labels)).collect()
    assert {str(r["doc_id"]): r["log_weight"] for r in keyed} == pytest.approx({str(i): w for (i, _), w in zip(rows, want, strict=True)}, abs=2e-3)
    # Without replacement, in proportion to weight: the k largest keys, which no threshold on the weight gives.
    k = round(200 / 320 * len(rows))
    kept = quality.resample(docs, labels)
    ids = [r["doc_id"] for r in kept.select(docs.columns).collect()]
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in sorted(keyed, key=lambda r: -r["sample_key"])[:k])
    chosen, left = ([r["log_weight"] for r in keyed if (r["doc_id"] in ids) == side] for side in (True, False))
    assert min(chosen) < max(left)
    held = [{i for i, _ in x} for x in (good[200:], toxic[60:], poor[60:])]
    assert len(held[0] & set(ids)) >= 0.9 * 200 and all(len(x & set(ids)) <= 0.25 * len(x) for x in held[1:])
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in quality.resample(docs.repartition(3), labels).collect())
    assert quality.resample(docs, labels, k=10).count() == 10
    assert quality.resample(docs_of(spark, []), labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).count() == len(rows)


def test_buckets_are_worked_out_once(spark):
    """A model and weights from written buckets, without texts, are those from texts."""
    for found in ([], [0], [65_534, 65_535, 131_071, 2_000_000], [0, 65_535, 131_070], sorted(random.Random(2).sample(range(quality.BUCKETS), 500))):
        assert quality.buckets(quality.packed(np.array(found, np.int64))).tolist() == found
    rows = [(i, f"{'good plain' if i % 2 else 'bad loud'} words {i}") for i in range(40)] + [(None, None), (99, "")]
    docs, labels = docs_of(spark, rows), spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    once = quality.featured(docs.select("doc_id", "text"), "text")
    assert once.columns == ["doc_id", quality.FEATURES]
    one, other = quality.fit(once, labels), quality.fit(docs, labels)
    assert (one.ratios == other.ratios).all() and (one.shares == other.shares).all()
    weights = {str(r["doc_id"]): r["w"] for r in once.select("doc_id", quality.log_weight(F.col(quality.FEATURES), one).alias("w")).collect()}
    assert weights == {str(i): one.log_weight(quality.features(t)) if t else 0.0 for i, t in rows}


def test_ties_in_the_last_place(spark):
    docs = docs_of(spark, [(1, "same text")] * 7 + [(2, "other")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for k in range(9):
        assert quality.resample(docs, labels, k=k).count() == k


def test_gumbel_keys(spark):
    """Chances of being the largest key go with weights."""
    weights = spark.createDataFrame([(g, w) for g in range(4000) for w in (1.0, 2.0, 5.0)], "g long, w double")
    keyed = weights.withColumn("key", quality.gumbel_key(F.log("w"), 1, "g", "w"))
    won = dict(keyed.groupBy("g").agg(F.max_by("w", "key").alias("w")).groupBy("w").count().collect())
    assert all(abs(won[w] / 4000 - w / 8) < 0.03 for w in (1.0, 2.0, 5.0))


def test_kth_largest(spark):
    rnd = random.Random(2)
    keys = [rnd.choice([1.0, 2.0, rnd.random() * 1e6]) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 7, 250, 500):
        assert quality.kth_largest(df, k, buckets=8, small=3) == sorted(keys, reverse=True)[k - 1]


def test_quality_query(spark):
    """Held-out accuracy on the table's own labels, where there are enough of them."""
    ids = {r["doc_id"] for r in registry.QUERIES["op4_quality_classifier"](spark, SF.replace("0.001", "0.01")).collect()}
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in ids for i in good) >= 0.85 * len(good)


# 5. Mixing


def test_targets():
    assert mixing.fill_targets({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}, 315.0, 2) == pytest.approx({"a": 20.0, "b": 590 / 3, "c": 295 / 3})
    assert mixing.fill_targets({}, {}, 0.0, 2) == {}


def test_flow():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 18, "b": 12}, 2)
    assert sum(flow.values()) == 30 and all(flow[p] <= 2 * n for p, n in {("a",): 10, ("a", "b"): 10, ("b",): 5}.items())
    # All fresh words go before any is repeated.
    assert flow[("a",)] >= 10 and flow[("b",)] >= 5 and flow[("a", "b")] >= 10


def test_mixing(spark):
    rnd = random.Random(3)
    rows = [(i, long_text(rnd, rnd.randint(0, 80)), f"s{rnd.choice([0, 0, 0, 1, 2, 3])}") for i in range(400)] + [(500, None, "s1"), (501, "a b", None), (None, "x y z", "S9"), (3, "t t", "s1"), (3, "t t", "s1")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and set(docs.columns) <= set(got[0].asDict())
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])
    assert sorted((str(r["doc_id"]), r["copies"]) for r in got) == sorted((str(r["doc_id"]), r["copies"]) for r in mixing.mix(docs.repartition(3)).collect())
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, "x", ["a"] if i % 2 else ["a", "b"]) for i in range(40)], "doc_id long, text string, source string, tags array<string>")
    got = mixing.mix(df, sources=F.col("tags"), weights={"a": 1, "b": 3}, share=1.0).collect()
    assert 0 < sum(r["copies"] for r in got) <= 80


# 6. WARC


def test_warc(spark, tmp_path):
    magic = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "é" * 700
    rows = [(1, "http://a", "<p>x</p>"), (2, "u\r\nInjected: 1", magic * 3), (3, None, None), (4, "", ""), (5, "x", big), (9, "x", big), (7, "x", big), (8, "x", "y" * 999), (10, "x", "y" * 999), (None, "x", "tail\r\n\r\n"), (11, "x", "WARC/1.0\r\n"), (9, "x", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size long")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.candidates(spark, str(tmp_path / "w")).count() > len(rows)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = raw == big.encode() and page != 9
        want.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(9 if revisit else None)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_pointer_jumping(spark):
    links = [("f", i * 10, i * 10 + 10) for i in range(37)] + [("f", 5, 95), ("f", 95, 100), ("g", 3, 9)]
    got = {(r["file"], r["pos"]) for r in warc.reachable(spark.createDataFrame(links, "file string, pos long, next long")).collect()}
    assert {p for f, p in got if f == "f" and p % 10} == set() and len([p for f, p in got if f == "f" and p < 370]) == 37 and not [p for f, p in got if f == "g"]


# 7. Top-k


def brute_topk(vectors, every, k=5):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, q in {(i, tuple(v)) for i, v in good if i % every == 0}:
        score = lambda v: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=True))))  # noqa: B023, E731
        scored = sorted((-score(v), b) for b, v in good if b != a and len(v) == len(q))[:k]
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(scored)]
    return sorted(want)


def test_topk(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    vectors = [(i, [float(x) for x in rnd.integers(-3, 4, 7) / 4]) for i in range(200)] + [(300, None), (301, [1.0, None] + [0.0] * 5), (302, [float("nan")] * 7), (303, [float("inf")] * 7), (None, [1.0] * 7), (350, [1.0, 2.0])]
    # Repeated rows, and ids that share several vectors.
    vectors += [vectors[7], vectors[50], (50, [2.0] * 7), (8, [2.0] * 7), (8, [2.0] * 7)]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<double>, q int, key string")
    q = topk.quantize(df)
    assert sorted(map(tuple, topk.exact_topk(q, q.where("vec_id % 50 = 0"), 5).collect())) == brute_topk(vectors, 50)
    # Products beyond 64 bits.
    big = [(i, [float(x) * 1e9 for x in rnd.integers(-9, 9, 3)]) for i in range(30)] + [(31, [1.0, 2.0, 3.0])]
    q = topk.quantize(spark.createDataFrame(big, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, topk.exact_topk(q, q.where("vec_id % 10 = 0"), 5).collect())) == brute_topk(big, 10)
    empty = topk.quantize(df.limit(0))
    assert topk.exact_topk(empty, empty).count() == 0


def test_topk_sends_no_blocks_through_the_driver(spark, monkeypatch):
    """Blocks are repeated for each block of the other side, which Spark's guess of their size leaves out."""
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rnd = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rnd.integers(-3, 4, 40) / 4]) for i in range(200)]
    q = topk.quantize(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    for few in (0, 1, topk.FEW):
        monkeypatch.setattr(topk, "FEW", few, raising=False)
        found = topk.exact_topk(q, q.where("vec_id % 20 = 0"), 5)
        assert sorted(map(tuple, found.collect())) == brute_topk(vectors, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_topk_sql_with_repeated_rows(spark):
    import duckdb

    rnd = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rnd.integers(-3, 4, 4) / 4]) for i in range(60)]
    vectors += [vectors[50], (50, [1.0] * 4), vectors[3], vectors[3]]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    q = topk.quantize(df)
    assert sorted(map(tuple, topk.exact_topk(q, q.where("vec_id % 50 = 0")).collect())) == sorted(con.sql(topk.SQL).fetchall()) == brute_topk(vectors, 50)


# 8 and 9. Repeats


def brute_repeats(docs, window, within):
    """Covered places by (id, text): rows that share an id but not the text are documents of their own."""
    first, gone = {}, defaultdict(set)
    for d, q in sorted(docs):
        own = set()
        for i in range(len(q) - window + 1):
            piece = q[i : i + window]
            if first.setdefault(piece, d) < d or (within and piece in own):
                gone[d, q].update(range(i, i + window))
            own.add(piece)
    return gone


@pytest.mark.parametrize("hot", [4_000, 3])
@pytest.mark.parametrize("op", ["bytes", "words"])
def test_repeats(spark, monkeypatch, hot, op):
    monkeypatch.setattr(repeats, "HOT_GROUP", hot)
    monkeypatch.setattr(repeats, "SORT_BATCH", 50)
    monkeypatch.setattr(repeats, "FOLD", 300 if hot > 3 else 10_000_000)
    kind = repeats.Kind(12, 4, True, 1, suffix_dedup._encode, suffix_dedup._lift, suffix_dedup.deep_shallow_order) if op == "bytes" else repeats.Kind(6, 2, False, 8, substring_dedup._encode, substring_dedup.mix64, substring_dedup.tree_order)
    for seed in range(2):
        rnd = random.Random(seed)
        base = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 60))) for _ in range(25)]
        rows = [(i, rnd.choice(base)[rnd.randint(0, 20) :] + rnd.choice(base) + rnd.choice(["", "é", "x" * 30])) for i in range(60)] + [(99, None), (100, ""), (None, "a" * 50), (101, "a b " * 200), (102, "a b " * 200), (5, None)]
        # Repeated rows, and rows that share an id but not the text.
        rows = [r for r in rows if r != (5, None)]
        rows += [rows[7], (9, rows[12][1] + "b"), (9, "short"), (101, "b a " * 90)]
        docs = docs_of(spark, rows)
        got = repeats.with_runs(docs, kind)
        assert set(docs.columns) < set(got.columns)
        want = brute_repeats({(d, t.encode() if op == "bytes" else tuple(t.split())) for d, t in rows if t and d is not None}, kind.window, kind.within)
        found = got.collect()
        assert len(found) == len(rows)
        for r in found:
            have = {x for a, b in repeats.covered_spans(r["repeated_runs"], kind.window) for x in range(a, b)}
            key = (r["doc_id"], r["text"].encode() if op == "bytes" else tuple(r["text"].split())) if r["text"] else None
            assert have == (want.get(key, set()) if r["doc_id"] is not None else set()), r
    assert repeats.with_runs(docs_of(spark, []), kind).count() == 0


def test_blocks_of_windows(spark):
    """What is left of a prefix that was dealt out is a few rows for a stretch, not one for each window."""
    kind = suffix_dedup.KIND
    width = -(-(kind.window - kind.gram + 1) // repeats.BLOCKS)
    cores = {}
    for first, n in [(400, 69), (400, 1), (468, 1), (420, 20), (431, 38)]:
        seen = []
        for w, many, place, a, b in repeats.blocks(kind, first, n, 468, width):
            seen.extend(range(w, w + many))
            assert a >= w + many - 1 and b <= w + kind.window and all(468 - x in range(place, place + width) for x in range(w, w + many))
            assert cores.setdefault(place, (a, b)) == (a, b)
        assert sorted(seen) == list(range(first, first + n))
    rnd = random.Random(0)
    gram = rnd.randbytes(32)
    rows = [(1, 0, d, d, 0, 69, 68, rnd.randbytes(68) + gram + rnd.randbytes(68)) for d in range(300)]
    batch = repeats._batch(repeats._CUT, zip(*rows, strict=True))
    out = [r for b in repeats._solver(kind, width)(iter([batch])) for r in b.to_pylist()]
    assert len(out) == repeats.BLOCKS * len(rows)
    assert sum(r["n"] for r in out) == 69 * len(rows)


def test_suffix_query(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    gone = brute_repeats(docs, 100, True)
    want = {}
    for d, q in docs:
        out = gone[d, q]
        kept = bytes(b for i, b in enumerate(q) if i not in out)
        want[d] = (len(q), len(out), sum(i - 1 not in out for i in out), hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES["op9_suffix_array_dedup"](spark, SF).collect()} == want


def test_dedup_texts(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "start " + passage), (2, passage + " end"), (3, None), (4, "ééé")]
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(docs_of(spark, rows)).collect()}
    assert cut == {1: "start " + passage, 2: "end", 3: None, 4: "ééé"}
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.dedup(docs_of(spark, rows)).collect()}
    assert cut == {1: "start " + passage, 2: " end", 3: None, 4: "ééé"}


def test_orders():
    rnd = random.Random(1)
    for _ in range(60):
        strings = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 70))) for _ in range(rnd.randint(1, 30))]
        strings += [s[: rnd.randint(0, len(s))] + bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for s in strings]
        order, common = suffix_dedup.deep_shallow_order(strings)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        assert [suffix_dedup._common(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True)] == list(common)
        wide = [np.frombuffer(s, np.uint8).astype(np.uint64).tobytes() for s in strings]
        order, common = substring_dedup.tree_order(wide)
        assert [strings[i] for i in order] == sorted(strings)
        assert [suffix_dedup._common(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True)] == list(common)


# 10. Fingerprints


def test_fingerprints(spark):
    rnd = random.Random(7)
    rows = [(i * 3, "".join(rnd.choice("abcdé😀 ") for _ in range(rnd.choice([0, 5, 30, 90, 700])))) for i in range(40)] + [(None, "null id " * 30), (200, None), (201, "same text " * 20), (202, "same text " * 20), (-5, "x" * 400)]
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)

    def brute(text):
        """Fingerprint text by the definition: of each window of hashes the rightmost least one."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        lifted = fingerprints.mix64((points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        hashes = fingerprints.gram_hashes(lifted, min(fingerprints.GRAM, lifted.size)).tolist() if text else []
        width = min(fingerprints.WINDOW, len(hashes))
        places = sorted({max(range(a, a + width), key=lambda i: (-hashes[i], i)) for a in range(len(hashes) - width + 1)}) if hashes else []
        return "".join(f"{hashes[p] >> 32:08x}{p - q:02x}" for q, p in zip([0, *places], places, strict=False))

    order = sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, r = text or "", after or "", got[doc]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.fingerprint_text(*fingerprints.winnow(text)) == brute(text) and r["edited_fingerprint"] == brute(edited)
        # The likeness can be had from the fingerprints.
        sets = [{f[i : i + 8] for i in range(0, len(f), 10)} for f in (r["fingerprint"], r["edited_fingerprint"], brute(after))]
        for name, other in (("near_edited", sets[1]), ("near_next", sets[2])):
            assert r[name] == (len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0)
    assert got[201]["fingerprint"] == got[202]["fingerprint"] and got[202]["near_next"] == 1.0
    assert fingerprints.compare_with_next(docs_of(spark, [])).count() == 0
    assert fingerprints.compare_with_next(docs_of(spark, [(1, "alone " * 40)])).first()["near_next"] == 1.0
    assert fingerprints.fingerprints(docs_of(spark, rows)).where(F.size("fingerprint") > 0).count() > 20


def test_a_third_of_the_rows_share_an_id(spark):
    rnd = random.Random(9)
    rows = [(i, long_text(rnd, 5)) for i in range(60)] + [(None, long_text(rnd, 5)) for _ in range(50)] + [(30, long_text(rnd, 5)) for _ in range(40)]
    docs = docs_of(spark, rows)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()
    order = sorted(keyed, key=lambda r: (-(2**63) if r["doc_id"] is None else r["doc_id"], r["h"], r["text"]), reverse=True)
    want = Counter()
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        cut = len(r["text"]) // 3
        edited = r["text"][: len(r["text"]) - cut] + after["text"][:cut]
        want[r["doc_id"], hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.compare_with_next(docs).collect()) == want
    ranges = fingerprints.Ranges([0.0, 0.0, 0.0, 5.0], {0.0})
    import pandas as pd

    found = ranges.of(pd.Series([-1, 0, 0, 0, 1, 5, 6]), pd.Series([0, -(2**63), 0, 2**63 - 1, 7, 0, 0])).tolist()
    assert found == sorted(found) and len(set(found[1:4])) == 3


def test_winnowing_guarantee():
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    hashes, positions = fingerprints.winnow(text)
    assert np.all(np.diff(positions) > 0) and np.all(np.diff(positions) <= fingerprints.WINDOW) and positions[0] < fingerprints.WINDOW
    span = fingerprints.GRAM + fingerprints.WINDOW - 1
    for _ in range(50):
        at = rnd.randrange(len(text) - span)
        other, _ = fingerprints.winnow("Z" * rnd.randrange(50) + text[at : at + span] + "Y" * 40)
        assert set(other.tolist()) & set(hashes.tolist())
    # Rightmost on ties.
    _, places = fingerprints.winnow("a" * 200)
    assert places[0] == fingerprints.WINDOW - 1
