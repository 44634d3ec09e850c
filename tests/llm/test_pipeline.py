"""The pipeline's stages on the smallest table."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_operators import brute_near, brute_repeats, check_packing, long_text, near_rows
from veritrail import storage
from veritrail.llm import quality


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns and 0 < after.count()
        if name == "ngram_jaccard_join":
            assert after.count() < before.count()
        if name == "suffix_array_dedup":
            assert after.where("n_chars <> length(text)").count() == 0
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert check_packing([tuple(r) for r in before.select("doc_id", "text").collect()], pieces) < 0.05


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_duplicates_by_row(spark):
    """Rows that share an id, repeated rows, null ids and texts without words."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (None, a + " x"), (None, "only here"), (None, "only here"), (4, ""), (4, ""), (None, None), (5, b + " y")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    want = [(1, a), (2, b), (None, "only here"), (4, ""), (4, ""), (None, None)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(str, want))


def test_run_is_its_stages(spark, tmp_path):
    """``run`` gives what the stages give one after the other, from documents to pieces."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, docs.select(keys).collect()))


def test_stages_against_brute_force(spark):
    """What each stage keeps of all that the one before kept, worked out plainly."""
    import random

    rnd = random.Random(41)
    passage = long_text(rnd, 80)
    rows = [(i, t + (" " + passage if i % 9 == 0 else "")) for i, t in near_rows(rnd, 60)] + [(100 + i, f"{long_text(rnd, 60)} {passage} {long_text(rnd, 7)}") for i in range(8)]
    docs = spark.createDataFrame([(i, t, "en", "abc"[i % 3], len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows[:40]], "doc_id long, quality int, toxic int")

    class Tables:
        """The session, with these labels for those of the folder."""

        read = type("Read", (), {"parquet": staticmethod(lambda path: labels)})

    # Quality: the documents with the largest keys, as many as the labels' share of good ones.
    keyed = quality.weigh(docs, quality.fit(docs, labels)).collect()
    good = sum(i % 4 > 0 for i, _ in rows[:40]) / 40
    best = sorted(keyed, key=lambda r: -r["sample_key"])[: round(good * len(rows))]
    kept = corpus_pipeline.keep_quality(Tables, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in best)

    # Near duplicates: the least id of each group.
    rows = sorted((r["doc_id"], r["text"]) for r in best)
    firsts = {i for i, _, least in brute_near(rows) if i == least}
    docs = kept.where(kept["doc_id"].isin([r["doc_id"] for r in best]))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert {str(r["doc_id"]) for r in kept.collect()} == firsts and len(firsts) < len(rows)

    # Repeats: bytes of earlier documents or places go, and documents of which nothing is left.
    rows = [(i, t.encode()) for i, t in rows if str(i) in firsts]
    gone = brute_repeats(set(rows), 100, True)
    want = {i: bytes(b for at, b in enumerate(t) if at not in gone[i, t]).decode() for i, t in rows}
    want = {i: t for i, t in want.items() if t}
    cut = corpus_pipeline.cut_repeats(spark, kept, "")
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want and any(gone.values())

    # Mixing: whole documents, at most twice, near each source's part of 150 % of all words; the same again when run again.
    mixed = corpus_pipeline.mix_sources(spark, cut, "")
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 2 and times == Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, cut, "").collect())
    size = {i: len(t.split()) for i, t in want.items()}
    per = defaultdict(int)
    for i in size:
        per["abc"[i % 3]] += size[i]
    full, weight, total = {}, {"a": 5, "b": 2, "c": 1}, 1.5 * sum(size.values())
    while True:
        share = {s: (total - sum(full.values())) * weight[s] / sum(weight[t] for t in per if t not in full) for s in per if s not in full}
        over = {s: 2.0 * per[s] for s in share if share[s] > 2 * per[s]}
        if not over:
            break
        full |= over
    for s, target in (full | share).items():
        assert abs(sum(size[i] * n for i, n in times.items() if "abc"[i % 3] == s) - target) <= max(size.values())

    # Packing: every id of every copy in one piece.
    pieces = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    check_packing([(r["doc_id"], r["text"]) for r in mixed.collect()], pieces)


def test_stages_leave_their_result_only(spark, tmp_path, monkeypatch):
    """A caller that takes the stages one by one, and never ``run``, isn't left with all tables that they wrote."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    docs, left = spark.read.parquet(f"{SF}/documents.parquet"), lambda: len(list((tmp_path / "shared").iterdir()))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert left() == k, name
    found = corpus_pipeline.run(spark, SF)
    assert found.count() and left() == k + 1
