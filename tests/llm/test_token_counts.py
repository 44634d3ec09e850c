"""Operator 3 over raw texts: white space counts as the model counts it."""

import random

import pytest
from tokenizers import Tokenizer, models, normalizers

from tests.conftest import SF
from veritrail.llm import token_counts


def raw_oracle(vocabulary, fallback):
    extra = [(f"<0x{b:02X}>", -1e6) for b in range(256)] if fallback else []
    low = min(score for _, score in vocabulary)
    oracle = Tokenizer(models.Unigram([("<unk>", low), *vocabulary, *[(p, low) for p, _ in extra]], unk_id=0, byte_fallback=fallback))
    oracle.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: len(oracle.encode(text, add_special_tokens=False).ids) if text else 0


CROSSING = [[], [("b▁a", -1.0)], [("a\nb", -1.0), ("\n", -2.0)], [("\n", -2.0)]]


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("crossing", CROSSING)
def test_white_space_counts(spark, fallback, crossing):
    rnd = random.Random(7)
    vocabulary = [("▁", -3.0), ("▁▁", -4.0), ("▁▁▁▁", -4.0), ("▁a", -2.0), ("▁ab", -3.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("ba", -4.0), ("b\r", -3.0), *crossing]
    texts = ["".join(rnd.choice("aabb    \n\n\t\ré▁日") for _ in range(rnd.randint(1, 50))) for _ in range(150)]
    texts += ["one two\nthree four", "\n", " ", "   ", "\n\n a", "a  b", " a", "a \n b", "a\r\nb", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    oracle = raw_oracle(vocabulary, fallback)
    for kept in (vocabulary, [p for p in vocabulary if p[0] != "▁"]):
        oracle = raw_oracle(kept, fallback)
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(rows, kept, fallback, keep_spaces=True).collect()}
        assert got == {i: oracle(t) for i, t in enumerate(texts)}


def test_query_counts_raw_documents(spark):
    import public_tokenizers

    vocabulary, fallback = token_counts.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    oracle = raw_oracle(vocabulary, fallback)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.query(spark, SF).collect())
    assert any("\n" in (d["text"] or "") for d in docs)
    assert got == sorted((d["doc_id"], oracle(d["text"])) for d in docs)


def test_scores_of_the_query(spark):
    """Counts and scores of whole documents by a plain Viterbi search over the whole text."""
    import public_tokenizers

    vocabulary, _ = token_counts.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    scores = dict(vocabulary)
    longest, unknown = max(map(len, scores)), min(scores.values()) - token_counts.UNKNOWN_PENALTY
    docs = [d for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if d["text"] and len(d["text"]) < 4000][:25]
    got = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in token_counts.query(spark, SF).collect()}
    for d in docs:
        text = ("▁" + d["text"]).replace(" ", "▁")
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            ways = [(best[a][0] + scores[text[a:end]], a - end, best[a][1] + 1) for a in range(max(0, end - longest), end) if text[a:end] in scores]
            if text[end - 1] not in scores:
                ways.append((best[-1][0] + unknown, 0, best[-1][1] + len(text[end - 1].encode())))
            score, _, pieces = min(ways, key=lambda w: (-w[0], w[1]))
            best.append((score, pieces))
        assert got[d["doc_id"]] == (best[-1][1], pytest.approx(best[-1][0]))


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b", 5, 6.0), (1, "a b", 5, 6.0), (None, "a", 1, 1.0), (2, None, 0, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, score double")
    got = token_counts.count_tokens(docs, [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("▁a", -2.5)]).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got) == [("1", 3, -5.5), ("1", 3, -5.5), ("2", 0, 0.0), ("None", 1, -2.5)]
    assert token_counts.log_probabilities([("x", -0.5), ("y", -2.0)]) == [("x", -0.5), ("y", -2.0)]
