"""Operator 3: token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each place of a word; dynamic programming carries
the best score and the number of pieces, and never builds the pieces. Ties are broken as the tokenizers' own
search does: among equal scores the piece that starts earliest stays. A character that no piece of length one
matches may be an unknown, at the lowest score less ``UNKNOWN_PENALTY``; it counts as its bytes where the
vocabulary falls back to bytes, otherwise as one piece for each run of unknowns.

A text starts with the vocabulary's space sign, and its spaces are such signs. Where the model keeps white space
(``keep_spaces``), every space, line break and tab counts; otherwise words are split at ASCII white space and each
starts with one sign. Kept texts are cut before spaces and around line breaks, where no piece crosses; a vocabulary
with pieces that would cross has the text searched in longer stretches or as a whole, with the same result. Tasks
keep the results of stretches they have met, up to a bound. A null or empty text has no pieces and score 0.
Repeated rows, null ids and empty tables need no care: each row gives one row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import WordTable, bound_text_batches, worker_cache

SPACE, UNKNOWN_PENALTY = "▁", 10.0
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


class Viterbi:
    """Best score and number of pieces of a string."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool) -> None:
        self.byte_fallback = byte_fallback
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def count(self, text: str) -> tuple[int, float]:
        n = len(text)
        ending: list[list] = [[] for _ in range(n)]
        for end, match in self.matches.iter(text) if len(self.matches) else ():
            ending[end].append(match)
        score, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            best, single = None, False
            # The automaton gives the longest first: the piece that starts earliest keeps its place on ties.
            for length, value in ending[end]:
                start = end + 1 - length
                single |= length == 1
                if best is None or score[start] + value > best:
                    best, pieces[end + 1], unknown[end + 1] = score[start] + value, pieces[start] + 1, False
            if not single and (best is None or score[end] + self.unknown > best):
                best, unknown[end + 1] = score[end] + self.unknown, True
                pieces[end + 1] = pieces[end] + (len(text[end].encode()) if self.byte_fallback else int(not unknown[end]))
            score[end + 1] = best
        return pieces[n], score[n]


def log_probabilities(vocabulary: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Scores as a unigram model has them. Those of a merge-based vocabulary are ranks with a minus, and give
    log probabilities by Zipf's law, up to a constant: the reciprocal of the rank. They come in steps of 2 ** -16, so
    that sums are exact and ties are ties. Pieces that the vocabulary bars (scores below -1e8) stay barred."""
    if not all(float(score).is_integer() for _, score in vocabulary):
        return vocabulary
    return [(piece, score if score < -1e8 else -round(math.log(1 - score) * 65536) / 65536) for piece, score in vocabulary]


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces and log probabilities of a SentencePiece model file, and whether it falls back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return log_probabilities([(model.id_to_piece(i), model.get_score(i)) for i in plain]), any(model.is_byte(i) for i in ids)


def keeps_spaces(path: str) -> bool:
    """Whether a SentencePiece model leaves repeated spaces as they are."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model.encode("a" + " " * 2 + "a") != model.encode("a a")


def splitter(vocabulary: list[tuple[str, float]], byte_fallback: bool) -> Callable[[bytes], list[bytes]]:
    """A function from a text with its first space to stretches that can be searched one by one.

    A cut is right where no piece holds the characters on both sides, and no run of unknowns, which counts as one
    piece without a fallback to bytes, goes across.
    """
    pieces = {piece for piece, _ in vocabulary}
    spaces = (byte_fallback or SPACE in pieces) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
    lines = (byte_fallback or "\n" in pieces) and not any("\n" in p and len(p) > 1 for p in pieces)
    # Space signs in a text are as good as spaces.
    sign = SPACE.encode()
    if spaces and lines:
        find = re.compile(rb" *[^ \n]+| +|\n").findall
    elif spaces:
        find = re.compile(rb" *[^ ]+| +").findall
    elif lines:
        find = re.compile(rb"[^\n]+|\n").findall
    else:
        find = lambda text: [text] if text else []
    return lambda text: find(text.replace(sign, b" ") if sign in text else text)


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, keep_spaces: bool = False) -> DataFrame:
    """(doc_id, n_tokens, score) for every row of ``docs`` (doc_id, text)."""
    bound_text_batches(docs.sparkSession)
    key = (hash(tuple(vocabulary)), byte_fallback, keep_spaces)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> WordTable:
            search = Viterbi(shared.value, byte_fallback)
            if keep_spaces:
                return WordTable(lambda w: search.count(w.decode().replace(" ", SPACE)), "qd")
            return WordTable(lambda w: search.count(SPACE + w.decode()), "qd")

        known = worker_cache(key, table)
        stretches = splitter(shared.value, byte_fallback) if keep_spaces else bytes.split
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                counts, scores = known.look(stretches(b" " + raw if raw and keep_spaces else raw))
                out.append((doc, int(counts.sum()), float(np.add.reduce(scores))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, fallback = read_vocabulary(path)
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, fallback, keeps_spaces(path))
