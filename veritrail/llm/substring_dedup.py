"""Operator 8: substring dedup of words with prefix-partitioned suffix trees.

Suffixes at anchors are partitioned by variable-length prefixes as :mod:`veritrail.llm.repeats` describes:
a prefix of ``GRAM`` words, or of the whole window where so many suffixes share it that a task should not
hold them. For each prefix a compacted suffix tree is built in memory; two suffixes have in common what
the internal node above both spells, so that nodes at least ``WINDOW`` words deep are the repeats.

Words are runs of anything but ASCII white space, told apart by a 64-bit hash. A word goes if a window of
``WINDOW`` words that covers it starts in a document with a smaller id too; repeats within a document stay.
A null text has no words; a document with a null id is kept whole. Repeated rows of one id and text get the
same answer; rows that share an id but not the text are compared with documents of smaller ids. Short and empty texts, and empty tables, lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import mix64, word_hashes
from veritrail.llm.repeats import Kind, covered_spans, kept_parts, with_runs

WINDOW, GRAM = 50, 16


class SuffixTree:
    """Compacted trie of symbol sequences. A node is [depth, children, indices that end here, a sequence through it]."""

    def __init__(self) -> None:
        self.root: list = [0, {}, [], ()]

    def insert(self, indices: list[int], seq: tuple) -> None:
        """Add a sequence, which all ``indices`` have."""
        parent, at = self.root, 0
        while at < len(seq):
            child = parent[1].get(seq[at])
            if child is None:
                parent[1][seq[at]] = [len(seq), {}, list(indices), seq]
                return
            end, through = min(child[0], len(seq)), child[3]
            if seq[at:end] == through[at:end]:
                stop = end
            else:
                stop = next(i for i in range(at, end) if seq[i] != through[i])
            if stop < child[0]:
                middle = [stop, {through[stop]: child}, [], through]
                parent[1][seq[at]] = middle
                child = middle
            parent, at = child, stop
        parent[2].extend(indices)

    def leaves(self) -> tuple[list[int], list[int]]:
        """Indices in the order of their sequences, and the depth of the node where each parts from the next."""
        order, parts, low = [], [], 0
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, above = stack.pop()
            low = min(low, above)
            for i in node[2]:
                if order:
                    parts.append(low)
                order.append(i)
                low = node[0]
            stack.extend((node[1][c], node[0]) for c in sorted(node[1], reverse=True))
        return order, parts


def tree_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of sequences of 64-bit words and the common prefixes of neighbours, from one tree for each first word."""
    equal: dict[bytes, list[int]] = {}
    for i, raw in enumerate(strings):
        equal.setdefault(raw, []).append(i)
    groups: dict[int, SuffixTree] = {}
    for raw, same in equal.items():
        seq = tuple(np.frombuffer(raw, np.uint64).tolist())
        groups.setdefault(seq[0] if seq else -1, SuffixTree()).insert(same, seq)
    order: list[int] = []
    common: list[int] = []
    for key in sorted(groups):
        found, parts = groups[key].leaves()
        common.extend(([0] if order else []) + parts)
        order.extend(found)
    return np.array(order, np.int64), np.array(common, np.int64)


def _encode(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode().split())


KIND = Kind(WINDOW, GRAM, False, 8, _encode, mix64, tree_order)
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` whose ``text`` keeps the words that no repeated window covers, joined by one space; texts
    without repeats are left as they are. ``removed_spans``: array of (start, end) in words of the old text."""
    kind = Kind(window, min(GRAM, window), False, 8, _encode, mix64, tree_order)

    @F.pandas_udf("text string, removed_spans array<struct<start:long,end:long>>")
    def cut(texts, runs):
        import pandas as pd

        out = []
        for t, r in zip(texts, runs, strict=True):
            spans = covered_spans(r, window)
            words = t.encode().split() if spans else []
            out.append((b" ".join(w for a, b in kept_parts(len(words), spans) for w in words[a:b]).decode() if spans else t, [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(out, columns=["text", "removed_spans"])

    done = with_runs(docs, kind).withColumn("repeated_runs", cut(F.col("text"), F.col("repeated_runs")))
    return done.withColumns({"text": F.col("repeated_runs.text"), "removed_spans": F.col("repeated_runs.removed_spans")}).drop("repeated_runs")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            words, spans = (text.as_py() or "").encode().split(), covered_spans(runs.as_py(), WINDOW)
            kept = b" ".join(w for a, b in kept_parts(len(words), spans) for w in words[a:b])
            rows.append((doc, len(words), sum(b - a for a, b in spans), hashlib.sha256(kept).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_runs(docs, KIND).select("doc_id", "text", "repeated_runs").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM s),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM k) WHERE doc_id > first),
g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM r),
n AS (
  SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
f AS (
  SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN n USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM f
"""
