"""Operator 9: suffix-array dedup of byte strings by deep-shallow sorting.

Suffixes at anchors are partitioned as :mod:`veritrail.llm.repeats` describes. Within a partition they are
sorted as in deep-shallow sorting: a multikey quicksort over characters of eight bytes, all segments of a
level at once, down to ``SHALLOW`` bytes; groups that still tie share a long prefix, and a blind trie, which
looks at branching bytes alone and compares each new suffix with one leaf only, orders them.

A byte goes if a string of ``LENGTH`` bytes that covers it starts earlier too (smaller doc_id, or earlier in
the document). A null text is empty; a document with a null id is kept whole. Repeated rows of one id and
text get the same answer; rows that share an id but not the text are compared with documents of smaller ids and
each with itself. Short and empty texts, and empty tables, lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import byte_table
from veritrail.llm.repeats import Kind, covered_spans, kept_parts, with_runs

LENGTH, GRAM, SHALLOW = 100, 32, 48
_CHAR = 8


def multikey_quicksort(chars: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of the rows of ``chars`` (rows x depth), and the (start, end) of those that tie to the last column.

    Each round splits every open segment about its middle row's character into less, equal and greater.
    """
    rows, depth = chars.shape
    order, segment, level = np.arange(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    while True:
        new = np.r_[True, segment[1:] != segment[:-1]]
        heads = np.flatnonzero(new)
        sizes = np.diff(heads, append=rows)
        number = np.cumsum(new) - 1
        live = np.flatnonzero((sizes[number] > 1) & (level < depth))
        if not live.size:
            return order, [(a, a + n) for a, n in zip(heads.tolist(), sizes.tolist(), strict=True) if n > 1]
        pivot = chars[order[heads + sizes // 2], np.minimum(level[heads], depth - 1)]
        own, middle = chars[order[live], level[live]], pivot[number[live]]
        side = 1 + (own > middle).astype(np.int64) - (own < middle).astype(np.int64)
        key = number * 3 + 1
        key[live] += side - 1
        again = np.argsort(key, kind="stable")
        deeper = level.copy()
        deeper[live] += side == 1
        order, segment, level = order[again], key[again], deeper[again]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], which: list[int]) -> list[int]:
    """The indices ``which`` of ``strings`` in the order of the strings. Equal strings are one leaf."""
    equal: dict[bytes, list[int]] = {}
    for i in which:
        equal.setdefault(strings[i], []).append(i)
    which = [same[0] for same in equal.values()]

    def char(i: int, depth: int) -> int:
        s = strings[i]
        return s[depth] if depth < len(s) else -1

    # A node is [depth, children]; a leaf is [None, [index]].
    root = [None, [which[0]]]
    for i in which[1:]:
        node = root
        while node[0] is not None:
            children = node[1]
            node = children.get(char(i, node[0])) or next(iter(children.values()))
        other = node[1][0]
        depth = _common(strings[i], strings[other])
        parent, node = None, root
        while node[0] is not None and node[0] < depth:
            parent, node = node, node[1][char(i, node[0])]
        if node[0] == depth:
            node[1][char(i, depth)] = [None, [i]]
            continue
        branch = [depth, {char(other, depth): node, char(i, depth): [None, [i]]}]
        if parent is None:
            root = branch
        else:
            parent[1][char(i, parent[0])] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out.extend(equal[strings[node[1][0]]])
        else:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
    return out


def deep_shallow_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings and the common prefix of each with the next."""
    width = -(-max(SHALLOW, max(map(len, strings))) // _CHAR) * _CHAR
    padded = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    order, ties = multikey_quicksort(padded[:, :SHALLOW].copy().view(">u8").astype(np.uint64))
    for a, b in ties:
        order[a:b] = blind_trie_order(strings, order[a:b].tolist())
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))[order]
    differ = padded[order[1:]] != padded[order[:-1]]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))


_TABLE = byte_table()


def _encode(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _lift(symbols: np.ndarray) -> np.ndarray:
    return _TABLE[symbols]


KIND = Kind(LENGTH, GRAM, True, 1, _encode, _lift, deep_shallow_order)


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` without repeated bytes: ``text`` loses them (and what they leave of split characters);
    ``removed_spans`` has what went, as array of (start, end) in bytes of the old text."""
    kind = Kind(length, min(GRAM, length), True, 1, _encode, _lift, deep_shallow_order)
    marked = with_runs(docs, kind, text=text)

    @F.pandas_udf("text string, removed_spans array<struct<start:long,end:long>>")
    def cut(texts, runs):
        import pandas as pd

        out = []
        for t, r in zip(texts, runs, strict=True):
            spans = covered_spans(r, length)
            raw = t.encode() if spans else b""
            out.append((b"".join(raw[a:b] for a, b in kept_parts(len(raw), spans)).decode("utf-8", "ignore") if spans else t, [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(out, columns=["text", "removed_spans"])

    # Else a filter on the result would have it worked out a second time, in workers of its own.
    done = marked.withColumn("repeated_runs", cut.asNondeterministic()(F.col(text), F.col("repeated_runs")))
    return done.withColumns({text: F.col("repeated_runs.text"), "removed_spans": F.col("repeated_runs.removed_spans")}).drop("repeated_runs")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw, spans = (text.as_py() or "").encode(), covered_spans(runs.as_py(), LENGTH)
            digest = hashlib.sha256()
            for a, b in kept_parts(len(raw), spans):
                digest.update(raw[a:b])
            rows.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_runs(docs, KIND).select("doc_id", "text", "repeated_runs").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = """
WITH d AS (
  SELECT doc_id, text, encode(coalesce(text, '')) AS b FROM documents),
u AS (
  SELECT row_number() OVER () AS u, * FROM (SELECT DISTINCT doc_id, text, b, octet_length(b) - 99 AS n FROM d WHERE doc_id IS NOT NULL AND octet_length(b) >= 100)),
c AS (
  SELECT u, doc_id, j, least(1000, n - j) AS m, substr(h, 2 * j + 1, 2198) AS h FROM (SELECT u, doc_id, n, hex(b) AS h, unnest(range(0, n, 1000)) AS j FROM u)),
k AS (
  SELECT u, doc_id, j + unnest(range(0, m)) AS i, unnest(list_transform(range(0, m), lambda i: md5_number(substr(h, 2 * i + 1, 200)))) AS g FROM c),
r AS (
  SELECT u, i FROM (SELECT u, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first, min(i) OVER (PARTITION BY g, u) AS own FROM k) WHERE doc_id > first OR i > own),
e AS (
  SELECT u, i, coalesce(i > lag(i) OVER (PARTITION BY u ORDER BY i) + 100, true) AS new FROM r),
n AS (
  SELECT u, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY u ORDER BY i) AS run FROM e),
a AS (
  SELECT u, min(i) AS a, max(i) + 100 AS z FROM n GROUP BY u, run),
l AS (
  SELECT doc_id, text, CAST(sum(z - a) AS BIGINT) AS gone, count(*) AS spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS stops FROM a JOIN u USING (u) GROUP BY doc_id, text),
f AS (
  SELECT d.doc_id, hex(b) AS h, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
         list_prepend(0, coalesce(stops, [])) AS kept_from, list_append(coalesce(starts, []), octet_length(b)) AS kept_to
  FROM d LEFT JOIN l ON l.doc_id IS NOT DISTINCT FROM d.doc_id AND l.text IS NOT DISTINCT FROM d.text)
SELECT doc_id, n_bytes, n_removed, n_spans,
       sha256(unhex(array_to_string(list_transform(list_zip(kept_from, kept_to), lambda x: substr(h, CAST(2 * x[1] + 1 AS BIGINT), CAST(2 * (x[2] - x[1]) AS BIGINT))), ''))) AS kept_sha256
FROM f
"""
