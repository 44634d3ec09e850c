"""Windows of a document that also occur earlier: the part that operators 8 and 9 share.

1. Every run of ``window`` symbols holds an anchor, the rightmost least hash among its runs of ``gram``
   symbols. Equal windows have their anchors at equal places, so only suffixes at anchors (two in
   ``window - gram + 2`` positions) matter, each with the stretch of text that holds all its windows.
2. Suffixes are partitioned by their prefix, the gram; those whose gram occurs nowhere else are dropped. Where a
   task itself meets a gram ``DENSE`` times or more, it solves those stretches as in 3 first and passes on what is
   left, so that passages in very many documents shrink before the shuffle; what stays dense goes around it.
3. For each prefix the operator's own suffix ordering (suffix trees in one, deep-shallow sorting in the other) sorts
   what follows and what precedes the anchor. Two windows are equal where both common prefixes are long enough.
   All repeats are found this way, on symbols; hashes only bring together what may be equal.
4. A prefix with more than ``HOT_GROUP`` stretches is dealt out over groups of that size. What is left of each is
   partitioned again by a longer string and solved again: a stretch is cut into at most ``BLOCKS`` blocks of windows, by
   where their anchor is, and a block goes by what all windows with the anchor at its places share. Where that is
   dealt out as well, what is left goes by whole windows.

Rows are documents by id and text: rows that share an id but not the text are different documents, of which
neither is earlier; repeated rows count once. A null text is empty. Rows with a null id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import bound_text_batches, gram_hashes, mix64, worker_cache
from veritrail.storage import materialize

#: Bytes of symbols that a task solves dense grams of at a time, and stretches of a gram that make it dense there.
FOLD, DENSE = 8_000_000, 8
#: Stretches sorted at a time, and stretches that a gram may have before it is dealt out.
SORT_BATCH, HOT_GROUP = 20_000, 1_000
#: Blocks of windows that a stretch is cut into at most, where its gram was dealt out.
BLOCKS = 3

Order = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Kind:
    """What a repeat is: ``encode`` gives a text's symbols, ``lift`` their hashes; ``order`` sorts byte strings
    of ``width`` bytes a symbol and gives the order and the common prefixes of neighbours, in symbols.
    ``within``: earlier starts in the same document count too."""

    window: int
    gram: int
    within: bool
    width: int
    encode: Callable[[str | None], np.ndarray]
    lift: Callable[[np.ndarray], np.ndarray]
    order: Order


#: Kinds of rows of a sample: a stretch; one of a gram that is dense in its task, and that gram's number there; windows that repeat.
STRETCH, DENSE_STRETCH, NUMBER, DONE = range(4)
_SAMPLE = pa.schema([(c, pa.int64()) for c in ("k", "kh", "doc", "text_hash", "start")] + [(c, pa.int32()) for c in ("n", "shift", "cnt", "kind")])
_SAMPLE_SQL = "k long, kh long, doc long, text_hash long, start long, n int, shift int, cnt int, kind int"
_CUT = pa.schema([(c, pa.int64()) for c in ("kh", "salt", "doc", "text_hash", "start")] + [("n", pa.int32()), ("shift", pa.int32()), ("stretch", pa.binary())])
_CUT_SQL = "kh long, salt long, doc long, text_hash long, start long, n int, shift int, stretch binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: x.size - (width - step)], x[width - step :]) if step < width else x


def anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(start, n, shift, gram hash): windows start .. start + n - 1 have their anchor at start + shift."""
    if hashes.size < window:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    grams, width = gram_hashes(hashes, gram), window - gram + 1
    least = sliding_min(grams, width)
    entered = grams[width - 1 :] == least
    # The anchor changes where a gram enters as the least, or where the least has left.
    change = entered.copy()
    change[1:] |= least[1:] > least[:-1]
    change[0] = True
    start = np.flatnonzero(change)
    place = start + width - 1
    old = ~entered[start]
    if old.any():
        s = start[old]
        place[old] -= np.argmax(grams[s[:, None] + np.arange(width - 1, -1, -1)] == least[s][:, None], axis=1)
    return start, np.diff(start, append=least.size), place - start, grams[place]


def later_in(group: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray, within: bool) -> np.ndarray:
    """Which rows have an earlier one in their group: of a smaller document or, ``within``, earlier in the same one."""
    order = np.lexsort((start, text, doc, group))
    g, d, t, s = group[order], doc[order], text[order], start[order]
    new = np.r_[True, g[1:] != g[:-1]]
    later = d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]
    if within:
        own = new | np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]
        later |= s > s[np.flatnonzero(own)[np.cumsum(own) - 1]]
    out = np.empty(group.size, bool)
    out[order] = later
    return out


def joined_runs(doc: np.ndarray, text: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts (doc, text, start, n), those that touch or overlap made one."""
    order = np.lexsort((start, text, doc))
    doc, text, start, end = doc[order], text[order], start[order], (start + n)[order]
    if not doc.size:
        return doc, text, start, end
    # Runs of one document lie between document breaks; offsetting documents lets one pass do all.
    span = int(end.max()) + 2
    rank = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
    reach = np.maximum.accumulate(end + rank * span)
    new = np.r_[True, (start + rank * span)[1:] > reach[:-1]]
    heads = np.flatnonzero(new)
    stops = reach[np.r_[heads[1:] - 1, reach.size - 1]] - rank[heads] * span
    return doc[heads], text[heads], start[heads], stops - start[heads]


def range_min(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The least of ``x`` between neighbouring ``places`` that ascend; anything for others."""
    low, high = places[:-1], np.maximum(places[1:], places[:-1] + 1)
    table, width = [x], 1
    while 2 * width <= x.size:
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(low.size, x.dtype)
    for i in np.unique(level):
        mine = np.flatnonzero(level == i)
        row = table[i]
        out[mine] = np.minimum(row[np.minimum(low[mine], row.size - 1)], row[np.clip(high[mine] - (1 << i), 0, row.size - 1)])
    return out


def solve(kind: Kind, group, doc, text, start, n, shift, stretches: list[bytes]) -> tuple[tuple, tuple]:
    """(runs (doc, text, start, n) of windows that occur earlier in their group, (row, start, n) of the other windows)."""
    item, gram, window = kind.width, kind.gram, kind.window

    def classes(strings: list[bytes]):
        """Places in suffix order group by group, common prefixes of neighbours there, and who equals the one before."""
        order, common = kind.order(strings)
        at = np.empty(order.size, np.int64)
        at[order] = np.arange(order.size)
        # The order mixes groups; neighbours within one share the least that any between them share.
        order = np.lexsort((at, group))
        apart = group[order][1:] != group[order][:-1]
        common = np.where(apart, -1, range_min(common, at[order]))
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))[order] // item
        same = (common == lengths[1:]) & (common == lengths[:-1])
        at[order] = np.arange(order.size)
        return at, common, np.r_[0, np.cumsum(~same)][at]

    def reverse(raw: bytes) -> bytes:
        return raw[::-1] if item == 1 else np.frombuffer(raw, f"V{item}")[::-1].tobytes()

    cuts, size = shift.tolist(), len(stretches)
    right_at, right_common, right_leaf = classes([x[c * item :][: window * item] for x, c in zip(stretches, cuts, strict=True)])
    left_at, left_common, left_leaf = classes([reverse(x[: (c + gram) * item]) for x, c in zip(stretches, cuts, strict=True)])
    # Stretches at the same leaves of both orders are equal: all windows of all but the first are later.
    leaf = right_leaf * size + left_leaf
    whole = later_in(leaf, doc, text, start + shift, kind.within)
    rest = np.flatnonzero(~whole)
    rows, starts, later = [], [], []
    for before in range(int(shift[rest].max(initial=-1)) + 1):
        use = rest[(shift[rest] >= before) & (shift[rest] - before < n[rest])]
        if not use.size:
            continue
        right = np.r_[0, np.cumsum(right_common < window - before)][right_at[use]]
        left = np.r_[0, np.cumsum(left_common < gram + before)][left_at[use]]
        at = start[use] + shift[use] - before
        rows.append(use)
        starts.append(at)
        later.append(later_in(right * size + left, doc[use], text[use], at, kind.within))
    row, at, late = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, starts, later))
    late = late.astype(bool)
    runs = joined_runs(*(np.r_[a[whole], b[row[late]]] for a, b in ((doc, doc), (text, text))), np.r_[start[whole], at[late]], np.r_[n[whole], np.ones(late.sum(), np.int64)])
    row, at = row[~late], at[~late]
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]) if row.size else np.empty(0, np.int64)
    return runs, (row[heads], at[heads], np.diff(heads, append=row.size))


def _batch(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sample(kind: Kind) -> Callable:
    item, window = kind.width, kind.window

    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        raws = [h[2] for h in held]
        sizes = [h[3].size for h in held]
        owner = np.repeat(np.arange(len(held)), sizes)
        doc, text = (np.repeat(np.array([h[i] for h in held], np.int64), sizes) for i in (0, 1))
        start, n, shift, kh = (np.concatenate([h[i] for h in held]) for i in (3, 4, 5, 6))
        kh = kh.view(np.int64)
        order = np.argsort(kh, kind="stable")
        heads = np.flatnonzero(np.r_[True, kh[order][1:] != kh[order][:-1]])
        times = np.empty(kh.size, np.int64)
        times[order] = np.repeat(counts := np.diff(heads, append=kh.size), counts)
        dense = order[times[order] >= DENSE]
        keep = [np.flatnonzero(times < DENSE)]
        left, done = [], []
        for a in range(0, dense.size, SORT_BATCH):
            some = dense[a : a + SORT_BATCH]
            stretches = [raws[o][s * item : e * item] for o, s, e in zip(owner[some].tolist(), start[some].tolist(), (start + n - 1 + window)[some].tolist(), strict=True)]
            runs, (row, at, m) = solve(kind, kh[some], doc[some], text[some], start[some], n[some], shift[some], stretches)
            left.append((some[row], at, m))
            done.append(runs)
        if done:
            row, at, m = (np.concatenate(x) for x in zip(*left, strict=True))
            number = np.unique(kh[row], return_inverse=True, return_counts=True)
            many = number[2][number[1]] >= DENSE
            r_doc, r_text, r_start, r_n = (np.concatenate(x) for x in zip(*done, strict=True))
        else:
            row = at = m = r_doc = r_text = r_start = r_n = np.empty(0, np.int64)
            many, number = np.empty(0, bool), (np.empty(0, np.int64),) * 3
        plain, row2, at2, m2 = keep[0], row[~many], at[~many], m[~many]
        row3, at3, m3 = row[many], at[many], m[many]
        hot = number[2] >= DENSE
        w_kh, w_cnt = number[0][hot], number[2][hot]
        spread = lambda x: mix64(x.astype(np.uint64)).view(np.int64)
        zero, one = (lambda like: np.zeros(like.size, np.int64)), (lambda like: np.ones(like.size, np.int64))
        parts = [
            (kh[plain], zero(plain), doc[plain], text[plain], start[plain], n[plain], shift[plain], one(plain), zero(plain) + STRETCH),
            (kh[row2], zero(row2), doc[row2], text[row2], at2, m2, start[row2] + shift[row2] - at2, one(row2), zero(row2) + STRETCH),
            (spread(text[row3] + at3), kh[row3], doc[row3], text[row3], at3, m3, start[row3] + shift[row3] - at3, zero(row3), zero(row3) + DENSE_STRETCH),
            (w_kh, zero(w_kh), zero(w_kh), zero(w_kh), zero(w_kh), zero(w_kh), zero(w_kh), w_cnt, zero(w_kh) + NUMBER),
            (spread(r_text + r_start), zero(r_doc), r_doc, r_text, r_start, r_n, zero(r_doc), zero(r_doc), zero(r_doc) + DONE),
        ]
        yield _batch(_SAMPLE, [np.concatenate(c) for c in zip(*parts, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("repeats", dict)
        held, size = [], 0
        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if doc is None:
                    continue
                symbols = kind.encode(text.as_py())
                found = anchors(kind.lift(symbols), kind.window, kind.gram)
                if not found[0].size:
                    continue
                held.append((doc, key, symbols.tobytes(), *found))
                size += symbols.nbytes
                if size >= FOLD:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return run


def _cut(kind: Kind) -> Callable:
    """Cut the marked stretches out of the texts (doc, text_hash, doc_id, text, marks)."""
    item, window = kind.width, kind.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("repeats", dict)
        rows: list[tuple] = []
        last = None
        for batch in batches:
            for doc, key, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
                # Repeated rows come together, unless Spark splits their partition; then their stretches are equal.
                if (doc, key) == last:
                    continue
                last = (doc, key)
                raw = kind.encode(text.as_py()).tobytes()
                for m in marks.as_py():
                    start, n = m["start"], m["n"]
                    rows.append((m["kh"], m["salt"], doc, key, start, n, m["shift"], raw[start * item : (start + n - 1 + window) * item]))
                if len(rows) >= SORT_BATCH // 4:
                    yield _batch(_CUT, zip(*rows, strict=True))
                    rows = []
        if rows:
            yield _batch(_CUT, zip(*rows, strict=True))

    return run


def _column(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def blocks(kind: Kind, start: int, n: int, anchor: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, n, place, core start, core end) of the windows start .. start + n - 1, cut where their anchor is at a multiple of
    ``width``: windows with their anchor at the same ``width`` places from ``place`` on share the core."""
    last = anchor - start
    for place in range((last - n + 1) // width * width, last + 1, width):
        end = min(place + width - 1, kind.window - kind.gram)
        first = anchor - min(end, last)
        yield first, anchor - max(place, last - n + 1) - first + 1, place, anchor - place, anchor - end + kind.window


def _solver(kind: Kind, width: int) -> Callable:
    """Solve whole groups of rows sorted by (kh, salt). Rows out have no stretch where they are windows that repeat,
    else they are windows left of a group that was dealt out, in blocks of ``width`` keyed by the hash of what they share."""
    item, window = kind.width, kind.window

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kh, salt, doc, text, start, n, shift = (_column(table, c) for c in _CUT.names[:-1])
        stretches = table.column("stretch").to_pylist()
        group = np.cumsum(np.r_[0, (kh[1:] != kh[:-1]) | (salt[1:] != salt[:-1])])
        (r_doc, r_text, r_start, r_n), (row, at, m) = solve(kind, group, doc, text, start, n, shift, stretches)
        none = np.zeros(r_doc.size, np.int64)
        if r_doc.size:
            yield _batch(_CUT, [none, none - 1, r_doc, r_text, r_start, r_n, none, [None] * r_doc.size])
        rows = []
        for i, s, k in zip(row.tolist(), at.tolist(), m.tolist(), strict=True):
            if salt[i] < 0:
                continue
            raw, off, anchor = stretches[i], int(start[i]), int(start[i] + shift[i])
            for w, many, place, a, b in blocks(kind, s, k, anchor, width):
                key = xxhash.xxh3_64_intdigest(raw[(a - off) * item : (b - off) * item], place) - 2**63
                rows.append((key, -1, int(doc[i]), int(text[i]), w, many, anchor - w, raw[(w - off) * item : (w - off + many - 1 + window) * item]))
            if len(rows) >= SORT_BATCH:
                yield _batch(_CUT, zip(*rows, strict=True))
                rows = []
        if rows:
            yield _batch(_CUT, zip(*rows, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("repeats", dict)
        held, rows, least = [], 0, SORT_BATCH
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < least:
                continue
            table = pa.Table.from_batches(held)
            kh, salt = _column(table, "kh"), _column(table, "salt")
            ends = np.flatnonzero((kh[1:] != kh[:-1]) | (salt[1:] != salt[:-1])) + 1
            if not ends.size:
                least = 2 * rows
                continue
            yield from emit(table.slice(0, cut := int(ends[-1])))
            held, rows, least = table.slice(cut).to_batches(), table.num_rows - cut, SORT_BATCH
        if rows:
            yield from emit(pa.Table.from_batches(held))

    return run


def repeated_runs(docs: DataFrame, kind: Kind) -> DataFrame:
    """(doc, text_hash, start, n): windows start .. start + n - 1 occur earlier. ``docs``: (doc, text_hash, doc_id, text)."""
    sampled = docs.select("doc_id", "text_hash", "text").mapInArrow(_sample(kind), _SAMPLE_SQL)
    total = F.sum("cnt").over(Window.partitionBy("k"))
    wanted = f"kind in ({DENSE_STRETCH}, {DONE}) or kind = {STRETCH} and total > 1 or kind = {NUMBER} and total > {HOT_GROUP}"
    found = sampled.withColumn("total", total).where(wanted)
    prefix = F.when(F.col("kind") == DENSE_STRETCH, F.col("kh")).otherwise(F.col("k"))
    found = materialize(found.select(prefix.alias("kh"), "doc", "text_hash", "start", "n", "shift", "total", "kind"))

    of = lambda kind: found.where(F.col("kind") == kind).drop("kind")
    totals = of(NUMBER).groupBy("kh").agg(F.max("total").alias("total"))
    open_ = of(STRETCH).unionByName(of(DENSE_STRETCH).drop("total").join(totals, "kh", "left"))
    marks = open_.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("kh", "start", "n", "shift", _salt().alias("salt"))).alias("marks"))
    texts = docs.join(marks, ["doc", "text_hash"]).select("doc", "text_hash", "doc_id", "text", "marks")
    columns = ["doc", "text_hash", "start", F.col("n").cast("long").alias("n")]
    runs, left = of(DONE).select(columns), texts.mapInArrow(_cut(kind), _CUT_SQL)
    dealt_out = not found.where(F.col("total") > HOT_GROUP).isEmpty()
    for width in sorted({-(-(kind.window - kind.gram + 1) // BLOCKS), 1}, reverse=True):
        solved = left.repartition("kh", "salt").sortWithinPartitions("kh", "salt").mapInArrow(_solver(kind, width), _CUT_SQL)
        if not dealt_out:
            return runs.unionByName(solved.select(columns))
        solved = materialize(solved)
        runs, left = runs.unionByName(solved.where("stretch is null").select(columns)), solved.where("stretch is not null")
        totals = left.groupBy("kh").agg(F.count("*").alias("total")).where(F.col("total") > HOT_GROUP)
        # Blocks of one place are whole windows, of which each group has left one at most.
        dealt_out = width > 1 and not totals.isEmpty()
        if dealt_out:
            left = left.join(totals, "kh", "left").withColumn("salt", _salt()).select(*_CUT.names)
    solved = left.repartition("kh").sortWithinPartitions("kh").mapInArrow(_solver(kind, 1), _CUT_SQL)
    return runs.unionByName(solved.select(columns))


def _salt() -> Column:
    """The group that a stretch is dealt out to, by the ``total`` of its key; -1 where there is one group."""
    groups = F.ceil(F.coalesce("total", F.lit(0)) / HOT_GROUP)
    return F.when(groups > 1, F.pmod(F.xxhash64("doc", "text_hash"), groups)).otherwise(-1)


def with_runs(docs: DataFrame, kind: Kind, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` and a column ``repeated_runs``, array of (start, n), null where there are none."""
    bound_text_batches(docs.sparkSession)
    # Keys that are never null, so that both joins below can share one shuffle of the texts.
    own = {"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "__text_hash": F.xxhash64(F.col(text), F.col(doc_id).isNull())}
    marked = docs.withColumns(own)
    slim = marked.select(F.col("__doc").alias("doc"), F.col("__text_hash").alias("text_hash"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    runs = repeated_runs(slim, kind).groupBy(F.col("doc").alias("__doc"), F.col("text_hash").alias("__text_hash")).agg(F.collect_list(F.struct("start", "n")).alias("repeated_runs"))
    return marked.join(runs, ["__doc", "__text_hash"], "left").drop("__doc", "__text_hash")


def covered_spans(runs: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal spans [start, end) that the windows of the runs cover."""
    spans: list[list[int]] = []
    for start, n in sorted((r["start"], r["n"]) for r in ([] if runs is None else runs)):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + n - 1 + window)
        else:
            spans.append([start, start + n - 1 + window])
    return [(a, b) for a, b in spans]


def kept_parts(length: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    at = 0
    for a, b in spans:
        if a > at:
            yield at, a
        at = b
    if at < length:
        yield at, length
