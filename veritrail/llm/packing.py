"""Operator 1: packing by non-negative least squares.

Documents are tokenized and cut into pieces of a whole sequence and a remainder. Combinations of at most three
remainder lengths that fill a sequence are enumerated, over lengths rounded up to ``BIN`` tokens; non-negative
least squares against the histogram of lengths says how often each is used; counts are rounded, and what the
histogram has left is packed greedily, longest first and then the longest that fits, at exact lengths. The
driver sees the histogram only. Pieces are given places in the plan by their rank within their length.

The ids of a text are those of its words, since the tokenizer's pattern never crosses white space: tasks cache
words, whose number is bounded, and tokenize each new one once.

A null or empty text is the end id alone. Repeated rows and null ids are documents of their own. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from pathlib import Path
from unicodedata import combining

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import bound_text_batches, worker_cache
from veritrail.storage import materialize

SEQUENCE, BIN, END_ID = 2048, 8, 1
#: Words, parts of plain ones and stems of others that a Python worker keeps the ids of: texts have many rare words.
CACHED_WORDS, CACHED_PARTS, CACHED_STEMS = 300_000, 450_000, 250_000
CACHED_LENGTH = 256
#: Pieces that a rank is given to at a time.
PIECES_PER_GROUP = 50_000

_PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


class Known(dict):
    """What was worked out once; forgotten at ``limit`` entries. Keys above ``CACHED_LENGTH`` are worked out each time."""

    def __init__(self, make: Callable, limit: int) -> None:
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(key) > CACHED_LENGTH:
            return self.make(key)
        if len(self) >= self.limit:
            self.clear()
        found = self[key] = self.make(key)
        return found


class WordIds:
    """Ids of words (white-space free byte strings), as little-endian unsigned 32-bit numbers."""

    # Printable ASCII, and how the tokenizer's pattern splits that in lower case.
    _PLAIN, _PARTS_OF_PLAIN = re.compile(rb"[!-~]+"), re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    # A stem and the ASCII punctuation after it, unless that has an apostrophe.
    _PARTS = re.compile(rb"(.*[^!-/:-@\[-`{-~])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.model = self.tokenizer.model
        self.words = Known(self._word, CACHED_WORDS)
        self.stems = Known(self._stem, CACHED_STEMS)
        self.parts = Known(self._part, CACHED_PARTS)
        self.stands_apart = Known(self._stands_apart, CACHED_STEMS)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _stem(self, stem: bytes) -> bytes:
        return np.array(self._ids(stem.decode()), "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a part of plain text, straight from the merges: its bytes stand for themselves there."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(part)])

    def _stands_apart(self, last: str) -> bool:
        """Whether the tokenizer splits after the character ``last`` where punctuation follows. Normalization may
        turn a letter into one with a mark, which takes the punctuation along."""
        return last.isalpha() and self._ids(last + ".") == self._ids(last) + self._ids(".")

    def _word(self, word: bytes) -> bytes:
        if b"<|" in word:  # may hold a special token, which has capitals and punctuation of its own
            return self._stem(word)
        if self._PLAIN.fullmatch(word):
            return b"".join(map(self.parts.__getitem__, self._PARTS_OF_PLAIN.findall(word.lower().decode())))
        if not word.isascii() and any(map(combining, word.decode())):  # marks may join a capital and not its small letter
            return self._stem(word)
        low = word.lower()
        cut = self._PARTS.fullmatch(low)
        if cut and self.stands_apart[cut[1].decode()[-1]]:
            return self.stems[cut[1]] + self.stems[cut[2]]
        return self.stems[low]


def token_bytes(text: str | None, ids: WordIds) -> bytes:
    """The ids of a text as bytes, without the end id."""
    return b"".join(map(ids.words.__getitem__, (text or "").encode().split()))


def _pieces(tokenizer, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = worker_cache("packing", lambda: WordIds(tokenizer.value)), END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = token_bytes(text.as_py(), ids) + end
                total = len(raw) // 4
                rows.extend((doc, a, min(size, total - a), zlib.crc32(raw[4 * a : 4 * (a + size)]), total) for a in range(0, total, size))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return run


def combinations(units: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0 that sum to ``units``; 0 stands for no piece."""
    a, b = np.meshgrid(np.arange(units + 1), np.arange(units + 1), indexing="ij")
    c = units - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nonnegative_least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 800) -> np.ndarray:
    """x >= 0 with sum over combos of x near ``histogram`` (index 0 is free), by accelerated projected gradients."""
    units, n = histogram.size, len(combos)
    flat = combos.reshape(-1)
    used = (flat > 0).astype(np.float64)

    def apply(x):
        return np.bincount(flat, weights=np.repeat(x, combos.shape[1]) * used, minlength=units)

    def back(r):
        return (r[flat] * used).reshape(combos.shape).sum(axis=1)

    v = np.ones(n)
    for _ in range(30):
        v = back(apply(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(apply(v))))
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(apply(y) - histogram))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(lengths: dict[int, int], size: int = SEQUENCE, width: int = BIN) -> list[tuple[list[tuple[str, int]], int]]:
    """Strategies ([(kind, value), ...], times): their slots take pieces of a bin ('bin') or of a length ('len')."""
    out = [([("len", size)], lengths[size])] if lengths.get(size) else []
    rest = {n: c for n, c in lengths.items() if n < size}
    units = size // width
    histogram = np.zeros(units + 1)
    for n, c in rest.items():
        histogram[-(-n // width)] += c
    room = histogram.astype(np.int64)
    if rest:
        combos = combinations(units)
        combos = combos[((histogram[combos] > 0) | (combos == 0)).all(axis=1)]
        x = nonnegative_least_squares(combos, histogram) if len(combos) else np.empty(0)
        for i in np.argsort(-x, kind="stable"):
            parts = [int(b) for b in combos[i] if b]
            need = {b: parts.count(b) for b in parts}
            times = min([int(round(x[i])), *(int(room[b]) // k for b, k in need.items())])
            if times > 0:
                for b, k in need.items():
                    room[b] -= times * k
                out.append(([("bin", b) for b in parts], times))
    left = leftovers(rest, room, width)
    order = sorted(left)
    while order:
        parts, fill = [], size
        used: dict[int, int] = {}
        while fill and (at := bisect_right(order, fill)):
            n = next((order[i] for i in range(at - 1, -1, -1) if used.get(order[i], 0) < left[order[i]]), None)
            if n is None:
                break
            k = min(fill // n, left[n] - used.get(n, 0))
            used[n] = used.get(n, 0) + k
            parts += [n] * k
            fill -= n * k
        times = min(left[n] // k for n, k in used.items())
        out.append(([("len", n) for n in parts], times))
        for n, k in used.items():
            left[n] -= times * k
        order = [n for n in order if left[n]]
    return out


def leftovers(lengths: dict[int, int], room, width: int) -> dict[int, int]:
    """Of each length, how many pieces the bins leave: bins take their longest pieces first."""
    left, spare = {}, {b: int(r) for b, r in enumerate(room)}
    for n in sorted(lengths):
        b = -(-n // width)
        left[n] = min(lengths[n], spare[b])
        spare[b] -= left[n]
    return left


def _place(strategies, lengths: dict[int, int], size: int, width: int):
    """Arrays that tell, for a length and a rank within it, the sequence and the slot."""
    taken: dict[tuple[str, int], int] = {}
    spans: dict[tuple[str, int], list] = {}
    sequence = 0
    for parts, times in strategies:
        for slot, key in enumerate(parts):
            spans.setdefault(key, []).append((taken.get(key, 0), sequence, slot))
            taken[key] = taken.get(key, 0) + times
        sequence += times
    base, starts, sequences, slots, at = {}, [], [], [], 0
    for key, rows in spans.items():
        base[key] = at
        starts += [at + s for s, _, _ in rows]
        sequences += [q for _, q, _ in rows]
        slots += [s for _, _, s in rows]
        at += taken[key]
    # By length: how many go to bins, where those start, and where the others start.
    in_bins, bin_at, len_at = (np.zeros(size + 1, np.int64) for _ in range(3))
    seen: dict[int, int] = {}
    for n in sorted(lengths, reverse=True):
        b = -(-n // width)
        mine = taken.get(("len", n), 0)
        in_bins[n] = lengths[n] - mine
        bin_at[n] = base.get(("bin", b), 0) + seen.get(b, 0)
        seen[b] = seen.get(b, 0) + in_bins[n]
        len_at[n] = base.get(("len", n), 0)
    starts, sequences, slots = (np.array(c, np.int64) for c in (starts, sequences, slots))

    def place(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = np.where(rank < in_bins[length], bin_at[length] + rank, len_at[length] + rank - in_bins[length])
        row = np.searchsorted(starts, spot, side="right") - 1
        return sequences[row] + spot - starts[row], slots[row]

    return place


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for ``docs`` (doc_id, text).

    ``tokenizer``: path of a tokenizer file, which the driver reads; executors get its content.
    """
    bound_text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(shared, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(pieces)
    groups = max(16, pieces.count() // PIECES_PER_GROUP)
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    counts = pieces.groupBy("length", "group").count()
    ahead = counts.select("length", "group", (F.sum("count").over(Window.partitionBy("length").orderBy("group")) - F.col("count")).alias("ahead"))
    # At most one row a length: the histogram.
    lengths = {r["length"]: r["count"] for r in counts.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    place = _place(plan(lengths, size), lengths, size, BIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            get = lambda c: batch.column(names.index(c)).to_numpy()
            sequence, slot = place(get("length"), get("rank"))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(f.name)) for f in _PIECE), pa.array(sequence), pa.array(slot)], names=[*_PIECE.names, "sequence_id", "slot"])

    order = Window.partitionBy("length", "group").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(ahead, ["length", "group"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    placed = ranked.drop("ahead", "group").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
