"""Operator 11: phrase collocations of each language, by exact counts over a minimal perfect hash of candidates.

Words are numbered by a 64-bit hash of language and word, for which a salt is chosen that keeps all words of the corpus apart
(:func:`count_words` sees every one); so a phrase is known exactly by its words' numbers. Apriori: parts of a frequent
phrase are frequent. Frequent words, then pairs, then longer phrases pass filters made of counters that tasks
fill and a tree sums; a counter is never below the count of what shares it, so that no frequent phrase is lost. What passes are
candidates. They are dealt out by hash to shards of about ``SHARD`` keys, each with a minimal perfect hash that stores its
keys. The texts' phrases, added up in each task, are dealt out alike; shards look their slots up, compare the
stored keys, and add them up with bincount, in as many tasks as there are, whose arrays a tree sums. Parts of
phrases are read from these counts by slot as well. Filters have a fixed size: where it is small for the corpus,
more candidates are counted, with the same result.

A null text is empty, a null language is ``und``. Texts of any length are hashed in stretches. Repeated rows count each;
phrases never cross documents. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import FAN_IN, PIECE_BITS, arrow_batches, assembled, bit_filter, bound_text_batches, give_back, mix64, set_bits
from veritrail.storage import materialize

LONGEST, MIN_COUNT, COVERED, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
#: Counters and bits of a filter (as powers of two).
COUNTER_BITS, WORD_BITS = 26, 26
#: Candidates of a shard.
SHARD = 50_000
#: Bytes of text that a task takes at a time, bytes hashed at a time, and phrases or counters held before they are added up.
TAKEN, STRETCH, HELD = 4 << 20, 1 << 18, 1 << 20
#: Phrases of a packed row, and such rows of an Arrow batch.
PACKED, PACKED_BATCH = 1 << 13, 32

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: What ends a piece, and what stands between words.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_ODD = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_TURNS = mix64(np.arange(1, 1 + 64 * LONGEST, dtype=np.uint64) * np.uint64(_ODD)).reshape(-1, LONGEST) | np.uint64(1)
_NUMBERS = [f"h{i}" for i in range(LONGEST)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, STRETCH), _powers(pow(_ODD, -1, 1 << 64), STRETCH)


def _hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each word, from sums of bytes times powers up to its ends, a stretch of text at a time."""
    values = mix64(mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(salt * 1000 + 7)))
    first, last, down = (np.zeros(starts.size, np.uint64) for _ in range(3))
    total, up, back = 0, 1, 1
    for at in range(0, text.size + 1, STRETCH):
        part = text[at : at + STRETCH]
        sums = np.zeros(part.size + 1, np.uint64)
        np.cumsum(values[part] * _UP[: part.size], out=sums[1:])
        sums = sums * np.uint64(up) + np.uint64(total)
        for places, out in ((starts, first), (ends, last)):
            a, b = np.searchsorted(places, [at, at + STRETCH])
            out[a:b] = sums[places[a:b] - at]
        a, b = np.searchsorted(starts, [at, at + STRETCH])
        # What brings the powers of a word down to those of a word at the start of the text.
        down[a:b] = np.uint64(back) * _DOWN[starts[a:b] - at]
        total = int(sums[-1])
        up, back = up * int(_UP[-1]) * _ODD & _M64, back * int(_DOWN[-1]) * int(_DOWN[1]) & _M64
    return mix64((last - first) * down)


@dataclass
class Words:
    """The words of some texts of one language: places in the lower-cased text, numbers, and the piece each is in."""

    lang: str
    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    numbers: np.ndarray
    pieces: np.ndarray

    @classmethod
    def of(cls, lang: str, texts: list[bytes], salt: int) -> Words:
        text = b"\n".join(texts).translate(_LOWER)
        codes = np.frombuffer(text, np.uint8)
        kinds = _KIND[codes]
        edges = np.flatnonzero(np.diff((kinds == 0).view(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        numbers = mix64(_hashes(codes, starts, ends, salt) ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=salt)))
        return cls(lang, text, starts, ends, numbers, np.searchsorted(np.flatnonzero(kinds == 2), starts))

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.text[self.starts[at] : self.ends[at + n - 1]].split())


def _taken(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[Words]:
    """The words of the batches' (text, lang), some megabytes of a language at a time."""
    give_back()
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for text, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            size += len(text) + 1
            if size >= TAKEN:
                yield from (Words.of(*x, salt) for x in held.items())
                held, size = {}, 0
    yield from (Words.of(*x, salt) for x in held.items())


def _runs(order_by: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of runs of rows equal in all columns, lengths of the runs), in order of ``order_by``."""
    order = np.argsort(order_by, kind="stable")
    new = np.zeros(order.size, bool)
    new[:1] = True
    for c in (order_by, *columns):
        new[1:] |= c[order[1:]] != c[order[:-1]]
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, order.size))


def texts_of(docs: DataFrame) -> DataFrame:
    bound_text_batches(docs.sparkSession)
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))


def count_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """((h0, lang, phrase, known): words and their counts, and the salt under which no two have one number)."""
    for salt in range(64):

        def run(batches: Iterator[pa.RecordBatch], salt: int = salt) -> Iterator[pa.RecordBatch]:
            for w in _taken(batches, salt):
                # A second hash tells words of one number apart.
                other = _hashes(np.frombuffer(w.text, np.uint8), w.starts, w.ends, salt + 1_000)
                order, starts, n = _runs(w.numbers, other)
                at = order[starts]
                words = pa.array([w.text[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(w.numbers[at].view(np.int64)), pa.array([w.lang] * at.size, pa.string()), words, pa.array(n)], names=["h0", "lang", "phrase", "known"])

        words = texts.mapInArrow(run, "h0 long, lang string, phrase string, known long")
        words = materialize(words.repartition("h0").groupBy("h0", "lang", "phrase").agg(F.sum("known").alias("known")))
        if words.groupBy("h0").count().where("count > 1").isEmpty():
            return words, salt
    raise RuntimeError("no salt keeps the words apart")


def packed_counts(slots: np.ndarray, counts: np.ndarray) -> bytes:
    used = np.flatnonzero(counts)
    return zlib.compress(slots[used].astype("<u4").tobytes() + counts[used].astype("<i8").tobytes(), 1)


def unpacked_counts(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(body)
    n = len(raw) // 12
    return np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<i8", n, 4 * n)


def tree_sum(arrays: DataFrame, tasks: int) -> DataFrame:
    """Sums by piece of the arrays (piece, task, body) of ``tasks`` tasks; no task adds more than FAN_IN arrays of a piece."""

    def add(rows):
        import pandas as pd

        total = np.zeros(0, np.int64)
        for slots, counts in map(unpacked_counts, rows["body"]):
            if slots.size and slots[-1] >= total.size:
                total = np.concatenate([total, np.zeros(int(slots[-1]) + 1 - total.size, np.int64)])
            total[slots] += counts
        return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "task": [rows["task"].iloc[0] // FAN_IN], "body": [packed_counts(np.arange(total.size), total)]})

    while True:
        arrays = arrays.groupBy("piece", F.floor(F.col("task") / FAN_IN).alias("__task")).applyInPandas(add, "piece long, task long, body binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return arrays


def _word_filter(words: DataFrame, least: int) -> bytes:
    """Bits of the words that occur ``least`` times."""
    return bit_filter(words.where(F.col("known") >= least).select(F.shiftrightunsigned("h0", 64 - WORD_BITS).alias("slot")), WORD_BITS)


def _count_filter(counters: DataFrame, tasks: int, least: int) -> bytes:
    """Bits of the counters that reach ``least``, summed over all tasks."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sums = [unpacked_counts(body) for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_bits(s[c >= least]) for s, c in sums], pa.binary())], names=["piece", "body"])

    return assembled(tree_sum(counters, tasks).select("piece", "body").mapInArrow(cut, "piece long, body binary"), COUNTER_BITS)


def _has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return bits[slots >> np.uint64(3)] << (slots & np.uint64(7)).astype(np.uint8) & 128 > 0


def turned(keys: list[np.ndarray], n, level: int) -> np.ndarray:
    """A hash of phrases (a column of numbers for each word, ``n`` words) that differs from level to level."""
    total = np.zeros(keys[0].size, np.uint64) + np.asarray(n).astype(np.uint64) * _TURNS[level, 0]
    for i, column in enumerate(keys):
        total = total + mix64(column ^ _TURNS[level, i]) * _TURNS[level, i]
    return mix64(total)


def passing(w: Words, filters: list[bytes]) -> list[np.ndarray]:
    """For 2 to LONGEST words, where phrases begin of which nothing says yet that they are rare. ``filters`` are those known so
    far: of words, pairs, and longer phrases."""
    known = [np.frombuffer(f, np.uint8) for f in filters]
    out, h = [], w.numbers
    fine = _has(known[0], h >> np.uint64(64 - WORD_BITS))
    fine = fine[:-1] & fine[1:] & (w.pieces[1:] == w.pieces[:-1])
    for n in range(2, LONGEST + 1):
        at = np.flatnonzero(fine)
        if min(n, 3) <= len(known):
            at = at[_has(known[min(n, 3) - 1], _counter(w, at, n))]
        out.append(at)
        if len(known) == 1:
            break
        fine = np.zeros(max(0, h.size - n + 1), bool)
        fine[at] = True
        fine = fine[:-1] & fine[1:]
    return out


def _columns(w: Words, at: np.ndarray, n: int) -> list[np.ndarray]:
    return [w.numbers[at + i] for i in range(n)]


def _counter(w: Words, at: np.ndarray, n: int) -> np.ndarray:
    return turned(_columns(w, at, n), n, 0) >> np.uint64(64 - COUNTER_BITS)


def _counters(texts: DataFrame, filters: list[bytes], salt: int) -> DataFrame:
    """(piece, task, body): counters of what passes and the next filter is for."""
    fixed = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def added(slots, counts, held):
            more = np.concatenate([slots, *held])
            order, starts, _ = _runs(more)
            weights = np.concatenate([counts, np.ones(more.size - slots.size, np.int64)])[order]
            return more[order[starts]], np.add.reduceat(weights, starts) if starts.size else counts[:0]

        for w in _taken(batches, salt):
            for n, at in enumerate(passing(w, fixed.value), 2):
                if n >= len(fixed.value) + 1:
                    held.append(_counter(w, at, n))
            if sum(x.size for x in held) >= HELD:
                slots, counts = added(slots, counts, held)
                held = []
        slots, counts = added(slots, counts, held)
        task, pieces = TaskContext.get().partitionId(), (slots >> np.uint64(PIECE_BITS)).astype(np.int64)
        low = slots & np.uint64((1 << PIECE_BITS) - 1)
        at = np.flatnonzero(np.diff(pieces, prepend=-1))
        bodies = [packed_counts(low[a:b], counts[a:b]) for a, b in zip(at.tolist(), [*at[1:].tolist(), pieces.size][: at.size], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(pieces[at]), pa.array(np.full(at.size, task, np.int64)), pa.array(bodies, pa.binary())], names=["piece", "task", "body"])

    return texts.mapInArrow(run, "piece long, task long, body binary")


_KEY_SQL = "n long, " + ", ".join(f"{h} long" for h in _NUMBERS)


def _key_arrays(keys: list[np.ndarray], n) -> list[pa.Array]:
    """Arrow columns of phrases: how many words, and the words' numbers."""
    size = keys[0].size
    columns = [np.zeros(size, np.uint64) if i >= len(keys) else keys[i] for i in range(LONGEST)]
    return [pa.array(np.zeros(size, np.int64) + n), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns)]


def _candidates(texts: DataFrame, filters: list[bytes], salt: int) -> DataFrame:
    """(n, h0.., lang, phrase) of what passes all filters, each once. Tasks pack what they find by buckets of its hash; a bucket's
    rows then meet in one task, which keeps a key for each phrase."""
    spark = texts.sparkSession
    fixed = spark.sparkContext.broadcast(filters)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for w in _taken(batches, salt):
            if len(seen) > HELD // 2:
                seen.clear()
            rows = []
            for n, at in enumerate(passing(w, fixed.value), 2):
                keys = _columns(w, at, n)
                order, starts, _ = _runs(turned(keys, n, 0), *keys)
                at = at[order[starts]]
                keys = np.zeros((at.size, LONGEST), np.uint64)
                for i, k in enumerate(_columns(w, at, n)):
                    keys[:, i] = k
                to = (turned(_columns(w, at, n), n, 0) % np.uint64(buckets)).tolist()
                for i, place in enumerate(at.tolist()):
                    name = bytes([n]) + keys[i].tobytes()
                    if name not in seen:
                        seen.add(name)
                        rows.append((to[i], name, w.phrase(place, n)))
            rows.sort()
            edges = [i for i in range(len(rows)) if not i or rows[i][0] != rows[i - 1][0]] + [len(rows)]
            found = [(rows[a][0], zlib.compress(b"".join(r[1] for r in rows[a:b]), 1), zlib.compress(b"\n".join(r[2] for r in rows[a:b]), 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([w.lang] * len(found), pa.string()), *(pa.array([f[i] for f in found], pa.binary()) for i in (1, 2))], names=["bucket", "lang", "names", "phrases"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, seen = 1 + 8 * LONGEST, set()
        for batch in batches:
            for lang, names, phrases in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw = zlib.decompress(names)
                names = [raw[a : a + size] for a in range(0, len(raw), size)]
                new = [(name, phrase) for name, phrase in zip(names, zlib.decompress(phrases).split(b"\n"), strict=True) if name not in seen]
                seen.update(name for name, _ in new)
                if new:
                    keys = np.frombuffer(b"".join(name[1:] for name, _ in new), np.uint64).reshape(-1, LONGEST)
                    n = np.array([name[0] for name, _ in new])
                    words = pa.array([phrase for _, phrase in new], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*_key_arrays([keys[:, i] for i in range(LONGEST)], n), pa.array([lang] * n.size, pa.string()), words], names=["n", *_NUMBERS, "lang", "phrase"])

    packed = texts.mapInArrow(run, "bucket long, lang string, names binary, phrases binary")
    return packed.repartition(buckets, "bucket").mapInArrow(once, f"{_KEY_SQL}, lang string, phrase string")


class PerfectHash:
    """A minimal perfect hash of phrases, with the phrases stored at their slots. Each level has bits for what no other key
    shares, and hands the rest on; a slot is the rank of the key's bit among all bits."""

    def __init__(self, keys: list[np.ndarray], n: np.ndarray) -> None:
        self.levels, rest, placed = [], np.arange(n.size), []
        for level in range(len(_TURNS)):
            if not rest.size:
                break
            size = rest.size * 3 // 2 + 1
            at = (turned([k[rest] for k in keys], n[rest], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            self.levels.append((bits, sum(p.size for p in placed) + np.cumsum(bits) - 1))
            placed.append(rest[alone][np.argsort(at[alone])])
            rest = rest[~alone]
        if rest.size:
            raise ValueError("equal keys")
        order = np.concatenate([np.zeros(0, np.int64), *placed])
        self.keys, self.n = [k[order] for k in keys], n[order]

    def __len__(self) -> int:
        return self.n.size

    def slots(self, keys: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't stored."""
        out, rest = np.full(n.size, -1, np.int64), np.arange(n.size)
        for level, (bits, ranks) in enumerate(self.levels):
            at = (turned([k[rest] for k in keys], n[rest], level) % np.uint64(bits.size)).astype(np.int64)
            hit = bits[at]
            out[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        met = np.flatnonzero(out >= 0)
        same = self.n[out[met]] == n[met]
        for mine, theirs in zip(self.keys, keys, strict=True):
            same &= mine[out[met]] == theirs[met]
        out[met[~same]] = -1
        return out

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps(([(np.packbits(b), b.size) for b, _ in self.levels], self.keys, self.n)), 1)

    @classmethod
    def unpacked(cls, body: bytes) -> PerfectHash:
        out = cls.__new__(cls)
        levels, out.keys, out.n = pickle.loads(zlib.decompress(body))
        out.levels, before = [], 0
        for raw, size in levels:
            bits = np.unpackbits(raw, count=size).astype(bool)
            out.levels.append((bits, before + np.cumsum(bits) - 1))
            before += int(bits.sum())
        return out


def _shard(shards: int):
    """The shard of a row's phrase, as :func:`_shards_of` has it."""
    turned_ = F.lit(0).cast("long")
    for i, h in enumerate(_NUMBERS):
        turned_ = turned_.bitwiseXOR(F.shiftleft(h, i))
    return F.pmod(turned_, F.lit(shards).cast("long"))


def _shards_of(keys: list[np.ndarray], shards: int) -> np.ndarray:
    out = np.zeros(keys[0].size, np.int64)
    for i, k in enumerate(keys):
        out ^= (k << np.uint64(i)).view(np.int64)
    return out % shards


def _keys_in(rows) -> tuple[list[np.ndarray], np.ndarray]:
    return [rows[h].to_numpy().view(np.uint64) for h in _NUMBERS], rows["n"].to_numpy()


def _hash_shards(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((shard, slot, ...) of each candidate, (shard, body): the shards' hashes)."""

    def place(rows):
        made = PerfectHash(*_keys_in(rows))
        return rows.assign(slot=made.slots(*_keys_in(rows)))

    def pack(rows):
        import pandas as pd

        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "body": [PerfectHash(*_keys_in(rows)).packed()]})

    schema = ", ".join(f"{c} {kind}" for c, kind in candidates.dtypes)
    placed = materialize(candidates.groupBy("shard").applyInPandas(place, f"{schema}, slot long"))
    return placed, materialize(placed.select("shard", "n", *_NUMBERS).groupBy("shard").applyInPandas(pack, "shard long, body binary"))


#: A packed phrase: its words' numbers and how many, how often it occurs or a number that stands for who asks.
_PACKED = np.dtype([*((h, "<u8") for h in _NUMBERS), ("n", "<u1"), ("value", "<i8")])
_HASH, _COUNTS, _ASKED = 0, 1, 2


def _by_shard(keys: list[np.ndarray], n, values: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed phrases): rows of bounded size."""
    made = np.zeros(keys[0].size, _PACKED)
    for h, k in zip(_NUMBERS, keys, strict=False):
        made[h] = k
    made["n"], made["value"] = n, values
    shard = _shards_of([made[h] for h in _NUMBERS], shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        for a in range(edges[s], edges[s + 1], PACKED):
            yield s, made[order[a : min(a + PACKED, edges[s + 1])]].tobytes()


def _dealt(shard_rows: list[tuple[int, DataFrame]], asked: DataFrame, shards: int, spark) -> tuple[DataFrame, int]:
    """The shards' own rows, once for each of as many tasks as deal with a shard, before what is asked (shard, salt, body)."""
    tasks = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = -(-tasks // shards)
    rows = asked.select("shard", F.pmod("salt", F.lit(salts)).cast("long").alias("salt"), F.lit(_ASKED).alias("kind"), "body")
    for kind, own in shard_rows:
        rows = rows.unionByName(own.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(kind).alias("kind"), "body"))
    return rows.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind"), salts


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, PerfectHash, np.ndarray, np.ndarray | None]]:
    """(shard, salt, hash, counts by slot, what is asked); None at the end of a shard and salt."""
    at, table, counts = None, None, None
    for batch in batches:
        for shard, salt, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (shard, salt) != at:
                if at:
                    yield *at, table, counts, None
                at, table, counts = (shard, salt), None, None
            if kind == _HASH:
                table = PerfectHash.unpacked(body)
                counts = np.zeros(len(table), np.int64)
            elif kind == _COUNTS:
                slots, n = unpacked_counts(body)
                counts[slots] = n
            else:
                yield *at, table, counts, np.frombuffer(body, _PACKED)
    if at:
        yield *at, table, counts, None


def _counts(texts: DataFrame, filters: list[bytes], salt: int, hashes: DataFrame, shards: int) -> DataFrame:
    """(piece, body): how often each slot's phrase occurs, by shard."""
    spark = texts.sparkSession
    fixed = spark.sparkContext.broadcast(filters)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        task = TaskContext.get().partitionId()

        def flushed() -> Iterator[pa.RecordBatch]:
            keys = [np.concatenate([k[i] for k, _ in held]) for i in range(LONGEST)]
            n = np.concatenate([x for _, x in held])
            order, starts, times = _runs(turned(keys, n, 0), *keys, n)
            at = order[starts]
            found = list(_by_shard([k[at] for k in keys], n[at], times, shards))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([task] * len(found), pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["shard", "salt", "body"])

        for w in _taken(batches, salt):
            for n, at in enumerate(passing(w, fixed.value), 2):
                keys = _columns(w, at, n)
                held.append(([*keys, *[np.zeros(at.size, np.uint64)] * (LONGEST - n)], np.full(at.size, n)))
            if sum(x.size for _, x in held) >= HELD:
                yield from flushed()
                held = []
        if held:
            yield from flushed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, slot_salt, table, counts, asked in _answers(batches):
            if table is None:
                continue
            if asked is None:
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([slot_salt]), pa.array([packed_counts(np.arange(counts.size), counts)], pa.binary())], names=["piece", "task", "body"])
            else:
                slots = table.slots([asked[h] for h in _NUMBERS], asked["n"])
                met = slots >= 0
                counts += np.bincount(slots[met], asked["value"][met], counts.size).astype(np.int64)

    rows, salts = _dealt([(_HASH, hashes)], texts.mapInArrow(occurrences, "shard long, salt long, body binary"), shards, spark)
    with arrow_batches(spark, PACKED_BATCH):
        arrays = materialize(rows.mapInArrow(add, "piece long, task long, body binary"))
    return tree_sum(arrays, salts).select("piece", "body")


def _cuts(frequent: DataFrame, hashes: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """(id, k, right, part, f): the parts of each cut after k words, their ids and counts, read by slot."""
    spark = frequent.sparkSession

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def asked() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            n, ids = table["n"].to_numpy(), table["id"].to_numpy()
            keys = [table[h].to_numpy().view(np.uint64) for h in _NUMBERS]
            made = []
            for whole in range(2, LONGEST + 1):
                rows = np.flatnonzero(n == whole)
                for k in range(1, whole):
                    for right, part in ((0, range(k)), (1, range(k, whole))):
                        # Who asks: the phrase, the cut and the side.
                        padded = [keys[i][rows] for i in part] + [np.zeros(rows.size, np.uint64)] * (LONGEST - len(part))
                        made.append((padded, np.full(rows.size, len(part)), (ids[rows] << 4) + 2 * k + right))
            columns = [np.concatenate([m[0][i] for m in made]) for i in range(LONGEST)]
            found = list(_by_shard(columns, np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made]), shards))
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([task] * len(found), pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["shard", "salt", "body"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield from asked()
                held = []
        if held:
            yield from asked()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, table, counts_, asked in _answers(batches):
            if asked is not None:
                slots, who = table.slots([asked[h] for h in _NUMBERS], asked["n"]), asked["value"]
                if (slots < 0).any():
                    raise ValueError("a part of a frequent phrase is no candidate")
                yield pa.RecordBatch.from_arrays([pa.array(who >> 4), pa.array((who >> 1) & 7), pa.array(who & 1), pa.array((np.int64(shard) << 32) + slots), pa.array(counts_[slots])], names=["id", "k", "right", "part", "f"])

    rows, _ = _dealt([(_HASH, hashes), (_COUNTS, counts)], frequent.select("id", "n", *_NUMBERS).mapInArrow(ask, "shard long, salt long, body binary"), shards, spark)
    with arrow_batches(spark, PACKED_BATCH):
        return materialize(rows.mapInArrow(answer, "id long, k long, right long, part long, f long"))


def _read(counts: DataFrame) -> DataFrame:
    """(shard, slot, f) of count arrays (piece, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slots, n = unpacked_counts(body)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(slots.size, shard, np.int64)), pa.array(slots.astype(np.int64)), pa.array(n)], names=["shard", "slot", "f"])

    return counts.mapInArrow(run, "shard long, slot long, f long")


def _with_words(counts: DataFrame, placed: DataFrame) -> DataFrame:
    """Counts with those of the words, which are known: (shard, body)."""

    def pack(rows):
        import pandas as pd

        rows = rows.sort_values("slot")
        return pd.DataFrame({"piece": [rows["shard"].iloc[0]], "task": [1], "body": [packed_counts(rows["slot"].to_numpy(), rows["known"].to_numpy())]})

    own = placed.where("n = 1").select("shard", "slot", "known").groupBy("shard").applyInPandas(pack, "piece long, task long, body binary")
    both = counts.select("piece", F.lit(0).cast("long").alias("task"), "body").unionByName(own)
    return tree_sum(both, 2).select(F.col("piece").alias("shard"), "body")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases that no longer one covers."""
    texts = texts_of(docs)
    tasks = docs.rdd.getNumPartitions()
    words, salt = count_words(texts)
    totals = words.groupBy("lang").agg(F.sum("known").alias("total"))
    filters = [_word_filter(words, min_count)]
    for _ in ("pairs", "longer phrases"):
        filters.append(_count_filter(_counters(texts, filters, salt), tasks, min_count))
    zero = F.lit(0).cast("long")
    single = words.where(F.col("known") >= min_count).select(F.lit(1).cast("long").alias("n"), "h0", *(zero.alias(h) for h in _NUMBERS[1:]), "lang", "phrase", "known")
    found = materialize(_candidates(texts, filters, salt).withColumn("known", zero).unionByName(single))
    shards = max(1, -(-found.count() // SHARD))
    placed, hashes = _hash_shards(found.withColumn("shard", _shard(shards)))
    counts = materialize(_with_words(_counts(texts, filters, salt, hashes, shards), placed))
    frequent = placed.join(_read(counts), ["shard", "slot"]).where(F.col("f") >= min_count)
    frequent = materialize(frequent.select((F.shiftleft("shard", 32) + F.col("slot")).alias("id"), "n", *_NUMBERS, "lang", "phrase", F.col("f").alias("a")))
    parts = _cuts(frequent.where("n > 1"), hashes, counts, shards)
    own = frequent.where("n > 1").select("id", "n", "a")
    side = lambda right: F.max(F.when(F.col("right") == right, F.col("f")))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = parts.groupBy("id", "k").agg(side(0).alias("l"), side(1).alias("r")).join(own, "id")
    cut = cut.withColumn("score", F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = cut.groupBy("id").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # A phrase inside one two words longer is inside one a word longer as well, which occurs no less often.
    inside = ((F.col("right") == 0) & (F.col("k") == F.col("n") - 1)) | ((F.col("right") == 1) & (F.col("k") == 1))
    gone = parts.join(own, "id").where((F.col("n") > 2) & inside & (wide("a") * 100 >= wide("f") * covered)).select(F.col("part").alias("id")).distinct()
    kept = frequent.where("n > 1").join(gone, "id", "left_anti").join(best, "id").join(totals, "lang")
    return kept.select("lang", "phrase", "a", "c.l", "c.r", F.col("total").alias("n"), "c.score")


def top_collocations(docs: DataFrame, top: int = TOP, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return collocations(docs, **how).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, m AS k, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase FROM w, range(1, {LONGEST + 1}) t(m), range(1, len(ws) - m + 2) u(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
x AS (SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score
      FROM c, range(1, c.k) t(j) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(ws, 1, j), ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(ws, j + 1, c.k), ' ')
      QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
b AS (SELECT c.lang, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase, max(a) AS a FROM c, range(2, k) t(m), range(1, k - m + 2) u(i) GROUP BY ALL)
SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, x.a DESC, x.phrase) AS rank, x.phrase, x.a, l, r, n, score
FROM x JOIN n USING (lang) LEFT JOIN b ON b.lang = x.lang AND b.phrase = x.phrase WHERE b.a IS NULL OR 100 * b.a < {COVERED} * x.a
QUALIFY rank <= {TOP}
"""
