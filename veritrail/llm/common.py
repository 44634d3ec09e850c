"""What several operators share: hashing in numpy, and Arrow helpers for work inside tasks."""

from __future__ import annotations

import ctypes
import gc
import zlib
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = 0x9E3779B97F4A7C15


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, so that their order is as good as random."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of ``k`` symbols, in a logarithmic number of passes."""
    n = symbols.size - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, length = None, 0
    power, width, block = _ODD, 1, symbols
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            # Powers of the multiplier wrap at 64 bits by intent.
            part = block[length : length + n]
            total = part if total is None else total * np.uint64(power) + part
            length += width
        if k >> (bit + 1):
            block = block[:-width] * np.uint64(power) + block[width:]
            power = power * power & 0xFFFFFFFFFFFFFFFF
            width *= 2
    return mix64(total)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def byte_table() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


#: Rows of an Arrow batch of texts, at most.
TEXT_BATCH = 1_000


def bound_text_batches(spark) -> None:
    """Have the session send texts to Python in smaller batches than its default of 10,000 rows, since those are
    held whole on both sides. Plans are made when they run, so the setting stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))


@contextmanager
def arrow_batches(spark, rows: int) -> Iterator[None]:
    """Fewer rows in each Arrow batch, for jobs started inside whose rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_held: dict = {}
#: Parameters of glibc's mallopt, and their values: large blocks are mapped, and so go back to the system when freed.
_MALLOPT = {-3: 1 << 20, -1: 1 << 20, -8: 2}


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and an executor has several."""
    gc.collect()
    pa.set_memory_pool(pa.system_memory_pool())
    with suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        for what, value in _MALLOPT.items():
            libc.mallopt(what, value)
        libc.malloc_trim(0)


def worker_cache(key, make: Callable[[], object]):
    """What this Python worker keeps for one operator. Another operator's goes first, so that caches don't add up."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


class WordTable(dict):
    """Numbers for each word, worked out once for a word that a Python worker meets, and forgotten at ``limit`` words or
    ``most`` bytes of them."""

    def __init__(self, make: Callable[[bytes], tuple], codes: str, limit: int = 150_000, most: int = 24 << 20) -> None:
        self.make, self.codes, self.limit, self.most, self.size = make, codes, limit, most, 0
        self.columns = [array(c) for c in codes]

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.size += len(word)
        for column, value in zip(self.columns, self.make(word), strict=True):
            column.append(value)
        return place

    def look(self, words: list[bytes]) -> list[np.ndarray]:
        """An array for each number, over ``words``."""
        if len(self) > self.limit or self.size > self.most:
            self.clear()
            self.size = 0
            self.columns = [array(c) for c in self.codes]
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return [np.frombuffer(column, column.typecode)[places] for column in self.columns]


#: Counters of a chunk of a table of counts, and chunks that one task adds up.
CHUNK, FAN_IN = 1 << 16, 64
COUNTS_SQL = "chunk int, slot long, counts binary"


def count_chunks(table: np.ndarray, slot: int) -> list[tuple[int, int, bytes]]:
    """The chunks (chunk, slot, counts) of a task's table of counts (rows of counters) that have any."""
    parts = table.reshape(table.shape[0], -1, CHUNK).swapaxes(0, 1)
    return [(c, slot, zlib.compress(part.astype(np.int64).tobytes(), 1)) for c, part in enumerate(parts) if part.any()]


def summed_chunks(parts: DataFrame, tasks: int) -> DataFrame:
    """Sums of the chunks (chunk, slot, counts) of ``tasks`` tasks, as a tree: no task adds more than FAN_IN of one chunk."""

    def add(rows):
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(raw), np.int64) for raw in rows["counts"])
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "slot": [rows["slot"].iloc[0] // FAN_IN], "counts": [zlib.compress(total.tobytes(), 1)]})

    while True:
        parts = parts.groupBy("chunk", F.floor(F.col("slot") / FAN_IN).alias("__slot")).applyInPandas(add, COUNTS_SQL)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return parts


def unpacked(chunks, rows: int = 1) -> Iterator[tuple[slice, np.ndarray]]:
    """(place, counts (rows x CHUNK)) of collected chunks (chunk, slot, counts), one at a time; a table's size doesn't
    depend on the corpus, and compressed it is small."""
    for chunk, _, raw in chunks:
        yield slice(chunk * CHUNK, (chunk + 1) * CHUNK), np.frombuffer(zlib.decompress(raw), np.int64).reshape(rows, CHUNK)


#: Bits of a piece of a filter (a power of two).
PIECE_BITS = 18


def set_bits(slots: np.ndarray) -> bytes:
    """A piece of a filter with these bits, compressed."""
    bits = np.zeros(1 << PIECE_BITS, bool)
    bits[slots] = True
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def assembled(pieces: DataFrame, bits: int) -> bytes:
    """The filter of 2 ** ``bits`` bits that (piece, body) rows make up."""
    out = np.zeros(1 << bits >> 3, np.uint8)
    for piece, body in pieces.select("piece", "body").collect():
        out[piece << PIECE_BITS >> 3 : (piece + 1) << PIECE_BITS >> 3] = np.frombuffer(zlib.decompress(body), np.uint8)
    return out.tobytes()


def bit_filter(slots: DataFrame, bits: int) -> bytes:
    """A filter of 2 ** ``bits`` bits with those of ``slots`` (slot): bit ``slot & 7`` from the left of byte ``slot >> 3``."""

    def pack(rows):
        import pandas as pd

        return pd.DataFrame({"piece": [rows["slot"].iloc[0] >> PIECE_BITS], "body": [set_bits(rows["slot"].to_numpy() & ((1 << PIECE_BITS) - 1))]})

    return assembled(slots.distinct().groupBy(F.shiftright("slot", PIECE_BITS).alias("p")).applyInPandas(pack, "piece long, body binary"), bits)
