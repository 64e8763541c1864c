"""Shared pieces of the training-data operators: storage, table loading and vectorised word hashing.

Words are maximal runs of bytes other than space and 0x09-0x0D in the UTF-8 text.  Word and n-gram
hashes are polynomial sums modulo 2**64 with odd bases, finished by a mixer; all of them are
computed on whole Arrow batches with numpy, in byte blocks of bounded size.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts are long, so batches are kept small.
BATCH_ROWS = 256
#: Bytes of text hashed at a time.
BLOCK_BYTES = 1 << 21

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, set to a temporary one only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="treedelta-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/treedelta-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, narrow: bool = False) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back.

    A table of few and narrow rows is dealt to no more tasks than the cluster runs at once twice over, for each file
    costs several calls of the file system however few rows it has.  It is dealt by a shuffle, since coalesced
    tasks would hold the sorters of all joins that they take in.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    out = df.repartition(2 * spark.sparkContext.defaultParallelism) if narrow else df
    out.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that carry whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@cache
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim, or what does nothing where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Return memory that was freed to the system.

    Python workers stay between tasks, and allocators keep what a task has freed: 100 to 150 MB of a worker here.
    """
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function for mapInArrow that gives memory back when it has ended."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def aside(df: DataFrame, names: list[str]) -> tuple[list, list]:
    """Columns under names that clash with no others, and their way back; unused ones are pruned as usual."""
    out = [df[f"`{c}`"].alias(f"td_kept_{i}") for i, c in enumerate(names)]
    return out, [F.col(f"td_kept_{i}").alias(c) for i, c in enumerate(names)]


def named(names: list[str]) -> list:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{c}`") for c in names]


def text_key(column: str):
    """128 bits that stand for a text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1024)
            grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, dtype=np.uint64))])
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(0xC2B2AE3D27D4EB4F)


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hashes of values[start:end] for many ranges by one prefix sum."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def _block_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one block, which neither starts nor ends inside a word."""
    black = ~_WHITE[data]
    edge = np.diff(black.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = (ends - starts).astype(np.uint64)
    return mix(_range_hashes(_BYTE_VALUES[data], starts, ends, _BYTES) + lengths * np.uint64(_BASE))


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of one text, block by block; null is the empty text."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    if len(text) <= BLOCK_BYTES:
        return _block_words(np.frombuffer(text, dtype=np.uint8))
    data, parts, at = np.frombuffer(text, dtype=np.uint8), [], 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        while end < len(data) and not _WHITE[data[end]]:
            ahead = np.flatnonzero(_WHITE[data[end : end + 4096]])
            end = end + int(ahead[0]) if len(ahead) else min(end + 4096, len(data))
        parts.append(_block_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def batch_word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of an Arrow array one after another, and the n + 1 offsets of each text's words."""
    texts = texts.cast(pa.large_binary())
    raw = [x.as_py() for x in texts] if texts.nbytes > 8 * BLOCK_BYTES else None
    if raw is not None:
        each = [word_hashes(x) for x in raw]
    else:
        # One pass over the joined bytes; a space between texts keeps their words apart.
        joined = b" ".join(x.as_py() or b"" for x in texts)
        data = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.array([len(x.as_py() or b"") for x in texts], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        black = ~_WHITE[data]
        edge = np.diff(black.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts = np.flatnonzero(edge == 1)
        return word_hashes(joined), np.searchsorted(starts, begins)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return (np.concatenate(each) if each else np.zeros(0, np.uint64)), offsets


_GRAM = [pow(_BASE, 2 * j + 3, 1 << 64) | 1 for j in range(64)]


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive words; the order of the words counts."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    if n <= 8:
        total = np.zeros(count, dtype=np.uint64)
        for j in range(n):
            total += words[j : j + count] * np.uint64(_GRAM[j])
    else:
        starts = np.arange(count)
        total = _range_hashes(words, starts, starts + n, _WORDS)
    return mix(total + np.uint64((seed * _BASE + n) & _MASK))


def int64(values: np.ndarray) -> np.ndarray:
    """The same bits as signed values, for Spark's long."""
    return values.view(np.int64)


# --- a count-min sketch of two rows, of which one bit per cell is left: two or more ---

#: Cells are added up in blocks of this many bits.
BLOCK_BITS = 18
#: Cells that a partition holds before it sends what it has counted; below 32 MB.
FLUSH_CELLS = 500_000
SKETCH_SCHEMA = "block int, once binary, more binary"
_SECOND = np.uint64(0xA0761D6478BD642F)


def cells(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each value in both rows."""
    shift = np.uint64(64 - bits)
    return (mix(values) >> shift).astype(np.int64), (mix(values ^ _SECOND) >> shift).astype(np.int64)


def sketch_rows(held: list[list[np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """One partition's counts: in each block of both rows the cells seen once, and more often."""
    block_bits = min(bits, BLOCK_BITS)
    blocks = 1 << (bits - block_bits)
    for row, parts in enumerate(held):
        cell, n = np.unique(np.concatenate(parts), return_counts=True)
        edges = np.searchsorted(cell, np.arange(blocks + 1) << block_bits)
        full = np.flatnonzero(np.diff(edges))
        inside = (cell & ((1 << block_bits) - 1)).astype("<u4")
        pick = lambda a, b, which: inside[a:b][which[a:b]].tobytes()
        lists = [[pick(edges[i], edges[i + 1], which) for i in full] for which in (n == 1, n > 1)]
        yield pa.RecordBatch.from_arrays([pa.array(full + row * blocks, pa.int32()), *[pa.array(x, pa.binary()) for x in lists]], names=["block", "once", "more"])


def merged_sketch(parts: DataFrame, bits: int) -> list[np.ndarray]:
    """The bits of cells with two or more counts over all partitions, for both rows; 2 ** bits / 8 bytes each."""
    block_bits = min(bits, BLOCK_BITS)
    blocks = 1 << (bits - block_bits)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << block_bits, dtype=np.uint8)
        for batch in batches:
            for once, more in zip(batch.column("once").to_pylist(), batch.column("more").to_pylist(), strict=True):
                at = np.frombuffer(once, dtype="<u4")
                counts[at] = np.minimum(counts[at], 1) + 1
                counts[np.frombuffer(more, dtype="<u4")] = 2
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())})

    rows = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(2)]
    width = (1 << block_bits) // 8
    for found in parts.groupBy("block").applyInArrow(add, "block int, bits binary").toLocalIterator():
        row, at = divmod(found["block"], blocks)
        rows[row][at * width : (at + 1) * width] = np.frombuffer(found["bits"], dtype=np.uint8)
    return rows


def seen_twice(rows: list[np.ndarray], values: np.ndarray, bits: int) -> np.ndarray:
    """The estimated count of each value is two or more; never false for a value that was counted twice."""
    hit = np.ones(len(values), dtype=bool)
    for row, at in zip(rows, cells(values, bits), strict=True):
        hit &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


class UnitTable:
    """unit -> bytes in two generations: when the young one is full it becomes the old one, and what is still in use moves over.

    make gives the bytes of a list of units; units beyond `long` characters aren't kept.
    """

    def __init__(self, make, most: int, long: int) -> None:
        self.make, self.most, self.long = make, most, long
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, units: set[str]) -> dict[str, bytes]:
        """A table that holds all of these units."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        missing = [u for u in units if u not in self.young]
        new = [u for u in missing if u not in self.old]
        self.young.update((u, self.old[u]) for u in missing if u in self.old)
        made = dict(zip(new, self.make(new), strict=True)) if new else {}
        over = {u: x for u, x in made.items() if len(u) > self.long}
        self.young.update((u, x) for u, x in made.items() if u not in over)
        return {u: over[u] if u in over else self.young[u] for u in units} if over else self.young
