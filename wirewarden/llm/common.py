"""Shared helpers: reading, words and their hashes, checkpoints, and bounded membership filters."""

from __future__ import annotations

import ctypes
import math
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Freed batches go back to the system at once: a worker that is kept for the next task holds no memory of the last one.
pa.set_memory_pool(pa.system_memory_pool())
#: So do freed arrays of this many bytes and more. The C library would else raise that bound up to 32 MB with what it is given back, and keep what is below.
FREED_AT_ONCE = 4 << 20


def free_at_once() -> bool:
    """Sets glibc's bounds M_MMAP_THRESHOLD (-3) and M_TRIM_THRESHOLD (-1) for this process; another C library is left as it is."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    return mallopt is not None and bool(mallopt(-3, FREED_AT_ONCE) and mallopt(-1, 2 * FREED_AT_ONCE))


free_at_once()

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, named in spark.checkpoint.dir. Only a local session (tests) may go without and gets a temporary one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Spark's own setting, off by default: an action's shuffle files are deleted when it has ended.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run within are deleted as each action ends. For actions that write into the shared folder: what reads their
    files needs the shuffle no more, whatever executor is lost."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def remainder(column: str, by: int) -> Column:
    """crc32 of the column as text, modulo `by`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def hot_join(left: DataFrame, right: DataFrame, on: str, total: int) -> DataFrame:
    """left with the columns of right (one row a key; null where there is none). right's `_rows`, which is dropped, says how many rows of left have
    the key, `total` how many there are in all. Keys with more than a 10,000th of the rows, of which there can't be 10,000, are broadcast;
    only the rows of the others are shuffled."""
    hot = F.col("_rows") > max(1, total // 10_000)
    columns = [c for c in right.columns if c not in (on, "_rows")]
    known = left.join(F.broadcast(right.filter(hot).withColumn("_hot", F.lit(True)).drop("_rows")), on, "left")
    rest = known.filter(F.col("_hot").isNull()).select(*left.columns).join(right.filter(~hot).drop("_rows"), on, "left")
    return known.filter(F.col("_hot")).select(*left.columns, *columns).union(rest.select(*left.columns, *columns))


def key_array(ids: pa.Array) -> np.ndarray:
    """Integer ids as 64-bit keys; nulls are 0."""
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)


# --- words -----------------------------------------------------------------------------------------------------------


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


#: Bytes that are turned into arrays at once.
PIECE = 1 << 17
_IS_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_CUTS = np.array([0 if b >= 128 or _IS_SPACE[b] else 1 if chr(b).isalpha() else 3 if b == 0x27 else 2 for b in range(256)], dtype=np.uint8)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a string column: 64-bit hashes and byte positions of all rows one after the other.

    Row r has words bounds[r] .. bounds[r + 1]; a null row has none. With lower, A-Z count as a-z; with bare
    accented Latin letters do not differ by case either, and ASCII punctuation parts words too. With cut a new word also starts where ASCII
    letters and other ASCII characters meet, but not after an apostrophe.
    """

    def __init__(self, column: pa.Array, lower: bool = False, bare: bool = False, cut: bool = False):
        column = column.cast(pa.large_binary())
        n = len(column)
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        table = _BYTE_LOWER if lower or bare else _BYTE
        self.parts = _IS_SPACE | _IS_MARK if bare else _IS_SPACE
        hashes, starts, ends = [], [], []
        lo, end = int(self.offsets[0]), int(self.offsets[-1])
        breaks = self.offsets[(self.offsets > lo) & (self.offsets < end)]
        while lo < end:
            hi = self._cut(lo, min(lo + PIECE, end), end, breaks)
            part = self.data[lo:hi]
            space = self.parts[part]
            word = np.concatenate([[False], ~space, [False]])
            first, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
            if cut:
                kind = _CUTS[part]
                at = np.flatnonzero(((kind[:-1] == 1) & (kind[1:] >= 2)) | ((kind[:-1] == 2) & (kind[1:] == 1)))
                first[at + 1], last[at] = True, True
            inner = breaks[np.searchsorted(breaks, lo, side="right") : np.searchsorted(breaks, hi)] - lo
            first[inner] = ~space[inner]
            last[inner - 1] = ~space[inner - 1]
            a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
            powers, inverses = _power_tables(len(part))
            codes = table[part]
            if bare:  # U+00C0 to U+00DE but U+00D7: C3 80 to C3 9E, the small letters 32 further
                capital = np.flatnonzero((part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] < 0x9F) & (part[1:] != 0x97)) + 1
                codes[capital] = _BYTE[part[capital] + 0x20]
            sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(codes * powers, dtype=U64)])
            hashes.append(mix((sums[b] - sums[a]) * inverses[a] + (b - a).astype(U64)))
            starts.append(a + lo)
            ends.append(b + lo)
            lo = hi
        self.hashes = np.concatenate([np.zeros(0, dtype=U64), *hashes])
        self.starts = np.concatenate([np.zeros(0, dtype=np.int64), *starts])
        self.ends = np.concatenate([np.zeros(0, dtype=np.int64), *ends])
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def _cut(self, lo: int, hi: int, end: int, breaks: np.ndarray) -> int:
        """Where a piece may end: no word is cut in two."""
        if hi >= end:
            return end
        near = breaks[np.searchsorted(breaks, hi, side="right") - 1] if len(breaks) and breaks[0] <= hi else lo
        if near > lo:
            return int(near)
        while hi < end:
            gap = np.flatnonzero(self.parts[self.data[hi : hi + PIECE]])
            following = breaks[np.searchsorted(breaks, hi) :][:1]
            at = min([hi + int(g) for g in gap[:1]] + [int(x) for x in following if x <= hi + PIECE] or [end + 1])
            if at <= end:
                return max(at, lo + 1)
            hi += PIECE
        return end

    def row(self, r: int) -> np.ndarray:
        return self.hashes[self.bounds[r] : self.bounds[r + 1]]

    def grams(self, k: int) -> Callable[[int], np.ndarray]:
        """A function that gives the hashes of a row's runs of k words."""
        made, bounds = rolling(self.hashes, k), self.bounds
        return lambda r: made[bounds[r] : max(bounds[r], bounds[r + 1] - k + 1)]

    def text(self, start: int, end: int) -> bytes:
        """The bytes from word start up to word end."""
        return self.data[self.starts[start] : self.ends[end - 1]].tobytes() if end > start else b""


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]])]


_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.concatenate([np.ones(1, dtype=U64), np.cumprod(np.full(size - 1, _BASE, dtype=U64), dtype=U64)])
        _inverses = np.concatenate([np.ones(1, dtype=U64), np.cumprod(np.full(size - 1, _BASE_INVERSE, dtype=U64), dtype=U64)])
    return _powers[:n], _inverses[:n]


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k words: a polynomial modulo 2^64 from one running sum."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    powers, inverses = _power_tables(len(hashes))
    sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(hashes * powers, dtype=U64)])
    return mix((sums[k:] - sums[:-k]) * inverses[:n] + U64(k))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], rows: int = 10_000):
    """A mapInArrow function whose state lives as long as the task and that sees at most so many rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                yield from step(batch.slice(lo, rows))

    return run


# --- membership filters ----------------------------------------------------------------------------------------------

#: Bits of a segment; a key's bits all lie in one segment, so that segments are built apart from each other.
SEGMENT_BITS = 1 << 20


class SegmentedFilter:
    """A blocked Bloom filter over (64-bit key, level); see `build_filter`."""

    def __init__(self, bits: np.ndarray, probes: int):
        self.bits, self.probes = bits, probes
        self.segments = max(1, len(bits) * 8 // SEGMENT_BITS)

    def contains(self, keys: np.ndarray, level: int = 1) -> np.ndarray:
        found = np.arange(len(keys))
        for r in range(self.probes):  # what a probe rules out needs no further one
            own = keys[found]
            at = segment_of(own, self.segments) * U64(SEGMENT_BITS) + offset_of(own, level, r)
            found = found[(self.bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), dtype=bool)
        out[found] = True
        return out

    def levels(self, keys: np.ndarray, most: int) -> np.ndarray:
        """The highest level up to which each key is held (0: not at all)."""
        out, alive = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        for level in range(1, most + 1):
            alive = alive[self.contains(keys[alive], level)]
            if not len(alive):
                break
            out[alive] = level
        return out


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mix(keys) >> U64(24)) % U64(segments)


def offset_of(keys: np.ndarray, level: int, probe: int) -> np.ndarray:
    salt = (level * 64 + probe + 1) * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(keys ^ U64(salt)) & U64(SEGMENT_BITS - 1)


def build_filter(keys: DataFrame, n_events: int, *, bits_per_event: float, probes: int, max_bytes: int) -> SegmentedFilter:
    """A filter of the rows (key long[, level int]); an event is one (key, level up to the row's level).

    Segments are made on the executors, each by one task from the keys that fall into it, and only their bits come to
    the driver: at most max_bytes, whatever the number of keys. Beyond that the rate of false positives rises instead.
    """
    segments = max(1, min(max_bytes * 8 // SEGMENT_BITS, math.ceil(n_events * bits_per_event / SEGMENT_BITS)))
    if "level" not in keys.columns:
        keys = keys.withColumn("level", F.lit(1))

    def with_segment(batches):
        for b in batches:
            h = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(h, segments).astype(np.int32)), b.column("key"), b.column("level")], ["segment", "key", "level"])

    def fill(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            seg = b.column("segment").to_numpy()
            h = b.column("key").to_numpy().view(U64)
            level = b.column("level").to_numpy()
            for s in np.unique(seg):
                bits = made.setdefault(int(s), np.zeros(SEGMENT_BITS, dtype=bool))
                own, top = h[seg == s], level[seg == s]
                for j in range(1, int(top.max()) + 1):
                    for r in range(probes):
                        bits[offset_of(own[top >= j], j, r)] = True
        for s, bits in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    keyed = keys.filter(F.col("key").isNotNull()).select(F.col("key").cast("long"), F.col("level").cast("int"))
    rows = keyed.mapInArrow(with_segment, "segment int, key long, level int").repartition("segment").mapInArrow(fill, "segment int, bits binary")
    out = np.zeros(segments * SEGMENT_BITS // 8, dtype=np.uint8)
    for row in rows.collect():
        at = row.segment * SEGMENT_BITS // 8
        out[at : at + SEGMENT_BITS // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return SegmentedFilter(out, probes)


def id_filter(ids: DataFrame, column: str, max_bytes: int = 32 << 20) -> SegmentedFilter:
    """A filter of integer ids, to thin a table before an exact join with them."""
    keys = ids.select(F.col(column).cast("long").alias("key"))
    return build_filter(keys, ids.count(), bits_per_event=12, probes=4, max_bytes=max_bytes)


def exclude(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of docs whose id is not among ids (a null id is not). Rows that a filter of the ids rules out are kept as they
    are; only the others, the ids' own rows and a few more, are shuffled to an exact join."""
    held = docs.sparkSession.sparkContext.broadcast(id_filter(ids, column))

    def part(among: bool):
        def run(batches):
            for b in batches:
                own = b.column(column)
                hit = held.value.contains(key_array(own)) & own.is_valid().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == among))
        return run

    kept = docs.mapInArrow(part(False), docs.schema)
    return kept.union(docs.mapInArrow(part(True), docs.schema).join(ids.select(column), column, "left_anti").select(docs.columns))
