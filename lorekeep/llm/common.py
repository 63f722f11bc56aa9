"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII characters, which
#: are also exactly the characters that ``bytes.split()`` splits on.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text handled at once inside a Python worker.
CHUNK_BYTES = 8 << 20

#: Partitions that a shuffle is asked for at most; beyond, a task gets several groups, one after the other.
MOST_TASKS = 1 << 16

#: Entries after which a per-worker word cache starts afresh.
CACHE_ENTRIES = 400_000

_made: list[tuple[SparkSession, str]] = []
_tops: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    The setting is read from the session.  Only where it is unset and the
    master is this very process (tests, a laptop) is a temporary folder of this
    machine used; on a cluster that is an error.  Folders are deleted when the
    driver ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or _local_top(spark)
    path = f"{top.rstrip('/')}/lorekeep-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    return path


def _local_top(spark: SparkSession) -> str:
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _tops:
        _tops.append(tempfile.mkdtemp(prefix="lorekeep-"))
    return _tops[0]


def _remove_all() -> None:
    for top in _tops:
        shutil.rmtree(top, ignore_errors=True)
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has gone already
            return
    _made.clear()


def release(spark: SparkSession) -> None:
    """Give back the shuffle files of finished steps: Spark removes them once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Shuffle files of earlier, finished steps are given back first.
    """
    release(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tasks_for(groups: int) -> int:
    """A partition for each group, within bounds."""
    return max(8, min(groups, MOST_TASKS))


_lean: list[bool] = []


def lean_memory() -> None:
    """In a worker: memory of large arrays goes back to the system as soon as they are freed.

    Else the C library keeps it for later, in each worker of an executor.
    """
    if not _lean:
        _lean.append(True)
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        except (OSError, AttributeError):  # another C library
            pass
    pa.default_memory_pool().release_unused()


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        lean_memory()
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The column's values as UTF-8 bytes, without decoding."""
    c = batch.column(column)
    return c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = h
        return h


_hashes = WordHashes()


def worker_hashes() -> WordHashes:
    """The word hashes that this process has remembered so far."""
    return _hashes


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        table = np.empty(size, dtype=np.uint64)
        table[0] = 1
        done = 1
        while done < size:  # doubling: base**(done + i) = base**done * base**i
            step = np.uint64(pow(int(base), done, 1 << 64))
            more = min(done, size - done)
            table[done : done + more] = table[:more] * step
            done += more
        _powers[name] = have = table
    return have


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * B**i`` modulo 2**64, with a leading 0."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * _power_table(_BASE, len(values) + 1, "base")[: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:stop]`` for each pair, free of the position."""
    inverse = _power_table(_INVERSE, len(prefix), "inverse")
    return mix((prefix[stop] - prefix[start]) * inverse[start])


def sliding_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive values."""
    n = len(prefix) - k
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    return mix((prefix[k:] - prefix[:n]) * _power_table(_INVERSE, len(prefix), "inverse")[:n])


def sliding_leftmost_min(hashes: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of each ``w`` consecutive hashes.

    The choice depends on what the window holds alone, so equal windows
    choose the same offset.
    """
    n = len(hashes) - w + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    low = np.uint64((1 << 24) - 1)
    index = np.arange(len(hashes), dtype=np.uint64)
    assert len(hashes) <= 1 << 24
    key = (hashes & ~low) | index
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: n], key[w - span : w - span + n])
    return (key[:n] & low).astype(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays, by planes of bytes, compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()) for a in arrays]
    return b"".join(x for p, a in zip(parts, arrays) for x in (np.array([len(p), len(a), a.itemsize], "<u4").tobytes(), p))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at, free = [], 0, zstandard.ZstdDecompressor()
    for kind in kinds:
        size, n, wide = np.frombuffer(data, "<u4", 3, at).tolist()
        planes = free.decompress(data[at + 12 : at + 12 + size], max_output_size=max(1, n * wide)) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(wide, n).T).view(kind).reshape(-1) if n else np.empty(0, kind))
        at += 12 + size
    return out
