"""Helpers that the corpus operators share: written tables, hot groups, and text hashing in Arrow batches.

Written tables go to the folder that the cluster names in ``spark.checkpoint.dir``; every executor
reaches it, so a lost executor costs a re-run of its tasks and nothing else.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.session import shuffles_dropped

#: A group is hot when it holds more than 1 / HOT_SHARE of all rows, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


# ---------------------------------------------------------------- written tables

def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one is made only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lotweave-shared-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/lotweave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut of the lineage with known sizes.

    Nothing reads the write's shuffles again, so their files go when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(table: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    spark = table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- hot groups

def same(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Null-safe equality of ``keys``, usable as a sort-merge join key."""
    test = None
    for k in keys:
        one = left[k].eqNullSafe(right[k])
        test = one if test is None else test & one
    return test


def lookup(rows: DataFrame, groups: DataFrame, keys: Sequence[str], values: Sequence[str], size: str, total: int) -> DataFrame:
    """``rows`` with the ``values`` of their group; no group lands whole in one task.

    ``groups`` has one row per key and the group's row count in ``size``. Groups over 1/1000 of
    ``total`` rows, fewer than a thousand by that definition, are broadcast; the rest meet in an
    ordinary join, where no key holds more than a thousandth of the rows.
    """
    line = max(1, total // HOT_SHARE)
    named = {f"_g_{c}": F.col(c) for c in (*keys, *values)}
    hot = F.broadcast(groups.filter(F.col(size) > line).select(*[c.alias(n) for n, c in named.items()], F.lit(True).alias("_hot")))
    cold = groups.filter(F.col(size) <= line).select(*[c.alias(n) for n, c in named.items()])

    def on(df, other):
        test = None
        for k in keys:
            one = df[k].eqNullSafe(other[f"_g_{k}"])
            test = one if test is None else test & one
        return test

    first = rows.join(hot, on(rows, hot), "left")
    out = [*[F.col(c) for c in rows.columns], *[F.col(f"_g_{c}").alias(c) for c in values]]
    in_hot = first.filter(F.col("_hot")).select(*out)
    rest = first.filter(F.col("_hot").isNull()).select(*rows.columns)
    return in_hot.unionByName(rest.join(cold, on(rest, cold)).select(*out))


# ---------------------------------------------------------------- Arrow batches

#: Python works on at most about so many bytes of text at a time, but always on whole texts.
SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch that Python works on at a time where each row grows in the work.
PIECE_ROWS = 250


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, at most ``rows`` to a batch."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def give_back() -> None:
    """Return the freed memory of this Python worker, which Spark keeps for later tasks, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone keeps freed pages
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, with the worker's freed memory given back when a task ends."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as Arrow strings; null becomes the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_string())
    return column.fill_null("")


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``most`` bytes together."""
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1, offset=column.offset * 8)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


# ---------------------------------------------------------------- hashing

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(33))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", _R), ("down", _RINV)):
            run = np.full(size, base, dtype=np.uint64)
            run[0] = 1
            _POWERS[name] = np.multiply.accumulate(run)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def byte_table(word_bytes: Sequence[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(word_bytes)] = True
    return table


#: Bytes of words that white space separates: all but space and 0x09-0x0D.
NOT_SPACE = byte_table([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])
#: Bytes of words of lower-cased letters, digits and everything outside ASCII.
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def hash_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of lower-cased texts, and how many words each text has.

    A polynomial prefix sum over the bytes gives every word's hash without a loop over words.
    """
    n, docs = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    low = _LOWER[data]
    inside = word[low]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    head[cuts] = inside[cuts]  # a text's first byte begins a word, whatever ended the text before
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    tail[cuts[1:] - 1] = inside[cuts[1:] - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[low] * up, out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    counts = np.diff(np.searchsorted(start, offsets))
    return hashes, counts


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for j in range(k):
        total = total * np.uint64(0x9FB21C651E98DF25) + words[j:j + n]
        total ^= total >> np.uint64(29)
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column out of one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
