"""Helpers that the training-data operators share: shared storage, byte kernels, table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a session on one machine gets a folder of its own; on a
    cluster that is an error, since executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_folder()
    return found.rstrip("/")


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, a finished query drops its shuffle files at once: what it gave is in the shared folder or in the driver."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs one re-read.

    The tables of a job stay until the shared folder is cleared: results that are
    read later may still depend on them.
    """
    path = shared_path(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path for tasks that read or write files of the shared folder; file: and file:/// name the same folder."""
    return fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def partitions(spark: SparkSession) -> int:
    """How many parts keyed work is split into; it follows the session's setting, so it grows with the cluster's input."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out_rest(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def values(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying the text; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text is about `limit` bytes at most; a single longer text makes a slice of its own."""
    _, offsets = values(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_LEFT, _RIGHT, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA24BAED4963EE407)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _SIZE)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One value for each ordered pair. The shift between the products keeps it from being a polynomial, so no family of texts collides by algebra."""
    x = a * _LEFT
    x += b
    x ^= x >> np.uint64(32)
    x *= _RIGHT
    x ^= x >> np.uint64(29)
    return x


def gram_hash(tokens: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n tokens, by pairs of hashes of half the length (the two halves overlap where n is no power of two)."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    level, width = tokens, 1
    while width * 2 <= n:
        level, width = _pair(level[:-width], level[width:]), width * 2
    if width < n:
        level = _pair(level[: len(level) - (n - width)], level[n - width :])
    return mix64(level + np.uint64(n * int(_SIZE) % 2**64))


def span_hash(tokens: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), none of them empty; equal sequences hash alike wherever they stand."""
    size, out = end - start, np.zeros(len(start), np.uint64)
    longest = int(size.max(initial=0))
    level, width = tokens, 1
    while width <= longest:
        now = np.flatnonzero((size >= width) & (size < 2 * width))
        out[now] = _pair(level[start[now]], level[end[now] - width])
        if 2 * width <= longest:
            level = _pair(level[:-width], level[width:])
        width *= 2
    return mix64(out + size.astype(np.uint64) * _SIZE)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes a[a_start : a_start + size] and b[b_start : b_start + size] are the same, for each row. Hashes propose, this decides."""
    out = np.ones(len(size), bool)
    if not len(size) or not int(size.sum()):
        return out
    upto = np.concatenate(([0], np.cumsum(size)))
    step = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
    differ = np.flatnonzero(a[np.repeat(a_start, size) + step] != b[np.repeat(b_start, size) + step])
    out[np.searchsorted(upto, differ, "right") - 1] = False
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions 0..n-1 that lie in any [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def spans_within(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut where one text ends and the next begins."""
    starts, ends = runs(mask)
    if not len(starts):
        return starts, ends
    inner = offsets[1:-1]
    at = np.searchsorted(starts, inner, "right") - 1
    split = inner[(at >= 0) & (starts[np.maximum(at, 0)] < inner) & (ends[np.maximum(at, 0)] > inner)]
    split = split[np.diff(split, prepend=-1) != 0]  # empty texts end where they begin
    return np.sort(np.concatenate((starts, split)), kind="stable"), np.sort(np.concatenate((ends, split)), kind="stable")
