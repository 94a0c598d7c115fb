"""Bloom filters of bounded size, built in segments on the executors.

A filter may let a row through that it should hold back, never the other way
round, so whatever passes is settled exactly afterwards. A corpus that outgrows
MAX_FILTER_BYTES fills the filter: more rows shuffle, results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, written

#: Bits per hash in the filters, and probes per hash.
BITS_PER_HASH, PROBES = 16, 4
#: Bound of a filter that is broadcast.
MAX_FILTER_BYTES = 32 << 20


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions below `bits` for each hash, one row per probe."""
    a = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D))
    b = mix64(hashes + np.uint64(0x14057B7EF767814F)) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) >> np.uint64(11)) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def put(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, at.ravel() >> 3, (1 << (at.ravel() & 7)).astype(np.uint8))


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


_LOW = np.uint64(0xFFFFFFFF)


def dealt(hashes: np.ndarray, segments: int) -> pa.RecordBatch:
    """A blob of the low halves of hashes for each segment, which the high halves tell."""
    seg = segment_of(hashes, segments)
    order = np.argsort(seg, kind="stable")
    keys, starts = np.unique(seg[order], return_index=True)
    parts = np.split((hashes & _LOW).astype(np.uint32)[order], starts[1:]) if len(keys) else []
    return pa.record_batch([pa.array(keys, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["seg", "hashes"])


def _send(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hash that repeats in a batch goes twice, however often it came."""
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            yield dealt(np.repeat(h, np.minimum(n, 2)), segments)

    return run


def _slice(slice_bits: int, repeats: bool):
    def run(group: pa.Table) -> pa.Table:
        """Of one segment its slice of the filter: of all hashes, or of those that come again (told by a filter over all of the segment's)."""
        blobs = [np.frombuffer(b, np.uint32).astype(np.uint64) for b in group.column("hashes").to_pylist()]
        bits = max(1024, BITS_PER_HASH * sum(map(len, blobs)))
        once, out = np.zeros(-(-bits // 8) if repeats else 0, np.uint8), np.zeros(slice_bits // 8, np.uint8)
        for blob in blobs:
            h, n = np.unique(blob, return_counts=True)
            if repeats:
                at = slots(h, bits)
                again = has(once, at) | (n > 1)
                put(once, at)
                h = h[again]
            put(out, slots(h, slice_bits))
        return pa.table({"seg": pa.array([group.column("seg")[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    return run


class Filter:
    """A broadcast filter over 64-bit hashes: `segments` slices of `slice_bits` bits, one after another."""

    def __init__(self, sent: DataFrame, bits: int, repeats: bool) -> None:
        """sent: seg, hashes (as `dealt` gives them). With `repeats` only hashes that come at least twice are in the filter."""
        spark = sent.sparkSession
        self.segments = partitions(spark)
        self.slice_bits = max(64, min(8 * MAX_FILTER_BYTES, bits) // self.segments // 64 * 64)
        size = self.slice_bits // 8
        whole = np.zeros(self.segments * size, np.uint8)
        # written first: fetching part by part must not depend on shuffle files of a query that is over
        slices = written(sent.groupBy("seg").applyInArrow(_slice(self.slice_bits, repeats), "seg long, bits binary"), "filter-slices")
        for r in slices.toLocalIterator():
            whole[r.seg * size : (r.seg + 1) * size] = np.frombuffer(r.bits, np.uint8)
        self.shared = spark.sparkContext.broadcast(whole)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        return has(self.shared.value, slots(hashes & _LOW, self.slice_bits) + segment_of(hashes, self.segments) * self.slice_bits)

    def test(self, hashes: Column) -> Column:
        """Whether each bigint hash may be in the filter."""

        @F.arrow_udf("boolean")
        def maybe(h: pa.Array) -> pa.Array:
            return pa.array(self.has(h.to_numpy(zero_copy_only=False).view(np.uint64)))

        return maybe(hashes)


def filter_of(hashes: DataFrame, rows: int, repeats: bool) -> Filter:
    """From one bigint column of hashes, without nulls."""
    return Filter(hashes.mapInArrow(_send(partitions(hashes.sparkSession)), "seg long, hashes binary"), max(1 << 13, BITS_PER_HASH * rows), repeats)
