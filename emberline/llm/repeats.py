"""Windows of tokens that also start in an earlier document: what suffix-array and substring deduplication share.

A window's anchor is the smallest hash of its grams, so equal windows have equal
anchors wherever they stand. The windows that follow one another under one
anchor form a unit; a text is a row of units that overlap. Units are told apart
by a cryptographic digest of their bytes. Equal units are settled as a whole;
where units under one anchor differ, their bytes meet in one part and the single
windows are compared there, token by token, by bucket-pointer refinement. Every
window of every text belongs to exactly one unit, so nothing is sampled away, and
a 64-bit hash only decides what meets, never what is removed.

Rows that share a doc_id are one document and should be equal; a null doc_id
neither removes nor is removed. doc_id is an integer column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Filter, dealt, filter_of
from .common import byte_values, chunks, covered, gram_hash, mix64, partitions, runs, sliding_min, span_hash, spans_within, text_or_empty, values, written

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes of text that a task works on at once, and bytes of the corpus for each part of keyed work.
SLICE_BYTES, PART_BYTES = 1 << 20, 8 << 20
#: Repeated units whose earliest document a task remembers.
HOT = 1 << 16


class Tokens:
    """Token hashes of a slice, the token number where each text begins, and the bytes of any run of tokens (words with one space between)."""

    def __init__(self, kind: str, data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> None:
        if kind == "bytes":
            self.count, self.offsets = len(data), offsets
            self.raw = data.tobytes()
            self.values = byte_values(data) if hashed else None
            return
        starts, ends = spans_within(~_SPACE[data], offsets)
        self.count, self.offsets = len(starts), np.searchsorted(starts, offsets)
        self.values = span_hash(byte_values(data), starts, ends) if hashed else None
        size = ends - starts
        self.begin = np.cumsum(size + 1) - size - 1
        self.end = self.begin + size
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[~_SPACE[data]]
        self.raw = joined.tobytes()

    def pieces(self, first: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The bytes of the tokens [first, first + size), for each row."""
        if hasattr(self, "begin"):
            first, last = self.begin[first], self.end[first + size - 1]
        else:
            last = first + size
        raw = self.raw
        return [raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]

    def window_starts(self, window: int) -> np.ndarray:
        """Mask over all places where a window would lie in the slice: those within one text."""
        places = max(self.count - window + 1, 0)
        good = np.ones(places, bool)
        for end in self.offsets[1:-1]:  # windows that run over a text's end
            good[max(end - window + 1, 0) : min(end, places)] = False
        return good


def units(tokens: Tokens, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """text, anchor, first window (a token number of the slice) and number of windows of each unit, in order."""
    none = np.zeros(0, np.int64)
    good = tokens.window_starts(window)
    if not good.any():
        return none, none.astype(np.uint64), none, none
    anchor = sliding_min(gram_hash(tokens.values, gram), window - gram + 1)
    # a text's last window and the next text's first are no neighbours, also where a window is one token
    change = np.union1d(np.flatnonzero((anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])) + 1, tokens.offsets[(tokens.offsets > 0) & (tokens.offsets < len(good))])
    first = np.concatenate(([0], change))
    n = np.diff(np.append(first, len(good)))
    keep = good[first]
    first, n = first[keep], n[keep]
    return np.searchsorted(tokens.offsets, first, "right") - 1, anchor[first], first, n


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    """doc_id as 64-bit integers; null (which takes part in nothing) as -1."""
    return batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], kind: str, hashed: bool = True) -> Iterator[tuple[pa.RecordBatch, Tokens, np.ndarray]]:
    for whole in batches:
        for batch in chunks(whole, "text", SLICE_BYTES):
            data, offsets = values(batch.column("text"))
            yield batch, Tokens(kind, data, offsets, hashed), offsets


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def parts_for(docs: DataFrame) -> int:
    """Parts of keyed work: as many as the session shuffles into, and more where the texts are larger than that suits."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    return max(partitions(docs.sparkSession), -(-size // PART_BYTES))


# ---- units and their fingerprints

#: k: 32 bits of the anchor and 32 of the digest; v: 64 more bits of the digest.
KINDS = {"k": np.uint64, "v": np.uint64, "doc": np.int64, "first": np.int32, "n": np.int32}
OWN = {"own_doc": np.int64, "own_first": np.int32, "own_n": np.int32}
#: A unit of a slice that no smaller document is known to hold goes to its part; the others are settled on the spot (own).
BUCKETS = "part int, " + ", ".join(f"{c} binary" for c in (*KINDS, *OWN))
_LOW = np.uint64(0xFFFFFFFF)


def fingerprints(tokens: Tokens, anchor: np.ndarray, first: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    digests = b"".join([blake2b(x, digest_size=12).digest() for x in tokens.pieces(first, n + window - 1)])
    three = np.frombuffer(digests, "<u4").reshape(-1, 3).astype(np.uint64)
    return (anchor & ~_LOW) | three[:, 0], (three[:, 1] << np.uint64(32)) | three[:, 2]


class _Hot:
    """Units that this task has seen in several documents, with the earliest: later copies are settled where they lie."""

    def __init__(self) -> None:
        self.k, self.v, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def earlier(self, k: np.ndarray, v: np.ndarray, doc: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.k, k)
        on = np.flatnonzero(at < len(self.k))
        out = np.zeros(len(k), bool)
        out[on] = (self.k[at[on]] == k[on]) & (self.v[at[on]] == v[on]) & (self.doc[at[on]] < doc[on])
        return out

    def settle(self, k: np.ndarray, v: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which units of a slice an earlier document holds, of this slice or of what is remembered; those that the slice repeats are remembered."""
        order = np.lexsort((doc, v, k))
        lead = earliest_in(k[order], v[order], doc[order])
        later = lead < doc[order]
        known = self.earlier(k, v, doc)
        known[order[later]] = True
        if len(self.k) > HOT:
            self.__init__()
        k, v, doc = (np.concatenate(x) for x in ((self.k, k[order[later]]), (self.v, v[order[later]]), (self.doc, lead[later])))
        order = np.lexsort((doc, v, k))
        k, v, doc = k[order], v[order], doc[order]
        keep = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)  # of two units alike in k one is remembered
        self.k, self.v, self.doc = k[keep], v[keep], doc[keep]
        return known


def send_units(kind: str, window: int, gram: int, keep: Callable[[np.ndarray], np.ndarray] | None, parts: int):
    """mapInArrow: the units of texts whose anchors pass `keep`, dealt out by anchor as BUCKETS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, hot = TaskContext.get().partitionId(), _Hot()
        for batch, tokens, _ in slices(batches, kind):
            text, m, first, n = units(tokens, window, gram)
            if keep:
                ok = keep(m)
                text, m, first, n = text[ok], m[ok], first[ok], n[ok]
            k, v = fingerprints(tokens, m, first, n, window)
            doc, first, n = ids_of(batch)[text], (first - tokens.offsets[text]).astype(np.int32), n.astype(np.int32)
            known = hot.settle(k, v, doc)
            at, later = np.flatnonzero(~known), np.flatnonzero(known)
            part = ((m & _LOW).astype(np.int64)) % parts
            at = at[np.argsort(part[at], kind="stable")]
            rows: dict[int, dict[str, bytes]] = {}
            keys, begin = np.unique(part[at], return_index=True)
            for p, own in zip(keys.tolist(), np.split(at, begin[1:]) if len(keys) else [], strict=True):
                rows[p] = {c: x[own].tobytes() for c, x in zip(KINDS, (k, v, doc, first, n), strict=True)}
            if len(later):
                turn += 1
                rows.setdefault(turn % parts, {}).update(zip(OWN, (doc[later].tobytes(), first[later].tobytes(), n[later].tobytes()), strict=True))
            columns = [*KINDS, *OWN]
            yield pa.record_batch([pa.array(list(rows), pa.int32()), *(pa.array([r.get(c, b"") for r in rows.values()], pa.binary()) for c in columns)], ["part", *columns])

    return run


def earliest_in(k: np.ndarray, v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For sorted (k, v), documents ascending within each: the first document of each."""
    if not len(k):
        return doc
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
    return doc[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]


def column_of(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)


def mixed_anchors(k: np.ndarray, v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For rows sorted by fingerprint: whether the anchor has several units in several documents."""
    if not len(k):
        return np.zeros(0, bool)
    anchor = k >> np.uint64(32)
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    starts = np.flatnonzero(new)
    other = np.concatenate(([False], (k[1:] != k[:-1]) | (v[1:] != v[:-1]))) & ~new
    several = np.add.reduceat(other.astype(np.int64), starts) > 0
    apart = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
    return (several & apart)[np.cumsum(new) - 1]


# ---- spans

#: Documents, and triples of 32-bit integers: first window, number of windows, and the part where they are to be compared (-1: settled).
SPANS = "bucket int, docs binary, spans binary"


def by_document(doc: np.ndarray, first: np.ndarray, n: np.ndarray, where: np.ndarray | int, parts: int) -> pa.Table:
    """Spans dealt out by document."""
    bucket = (mix64(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((first, doc, bucket))
    triples = np.stack(np.broadcast_arrays(first, n, where), axis=1).astype(np.int32)[order]
    doc, bucket = doc[order], bucket[order]
    keys, begin = np.unique(bucket, return_index=True)
    cut = lambda x: [y.tobytes() for y in np.split(x, begin[1:])] if len(keys) else []
    return pa.table({"bucket": pa.array(keys, pa.int32()), "docs": pa.array(cut(doc), pa.binary()), "spans": pa.array(cut(triples), pa.binary())})


def _gather(settled: bool):
    def run(group: pa.Table) -> pa.Table:
        """Of one bucket: a row per document with its settled spans, or with those to be compared."""
        doc, spans = column_of(group, "docs", np.int64), column_of(group, "spans", np.int32).reshape(-1, 3)
        on = (spans[:, 2] < 0) == settled
        doc, spans = doc[on], spans[on]
        order = np.argsort(doc, kind="stable")
        keys, begin = np.unique(doc[order], return_index=True)
        cut = [y.tobytes() for y in np.split(spans[order], begin[1:])] if len(keys) else []
        return pa.table({"__doc": pa.array(keys, pa.int64()), "__spans": pa.array(cut, pa.binary())})

    return run


def spans_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """text, first, n and part of all spans gathered for a batch's rows."""
    blobs = [x or b"" for x in batch.column("__spans").to_pylist()]
    triples = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 3).astype(np.int64)
    return np.repeat(np.arange(len(blobs)), [len(x) // 12 for x in blobs]), triples[:, 0], triples[:, 1], triples[:, 2]


def _documents(group: pa.Table) -> pa.Table:
    return pa.table({"__doc": pa.array(np.unique(column_of(group, "docs", np.int64)))})


class Marked:
    """The documents that have spans, dealt out by id once; the rest of the corpus stays where it is, told by a filter over the ids."""

    def __init__(self, docs: DataFrame, spans: DataFrame, parts: int) -> None:
        ids = written(spans.groupBy("bucket").applyInArrow(_documents, "__doc long"), "passage-documents")
        seen = filter_of(ids.select(F.xxhash64("__doc")), ids.count(), repeats=False)
        flagged = texts(docs).withColumn("__flag", seen.test(F.xxhash64("doc_id")))
        self.dealt = flagged.filter("__flag and doc_id is not null").select("doc_id", "text").repartition(parts, "doc_id")
        self.rest = flagged.filter("not __flag or doc_id is null").select("doc_id", "text")

    def rows(self, spans: DataFrame, settled: bool) -> DataFrame:
        """doc_id, text, __spans of the documents that have spans to be compared, or of all marked ones with their settled spans. Both reuse one exchange of the texts."""
        own = spans.groupBy("bucket").applyInArrow(_gather(settled), "__doc long, __spans binary")
        return self.dealt.join(own, F.col("doc_id") == F.col("__doc"), "left" if settled else "inner").select("doc_id", "text", "__spans")


# ---- single windows

WINDOWS = "part int, docs binary, firsts binary, sizes binary, bytes binary, " + ", ".join(f"{c} binary" for c in OWN)


def _windows_of(batch: pa.RecordBatch, tokens: Tokens, window: int) -> tuple[np.ndarray, ...]:
    """Of every window to be compared: its unit's number, and the unit's part, its text, and where it starts in the slice."""
    text, first, n, part = spans_of(batch)
    ok = first + n + window - 1 <= tokens.offsets[text + 1] - tokens.offsets[text]  # rows that repeat a doc_id may have other texts
    text, first, n, part = text[ok], first[ok], n[ok], part[ok]
    unit = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(unit)) - (np.cumsum(n) - n)[unit]
    return unit, part[unit], text[unit], tokens.offsets[text[unit]] + first[unit] + at


def _send_hashes(kind: str, window: int, segments: int):
    """Hashes of the windows to be compared, once for each text, dealt out by segment; twice if two texts of the slice have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens, _ in slices(batches, kind):
            _, _, text, place = _windows_of(batch, tokens, window)
            h = gram_hash(tokens.values, window)[place] if len(place) else np.zeros(0, np.uint64)
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            own = h[np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))] if len(h) else h
            h, n = np.unique(own, return_counts=True)
            yield dealt(np.repeat(h, np.minimum(n, 2)), segments)

    return run


def _send_windows(kind: str, window: int, parts: int, keep: Callable[[np.ndarray], np.ndarray]):
    """The bytes of the windows to be compared that several documents may hold, as runs dealt out to the parts of their units.

    Runs that a slice or a task has seen in an earlier document are settled on the
    spot: of a passage that a share of all texts has, a task sends few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, hot = TaskContext.get().partitionId(), _Hot()
        for batch, tokens, _ in slices(batches, kind):
            unit, part, text, place = _windows_of(batch, tokens, window)
            on = np.flatnonzero(keep(gram_hash(tokens.values, window)[place])) if len(place) else place
            unit, part, text, place = unit[on], part[on], text[on], place[on]
            new = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (place[1:] != place[:-1] + 1)))) if len(on) else on
            n = np.diff(np.append(new, len(on)))
            part, text, place = part[new], text[new], place[new]
            k, v = fingerprints(tokens, np.zeros(len(n), np.uint64), place, n, window)
            doc, first = ids_of(batch)[text], place - tokens.offsets[text]
            known = hot.settle(k, v, doc)
            at, later = np.flatnonzero(~known), np.flatnonzero(known)
            at = at[np.argsort(part[at], kind="stable")]
            pieces = tokens.pieces(place[at], n[at] + window - 1)
            sizes = np.array([len(x) for x in pieces], np.int32)
            keys, begin = np.unique(part[at], return_index=True)
            rows: dict[int, dict[str, bytes]] = {}
            for p, a, b in zip(keys.tolist(), begin.tolist(), np.append(begin[1:], len(at)).tolist(), strict=False):
                own = at[a:b]
                rows[p] = {"docs": doc[own].tobytes(), "firsts": first[own].astype(np.int32).tobytes(), "sizes": sizes[a:b].tobytes(), "bytes": b"".join(pieces[a:b])}
            if len(later):
                turn += 1
                rows.setdefault(turn % parts, {}).update(zip(OWN, (doc[later].tobytes(), first[later].astype(np.int32).tobytes(), n[later].astype(np.int32).tobytes()), strict=True))
            columns = ["docs", "firsts", "sizes", "bytes", *OWN]
            yield pa.record_batch([pa.array(list(rows), pa.int32()), *(pa.array([r.get(c, b"") for r in rows.values()], pa.binary()) for c in columns)], ["part", *columns])

    return run


def _byte_buckets(data: bytes, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each byte the q-gram that begins there, as a number; tokens of each unit; q, eight bytes at most."""
    q = min(8, window)
    padded = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(q - 1, np.uint8))).astype(np.uint64)
    name = np.zeros(len(data), np.uint64)
    for i in range(q):
        name = (name << np.uint64(8)) | padded[i : i + len(data)]
    return name, sizes.astype(np.int64), q


def _word_buckets(data: bytes, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each word its number among the distinct ones; words of each unit; 1."""
    ends = np.cumsum(sizes)
    pieces = [data[b - n : b].split(b" ") for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    words = np.empty(sum(map(len, pieces)), object)
    words[:] = [w for x in pieces for w in x]
    return pd.factorize(words)[0].astype(np.uint64), np.array([len(x) for x in pieces], np.int64), 1


def refine_buckets(name: np.ndarray, sizes: np.ndarray, doc: np.ndarray, q: int, window: int) -> np.ndarray:
    """Mask of the tokens at which a window starts that an earlier document of the units holds too.

    name: of each token of the concatenated units the bucket of the q tokens that
    begin there; sizes, doc: tokens and document of each unit. Bucket-pointer
    refinement to the depth of a window: a bucket is split by sorting its suffixes on
    the bucket pointers at the later offset; the new pointers are written back, and
    the next pass reads them there, so the depth doubles. Buckets that only one
    document has are finished and their suffixes never sorted again.
    """
    total = len(name)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    left = np.cumsum(sizes)[unit] - np.arange(total)  # tokens from here to the unit's end
    pointer, depth, top = np.zeros(total, np.int64), q, 0
    open_ = np.flatnonzero(left >= q)
    key = name[open_]
    earliest = np.zeros(total, np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        key, open_ = key[order], open_[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        starts, owner = np.flatnonzero(new), doc[unit[open_]]
        bucket = np.cumsum(new) - 1
        pointer[open_] = top + bucket
        top += len(starts)
        if len(starts):
            low, high = np.minimum.reduceat(owner, starts), np.maximum.reduceat(owner, starts)
            shared = (low < high)[bucket]
            earliest[open_] = low[bucket]
            open_ = open_[shared]
        if depth == window or not len(open_):
            break
        step = min(depth, window - depth)
        depth += step
        open_ = open_[left[open_] >= depth]
        key = pointer[open_].astype(np.uint64) * np.uint64(top) + pointer[open_ + step].astype(np.uint64)
    out = np.zeros(total, bool)
    if depth == window:
        out[open_] = earliest[open_] < doc[unit[open_]]
    return out


def _compare(kind: str, window: int, parts: int):
    def run(group: pa.Table) -> pa.Table:
        """Of one part: the windows that an earlier document holds, as spans."""
        doc, first, sizes = column_of(group, "docs", np.int64), column_of(group, "firsts", np.int32), column_of(group, "sizes", np.int32)
        name, sizes, q = (_byte_buckets if kind == "bytes" else _word_buckets)(b"".join(group.column("bytes").to_pylist()), sizes, window)
        hit = np.flatnonzero(refine_buckets(name, sizes, doc, q, window))
        unit = np.searchsorted(np.cumsum(sizes), hit, "right")
        doc, at = doc[unit], first[unit] + hit - (np.cumsum(sizes) - sizes)[unit]
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else np.zeros(0, np.int64)
        own = [column_of(group, c, t) for c, t in OWN.items()]
        return by_document(*(np.concatenate(x) for x in zip(own, (doc[new], at[new], np.diff(np.append(new, len(at)))), strict=True)), -1, parts)

    return run


def compared(marked: Marked, settled: DataFrame, kind: str, window: int, parts: int) -> DataFrame:
    """Spans of the windows that `settled` leaves to be compared and that an earlier document holds, from the texts.

    Two passes: a filter over the windows' hashes holds back those that only one
    document has, so that variants of one text don't gather in its part.
    """
    asked = marked.rows(settled, False)
    segments = partitions(settled.sparkSession)
    seen = Filter(asked.mapInArrow(_send_hashes(kind, window, segments), "seg long, hashes binary"), parts * PART_BYTES, repeats=True)
    sent = asked.mapInArrow(_send_windows(kind, window, parts, seen.has), WINDOWS)
    return sent.groupBy("part").applyInArrow(_compare(kind, window, parts), SPANS)


def removed_tokens(batch: pa.RecordBatch, tokens: Tokens, window: int) -> np.ndarray:
    """Mask of the tokens that the spans of a batch's rows cover; spans beyond a text's end are cut there."""
    text, first, n, _ = spans_of(batch)
    begin = np.minimum(tokens.offsets[text] + first, tokens.offsets[text + 1])
    return covered(tokens.count, begin, np.minimum(begin + n + window - 1, tokens.offsets[text + 1]))


def pieces_of(mask: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """For each text: removed tokens, the bounds of what is kept (start, end pairs), and removed runs."""
    begin, end = runs(mask)
    if len(begin):
        inner = offsets[1:-1]
        at = np.searchsorted(begin, inner, "right") - 1
        split = inner[(at >= 0) & (begin[np.maximum(at, 0)] < inner) & (end[np.maximum(at, 0)] > inner)]
        begin, end = np.union1d(begin, split), np.union1d(end, split)
    lo, hi = np.searchsorted(begin, offsets[:-1]), np.searchsorted(begin, offsets[1:])
    for i in range(len(offsets) - 1):
        b, e = begin[lo[i] : hi[i]], end[lo[i] : hi[i]]
        yield int((e - b).sum()), np.stack((np.append(offsets[i], e), np.append(b, offsets[i + 1])), axis=1), len(b)
