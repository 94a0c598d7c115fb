"""Best-fit packing of token pieces by a linear grouping scheme.

A plan needs only how many pieces have each length, at most `capacity` numbers
however large the corpus is: large lengths are put in groups of equal
cardinality and rounded up to the group's largest; a linear programme over
configurations of these few sizes (column generation) says how
often each configuration is used; actual pieces take the places of rounded ones;
what the rounding down of the programme left over and all small pieces go, the
longest first, where they fit best. The plan maps (length, rank within length)
ranges to sequences, so each piece finds its place without meeting any other.

Defined results: a null text is empty; an empty text is the end token alone;
texts longer than a sequence are cut so that all pieces but the first are full;
very long texts are tokenised whole, one at a time; rows that repeat a doc_id are
packed each; pieces of equal length are alike to the plan; other columns of the
input are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import count as counting

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, chunks, equal_spans, span_hash, text_or_empty, values, written

CAPACITY, END_ID = 1024, 2
#: Lengths above this share of the capacity (a third or more: at most two fit in a sequence) are large; they are put in so many groups at most.
LARGE_SHARE, GROUPS = 1 / 3, 200
#: Text bytes that a task tokenises at once, and distinct words, and their bytes, that it remembers.
SLICE_BYTES, REMEMBERED, REMEMBERED_BYTES = 2 << 20, 600_000, 16 << 20

#: The split pattern of the public byte-level vocabulary (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class WordIds:
    """Token ids of whole texts, word by word: equal words are tokenised once and remembered.

    A text may be cut before a single space between two characters that are not
    white space; the split pattern never joins across such a place, so the ids of
    the parts are the ids of the whole. Words are looked up by hash and taken as
    known only if their bytes are the same. The vocabulary file is the tokenizer's;
    its merges are in the order of its ids, which makes them ranks. A special string
    of the file gets its own id, as the tokenizer gives it, or is ordinary text.
    """

    def __init__(self, path: str, special: bool = True) -> None:
        import tiktoken

        symbols = byte_symbols()
        spec = json.load(open(path, encoding="utf-8"))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
        self.encode = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = {w.encode(): i for w, i in added.items()} if special else {}
        self.marks = re.compile(b"|".join(re.escape(w) for w in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.place, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # ids in the pool
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # bytes of the word
        self.pool, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _pooled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of each word's ids, added to the pool."""
        ids = [[self.special[w]] if w in self.special else self.encode(w.decode("utf-8")) for w in words]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        place = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate((self.pool, np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))))
        return place, count

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        place, count = self._pooled(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = len(self.text) + np.cumsum(size) - size
        self.text = np.concatenate((self.text, np.frombuffer(b"".join(words), np.uint8)))
        at = np.searchsorted(self.known, hashes)
        for name, new in (("known", hashes), ("place", place), ("count", count), ("start", start), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def _marked(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Text starts and, as if texts began there, the starts and ends of special strings."""
        edges = [m.span() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False) for m in self.marks.finditer(raw, a, b)]
        return np.union1d(offsets, np.array(edges, np.int64).ravel())

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        edges = self._marked(raw, offsets) if self.marks and self.marks.search(raw) else offsets
        starts = cut_places(data, edges)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        unique, first, which = np.unique(span_hash(byte_values(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED or len(self.text) > REMEMBERED_BYTES:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
        new = self.known[at] != unique if len(self.known) else np.ones(len(unique), bool)
        self.learn(unique[new], [raw[starts[i] : ends[i]] for i in first[new]])
        at = np.searchsorted(self.known, unique)[which]
        place, count = self.place[at], self.count[at]
        # the hash proposes, the bytes decide
        same = self.size[at] == size
        same[same] = equal_spans(data, starts[same], self.text, self.start[at[same]], size[same])
        if not same.all():
            place[~same], count[~same] = self._pooled([raw[a:b] for a, b in zip(starts[~same], ends[~same], strict=True)])
        upto = np.concatenate(([0], np.cumsum(count)))
        source = np.repeat(place - upto[:-1], count) + np.arange(upto[-1])
        return self.pool[source], upto[np.searchsorted(starts, offsets)]


_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
#: First bytes of characters that may be white space beyond ASCII.
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the parts: all text starts, and each single space that certainly has no white space beside it."""
    spaces = np.flatnonzero(data[1:-1] == 32) + 1
    before, after = data[spaces - 1], data[spaces + 1]
    good = ~_WHITE[before] & ~_WHITE[after] & ~_MAYBE[after]
    wide = before >= 0x80
    good &= ~(wide & (_MAYBE[data[np.maximum(spaces - 2, 0)]] | _MAYBE[data[np.maximum(spaces - 3, 0)]]))
    own = offsets[:-1][np.diff(offsets) > 0]
    # a space that ends a text or starts one has its neighbour in another text
    edge = np.isin(spaces, np.concatenate((own, own - 1)), assume_unique=False)
    return np.union1d(own, spaces[good & ~edge])


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _pieces(path: str, capacity: int, keep_ids: bool, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = WordIds(path, special), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in chunks(whole, "text", SLICE_BYTES):
                ids, bounds = words.ids(*values(batch.column("text")))
                n = np.diff(bounds) + 1
                of = np.repeat(np.arange(len(n)), -(-n // capacity))
                piece = np.arange(len(of)) - np.concatenate(([0], np.cumsum(-(-n // capacity))))[:-1][of]
                head = (n - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[of] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[of], capacity)
                stream = np.insert(ids.astype("<u4"), bounds[1:], END_ID)
                at = (bounds[:-1] + np.arange(len(n)))[of] + start
                parts = [stream[a:b] for a, b in zip(at, at + length, strict=True)]
                crc = np.fromiter((zlib.crc32(p) for p in parts), np.int64, len(parts))
                # rank among this task's pieces of the same length
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                cols = [batch.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc), pa.array(np.full(len(of), part, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if keep_ids:
                    cols, names = [*cols, pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.record_batch(cols, names)

    return run


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, special: bool = True) -> DataFrame:
    """Written table of pieces: doc_id, piece, start, length, ids_crc32, part and rank (its rank among the task's pieces of that length), and ids if wanted."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = PIECES.format(id=dict(rows.dtypes)["doc_id"]) + (", ids array<long>" if keep_ids else "")
    return written(rows.mapInArrow(_pieces(tokenizer_path, capacity, keep_ids, special), schema), "pieces")


# ---- the plan


def _best_column(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset of sizes (descending) that fits in a sequence; large sizes go in at most twos."""
    column = np.zeros(len(sizes))
    partner = np.searchsorted(-sizes, sizes - capacity)  # the first size that fits beside each
    tail = np.maximum.accumulate(worth[::-1])[::-1]
    gain = worth + np.where(partner < len(sizes), tail[np.minimum(partner, len(sizes) - 1)], 0)
    i = int(gain.argmax())
    column[i] += 1
    if partner[i] < len(sizes):
        column[partner[i] + int(worth[partner[i] :].argmax())] += 1
    return column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (pieces of each size in a sequence) and how often the linear programme uses each."""
    k = len(sizes)
    basis = np.diag(np.maximum(capacity // sizes, 1).astype(float))
    amount = demand / basis.diagonal()
    inverse = np.diag(1 / basis.diagonal())
    for pivot in counting(1):
        if pivot % 100 == 0:
            inverse = np.linalg.inv(basis)
            amount = np.maximum(inverse @ demand, 0)
        price = np.ones(k) @ inverse
        column = _best_column(np.maximum(price, 0), sizes, capacity)
        worth = price @ column
        # no plan uses fewer than (sequences now) / worth sequences: within half a sequence of that the programme is solved
        if worth <= 1 + 1e-7 or amount.sum() * (1 - 1 / worth) < 0.5:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        amount = amount - theta * step
        amount[out] = theta
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return basis, np.maximum(amount, 0)


class Plan:
    """Ranges of pieces and their places; columns of `rows`: length, first rank, pieces, first sequence, pieces a sequence, offset."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY) -> None:
        self.capacity, self.sequences, self.rows = capacity, 0, []
        self.rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        rest = {n: [(0, int(c))] for n, c in enumerate(counts) if c and n}
        if full := rest.pop(capacity, None):
            self.rows.append((capacity, 0, full[0][1], 0, 1, 0))
            self.sequences = full[0][1]
        large = [n for n in rest if n > LARGE_SHARE * capacity]
        if large:
            self._group(sorted(large, reverse=True), rest)
        for n in sorted(rest, reverse=True):
            for first, count in rest[n]:
                self._best_fit(n, first, count)
        self.rows.sort()

    def _group(self, large: list[int], rest: dict) -> None:
        lengths, counts = np.array(large), np.array([rest[n][0][1] for n in large])
        upto = np.concatenate(([0], np.cumsum(counts)))
        total, size = int(upto[-1]), -(-int(upto[-1]) // GROUPS)
        first = np.arange(0, total, size)
        rounded = lengths[np.searchsorted(upto, first, "right") - 1]
        # groups that round to the same length are one size of the programme
        sizes, which = np.unique(-rounded, return_inverse=True)
        sizes, begin = -sizes, np.append(first, total)
        start = np.array([begin[np.flatnonzero(which == g)[0]] for g in range(len(sizes))])
        stop = np.append(start[1:], total)
        columns, amount = configurations(sizes, (stop - start).astype(float), self.capacity)
        left, at = (stop - start).copy(), start.copy()
        for c in np.argsort(-amount, kind="stable"):
            need = columns[:, c].astype(int)
            used = np.flatnonzero(need)
            times = min([int(amount[c] + 1e-9), *(int(left[g] // need[g]) for g in used)])
            if times > 0:
                slots = []
                for g in used:
                    for _ in range(need[g]):
                        slots.append(int(at[g]))
                        at[g] += times
                        left[g] -= times
                self._substitute(slots, times, lengths, upto)
        for i, n in enumerate(lengths):  # what is left of each length
            rest[n] = []
            for g in range(len(sizes)):
                a, b = max(at[g], upto[i]), min(stop[g], upto[i + 1])
                if a < b:
                    rest[n].append((int(a - upto[i]), int(b - a)))

    def _substitute(self, slots: list[int], times: int, lengths: np.ndarray, upto: np.ndarray) -> None:
        """`times` sequences; slot j of sequence i gets the actual piece slots[j] + i in the order of lengths."""
        breaks = {0, times}
        for s in slots:
            breaks.update(int(u - s) for u in upto[np.searchsorted(upto, s, "right") : np.searchsorted(upto, s + times)])
        cuts = sorted(breaks)
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            for s in slots:
                i = int(np.searchsorted(upto, s + a, "right")) - 1
                self.rows.append((int(lengths[i]), int(s + a - upto[i]), b - a, self.sequences + a, 1, offset))
                offset += int(lengths[i])
            self.rooms[self.capacity - offset].append((self.sequences + a, b - a))
        self.sequences += times

    def _best_fit(self, length: int, first: int, count: int) -> None:
        room = length
        while count:
            while room <= self.capacity and not self.rooms[room]:
                room += 1
            if room > self.capacity:
                each = self.capacity // length
                need = -(-count // each)
                self.rooms[self.capacity].append((self.sequences, need))
                self.sequences += need
                room = self.capacity
            # the fullest sequence that still has room takes as many as fit, then the next one
            base, n = self.rooms[room].pop()
            each = room // length
            use = min(n, -(-count // each))
            placed = min(count, use * each)
            self.rows.append((length, first, placed, base, each, self.capacity - room))
            whole, last = divmod(placed, each)
            if whole:
                self.rooms[room - each * length].append((base, whole))
            if last:
                self.rooms[room - last * length].append((base + whole, 1))
            if n > use:
                self.rooms[room].append((base + use, n - use))
            first, count = first + placed, count - placed


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] * (1 << 44) + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            r = rows[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1]
            nth = rank - r[:, 1]
            keep = [c for c in batch.schema.names if c not in ("rank", "before", "part")]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(r[:, 3] + nth // r[:, 4]), pa.array(r[:, 5] + nth % r[:, 4] * length)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, special: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset for every piece of docs (doc_id, text).

    With special=False the vocabulary's special strings in a text are ordinary text.
    """
    pieces = tokenized_pieces(docs, tokenizer_path, capacity, keep_ids, special)
    shares = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    shares = written(shares, "piece-shares")
    counts = np.zeros(capacity + 1, np.int64)
    for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    rows = np.array(Plan(counts, capacity).rows or [(0, 0, 0, 0, 1, 0)], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    # pieces of the same length in the tasks before: one row per task and length
    before = shares.select("part", "length", F.expr("sum(n) OVER (PARTITION BY length ORDER BY part ROWS UNBOUNDED PRECEDING) - n").alias("before"))
    ranked = pieces.join(before, ["part", "length"])
    out = ranked.drop("rank", "before", "part")
    schema = ", ".join(f"{n} {t}" for n, t in out.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(shared), schema)
