"""Benchmark decontamination with an FM-index for each training shard.

The words of a shard become symbols of the benchmark's vocabulary. Stretches of
such words that are too short to hold any window can't match and are left out,
which loses nothing. Over the rest of the shard stands one FM-index: the
Burrows-Wheeler transform from a full suffix sort, a wavelet matrix for ranks and
sampled suffix positions. All windows of the benchmark go through backward search
together, occurrences are located by walking to the next sample, and the words
they cover are merged into spans. Words are looked up by hash and taken for the
vocabulary's only if their bytes are the same.

The benchmark's windows are made on the executors, in blocks of BLOCK_BYTES of
text that lie in the shared folder. A shard is searched for one block after the
other in one pass over the corpus, so a larger benchmark takes more time, not
more memory, and nothing of it goes through the driver.

Defined results: null texts have no words and come through unchanged; items
without a word have no windows; items of fewer words than a window are one
window; equal items are found each; repeated rows are treated each; a very long
text is a shard of its own; an empty benchmark leaves every text as it is; an
empty table gives no rows. Columns of the input may have any name that does not
start with `__dc_`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, chunks, covered, equal_spans, open_fs, runs, shared_path, span_hash, spans_within, text_or_empty, values

WINDOW = 10
#: Benchmark text of a block; with at most WINDOW symbols a word a block takes some ten times that in memory.
BLOCK_BYTES = 4 << 20
#: Blocks that a Python worker keeps from shard to shard instead of reading them again.
KEPT_BYTES = 32 << 20
#: Text of a shard, text whose words are taken at once, and every how manieth suffix position is kept.
SHARD_BYTES, SLICE_BYTES, SAMPLE = 4 << 20, 1 << 20, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    return span_hash(byte_values(low) + np.uint64(salt), starts, ends)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text with A-Z in lower case, and starts and ends of its words."""
    low = _LOWER[data]
    return low, *spans_within(_IN_WORD[low], offsets)


# ---- the index


class FMIndex:
    """Over symbols 1.. with 0 as a separator; the text must not be empty."""

    def __init__(self, text: np.ndarray) -> None:
        text = np.append(text + 1, 0)  # an end mark of its own, before all others
        suffix = suffix_order(text)
        self.size, self.bwt = len(text), text[suffix - 1]
        top = int(text.max())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1)))).astype(np.int64)
        # wavelet matrix: at each bit, ones counted before each place; zeros go in front for the next
        self.levels, row = [], self.bwt
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones))).astype(np.int32), int(len(row) - ones.sum())))
            row = np.concatenate((row[ones == 0], row[ones == 1]))
        kept = suffix % SAMPLE == 0
        self.sampled, self.before, self.samples = kept, np.concatenate(([0], np.cumsum(kept))), suffix[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        zero = np.zeros(len(symbol), np.int64)
        for bit, ones, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            zero = np.where(one, zeros + ones[zero], zero - ones[zero])
        return at - zero

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns, aligned right and padded left with -1."""
        patterns = np.where(patterns >= 0, patterns + 1, -1)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        high[(patterns >= len(self.first) - 1).any(axis=1)] = 0
        for j in range(patterns.shape[1] - 1, -1, -1):
            on = np.flatnonzero((high > low) & (patterns[:, j] >= 0))
            c = patterns[on, j]
            low[on], high[on] = self.first[c] + self.rank(c, low[on]), self.first[c] + self.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to the next sampled one."""
        place, steps, row, todo = np.empty(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(todo):
            found = self.sampled[row[todo]]
            done = todo[found]
            place[done] = self.samples[self.before[row[done]]] + steps
            todo = todo[~found]
            c = self.bwt[row[todo]]
            row[todo] = self.first[c] + self.rank(c, row[todo])
            steps += 1
        return place


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by doubling the compared length; only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_ = text[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    step = 1
    while True:
        head = rank[order]
        tied = np.concatenate((head[1:] == head[:-1], [False]))
        tied[1:] |= tied[:-1].copy()
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        own = order[at]
        nxt = np.where(own + step < n, rank[np.minimum(own + step, n - 1)], -1)
        again = np.lexsort((nxt, head[at]))
        own, nxt, lead = own[again], nxt[again], head[at]
        order[at] = own
        new = np.concatenate(([True], (lead[1:] != lead[:-1]) | (nxt[1:] != nxt[:-1])))
        rank[own] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step *= 2


# ---- the benchmark

BLOCK = "salt long, words binary, sizes binary, windows binary, starts binary, items array<string>"


@dataclass
class Block:
    """The vocabulary (bytes of the words, sorted by hash: symbol = place + 1) and the windows of some items."""

    salt: int
    words: np.ndarray
    sizes: np.ndarray
    windows: np.ndarray  # symbols, aligned right, -1 before shorter ones
    starts: np.ndarray  # window -> its items in `items`
    items: list[str]

    def __post_init__(self) -> None:
        self.places = np.cumsum(self.sizes) - self.sizes
        self.hashes = word_hash(self.words, self.places, self.places + self.sizes, self.salt)
        self.shortest = int((self.windows >= 0).sum(axis=1).min(initial=1 << 30))

    def row(self) -> pa.RecordBatch:
        binary = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((self.words, np.uint8), (self.sizes, np.int64), (self.windows, np.int32), (self.starts, np.int64))]
        return pa.record_batch([pa.array([self.salt], pa.int64()), *binary, pa.array([self.items], pa.list_(pa.string()))], ["salt", "words", "sizes", "windows", "starts", "items"])

    @staticmethod
    def of(row: dict, window: int) -> Block:
        read = lambda c, t: np.frombuffer(row[c], t)
        return Block(row["salt"], read("words", np.uint8), read("sizes", np.int64), read("windows", np.int32).reshape(-1, window), read("starts", np.int64), row["items"])


def block_of(ids: list[str], data: np.ndarray, offsets: np.ndarray, window: int) -> Block | None:
    low, starts, ends = words(data, offsets)
    if not len(starts):
        return None
    raw, number = low.tobytes(), {}
    symbol = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    # other words have other hashes: should two of the vocabulary be alike, another salt tells them apart
    sizes, text = np.array([len(w) for w in number]), np.frombuffer(b"".join(number), np.uint8)
    places, salt = np.cumsum(sizes) - sizes, 0
    while len(np.unique(hashes := word_hash(text, places, places + sizes, salt))) < len(number):
        salt += 1
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    listed = list(number)
    symbol = rank[symbol] + 1
    # the windows of every item: the places where they end, aligned right
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    own = np.flatnonzero(n)
    many = np.maximum(n[own] - window + 1, 1)
    item = np.repeat(own, many)
    step = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(n[item], window)
    at = (first[item] + step + size)[:, None] + np.arange(-window, 0)
    rows = np.where(np.arange(window) >= (window - size)[:, None], symbol[np.maximum(at, 0)], -1)
    distinct, which = np.unique(rows, axis=0, return_inverse=True)
    pairs = np.unique(np.stack((which.ravel(), item)), axis=1)
    ordered = np.frombuffer(b"".join(listed[i] for i in order), np.uint8)
    return Block(salt, ordered, sizes[order], distinct, np.searchsorted(pairs[0], np.arange(len(distinct) + 1)), [ids[i] for i in pairs[1]])


def write_blocks(benchmark: DataFrame, window: int = WINDOW, size: int | None = None) -> str:
    """The blocks of a benchmark (item_id, text) as a table in the shared folder; returns its path."""
    size = size or BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", size):
                if found := block_of(batch.column("id").to_pylist(), *values(batch.column("text")), window):
                    yield found.row()

    path = shared_path(benchmark.sparkSession, "benchmark-blocks")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), text_or_empty().alias("text"))
    rows.mapInArrow(run, BLOCK).write.parquet(path)
    return path


_KEPT: dict[str, list[Block]] = {}


def read_blocks(path: str, window: int) -> Iterator[Block]:
    """One block after the other; a small benchmark stays in the worker."""
    if path in _KEPT:
        yield from _KEPT[path]
        return
    store, base = open_fs(path)
    files = sorted((f for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")), key=lambda f: f.path)
    keep: list[Block] | None = [] if sum(f.size for f in files) <= KEPT_BYTES else None
    for f in files:
        with store.open_input_file(f.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=1):
                for row in batch.to_pylist():
                    block = Block.of(row, window)
                    if keep is not None:
                        keep.append(block)
                    yield block
    if keep is not None:
        _KEPT.clear()
        _KEPT[path] = keep


# ---- the shards


@dataclass
class Shard:
    """Lower-case text of a shard, and its words: starts, ends, text."""

    low: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Shard:
        low, starts, ends = words(data, offsets)
        return Shard(low, offsets, starts, ends, np.searchsorted(offsets, starts, "right") - 1)

    def slices(self) -> Iterator[slice]:
        """Words of SLICE_BYTES of text at a time."""
        at = 0
        while at < len(self.starts):
            end = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + SLICE_BYTES, "right")))
            yield slice(at, end)
            at = end

    def symbols(self, block: Block) -> np.ndarray:
        """Of each word its symbol, 0 if the vocabulary may be without it; hashes only."""
        out = np.zeros(len(self.starts), np.int32)
        for s in self.slices():
            base, top = self.starts[s][0], self.ends[s][-1]
            hashes = word_hash(self.low[base:top], self.starts[s] - base, self.ends[s] - base, block.salt)
            at = np.minimum(np.searchsorted(block.hashes, hashes), len(block.hashes) - 1)
            out[s] = np.where(block.hashes[at] == hashes, at + 1, 0)
        return out

    def stretches(self, symbol: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
        """Known words in a row within a text, if they can hold a window."""
        known = symbol > 0
        begin, end = runs(known)
        edge = np.flatnonzero(np.diff(self.doc)) + 1
        inside = edge[known[edge] & known[edge - 1]]
        begin, end = np.sort(np.concatenate((begin, inside)), kind="stable"), np.sort(np.concatenate((end, inside)), kind="stable")
        long = end - begin >= shortest
        return begin[long], end[long]

    def occurrences(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, first word and words of every occurrence."""
        none = np.zeros(0, np.int64)
        symbol = self.symbols(block) if len(self.starts) else none
        begin, end = self.stretches(symbol, block.shortest)
        # what the hash proposed the bytes decide, before anything is indexed
        at = np.flatnonzero(covered(len(symbol), begin, end)) if len(begin) else none
        word = symbol[at] - 1
        same = block.sizes[word] == self.ends[at] - self.starts[at]
        same[same] = equal_spans(self.low, self.starts[at[same]], block.words, block.places[word[same]], block.sizes[word[same]])
        if not same.all():
            symbol[at[~same]] = 0
            begin, end = self.stretches(symbol, block.shortest)
        if not len(begin):
            return none, none, none
        size = end - begin + 1  # and a separator
        place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        text = symbol[np.minimum(place, len(symbol) - 1)].astype(np.int64)
        text[np.cumsum(size) - 1] = 0
        index = FMIndex(text)
        low, high = index.search(block.windows.astype(np.int64))
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        row = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return which, place[index.locate(row)], (block.windows >= 0).sum(axis=1)[which]


FOUND = "__dc_words long, __dc_starts array<long>, __dc_ends array<long>, __dc_items array<string>"


def _search(path: str, window: int, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "__dc_text", SHARD_BYTES):
                data, offsets = values(batch.column("__dc_text"))
                shard = Shard.of(data, offsets)
                hit = np.zeros(len(shard.starts), bool)
                items: list[set[str]] = [set() for _ in range(batch.num_rows)]
                for block in read_blocks(path, window):
                    which, first, n = shard.occurrences(block)
                    hit |= covered(len(hit), first, first + n)
                    for pair in np.unique(shard.doc[first] * len(block.windows) + which).tolist():
                        d, w = divmod(pair, len(block.windows))
                        items[d].update(block.items[block.starts[w] : block.starts[w + 1]])
                # spans of hit words, by text, counted in its words
                begin, end = runs(hit)
                edge = np.flatnonzero(np.diff(shard.doc)) + 1
                inside = edge[hit[edge] & hit[edge - 1]]
                begin, end = np.sort(np.concatenate((begin, inside)), kind="stable"), np.sort(np.concatenate((end, inside)), kind="stable")
                upto = np.searchsorted(shard.doc, np.arange(len(offsets)))
                at, rel = np.searchsorted(shard.doc[begin], np.arange(len(offsets))), upto[shard.doc[begin]]
                if cut:
                    place = batch.schema.get_field_index("__dc_text")
                    batch = batch.set_column(place, "__dc_text", _without(data, offsets, shard.starts[begin], shard.ends[end - 1]))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x - rel, pa.int64())) for x in (begin, end)]
                names = ["__dc_words", "__dc_starts", "__dc_ends", "__dc_items"]
                yield pa.record_batch([*batch.columns, pa.array(np.diff(upto), pa.int64()), *lists, pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [*batch.schema.names, *names])

    return run


def _without(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts without the bytes [begin, end) of the spans; what stands between two hit words of a span goes with them."""
    keep = ~covered(len(data), begin, end)
    upto = np.concatenate(([0], np.cumsum(keep)))[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())).cast(pa.string())


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", cut: bool = False) -> DataFrame:
    """docs with __dc_text (no null; without the hit spans if `cut`), __dc_words, spans of hit words (__dc_starts, __dc_ends: half-open, in words) and __dc_items."""
    path = write_blocks(benchmark, window)
    rows = docs.withColumn("__dc_text", text_or_empty(text_col))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", {FOUND}"
    return rows.mapInArrow(_search(path, window, cut), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs with the hit spans cut out of the text; texts of which no word is left go, untouched rows pass as they are."""
    found = find(docs, benchmark, window, text_col, cut=True)
    left = F.expr("__dc_words = 0 or __dc_words > aggregate(zip_with(__dc_starts, __dc_ends, (a, b) -> b - a), 0L, (x, y) -> x + y)")
    # rows without a span keep their own (possibly null) text
    text = F.when(F.size("__dc_starts") > 0, F.col("__dc_text")).otherwise(F.col(text_col))
    return found.filter(left).withColumn(text_col, text).select(docs.columns)
