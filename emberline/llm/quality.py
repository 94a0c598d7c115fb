"""Quality of documents by ridge regression on random Fourier features, calibrated by isotonic regression.

A text is known by STATS statistics of its whole bytes (kinds of bytes, words and
lines, repeats), measured once and written. Their standardised values go through
random Fourier features, whose inner products approximate a Gaussian kernel, so a
linear fit on them is a smooth one on the statistics. Every partition sums its own
normal equations; the sums are added on executors and the driver solves one system
of FEATURES + 1 unknowns, however many labelled rows there are: all of them count.

The equations are summed by fold. Leaving out one fold at a time is a subtraction,
so each labelled row is also scored by a fit that hasn't seen it. Those scores, in
BINS bins, give the isotonic curve (pool adjacent violators), which turns a score
into the share of good texts among those that score alike.

Defined results: null text is empty, and an empty text is scored by its statistics
like any other; labels that are null don't count, of an id that has several the
largest does; without labelled rows every score is 0.5; repeated rows are scored
each, and texts alike score alike; a text of more than PIECE_BYTES is measured
piece by piece, and only distinct words and lines are carried along (a word or a
line that a piece's end cuts counts as two); columns of the input may have any name
that does not start with `__ql_`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, chunks, partitions, span_hash, spans_within, text_or_empty, values, written

#: Fourier features and the width of the kernel they stand for, in standard deviations; the ridge, as a share of the rows.
FEATURES, WIDTH, RIDGE = 256, 5.0, 1e-4
#: Standardised values are held within so many deviations.
FAR = 6.0
FOLDS, BINS, SEED = 4, 4096, 20
SLICE_BYTES, PIECE_BYTES = 2 << 20, 4 << 20

_KIND = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 stops and commas, 5 other signs, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 6
_KIND[[32, *range(9, 14)]] = 3
_KIND[[*b".,;:?'\"()-"]] = 4
KINDS = 7
#: What a piece adds up to: bytes of each kind, words, their bytes, words like the one before, words with signs in them, words without lower case, words of one byte, stops, lines, lines like the one before.
COUNTS = KINDS + 9
STATS = 20


@dataclass
class Sums:
    """Counts of texts (a row each), their byte histograms, and hashes of their distinct words and lines as (text, hash)."""

    counts: np.ndarray
    histogram: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    lines: tuple[np.ndarray, np.ndarray]


def _distinct(text: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.concatenate(([True], (np.diff(text) != 0) | (hashed[1:] != hashed[:-1])))[: len(text)]
    return text[new], hashed[new]


def measure(data: np.ndarray, offsets: np.ndarray) -> Sums:
    """Counts of all texts of a slice at once."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    histogram = np.bincount(text * 256 + data, minlength=256 * n).reshape(n, 256)
    counts = np.zeros((n, COUNTS))
    for k in range(KINDS):
        counts[:, k] = histogram[:, _KIND == k].sum(axis=1)
    kind = _KIND[data]
    tokens = byte_values(data)
    starts, ends = spans_within(kind != 3, offsets)
    of = np.searchsorted(offsets, starts, "right") - 1
    add = lambda where: np.bincount(where, minlength=n)
    words = span_hash(tokens, starts, ends)
    signs, lower = (np.concatenate(([0], np.cumsum(kind == k))) for k in (5, 0))
    again = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1])) + 1
    counts[:, KINDS] = add(of)
    counts[:, KINDS + 1] = np.bincount(of, ends - starts, n)
    counts[:, KINDS + 2] = add(of[again])
    counts[:, KINDS + 3] = add(of[signs[ends] > signs[starts]])
    counts[:, KINDS + 4] = add(of[lower[ends] == lower[starts]])
    counts[:, KINDS + 5] = add(of[ends - starts == 1])
    counts[:, KINDS + 6] = histogram[:, [*b".!?"]].sum(axis=1)
    first, last = spans_within((data != 10) & (data != 13), offsets)
    line_of = np.searchsorted(offsets, first, "right") - 1
    lines = span_hash(tokens, first, last)
    same = np.flatnonzero((lines[1:] == lines[:-1]) & (line_of[1:] == line_of[:-1])) + 1
    counts[:, KINDS + 7] = add(line_of)
    counts[:, KINDS + 8] = add(line_of[same])
    return Sums(counts, histogram, _distinct(of, words), _distinct(line_of, lines))


def measure_long(data: np.ndarray) -> Sums:
    """The same of one text, piece by piece; pieces end before white space where they can."""
    total, at = None, 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        if end < len(data):
            gap = np.flatnonzero(_KIND[data[at:end]] == 3)
            end = at + int(gap[-1]) if len(gap) and gap[-1] else end
        new = measure(data[at:end], np.array([0, end - at]))
        if total is None:
            total = new
        else:
            total.counts += new.counts
            total.histogram = total.histogram + new.histogram
            total.words, total.lines = (_distinct(*(np.concatenate(x) for x in zip(a, b, strict=True))) for a, b in ((total.words, new.words), (total.lines, new.lines)))
        at = end
    return total if total is not None else measure(data, np.array([0, 0]))


def statistics(s: Sums) -> np.ndarray:
    """STATS numbers for each text, none of them infinite."""
    c, n = s.counts, len(s.counts)
    size, words, lines = c[:, :KINDS].sum(axis=1), c[:, KINDS], c[:, KINDS + 7]
    per = lambda a, b: a / np.maximum(b, 1)
    p = s.histogram / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    distinct, distinct_lines = np.bincount(s.words[0], minlength=n), np.bincount(s.lines[0], minlength=n)
    letters = c[:, 0] + c[:, 1] + c[:, 6]
    out = np.stack([
        np.log1p(size), *(per(c[:, k], size) for k in range(KINDS)), per(c[:, 1], letters), np.log1p(words), per(c[:, KINDS + 1], words), per(distinct, words),
        *(per(c[:, KINDS + k], words) for k in (2, 3, 4, 5)), np.log1p(per(words, c[:, KINDS + 6])), entropy, per(distinct_lines, lines), per(c[:, KINDS + 8], lines),
    ], axis=1)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "__ql_text", SLICE_BYTES):
            data, offsets = values(batch.column("__ql_text"))
            sums = measure_long(data) if len(data) > PIECE_BYTES else measure(data, offsets)
            rest = [c for c in batch.schema.names if c != "__ql_text"]
            x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(sums).ravel()), STATS).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*(batch.column(c) for c in rest), x], [*rest, "__ql_x"])


def measured(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs, without the text unless it is to be kept, with its statistics __ql_x. Written, so that texts are read once."""
    rest = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(*rest, text_or_empty(text_col).alias("__ql_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "__ql_text")
    return written(rows.mapInArrow(_measured, f"{schema + ', ' if schema else ''}__ql_x array<double>"), "quality-statistics")


@dataclass
class Model:
    """Centre and scale of the statistics, weights of the features for each fold left out and (last) for none, and the curve from raw to calibrated scores."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))


def fourier(x: np.ndarray, model: Model) -> np.ndarray:
    """sqrt(2 / FEATURES) cos(w x + b), w from the Gaussian that is the kernel's transform, and a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.standard_normal((STATS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - model.centre) / model.scale, -FAR, FAR)
    return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))), axis=1)


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("__ql_x").flatten()).reshape(-1, STATS)


def _equations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each fold and unknown: this partition's sums of products with the features and with the label."""
        total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 3))
        for batch in batches:
            z, y, fold = fourier(_x(batch), model), np.array(batch.column("__ql_y"), float), np.array(batch.column("__ql_fold"))
            for k in range(FOLDS):
                own = z[fold == k]
                total[k, :, :-2] += own.T @ own
                total[k, :, -2] += own.T @ y[fold == k]
                total[k, :, -1] += len(own)
        k, i = np.divmod(np.arange(FOLDS * (FEATURES + 1)), FEATURES + 1)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), FEATURES + 3).cast(pa.list_(pa.float64()))
        yield pa.record_batch({"fold": pa.array(k.astype(np.int32)), "unknown": pa.array(i.astype(np.int32)), "sums": sums})

    return run


def _added(table: pa.Table) -> pa.Table:
    rows = np.array(table.column("sums").combine_chunks().flatten()).reshape(-1, FEATURES + 3)
    return pa.table({"fold": table.column("fold")[:1], "unknown": table.column("unknown")[:1], "sums": pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.float64()))})


def _raw(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bin of each row's score by the fit that hasn't seen its fold."""
        for batch in batches:
            z, fold = fourier(_x(batch), model), np.array(batch.column("__ql_fold"))
            raw = (z * model.weights[fold]).sum(axis=1)
            yield pa.record_batch({"bin": pa.array(_bin(raw)), "y": batch.column("__ql_y")})

    return run


def _bin(raw: np.ndarray) -> np.ndarray:
    """Raw scores lie around 0 and 1; the outermost bins take what lies beyond."""
    return np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int32)


def pool(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Shares good / n, with neighbours pooled until they never fall."""
    blocks: list[list[float]] = []
    for w, g in zip(n, good, strict=True):
        blocks.append([w, g, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, g2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + g2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / w) for w, g, k in blocks])


def train(rows: DataFrame) -> Model | None:
    """Model from measured rows with __ql_y (0 or 1) and __ql_fold; None without rows. The driver gets sums only."""
    rows = written(rows, "quality-labelled")
    x = [F.col("__ql_x")[i] for i in range(STATS)]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x))).first()
    if not r["n"]:
        return None
    centre, scale = (np.array([r[f"{k}{i}"] for i in range(STATS)]) for k in "ms")
    model = Model(centre, np.where(scale > 1e-9, scale, 1.0), np.zeros((FOLDS + 1, FEATURES + 1)))
    schema = "fold int, unknown int, sums array<double>"
    parts = rows.coalesce(max(2, partitions(rows.sparkSession))).mapInArrow(_equations(model), schema)
    total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 3))
    for row in parts.groupBy("fold", "unknown").applyInArrow(_added, schema).collect():
        total[row.fold, row.unknown] = row.sums
    for k in range(FOLDS + 1):
        use = total[[f for f in range(FOLDS) if f != k]].sum(axis=0)
        ridge = np.diag([RIDGE * max(use[0, -1], 1)] * FEATURES + [1e-9])
        model.weights[k] = np.linalg.solve(use[:, :-2] + ridge, use[:, -2])
    bins = rows.mapInArrow(_raw(model), "bin int, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()
    model.raw = (np.array([b.bin for b in bins]) + 0.5) / BINS * 3 - 1
    model.share = pool(np.array([b.n for b in bins], float), np.array([b.good for b in bins], float))
    return model


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "__ql_x"]
            if model is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                raw = fourier(_x(batch), model) @ model.weights[-1]
                # what the curve holds alike keeps the order of the raw scores within a thousandth
                score = 0.999 * np.interp(raw, model.raw, model.share) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(score)], [*rest, "__ql_score"])

    return run


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """Measured rows with __ql_score, from 0 to 1, in place of their statistics."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "__ql_x")
    return rows.mapInArrow(_scored(model), f"{schema + ', ' if schema else ''}__ql_score double")


def labelled(rows: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """The measured rows that have a label, as __ql_x, __ql_y and __ql_fold (by a hash of the id)."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("__ql_id")).agg(F.max((F.col(label) == 1).cast("int")).alias("__ql_y"))
    fold = F.pmod(F.xxhash64("__ql_id"), F.lit(FOLDS)).cast("int").alias("__ql_fold")
    return rows.select(F.col(id_col).alias("__ql_id"), "__ql_x").join(known, "__ql_id").select("__ql_x", "__ql_y", fold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, usable: Column | None = None) -> DataFrame:
    """The rows of docs that score at least the threshold, by a model learnt from the labelled ones among them (those that are `usable`)."""
    rows = measured(docs, keep_text=True)
    model = train(labelled(rows if usable is None else rows.filter(usable), labels))
    return score(rows, model).filter(F.col("__ql_score") >= threshold).select(docs.columns)
