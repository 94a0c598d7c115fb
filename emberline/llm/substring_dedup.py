"""Incremental substring deduplication with a log-structured fingerprint index.

The index is a series of immutable runs, each a written table of fingerprints
(units of window hashes, their anchor and the earliest document that holds them)
in parts, sorted by fingerprint. A new batch is sorted and merge-joined with each
run part by part, and leaves a run of its own. Matches are verified by a digest
of the unit's words; where units under one anchor differ, the windows themselves
are compared from the texts. When there are more than MAX_RUNS runs they are
merged, two sorted runs at a time, into one that keeps the earliest document of
each fingerprint. A manifest names the runs, so an index can be opened again.

Documents are judged against all documents with a smaller doc_id in the index or
in their own batch. A batch does not change what earlier batches have kept.

Defined results: null text has no words; texts of fewer words than a window lose
nothing; a window that repeats within one document only stays; rows that share a
doc_id are one document; rows without a doc_id come through whole; an empty batch
gives an empty table; other columns of the input are not read. doc_id is an
integer; very long texts are held whole in one task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, partitions, shared_dir, tidy
from .repeats import BUCKETS, KINDS, OWN, SPANS, Marked, by_document, column_of, compared, earliest_in, mixed_anchors, parts_for, pieces_of, removed_tokens, send_units, slices, texts

#: Words of a window and of an anchor's gram; runs before they are merged; batches of a whole table.
WINDOW, GRAM, MAX_RUNS, BATCHES = 50, 8, 3, 5

RUN = "part int, run int, " + ", ".join(f"{c} binary" for c in KINDS)
MERGED = f"{SPANS}, {RUN}"
Run = list[np.ndarray]  # k, v, doc, first, n sorted by fingerprint, the earliest document of each


def _read(row: dict) -> Run:
    return [np.frombuffer(row[c], t) for c, t in KINDS.items()]


def _packed(part: int, number: int, run: Run) -> dict:
    return {"part": pa.array([part], pa.int32()), "run": pa.array([number], pa.int32())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(KINDS, run, strict=True)}


def earliest_held(run: Run, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The document that a run holds for each of the sorted fingerprints, or the largest number: a merge join verified on v."""
    low, high = np.searchsorted(run[0], k, "left"), np.searchsorted(run[0], k, "right")
    out = np.full(len(k), np.iinfo(np.int64).max)
    for step in range(int((high - low).max(initial=0))):  # several units alike in k are rare
        on = np.flatnonzero(low + step < high)
        at = low[on] + step
        same = run[1][at] == v[on]
        out[on[same]] = run[2][at[same]]
    return out


def merged(a: Run, b: Run) -> Run:
    """Two runs as one, without sorting them anew: the rows of b go to their places among those of a."""
    place = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
    from_b = np.zeros(len(a[0]) + len(b[0]), bool)
    from_b[place] = True
    out = []
    for x, y in zip(a, b, strict=True):
        z = np.empty(len(from_b), x.dtype)
        z[from_b], z[~from_b] = y, x
        out.append(z)
    k = out[0]
    tied = np.concatenate((k[1:] == k[:-1], [False])) if len(k) else np.zeros(0, bool)
    tied[1:] |= tied[:-1].copy()
    at = np.flatnonzero(tied)  # rows alike in k, by digest and document
    order = at[np.lexsort((out[2][at], out[1][at], k[at]))]
    for z in out:
        z[at] = z[order]
    keep = np.concatenate(([True], (k[1:] != k[:-1]) | (out[1][1:] != out[1][:-1]))) if len(k) else tied
    return [z[keep] for z in out]


def _compact(number: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["run"])
        return pa.table(_packed(rows[0]["part"], number, reduce(merged, map(_read, rows))))

    return run


def _merge_join(parts: int, number: int):
    def run(new: pa.Table, runs: pa.Table) -> pa.Table:
        """Of one part: the batch's units against all runs. Gives spans by document, and the batch's own run."""
        own = [column_of(new, c, t) for c, t in OWN.items()]
        fresh = [column_of(new, c, t) for c, t in KINDS.items()]
        order = np.lexsort((fresh[2], fresh[1], fresh[0]))
        k, v, doc, first, n = (x[order] for x in fresh)
        lead = earliest_in(k, v, doc)
        held = [_read(r) for r in runs.to_pylist()]
        for x in held:
            lead = np.minimum(lead, earliest_held(x, k, v))
        whole = lead < doc
        left = [x[~whole] for x in (k, v, doc, first, n)]  # several rows of one unit are of one document
        # anchors that the batch brings and that several units share: the earlier documents' windows are sources
        anchors = np.unique(left[0] >> np.uint64(32))
        near = [[y[np.isin(x[0] >> np.uint64(32), anchors)] for y in x] for x in held]
        both = [np.concatenate(x) for x in zip(left, *near, strict=True)]
        order = np.lexsort((both[2], both[1], both[0]))
        both = [x[order] for x in both]
        mixed = mixed_anchors(*both[:3])
        part = (new if new.num_rows else runs).column("part")[0].as_py()
        where = np.repeat([-1, part], [len(own[0]) + whole.sum(), mixed.sum()])
        spans = by_document(*(np.concatenate((o, x[whole], y[mixed])) for o, x, y in zip(own, (doc, first, n), both[2:], strict=True)), where, parts)
        keep = np.concatenate(([True], (left[0][1:] != left[0][:-1]) | (left[1][1:] != left[1][:-1]))) if len(left[0]) else np.zeros(0, bool)
        packed = _packed(part, number, [x[keep] for x in left])
        names, rows = spans.column_names, spans.num_rows
        above = spans.append_column("part", pa.nulls(rows, pa.int32()))
        return pa.concat_tables([above, pa.table(packed | {"bucket": pa.nulls(1, pa.int32())})], promote_options="default").select([*names, *packed])

    return run


class FingerprintIndex:
    """The runs of one index, each a written table with a sorted array of fingerprints for each part; `open` finds them again."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, max_runs: int = MAX_RUNS, parts: int | None = None, folder: str | None = None) -> None:
        self.spark, self.window, self.gram, self.max_runs = spark, window, gram, max_runs
        self.parts = parts or partitions(spark)
        self.folder = (folder or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}").rstrip("/")
        self.paths: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, max_runs: int = MAX_RUNS) -> FingerprintIndex:
        last = spark.read.json(f"{folder.rstrip('/')}/manifest-*").orderBy(F.desc("version")).first()
        index = cls(spark, last.window, last.gram, max_runs, last.parts, folder)
        index.paths, index.version = list(last.paths), last.version
        return index

    @property
    def runs(self) -> list[DataFrame]:
        return [self.spark.read.schema(RUN).parquet(p).filter("part is not null") for p in self.paths]

    def _all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.runs) if self.paths else self.spark.createDataFrame([], RUN)

    def _commit(self) -> None:
        """A manifest of the next version; runs that it no longer names may be deleted."""
        self.version += 1
        row = (self.version, self.window, self.gram, self.parts, self.paths)
        manifest = self.spark.createDataFrame([row], "version int, window int, gram int, parts int, paths array<string>")
        manifest.coalesce(1).write.json(f"{self.folder}/manifest-{self.version:06d}")

    def compact(self) -> None:
        """Merge all runs into one that keeps the earliest document of each fingerprint."""
        if len(self.paths) > 1:
            path = f"{self.folder}/run-{uuid.uuid4().hex}"
            with tidy(self.spark):
                self._all().groupBy("part").applyInArrow(_compact(self.version), RUN).write.parquet(path)
            self.paths = [path]
            self._commit()

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Add a batch (doc_id, text). Returns spans by document: units that earlier documents hold, and windows to be compared from the texts."""
        sent = texts(batch).filter("doc_id is not null").mapInArrow(send_units("words", self.window, self.gram, None, self.parts), BUCKETS)
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        joined = sent.groupBy("part").cogroup(self._all().groupBy("part")).applyInArrow(_merge_join(self.parts, self.version), MERGED)
        with tidy(self.spark):
            joined.write.parquet(path)
        self.paths.append(path)
        self._commit()
        if len(self.paths) > self.max_runs:
            self.compact()
        return self.spark.read.schema(SPANS).parquet(path).filter("bucket is not null")


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens, _ in slices(batches, "words", hashed=False):
            removed, kept = [], []
            for gone, keep, _ in pieces_of(removed_tokens(batch, tokens, window), tokens.offsets):
                keep = keep[keep[:, 0] < keep[:, 1]]
                kept.append(b" ".join(tokens.pieces(keep[:, 0], keep[:, 1] - keep[:, 0])))
                removed.append(gone)
            sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            columns = [batch.column("doc_id"), pa.array(np.diff(tokens.offsets), pa.int64()), pa.array(removed, pa.int64()), sha]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.record_batch([*columns, pa.array([x.decode() for x in kept], pa.string())], [*names, "kept"]) if with_text else pa.record_batch(columns, names)

    return run


def verify_and_cut(docs: DataFrame, settled: DataFrame, window: int = WINDOW, with_text: bool = False, parts: int | None = None) -> DataFrame:
    """Compare the windows that settled leaves open, from the texts of docs (the batch and what came before it), and cut.

    Per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), and that text if wanted.
    """
    parts = parts or parts_for(docs)
    marked = Marked(docs, settled, parts)
    spans = settled.unionByName(compared(marked, settled, "words", window, parts))
    cut = marked.rows(spans, True).mapInArrow(_kept(window, with_text), OUT + (", kept string" if with_text else ""))
    words = F.trim(F.regexp_replace("text", SPACE_CLASS, " "))
    count = F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "))) + 1)
    whole = marked.rest.select("doc_id", count.cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(words, 256).alias("kept_sha256"), *([words.alias("kept")] if with_text else []))
    return cut.unionByName(whole)


def substring_dedup(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Ingest docs into a new index in `batches` ranges of doc_id, smallest first, verify and cut."""
    index = FingerprintIndex(docs.sparkSession, window, min(GRAM, window), parts=parts_for(docs))
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 1000).alias("q")).first().q if shares else []
    cuts = sorted({int(c) for c in found or []})
    settled = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs if low is None else docs.filter(F.col("doc_id") > low)
        settled.append(index.ingest(part if high is None else part.filter(F.col("doc_id") <= high)))
    return verify_and_cut(docs, reduce(DataFrame.unionByName, settled), window, with_text, index.parts)
