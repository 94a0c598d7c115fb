"""Suffix-array deduplication of byte passages by bucket-pointer refinement.

Suffixes are sorted only as deep as a passage is long, and only where it can
matter. Their initial buckets are q-grams of eight bytes. A bucket is refined by
sorting on the bucket pointers of the later offset; the new pointers are written
back and read by the next pass, so the depth goes 8, 16, 32, 50, and buckets of a
single document are finished early (`repeats.refine_buckets`). All passes of a
round are of one depth, since passages must not be told apart beyond their end.

What has to be sorted together is brought together first: a text is a row of
units, stretches of passages under one anchor (`repeats`). A filter of bounded
size over the anchors of all texts holds back units whose anchor no other
document has; units that equal an earlier document's by digest are settled as a
whole; the bytes of the remaining units under a shared anchor meet in one part
and are refined there. Once a corpus outgrows the filter more units pass it; the
result stays the same.

Defined results: null text is empty; texts shorter than a passage lose nothing;
a passage that repeats within one document only stays; rows that share a doc_id
are one document; rows without a doc_id come through whole; an empty table gives
an empty table; other columns of the input are not read. doc_id is an integer. A
text is held in memory as a whole in one task, at about 100 bytes for each of its
bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Filter, dealt
from .common import partitions, written
from .repeats import BUCKETS, KINDS, OWN, PART_BYTES, SPANS, Marked, by_document, column_of, compared, earliest_in, mixed_anchors, parts_for, pieces_of, removed_tokens, send_units, slices, texts, units

#: Bytes of a passage; the q-gram of an anchor.
PASSAGE, GRAM = 50, 26


def _anchors(passage: int, gram: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's distinct anchors, dealt out by segment; twice if two documents of the slice have it."""
        for _, tokens, _ in slices(batches, "bytes"):
            text, m, _, _ = units(tokens, passage, gram)
            order = np.lexsort((text, m))
            m, text = m[order], text[order]
            own = m[np.concatenate(([True], (m[1:] != m[:-1]) | (text[1:] != text[:-1])))] if len(m) else m
            h, n = np.unique(own, return_counts=True)
            yield dealt(np.repeat(h, np.minimum(n, 2)), segments)

    return run


def _settle(parts: int):
    def run(group: pa.Table) -> pa.Table:
        """Of one part: units that an earlier document holds whole, and the first of units that share their anchor with others."""
        k, v, doc, first, n = (column_of(group, c, t) for c, t in KINDS.items())
        own = [column_of(group, c, t) for c, t in OWN.items()]
        order = np.lexsort((doc, v, k))
        k, v, doc, first, n = k[order], v[order], doc[order], first[order], n[order]
        whole = earliest_in(k, v, doc) < doc
        mixed = mixed_anchors(k, v, doc) & ~whole
        where = np.repeat([-1, group.column("part")[0].as_py()], [len(own[0]) + whole.sum(), mixed.sum()])
        return by_document(*(np.concatenate((o, x[whole], x[mixed])) for o, x in zip(own, (doc, first, n), strict=True)), where, parts)

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(passage: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens, offsets in slices(batches, "bytes", hashed=False):
            removed, spans, kept = [], [], []
            for gone, keep, n in pieces_of(removed_tokens(batch, tokens, passage), offsets):
                kept.append(b"".join(tokens.raw[a:b] for a, b in keep.tolist()))
                removed.append(gone), spans.append(n)
            sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), sha]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.record_batch([*columns, pa.array(kept, pa.binary())], [*names, "kept"]) if with_text else pa.record_batch(columns, names)

    return run


def suffix_dedup(docs: DataFrame, passage: int = PASSAGE, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept if wanted."""
    gram, parts = min(GRAM, passage), parts_for(docs)
    named = texts(docs).filter("doc_id is not null")
    sent = named.mapInArrow(_anchors(passage, gram, partitions(docs.sparkSession)), "seg long, hashes binary")
    # a bit for each byte of text at the least: an anchor comes about every twelve bytes
    seen = Filter(sent, parts * PART_BYTES, repeats=True)
    rows = named.mapInArrow(send_units("bytes", passage, gram, seen.has, parts), BUCKETS)
    settled = written(rows.groupBy("part").applyInArrow(_settle(parts), SPANS), "suffix-settled")
    marked = Marked(docs, settled, parts)
    spans = settled.unionByName(compared(marked, settled, "bytes", passage, parts))
    cut = marked.rows(spans, True).mapInArrow(_kept(passage, with_text), OUT + (", kept binary" if with_text else ""))
    whole = marked.rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.encode("text", "UTF-8").alias("kept")] if with_text else []))
    return cut.unionByName(whole)
