"""Near-duplicate classes by DartMinHash.

A document is a weighted set: its shingles of five words, each with the number
of times it comes; weights may be any positive numbers. The plane of weight and
rank over each element is cut into regions that double in weight, and darts are
thrown by hash into each region below the element's weight: their ranks are
exponentially spaced, the denser the wider the region, and a dart counts if it
falls below the weight. So the cost grows with the logarithm of a weight. Each
dart belongs to one of the signature's coordinates; the earliest one of each
coordinate is kept, so two documents agree at a coordinate with probability equal
to their weighted Jaccard similarity. Only darts up to a rank that suffices for
the document's total weight are thrown. Bands of the signature are joined on
equality.

Equal word sequences are one text: only the smallest doc_id of each goes on. In
a bucket every text is compared with the smallest one, on the true weighted sets.
Texts that this leaves in different components of one bucket are joined by prefix
and position filtering, which is exact: all pairs of them that can still be
similar are compared. So every pair of texts that agree in a whole band ends up
either in one class or compared. Which texts meet is decided by bands (a pair at
the similarity meets in none once in some 12 000 times), what is linked by sets.

Defined results: a text of fewer than five words has one shingle, all its words;
texts without a word are equal to each other; null text is empty; rows that share
a doc_id fall in one class; rows without a doc_id have a null class; ties of
similarity at the threshold are links; very long texts are read whole; other
columns of the input are not read; an empty table gives an empty table. doc_id is
an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, chunks, mix64, span_hash, text_or_empty, values, written
from .repeats import Tokens

SHINGLE, SIMILARITY = 5, 0.8
#: Rows of a band and bands: a pair at the similarity shares no band once in some 12 000 times.
ROWS, BANDS = 7, 40
SLICE_BYTES = 1 << 20


def elements(tokens: Tokens, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight) of each text's distinct shingles, by text and element."""
    sizes = np.diff(tokens.offsets)
    n = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(sizes)), n)
    first = tokens.offsets[text] + np.arange(len(text)) - np.concatenate(([0], np.cumsum(n)))[:-1][text]
    x = span_hash(tokens.values, first, np.minimum(first + shingle, tokens.offsets[text + 1]))
    order = np.lexsort((x, text))
    text, x = text[order], x[order]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (x[1:] != x[:-1])))) if len(x) else np.zeros(0, np.int64)
    return text[new], x[new], np.diff(np.append(new, len(x))).astype(np.float64)


_REGION, _HEIGHT = 0xD1342543DE82EF95, np.uint64(0x2545F4914F6CDD1D)


def regions(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element number, seed and lower edge of the weight regions [2**i - 1, 2**(i + 1) - 1) that each element reaches into."""
    many = np.floor(np.log2(weight + 1)).astype(np.int64)
    many += 2.0**many - 1 < weight
    of = np.repeat(np.arange(len(x)), many)
    i = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    return of, mix64(x[of] + (i + 1).astype(np.uint64) * np.uint64(_REGION)), 2.0**i - 1


def _uniform(dart: np.ndarray) -> np.ndarray:
    return ((dart >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(text: np.ndarray, x: np.ndarray, weight: np.ndarray, count: int, size: int) -> np.ndarray:
    """(count, size) dart ids, 0 for texts without elements. Elements must be grouped by text."""
    total = np.bincount(text, weight, minlength=count)
    best, ids = np.full(count * size, np.inf), np.zeros(count * size, np.uint64)
    of, seed, low = regions(x, weight)
    need = np.log(size) + 4
    todo = np.flatnonzero(total)
    limit, done_to = np.zeros(count), np.zeros(count)
    while len(todo):
        limit[todo] = size * need / total[todo]
        on = np.flatnonzero(np.isin(text[of], todo)) if len(todo) < count else np.arange(len(of))
        t, e, below, w = text[of[on]], seed[on], low[on], weight[of[on]]
        rank, i = np.zeros(len(t)), 0
        while len(t):
            i += 1
            dart = mix64(e + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64))
            rank = rank - np.log(_uniform(dart)) / (below + 1)  # a region is as wide as its lower edge and one
            stay = rank <= limit[t]
            t, e, below, w, rank, dart = t[stay], e[stay], below[stay], w[stay], rank[stay], dart[stay]
            fresh = np.flatnonzero(rank > done_to[t])
            # of the highest region an element reaches only a part lies below its weight
            part = w[fresh] < 2 * below[fresh] + 1
            fresh = fresh[~part | (below[fresh] + (below[fresh] + 1) * (1 - _uniform(mix64(dart[fresh] ^ _HEIGHT))) < w[fresh])]
            slot = t[fresh] * size + (mix64(dart[fresh]) % np.uint64(size)).astype(np.int64)
            r, d = rank[fresh], dart[fresh]
            np.minimum.at(best, slot, r)
            won = best[slot] == r
            ids[slot[won]] = d[won]
        done_to[todo] = limit[todo]
        todo = todo[np.isinf(best.reshape(count, size)[todo]).any(axis=1)]
        need *= 2
    return ids.reshape(count, size)


def band_keys(ids: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(texts, bands) one number for each band, different bands never alike."""
    odd = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    mixed = (ids.reshape(len(ids), bands, rows) * odd).sum(axis=2, dtype=np.uint64)
    return mix64(mixed ^ mix64(np.arange(bands, dtype=np.uint64) + np.uint64(77)))


def _bands(rows: int, bands: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", SLICE_BYTES):
                tokens = Tokens("words", *values(batch.column("text")))
                text, x, weight = elements(tokens, shingle)
                keys = band_keys(signatures(text, x, weight, batch.num_rows, rows * bands), rows, bands)
                has = np.bincount(text, minlength=batch.num_rows) > 0
                sizes = np.where(has, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(keys[has].ravel().view(np.int64)))
                yield pa.record_batch([batch.column("doc_id"), batch.column("key"), lists], ["doc_id", "key", "bands"])

    return run


#: A weighted set: sorted elements (64-bit) and their weights (32-bit floats).
SET = "doc long, elements binary, weights binary"


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", SLICE_BYTES):
                text, x, weight = elements(Tokens("words", *values(batch.column("text"))), shingle)
                cuts = np.searchsorted(text, np.arange(1, batch.num_rows))
                blobs = [pa.array([p.tobytes() for p in np.split(v, cuts)], pa.binary()) for v in (x, weight.astype(np.float32))]
                yield pa.record_batch([batch.column("doc_id"), *blobs], ["doc", "elements", "weights"])

    return run


def similarity_of(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = float(np.minimum(wx[at], wy)[x[at] == y].sum(dtype=np.float64))
    return both / (float(wx.sum(dtype=np.float64) + wy.sum(dtype=np.float64)) - both)


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            columns = [batch.column(c).to_pylist() for c in ("xa", "wa", "xb", "wb")]
            for i, (xa, wa, xb, wb) in enumerate(zip(*columns, strict=True)):
                if xa and xb:
                    keep[i] = similarity_of(np.frombuffer(xa, np.uint64), np.frombuffer(wa, np.float32), np.frombuffer(xb, np.uint64), np.frombuffer(wb, np.float32)) >= least - 1e-9
            mask = pa.array(keep)
            yield pa.record_batch([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(doc, class): the smallest document that each document of the edges (a, b) is connected with.

    Labels spread to neighbours and then jump along themselves, so the rounds are
    about the logarithm of the longest path. Every round is written.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a"))
    labels = written(both.groupBy(F.col("src").alias("doc")).agg(F.least(F.min("dst"), F.first("src")).alias("class")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("doc", "src"), "src").groupBy(F.col("dst").alias("doc")).agg(F.min("class").alias("heard"))
        near = labels.join(heard, "doc").select("doc", F.least("class", "heard").alias("near"), F.col("class").alias("old"))
        jump = labels.select(F.col("doc").alias("near"), F.col("class").alias("far"))
        new = written(near.join(jump, "near").select("doc", F.least("near", "far").alias("class"), "old"), "labels")
        labels = new.select("doc", "class")
        if new.filter("class <> old").isEmpty():
            return labels


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = values(batch.column("elements"))
        n = np.diff(offsets) // 8
        weights = np.frombuffer(values(batch.column("weights"))[0].tobytes(), np.float32).astype(np.float64)
        total = np.bincount(np.repeat(np.arange(len(n)), n), weights, minlength=len(n))
        pick = lambda c: batch.column(c).take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.record_batch([pick("doc"), pick("c"), pa.array(np.repeat(total, n)), pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(weights)], ["doc", "c", "total", "element", "weight"])


def candidates(sets: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members (doc, c) of different components that can still be similar, each once.

    Elements are put in one order for all, the rarest first. Similar sets share an
    element so early in both that the weight from there on can make up the overlap
    they need: this prefix and position filter is exact, and a text whose rare
    elements are its own meets no other, however many texts share its common ones.
    The join is on the element and on the magnitude of the total weight, which
    similar sets share up to one step, so an element that many texts have is split.
    """
    rows = sets.join(members, "doc").select("doc", "c", "elements", "weights").mapInArrow(_listed, "doc long, c long, total double, element long, weight double")
    counted = rows.groupBy("element").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # elements of one text only come first in the order; they count by their weight alone
    ranked = rows.join(counted, "element", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    before = F.sum("weight").over(W.partitionBy("doc", "c").orderBy("df", "element").rowsBetween(W.unboundedPreceding, -1))
    front = ranked.withColumn("left", F.col("total") - F.coalesce(before, F.lit(0.0))).filter((F.col("df") > 1) & (F.col("left") >= F.col("total") * similarity - 1e-6)).select("doc", "c", "total", "left", "element")
    size = F.log("total") / -float(np.log(similarity))
    other = front.select(F.col("doc").alias("doc2"), F.col("c").alias("c2"), F.col("total").alias("total2"), F.col("left").alias("left2"), "element", F.floor(size).alias("size"))
    front = front.withColumn("size", F.explode(F.array_distinct(F.array(F.floor(size), F.floor(size) + 1, F.floor(size + 1 + 1e-9)))))
    need = (F.col("total") + F.col("total2")) * (similarity / (1 + similarity)) - 1e-6
    lighter = (F.col("total") < F.col("total2")) | ((F.col("total") == F.col("total2")) & (F.col("doc") < F.col("doc2")))
    joined = front.join(other, (front["element"] == other["element"]) & (front["size"] == other["size"]) & (F.col("c") != F.col("c2")) & lighter & (F.least("left", "left2") >= need) & (F.col("total") >= F.col("total2") * similarity - 1e-6))
    return joined.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def near_classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id and class_id, the smallest doc_id of its class of near-duplicates."""
    norm = F.trim(F.regexp_replace(text_or_empty(), SPACE_CLASS, " "))
    source = docs.select("doc_id", text_or_empty().alias("text"), F.md5(norm).alias("key"))
    signed = source.filter("doc_id is not null").select("doc_id", "text", "key")
    signed = written(signed.mapInArrow(_bands(rows, bands, shingle), "doc_id long, key string, bands array<long>"), "near-bands")
    firsts = written(signed.groupBy("key").agg(F.min("doc_id").alias("rep")), "near-firsts")  # written: the join may then split a large group of copies
    same = written(signed.select("doc_id", "key").join(firsts, "key").select("doc_id", "rep"), "near-copies")
    reps = signed.join(same.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    keyed = reps.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("h"))
    shared = keyed.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("h", "lo")
    buckets = written(keyed.join(shared, "h"), "near-buckets")  # members of buckets with two texts or more

    involved = buckets.select(F.col("doc").alias("doc_id")).distinct()
    sets = written(source.select("doc_id", "text").join(involved, "doc_id", "left_semi").mapInArrow(_sets(shingle), SET), "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of (a, b), a < b, those that are similar."""
        left = sets.select(F.col("doc").alias("a"), F.col("elements").alias("xa"), F.col("weights").alias("wa"))
        right = sets.select(F.col("doc").alias("b"), F.col("elements").alias("xb"), F.col("weights").alias("wb"))
        return written(pairs.join(right, "b").join(left, "a").select("a", "b", "xa", "wa", "xb", "wb").mapInArrow(_similar(similarity), "a long, b long"), "near-links")

    def apart() -> DataFrame:
        """Members, with their component, of the buckets that still hold several components."""
        member = buckets.select("h", "doc").join(classes, "doc", "left").select("h", "doc", F.coalesce("class", "doc").alias("c"))
        mixed = member.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("h")
        return member.join(mixed, "h", "left_semi").select("doc", "c").distinct()

    tried = written(buckets.filter("lo < doc").select(F.col("lo").alias("a"), F.col("doc").alias("b")).distinct(), "near-pairs")
    links = verified(tried)
    classes = components(links)
    apart_ = written(apart(), "near-apart")
    if not apart_.isEmpty():
        more = written(candidates(sets, apart_, similarity).join(tried, ["a", "b"], "left_anti"), "near-pairs")
        found = verified(more)
        if not found.isEmpty():
            classes = components(links.unionByName(found))
    named = same.join(classes.select(F.col("doc").alias("rep"), "class"), "rep", "left")
    out = named.select("doc_id", F.coalesce("class", "rep").alias("class_id"))
    return out.unionByName(docs.filter("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id")))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of each class the document with the smallest doc_id; rows without a doc_id stay."""
    gone = near_classes(docs, **options).filter("class_id < doc_id").select(F.col("doc_id").alias("__nd_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__nd_id"), "left_anti")
