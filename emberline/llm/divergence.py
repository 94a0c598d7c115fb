"""How far the sources of a language differ, from exact counts of the terms they use.

A term carries its language, so that one CountVectorizer (document frequency at
least `min_df`, no bound on the vocabulary) holds the vocabulary of every language
on its own and turns its terms into exact sparse vectors. The vocabulary is first
sized by Spark, which counts documents by hash of the term, and then fitted in
slices by that hash, each of about SLICE_TERMS terms: more text gives more slices,
a slice reads its own terms only, and neither the driver nor a broadcast holds more
than one of them.

The vectorizer gets the documents condensed. A task reads SLICE_BYTES of text at a
time and holds HELD sums of terms by source: a term that a source repeats there is
in one row with a weight, and in further rows until they are as many as its
documents or `min_df`, so that the fit finds the same vocabulary. Terms that a Bloom
filter over the hashes of frequent ones rejects are in too few documents and left
out; those that it lets pass are for the fit to judge.

Vectors are summed by source (a term has its language), times their weights,
sparse: first within a batch of them, then by blocks of the vector, so that all
sources of a term come together and with them its sum over the language. Two
sources are compared over the terms that either has. With p0 for a term that a
group lacks and f the term's divergence,

    sum over all V kept terms = V f(p0, q0) + [terms of one: f(p, q0) - f(p0, q0)]
      + [terms of the other: f(p0, q) - f(p0, q0)]
      + [terms of both: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

where the first two need each group's histogram of counts only, and the last one
each term's own groups, summed within a task before the pairs shuffle. Everything
is integer arithmetic.

Defined results: null text, language and source are ''; a group without terms and
a language without kept terms have their pairs, at the smoothed shares or at 0;
repeated rows count each; ties rank by the bytes of the item; an empty table gives
no rows; very long texts are read whole. Only `lang`, `source` and `text` are read,
so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bloom import filter_of
from .common import byte_values, chunks, partitions, shared_path, span_hash, spans_within, text_or_empty, tidy, values, written

#: Terms of all languages in a slice of the vocabulary.
SLICE_TERMS = 1 << 19
SLICE_BYTES = 1 << 20
#: Sums that a task holds while it reads on, and terms in a batch of its result.
HELD, TERM_ROWS = 1 << 20, 1 << 14
#: Keys in a row for the vectorizer, which builds a map of each row.
ROW_KEYS = 1 << 11
#: Sources of a language that are compared at once, and pair sums that a task holds.
BLOCK, HELD_PAIRS = 1 << 10, 1 << 20
#: The largest value that CountVectorizer takes: the vocabulary isn't cut.
NO_BOUND = 2**31 - 1
SCALE = 1_000_000_000


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def keys_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Terms of a slice of texts, each followed by a space and its language, and the text of each. Terms are runs of letters and of characters beyond ASCII, with A-Z in lower case."""
    data, offsets = values(batch.column("text"))
    term = _IS_TERM[data]
    starts, ends = spans_within(term, offsets)
    text, size = np.searchsorted(offsets, starts, "right") - 1, ends - starts
    langs = batch.column("lang").dictionary_encode()
    names = [b" " + x.encode() for x in langs.dictionary.to_pylist()]
    lang = np.array(langs.indices, np.int64)[text]
    more = np.array([len(x) for x in names], np.int64)[lang]
    upto = np.concatenate(([0], np.cumsum(size + more)))
    out, own = np.empty(upto[-1], np.uint8), np.ones(upto[-1], bool)
    for k, name in enumerate(names):
        at = (upto[:-1] + size)[lang == k]
        for i, byte in enumerate(name):
            out[at + i] = byte
            own[at + i] = False
    out[own] = _LOW[data[term]]
    return pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(out)]), text


def hashes(terms: pa.Array) -> np.ndarray:
    data, offsets = values(terms)
    return span_hash(byte_values(data), offsets[:-1], offsets[1:])


def _lists(keys: pa.Array, first: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int64)), keys).cast(pa.list_(pa.string()))


def _firsts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(sorted_, prepend=sorted_[:1] - 1))


class _Sums:
    """Sums by key, added in pieces. Pieces are summed up when HELD keys have come, and go on being held while they are no more than that."""

    def __init__(self, columns: int) -> None:
        self.pieces: list[list[np.ndarray]] = []
        self.columns, self.come = columns, 0

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> bool:
        """Whether there are more sums than are to be held."""
        self.pieces.append([keys, *columns])
        self.come += len(keys)
        if self.come < HELD:
            return False
        self.pieces, self.come = [self.take()], 0
        return len(self.pieces[0][0]) > HELD

    def take(self) -> list[np.ndarray]:
        """The keys in order, and their sums; nothing is held afterwards."""
        whole = [np.concatenate(x) for x in zip(*self.pieces, strict=True)] or [np.zeros(0, np.int64)] * (1 + self.columns)
        self.pieces, self.come = [], 0
        order = np.argsort(whole[0])
        keys = whole[0][order]
        first = _firsts(keys)
        return [keys[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in whole[1:])]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of distinct keys and how many texts have each, summed over the slices of a task."""
    sums = _Sums(1)

    def out() -> pa.RecordBatch:
        hashed, n = sums.take()
        return pa.record_batch({"hash": pa.array(hashed), "n": pa.array(n)})

    for whole in batches:
        for batch in chunks(whole, "text", SLICE_BYTES):
            keys, text = keys_of(batch)
            found = keys.dictionary_encode()
            code, size = np.array(found.indices, np.int64), max(len(found.dictionary), 1)
            pairs = np.sort(text * size + code)
            n = np.bincount(pairs[_firsts(pairs)] % size, minlength=len(found.dictionary))
            if sums.add(hashes(found.dictionary).view(np.int64), n):
                yield out()
    yield out()


def _condensed(frequent: Callable[[np.ndarray], np.ndarray], parts: int, min_df: int):
    def rows(keys: pa.Array, names: list[str], cells: np.ndarray, times: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
        many = len(names)
        key, of = np.divmod(cells, many)
        # beside its row in each source, a key needs more rows until they are as many as its texts or min_df
        begin = _firsts(key)
        sources, before = np.diff(np.append(begin, len(key))), np.cumsum(texts - 1) - (texts - 1)
        more = np.maximum(np.minimum(np.add.reduceat(texts, begin), min_df) - sources, 0)
        more = np.clip(np.repeat(more + before[begin], sources) - before, 0, texts - 1)
        cell = np.repeat(np.arange(len(key)), more + 1)
        layer = np.arange(len(cell)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        weight = np.where(layer == 0, (times - more)[cell], 1)
        part = (hashes(keys) % np.uint64(parts)).astype(np.int64)[key[cell]] if parts > 1 else np.zeros(len(cell), np.int64)
        # rows by part and source, in them by weight and layer
        layers = layer.max() + 1
        outer, inner = part * many + of[cell], weight * layers + layer
        order = np.lexsort((inner, outer))
        outer, inner = outer[order], inner[order]
        row = np.flatnonzero(np.concatenate(([True], (np.diff(outer) != 0) | (np.diff(inner) != 0))))
        at = np.arange(len(order))
        row = np.flatnonzero((at - np.repeat(row, np.diff(np.append(row, len(at))))) % ROW_KEYS == 0)
        (part, of), weight = np.divmod(outer[row], many), inner[row] // layers
        return pa.record_batch({"source": pa.array(names, pa.string()).take(pa.array(of)), "weight": pa.array(weight), "keys": _lists(keys.take(pa.array(key[cell[order]])), row), "part": pa.array(part.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The frequent keys of many slices of texts, as few rows of distinct keys. The times that a source has a key are the sum of the weights of its rows with it; a key is in
        as many rows as texts, or in fewer that are still min_df at least."""
        seen: dict[str, int] = {}
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        come = 0

        def joined() -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """What is held, by distinct key and source. Keys are told apart by their bytes."""
            found = pa.chunked_array([x[0] for x in held]).combine_chunks().dictionary_encode()
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            key = np.array(found.indices, np.int64)[np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])]
            sums, many = _Sums(2), len(seen)
            sums.pieces = [[key * many + np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])]]
            held.clear()
            cells, times, texts = sums.take()
            key, of = np.divmod(cells, many)
            return found.dictionary, key.astype(np.int32), of.astype(np.int32), times, texts

        def out(keys: pa.Array, key: np.ndarray, of: np.ndarray, times: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
            return rows(keys, list(seen), key * np.int64(len(seen)) + of, times, texts)

        for whole in batches:
            for batch in chunks(whole, "text", SLICE_BYTES):
                keys, text = keys_of(batch)
                found = keys.dictionary_encode()
                own = frequent(hashes(found.dictionary))
                code = (np.cumsum(own) - 1)[np.array(found.indices)]
                has = own[np.array(found.indices)]
                code, text = code[has], text[has]
                if not len(code):
                    continue
                source = batch.column("source").dictionary_encode()
                many = len(source.dictionary)
                places = np.sort((code * many + np.array(source.indices, np.int64)[text]) * batch.num_rows + text)
                cells = places // batch.num_rows
                first = _firsts(cells)
                times = np.diff(np.append(first, len(cells)))
                texts = np.add.reduceat((np.diff(places, prepend=-1) != 0).astype(np.int64), first)
                key, of = np.divmod(cells[first], many)
                known = np.array([seen.setdefault(x, len(seen)) for x in source.dictionary.to_pylist()], np.int32)
                held.append((found.dictionary.filter(pa.array(own)), key.astype(np.int32), known[of], times, texts))
                come += len(key)
                if come >= HELD:
                    held, come = [joined()], 0
                    if len(held[0][1]) > HELD:
                        yield out(*held.pop())
        if held:
            yield out(*joined())

    return run


def _summed(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weighted sums of sparse vectors by source over a batch of them, sparse again, dealt out by the place in the vector."""
        for batch in batches:
            source = batch.column("source").dictionary_encode()
            size = np.diff(np.array(batch.column("at").offsets))
            at, x = np.array(batch.column("at").flatten(), np.int64), np.array(batch.column("x").flatten()).astype(np.int64)
            if not len(at):
                continue
            many, width, sums = len(source.dictionary), at.max() + 1, _Sums(1)
            sums.add((at % blocks * width + at) * many + np.repeat(np.array(source.indices, np.int64), size), x * np.repeat(np.array(batch.column("weight")), size))
            cell, n = sums.take()
            cell, of = np.divmod(cell, many)
            block, at = np.divmod(cell, width)
            first = _firsts(block)
            whole = pa.record_batch({"source": pa.DictionaryArray.from_arrays(pa.array(of.astype(np.int32)), source.dictionary), "at": pa.array(at.astype(np.int32)), "n": pa.array(n)})
            sent = []
            for a, b in zip(first, [*first[1:], len(block)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema) as to:
                    to.write_batch(whole.slice(a, b - a))
                sent.append(sink.getvalue().to_pybytes())
            yield pa.record_batch({"block": pa.array(block[first].astype(np.int32)), "cells": pa.array(sent, pa.binary())})

    return run


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of whole blocks added up: of each place in the vectors the sources that have it, and its sum over them."""
    seen: dict[str, int] = {}
    sums = _Sums(1)
    for batch in batches:
        for blob in batch.column("cells"):
            with pa.ipc.open_stream(blob.as_buffer()) as come:
                for piece in come:
                    known = np.array([seen.setdefault(x, len(seen)) for x in piece.column("source").dictionary.to_pylist()], np.int64)
                    sums.add(np.array(piece.column("at"), np.int64) * NO_BOUND + known[np.array(piece.column("source").indices)], np.array(piece.column("n")))
    cell, n = sums.take()
    at, of = np.divmod(cell, NO_BOUND)
    first = _firsts(at)
    names = pa.array(list(seen), pa.string())
    for i in range(0, len(first), TERM_ROWS):
        a, b = first[i], first[i + TERM_ROWS] if i + TERM_ROWS < len(first) else len(at)
        own = first[i : i + TERM_ROWS]
        groups = pa.StructArray.from_arrays([names.take(pa.array(of[a:b])), pa.array(n[a:b])], ["source", "n"])
        yield pa.record_batch({"at": pa.array(at[own].astype(np.int32)), "n_lang": pa.array(np.add.reduceat(n[a:b], own - a)), "groups": pa.ListArray.from_arrays(pa.array(np.append(own - a, b - a).astype(np.int32)), groups)})


def group_counts(docs: DataFrame, min_df: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts, groups): lang, term, n_lang, groups (source and n > 0 of each) for kept terms; and every (lang, source) that occurs."""
    spark = docs.sparkSession
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty().alias("text"))
    groups = written(rows.select("lang", "source").distinct(), "divergence-groups")
    # how large the vocabulary is, by hashes of its terms; which terms are in it is for the fit to say
    hashed = rows.mapInArrow(_hashed, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    used = written(hashed.filter(F.col("n") >= min_df).select("hash"), "divergence-hashes")
    size = used.count()
    parts = -(-size // SLICE_TERMS)
    schema = "lang string, term string, n_lang long, groups array<struct<source: string, n: long>>"
    if not parts:
        return spark.createDataFrame([], schema), groups
    terms = rows.mapInArrow(_condensed(filter_of(used, size, repeats=False).has, parts, min_df), "source string, weight long, keys array<string>, part int")
    if parts > 1:  # a slice is read on its own later, so its rows come together
        whole, path = terms, shared_path(spark, "divergence-slices")
        with tidy(spark):
            whole.hint("rebalance", "part").write.partitionBy("part").parquet(path)
        terms = spark.read.schema(whole.schema).parquet(path)
    else:
        terms = written(terms.drop("part"), "divergence-terms")
    path, blocks = shared_path(spark, "divergence-counts"), partitions(spark)
    for part in range(parts):
        keys = (terms.filter(F.col("part") == part) if parts > 1 else terms).select("source", "weight", "keys")
        model = CountVectorizer(inputCol="keys", outputCol="vector", minDF=float(min_df), vocabSize=NO_BOUND).fit(keys)
        saved = shared_path(spark, "divergence-vocabulary")
        model.save(saved)
        names = spark.read.parquet(f"{saved}/data").select(F.posexplode("vocabulary").alias("at", "key"))
        vectors = model.transform(keys).select("source", "weight", F.unwrap_udt("vector").alias("v")).select("source", "weight", F.col("v.indices").alias("at"), F.col("v.values").alias("x"))
        sums = vectors.mapInArrow(_summed(blocks), "block int, cells binary").repartition("block").mapInArrow(_by_term, "at int, n_lang long, groups array<struct<source: string, n: long>>")
        lang = F.substr("key", F.length(F.substring_index("key", " ", 1)) + 2)
        with tidy(spark):
            sums.join(names, "at").select(lang.alias("lang"), F.substring_index("key", " ", 1).alias("term"), "n_lang", "groups").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path), groups


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact for any count of a long; 0 where nothing is kept."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, bottom = F.lit(SCALE).cast("decimal(18,0)") * wide(count + 2), wide(total + terms * 2)
    near = F.call_function("div", F.lit(SCALE).cast("long") * (count + 2), total + terms * 2)
    return F.when(terms == 0, F.lit(0).cast("long")).when(count < (2**63 - 1) // SCALE - 2, near + 1).otherwise(F.call_function("div", top, bottom) + 1)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The divergence of each pair; shares are below 2^30, so squares fit a long."""
    return (p - q) ** 2 // np.maximum(p + q, 1)


def _sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group with a block of groups, what its own terms add against groups that lack them; once for a pair, what all V terms add where both lack them."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, q0 = np.array(r["ids"], np.int64), np.array(r["zeros"], np.int64)
            other = ids != r["id"]
            ids, q0 = ids[other], q0[other]
            base = _f(np.int64(r["p0"]), q0)
            value = np.where(ids > r["id"], base * r["terms"], 0)
            for p, n in zip(r["shares"] or [], r["times"] or [], strict=True):
                value += n * (_f(np.int64(p), q0) - base)
            low, high = np.minimum(ids, r["id"]), np.maximum(ids, r["id"])
            yield pa.record_batch({"lang": pa.array([r["lang"]] * len(ids), pa.string()), "a": pa.array(low), "b": pa.array(high), "value": pa.array(value)})


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of groups, what the terms of both add beyond the one-sided sums. Pairs are summed here first, HELD_PAIRS at most."""
    held: dict[str, list[np.ndarray]] = {}

    def flush(lang: str) -> pa.RecordBatch:
        pair, value = held.pop(lang)
        return pa.record_batch({"lang": pa.array([lang] * pair.shape[1], pa.string()), "a": pa.array(pair[0]), "b": pa.array(pair[1]), "value": pa.array(value)})

    def add(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        if lang in held:
            a, b, value = np.concatenate((held[lang][0][0], a)), np.concatenate((held[lang][0][1], b)), np.concatenate((held[lang][1], value))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0))))
        held[lang] = [np.stack((a[first], b[first])), np.add.reduceat(value[order], first)]

    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        names, which = lang.dictionary.to_pylist(), np.array(lang.indices)
        lists = batch.column("groups")
        ends = np.array(lists.offsets, np.int64)
        ids, p, p0 = (np.array(lists.values.field(f)) for f in ("id", "p", "p0"))
        size = np.diff(ends)
        for k in np.unique(size[size > 1]):
            for at, name in enumerate(names):
                begin = ends[:-1][(size == k) & (which == at)]
                i, step = 0, max(1, HELD_PAIRS // int(k))
                while i < k - 1:
                    # rows i.. of the triangle of pairs, as many as fit
                    take = max(1, min(int(k) - 1 - i, step // int(k)))
                    x, y = (v.ravel() for v in np.meshgrid(np.arange(i, i + take), np.arange(i + 1, k), indexing="ij"))
                    x, y = x[x < y], y[x < y]
                    some = max(1, HELD_PAIRS // len(x))
                    for j in range(0, len(begin), some):
                        left, right = (begin[j : j + some, None] + x).ravel(), (begin[j : j + some, None] + y).ravel()
                        value = _f(p[left], p[right]) - _f(p[left], p0[right]) - _f(p0[left], p[right]) + _f(p0[left], p0[right])
                        add(name, ids[left], ids[right], value)
                    i += take
                    if name in held and held[name][0].shape[1] > HELD_PAIRS:
                        yield flush(name)
    for name in list(held):
        yield flush(name)


def divergence(docs: DataFrame, min_df: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` compares a source with each other one of its language, part `term` lists the terms it uses more than the language does."""
    counts, groups = group_counts(docs, min_df)
    of_lang = counts.groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count(F.lit(1)).alias("terms"))
    counts = counts.select("lang", "term", "n_lang", F.inline("groups"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "total_lang", "terms"])
    sized = sized.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    sized = written(sized.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("terms"))), "divergence-sizes")

    shares = counts.join(sized, ["lang", "source"]).select("lang", "source", "id", "term", "n_lang", "total_lang", "terms", "p0", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    q = _share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    told = shares.withColumn("q", q).filter("p > q")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    listed = listed.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    # how many terms of a group have each share: a few values, however many terms
    histogram = shares.groupBy("lang", "id", "p").agg(F.count(F.lit(1)).alias("times")).groupBy("lang", "id").agg(F.sort_array(F.collect_list(F.struct("p", "times"))).alias("h"))
    left = sized.join(histogram, ["lang", "id"], "left").select("lang", "id", "p0", "terms", F.col("h.p").alias("shares"), F.col("h.times").alias("times"))
    block = sized.groupBy("lang", F.floor((F.col("id") - 1) / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "p0"))).alias("g"))
    block = block.select("lang", F.col("g.id").alias("ids"), F.col("g.p0").alias("zeros"))
    pair = "lang string, a long, b long, value long"
    sided = left.join(block, "lang").mapInArrow(_sided, pair)
    met = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("id", "p", "p0"))).alias("groups")).filter("size(groups) > 1")
    values = sided.unionByName(met.select("lang", "groups").mapInArrow(_shared_terms, pair)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = values.select("lang", "value", F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))))
    name = sized.select("lang", "id", "source")
    pairs = both.join(name, ["lang", "id"]).join(name.select("lang", F.col("id").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(listed)
