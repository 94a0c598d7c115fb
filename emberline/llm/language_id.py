"""Language identification by prediction by partial matching.

For each language a context tree of bytes holds how often each byte followed
each context of up to three bytes. An unseen byte escapes to the next shorter
context, with the escape probability of method C (distinct / (count + distinct))
and with the bytes of the longer context excluded. After training the trees are
frozen into code lengths: of every byte seen after a context, and of the escape
from it, so that the exact code length of any byte is a short sum down its chain
of contexts. All contexts of the sample are kept. The language with the shortest
code wins. A byte near the start of a text has as much context as there is.

Defined results: null text and texts without a letter are `und` with score 0;
ties go to the language that sorts first; with no rows to learn from every text
is `und`; repeated rows are scored each; very long texts are read whole, one at a
time; columns of the input may have any name that does not start with `__li_`
(`lang_pred` and `score` are replaced); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, held_out_rest, text_or_empty, values, written

#: The training sample: texts of each language at most, read whole.
TRAIN_DOCS = 250
#: Tasks that count the sample.
COUNT_PARTS = 2
SLICE_BYTES = 2 << 20


@dataclass
class Tree:
    """Of one language, for orders 0..3: (context, byte) codes seen, sorted, with their code lengths, and contexts with those of their escape."""

    codes: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]
    symbols: int  # bytes that training saw, and one more that stands for all others


@dataclass
class Grams:
    """For orders 0..3 the (context, byte) sequences of a language as numbers of base 256, sorted, and how often each came."""

    counts: list[tuple[np.ndarray, np.ndarray]]


def _slice_grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sequences of 1 to 4 bytes of a slice and their counts; they stay within a text."""
    out, s = [], data.astype(np.int64)
    code, start = s, np.repeat(offsets[:-1], np.diff(offsets))
    for order in range(4):
        if order:
            code = s[: max(len(s) - order, 0)] * 256**order + code[1:]
        inside = start[: len(code)] == start[order:] if len(code) else np.zeros(0, bool)
        out.append(np.unique(code[inside], return_counts=True))
    return out


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _found(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def byte_bits(tree: Tree, symbols: int, code: np.ndarray, order: int) -> np.ndarray:
    """Code lengths in bits of the last bytes of `code` (context and byte as a number of base 256) after `order` bytes of context."""
    out, todo = np.zeros(len(code)), np.arange(len(code))
    for o in range(order, -1, -1):
        key = code[todo] & (256 ** (o + 1) - 1)
        at, seen = _found(tree.codes[o], key)
        out[todo[seen]] += tree.bits[o][at[seen]]
        todo, key = todo[~seen], key[~seen]
        at, known = _found(tree.contexts[o], key >> 8)
        out[todo[known]] += tree.escape[o][at[known]]
    out[todo] += np.log2(symbols)
    return out


def _grow(grams: Grams, symbols: int) -> Tree:
    """A context's own bytes by method C; the escape's share is spread over the bytes it has not, by the shorter context's distribution."""
    tree = Tree([], [], [], [])
    for order, (code, n) in enumerate(grams.counts):
        context, first = np.unique(code >> 8, return_index=True)
        own = np.repeat(np.arange(len(context)), np.diff(np.append(first, len(code))))
        if order:
            shorter = 2.0 ** -byte_bits(tree, symbols, code & (256**order - 1), order - 1)
        else:
            shorter = np.full(len(code), 1 / symbols)
        total, kinds = np.bincount(own, n, len(context)), np.bincount(own, minlength=len(context))
        rest = 1 - np.bincount(own, shorter, len(context))
        closed = rest < 1e-12  # nothing is left to escape to
        tree.codes.append(code)
        tree.bits.append(np.log2(np.where(closed, total, total + kinds)[own] / n))
        tree.contexts.append(context)
        tree.escape.append(np.log2((total + kinds) / np.maximum(kinds, 1)) + np.log2(np.where(closed, 1, rest)))
    return tree


def train(samples: dict[str, list[bytes]] | dict[str, Grams]) -> Model | None:
    """Model from sample texts, or from their counts, by language; None if there are none."""
    grams = {k: v if isinstance(v, Grams) else Grams(_slice_grams(*_join(v))) for k, v in samples.items()}
    grams = {k: g for k, g in grams.items() if len(g.counts[0][0])}
    languages = sorted(grams)
    if not languages:
        return None
    seen = np.unique(np.concatenate([g.counts[0][0] for g in grams.values()]))
    symbols = len(seen) + 1
    return Model(languages, [_grow(grams[k], symbols) for k in languages], symbols)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages) code lengths in bits."""
    s, starts, size = data.astype(np.int64), offsets[:-1], np.diff(offsets)
    out = np.zeros((len(size), len(model.languages)))
    code = np.zeros(len(s), np.int64)
    for i in range(4):
        code[i:] |= s[: len(s) - i] << (8 * i)
    # texts share few distinct sequences of four bytes: each is coded once
    long = np.flatnonzero(np.repeat(starts, size) + 3 <= np.arange(len(s)))
    text = np.repeat(np.arange(len(size)), size)[long]
    distinct, which = np.unique(code[long].astype(np.uint32), return_inverse=True)
    some = np.flatnonzero(size > 3)
    for k, tree in enumerate(model.trees):
        bits = byte_bits(tree, model.symbols, distinct.astype(np.int64), 3)[which]
        if len(some):
            out[some, k] = np.add.reduceat(bits, np.searchsorted(text, some))
        for order in range(3):
            on = np.flatnonzero(size > order)
            out[on, k] += byte_bits(tree, model.symbols, code[starts[on] + order], order)
    return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in chunks(whole, "__li_text", SLICE_BYTES):
                bits = code_lengths(model, *values(batch.column("__li_text")))
                best = bits.argmin(axis=1)
                gap = np.minimum(bits - bits[np.arange(len(bits)), best][:, None], 1000)
                p = 1 / (2.0**-gap).sum(axis=1)
                letters = batch.column("__li_letters").to_numpy(zero_copy_only=False)
                lang = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                rest = [c for c in batch.schema.names if c not in ("__li_text", "__li_letters")]
                yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(lang, pa.string()), pa.array(np.where(letters, p, 0.0))], [*rest, "lang_pred", "score"])

    return run


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text", SLICE_BYTES):
            lang = batch.column("lang").to_numpy(zero_copy_only=False)
            for kind in sorted(set(lang)):
                data, offsets = values(batch.column("text").filter(pa.array(lang == kind)))
                for order, (code, n) in enumerate(_slice_grams(data, offsets)):
                    yield pa.record_batch({"lang": pa.array([kind] * len(code), pa.string()), "ord": pa.array(np.full(len(code), order, np.int32)), "code": pa.array(code), "n": pa.array(n.astype(np.int64))})


def sample(labelled: DataFrame, docs_per_language: int = TRAIN_DOCS) -> dict[str, Grams]:
    """Counts over at most docs_per_language whole texts of each language, picked by a hash of the id.

    Executors count; the driver gets the distinct sequences of up to four bytes of the sample.
    """
    usable = labelled.filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    picked = F.abs(F.xxhash64("doc_id") % 1_000_000)
    # about 1.2 times what is wanted, then the limit: no language is sorted as a whole
    wanted = F.lit(False)
    for lang, n in sizes.items():
        wanted = wanted | ((F.col("lang") == lang) & (picked < int(1_200_000 * docs_per_language / n) + 1))
    texts = written(usable.filter(wanted).select("lang", "text", picked.alias("p"), F.xxhash64("text").alias("h")), "language-sample")
    place = F.row_number().over(W.partitionBy("lang").orderBy("p", "h"))
    # the places are dealt without the texts; texts alike in p and h are alike
    last = texts.select("lang", "p", "h").withColumn("k", place).filter(F.col("k") <= docs_per_language).groupBy("lang", "p", "h").agg(F.count(F.lit(1)).alias("most"))
    some = texts.join(last, ["lang", "p", "h"]).withColumn("k", F.row_number().over(W.partitionBy("lang", "p", "h").orderBy("p"))).filter("k <= most")
    # the sample is small: few parts, else each part repeats the common sequences
    grams = some.select("lang", "text").coalesce(COUNT_PARTS).mapInArrow(_gram_rows, "lang string, ord int, code long, n long").groupBy("lang", "ord", "code").agg(F.sum("n").alias("n"))
    found = grams.toArrow().sort_by([("lang", "ascending"), ("ord", "ascending"), ("code", "ascending")])
    order, code, n = (found.column(c).to_numpy() for c in ("ord", "code", "n"))
    names = found.column("lang").combine_chunks().dictionary_encode()
    lang, listed = np.array(names.indices), names.dictionary.to_pylist()
    out = {}
    for k in sizes:
        own = lang == listed.index(k) if k in listed else np.zeros(len(lang), bool)
        out[k] = Grams([(code[own & (order == o)], n[own & (order == o)]) for o in range(4)])
    return out


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score."""
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    if model is None:
        return docs.select(*rest, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*rest, text_or_empty(text_col).alias("__li_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__li_letters"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if not n.startswith("__li_"))
    return rows.mapInArrow(_score(shared), f"{schema}, lang_pred string, score double")


def learnable(docs: DataFrame, mod: int, held: int) -> DataFrame:
    return docs.filter(held_out_rest(F.col("doc_id"), mod) != held)
