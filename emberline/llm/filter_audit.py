"""How filters of documents interact, by a Gray-code walk over all their subsets.

A document is known by the set of filters that it fails, and documents of a part
with the same set form one cell: k filters give 2^k cells at most, however many
documents there are. Cells are counted by Spark. Within a part a walk in Gray-code
order visits every subset of the filters by toggling one filter at a time. Each
cell keeps how many active filters it fails; a toggle moves that counter for the
cells of one filter, and those that leave or reach zero change the running number
of survivors. The 2^k numbers of survivors are stored, and every figure of every
order of the filters is a difference of two of them.

The filter of copies needs the whole table: rows shuffle by digest, counted before
they meet, so that a group of copies costs a few rows whatever its size.

Defined results: null text is empty, a null part is the part ''; a null id has no
smaller id, and any id that isn't null is smaller; rows that repeat an id and its
text are no copies of each other and count each; a row is good (or whatever the
outcome says) if any row of `labels` with its id says so; very long texts are read
whole, one at a time; an empty table has no parts and gives no rows. Columns of
the inputs may have any name: only those named as arguments are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty

#: Every order of the filters is reported, so their number is bounded.
MOST_FILTERS = 7


def short_text(text: Column, words: Column, least: int = 200) -> Column:
    return F.size(words) < least


def repetitive(text: Column, words: Column, percent: int = 50) -> Column:
    return F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(percent).cast("long")


def shouting(text: Column, words: Column, percent: int = 3) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.length(text) * F.lit(percent).cast("long")


def has_symbols(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Filters by letter: what makes a text fail, given it and its words.
TEXT_FILTERS = {"A": short_text, "B": repetitive, "C": shouting, "D": has_symbols}
COPIES = "E"


def failures(docs: DataFrame, filters: dict = TEXT_FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, digest of the text, and mask: bit i is set where the text fails the i-th filter."""
    text = text_or_empty(text_col)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + fails(text, words).cast("int") * F.lit(1 << i)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))


def with_outcomes(rows: DataFrame, labels: DataFrame, outcomes: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """rows with one 0/1 column for each outcome; a row without labels has none of them."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, c in outcomes.items()))
    return rows.join(known, "id", "left").fillna(0, list(outcomes))


def cells(rows: DataFrame, outcomes: Sequence[str], copies_bit: int) -> DataFrame:
    """part, mask and the counts of its documents: all of them, and those with each outcome. Copies get their bit here."""
    kind = ["digest", "part", "mask", *outcomes]
    # rows of one id first: how many rows has the smallest id of a kind? Later steps see a few rows of each digest
    by_id = rows.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    by_kind = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"))
    lowest = F.min("first").over(Window.partitionBy("digest"))
    stay = F.when(F.col("lowest").isNull(), F.col("n")).when(F.col("first") == F.col("lowest"), F.col("n_first")).otherwise(0)
    split = by_kind.withColumn("lowest", lowest).withColumn("stay", stay)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + F.lit(1 << copies_bit)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    counted = split.select("part", *outcomes, F.inline(both))
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(o)).alias(o) for o in outcomes))


def survivors(masks: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """counts (a row for each cell) summed over the cells that no active filter removes, for each of the 2^k sets of active filters."""
    out = np.zeros((1 << k, counts.shape[1]), np.int64)
    failing, alive, active = np.zeros(len(masks), np.int64), counts.sum(axis=0), 0
    out[0] = alive
    for step in range(1, 1 << k):
        bit = (step & -step).bit_length() - 1  # the one filter in which neighbours of the Gray code differ
        active ^= 1 << bit
        own = (masks >> bit & 1) == 1
        if active >> bit & 1:
            alive = alive - counts[own & (failing == 0)].sum(axis=0)
            failing[own] += 1
        else:
            failing[own] -= 1
            alive = alive + counts[own & (failing == 0)].sum(axis=0)
        out[active] = alive
    return out


def _orders(names: Sequence[str], outcomes: Sequence[str]):
    k = len(names)
    every = (1 << k) - 1

    def run(table: pa.Table) -> pa.Table:
        """All orders of one part, from its cells."""
        masks = table.column("mask").to_numpy().astype(np.int64)
        left = survivors(masks, np.stack([table.column(c).to_numpy() for c in ("n", *outcomes)], axis=1).astype(np.int64), k)
        fails = [int(left[0, 0] - left[1 << i, 0]) for i in range(k)]
        alone = [int(left[every ^ 1 << i, 0] - left[every, 0]) for i in range(k)]
        shapley = [0] * k
        for s in range(1 << k):
            before = s.bit_count()
            for i in range(k):
                if not s >> i & 1:
                    shapley[i] += factorial(before) * factorial(k - 1 - before) * int(left[s, 0] - left[s | 1 << i, 0])
        out: dict[str, list] = {c: [] for c in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{o}_lost" for o in outcomes), "shapley")}
        for order in permutations(range(k)):
            active = 0
            for step, i in enumerate(order, 1):
                lost = left[active] - left[active | 1 << i]
                active |= 1 << i
                row = ["".join(names[j] for j in order), step, left[active, 0], lost[0], fails[i] - lost[0], alone[i], *lost[1:], shapley[i]]
                for c, v in zip(out.values(), row, strict=True):
                    c.append(v)
        part = table.column("part")[0].as_py()
        columns = {"part": pa.array([part] * len(out["step"]), pa.string()), "filter_order": pa.array(out.pop("filter_order"), pa.string()), "step": pa.array(out.pop("step"), pa.int32())}
        return pa.table(columns | {c: pa.array([int(x) for x in v], pa.int64()) for c, v in out.items()})

    return run


def audit(docs: DataFrame, labels: DataFrame, outcomes: dict[str, Column], filters: dict = TEXT_FILTERS, copies: str = COPIES) -> DataFrame:
    """For each part and each order of the filters, what every step keeps, removes and costs.

    Columns: part, filter_order, step; kept after the step, removed in it,
    redundant (fail the filter, went earlier), unique_fails (fail this filter
    only), <outcome>_lost in it, shapley (removed by the filter, over all orders).
    """
    names = [*filters, copies]
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; at most {MOST_FILTERS}")
    found = cells(with_outcomes(failures(docs, filters), labels, outcomes), list(outcomes), len(filters))
    lost = "".join(f"`{o}_lost` long, " for o in outcomes)
    return found.groupBy("part").applyInArrow(_orders(names, list(outcomes)), f"part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, {lost}shapley long")
