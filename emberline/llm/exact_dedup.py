"""Exact deduplication by two passes of Bloom filters.

Pass one sends an 8-byte hash of every text, never the row, to one of many
hash segments; a Bloom filter in each segment sees which hashes come a second
time. Only those set bits in a second filter of bounded size. Pass two probes
that filter where the rows lie: a row that misses has no equal and passes
straight through, only the others shuffle, by their SHA-256.

Defined results: null text counts as empty; empty texts are equal; a null
doc_id loses to any other, rows that repeat a doc_id with an equal text are one
document (all have the same keep_id); very long texts are hashed whole; an empty
table gives an empty table. Columns of the input may have any name that does not
start with `__xd_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Filter, filter_of
from .common import SPACE_CLASS, text_or_empty, written

def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE_CLASS, " ")


def _probe(seen: Filter, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = seen.has(batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.record_batch([*batch.columns, pa.array(maybe)], [*batch.schema.names, "__xd_maybe"])

    return run


def group_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: __xd_id, __xd_sha, __xd_keep (smallest id of its equals), __xd_size.

    The digests are written once; both passes then run over a table of about 50 bytes a row.
    """
    digests = written(docs.select(F.col(id_col).alias("__xd_id"), F.sha2(normalised(text_col), 256).alias("__xd_sha")), "exact-digests")
    digests = digests.withColumn("__xd_hash", F.xxhash64("__xd_sha"))
    seen = filter_of(digests.select("__xd_hash"), digests.count(), repeats=True)
    schema = ", ".join(f"{n} {t}" for n, t in digests.dtypes) + ", __xd_maybe boolean"
    probed = digests.mapInArrow(_probe(seen, 2), schema)
    alone = probed.filter("not __xd_maybe").select("__xd_id", "__xd_sha", F.col("__xd_id").alias("__xd_keep"), F.lit(1).cast("long").alias("__xd_size"))
    maybe = probed.filter("__xd_maybe").select("__xd_id", "__xd_sha")
    # written, so that both sides of the join are plain exchanges: AQE then splits the row side where one text holds a large share of the rows
    groups = written(maybe.groupBy("__xd_sha").agg(F.min("__xd_id").alias("__xd_keep"), F.count(F.lit(1)).alias("__xd_size")), "exact-groups")
    return alone.unionByName(maybe.join(groups, "__xd_sha"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns. Rows whose hash misses the filter never shuffle."""
    own = docs.columns
    hashed = docs.withColumn("__xd_sha", F.sha2(normalised(text_col), 256))
    digests = written(hashed.select(F.col(id_col).alias("__xd_id"), "__xd_sha"), "exact-digests")
    digests = digests.withColumn("__xd_hash", F.xxhash64("__xd_sha"))
    seen = filter_of(digests.select("__xd_hash"), digests.count(), repeats=True)
    schema = "__xd_id " + dict(digests.dtypes)["__xd_id"] + ", __xd_sha string, __xd_hash long, __xd_maybe boolean"
    suspects = digests.mapInArrow(_probe(seen, 2), schema).filter("__xd_maybe")
    stays = written(suspects.groupBy("__xd_sha").agg(F.min("__xd_id").alias("__xd_keep")).withColumnRenamed("__xd_sha", "__xd_of"), "exact-groups")
    # rows that repeat a whole document tie; one of them stays
    tied = suspects.groupBy("__xd_sha", "__xd_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__xd_sha")
    marked = hashed.withColumn("__xd_maybe", seen.test(F.xxhash64("__xd_sha")))
    through = marked.filter("not __xd_maybe").select(own)
    checked = marked.filter("__xd_maybe").join(stays, (F.col("__xd_sha") == F.col("__xd_of")) & F.col(id_col).eqNullSafe(F.col("__xd_keep")), "left_semi")
    if not tied.isEmpty():
        tied = written(tied.distinct(), "exact-ties")
        checked = checked.join(tied, "__xd_sha", "left_anti").unionByName(checked.join(tied, "__xd_sha", "left_semi").dropDuplicates(["__xd_sha"]))
    return through.unionByName(checked.select(own))
