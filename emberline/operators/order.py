"""Places in a total order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.landing import work_path


def with_place(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place (from 1) in a total order.

    A range exchange deals them out to sorted parts; what lies in the parts before is
    a sum over one row per part. The parts' bounds are sampled, so the sorted rows are
    written to the shared folder: both uses, and tasks that run again, read the same
    parts, whichever executors are left.
    """
    spark, path = rows.sparkSession, work_path(rows.sparkSession, "sorted")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    spread = spark.read.parquet(path)
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = spread.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = spread.withColumn("__part", part).join(sizes.select("__part", before.alias("__before")), "__part")
    return placed.withColumn(name, (F.col("__before") + at + 1).cast("int")).drop("__id", "__part", "__before")
