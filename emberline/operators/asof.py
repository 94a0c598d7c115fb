"""Joins by time: the version in force, the nearest hour, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _tagged(probes: DataFrame, versions: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """Both sides as rows of one frame, by key and day: probes (__is 1) with their columns in __p, versions (__is 0) with theirs in __val."""
    extra = [c for c in probes.columns if c not in keys and c != t]
    p = probes.select(*keys, t, F.struct(*extra).alias("__p")).withColumn("__is", F.lit(1))
    v = versions.select(*keys, t, F.struct(F.col(t).alias("version_t"), *values).alias("__val")).withColumn("__is", F.lit(0))
    return p.unionByName(v, allowMissingColumns=True).withColumn("__day", F.to_date(t))


def _edges(both: DataFrame, keys: list[str], t: str, forward: bool, name: str) -> DataFrame:
    """For each key and day what the days before (or after) leave to it: one row per key and day that has any."""
    edge = (F.min_by if forward else F.max_by)("__val", F.when(F.col("__is") == 0, F.col(t)))
    days = both.groupBy(*keys, "__day").agg(edge.alias("__edge"))
    order = F.col("__day").desc() if forward else F.col("__day").asc()
    return days.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__day").alias("__on"), F.last("__edge", ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)).alias(name))


def _with_edges(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    same = F.col("__day").eqNullSafe(F.col("__on"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(edges, same, "left").drop("__on", *(f"__{k}" for k in keys))


def asof(probes: DataFrame, versions: DataFrame, keys: list[str], t: str, values: list[str], forward: bool = False) -> DataFrame:
    """For each probe the latest version at or before its time (or the earliest at or after).

    Both sides are tagged and united, then one window for each key and day carries
    the last version seen: one shuffle and one sort, never a product of probes and
    versions, and no task holds more than a day of a key. What the days before
    leave is carried over in a table of key-days and joined. A version at the
    probe's time counts. values come from versions; the version's own time comes
    out as version_t.
    """
    both = _tagged(probes, versions, keys, t, values)
    # at equal times versions come first in either direction
    order = (F.col(t).desc(), F.col("__is")) if forward else (F.col(t).asc(), F.col("__is"))
    carried = F.last("__val", ignorenulls=True).over(W.partitionBy(*keys, "__day").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("__found", carried).filter("__is = 1")
    out = _with_edges(found, _edges(both, keys, t, forward, "__edge"), keys).withColumn("__found", F.coalesce("__found", "__edge"))
    return out.select(*keys, t, "__p.*", "__found.*")


def nearest_hour(probes: DataFrame, hours: DataFrame, keys: list[str], t: str, minutes: int = 90) -> DataFrame:
    """The nearest version within the tolerance (inclusive); of two as near the earlier one. Adds hour_t.

    One sort serves both directions.
    """
    both = _tagged(probes, hours, keys, t, [])
    day = W.partitionBy(*keys, "__day").orderBy(F.col(t).asc(), F.col("__is"))
    version = F.col("__val.version_t")
    found = both.withColumns({
        "__back": F.last(version, ignorenulls=True).over(day.rowsBetween(W.unboundedPreceding, 0)), "__fore": F.first(version, ignorenulls=True).over(day.rowsBetween(0, W.unboundedFollowing)),
    }).filter("__is = 1")
    for name, forward in (("__back", False), ("__fore", True)):
        found = _with_edges(found, _edges(both, keys, t, forward, "__edge"), keys).withColumn(name, F.coalesce(name, "__edge.version_t")).drop("__edge")
    gap = lambda c: F.abs(F.unix_millis(F.col(c).cast("timestamp")) - F.unix_millis(F.col(t).cast("timestamp")))
    best = F.when(F.coalesce(gap("__back") <= gap("__fore"), F.col("__fore").isNull()), F.col("__back")).otherwise(F.col("__fore"))
    picked = found.withColumn("hour_t", best)
    return picked.withColumn("hour_t", F.when(gap("hour_t") <= minutes * 60_000, F.col("hour_t"))).select(*keys, t, "__p.*", "hour_t")


def series_asof(probes: DataFrame, versions: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """The newest version at the probe's time, else the series' earliest."""
    first = versions.groupBy(*keys).agg(F.min_by(value, F.struct(t, value)).alias("__first"))
    found = asof(probes, versions, keys, t, [value]).join(first, keys, "left")
    return found.withColumn(value, F.coalesce(value, "__first")).drop("__first")


def neighbours(index: DataFrame, current: DataFrame, keys: list[str], order: list[str], reach: int = 2) -> DataFrame:
    """Versions at most `reach` places from the current one of each key. current has keys and place columns of index."""
    ranked = index.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    here = ranked.join(current, [*keys, *order], "left_semi").select(*keys, F.col("rank").alias("at"))
    return ranked.join(here, keys).filter(F.abs(F.col("rank") - F.col("at")) <= reach).withColumn("distance", F.col("rank") - F.col("at")).drop("at", "rank")
