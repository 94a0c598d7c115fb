"""Forecast runs and rasters as pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Upper bounds (hours) and colours of the arrival bands; vector products that aren't offered.
BANDS = [(12, "#08306b"), (24, "#2171b5"), (48, "#6baed6"), (72, "#c6dbef"), (96, "#fdf4e3"), (120, "#fdd0a2"), (168, "#fdae6b"), (240, "#e6550d"), (336, "#a63603")]
DEFAULT_HORIZON, DEFAULT_REACH = 336, 240
KNOWN_PRODUCTS = ["crown-fire", "flame-length", "hours-since-burned", "spread-rate"]


def newest_runs(runs: DataFrame, n: int = 2) -> DataFrame:
    """The newest n complete, unexpired runs of each slug."""
    rank = F.row_number().over(W.partitionBy("slug_key").orderBy(F.col("run_time").desc(), "run_key"))
    return runs.filter("complete and not expired").withColumn("rank", rank).filter(F.col("rank") <= n)


def told_horizon(longest: Column) -> Column:
    """The longest horizon of a run's good files, 336 where nothing tells."""
    return F.coalesce(F.nullif(longest, F.lit(0)), F.lit(DEFAULT_HORIZON))


def run_availability(files: DataFrame) -> DataFrame:
    """Percentiles with a good file, products on offer and horizon of each run; horizon 336 where nothing tells."""
    known = F.col("product").isin(KNOWN_PRODUCTS)
    return files.groupBy("run_key").agg(
        F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("pct")))).alias("toa_pcts"), F.sort_array(F.collect_set(F.when(F.col("ok") & known, F.col("product")))).alias("products"),
        told_horizon(F.max(F.when(F.col("ok"), F.col("n")))).alias("horizon_hours"))


def runs_with_horizon(files: DataFrame, *of_run: str) -> DataFrame:
    """The distinct runs (run_key and the columns of_run) with the horizon of their run_key, in one pass over the files."""
    each = files.groupBy("run_key", *of_run).agg(F.max(F.when(F.col("ok"), F.col("n"))).alias("n"))
    return each.select("run_key", *of_run, told_horizon(F.max("n").over(W.partitionBy("run_key"))).alias("horizon_hours"))


def build_runs(files: DataFrame, known: list[str] = KNOWN_PRODUCTS) -> DataFrame:
    """Per run the arrival percentiles with a good file, each known product with its percentiles, and the longest of those products' horizons (336 where none tells).

    files: run_key, product (null: arrival times), pct, ok, n. Runs without a good file stay.
    """
    good = F.col("ok") & F.col("product").isin(known)
    each = files.groupBy("run_key", F.when(good, F.col("product")).alias("product")).agg(
        F.sort_array(F.collect_set(F.when(good, F.col("pct")))).alias("percentiles"), F.max(F.when(good, F.col("n"))).alias("n"), F.collect_set(F.when(F.col("ok") & F.col("product").isNull(), F.col("pct"))).alias("toa"))
    offered = F.sort_array(F.collect_list(F.when(F.col("product").isNotNull(), F.struct("product", "percentiles"))))
    return each.groupBy("run_key").agg(F.sort_array(F.flatten(F.collect_list("toa"))).alias("toa_pcts"), F.map_from_entries(offered).alias("products"), told_horizon(F.max("n")).alias("horizon_hours"))


def arrival_band(hours: Column, bands: list[tuple[int, str]] = BANDS) -> Column:
    """Upper bound of the first band that holds the hours; beyond the last the last."""
    bounds = [b for b, _ in bands]
    chain = F.when(hours <= bounds[0], bounds[0])
    for b in bounds[1:-1]:
        chain = chain.when(hours <= b, b)
    return F.when(hours.isNotNull(), chain.otherwise(bounds[-1]))


def _horizon(horizon: Column, bands: list[tuple[int, str]] = BANDS) -> Column:
    return F.when(horizon > 0, F.floor(horizon + 0.5).cast("int")).otherwise(bands[-1][0])


def legend_bands(runs: DataFrame, bands: list[tuple[int, str]] = BANDS) -> DataFrame:
    """A row for each band that begins before the run's horizon, the last one cut to it."""
    lows = [0, *(b for b, _ in bands[:-1])]
    table = F.array(*(F.struct(F.lit(lo).alias("low"), F.lit(b).alias("high"), F.lit(c).alias("color")) for lo, (b, c) in zip(lows, bands, strict=True)))
    h = _horizon(F.col("horizon_hours"), bands)
    return runs.select("run_key", h.alias("h"), F.inline(F.filter(table, lambda x: x["low"] < h))).select("run_key", F.least("high", "h").alias("hours"), "color")


def _stops(h: Column, bands: list[tuple[int, str]]) -> Column:
    return F.concat(F.filter(F.array(*(F.lit(b) for b, _ in bands)), lambda x: x < h - 12), F.array(h))


def reach_stops(runs: DataFrame, bands: list[tuple[int, str]] = BANDS) -> DataFrame:
    """Slider stops: the bounds more than 12 h below the horizon, and the horizon."""
    return runs.select("run_key", F.explode(_stops(_horizon(F.col("horizon_hours"), bands), bands)).alias("stop"))


def nearest_stop_of(horizon: Column, within: Column | None = None, bands: list[tuple[int, str]] = BANDS) -> Column:
    """the stop nearest to the wanted reach (least of 240 and the horizon if none is given), ties to the smaller."""
    h = _horizon(horizon, bands)
    want = within if within is not None else F.least(F.lit(DEFAULT_REACH), h)
    return F.array_min(F.transform(_stops(h, bands), lambda x: F.struct(F.abs(x - want).alias("off"), x.alias("stop"))))["stop"]


def nearest_stop(runs: DataFrame, within: Column | None = None, bands: list[tuple[int, str]] = BANDS) -> DataFrame:
    """nearest_stop_of each run. runs: one row for each run_key."""
    return runs.filter("run_key is not null").select("run_key", nearest_stop_of(F.col("horizon_hours"), within, bands).alias("stop"))


def nearest_percentile_of(pct: Column, want: int, there: Column) -> Column:
    """aggregate: of the percentiles that are there the nearest to the wanted one, ties to the smaller."""
    return F.min_by(pct, F.when(there, F.struct(F.abs(pct - want), pct)))


def nearest_percentile(available: DataFrame, want: int) -> DataFrame:
    """the run's percentile nearest to the wanted one, ties to the smaller."""
    return available.groupBy("run_key").agg(nearest_percentile_of(F.col("pct"), want, F.lit(True)).alias("pct"))


def arrival_census(pixels: DataFrame, hours: float, recent: float = 12) -> DataFrame:
    """Pixels burned by the hour, of these lately, not yet, and without data."""
    v = F.col("toa_hours")
    there = v.isNotNull() & ~F.isnan(v) & (v > 0)
    return pixels.groupBy("run_key", "pct").agg(
        F.count_if(there & (v <= hours)).alias("burned"), F.count_if(there & (v <= hours) & (v > hours - recent)).alias("leading"), F.count_if(there & (v > hours)).alias("later"), F.count_if(~there).alias("nodata"))


def arrival_areas(pixels: DataFrame, hours: float, recent: float = 12, cell_metres: float = 30.0) -> DataFrame:
    """The census as areas in hectares, of square pixels."""
    size = cell_metres * cell_metres / 10_000
    counts = ("burned", "leading", "later", "nodata")
    return arrival_census(pixels, hours, recent).select("run_key", "pct", *((F.col(c) * size).alias(f"{c}_ha") for c in counts))


def arrival_histogram(pixels: DataFrame, within: float, bands: list[tuple[int, str]] = BANDS) -> DataFrame:
    """Pixels of each band that are reached within the limit."""
    reached = pixels.filter((F.col("toa_hours") > 0) & (F.col("toa_hours") <= within))
    return reached.groupBy("run_key", "pct", arrival_band(F.col("toa_hours"), bands).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def burn_curve(pixels: DataFrame) -> DataFrame:
    """Pixels burned up to each whole hour at which any burns."""
    hourly = pixels.filter("toa_hours > 0").groupBy("run_key", "pct", F.ceil("toa_hours").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hourly.withColumn("burned", F.sum("n").over(W.partitionBy("run_key", "pct").orderBy("hour").rowsBetween(W.unboundedPreceding, 0))).drop("n")


def class_census(pixels: DataFrame) -> DataFrame:
    """Pixels of each non-zero class by run, percentile, product and time."""
    return pixels.filter("value > 0").groupBy("run_key", "pct", "product", "valid_time", "value").agg(F.count(F.lit(1)).alias("n"))


def ramp_color(values: DataFrame, ramp: DataFrame, discrete: bool = False) -> DataFrame:
    """R, g, b of each value on its product's ramp: ends held, linear between stops, or exact stops only. 0 has no colour.

    A ramp is a handful of stops and there are as many as products, so all of them
    become one map, a scalar of the query; the interval is found in a product's
    array. Products without a ramp have no colour.
    """
    channel = lambda c, k: F.conv(F.substr(c, F.lit(2 + 2 * k), F.lit(2)), 16, 10).cast("int")
    ramps = ramp.groupBy("product").agg(F.sort_array(F.collect_list(F.struct("stop", "color"))).alias("__ramp"))
    ramps = ramps.agg(F.map_from_entries(F.collect_list(F.struct("product", "__ramp"))).alias("m"))
    v, stops = F.col("value"), F.col("__ramp")
    met = values.filter("value <> 0").withColumn("__ramp", F.try_element_at(ramps.scalar(), F.col("product"))).filter("__ramp is not null")
    below = F.size(F.filter(stops, lambda x: x["stop"] <= v))
    if discrete:
        met = met.withColumn("__at", F.array_position(F.transform(stops, lambda x: x["stop"]), v)).filter("__at > 0")
        lo, hi, share = F.get(stops, F.col("__at").cast("int") - 1), F.get(stops, F.col("__at").cast("int") - 1), F.lit(0.0)
    else:
        lo = F.get(stops, F.greatest(below - 1, F.lit(0)))
        hi = F.coalesce(F.get(stops, below), lo)
        share = F.when((below > 0) & (hi["stop"] > lo["stop"]), (v - lo["stop"]) / (hi["stop"] - lo["stop"])).otherwise(0.0)
    met = met.withColumns({"__lo": lo["color"], "__hi": F.when(below > 0, hi["color"]).otherwise(lo["color"]), "__share": share})
    mix = lambda k: F.floor(channel(F.col("__lo"), k) + (channel(F.col("__hi"), k) - channel(F.col("__lo"), k)) * F.col("__share") + 0.5).cast("int")
    return met.select(*values.columns, mix(0).alias("r"), mix(1).alias("g"), mix(2).alias("b"))


def thin_instants(instants: DataFrame) -> DataFrame:
    """Of each run's instants (run_key, t) the first, all within 24 h, three-hourly ones to 72 h and six-hourly ones after."""
    start = F.first("t").over(W.partitionBy("run_key").orderBy("t"))
    seconds = F.unix_seconds(F.col("t").cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    spaced = instants.withColumn("s", seconds)
    hour = F.floor(F.col("s") / 3600)
    keep = (F.col("s") <= 86400) | ((F.col("s") <= 259200) & (hour % 3 == 0)) | ((F.col("s") > 259200) & (hour % 6 == 0))
    return spaced.filter(keep).drop("s")


def run_ticks(runs: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """H3: hourly ticks from each run's start over its horizon, within [start, end] where these are given."""
    last = F.col("run_time") + F.make_dt_interval(hours=F.col("horizon_hours").cast("int"))
    ticks = runs.filter("horizon_hours >= 0").select("run_key", F.explode(F.sequence("run_time", last, F.expr("INTERVAL '1' HOUR"))).alias("t"))
    if start is not None:
        ticks = ticks.filter(F.col("t") >= start)
    return ticks if end is None else ticks.filter(F.col("t") <= end)


def expected_hours(cycles: DataFrame) -> DataFrame:
    """H2: forecast hours of each cycle: 0 to 48 at 00, 06, 12 and 18, else 0 to 18."""
    last = F.when(F.hour("cycle") % 6 == 0, 48).otherwise(18)
    return cycles.select("cycle", F.explode(F.sequence(F.lit(0), last)).alias("fhour"))


def pick_run(runs: DataFrame) -> DataFrame:
    """Of each fire the newest drawable run, else the newest."""
    return runs.groupBy("fire").agg(F.max_by("run_key", F.struct("drawable", "run_time", "run_key")).alias("run_key"))


def carry_forward(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Fires without a drawable run keep the newest drawable one published before, unless it is among the current ones."""
    drawn = current.filter("drawable").select("fire").distinct()
    lost = previous.filter("drawable").join(drawn, "fire", "left_anti").join(current.select("fire", "run_key"), ["fire", "run_key"], "left_anti").join(current.select("fire").distinct(), "fire", "left_semi")
    best = lost.groupBy("fire").agg(F.max_by(F.struct(*[c for c in previous.columns if c != "fire"]), F.struct("run_time", "run_key")).alias("r")).select("fire", "r.*")
    return current.unionByName(best)


def coverage_band(hours: DataFrame) -> DataFrame:
    """H7: first and last rendered hour of runs with at least two."""
    return hours.groupBy("run_key").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")


def frame_times(ticks: DataFrame, hours: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sorted distinct instants of both within the window; an hourly grid if there are none."""
    found = ticks.select("t").union(hours.select("t")).filter(F.col("t").between(start, end)).distinct()
    grid = ticks.sparkSession.range(1).select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))).alias("t"))
    # the grid stands in only where nothing was found: one row tells
    none = found.limit(1).agg(F.count(F.lit(1)) == 0).scalar()
    return found.unionByName(grid.filter(none))


def grid_bounds(grids: DataFrame) -> DataFrame:
    """lon/lat envelope of each UTM grid from its four corners. grids: grid, e0, n0, e1, n1, zone, north."""
    from ..functions.geo import utm_to_lonlat

    corner = lambda e, n: F.struct(F.col(e).alias("e"), F.col(n).alias("n"))
    four = grids.select("grid", "zone", "north", F.explode(F.array(corner("e0", "n0"), corner("e1", "n0"), corner("e1", "n1"), corner("e0", "n1"))).alias("c"))
    placed = four.select("grid", utm_to_lonlat(F.col("c.e"), F.col("c.n"), F.col("zone"), F.col("north")).alias("p"))
    return placed.groupBy("grid").agg(F.min("p.lon").alias("w"), F.min("p.lat").alias("s"), F.max("p.lon").alias("e"), F.max("p.lat").alias("n"))
