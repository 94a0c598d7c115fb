"""Weather: message indexes, cycles, winds, hourly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import flip_bearing
from ..functions.time import local_day, wmo_severity

# The index records that each product needs, in order.
RECORDS = [("ws", "UGRD", "10 m above ground", 0), ("ws", "VGRD", "10 m above ground", 1), ("wg", "GUST", "surface", 0), ("tmpf", "TMP", "2 m above ground", 0), ("rh", "RH", "2 m above ground", 0), ("smoke", "MASSDEN", "8 m above ground", 0), ("apcp01", "APCP", "surface", 0)]


def parse_index_lines(lines: DataFrame) -> DataFrame:
    """Typed rows of 'number:offset:d=...:VAR:level:forecast:' lines (file_key, pos, line); short or broken lines go."""
    parts = F.split("line", ":")
    part = lambda k: F.try_element_at(parts, F.lit(k))
    rows = lines.filter(F.size(parts) >= 6).select("file_key", "pos", part(1).try_cast("int").alias("msgnum"), part(2).try_cast("long").alias("offset"), part(4).alias("var"), part(5).alias("level"), part(6).alias("fcst"))
    return rows.filter("msgnum is not null and offset is not null")


def byte_ranges(index: DataFrame) -> DataFrame:
    """Start and end of each message; the last one is open."""
    return index.withColumn("end", F.lead("offset").over(W.partitionBy("file_key").orderBy("pos")) - 1)


def select_messages(index: DataFrame, spec: DataFrame, fhour: Column | None = None) -> DataFrame:
    """First message of each record that a product needs, exact variable and level (and accumulation window where the spec has one); products lacking a record go.

    spec: product, var, level, part[, fcst]. Keyed by file_key.
    """
    keys = ["var", "level"] + (["fcst"] if "fcst" in spec.columns else [])
    need = spec.groupBy("product").agg(F.count(F.lit(1)).alias("need"))
    hit = index.join(spec, keys).groupBy("file_key", "product", "part").agg(F.min("msgnum").alias("msgnum"))
    whole = hit.groupBy("file_key", "product").agg(F.count(F.lit(1)).alias("got"), F.sort_array(F.collect_list(F.struct("part", "msgnum"))).alias("m"))
    return whole.join(need, "product").filter("got = need").select("file_key", "product", F.transform("m", lambda x: x["msgnum"]).alias("messages"))


def available_hours(listing: DataFrame) -> DataFrame:
    """Hours of each cycle with both the data object and its index. listing: key."""
    pattern = r"^(.*)\.t(\d{2})z\.wrfsfcf(\d{2})\.grib2(\.idx)?$"
    part = lambda k: F.regexp_extract("key", pattern, k)
    rows = listing.filter(F.col("key").rlike(pattern)).select(F.concat_ws("/", part(1), part(2)).alias("cycle"), part(3).try_cast("int").alias("fhour"), (part(4) != "").alias("index"))
    return rows.filter("not index").select("cycle", "fhour").intersect(rows.filter("index").select("cycle", "fhour"))


def discover_cycles(hours: DataFrame, now: Column, min_hours: int = 2, count: int = 2, lookback: int = 12) -> DataFrame:
    """The newest cycles of the last hours that have enough hours. hours: cycle (instant), fhour."""
    recent = hours.filter((F.col("cycle") <= now) & (F.col("cycle") > F.date_trunc("hour", now) - F.make_interval(hours=F.lit(lookback))))
    enough = recent.groupBy("cycle").agg(F.count_distinct("fhour").alias("hours")).filter(F.col("hours") >= min_hours)
    return enough.orderBy(F.col("cycle").desc()).limit(count)


def run_completeness(rendered: DataFrame, expected: DataFrame) -> DataFrame:
    """Rendered against expected hours of each cycle; full means as many as expected."""
    r = rendered.select("cycle", "fhour").distinct().join(expected, ["cycle", "fhour"], "left_semi").groupBy("cycle").agg(F.count(F.lit(1)).alias("rendered"))
    e = expected.groupBy("cycle").agg(F.count(F.lit(1)).alias("expected"))
    return e.join(r, "cycle", "left").select("cycle", F.coalesce("rendered", F.lit(0)).alias("rendered"), "expected", (F.coalesce("rendered", F.lit(0)) >= F.col("expected")).alias("complete"))


def advertised_hours(rendered: DataFrame, listed: DataFrame, expected: DataFrame) -> DataFrame:
    """Per cycle (of listed) what is rendered of its listed hours, whether that is all of them (complete), whether the listing is the whole cycle (full), whether both hold (done), and the hours to advertise: all once done, else those rendered.

    rendered, listed, expected: cycle, fhour.
    """
    every = listed.select("cycle", "fhour").distinct()
    have = rendered.select("cycle", "fhour").distinct().withColumn("there", F.lit(True))
    whole = expected.groupBy("cycle").agg(F.count_distinct("fhour").alias("expected"))
    counted = every.join(have, ["cycle", "fhour"], "left").groupBy("cycle").agg(
        F.count(F.lit(1)).alias("listed"), F.count("there").alias("rendered"), F.sort_array(F.collect_list(F.when(F.col("there"), F.col("fhour")))).alias("hours"))
    state = counted.join(whole, "cycle", "left").withColumns({"complete": F.col("rendered") == F.col("listed"), "full": F.coalesce(F.col("listed") >= F.col("expected"), F.lit(False))})
    return state.withColumn("done", F.col("complete") & F.col("full")).select("cycle", "listed", "rendered", "complete", "full", "done", "hours")


def wind_rows(cells: DataFrame) -> DataFrame:
    """Wind grid rows (hour, row, col, u, v) from field rows (vec_id, cell, v): even fields are u, odd ones v."""
    half = cells.select(F.floor(F.col("vec_id") / 2).alias("hour"), (F.col("vec_id") % 2).alias("k"), F.floor(F.col("cell") / 8).cast("int").alias("row"), (F.col("cell") % 8).cast("int").alias("col"), (F.col("v").cast("double") * 20).alias("x"))
    return half.groupBy("hour", "row", "col").agg(F.max(F.when(F.col("k") == 0, F.col("x"))).alias("u"), F.max(F.when(F.col("k") == 1, F.col("x"))).alias("v"))


def sample_grid(points: DataFrame, grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """C14: bilinear u and v at points (id, hour, fr, fc: fractional row and column), held at the edges; a missing neighbour leaves null."""
    hold = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), c))
    p = points.withColumns({"r": hold(F.col("fr"), rows), "c": hold(F.col("fc"), cols)})
    p = p.withColumns({"r0": F.least(F.floor("r"), F.lit(rows - 2)).cast("int"), "c0": F.least(F.floor("c"), F.lit(cols - 2)).cast("int")})
    dy, dx = F.col("r") - F.col("r0"), F.col("c") - F.col("c0")
    corner = lambda i, j, w: F.struct((F.col("r0") + i).alias("row"), (F.col("c0") + j).alias("col"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - dy) * (1 - dx)), corner(0, 1, (1 - dy) * dx), corner(1, 0, dy * (1 - dx)), corner(1, 1, dy * dx))
    joined = p.select("id", "hour", F.inline(four)).join(grid, ["hour", "row", "col"], "left")
    whole = lambda c: F.when(F.count(c) == 4, F.sum(F.col("w") * F.col(c)))
    return joined.groupBy("id", "hour").agg(whole("u").alias("u"), whole("v").alias("v"))


def coarsen(grid: DataFrame, factor: int) -> DataFrame:
    """Means over blocks of cells; missing cells don't count."""
    return grid.groupBy("hour", F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("u").alias("u"), F.avg("v").alias("v"))


def export_wind_grid(grid: DataFrame) -> DataFrame:
    """Row-major arrays of each hour, rounded (half to even) to a tenth, missing cells null."""
    cells = F.sort_array(F.collect_list(F.struct("row", "col", F.bround("u", 1).alias("u"), F.bround("v", 1).alias("v"))))
    rows = grid.groupBy("hour").agg(cells.alias("x"), (F.max("row") + 1).alias("ny"), (F.max("col") + 1).alias("nx"))
    return rows.select("hour", "nx", "ny", F.transform("x", lambda c: c["u"]).alias("u"), F.transform("x", lambda c: c["v"]).alias("v"))


def explode_point_weather(feed: DataFrame) -> DataFrame:
    """Rows of parallel hourly arrays; an hour with any member missing, or an unreadable time, goes."""
    rows = feed.select("fire_key", F.inline(F.arrays_zip("time", "temp_f", "code", "wind_mph", "wind_from_deg")))
    stamp = F.coalesce(F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return rows.withColumn("t", stamp).drop("time").na.drop()


def weather_slots(hours: DataFrame, stride: int) -> DataFrame:
    """Slots of `stride` hours from the epoch on: exact hours below a day, summaries from a day on."""
    if stride < 24:
        on = F.unix_seconds(F.col("t").cast("timestamp")) % (stride * 3600) == 0
        return hours.filter(on).select("fire_key", F.col("t").alias("slot"), F.col("temp_f").alias("temp"), "code", F.col("wind_mph").alias("wind"), flip_bearing(F.col("wind_from_deg")).alias("bearing"))
    return window_weather(hours, stride)


def window_weather(hours: DataFrame, stride: int) -> DataFrame:
    """Highest temperature, worst code, and wind at the windiest hour (the first of equals) of each window."""
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / (stride * 3600)) * (stride * 3600)).cast("timestamp_ntz")
    early = -F.unix_seconds(F.col("t").cast("timestamp"))
    windiest = F.max_by(F.struct("wind_mph", "wind_from_deg"), F.struct(F.col("wind_mph"), early))
    out = hours.groupBy("fire_key", slot.alias("slot")).agg(F.max("temp_f").alias("temp"), F.min_by("code", F.struct(wmo_severity(F.col("code")), "t")).alias("code"), windiest.alias("w"))
    return out.select("fire_key", "slot", F.floor(F.col("temp") + 0.5).alias("temp"), "code", F.floor(F.col("w.wind_mph") + 0.5).alias("wind"), flip_bearing(F.col("w.wind_from_deg")).alias("bearing"))


def seam_union(past: DataFrame, future: DataFrame, keys: list[str]) -> DataFrame:
    """Past and future slots; the future wins where both have one."""
    return past.join(future.select(*keys), keys, "left_anti").unionByName(future)


def day_boundaries(series: DataFrame) -> DataFrame:
    """Hours at which the fire-local day changes. series: fire_key, t, zone."""
    day = local_day(F.col("t"), F.col("zone"))
    keyed = series.withColumn("day", day)
    return keyed.withColumn("before", F.lag("day").over(W.partitionBy("fire_key").orderBy("t"))).filter("before is not null and before <> day").drop("before")


def offered_products(manifest: DataFrame, order: list[str]) -> DataFrame:
    """Products that the manifest has, in the fixed order. manifest: run_key, product."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("product"))
    return manifest.select("run_key", "product", place.cast("int").alias("place")).distinct().filter("place > 0")
