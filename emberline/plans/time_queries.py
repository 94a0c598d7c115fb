"""Queries that join by time, over forecasts and over weather, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import time as tm
from ..operators import asof as ao
from ..operators import forecast as fc
from ..operators import weather as wx
from .adapters import cte, view


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _versions(spark, sf_dir):
    v = view(spark, sf_dir, "perimeter_index").groupBy("fire_key", F.col("version_ts").alias("t")).agg(F.max("path").alias("path"))
    return v


def _probes(spark, sf_dir):
    return view(spark, sf_dir, "time_probes").groupBy("probe_id", "probe_line", "fire_key", "t").agg(F.count(F.lit(1)).alias("copies"))


def perimeter_asof(spark, sf_dir):
    return ao.asof(_probes(spark, sf_dir), _versions(spark, sf_dir), ["fire_key"], "t", ["path"])


def nearest_hours(spark, sf_dir):
    p = _probes(spark, sf_dir).withColumn("t", F.col("t") + F.make_interval(hours=(F.col("probe_line") * 4).cast("int")))
    v = _versions(spark, sf_dir).withColumn("t", F.col("t") + F.expr("INTERVAL 10 HOURS")).drop("path")
    return ao.nearest_hour(p, v, ["fire_key"], "t", 300)


def series_asof(spark, sf_dir):
    v = _versions(spark, sf_dir).filter("t >= TIMESTAMP_NTZ'1994-01-01'")
    return ao.series_asof(_probes(spark, sf_dir), v, ["fire_key"], "t", "path").drop("version_t")


def version_neighbours(spark, sf_dir):
    v = _versions(spark, sf_dir).select("fire_key", "path", "t")
    return ao.neighbours(v, v.filter("path like '%7'"), ["fire_key"], ["t", "path"]).select("fire_key", "path", F.col("distance").cast("long").alias("distance")).distinct()


def _avail(spark, sf_dir):
    return view(spark, sf_dir, "run_availability")


def _runs(spark, sf_dir):
    return _avail(spark, sf_dir).select("run_key", "slug_key", "run_time", "complete", "expired").distinct()


def newest_runs(spark, sf_dir):
    return fc.newest_runs(_runs(spark, sf_dir)).select("run_key", "slug_key", F.col("rank").cast("int").alias("rank"))


def run_offers(spark, sf_dir):
    r = fc.run_availability(_avail(spark, sf_dir))
    return r.select("run_key", F.array_join(F.col("toa_pcts").cast("array<string>"), ",").alias("toa_pcts"), F.array_join("products", ",").alias("products"), "horizon_hours")


def _horizons(spark, sf_dir):
    return fc.run_availability(_avail(spark, sf_dir)).select("run_key", (F.col("horizon_hours") * 7).alias("horizon_hours"))


def legend_bands(spark, sf_dir):
    return fc.legend_bands(_horizons(spark, sf_dir))


def reach_stops(spark, sf_dir):
    return fc.reach_stops(_horizons(spark, sf_dir))


def nearest_choices(spark, sf_dir):
    runs = _avail(spark, sf_dir).groupBy("run_key").agg(fc.told_horizon(F.max(F.when(F.col("ok"), F.col("n")))).alias("horizon_hours"), fc.nearest_percentile_of(F.col("pct"), 40, F.col("ok")).alias("pct"))
    return runs.select("run_key", fc.nearest_stop_of(F.col("horizon_hours") * 7).alias("stop"), "pct")


def _pixels(spark, sf_dir):
    return view(spark, sf_dir, "toa_pixels")


def arrival_census(spark, sf_dir):
    return fc.arrival_census(_pixels(spark, sf_dir), 72)


def arrival_histogram(spark, sf_dir):
    return fc.arrival_histogram(_pixels(spark, sf_dir), 240)


def burn_curve(spark, sf_dir):
    return fc.burn_curve(_pixels(spark, sf_dir))


def class_census(spark, sf_dir):
    p = _pixels(spark, sf_dir).select("run_key", "pct", F.lit("flame-length").alias("product"), (F.col("row") % 4).alias("valid_time"), F.floor(F.col("toa_hours") / 50).alias("value"))
    return fc.class_census(p)


RAMP = [("wind", 0.0, "#78b4dc"), ("wind", 100.0, "#50aa96"), ("wind", 200.0, "#ffdc50"), ("wind", 300.0, "#ff9628")]


def ramp_colors(spark, sf_dir):
    ramp = spark.createDataFrame(RAMP, "product string, stop double, color string")
    v = _pixels(spark, sf_dir).select(F.col("toa_hours").alias("value")).distinct().select(F.lit("wind").alias("product"), "value")
    return fc.ramp_color(v, ramp).select("value", "r", "g", "b")


def member_asof(spark, sf_dir):
    p = _probes(spark, sf_dir).withColumn("run_key", F.col("probe_id") % 40).drop("fire_key")
    m = _runs(spark, sf_dir).select((F.col("run_key") % 40).alias("run_key"), F.col("run_time").alias("t")).distinct()
    return ao.asof(p, m, ["run_key"], "t", [])


def thinned_instants(spark, sf_dir):
    d = view(spark, sf_dir, "detections").select((F.col("ordinal") % 7).alias("run_key"), F.date_trunc("hour", "acq_ts").cast("timestamp_ntz").alias("t")).distinct()
    return fc.thin_instants(d)


def run_ticks(spark, sf_dir):
    r = fc.runs_with_horizon(_avail(spark, sf_dir), "slug_key", "run_time", "complete", "expired")
    return fc.run_ticks(r.withColumn("horizon_hours", F.col("horizon_hours") * 7))


def _cycles(spark, sf_dir):
    return view(spark, sf_dir, "detections").select(F.date_trunc("hour", "acq_ts").cast("timestamp_ntz").alias("cycle"), (F.col("ordinal") % 20).cast("int").alias("fhour")).distinct()


def expected_hours(spark, sf_dir):
    return fc.expected_hours(_cycles(spark, sf_dir).select("cycle").distinct())


def run_completeness(spark, sf_dir):
    c = _cycles(spark, sf_dir)
    return wx.run_completeness(c, fc.expected_hours(c.select("cycle").distinct()))


def discovered_cycles(spark, sf_dir):
    return wx.discover_cycles(_cycles(spark, sf_dir), _ntz("2024-01-20 12:30:00"))


def _choice(spark, sf_dir):
    return _runs(spark, sf_dir).select(F.col("slug_key").alias("fire"), "run_key", "run_time", F.expr("run_key % 7 = 0 and slug_key % 3 <> 0").alias("drawable"))


def picked_runs(spark, sf_dir):
    return fc.pick_run(_choice(spark, sf_dir))


def carried_runs(spark, sf_dir):
    c = _choice(spark, sf_dir)
    return fc.carry_forward(c.filter("run_key % 2 = 0"), c.withColumn("drawable", F.expr("run_key % 5 = 0"))).select("fire", "run_key", "drawable")


def coverage_bands(spark, sf_dir):
    return fc.coverage_band(view(spark, sf_dir, "point_weather").select((F.col("fire_key") * 100 + F.dayofmonth("t")).alias("run_key"), "t"))


def frame_times(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    t = d.select(F.date_trunc("hour", "acq_ts").cast("timestamp_ntz").alias("t"))
    return fc.frame_times(t, view(spark, sf_dir, "point_weather").select("t"), _ntz("2024-01-10 00:00:00"), _ntz("2024-01-12 00:00:00"))


def utm_bounds(spark, sf_dir):
    s = view(spark, sf_dir, "fires").select(F.col("ordinal").alias("grid"), (F.lit(300000.0) + F.col("ordinal") * 1000).alias("e0"), (F.lit(4500000.0) + F.col("ordinal") * 2000).alias("n0"), (F.col("ordinal") % 9 + 10).alias("zone"), (F.col("ordinal") % 5 != 0).alias("north"))
    b = fc.grid_bounds(s.withColumns({"e1": F.col("e0") + 30000, "n1": F.col("n0") + 20000}))
    return b.select("grid", *(F.round(c, 6).alias(c) for c in "wsen"))


def weather_index(spark, sf_dir):
    return wx.byte_ranges(wx.parse_index_lines(view(spark, sf_dir, "weather_index_lines")))


def weather_messages(spark, sf_dir):
    i = wx.parse_index_lines(view(spark, sf_dir, "weather_index_lines")).withColumn("level", F.concat(F.lit("L"), (F.col("msgnum") % 3).cast("string"))).withColumn("var", F.substring_index("var", " ", 1))
    spec = spark.createDataFrame([("ws", "STANDARD", "L0", 0), ("ws", "STANDARD", "L1", 1), ("wg", "PROMO", "L2", 0), ("rh", "ECONOMY", "L0", 0), ("rh", "MEDIUM", "L1", 1)], "product string, var string, level string, part int")
    return wx.select_messages(i, spec).select("file_key", "product", F.array_join(F.col("messages").cast("array<string>"), ",").alias("messages"))


def listed_hours(spark, sf_dir):
    f = view(spark, sf_dir, "fires")
    key = F.concat(F.lit("hrrr.20260817/conus/hrrr.t"), F.lpad((F.col("ordinal") % 24).cast("string"), 2, "0"), F.lit("z.wrfsfcf"), F.lpad((F.col("ordinal") % 49).cast("string"), 2, "0"), F.lit(".grib2"))
    keys = f.filter("ordinal % 3 <> 0").select(key.alias("key")).union(f.filter("ordinal % 4 <> 0").select(F.concat(key, F.lit(".idx")))).union(f.select(F.lit("index.html")))
    return wx.available_hours(keys)


def _grid(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("cell", "v"))
    return wx.wind_rows(e)


def wind_vectors(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return g.select("hour", "row", "col", F.round(geo.wind_speed_mph(F.col("u"), F.col("v")), 3).alias("speed"), F.round(geo.wind_bearing(F.col("u"), F.col("v")), 3).alias("bearing"))


def _wind_probes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 2).alias("hour"), (F.col("vec_id") % 90 / 10.0 - 0.5).alias("fr"), (F.col("vec_id") % 70 / 8.0).alias("fc"))


def wind_samples(spark, sf_dir):
    s = wx.sample_grid(_wind_probes(spark, sf_dir).filter("id % 2 = 0"), _grid(spark, sf_dir), 8, 8)
    return s.select("id", "hour", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


def wind_probes(spark, sf_dir):
    """All probes."""
    s = wx.sample_grid(_wind_probes(spark, sf_dir), _grid(spark, sf_dir), 8, 8)
    return s.select("id", "hour", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


def coarse_winds(spark, sf_dir):
    return wx.coarsen(_grid(spark, sf_dir), 4).select("hour", "row", "col", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


def wind_export(spark, sf_dir):
    x = wx.export_wind_grid(wx.coarsen(_grid(spark, sf_dir), 4))
    return x.select("hour", "nx", "ny", *((F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 1) + F.lit(0.0)).alias(f"sum_{c}") for c in "uv"), *((F.round(F.col(c)[1], 1) + F.lit(0.0)).alias(f"{c}_1") for c in "uv"))


def unit_conversion(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    product = F.element_at(F.array(*map(F.lit, ("ws", "wg", "tmpf", "rh", "smoke", "apcp01"))), (F.col("ordinal") % 6 + 1).cast("int"))
    return d.select("ordinal", product.alias("product"), F.round(geo.convert_units(product, F.col("frp"), F.col("frp") / 2), 4).alias("x"))


def _member(name):
    return lambda r: r[name]


def _hourly(spark, sf_dir):
    return view(spark, sf_dir, "point_weather")


def point_weather_rows(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    feed = h.groupBy("fire_key").agg(F.sort_array(F.collect_list(F.struct("t", "temp_f", F.when(F.col("code") != 50, F.col("code")).alias("code"), "wind_mph", "wind_from_deg"))).alias("x"))
    arrays = {c: F.transform("x", _member(c)) for c in ("temp_f", "code", "wind_mph", "wind_from_deg")}
    feed = feed.withColumn("time", F.transform("x", lambda r: F.date_format(r["t"], "yyyy-MM-dd'T'HH:mm"))).withColumns(arrays)
    return wx.explode_point_weather(feed.drop("x")).select("fire_key", F.col("t").cast("timestamp_ntz").alias("t"), "code", F.round("temp_f", 4).alias("temp_f"))


def weather_labels(spark, sf_dir):
    return _hourly(spark, sf_dir).select("code").distinct().select("code", tm.wmo_label(F.col("code")).alias("label"), tm.wmo_severity(F.col("code")).alias("severity"))


def daily_weather(spark, sf_dir):
    return wx.weather_slots(_hourly(spark, sf_dir), 24).select("fire_key", "slot", F.col("temp").cast("long").alias("temp"), "code", F.col("wind").cast("long").alias("wind"), F.col("bearing").cast("long").alias("bearing"))


def six_hourly_weather(spark, sf_dir):
    return wx.weather_slots(_hourly(spark, sf_dir), 6).select("fire_key", "slot", F.round("temp", 4).alias("temp"), "code", F.col("bearing").cast("long").alias("bearing"))


def seam_slots(spark, sf_dir):
    h = _hourly(spark, sf_dir).select("fire_key", "t", "code")
    return wx.seam_union(h.filter("t < TIMESTAMP_NTZ'2024-01-15'"), h.filter("t >= TIMESTAMP_NTZ'2024-01-14'").withColumn("code", F.col("code") + 100), ["fire_key", "t"])


def day_boundaries(spark, sf_dir):
    h = _hourly(spark, sf_dir).withColumn("zone", F.when(F.col("fire_key") % 2 == 0, "America/Denver").otherwise("America/Los_Angeles"))
    return wx.day_boundaries(h.select("fire_key", "t", "zone")).select("fire_key", "t", F.col("day").cast("string").alias("day"))


def offered_products(spark, sf_dir):
    return wx.offered_products(_avail(spark, sf_dir).filter("ok").select("run_key", "product"), ["flame-length", "spread-rate"])


QUERIES = {f.__name__: f for f in (
    perimeter_asof, nearest_hours, series_asof, version_neighbours, newest_runs, run_offers, legend_bands, reach_stops, nearest_choices, arrival_census, arrival_histogram, burn_curve, class_census,
    ramp_colors, member_asof, thinned_instants, run_ticks, expected_hours, run_completeness, discovered_cycles, picked_runs, carried_runs, coverage_bands, frame_times, utm_bounds, weather_index, weather_messages,
    listed_hours, wind_vectors, wind_samples, wind_probes, coarse_winds, wind_export, unit_conversion, point_weather_rows, weather_labels, daily_weather, six_hourly_weather, seam_slots, day_boundaries, offered_products)}

_V = dict(versions="SELECT fire_key, version_ts AS t, max(path) AS path FROM perimeter_index GROUP BY ALL", probes="SELECT probe_id, probe_line, fire_key, t, count(*) AS copies FROM time_probes GROUP BY ALL")
_R = "SELECT DISTINCT run_key, slug_key, run_time, complete, expired FROM run_availability"
_OFF = "SELECT run_key, coalesce(string_agg(DISTINCT CASE WHEN ok THEN CAST(pct AS VARCHAR) END, ',' ORDER BY CASE WHEN ok THEN CAST(pct AS VARCHAR) END), '') AS toa_pcts, coalesce(string_agg(DISTINCT CASE WHEN ok AND product IN ('crown-fire','flame-length','hours-since-burned','spread-rate') THEN product END, ',' ORDER BY CASE WHEN ok AND product IN ('crown-fire','flame-length','hours-since-burned','spread-rate') THEN product END), '') AS products, coalesce(nullif(max(CASE WHEN ok THEN n END), 0), 336) AS horizon_hours FROM run_availability GROUP BY 1"
_HZ = "SELECT run_key, horizon_hours * 7 AS h FROM off"
_BANDS = "SELECT * FROM (VALUES " + ", ".join(f"({lo}, {b}, '{c}')" for lo, (b, c) in zip([0, 12, 24, 48, 72, 96, 120, 168, 240], fc.BANDS, strict=True)) + ") AS v(low, high, color)"
_STOPS = "SELECT run_key, high AS stop FROM hz JOIN bands ON high < h - 12 UNION ALL SELECT run_key, h FROM hz"
_F = dict(off=_OFF, hz=_HZ, bands=_BANDS, stops=_STOPS)
_BAND = "CASE " + " ".join(f"WHEN toa_hours <= {b} THEN {b}" for b, _ in fc.BANDS[:-1]) + " ELSE 336 END"
_CYC = "SELECT DISTINCT date_trunc('hour', acq_ts) AS cycle, CAST(ordinal % 20 AS INT) AS fhour FROM detections"
_EXP = "SELECT cycle, CAST(unnest(range(0, CASE WHEN hour(cycle) % 6 = 0 THEN 49 ELSE 19 END)) AS INT) AS fhour FROM (SELECT DISTINCT cycle FROM cyc)"
_CH = "SELECT slug_key AS fire, run_key, run_time, run_key % 7 = 0 AND slug_key % 3 <> 0 AS drawable FROM r"
_CELLS = "SELECT vec_id, i - 1 AS cell, embedding[i] AS v FROM embeddings, range(1, 65) t(i)"
_GRID = "SELECT vec_id // 2 AS hour, CAST((cell // 8) AS INT) AS row, CAST(cell % 8 AS INT) AS col, max(CASE WHEN vec_id % 2 = 0 THEN CAST(v AS DOUBLE) * 20 END) AS u, max(CASE WHEN vec_id % 2 = 1 THEN CAST(v AS DOUBLE) * 20 END) AS v FROM cells GROUP BY ALL"
_W = dict(cells=_CELLS, grid=_GRID)
_COARSE = "SELECT hour, CAST(row // 4 AS BIGINT) AS row, CAST(col // 4 AS BIGINT) AS col, avg(u) AS u, avg(v) AS v FROM grid GROUP BY 1, 2, 3"
_SEV = "list_position([" + ",".join(map(str, tm.WMO_SEVERITY)) + "], code)"
_LAB = "CASE " + " ".join(f"WHEN code IN ({','.join(map(str, c))}) THEN '{n}'" for n, c in tm.WMO_LABELS.items()) + " ELSE 'Cloudy' END"
_UTM = """SELECT grid, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM (
 SELECT grid, zone*6-183 + degrees((d - (1+2*t+c)*d**3/6 + (5-2*c+28*t-3*c*c+8*ep+24*t*t)*d**5/120)/cos(phi)) AS lon, degrees(phi - n1*tan(phi)/r1*(d*d/2 - (5+3*t+10*c-4*c*c-9*ep)*d**4/24 + (61+90*t+298*c+45*t*t-252*ep-3*c*c)*d**6/720)) AS lat FROM (
 SELECT *, (e-500000)/(n1*0.9996) AS d FROM (SELECT *, ep*cos(phi)**2 AS c, tan(phi)**2 AS t, 6378137/sqrt(1-e2*sin(phi)**2) AS n1, 6378137*(1-e2)/pow(1-e2*sin(phi)**2, 1.5) AS r1 FROM (
 SELECT *, mu + (3*e1/2-27*e1**3/32)*sin(2*mu) + (21*e1**2/16-55*e1**4/32)*sin(4*mu) + (151*e1**3/96)*sin(6*mu) + (1097*e1**4/512)*sin(8*mu) AS phi FROM (
 SELECT *, y/0.9996/(6378137*(1-e2/4-3*e2**2/64-5*e2**3/256)) AS mu FROM (SELECT *, e2/(1-e2) AS ep, (1-sqrt(1-e2))/(1+sqrt(1-e2)) AS e1, CASE WHEN north THEN nn ELSE nn-10000000 END AS y FROM corners, (SELECT (1/298.257223563::DOUBLE)*(2-1/298.257223563::DOUBLE) AS e2)))))))
 GROUP BY grid"""
_COR = "SELECT ordinal AS grid, 300000.0::DOUBLE + ordinal*1000 + a*30000 AS e, 4500000.0::DOUBLE + ordinal*2000 + b*20000 AS nn, ordinal % 9 + 10 AS zone, ordinal % 5 <> 0 AS north FROM fires, (VALUES (0,0),(1,0),(1,1),(0,1)) v(a,b)"
_KEY = "'hrrr.20260817/conus/hrrr/' || lpad(CAST(ordinal % 24 AS VARCHAR), 2, '0') AS cycle, CAST(ordinal % 49 AS INT) AS fhour"

_PROBED = """SELECT id, p.hour, CASE WHEN count(u) = 4 THEN round(sum(w * u), 4) END AS u, CASE WHEN count(v) = 4 THEN round(sum(w * v), 4) END AS v FROM (
 SELECT id, hour, r0 + i AS row, c0 + j AS col, (CASE WHEN i = 1 THEN r - r0 ELSE 1 - r + r0 END) * (CASE WHEN j = 1 THEN c - c0 ELSE 1 - c + c0 END) AS w FROM (SELECT *, least(floor(r), 6)::INT AS r0, least(floor(c), 6)::INT AS c0 FROM (
 SELECT vec_id AS id, vec_id // 2 AS hour, greatest(0, least(7, vec_id % 90 / 10.0::DOUBLE - 0.5)) AS r, greatest(0, least(7, vec_id % 70 / 8.0::DOUBLE)) AS c FROM embeddings {where})), (VALUES (0,0),(0,1),(1,0),(1,1)) k(i, j)) p LEFT JOIN grid g ON g.hour = p.hour AND g.row = p.row AND g.col = p.col GROUP BY id, p.hour"""

ORACLE = {
    "perimeter_asof": cte("SELECT p.fire_key, p.t, probe_id, probe_line, copies, v.t AS version_t, v.path FROM probes p ASOF LEFT JOIN versions v ON p.fire_key = v.fire_key AND p.t >= v.t", "perimeter_index", "time_probes", **_V),
    "nearest_hours": cte("""SELECT fire_key, t, probe_id, probe_line, copies, CASE WHEN abs(epoch_ms(h) - epoch_ms(t)) <= 300*60000 THEN h END AS hour_t FROM (SELECT *, CASE WHEN f IS NULL OR epoch_ms(t) - epoch_ms(b) <= epoch_ms(f) - epoch_ms(t) THEN b ELSE f END AS h FROM (
 SELECT x.*, v.t AS f FROM (SELECT p.*, v.t AS b FROM p ASOF LEFT JOIN v ON p.fire_key = v.fire_key AND p.t >= v.t) x ASOF LEFT JOIN v ON x.fire_key = v.fire_key AND x.t <= v.t))""", "perimeter_index", "time_probes", **_V,
        p="SELECT * REPLACE (t + to_hours(CAST(probe_line * 4 AS INT)) AS t) FROM probes", v="SELECT fire_key, t + INTERVAL 10 HOURS AS t FROM versions"),
    "series_asof": cte("SELECT p.fire_key, p.t, probe_id, probe_line, copies, coalesce(v.path, f.path) AS path FROM probes p ASOF LEFT JOIN late v ON p.fire_key = v.fire_key AND p.t >= v.t LEFT JOIN (SELECT fire_key, arg_min(path, t) AS path FROM late GROUP BY 1) f ON f.fire_key = p.fire_key", "perimeter_index", "time_probes", **_V, late="SELECT * FROM versions WHERE t >= TIMESTAMP '1994-01-01'"),
    "version_neighbours": cte("SELECT DISTINCT a.fire_key, a.path, CAST(a.k - b.k AS BIGINT) AS distance FROM k a JOIN k b ON a.fire_key = b.fire_key AND b.path LIKE '%7' AND abs(a.k - b.k) <= 2", "perimeter_index", "time_probes", **_V, k="SELECT *, row_number() OVER (PARTITION BY fire_key ORDER BY t, path) AS k FROM versions"),
    "newest_runs": cte("SELECT run_key, slug_key, rank FROM (SELECT run_key, slug_key, CAST(row_number() OVER (PARTITION BY slug_key ORDER BY run_time DESC, run_key) AS INT) AS rank FROM r WHERE complete AND NOT expired) WHERE rank <= 2", "run_availability", r=_R),
    "run_offers": cte("SELECT * FROM off", "run_availability", off=_OFF),
    "legend_bands": cte("SELECT run_key, least(high, h) AS hours, color FROM hz JOIN bands ON low < h", "run_availability", **_F),
    "reach_stops": cte("SELECT * FROM stops", "run_availability", **_F),
    "nearest_choices": cte("SELECT run_key, stop, pct FROM (SELECT run_key, arg_min(stop, abs(stop - least(240, h)) * 1000 + stop) AS stop FROM stops JOIN hz USING (run_key) GROUP BY 1) LEFT JOIN (SELECT run_key, arg_min(pct, abs(pct - 40) * 1000 + pct) AS pct FROM run_availability WHERE ok GROUP BY 1) USING (run_key)", "run_availability", **_F),
    "arrival_census": cte("SELECT run_key, pct, count(*) FILTER (toa_hours > 0 AND toa_hours <= 72) AS burned, count(*) FILTER (toa_hours > 60 AND toa_hours <= 72) AS leading, count(*) FILTER (toa_hours > 72) AS later, count(*) FILTER (NOT toa_hours > 0) AS nodata FROM toa_pixels GROUP BY ALL", "toa_pixels"),
    "arrival_histogram": cte(f"SELECT run_key, pct, {_BAND} AS band, count(*) AS n FROM toa_pixels WHERE toa_hours > 0 AND toa_hours <= 240 GROUP BY ALL", "toa_pixels"),
    "burn_curve": cte("SELECT run_key, pct, hour, CAST(sum(n) OVER (PARTITION BY run_key, pct ORDER BY hour) AS BIGINT) AS burned FROM (SELECT run_key, pct, CAST(ceil(toa_hours) AS BIGINT) AS hour, count(*) AS n FROM toa_pixels WHERE toa_hours > 0 GROUP BY ALL)", "toa_pixels"),
    "class_census": cte("SELECT run_key, pct, 'flame-length' AS product, row % 4 AS valid_time, CAST(floor(toa_hours / 50) AS BIGINT) AS value, count(*) AS n FROM toa_pixels WHERE toa_hours >= 50 GROUP BY ALL", "toa_pixels"),
    "ramp_colors": cte("SELECT value, " + ", ".join(f"CAST(floor(c0[{k}] + (c1[{k}] - c0[{k}]) * share + 0.5) AS INT) AS {n}" for k, n in ((1, 'r'), (2, 'g'), (3, 'b'))) + """ FROM (SELECT value, CASE WHEN value >= 300 THEN [255,150,40] WHEN value >= 200 THEN [255,220,80] WHEN value >= 100 THEN [80,170,150] ELSE [120,180,220] END AS c0,
 CASE WHEN value >= 200 THEN [255,150,40] WHEN value >= 100 THEN [255,220,80] ELSE [80,170,150] END AS c1, CASE WHEN value >= 300 THEN 0 ELSE (value % 100) / 100 END AS share FROM (SELECT DISTINCT toa_hours AS value FROM toa_pixels) WHERE value <> 0)""", "toa_pixels"),
    "member_asof": cte("SELECT p.run_key, p.t, probe_id, probe_line, copies, m.t AS version_t FROM p ASOF LEFT JOIN m ON p.run_key = m.run_key AND p.t >= m.t", "time_probes", "run_availability", r=_R, p="SELECT probe_id % 40 AS run_key, t, probe_id, probe_line, copies FROM (" + _V["probes"] + ")", m="SELECT DISTINCT run_key % 40 AS run_key, run_time AS t FROM r"),
    "thinned_instants": cte("SELECT run_key, t FROM (SELECT *, epoch(t - min(t) OVER (PARTITION BY run_key)) AS s FROM d) WHERE s <= 86400 OR (s <= 259200 AND floor(s/3600) % 3 = 0) OR (s > 259200 AND floor(s/3600) % 6 = 0)", "detections", d="SELECT DISTINCT ordinal % 7 AS run_key, date_trunc('hour', acq_ts) AS t FROM detections"),
    "run_ticks": cte("SELECT run_key, unnest(generate_series(run_time, run_time + to_hours(CAST(h AS INT)), INTERVAL 1 HOUR)) AS t FROM r JOIN hz USING (run_key)", "run_availability", r=_R, **_F),
    "expected_hours": cte("SELECT * FROM ex", "detections", cyc=_CYC, ex=_EXP),
    "run_completeness": cte("SELECT cycle, coalesce(g, 0) AS rendered, expected, coalesce(g, 0) >= expected AS complete FROM (SELECT cycle, count(*) AS expected FROM ex GROUP BY 1) LEFT JOIN (SELECT cycle, count(*) AS g FROM cyc SEMI JOIN ex USING (cycle, fhour) GROUP BY 1) USING (cycle)", "detections", cyc=_CYC, ex=_EXP),
    "discovered_cycles": cte("SELECT cycle, count(DISTINCT fhour) AS hours FROM cyc WHERE cycle <= TIMESTAMP '2024-01-20 12:30:00' AND cycle > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1 HAVING count(DISTINCT fhour) >= 2 ORDER BY cycle DESC LIMIT 2", "detections", cyc=_CYC),
    "picked_runs": cte("SELECT fire, run_key FROM ch QUALIFY row_number() OVER (PARTITION BY fire ORDER BY drawable DESC, run_time DESC, run_key DESC) = 1", "run_availability", r=_R, ch=_CH),
    "carried_runs": cte("""SELECT fire, run_key, drawable FROM cur UNION ALL SELECT fire, run_key, true FROM (SELECT * FROM ch WHERE run_key % 5 = 0 AND run_key % 2 = 1 AND fire IN (SELECT fire FROM cur) AND fire NOT IN (SELECT fire FROM cur WHERE drawable)
 QUALIFY row_number() OVER (PARTITION BY fire ORDER BY run_time DESC, run_key DESC) = 1)""", "run_availability", r=_R, ch=_CH, cur="SELECT * FROM ch WHERE run_key % 2 = 0"),
    "coverage_bands": cte('SELECT fire_key * 100 + dayofmonth(t) AS run_key, min(t) AS "first", max(t) AS "last" FROM point_weather GROUP BY 1 HAVING count(*) >= 2', "point_weather"),
    "frame_times": cte("SELECT DISTINCT t FROM (SELECT date_trunc('hour', acq_ts) AS t FROM detections UNION ALL SELECT t FROM point_weather) WHERE t BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'", "detections", "point_weather"),
    "utm_bounds": cte("SELECT grid, round(w, 6) AS w, round(s, 6) AS s, round(e, 6) AS e, round(n, 6) AS n FROM u", "fires", corners=_COR, u=_UTM),
    "weather_index": cte("""SELECT file_key, pos, msgnum, "offset", var, level, fcst, lead("offset") OVER (PARTITION BY file_key ORDER BY pos) - 1 AS "end" FROM (SELECT file_key, pos, try_cast(split_part(line, ':', 1) AS INT) AS msgnum, try_cast(split_part(line, ':', 2) AS BIGINT) AS "offset", split_part(line, ':', 4) AS var, split_part(line, ':', 5) AS level, split_part(line, ':', 6) AS fcst FROM weather_index_lines)""", "weather_index_lines"),
    "weather_messages": cte("""SELECT file_key, product, string_agg(CAST(m AS VARCHAR), ',' ORDER BY part) AS messages FROM (SELECT file_key, product, part, need, min(m) AS m FROM (SELECT file_key, CAST(split_part(line, ':', 1) AS INT) AS m, split_part(split_part(line, ':', 4), ' ', 1) AS var FROM weather_index_lines)
 JOIN (VALUES ('ws','STANDARD',0,0,2),('ws','STANDARD',1,1,2),('wg','PROMO',2,0,1),('rh','ECONOMY',0,0,2),('rh','MEDIUM',1,1,2)) s(product, v, lv, part, need) ON var = v AND m % 3 = lv GROUP BY ALL) GROUP BY file_key, product HAVING count(*) = max(need)""", "weather_index_lines"),
    "listed_hours": cte(f"SELECT DISTINCT {_KEY} FROM fires WHERE ordinal % 3 <> 0 INTERSECT SELECT {_KEY} FROM fires WHERE ordinal % 4 <> 0", "fires"),
    "wind_vectors": cte("SELECT hour, row, col, CASE WHEN sqrt(u*u + v*v) * 2.23694 >= 1 THEN round(sqrt(u*u + v*v) * 2.23694, 3) END AS speed, round((degrees(atan2(u, v)) + 360) % 360, 3) AS bearing FROM grid", **_W),
    "wind_samples": cte(_PROBED.format(where="WHERE vec_id % 2 = 0"), **_W),
    "wind_probes": cte(_PROBED.format(where=""), **_W),
    "coarse_winds": cte(f"SELECT hour, row, col, round(u, 4) AS u, round(v, 4) AS v FROM ({_COARSE})", **_W),
    "wind_export": cte(f"SELECT hour, 2::BIGINT AS nx, 2::BIGINT AS ny, round(sum(round_even(u, 1)), 1) + 0.0::DOUBLE AS sum_u, round(sum(round_even(v, 1)), 1) + 0.0::DOUBLE AS sum_v, round(max(round_even(u, 1)) FILTER (row = 0 AND col = 1), 1) + 0.0::DOUBLE AS u_1, round(max(round_even(v, 1)) FILTER (row = 0 AND col = 1), 1) + 0.0::DOUBLE AS v_1 FROM ({_COARSE}) GROUP BY hour", **_W),
    "unit_conversion": cte("SELECT ordinal, product, round(CASE product WHEN 'ws' THEN sqrt(frp*frp + frp*frp/4) * 2.23694 WHEN 'wg' THEN frp * 2.23694 WHEN 'tmpf' THEN (frp - 273.15) * 9 / 5 + 32 WHEN 'smoke' THEN frp * 1e9 WHEN 'apcp01' THEN frp / 25.4 ELSE frp END, 4) AS x FROM (SELECT *, ['ws','wg','tmpf','rh','smoke','apcp01'][ordinal % 6 + 1] AS product FROM detections)", "detections"),
    "point_weather_rows": cte("SELECT fire_key, t, code, round(temp_f, 4) AS temp_f FROM point_weather WHERE code <> 50", "point_weather"),
    "weather_labels": cte(f"SELECT DISTINCT code, {_LAB} AS label, CAST(coalesce({_SEV} - 1, 28) AS INT) AS severity FROM point_weather", "point_weather"),
    "daily_weather": cte(f"""SELECT fire_key, date_trunc('day', t) AS slot, CAST(floor(max(temp_f) + 0.5) AS BIGINT) AS temp, arg_min(code, coalesce({_SEV}, 29) * 1e12 + epoch(t)) AS code, CAST(floor(max(wind_mph) + 0.5) AS BIGINT) AS wind,
 (first(wind_from_deg ORDER BY wind_mph DESC, t) + 180) % 360 AS bearing FROM point_weather GROUP BY 1, 2""", "point_weather"),
    "six_hourly_weather": cte("SELECT fire_key, t AS slot, round(temp_f, 4) AS temp, code, (wind_from_deg + 180) % 360 AS bearing FROM point_weather WHERE hour(t) % 6 = 0", "point_weather"),
    "seam_slots": cte("SELECT fire_key, t, CASE WHEN t >= TIMESTAMP '2024-01-14' THEN code + 100 ELSE code END AS code FROM point_weather", "point_weather"),
    "day_boundaries": cte("SELECT fire_key, t, CAST(day AS VARCHAR) AS day FROM (SELECT *, lag(day) OVER (PARTITION BY fire_key ORDER BY t) AS b FROM (SELECT fire_key, t, CAST(timezone(CASE WHEN fire_key % 2 = 0 THEN 'America/Denver' ELSE 'America/Los_Angeles' END, timezone('UTC', t)) AS DATE) AS day FROM point_weather)) WHERE b <> day", "point_weather"),
    "offered_products": cte("SELECT DISTINCT run_key, product, CASE product WHEN 'flame-length' THEN 1 ELSE 2 END AS place FROM run_availability WHERE ok AND product IN ('flame-length', 'spread-rate')", "run_availability"),
}
