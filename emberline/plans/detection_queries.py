"""Queries over detections and fires, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import time as tm
from ..operators import detections as ops
from .adapters import cte, view

#: The clock of the given tables.
NOW = "2024-01-20 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = ops.history_since(view(spark, sf_dir, "fires"), _now(), 30)
    return ops.query_boxes(fires).select(F.col("ordinal").alias("fire"), F.col("since").cast("string").alias("since"), "box", "timezone", "fire_coordinates")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.detections_for_fires(view(spark, sf_dir, "detections"), _boxes(spark, sf_dir).select("fire", "since", "box"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = ops.with_zone(view(spark, sf_dir, "fires")).select(F.col("ordinal").alias("fire"), "zone")
    return ops.daily_counts_in_boxes(view(spark, sf_dir, "detections"), _boxes(spark, sf_dir).select("fire", "since", "box"), zones)


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = ops.with_zone(ops.query_boxes(view(spark, sf_dir, "fires"))).select(
        F.col("ordinal").alias("fire"), "zone", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz").alias("from_ts"), _now().alias("to_ts"))
    return ops.local_days(windows)


def detection_fields(spark, sf_dir):
    d = ops.normalized(view(spark, sf_dir, "detections"))
    return d.select("ordinal", F.col("acq_instant").cast("timestamp_ntz").alias("acq_instant"), "conf", tm.to_epoch_ms(F.col("acq_instant")).alias("acq_ms"))


def detections_slim(spark, sf_dir):
    return ops.slim(view(spark, sf_dir, "detections"))


def detections_at(spark, sf_dir):
    d = ops.normalized(view(spark, sf_dir, "detections")).filter(tm.visible_at(F.col("acq_ts"), _now()))
    return d.select("ordinal", F.round(tm.age_position(F.col("acq_ts"), _now()), 4).alias("age"), tm.low_weight(F.col("conf")).alias("weight"))


def box_algebra(spark, sf_dir):
    f = view(spark, sf_dir, "fires").withColumn("p", geo.parse_lat_lon(F.col("fire_coordinates"), True)).filter("p is not null")
    f = f.withColumn("r", geo.rect(F.col("p.lon"), F.col("p.lat")))
    f = f.withColumns({"g": geo.snap(F.col("r")), "q": geo.pad(F.col("r"), 0.1, 85), "u": geo.box_union(geo.rect(F.col("p.lon"), F.col("p.lat"), 1.0, 0.1), F.col("r"))})
    return f.select(
        "ordinal", *(F.round(f"g.{c}", 6).alias(f"snap_{c}") for c in "wsen"), *(F.round(f"q.{c}", 6).alias(f"pad_{c}") for c in "wsen"), *(F.round(f"u.{c}", 6).alias(f"union_{c}") for c in "wsen"),
        geo.box_contains(F.col("g"), F.col("r")).alias("holds"), geo.box_contains(F.col("r"), F.col("u")).alias("held"))


def mercator(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    return d.select("ordinal", F.round(geo.merc_x(F.col("lon")), 3).alias("x"), F.round(geo.merc_y(F.col("lat")), 3).alias("y"), F.round(geo.inv_merc_y(geo.merc_y(F.col("lat"))), 6).alias("lat_back"))


def detections_in_boxes(spark, sf_dir):
    return _matched(spark, sf_dir).select("fire", "ordinal", "acq_date")


def detections_in_leaves(spark, sf_dir):
    """C6 on the quadtree: the rows of detections_in_boxes."""
    found = ops.detections_on_tree(view(spark, sf_dir, "detections"), _boxes(spark, sf_dir).select("fire", "since", "box"), 1 / 64, apart=["ordinal"])
    return found.select("fire", "ordinal", "acq_date")


def daily_detections(spark, sf_dir):
    return _daily(spark, sf_dir).withColumn("local_day", F.col("local_day").cast("string"))


def local_days(spark, sf_dir):
    return _days(spark, sf_dir).withColumn("local_day", F.col("local_day").cast("string"))


def zero_filled_activity(spark, sf_dir):
    return ops.zero_filled(_days(spark, sf_dir), _daily(spark, sf_dir)).select("fire", F.col("local_day").cast("string").alias("local_day"), "n")


def activity_by_local_day(spark, sf_dir):
    days = ops.normalize_activity(ops.zero_filled(_days(spark, sf_dir), _daily(spark, sf_dir)))
    return days.select("fire", F.col("local_day").cast("string").alias("local_day"), "n", F.round("activity", 6).alias("activity"))


def activity_samples(spark, sf_dir):
    days = ops.normalize_activity(ops.zero_filled(_days(spark, sf_dir), _daily(spark, sf_dir)))
    return ops.activity_samples(days, _now()).select("fire", "t", F.round("activity", 6).alias("activity"))


def archive_index(spark, sf_dir):
    i = ops.archive_index_in_boxes(view(spark, sf_dir, "detections"), _boxes(spark, sf_dir).select("fire", "since", "box"))
    return i.select("fire", F.array_join("days", ",").alias("days"), *(F.round(c, 6).alias(c) for c in "wsen"))


def final_days(spark, sf_dir):
    days = ops.acquired_days_in_boxes(view(spark, sf_dir, "detections"), _boxes(spark, sf_dir).select("fire", "since", "box"))
    return ops.mark_final(days, F.lit("2024-01-18"), _now(), 5)


def history_since(spark, sf_dir):
    return ops.history_since(view(spark, sf_dir, "fires"), _now()).select("ordinal", F.col("since").cast("string").alias("since"))


def stitched_pages(spark, sf_dir):
    d = view(spark, sf_dir, "detections").withColumns({"lon": F.round("lon", 1), "lat": F.round("lat", 1), "acq_time": F.substr("acq_time", F.lit(1), F.lit(1))})
    return ops.stitch(d.filter("ordinal % 3 <> 0"), d.filter("ordinal % 3 <> 1")).select("ordinal", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "acq_date", "acq_time", "source")


def detection_pages(spark, sf_dir):
    return ops.page(view(spark, sf_dir, "detections"), F.lit("2024-01-10"), 700).select("ordinal", "acq_date")


def generations(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    state = boxes.filter("fire % 4 <> 0").select("fire", F.when(F.col("fire") % 3 == 0, geo.snap(geo.pad(F.col("box"), -0.2))).otherwise(F.col("box")).alias("archived"), F.lit(2).alias("gen"))
    return ops.next_generation(state, boxes.select("fire", "box")).select("fire", *(F.round(f"box.{c}", 6).alias(c) for c in "wsen"), "gen", "restarted")


def recovered_state(spark, sf_dir):
    f = view(spark, sf_dir, "fires").select(F.col("ordinal").alias("fire"), F.lit(3).alias("gen"), F.to_date("created_on").cast("string").alias("day"))
    state = f.filter("fire % 2 = 0").withColumn("gen", F.lit(5)).withColumn("day", F.when(F.col("fire") % 4 == 0, F.col("day")))
    return ops.recover_state(state, f.filter("fire % 5 <> 0"), ["gen", "day"])


def detections_source(spark, sf_dir):
    d, boxes = view(spark, sf_dir, "detections"), _boxes(spark, sf_dir).select("fire", "since", "box")
    index = ops.counts_in_boxes(d, boxes).filter("n >= 3").select("fire")
    archived, direct = d.filter("ordinal % 2 = 0").withColumn("origin", F.lit("archive")), d.withColumn("origin", F.lit("direct"))
    return ops.detections_source_in_boxes(archived, direct, boxes, index).select("fire", "ordinal", "origin")


QUERIES = {f.__name__: f for f in (
    detection_fields, detections_slim, detections_at, box_algebra, mercator, detections_in_boxes, detections_in_leaves, daily_detections, local_days, zero_filled_activity, activity_by_local_day,
    activity_samples, archive_index, final_days, history_since, stitched_pages, detection_pages, generations, recovered_state, detections_source)}

_N = f"TIMESTAMP '{NOW}'"
_CONF = """CASE WHEN lower(trim(coalesce(confidence,''))) IN ('l','low') THEN 'low' WHEN lower(trim(coalesce(confidence,''))) IN ('n','nominal') THEN 'nominal' WHEN lower(trim(coalesce(confidence,''))) IN ('h','high') THEN 'high'
 WHEN try_cast(trim(confidence) AS DOUBLE) < 30 THEN 'low' WHEN try_cast(trim(confidence) AS DOUBLE) >= 80 THEN 'high' ELSE 'nominal' END"""
_INSTANT = "try_strptime(acq_date || ' ' || lpad(CAST(CAST(try_cast(acq_time AS DOUBLE) AS INT) AS VARCHAR), 4, '0'), '%Y-%m-%d %H%M')"
_PLACED = "SELECT *, try_cast(trim(split_part(fire_coordinates, ',', 2)) AS DOUBLE) AS lon, try_cast(trim(split_part(fire_coordinates, ',', 1)) AS DOUBLE) AS lat FROM fires WHERE len(string_split(fire_coordinates, ',')) = 2"
_BOXES = f"SELECT ordinal AS fire, timezone, CAST(greatest(CAST(created_on AS DATE), DATE '2024-01-20' - 30) AS VARCHAR) AS since, floor((lon-0.6)/0.25)*0.25 AS w, floor((lat-0.5)/0.25)*0.25 AS s, ceil((lon+0.6)/0.25)*0.25 AS e, ceil((lat+0.5)/0.25)*0.25 AS n FROM placed"
_MATCHED = "SELECT b.fire, d.* FROM detections d JOIN boxes b ON d.lon BETWEEN b.w AND b.e AND d.lat BETWEEN b.s AND b.n AND d.acq_date >= b.since"
_ZONES = "SELECT ordinal AS fire, CASE WHEN timezone = 'Not/AZone' THEN 'UTC' ELSE timezone END AS zone FROM fires"
_DAILY = "SELECT fire, CAST(timezone(zone, timezone('UTC', acq_ts)) AS DATE) AS local_day, count(*) AS n FROM matched JOIN zones USING (fire) GROUP BY ALL"
_DAYS = f"""SELECT fire, CAST(d AS DATE) AS local_day, timezone('UTC', timezone(zone, d)) AS start_utc, timezone('UTC', timezone(zone, d + INTERVAL 1 DAY)) AS end_utc
FROM (SELECT fire, zone, unnest(generate_series(CAST(CAST(timezone(zone, timezone('UTC', TIMESTAMP '2024-01-05 00:00:00')) AS DATE) AS TIMESTAMP), CAST(CAST(timezone(zone, timezone('UTC', {_N})) AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM zones JOIN placed ON fire = ordinal)"""
_ZERO = "SELECT fire, local_day, start_utc, end_utc, coalesce(n, 0) AS n FROM days LEFT JOIN daily USING (fire, local_day)"
_ACT = "SELECT fire, local_day, start_utc, end_utc, n, CASE WHEN n > 0 THEN greatest(0.12::DOUBLE, n / top) ELSE 0.0::DOUBLE END AS activity FROM (SELECT *, max(n) OVER (PARTITION BY fire) AS top FROM zero) WHERE top > 0"
_M = dict(placed=_PLACED, boxes=_BOXES, matched=_MATCHED)
_ALL = _M | dict(zones=_ZONES, daily=_DAILY, days=_DAYS, zero=_ZERO, act=_ACT)
_R = lambda box, p: ", ".join(f"round({box}{c}, 6) AS {p}{c}" for c in "wsen")

ORACLE = {
    "detection_fields": cte(f"SELECT ordinal, {_INSTANT} AS acq_instant, {_CONF} AS conf, epoch_ms({_INSTANT}) AS acq_ms FROM detections", "detections"),
    "detections_slim": cte("SELECT lon, lat, acq_date, acq_time, source, confidence, frp FROM detections", "detections"),
    "detections_at": cte(f"SELECT ordinal, round(greatest(0.0, least(1.0, h / 48)), 4) AS age, CASE WHEN conf = 'low' THEN 0.45::DOUBLE ELSE 0.8::DOUBLE END AS weight FROM (SELECT ordinal, {_CONF} AS conf, (epoch_ms({_N}) - epoch_ms(acq_ts)) / 3600000.0::DOUBLE AS h FROM detections) WHERE h >= 0 AND h <= 72", "detections"),
    "box_algebra": cte("""SELECT ordinal, round(floor((lon-0.6)/0.25)*0.25, 6) AS snap_w, round(floor((lat-0.5)/0.25)*0.25, 6) AS snap_s, round(ceil((lon+0.6)/0.25)*0.25, 6) AS snap_e, round(ceil((lat+0.5)/0.25)*0.25, 6) AS snap_n,
 round(lon-0.6-0.12, 6) AS pad_w, round(greatest(lat-0.5-0.1, -85), 6) AS pad_s, round(lon+0.6+0.12, 6) AS pad_e, round(least(lat+0.5+0.1, 85), 6) AS pad_n, round(lon-1.0, 6) AS union_w, round(lat-0.5, 6) AS union_s, round(lon+1.0, 6) AS union_e, round(lat+0.5, 6) AS union_n, true AS holds, false AS held
 FROM placed WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""", "fires", placed=_PLACED),
    "mercator": cte("SELECT ordinal, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi()/4 + radians(lat)/2)) * 6378137, 3) AS y, round(lat, 6) AS lat_back FROM detections", "detections"),
    "detections_in_boxes": cte("SELECT fire, ordinal, acq_date FROM matched", "fires", "detections", **_M),
    "detections_in_leaves": cte("SELECT fire, ordinal, acq_date FROM matched", "fires", "detections", **_M),
    "daily_detections": cte("SELECT * REPLACE (CAST(local_day AS VARCHAR) AS local_day) FROM daily", "fires", "detections", **_M, zones=_ZONES, daily=_DAILY),
    "local_days": cte("SELECT * REPLACE (CAST(local_day AS VARCHAR) AS local_day) FROM days", "fires", placed=_PLACED, zones=_ZONES, days=_DAYS),
    "zero_filled_activity": cte("SELECT fire, CAST(local_day AS VARCHAR) AS local_day, n FROM zero", "fires", "detections", **_ALL),
    "activity_by_local_day": cte("SELECT fire, CAST(local_day AS VARCHAR) AS local_day, n, round(activity, 6) AS activity FROM act", "fires", "detections", **_ALL),
    "activity_samples": cte(f"""SELECT fire, t, round(activity, 6) AS activity FROM (SELECT * FROM s UNION ALL SELECT fire, {_N}, arg_max(activity, t) FROM s GROUP BY fire HAVING max(t) < {_N})""", "fires", "detections", **_ALL, s=f"SELECT fire, least(start_utc + (end_utc - start_utc) / 2, {_N}) AS t, activity FROM act"),
    "archive_index": cte("SELECT fire, string_agg(DISTINCT acq_date, ',' ORDER BY acq_date) AS days, round(min(lon), 6) AS w, round(min(lat), 6) AS s, round(max(lon), 6) AS e, round(max(lat), 6) AS n FROM matched GROUP BY fire", "fires", "detections", **_M),
    "final_days": cte("SELECT fire, acq_date, n, n > 5 AS over_cap, acq_date < '2024-01-18' AND acq_date < '2024-01-19' AND n <= 5 AS final FROM (SELECT fire, acq_date, count(*) AS n FROM matched GROUP BY ALL)", "fires", "detections", **_M),
    "history_since": cte("SELECT ordinal, CAST(greatest(CAST(created_on AS DATE), DATE '2024-01-20' - 45) AS VARCHAR) AS since FROM fires", "fires"),
    "stitched_pages": cte("SELECT min(ordinal) AS ordinal, lon, lat, acq_date, acq_time, source FROM (SELECT ordinal, round(lon, 1) AS lon, round(lat, 1) AS lat, acq_date, substr(acq_time, 1, 1) AS acq_time, source FROM detections) GROUP BY ALL", "detections"),
    # page after page: its newest day begins the next one
    "detection_pages": "WITH RECURSIVE " + cte("", "detections").removeprefix("WITH ").rstrip() + """,
 d AS (SELECT ordinal, acq_date, row_number() OVER (ORDER BY acq_date, ordinal) AS r FROM detections WHERE acq_date >= '2024-01-10'),
 first AS (SELECT acq_date, min(r) AS r FROM d GROUP BY 1),
 walk AS (SELECT 0 AS page, '2024-01-10' AS cursor, 0::BIGINT AS reached, true AS go
  UNION ALL SELECT page + 1, coalesce(e.acq_date, cursor), coalesce(e.r, (SELECT count(*) FROM d))::BIGINT, coalesce(e.acq_date <> cursor, false) AND page < 3
   FROM (SELECT w.*, (SELECT min(r) FROM first WHERE acq_date >= w.cursor) AS start FROM walk w WHERE go) w LEFT JOIN d e ON e.r = start + 699)
 SELECT ordinal, acq_date FROM d WHERE r <= (SELECT max(reached) FROM walk)""",
    "generations": cte(f"""SELECT fire, {_R('', '')}, CAST(CASE WHEN fire % 4 = 0 THEN 1 WHEN fire % 3 = 0 AND grown THEN 3 ELSE 2 END AS INT) AS gen, fire % 4 <> 0 AND fire % 3 = 0 AND grown AS restarted
 FROM (SELECT *, NOT (floor((w + (e-w)*0.2)/0.25)*0.25 <= w AND floor((s + (n-s)*0.2)/0.25)*0.25 <= s AND ceil((e - (e-w)*0.2)/0.25)*0.25 >= e AND ceil((n - (n-s)*0.2)/0.25)*0.25 >= n) AS grown FROM boxes)""", "fires", placed=_PLACED, boxes=_BOXES),
    "recovered_state": cte("""SELECT fire, coalesce(s.gen, p.gen) AS gen, coalesce(s.day, p.day) AS day FROM (SELECT fire, 5 AS gen, CASE WHEN fire % 4 = 0 THEN day END AS day FROM f WHERE fire % 2 = 0) s
 FULL JOIN (SELECT fire, 3 AS gen, day FROM f WHERE fire % 5 <> 0) p USING (fire)""", "fires", f="SELECT ordinal AS fire, CAST(CAST(created_on AS DATE) AS VARCHAR) AS day FROM fires"),
    "detections_source": cte("""SELECT fire, ordinal, 'archive' AS origin FROM matched WHERE ordinal % 2 = 0 AND fire IN (SELECT fire FROM matched GROUP BY fire HAVING count(*) >= 3)
 UNION ALL SELECT fire, ordinal, 'direct' FROM matched WHERE fire NOT IN (SELECT fire FROM matched GROUP BY fire HAVING count(*) >= 3)""", "fires", "detections", **_M),
}
