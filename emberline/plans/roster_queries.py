"""Queries over the fire roster, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm
from ..functions.geo import parse_lat_lon
from ..operators import roster as ops
from .adapters import cte, view

NOW = "1996-01-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _fires(spark, sf_dir):
    return view(spark, sf_dir, "fires")


def _runs(spark, sf_dir):
    return view(spark, sf_dir, "run_availability").select("run_key", F.col("slug_key").alias("fire"), "run_time").distinct()


def fire_index(spark, sf_dir):
    f = _fires(spark, sf_dir).filter(tx.is_wildfire(F.col("firetype")))
    p = parse_lat_lon(F.col("fire_coordinates"))
    return f.select("ordinal", tx.slugify(F.col("post_title")).alias("slug"), F.round(p["lon"], 6).alias("lon"), F.round(p["lat"], 6).alias("lat"), tx.norm_guid(F.col("cornea_id")).alias("guid"), F.round("acres", 2).alias("acres"))


def prescribed_fires(spark, sf_dir):
    return _fires(spark, sf_dir).filter(tx.is_prescribed(F.col("firetype"))).select("ordinal", "firetype")


def name_forms(spark, sf_dir):
    f = _fires(spark, sf_dir).withColumn("raw", F.concat(F.lit("2026_"), F.initcap("post_title"), F.when(F.col("ordinal") % 3 == 0, "_Complex").when(F.col("ordinal") % 3 == 1, "%20Fire").otherwise("")))
    n = tx.normalize_name(F.col("raw"))
    return f.select("ordinal", n.alias("name"), F.array_join(tx.name_variants(n), "|").alias("variants"))


def unique_slugs(spark, sf_dir):
    return ops.assign_slugs(_fires(spark, sf_dir)).select("ordinal", "fire_slug")


def roster_merge(spark, sf_dir):
    f = _fires(spark, sf_dir).withColumn("fire_slug", tx.slugify(F.col("post_title")))
    live = f.filter("ordinal % 3 <> 0").withColumns({"post_title": F.when(F.col("ordinal") % 10 == 1, "").otherwise(F.upper("post_title")), "acres": F.when(F.col("ordinal") % 4 == 0, None).otherwise(F.col("acres") + 1)})
    return ops.merge_roster(f.filter("ordinal % 5 <> 0"), live).withColumns({"acres": F.round("acres", 2), "containment": F.col("containment").cast("long")})


def _flagged(spark, sf_dir):
    return _fires(spark, sf_dir).withColumns({"name": F.col("post_title"), "has_spread_forecast": F.col("ordinal") % 4 == 0, "has_incident_maps": F.col("ordinal") % 6 == 0, "active": F.col("ordinal") % 9 != 0})


def roster_chips(spark, sf_dir):
    return _flagged(spark, sf_dir).select("ordinal", *(ops.chip(c).alias(c) for c in ("forecast", "maps", "large", "uncontained")))


def roster_search(spark, sf_dir):
    f = _flagged(spark, sf_dir)
    found = [ops.matches_query(f, q).select("ordinal", F.lit(q).alias("query")) for q in ("", "or", "ore", "blue")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def roster_sorted(spark, sf_dir):
    f = _flagged(spark, sf_dir)
    return ops.sort_roster(f, "containment", True).select("ordinal", F.lit("down").alias("way"), "position").unionByName(ops.sort_roster(f, "containment", False).select("ordinal", F.lit("up").alias("way"), "position"))


def roster_summary(spark, sf_dir):
    return ops.roster_summary(_flagged(spark, sf_dir))


def freshness_grades(spark, sf_dir):
    p = F.col("poly_last_updated")
    f = _fires(spark, sf_dir).withColumn("poly_last_updated", F.when(F.col("ordinal") % 5 == 0, _now() - F.expr("INTERVAL 11 HOURS")).when(F.col("ordinal") % 5 == 1, _now() - F.expr("INTERVAL 30 HOURS")).otherwise(p))
    return f.select("ordinal", tm.freshness(p, _now()).alias("freshness"), tm.feed_grade(p, _now(), 6, 31).alias("grade"), tm.is_stale(p, _now(), 24).alias("stale"), tm.age_badge(p, _now()).alias("badge"))


def display_columns(spark, sf_dir):
    f = ops.with_display_columns(_fires(spark, sf_dir), _now())
    return f.select("ordinal", "acres_text", "age_text")


def op_headings(spark, sf_dir):
    f = _fires(spark, sf_dir).withColumn("zone", F.when(F.col("timezone") == "Not/AZone", "UTC").otherwise(F.col("timezone")))
    day = F.date_add(F.lit("1995-12-30").cast("date"), (F.col("ordinal") % 4).cast("int"))
    return f.select("ordinal", tm.op_date_heading(day, F.col("zone"), _now()).alias("heading"))


def id_lookup(spark, sf_dir):
    f = _fires(spark, sf_dir)
    ids = f.select(F.upper(tx.readable_id(F.col("unique_fire_id"))).alias("id")).unionByName(spark.sql("SELECT '{0A1B2C3D-0000-1111-2222-333344445555}' AS id UNION ALL SELECT 'nobody'"))
    return ops.resolve_ids(ids, f)


def catalog_build(spark, sf_dir):
    f = _fires(spark, sf_dir).select(F.col("ordinal").alias("fire"), "post_title")
    d = view(spark, sf_dir, "files").groupBy(F.col("incident_key").alias("fire")).agg(F.count(F.lit(1)).alias("map_count"))
    per = view(spark, sf_dir, "perimeter_index").groupBy(F.col("fire_key").alias("fire")).agg(F.count(F.lit(1)).alias("perimeter_count"))
    arc = f.filter("fire % 3 = 0").select("fire", F.lit(True).alias("archived"))
    c = ops.build_catalog(f, d, ops.spread_index(_runs(spark, sf_dir)), per, arc)
    return c.select("fire", "post_title", "has_incident_maps", "spread_run_count", "has_spread_forecast", "latest", "perimeter_count", "has_archive")


def spread_index(spark, sf_dir):
    return ops.spread_index(_runs(spark, sf_dir))


def perimeter_counts(spark, sf_dir):
    f = _fires(spark, sf_dir).select(F.col("ordinal").alias("fire"), F.col("poly_last_updated").alias("poly"))
    cache = f.filter("fire % 2 = 0").select("fire", F.when(F.col("fire") % 4 == 0, F.col("poly")).alias("poly"), F.lit(7).cast("long").alias("n"))
    return ops.perimeter_counts(view(spark, sf_dir, "perimeter_index").withColumnRenamed("fire_key", "fire"), f, cache)


def fire_overview(spark, sf_dir):
    f = _fires(spark, sf_dir).select(F.col("ordinal").alias("fire"), "fire_coordinates")
    rep = f.filter("fire % 4 = 1").select("fire", (F.col("fire") * 3).alias("personnel"))
    exp = f.filter("fire % 3 = 1").select("fire", (F.col("fire") * 5).alias("homes"))
    return ops.fire_overview(f, rep, exp, f.filter("fire % 2 = 0").select("fire", F.concat(F.lit("live "), "fire_coordinates").alias("fire_coordinates"))).select("fire", "personnel", "homes", "origin")


def _detail(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    b = o.groupBy((F.col("o_custkey") % 50).alias("fire"), (F.lit(1) + F.col("o_orderkey") % 3).alias("miles")).agg(F.count(F.lit(1)).alias("homes"))
    return b.groupBy("fire").agg(F.collect_list(F.struct(F.col("miles").cast("int").alias("miles"), "homes")).alias("buffers"))


def exposure_buffers(spark, sf_dir):
    p = ops.exposure_pivot(_detail(spark, sf_dir), [1, 2, 3])
    return p.select("fire", *(F.col(str(m)).alias(f"homes_{m}") for m in (1, 2, 3)))


def stop_percents(spark, sf_dir):
    return ops.stop_percent(_fires(spark, sf_dir).select("ordinal", "state", "acres"), "state", "acres").select("ordinal", F.round("percent", 4).alias("percent"))


def preserved_columns(spark, sf_dir):
    f = _fires(spark, sf_dir).select(F.col("ordinal").alias("fire"), "post_title", F.lit(0).cast("long").alias("spread_run_count"))
    return ops.preserve_columns(f, f.filter("fire % 2 = 0").withColumn("spread_run_count", F.col("fire") * 2), ["spread_run_count"])


def healed_counts(spark, sf_dir):
    f = _fires(spark, sf_dir).select(F.col("ordinal").alias("fire"), F.when(F.col("ordinal") % 3 != 0, F.col("ordinal")).alias("map_count"), (F.col("ordinal") % 2 == 0).alias("matched"))
    return ops.heal_counts(f, f.filter("fire % 5 <> 0").select("fire", (F.col("fire") + 100).alias("map_count")))


def stalest_fires(spark, sf_dir):
    f = _fires(spark, sf_dir).select(F.col("ordinal").alias("fire"), "acres", F.when(F.col("ordinal") % 6 != 0, F.col("ordinal") % 4).alias("synced"))
    return ops.stalest_first(f).select("fire", "rank")


def timeline_domains(spark, sf_dir):
    f = _fires(spark, sf_dir).select(F.col("ordinal").alias("fire"), F.when(F.col("ordinal") % 7 != 0, F.col("created_on")).alias("created_on"))
    r = _runs(spark, sf_dir).groupBy("fire").agg((F.max("run_time") + F.expr("INTERVAL 336 HOURS")).alias("run_end"))
    w = view(spark, sf_dir, "point_weather").groupBy(F.col("fire_key").alias("fire")).agg(F.max("t").alias("weather_end"))
    return ops.timeline_domain(f, r, w, _now())


QUERIES = {f.__name__: f for f in (
    fire_index, prescribed_fires, name_forms, unique_slugs, roster_merge, roster_chips, roster_search, roster_sorted, roster_summary, freshness_grades, display_columns, op_headings, id_lookup,
    catalog_build, spread_index, perimeter_counts, fire_overview, exposure_buffers, stop_percents, preserved_columns, healed_counts, stalest_fires, timeline_domains)}

_N = f"TIMESTAMP '{NOW}'"
_SLUG = "nullif(trim(regexp_replace(lower(post_title), '[^a-z0-9]+', '-', 'g'), '-'), '')"
_FLAG = "SELECT *, post_title AS name, ordinal % 4 = 0 AS has_spread_forecast, ordinal % 6 = 0 AS has_incident_maps, ordinal % 9 <> 0 AS active FROM fires"
_RUNS = "SELECT DISTINCT run_key, slug_key AS fire, run_time FROM run_availability"
_SPREAD = "SELECT fire, arg_max(run_key, (epoch_us(run_time)::HUGEINT * 1000000000 - run_key)) AS latest, count(*) AS spread_run_count FROM runs GROUP BY fire"
_NORM = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url_decode(raw), '^\d{4}_', ''), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[_-]+', ' ', 'g')), '[^a-z0-9 ]+', '', 'g'), '\s+', ' ', 'g'))"

ORACLE = {
    "fire_index": cte(f"SELECT ordinal, {_SLUG} AS slug, round(try_cast(trim(split_part(fire_coordinates, ',', 2)) AS DOUBLE), 6) AS lon, CASE WHEN fire_coordinates LIKE '%,%' THEN round(try_cast(trim(split_part(fire_coordinates, ',', 1)) AS DOUBLE), 6) END AS lat, lower(trim(cornea_id, '{{}}')) AS guid, round(acres, 2) AS acres FROM fires WHERE lower(firetype) = 'wildfire'".replace("{{}}", "{}"), "fires"),
    "prescribed_fires": cte("SELECT ordinal, firetype FROM fires WHERE trim(firetype) ILIKE 'prescribed%'", "fires"),
    "name_forms": cte("SELECT ordinal, name, CASE WHEN name LIKE '% complex' THEN name || '|' || trim(left(name, length(name) - 8)) WHEN name LIKE '% fire' THEN name || '|' || trim(left(name, length(name) - 5)) ELSE name END AS variants FROM n", "fires",
        r="SELECT ordinal, '2026_' || array_to_string(list_transform(string_split(post_title, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') || CASE ordinal % 3 WHEN 0 THEN '_Complex' WHEN 1 THEN '%20Fire' ELSE '' END AS raw FROM fires", n=f"SELECT ordinal, {_NORM} AS name FROM r"),
    "unique_slugs": cte("""SELECT ordinal, CASE WHEN nth = 1 THEN base WHEN in_state = 1 THEN base || '-' || lower(state) ELSE base || '-' || CAST(1 + sum(CASE WHEN nth = 1 OR in_state = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY base ORDER BY ordinal) AS VARCHAR) END AS fire_slug
 FROM (SELECT *, CASE WHEN nth = 1 THEN 0 ELSE row_number() OVER (PARTITION BY base, state, nth > 1 ORDER BY ordinal) END AS in_state FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ordinal) AS nth FROM (SELECT *, """ + _SLUG + """ AS base FROM fires)))""", "fires"),
    "roster_merge": cte("""SELECT cornea_id, coalesce(l.name, c.post_title) AS name, coalesce(l.state, c.state) AS state, round(coalesce(l.acres, c.acres), 2) AS acres, coalesce(l.containment, c.containment)::BIGINT AS containment, l.cornea_id IS NOT NULL AS active,
 c.created_on, c.fire_slug, greatest(l.poly_last_updated, c.poly_last_updated) AS poly_last_updated FROM (SELECT *, """ + _SLUG + """ AS fire_slug FROM fires WHERE ordinal % 5 <> 0) c
 FULL JOIN (SELECT cornea_id, CASE WHEN ordinal % 10 = 1 THEN 'Unnamed fire' ELSE upper(post_title) END AS name, state, CASE WHEN ordinal % 4 <> 0 THEN acres + 1 END AS acres, containment, poly_last_updated FROM fires WHERE ordinal % 3 <> 0) l USING (cornea_id)""", "fires"),
    "roster_chips": cte("SELECT ordinal, has_spread_forecast AS forecast, has_incident_maps AS maps, acres > 1000 AS large, coalesce(containment, 0) < 50 AS uncontained FROM flagged", "fires", flagged=_FLAG),
    "roster_search": cte("SELECT ordinal, '' AS query FROM fires UNION ALL SELECT ordinal, 'or' FROM fires WHERE lower(post_title) LIKE '%or%' OR state = 'OR' UNION ALL SELECT ordinal, 'ore' FROM fires WHERE lower(post_title) LIKE '%ore%' OR state = 'OR' UNION ALL SELECT ordinal, 'blue' FROM fires WHERE lower(post_title) LIKE '%blue%'", "fires"),
    "roster_sorted": cte("SELECT ordinal, 'down' AS way, row_number() OVER (ORDER BY containment DESC NULLS LAST, lower(post_title), cornea_id)::INT AS position FROM fires UNION ALL SELECT ordinal, 'up', row_number() OVER (ORDER BY containment ASC NULLS LAST, lower(post_title), cornea_id)::INT FROM fires", "fires"),
    "roster_summary": cte("SELECT count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (has_spread_forecast) AS with_forecast, count(*) FILTER (has_incident_maps) AS with_maps FROM flagged", "fires", flagged=_FLAG),
    "freshness_grades": cte("SELECT ordinal, CASE WHEN p IS NULL THEN 'none' WHEN h < 12 THEN 'fresh' WHEN h < 48 THEN 'recent' ELSE 'stale' END AS freshness, CASE WHEN p IS NULL THEN 'unknown' WHEN h < 6 THEN 'ok' WHEN h < 31 THEN 'warn' ELSE 'late' END AS grade, h >= 24 AS stale, CASE WHEN floor(h) < 24 THEN CAST(CAST(floor(h) AS BIGINT) AS VARCHAR) || 'h' ELSE CAST(CAST(floor(floor(h)/24) AS BIGINT) AS VARCHAR) || 'd' END AS badge FROM (SELECT ordinal, p, (epoch_ms(" + _N + ") - epoch_ms(p)) / 3600000.0 AS h FROM (SELECT ordinal, CASE ordinal % 5 WHEN 0 THEN " + _N + " - INTERVAL 11 HOURS WHEN 1 THEN " + _N + " - INTERVAL 30 HOURS ELSE poly_last_updated END AS p FROM fires))", "fires"),
    "display_columns": cte("SELECT ordinal, CASE WHEN acres >= 1e6 THEN format('{:,.1f}M', acres / 1e6) WHEN acres >= 1e4 THEN format('{:,.1f}k', acres / 1e3) WHEN acres IS NOT NULL THEN format('{:,.0f}', floor(acres + 0.5)) END AS acres_text, CASE WHEN h < 24 THEN CAST(h AS VARCHAR) || 'h' ELSE CAST(CAST(floor(h / 24) AS BIGINT) AS VARCHAR) || 'd' END AS age_text FROM (SELECT *, CAST(floor((epoch_ms(" + _N + ") - epoch_ms(created_on)) / 3600000.0) AS BIGINT) AS h FROM fires)", "fires"),
    "op_headings": cte("SELECT ordinal, CASE WHEN d = today THEN 'Today' WHEN d = today - 1 THEN 'Yesterday' ELSE CAST(d AS VARCHAR) END AS heading FROM (SELECT ordinal, DATE '1995-12-30' + CAST(ordinal % 4 AS INT) AS d, CAST(timezone(CASE WHEN timezone = 'Not/AZone' THEN 'UTC' ELSE timezone END, timezone('UTC', " + _N + ")) AS DATE) AS today FROM fires)", "fires"),
    "id_lookup": cte("SELECT upper(unique_fire_id) AS id, cornea_id FROM fires UNION ALL VALUES ('{0A1B2C3D-0000-1111-2222-333344445555}', '0a1b2c3d-0000-1111-2222-333344445555'), ('nobody', NULL)", "fires"),
    "catalog_build": cte("SELECT ordinal AS fire, post_title, coalesce(map_count > 0, false) AS has_incident_maps, coalesce(spread_run_count, 0) AS spread_run_count, coalesce(spread_run_count > 0, false) AS has_spread_forecast, latest, perimeter_count, ordinal % 3 = 0 AS has_archive FROM fires LEFT JOIN (SELECT incident_key, count(*) AS map_count FROM files GROUP BY 1) ON incident_key = ordinal LEFT JOIN spread ON fire = ordinal LEFT JOIN (SELECT fire_key, count(*) AS perimeter_count FROM perimeter_index GROUP BY 1) ON fire_key = ordinal", "fires", "files", "perimeter_index", "run_availability", runs=_RUNS, spread=_SPREAD),
    "spread_index": cte("SELECT * FROM spread", "run_availability", runs=_RUNS, spread=_SPREAD),
    "perimeter_counts": cte("SELECT ordinal AS fire, CASE WHEN ordinal % 4 = 0 OR (ordinal % 2 = 0 AND poly_last_updated IS NULL) THEN 7 ELSE coalesce(c, CASE WHEN ordinal % 2 = 0 THEN 7 END) END AS n FROM fires LEFT JOIN (SELECT fire_key, count(*) AS c FROM perimeter_index GROUP BY 1) ON fire_key = ordinal", "fires", "perimeter_index"),
    "fire_overview": cte("SELECT ordinal AS fire, CASE WHEN ordinal % 4 = 1 THEN ordinal * 3 END AS personnel, CASE WHEN ordinal % 3 = 1 THEN ordinal * 5 END AS homes, CASE WHEN ordinal % 2 = 0 THEN 'live ' || fire_coordinates ELSE fire_coordinates END AS origin FROM fires", "fires"),
    "exposure_buffers": "SELECT o_custkey % 50 AS fire, nullif(count(*) FILTER (o_orderkey % 3 = 0), 0) AS homes_1, nullif(count(*) FILTER (o_orderkey % 3 = 1), 0) AS homes_2, nullif(count(*) FILTER (o_orderkey % 3 = 2), 0) AS homes_3 FROM orders GROUP BY 1",
    "stop_percents": cte("SELECT ordinal, round(CASE WHEN hi > lo THEN (acres - lo) * 100 / (hi - lo) ELSE 0 END, 4) AS percent FROM (SELECT *, min(acres) OVER (PARTITION BY state) AS lo, max(acres) OVER (PARTITION BY state) AS hi FROM fires)", "fires"),
    "preserved_columns": cte("SELECT ordinal AS fire, post_title, CASE WHEN ordinal % 2 = 0 THEN ordinal * 2 END AS spread_run_count FROM fires", "fires"),
    "healed_counts": cte("SELECT ordinal AS fire, coalesce(CASE WHEN ordinal % 3 <> 0 THEN ordinal END, CASE WHEN ordinal % 5 <> 0 THEN ordinal + 100 END) AS map_count, ordinal % 2 = 0 AND ordinal % 5 = 0 AS requeue FROM fires", "fires"),
    "stalest_fires": cte("SELECT ordinal AS fire, row_number() OVER (ORDER BY CASE WHEN ordinal % 6 <> 0 THEN ordinal % 4 END ASC NULLS FIRST, acres DESC, ordinal)::INT AS rank FROM fires", "fires"),
    "timeline_domains": cte('SELECT ordinal AS fire, coalesce(CASE WHEN ordinal % 7 <> 0 THEN created_on END, ' + _N + ' - INTERVAL 7 DAYS) AS start, greatest(run_end, weather_end, ' + _N + ' + INTERVAL 5 DAYS) AS "end" FROM fires LEFT JOIN (SELECT fire, max(run_time) + INTERVAL 336 HOURS AS run_end FROM runs GROUP BY 1) r ON r.fire = ordinal LEFT JOIN (SELECT fire_key, max(t) AS weather_end FROM point_weather GROUP BY 1) w ON w.fire_key = ordinal', "fires", "run_availability", "point_weather", runs=_RUNS),
}
