"""Queries over the corners of the operators: names that clash, zones of all kinds, links with scores, gates, resumed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..functions import time as tm
from ..operators import detections as det
from ..operators import forecast, incidents, weather
from ..operators import linkage as lk
from ..operators import roster
from ..operators import vocabulary as vocab
from ..sources.sinks import register_functions
from ..sources.sql import register_row_functions
from . import incident_queries as base
from .adapters import cte, view

NOW = "2024-01-20 12:00:00"
#: Zones of the detections' fires by turns: real ones, an invalid one, none.
ZONES = ["America/Detroit", "America/Juneau", "Asia/Kathmandu", "Australia/Lord_Howe", "Nowhere/Land", None, "Europe/Lisbon"]


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _short_names(spark, sf_dir):
    """Fires named by the first three letters of a name, some with a state or a number in the name, some without a state."""
    f = view(spark, sf_dir, "fires")
    k, stem = F.col("ordinal") % 9, F.substr("post_title", F.lit(1), F.lit(3))
    name = F.when(k == 3, F.concat_ws(" ", stem, "state")).when(k == 5, F.concat(stem, F.lit(" 2"))).when(k == 7, F.concat(stem, F.lit(" xx"))).otherwise(stem)
    return f.select("ordinal", name.alias("post_title"), F.when(F.col("ordinal") % 7 != 0, F.col("state")).alias("state"), "cornea_id")


def clashing_slugs(spark, sf_dir):
    return roster.assign_slugs(_short_names(spark, sf_dir)).select("ordinal", "fire_slug")


def state_search(spark, sf_dir):
    f = view(spark, sf_dir, "fires").withColumns({"name": F.col("post_title"), "state": F.substr(F.lit("TXGANCFLOHMAMNMIDCPRWVKS"), (F.col("ordinal") % 12 * 2 + 1).cast("int"), F.lit(2))})
    found = [roster.matches_query(f, q).select("ordinal", F.lit(q).alias("query")) for q in ("carolina", "ma", "mas", " West V")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def zoned_days(spark, sf_dir):
    d = view(spark, sf_dir, "detections").select((F.col("ordinal") % 14).alias("fire"), "acq_ts")
    names = F.array(*map(F.lit, ZONES))
    zones = det.with_zone(d.select("fire", F.element_at(names, (F.col("fire") % 7 + 1).cast("int")).alias("timezone")).distinct()).select("fire", "zone")
    return det.daily_counts(d, zones)


def forecast_links(spark, sf_dir):
    """Slugs with the incident number, another one or none, names cut short, and id documents."""
    f = base._link_fires(spark, sf_dir)
    k = F.col("fire") % 6
    name = F.when(k == 1, F.concat("name", F.lit("s"))).when(k == 4, F.substr("name", F.lit(1), F.length("name") - 5)).otherwise(F.col("name"))
    number = F.when(k == 0, F.concat(F.lit("-"), F.lpad(F.col("fire").cast("string"), 6, "0"))).when(k == 2, F.concat(F.lit("-77"), F.lpad(F.col("fire").cast("string"), 4, "0"))).when(k == 3, "-12").otherwise("")
    slugs = f.select(F.concat(F.lower("state"), F.lit("-"), tx.slugify(name), number).alias("slug")).distinct()
    docs = f.filter("fire % 10 = 5").select(F.concat(F.lower("state"), F.lit("-"), tx.slugify(F.col("name"))).alias("slug"), "cornea_id")
    return lk.match_forecast_slugs(slugs, docs, f)


def gathered_tokens(spark, sf_dir):
    f = base._files(spark, sf_dir)
    parent = F.element_at(F.array(*map(F.lit, ("Products", "GIS", "QR"))), (F.col("ordinal") % 3 + 1).cast("int"))
    day = F.when(F.col("ordinal") % 3 != 2, F.concat(F.lit("202608"), "day"))
    rows = f.select((F.col("incident_key") % 7).alias("dir"), parent.alias("parent"), (F.col("ordinal") % 3).alias("parent_no"), day.alias("day"), F.when(F.col("ordinal") % 5 < 3, F.col("name")).otherwise("none.pdf").alias("name"), "ordinal")
    return incidents.gather_unit_tokens(rows, 2026).select("dir", "token", "n", "rank")


def accepted_sheets(spark, sf_dir):
    """The label points as sheets with a western longitude; by turns too far apart, off the map, noisy, or good."""
    k = F.col("sheet_key") % 5
    val = F.when(F.col("axis") == "lon", -F.col("val") - 77).otherwise(F.col("val"))
    val = F.when(k == 0, val * 200).when(k == 1, val + 60).when(k == 2, val + (F.col("ordinal") % 7) / 50).otherwise(val)
    p = view(spark, sf_dir, "label_points").select(F.col("sheet_key").alias("sheet"), "axis", "pos", val.alias("val"))
    pages = p.select("sheet").distinct().select("sheet", F.lit(51.0).alias("width"), F.lit(80.0).alias("height"))
    found = lk.accepted_fits(p, pages)
    return found.select("sheet", "lon_n", "lat_n", *(F.round(c, 4).alias(c) for c in ("lon_a", "lat_a", "x0", "y0", "x1", "y1")), *(F.round(c, 3).alias(c) for c in ("w", "s", "e", "n")))


def run_products(spark, sf_dir):
    f = view(spark, sf_dir, "run_availability").withColumn("product", F.when(F.col("product") != "isochrones", F.when(F.col("n") % 4 == 0, "wind-vectors").otherwise(F.col("product"))))
    r = forecast.build_runs(f)
    return r.select("run_key", F.array_join(F.transform("toa_pcts", lambda x: x.cast("string")), ",").alias("toa"), *(F.array_join(F.transform(F.try_element_at("products", F.lit(p)), lambda x: x.cast("string")), ",").alias(p.replace("-", "_")) for p in ("flame-length", "spread-rate")), F.col("horizon_hours").cast("long").alias("horizon_hours"))


def arrival_areas(spark, sf_dir):
    return forecast.arrival_areas(view(spark, sf_dir, "toa_pixels"), 200.0, 50.0).select("run_key", "pct", *(F.round(c, 4).alias(c) for c in ("burned_ha", "leading_ha", "later_ha", "nodata_ha")))


def advertised_hours(spark, sf_dir):
    o = view(spark, sf_dir, "run_availability").select((F.date_trunc("day", "run_time") + F.make_interval(hours=F.col("run_key") % 4 * 5)).alias("cycle"), (F.col("n") - 1).alias("fhour"), "run_key").filter("run_key % 3 <> 1")
    cycles = o.select("cycle").distinct()
    listed = o.filter("fhour <= 18").unionByName(cycles.filter(F.hour("cycle") == 5).select("cycle", F.explode(F.sequence(F.lit(0), F.lit(18))).alias("fhour"), F.lit(0).cast("long").alias("run_key")))
    rendered = listed.filter((F.hour("cycle") == 5) | (F.col("run_key") % 5 != 0))
    r = weather.advertised_hours(rendered, listed, forecast.expected_hours(cycles))
    return r.select("cycle", "listed", "rendered", "complete", "full", "done", F.array_join(F.transform("hours", lambda x: x.cast("string")), ",").alias("hours"))


def _shapes(spark, sf_dir):
    """Diamonds around places, of many sizes; their envelopes reach further than they do."""
    f = view(spark, sf_dir, "fires").select(F.col("cornea_id").alias("guid"), (F.lit(2000) + F.col("ordinal") % 27).alias("year"), (F.lit(-124.0) + F.col("ordinal") % 50 * 1.0).alias("x"), (F.lit(32.0) + F.col("ordinal") % 15 * 1.0).alias("y"), (F.lit(0.5) + F.col("ordinal") % 9).alias("r"))
    point = lambda dx, dy: F.array(F.col("x") + dx * F.col("r"), F.col("y") + dy * F.col("r"))
    ring = F.array(point(1, 0), point(0, 1), point(-1, 0), point(0, -1), point(1, 0))
    return f.select("guid", "year", (F.col("x") - F.col("r")).alias("w"), (F.col("y") - F.col("r")).alias("s"), (F.col("x") + F.col("r")).alias("e"), (F.col("y") + F.col("r")).alias("n"), F.array(ring).alias("rings"))


def histories(spark, sf_dir):
    """The three newest shapes around every fire, all fires at once."""
    f = view(spark, sf_dir, "fires")
    box = lambda k, d: (F.col(k) + d).alias
    fires = f.select(F.col("ordinal").alias("fire"), F.col("cornea_id").alias("guid"), (F.lit(-124.0) + F.col("ordinal") * 7 % 50).alias("x"), (F.lit(32.0) + F.col("ordinal") * 3 % 15).alias("y"))
    fires = fires.select("fire", "guid", box("x", -0.75)("w"), box("y", -0.75)("s"), box("x", 0.75)("e"), box("y", 0.75)("n"))
    return lk.histories_of_fires(_shapes(spark, sf_dir), fires, 2026, 3)


def historic_shapes(spark, sf_dir):
    return lk.historic_perimeters(_shapes(spark, sf_dir), (-109.75, 38.25, -106.25, 40.75), 2026, "{F00000021}").select("guid", "year")


#: Rows of a page: some days of some fires have more at every size of the given tables.
PAGE_ROWS = 20


def synced_days(spark, sf_dir):
    """The days of each fire's pages and which of them are final."""
    d = view(spark, sf_dir, "detections").select((F.col("ordinal") % 40).alias("fire"), "ordinal", "acq_date")
    cursors = d.select("fire").distinct().select("fire", F.date_add(F.lit("2024-01-02").cast("date"), (F.col("fire") % 18).cast("int")).cast("string").alias("cursor"))
    return det.mark_synced(det.page_by_fire(d, cursors, PAGE_ROWS, 3), det.next_cursors(d, cursors, _now(), PAGE_ROWS, 3), _now())


def resumed_pages(spark, sf_dir):
    """Per fire the page from its cursor, and where the next one begins."""
    d = view(spark, sf_dir, "detections").select((F.col("ordinal") % 40).alias("fire"), "ordinal", "acq_date")
    cursors = d.select("fire").distinct().select("fire", F.date_add(F.lit("2024-01-02").cast("date"), (F.col("fire") % 18).cast("int")).cast("string").alias("cursor"))
    page = det.page_by_fire(d, cursors, PAGE_ROWS, 3)
    after = det.next_cursors(d, cursors, _now(), PAGE_ROWS, 3)
    taken = page.groupBy("fire").agg(F.count(F.lit(1)).alias("taken"), F.max("ordinal").alias("last_taken"))
    return after.join(taken, "fire", "left").select("fire", "cursor", "stalled", "stalled_day", F.coalesce("taken", F.lit(0)).alias("taken"), "last_taken")


def sql_functions(spark, sf_dir):
    register_functions(spark)
    f = view(spark, sf_dir, "fires")
    return f.selectExpr(
        "ordinal", "slugify(post_title) AS slug", "norm_guid(cornea_id) AS guid", "normalize_name(concat('2026_', initcap(post_title))) AS name", "is_wildfire(firetype) AS wildfire", "is_prescribed(firetype) AS prescribed",
        "freshness(poly_last_updated, TIMESTAMP_NTZ '1996-01-01 00:00:00') AS freshness", "conf_norm(CAST(ordinal AS STRING)) AS conf", "readable_id(unique_fire_id) AS readable", "valid_day(concat('2026-', lpad(CAST(ordinal % 20 AS STRING), 2, '0'), '-11')) AS valid",
        "round(flip_bearing(CAST(ordinal AS DOUBLE)), 3) AS bearing", "round(wind_speed_mph(CAST(ordinal % 7 AS DOUBLE), 4.0D), 4) AS mph")


def zones_known(spark, sf_dir):
    """Which of the fires' zones are valid."""
    f = view(spark, sf_dir, "fires")
    return f.select("ordinal", tm.known_zone(F.col("timezone")).alias("zone"))


def sql_product_names(spark, sf_dir):
    """What product_names gives, by a table function in SQL."""
    register_row_functions(spark)
    return spark.sql("SELECT ordinal, p.* FROM {f}, LATERAL parse_product_filename(name) p", f=base._files(spark, sf_dir))


def sql_unit_tokens(spark, sf_dir):
    register_row_functions(spark)
    return spark.sql("SELECT ordinal, array_join(unit_tokens(name, 2026), ',') AS tokens FROM {f}", f=base._files(spark, sf_dir))


def sql_coordinates(spark, sf_dir):
    register_row_functions(spark)
    p = view(spark, sf_dir, "label_points").select((F.col("ordinal") % 190).alias("d"), (F.col("sub") * 11 % 70).alias("m"), (F.col("ordinal") % 5).alias("h")).distinct()
    text = "concat(CASE WHEN h = 4 THEN '-' ELSE '' END, d, '° ', m, \"'\", CASE h WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'W' ELSE '' END)"
    return spark.sql(f"SELECT d, m, h, c.axis AS axis, round(c.deg, 6) AS deg FROM (SELECT d, m, h, parse_coord({text}) AS c FROM {{p}})", p=p)


def sql_boxes(spark, sf_dir):
    register_row_functions(spark)
    f = view(spark, sf_dir, "fires").withColumn("p", geo.parse_lat_lon(F.col("fire_coordinates"), True)).filter("p is not null").select("ordinal", "p.lon", "p.lat")
    steps = "SELECT ordinal, r, box_snap(r, 0.25D) AS g, box_pad(r, 0.1D, 85D) AS q, box_union(rect(lon, lat, 1D, 0.1D), r) AS u FROM (SELECT *, rect(lon, lat, 0.6D, 0.5D) AS r FROM {f})"
    columns = ", ".join(f"round({k}.{c}, 6) AS {name}_{c}" for k, name in (("g", "snap"), ("q", "pad"), ("u", "union")) for c in "wsen")
    return spark.sql(f"SELECT ordinal, {columns}, box_contains(g, r) AS holds, box_contains(r, u) AS held FROM ({steps})", f=f)


def sql_days(spark, sf_dir):
    """Local days of spans of up to four days, clock changes among them."""
    register_row_functions(spark)
    f = view(spark, sf_dir, "fires").select("ordinal", (F.lit("2024-03-08 00:00:00").cast("timestamp_ntz") + F.make_interval(hours=F.col("ordinal") % 96)).alias("begins"))
    return spark.sql("SELECT ordinal, CAST(d.local_day AS STRING) AS local_day, d.start_utc, d.end_utc FROM {f}, LATERAL local_days('America/Denver', begins, begins + INTERVAL 30 HOURS) d", f=f)


def labelled_products(spark, sf_dir):
    """Labels from a table of the caller's, which knows fewer products and one more."""
    p = view(spark, sf_dir, "files").select("ordinal", F.concat(F.trim("product_raw"), F.when(F.col("ordinal") % 3 == 0, "_arche").otherwise(""), F.when(F.col("ordinal") % 6 == 3, "_Ortho").otherwise("")).alias("product"))
    table = spark.createDataFrame([("ops", "Operations", 1), ("iap_arche", "Action plan, large", 2), ("briefpio", "Briefing", 3), ("ops_arche_ortho", "Photo", 4)], "base string, label string, rank int")
    return vocab.label_products(p, table).select("ordinal", "base", "label", "rank")


QUERIES = {f.__name__: f for f in (
    clashing_slugs, state_search, zoned_days, forecast_links, gathered_tokens, accepted_sheets, run_products, arrival_areas, advertised_hours, historic_shapes, histories, resumed_pages, synced_days, sql_functions, zones_known,
    sql_product_names, sql_unit_tokens, sql_coordinates, sql_boxes, sql_days, labelled_products)}

_SLUG = "nullif(trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-'), '')"
_NORM = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({}, '[_-]+', ' ', 'g')), '[^a-z0-9 ]+', '', 'g'), '\s+', ' ', 'g'))"


_FORMS = "SELECT {key}, state, unnest(CASE WHEN n LIKE '% complex' THEN [n, trim(left(n, length(n) - 8))] WHEN n LIKE '% fire' THEN [n, trim(left(n, length(n) - 5))] ELSE [n] END) AS v FROM (SELECT {key}, state, " + _NORM.replace("{}", "name").replace("{", "{{").replace("}", "}}") + " AS n FROM {source})"


def recursive(body: str, *views: str, **more: str) -> str:
    return "WITH RECURSIVE" + cte(body, *views, **more).removeprefix("WITH")


def ratio(a: str, b: str) -> str:
    """J1 in DuckDB: the longest common subsequence by bits, one for each character of a (at most 120)."""
    full = f"((CAST(1 AS HUGEINT) << CAST(length({a}) AS HUGEINT)) - 1)"
    same = f"CASE WHEN substr({a}, CAST(i + 1 AS BIGINT), 1) = c THEN CAST(1 AS HUGEINT) << CAST(i AS HUGEINT) ELSE CAST(0 AS HUGEINT) END"
    masks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(length({a})), lambda i: {same})))"
    bits = f"list_reduce(list_prepend({full}, {masks}), lambda have, mask: ((have + (have & mask)) | (have - (have & mask))) & {full})"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) * length({b}) = 0 THEN 0.0 ELSE 200.0 * (length({a}) - bit_count({bits})) / (length({a}) + length({b})) END"


_LINK = "SELECT ordinal AS fire, post_title AS name, state, unique_fire_id, cornea_id, CAST(split_part(unique_fire_id, '-', 3) AS BIGINT) AS incident, " + _SLUG.format("post_title") + " AS form FROM fires"


def links(slugs: str, docs: str, with_incident: bool = True) -> dict[str, str]:
    """C4 in steps: by document, exact, fuzzy."""
    incident = "incident" if with_incident else "NULL"
    return {
        "link": _LINK, "slugs": slugs, "docs": docs,
        "by_doc": "SELECT slug, min(fire) AS fire, 'document' AS method, 1.0::DOUBLE AS score FROM slugs JOIN docs USING (slug) JOIN link ON lower(trim(link.cornea_id, '{}')) = lower(trim(docs.cornea_id, '{}')) GROUP BY slug",
        "rest": "SELECT slug, upper(split_part(slug, '-', 1)) AS state, substr(slug, length(split_part(slug, '-', 1)) + 2) AS whole FROM slugs WHERE slug NOT IN (SELECT slug FROM by_doc)",
        "split": r"SELECT *, regexp_replace(whole, '-\d{4,6}$', '') AS bare, try_cast(regexp_extract(whole, '-(\d{4,6})$', 1) AS BIGINT) AS number FROM rest",
        "single": f"SELECT state, form, min(fire) AS fire, min({incident}) AS incident FROM link GROUP BY ALL HAVING count(*) = 1",
        "hits": "SELECT slug, number, coalesce(a.fire, b.fire) AS fire, CASE WHEN a.fire IS NOT NULL THEN a.incident ELSE b.incident END AS incident FROM split LEFT JOIN single a ON a.state = split.state AND a.form = bare LEFT JOIN single b ON b.state = split.state AND b.form = whole WHERE coalesce(a.fire, b.fire) IS NOT NULL",
        "exact": "SELECT slug, fire, CASE WHEN sure THEN 'unit_num' ELSE 'name_exact' END AS method, CASE WHEN sure THEN 1.0 ELSE 0.95 END::DOUBLE AS score FROM (SELECT *, coalesce(suffix(CAST(number AS VARCHAR), CAST(incident AS VARCHAR)), false) AS sure FROM hits)",
        "pairs": f"SELECT slug, fire, {_NORM.format('bare')} AS v, {_NORM.format('name')} AS v2 FROM split JOIN link USING (state) WHERE slug NOT IN (SELECT slug FROM exact)",
        "scored": f"SELECT slug, fire, {ratio('v', 'v2')} AS score FROM pairs",
        "fuzzy": "SELECT slug, fire, 'name_fuzzy' AS method, round_even(score / 100, 3)::DOUBLE AS score FROM scored WHERE score >= 90 QUALIFY row_number() OVER (PARTITION BY slug ORDER BY score DESC, fire) = 1",
    }


_LINKS = "SELECT * FROM by_doc UNION ALL SELECT * FROM exact UNION ALL SELECT * FROM fuzzy"
_CUT = {f"k{i + 1}": f"SELECT sheet, axis, pos, val, a, b FROM (SELECT *, median(r) OVER (PARTITION BY sheet, axis) AS m FROM (SELECT k.sheet, k.axis, k.pos, k.val, l.a, l.b, abs(k.val - l.a * k.pos - l.b) AS r FROM k{i} k JOIN (SELECT sheet, axis, regr_slope(val, pos) AS a, regr_intercept(val, pos) AS b FROM k{i} GROUP BY ALL) l USING (sheet, axis))) WHERE r <= greatest(3 * m, 1e-4)" for i in range(3)}
_DAYS = "CASE fire % 7 " + " ".join(f"WHEN {i} THEN '{z if z and z != 'Nowhere/Land' else 'UTC'}'" for i, z in enumerate(ZONES)) + " END"
_CURSORS = {
    "d": "SELECT ordinal % 40 AS fire, ordinal, acq_date FROM detections", "c": "SELECT DISTINCT fire, CAST(DATE '2024-01-02' + CAST(fire % 18 AS INT) AS VARCHAR) AS cursor FROM d",
}


def paging(limit: int, pages: int) -> dict[str, str]:
    """one page after the other, over the sorted days and ordinals of each fire's rows from d, from its cursor in c."""
    return {
        "lists": "SELECT c.fire, c.cursor, coalesce(list(acq_date ORDER BY acq_date, ordinal) FILTER (ordinal IS NOT NULL), []) AS days, coalesce(list(ordinal ORDER BY acq_date, ordinal) FILTER (ordinal IS NOT NULL), []) AS ids FROM c LEFT JOIN d ON d.fire = c.fire AND d.acq_date >= c.cursor GROUP BY ALL",
        "walk": f"""SELECT fire, cursor AS since, cursor, days, ids, 0 AS page, 'go' AS state, 0::BIGINT AS reached FROM lists
 UNION ALL SELECT fire, since, CASE WHEN newest IS NULL THEN cursor ELSE newest END, days, ids, page + 1, CASE WHEN newest IS NULL THEN 'complete' WHEN newest = cursor THEN 'stalled' WHEN page + 1 = {pages} THEN 'capped' ELSE 'go' END, least(before + {limit}, len(days))::BIGINT
  FROM (SELECT *, days[before + {limit}] AS newest FROM (SELECT *, len(list_filter(days, lambda x: x < cursor)) AS before FROM walk WHERE state = 'go'))""",
        "ended": "SELECT fire, CASE state WHEN 'stalled' THEN CAST(CAST(cursor AS DATE) + 1 AS VARCHAR) WHEN 'complete' THEN greatest(since, '2024-01-19') ELSE least(cursor, '2024-01-19') END AS cursor, state = 'stalled' AS stalled, CASE WHEN state = 'stalled' THEN cursor END AS stalled_day, days[1 : reached] AS days, ids[1 : reached] AS ids FROM walk WHERE state <> 'go'",
    }


_BOX_GAP = "greatest(-109.75 - x, 0, x - -106.25) + greatest(38.25 - y, 0, y - 40.75)"

ORACLE = {
    # fire by fire, with the slugs taken so far
    "clashing_slugs": recursive("SELECT ordinal, slug AS fire_slug FROM walk WHERE i > 0", "fires",
        named="SELECT ordinal, CASE ordinal % 9 WHEN 3 THEN substr(post_title, 1, 3) || ' ' || state WHEN 5 THEN substr(post_title, 1, 3) || ' 2' WHEN 7 THEN substr(post_title, 1, 3) || ' xx' ELSE substr(post_title, 1, 3) END AS post_title, CASE WHEN ordinal % 7 <> 0 THEN lower(state) ELSE 'xx' END AS st FROM fires",
        f="SELECT row_number() OVER (ORDER BY ordinal) AS i, ordinal, st, " + _SLUG.format("post_title") + " AS base FROM named",
        walk="""SELECT 0::BIGINT AS i, 0::BIGINT AS ordinal, '' AS slug, MAP {'': 0} AS taken
 UNION ALL SELECT i, ordinal, slug, map_concat(bumped, CASE WHEN map_contains(bumped, slug) THEN MAP {slug: bumped[slug]} ELSE MAP {slug: 1} END) FROM (
  SELECT f.i, f.ordinal, CASE WHEN NOT map_contains(taken, base) THEN base WHEN NOT map_contains(taken, base || '-' || st) THEN base || '-' || st ELSE base || '-' || CAST(taken[base] + 1 AS VARCHAR) END AS slug,
   CASE WHEN map_contains(taken, base) AND map_contains(taken, base || '-' || st) THEN map_concat(taken, MAP {base: taken[base] + 1}) ELSE taken END AS bumped FROM walk JOIN f ON f.i = walk.i + 1)"""),
    "throttled_events": recursive("SELECT actor, ordinal FROM walk WHERE kept", "user_actions",
        ev="SELECT actor % 20 AS actor, ordinal, ts, row_number() OVER (PARTITION BY actor % 20 ORDER BY ts, ordinal) AS i FROM user_actions",
        walk="""SELECT DISTINCT actor, 0::BIGINT AS ordinal, 0::BIGINT AS i, CAST(NULL AS TIMESTAMP) AS since, 0 AS n, 0 AS total, false AS kept FROM ev
 UNION ALL SELECT actor, ordinal, i, since, CASE WHEN n < 2 AND total < 60 THEN n + 1 ELSE n END, CASE WHEN n < 2 AND total < 60 THEN total + 1 ELSE total END, n < 2 AND total < 60 FROM (
  SELECT ev.actor, ev.ordinal, ev.i, CASE WHEN since IS NULL OR epoch_us(ts) - epoch_us(since) > 60000000 THEN ts ELSE since END AS since, CASE WHEN since IS NULL OR epoch_us(ts) - epoch_us(since) > 60000000 THEN 0 ELSE n END AS n, total FROM walk JOIN ev ON ev.actor = walk.actor AND ev.i = walk.i + 1)"""),
    "name_ratios": cte(f"SELECT least(f.fire, g.fire) AS a, greatest(f.fire, g.fire) AS b, round({ratio('f.name', 'g.name')}, 4) AS ratio FROM named f JOIN named g ON f.state = g.state AND f.name < g.name AND length(g.name) BETWEEN ceil(length(f.name) * 9 / 11) AND floor(length(f.name) * 11 / 9) UNION ALL SELECT named.fire, link.fire, 100.0 FROM link JOIN named USING (state, name) WHERE link.fire <> named.fire", "fires", link=_LINK, named="SELECT state, name, min(fire) AS fire FROM link GROUP BY ALL"),
    "matched_slugs": cte(_LINKS, "fires", **links(
        "SELECT DISTINCT lower(state) || '-' || " + _SLUG.format("CASE WHEN fire % 4 = 1 THEN name || 's' ELSE name END") + " || CASE WHEN fire % 2 = 0 THEN '-' || CAST(fire AS VARCHAR) ELSE '' END AS slug FROM link",
        "SELECT lower(state) || '-' || form || '-' || CAST(fire AS VARCHAR) AS slug, cornea_id FROM link WHERE fire % 10 = 0")),
    "matched_incidents": cte("SELECT dir, fire, 'override' AS method, 1.0::DOUBLE AS score FROM by_pin UNION ALL SELECT dir, fire, 'unit_id', 1.0 FROM by_id UNION ALL SELECT dir, fire, 'name_exact', 0.95 FROM hits WHERE fire = other UNION ALL SELECT dir, fire, 'name_fuzzy', round_even(score / 100, 3)::DOUBLE FROM best WHERE ties = 1 AND k = 1", "fires",
        link=_LINK, dirs="SELECT fire + 1000 AS dir, CASE fire % 3 WHEN 0 THEN name || ' fire' WHEN 1 THEN name || 's' ELSE name END AS name, state, CASE WHEN fire % 7 = 0 THEN unique_fire_id END AS token FROM link",
        pins="SELECT fire + 1000 AS dir, CASE WHEN fire % 2 = 0 THEN 'ignore' ELSE unique_fire_id END AS pin FROM link WHERE fire % 25 = 4",
        by_pin="SELECT dir, fire FROM pins JOIN link ON pin = unique_fire_id", by_id="SELECT dir, fire FROM dirs JOIN link ON upper(token) = upper(unique_fire_id) WHERE dir NOT IN (SELECT dir FROM pins)",
        open="SELECT * FROM dirs WHERE dir NOT IN (SELECT dir FROM pins) AND dir NOT IN (SELECT dir FROM by_id)",
        lforms=_FORMS.format(key="dir", source="open"), rforms=_FORMS.format(key="fire", source="link"),
        hits="SELECT dir, min(fire) AS fire, max(fire) AS other FROM lforms JOIN rforms USING (state, v) GROUP BY dir",
        scored=f"SELECT dir, fire, max({ratio('l.v', 'r.v')}) AS score FROM lforms l JOIN rforms r USING (state) WHERE dir NOT IN (SELECT dir FROM hits) GROUP BY ALL",
        best="SELECT *, count(*) OVER (PARTITION BY dir, score) AS ties, rank() OVER (PARTITION BY dir ORDER BY score DESC) AS k FROM scored WHERE score >= 90"),
    "pinned_incidents": cte("SELECT dir, CASE WHEN fire % 3 = 1 THEN fire END AS fire, 'override' AS method, 1.0::DOUBLE AS score, CASE WHEN fire % 3 = 1 THEN unique_fire_id ELSE 'gone-' || CAST(fire AS VARCHAR) END AS pin FROM pins WHERE fire % 3 < 2 UNION ALL SELECT dir, fire, 'name_exact', 0.95, NULL FROM hits WHERE fire = other UNION ALL SELECT dir, fire, 'name_fuzzy', round_even(score / 100, 3)::DOUBLE, NULL FROM best WHERE ties = 1 AND k = 1", "fires",
        link=_LINK, dirs="SELECT fire + 1000 AS dir, * FROM link", pins="SELECT * FROM dirs WHERE fire % 5 < 3", open="SELECT * FROM dirs WHERE fire % 5 >= 3",
        lforms=_FORMS.format(key="dir", source="open"), rforms=_FORMS.format(key="fire", source="link"),
        hits="SELECT dir, min(fire) AS fire, max(fire) AS other FROM (SELECT l.dir, r.fire FROM lforms l JOIN rforms r USING (v)) GROUP BY dir",
        scored=f"SELECT dir, r.fire, max({ratio('l.v', 'r.v')}) AS score FROM lforms l JOIN rforms r ON length(r.v) BETWEEN length(l.v) * 9 / 11 AND length(l.v) * 11 / 9 WHERE dir NOT IN (SELECT dir FROM hits) GROUP BY ALL",
        best="SELECT *, count(*) OVER (PARTITION BY dir, score) AS ties, rank() OVER (PARTITION BY dir ORDER BY score DESC) AS k FROM scored WHERE score >= 90"),
    "state_search": cte("""SELECT ordinal, 'carolina' AS query FROM t WHERE name LIKE '%carolina%' OR st = 'NC' UNION ALL SELECT ordinal, 'ma' FROM t WHERE name LIKE '%ma%' OR st = 'MA' UNION ALL SELECT ordinal, 'mas' FROM t WHERE name LIKE '%mas%' OR st = 'MA'
 UNION ALL SELECT ordinal, ' West V' FROM t WHERE name LIKE '%west v%' OR st = 'WV'""", "fires", t="SELECT ordinal, lower(post_title) AS name, substr('TXGANCFLOHMAMNMIDCPRWVKS', CAST(ordinal % 12 * 2 + 1 AS BIGINT), 2) AS st FROM fires"),
    "zoned_days": cte(f"SELECT fire, CAST(timezone({_DAYS}, timezone('UTC', acq_ts)) AS DATE) AS local_day, count(*) AS n FROM (SELECT ordinal % 14 AS fire, acq_ts FROM detections) GROUP BY ALL", "detections"),
    "forecast_links": cte(_LINKS, "fires", **links(
        "SELECT DISTINCT lower(state) || '-' || " + _SLUG.format("CASE fire % 6 WHEN 1 THEN name || 's' WHEN 4 THEN left(name, length(name) - 5) ELSE name END") + " || CASE fire % 6 WHEN 0 THEN '-' || lpad(CAST(fire AS VARCHAR), 6, '0') WHEN 2 THEN '-77' || lpad(CAST(fire AS VARCHAR), 4, '0') WHEN 3 THEN '-12' ELSE '' END AS slug FROM link",
        "SELECT lower(state) || '-' || form AS slug, cornea_id FROM link WHERE fire % 10 = 5")),
    "gathered_tokens": cte("SELECT dir, token, count(*) AS n, CAST(row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, min(parent_no * 100000000000 + k * 10000000000 + ordinal)) AS INT) AS rank FROM v JOIN c USING (dir, parent_no, k) WHERE token IS NOT NULL GROUP BY dir, token", "files",
        t="SELECT incident_key % 7 AS dir, ordinal % 3 AS parent_no, ordinal % 28 AS day, ordinal, CASE WHEN ordinal % 5 < 3 AND ordinal % 11 <> 5 THEN '2026-COGMF-' || lpad(CAST(ordinal % 7 AS VARCHAR), 6, '0') END AS token FROM files",
        v="SELECT * FROM (SELECT *, CASE WHEN parent_no = 2 THEN 1 ELSE dense_rank() OVER (PARTITION BY dir, parent_no ORDER BY day DESC) END AS k FROM t) WHERE k <= 2",
        g="SELECT dir, parent_no, k, count(token) AS got FROM v GROUP BY ALL", c="SELECT dir, parent_no, k FROM g a WHERE k = 1 OR NOT EXISTS (SELECT 1 FROM g b WHERE b.dir = a.dir AND b.parent_no * 2 + b.k < a.parent_no * 2 + a.k AND b.got > 0)"),
    "accepted_sheets": cte("""SELECT sheet, lon_n, lat_n, round(lon_a, 4) AS lon_a, round(lat_a, 4) AS lat_a, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1, round(lon_a * x0 + lon_b, 3) AS w, round(lat_a * y1 + lat_b, 3) AS s, round(lon_a * x1 + lon_b, 3) AS e, round(lat_a * y0 + lat_b, 3) AS n
 FROM framed WHERE lon_a * (x1 - x0) BETWEEN 0.02 AND 6 AND lat_a * (y0 - y1) BETWEEN 0.02 AND 6 AND lon_a * (x0 + x1) / 2 + lon_b BETWEEN -170 AND -60 AND lat_a * (y0 + y1) / 2 + lat_b BETWEEN 15 AND 72""", "label_points",
        k0="SELECT sheet_key AS sheet, axis, pos, CASE sheet_key % 5 WHEN 0 THEN v * 200 WHEN 1 THEN v + 60 WHEN 2 THEN v + (ordinal % 7) / 50 ELSE v END AS val FROM (SELECT *, CASE WHEN axis = 'lon' THEN -val - 77 ELSE val END AS v FROM label_points)", **_CUT,
        gaps="SELECT sheet, axis, median(gap) AS spacing FROM (SELECT sheet, axis, p - lag(p) OVER (PARTITION BY sheet, axis ORDER BY p) AS gap FROM (SELECT DISTINCT sheet, axis, round(pos, 1) AS p FROM k3)) WHERE gap > 1 GROUP BY ALL",
        fits="SELECT sheet, axis, any_value(a) AS a, any_value(b) AS b, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM k3 GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT val) >= 2 AND sqrt(avg(power(val - a * pos - b, 2))) <= 0.005",
        spaced="SELECT fits.*, coalesce(spacing, 0) AS spacing FROM fits LEFT JOIN gaps USING (sheet, axis)",
        framed="SELECT x.sheet, x.n AS lon_n, y.n AS lat_n, x.a AS lon_a, x.b AS lon_b, y.a AS lat_a, y.b AS lat_b, greatest(0, x.lo - greatest(0.51, x.spacing / 2)) AS x0, least(51, x.hi + greatest(0.51, x.spacing / 2)) AS x1, greatest(0, y.lo - greatest(0.8, y.spacing / 2)) AS y0, least(80, y.hi + greatest(0.8, y.spacing / 2)) AS y1 FROM spaced x JOIN spaced y USING (sheet) WHERE x.axis = 'lon' AND y.axis = 'lat' AND y.a < 0 AND x.a > 0"),
    "run_products": cte("""SELECT run_key, coalesce(string_agg(DISTINCT CAST(pct AS VARCHAR), ',' ORDER BY CAST(pct AS VARCHAR)) FILTER (ok AND p IS NULL), '') AS toa, string_agg(DISTINCT CAST(pct AS VARCHAR), ',' ORDER BY CAST(pct AS VARCHAR)) FILTER (ok AND p = 'flame-length') AS flame_length,
 string_agg(DISTINCT CAST(pct AS VARCHAR), ',' ORDER BY CAST(pct AS VARCHAR)) FILTER (ok AND p = 'spread-rate') AS spread_rate, coalesce(nullif(max(n) FILTER (ok AND p IN ('flame-length', 'spread-rate')), 0), 336)::BIGINT AS horizon_hours
 FROM (SELECT *, CASE WHEN product <> 'isochrones' THEN CASE WHEN n % 4 = 0 THEN 'wind-vectors' ELSE product END END AS p FROM run_availability) GROUP BY run_key""", "run_availability"),
    "arrival_areas": cte("""SELECT run_key, pct, round(0.09::DOUBLE * count(*) FILTER (toa_hours > 0 AND toa_hours <= 200), 4) AS burned_ha, round(0.09::DOUBLE * count(*) FILTER (toa_hours > 150 AND toa_hours <= 200), 4) AS leading_ha, round(0.09::DOUBLE * count(*) FILTER (toa_hours > 200), 4) AS later_ha, round(0.09::DOUBLE * count(*) FILTER (toa_hours IS NULL OR toa_hours <= 0), 4) AS nodata_ha
 FROM toa_pixels GROUP BY ALL""", "toa_pixels"),
    "advertised_hours": cte("""SELECT cycle, count(*) AS listed, count(*) FILTER (there) AS rendered, count(*) FILTER (there) = count(*) AS complete, count(*) >= CASE WHEN hour(cycle) % 6 = 0 THEN 49 ELSE 19 END AS full, count(*) FILTER (there) = count(*) AND count(*) >= CASE WHEN hour(cycle) % 6 = 0 THEN 49 ELSE 19 END AS done,
 coalesce(string_agg(CAST(fhour AS VARCHAR), ',' ORDER BY fhour) FILTER (there), '') AS hours FROM (SELECT cycle, fhour, max(CASE WHEN hour(cycle) = 5 OR run_key % 5 <> 0 THEN 1 ELSE 0 END) = 1 AS there FROM listed GROUP BY ALL) GROUP BY cycle""", "run_availability",
        o="SELECT date_trunc('day', run_time) + INTERVAL (run_key % 4 * 5) HOURS AS cycle, n - 1 AS fhour, run_key FROM run_availability WHERE run_key % 3 <> 1",
        listed="SELECT * FROM o WHERE fhour <= 18 UNION ALL SELECT cycle, unnest(range(0, 19)), 0 FROM (SELECT DISTINCT cycle FROM o WHERE hour(cycle) = 5)"),
    # a diamond meets a box just if the box's nearest point lies within its radius, streets measured
    "historic_shapes": cte(f"SELECT guid, year FROM (SELECT cornea_id AS guid, 2000 + ordinal % 27 AS year, -124.0 + ordinal % 50 AS x, 32.0 + ordinal % 15 AS y, 0.5 + ordinal % 9 AS r FROM fires) WHERE year >= 2016 AND {_BOX_GAP} <= r AND lower(trim(guid, '{{}}')) <> 'f00000021' ORDER BY year DESC, guid LIMIT 2000", "fires"),
    "histories": cte("""SELECT f.fire, m.guid, m.year FROM (SELECT ordinal AS fire, cornea_id AS own, -124.0 + ordinal * 7 % 50 AS px, 32.0 + ordinal * 3 % 15 AS py FROM fires) f JOIN (SELECT cornea_id AS guid, 2000 + ordinal % 27 AS year, -124.0 + ordinal % 50 AS x, 32.0 + ordinal % 15 AS y, 0.5 + ordinal % 9 AS r FROM fires) m
 ON m.guid <> f.own AND m.year >= 2016 AND greatest(abs(x - px) - 0.75, 0) + greatest(abs(y - py) - 0.75, 0) <= r QUALIFY row_number() OVER (PARTITION BY f.fire ORDER BY m.year DESC, m.guid) <= 3""", "fires"),
    "resumed_pages": recursive("SELECT fire, cursor, stalled, stalled_day, len(ids)::BIGINT AS taken, list_max(ids) AS last_taken FROM ended", "detections", **_CURSORS, **paging(20, 3)),
    "synced_days": recursive("SELECT fire, acq_date, count(*) AS n, acq_date < any_value(cursor) AND acq_date < '2024-01-19' AND acq_date <> coalesce(any_value(stalled_day), '') AS final FROM (SELECT *, unnest(days) AS acq_date FROM ended) GROUP BY fire, acq_date", "detections", **_CURSORS, **paging(20, 3)),
    "sql_functions": cte("SELECT ordinal, " + _SLUG.format("post_title") + r""" AS slug, lower(trim(cornea_id, '{}')) AS guid, """ + _NORM.format("post_title") + r""" AS name, lower(firetype) = 'wildfire' AS wildfire, firetype ILIKE 'prescribed%' AS prescribed,
 CASE WHEN poly_last_updated IS NULL THEN 'none' WHEN epoch_ms(TIMESTAMP '1996-01-01') - epoch_ms(poly_last_updated) < 43200000 THEN 'fresh' WHEN epoch_ms(TIMESTAMP '1996-01-01') - epoch_ms(poly_last_updated) < 172800000 THEN 'recent' ELSE 'stale' END AS freshness,
 CASE WHEN ordinal < 30 THEN 'low' WHEN ordinal >= 80 THEN 'high' ELSE 'nominal' END AS conf, lower(unique_fire_id) AS readable, ordinal % 20 BETWEEN 1 AND 12 AS valid, round((ordinal + 180) % 360, 3)::DOUBLE AS bearing, round(sqrt(power(ordinal % 7, 2) + 16) * 2.23694, 4) AS mph FROM fires""", "fires"),
    "sql_days": cte("""SELECT ordinal, CAST(CAST(d AS DATE) AS VARCHAR) AS local_day, timezone('UTC', timezone('America/Denver', d)) AS start_utc, timezone('UTC', timezone('America/Denver', d + INTERVAL 1 DAY)) AS end_utc
 FROM (SELECT ordinal, unnest(generate_series(date_trunc('day', l(b)), date_trunc('day', l(b + INTERVAL 30 HOURS)), INTERVAL 1 DAY)) AS d FROM (SELECT ordinal, TIMESTAMP '2024-03-08' + INTERVAL (ordinal % 96) HOURS AS b FROM fires))""".replace("l(b)", "timezone('America/Denver', timezone('UTC', b))").replace("l(b + INTERVAL 30 HOURS)", "timezone('America/Denver', timezone('UTC', b + INTERVAL 30 HOURS))"), "fires"),
    "labelled_products": cte("""SELECT ordinal, CASE WHEN p IN ('ops_arche_ortho') THEN p WHEN p = 'ops' OR starts_with(p, 'ops_') THEN 'ops' WHEN p = 'iap_arche' OR starts_with(p, 'iap_arche_') THEN 'iap_arche' WHEN p = 'briefpio' OR starts_with(p, 'briefpio_') THEN 'briefpio' ELSE 'other' END AS base,
 CASE p WHEN 'ops' THEN 'Operations' WHEN 'ops_arche' THEN 'Operations (arche)' WHEN 'ops_arche_ortho' THEN 'Photo' WHEN 'iap_arche' THEN 'Action plan, large' WHEN 'iap_arche_ortho' THEN 'Action plan, large (ortho)' WHEN 'briefpio' THEN 'Briefing' WHEN 'briefpio_arche' THEN 'Briefing (arche)' WHEN 'briefpio_arche_ortho' THEN 'Briefing (arche ortho)' ELSE 'Other' END AS label,
 CASE WHEN p = 'ops_arche_ortho' THEN 4 WHEN starts_with(p, 'ops') THEN 1 WHEN starts_with(p, 'iap_arche') THEN 2 WHEN starts_with(p, 'briefpio') THEN 3 END AS rank
 FROM (SELECT ordinal, lower(trim(product_raw) || CASE WHEN ordinal % 3 = 0 THEN '_arche' ELSE '' END || CASE WHEN ordinal % 6 = 3 THEN '_ortho' ELSE '' END) AS p FROM files)""", "files"),
    "zones_known": cte("SELECT ordinal, CASE WHEN timezone = 'Not/AZone' THEN 'UTC' ELSE timezone END AS zone FROM fires", "fires"),
}
