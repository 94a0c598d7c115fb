"""Domain views over the given tables, in SQL that Spark and DuckDB both run. Table names stand in braces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages embeddings".split()

VIEWS: dict[str, str] = {
    "detections": """SELECT event_id AS ordinal, ts AS acq_ts, CAST(CAST(ts AS DATE) AS STRING) AS acq_date,
       CAST(hour(ts)*100 + minute(ts) AS STRING) || '.0' AS acq_time,
       CASE event_type WHEN 'click' THEN 'SNPP' WHEN 'purchase' THEN 'NOAA-20' WHEN 'signup' THEN 'NOAA-21' ELSE 'MODIS' END AS source,
       CASE WHEN event_type IN ('view','error') THEN regexp_extract(props, '([0-9]+)', 1)
            WHEN event_id % 4 = 0 THEN 'l' WHEN event_id % 4 = 1 THEN 'n' WHEN event_id % 4 = 2 THEN 'h' ELSE '' END AS confidence,
       value AS frp,
       CAST(-124 AS DOUBLE) + (user_id % 50) + (event_id % 97) / CAST(200 AS DOUBLE) AS lon,
       CAST(32 AS DOUBLE) + (user_id % 15) + (event_id % 89) / CAST(200 AS DOUBLE) AS lat
FROM {events}""",
    "fires": """SELECT s_suppkey AS ordinal, '{{F' || lpad(CAST(s_suppkey AS STRING), 8, '0') || '}}' AS cornea_id,
       p_name AS post_title, substr('ORWACAIDMTCOWYSDUTNVAZNM', 1 + 2 * (s_nationkey % 12), 2) AS state,
       CASE WHEN s_suppkey % 13 = 7 THEN 'unknown'
            ELSE CAST(32 + s_suppkey % 15 AS STRING) || '.25, -' || CAST(124 - s_suppkey % 50 AS STRING) || '.5' END AS fire_coordinates,
       abs(s_acctbal) * 100 AS acres,
       CASE WHEN s_suppkey % 11 = 5 THEN NULL ELSE s_suppkey % 101 END AS containment,
       CASE s_suppkey % 10 WHEN 8 THEN 'Prescribed Fire' WHEN 9 THEN 'Prescribed' ELSE 'Wildfire' END AS firetype,
       o_orderdate AS created_on,
       CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE o_orderdate END AS poly_last_updated,
       CASE s_suppkey % 4 WHEN 0 THEN 'America/Los_Angeles' WHEN 1 THEN 'America/Denver' WHEN 2 THEN 'America/Boise' ELSE 'Not/AZone' END AS timezone,
       '2026-' || substr('ORWACAIDMTCOWYSDUTNVAZNM', 1 + 2 * (s_nationkey % 12), 2) || 'XYZ-' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS unique_fire_id
FROM {supplier} JOIN {part} ON p_partkey = s_suppkey JOIN {orders} ON o_orderkey = s_suppkey""",
    "perimeter_index": """SELECT o_custkey % 50 AS fire_key, '/perimeters/' || CAST(o_orderkey AS STRING) AS path, o_orderdate AS version_ts, o_orderkey AS ordinal FROM {orders}""",
    "time_probes": """SELECT l_orderkey AS probe_id, l_linenumber AS probe_line, l_suppkey % 50 AS fire_key, l_shipdate AS t FROM {lineitem}""",
    "toa_pixels": """SELECT l_suppkey AS run_key, 10 + 20 * (l_linenumber % 5) AS pct, l_orderkey % 64 AS row, l_partkey % 64 AS col,
       max(CASE WHEN l_returnflag = 'N' THEN CAST(0 AS DOUBLE) ELSE l_quantity * 7 END) AS toa_hours
FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "run_availability": """SELECT o_orderkey AS run_key, o_custkey % 50 AS slug_key, o_orderdate AS run_time, o_orderstatus <> 'P' AS complete,
       o_orderpriority = '5-LOW' AS expired, 10 + 20 * (l_linenumber % 5) AS pct,
       CASE l_returnflag WHEN 'A' THEN 'spread-rate' WHEN 'R' THEN 'flame-length' ELSE 'isochrones' END AS product,
       l_linestatus = 'F' AS ok, CAST(l_quantity AS INT) AS n
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey""",
    "files": """SELECT doc_id AS ordinal, doc_id % 20 AS incident_key,
       substr('ops  iap  briefpio  evac ', 1 + 5 * CAST(doc_id % 5 AS INT), 5) AS product_raw, text AS content, n_chars AS size_bytes, source AS rel_dir
FROM {documents}""",
    "weather_index_lines": """SELECT p_size AS file_key, p_partkey AS pos,
       CAST(p_partkey AS STRING) || ':' || CAST(p_partkey * 1000 + p_size AS STRING) || ':d=2026081712:' || p_type || ':' || p_name || ':' || CAST(p_size AS STRING) || ' hour fcst:' AS line
FROM {part}""",
    "sitrep_lines": """SELECT s_suppkey % 16 AS report, s_suppkey AS line_no, p_name || '   ' || substr('ORWACAIDMTCOWYSDUTNVAZNM', 1 + 2 * (s_nationkey % 12), 2) || '-XYZ  ' || CAST(1000 + s_suppkey AS STRING)
       || '  ---  ' || CAST(s_suppkey % 101 AS STRING) || '  Ctn  8/' || CAST(1 + s_suppkey % 28 AS STRING) || '  1,' || lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0')
       || '  -16  17  54  4  0  56.2M  BLM' AS line
FROM {supplier} JOIN {part} ON p_partkey = s_suppkey""",
    "label_points": """SELECT l_suppkey AS sheet_key, CASE WHEN l_linestatus = 'F' THEN 'lat' ELSE 'lon' END AS axis, l_orderkey AS ordinal, l_linenumber AS sub,
       l_quantity AS pos, CAST(43 AS DOUBLE) - l_quantity / 1000 + CASE WHEN l_partkey % 17 = 0 THEN 2 ELSE 0 END AS val
FROM {lineitem}""",
    "point_weather": """SELECT user_id % 10 AS fire_key, date_trunc('hour', ts) AS t, max(value) AS temp_f,
       max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS code, min(value) / 10 AS wind_mph, max(event_id % 360) AS wind_from_deg
FROM {events} GROUP BY 1, 2""",
    "user_actions": """SELECT user_id AS actor, event_id AS ordinal, event_type AS event, props AS properties, ts FROM {events}""",
}

#: Rows that a task sorts or groups at once.
PART_ROWS = 1 << 19

#: Views of two tables that both grow, and the key by which they meet.
MEET = {"run_availability": {"orders": "o_orderkey", "lineitem": "l_orderkey"}}


def parts_of(*tables: DataFrame) -> int:
    """How many parts of PART_ROWS rows the largest of the tables makes (the footers tell); 1 where one is enough."""
    return max(-(-t.count() // PART_ROWS) for t in tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame over the parquet tables of sf_dir.

    Large tables that meet by key are dealt out by it in as many parts as their rows
    make, so what a task holds doesn't grow with them; what is grouped by that key
    afterwards stays in these parts.
    """
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    keys = MEET.get(name, {})
    if keys and (parts := parts_of(*(used[t] for t in keys))) > 1:
        parts = max(parts, spark.sparkContext.defaultParallelism)
        used |= {t: used[t].repartition(parts, key) for t, key in keys.items()}
    return spark.sql(sql, **used)


def cte(body: str, *views: str, **more: str) -> str:
    """DuckDB SQL: the named views (and further named queries) as common table expressions before the body."""
    parts = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in views] + [f"{k} AS ({q})" for k, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
