"""Expressions as SQL functions that give arrays, structs and tables, for users who write SQL only.

Scalar ones are inlined by the optimiser; table functions are used with LATERAL
and, as they read no table, become projections and generators of the row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

BOX = "STRUCT<w: DOUBLE, s: DOUBLE, e: DOUBLE, n: DOUBLE>"
_BOX = "named_struct('w', {}, 's', {}, 'e', {}, 'n', {})"
# Incident ids in file names, anchor of a map file's name, coordinate labels.
_TOKEN = "_([A-Z]{2}[A-Z0-9]{2,4}[0-9]{6})(?=[_.])"
_ANCHOR = r"_(\\d{8})_(\\d{4})_"
_COORD = "^(-?)(\\\\d{1,3})\\\\s*[°º]\\\\s*(?:(\\\\d{1,2}(?:\\\\.\\\\d+)?)\\\\s*[\\'′])?\\\\s*(?:(\\\\d{1,2}(?:\\\\.\\\\d+)?)\\\\s*[\\\"″])?\\\\s*([NSEW])?$"

#: By signature, in the order of their use of each other.
FUNCTIONS = {
    "unit_tokens(name STRING, year INT) RETURNS ARRAY<STRING>": f"transform(regexp_extract_all(name, '{_TOKEN}', 1), x -> concat(CAST(year AS STRING), '-', substr(x, 1, length(x) - 6), '-', right(x, 6)))",
    f"rect(lon DOUBLE, lat DOUBLE, dx DOUBLE, dy DOUBLE) RETURNS {BOX}": _BOX.format("lon - dx", "lat - dy", "lon + dx", "lat + dy"),
    f"box_union(a {BOX}, b {BOX}) RETURNS {BOX}": _BOX.format("least(a.w, b.w)", "least(a.s, b.s)", "greatest(a.e, b.e)", "greatest(a.n, b.n)"),
    f"box_pad(b {BOX}, part DOUBLE, edge DOUBLE) RETURNS {BOX}": _BOX.format("b.w - (b.e - b.w) * part", "greatest(b.s - (b.n - b.s) * part, -edge)", "b.e + (b.e - b.w) * part", "least(b.n + (b.n - b.s) * part, edge)"),
    f"box_snap(b {BOX}, grid DOUBLE) RETURNS {BOX}": _BOX.format("floor(b.w / grid) * grid", "floor(b.s / grid) * grid", "ceil(b.e / grid) * grid", "ceil(b.n / grid) * grid"),
    f"box_contains(outside {BOX}, inside {BOX}) RETURNS BOOLEAN": "outside.w <= inside.w AND outside.s <= inside.s AND outside.e >= inside.e AND outside.n >= inside.n",
    f"in_box(lon DOUBLE, lat DOUBLE, b {BOX}) RETURNS BOOLEAN": "lon BETWEEN b.w AND b.e AND lat BETWEEN b.s AND b.n",
    "coord_part(label STRING, k INT) RETURNS STRING": f"regexp_extract(trim(label), '{_COORD}', k)",
    "coord_number(label STRING, k INT) RETURNS DOUBLE": "coalesce(try_cast(coord_part(label, k) AS DOUBLE), 0)",
    "parse_coord(label STRING) RETURNS STRUCT<axis: STRING, deg: DOUBLE>": (
        "CASE WHEN coord_part(label, 2) <> '' AND coord_number(label, 2) <= 180 AND coord_number(label, 3) < 60 AND coord_number(label, 4) < 60 THEN named_struct("
        "'axis', CASE WHEN coord_part(label, 5) IN ('N', 'S') THEN 'lat' WHEN coord_part(label, 5) IN ('E', 'W') OR coord_number(label, 2) >= 60 THEN 'lon' ELSE 'lat' END, "
        "'deg', (coord_number(label, 2) + coord_number(label, 3) / 60 + coord_number(label, 4) / 3600) * CASE WHEN coord_part(label, 5) IN ('S', 'W') OR coord_part(label, 5) = '' AND (coord_part(label, 1) = '-' OR coord_number(label, 2) >= 60) THEN -1 ELSE 1 END) END"
    ),
    "local_days(zone STRING, begins TIMESTAMP_NTZ, ends TIMESTAMP_NTZ) RETURNS TABLE(local_day DATE, start_utc TIMESTAMP_NTZ, end_utc TIMESTAMP_NTZ)": (
        "SELECT d, convert_timezone(zone, 'UTC', CAST(d AS TIMESTAMP_NTZ)), convert_timezone(zone, 'UTC', CAST(date_add(d, 1) AS TIMESTAMP_NTZ)) "
        "FROM (SELECT explode(sequence(to_date(convert_timezone('UTC', zone, begins)), to_date(convert_timezone('UTC', zone, ends)))) AS d)"
    ),
    "parse_product_filename(name STRING) RETURNS TABLE(product STRING, product_base STRING, sheet STRING, orientation STRING, generated_at_local STRING, op_date STRING, period STRING, unit_incident STRING, fire_name STRING)": rf"""
SELECT CASE WHEN has AND size(head) > 0 THEN lower(array_join(head, '_')) ELSE 'other' END, CASE WHEN has AND size(head) > 0 THEN lower(head[0]) ELSE 'other' END,
 CASE WHEN has THEN sheet END, CASE WHEN has THEN orientation END,
 CASE WHEN has THEN concat(substr(day, 1, 4), '-', substr(day, 5, 2), '-', substr(day, 7), 'T', substr(time, 1, 2), ':', substr(time, 3)) END,
 CASE WHEN has AND dated THEN concat(substr(day, 1, 4), '-', substr(mmdd, 1, 2), '-', substr(mmdd, 3)) END, CASE WHEN has AND dated THEN period END,
 CASE WHEN has AND is_unit THEN unit END, CASE WHEN has AND size(words) > 0 THEN array_join(words, '_') END
FROM (SELECT *, CASE WHEN is_unit THEN slice(rest, 1, size(rest) - 1) ELSE rest END AS words,
  CASE WHEN arch THEN slice(front, 1, size(front) - 2) WHEN single THEN slice(front, 1, size(front) - 1) ELSE front END AS head, CASE WHEN arch THEN concat('arch_', ending) WHEN single THEN ending END AS sheet
 FROM (SELECT *, coalesce(rlike(unit, '^[A-Z]{{2}}[A-Z0-9]{{2,4}}[0-9]{{6}}$'), false) AS is_unit,
   coalesce(size(front) >= 2 AND lower(try_element_at(front, -2)) = 'arch' AND length(ending) = 1, false) AS arch, coalesce(rlike(ending, '^\\d{{1,3}}x\\d{{1,3}}$|^8\\.5x11$'), false) AS single
  FROM (SELECT *, try_element_at(rest, -1) AS unit, lower(try_element_at(front, -1)) AS ending
   FROM (SELECT *, CASE WHEN dated THEN slice(tail, 1, size(tail) - 1) ELSE tail END AS rest, CASE WHEN orientation IS NOT NULL THEN slice(start, 1, size(start) - 1) ELSE start END AS front,
     lpad(regexp_extract(last, '(?i)^(\\d{{3,4}})(day|night)?$', 1), 4, '0') AS mmdd, nullif(lower(regexp_extract(last, '(?i)^(\\d{{3,4}})(day|night)?$', 2)), '') AS period
    FROM (SELECT *, coalesce(rlike(last, '(?i)^(\\d{{3,4}})(day|night)?$'), false) AS dated, CASE WHEN lower(try_element_at(start, -1)) IN ('port', 'land') THEN lower(try_element_at(start, -1)) END AS orientation
     FROM (SELECT *, try_element_at(tail, -1) AS last
      FROM (SELECT rlike(stem, '{_ANCHOR}') AS has, regexp_extract(stem, '{_ANCHOR}', 1) AS day, regexp_extract(stem, '{_ANCHOR}', 2) AS time,
        filter(split(regexp_extract(stem, '^(.*?)_\\d{{8}}_\\d{{4}}_', 1), '_'), x -> x <> '') AS start, filter(split(regexp_extract(stem, '^.*?_\\d{{8}}_\\d{{4}}_(.*)$', 1), '_'), x -> x <> '') AS tail
       FROM (SELECT regexp_replace(name, '\\.[^.]*$', '') AS stem))))))))""",
}


def register_row_functions(spark: SparkSession) -> None:
    """The functions above, for this session."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
