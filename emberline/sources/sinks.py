"""Archive, catalog and state writers, and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_detection_archive(detections: DataFrame, path: str) -> None:
    """One folder per fire, generation and day; only the days in the input are rewritten. Input: fire_slug, gen, acq_date and the row."""
    # a writer task per day folder, not a file per task and folder
    dealt = detections.repartition("fire_slug", "gen", "acq_date")
    dealt.write.partitionBy("fire_slug", "gen", "acq_date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_archive_index(detections: DataFrame, path: str) -> None:
    """Per fire the newest generation with its days and envelope, as JSON."""
    rows = detections.groupBy("fire_slug", "gen").agg(F.sort_array(F.collect_set("acq_date")).alias("days"), F.array(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).alias("bbox"))
    newest = rows.groupBy("fire_slug").agg(F.max_by(F.struct("gen", "days", "bbox"), "gen").alias("i")).select("fire_slug", "i.*")
    newest.write.mode("overwrite").json(path)


def read_archive(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """The archived rows of each fire's newest generation; day folders that have gone are skipped."""
    rows = spark.read.option("ignoreMissingFiles", "true").option("basePath", path).parquet(path)
    return rows.join(index.select("fire_slug", "gen"), ["fire_slug", "gen"], "left_semi")


INDEX = "fire_slug string, gen int, days array<string>, w double, s double, e double, n double, rows long"


def append_to_archive(batch: DataFrame, path: str, name: str, batch_id: int) -> bool:
    """Add a batch to the archive exactly once; whether it was added now. Input: fire_slug, gen, acq_date, lon, lat and the row.

    The batch's rows lie in folders of its own below each fire, generation and day.
    Its manifest, one file that is also the batch's part of the index, is written
    after them: without it readers don't see the batch. A batch that runs again
    finds its manifest and does nothing, or else writes its own folders anew.
    """
    spark, key = batch.sparkSession, f"{name}-{batch_id:012d}"
    manifest = f"{path}/manifests/batch={key}"
    if _written(spark, manifest):
        return False
    rows = batch.withColumn("batch", F.lit(key)).repartition("fire_slug", "gen", "acq_date")
    rows.write.partitionBy("fire_slug", "gen", "acq_date", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/rows")
    box = [F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n")]
    index = batch.groupBy("fire_slug", "gen").agg(F.sort_array(F.collect_set("acq_date")).alias("days"), *box, F.count(F.lit(1)).alias("rows"))
    index.coalesce(1).write.mode("overwrite").json(manifest)
    return True


def _written(spark: SparkSession, manifest: str) -> bool:
    """Whether a manifest has been committed; its one file appears whole or not at all."""
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.schema(INDEX).json(manifest).isEmpty()
    except AnalysisException:  # no such folder yet
        return False


def streamed_index(spark: SparkSession, path: str) -> DataFrame:
    """Per fire the newest generation with its days, envelope and number of rows, over the manifests of all batches."""
    parts = spark.read.schema(INDEX).json(f"{path}/manifests")
    whole = parts.groupBy("fire_slug", "gen").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days"), F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"), F.sum("rows").alias("rows"))
    return whole.groupBy("fire_slug").agg(F.max_by(F.struct("gen", "days", "w", "s", "e", "n", "rows"), "gen").alias("i")).select("fire_slug", "i.*")


def read_streamed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The archived rows (columns of schema beside the folders) of batches that have a manifest."""
    folders = "fire_slug string, gen int, acq_date string, batch string"
    rows = spark.read.schema(f"{schema}, {folders}").option("ignoreMissingFiles", "true").parquet(f"{path}/rows")
    done = spark.read.schema(f"{INDEX}, batch string").json(f"{path}/manifests").select("batch").distinct()
    return rows.join(done, "batch", "left_semi")


def write_version(rows: DataFrame, path: str, version: int) -> None:
    """Data first, the pointer after it; a version that exists is written again whole."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")
    rows.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").json(f"{path}-pointer")


def publish_catalog(assets: list[tuple[DataFrame, str]], catalog: DataFrame, path: str) -> int:
    """Assets, then the next version of the catalog, then the pointer."""
    for rows, place in assets:
        rows.write.mode("overwrite").parquet(place)
    version = (newest_version(catalog.sparkSession, path) or 0) + 1
    write_version(catalog, path, version)
    return version


def newest_version(spark: SparkSession, path: str) -> int | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("version int").json(f"{path}-pointer").agg(F.max("version")).first()[0]
    except AnalysisException:  # nothing published yet
        return None


def read_published(spark: SparkSession, path: str) -> DataFrame | None:
    version = newest_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/version={version}")


def save_state(sections: dict[str, DataFrame], path: str) -> None:
    """One table per section, overwritten by each run."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


#: The scalar expressions as SQL, by signature.
SQL_FUNCTIONS = {
    "slugify(x STRING) RETURNS STRING": "nullif(regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-'), '^-+|-+$', ''), '')",
    "norm_guid(x STRING) RETURNS STRING": "lower(regexp_replace(trim(x), '[{}]', ''))",
    "normalize_name(x STRING) RETURNS STRING": (
        r"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(try_url_decode(replace(x, '+', '%2B')), x), r'^\d{4}_', ''), "
        r"'(?<=[a-z])(?=[A-Z])', ' '), '(?<=[A-Z])(?=[A-Z][a-z])', ' '), '[_-]+', ' ')), '[^a-z0-9 ]+', ''), r'\s+', ' '))"
    ),
    "is_wildfire(x STRING) RETURNS BOOLEAN": "lower(x) = 'wildfire'",
    "is_prescribed(x STRING) RETURNS BOOLEAN": "coalesce(rlike(trim(x), '(?i)^prescribed'), false)",
    "readable_id(x STRING) RETURNS STRING": r"lower(regexp_replace(x, r'^(\d{4}-\d{2}-\d{2})-([A-Za-z]{2})-(.+)$', '$3-$2-$1'))",
    "valid_day(x STRING) RETURNS BOOLEAN": r"coalesce(rlike(x, r'^20\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$'), false)",
    "acq_instant(day STRING, hhmm STRING) RETURNS TIMESTAMP": "try_to_timestamp(concat(day, ' ', lpad(CAST(CAST(try_cast(hhmm AS DOUBLE) AS INT) AS STRING), 4, '0')), 'yyyy-MM-dd HHmm')",
    "conf_norm(x STRING) RETURNS STRING": (
        "CASE WHEN lower(trim(coalesce(x, ''))) IN ('l', 'low') THEN 'low' WHEN lower(trim(coalesce(x, ''))) IN ('n', 'nominal') THEN 'nominal' WHEN lower(trim(coalesce(x, ''))) IN ('h', 'high') THEN 'high' "
        "WHEN try_cast(trim(x) AS DOUBLE) < 30 THEN 'low' WHEN try_cast(trim(x) AS DOUBLE) >= 80 THEN 'high' ELSE 'nominal' END"
    ),
    "hours_between(ts TIMESTAMP_NTZ, now TIMESTAMP_NTZ) RETURNS DOUBLE": "(unix_millis(CAST(now AS TIMESTAMP)) - unix_millis(CAST(ts AS TIMESTAMP))) / 3600000",
    "freshness(ts TIMESTAMP_NTZ, now TIMESTAMP_NTZ) RETURNS STRING": "CASE WHEN ts IS NULL THEN 'none' WHEN hours_between(ts, now) < 12 THEN 'fresh' WHEN hours_between(ts, now) < 48 THEN 'recent' ELSE 'stale' END",
    "local_day(ts TIMESTAMP_NTZ, zone STRING) RETURNS DATE": "to_date(convert_timezone('UTC', zone, ts))",
    "flip_bearing(d DOUBLE) RETURNS DOUBLE": "pmod(d + 180, 360)",
    "wind_speed_mph(u DOUBLE, v DOUBLE) RETURNS DOUBLE": "hypot(u, v) * 2.23694",
}


def register_functions(spark: SparkSession) -> None:
    """Expressions for SQL users, as SQL functions that the optimiser inlines."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
