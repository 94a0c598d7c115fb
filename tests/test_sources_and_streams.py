"""Readers, sinks and streams on small files."""

from __future__ import annotations

import hashlib
import json
import shutil

from pyspark.sql import functions as F

from emberline.operators import incidents
from emberline.sources import landing, readers, sinks
from emberline.streaming import detection_streams as st


def _put(path, doc):
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(path)


def test_json_readers(spark, tmp_path):
    fires = {"fires": [{"cornea_id": "c-1", "post_title": "Moose", "fire_coordinates": "45, -114", "state": "ID", "acres": 6000, "firetype": "Wildfire", "active": True}, {"cornea_id": "c-2", "firetype": "Prescribed", "active": True}, {"cornea_id": "c-3", "firetype": "Wildfire", "active": False}]}
    assert [(r.cornea_id, r.lon, r.lat) for r in readers.read_fires(spark, _put(tmp_path / "f.json", fires)).collect()] == [("c-1", -114.0, 45.0)]
    points = {"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": [-120, 48]}, "properties": {"source": "MODIS", "acq_date": "2026-08-18", "acq_time": "0400", "frp": 2.5, "confidence": "n", "brightness": 1}}]}
    r = readers.read_detections(spark, _put(tmp_path / "d.json", points)).first()
    assert (r.lon, r.lat, r.acq_time) == (-120.0, 48.0, "0400")
    r = readers.read_perimeter_index(spark, _put(tmp_path / "c-9.json", [{"path": "/p/1", "date": "2026-08-18T00:00:00Z"}])).first()
    assert (r.cornea_id, r.path) == ("c-9", "/p/1")
    manifest = {"runs": {"elk/1": {"slug": "elk", "run_ts": "20260817_100500", "complete": True, "expired": False, "files": {"10": {"ok": True, "bytes": 5}}, "vars": {"50": {"spread-rate": {"ok": True, "n": 169}}}}}}
    runs = readers.read_forecast_manifest(spark, _put(tmp_path / "m.json", manifest))
    assert {(r.pct, r["product"], r.ok, r.n) for r in readers.manifest_files(runs).collect()} == {(10, None, True, None), (50, "spread-rate", True, 169)}
    assert readers.read_fire_matches(spark, _put(tmp_path / "x.json", {"matches": {"elk": {"cornea_id": "c-1"}}})).first().slug == "elk"
    assert [(r.dir, r.pin) for r in readers.read_overrides(spark, _put(tmp_path / "o.json", {"_note": "x", "a/b": "ignore"})).collect()] == [("a/b", "ignore")]
    ir = {"name": "Heat Perimeter", "features": [{"geometry": None, "properties": {}}, {"geometry": {"type": "Polygon", "coordinates": [[[1, 2]]]}, "properties": {"a": "1"}}]}
    r = readers.read_ir_features(spark, _put(tmp_path / "f1.geojson", ir)).collect()
    assert [(x.flight_id, x.heat, x.type) for x in r] == [("f1", "Perimeter", "Polygon")]


def test_text_and_xml_readers(spark, tmp_path):
    idx = "1:0:d=2026081712:REFC:entire atmosphere:2 hour fcst:\nbroken\n2:77:d=2026081712:UGRD:10 m above ground:2 hour fcst:\n"
    assert [(r.msgnum, r.offset, r["var"]) for r in readers.read_weather_index(spark, _put(tmp_path / "h.idx", idx)).orderBy("msgnum").collect()] == [(1, 0, "REFC"), (2, 77, "UGRD")]
    xml = "<L><Layer><Name>snap_20260816_000000</Name></Layer><Layer><Name>snap_20260817_000000</Name></Layer><Layer><Name>other</Name></Layer></L>"
    assert readers.newest_snapshot_layer(spark, _put(tmp_path / "l.xml", xml)).first().name == "snap_20260817_000000"
    page = spark.createDataFrame([("http://x/", '<a href="?C=N">N</a><a href="IR/">IR/</a> 2026-08-17 06:56    - \n<a href="a%20b.pdf">a</a> 2026-08-16 22:06  9.8M')], "url string, html string")
    assert [(r.name, r.mtime, r.is_dir, r.size_hint) for r in readers.read_listing(page).collect()] == [("IR", "2026-08-17 06:56", True, None), ("a b.pdf", "2026-08-16 22:06", False, 10276044)]
    _put(tmp_path / "blob.bin", "abc")
    assert readers.hash_files(spark, str(tmp_path / "blob.bin")).first().sha16 == "ba7816bf8f01cfea"
    lines = readers.read_sitrep(spark, _put(tmp_path / "s.txt", "a\nb"))
    assert [r.line for r in lines.orderBy("line_no").collect()] == ["a", "b"]


def test_archive_and_catalog(spark, tmp_path):
    rows = spark.createDataFrame([("elk", 1, "2026-08-18", -120.0, 48.0), ("elk", 1, "2026-08-19", -119.0, 47.0)], "fire_slug string, gen int, acq_date string, lon double, lat double")
    path, index = str(tmp_path / "archive"), str(tmp_path / "index")
    sinks.write_detection_archive(rows, path)
    sinks.write_detection_archive(rows.filter("acq_date = '2026-08-19'").withColumn("lon", F.lit(-118.0)), path)
    sinks.write_archive_index(rows, index)
    i = spark.read.json(index)
    assert i.first().days == ["2026-08-18", "2026-08-19"]
    got = sinks.read_archive(spark, path, i.withColumn("gen", F.col("gen").cast("int")))
    assert sorted(r.lon for r in got.collect()) == [-120.0, -118.0]
    catalog = str(tmp_path / "catalog")
    assert sinks.read_published(spark, catalog) is None
    assert [sinks.publish_catalog([], rows.limit(k), catalog) for k in (1, 2)] == [1, 2]
    assert sinks.read_published(spark, catalog).count() == 2
    sinks.save_state({"files": rows}, str(tmp_path / "state"))
    assert sinks.load_state(spark, str(tmp_path / "state"), "files").count() == 2
    sinks.register_functions(spark)
    assert spark.sql("select slugify('Big Grass')").first()[0] == "big-grass"


def _stream(spark, rows, path, parts=2):
    rows.repartition(parts).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(query, name, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query.sparkSession.table(name) if hasattr(query, "sparkSession") else None


def test_dedupe_and_daily_windows(spark, tmp_path):
    rows = spark.range(40).select(F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.lit("d").alias("acq_date"), (F.col("id") % 20).cast("string").alias("acq_time"), F.lit("M").alias("source"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % 20) * 20_000).cast("timestamp_ntz").alias("acq_ts"))
    s = st.dedupe_stream(st.with_lateness(_stream(spark, rows, str(tmp_path / "a"), 1), "10 days"))
    assert _run(s, "deduped").count() == 20
    d = st.daily_windows(st.with_lateness(_stream(spark, rows.filter("acq_time < '2'"), str(tmp_path / "b"), 1)))
    out = _run(d, "daily")
    newest = rows.filter("acq_time < '2'").agg(F.max("acq_ts")).first()[0]
    # only days that ended a day before the newest event are final
    assert all((newest - r.day).total_seconds() >= 2 * 86400 for r in out.collect()) and out.count() > 0


def test_throttle_stream_equals_the_batch(spark, tmp_path):
    e = spark.range(60).select((F.col("id") % 3).alias("actor"), F.col("id").alias("ordinal"), F.timestamp_seconds(F.col("id") * 7 + 1_700_000_000).alias("ts"))
    want = {(r.actor, r.ordinal) for r in incidents.throttle(e.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 2, 8).collect()}
    with st.keyed_state(spark):
        got = _run(st.throttle_stream(_stream(spark, e, str(tmp_path / "e"), 1), 2, 8), "throttled")
    assert {(r.actor, r.ordinal) for r in got.collect()} == want


def test_a_quiet_minute_leaves_the_state_and_the_session_stays(spark, tmp_path):
    """Three actors fall silent; a fourth one's event an hour later moves the watermark past their minutes. The second run goes on from the checkpoint."""
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    at = lambda rows: spark.createDataFrame(rows, "actor long, ordinal long, s long").select("actor", "ordinal", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    at([(a, 10 * a + i, i) for a in range(3) for i in range(4)]).coalesce(1).write.parquet(source)
    stream = lambda: st.throttle_stream(spark.readStream.schema("actor long, ordinal long, ts timestamp").parquet(source), 2, 3, "1 minute")
    rows = lambda name: spark.read.format("statestore").option("path", state).option("stateVarName", name).load()
    out = str(tmp_path / "out")

    def run():
        stream().writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination(180)

    with st.keyed_state(spark):
        run()
        assert rows("minute").count() == 3
        at([(9, 90, 3600)]).coalesce(1).write.mode("append").parquet(source)
        run()
        assert {r.key.actor for r in rows("minute").collect()} == {9}
        assert {r.key.actor: r.value.total for r in rows("session").collect()} == {0: 2, 1: 2, 2: 2, 9: 1}
        at([(a, 10 * a + 100 + i, 7200) for a in range(3) for i in range(3)]).coalesce(1).write.mode("append").parquet(source)
        run()
    # a new minute, but the session has one event left
    assert sorted(r.ordinal for r in spark.read.parquet(out).collect()) == [0, 1, 10, 11, 20, 21, 90, 100, 110, 120]


def test_generations_go_on_and_a_lost_state_takes_the_index(spark, tmp_path):
    source = str(tmp_path / "g")
    box = lambda rows: spark.createDataFrame(rows, "fire long, w double, s double, e double, n double")
    published = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 3), (7, 0.0, 0.0, 9.0, 9.0, 5)], "fire long, w double, s double, e double, n double, gen int")
    box([(1, 0.0, 0.0, 2.0, 2.0), (2, 0.0, 0.0, 1.0, 1.0)]).coalesce(1).write.parquet(source)
    stream = lambda: st.generation_stream(spark.readStream.schema("fire long, w double, s double, e double, n double").parquet(source), published)
    rows = {}

    def run(state):
        def keep(batch, _):
            rows.update({r.fire: (r.w, r.e, r.gen) for r in batch.collect()})

        stream().writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination(180)

    with st.keyed_state(spark):
        run("kept")
        assert rows == {1: (0.0, 2.0, 4), 2: (0.0, 1.0, 1)}
        box([(1, -1.0, 0.0, 1.0, 1.0), (7, 1.0, 1.0, 2.0, 2.0)]).coalesce(1).write.mode("append").parquet(source)
        run("kept")  # goes on from its state, the index doesn't count again
        assert rows == {1: (-1.0, 2.0, 5), 2: (0.0, 1.0, 1), 7: (0.0, 9.0, 5)}
        rows.clear()
        run("lost")  # both files at once, from the index
        assert rows[7] == (0.0, 9.0, 5) and rows[1][:2] == (-1.0, 2.0) and rows[1][2] in (4, 5)


def test_a_batch_that_crashed_before_its_manifest_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "archive")
    schema = "fire_slug string, gen int, acq_date string, lon double, lat double, ordinal long"
    one = spark.createDataFrame([("elk", 1, "2026-08-18", -120.0, 48.0, 1), ("elk", 1, "2026-08-19", -119.0, 47.0, 2)], schema)
    two = spark.createDataFrame([("elk", 1, "2026-08-19", -121.0, 46.0, 3), ("elk", 2, "2026-08-20", -121.0, 46.0, 4), ("hay", 1, "2026-08-20", -100.0, 40.0, 5)], schema)
    read = lambda: sorted(r.ordinal for r in sinks.read_streamed(spark, path, "lon double, lat double, ordinal long").collect())
    assert sinks.append_to_archive(one, path, "d", 0) and not sinks.append_to_archive(one, path, "d", 0)
    index = sinks.streamed_index(spark, path).first()
    assert read() == [1, 2] and (index.days, index.w, index.n, index.rows) == (["2026-08-18", "2026-08-19"], -120.0, 48.0, 2)
    # the rows of the second batch are there, the crash came before its manifest
    assert sinks.append_to_archive(two, path, "d", 1)
    shutil.rmtree(f"{path}/manifests/batch=d-000000000001")
    assert read() == [1, 2] and sinks.streamed_index(spark, path).count() == 1
    assert sinks.append_to_archive(two, path, "d", 1) and read() == [1, 2, 3, 4, 5]
    assert {(r.fire_slug, r.gen, r.rows) for r in sinks.streamed_index(spark, path).collect()} == {("elk", 2, 1), ("hay", 1, 1)}
    # another stream has its own batches; an empty batch adds nothing
    assert sinks.append_to_archive(one, path, "other", 0) and read() == [1, 1, 2, 2, 3, 4, 5]
    assert sinks.append_to_archive(one.limit(0), path, "d", 2) and read() == [1, 1, 2, 2, 3, 4, 5]


def test_a_stream_that_is_run_again_archives_once(spark, tmp_path):
    rows = spark.range(90).select((F.col("id") % 3).cast("string").alias("fire_slug"), F.lit(1).alias("gen"), F.concat(F.lit("2026-08-0"), (1 + F.col("id") % 4).cast("string")).alias("acq_date"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.col("id").alias("ordinal"))
    stream, path = _stream(spark, rows, str(tmp_path / "in"), 3), str(tmp_path / "archive")
    for state in ("a", "a", "b"):  # the last one has lost its checkpoint
        st.archive_stream(stream, path, "d").option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination(180)
    assert sorted(r.ordinal for r in sinks.read_streamed(spark, path, "lon double, lat double, ordinal long").collect()) == list(range(90))


def test_files_beyond_a_row_are_hashed_in_pieces(spark, tmp_path):
    """A sparse file of 3 GB: its task holds a piece of it at a time."""
    folder = tmp_path / "blobs"
    folder.mkdir()
    (folder / "small.bin").write_bytes(b"abc")
    (folder / "empty.bin").write_bytes(b"")
    (folder / "with space.bin").write_bytes(b"x" * 5000)
    with open(folder / "large.bin", "wb") as f:
        f.truncate(3 << 30)
    sha, piece = hashlib.sha256(), bytes(1 << 20)
    for _ in range(3 << 10):
        sha.update(piece)
    got = {r.path.rsplit("/", 1)[-1]: (r.sha16, r.size) for r in readers.hash_files(spark, str(folder), 4000).collect()}
    short = lambda b: hashlib.sha256(b).hexdigest()[:16]
    assert got.pop("large.bin") == (sha.hexdigest()[:16], 3 << 30)
    assert sorted(got.values()) == sorted([(short(b"abc"), 3), (short(b"x" * 5000), 5000)])


def test_heartbeats_and_activity(spark, tmp_path):
    runs = spark.createDataFrame([("a", i, f"n{i}") for i in range(50)], "job string, finished_at int, note string")
    q = st.fold_heartbeats_stream(_stream(spark, runs, str(tmp_path / "h"), 2), str(tmp_path / "beats"), 40).trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = sinks.read_published(spark, str(tmp_path / "beats"))
    assert sorted(r.finished_at for r in kept.collect()) == list(range(10, 50))
    d = spark.createDataFrame([(1, 5), (1, 30), (1, 200)], "fire long, h int").select("fire", F.timestamp_seconds(F.col("h") * 3600).alias("acq_ts"))
    zones = spark.createDataFrame([(1, "America/Denver")], "fire long, zone string")
    s = st.activity_stream(st.with_lateness(_stream(spark, d, str(tmp_path / "z"), 1)), zones)
    assert {(str(r.local_day), r.n) for r in _run(s, "activity").collect()} >= {("1969-12-31", 1)}


def test_files_of_tasks_are_listed_by_tasks(spark):
    """Files that tasks wrote into folders of their own: all are hashed, none by a scan that the driver lists."""
    texts = spark.range(300).select(F.concat(F.lit("é "), F.col("id").cast("string")).alias("t")).repartition(3)
    folders = landing.land_files(texts, F.col("t"), "blobs")
    found = readers.hash_files(spark, folders)
    assert {(r.sha16, r.size) for r in found.collect()} == {(hashlib.sha256(b).hexdigest()[:16], len(b)) for b in (f"é {i}\n".encode() for i in range(300))}
    assert len(folders) == 3 and "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
