"""Queries over incident files, linkage, reports and map labels, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm
from ..operators import incidents as ops
from ..operators import linkage as lk
from ..sources.readers import parse_listing_pages
from .adapters import cte, view


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _files(spark, sf_dir):
    """Product names in the published form, over the files view."""
    f = view(spark, sf_dir, "files")
    sheet = F.when(F.col("ordinal") % 4 == 0, "arch_e_port").when(F.col("ordinal") % 4 == 1, "11x17_land").when(F.col("ordinal") % 4 == 2, "85x11").otherwise("")
    day = F.lpad((F.col("ordinal") % 28 + 1).cast("string"), 2, "0")
    name = F.concat_ws("_", F.trim("product_raw"), F.nullif(sheet, F.lit("")), F.concat(F.lit("202608"), day), F.lit("2100"), F.lit("Elk_Creek"), F.concat(F.lit("COGMF"), F.lpad((F.col("ordinal") % 7).cast("string"), 6, "0")), F.concat(F.lit("8"), day, F.when(F.col("ordinal") % 3 == 0, "day").when(F.col("ordinal") % 3 == 1, "night").otherwise("")))
    return f.withColumns({"name": F.when(F.col("ordinal") % 11 == 5, "Read_Me.txt").otherwise(F.concat(name, F.lit(".pdf"))), "day": day})


def product_names(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.select("ordinal", F.inline(F.array(tx.parse_product_filename(F.col("name")))))


def product_vocabulary(spark, sf_dir):
    p = F.concat(F.trim("product_raw"), F.when(F.col("ordinal") % 3 == 0, "_arche").otherwise(""), F.when(F.col("ordinal") % 6 == 3, "_ortho").otherwise(""))
    f = view(spark, sf_dir, "files").withColumns({"p": p, "kind": F.when(F.col("ordinal") % 10 == 0, "mobile").when(F.col("ordinal") % 10 == 1, "qr").otherwise("pdf")})
    return f.select("ordinal", tx.product_base(F.col("p")).alias("base"), tx.product_label(F.col("p"), tx.product_base(F.col("p"))).alias("label"), tx.product_rank(F.col("p"), F.col("kind")).alias("rank"), tx.tiling_priority(F.trim("product_raw")).alias("priority"))


def unit_token_lists(spark, sf_dir):
    return _files(spark, sf_dir).select("ordinal", F.array_join(tx.unit_tokens(F.col("name"), 2026), ",").alias("tokens"))


def candidate_dirs(spark, sf_dir):
    f = view(spark, sf_dir, "fires")
    raw = F.concat((F.lit(2025) + F.col("ordinal") % 2).cast("string"), F.lit("_"), F.when(F.col("ordinal") % 9 == 3, "zFireName4").otherwise(F.replace("post_title", F.lit(" "), F.lit("%20"))), F.lit("/"))
    return f.select("ordinal", tx.dir_rest(raw, 2026).alias("rest"))


def folder_keys(spark, sf_dir):
    f = view(spark, sf_dir, "files")
    m, d = F.lpad((F.col("ordinal") % 14).cast("string"), 2, "0"), F.lpad((F.col("ordinal") % 33).cast("string"), 2, "0")
    name = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("2026"), m, d)).otherwise(F.concat(m, d, F.lit("2026")))
    return f.select("ordinal", tx.daily_key(name).alias("key"), tx.valid_day(F.concat(F.lit("2026-"), m, F.lit("-"), d)).alias("valid"))


def size_hints(spark, sf_dir):
    f = view(spark, sf_dir, "files")
    hint = F.concat((F.col("size_bytes") / 10).cast("string"), F.element_at(F.array(*map(F.lit, ("", "K", "M", "G", "-"))), (F.col("ordinal") % 5 + 1).cast("int")))
    return f.select("ordinal", tx.size_bytes(hint).alias("bytes"))


def stamps(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    http = F.concat(F.date_format("acq_ts", "EEE"), F.lit(", "), F.date_format("acq_ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    run = F.date_format("acq_ts", "yyyyMMdd_HHmmss")
    ntz = lambda c: c.cast("timestamp_ntz")
    return d.select("ordinal", ntz(tm.http_date(F.when(F.col("ordinal") % 5 == 0, "junk").otherwise(http))).alias("http"), ntz(tm.run_instant(run)).alias("run"), ntz(tm.member_instant(F.concat(F.lit("ws_"), run, F.lit(".tif")))).alias("member"), tm.cycle_name(F.col("acq_ts")).alias("cycle"), ntz(tm.from_epoch_ms(tm.to_epoch_ms(F.col("acq_ts")))).alias("back"))


def coordinate_labels(spark, sf_dir):
    p = view(spark, sf_dir, "label_points").select((F.col("ordinal") % 190).alias("d"), (F.col("sub") * 11 % 70).alias("m"), (F.col("ordinal") % 5).alias("h")).distinct()
    text = F.concat(F.when(F.col("h") == 4, "-").otherwise(""), F.col("d").cast("string"), F.lit("° "), F.col("m").cast("string"), F.lit("'"), F.element_at(F.array(*map(F.lit, ("N", "S", "W", "", ""))), (F.col("h") + 1).cast("int")))
    c = tx.parse_coord(text)
    return p.select("d", "m", "h", c["axis"].alias("axis"), F.round(c["deg"], 6).alias("deg"))


def flight_names(spark, sf_dir):
    f = view(spark, sf_dir, "fires")
    name = F.concat(F.lit("20260817_"), F.initcap(F.split("post_title", " ")[0]), F.lit("_IR_"), F.col("ordinal").cast("string"), F.lit(".zip"))
    layer = F.element_at(F.array(*map(F.lit, ("Heat Perimeter", "Intense Heat", "scattered", "Isolated pts", "other"))), (F.col("ordinal") % 5 + 1).cast("int"))
    note = F.concat(F.lit("Flight notes. Estimated Acreage: "), F.format_number(F.floor("acres"), 0), F.lit(" acres"))
    return f.select("ordinal", tx.flight_id(name, F.col("post_title")).alias("flight"), tx.heat_class(layer).alias("heat"), tx.estimated_acres(note).alias("acres"))


def content_shards(spark, sf_dir):
    f = view(spark, sf_dir, "files").withColumn("sha16", ops.content_id(F.col("content")))
    return f.select("ordinal", "sha16", tx.shard_of(F.when(F.col("ordinal") % 9 == 0, "xyz").otherwise(F.col("sha16")), 8).alias("shard"))


def sheet_fields(spark, sf_dir):
    f = view(spark, sf_dir, "files")
    kind = F.when(F.col("ordinal") % 6 == 0, "mobile").otherwise("pdf")
    sheet = F.element_at(F.array(*map(F.lit, ("arch_e", "8.5x11", "arch_d", "36x48"))), (F.col("ordinal") % 4 + 1).cast("int"))
    z = tx.zoom_range(F.lit(0.5) + F.col("ordinal") % 50)
    return f.select(
        "ordinal", tx.row_action(kind, F.col("ordinal") % 2 == 0, F.col("ordinal") % 4 == 0).alias("action"), tx.series_key(F.trim("product_raw"), sheet, F.when(F.col("ordinal") % 3 == 0, "port")).alias("series"), tx.sheet_dpi(sheet).alias("dpi"), z["zmin"].alias("zmin"), z["zmax"].alias("zmax"),
        tx.incident_key(F.when(F.col("ordinal") % 2 == 0, "pacific_nw_oregon").otherwise("rocky_mtn"), F.lit(2026), F.col("incident_key").cast("string")).alias("key"), tx.fill_template(F.lit("{slug}/{pct}.tif"), slug=F.trim("product_raw"), pct=F.col("ordinal") % 9).alias("path"))


def first_copies(spark, sf_dir):
    return ops.first_wins(view(spark, sf_dir, "files").select(ops.content_id(F.col("content")).alias("sha16"), "ordinal", "rel_dir"), ["sha16"])


def file_revisions(spark, sf_dir):
    f = view(spark, sf_dir, "files").select("ordinal", "incident_key", (F.col("size_bytes") % 3).alias("sha"))
    return ops.with_rev(f, "incident_key", "sha", "ordinal").select("ordinal", "rev")


def _snapshots(spark, sf_dir):
    f = view(spark, sf_dir, "files").select(F.col("incident_key").alias("incident"), F.col("ordinal").alias("rel"), F.concat(F.lit("e"), (F.col("ordinal") % 13).cast("string")).alias("etag"), F.col("size_bytes").alias("size"), F.col("ordinal"))
    state = f.filter("ordinal % 3 <> 0").withColumn("etag", F.when(F.col("ordinal") % 4 == 0, "old").otherwise(F.col("etag")))
    return f.filter("ordinal % 7 <> 0").drop("ordinal"), state.drop("ordinal")


def file_diff(spark, sf_dir):
    return ops.diff_files(*_snapshots(spark, sf_dir), 8000)


def replayed_files(spark, sf_dir):
    now, state = _snapshots(spark, sf_dir)
    return ops.replay_files(now, state)


def _dirs(spark, sf_dir):
    return view(spark, sf_dir, "fires").select(F.col("ordinal").alias("dir"), (F.col("ordinal") % 30).alias("fire"), (F.col("ordinal") % 4).alias("mtime"), "post_title", "acres", "poly_last_updated", "ordinal")


def changed_folders(spark, sf_dir):
    d = _dirs(spark, sf_dir)
    state = d.select("dir", (F.col("dir") % 3).alias("mtime"), F.when(F.col("dir") % 5 != 0, F.col("fire")).alias("matched"))
    return ops.changed_dirs(d.select("dir", "mtime"), state)


def sibling_folders(spark, sf_dir):
    d = _dirs(spark, sf_dir).select("dir", "fire")
    return ops.replay_siblings(d, d.filter("dir % 4 = 1"))


def token_votes(spark, sf_dir):
    f = _files(spark, sf_dir).select((F.col("incident_key") % 5).alias("dir"), F.concat(F.lit("202608"), "day").alias("folder"), "name", "ordinal")
    return ops.unit_token_votes(f, 2026).select("dir", "token", "n", "rank")


def incident_summaries(spark, sf_dir):
    f = view(spark, sf_dir, "files").select(F.col("incident_key").alias("fire"), F.concat(F.lit("2026-"), F.lpad((F.col("ordinal") % 15).cast("string"), 2, "0"), F.lit("-11")).alias("day"), F.col("size_bytes").alias("uploaded"), "ordinal")
    return ops.incident_summary(f.filter("ordinal % 3 <> 0"), f.filter("ordinal % 3 = 0"))


def _manifest(spark, sf_dir):
    f = view(spark, sf_dir, "files").select(F.col("incident_key").alias("fire"), ops.content_id(F.col("content")).alias("sha16"), (F.col("ordinal") % 6).alias("dir"), "ordinal", "size_bytes")
    flights = f.select("fire", (F.col("ordinal") % 4).alias("flight_id"), "dir", (F.col("ordinal") % 2 == 0).alias("converted"), (F.col("size_bytes") % 5).alias("links"), "ordinal")
    dirs = f.groupBy("fire", "dir").agg(F.count(F.lit(1)).alias("n_maps"), F.min("ordinal").alias("ordinal"))
    return ops.merge_manifests(f, flights, dirs)


def manifest_sheets(spark, sf_dir):
    return _manifest(spark, sf_dir)[0].select("fire", "sha16", "ordinal")


def manifest_flights(spark, sf_dir):
    return _manifest(spark, sf_dir)[1]


def manifest_meta(spark, sf_dir):
    return _manifest(spark, sf_dir)[2]


def _flight_files(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("zip", "pdf", "KMZ", "txt", "doc"))), (F.col("size_bytes") % 5 + 1).cast("int"))
    return view(spark, sf_dir, "files").select(F.col("incident_key").alias("incident"), F.col("incident_key").alias("fire"), (F.col("ordinal") % 60).alias("folder"), F.concat(F.lit("f"), F.col("ordinal").cast("string"), F.lit("."), ext).alias("name"), "ordinal")


def assembled_flights(spark, sf_dir):
    return ops.assemble_flights(_flight_files(spark, sf_dir))


def flight_backlog(spark, sf_dir):
    f = _flight_files(spark, sf_dir)
    return ops.flight_backlog(f, f.filter("ordinal % 3 = 0").select("fire", "folder"))


def series_counts(spark, sf_dir):
    f = view(spark, sf_dir, "files").select(F.col("incident_key").alias("incident"), F.trim("product_raw").alias("series"), (F.col("size_bytes") % 2 == 0).alias("overlayable"))
    return ops.series_counts(f)


def run_totals(spark, sf_dir):
    f = view(spark, sf_dir, "files").select("size_bytes", F.element_at(F.array(*map(F.lit, ("new", "unchanged", "too_big", "deferred"))), (F.col("ordinal") % 4 + 1).cast("int")).alias("kind"), (F.col("incident_key") % 3 == 0).alias("matched"))
    return ops.run_totals(f)


def current_periods(spark, sf_dir):
    f = view(spark, sf_dir, "files").select(F.col("incident_key").alias("incident"), F.concat(F.lit("202608"), F.lpad((F.col("incident_key") + F.col("ordinal") % 9).cast("string"), 2, "0")).alias("key")).distinct()
    return ops.current_period(f, "20260815", 3)


def ordered_sheets(spark, sf_dir):
    f = _files(spark, sf_dir).select("ordinal", F.col("incident_key").alias("incident"), F.when(F.col("ordinal") % 8 != 0, F.col("day")).alias("op_date"), F.trim("product_raw").alias("product"), F.lit("pdf").alias("kind"), F.when(F.col("ordinal") % 3 == 0, "day").when(F.col("ordinal") % 3 == 1, "night").alias("period"), F.lpad(F.col("ordinal").cast("string"), 9, "0").alias("filename"))
    return ops.order_sheets(f).select("ordinal", "position")


def budgeted_sheets(spark, sf_dir):
    f = view(spark, sf_dir, "files").select("ordinal", F.col("incident_key").alias("incident"), F.trim("product_raw").alias("base"), (F.col("ordinal") % 6 == 0).alias("flat"))
    return ops.apply_budget(f, 12).select("ordinal", "work")


def pending_sheets(spark, sf_dir):
    f = view(spark, sf_dir, "files").select(ops.content_id(F.col("content")).alias("sha16"), "ordinal", (F.col("ordinal") % 3 != 0).alias("georeferenced"))
    return ops.pending_sheets(f, f.filter("ordinal % 5 = 1").select("sha16"), 4, 2).select("sha16", "ordinal")


def inactive_incidents(spark, sf_dir):
    d = _dirs(spark, sf_dir).select(F.col("dir").alias("incident"))
    return ops.inactive(d, d.filter("incident % 3 = 0"))


def day_unions(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    days = lambda cond, n: F.collect_set(F.when(F.expr(cond), F.col("acq_date"))).alias(n)
    g = d.groupBy(F.floor("lon").alias("cell")).agg(days("ordinal % 3 = 0", "a"), days("ordinal % 5 = 0", "b"))
    return g.select("cell", F.array_join(ops.union_days(F.col("a"), F.col("b")), ",").alias("days"))


def changed_documents(spark, sf_dir):
    f = view(spark, sf_dir, "files").select(F.col("ordinal").alias("doc"), (F.col("size_bytes") % 4).alias("etag"))
    return ops.changed_docs(f, f.select("doc", (F.col("doc") % 4).alias("etag"), (F.col("doc") % 6 != 0).alias("cached")))


def retry_ledger(spark, sf_dir):
    f = view(spark, sf_dir, "files").select(F.col("ordinal").alias("flight"))
    a = f.filter("flight % 3 <> 0").select("flight", (F.col("flight") % 4 == 0).alias("ok"), (F.col("flight") % 5).cast("int").alias("version"))
    return ops.retryable(f, a, 3)


def repair_queue(spark, sf_dir):
    f = view(spark, sf_dir, "files").select(F.col("ordinal").alias("sha16"), (F.col("ordinal") % 2 == 0).alias("broken"))
    a = f.select("sha16", F.when(F.col("sha16") % 3 == 0, "georef").otherwise("broken").alias("kind")).filter("sha16 % 5 <> 0")
    return ops.repair_queue(f, a, "georef").select("sha16")


def adopted_markers(spark, sf_dir):
    f = view(spark, sf_dir, "files").select(F.col("ordinal").alias("sha16"), F.when(F.col("ordinal") % 3 == 0, F.col("ordinal") * 2).alias("tiles"))
    return ops.adopt_markers(f, f.filter("sha16 % 4 = 0").select("sha16", (F.col("sha16") * 5).alias("tiles")))


def retention(spark, sf_dir):
    d = view(spark, sf_dir, "fires").select(F.col("ordinal").alias("incident"), F.when(F.col("ordinal") % 2 == 0, F.col("created_on")).alias("inactive_since"))
    return ops.retention_candidates(d, d.filter("incident % 3 = 0").select("incident"), _ts("1996-01-01 00:00:00"), 14)


def ranked_candidates(spark, sf_dir):
    d = _dirs(spark, sf_dir)
    fires = d.groupBy(F.col("post_title").alias("name")).agg(F.max("acres").alias("acres"), F.max("poly_last_updated").alias("last_updated")).filter("name not like 'b%'")
    return ops.rank_candidates(d.select("dir", F.col("post_title").alias("name"), "ordinal"), fires, ["blue new item", "red old part"]).select("dir", "rank")


RULES = [(0, "frames/national/", "short"), (1, "frames/", "year"), (2, "tiles/", "year"), (3, "catalogs/versions/", "year"), (4, "catalogs/", "minute"), (5, "state/", "private")]


def asset_classes(spark, sf_dir):
    stem = F.element_at(F.array(*map(F.lit, ("frames/national/a", "frames/b", "catalogs/versions/c", "catalogs/d", "raw/e/qr/f", "raw/g", "other/h", "state/i"))), (F.col("ordinal") % 8 + 1).cast("int"))
    keys = view(spark, sf_dir, "files").select(F.concat(stem, F.col("ordinal").cast("string")).alias("key"))
    return ops.asset_class(keys, spark.createDataFrame(RULES, "rank int, prefix string, cls string"), "short")


def throttled_events(spark, sf_dir):
    e = view(spark, sf_dir, "user_actions").withColumn("actor", F.col("actor") % 20)
    return ops.throttle(e, 2, 60)


def once_per_scope(spark, sf_dir):
    return ops.once_per_scope(view(spark, sf_dir, "user_actions"), "signup")


def heartbeat_latest(spark, sf_dir):
    e = view(spark, sf_dir, "user_actions").select(F.col("event").alias("job"), F.col("ordinal").alias("finished_at"), F.col("properties").alias("note"))
    return ops.fold_heartbeats(e)[0]


def heartbeat_history(spark, sf_dir):
    e = view(spark, sf_dir, "user_actions").select(F.col("event").alias("job"), F.col("ordinal").alias("finished_at"))
    return ops.keep_last(e, 40, ["job"], F.col("finished_at").desc())


def recent_runs(spark, sf_dir):
    e = view(spark, sf_dir, "user_actions").select(F.col("actor").alias("job"), F.col("ordinal").alias("finished_at"), "ts")
    r = ops.keep_last(e, 10, ["job"], F.col("finished_at").desc())
    return r.groupBy("job").agg(F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list("finished_at"))), lambda x: x.cast("string")), ",").alias("runs"), tm.feed_grade(F.max("ts"), _ts("2024-01-30 12:00:00"), 12, 48).alias("grade"))


def listing_rows(spark, sf_dir):
    p = parse_listing_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html"))
    return p.select("url", "name", "href", "is_dir")


# ---- linkage


def _link_fires(spark, sf_dir):
    return view(spark, sf_dir, "fires").select(F.col("ordinal").alias("fire"), "ordinal", F.col("post_title").alias("name"), "state", "unique_fire_id", "cornea_id")


def matched_incidents(spark, sf_dir):
    f = _link_fires(spark, sf_dir)
    dirs = f.select((F.col("fire") + 1000).alias("dir"), F.when(F.col("fire") % 3 == 0, F.concat("name", F.lit(" fire"))).when(F.col("fire") % 3 == 1, F.concat("name", F.lit("s"))).otherwise(F.col("name")).alias("name"), "state", F.when(F.col("fire") % 7 == 0, F.col("unique_fire_id")).alias("token"))
    pins = f.filter("fire % 25 = 4").select((F.col("fire") + 1000).alias("dir"), F.when(F.col("fire") % 2 == 0, "ignore").otherwise(F.col("unique_fire_id")).alias("pin"))
    return lk.match_incidents(dirs, f, pins).select("dir", "fire", "method", F.round("score", 3).alias("score"))


def pinned_incidents(spark, sf_dir):
    """Pins to fires that are there, to one that is gone, and none."""
    f = _link_fires(spark, sf_dir)
    dirs = f.select((F.col("fire") + 1000).alias("dir"), "name", F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("token"))
    pin = F.when(F.col("fire") % 3 == 0, F.concat(F.lit("gone-"), F.col("fire").cast("string"))).when(F.col("fire") % 3 == 1, F.col("unique_fire_id")).otherwise("ignore")
    return lk.match_incidents(dirs, f, f.filter("fire % 5 < 3").select((F.col("fire") + 1000).alias("dir"), pin.alias("pin"))).withColumn("score", F.round("score", 3))


def matched_slugs(spark, sf_dir):
    f = _link_fires(spark, sf_dir)
    slugs = f.select(F.concat(F.lower("state"), F.lit("-"), tx.slugify(F.concat("name", F.when(F.col("fire") % 4 == 1, "s").otherwise(""))), F.when(F.col("fire") % 2 == 0, F.concat(F.lit("-"), F.col("fire").cast("string"))).otherwise("")).alias("slug")).distinct()
    docs = f.filter("fire % 10 = 0").select(F.concat(F.lower("state"), F.lit("-"), tx.slugify(F.col("name")), F.lit("-"), F.col("fire").cast("string")).alias("slug"), "cornea_id")
    return lk.match_forecast_slugs(slugs, docs, f)


def sitrep_rows(spark, sf_dir):
    return lk.parse_sitrep_lines(view(spark, sf_dir, "sitrep_lines")).select("line_no", "name", "unit", "acres", "acres_change", "contained_pct", "personnel", "personnel_change", "crews", "est_containment", "cost_to_date", "owner")


def narratives(spark, sf_dir):
    t = view(spark, sf_dir, "fires").select(F.col("ordinal").alias("doc"), F.concat("post_title", F.lit(", in the north.\n \nNext"), F.col("state"), F.lit(" one, calm.\n\nplain")).alias("text"))
    return lk.parse_narratives(t)


def matched_sitrep(spark, sf_dir):
    rows = lk.parse_sitrep_lines(view(spark, sf_dir, "sitrep_lines"))
    n = view(spark, sf_dir, "fires").filter("ordinal % 2 = 0").select(F.col("ordinal").alias("doc"), F.concat("post_title", F.lit(", quiet.")).alias("text"))
    return lk.match_sitrep(rows, _link_fires(spark, sf_dir), lk.parse_narratives(n))


def name_ratios(spark, sf_dir):
    return lk.name_pairs(_link_fires(spark, sf_dir), None).select("a", "b", F.round("ratio", 4).alias("ratio"))


def _labels(spark, sf_dir):
    return view(spark, sf_dir, "label_points").select(F.col("sheet_key").alias("sheet"), "axis", "pos", "val")


def label_fits(spark, sf_dir):
    return lk.fit_axes(_labels(spark, sf_dir)).select("sheet", "axis", F.round("a", 4).alias("a"), F.round("b", 3).alias("b"), "n")


def label_spacing(spark, sf_dir):
    return lk.median_spacing(_labels(spark, sf_dir))


def envelopes(spark, sf_dir):
    d = view(spark, sf_dir, "detections").groupBy((F.col("ordinal") % 50).alias("id")).agg(F.array(F.collect_list(F.array("lon", "lat"))).alias("rings"))
    return lk.envelope(d).select("id", *(F.round(c, 6).alias(c) for c in "wsen"))


def historic_perimeters(spark, sf_dir):
    r = view(spark, sf_dir, "fires").select(F.col("cornea_id").alias("guid"), (F.lit(2000) + F.col("ordinal") % 27).alias("year"), (F.lit(-124.0) + F.col("ordinal") % 50).alias("w"), (F.lit(32.0) + F.col("ordinal") % 15).alias("s"))
    r = r.withColumns({"e": F.col("w") + 1, "n": F.col("s") + 1})
    return lk.historic_perimeters(r, (-120.0, 34.0, -90.0, 44.0), 2026, "{F00000021}", 30).select("guid", "year")


QUERIES = {f.__name__: f for f in (
    product_names, product_vocabulary, unit_token_lists, candidate_dirs, folder_keys, size_hints, stamps, coordinate_labels, flight_names, content_shards, sheet_fields, first_copies, file_revisions, file_diff, replayed_files,
    changed_folders, sibling_folders, token_votes, incident_summaries, manifest_sheets, manifest_flights, manifest_meta, assembled_flights, flight_backlog, series_counts, run_totals, current_periods, ordered_sheets, budgeted_sheets,
    pending_sheets, inactive_incidents, day_unions, changed_documents, retry_ledger, repair_queue, adopted_markers, retention, ranked_candidates, asset_classes, throttled_events, once_per_scope, heartbeat_latest, heartbeat_history,
    recent_runs, listing_rows, matched_incidents, pinned_incidents, matched_slugs, sitrep_rows, narratives, matched_sitrep, name_ratios, label_fits, label_spacing, envelopes, historic_perimeters)}

_F = "files"
_DAY = "lpad(CAST(ordinal % 28 + 1 AS VARCHAR), 2, '0')"
_P = "trim(product_raw)"
_SHA = "substr(sha256(content), 1, 16)"
_SHARD = "CAST(CAST('0x' || substr(sha16, 1, 8) AS BIGINT) % {n} AS BIGINT)"
_BASE = "CASE " + " ".join(f"WHEN p = '{b}' OR starts_with(p, '{b}_') THEN '{b}'" for b in sorted(tx.PRODUCT_RANKS, key=lambda b: (-len(b), b))) + " ELSE 'other' END"
_LABEL = "CASE base " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.PRODUCT_LABELS.items()) + " END"
_RANK = "CASE base " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tx.PRODUCT_RANKS.items()) + " END"
_PRIO = "CASE base " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tx.TILING_PRIORITY.items()) + " ELSE 7 END"
_DIRS = "SELECT ordinal AS dir, ordinal % 30 AS fire, ordinal % 4 AS mtime, post_title, acres, poly_last_updated, ordinal FROM fires"
_ITEM = lambda *x, n=None: "[" + ",".join(f"'{v}'" for v in x) + f"][ordinal % {n or len(x)} + 1]"
_FF = "SELECT incident_key AS incident, incident_key AS fire, ordinal % 60 AS folder, 'f' || CAST(ordinal AS VARCHAR) || '.' || ['zip','pdf','KMZ','txt','doc'][size_bytes % 5 + 1] AS name, lower(['zip','pdf','KMZ','txt','doc'][size_bytes % 5 + 1]) AS ext, ordinal FROM files"
_NORM = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({c}, '[_-]+', ' ', 'g')), '[^a-z0-9 ]+', '', 'g'), '\s+', ' ', 'g'))"
_SIT = "SELECT s_suppkey AS line_no, p_name AS name, substr('ORWACAIDMTCOWYSDUTNVAZNM', 1 + 2 * (s_nationkey % 12), 2) || '-XYZ' AS unit, CAST(1000 + s_suppkey AS BIGINT) AS acres, CAST(NULL AS BIGINT) AS acres_change, CAST(s_suppkey % 101 AS BIGINT) AS contained_pct, CAST(1000 + s_suppkey % 1000 AS BIGINT) AS personnel, CAST(-16 AS BIGINT) AS personnel_change, CAST(17 AS BIGINT) AS crews, '8/' || CAST(1 + s_suppkey % 28 AS VARCHAR) AS est_containment, '56.2M' AS cost_to_date, 'BLM' AS owner FROM supplier JOIN part ON p_partkey = s_suppkey"

ORACLE = {
    "product_names": cte(f"""SELECT ordinal, CASE WHEN r THEN 'other' ELSE {_P} END AS product, CASE WHEN r THEN 'other' ELSE {_P} END AS product_base, CASE WHEN NOT r THEN CASE ordinal % 4 WHEN 0 THEN 'arch_e' WHEN 1 THEN '11x17' WHEN 2 THEN '85x11' END END AS sheet, CASE WHEN NOT r THEN CASE ordinal % 4 WHEN 0 THEN 'port' WHEN 1 THEN 'land' END END AS orientation,
 CASE WHEN NOT r THEN '2026-08-' || {_DAY} || 'T21:00' END AS generated_at_local, CASE WHEN NOT r THEN '2026-08-' || {_DAY} END AS op_date, CASE WHEN NOT r THEN CASE ordinal % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'night' END END AS period, CASE WHEN NOT r THEN 'COGMF' || lpad(CAST(ordinal % 7 AS VARCHAR), 6, '0') END AS unit_incident, CASE WHEN NOT r THEN 'Elk_Creek' END AS fire_name
 FROM (SELECT *, ordinal % 11 = 5 AS r FROM files)""", _F),
    "product_vocabulary": cte(f"SELECT ordinal, base, CASE WHEN p <> base AND starts_with(p, base || '_') AND base <> 'other' THEN {_LABEL} || ' (' || replace(substr(p, length(base) + 2), '_', ' ') || ')' ELSE {_LABEL} END AS label, CAST(CASE ordinal % 10 WHEN 0 THEN 11 WHEN 1 THEN 10 ELSE {_RANK} END AS INT) AS rank, CAST({_PRIO.replace('base', 'q')} AS INT) AS priority FROM (SELECT *, {_BASE} AS base FROM (SELECT ordinal, {_P} AS q, {_P} || CASE WHEN ordinal % 3 = 0 THEN '_arche' ELSE '' END || CASE WHEN ordinal % 6 = 3 THEN '_ortho' ELSE '' END AS p FROM files))", _F),
    "unit_token_lists": cte("SELECT ordinal, CASE WHEN ordinal % 11 = 5 THEN '' ELSE '2026-COGMF-' || lpad(CAST(ordinal % 7 AS VARCHAR), 6, '0') END AS tokens FROM files", _F),
    "candidate_dirs": cte("SELECT ordinal, CASE WHEN ordinal % 2 = 1 AND ordinal % 9 <> 3 THEN post_title END AS rest FROM fires", "fires"),
    "folder_keys": cte("SELECT ordinal, CASE WHEN ordinal % 14 BETWEEN 1 AND 12 AND ordinal % 33 BETWEEN 1 AND 31 THEN '2026' || lpad(CAST(ordinal % 14 AS VARCHAR), 2, '0') || lpad(CAST(ordinal % 33 AS VARCHAR), 2, '0') END AS key, ordinal % 14 BETWEEN 1 AND 12 AND ordinal % 33 BETWEEN 1 AND 31 AS valid FROM files", _F),
    "size_hints": cte("SELECT ordinal, CASE WHEN ordinal % 5 < 4 THEN CAST(trunc(size_bytes / 10 * pow(1024, ordinal % 5)) AS BIGINT) END AS bytes FROM files", _F),
    "stamps": cte("SELECT ordinal, CASE WHEN ordinal % 5 <> 0 THEN date_trunc('second', acq_ts) END AS http, date_trunc('second', acq_ts) AS run, date_trunc('second', acq_ts) AS member, 'hrrr_' || strftime(acq_ts, '%Y%m%d_%H') AS cycle, date_trunc('millisecond', acq_ts) AS back FROM detections", "detections"),
    "coordinate_labels": cte("""SELECT d, m, h, CASE WHEN ok THEN CASE WHEN h IN (0, 1) THEN 'lat' WHEN h = 2 OR d >= 60 THEN 'lon' ELSE 'lat' END END AS axis, CASE WHEN ok THEN round(CASE WHEN h IN (1, 2, 4) OR (h = 3 AND d >= 60) THEN -1 ELSE 1 END * (d + m / 60), 6) END AS deg
 FROM (SELECT *, d <= 180 AND m < 60 AS ok FROM (SELECT DISTINCT ordinal % 190 AS d, sub * 11 % 70 AS m, ordinal % 5 AS h FROM label_points))""", "label_points"),
    "flight_names": cte("SELECT ordinal, '20260817_IR_' || CAST(ordinal AS VARCHAR) AS flight, ['Perimeter','Intense','Scattered','Isolated',NULL][ordinal % 5 + 1] AS heat, floor(acres) AS acres FROM fires", "fires"),
    "content_shards": cte(f"SELECT ordinal, sha16, CASE WHEN ordinal % 9 = 0 THEN 0 ELSE {_SHARD.format(n=8)} END AS shard FROM (SELECT ordinal, {_SHA} AS sha16 FROM files)", _F),
    "sheet_fields": cte(f"""SELECT ordinal, CASE WHEN ordinal % 6 = 0 THEN 'download' WHEN ordinal % 4 = 0 THEN 'overlay' WHEN ordinal % 2 = 0 THEN 'overlay-soon' ELSE 'view' END AS action, {_P} || '|' || {_ITEM('arch_e', '8.5x11', 'arch_d', '36x48')} || '|' || CASE WHEN ordinal % 3 = 0 THEN 'port' ELSE '' END AS series, CAST([150,300,200,200][ordinal % 4 + 1] AS INT) AS dpi,
 CAST(z - 6 AS INT) AS zmin, CAST(z AS INT) AS zmax, CASE WHEN ordinal % 2 = 0 THEN 'pacific_nw' ELSE 'rocky_mtn' END || '/2026/' || CAST(incident_key AS VARCHAR) AS key, {_P} || '/' || CAST(ordinal % 9 AS VARCHAR) || '.tif' AS path FROM (SELECT *, greatest(10, least(16, floor(log2(156543.03392804097 / (0.5 + ordinal % 50))))) AS z FROM files)""", _F),
    "first_copies": cte(f"SELECT {_SHA} AS sha16, min(ordinal) AS ordinal, arg_min(rel_dir, ordinal) AS rel_dir FROM files GROUP BY 1", _F),
    "file_revisions": cte("SELECT ordinal, CAST(sum(c) OVER (PARTITION BY incident_key ORDER BY ordinal) AS BIGINT) AS rev FROM (SELECT ordinal, incident_key, CASE WHEN lag(size_bytes % 3) OVER w IS DISTINCT FROM size_bytes % 3 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM files WINDOW w AS (PARTITION BY incident_key ORDER BY ordinal))", _F),
    "file_diff": cte("SELECT incident_key AS incident, ordinal AS rel, CASE WHEN ordinal % 7 = 0 THEN 'replayed' WHEN size_bytes > 8000 THEN 'too_big' WHEN ordinal % 3 = 0 THEN 'new' WHEN ordinal % 4 = 0 THEN 'changed' ELSE 'unchanged' END AS kind FROM files WHERE ordinal % 7 <> 0 OR ordinal % 3 <> 0", _F),
    "replayed_files": cte("SELECT incident_key AS incident, ordinal AS rel, CASE WHEN ordinal % 7 = 0 AND ordinal % 4 = 0 THEN 'old' ELSE 'e' || CAST(ordinal % 13 AS VARCHAR) END AS etag, size_bytes AS size FROM files WHERE ordinal % 7 <> 0 OR ordinal % 3 <> 0", _F),
    "changed_folders": cte("SELECT ordinal AS dir, ordinal % 4 AS mtime FROM fires WHERE NOT (ordinal % 4 = ordinal % 3 AND ordinal % 5 <> 0)", "fires"),
    "sibling_folders": cte("SELECT dir, fire FROM d WHERE dir % 4 <> 1 AND fire IN (SELECT fire FROM d WHERE dir % 4 = 1)", "fires", d=_DIRS),
    "token_votes": cte(f"SELECT dir, token, n, CAST(row_number() OVER (PARTITION BY dir ORDER BY n DESC, f) AS INT) AS rank FROM (SELECT dir, token, count(*) AS n, min(ordinal) AS f FROM (SELECT incident_key % 5 AS dir, '2026-COGMF-' || lpad(CAST(ordinal % 7 AS VARCHAR), 6, '0') AS token, ordinal, dense_rank() OVER (PARTITION BY incident_key % 5 ORDER BY {_DAY} DESC) AS k FROM files) WHERE k <= 2 AND ordinal % 11 <> 5 GROUP BY ALL)", _F),
    "incident_summaries": cte("SELECT incident_key AS fire, count(*) FILTER (ordinal % 3 <> 0) AS map_count, count(*) FILTER (ordinal % 3 = 0) AS ir_count, max(CASE WHEN ordinal % 15 BETWEEN 1 AND 12 THEN '2026-' || lpad(CAST(ordinal % 15 AS VARCHAR), 2, '0') || '-11' END) AS latest_upload, max(size_bytes) AS latest_upload_ts FROM files GROUP BY 1", _F),
    "manifest_sheets": cte(f"SELECT incident_key AS fire, {_SHA} AS sha16, min(ordinal) AS ordinal FROM files GROUP BY 1, 2", _F),
    "manifest_flights": cte("SELECT incident_key AS fire, ordinal % 4 AS flight_id, ordinal % 6 AS dir FROM files QUALIFY row_number() OVER (PARTITION BY incident_key, ordinal % 4 ORDER BY (ordinal % 2 = 0) DESC, size_bytes % 5 DESC, ordinal) = 1", _F),
    "manifest_meta": cte("SELECT fire, dir FROM (SELECT incident_key AS fire, ordinal % 6 AS dir, count(*) AS n, min(ordinal) AS o FROM files GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY fire ORDER BY n DESC, o) = 1", _F),
    "assembled_flights": cte("SELECT incident, folder, zip, pdf, kmz, notes, coalesce(zip, pdf, kmz) AS named_by FROM (SELECT incident, folder, arg_min(name, ordinal) FILTER (ext = 'zip') AS zip, arg_min(name, ordinal) FILTER (ext = 'pdf') AS pdf, arg_min(name, ordinal) FILTER (ext = 'kmz') AS kmz, arg_min(name, ordinal) FILTER (ext = 'txt') AS notes FROM ff GROUP BY ALL)", _F, ff=_FF),
    "flight_backlog": cte("SELECT fire, have, coalesce(tried, 0) AS tried FROM (SELECT fire, count(DISTINCT folder) AS have FROM ff WHERE ext IN ('zip','kmz') GROUP BY 1) LEFT JOIN (SELECT fire, count(DISTINCT folder) AS tried FROM ff WHERE ordinal % 3 = 0 GROUP BY 1) USING (fire) WHERE have > coalesce(tried, 0)", _F, ff=_FF),
    "series_counts": cte(f"SELECT incident_key AS incident, {_P} AS series, count(*) AS n FROM files WHERE size_bytes % 2 = 0 GROUP BY ALL", _F),
    "run_totals": cte("SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (ordinal % 4 = 1) AS unchanged, count(*) FILTER (ordinal % 4 = 2) AS too_big, count(*) FILTER (ordinal % 4 = 3) AS deferred, count(*) FILTER (incident_key % 3 = 0) AS matched, count(*) FILTER (incident_key % 3 <> 0) AS unmatched FROM files", _F),
    "current_periods": cte("SELECT incident, key FROM (SELECT *, count(*) FILTER (key >= '20260815') OVER (PARTITION BY incident) AS fresh, row_number() OVER (PARTITION BY incident ORDER BY key DESC) AS k FROM d) WHERE (fresh > 0 AND key >= '20260815' AND k <= 3) OR (fresh = 0 AND k = 1)", _F, d="SELECT DISTINCT incident_key AS incident, '202608' || lpad(CAST(incident_key + ordinal % 9 AS VARCHAR), 2, '0') AS key FROM files"),
    "ordered_sheets": cte(f"SELECT ordinal, CAST(row_number() OVER (PARTITION BY incident_key ORDER BY CASE WHEN ordinal % 8 <> 0 THEN {_DAY} END DESC NULLS LAST, {_RANK.replace('base', _P)}, ordinal % 3, ordinal) AS INT) AS position FROM files", _F),
    "budgeted_sheets": cte(f"SELECT ordinal, ordinal % 6 = 0 OR sum(CASE WHEN ordinal % 6 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY incident_key ORDER BY {_PRIO.replace('base', _P)}, ordinal) <= 12 AS work FROM files", _F),
    "pending_sheets": cte(f"SELECT sha16, min(ordinal) AS ordinal FROM (SELECT ordinal, {_SHA} AS sha16 FROM files) f WHERE ordinal % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM files t WHERE t.ordinal % 5 = 1 AND substr(sha256(t.content), 1, 16) = f.sha16) AND {_SHARD.format(n=4)} = 2 GROUP BY 1", _F),
    "inactive_incidents": cte("SELECT ordinal AS incident FROM fires WHERE ordinal % 3 <> 0", "fires"),
    "day_unions": cte("SELECT CAST(floor(lon) AS BIGINT) AS cell, coalesce(string_agg(DISTINCT CASE WHEN ordinal % 3 = 0 OR ordinal % 5 = 0 THEN acq_date END, ',' ORDER BY CASE WHEN ordinal % 3 = 0 OR ordinal % 5 = 0 THEN acq_date END), '') AS days FROM detections GROUP BY 1", "detections"),
    "changed_documents": cte("SELECT ordinal AS doc, size_bytes % 4 AS etag FROM files WHERE NOT (size_bytes % 4 = ordinal % 4 AND ordinal % 6 <> 0)", _F),
    "retry_ledger": cte("SELECT ordinal AS flight FROM files WHERE ordinal % 3 = 0 OR NOT (ordinal % 4 = 0 OR ordinal % 5 >= 3)", _F),
    "repair_queue": cte("SELECT ordinal AS sha16 FROM files WHERE ordinal % 2 = 0 AND NOT (ordinal % 3 = 0 AND ordinal % 5 <> 0)", _F),
    "adopted_markers": cte("SELECT ordinal AS sha16, CASE WHEN ordinal % 3 = 0 THEN ordinal * 2 WHEN ordinal % 4 = 0 THEN ordinal * 5 END AS tiles, ordinal % 3 <> 0 AND ordinal % 4 = 0 AS adopted FROM files", _F),
    "retention": cte("SELECT ordinal AS incident, s AS inactive_since, coalesce(date_diff('day', CAST(s AS DATE), DATE '1996-01-01') >= 14, false) AS expired FROM (SELECT ordinal, CASE WHEN ordinal % 3 <> 0 THEN coalesce(CASE WHEN ordinal % 2 = 0 THEN created_on END, TIMESTAMP '1996-01-01') END AS s FROM fires)", "fires"),
    "ranked_candidates": cte("SELECT dir, CAST(row_number() OVER (ORDER BY CASE name WHEN 'blue new item' THEN 1 WHEN 'red old part' THEN 2 ELSE 3 END, acres DESC NULLS LAST, lu DESC NULLS LAST, ordinal) AS INT) AS rank FROM (SELECT dir, post_title AS name, ordinal FROM d) LEFT JOIN (SELECT post_title AS name, max(acres) AS acres, max(poly_last_updated) AS lu FROM d WHERE post_title NOT LIKE 'b%' GROUP BY 1) USING (name)", "fires", d=_DIRS),
    "asset_classes": cte("SELECT ['frames/national/a','frames/b','catalogs/versions/c','catalogs/d','raw/e/qr/f','raw/g','other/h','state/i'][ordinal % 8 + 1] || CAST(ordinal AS VARCHAR) AS key, ['short','year','year','minute','short','week','short','private'][ordinal % 8 + 1] AS cls FROM files", _F),
    "once_per_scope": cte("SELECT actor, scope, event, properties, min(ordinal) AS ordinal FROM (SELECT *, CAST(sum(CASE WHEN event = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY ordinal) AS BIGINT) AS scope FROM user_actions) WHERE event <> 'signup' GROUP BY ALL", "user_actions"),
    "heartbeat_latest": cte("SELECT event AS job, arg_max(properties, ordinal) AS note, max(ordinal) AS finished_at FROM user_actions GROUP BY 1", "user_actions"),
    "heartbeat_history": cte("SELECT event AS job, ordinal AS finished_at FROM user_actions QUALIFY row_number() OVER (PARTITION BY event ORDER BY ordinal DESC) <= 40", "user_actions"),
    "recent_runs": cte("SELECT actor AS job, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal DESC) AS runs, CASE WHEN (epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - epoch_ms(max(ts))) / 3600000.0 < 12 THEN 'ok' WHEN (epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - epoch_ms(max(ts))) / 3600000.0 < 48 THEN 'warn' ELSE 'late' END AS grade FROM (SELECT * FROM user_actions QUALIFY row_number() OVER (PARTITION BY actor ORDER BY ordinal DESC) <= 10) GROUP BY 1", "user_actions"),
    "listing_rows": "SELECT url, url_decode(regexp_replace(href, '/+$', '')) AS name, href, href LIKE '%/' AS is_dir FROM (SELECT url, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS href FROM pages) WHERE href NOT LIKE '?%' AND href NOT LIKE '..%' AND href <> '/'",
    "sitrep_rows": _SIT,
    "narratives": cte("SELECT name, arg_min(narrative, doc * 10 + pos) AS narrative FROM (SELECT " + _NORM.format(c="post_title") + " AS name, post_title || ', in the north.' AS narrative, ordinal AS doc, 0 AS pos FROM fires UNION ALL SELECT 'next ' || lower(state) || ' one', 'Next' || state || ' one, calm.', ordinal, 1 FROM fires) GROUP BY 1", "fires"),
    "matched_sitrep": cte("SELECT fire, line_no, acres, personnel, narrative FROM (SELECT name, left(unit, 2) AS state, max(line_no) AS line_no, arg_max(acres, line_no) AS acres, arg_max(personnel, line_no) AS personnel FROM s GROUP BY 1, 2) JOIN (SELECT post_title AS name, state, min(ordinal) AS fire FROM fires GROUP BY 1, 2) USING (name, state) LEFT JOIN (SELECT DISTINCT post_title AS name, post_title || ', quiet.' AS narrative FROM fires WHERE ordinal % 2 = 0) USING (name)", "fires", s=_SIT),
    "label_spacing": cte("SELECT sheet, axis, median(g) AS spacing FROM (SELECT sheet, axis, pos - lag(pos) OVER (PARTITION BY sheet, axis ORDER BY pos) AS g FROM (SELECT DISTINCT sheet_key AS sheet, axis, pos FROM label_points)) WHERE g > 1 GROUP BY ALL", "label_points"),
    "envelopes": cte("SELECT ordinal % 50 AS id, round(min(lon), 6) AS w, round(min(lat), 6) AS s, round(max(lon), 6) AS e, round(max(lat), 6) AS n FROM detections GROUP BY 1", "detections"),
    "historic_perimeters": cte("SELECT cornea_id AS guid, 2000 + ordinal % 27 AS year FROM fires WHERE -124 + ordinal % 50 <= -90 AND -123 + ordinal % 50 >= -120 AND 32 + ordinal % 15 <= 44 AND 33 + ordinal % 15 >= 34 AND ordinal % 27 >= 16 AND ordinal <> 21 ORDER BY year DESC, guid LIMIT 30", "fires"),
    # the line of the third round, which then drops what lies off it once more
    "label_fits": cte("SELECT sheet, axis, round(any_value(a), 4) AS a, round(any_value(b), 3) AS b, count(*) AS n FROM k3 GROUP BY ALL", "label_points", k0="SELECT sheet_key AS sheet, axis, pos, val FROM label_points", **{
        f"k{i + 1}": f"SELECT sheet, axis, pos, val, a, b FROM (SELECT *, median(r) OVER (PARTITION BY sheet, axis) AS m FROM (SELECT k.sheet, k.axis, k.pos, k.val, l.a, l.b, abs(k.val - l.a * k.pos - l.b) AS r FROM k{i} k JOIN (SELECT sheet, axis, regr_slope(val, pos) AS a, regr_intercept(val, pos) AS b FROM k{i} GROUP BY ALL) l USING (sheet, axis))) WHERE r <= greatest(3 * m, 1e-4)" for i in range(3)}),
}
