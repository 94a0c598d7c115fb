"""Incident files: diffs, revisions, manifests, queues and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from .order import with_place

MAX_BYTES = 200 << 20


def content_id(content: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substr(F.sha2(content, 256), F.lit(1), F.lit(16))


def first_wins(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Of equal keys the row that came first. Sums up before it shuffles."""
    kept = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), ordinal).alias("__r")).select(*keys, "__r.*")


def with_rev(versions: DataFrame, key: str, sha: str, order: str) -> DataFrame:
    """Revision number, one more each time the content id changes."""
    w = W.partitionBy(key).orderBy(order)
    change = F.when(F.lag(sha).over(w).isNull() | (F.lag(sha).over(w) != F.col(sha)), 1).otherwise(0)
    return versions.withColumn("__c", change).withColumn("rev", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__c")


def diff_files(listing: DataFrame, state: DataFrame, cap: int = MAX_BYTES) -> DataFrame:
    """New, changed, unchanged, too_big, or replayed (in the state only) for each (incident, rel)."""
    now, old = listing.alias("n"), state.alias("o")
    joined = now.join(old, ["incident", "rel"], "full_outer")
    kind = (
        F.when(F.col("n.etag").isNull() & F.col("n.size").isNull(), "replayed").when(F.col("n.size") > cap, "too_big").when(F.col("o.etag").isNull() & F.col("o.size").isNull(), "new")
        .when(F.col("n.etag").eqNullSafe(F.col("o.etag")) & F.col("n.size").eqNullSafe(F.col("o.size")), "unchanged").otherwise("changed")
    )
    return joined.select("incident", "rel", kind.alias("kind"))


def changed_dirs(candidates: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """C11: candidate folders, without those whose state has the same mtime and a match."""
    if force:
        return candidates
    same = state.filter("matched is not null").select("dir", F.col("mtime").alias("m"))
    return candidates.join(same, (candidates["dir"] == same["dir"]) & candidates["mtime"].eqNullSafe(same["m"]), "left_anti")


def replay_siblings(dirs: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """C20: unchanged folders of fires that are rebuilt in this run."""
    return dirs.join(rebuilt.select("fire").distinct(), "fire", "left_semi").join(rebuilt.select("dir"), "dir", "left_anti")


def replay_files(current: DataFrame, state: DataFrame) -> DataFrame:
    """This run's files and those mirrored before that it didn't see."""
    return current.unionByName(state.join(current.select("incident", "rel"), ["incident", "rel"], "left_anti"))


def unit_token_votes(files: DataFrame, year: int) -> DataFrame:
    """Incident ids in each folder's newest two dated subfolders, by votes, ties by first seen. files: dir, folder, name, ordinal."""
    days = files.withColumn("day", tx.daily_key(F.col("folder"))).filter("day is not null")
    newest = days.withColumn("k", F.dense_rank().over(W.partitionBy("dir").orderBy(F.col("day").desc()))).filter("k <= 2")
    votes = newest.select("dir", "ordinal", F.explode(tx.unit_tokens(F.col("name"), year)).alias("token")).groupBy("dir", "token").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    return votes.withColumn("rank", F.row_number().over(W.partitionBy("dir").orderBy(F.col("n").desc(), "first"))).drop("first")


def gather_unit_tokens(files: DataFrame, year: int) -> DataFrame:
    """Votes for incident ids from each folder's product, GIS and quick-reference subfolders, ties by first seen.

    files: dir, parent (products, gis or qr), parent_no (their order), day (the dated
    subfolder; null below qr), name, ordinal. Of a parent's days the newest counts,
    the one before only if nothing before it gave an id.
    """
    newest = F.dense_rank().over(W.partitionBy("dir", "parent_no").orderBy(F.col("day").desc_nulls_last()))
    dated = files.filter((F.lower("parent") == "qr") | (F.lower("parent").isin("products", "gis") & F.col("day").rlike(r"^\d{8}$")))
    listed = dated.withColumn("k", F.when(F.lower("parent") == "qr", 1).otherwise(newest)).filter("k <= 2")
    found = listed.withColumn("tokens", F.coalesce(tx.unit_tokens(F.col("name"), year), F.array().cast("array<string>")))
    units = found.groupBy("dir", "parent_no", "k").agg(F.sum(F.size("tokens")).alias("got"))
    before = F.coalesce(F.sum("got").over(W.partitionBy("dir").orderBy("parent_no", "k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = units.withColumn("before", before).filter("k = 1 or before = 0").select("dir", "parent_no", "k")
    seen = F.struct("parent_no", "k", "ordinal")
    votes = found.join(counted, ["dir", "parent_no", "k"]).select("dir", seen.alias("seen"), F.explode("tokens").alias("token")).groupBy("dir", "token").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first"))
    return votes.withColumn("rank", F.row_number().over(W.partitionBy("dir").orderBy(F.col("n").desc(), "first"))).drop("first")


def incident_summary(sheets: DataFrame, flights: DataFrame) -> DataFrame:
    """Per fire sheets, flights, latest valid day and latest upload instant."""
    both = sheets.select("fire", "day", "uploaded", F.lit(1).alias("s"), F.lit(0).alias("f")).unionByName(flights.select("fire", "day", "uploaded", F.lit(0).alias("s"), F.lit(1).alias("f")))
    return both.groupBy("fire").agg(
        F.sum("s").alias("map_count"), F.sum("f").alias("ir_count"), F.max(F.when(tx.valid_day(F.col("day")), F.col("day"))).alias("latest_upload"), F.max("uploaded").alias("latest_upload_ts"))


def merge_manifests(sheets: DataFrame, flights: DataFrame, dirs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Over the folders of a fire: the first copy of a sheet, the best copy of a flight (converted, then most links), the meta of the folder with most sheets."""
    best = flights.groupBy("fire", "flight_id").agg(F.max_by("dir", F.struct("converted", "links", -F.col("ordinal"))).alias("dir"))
    meta = dirs.groupBy("fire").agg(F.max_by("dir", F.struct("n_maps", -F.col("ordinal"))).alias("dir"))
    return first_wins(sheets, ["fire", "sha16"]), best, meta


def assemble_flights(files: DataFrame) -> DataFrame:
    """One row per flight folder: its first zip, pdf, kmz and notes, and the name the id comes from. files: incident, folder, name, ordinal."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    pick = lambda cond: F.min_by("name", F.when(cond, F.col("ordinal")))
    rows = files.groupBy("incident", "folder").agg(pick(ext == "zip").alias("zip"), pick(ext == "pdf").alias("pdf"), pick(ext == "kmz").alias("kmz"), pick(ext == "txt").alias("notes"))
    return rows.withColumn("named_by", F.coalesce("zip", "pdf", "kmz"))


def series_counts(sheets: DataFrame) -> DataFrame:
    """Versions of each map series that can be overlaid."""
    return sheets.filter("overlayable").groupBy("incident", "series").agg(F.count(F.lit(1)).alias("n"))


def run_totals(events: DataFrame) -> DataFrame:
    """Files, bytes and outcomes of a run."""
    skipped = [F.count_if(F.col("kind") == k).alias(k) for k in ("unchanged", "too_big", "deferred")]
    return events.agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), *skipped, F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))


def flight_backlog(files: DataFrame, attempts: DataFrame) -> DataFrame:
    """Fires with more convertible flight folders than attempted conversions."""
    convertible = files.filter(F.lower("name").rlike(r"\.(zip|kmz)$")).groupBy("fire").agg(F.count_distinct("folder").alias("have"))
    tried = attempts.groupBy("fire").agg(F.count_distinct("folder").alias("tried"))
    return convertible.join(tried, "fire", "left").filter(F.col("have") > F.coalesce("tried", F.lit(0))).select("fire", "have", F.coalesce("tried", F.lit(0)).alias("tried"))


def current_period(dirs: DataFrame, floor: str, cap: int) -> DataFrame:
    """E5: folders from the floor day on, newest first up to the cap; if there are none, the single newest. dirs: incident, key."""
    w = W.partitionBy("incident")
    fresh = F.count_if(F.col("key") >= floor).over(w)
    place = F.row_number().over(w.orderBy(F.col("key").desc()))
    rows = dirs.withColumns({"fresh": fresh, "place": place})
    return rows.filter(((F.col("fresh") > 0) & (F.col("key") >= floor) & (F.col("place") <= cap)) | ((F.col("fresh") == 0) & (F.col("place") == 1))).drop("fresh", "place")


def order_sheets(sheets: DataFrame) -> DataFrame:
    """per fire by day (newest first, undated last), product, day before night, name. Adds the position."""
    period = F.when(F.col("period") == "day", 0).when(F.col("period") == "night", 1).otherwise(2)
    w = W.partitionBy("incident").orderBy(F.col("op_date").desc_nulls_last(), tx.product_rank(F.col("product"), F.col("kind")), period, "filename")
    return sheets.withColumn("position", F.row_number().over(w))


def apply_budget(pending: DataFrame, budget: int) -> DataFrame:
    """the first sheets by priority become work within the budget, flat ones never count. pending: ordinal, base, flat, incident."""
    order = W.partitionBy("incident").orderBy(tx.tiling_priority(F.col("base")), "ordinal")
    used = F.sum(F.when(F.col("flat"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return pending.withColumn("work", F.col("flat") | (used <= budget))


def pending_sheets(files: DataFrame, tiled: DataFrame, shards: int, shard: int) -> DataFrame:
    """georeferenced, untiled sheets, one per content id, of one shard."""
    todo = files.filter("georeferenced").join(tiled, "sha16", "left_anti")
    return first_wins(todo, ["sha16"]).filter(tx.shard_of(F.col("sha16"), shards) == shard)


def keep_last(rows: DataFrame, n: int, partition: list[str], order: Column) -> DataFrame:
    """The last n rows of each group."""
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*partition).orderBy(order))).filter(F.col("__k") <= n).drop("__k")


def inactive(tracked: DataFrame, active: DataFrame) -> DataFrame:
    """Tracked incidents that aren't active."""
    return tracked.select("incident").exceptAll(active.select("incident"))


def union_days(a: Column, b: Column) -> Column:
    """Sorted union of two day sets."""
    return F.sort_array(F.array_union(a, b))


def changed_docs(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Documents whose tag differs from the cached one, or whose cached body is lost."""
    good = state.filter("cached").select("doc", F.col("etag").alias("old"))
    return docs.join(good, (docs["doc"] == good["doc"]) & (docs["etag"] == good["old"]), "left_anti")


def retryable(flights: DataFrame, attempts: DataFrame, version: int) -> DataFrame:
    """Flights never converted, or that failed under an older converter."""
    settled = attempts.filter(F.col("ok") | (F.col("version") >= version)).select("flight").distinct()
    return flights.join(settled, "flight", "left_anti")


def repair_queue(sheets: DataFrame, attempts: DataFrame, kind: str) -> DataFrame:
    """Broken sheets that this kind of repair hasn't been tried on."""
    return sheets.filter("broken").join(attempts.filter(F.col("kind") == kind), "sha16", "left_anti")


def adopt_markers(state: DataFrame, markers: DataFrame) -> DataFrame:
    """Tile sets that shards have finished enter the state; what the state has stays."""
    s, m = state.alias("s"), markers.alias("m")
    return s.join(m, "sha16", "left").select("sha16", F.coalesce("s.tiles", "m.tiles").alias("tiles"), (F.col("s.tiles").isNull() & F.col("m.tiles").isNotNull()).alias("adopted"))


def retention_candidates(state: DataFrame, active: DataFrame, now: Column, days: int) -> DataFrame:
    """Since when each tracked incident is inactive (cleared once it is active again), and whether that is longer than `days`. It only selects."""
    joined = state.join(active.select("incident", F.lit(True).alias("alive")), "incident", "left")
    since = F.when(F.col("alive"), F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce("inactive_since", now))
    return joined.select("incident", since.alias("inactive_since"), F.coalesce(F.datediff(now, since) >= days, F.lit(False)).alias("expired"))


def rank_candidates(dirs: DataFrame, fires: DataFrame, priority: list[str]) -> DataFrame:
    """Folders in work order: named ones first, then by the fire's acres and last update, unknown last, stable."""
    joined = dirs.join(fires.select("name", "acres", "last_updated"), "name", "left")
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("name"))
    named = F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(len(priority) + 1)
    return with_place(joined, "rank", named.asc(), F.col("acres").desc_nulls_last(), F.col("last_updated").desc_nulls_last(), F.col("ordinal").asc())


def asset_class(assets: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The first rule whose prefix an asset's key has, else the default of its path.

    The rules (a handful) become one array, a scalar subquery, so assets meet them
    in a projection: no join, no shuffle.
    """
    raw = F.when(F.col("key").startswith("raw/") & F.col("key").contains("/qr/"), "short").when(F.col("key").startswith("raw/"), "week").otherwise(default)
    ordered = rules.agg(F.sort_array(F.collect_list(F.struct("rank", "prefix", "cls")))).scalar()
    hit = F.filter("__rules", lambda r: F.startswith(F.col("key"), r["prefix"]))
    return assets.withColumn("__rules", ordered).select("key", F.coalesce(F.get(hit, F.lit(0))["cls"], raw).alias("cls"))


def throttle(events: DataFrame, per_minute: int = 30, per_session: int = 300) -> DataFrame:
    """Of each actor's events at most so many a minute (a window restarts at the first event over 60 s after its start) and in all.

    The running window can't be a tumbling one, so an actor's events fold in order,
    but a gap of over a minute always begins a new window: the events between two
    gaps fold on their own, and the bound for the session falls on what they keep.
    Batch form; the streaming form keeps the same state for each actor.
    """
    mine = W.partitionBy("actor").orderBy("ts", "ordinal")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(mine)) > 60_000_000
    bursts = events.withColumn("burst", F.sum(F.when(gap, 1).otherwise(0)).over(mine.rowsBetween(W.unboundedPreceding, 0)))
    steps = F.sort_array(F.collect_list(F.struct("ts", "ordinal")))
    start = F.struct(F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(0).alias("n"), F.array().cast("array<struct<ts:timestamp_ntz,ordinal:bigint>>").alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        fresh = acc["since"].isNull() | (micros(e["ts"]) - micros(acc["since"]) > 60_000_000)
        n = F.when(fresh, 0).otherwise(acc["n"])
        ok = n < per_minute
        one = F.when(ok, 1).otherwise(0)
        kept = F.when(ok, F.concat(acc["kept"], F.array(F.struct(e["ts"].alias("ts"), e["ordinal"].cast("bigint").alias("ordinal"))))).otherwise(acc["kept"])
        return F.struct(F.when(fresh, e["ts"]).otherwise(acc["since"]).alias("since"), (n + one).alias("n"), kept.alias("kept"))

    kept = bursts.groupBy("actor", "burst").agg(F.aggregate(steps, start, step, lambda acc: acc["kept"]).alias("k")).select("actor", F.inline("k"))
    return kept.withColumn("nth", F.row_number().over(mine)).filter(F.col("nth") <= per_session).select("actor", "ordinal")


def once_per_scope(events: DataFrame, reset: str) -> DataFrame:
    """Each (event, properties) once per scope of an actor; a reset event begins a new scope."""
    w = W.partitionBy("actor").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    scoped = events.withColumn("scope", F.sum(F.when(F.col("event") == reset, 1).otherwise(0)).over(w))
    return scoped.filter(F.col("event") != reset).groupBy("actor", "scope", "event", "properties").agg(F.min("ordinal").alias("ordinal"))


def fold_heartbeats(runs: DataFrame, keep: int = 40) -> tuple[DataFrame, DataFrame]:
    """Latest run of each job, and its last runs."""
    latest = runs.groupBy("job").agg(F.max_by("note", "finished_at").alias("note"), F.max("finished_at").alias("finished_at"))
    return latest, keep_last(runs, keep, ["job"], F.col("finished_at").desc())
