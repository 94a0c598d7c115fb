"""Expressions and operators on literal cases."""

from __future__ import annotations

import random
import re
import time
import statistics

from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.functions import text as tx
from emberline.functions import time as tm
from emberline.operators import detections, incidents, linkage, roster, weather


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_points_and_names(spark):
    assert one(spark, geo.parse_lat_lon(F.lit("45, -114"))) == (-114.0, 45.0)
    assert one(spark, geo.parse_lat_lon(F.lit("45"))) is None
    assert one(spark, geo.parse_lat_lon(F.lit("95, 0"), True)) is None
    assert one(spark, tx.slugify(F.lit("  Big Grass!"))) == "big-grass"
    assert one(spark, tx.normalize_name(F.lit("2026_HayCreekComplex"))) == "hay creek complex"
    assert one(spark, tx.normalize_name(F.lit("2026_Aspen%20Acres"))) == "aspen acres"
    assert one(spark, tx.normalize_name(F.lit("2026_P-L_Gulch"))) == "p l gulch"
    assert one(spark, tx.normalize_name(F.lit("2026_I5MM57NB"))) == "i5mm57nb"
    assert one(spark, tx.name_variants(F.lit("hay creek complex"))) == ["hay creek complex", "hay creek"]
    assert one(spark, tx.dir_rest(F.lit("2026_zFireName4/"), 2026)) is None
    assert round(one(spark, tx.indel_ratio(F.lit("big grass"), F.lit("big gras"))), 3) == 94.118


def test_product_filename(spark):
    r = one(spark, tx.parse_product_filename(F.lit("ops_arch_e_port_20260816_2100_Elk_COGMF000114_817day.pdf")))
    assert r.asDict() == {"product": "ops", "product_base": "ops", "sheet": "arch_e", "orientation": "port", "generated_at_local": "2026-08-16T21:00", "op_date": "2026-08-17", "period": "day", "unit_incident": "COGMF000114", "fire_name": "Elk"}
    assert one(spark, tx.parse_product_filename(F.lit("Read_Me.txt"))).product == "other"
    assert one(spark, tx.unit_tokens(F.lit("ops_20260816_2100_Elk_COGMF000114_817day.pdf"), 2026)) == ["2026-COGMF-000114"]
    assert one(spark, tx.daily_key(F.lit("07282026"))) == "20260728"
    assert one(spark, tx.size_bytes(F.lit("9.8M"))) == 10276044


def test_times_and_labels(spark):
    assert str(one(spark, tm.acq_instant(F.lit("2026-08-18"), F.lit("421.0")))) == "2026-08-18 04:21:00"
    assert [one(spark, tm.conf_norm(F.lit(x))) for x in ("l", "29", "30", "80", "", "junk", "High")] == ["low", "low", "nominal", "high", "nominal", "nominal", "high"]
    assert one(spark, tm.http_date(F.lit("junk"))) is None
    assert one(spark, tx.parse_coord(F.lit("118° 30' W"))) == ("lon", -118.5)
    assert one(spark, tx.parse_coord(F.lit("118° 60'"))) is None
    assert one(spark, tm.wmo_severity(F.lit(7))) == 28
    assert str(one(spark, tm.local_day(F.lit("2026-08-18 05:00:00").cast("timestamp_ntz"), F.lit("America/Los_Angeles")))) == "2026-08-17"


def test_local_days_where_clocks_change(spark):
    rows = spark.sql("select 1 as fire, 'America/Denver' as zone, timestamp_ntz'2026-11-01 06:00:00' as from_ts, timestamp_ntz'2026-11-02 06:00:00' as to_ts")
    days = detections.local_days(rows).collect()
    assert [(r.end_utc - r.start_utc).total_seconds() / 3600 for r in days] == [25.0]


def test_slug_assignment(spark):
    f = spark.createDataFrame([(1, "Elk", "CO", "a"), (2, "Elk", "CA", "b"), (3, "Elk", "CA", "c"), (4, None, "ID", "{X}")], "ordinal int, post_title string, state string, cornea_id string")
    assert [r.fire_slug for r in roster.assign_slugs(f).orderBy("ordinal").collect()] == ["elk", "elk-ca", "elk-2", "x"]


def plain_slugs(fires: list[tuple[str, str | None]]) -> list[str]:
    out, taken = [], {}
    for name, state in fires:
        base = "-".join(w for w in re.split("[^a-z0-9]+", name.lower()) if w)
        slug = base
        if base in taken:
            slug = f"{base}-{(state or 'xx').lower()}"
            if slug in taken:
                taken[base] += 1
                slug = f"{base}-{taken[base]}"
        taken.setdefault(slug, 1)
        out.append(slug)
    return out


def test_slugs_are_told_apart_for_any_state(spark):
    """States of any length and text, names that end in a state, a number or xx, chains of them, and words that only look like a state."""
    rng = random.Random(1)
    cases = [[("Elk", "CAL"), ("Elk", "CAL"), ("Elk Cal", "CAL")], [("Elk", "New-York"), ("Elk", "New-York"), ("Elk New York", "CO"), ("Elk", None), ("Elk xx", None), ("Elk", None)]]
    cases += [[(" ".join(["Elk", *rng.choices(["cal", "co", "2", "3", "creek", "xx", "new", "york"], k=rng.choice([0, 0, 1, 2]))]), rng.choice(["CAL", "CO", "New-York", "New York", None])) for _ in range(30)] for _ in range(6)]
    for fires in cases:
        rows = spark.createDataFrame([(i, n, st, "x") for i, (n, st) in enumerate(fires)], "ordinal int, post_title string, state string, cornea_id string")
        got = [r.fire_slug for r in roster.assign_slugs(rows).orderBy("ordinal").collect()]
        assert got == plain_slugs(fires), fires
        assert got[:3] == ["elk", "elk-cal", "elk-cal-cal"] or fires is not cases[0]


def test_wind_sampling_holds_edges_and_misses(spark):
    grid = spark.createDataFrame([(0, r, c, float(r), None if (r, c) == (1, 1) else float(c)) for r in range(2) for c in range(2)], "hour long, row int, col int, u double, v double")
    p = spark.createDataFrame([(1, 0, 0.5, 0.5), (2, 0, -3.0, 9.0)], "id long, hour long, fr double, fc double")
    got = {r.id: (r.u, r.v) for r in weather.sample_grid(p, grid, 2, 2).collect()}
    assert got == {1: (0.5, None), 2: (0.0, None)}


def test_throttle_restarts_at_first_event_after_a_minute(spark):
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 1, 2, 61, 62, 63])], "actor long, ordinal long, s int").select("actor", "ordinal", (F.timestamp_seconds("s")).cast("timestamp_ntz").alias("ts"))
    assert [r.ordinal for r in incidents.throttle(e, 2, 10).orderBy("ordinal").collect()] == [0, 1, 3, 4]


def test_label_fit_drops_strays(spark):
    p = spark.createDataFrame([(1, "lat", x, y) for x, y in [(100.0, 43.0), (300.0, 42.9), (500.0, 42.8), (700.0, 42.7), (410.0, 45.0)]], "sheet int, axis string, pos double, val double")
    r = linkage.fit_axes(p).first()
    assert (r.n, round(r.a, 6)) == (4, -0.0005)


def plain_fit(pairs: list[tuple[float, float]]) -> tuple[float, float, int]:
    for _ in range(3):
        mx, my = statistics.fmean(x for x, _ in pairs), statistics.fmean(y for _, y in pairs)
        a = sum((x - mx) * (y - my) for x, y in pairs) / sum((x - mx) ** 2 for x, _ in pairs)
        b = my - a * mx
        off = [abs(y - a * x - b) for x, y in pairs]
        pairs = [p for p, r in zip(pairs, off, strict=True) if r <= max(3 * statistics.median(off), 1e-4)]
    return a, b, len(pairs)


def test_the_line_of_the_last_round_stays(spark):
    """Strays large enough that every round still drops some: a fourth fit would give another line."""
    rng, made = random.Random(9), {}
    for sheet in range(20):
        made[sheet] = [(10.0 * i, 43 - 0.002 * i + rng.choice([0.0] * 6 + [0.5, 2.0, 8.0]) * rng.random() + 0.01 * rng.random()) for i in range(25)]
    p = spark.createDataFrame([(s, "lat", x, y) for s, own in made.items() for x, y in own], "sheet int, axis string, pos double, val double")
    got = {r.sheet: (r.a, r.b, r.n) for r in linkage.fit_axes(p).collect()}
    for sheet, own in made.items():
        a, b, n = plain_fit(own)
        assert got[sheet][2] == n and abs(got[sheet][0] - a) < 1e-9 and abs(got[sheet][1] - b) < 1e-6


def test_incident_cascade(spark):
    fires = spark.createDataFrame([(1, "Elk", "CO", "2026-COGMF-000114"), (2, "Hay Creek", "MT", "2026-MTX-000001"), (3, "Moose", "MT", "2026-MTX-000002"), (4, "Moose", "MT", "2026-MTX-000003")], "fire int, name string, state string, unique_fire_id string")
    dirs = spark.createDataFrame([("a", "Elk", "CO", "2026-COGMF-000114"), ("b", "HayCreekComplex", "MT", None), ("c", "Moose", "MT", None), ("d", "Hay Crek", "MT", None), ("e", "Elk", "CO", None)], "dir string, name string, state string, token string")
    pins = spark.createDataFrame([("e", "ignore")], "dir string, pin string")
    got = {r.dir: (r.fire, r.method) for r in linkage.match_incidents(dirs, fires, pins).collect()}
    assert got == {"a": (1, "unit_id"), "b": (2, "name_exact"), "d": (2, "name_fuzzy")}


def test_incident_names_by_variants_regions_and_ranked_ids(spark):
    fires = spark.createDataFrame(
        [(1, "Elk Creek", "CO", "2026-COGMF-000114"), (2, "Hay Ridge", "MT", None), (3, "Twin Peaks", "ID", "2026-IDX-000002"), (4, "Dry Gulch", "AZ", None), (5, "Dry Gulch", "CO", None), (6, "", "CO", None), (7, "Long Draw", None, None)],
        "fire int, name string, state string, unique_fire_id string")
    dirs = spark.createDataFrame(
        [("variants", "Elk Creeks Fire", None, "rocky_mtn", []), ("second state", "Twin Peak", None, "n_rockies", []), ("unknown region", "Hay Ridge", None, "elsewhere", []), ("no region", "Long Draw", None, None, []),
         ("outside", "Hay Ridge", None, "southern", []), ("one of two", "Dry Gulch", None, "southwest", []), ("two of two", "Dry Gulch", None, None, []), ("ranked", "zz", None, None, ["2026-NOONE-000001", "2026-idx-000002", "2026-COGMF-000114"]),
         ("empty", "", "CO", None, None)],
        "dir string, name string, state string, region string, tokens array<string>")
    got = {r.dir: (r.fire, r.method, r.score) for r in linkage.match_incidents(dirs, fires, spark.createDataFrame([], "dir string, pin string")).collect()}
    assert got == {
        "variants": (1, "name_fuzzy", 0.947), "second state": (3, "name_fuzzy", 0.947), "unknown region": (2, "name_exact", 0.95), "no region": (7, "name_exact", 0.95),
        "one of two": (4, "name_exact", 0.95), "ranked": (3, "unit_id", 1.0),
    }


def test_slugs_are_compared_by_normalised_names(spark):
    fires = spark.createDataFrame([(1, "HayCreek", "MT", None), (2, "O'Brien Draw", "CO", None)], "fire int, name string, state string, cornea_id string")
    slugs = spark.createDataFrame([("mt-hay-creek",), ("co-obrien-draw-500153",), ("mt-obrien-draw",)], "slug string")
    got = linkage.match_forecast_slugs(slugs, spark.createDataFrame([], "slug string, cornea_id string"), fires).collect()
    assert {r.slug: (r.fire, r.method) for r in got} == {"mt-hay-creek": (1, "name_fuzzy"), "co-obrien-draw-500153": (2, "name_fuzzy")}


def test_name_ratios_link_all_names_of_a_state_that_are_alike(spark):
    made = [(i, n, st) for i, (n, st) in enumerate([("elk creek", "CO"), ("elk creeks", "CO"), ("elk creek", "CO"), ("hay ridge", "CO"), ("elk creek", "MT"), ("", "CO"), ("", "CO"), (None, "CO"), ("elk", "CO")], 11)]
    got = {(r.a, r.b): round(r.ratio, 4) for r in linkage.name_pairs(spark.createDataFrame(made, "fire int, name string, state string")).collect()}
    assert got == {(11, 12): 94.7368, (11, 13): 100, (16, 17): 100}


def plain_ratio(a: str, b: str) -> float:
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_close_names_lose_no_pair_and_score_few(spark):
    """Against all pairs: names of a small alphabet, repeated letters, empty and short ones, and edits right at the bound."""
    rng = random.Random(11)
    names = {"", "a", "b", "aa", "ab", "a" * 29, "a" * 30, "a" * 33, "ab" * 12, "ab" * 13, "straße", "strasse", "漢字の山火事です", "漢字の山火事でした"}
    for _ in range(80):
        n = list("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 24))))
        names.add("".join(n))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(n) + 1)
            n[at : at + rng.choice([0, 1])] = rng.choice([[], ["x"]])
        names.add("".join(n))
    rows = spark.createDataFrame([(st, n) for n in sorted(names) for st in ("CO", "MT")], "state string, v string")
    other = rows.withColumnRenamed("v", "v2")
    want = {(st, a, b): plain_ratio(a, b) for a in names for b in names if plain_ratio(a, b) >= 90 for st in ("CO", "MT")}
    got = {(r.state, r.v, r.v2): r.ratio for r in linkage.close_names(rows, other, ["state"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    low = {(a, b) for a in names for b in names if plain_ratio(a, b) >= 80}
    assert {(r.v, r.v2) for r in linkage.close_names(rows.filter("state = 'CO'"), other, ["state"], 80.0).collect()} == low


def test_the_prefix_filter_compares_far_fewer_names_than_their_lengths_allow(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ser", "ton", "el", "ridge", "creek", "bu", "ha"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    names = sorted({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(600)})
    fires = spark.createDataFrame([("CO", n) for n in names], "state string, v string")
    other = fires.withColumnRenamed("v", "v2")
    by_length = fires.join(other, "state").filter("length(v2) between ceil(length(v) * 9 / 11) and floor(length(v) * 11 / 9)").count()
    met, scored = linkage.candidate_names(fires, other, ["state"]).select("v", "v2").distinct().count(), linkage.likely_names(fires, other, ["state"]).count()
    close = linkage.close_names(fires, other, ["state"]).count()
    assert len(names) <= close <= scored < 2 * close and met < by_length / 4 and scored < by_length / 50


def test_pins_hold_without_a_fire(spark):
    fires = spark.createDataFrame([(1, "Elk", "CO", "2026-COGMF-000114")], "fire int, name string, state string, unique_fire_id string")
    dirs = spark.createDataFrame([(d, "Elk", "CO", "2026-COGMF-000114") for d in "abcd"], "dir string, name string, state string, token string")
    pins = spark.createDataFrame([("a", "gone-fire"), ("b", "ignore"), ("c", "2026-COGMF-000114"), ("x", "gone-fire")], "dir string, pin string")
    got = {r.dir: (r.fire, r.method, r.pin) for r in linkage.match_incidents(dirs, fires, pins).collect()}
    assert got == {"a": (None, "override", "gone-fire"), "c": (1, "override", "2026-COGMF-000114"), "d": (1, "unit_id", None)}


def test_a_name_that_many_have_gives_no_pairs_of_all(spark):
    """Folders and fires of one name: one row for each folder, and none of them a match."""
    fires = spark.range(400).select(F.col("id").cast("int").alias("fire"), F.lit("Elk Creek").alias("name"), F.lit("CO").alias("state"), F.lit(None).cast("string").alias("unique_fire_id"))
    dirs = spark.range(400).select(F.col("id").alias("dir"), F.lit("Elk Creeks").alias("name"), F.lit("CO").alias("state"), F.lit(None).cast("string").alias("token"))
    assert linkage.match_incidents(dirs, fires, spark.createDataFrame([], "dir long, pin string")).count() == 0
    assert linkage.name_pairs(fires).count() == 399


def plain_pages(rows: list[tuple[str, int]], since: str, limit: int, pages: int) -> tuple[set[int], str, str | None]:
    """Page after page as a client would: ids taken, how it ended, and the day it stalled on or reached."""
    taken: set[int] = set()
    cursor = since
    for _ in range(pages):
        page = [(d, i) for d, i in sorted(rows) if d >= cursor][:limit]
        new = [d for d, i in page if i not in taken]
        taken |= {i for _, i in page}
        if len(page) < limit:
            return taken, "complete", None
        if not new or max(new) == cursor:
            return taken, "stalled", cursor
        cursor = max(new)
    return taken, "capped", cursor


def test_pages_equal_the_plain_loop(spark):
    rng = random.Random(8)
    now, made, state, want = F.lit("2024-02-20 12:00:00").cast("timestamp_ntz"), [], [], {}
    for fire in range(150):
        counts = [rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 11, 30]) for _ in range(rng.randint(0, 12))]
        own = [(f"2024-01-{d + 1:02}", fire * 1000 + d * 40 + k) for d, n in enumerate(counts) for k in range(n)]
        since = f"2024-01-{rng.randint(1, 6):02}"
        made += [(fire, i, d) for d, i in own]
        state.append((fire, since))
        want[fire] = plain_pages(own, since, 5, 4)
    rows, cursors = spark.createDataFrame(made, "fire int, ordinal int, acq_date string"), spark.createDataFrame(state, "fire int, cursor string")
    got: dict[int, set] = {}
    for r in detections.page_by_fire(rows, cursors, 5).collect():
        assert r.ordinal not in got.setdefault(r.fire, set())
        got[r.fire].add(r.ordinal)
    after = {r.fire: r for r in detections.next_cursors(rows, cursors, now, 5).collect()}
    assert {w[1] for w in want.values()} == {"complete", "stalled", "capped"}
    for fire, (taken, how, day) in want.items():
        assert got.get(fire, set()) == taken
        r = after[fire]
        next_day = "2024-02-19" if how == "complete" else day if how == "capped" else f"2024-01-{int(day[-2:]) + 1:02}"
        assert (r.cursor, r.stalled, r.stalled_day) == (next_day, how == "stalled", day if how == "stalled" else None)


def test_pages_stall_at_once_on_a_hot_day(spark):
    """Four pages of two: one row of the first day, two of the hot one, which stalls in the same sync and stays partial."""
    rows = spark.createDataFrame([(1, i, "2024-01-01" if i == 0 else "2024-01-02") for i in range(21)] + [(2, 50, "2024-01-02")], "fire int, ordinal int, acq_date string")
    cursors, now = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-09")], "fire int, cursor string"), F.lit("2024-01-06 12:00:00").cast("timestamp_ntz")
    page, after = detections.page_by_fire(rows, cursors, 2), detections.next_cursors(rows, cursors, now, 2)
    assert sorted((r.fire, r.ordinal) for r in page.collect()) == [(1, 0), (1, 1), (1, 2), (2, 50)]
    assert sorted(map(tuple, after.collect())) == [(1, "2024-01-03", True, "2024-01-02"), (2, "2024-01-05", False, None), (3, "2024-01-09", False, None)]
    days = {(r.fire, r.acq_date): (r.n, r.final) for r in detections.mark_synced(page, after, now).collect()}
    assert days == {(1, "2024-01-01"): (1, True), (1, "2024-01-02"): (2, False), (2, "2024-01-02"): (1, True)}


def test_histories_of_all_fires_equal_those_of_each(spark):
    """Perimeters from a point to a continent, boxes on cell edges, the fire itself, shapes that only their envelope meets."""
    rng, rows = random.Random(4), []
    for i in range(120):
        x, y, r = rng.choice([-120.0, -119.75, -119.6, -118.0, 0.0, 10.2]), rng.choice([40.0, 40.25, 41.1, -3.0]), rng.choice([0.0, 0.01, 0.25, 0.3, 1.0, 7.0, 90.0])
        ring = [[x + r, y], [x, y + r], [x - r, y], [x, y - r], [x + r, y]]
        rows.append((f"{{G{i}}}", 2010 + i % 17, x - r, y - r, x + r, y + r, [ring]))
    shapes = spark.createDataFrame(rows, "guid string, year int, w double, s double, e double, n double, rings array<array<array<double>>>")
    fires = [(k, f"g{k}", x - d, y - d, x + d, y + d) for k, (x, y, d) in enumerate([(-120.0, 40.0, 0.5), (-119.75, 40.25, 0.0), (-119.0, 40.5, 0.6), (0.0, 0.0, 2.0), (170.0, 80.0, 0.5)])]
    all_at_once = linkage.histories_of_fires(shapes, spark.createDataFrame(fires, "fire int, guid string, w double, s double, e double, n double"), 2026, 15)
    got = {}
    for r in all_at_once.collect():
        got.setdefault(r.fire, []).append((r.guid, r.year))
    for k, own, *box in fires:
        want = [(r.guid, r.year) for r in linkage.historic_perimeters(shapes, tuple(box), 2026, own, 15).collect()]
        assert sorted(got.get(k, [])) == sorted(want)
    plan = all_at_once._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_crowded_cell_is_dealt_out(spark):
    """Half of the rows on one spot, more crowded around it, boxes with edges on cells of every level: the rows of the fixed grid, and no key with much more than its share."""
    rng, rows = random.Random(5), []
    for i in range(2000):
        x, y = (-114.0, 44.0) if i % 2 else (-114 + rng.random() / 4, 44 + rng.random() / 4) if i % 3 else (-120 + 12 * rng.random(), 40 + 8 * rng.random())
        rows.append((i, x, y, f"2024-01-{1 + i % 9:02}"))
    d = spark.createDataFrame(rows, "ordinal int, lon double, lat double, acq_date string").withColumn("pad", F.lit("x"))
    boxes = [(1, "2024-01-03", -114.25, 43.75, -113.5, 44.5), (2, "2024-01-01", -114.0, 44.0, -114.0, 44.0), (3, "2024-01-01", -113.99, 44.001, -113.95, 44.02), (4, "2024-01-01", -119.0, 41.0, -115.0, 47.0), (5, "2024-01-01", 10.0, 10.0, 11.0, 11.0)]
    b = spark.createDataFrame(boxes, "fire int, since string, w double, s double, e double, n double").select("fire", "since", F.struct("w", "s", "e", "n").alias("box"))
    want = sorted((f, i) for i, x, y, day in rows for f, since, w, s, e, n in boxes if w <= x <= e and s <= y <= n and day >= since)
    for share in (1.0, 1 / 20, 1 / 100):
        assert sorted((r.fire, r.ordinal) for r in detections.detections_on_tree(d, b, share).collect()) == want
    assert sorted((r.fire, r.ordinal) for r in detections.detections_for_fires(d, b).collect()) == want
    crowded = detections.crowded_cells(d, 1 / 20)
    assert max(r.salts for r in crowded.collect()) >= 10 and crowded.count() < 20 * 5
    placed = detections._on_tree(d.withColumns({"cx": F.floor(F.col("lon") / 0.25), "cy": F.floor(F.col("lat") / 0.25)}), crowded, 4, lambda r, k: r.withColumns({"cx": F.floor(F.col("lon") * 2.0**k / 0.25), "cy": F.floor(F.col("lat") * 2.0**k / 0.25)}))
    keys = placed.withColumn("salt", F.pmod(F.xxhash64(*d.columns), F.col("salts"))).groupBy("level", "cx", "cy", "salt").count()
    assert placed.count() == 2000 and keys.agg(F.max("count")).first()[0] <= 2 * 2000 / 20


def test_fires_that_share_a_box_meet_its_detections_once(spark):
    """Shared boxes with other dates and zones, edges, a fire without detections: the rows of each fire on its own, and joins that don't grow with the fires of a box."""
    rows = [(i, -120 + i % 9 * 0.25, 40 + i % 7 * 0.125, f"2024-01-0{1 + i % 5}", i % 24) for i in range(400)]
    d = spark.createDataFrame(rows, "ordinal int, lon double, lat double, acq_date string, h int").withColumn("acq_ts", F.to_timestamp("acq_date").cast("timestamp_ntz") + F.make_interval(hours=F.col("h")))
    own = [(k, f"2024-01-0{1 + k % 4}", *((-120.0, 40.0, -119.0, 40.5) if k % 3 else (-119.5, 40.25, -118.75, 41.0)), ["UTC", "America/Denver"][k % 2]) for k in range(40)] + [(99, "2024-01-01", 10.0, 10.0, 11.0, 11.0, "UTC")]
    f = spark.createDataFrame(own, "fire int, since string, w double, s double, e double, n double, zone string")
    boxes, zones = f.select("fire", "since", F.struct("w", "s", "e", "n").alias("box")), f.select("fire", "zone")
    each = detections.detections_for_fires(d, boxes)
    told = lambda x: sorted(map(str, x.collect()))
    daily = detections.daily_counts_in_boxes(d, boxes, zones)
    assert told(daily) == told(detections.daily_counts(each, zones)) and daily.count() > 40
    assert told(detections.acquired_days_in_boxes(d, boxes)) == told(each.groupBy("fire", "acq_date").agg(F.count(F.lit(1)).alias("n")))
    assert told(detections.archive_index_in_boxes(d, boxes)) == told(detections.archive_index(each))
    assert detections._met_once(d, boxes, ["box"]).count() < 2 * 400 < each.count()


def test_histories_of_shared_boxes_and_shapes(spark):
    """Many fires in one box, perimeters of one guid that come before all others, guids without a value, equal shapes: the rows of each fire on its own, and few pairs of boxes and shapes."""
    rows = [(None if i % 50 == 0 else f"{{G{i % 7}}}" if i < 200 else f"{{H{i}}}", 2026 - i // 100, 0.0 + i % 3, 0.0, 1.0 + i % 3, 1.0) for i in range(400)]
    shapes = spark.createDataFrame(rows, "guid string, year int, w double, s double, e double, n double")
    fires = [(k, f"{{g{k}}}" if k < 9 else None, *((0.2, 0.2, 0.8, 0.8) if k % 2 else (1.2, 0.2, 2.8, 0.8))) for k in range(30)]
    for most in (1, 3, 40):
        got = {}
        for r in linkage.histories_of_fires(shapes, spark.createDataFrame(fires, "fire int, guid string, w double, s double, e double, n double"), 2026, most).collect():
            got.setdefault(r.fire, []).append((r.guid or "", -r.year))
        for k, own, w, s, e, n in fires:
            other = [(-y, g or "") for g, y, a, b, c, d in rows if a <= e and c >= w and b <= n and d >= s and (g is None or own is None or g.strip("{}").lower() != own.strip("{}"))]
            assert sorted((y, g) for g, y in got[k]) == sorted(other)[:most]
    assert linkage._newest_of_any(shapes.select(F.lit(1).alias("box"), "guid", "year"), ["box"], 3).count() == 6


def test_names_of_all_ratios_are_paired(spark):
    made = [(11, "elk creek", "CO"), (12, "elk ridge", "CO"), (13, "elk ridge", "CO"), (14, "elk ridge x", "MT"), (15, "elk", "CO")]
    got = {(r.a, r.b): round(r.ratio, 4) for r in linkage.name_pairs(spark.createDataFrame(made, "fire int, name string, state string"), None).collect()}
    assert got == {(11, 12): round(plain_ratio("elk creek", "elk ridge"), 4), (12, 13): 100}


def test_many_fires_of_a_root_are_named_in_a_step_each(spark):
    """A root of 30,000 fires with several names: a fold that copies what it has would take minutes."""
    names, states = ["Elk", "Elk co", "Elk 2", "Elk 7", "Elk xx", "Elk ut 3"], ["CO", "UT", None, "MT", "3"]
    fires = [(names[i * 7 % 11 % 6], states[i * 5 % 13 % 5]) for i in range(30000)]
    rows = spark.createDataFrame([(i, n, st, "x") for i, (n, st) in enumerate(fires)], "ordinal int, post_title string, state string, cornea_id string")
    began = time.time()
    got = [r.fire_slug for r in roster.assign_slugs(rows).orderBy("ordinal").collect()]
    assert got == plain_slugs(fires) and time.time() - began < 60


def test_names_are_normalised_once(spark):
    """Slugs and names made by expressions: filters on what comes of them don't copy these below the distinct rows and joins."""
    fires = spark.range(9).select(F.col("id").alias("fire"), F.concat(F.lit("Elk "), F.col("id").cast("string")).alias("name"), F.lit("CO").alias("state"), F.lit("x").alias("cornea_id"))
    slugs = fires.select(F.concat(F.lit("co-"), tx.slugify(F.col("name"))).alias("slug")).distinct()
    found = linkage.match_forecast_slugs(slugs, fires.select(F.lit("a-b").alias("slug"), "cornea_id").limit(0), fires)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 9 and plan.count("regexp_replace") < 150, plan.count("regexp_replace")


def _spots_met(spark, monkeypatch, join):
    """500 fires of one box and three dates, a fire without an id, one of its own box: rows of each fire, met by 2 boxes with dates alike and not by each fire."""
    rows = [(i, -120 + i % 7 / 10, 40 + i % 5 / 10, f"2024-01-{1 + i % 9:02}") for i in range(300)]
    d = spark.createDataFrame(rows, "ordinal int, lon double, lat double, acq_date string")
    fires = [*((k, f"2024-01-0{1 + k % 3}", -120.0, 40.0, -119.75, 40.25) for k in range(500)), (None, "2024-01-01", -120.0, 40.0, -119.75, 40.25), (900, "2024-01-05", -119.5, 40.25, -119.0, 41.0), (901, None, -120.0, 40.0, -119.0, 41.0)]
    b = spark.createDataFrame(fires, "fire int, since string, w double, s double, e double, n double").select("fire", "since", F.struct("w", "s", "e", "n").alias("box"))
    found, of_spots = [], detections._of_spots
    monkeypatch.setattr(detections, "_of_spots", lambda met, boxes: found.append(met) or of_spots(met, boxes))
    key = lambda r: (r[0] is None, r)
    want = sorted(((f, i) for f, since, w, s, e, n in fires if since for i, x, y, day in rows if w <= x <= e and s <= y <= n and day >= since), key=key)
    got = join(d, b)
    assert got.columns == [*d.columns, "fire"] and sorted(((r.fire, r.ordinal) for r in got.collect()), key=key) == want
    assert found[0].count() < 4 * len(rows) < len(want)


def test_fires_of_a_box_meet_detections_at_once(spark, monkeypatch):
    """F11"""
    _spots_met(spark, monkeypatch, detections.detections_for_fires)


def test_fires_of_a_box_meet_leaves_at_once(spark, monkeypatch):
    """F12"""
    _spots_met(spark, monkeypatch, lambda d, b: detections.detections_on_tree(d, b, 1 / 20))


def test_sources_are_chosen_before_fires_come_in(spark):
    """fires that share boxes, one with two boxes, without an id or without detections: the rows of a choice made on each row, and no exchange holds a row for each fire and detection."""
    rows = [(i, -120 + i % 7 / 10, 40 + i % 5 / 10, f"2024-01-{1 + i % 9:02}") for i in range(300)]
    d = spark.createDataFrame(rows, "ordinal int, lon double, lat double, acq_date string")
    alike = [(k, f"2024-01-0{1 + k % 3}", -120.0, 40.0, -119.75, 40.25) for k in range(400)] + [(1000 + k, "2024-01-09", -120.0, 40.25, -119.75, 40.5) for k in range(60)]
    fires = [*alike, (None, "2024-01-01", -120.0, 40.0, -119.75, 40.25), (900, "2024-01-09", -120.0, 40.25, -119.75, 40.5), (900, "2024-01-05", -119.5, 40.25, -119.0, 41.0), (901, "2024-01-01", 10.0, 10.0, 11.0, 11.0), (902, None, -120.0, 40.0, -119.0, 41.0)]
    b = spark.createDataFrame(fires, "fire int, since string, w double, s double, e double, n double").select("fire", "since", F.struct("w", "s", "e", "n").alias("box"))
    archived, direct = d.filter("ordinal % 2 = 0").withColumn("origin", F.lit("archive")), d.withColumn("origin", F.lit("direct"))
    each, counts = detections.detections_for_fires(d, b), detections.counts_in_boxes(d, b)
    told = lambda x: sorted(map(str, x.collect()))
    assert told(counts.filter("fire is not null")) == told(each.filter("fire is not null").groupBy("fire").agg(F.count(F.lit(1)).alias("n")))
    some = set()
    for least in (3, 20, 1000):
        index = counts.filter(F.col("n") >= least).select("fire")
        got = detections.detections_source_in_boxes(archived, direct, b, index)
        want = detections.detections_source(detections.detections_for_fires(archived, b), detections.detections_for_fires(direct, b), index)
        assert told(got.select(want.columns)) == told(want)
        some |= {(least, r.origin) for r in got.select("origin").distinct().collect()}
    assert {(20, "archive"), (20, "direct")} <= some


def test_a_tree_places_rows_in_one_pass(spark):
    """rows find their leaf without a shuffle or a join for each level, whether their cell, a quarter of it or only one spot is crowded; fires come in to rows that are dealt out."""
    rng, rows = random.Random(7), []
    for i in range(3000):
        x, y = (-114.0, 44.0) if i % 3 == 0 else (-114.25 + rng.random() / 2, 44 + rng.random() / 4) if i % 3 == 1 else (-120 + 12 * rng.random(), -4 + 8 * rng.random())
        rows.append((i, x, y, f"2024-01-{1 + i % 9:02}"))
    d = spark.createDataFrame(rows, "ordinal int, lon double, lat double, acq_date string")
    boxes = [(k, "2024-01-03", -114.25, 43.75, -113.5, 44.5) for k in range(40)] + [(50, "2024-01-01", -114.0, 44.0, -114.0, 44.0), (51, "2024-01-01", -114.1, 44.001, -113.95, 44.02), (52, "2024-01-01", -119.0, -3.5, -115.0, 3.5), (53, "2024-01-02", None, 43.0, -113.0, 45.0)]
    b = spark.createDataFrame(boxes, "fire int, since string, w double, s double, e double, n double").select("fire", "since", F.struct("w", "s", "e", "n").alias("box"))
    want = sorted((f, i) for i, x, y, day in rows for f, since, w, s, e, n in boxes if w is not None and w <= x <= e and s <= y <= n and day >= since)
    for share, splits, apart in ((1 / 64, 4, ["ordinal"]), (1 / 20, 2, None), (1 / 100, 0, ["ordinal"]), (1 / 256, 5, None)):
        assert sorted((r.fire, r.ordinal) for r in detections.detections_on_tree(d, b, share, splits, apart).collect()) == want
    crowded = detections.crowded_cells(d, 1 / 64).localCheckpoint()
    down = lambda r, k: r.withColumns({"cx": F.floor(F.col("lon") * 2.0**k / 0.25), "cy": F.floor(F.col("lat") * 2.0**k / 0.25)})
    placed = detections._on_tree(down(d, 0), crowded, 4, down)
    lines = placed._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count("Join") == 1 and placed.count() == 3000
    bad = {(r.level, r.cx, r.cy): r.salts for r in crowded.collect()}
    for r in placed.collect():
        cell = lambda k: (k, int(r.lon * 4 * 2**k // 1), int(r.lat * 4 * 2**k // 1))  # noqa: E731, B023
        first = next((k for k in range(5) if cell(k) not in bad), 4)
        assert ((r.level, r.cx, r.cy), r.salts) == (cell(first), bad.get(cell(first), 1))
    assert {0, 2, 4} <= {r.level for r in placed.select("level").distinct().collect()}
