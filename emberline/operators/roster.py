"""The fire roster: catalog build and merge, filters, sorting, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from .order import with_place

# Names of the states that the roster searches by.
STATE_NAMES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut", "DE": "delaware", "FL": "florida", "GA": "georgia",
    "HI": "hawaii", "ID": "idaho", "IL": "illinois", "IN": "indiana", "IA": "iowa", "KS": "kansas", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland",
    "MA": "massachusetts", "MI": "michigan", "MN": "minnesota", "MS": "mississippi", "MO": "missouri", "MT": "montana", "NE": "nebraska", "NV": "nevada", "NH": "new hampshire", "NJ": "new jersey",
    "NM": "new mexico", "NY": "new york", "NC": "north carolina", "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon", "PA": "pennsylvania", "RI": "rhode island", "SC": "south carolina",
    "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah", "VT": "vermont", "VA": "virginia", "WA": "washington", "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming",
    "DC": "district of columbia", "PR": "puerto rico",
}


def assign_slugs(fires: DataFrame) -> DataFrame:
    """Slugs, told apart. The first fire takes its name; one whose name is taken name-state (xx if unknown); if that is taken too, name-n.

    Whether a slug is taken depends on all fires before, but only fires of one
    root meet: the name without what a state or a number may have put behind it.
    Where a root has one name, windows give the places; only roots with several
    names (elk and elk-co) are folded in order. Fires have a unique ordinal.
    """
    base = F.coalesce(tx.slugify(F.col("post_title")), tx.slugify(F.col("cornea_id")), F.lit("unknown"))
    state = F.coalesce(F.nullif(F.lower("state"), F.lit("")), F.lit("xx"))
    named = fires.withColumns({"__base": base, "__state": state})
    named = named.join(_roots(named), "__base")
    root = W.partitionBy("__root")
    named = named.withColumn("__mixed", F.min("__base").over(root) != F.max("__base").over(root))
    by_name = W.partitionBy("__root", "__base").orderBy("ordinal")
    plain = named.filter("not __mixed").withColumn("__nth", F.row_number().over(by_name))
    plain = plain.withColumn("__in_state", F.row_number().over(W.partitionBy("__root", "__base", "__state", F.col("__nth") > 1).orderBy("ordinal")))
    first, by_state = F.col("__nth") == 1, (F.col("__nth") > 1) & (F.col("__in_state") == 1)
    rest = F.sum(F.when(first | by_state, 0).otherwise(1)).over(by_name.rowsBetween(W.unboundedPreceding, 0))
    slug = F.when(first, F.col("__base")).when(by_state, F.concat_ws("-", "__base", "__state")).otherwise(F.concat_ws("-", F.col("__base"), (rest + 1).cast("string")))
    mixed = named.filter("__mixed")
    in_order = mixed.select("__root", F.col("ordinal").cast("long").alias("__ordinal"), "__base", "__state").repartition("__root").sortWithinPartitions("__root", "__ordinal")
    folded = in_order.mapInArrow(_fold_slugs, "__ordinal long, fire_slug string")
    told = mixed.join(folded, F.col("ordinal") == F.col("__ordinal"))
    return plain.withColumn("fire_slug", slug).select(*fires.columns, "fire_slug").unionByName(told.select(*fires.columns, "fire_slug"))


def _roots(named: DataFrame) -> DataFrame:
    """__base and __root: the shortest other name that it could be a slug of, else itself.

    A slug is a name, maybe with a state or a number behind it, so a name can meet
    those it begins with if the rest are words of states that occur, or numbers.
    """
    bases = named.select("__base").distinct()
    words = named.select(F.explode(F.split("__state", "-")).alias("__word")).distinct().withColumn("__known", F.lit(True))
    parts = bases.select("__base", F.posexplode(F.split("__base", "-")).alias("__at", "__word")).join(words, "__word", "left")
    # the last word that no slug adds: a root has at least the words up to there
    own = F.max(F.when(~(F.coalesce("__known", F.lit(False)) | F.col("__word").rlike("^[0-9]+$")), F.col("__at") + 1))
    least = parts.groupBy("__base").agg(F.greatest(F.coalesce(own, F.lit(1)), F.lit(1)).alias("__least"), F.count(F.lit(1)).cast("int").alias("__words"))
    begins = least.select("__base", F.explode(F.sequence("__least", "__words")).alias("__n"))
    begins = begins.withColumn("__root", F.array_join(F.slice(F.split("__base", "-"), 1, F.col("__n")), "-"))
    return begins.join(bases.withColumnRenamed("__base", "__root"), "__root", "left_semi").groupBy("__base").agg(F.min_by("__root", "__n").alias("__root"))


def _fold_slugs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slugs of fires that come by root and in order (__root, __ordinal, __base, __state), a step for each.

    Kept of a root: the names and names with states that are taken, and how often a
    name needed a number; name-2 to name-n are taken by that.
    """
    at, taken, numbers = None, set(), {}

    def has(slug: str) -> bool:
        name, _, n = slug.rpartition("-")
        return slug in taken or (n.isdecimal() and n == str(int(n)) and 2 <= int(n) <= numbers.get(name, 1))

    for batch in batches:
        roots, bases, states = (batch.column(c).to_pylist() for c in ("__root", "__base", "__state"))
        slugs = []
        for root, base, state in zip(roots, bases, states, strict=True):
            if root != at:
                at, taken, numbers = root, set(), {}
            slug = base
            if has(base):
                slug = f"{base}-{state}"
                if has(slug):
                    numbers[base] = numbers.get(base, 1) + 1
                    slugs.append(f"{base}-{numbers[base]}")
                    continue
            taken.add(slug)
            slugs.append(slug)
        yield pa.RecordBatch.from_arrays([batch.column("__ordinal"), pa.array(slugs, pa.string())], names=["__ordinal", "fire_slug"])


def build_catalog(fires: DataFrame, incidents: DataFrame, spread: DataFrame, perimeters: DataFrame, archives: DataFrame) -> DataFrame:
    """Fires with their incident, forecast, perimeter and archive summaries, all keyed by fire. Joins are left to the planner."""
    joined = fires.join(incidents, "fire", "left").join(spread, "fire", "left").join(perimeters, "fire", "left").join(archives, "fire", "left")
    return joined.withColumns({
        "has_incident_maps": F.coalesce(F.col("map_count") > 0, F.lit(False)), "spread_run_count": F.coalesce("spread_run_count", F.lit(0)),
        "has_spread_forecast": F.coalesce(F.col("spread_run_count") > 0, F.lit(False)), "has_archive": F.col("archived").isNotNull(),
    })


def merge_roster(catalog: DataFrame, live: DataFrame) -> DataFrame:
    """Full outer merge by cornea_id. Live wins on name, state, acres, containment and activity, the catalog on created and slug; the newer perimeter stamp stays.

    Of repeated ids the catalog keeps the last row; live rows fold in order, each column by its own rule. A live row without a title is an unnamed fire.
    """
    last = lambda c, by="ordinal": F.max_by(c, by)
    cat = catalog.filter("cornea_id is not null").groupBy("cornea_id").agg(last(F.struct("post_title", "state", "acres", "containment", "created_on", "fire_slug", "poly_last_updated")).alias("c"))
    known = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ordinal")))
    alive = live.filter("cornea_id is not null").groupBy("cornea_id").agg(
        last(F.struct(F.coalesce(F.nullif("post_title", F.lit("")), F.lit("Unnamed fire")).alias("name"), F.nullif("state", F.lit("")).alias("state"))).alias("l"),
        known("acres").alias("acres"), known("containment").alias("containment"), F.max("poly_last_updated").alias("poly"))
    both = cat.join(alive, "cornea_id", "full_outer")
    return both.select(
        "cornea_id", F.coalesce("l.name", "c.post_title").alias("name"), F.coalesce("l.state", "c.state").alias("state"), F.coalesce(both["acres"], F.col("c.acres")).alias("acres"),
        F.coalesce(both["containment"], F.col("c.containment")).alias("containment"), F.col("l").isNotNull().alias("active"), F.col("c.created_on").alias("created_on"), F.col("c.fire_slug").alias("fire_slug"),
        F.greatest("poly", "c.poly_last_updated").alias("poly_last_updated"),
    )


def chip(name: str) -> Column:
    """A filter chip; an unknown containment counts as 0."""
    return {
        "forecast": F.coalesce(F.col("has_spread_forecast"), F.lit(False)), "maps": F.coalesce(F.col("has_incident_maps"), F.lit(False)),
        "large": F.coalesce(F.col("acres") > 1000, F.lit(False)), "uncontained": F.coalesce(F.col("containment"), F.lit(0)) < 50,
    }[name]


def matches_query(roster: DataFrame, query: str, name: str = "name", states: dict[str, str] = STATE_NAMES) -> DataFrame:
    """Name holds the query, or the state is it, or (from three letters on) the state's full name holds it. Blank keeps all."""
    q = query.strip().lower()
    if not q:
        return roster
    full = tx.lookup(F.upper("state"), states)
    found = F.lower(name).contains(q) | (F.lower("state") == q)
    if len(q) >= 3:
        found = found | full.contains(q)
    return roster.filter(F.coalesce(found, F.lit(False)))


def sort_roster(roster: DataFrame, key: str, descending: bool, name: str = "name") -> DataFrame:
    """by one key, unknown last in both directions, ties by name. Adds the position. A total order over the roster, one row per active fire."""
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    return with_place(roster, "position", order, F.lower(name).asc(), F.col("cornea_id").asc())


def roster_summary(roster: DataFrame) -> DataFrame:
    """Totals for the header."""
    return roster.agg(F.count(F.lit(1)).alias("total"), F.count_if("active").alias("active"), F.count_if(chip("forecast")).alias("with_forecast"), F.count_if(chip("maps")).alias("with_maps"))


def with_display_columns(roster: DataFrame, now: Column) -> DataFrame:
    """Acres and age as shown."""
    from ..functions.time import age_badge

    return roster.withColumns({"acres_text": tx.display_acres(F.col("acres")), "age_text": age_badge(F.col("created_on"), now)})


def resolve_ids(wanted: DataFrame, fires: DataFrame) -> DataFrame:
    """Wanted ids (column id) to cornea ids: by readable id, or GUIDs as they are."""
    keyed = fires.select(tx.readable_id(F.col("unique_fire_id")).alias("key"), "cornea_id")
    guid = F.col("id").rlike(r"^\{?[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}?$")
    found = wanted.join(keyed, F.lower("id") == F.col("key"), "left")
    return found.select("id", F.coalesce("cornea_id", F.when(guid, tx.norm_guid(F.col("id")))).alias("cornea_id"))


def spread_index(runs: DataFrame) -> DataFrame:
    """D3: latest run and number of runs of each fire; of runs at the same time the first listed."""
    return runs.groupBy("fire").agg(F.max_by("run_key", F.struct("run_time", -F.col("run_key"))).alias("latest"), F.count(F.lit(1)).alias("spread_run_count"))


def perimeter_counts(index: DataFrame, fires: DataFrame, cache: DataFrame) -> DataFrame:
    """Versions per fire, counted anew only where poly_last_updated differs from the cached one."""
    state = fires.select("fire", "poly").join(cache.select("fire", F.col("poly").alias("old"), F.col("n").alias("cached")), "fire", "left")
    state = state.withColumn("same", F.col("cached").isNotNull() & F.col("poly").eqNullSafe(F.col("old")))
    counted = index.join(state.filter("not same").select("fire"), "fire", "left_semi").groupBy("fire").agg(F.count(F.lit(1)).alias("counted"))
    return state.join(counted, "fire", "left").select("fire", F.when(F.col("same"), F.col("cached")).otherwise(F.coalesce("counted", "cached")).alias("n"))


def fire_overview(fires: DataFrame, sitrep: DataFrame, exposure: DataFrame, live: DataFrame) -> DataFrame:
    """C17: fire with report and exposure; the origin is the live one, else the catalog's."""
    joined = fires.join(sitrep, "fire", "left").join(exposure, "fire", "left").join(live.select("fire", F.col("fire_coordinates").alias("live_coordinates")), "fire", "left")
    return joined.withColumn("origin", F.coalesce("live_coordinates", "fire_coordinates")).drop("live_coordinates")


def exposure_rows(detail: DataFrame) -> DataFrame:
    """One row per fire and buffer from the nested array."""
    return detail.select("fire", F.inline("buffers"))


def exposure_pivot(detail: DataFrame, miles: list[int]) -> DataFrame:
    """One column of totals per buffer distance."""
    return exposure_rows(detail).groupBy("fire").pivot("miles", miles).agg(F.sum("homes"))


def stop_percent(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Place of each value between its group's least and greatest, in percent; 0 if they are the same."""
    w = W.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("percent", F.when(high > low, (F.col(value) - low) * 100 / (high - low)).otherwise(0.0))


def preserve_columns(new: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that this job doesn't own come from the previous catalog."""
    old = previous.select("fire", *(F.col(c).alias(f"__old_{c}") for c in columns))
    joined = new.drop(*columns).join(old, "fire", "left")
    return joined.select(*[c for c in new.columns if c not in columns], *(F.col(f"__old_{c}").alias(c) for c in columns))


def heal_counts(state: DataFrame, manifests: DataFrame) -> DataFrame:
    """I16: unknown counts are taken from the published manifests; a matched incident without a manifest is queued again."""
    joined = state.join(manifests.select("fire", F.col("map_count").alias("published")), "fire", "left")
    return joined.select("fire", F.coalesce("map_count", "published").alias("map_count"), (F.col("matched") & F.col("published").isNull()).alias("requeue"))


def stalest_first(fires: DataFrame) -> DataFrame:
    """Work order: the longest unsynced first (never synced before all), then the larger fire."""
    return with_place(fires, "rank", F.col("synced").asc_nulls_first(), F.coalesce("acres", F.lit(0)).desc(), F.col("fire").asc())


def timeline_domain(fires: DataFrame, runs: DataFrame, weather: DataFrame, now: Column) -> DataFrame:
    """H5: from the fire's creation (else a week ago) to the last of run end, weather end and five days ahead."""
    joined = fires.join(runs, "fire", "left").join(weather, "fire", "left")
    start = F.coalesce("created_on", now - F.expr("INTERVAL 7 DAYS"))
    return joined.select("fire", start.alias("start"), F.greatest("run_end", "weather_end", now + F.expr("INTERVAL 5 DAYS")).alias("end"))
