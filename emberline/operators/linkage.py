"""Linking feeds to fires by id, name and fuzzy name; situation reports; map-margin labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

FUZZY, EXACT = 90.0, 0.95
# Fields of a report row in order.
ROW = (
    r"([A-Z]{2}-[A-Z0-9]{2,5})\s+([\d,]+)\s+(-?[\d,]+|---|UNK)\s+(\d{1,3}|---|UNK)\s+(Ctn|Comp)\s+(\d{1,2}/\d{1,2}|UNK|---|NR)\s+([\d,]+|---)\s+(-?[\d,]+|---|UNK)\s+"
    r"(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d.,]+[KMB]?|UNK|NR|---)\s+([A-Z]{2,8})\s*$"
)
COUNTS = ["acres", "acres_change", "contained_pct", "", "", "personnel", "personnel_change", "crews", "engines", "helicopters", "structures_lost"]


#: Fixed values. States of a region (geographic area coordination centre); a region that isn't listed sets no limit.
REGION_STATES = {
    "alaska": "AK", "calif_n": "CA", "calif_s": "CA", "california_statewide": "CA", "eastern": "MN WI MI IA IL IN OH MO NH VT ME MA CT RI NY NJ PA DE MD WV",
    "great_basin": "NV UT ID WY AZ", "n_rockies": "MT ND ID", "pacific_nw": "OR WA", "pacific_nw_oregon": "OR", "pacific_nw_washington": "WA", "rocky_mtn": "CO WY SD NE KS",
    "southern": "TX OK AR LA MS AL GA FL SC NC TN KY VA PR", "southwest": "AZ NM TX",
}
ANYWHERE = "*"


def _pools(dirs: DataFrame, regions: dict[str, str]) -> Column:
    """The states whose fires a folder may be: those of its region, else its own state; ANYWHERE if neither is known."""
    states = F.array("state")
    if "region" in dirs.columns:
        known = F.create_map(*(x for k, v in regions.items() for x in (F.lit(k), F.split(F.lit(v), " "))))
        states = F.when(F.col("region").isNull(), states).otherwise(F.try_element_at(known, F.col("region")))
    states = F.filter(states, lambda x: x.isNotNull())
    return F.when(F.size(states) > 0, states).otherwise(F.array(F.lit(ANYWHERE)))


def match_incidents(dirs: DataFrame, fires: DataFrame, overrides: DataFrame, regions: dict[str, str] = REGION_STATES) -> DataFrame:
    """Folder to fire: pins, then the incident ids its files vote for, then a name variant that only one fire has, then the best fuzzy name of 90 and more.

    dirs: dir, name, state, token, and if there are any region (its states stand
    for the state) and tokens (ids by falling votes, instead of token); fires:
    fire, name, state, unique_fire_id; overrides: dir, pin ('ignore' drops the
    folder). Returns dir, fire, method, score and pin: a pin holds also where no
    fire has it (fire is null then). The first voted id that a fire has wins.
    Several exact hits or a tied best score reject the folder. A folder without
    region and state may be a fire of any state.

    All stages put their candidates side by side and the first stage of a folder
    counts. Names meet once: folders and fires are joined as distinct names, of
    which the smallest and the largest fire tell whether one fire alone has them,
    so a name that many share costs one row; a score of 100 is the exact hit.
    """
    ids = fires.select("fire", F.upper("unique_fire_id").alias("token"))
    found = lambda stage, fire, method, score, pin=F.lit(None).cast("string"): ("dir", F.lit(stage).alias("stage"), F.struct(fire.alias("fire"), method.alias("method"), score.alias("score"), pin.alias("pin")).alias("m"))
    pinned = overrides.join(dirs.select("dir"), "dir", "left_semi").join(fires.groupBy(F.col("unique_fire_id").alias("pin")).agg(F.min("fire").alias("fire")), "pin", "left")
    by_pin = pinned.select(*found(0, F.col("fire"), F.when(F.col("pin") != "ignore", "override"), F.lit(1.0), F.col("pin")))
    voted = dirs.select("dir", F.posexplode(F.col("tokens") if "tokens" in dirs.columns else F.array("token")).alias("k", "token")).withColumn("token", F.upper("token"))
    by_id = voted.join(ids, "token").groupBy("dir").agg(F.min_by("fire", F.struct(F.col("k"), -F.col("fire"))).alias("fire")).select(*found(1, F.col("fire"), F.lit("unit_id"), F.lit(1.0)))
    forms = dirs.select("dir", F.explode(_pools(dirs, regions)).alias("pool"), F.explode(tx.name_variants(tx.normalize_name(F.col("name")))).alias("v")).filter("v <> ''")
    known = fires.select("fire", "state", F.explode(tx.name_variants(tx.normalize_name(F.col("name")))).alias("v2")).filter("v2 <> ''")
    known = known.select("fire", F.explode(F.array(F.col("state"), F.lit(ANYWHERE))).alias("pool"), "v2").filter("pool is not null").groupBy("pool", "v2").agg(F.min("fire").alias("low"), F.max("fire").alias("high"))
    best = lambda rows, *keys: rows.groupBy(*keys, "score").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy(*keys).agg(F.max_by(F.struct("score", "low", "high"), "score").alias("b")).select(*keys, "b.*")
    names = best(close_names(forms.select("pool", "v").distinct(), known.select("pool", "v2"), ["pool"]).join(known, ["pool", "v2"]).withColumnRenamed("ratio", "score"), "pool", "v")
    alone = best(forms.join(names, ["pool", "v"]), "dir").filter("low = high")
    exact = F.col("score") == 100
    by_name = alone.select(*found(2, F.col("low"), F.when(exact, "name_exact").otherwise("name_fuzzy"), F.when(exact, EXACT).otherwise(F.bround(F.col("score") / 100, 3))))
    first = by_pin.unionByName(by_id).unionByName(by_name).groupBy("dir").agg(F.min_by("m", "stage").alias("m"))
    return first.select("dir", "m.*").filter("method is not null")


def allowed_lengths(n: Column) -> Column:
    """The lengths of names that can reach a ratio of FUZZY with a name of length n."""
    return F.when(n > 0, F.sequence(F.ceil(n * 9 / 11).cast("int"), F.floor(n * 11 / 9).cast("int")))


def with_grams(rows: DataFrame, name: str, grams: str) -> DataFrame:
    """rows with the pairs of neighbouring characters of a name, ends included, each with its number among its equals, so that the array is a set."""
    marked = F.concat(F.lit("\x01"), F.col(name), F.lit("\x02"))
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substring(marked, i, F.lit(2))))
    # a column of its own, so that the sorted pairs are made once and not for each of them
    number = lambda x, i: F.concat(x, (i + 2 - F.array_position("__pairs", x)).cast("string"))
    return rows.withColumn("__pairs", pairs).withColumn(grams, F.transform("__pairs", number)).drop("__pairs")


def _edits(total: Column, least: float) -> Column:
    """Characters to insert and delete, at most, for a ratio of `least` between names of so many characters together."""
    return F.floor(total * ((100 - least) / 100) + 1e-9)


def candidate_names(left: DataFrame, right: DataFrame, keys: list[str], least: float = FUZZY) -> DataFrame:
    """keys, v, v2 and the grams of both: names v of left and v2 of right, of equal keys, that may reach `least`, once for each gram they meet at. Both sides have distinct rows.

    With d characters inserted or deleted, i of them deleted from a, at most d + i
    of a's grams aren't in b: a deletion spoils two of a's pairs, an insertion one.
    So of any d + i + 1 grams of a one is in b, and the rarest ones are taken on
    both sides (prefix filter): no pair is lost, and common grams never meet.
    """
    left, right = with_grams(left.select(*keys, "v"), "v", "__a"), with_grams(right.select(*keys, "v2"), "v2", "__b")
    rare = right.select(F.explode("__b").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("__n"))

    def prefix(rows: DataFrame, name: str, own: str) -> DataFrame:
        n = F.length(name)
        spoilt = lambda m: F.floor((3 * _edits(n + m, least) + n - m) / 2)
        sizes = F.sequence(F.ceil(n * (least / (200 - least)) - 1e-9).cast("int"), F.floor(n * ((200 - least) / least) + 1e-9).cast("int"))
        grams = rows.select(*keys, name, own, (F.array_max(F.transform(sizes, spoilt)) + 1).alias("__take"), F.explode(own).alias("gram"))
        place = F.row_number().over(W.partitionBy(*keys, name).orderBy(F.coalesce("__n", F.lit(0)), "gram"))
        return grams.join(rare, "gram", "left").withColumn("__k", place).filter("__k <= __take").select(*keys, name, own, "gram")

    met = prefix(left, "v", "__a").join(prefix(right, "v2", "__b"), [*keys, "gram"])
    longer, shorter = F.greatest(F.length("v"), F.length("v2")), F.least(F.length("v"), F.length("v2"))
    return met.filter(longer - shorter <= _edits(F.length("v") + F.length("v2"), least)).select(*keys, "v", "v2", "__a", "__b")


def likely_names(left: DataFrame, right: DataFrame, keys: list[str], least: float = FUZZY) -> DataFrame:
    """keys, v, v2: candidates that also pass two cheap tests which no pair of that ratio fails: grams they share, and a Levenshtein distance within the bound, as it is never above the number of insertions and deletions."""
    total = F.length("v") + F.length("v2")
    edits = _edits(total, least)
    shared = F.size(F.array_intersect("__a", "__b")) >= 1 + F.ceil((total - 3 * edits) / 2)
    return candidate_names(left, right, keys, least).filter(shared).filter(F.levenshtein("v", "v2") <= edits).select(*keys, "v", "v2").distinct()


def close_names(left: DataFrame, right: DataFrame, keys: list[str], least: float = FUZZY) -> DataFrame:
    """keys, v, v2, ratio: pairs of names with an indel ratio of `least` or more."""
    return likely_names(left, right, keys, least).withColumn("ratio", tx.indel_ratio(F.col("v"), F.col("v2"))).filter(F.col("ratio") >= least)


def name_pairs(fires: DataFrame, least: float | None = FUZZY) -> DataFrame:
    """Fires of a state whose names are alike by a ratio of `least` or more, as links a, b, ratio (a < b). fires: fire, name, state.

    Without `least` all names whose lengths allow a ratio of FUZZY are linked,
    whatever their ratio: as many rows as there are such pairs of different names.

    The first fire of each name stands for it: names are linked between those, and
    the other fires of a name hang on its first one at 100. Nothing is lost, and a
    name that many fires have gives as many rows as fires.
    """
    named = fires.filter("name is not null and state is not null").groupBy("state", "name").agg(F.min("fire").alias("first"))
    one = named.select("state", F.col("name").alias("v"))
    two = one.withColumnRenamed("v", "v2")
    if least is None:
        sized = one.withColumn("size", F.explode(allowed_lengths(F.length("v"))))
        close = sized.join(two.withColumn("size", F.length("v2")), ["state", "size"]).filter("v < v2").select("state", "v", "v2", tx.indel_ratio(F.col("v"), F.col("v2")).alias("ratio"))
    else:
        close = close_names(one, two, ["state"], least).filter("v < v2")
    first = lambda k, n: named.select("state", F.col("name").alias(n), F.col("first").alias(k))
    links = close.join(first("f", "v"), ["state", "v"]).join(first("g", "v2"), ["state", "v2"]).select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b"), "ratio")
    members = fires.join(named, ["state", "name"]).filter("fire <> first").select(F.col("first").alias("a"), F.col("fire").alias("b"), F.lit(100.0).alias("ratio"))
    return links.unionByName(members)


def _once(c: Column) -> Column:
    """The column as a generator of one row: computed once and here, as the planner neither copies it into filters nor moves these below joins and distinct rows."""
    return F.explode(F.array(c))


def match_forecast_slugs(slugs: DataFrame, documents: DataFrame, fires: DataFrame) -> DataFrame:
    """C4: forecast slug ('st-name' or 'st-name-number', 4 to 6 digits) to fire, with method and score.

    By the id document first. Else, among the fires of the slug's state, by the
    exact slug of a name that one fire has, without the number first, then whole;
    if the slug's number is the fire's incident number, or ends in it, the match is
    certain (unit_num). Else the best fuzzy score of 90 and more over normalised
    names, the first fire of equals. fires: fire, name, state, cornea_id and, if
    there is one, unique_fire_id.
    """
    ids = documents.select("slug", tx.norm_guid(F.col("cornea_id")).alias("guid"))
    uid = F.col("unique_fire_id") if "unique_fire_id" in fires.columns else F.lit(None).cast("string")
    slugs = slugs.select(_once(F.col("slug")).alias("slug"))
    own = fires.select("fire", "name", "state", tx.norm_guid(F.col("cornea_id")).alias("guid"), tx.slugify(F.col("name")).alias("form"), F.element_at(F.split(uid, "-"), -1).try_cast("long").alias("incident"))
    found = lambda stage, fire, method, score: ("slug", F.lit(stage).alias("stage"), F.struct(fire.alias("fire"), method.alias("method"), score.alias("score")).alias("m"))
    by_doc = slugs.join(ids, "slug").join(own.select("guid", "fire"), "guid").groupBy("slug").agg(F.min("fire").alias("fire")).select(*found(0, F.col("fire"), F.lit("document"), F.lit(1.0)))
    head = F.substring_index("slug", "-", 1)
    split = slugs.filter(F.contains("slug", F.lit("-"))).select("slug", F.upper(head).alias("state"), F.substr("slug", F.length(head) + 2).alias("whole"))
    split = split.withColumns({"number": F.regexp_extract("whole", r"-([0-9]{4,6})$", 1).try_cast("long"), "bare": F.regexp_replace("whole", r"-[0-9]{4,6}$", "")})
    unique = own.groupBy("state", "form").agg(F.min("fire").alias("fire"), F.min("incident").alias("incident"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    tries = split.select("slug", "state", "number", F.posexplode(F.array_distinct(F.array("bare", "whole"))).alias("k", "form"))
    hits = tries.join(unique, ["state", "form"]).groupBy("slug").agg(F.min_by(F.struct("fire", "number", "incident"), "k").alias("h"))
    sure = F.coalesce(F.endswith(F.col("h.number").cast("string"), F.col("h.incident").cast("string")), F.lit(False))
    exact = hits.select(*found(1, F.col("h.fire"), F.when(sure, "unit_num").otherwise("name_exact"), F.when(sure, 1.0).otherwise(EXACT)))
    forms = split.select("slug", "state", _once(tx.normalize_name(F.replace("bare", F.lit("-"), F.lit(" ")))).alias("v")).filter("v <> ''")
    named = own.filter("state is not null").groupBy("state", "name").agg(F.min("fire").alias("fire"))
    known = named.select("fire", "state", _once(tx.normalize_name(F.col("name"))).alias("v2")).filter("v2 <> ''").groupBy("state", "v2").agg(F.min("fire").alias("fire"))
    close = close_names(forms.select("state", "v").distinct(), known.select("state", "v2"), ["state"]).join(known, ["state", "v2"])
    best = close.groupBy("state", "v").agg(F.max_by(F.struct("fire", "ratio"), F.struct("ratio", -F.col("fire"))).alias("b"))
    fuzzy = forms.join(best, ["state", "v"]).select(*found(2, F.col("b.fire"), F.lit("name_fuzzy"), F.bround(F.col("b.ratio") / 100, 3)))
    return by_doc.unionByName(exact).unionByName(fuzzy).groupBy("slug").agg(F.min_by("m", "stage").alias("m")).select("slug", "m.*")


def parse_sitrep_lines(lines: DataFrame) -> DataFrame:
    """Typed rows of report lines (report, line_no, line; without report all lines are one report, read in one task); a row without a name takes the nearest of the two lines before that isn't a row itself."""
    w = W.partitionBy("report").orderBy("line_no") if "report" in lines.columns else W.orderBy("line_no")
    is_row = F.col("line").rlike(ROW)
    strip = lambda c: F.regexp_replace(c, r"^[ *]+|[ *]+$", "")
    before = [F.when(~F.lag(is_row, k).over(w), F.nullif(strip(F.lag("line", k).over(w)), F.lit(""))) for k in (1, 2)]
    rows = lines.withColumn("carried", F.coalesce(*before)).filter(is_row)
    field = lambda k: F.regexp_extract("line", ROW, k)
    number = lambda k: F.replace(field(k), F.lit(","), F.lit("")).try_cast("long")
    own = F.nullif(strip(F.regexp_extract("line", r"^(.*?)" + ROW, 1)), F.lit(""))
    out = rows.select(
        "line_no", F.coalesce(own, "carried").alias("name"), field(1).alias("unit"), *(number(i + 2).alias(c) for i, c in enumerate(COUNTS) if c),
        field(5).alias("containment_kind"), F.when(field(6).contains("/"), field(6)).alias("est_containment"), F.when(~field(13).isin("UNK", "NR", "---"), field(13)).alias("cost_to_date"), field(14).alias("owner"),
    )
    return out.filter("name is not null")


def parse_narratives(texts: DataFrame) -> DataFrame:
    """Paragraphs between blank lines, flattened, under the normalised name they begin with (up to the first comma); the first of a name wins."""
    paragraphs = texts.select("doc", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "p"))
    flat = F.trim(F.regexp_replace("p", r"\s+", " "))
    keyed = paragraphs.select("doc", "pos", flat.alias("narrative")).withColumn("name", tx.normalize_name(F.regexp_extract("narrative", r"^([^,.]{1,60})[,.]", 1))).filter("name <> ''")
    return keyed.groupBy("name").agg(F.min_by("narrative", F.struct("doc", "pos")).alias("narrative"))


def match_sitrep(rows: DataFrame, fires: DataFrame, narratives: DataFrame) -> DataFrame:
    """Report row to fire by normalised name and state; of fires alike the first, of rows alike the last; the narrative comes by name."""
    r = rows.withColumns({"key": tx.normalize_name(F.col("name")), "state": F.substr("unit", F.lit(1), F.lit(2))})
    last = r.groupBy("key", "state").agg(F.max_by(F.struct("line_no", "acres", "personnel"), "line_no").alias("r"))
    first = fires.withColumn("key", tx.normalize_name(F.col("name"))).groupBy("key", "state").agg(F.min_by("fire", "ordinal").alias("fire"))
    named = narratives.select(F.col("name").alias("key"), "narrative")
    return last.join(first, ["key", "state"]).join(named, "key", "left").select("fire", "r.*", "narrative")


def median_spacing(points: DataFrame) -> DataFrame:
    """Median gap (over 1) between a sheet's sorted distinct label places."""
    gaps = points.select("sheet", "axis", "pos").distinct().withColumn("gap", F.col("pos") - F.lag("pos").over(W.partitionBy("sheet", "axis").orderBy("pos")))
    return gaps.filter("gap > 1").groupBy("sheet", "axis").agg(F.percentile("gap", F.lit(0.5)).alias("spacing"))


#: Labels an axis needs, the largest error of its line in degrees, degrees a frame spans, and where its middle lies.
MIN_LABELS, RMS_MAX, SPAN, LON_RANGE, LAT_RANGE = 3, 0.005, (0.02, 6.0), (-170.0, -60.0), (15.0, 72.0)


def fit_axes(points: DataFrame, rounds: int = 3) -> DataFrame:
    """Per sheet and axis the line of the last round, and what the rounds kept: n, distinct values, rms, first and last place, spacing.

    A round fits a line by least squares and drops what lies off it by over three
    median residuals and 1e-4; after the last round the line stays as it is.
    """
    keys = ["sheet", "axis"]
    w, kept = W.partitionBy(*keys), points.select(*keys, "pos", "val")
    for _ in range(rounds):
        fit = kept.withColumns({"a": F.regr_slope("val", "pos").over(w), "b": F.regr_intercept("val", "pos").over(w)})
        fit = fit.withColumn("r", F.abs(F.col("val") - F.col("a") * F.col("pos") - F.col("b")))
        kept = fit.withColumn("middle", F.percentile("r", F.lit(0.5)).over(w)).filter("r <= greatest(3 * middle, 1e-4)").drop("r", "middle")
    spaced = median_spacing(kept.select(*keys, F.round("pos", 1).alias("pos")))
    fits = kept.groupBy(*keys).agg(
        F.first("a").alias("a"), F.first("b").alias("b"), F.count(F.lit(1)).alias("n"), F.count_distinct("val").alias("values"), F.sqrt(F.avg(F.pow(F.col("val") - F.col("a") * F.col("pos") - F.col("b"), 2))).alias("rms"),
        F.min("pos").alias("low"), F.max("pos").alias("high"))
    return fits.join(spaced, keys, "left").withColumn("spacing", F.coalesce("spacing", F.lit(0.0)))


def accepted_fits(points: DataFrame, pages: DataFrame) -> DataFrame:
    """Sheets whose two axes pass the gates, with lines, frame on the page and its bounds. pages: sheet, width, height.

    Gates: three labels of two values on each axis, a small error, north up, a
    frame of plausible span and middle. The frame reaches half a spacing (one
    hundredth of the page at least) beyond the outermost labels, within the page.
    """
    good = fit_axes(points).filter((F.col("n") >= MIN_LABELS) & (F.col("values") >= 2) & (F.col("rms") <= RMS_MAX))
    side = lambda axis: good.filter(F.col("axis") == axis).select("sheet", *(F.col(c).alias(f"{axis}_{c}") for c in ("a", "b", "n", "low", "high", "spacing")))
    both = side("lon").join(side("lat"), "sheet").join(pages, "sheet").filter("lat_a < 0 and lon_a > 0")
    pad = lambda axis, size: F.greatest(F.col(size) * 0.01, F.col(f"{axis}_spacing") * 0.5)
    framed = both.withColumns({
        "x0": F.greatest(F.lit(0.0), F.col("lon_low") - pad("lon", "width")), "x1": F.least(F.col("width"), F.col("lon_high") + pad("lon", "width")),
        "y0": F.greatest(F.lit(0.0), F.col("lat_low") - pad("lat", "height")), "y1": F.least(F.col("height"), F.col("lat_high") + pad("lat", "height")),
    })
    at = lambda axis, place: F.col(f"{axis}_a") * F.col(place) + F.col(f"{axis}_b")
    bounded = framed.withColumns({"w": at("lon", "x0"), "e": at("lon", "x1"), "n": at("lat", "y0"), "s": at("lat", "y1")})
    spans = (F.col("e") - F.col("w")).between(*SPAN) & (F.col("n") - F.col("s")).between(*SPAN)
    middle = ((F.col("w") + F.col("e")) / 2).between(*LON_RANGE) & ((F.col("s") + F.col("n")) / 2).between(*LAT_RANGE)
    return bounded.filter(spans & middle).select("sheet", "lon_a", "lon_b", "lat_a", "lat_b", "lon_n", "lat_n", "x0", "y0", "x1", "y1", "w", "s", "e", "n")


def meets_box(rings: Column, w: float | Column, s: float | Column, e: float | Column, n: float | Column) -> Column:
    """Whether a polygon (rings of [lon, lat], the first point again at the end) and a box have a point in common.

    Either an edge meets the box (their extents overlap and the box's corners are
    not all on one side of it), or the box lies inside, told by one corner and the
    edges that a ray from it crosses.
    """
    x, y = lambda p: p[0], lambda p: p[1]
    edges = F.flatten(F.transform(rings, lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))), lambda i: F.struct(F.get(r, i).alias("p"), F.get(r, i + 1).alias("q")))))
    edges = F.filter(edges, lambda g: g["q"].isNotNull())

    def touches(g: Column) -> Column:
        p, q = g["p"], g["q"]
        over = (F.least(x(p), x(q)) <= e) & (F.greatest(x(p), x(q)) >= w) & (F.least(y(p), y(q)) <= n) & (F.greatest(y(p), y(q)) >= s)
        turns = [(x(q) - x(p)) * (cy - y(p)) - (y(q) - y(p)) * (cx - x(p)) for cx in (w, e) for cy in (s, n)]
        return over & (F.least(*turns) <= 0) & (F.greatest(*turns) >= 0)

    def crossed(g: Column) -> Column:
        p, q = g["p"], g["q"]
        return ((y(p) > s) != (y(q) > s)) & (F.lit(w) < (x(q) - x(p)) * (F.lit(s) - y(p)) / (y(q) - y(p)) + x(p))

    return F.exists(edges, touches) | (F.size(F.filter(edges, crossed)) % 2 == 1)


#: Side of the finest grid cell in degrees, and how often it doubles until one cell holds the globe.
FINEST, LEVELS = 0.25, 12


def _cells(w: Column, s: Column, e: Column, n: Column, level: Column) -> Column:
    """The grid cells (cx, cy) of a level that a box meets."""
    side = F.lit(FINEST) * F.pow(F.lit(2.0), level)
    span = lambda a, b: F.sequence(F.floor(a / side), F.floor(b / side))
    return F.flatten(F.transform(span(w, e), lambda x: F.transform(span(s, n), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def histories_of_fires(rows: DataFrame, fires: DataFrame, now_year: int, most: int = 2000) -> DataFrame:
    """A15, C19 for all fires at once: fire, guid, year of the perimeters of the last ten years that meet each fire's box, without the fire itself; the `most` newest of each fire.

    rows: guid, year, envelope (w, s, e, n), and if there are any rings, which
    decide; fires: fire, guid, w, s, e, n. A perimeter lies in the cells of the
    level whose side its envelope doesn't exceed, four of them at most, and a fire's
    box covers cells of every level: an equi join on level and cell. A pair counts
    in its first common cell only, so that none has to be told apart later.

    Equal shapes and equal boxes meet once: a shape stands for its newest perimeters
    and a box for its fires. A fire leaves out one guid, so `most` perimeters of each
    guid and twice `most` in all hold what any fire of a box can ask for.
    """
    recent = rows.filter((F.col("year") >= now_year - 10) & (F.col("w") <= F.col("e")) & (F.col("s") <= F.col("n")))
    extent = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"))
    level = F.least(F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(FINEST)) / FINEST)), F.lit(0)), F.lit(LEVELS)).cast("int")
    shape = [c for c in ("w", "s", "e", "n", "rings") if c in rows.columns]
    place = F.struct(*shape)
    newest = _newest_of_any(recent.select(place.alias("place"), "guid", "year"), ["place"], most)
    held = newest.select("place").distinct().select("place", "place.*").withColumn("level", level)
    mine = held.select("*", F.inline(_cells(F.col("w"), F.col("s"), F.col("e"), F.col("n"), F.col("level"))))
    asked = fires.select("fire", tx.norm_guid(F.col("guid")).alias("own"), F.struct(*(F.col(c).alias(f"b{c}") for c in "wsen")).alias("box"))
    boxes = asked.select("box").distinct().select("box", "box.*").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    theirs = boxes.select("*", F.inline(_cells(F.col("bw"), F.col("bs"), F.col("be"), F.col("bn"), F.col("level"))))
    met = theirs.join(mine, ["level", "cx", "cy"])
    side = F.lit(FINEST) * F.pow(F.lit(2.0), F.col("level"))
    first = (F.col("cx") == F.floor(F.greatest("w", "bw") / side)) & (F.col("cy") == F.floor(F.greatest("s", "bs") / side))
    near = met.filter(first & (F.col("w") <= F.col("be")) & (F.col("e") >= F.col("bw")) & (F.col("s") <= F.col("bn")) & (F.col("n") >= F.col("bs")))
    if "rings" in rows.columns:
        near = near.filter(meets_box(F.col("rings"), F.col("bw"), F.col("bs"), F.col("be"), F.col("bn")))
    of_box = _newest_of_any(near.select("box", "place").join(newest, "place").select("box", "guid", "year"), ["box"], most)
    others = asked.join(of_box, "box").filter(~F.coalesce(tx.norm_guid(F.col("guid")) == F.col("own"), F.lit(False)))
    by_fire = F.row_number().over(W.partitionBy("fire").orderBy(F.col("year").desc(), "guid"))
    return others.select("fire", "guid", "year").withColumn("k", by_fire).filter(F.col("k") <= most).drop("k")


def _newest_of_any(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of each key's rows (guid, year) those that can be among the `most` newest once any one guid is left out."""
    newest = lambda *by: F.row_number().over(W.partitionBy(*keys, *by).orderBy(F.col("year").desc(), "guid"))
    of_guid = rows.withColumn("k", newest(tx.norm_guid(F.col("guid")))).filter(F.col("k") <= most)
    return of_guid.withColumn("k", newest()).filter(F.col("k") <= 2 * most).drop("k")


def envelope(rings: DataFrame) -> DataFrame:
    """Box around nested coordinate rings (array of arrays of [lon, lat])."""
    flat = F.flatten("rings")
    lon, lat = F.transform(flat, lambda p: p[0]), F.transform(flat, lambda p: p[1])
    return rings.select("id", F.array_min(lon).alias("w"), F.array_min(lat).alias("s"), F.array_max(lon).alias("e"), F.array_max(lat).alias("n"))


def historic_perimeters(rows: DataFrame, box: tuple[float, float, float, float], now_year: int, exclude: str, most: int = 2000) -> DataFrame:
    """Perimeters of the last ten years that meet the given box, without the fire itself, the newest year first.

    rows have the envelope (w, s, e, n), which is tested first, and if there are any
    rings, which decide.
    """
    w, s, e, n = box
    near = rows.filter((F.col("w") <= e) & (F.col("e") >= w) & (F.col("s") <= n) & (F.col("n") >= s) & (F.col("year") >= now_year - 10))
    if "rings" in rows.columns:
        near = near.filter(meets_box(F.col("rings"), w, s, e, n))
    other = near.filter(tx.norm_guid(F.col("guid")) != exclude.strip("{}").lower())
    return other.orderBy(F.col("year").desc(), "guid").limit(most)
