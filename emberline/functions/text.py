"""Column expressions over names, file names and text fields. None needs a Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Product vocabulary (label, display rank, tiling priority by base).
PRODUCT_LABELS = {
    "ops": "Operations Map", "brief": "Briefing Map", "iap": "IAP Map", "pio": "Public Information Map", "airops": "Air Operations Map",
    "evac": "Evacuation Map", "trans": "Transportation Map", "owner": "Land Ownership Map", "suprep": "Suppression Repair Map",
    "suppression_repair": "Suppression Repair Map", "repair": "Suppression Repair Map", "mobile": "Avenza Mobile Map", "other": "Map",
}
PRODUCT_RANKS = {"ops": 0, "iap": 1, "brief": 2, "airops": 3, "evac": 4, "trans": 5, "pio": 6, "suprep": 7, "suppression_repair": 7, "repair": 7, "owner": 8, "other": 9}
QR_RANK, MOBILE_RANK = 10, 11
TILING_PRIORITY = {"ops": 0, "brief": 1, "iap": 2, "airops": 3, "evac": 4, "trans": 5, "pio": 6, "other": 7}
SHEET_DPI = {"8x11": 300, "85x11": 300, "11x17": 300, "arch_c": 200, "arch_d": 200, "arch_e": 150}
DEFAULT_DPI = 200
#: Web-mercator metres per pixel at zoom 0.
TOP_RESOLUTION = 156543.03392804097


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def unquote(c: Column) -> Column:
    """Percent-decoding that keeps plus signs and bad escapes."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def slugify(c: Column) -> Column:
    """B2: lower case, other characters to single hyphens, none at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def is_wildfire(c: Column) -> Column:
    return F.lower(c) == "wildfire"


def is_prescribed(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("(?i)^prescribed"), F.lit(False))


def normalize_name(c: Column) -> Column:
    """Comparable form of a fire or folder name (the patterns are fixed values)."""
    s = F.regexp_replace(unquote(c), r"^\d{4}_", "")
    s = F.regexp_replace(s, "(?<=[a-z])(?=[A-Z])", " ")
    s = F.regexp_replace(s, "(?<=[A-Z])(?=[A-Z][a-z])", " ")
    s = F.lower(F.regexp_replace(s, "[_-]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", ""), r"\s+", " "))


def name_variants(name: Column) -> Column:
    """The normalised name, and without a trailing ' complex' or ' fire'."""
    short = [F.when(name.endswith(x), F.trim(F.substr(name, F.lit(1), F.length(name) - len(x)))) for x in (" complex", " fire")]
    return F.array_distinct(F.array_compact(F.array(name, *short)))


def unit_tokens(filename: Column, year: int) -> Column:
    """Incident ids in a file name, as 'YYYY-UNIT-NUMBER'."""
    pattern = F.lit(r"_([A-Z]{2}[A-Z0-9]{2,4}[0-9]{6})(?=[_.])")
    found = F.regexp_extract_all(filename, pattern, F.lit(1))
    return F.transform(found, lambda x: F.concat(F.lit(f"{year}-"), F.substr(x, F.lit(1), F.length(x) - 6), F.lit("-"), F.right(x, F.lit(6))))


def dir_rest(name: Column, year: int) -> Column:
    """What follows the year in a candidate folder's name; null for other years and template folders."""
    plain = unquote(F.regexp_replace(name, "/+$", ""))
    rest = F.regexp_extract(plain, r"^(\d{4})_(.+)$", 2)
    ok = (F.regexp_extract(plain, r"^(\d{4})_(.+)$", 1) == str(year)) & ~rest.rlike(r"(?i)^z?firename\d*$")
    return F.when(ok, rest)


def parse_product_filename(filename: Column) -> Column:
    """Product, product_base, sheet, orientation, generated_at_local, op_date, period, unit_incident, fire_name of a map file's name."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    anchor = r"_(\d{8})_(\d{4})_"
    has = stem.rlike(anchor)
    day, time = F.regexp_extract(stem, anchor, 1), F.regexp_extract(stem, anchor, 2)
    prefix = F.regexp_extract(stem, r"^(.*?)_\d{8}_\d{4}_", 1)
    suffix = F.regexp_extract(stem, r"^.*?_\d{8}_\d{4}_(.*)$", 1)
    words = lambda c: F.filter(F.split(c, "_"), lambda x: x != "")
    head = words(prefix)
    last = lambda a, k=1: F.lower(F.try_element_at(a, F.lit(-k)))
    front = lambda a, k: F.slice(a, F.lit(1), F.greatest(F.size(a) - k, F.lit(0)))
    orientation = F.when(last(head).isin("port", "land"), last(head))
    head = F.when(orientation.isNotNull(), front(head, 1)).otherwise(head)
    arch = (F.size(head) >= 2) & (last(head, 2) == "arch") & (F.length(last(head)) == 1)
    single = last(head).rlike(r"^\d{1,3}x\d{1,3}$|^8\.5x11$")
    sheet = F.when(arch, F.concat(F.lit("arch_"), last(head))).when(single, last(head))
    head = F.when(arch, front(head, 2)).when(single, front(head, 1)).otherwise(head)
    named = has & (F.size(head) > 0)
    tail = words(suffix)
    period_pattern = r"(?i)^(\d{3,4})(day|night)?$"
    dated = F.coalesce(F.try_element_at(tail, F.lit(-1)).rlike(period_pattern), F.lit(False))
    mmdd = F.lpad(F.regexp_extract(F.try_element_at(tail, F.lit(-1)), period_pattern, 1), 4, "0")
    period = F.nullif(F.lower(F.regexp_extract(F.try_element_at(tail, F.lit(-1)), period_pattern, 2)), F.lit(""))
    rest = F.when(dated, front(tail, 1)).otherwise(tail)
    unit = F.try_element_at(rest, F.lit(-1))
    is_unit = F.coalesce(unit.rlike(r"^[A-Z]{2}[A-Z0-9]{2,4}[0-9]{6}$"), F.lit(False))
    name = F.when(is_unit, front(rest, 1)).otherwise(rest)
    return F.struct(
        F.when(named, F.lower(F.array_join(head, "_"))).otherwise("other").alias("product"),
        F.when(named, F.lower(F.try_element_at(head, F.lit(1)))).otherwise("other").alias("product_base"),
        F.when(has, sheet).alias("sheet"), F.when(has, orientation).alias("orientation"),
        F.when(has, F.concat(F.substr(day, F.lit(1), F.lit(4)), F.lit("-"), F.substr(day, F.lit(5), F.lit(2)), F.lit("-"), F.substr(day, F.lit(7)), F.lit("T"), F.substr(time, F.lit(1), F.lit(2)), F.lit(":"), F.substr(time, F.lit(3)))).alias("generated_at_local"),
        F.when(has & dated, F.concat(F.substr(day, F.lit(1), F.lit(4)), F.lit("-"), F.substr(mmdd, F.lit(1), F.lit(2)), F.lit("-"), F.substr(mmdd, F.lit(3)))).alias("op_date"),
        F.when(has & dated, period).alias("period"),
        F.when(has & is_unit, unit).alias("unit_incident"),
        F.when(has & (F.size(name) > 0), F.array_join(name, "_")).alias("fire_name"),
    )


def product_base(product: Column, ranks: dict[str, int] = PRODUCT_RANKS) -> Column:
    """The longest known base that the product is or continues with an underscore."""
    p = F.lower(F.coalesce(product, F.lit("")))
    bases = sorted(ranks, key=lambda b: (-len(b), b))
    return F.coalesce(*(F.when((p == b) | p.startswith(b + "_"), b) for b in bases), F.lit("other"))


def product_label(product: Column, base: Column, labels: dict[str, str] = PRODUCT_LABELS) -> Column:
    """Label of the whole product or else of its base, with the variant in brackets."""
    p, b = F.coalesce(product, F.lit("")), F.coalesce(base, F.lit("other"))
    label = F.coalesce(lookup(p, labels), lookup(b, labels), F.lit(labels["other"]))
    varied = lookup(b, labels).isNotNull() & (p != b) & F.startswith(p, F.concat(b, F.lit("_")))
    variant = F.replace(F.substr(p, F.length(b) + 2), F.lit("_"), F.lit(" "))
    return F.when(varied, F.concat(label, F.lit(" ("), variant, F.lit(")"))).otherwise(label)


def product_rank(product: Column, kind: Column, ranks: dict[str, int] = PRODUCT_RANKS) -> Column:
    """Order within a date: product, then quick-reference sheets, then mobile ones."""
    return F.when(kind == "mobile", MOBILE_RANK).when(kind == "qr", QR_RANK).otherwise(lookup(product_base(product, ranks), ranks)).cast("int")


def tiling_priority(base: Column, priorities: dict[str, int] = TILING_PRIORITY) -> Column:
    return lookup(F.coalesce(base, F.lit("other")), priorities, priorities["other"])


def daily_key(name: Column) -> Column:
    """B13: 'YYYYMMDD' of a dated folder, whether written YYYYMMDD or MMDDYYYY; null otherwise."""
    plain = F.regexp_replace(name, "/+$", "")
    good = r"20\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])"
    other = r"^((0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01]))(20\d{2})$"
    return F.when(plain.rlike(f"^{good}$"), plain).when(plain.rlike(other), F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))))


def valid_day(day: Column) -> Column:
    """Looks like a day of this century; the calendar isn't asked."""
    return F.coalesce(day.rlike(r"^20\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"), F.lit(False))


def size_bytes(hint: Column) -> Column:
    """B15: '9.8M' to bytes, truncated; '-' and junk to null."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)([KMGT]?)\s*$"
    unit = lookup(F.upper(F.regexp_extract(hint, pattern, 2)), {"": 1.0, "K": 1024.0, "M": 1024.0**2, "G": 1024.0**3, "T": 1024.0**4})
    return (F.regexp_extract(hint, pattern, 1).try_cast("double") * unit).cast("long")


def norm_guid(c: Column) -> Column:
    """Without braces, in lower case."""
    return F.lower(F.regexp_replace(F.trim(c), "[{}]", ""))


def parse_coord(text: Column) -> Column:
    """(axis, degrees) of a map margin label; bare values of 60 and more are western longitudes."""
    pattern = "^(-?)(\\d{1,3})\\s*[°º]\\s*(?:(\\d{1,2}(?:\\.\\d+)?)\\s*['′])?\\s*(?:(\\d{1,2}(?:\\.\\d+)?)\\s*[\"″])?\\s*([NSEW])?$"
    t = F.trim(text)
    part = lambda k: F.regexp_extract(t, pattern, k)
    number = lambda k: F.coalesce(part(k).try_cast("double"), F.lit(0.0))
    degrees = part(2).try_cast("double")
    v = degrees + number(3) / 60 + number(4) / 3600
    far = degrees >= 60
    axis = F.when(part(5).isin("N", "S"), "lat").when(part(5).isin("E", "W"), "lon").when(far, "lon").otherwise("lat")
    down = part(5).isin("S", "W") | ((part(5) == "") & ((part(1) == "-") | far))
    ok = t.rlike(pattern) & (degrees <= 180) & (number(3) < 60) & (number(4) < 60)
    return F.when(ok, F.struct(axis.alias("axis"), F.when(down, -v).otherwise(v).alias("deg")))


def readable_id(unique_id: Column) -> Column:
    """B34: 'YYYY-MM-DD-ST-NAME' to 'name-st-yyyy-mm-dd'; anything else in lower case."""
    return F.lower(F.regexp_replace(unique_id, r"^(\d{4}-\d{2}-\d{2})-([A-Za-z]{2})-(.+)$", "$3-$2-$1"))


def heat_class(layer: Column) -> Column:
    """Heat class that a layer's name speaks of, the first that matches."""
    has = lambda w: layer.rlike(f"(?i){w}")
    return F.when(has("intense"), "Intense").when(has("scatter"), "Scattered").when(has("isolat"), "Isolated").when(has("perimeter"), "Perimeter")


def estimated_acres(text: Column) -> Column:
    """The acreage that a flight's notes estimate."""
    return F.replace(F.regexp_extract(text, r"(?i)Estimated\s+Acreage:?\s*([\d,.]+)", 1), F.lit(","), F.lit("")).try_cast("double")


def flight_id(filename: Column, fire_name: Column) -> Column:
    """The file's stem without the tokens that spell the fire's name."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    own = F.split(normalize_name(fire_name), " ")
    return F.array_join(F.filter(F.split(stem, "[_ -]+"), lambda x: (x != "") & ~F.array_contains(own, F.lower(x))), "_")


def shard_of(sha: Column, shards: int) -> Column:
    """Shard of a content id by its first eight hex digits; junk goes to shard 0."""
    head = F.substr(sha, F.lit(1), F.lit(8))
    number = F.when(head.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(head, 16, 10).cast("long"))
    return F.coalesce(number % shards, F.lit(0)).cast("long")


def fill_template(template: Column, **fields: Column) -> Column:
    """Every {name} replaced by its field."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1].cast("string")), fields.items(), template)


def row_action(kind: Column, georeferenced: Column, tiles: Column) -> Column:
    """What a sheet's row offers."""
    return F.when(kind == "mobile", "download").when(georeferenced & tiles, "overlay").when(georeferenced, "overlay-soon").otherwise("view")


def series_key(product: Column, sheet: Column, orientation: Column) -> Column:
    return F.concat_ws("|", F.coalesce(product, F.lit("null")), F.coalesce(sheet, F.lit("")), F.coalesce(orientation, F.lit("")))


def incident_key(region: Column, year: Column, directory: Column) -> Column:
    """B42: 'region/year/directory', state roots folded into their region."""
    return F.concat_ws("/", F.regexp_replace(region, "^pacific_nw_(oregon|washington)$", "pacific_nw"), year.cast("string"), directory)


def sheet_dpi(sheet: Column, dpi: dict[str, int] = SHEET_DPI, default: int = DEFAULT_DPI) -> Column:
    return lookup(F.replace(F.lower(F.coalesce(sheet, F.lit(""))), F.lit("."), F.lit("")), dpi, default)


def zoom_range(metres_per_pixel: Column) -> Column:
    """Deepest and shallowest tile zoom of a sheet."""
    top = F.greatest(F.lit(10), F.least(F.lit(16), F.floor(F.log2(F.lit(TOP_RESOLUTION) / metres_per_pixel)).cast("int")))
    return F.struct((top - 6).alias("zmin"), top.alias("zmax"))


def display_acres(acres: Column) -> Column:
    """1,234 / 12.3k / 1.2M."""
    return (
        F.when(acres >= 1e6, F.concat(F.format_number(acres / 1e6, 1), F.lit("M")))
        .when(acres >= 1e4, F.concat(F.format_number(acres / 1e3, 1), F.lit("k")))
        .when(acres.isNotNull(), F.format_number(F.floor(acres + 0.5), 0))
    )


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (length a + length b), by dynamic programming over characters as one expression."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    letters = chars(b)

    def next_row(row: Column, x: Column) -> Column:
        cells = F.transform(letters, lambda y, j: F.when(x == y, F.element_at(row, j + 1) + 1).otherwise(F.element_at(row, j + 2)))
        return F.aggregate(cells, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), v))))

    lcs = F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(chars(a), zero, next_row), -1))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / total)
