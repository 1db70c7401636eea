"""What is told about a cluster: area, evidence, attribution, messages, incident reports and formats, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

C = F.col
NONE = "Not available"
#: The order of level names; a text that is none of them comes first.
LEVEL_ORDER = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "ELEVATED": 2, "NORMAL": 1}
#: Area, its name and description, and by which words in which columns it is told; the first that fits is taken.
AREAS = (
    ("INDUSTRIAL_ZONE", "Industrial / Manufacturing Area", "Identified near industrial infrastructure, factory clusters, or commercial facilities.", {"classification_label": ("industrial",), "facility_type": ("factory", "industrial", "refinery", "power", "works")}),
    ("FOREST_AREA", "Forest / Natural Vegetation Area", "Identified in forest canopy, dense vegetative cover, or wilderness zone.", {"classification_label": ("forest",), "land_cover": ("forest", "tree", "woodland"), "rationale": ("forest",)}),
    ("AGRICULTURAL_AREA", "Agricultural / Farmland Area", "Identified in open agricultural fields, rural crop parcels, or agrarian landscape.", {"classification_label": ("agricultural",), "land_cover": ("crop", "agriculture", "field"), "rationale": ("crop",)}),
    ("RESIDENTIAL_DOMESTIC", "Domestic / Residential Settlement Area", "Identified within or adjacent to inhabited settlements, residential colonies, or township sectors.", {"land_cover": ("urban", "built"), "facility_type": ("residential",)}),
    ("PARK_PROTECTED", "Park / Protected Green Zone", "Identified in parklands, water buffer zones, or protected natural open spaces.", {"land_cover": ("park", "grass", "water")}),
)
ELSEWHERE = ("MIXED_TERRAIN", "Mixed / Rural Open Terrain", "Observed in open terrain or transitional rural geography with mixed spectral characteristics.")
#: What to do next, by severity; all others have the last list.
ACTIONS = {
    "CRITICAL": (
        "Immediate local field verification required at identified coordinates.",
        "Notify appropriate local emergency / fire-response authority with incident location context.",
        "Check identified location, street access, and nearby industrial/vulnerable infrastructure.",
        "Maintain continuous alert monitoring for subsequent satellite overpasses.",
    ),
    "HIGH": (
        "Prioritize field verification at specified location.",
        "Review nearby industrial infrastructure and local geographic access.",
        "Notify responsible regional monitoring and emergency response personnel.",
        "Continue tracking cluster thermal persistence and movement vectors.",
    ),
    "MEDIUM": (
        "Continue satellite alert monitoring.",
        "Review cluster persistence and supporting geospatial evidence.",
        "Consider local ground verification if thermal activity continues into next overpass.",
    ),
    "": (
        "Continue routine observation.",
        "No immediate escalation based solely on current satellite thermal evidence.",
    ),
}
#: Statuses that a later run tries again.
TRANSIENT = ("no network connection", "timed out", "search error", "search pending", "observation search pending")
#: Parts of an address, each the first that is given of these tags.
ADDRESS = {
    "state": ("state", "state_district"),
    "district": ("state_district", "county", "district"),
    "city_town": ("city", "town", "village", "municipality", "hamlet"),
    "locality": ("suburb", "neighbourhood", "residential", "quarter", "locality"),
}


def text(x: str, places: int = 1) -> Column:
    return scalar.fixed(C(x), places)


def given(*columns: Column, default: str) -> Column:
    """The first of the columns that is neither missing nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(default))


def level_order(x: Column) -> Column:
    return reduce(lambda w, kv: w.when(x == kv[0], kv[1]), list(LEVEL_ORDER.items())[1:], F.when(x == "HIGH", LEVEL_ORDER["HIGH"])).otherwise(0)


def sort_keys(df: DataFrame, column: str, ascending: bool = True) -> list[Column]:
    """Keys to order by one column: numbers by value, texts by their level and then as text; missing values last."""
    x = C(column)
    by = [level_order(x), x] if df.schema[column].dataType.simpleString() == "string" else [x]
    return [x.isNull(), *[k.asc() if ascending else k.desc() for k in by]]


def area(rationale: Column | None = None, town: Column | None = None, locality: Column | None = None) -> Column:
    """Kind of area with its name and description, from label, facility and land cover.

    `rationale` is the text that explains the class, `town` and `locality` what a geocoder knows; a known one (neither
    null, empty nor NONE) tells of a settlement where no area before it fits. Without them those conditions do not count.
    """
    text_of = lambda c: F.lower(F.coalesce(rationale if c == "rationale" else C(c), F.lit("")))
    settled = [F.coalesce(~F.trim(x).isin("", NONE), F.lit(False)) for x in (town, locality) if x is not None]
    told = lambda *x: F.struct(*[F.lit(v).alias(k) for k, v in zip(("type", "name", "description"), x, strict=True)])
    out = told(*ELSEWHERE)
    for *names, words in reversed(AREAS):
        met = [F.contains(text_of(c), F.lit(w)) for c, some in words.items() if c != "rationale" or rationale is not None for w in some]
        out = F.when(reduce(lambda a, b: a | b, met + (settled if names[0] == "RESIDENTIAL_DOMESTIC" else [])), told(*names)).otherwise(out)
    return out


def area_category(**known: Column) -> Column:
    return area(**known)["type"]


def evidence(imagery: Column | None = None) -> Column:
    """Array of (side, key, label, why): what supports a cluster, of the thresholds that it meets, and what limits it.

    `imagery` says whether a usable satellite scene is at hand; without it there is none. Missing values count as 0, a
    missing count of days as 1. The sentences are fixed values.
    """
    level, label = C("abnormality_level"), C("classification_label")
    number = lambda c: F.coalesce(C(c).cast("double"), F.lit(0.0))
    days, lasting = F.coalesce(C("active_days"), F.lit(1)), F.lower(F.coalesce("persistence_category", F.lit("")))
    of = lambda pattern, *values: F.format_string(pattern, *values)
    one = lambda x: scalar.fixed(x, 1)
    ti4, diff, frp = number("max_bright_ti4"), number("bt_diff_max"), number("max_frp")
    found = (
        ("supporting", "intensity", "High thermal intensity", (ti4 >= 340) | (diff >= 45), of("Peak brightness temperature %s K and/or spectral contrast %s K exceed the anomaly-explainer thresholds.", one(ti4), one(diff))),
        ("supporting", "persistence", "Persistent thermal activity", (lasting == "persistent") | (days >= 4), of("Activity spans %s active day(s) with persistence category '%s'.", days.cast("string"), F.when(lasting == "", "unknown").otherwise(lasting))),
        ("supporting", "frp", "Elevated FRP", frp >= 15, of("Peak Fire Radiative Power of %s MW meets the strong-FRP evidence threshold (>= 15 MW).", one(frp))),
        ("supporting", "abnormality", F.concat(level, F.lit(" statistical abnormality")), level.isin("HIGH", "ELEVATED"), of("The event was flagged %s relative to the analyzed thermal baseline.", level)),
        ("supporting", "reliability", "High detection reliability", C("detection_reliability") == "HIGH", F.lit("The false-alarm detector assigned HIGH detection reliability to this cluster.")),
        ("supporting", "context", "Strong contextual evidence", (number("classification_score") >= 0.6) & ~F.contains(label, F.lit("Unknown")), of("The source-classification model assigned a confidence of %s%% (%s).", scalar.rounded(number("classification_score") * 100, 0).cast("int").cast("string"), label)),
        ("limiting", "satellite", "Limited satellite imagery", F.lit(True) if imagery is None else ~F.coalesce(imagery, F.lit(False)), F.lit("No usable Sentinel-2 observation: imagery is unavailable or cloud-obscured. This is not negative evidence.")),
        ("limiting", "fa", "High false-alarm concern", C("false_alarm_indicator") == "HIGH", F.lit("The false-alarm detector flagged weak or single-pass evidence. HIGH concern is not a confirmed false alarm.")),
        ("limiting", "movement", "Insufficient movement observations", C("movement_status") == "INSUFFICIENT_DATA", F.lit("Too few satellite passes to infer a defensible direction for the detected thermal activity.")),
        ("limiting", "station", "No nearby fire station", C("station_km").isNull(), F.lit("No verified fire station was found within the operational search radius.")),
    )
    each = [F.when(F.coalesce(met, F.lit(False)), F.struct(F.lit(side).alias("side"), F.lit(k).alias("key"), (F.lit(name) if isinstance(name, str) else name).alias("label"), why.alias("why"))) for side, k, name, met, why in found]
    return F.array_compact(F.array(*each))


def supporting_evidence() -> Column:
    return F.filter(evidence(), lambda e: e["side"] == "supporting")


def relevance(name: Column, aliases: Column, query: Column) -> Column:
    """How well a place fits a search, 0 best: its name, one of its aliases, a name that begins so, any name or alias that holds it; null for others and for blank searches."""
    q, low = F.lower(F.trim(query)), F.lower(name)
    others = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.lower(a))
    holds = F.contains(low, q) | F.exists(others, lambda a: F.contains(a, q))
    return F.when((q != "") & holds, F.when(low == q, 0).when(F.array_contains(others, q), 1).when(F.startswith(low, q), 2).otherwise(3))


def attribution(values: dict[str, Column], most: int = 5) -> tuple[Column, Column, Column]:
    """(positive, negative, summary): the `most` largest values of either sign by magnitude, ties by name; missing ones
    count as 0. The summary names three of each and which side outweighs the other."""
    each = F.array(*[F.struct((-F.abs(F.coalesce(v, F.lit(0.0)))).alias("by"), F.lit(k).alias("name"), F.coalesce(v, F.lit(0.0)).alias("value")) for k, v in values.items()])
    ranked = F.array_sort(each)
    top = lambda sign: F.slice(F.filter(ranked, lambda s: s["value"] * sign > 0), 1, most)
    told = lambda a, n: F.array_join(F.transform(F.slice(a, 1, n), lambda s: F.concat(s["name"], F.lit(" ("), scalar.fixed(s["value"], 3), F.lit(")"))), ", ")
    total = F.aggregate(ranked, F.lit(0).cast("long"), lambda a, s: a + scalar.milli(s["value"]))
    parts = [F.when(F.size(top(sign)) > 0, F.concat(F.lit(f"Top {name} factors: "), told(top(sign), 3))) for sign, name in ((1, "positive"), (-1, "negative"))]
    side = F.when(total > 0, "Overall positive signal dominates").otherwise("Overall negative signal dominates")
    return told(top(1), most), told(top(-1), most), F.concat_ws("; ", *parts, side)


def why_flagged() -> Column:
    label = C("classification_label")
    factors = F.concat_ws(
        ", ",
        F.when(C("persistence_category").isin("multi_day", "persistent", "recurrent"), "persistent thermal activity over multiple satellite passes").otherwise("localized thermal anomaly detection"),
        F.when(C("max_frp") > 20, F.concat(F.lit("elevated Fire Radiative Power (FRP "), text("max_frp"), F.lit(" MW)"))).when(C("max_frp") > 5, F.concat(F.lit("moderate Fire Radiative Power (FRP "), text("max_frp"), F.lit(" MW)"))),
        F.when(~label.isin("Unknown", NONE), F.concat(F.lit("supporting geospatial context ("), label, F.lit(")"))),
        F.when(C("false_alarm_indicator") == "LOW", "low false-alarm indicator score"),
    )
    return F.concat(F.lit("Cluster flagged at "), C("severity"), F.lit(" level (Risk Score "), text("risk_score"), F.lit("/100) because the anomaly exhibits "), factors, F.lit(" across "), C("observation_count").cast("string"), F.lit(" satellite observations."))


def recommended_actions() -> Column:
    lists = {k: F.array(*map(F.lit, v)) for k, v in ACTIONS.items()}
    return reduce(lambda w, k: w.when(C("severity") == k, lists[k]), ("HIGH", "MEDIUM"), F.when(C("severity") == "CRITICAL", lists["CRITICAL"])).otherwise(lists[""])


def placeholders() -> Column:
    """The ten values of a message template, in order."""
    return F.array(
        C("severity"), C("cluster_id").cast("string"), scalar.rounded(C("risk_score"), 0).cast("long").cast("string"),
        F.concat(text("latitude", 5), F.lit(","), text("longitude", 5)), given(C("classification_label"), default="Unknown"),
        given(C("evidence_confidence"), C("detection_reliability"), default="UNKNOWN"), C("observation_count").cast("string"), C("active_days").cast("string"),
        given(C("station_name"), default="Verified fire station"), F.coalesce(text("station_km"), F.lit("0.0")),
    )


def message() -> Column:
    """Text of a notification, from the placeholders."""
    p = lambda i: F.element_at(placeholders(), i)
    parts = ("Decision-support alert. Severity ", p(1), "; cluster ", p(2), "; risk ", p(3), "/100; coordinates ", p(4), "; classification ", p(5), "; evidence ", p(6), "; detections ", p(7), ", active days ", p(8), ". Nearest verified fire station: ", p(9), " (", p(10), " km). Advisory thermal anomaly information only; not a confirmed fire or official dispatch.")
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def settled(status: Column) -> Column:
    """Whether a result stands: it has a status, and that is none which a later run tries again."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return (s != "") & ~reduce(lambda a, b: a | b, [F.contains(s, F.lit(t)) for t in TRANSIENT])


def location_header(tags: Column, lat: Column, lon: Column) -> Column:
    """Town (else locality), district and state of a map of address tags, each once; the coordinates where none is given."""
    part = {k: F.coalesce(*[F.nullif(F.element_at(tags, F.lit(t)), F.lit("")) for t in names]) for k, names in ADDRESS.items()}
    names = F.array_distinct(F.array_compact(F.array(F.coalesce(part["city_town"], part["locality"]), part["district"], part["state"])))
    place = F.concat(F.lit("Coordinates: "), scalar.fixed(lat, 4), F.lit(", "), scalar.fixed(lon, 4))
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(place)


def facility_kind(tags: Column) -> Column:
    """Kind of a mapped element: its first tag of four, else industrial."""
    return given(*[F.element_at(tags, F.lit(t)) for t in ("industrial", "man_made", "power", "landuse")], default="industrial")


def unusable_patch(n: Column, zeros: Column, total: Column, squares: Column) -> Column:
    """Whether an image patch is empty, over 95 % zero or of a deviation under 1, from the counts and sums of its pixels."""
    return (n == 0) | (zeros * 100 > n * 95) | (n * squares - total * total < n * n)


def coordinates(lat: Column, lon: Column) -> Column:
    side = lambda x, plus, minus: F.concat(scalar.fixed(F.abs(x), 3), F.when(x >= 0, f"°{plus}").otherwise(f"°{minus}"))
    return F.concat(side(lat, "N", "S"), F.lit(", "), side(lon, "E", "W"))


def run_status(products: DataFrame, by: str) -> DataFrame:
    """(by, status, error) of runs over several products: failed if all of them are, degraded if some, else healthy."""
    bad = F.when(C("error").isNotNull(), F.concat_ws(": ", "product", "error"))
    status = F.when(F.count("error") == F.count("*"), "failed").when(F.count("error") > 0, "degraded").otherwise("healthy")
    return products.groupBy(by).agg(status.alias("status"), F.array_join(F.sort_array(F.collect_list(bad)), "; ").alias("error"))
