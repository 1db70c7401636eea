"""Column helpers: numbers, text, geodesy. Missing values are NULL throughout; NaN and infinities become NULL."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
#: Texts that count as missing.
MISSING = ("", "nan", "none", "unknown", "insufficient", "insufficient_evidence", "insufficient_data", "unavailable", "no fire station within", "fire station data unavailable", "invalid coordinates")


def rounded(x: Column, places: int) -> Column:
    """Half-even rounding of the scaled binary value."""
    return F.rint(x * F.lit(float(10**places))) / F.lit(float(10**places))


def milli(x: Column) -> Column:
    """Thousandths as a whole number, so that sums do not depend on their order."""
    return F.rint(x * F.lit(1000.0)).cast("long")


def mean3(x: Column) -> Column:
    """Mean of a group to three places, from exact sums."""
    return F.rint(F.sum(milli(x)) / F.count(x)) / F.lit(1000.0)


def number(x: Column, default: float | None = None) -> Column:
    """A double; unreadable, NaN and infinite values become `default`."""
    d = F.expr("try_cast(null as double)") if default is None else F.lit(default)
    v = x.cast("string").try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), d).otherwise(v)


def json_safe(df: DataFrame, texts: tuple[str, ...] = ()) -> DataFrame:
    """`df` as JSON can hold it: NaN and infinite numbers are null, missing values of the columns `texts` empty texts."""

    def safe(name: str, kind: str) -> Column:
        x = F.col(f"`{name}`")
        if name in texts:
            return F.coalesce(x, F.lit(""))
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) if kind in ("double", "float") else x

    return df.select(*[safe(n, k).alias(n) for n, k in df.dtypes])


def clean(x: Column) -> Column:
    """Trimmed text, '' where it says that something is missing."""
    t = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(*MISSING), F.lit("")).otherwise(t)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2.0)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h))) * F.lit(2 * EARTH_KM)  # least() would hide a NULL


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    turn = F.radians(lon2) - F.radians(lon1)
    y = F.sin(turn) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.pmod(F.atan2(y, x) * F.lit(180.0 / pi) + 360.0, F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.rint(degrees / 45.0).cast("int") % 8 + 1))


def destination(lat: Column, lon: Column, degrees: Column, km: float | Column) -> tuple[Column, Column]:
    """The point `km` away along a bearing: (latitude, longitude)."""
    d = (km if isinstance(km, Column) else F.lit(km)) / F.lit(EARTH_KM)
    phi, lam, t = F.radians(lat), F.radians(lon), F.radians(degrees)
    phi2 = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(t))
    lam2 = lam + F.atan2(F.sin(t) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(phi2))
    return phi2 * F.lit(180.0 / pi), F.pmod(lam2 * F.lit(180.0 / pi) + 540.0, F.lit(360.0)) - 180.0


def padded_time(x: Column) -> Column:
    """HHMM with leading zeros; longer texts stay whole."""
    t = F.trim(x.cast("string"))
    return F.when(F.length(t) < 4, F.lpad(t, 4, "0")).otherwise(t)


def fixed(x: Column, places: int) -> Column:
    """Decimal text with so many places, from whole numbers only, so that every engine gives the same."""
    n = F.rint(x * F.lit(float(10**places))).cast("long")
    scale = 10**places
    return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), F.floor(F.abs(n) / scale).cast("long").cast("string"), F.lit("."), F.lpad((F.abs(n) % scale).cast("string"), places, "0"))


def detection_key(lat: Column, lon: Column, date: Column, time: Column, satellite: Column) -> Column:
    """16 hex digits that name an observation."""
    return F.substring(F.md5(F.concat_ws("|", fixed(lat, 5), fixed(lon, 5), date.cast("string"), time, satellite)), 1, 16)


def event_key(satellite: Column, lat: Column, lon: Column) -> Column:
    """16 hex digits that name a place as one satellite family sees it."""
    return F.substring(F.sha1(F.concat_ws("|", F.lit("EVK1"), F.upper(F.coalesce(satellite, F.lit("UNKNOWN"))), fixed(lat, 3), fixed(lon, 3))), 1, 16)


def masked_phone(x: Column) -> Column:
    """All but the last four digits as stars; four or fewer are all hidden."""
    d = F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9+]", "")
    return F.when(F.length(d) <= 4, F.lit("****")).otherwise(F.concat(F.repeat(F.lit("*"), F.length(d) - 4), F.right(d, F.lit(4))))
