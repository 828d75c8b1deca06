"""Column expressions: numbers, dates and flags out of dirty text, and distances. Missing is always null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgeline.params import DEFAULT, Params

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Formats by whether a text has a colon and a slash: each text is tried in those only that may fit.
_DATES = {
    (True, True): ("yyyy/M/d H:mm:ss", "yyyy/M/d H:mm"),
    (True, False): ("yyyy-MM-dd HH:mm:ss",),
    (False, True): ("yyyy/M/d", "M/d/yyyy"),
    (False, False): ("yyyy-MM-dd", "yyyyMMdd"),
}


def number(text: Column) -> Column:
    """A double, or null for what is not a plain number (1,234; <0.1; NaN; 1.5d)."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def timestamp(text: Column) -> Column:
    """A timestamp from any of several formats, row by row; null if none fits."""
    told = F.lit(None).cast("timestamp")
    for (colon, slash), formats in _DATES.items():
        here = (text.contains(":") == F.lit(colon)) & (text.contains("/") == F.lit(slash))
        told = F.when(here, F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats])).otherwise(told)
    return told.cast("timestamp_ntz")


def mesh_id(text: Column) -> Column:
    """Stripped of all white space, also full-width; empty is null."""
    return F.nullif(F.regexp_replace(text, r"^[\s　]+|[\s　]+$", ""), F.lit(""))


def blank_to_null(text: Column) -> Column:
    """The raw files' null tokens: the empty string and one space."""
    return F.when(~text.isin("", " "), text)


def haversine_km(lat: Column, lon: Column, params: Params = DEFAULT) -> Column:
    """Great-circle distance from the site."""
    lat0, lon0 = F.radians(F.lit(params.site_latitude)), F.radians(F.lit(params.site_longitude))
    a = F.pow(F.sin((F.radians(lat) - lat0) / 2), 2) + F.cos(lat0) * F.cos(F.radians(lat)) * F.pow(F.sin((F.radians(lon) - lon0) / 2), 2)
    return F.lit(2 * params.earth_radius_km) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def height_anomalous(height: Column) -> Column:
    return F.coalesce(height != 100.0, F.lit(False))


def decontaminated(*texts: Column) -> Column:
    found = F.lit(False)
    for text in texts:
        found = found | F.coalesce(text.rlike("(?i)除染|decontamination"), F.lit(False))
    return found


def is_dose_rate(category: Column) -> Column:
    """True also for a null category, which is kept."""
    return category.isNull() | category.rlike("空間線量率|Spatial dose rate")


def half_even(x: Column, digits: int) -> Column:
    """Rounded, halves to the even neighbour."""
    return F.bround(x, digits)


def significant(x: Column, digits: int) -> Column:
    """Rounded to so many significant digits."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")
