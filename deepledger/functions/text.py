"""Text, time and coordinate parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A finite double, or null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def timestamp(text: Column) -> Column:
    """ISO 8601 with or without zone (none: the session's), compact dates, and the EXIF form; anything else null."""
    t = F.trim(text)
    exif = F.regexp_replace(t, r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3T")
    iso = F.when(exif.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.regexp_replace(F.regexp_replace(exif, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    compact = F.when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)).try_cast("timestamp"))
    return F.coalesce(iso, compact)


def unix_timestamp(value: Column) -> Column:
    """Seconds not below 0 of a numeric field."""
    return F.when(value >= 0, F.timestamp_micros((value * 1e6).cast("long")))


def coordinate(text: Column) -> Column:
    """Degrees of `dd mm.mmm H`, `ddmm.mmmH` or `dd.dddd H`; south and west negative; out of range or unreadable null."""
    t = F.upper(F.trim(text))
    sign = F.when(t.rlike("[SW]"), -1.0).otherwise(1.0)
    get = lambda pattern, g: F.nullif(F.regexp_extract(t, pattern, g), F.lit("")).try_cast("double")
    spaced = r"^(\d{1,3})\s*[° ]\s*(\d{1,2}\.\d+)\s*'?\s*[NSEW]$"
    merged = r"^(\d{2,3})(\d{2}\.\d+)\s*[NSEW]$"
    plain = r"^([+-]?\d{1,3}\.\d+)\s*°?\s*[NSEW]?$"
    value = F.coalesce(get(spaced, 1) + get(spaced, 2) / 60, get(merged, 1) + get(merged, 2) / 60, get(plain, 1))
    return F.when(F.abs(value) <= 180, sign * value)


def telemetry(text: Column) -> dict[str, Column]:
    """Fields that a screen overlay shows as `NAME value`, in any case; null if a field is not there."""
    low = F.lower(text)
    names = {"heading_deg": "(?:heading|hdg|course|cog)", "pitch_deg": "pitch", "roll_deg": "roll", "altitude_m": "alt(?:itude)?", "range_m": "(?:range|rng)"}
    return {k: F.nullif(F.regexp_extract(low, rf"\b{p}\s*[:=]?\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double") for k, p in names.items()}


def safe_name(text: Column) -> Column:
    """The last path part with all but letters, digits, dot, dash and underscore replaced; "file" if nothing is left."""
    base = F.regexp_replace(F.element_at(F.split(F.regexp_replace(text, r"\\", "/"), "/"), -1), r"[^A-Za-z0-9._-]", "_")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(base, r"^\.+", "")), F.lit("")), F.lit("file"))


def site_key(stem: Column) -> Column:
    """A file's stem without a trailing _number."""
    return F.regexp_replace(stem, r"_\d+$", "")


#: States of a location, and what older names of them mean.
LOCATION_STATUSES = ("VERIFIED", "DERIVED", "MANUAL", "VESSEL_ONLY", "UNAVAILABLE", "INVALID")
OLDER_STATUSES = {"approximate": "DERIVED", "known": "VERIFIED", "unknown": "UNAVAILABLE"}


def location_status(status: Column) -> Column:
    """One of LOCATION_STATUSES for its name in any case or an older name; UNAVAILABLE for anything else and null."""
    older = F.lit("UNAVAILABLE")
    for name, state in OLDER_STATUSES.items():
        older = F.when(F.lower(status) == name, state).otherwise(older)
    return F.when(F.upper(status).isin(*LOCATION_STATUSES), F.upper(status)).otherwise(older)
