"""Values of statements: times, numbers, ids, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_SECONDS = 365 * 86400
#: The last instant of a 64-bit nanosecond clock; later times count as unusable.
LAST_TIME = "2262-04-11 23:47:16"
FIRST_TIME = "1677-09-21 00:12:44"


def parse_time_value(raw: Column) -> Column:
    """Timestamp of a quoted time text; null for zero months or days, BCE years, and what lies outside a nanosecond clock."""
    text = F.regexp_replace(F.trim(raw), r'^[\s"\']+|[\s"\']+$', "")
    text = F.regexp_replace(text, r"^\+", "")
    zero = F.substring(text, 6, 2).isin("00") | F.substring(text, 9, 2).isin("00")
    full = F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)
    usable = text.rlike(r"^\d{4}(-\d{2}(-\d{2}.*)?)?$") & ~(zero & (F.length(text) >= 10))
    parsed = F.try_to_timestamp(F.regexp_replace(full, "Z$", ""))
    return F.when(usable & (parsed <= F.lit(LAST_TIME).cast("timestamp")) & (parsed >= F.lit(FIRST_TIME).cast("timestamp")), parsed)


def in_scope(value: Column, first: str = "2012-10-29") -> Column:
    return value >= F.lit(first).cast("timestamp")


def exp_decay(seconds: Column, half_life: float = YEAR_SECONDS) -> Column:
    return F.exp(-seconds * (math.log(2) / half_life))


def qid_int(text: Column) -> Column:
    """The number in Q12 or P12; null for anything else."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.trim(text), r"^[\"']?[QP](\d{1,9})[\"']?$", 1), F.lit("")), F.lit("999999999")).cast("int")


def coerce_numeric(text: Column) -> Column:
    """Double of a numeric text, quoted or signed or with _ between digits; null for NaN and the rest."""
    t = F.lower(F.regexp_replace(F.trim(text), r'^[\s"]+|[\s"]+$', ""))
    plain = t.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?$")
    infinite = t.rlike(r"^[+-]?inf(inity)?$")
    number = F.when(plain, F.regexp_replace(t, "_", "").try_cast("double"))
    return F.when(infinite, F.when(t.startswith("-"), float("-inf")).otherwise(float("inf"))).otherwise(number)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin((F.radians(lat2) - F.radians(lat1)) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin((F.radians(lon2) - F.radians(lon1)) / 2) ** 2
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def julian_day(year: Column, month: Column, day: Column) -> Column:
    """Julian day number of a proleptic Gregorian date; years before 1 have no year 0 (year -1 is the one before 1)."""
    y = F.when(year < 0, year + 1).otherwise(year)
    a = F.floor((14 - month) / 12)
    y2, m2 = y + 4800 - a, month + 12 * a - 3
    return (day + F.floor((153 * m2 + 2) / 5) + 365 * y2 + F.floor(y2 / 4) - F.floor(y2 / 100) + F.floor(y2 / 400) - 32045).cast("long")


def time_parts(text: Column) -> Column:
    """Struct of year (signed), month, day, hour, minute and second."""
    names = ["year", "month", "day", "hour", "minute", "second"]
    pattern = r"^[\"']?([+-]?\d+)-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d))?"
    return F.struct(*(F.regexp_extract(text, pattern, k + 1).try_cast("int").alias(n) for k, n in enumerate(names)))


def magnitude(datatype: Column, old: Column, new: Column) -> Column:
    """Size of a change: difference of quantities, days between times, kilometres between coordinates, edits between texts."""

    def day(x: Column) -> Column:
        p = time_parts(x)
        return julian_day(p["year"], p["month"], p["day"])

    def at(x: Column, k: str) -> Column:
        return F.get_json_object(x, f"$.{k}").try_cast("double")

    coordinates = haversine_km(at(old, "latitude"), at(old, "longitude"), at(new, "latitude"), at(new, "longitude"))
    return (
        F.when(datatype == "quantity", coerce_numeric(new) - coerce_numeric(old))
        .when(datatype == "time", (day(new) - day(old)).cast("double"))
        .when(datatype == "globecoordinate", coordinates)
        .otherwise(F.levenshtein(old, new).cast("double"))
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 1) without observations."""
    p, z2 = k / n, z * z
    centre, spread = p + z2 / (2 * n), z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    low, high = (centre - spread) / (1 + z2 / n), (centre + spread) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(high, F.lit(1.0))).otherwise(1.0)
