"""Durations as (months, micros): months and days have no common unit, so the two parts are kept apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Units by their spellings (fixed values): months or microseconds of one unit.
UNITS = {
    ("s", "sec", "secs", "second", "seconds"): (0, SECOND),
    ("m", "min", "mins", "minute", "minutes"): (0, 60 * SECOND),
    ("h", "hr", "hrs", "hour", "hours"): (0, 3600 * SECOND),
    ("d", "day", "days"): (0, 86_400 * SECOND),
    ("w", "wk", "wks", "week", "weeks"): (0, 7 * 86_400 * SECOND),
    ("mo", "month", "months"): (1, 0),
    ("yr", "yrs", "year", "years"): (12, 0),
}
SPELLED = {name: size for names, size in UNITS.items() for name in names}
ONE = r"(\d+(?:\.\d+)?)\s*(" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r")\b"
ALL = rf"^\s*(?:{ONE}\s*,?\s*)+$"


def parse_text(text: str) -> tuple[int, int] | None:
    """(months, micros) of a text like ``1 yr, 2d 3h``; None if it is not a duration."""
    if not re.match(ALL, text, re.IGNORECASE):
        return None
    months = micros = 0.0
    for number, unit in re.findall(ONE, text, re.IGNORECASE):
        m, u = SPELLED[unit.lower()]
        months += float(number) * m
        micros += float(number) * u
    return int(months), round(micros)


def duration(value: Column) -> Column:
    """Struct (months int, micros bigint) of a text column, null if it is not a duration; native expressions only."""
    text = F.lower(value)
    numbers = F.regexp_extract_all(text, F.lit(ONE), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(ONE), F.lit(2))
    months, micros = (F.expr("map(" + ", ".join(f"'{k}', {float(sizes[i])}D" for k, sizes in SPELLED.items()) + ")") for i in (0, 1))
    total = lambda sizes: F.aggregate(F.zip_with(numbers, units, lambda n, u: n.cast("double") * sizes[u]), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.regexp_like(text, F.lit(ALL)), F.struct(F.floor(total(months)).cast("int").alias("months"), F.round(total(micros)).cast("bigint").alias("micros")))


def total(values: Column) -> Column:
    """Sum of a list of durations, part by part."""
    add = lambda name: F.aggregate(F.transform(values, lambda x: x[name].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.struct(add("months").cast("int").alias("months"), add("micros").alias("micros"))


#: Parts of a duration by name (fixed values), from the largest: microseconds of one, 0 where it is made of months.
PARTS = {"years": 0, "months": 0, "weeks": 7 * 86_400 * SECOND, "days": 86_400 * SECOND, "hours": 3600 * SECOND, "minutes": 60 * SECOND, "seconds": SECOND, "milliseconds": 1000}
DAY = 86_400 * SECOND


def length(value: Column) -> Column:
    """Microseconds that a duration is compared by: 365 days for twelve months, 30 for each month beyond them."""
    months = value["months"].cast("bigint")
    days = (months - months % 12) / 12 * 365 + months % 12 * 30
    return F.round(days).cast("bigint") * F.lit(DAY) + value["micros"]


def add(left: Column, right: Column, sign: int = 1) -> Column:
    return F.struct((left["months"] + sign * right["months"]).alias("months"), (left["micros"] + sign * right["micros"]).alias("micros"))


def times(value: Column, factor: Column) -> Column:
    """A duration several times over; what is left of a month counts 30 days."""
    months = value["months"] * factor.cast("double")
    whole = F.when(months < 0, F.ceil(months)).otherwise(F.floor(months))
    micros = F.round(value["micros"] * factor.cast("double") + (months - whole) * F.lit(30.0 * DAY)).cast("bigint")
    return F.struct(whole.cast("int").alias("months"), micros.alias("micros"))


def part(value: Column, name: str) -> Column:
    """Whole years, months, weeks, days and so on of a duration, each of what the larger parts leave."""
    size = PARTS[name]
    whole = lambda c, n: ((c - c % n) / n).cast("bigint")
    if name in ("years", "months"):
        return whole(value["months"], 12) if name == "years" else (value["months"] % 12).cast("bigint")
    larger = min((s for s in PARTS.values() if s > size), default=None)
    return whole(value["micros"] if larger is None else value["micros"] % larger, size)


def text(value: Column) -> Column:
    """``1 year, 2 months, 3 days``: the parts that aren't 0."""

    def written(name: str) -> Column:
        n = part(value, name)
        return F.when(n != 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, name[:-1]).otherwise(name)))

    parts = F.array_compact(F.array(*(written(name) for name in PARTS if name != "milliseconds")))
    return F.when(value.isNotNull(), F.when(F.size(parts) == 0, "0 seconds").otherwise(F.array_join(parts, ", ")))


def summed(value: Column) -> Column:
    """Aggregate: sum of a column of durations, months and microseconds apart; null without rows."""
    return F.when(F.count(value) > 0, F.struct(F.sum(value["months"]).cast("int").alias("months"), F.sum(value["micros"]).alias("micros")))


def plus(moment: Column, length: Column, sign: int = 1) -> Column:
    """A timestamp moved by a duration: calendar months first, then exact time."""
    moved = F.add_months(F.to_date(moment), sign * length["months"]).cast("timestamp")
    time = F.unix_micros(moment.cast("timestamp")) - F.unix_micros(F.date_trunc("day", moment.cast("timestamp")))
    return F.timestamp_micros(F.unix_micros(moved) + time + sign * length["micros"])


def seconds(length: Column) -> Column:
    """Seconds of a duration without months; null otherwise, since months have no fixed length."""
    return F.when(length["months"] == 0, length["micros"] / F.lit(SECOND))


def minutes_text(minutes: Column) -> Column:
    """``95`` as ``1h 35m``, ``60`` as ``1h``, ``5`` as ``5m``."""
    whole = F.floor(minutes).cast("bigint")
    hours, rest = F.floor(whole / 60).cast("bigint"), whole % 60
    return F.when(hours == 0, F.concat(rest.cast("string"), F.lit("m"))).when(rest == 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))
