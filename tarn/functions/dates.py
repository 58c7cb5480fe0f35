"""Dates of the note query language. The clock is always a parameter, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format tokens of the language, longest first where one begins another (fixed values), and Spark's pattern.
TOKENS = (("yyyy", "yyyy"), ("yy", "yy"), ("MMMM", "MMMM"), ("MMM", "MMM"), ("MM", "MM"), ("M", "M"), ("dd", "dd"), ("d", "d"), ("cccc", "EEEE"), ("ccc", "EEE"), ("EEEE", "EEEE"), ("EEE", "EEE"), ("HH", "HH"), ("H", "H"), ("hh", "hh"), ("h", "h"), ("mm", "mm"), ("m", "m"), ("ss", "ss"), ("s", "s"), ("SSS", "SSS"), ("a", "a"), ("ZZ", "xxx"), ("ooo", "DDD"), ("o", "D"), ("q", "Q"))


def keyword(name: str, now: Column) -> Column:
    """Dates by name: today, now, tomorrow, yesterday, and starts and ends of the week, month and year."""
    day = F.date_trunc("day", now)
    week, month, year = (F.date_trunc(unit, now) for unit in ("week", "month", "year"))
    end = lambda start, months, days: F.timestamp_micros(F.unix_micros(F.date_add(F.add_months(F.to_date(start), months), days).cast("timestamp")) - 1000)
    found = {
        "now": now, "today": day, "tomorrow": F.date_add(F.to_date(day), 1).cast("timestamp"), "yesterday": F.date_add(F.to_date(day), -1).cast("timestamp"),
        "sow": week, "som": month, "soy": year, "eow": end(week, 0, 7), "eom": end(month, 1, 0), "eoy": end(year, 12, 0),
    }
    return found[name]


def date(value: Column, pattern: str | None = None) -> Column:
    """Timestamp of a text, null if it is none. Without a pattern ISO dates with an optional time are read."""
    if pattern is not None:
        return F.try_to_timestamp(value, F.lit(to_pattern(pattern)))
    fits = F.regexp_like(value, F.lit(r"^\d{4}-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?)?$"))
    return F.when(fits, F.when(F.length(value) == 7, F.concat(value, F.lit("-01"))).otherwise(value).try_cast("timestamp"))


def to_pattern(tokens: str) -> str:
    out, i = [], 0
    while i < len(tokens):
        if tokens[i] == "'":
            end = tokens.find("'", i + 1)
            end = len(tokens) if end < 0 else end
            out.append(tokens[i : end + 1])
            i = end + 1
            continue
        token = next(((t, p) for t, p in TOKENS if tokens.startswith(t, i)), None)
        out.append(token[1] if token else f"'{tokens[i]}'" if tokens[i].isalpha() else tokens[i])
        i += len(token[0]) if token else 1
    return "".join(out)


def date_format(moment: Column, tokens: str) -> Column:
    """Text by tokens; ``x`` and ``X`` are milliseconds and seconds since 1970."""
    if tokens == "x":
        return F.unix_millis(moment.cast("timestamp")).cast("string")
    if tokens == "X":
        return F.unix_seconds(moment.cast("timestamp")).cast("string")
    return F.date_format(moment, to_pattern(tokens))


def strip_time(moment: Column) -> Column:
    return F.date_trunc("day", moment)


def local_time(moment: Column, zone: str, session_zone: str = "UTC") -> Column:
    return F.convert_timezone(F.lit(session_zone), F.lit(zone), moment.cast("timestamp_ntz"))


#: Parts of a date by name (fixed values) and the field that Spark extracts.
PARTS = {"year": "YEAR", "month": "MONTH", "week": "WEEK", "weekyear": "YEAROFWEEK", "day": "DAY", "hour": "HOUR", "minute": "MINUTE"}


def part(moment: Column, name: str) -> Column:
    if name == "weekday":
        return F.weekday(moment) + 1
    if name == "second":
        return F.floor(F.extract(F.lit("SECOND"), moment)).cast("int")
    if name == "millisecond":
        return (F.extract(F.lit("SECOND"), moment) * 1000 % 1000).cast("int")
    return F.extract(F.lit(PARTS[name]), moment)


def file_day(basename: Column) -> Column:
    """The date in a file name, as yyyy-mm-dd or yyyymmdd."""
    found = F.regexp_extract(basename, r"(\d{4})-?(\d{2})-?(\d{2})", 0)
    return F.try_to_date(F.regexp_replace(found, "-", ""), "yyyyMMdd")
