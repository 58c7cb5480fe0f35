"""Date layouts given by example (the reference time 2006-01-02 15:04:05) as Spark datetime patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a layout, longest first where one begins another (fixed values), and Spark's pattern for each.
ELEMENTS = (
    ("January", "MMMM"), ("Monday", "EEEE"), ("2006", "yyyy"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("-0700", "xx"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"),
    ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"), ("_2", "d"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
)
RFC3339 = "2006-01-02T15:04:05Z07:00"
DATE_TIME = "2006-01-02 15:04:05"


def parts_of(layout: str) -> list[tuple[str, str]]:
    """The layout as (kind, text): 'p' for a pattern, 't' for literal text."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(layout):
        if layout[i] in ".," and layout[i + 1 : i + 2] in ("0", "9"):
            digit = layout[i + 1]
            n = 0
            while layout[i + 1 + n : i + 2 + n] == digit:
                n += 1
            if not layout[i + 1 + n : i + 2 + n].isdigit():
                fraction = "".join(f"[{layout[i]}{'S' * k}]" for k in range(9, 0, -1)) if digit == "9" else layout[i] + "S" * n
                out.append(("p", fraction))
                i += 1 + n
                continue
        element = next(((x, p) for x, p in ELEMENTS if layout.startswith(x, i)), None)
        if element:
            out.append(("p", element[1]))
            i += len(element[0])
        else:
            out.append(("t", layout[i]))
            i += 1
    return out


def to_pattern(layout: str) -> str:
    """Spark datetime pattern of a layout; literal letters are quoted."""
    quoted = [("'" + t + "'" if t.isalpha() else "''" if t == "'" else t) if kind == "t" else t for kind, t in parts_of(layout)]
    return "".join(quoted).replace("''", "") if "'" not in layout else "".join(quoted)


def parse(value: Column, layout: str = RFC3339) -> Column:
    """Timestamp of the value, null if it does not fit. Seconds may have a fraction that the layout does not name; day names are checked
    for their form only, since Spark's parser takes no day names."""
    parts = parts_of(layout or RFC3339)
    text = value
    names = {"EEEE": "(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day", "EEE": "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"}
    if any(p in names for _, p in parts):
        text = F.regexp_replace(text, "|".join(sorted({names[p] for _, p in parts if p in names}, key=len, reverse=True)), "")
        parts = [x for x in parts if x[1] not in names]
    fixed = "".join(p for _, p in parts)
    pattern = "".join(("'" + t + "'" if t.isalpha() else "''" if t == "'" else t) if kind == "t" else t for kind, t in parts)
    if "ss" in fixed and "S" not in fixed:
        text = F.regexp_replace(text, r"(:\d{2})[.,]\d{1,9}", "$1")
    return F.try_to_timestamp(text, F.lit(pattern))


def render(moment: Column, layout: str = "") -> Column:
    """Text of a timestamp; the empty layout means date and time."""
    return F.date_format(moment, to_pattern(layout or DATE_TIME))
