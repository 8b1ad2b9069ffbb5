"""Deadlines, relative dates and timestamps. "Now" is always an argument."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions import fixed_values as fv
from siftwork.functions.text import hints, windows_after

_M = fv.MONTH_PATTERN
# (pattern, group of year, group of month, group of day), tried in this order
_DATE_FORMS = [
    (rf"(?i)\b{_M}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s*(20\d\d)?\b", 3, 1, 2),
    (rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{_M}\.?,?\s*(20\d\d)?\b", 3, 2, 1),
    (r"\b(20\d\d)-(\d{2})-(\d{2})\b", 1, 2, 3),
    (r"\b(\d{1,2})/(\d{1,2})/(20\d\d|\d{2})\b", 3, 1, 2),
]


def _month_number(m: Column) -> Column:
    named = F.array_position(F.array(*[F.lit(x) for x in fv.MONTHS]), F.substring(F.lower(m), 1, 3)).cast("int")
    return F.when(m.rlike(r"^\d"), m.try_cast("int")).otherwise(named)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """Date from parts, NULL for an impossible one."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"),
                                     F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def parse_date(text: Column, today: Column) -> Column:
    """First date form that parses. Without a year the date rolls to next year once 30 days past."""
    tries = []
    for rx, gy, gm, gd in _DATE_FORMS:
        y = F.regexp_extract(text, rx, gy)
        month = _month_number(F.regexp_extract(text, rx, gm))
        day = F.regexp_extract(text, rx, gd).try_cast("int")
        year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).try_cast("int")
        this = _ymd(F.year(today), month, day)
        guess = F.when(this < F.date_sub(today, fv.ROLL_FORWARD_AFTER_DAYS), _ymd(F.year(today) + 1, month, day)).otherwise(this)
        tries.append(F.when(text.rlike(rx), F.when(y != "", _ymd(year, month, day)).otherwise(guess)))
    return F.coalesce(*tries)


def deadline(text: Column, as_of: Column) -> Column:
    """The first stated application deadline near a cue that is not long past; NULL otherwise."""
    today = F.to_date(as_of)
    found = F.filter(
        F.transform(windows_after(text, fv.DEADLINE_CUE, fv.DEADLINE_WINDOW_CHARS), lambda w: parse_date(w, today)),
        lambda d: d >= F.date_sub(today, fv.DROP_AFTER_DAYS))
    return F.when(hints(text, fv.DEADLINE_HINTS), F.get(found, F.lit(0)))


def is_rolling(text: Column) -> Column:
    return F.coalesce(text.rlike(fv.ROLLING_PATTERN), F.lit(False))


def relative_posted(text: Column, as_of: Column) -> Column:
    """"Posted Today / Yesterday / 12 Days Ago / 30+ Days Ago" -> date."""
    today = F.to_date(as_of)
    days = F.regexp_extract(text, r"(?i)(\d+)\+?\s*days?\s*ago", 1).try_cast("int")
    return (F.when(text.rlike(r"(?i)\btoday\b"), today).when(text.rlike(r"(?i)\byesterday\b"), F.date_sub(today, 1))
            .otherwise(F.date_sub(today, days)))


def since_label(ts: Column, as_of: Column) -> Column:
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0))
    clock = F.date_format(ts, "HH:mm")
    return (F.when(ts.isNull(), F.lit("your first visit"))
            .when(days <= 0, F.concat(F.lit("earlier today, "), clock))
            .when(days == 1, F.concat(F.lit("yesterday, "), clock))
            .when(days < 7, F.concat(F.date_format(ts, "EEEE"), F.lit(", "), clock))
            .otherwise(F.date_format(ts, "d MMM")))


def utc_timestamp(text: Column) -> Column:
    """Mixed ISO dates, naive and offset timestamps -> UTC timestamp; anything else NULL."""
    t = F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2}) (?=\d)", "$1T")
    iso = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(t.rlike(iso), t.try_cast("timestamp"))


def at(as_of: str) -> Column:
    """The moment every relative computation refers to."""
    return F.lit(as_of).cast("timestamp_ntz")
