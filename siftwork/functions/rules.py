"""Rejection rules. Each is a boolean Column; ``first_reason`` chains them in their fixed order."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.config import Settings
from siftwork.functions import fixed_values as fv
from siftwork.functions.degree import degree_mismatch
from siftwork.functions.terms import term_mismatch
from siftwork.functions.text import contains_any, holds_any, let, literal_rx, match_windows, words_rx


def sponsorship_blocked(s: Settings, sponsorship: Column) -> Column:
    return F.coalesce(contains_any(sponsorship, s.sponsorship_values), F.lit(False))


def title_excluded(s: Settings, title: Column) -> Column:
    words = [w for w in s.title_exclude if w]
    return title.rlike(rf"(?i)\b(?:{literal_rx(words)})") if words else F.lit(False)


def firmware_signals(title: Column, text: Column) -> Column:
    body = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    return functools.reduce(operator.add, [body.rlike("(?i)" + rx).cast("int") for rx in fv.FIRMWARE_SIGNALS])


def firmware_heavy(title: Column, text: Column) -> Column:
    gate = title.rlike(words_rx(fv.FIRMWARE_TITLE_GATE))
    return F.when(title.rlike(r"(?i)\bfirmware\b"), F.lit(True)).when(
        gate, firmware_signals(title, text) >= fv.FIRMWARE_MIN_SIGNALS).otherwise(F.lit(False))


def place_not_allowed(s: Settings, location: Column) -> Column:
    if not s.strict_location or not s.locations:
        return F.lit(False)
    out = (F.coalesce(location, F.lit("")) != "") & ~contains_any(location, s.locations)
    return out & ~location.rlike(r"(?i)\bremote\b") if s.remote_ok else out


def place_excluded(s: Settings, title: Column, location: Column) -> Column:
    return F.coalesce(contains_any(location, s.location_exclude), F.lit(False)) | F.coalesce(
        contains_any(title, s.location_exclude), F.lit(False))


def haystack(title: Column, location: Column, text: Column) -> Column:
    def blank_out(c):
        return F.when(c == "", None).otherwise(c)
    return F.concat_ws("\n", blank_out(title), blank_out(location), blank_out(text))


def unpaid_in_context(body: Column) -> Column:
    """An unpaid-type phrase counts only with a pay word within 60 characters; benefit wording never does."""
    near = match_windows(body, fv.UNPAID_PATTERN, 60, 60)
    return F.exists(near, lambda w: w.rlike(words_rx(fv.PAY_CONTEXT_WORDS)))


def unpaid(s: Settings, body: Column) -> Column:
    return unpaid_in_context(body) | contains_any(body, [n for n in s.unpaid if n.lower() != "unpaid"])


def first_reason(s: Settings, *, title: Column, location: Column, terms: Column, text: Column,
                 sponsorship: Column) -> Column:
    """Reason code of the first rule that rejects, or NULL. ``coalesce``/``when`` stop at the first hit."""
    body = haystack(title, location, text)
    out = (F.when(term_mismatch(s, title, terms), F.lit("term_mismatch"))
           .when(sponsorship_blocked(s, sponsorship), F.lit("citizenship"))
           .when(title_excluded(s, title), F.lit("out_of_scope"))
           .when(firmware_heavy(title, text), F.lit("firmware_heavy"))
           .when(place_not_allowed(s, location), F.lit("location_not_allowed"))
           .when(place_excluded(s, title, location), F.lit("location_excluded")))

    def text_rules(low: Column) -> Column:
        """The rules that read the whole text share one lower-cased copy of it."""
        last = F.when(unpaid_in_context(body) | holds_any(low, [n for n in s.unpaid if n.lower() != "unpaid"]), F.lit("unpaid"))
        for code, needles in (("clearance", s.clearance), ("citizenship", s.citizenship), ("level", s.level), ("other", s.other)):
            if needles:
                last = last.when(holds_any(low, needles), F.lit(code))
        return last.otherwise(degree_mismatch(s.degree_ceiling, title, text))
    return out.otherwise(let(F.lower(body), text_rules))
