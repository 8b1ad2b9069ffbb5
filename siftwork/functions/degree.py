"""Degree levels a posting names, the clauses that require one, and the ceiling rule."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions import fixed_values as fv
from siftwork.functions.text import hints, strip

_DOTTED_HINT = r"(?i)\b(?:ph|[abmd])\.\s?[adeps]"      # every dotted degree contains this
_NAMES = sorted(fv.DEGREE_LEVELS, key=fv.DEGREE_LEVELS.get)


def undot(text: Column) -> Column:
    """Take the dots out of dotted degree abbreviations so that they survive clause splitting.

    One pass per abbreviation; the longest spellings come first so a short one cannot split a long one.
    """
    out = F.coalesce(text, F.lit(""))
    for form in fv.DOTTED_DEGREES:
        letters = form.split(".")
        rx = r"\.\s?".join(f"({x})" for x in letters) if form != "A.A.S" else r"(A)\.\s?(A)\.?\s?(S)"
        out = F.regexp_replace(out, rf"(?i)\b{rx}\.?", "".join(f"${i + 1}" for i in range(len(letters))))
    return F.when(text.rlike(_DOTTED_HINT), out).otherwise(F.coalesce(text, F.lit("")))


def _named(text: Column) -> dict[str, Column]:
    hits: dict[str, list[Column]] = {n: [] for n in _NAMES}
    for level, rx in fv.DEGREE_PATTERNS:
        hits[level].append(text.rlike(rx))
    hits["master"].append(text.rlike(fv.GRAD_STUDENT_PATTERN) & ~text.rlike(fv.GRAD_FALSE_FRIENDS))
    hits["bachelor"].append(text.rlike(fv.UNDERGRAD_YEARS))
    return {n: functools.reduce(operator.or_, cs) for n, cs in hits.items()}


def level_mask(text: Column) -> Column:
    """Bit mask of the levels named: 1 associate, 2 bachelor, 4 master, 8 phd."""
    named = _named(text)
    return functools.reduce(operator.add, [
        F.when(named[n], F.lit(1 << (fv.DEGREE_LEVELS[n] - 1))).otherwise(F.lit(0)) for n in _NAMES])


def mask_names(mask: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(1 << (fv.DEGREE_LEVELS[n] - 1)) != 0, F.lit(n)) for n in _NAMES]))


def _clauses(text: Column) -> Column:
    """Clauses that can matter, as struct(text, mask, head, ok): head 1 = "preferred" heading, 2 = "required" heading,
    0 = neither. Degree patterns run only on possible headings and on requirement clauses."""
    parts = F.filter(F.transform(F.split(text, fv.CLAUSE_BREAK, -1), strip), lambda p: p != "")

    def judge(p: Column) -> Column:
        head = F.when(F.length(p) <= fv.HEADING_MAX_CHARS,
                      F.when(p.rlike(fv.PREFERRED_HEADING), F.lit(1)).when(p.rlike(fv.REQUIRED_HEADING), F.lit(2))
                      .otherwise(F.lit(0))).otherwise(F.lit(0))
        ok = ((F.length(p) <= fv.CLAUSE_MAX_CHARS) & hints(p, fv.REQUIREMENT_HINTS) & p.rlike(fv.REQUIREMENT_WORDS)
              & ~p.rlike(fv.OPTIONAL_WORDS) & ~p.rlike(fv.PAY_WORDS))
        return F.struct(p.alias("text"), head.alias("head"), ok.alias("ok"))

    live = F.filter(F.transform(parts, judge), lambda x: (x["head"] > 0) | x["ok"])
    named = F.transform(live, lambda x: F.struct(
        x["text"].alias("text"), x["head"].alias("head"), x["ok"].alias("ok"), level_mask(x["text"]).alias("mask")))
    return F.transform(named, lambda x: F.struct(
        x["text"].alias("text"), x["mask"].alias("mask"), x["ok"].alias("ok"),
        F.when(x["mask"] == 0, x["head"]).otherwise(F.lit(0)).alias("head")))


def _off(st: Column, x: Column) -> Column:
    return F.when(x["head"] == 1, F.lit(True)).when(x["head"] == 2, F.lit(False)).otherwise(st["off"])


def requirement_clauses(text: Column) -> Column:
    """Clauses that state a degree requirement, in order, as one fold inside the row (no shuffle).

    A short clause without a degree can be a heading: "preferred" headings switch clauses off until a
    "required" heading switches them on again.
    """
    none = F.array().cast("array<string>")

    def step(st: Column, x: Column) -> Column:
        keep = F.when(~_off(st, x) & x["ok"], F.array_append(st["kept"], x["text"])).otherwise(st["kept"])
        return F.struct(_off(st, x).alias("off"), keep.alias("kept"))
    fold = F.aggregate(_clauses(undot(text)), F.struct(F.lit(False).alias("off"), none.alias("kept")), step)["kept"]
    return F.when(hints(text, fv.REQUIREMENT_HINTS), fold).otherwise(none)


def description_mask(text: Column) -> Column:
    """Levels named by requirement clauses. Text without a requirement word or a degree skips the clause work."""
    def step(st: Column, x: Column) -> Column:
        add = F.when(~_off(st, x) & x["ok"], x["mask"]).otherwise(F.lit(0))
        return F.struct(_off(st, x).alias("off"), st["mask"].bitwiseOR(add).alias("mask"))
    t = undot(text)
    fold = F.aggregate(_clauses(t), F.struct(F.lit(False).alias("off"), F.lit(0).alias("mask")), step)["mask"]
    return F.when(hints(text, fv.REQUIREMENT_HINTS), fold).otherwise(F.lit(0))


def accepted_mask(title: Column, text: Column) -> Column:
    own = level_mask(undot(title))
    return F.when(own != 0, own).otherwise(F.coalesce(description_mask(text), F.lit(0)))


def degree_mismatch(ceiling: int, title: Column, text: Column) -> Column:
    if not ceiling:
        return F.lit(None).cast("string")
    mask = accepted_mask(title, text)
    out = F.when(mask == 0, None)
    for n in _NAMES:                                   # the lowest named level decides
        level = fv.DEGREE_LEVELS[n]
        hit = mask.bitwiseAND(1 << (level - 1)) != 0
        out = out.when(hit, F.lit(f"{n}-only") if level > ceiling else F.lit(None).cast("string"))
    return out
