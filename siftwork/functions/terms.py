"""Work-term labels: which (season, year) pairs a posting claims and whether they fit the profile."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.config import Settings

_SEASON_YEAR = r"(?i)\b(spring|summer|fall|autumn|winter)\s*(?:of\s*)?(20\d\d)\b"
_SEASON = r"(?i)\b(spring|summer|fall|autumn|winter)\b"
_YEAR = r"\b(20\d\d)\b"


def parse_label(label: str) -> tuple[str, str]:
    """(season or '', year or '') of a profile label."""
    m = re.search(_SEASON_YEAR, label or "")
    if m:
        return m.group(1).lower().replace("autumn", "fall"), m.group(2)
    y = re.search(_YEAR, label or "")
    return "", (y.group(1) if y else "")


def accepted_pairs(labels) -> list[tuple[str, str]]:
    return [p for p in map(parse_label, labels) if p[1]]


def split_terms(terms_txt: Column) -> Column:
    return F.filter(F.split(F.coalesce(terms_txt, F.lit("")), "\\|"), lambda t: t != "")


def _pair(t: Column) -> Column:
    season = F.lower(F.regexp_extract(t, _SEASON_YEAR, 1))
    year = F.regexp_extract(t, _SEASON_YEAR, 2)
    return F.struct(
        F.when(season == "autumn", F.lit("fall")).otherwise(season).alias("season"),
        F.when(year != "", year).otherwise(F.regexp_extract(t, _YEAR, 1)).alias("year"))


def claimed_terms(title: Column, terms: Column) -> Column:
    """Array of struct(season, year); NULL when the posting says nothing. Structured terms beat the title."""
    parsed = F.filter(F.transform(terms, _pair), lambda p: p["year"] != "")
    years = F.array_distinct(F.regexp_extract_all(title, F.lit(_YEAR), F.lit(1)))
    seasons = F.array_distinct(F.transform(
        F.regexp_extract_all(title, F.lit(_SEASON), F.lit(1)),
        lambda s: F.when(F.lower(s) == "autumn", F.lit("fall")).otherwise(F.lower(s))))
    seasons = F.when(F.size(seasons) == 0, F.array(F.lit(""))).otherwise(seasons)
    crossed = F.flatten(F.transform(years, lambda y: F.transform(
        seasons, lambda s: F.struct(s.alias("season"), y.alias("year")))))
    return (F.when(F.size(F.coalesce(parsed, F.array())) > 0, parsed)
            .when(F.size(years) > 0, crossed))


def any_match(claimed: Column, pairs: list[tuple[str, str]]) -> Column:
    def fits(p: Column) -> Column:
        out = F.lit(False)
        for season, year in pairs:
            same = F.lit(True) if not season else ((p["season"] == "") | (p["season"] == season))
            out = out | ((p["year"] == year) & same)
        return out
    return F.coalesce(F.exists(claimed, fits), F.lit(False))


def primary_pairs(s: Settings):
    return accepted_pairs([s.term, *s.term_also_accept])


def alt_pairs(s: Settings):
    return accepted_pairs(s.alt_terms)


def term_mismatch(s: Settings, title: Column, terms: Column) -> Column:
    accepted = primary_pairs(s) + alt_pairs(s)
    if not accepted:
        return F.lit(False)
    claimed = claimed_terms(title, terms)
    return claimed.isNotNull() & ~any_match(claimed, accepted)


def term_track(s: Settings, title: Column, terms: Column) -> Column:
    if not s.alt_terms:
        return F.lit("primary")
    claimed = claimed_terms(title, terms)
    first, second = any_match(claimed, primary_pairs(s)), any_match(claimed, alt_pairs(s))
    return F.when(first & ~second, F.lit("primary")).when(second & ~first, F.lit("alt")).otherwise(F.lit("unknown"))


def in_track(track: Column, want: str) -> Column:
    return F.lit(True) if want == "all" else (track == want) | (track == "unknown")


def term_labels(s: Settings) -> dict[str, str]:
    return {"primary": " / ".join([s.term, *s.term_also_accept]), "alt": " / ".join(s.alt_terms)}


def term_badge(s: Settings, title: Column, terms: Column) -> Column:
    """Struct(track, term_label, term_hint)."""
    track, claimed, names = term_track(s, title, terms), claimed_terms(title, terms), term_labels(s)
    label = (F.when(track == "primary", F.lit(names["primary"])).when(track == "alt", F.lit(names["alt"]))
             .when(claimed.isNotNull(), F.lit("either term")).otherwise(F.lit("term unstated")))
    hint = (F.when(claimed.isNotNull() & (F.size(terms) > 0), F.concat(F.lit("posting says: "), F.array_join(terms, ", ")))
            .when(claimed.isNotNull(), F.lit("term read from the title"))
            .otherwise(F.lit("the posting does not state a work term")))
    return F.struct(track.alias("track"), label.alias("term_label"), hint.alias("term_hint"))
