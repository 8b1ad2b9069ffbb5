"""Role-type classification over the catalog: a phrase dictionary lookup per text, no join, no shuffle."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.catalog import GENERAL, GENERAL_LABEL
from siftwork.config import Settings
from siftwork.functions import fixed_values as fv
from siftwork.functions.phrases import group_counts, let, literal

TAG_WEIGHT, SUMMARY_WEIGHT, MIN_FALLBACK = 2, 1, 2


def alternation(words) -> str:
    """Longest keyword first, so a phrase wins over a word inside it; one boundary pair around the lot."""
    ordered = sorted(words, key=len, reverse=True)
    return rf"(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in ordered)})(?![a-z0-9])"


def role_hits(s: Settings, low: Column) -> Column:
    """array<struct<g, hits>>: distinct keywords of each role type (by its place in ``role_names``) in lower-cased text."""
    return group_counts(low, [t.keywords for t in _typed(s)])


def role_names(s: Settings) -> list[str]:
    return [t.key for t in _typed(s)]


def _typed(s: Settings) -> list:
    return [t for t in s.types if t.keywords]


def is_trading_firm(company: Column) -> Column:
    return F.coalesce(F.lower(company).rlike(alternation(fv.TRADING_FIRMS)), F.lit(False))


def _best(names: Column, hits: Column, floor: int) -> Column:
    """Name of the type with most hits, above ``floor``; the earlier type wins ties."""
    top = F.array_max(F.transform(F.filter(hits, lambda h: h["hits"] > floor), lambda h: F.struct(h["hits"].alias("n"), (-h["g"]).alias("o"))))
    return F.get(names, -top["o"])


def classify(s: Settings, title: Column, company: Column | None = None, tags: Column | None = None,
             summary: Column | None = None) -> Column:
    """One role key per posting: decisive title, trading firm, most distinct title hits, tags and summary, general."""
    names = F.expr(literal(role_names(s)))
    decisive = [i for i, t in enumerate(_typed(s)) if t.decisive]
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    firm = F.when(is_trading_firm(company), F.lit("quant")) if company is not None else F.lit(None).cast("string")

    def of_title(hits: Column) -> Column:
        first = F.array_min(F.filter(F.transform(hits, lambda h: h["g"]), lambda g: g.isin(decisive))) if decisive else F.lit(None).cast("int")
        return F.coalesce(F.get(names, first), firm, _best(names, hits, 0))

    steps = [let(role_hits(s, low(title)), of_title)]

    def weighted(text: Column, weight: int) -> Column:
        return F.transform(role_hits(s, low(text)), lambda h: F.struct(h["g"].alias("g"), (h["hits"] * weight).alias("hits")))

    weighed = [weighted(c, w) for c, w in ((tags, TAG_WEIGHT), (summary, SUMMARY_WEIGHT)) if c is not None]
    if weighed:
        def summed(both: Column) -> Column:
            groups = F.array_distinct(F.transform(both, lambda h: h["g"]))
            points = lambda g: F.aggregate(F.filter(both, lambda h: h["g"] == g), F.lit(0), lambda a, h: a + h["hits"])
            return _best(names, F.transform(groups, lambda g: F.struct(g.alias("g"), points(g).alias("hits"))), MIN_FALLBACK - 1)
        steps.append(let(F.concat(*weighed), summed))
    return F.coalesce(*steps, F.lit(GENERAL))


def literal_map(key: Column, mapping: dict, default: Column) -> Column:
    """Look a small literal mapping up; ``key`` appears once in the plan."""
    if not mapping:
        return default
    entries = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), default)


def role_label(s: Settings, role: Column) -> Column:
    return literal_map(role, {**{t.key: t.label for t in s.types}, GENERAL: GENERAL_LABEL}, role)


def role_order(s: Settings, role: Column) -> Column:
    keys = [t.key for t in s.types] + [GENERAL]
    return literal_map(role, {k: i for i, k in enumerate(keys)}, F.lit(99))


def role_weight(s: Settings, role: Column) -> Column:
    picked = {p.key: p.weight for p in s.role_types}
    others = {k: s.excluded_weight for k in s.excluded_role_types if k not in picked}
    return literal_map(role, {**picked, **others}, F.lit(s.neutral_weight))
