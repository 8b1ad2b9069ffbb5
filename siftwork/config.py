"""Typed settings. Every knob a query reads is a field here; queries never read files or the clock."""
from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from siftwork.catalog import RoleType, default_catalog
from siftwork.functions import fixed_values as fv


@dataclass(frozen=True)
class RolePick:
    key: str
    weight: int = 70
    label: str = ""
    keywords: tuple[str, ...] = ()      # non-empty = a custom type

    def __post_init__(self):
        """A key is a slug, a weight lies in 0-100, and keywords that could never match between word boundaries are dropped."""
        key = re.sub(r"[^a-z0-9-]+", "-", str(self.key).strip().lower()).strip("-")
        if not key:
            raise ValueError("a role type needs a key")
        words = [str(w).strip().lower() for w in self.keywords]
        object.__setattr__(self, "key", key)
        object.__setattr__(self, "weight", max(0, min(100, int(self.weight))))
        object.__setattr__(self, "keywords", tuple(w for w in words if w and w[0].isalnum() and w[-1].isalnum()))


@dataclass(frozen=True)
class Settings:
    as_of: str = "2024-01-31 00:00:00"
    rubric: str = fv.RUBRIC_VERSION
    profile: str = "cur"
    term: str = "Summer 2027"
    term_also_accept: tuple[str, ...] = ("Spring 2027",)
    alt_terms: tuple[str, ...] = ("Winter 2027",)
    locations: tuple[str, ...] = ("San Francisco", "New York", "NYC", "Vancouver", "Toronto", "Austin", "London")
    remote_ok: bool = True
    strict_location: bool = True
    degrees: tuple[str, ...] = ("bachelor",)
    sponsorship_values: tuple[str, ...] = tuple(fv.SPONSORSHIP_VALUES)
    title_exclude: tuple[str, ...] = tuple(fv.TITLE_EXCLUDE)
    location_exclude: tuple[str, ...] = ("london",)
    unpaid: tuple[str, ...] = tuple(fv.UNPAID_PHRASES)
    clearance: tuple[str, ...] = tuple(fv.CLEARANCE_PHRASES)
    citizenship: tuple[str, ...] = tuple(fv.CITIZENSHIP_PHRASES)
    level: tuple[str, ...] = ()
    other: tuple[str, ...] = ()
    role_types: tuple[RolePick, ...] = (
        RolePick("gpu", 62), RolePick("systems", 58), RolePick("ml", 55), RolePick("robotics", 50),
        RolePick("data", 45), RolePick("hardware", 40))
    excluded_role_types: tuple[str, ...] = ("it", "qa", "quant")
    catalog: tuple[RoleType, ...] = field(default_factory=lambda: tuple(default_catalog()))
    neutral_weight: int = 36
    excluded_weight: int = 12
    title_domain_points: int = 8
    title_domain_cap: int = 16
    desc_domain_points: int = 3
    desc_domain_cap: int = 12
    desc_chars: int = 600
    reputation_weight: float = 0.3
    unknown_reputation: int = 50
    software_keywords: tuple[str, ...] = tuple(fv.SOFTWARE_KEYWORDS)
    software_title_bonus: int = 14
    software_desc_points: int = 3
    software_desc_cap: int = 9
    negative_title: tuple[str, ...] = tuple(fv.NEGATIVE_TITLE)
    negative_title_penalty: int = 30
    hi: int = 64
    lo: int = 36
    triage_weight: float = 0.7
    triage_min_score: int = 35
    triage_batch: int = 40
    triage_chars: int = 500
    batch_size: int = 24
    concurrency: int = 2
    run_token_budget: int = 300_000
    weekly_token_budget: int = 0
    likely_min: int = 68
    reach_min: int = 50
    unread_to_triage: bool = True
    digest_cap: int = 80
    w_skills: float = 0.65
    w_level: float = 0.35
    w_alignment: float = 0.45
    w_quality: float = 0.30
    w_reputation: float = 0.25
    likely_gate: tuple[int, int] = (65, 50)      # likelihood, desirability
    reach_gate: tuple[int, int] = (70, 25)       # desirability, likelihood
    wildcard_min_interest: int = 70
    wildcard_cap: int = 5

    def __post_init__(self):
        object.__setattr__(self, "role_types", tuple({p.key: p for p in self.role_types}.values()))     # the last pick of a key counts
        unknown = [d for d in self.degrees if d.strip().lower() not in fv.DEGREE_LEVELS]
        if unknown:
            raise ValueError(f"unknown degrees {unknown}; use {list(fv.DEGREE_LEVELS)}")

    def but(self, **kw) -> "Settings":
        return replace(self, **kw)

    @property
    def types(self) -> list[RoleType]:
        """Types in tie-break order: custom picks first, then the catalog (a custom key shadows its entry)."""
        custom = [p for p in self.role_types if p.keywords]
        keys = {p.key for p in custom}
        out = [RoleType(i, p.key, p.label or p.key, "Yours", False, tuple(sorted(p.keywords)))
               for i, p in enumerate(custom)]
        out += [RoleType(len(custom) + t.ord, t.key, t.label, t.grp, t.decisive, t.keywords)
                for t in self.catalog if t.key not in keys]
        return out

    @property
    def picked_keywords(self) -> list[str]:
        by_key = {t.key: t.keywords for t in self.catalog}
        return sorted({w for p in self.role_types for w in (p.keywords or by_key.get(p.key, ()))})

    @property
    def negative_words(self) -> list[str]:
        """Off-target title words, minus any word the user asked for."""
        picked = set(self.picked_keywords)
        return [w.strip() for w in self.negative_title if w.strip() and w.strip().lower() not in picked]

    @property
    def degree_ceiling(self) -> int:
        return max((fv.DEGREE_LEVELS[d.strip().lower()] for d in self.degrees), default=0)


DEFAULT = Settings()
