"""The library's rules as SQL functions, for sessions whose users write SQL only.

``register`` defines temporary scalar functions and table functions in the session. Their bodies are SQL expressions, so Catalyst inlines
them: a query that uses them plans as if the expression had been written out. Numbers come from ``Settings``.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

from siftwork.config import Settings
from siftwork.functions import fixed_values as fv


def definitions(s: Settings) -> dict[str, str]:
    """Function name -> signature and body."""
    likely, reach = s.likely_gate, s.reach_gate
    words = "|".join(fv.INTERNSHIP_WORDS).replace("\\", "\\\\").replace("'", "\\'")
    return {
        "clamp100": "(x DOUBLE) RETURNS INT RETURN greatest(0, least(100, CAST(bround(x) AS INT)))",
        "likelihood": f"(skills INT, level INT) RETURNS INT RETURN clamp100(skills * {s.w_skills}D + level * {s.w_level}D)",
        "desirability": f"(alignment INT, quality INT, reputation INT) RETURNS INT RETURN clamp100(alignment * {s.w_alignment}D + quality * {s.w_quality}D + reputation * {s.w_reputation}D)",
        "rubric_bucket": f"""(lik INT, des INT, interest INT, wildcard BOOLEAN) RETURNS STRING RETURN CASE WHEN lik >= {likely[0]} AND des >= {likely[1]} THEN 'likely'
 WHEN des >= {reach[0]} AND lik >= {reach[1]} THEN 'reach' WHEN wildcard AND interest >= {s.wildcard_min_interest} THEN 'wildcard' ELSE 'archive' END""",
        "blend_score": f"(local INT, external INT) RETURNS INT RETURN CASE WHEN external IS NULL THEN local ELSE clamp100({s.triage_weight}D * external + (1 - {s.triage_weight}D) * local) END",
        "is_internship": f"(title STRING) RETURNS BOOLEAN RETURN coalesce(title, '') RLIKE '(?i)\\\\b(?:{words})\\\\b'",
        "split_list": "(packed STRING) RETURNS TABLE (position INT, item STRING) RETURN SELECT pos, col FROM posexplode(split(packed, '\\\\|')) WHERE packed <> ''",
    }


def register(spark: SparkSession, s: Settings) -> list[str]:
    """Define all functions in the session (again, if they are) and return their names."""
    found = definitions(s)
    for name, text in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}")
    return list(found)
