"""The 0-100 local score and the composite rubric score, as column arithmetic."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.config import Settings
from siftwork.functions.phrases import distinct_phrases, is_phrase
from siftwork.functions.plan import once
from siftwork.functions.roles import classify, role_weight
from siftwork.functions.text import bounded_rx, trim_boilerplate


def clamp100(x: Column) -> Column:
    """Half-even rounding, then clamp."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x).cast("int")))


def keyword_hits(text: Column, words) -> Column:
    """Distinct keywords found, lower-cased, as one alternation in list order finds them. Phrases of whole words are looked up;
    the few keywords that begin or end otherwise (c++) are tested by a pattern each and must not share a word with another."""
    low = F.lower(text)
    words = [w.lower() for w in words]
    found = distinct_phrases(low, [w for w in words if is_phrase(w)]) if any(map(is_phrase, words)) else F.array().cast("array<string>")
    odd = [w for w in words if not is_phrase(w)]
    if not odd:
        return found
    tested = F.array(*[F.when(low.contains(w), F.when(low.rlike(bounded_rx([w], "")), F.lit(w))) for w in odd])
    return F.concat(found, F.array_compact(tested))


def description_head(s: Settings, text: Column) -> Column:
    return F.substring(trim_boilerplate(F.coalesce(text, F.lit(""))), 1, s.desc_chars)


def add_local_score(s: Settings, df: DataFrame) -> DataFrame:
    """Add role, score, why, unread, off_target and band to rows with title, company_name, description_text and
    reputation (NULL = unknown company). Intermediate columns keep each regex in the plan once."""
    none = F.array().cast("array<string>")
    zero = F.lit(0)
    df = df.withColumns({
        "_title": F.coalesce("title", F.lit("")),
        "unread": F.col("description_text").isNull(),
        "_head": description_head(s, F.col("description_text")),
    })
    df = once(df, _role=classify(s, F.col("title"), F.col("company_name")), _title_hits=keyword_hits(F.col("_title"), s.picked_keywords),
              _head_hits=keyword_hits(F.col("_head"), s.picked_keywords), _soft_hits=F.when(F.col("unread"), zero).otherwise(F.size(keyword_hits(F.col("_head"), s.software_keywords))))
    df = df.withColumns({
        "role": F.col("_role"),
        "_soft_title": F.col("_title").rlike(bounded_rx(s.software_keywords)),
        "_off": F.lower(F.regexp_extract("_title", "(" + bounded_rx(s.negative_words) + ")", 1)),
    }).withColumns({
        "off_target": F.col("_off") != "",
        "_desc_hits": F.when(F.col("unread"), none).otherwise(F.array_except("_head_hits", "_title_hits")),
    })
    total = (role_weight(s, F.col("role")).cast("double")
             + F.least(F.lit(s.title_domain_cap), F.size("_title_hits") * s.title_domain_points)
             + F.when(F.col("_soft_title"), F.lit(s.software_title_bonus)).otherwise(zero)
             + F.least(F.lit(s.desc_domain_cap), F.size("_desc_hits") * s.desc_domain_points)
             + F.least(F.lit(s.software_desc_cap), F.col("_soft_hits") * s.software_desc_points)
             + F.coalesce((F.col("reputation") - s.unknown_reputation) * F.lit(s.reputation_weight), F.lit(0.0))
             - F.when(F.col("off_target"), F.lit(s.negative_title_penalty)).otherwise(zero))
    shown = F.when(F.size("_title_hits") > 0, F.lit(1)).otherwise(F.lit(2))
    why = F.slice(F.concat(
        F.slice(F.array_sort("_title_hits"), 1, 2),
        F.when(F.col("_soft_title"), F.array(F.lit("software title"))).otherwise(none),
        F.slice(F.array_sort("_desc_hits"), F.lit(1), shown),
        F.when(F.col("reputation") >= 70, F.array(F.lit("known company"))).otherwise(none),
        F.when(F.col("off_target"), F.array(F.concat(F.lit("off-target: "), F.col("_off")))).otherwise(none)), 1, 6)
    df = once(df, score=clamp100(total)).withColumn("why", why)
    df = df.withColumn("band", band(s, F.col("score"), F.col("unread"), F.col("off_target")))
    return df.drop("_role", "_title", "_head", "_title_hits", "_head_hits", "_soft_hits", "_soft_title", "_off", "_desc_hits")


def band(s: Settings, score: Column, unread: Column, off_target: Column) -> Column:
    out = F.when(score >= s.hi, F.lit("yes"))
    if s.unread_to_triage:
        out = out.when((score <= s.lo) & unread & ~off_target, F.lit("ambiguous"))
    return out.when(score <= s.lo, F.lit("no")).otherwise(F.lit("ambiguous"))


def fast_bucket(s: Settings, score: Column) -> Column:
    return F.when(score >= s.likely_min, F.lit("likely")).when(score >= s.reach_min, F.lit("reach")).otherwise(F.lit("archive"))


def blend(s: Settings, local: Column, external: Column) -> Column:
    return F.when(external.isNull(), local).otherwise(
        clamp100(external * F.lit(s.triage_weight) + local * F.lit(1 - s.triage_weight)))


def likelihood(s: Settings, skills: Column, level: Column) -> Column:
    return clamp100(skills * F.lit(s.w_skills) + level * F.lit(s.w_level))


def desirability(s: Settings, alignment: Column, quality: Column, reputation: Column) -> Column:
    return clamp100(alignment * F.lit(s.w_alignment) + quality * F.lit(s.w_quality) + reputation * F.lit(s.w_reputation))


def rubric_bucket(s: Settings, lik: Column, des: Column, interest: Column, wildcard: Column) -> Column:
    return (F.when((lik >= s.likely_gate[0]) & (des >= s.likely_gate[1]), F.lit("likely"))
            .when((des >= s.reach_gate[0]) & (lik >= s.reach_gate[1]), F.lit("reach"))
            .when(wildcard & (interest >= s.wildcard_min_interest), F.lit("wildcard"))
            .otherwise(F.lit("archive")))
