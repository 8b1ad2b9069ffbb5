"""Scoring jobs: local scores for postings and the pending-queue scoring run."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.config import Settings
from siftwork.functions import rules, scoring, terms
from siftwork.functions.plan import once
from siftwork.operators.lookup import reputation_by_slug


def scored_postings(s: Settings, postings: DataFrame, companies: DataFrame) -> DataFrame:
    return scoring.add_local_score(s, reputation_by_slug(postings, companies))


def with_reason(s: Settings, rows: DataFrame) -> DataFrame:
    return once(rows, reason=rules.first_reason(
        s, title=F.col("title"), location=F.col("location"), terms=terms.split_terms(F.col("terms_txt")),
        text=F.col("description_text"), sponsorship=F.col("sponsorship")))


def score_pending(s: Settings, queue: DataFrame, companies: DataFrame) -> DataFrame:
    """Evaluation rows for a pending queue: rule rejects and local scores, in one pass without a second scan.

    A rejected row loses its title and text before scoring, so the patterns of the score run on passing rows only.
    """
    judged = with_reason(s, queue)
    judged = judged.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("title", "description_text")})
    rows = scored_postings(s, judged, companies)
    rejected = F.col("reason").isNotNull()
    return rows.select(
        "job_id", F.when(rejected, F.lit("prefilter")).otherwise(F.lit("local")).alias("model"),
        F.col("reason").alias("hard_reject_reason"), F.when(~rejected, F.col("score")).alias("likelihood"),
        F.when(~rejected, F.col("band")).alias("band"),
        F.when(rejected, F.lit("archive")).otherwise(scoring.fast_bucket(s, F.col("score"))).alias("bucket"))
