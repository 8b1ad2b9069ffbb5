"""The three "latest row" rules. All are map-side combined aggregates, so a hot key never lands in one sort."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import fixed_values as fv


def _latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*")


def latest_rubric_preferred(evals: DataFrame, profile: str, rubric: str) -> DataFrame:
    """Per job: a row of the current rubric first, then the newest, then the last written."""
    mine = evals.where(F.col("profile_hash") == profile)
    return _latest(mine, "job_id", [(F.col("rubric_version") == rubric).alias("a"), F.col("created_at").alias("b"), F.col("eval_seq").alias("c")])


def latest_by_seq(evals: DataFrame, profile: str) -> DataFrame:
    return _latest(evals.where(F.col("profile_hash") == profile), "job_id", [F.col("eval_seq")])


def latest_by_time(evals: DataFrame) -> DataFrame:
    return _latest(evals, "job_id", [F.col("created_at").alias("a"), F.col("eval_seq").alias("b")])


def latest_status(apps: DataFrame) -> DataFrame:
    """Last writer wins on status; the newest non-NULL note is kept."""
    when = F.struct("updated_at", "event_id")
    return apps.groupBy("job_id").agg(
        F.max_by("status", when).alias("status"), F.max("updated_at").alias("updated_at"),
        F.max_by("note", F.when(F.col("note").isNotNull(), when)).alias("note"))


def replace_evaluations(evals: DataFrame) -> DataFrame:
    """One row per (job, rubric, profile): the last written."""
    keys = ["job_id", "rubric_version", "profile_hash"]
    rest = [c for c in evals.columns if c not in keys]
    return evals.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("eval_seq")).alias("_r")).select(*keys, "_r.*")


def current_rows(evals: DataFrame, postings: DataFrame, apps: DataFrame, companies: DataFrame, profile: str, rubric: str) -> DataFrame:
    """Latest evaluation of each active posting with its application status (default ``new``) and company tier."""
    return (latest_rubric_preferred(evals, profile, rubric).join(postings.where("active"), "job_id")
            .join(latest_status(apps).select("job_id", F.col("status").alias("app_status"), F.col("note").alias("app_note"),
                                             F.col("updated_at").alias("app_updated_at")), "job_id", "left")
            .join(companies.select("company_id", "tier"), "company_id", "left")
            .withColumn("app_status", F.coalesce("app_status", F.lit("new"))))


def carry_over(evals: DataFrame, postings: DataFrame, profile: str, rubric: str) -> DataFrame:
    """Newest same-rubric evaluation of each job that has none under the current profile, re-stamped; term-shaped
    rejects are marked for another look, rule and local rows are left behind."""
    same = evals.where(F.col("rubric_version") == rubric)
    have = same.where(F.col("profile_hash") == profile).select("job_id")
    newest = _latest(same, "job_id", [F.col("created_at").alias("a"), F.col("eval_seq").alias("b")])
    rows = newest.where((F.col("profile_hash") != profile) & ~F.col("model").isin("prefilter", "local")).join(have, "job_id", "left_anti").join(
        postings.where(F.col("active") & ~F.coalesce(F.col("needs_reeval"), F.lit(False))).select("job_id"), "job_id", "left_semi")
    again = F.coalesce(F.col("hard_reject_reason").rlike(fv.TERM_REASON), F.lit(False))
    return rows.withColumn("outcome", F.when(again, F.lit("requeued")).otherwise(F.lit("carried"))).withColumn(
        "profile_hash", F.when(again, F.col("profile_hash")).otherwise(F.lit(profile)))


def stale_jobs(postings: DataFrame, evals: DataFrame, profile: str, rubric: str) -> DataFrame:
    """Active postings with text (even empty) but no row for (rubric, profile). Empty text = rejected before its
    text was fetched: that marker is lifted (text becomes NULL) so the rules look again."""
    have = evals.where((F.col("profile_hash") == profile) & (F.col("rubric_version") == rubric)).select("job_id")
    rows = postings.where(F.col("active") & F.col("description_text").isNotNull()).join(have, "job_id", "left_anti")
    return rows.select("job_id", (F.col("description_text") == "").alias("requeued"), (F.col("description_text") != "").alias("needs_reeval"))
