"""Work queues: which postings wait for which step."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import fixed_values as fv


def readable(text: Column, failures: Column) -> Column:
    """Text present, or given up on after repeated fetch failures (scored from metadata alone)."""
    return (text.isNotNull() & (text != "")) | (text.isNull() & (F.coalesce(failures, F.lit(0)) >= fv.FETCH_GIVE_UP))


def pending_fast(postings: DataFrame, evals: DataFrame, profile: str) -> DataFrame:
    """Active readable postings without any evaluation under the profile (anti join on the job id)."""
    done = evals.where(F.col("profile_hash") == profile).select("job_id")
    return postings.where(F.col("active") & readable(F.col("description_text"), F.col("fetch_failures"))).join(done, "job_id", "left_anti")


def pending_evaluation(postings: DataFrame, evals: DataFrame, profile: str, rubric: str) -> DataFrame:
    """As above but rubric-aware: flagged rows, or no row for (rubric, profile), unless an older rubric already
    archived or rejected the posting under the same profile. Both tests are one aggregate per job."""
    mine = evals.where(F.col("profile_hash") == profile).groupBy("job_id").agg(
        F.max(F.col("rubric_version") == rubric).alias("_current"),
        F.max((F.col("rubric_version") != rubric) & ((F.col("bucket") == "archive") | F.col("hard_reject_reason").isNotNull())).alias("_closed"))
    rows = postings.where(F.col("active") & readable(F.col("description_text"), F.col("fetch_failures"))).join(mine, "job_id", "left")
    flagged = F.coalesce(F.col("needs_reeval"), F.lit(False))
    keep = flagged | (~F.coalesce(F.col("_closed"), F.lit(False)) & ~F.coalesce(F.col("_current"), F.lit(False)))
    return rows.where(keep).drop("_current", "_closed")


def needs_description(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("active") & F.col("description_text").isNull()
                          & (F.coalesce(F.col("fetch_failures"), F.lit(0)) < fv.FETCH_GIVE_UP))


def json_band(raw: Column) -> Column:
    return F.get_json_object(raw, "$.fast.band")


def ambiguous_queue(evals: DataFrame, postings: DataFrame, profile: str) -> DataFrame:
    """Active postings whose local evaluation is in the ambiguous band."""
    e = evals.where((F.col("profile_hash") == profile) & (F.col("model") == "local") & (json_band(F.col("raw")) == "ambiguous"))
    return e.select("job_id", "eval_seq", "likelihood").join(postings.where("active"), "job_id")
