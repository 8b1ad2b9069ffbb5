"""X: scores, bands, buckets, blending and batch inference."""
from pyspark.sql import functions as F

from siftwork.config import DEFAULT as S
from siftwork.functions import fixed_values as fv, scoring
from siftwork.operators import lookup, packing
from siftwork.operators.queues import ambiguous_queue, pending_fast
from siftwork.operators.ranking import top_rank
from siftwork.operators.scores import score_pending, scored_postings
from siftwork.plans import oracle as o
from siftwork.plans.q_rules import RULE_COLUMNS, _READ, reason
from siftwork.plans.q_text import TRIAGE_SQL
from siftwork.plans.registry import query
from siftwork.sources.views import view

_BUCKET = "CASE WHEN score >= 68 THEN 'likely' WHEN score >= 50 THEN 'reach' ELSE 'archive' END"
_NEED = ["title", "company_name", "description_text"]


def _scored(spark, d, extra=()):
    return scored_postings(S, view(spark, d, "postings", [*_NEED, *extra]), view(spark, d, "company_dim"))


@query("x00_top_scored", f"""WITH {o.score_cte('postings')} SELECT row_number() OVER (ORDER BY score DESC, job_id) AS rank, job_id, role, score, band, {_BUCKET} AS bucket
FROM scored ORDER BY score DESC, job_id LIMIT 20""")
def x00(spark, d):
    """Flagship: the 20 best postings by local score."""
    rows = _scored(spark, d).withColumn("bucket", scoring.fast_bucket(S, F.col("score")))
    return top_rank(rows.select("job_id", "role", "score", "band", "bucket"), [("score", "desc"), ("job_id", "asc")], 20)


@query("x01_local_score", f"WITH {o.score_cte('postings')} SELECT job_id, role, score FROM scored")
def x01(spark, d):
    return _scored(spark, d).select("job_id", "role", "score")


@query("x02_score_reasons", f"WITH {o.score_cte('postings')} SELECT job_id, why FROM scored")
def x02(spark, d):
    return _scored(spark, d).select("job_id", F.array_join("why", "|").alias("why"))


@query("x03_score_band", f"WITH {o.score_cte('postings')} SELECT job_id, band, unread FROM scored")
def x03(spark, d):
    return _scored(spark, d).select("job_id", "band", "unread")


@query("x04_fast_bucket", f"WITH {o.score_cte('postings')} SELECT job_id, {_BUCKET} AS bucket FROM scored")
def x04(spark, d):
    return _scored(spark, d).select("job_id", scoring.fast_bucket(S, F.col("score")).alias("bucket"))


@query("x05_blend_score", """SELECT eval_seq, CASE WHEN t IS NULL THEN likelihood ELSE CAST(greatest(0, least(100, round_even(CAST(0.7 AS DOUBLE) * t + (1 - CAST(0.7 AS DOUBLE)) * likelihood, 0))) AS INT) END AS final
FROM (SELECT eval_seq, likelihood, CAST(json_extract_string(raw, '$.fast.triage') AS INT) AS t FROM evals WHERE raw IS NOT NULL)""")
def x05(spark, d):
    e = view(spark, d, "evals").where("raw IS NOT NULL")
    t = F.get_json_object("raw", "$.fast.triage").try_cast("int")
    return e.select("eval_seq", scoring.blend(S, F.col("likelihood"), t).alias("final"))


COMPOSITE_SQL = """SELECT e.*, coalesce(c.reputation, CASE c.tier WHEN 1 THEN 90 WHEN 2 THEN 70 WHEN 3 THEN 55 END, 50) AS rep,
  CAST(greatest(0, least(100, round_even(skills_match * CAST(0.65 AS DOUBLE) + level_match * CAST(0.35 AS DOUBLE), 0))) AS INT) AS lik,
  CAST(greatest(0, least(100, round_even(work_alignment * CAST(0.45 AS DOUBLE) + experience_quality * CAST(0.30 AS DOUBLE)
    + coalesce(c.reputation, CASE c.tier WHEN 1 THEN 90 WHEN 2 THEN 70 WHEN 3 THEN 55 END, 50) * CAST(0.25 AS DOUBLE), 0))) AS INT) AS des
FROM evals e JOIN postings p ON p.job_id = e.job_id LEFT JOIN company_dim c ON c.company_id = p.company_id"""
RUBRIC_SQL = "CASE WHEN lik >= 65 AND des >= 50 THEN 'likely' WHEN des >= 70 AND lik >= 25 THEN 'reach' WHEN wildcard AND interest >= 70 THEN 'wildcard' ELSE 'archive' END"


def with_composite(spark, d, extra=()):
    p = view(spark, d, "postings", ["company_id", *extra])
    rows = lookup.reputation_by_id(view(spark, d, "evals").join(p, "job_id"), view(spark, d, "company_dim"), S.unknown_reputation)
    return rows.withColumns({
        "lik": scoring.likelihood(S, F.col("skills_match"), F.col("level_match")),
        "des": scoring.desirability(S, F.col("work_alignment"), F.col("experience_quality"), F.col("reputation"))})


@query("x06_composite_score", f"SELECT eval_seq, lik, des, interest FROM ({COMPOSITE_SQL})")
def x06(spark, d):
    return with_composite(spark, d).select("eval_seq", "lik", "des", "interest")


@query("x07_rubric_bucket", f"SELECT eval_seq, {RUBRIC_SQL} AS bucket FROM ({COMPOSITE_SQL})")
def x07(spark, d):
    c = with_composite(spark, d)
    return c.select("eval_seq", scoring.rubric_bucket(S, c.lik, c.des, c.interest, c.wildcard).alias("bucket"))


FAST_SQL = f"""pend AS (SELECT p.* FROM postings p WHERE active AND {_READ} AND NOT EXISTS (SELECT 1 FROM evals e WHERE e.job_id = p.job_id AND e.profile_hash = 'old')),
{o.cascade_cte('pend')}, passed AS (SELECT p.* FROM pend p JOIN judged j ON j.job_id = p.job_id WHERE j.reason IS NULL), {o.score_cte('passed')},
fast_rows AS (SELECT job_id, 'prefilter' AS model, reason AS hard_reject_reason, CAST(NULL AS INT) AS likelihood, CAST(NULL AS VARCHAR) AS band, 'archive' AS bucket FROM judged WHERE reason IS NOT NULL
 UNION ALL SELECT job_id, 'local', NULL, score, band, {_BUCKET} FROM scored)"""


def fast_rows(spark, d):
    p = view(spark, d, "postings", [*RULE_COLUMNS, "company_name", "active", "fetch_failures"])
    queue = pending_fast(p, view(spark, d, "evals"), "old")
    return score_pending(S, queue, view(spark, d, "company_dim"))


@query("x08_fast_scoring", f"WITH {FAST_SQL} SELECT * FROM fast_rows")
def x08(spark, d):
    """Pending queue -> rule cascade -> local score -> evaluation rows, one pass over the queue."""
    return fast_rows(spark, d)


@query("x09_batch_inference", f"""WITH {TRIAGE_SQL} SELECT batch, job_id, CASE WHEN batch % 3 <> 1 THEN CAST(len(string_split({o.squeeze('block')}, ' ')) % 101 AS INT) END AS score,
 CASE WHEN batch % 3 = 1 THEN 'scorer refused the batch' END AS error FROM blocks""")
def x09(spark, d):
    """Ambiguous queue packed into prompts and scored by a pluggable function; the default one counts words and refuses every third batch."""
    p = view(spark, d, "postings", ["company_name", "title", "location", "first_seen_at", "active", "description_text"])
    queue = ambiguous_queue(view(spark, d, "evals"), p, S.profile)
    prompts = packing.batch_prompts(queue, packing.triage_block(S, queue), S.triage_batch)
    return packing.batch_inference(prompts, packing.word_count_scorer)
