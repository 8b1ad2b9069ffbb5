"""ST: streaming jobs run to completion over the landed tables."""
from datetime import timedelta

from pyspark.sql import functions as F

from siftwork.config import DEFAULT as S
from siftwork.functions import dates, scoring
from siftwork.operators import merge, scores
from siftwork.plans import oracle as o
from siftwork.plans.q_joins import incoming, stored
from siftwork.plans.q_merge import FEED_SQL, MERGED, _MERGE_SQL, polls
from siftwork.plans.registry import query
from siftwork.session import cut_lineage, scratch_dir
from siftwork.sources.views import bind_counts, postings_sql, raw, view
from siftwork.streaming import jobs


def _events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return jobs.file_stream(spark, f"{d}/events.parq*", e.schema)


def _timed(spark, d):
    """Watermarks need an instant; the stored times are UTC."""
    return _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))


def _in_calls(spark, rows, parts, job):
    """Land one part of the rows after the other, each written by all tasks, and let ``job(stream)`` take up what has landed: a
    call's new files are one micro-batch, so parts keep their order however many files they have."""
    landed = scratch_dir(spark, "landed")
    for part in parts:
        rows.where(part).write.mode("append").parquet(landed)
        out = job(jobs.file_stream(spark, landed, rows.schema))
    return out


@query("st1_stream_upsert", f"WITH {_MERGE_SQL} SELECT * EXCLUDE (is_new) FROM merged")
def st1(spark, d):
    """Postings landed in three parts, in order, and merged in three micro-batches into a bucketed table (equal to the batch merge)."""
    inc, before, root = cut_lineage(incoming(spark, d)), stored(spark, d), scratch_dir(spark, "postings")
    low, high = inc.agg(F.expr("percentile_approx(job_id, array(0.33, 0.66))")).first()[0]
    k = F.col("job_id")
    out = _in_calls(spark, inc, [k <= low, (k > low) & (k <= high), k > high], lambda stream: jobs.upsert_stream(stream, before, dates.at(S.as_of), root, buckets=16))
    return out.select(*[c for c in MERGED if c != "is_new"])


@query("st2_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def st2(spark, d):
    """Keys that got through; within the watermark a key passes once, so no key may appear twice."""
    s = jobs.dedupe_stream(_timed(spark, d), ["user_id", "event_type"], "40 days")
    return jobs.run_to_files(s.select("user_id", "event_type"))


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS visits FROM n GROUP BY user_id, s
HAVING max(ts) + INTERVAL 45 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


@query("st3_stream_sessions", _SESSIONS)
def st3(spark, d):
    """Sessions closed by the watermark, append mode."""
    out = jobs.run_to_files(jobs.session_stream(_timed(spark, d), "45 minutes", "10 minutes"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("st4_stream_budget", """WITH e AS (SELECT ts, CAST(floor(value * 100) AS BIGINT) AS tokens FROM events), x AS (SELECT e.*, CAST(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) - INTERVAL 1 DAY * k.k AS window_start FROM e, (SELECT unnest(range(7)) AS k) k)
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS runs FROM x GROUP BY 1""")
def st4(spark, d):
    """Trailing seven-day spend sliding by a day, the windows that are still open included."""
    e = _timed(spark, d).select("ts", F.floor(F.col("value") * 100).alias("tokens"))
    out = jobs.trailing_spend(jobs.daily_spend_stream(e, "1 day"), 7, scratch_dir(spark, "spend"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _in_two_calls(spark, d, job):
    """Events landed in two halves, the second after a first call of the job has ended: ``job(stream, root)`` resumes."""
    e, root = spark.read.parquet(f"{d}/events.parquet"), scratch_dir(spark, "resumed")
    half = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    return _in_calls(spark, e, [F.col("event_id") <= half, F.col("event_id") > half], lambda stream: job(stream, root))


@query("st5_stream_score", f"WITH {o.score_cte('postings')} SELECT job_id, role, score, band FROM scored")
def st5(spark, d):
    """Stateless scoring of landed documents with stream-static joins to the supplier and company tables."""
    docs = raw(spark, d, "documents")
    stream = jobs.file_stream(spark, f"{d}/documents.parq*", docs.schema)
    sql = bind_counts(spark, postings_sql(["company_name", "title", "description_text"]), d).replace("{documents}", "{docs}").replace("{supplier}", "{sup}")
    p = spark.sql(sql, docs=stream, sup=raw(spark, d, "supplier"))
    scored = scores.scored_postings(S, p, view(spark, d, "company_dim")).select("job_id", "role", "score", "band")
    return jobs.run_to_files(scored)


@query("st6_stream_status", """SELECT job_id, arg_max(status, (updated_at, event_id)) AS status, max(updated_at) AS updated_at FROM apps GROUP BY 1""")
def st6(spark, d):
    """Status per posting in update mode, over two calls; the watermark's delay is longer than the events reach back."""
    n = raw(spark, d, "documents").count()
    t = F.col("event_type")
    status = F.when(t == "view", F.lit("shortlisted")).when(t == "click", F.lit("applied")).when(t == "signup", F.lit("interview")).when(t == "purchase", F.lit("offer")).otherwise(F.lit("rejected"))

    def job(events, root):
        log = events.where("user_id % 3 = 0").select("event_id", (F.col("event_id") % n).alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
        return jobs.keep_newest(jobs.status_stream(log, "60 days", timedelta(days=30)), "job_id", ["updated_at", "event_id"], root)
    return _in_two_calls(spark, d, job).select("job_id", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("st6b_stream_feed_health", FEED_SQL)
def st6b(spark, d):
    """Feed health in update mode, over two calls."""
    def job(events, root):
        p = polls(events)
        return jobs.keep_newest(jobs.health_stream(p.withColumn("at", F.col("at").cast("timestamp"))), "feed", ["seen"], root)
    return _in_two_calls(spark, d, job).select("feed", "status", F.col("last_rows").cast(polls(raw(spark, d, "events")).schema["rows"].dataType).alias("last_rows"), F.col("last_checked").cast("timestamp_ntz").alias("last_checked"))
