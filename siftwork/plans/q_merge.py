"""U: upserts and reconciliation, plus the counts they report."""
from pyspark.sql import functions as F

from siftwork.config import DEFAULT as S
from siftwork.functions import dates, rules, scoring
from siftwork.operators import merge, scores, versions
from siftwork.plans import oracle as o
from siftwork.plans.q_joins import INCOMING_SQL, SNAPSHOT_SQL, incoming, stored
from siftwork.plans.q_rules import RULE_COLUMNS
from siftwork.plans.q_score import COMPOSITE_SQL, RUBRIC_SQL, with_composite
from siftwork.plans.q_versions import STATUS_SQL, current, CUR_SQL
from siftwork.plans.registry import query
from siftwork.session import cut_lineage
from siftwork.sources.views import raw, view

_DL = "CASE WHEN description_text <> '' THEN CASE job_id % 13 WHEN 1 THEN DATE '2024-10-15' WHEN 2 THEN DATE '2024-02-09' END END"
_HASH = f"CASE WHEN description_text <> '' THEN sha1({o.squeeze('description_text')}) END"

# the batch as the sequence it is: one row after another, with the keys and URLs inserted so far
_MERGE_SQL = f"""RECURSIVE {SNAPSHOT_SQL}, {INCOMING_SQL}, s AS MATERIALIZED (SELECT *, {_HASH} AS h, {_DL} AS dl FROM stored), u AS (SELECT curl, min(job_id) AS job_id FROM s WHERE curl <> '' GROUP BY 1),
i AS MATERIALIZED (SELECT i.*, {_HASH.replace('description_text', 'i.description_text')} AS h, {_DL.replace('description_text', 'i.description_text').replace('job_id', 'i.job_id')} AS dl, k.job_id AS km, u.job_id AS um,
 row_number() OVER (ORDER BY i.job_id) AS n FROM incoming i LEFT JOIN s k ON k.dedup_key = i.dedup_key LEFT JOIN u ON u.curl = i.curl AND i.curl <> ''),
q(n, keys, urls, ids, target) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) UNION ALL
 SELECT x.n, CASE WHEN t IS NULL THEN keys || [dedup_key] ELSE keys END, CASE WHEN t IS NULL THEN urls || [curl] ELSE urls END, CASE WHEN t IS NULL THEN ids || [job_id] ELSE ids END, t
 FROM (SELECT i.n, keys, urls, ids, dedup_key, curl, job_id, coalesce(km, ids[list_position(keys, dedup_key)], um, CASE WHEN curl <> '' THEN ids[list_position(urls, curl)] END) AS t FROM q JOIN i ON i.n = q.n + 1) x),
i2 AS MATERIALIZED (SELECT i.*, coalesce(q.target, i.job_id) AS target, q.target IS NULL AS ins FROM i JOIN q ON q.n = i.n),
base AS (SELECT job_id, false AS is_new, company_id, source, terms_txt, sponsorship, h, dl, active, external_id, posted_at, first_seen_at FROM s
 UNION ALL SELECT job_id, true, company_id, source, terms_txt, sponsorship, h, dl, active, external_id, posted_at, {o.AS_OF} FROM i2 WHERE ins),
upd AS (SELECT i2.*, b.source AS bs, b.h AS bh, i2.h IS NOT NULL AND i2.source = b.source AS same FROM i2 JOIN base b ON b.job_id = i2.target WHERE NOT ins),
g AS (SELECT target, arg_min(company_id, job_id) FILTER (WHERE company_id IS NOT NULL) AS c, arg_min(terms_txt, job_id) FILTER (WHERE terms_txt <> '') AS t,
 arg_min(sponsorship, job_id) FILTER (WHERE sponsorship <> '') AS sp, arg_max(active, job_id) AS a, arg_min(h, job_id) FILTER (WHERE h IS NOT NULL) AS fh,
 arg_min(coalesce(dl, DATE '1900-01-01'), job_id) FILTER (WHERE h IS NOT NULL) AS fdl, list(h ORDER BY job_id) FILTER (WHERE same) AS hs, arg_min(dl, job_id) FILTER (WHERE same AND dl IS NOT NULL) AS sdl FROM upd GROUP BY 1),
merged AS (SELECT b.job_id, b.is_new, coalesce(b.company_id, g.c) AS company_id, coalesce(nullif(b.terms_txt, ''), g.t, b.terms_txt) AS terms_txt, coalesce(b.sponsorship, g.sp) AS sponsorship,
 coalesce(g.a, b.active) AS active, CASE WHEN len(g.hs) > 0 THEN g.hs[-1] WHEN b.h IS NULL THEN g.fh ELSE b.h END AS description_hash,
 coalesce(b.dl, CASE WHEN b.h IS NULL THEN nullif(g.fdl, DATE '1900-01-01') END, g.sdl) AS deadline,
 coalesce(len(list_distinct([coalesce(b.h, g.fh)] || g.hs)) > 1 AND len(g.hs) > 0, false) AS needs_reeval, external_id, posted_at, first_seen_at,
 CASE WHEN b.is_new OR g.target IS NOT NULL THEN {o.AS_OF} END AS last_seen_at FROM base b LEFT JOIN g ON g.target = b.job_id)"""
MERGED = ["job_id", "is_new", "company_id", "terms_txt", "sponsorship", "active", "description_hash", "deadline", "needs_reeval", "external_id", "posted_at", "first_seen_at", "last_seen_at"]


@query("u01_upsert_postings", f"WITH {_MERGE_SQL} SELECT * FROM merged")
def u01(spark, d):
    """The incoming rows as two batches, one after the other; is_new: not in the snapshot before both."""
    before, inc = stored(spark, d), cut_lineage(incoming(spark, d))
    half = inc.agg(F.expr("percentile_approx(job_id, 0.5)")).first()[0]
    now = dates.at(S.as_of)
    after = cut_lineage(merge.upsert_postings(before, inc.where(F.col("job_id") <= half), now))
    out = merge.upsert_postings(after, inc.where(F.col("job_id") > half), now)
    old = before.select("job_id", F.lit(False).alias("was_new"))
    return out.join(old, "job_id", "left").withColumn("is_new", F.coalesce("was_new", F.lit(True))).select(*MERGED)


@query("u01b_posting_urls", f"WITH {_MERGE_SQL} SELECT target AS job_id, url FROM i2 UNION SELECT job_id, curl FROM i2 WHERE ins")
def u01b(spark, d):
    """Every URL under which a posting was reported."""
    return merge.posting_urls(merge.resolve(incoming(spark, d), stored(spark, d)))


@query("a20_ingest_stats", f"""WITH {_MERGE_SQL}, n AS (SELECT source, count(*) AS new FROM i2 WHERE ins GROUP BY 1), hit AS (SELECT job_id FROM i2 UNION SELECT target FROM i2 WHERE NOT ins),
cnt AS (SELECT source, count(*) AS c FROM (SELECT source FROM i2 UNION ALL SELECT source FROM i2 WHERE NOT ins) GROUP BY 1),
gone AS (SELECT s.source, count(*) AS d FROM s JOIN cnt ON cnt.source = s.source WHERE s.active AND cnt.c >= 5 AND s.job_id NOT IN (SELECT job_id FROM hit) GROUP BY 1)
SELECT i.source, count(*) AS seen, coalesce(any_value(n.new), 0) AS new, coalesce(any_value(gone.d), 0) AS deactivated FROM i2 i LEFT JOIN n ON n.source = i.source LEFT JOIN gone ON gone.source = i.source GROUP BY 1""")
def a20(spark, d):
    return merge.ingest_stats(stored(spark, d), incoming(spark, d))


_PROPOSED = """SELECT slug, name, 'discover' AS source, CASE WHEN CAST(split_part(slug, '-', 2) AS INT) % 4 = 1 THEN 'approved' ELSE 'proposed' END AS status, CAST(nullif(tier, '') AS INT) AS tier,
 CASE WHEN reputation <> 'n/a' THEN CAST(reputation AS INT) END AS reputation, nullif(ats_type, '') AS ats_type, nullif(ats_token, '') AS ats_token FROM directory"""


def proposals(spark, d):
    e = view(spark, d, "directory")
    n = F.substring_index("slug", "-", -1).cast("int")
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return e.select("slug", "name", F.lit("discover").alias("source"), F.when(n % 4 == 1, F.lit("approved")).otherwise(F.lit("proposed")).alias("status"),
                    F.col("tier").try_cast("int").alias("tier"), F.col("reputation").try_cast("int").alias("reputation"), blank("ats_type"), blank("ats_token"))


@query("u02_upsert_companies", f"""WITH p AS ({_PROPOSED}) SELECT coalesce(c.slug, p.slug) AS slug, coalesce(c.name, p.name) AS name, coalesce(c.source, p.source) AS source,
 CASE WHEN c.slug IS NULL THEN p.status WHEN p.slug IS NOT NULL AND (p.status = 'approved' OR c.status NOT IN ('approved', 'rejected')) THEN p.status ELSE c.status END AS status,
 coalesce(p.tier, c.tier) AS tier, coalesce(p.reputation, c.reputation) AS reputation, coalesce(p.ats_type, c.ats_type) AS ats_type, coalesce(p.ats_token, c.ats_token) AS ats_token
FROM company_dim c FULL JOIN p ON p.slug = c.slug""")
def u02(spark, d):
    return merge.upsert_companies(view(spark, d, "company_dim"), proposals(spark, d))


def polls(events):
    """Events read as poll results of the feed ``user_id``."""
    t = F.col("event_type")
    return events.select(
        F.col("user_id").alias("feed"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.when(t.isin("view", "purchase"), F.lit("ok")).when(t == "click", F.lit("network")).when(t == "error", F.lit("http")).when(
            F.col("event_id") % 97 == 0, F.lit("disabled")).otherwise(F.lit("unparsable")).alias("outcome"),
        F.floor("value").cast("bigint").alias("rows"), F.when(t == "error", F.when(F.col("event_id") % 2 == 0, F.lit(404)).otherwise(F.lit(503))).alias("code"))


FEED_SQL = """WITH p AS (SELECT user_id AS feed, ts, event_id, CAST(floor(value) AS BIGINT) AS rows, CASE WHEN event_type IN ('view', 'purchase') THEN CASE WHEN floor(value) >= 15 THEN 'ok' ELSE 'thin' END
 WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'gone' WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'disable' WHEN event_type = 'signup' THEN 'gone' ELSE 'nothing' END AS ev, event_type IN ('view', 'purchase') AS ok FROM events)
SELECT feed, list_reduce(['active'] || list(ev ORDER BY ts, event_id), lambda s, e: CASE WHEN s = 'disabled' THEN s WHEN e = 'disable' THEN 'disabled' WHEN e = 'gone' THEN 'broken' WHEN e = 'ok' THEN 'active' ELSE s END) AS status,
 arg_max(rows, (ts, event_id)) FILTER (WHERE ok) AS last_rows, max(ts) AS last_checked FROM p GROUP BY 1"""


@query("u03_upsert_feed_health", FEED_SQL)
def u03(spark, d):
    return merge.feed_health(polls(raw(spark, d, "events")))


@query("u04_application_status", """WITH a AS (SELECT *, CASE WHEN status = 'rejected' AND event_id % 10 = 0 THEN 'closed' ELSE status END AS s2 FROM apps),
l AS (SELECT job_id, arg_max(s2, (updated_at, event_id)) AS status, arg_max(note, (updated_at, event_id)) FILTER (WHERE note IS NOT NULL) AS note, bool_or(s2 = 'closed') AS was_closed FROM a GROUP BY 1)
SELECT l.job_id, l.status, l.note, p.active AND NOT l.was_closed AS active FROM l JOIN postings p ON p.job_id = l.job_id""")
def u04(spark, d):
    """Last status per posting, note kept when a later one is empty; a closed application deactivates its posting."""
    a = view(spark, d, "apps").withColumn("status", F.when((F.col("status") == "rejected") & (F.col("event_id") % 10 == 0), F.lit("closed")).otherwise(F.col("status")))
    closed = a.groupBy("job_id").agg(F.bool_or(F.col("status") == "closed").alias("was_closed"))
    st = versions.latest_status(a).select("job_id", "status", "note").join(closed, "job_id")
    return st.join(view(spark, d, "postings", ["active"]), "job_id").select("job_id", "status", "note", (F.col("active") & ~F.col("was_closed")).alias("active"))


@query("u05_replace_evaluations", """SELECT job_id, rubric_version, profile_hash, max(eval_seq) AS eval_seq, arg_max(bucket, eval_seq) AS bucket, false AS needs_reeval FROM evals GROUP BY 1, 2, 3""")
def u05(spark, d):
    return versions.replace_evaluations(view(spark, d, "evals")).select("job_id", "rubric_version", "profile_hash", "eval_seq", "bucket", F.lit(False).alias("needs_reeval"))


_LIVE_SQL = "ev AS (SELECT * FROM evals QUALIFY row_number() OVER (PARTITION BY job_id, rubric_version, profile_hash ORDER BY eval_seq DESC) = 1)"
_RECON_SQL = f"""{_LIVE_SQL}, act AS (SELECT * FROM postings WHERE active), {o.cascade_cte('act')}"""


def _evals(spark, d):
    return versions.replace_evaluations(view(spark, d, "evals"))


def _reasons(spark, d):
    return merge.fresh_reasons(S, view(spark, d, "postings", [*RULE_COLUMNS, "active"]))


@query("u06_reprefilter", f"""WITH {_RECON_SQL} SELECT e.job_id, e.eval_seq, e.model, j.reason FROM ev e JOIN judged j ON j.job_id = e.job_id
WHERE e.profile_hash = 'cur' AND e.hard_reject_reason IS NULL AND j.reason IS NOT NULL AND e.model IN ('local', 'triage')""")
def u06(spark, d):
    return merge.reprefilter(S, _evals(spark, d), _reasons(spark, d))


@query("u07_unreject_stale", f"""WITH {_RECON_SQL} SELECT e.job_id, e.eval_seq, e.hard_reject_reason AS old_reason, j.reason, CASE WHEN j.reason IS NULL THEN 'freed' ELSE 'updated' END AS action
FROM ev e JOIN judged j ON j.job_id = e.job_id WHERE e.profile_hash = 'cur' AND e.model = 'prefilter' AND e.hard_reject_reason IS DISTINCT FROM j.reason""")
def u07(spark, d):
    return merge.unreject_stale(S, _evals(spark, d), _reasons(spark, d))


@query("a19_reconcile_counts", f"""WITH {_RECON_SQL} SELECT change, count(*) AS n FROM (
 SELECT j.reason AS change FROM ev e JOIN judged j ON j.job_id = e.job_id WHERE e.profile_hash = 'cur' AND e.hard_reject_reason IS NULL AND j.reason IS NOT NULL AND e.model IN ('local', 'triage')
 UNION ALL SELECT CASE WHEN j.reason IS NULL THEN 'freed: ' || e.hard_reject_reason ELSE e.hard_reject_reason || ' -> ' || j.reason END
 FROM ev e JOIN judged j ON j.job_id = e.job_id WHERE e.profile_hash = 'cur' AND e.model = 'prefilter' AND e.hard_reject_reason IS DISTINCT FROM j.reason) GROUP BY 1""")
def a19(spark, d):
    e, r = _evals(spark, d), _reasons(spark, d)
    return merge.reconcile_counts(merge.reprefilter(S, e, r), merge.unreject_stale(S, e, r))


@query("u08_recompute_fast", f"""WITH {_LIVE_SQL}, {o.score_cte('postings')}, x AS (SELECT e.eval_seq, s.score, CASE WHEN e.model = 'triage' THEN CAST(json_extract_string(e.raw, '$.fast.triage') AS INT) END AS t
 FROM ev e JOIN scored s ON s.job_id = e.job_id JOIN postings p ON p.job_id = e.job_id WHERE p.active AND e.profile_hash = 'cur' AND e.model IN ('local', 'triage') AND e.hard_reject_reason IS NULL),
f AS (SELECT *, CASE WHEN t IS NULL THEN score ELSE CAST(greatest(0, least(100, round_even(CAST(0.7 AS DOUBLE) * t + (1 - CAST(0.7 AS DOUBLE)) * score, 0))) AS INT) END AS final FROM x)
SELECT eval_seq, score, final, CASE WHEN final >= 68 THEN 'likely' WHEN final >= 50 THEN 'reach' ELSE 'archive' END AS bucket FROM f""")
def u08(spark, d):
    """Local rows scored again from the posting, external scores kept and blended again, both re-bucketed."""
    p = view(spark, d, "postings", ["title", "company_name", "description_text", "active"]).where("active")
    score = scores.scored_postings(S, p, view(spark, d, "company_dim")).select("job_id", "score")
    rows = _evals(spark, d).where("profile_hash = 'cur' AND model IN ('local', 'triage') AND hard_reject_reason IS NULL").join(score, "job_id")
    ext = F.when(F.col("model") == "triage", F.get_json_object("raw", "$.fast.triage").try_cast("int"))
    return rows.withColumn("final", scoring.blend(S, F.col("score"), ext)).select(
        "eval_seq", "score", "final", scoring.fast_bucket(S, F.col("final")).alias("bucket"))


@query("u09_recompute_buckets", f"""SELECT c.eval_seq, c.lik, c.des, CASE WHEN {RUBRIC_SQL} <> 'archive' AND {o.firmware('p.title', 'p.description_text')} THEN 'archive' ELSE {RUBRIC_SQL} END AS bucket
FROM ({COMPOSITE_SQL}) c JOIN postings p ON p.job_id = c.job_id WHERE c.rubric_version = '2' AND c.hard_reject_reason IS NULL AND c.raw IS NOT NULL AND c.model NOT IN ('local', 'triage')""")
def u09(spark, d):
    c = with_composite(spark, d, ["title", "description_text"]).where("rubric_version = '2' AND hard_reject_reason IS NULL AND raw IS NOT NULL AND model NOT IN ('local', 'triage')")
    b = scoring.rubric_bucket(S, c.lik, c.des, c.interest, c.wildcard)
    return c.select("eval_seq", "lik", "des", F.when(b == "archive", b).when(rules.firmware_heavy(c.title, c.description_text), F.lit("archive")).otherwise(b).alias("bucket"))


@query("u10_propose_companies", f"""WITH {CUR_SQL}, g AS (SELECT {o.slug('p.company_name')} AS slug, p.company_name AS name, p.job_id, 'Posted a ' || e.bucket || ' job: ' || p.title AS rationale
 FROM cur e JOIN postings p ON p.job_id = e.job_id WHERE p.active AND e.bucket IN ('likely', 'reach') AND p.company_id IS NULL)
SELECT slug, name, rationale, 'proposed' AS status FROM g WHERE slug NOT IN (SELECT slug FROM company_dim) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY job_id) = 1""")
def u10(spark, d):
    return merge.propose_companies(current(spark, d), view(spark, d, "company_dim"))


@query("u11_mark_fetch_failures", """SELECT job_id, CASE WHEN job_id % 3 = 0 THEN '{"fetch_failures":"1"}' ELSE '{"k":"v","fetch_failures":"' || (fetch_failures + 1) || '"}' END AS raw,
 CASE WHEN job_id % 3 = 0 THEN 1 ELSE fetch_failures + 1 END AS failures, CASE WHEN job_id % 3 = 0 THEN 1 ELSE fetch_failures + 1 END >= 2 AS given_up FROM postings WHERE description_text IS NULL""")
def u11(spark, d):
    p = view(spark, d, "postings", ["fetch_failures", "description_text"]).where("description_text IS NULL")
    p = p.withColumn("raw", F.when(F.col("job_id") % 3 != 0, F.concat(F.lit('{"k":"v","fetch_failures":'), F.col("fetch_failures").cast("string"), F.lit("}"))))
    return merge.mark_fetch_failures(p)


@query("u12_watchlist_changes", f"""WITH ch AS (SELECT s_suppkey AS request, CASE s_suppkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'add_known' ELSE 'remove' END AS action,
 CASE s_suppkey % 3 WHEN 1 THEN s_name || CASE s_suppkey % 2 WHEN 0 THEN '' ELSE ', Inc.' END ELSE lower(replace(s_name, '#', '-')) || CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 THEN '-group' ELSE '' END END AS value,
 lower(replace(s_name, '#', '-')) AS own FROM supplier)
SELECT request, action, CASE WHEN action = 'remove' THEN CASE WHEN c.slug IS NOT NULL THEN 'paused' ELSE 'missing' END WHEN e.slug IS NOT NULL THEN 'approved'
  WHEN action = 'add_known' AND EXISTS (SELECT 1 FROM postings p WHERE p.company_name = ch.value) THEN 'approved' ELSE 'not_found' END AS outcome,
 CASE WHEN action = 'remove' THEN c.slug WHEN e.slug IS NOT NULL THEN own WHEN action = 'add_known' AND EXISTS (SELECT 1 FROM postings p WHERE p.company_name = ch.value) THEN own END AS slug
FROM ch LEFT JOIN company_dim c ON c.slug = ch.own LEFT JOIN directory e ON e.slug = ch.own""")
def u12(spark, d):
    s = raw(spark, d, "supplier")
    k, slug = s.s_suppkey, F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))
    ch = s.select(k.alias("request"), F.when(k % 3 == 0, F.lit("add")).when(k % 3 == 1, F.lit("add_known")).otherwise(F.lit("remove")).alias("action"),
                  F.when(k % 3 == 1, F.concat(s.s_name, F.when(k % 2 == 0, F.lit("")).otherwise(F.lit(", Inc.")))).otherwise(
                      F.concat(slug, F.when((k % 3 == 0) & (k % 2 == 1), F.lit("-group")).otherwise(F.lit("")))).alias("value"))
    return merge.watchlist_changes(ch, view(spark, d, "company_dim"), view(spark, d, "directory"), view(spark, d, "postings", ["company_name"]))


@query("u13_classify_feed_probe", """SELECT 'feed-' || c_custkey AS repo, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 50 > 0 THEN 'simplify' WHEN c_custkey % 40 >= 15 THEN 'readme' END AS kind,
 CASE WHEN (c_custkey % 4 = 0 AND c_custkey % 50 > 0) OR c_custkey % 40 >= 15 THEN 'active' ELSE 'broken' END AS status, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 50 > 0 THEN c_custkey % 50 ELSE c_custkey % 40 END AS rows,
 CASE WHEN NOT ((c_custkey % 4 = 0 AND c_custkey % 50 > 0) OR c_custkey % 40 >= 15) THEN CASE WHEN c_custkey % 11 = 0 THEN 'README not found' ELSE 'only ' || (c_custkey % 40) || ' parsable postings' END END AS error
FROM customer WHERE c_custkey % 5 <> 0""")
def u13(spark, d):
    c = raw(spark, d, "customer")
    k = c.c_custkey
    repo = F.concat(F.lit("feed-"), k.cast("string"))
    cand = c.select(repo.alias("repo"), F.when(k % 4 == 0, k % 50).alias("listing_rows"), (k % 40).alias("table_rows"), F.when(k % 11 == 0, F.lit("README not found")).alias("error"))
    return merge.probe_feeds(cand, c.where(k % 5 == 0).select(repo.alias("repo")), 9)
