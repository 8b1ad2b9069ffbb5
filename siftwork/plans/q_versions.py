"""W: versions, sessions, packing and ranking; plus the decorated rows reports start from."""
from pyspark.sql import functions as F

from siftwork.config import DEFAULT as S
from siftwork.functions import dates, fixed_values as fv, text as tx
from siftwork.functions.plan import once
from siftwork.operators import packing, ranking, reports, versions, windows
from siftwork.operators.queues import ambiguous_queue
from siftwork.plans import oracle as o
from siftwork.plans.registry import query
from siftwork.session import cut_lineage
from siftwork.sources.views import raw, view

CUR_SQL = """cur AS (SELECT * FROM evals WHERE profile_hash = 'cur'
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY (rubric_version = '2') DESC, created_at DESC, eval_seq DESC) = 1)"""
STATUS_SQL = """st AS (SELECT job_id, arg_max(status, (updated_at, event_id)) AS status, max(updated_at) AS updated_at,
  arg_max(note, (updated_at, event_id)) FILTER (WHERE note IS NOT NULL) AS note FROM apps GROUP BY job_id)"""
DEADLINE_SQL = "CASE WHEN description_text <> '' THEN CASE job_id % 13 WHEN 1 THEN DATE '2024-10-15' WHEN 2 THEN DATE '2024-02-09' END END"
ROWS_SQL = f"""{CUR_SQL}, {STATUS_SQL},
r0 AS (SELECT e.* EXCLUDE (job_id), p.*, coalesce(st.status, 'new') AS app_status, st.note AS app_note, c.tier
  FROM cur e JOIN postings p ON p.job_id = e.job_id LEFT JOIN st ON st.job_id = e.job_id LEFT JOIN company_dim c ON c.company_id = p.company_id WHERE p.active),
r1 AS (SELECT *, CASE model WHEN 'prefilter' THEN 'rules' WHEN 'triage' THEN 'triage' WHEN 'local' THEN 'fast' ELSE 'deep' END AS src,
  coalesce(json_extract_string(raw, '$.fit_tags[0]'), '') AS fit_tags, coalesce(json_extract_string(raw, '$.description_unavailable') = 'true', false) AS unread,
  created_at >= {o.AS_OF} - INTERVAL 36 HOUR AS is_new, {o.track('title', 'terms_txt')} AS track, {DEADLINE_SQL} AS deadline FROM r0),
deco AS (SELECT *, {o.classify('title', 'company_name', 'fit_tags', "coalesce(summary, '')")} AS role,
  CASE WHEN job_id % 3 = 0 THEN 'strong fit|' || CASE WHEN job_id % 2 = 0 THEN 'gpu work' ELSE 'spark and kafka' END ELSE '' END AS bullets FROM r1)"""
ROW_COLUMNS = ["company_name", "title", "location", "active", "terms_txt", "first_seen_at", "company_id"]


def current(spark, d, extra=()):
    return versions.current_rows(view(spark, d, "evals"), view(spark, d, "postings", [*ROW_COLUMNS, *extra]), view(spark, d, "apps"),
                                 view(spark, d, "company_dim"), S.profile, S.rubric)


def decorated(spark, d, extra=(), deadline=False):
    rows = reports.decorate(S, current(spark, d, [*extra, *(["description_text"] if deadline else [])]))
    if deadline:
        rows = once(rows, deadline=dates.deadline(F.col("description_text"), dates.at(S.as_of))).drop("description_text")
    return rows


@query("w01_latest_rubric_preferred", f"WITH {CUR_SQL} SELECT job_id, eval_seq, rubric_version FROM cur")
def w01(spark, d):
    return versions.latest_rubric_preferred(view(spark, d, "evals"), S.profile, S.rubric).select("job_id", "eval_seq", "rubric_version")


@query("w02_latest_by_seq", "SELECT job_id, max(eval_seq) AS eval_seq FROM evals WHERE profile_hash = 'cur' GROUP BY 1")
def w02(spark, d):
    return versions.latest_by_seq(view(spark, d, "evals"), S.profile).select("job_id", "eval_seq")


@query("w03_visit_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS f FROM visits WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
a AS (SELECT user_id, s, min(ts) AS session_start, max(ts) AS session_end, count(*) AS visits FROM n GROUP BY 1, 2)
SELECT user_id, session_start, session_end, visits, coalesce(lag(session_end) OVER (PARTITION BY user_id ORDER BY s), session_start) AS cutoff FROM a""")
def w03(spark, d):
    return windows.visit_sessions(view(spark, d, "visits"))


_QUEUE_SQL = """q AS (SELECT e.job_id, e.eval_seq, row_number() OVER (ORDER BY e.likelihood DESC, p.first_seen_at DESC, e.eval_seq) AS n FROM evals e JOIN postings p ON p.job_id = e.job_id
 WHERE e.profile_hash = 'cur' AND e.model = 'local' AND p.active AND json_extract_string(e.raw, '$.fast.band') = 'ambiguous'),
b AS (SELECT (n - 1) // 10 AS batch, 9000 + sum(job_id * 31 % 400) AS tokens FROM q GROUP BY 1)"""


def _waves_sql(tokens):
    return f"""WITH RECURSIVE {_QUEUE_SQL}, c AS (SELECT batch, {tokens} AS tokens FROM b), w AS (SELECT batch // 2 AS wave, list(tokens ORDER BY batch) AS t FROM c GROUP BY 1),
s(wave, spent, most, stopped, fit) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), false, CAST(0 AS HUGEINT) UNION ALL
 SELECT w.wave, s.spent + coalesce(list_sum(w.t[:x.fit]), 0), greatest(s.most, coalesce(list_max(w.t[:x.fit]), 0)), s.stopped OR x.fit <= 0, x.fit
 FROM s JOIN w ON w.wave = s.wave + 1, LATERAL (SELECT CASE WHEN s.stopped THEN 0 ELSE greatest(0, (150000 - s.spent) // CASE WHEN s.most > 0 THEN s.most ELSE 26000 END) END AS fit) x)
SELECT CAST(c.batch AS BIGINT) AS batch, CAST(s.wave AS BIGINT) AS wave, c.batch % 2 < s.fit AS runs FROM c JOIN s ON s.wave = c.batch // 2"""


def _batches(spark, d):
    """Batches of 10 (so that small data has several waves) and a made-up cost per batch."""
    p = view(spark, d, "postings", ["first_seen_at", "active"])
    q = packing.queue_rank(ambiguous_queue(view(spark, d, "evals"), p, S.profile))
    return q.groupBy(F.floor((F.col("n") - 1) / 10).alias("batch")).agg((F.sum(F.col("job_id") * 31 % 400) + 9000).alias("tokens"))


@query("w04_budget_waves", _waves_sql("tokens"))
def w04(spark, d):
    """Budget 150 000."""
    return packing.budget_waves(S, _batches(spark, d), 150_000)


@query("w04b_cheap_batches", _waves_sql("CASE WHEN batch % 4 = 1 THEN 1 ELSE tokens END"))
def w04b(spark, d):
    """Every fourth batch costs a single token, and the scan goes in chunks of two waves."""
    cheap = F.when(F.col("batch") % 4 == 1, F.lit(1)).otherwise(F.col("tokens"))
    return packing.budget_waves(S, _batches(spark, d).withColumn("tokens", cheap), 150_000, chunk=2)


@query("w04c_no_budget", f"WITH {_QUEUE_SQL} SELECT CAST(batch AS BIGINT) AS batch, 0 AS wave, true AS runs FROM b")
def w04c(spark, d):
    """Without a budget all batches are one wave."""
    return packing.budget_waves(S, _batches(spark, d), None)


@query("w05_batch_pack", """WITH c AS (SELECT job_id, CASE WHEN description_text IS NULL THEN 'unread' ELSE 'read' END AS class FROM postings)
SELECT job_id, class, (row_number() OVER (PARTITION BY class ORDER BY job_id) - 1) // CASE class WHEN 'unread' THEN 36 ELSE 24 END AS batch FROM c""")
def w05(spark, d):
    return packing.pack_batches(S, view(spark, d, "postings", ["description_text"]))


@query("w06_token_allowance", """WITH m AS (SELECT started_at, sum(tokens) AS t FROM runs GROUP BY 1),
s AS (SELECT started_at, CAST(sum(t) OVER (ORDER BY started_at RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS spent FROM m)
SELECT started_at, spent, least(300000, greatest(0, 40000000 - spent)) AS allowance, CASE WHEN greatest(0, 40000000 - spent) < 300000 THEN 'weekly cap' ELSE 'run cap' END AS binding FROM s""")
def w06(spark, d):
    s = windows.rolling_spend(view(spark, d, "runs"))
    return s.withColumns(windows.allowance(S, F.col("spent"), 300_000, 40_000_000))


@query("w08_slug_uniquify", """WITH b AS (SELECT s_suppkey, 'group-' || (s_suppkey % 7) AS base FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY s_suppkey) AS k FROM b)
SELECT s_suppkey, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS slug FROM n""")
def w08(spark, d):
    """Repeated slugs get -2, -3, ... in order; exact numbering even when one slug is very common."""
    b = raw(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("group-"), (F.col("s_suppkey") % 7).cast("string")).alias("base"))
    n = ranking.global_rank(b, [("s_suppkey", "asc")], keys=["base"], name="k")
    return n.select("s_suppkey", F.when(F.col("k") > 1, F.concat_ws("-", "base", F.col("k").cast("string"))).otherwise(F.col("base")).alias("slug"))


SECTION_SQL = """k AS (SELECT *, CASE bucket WHEN 'likely' THEN likelihood * desirability WHEN 'wildcard' THEN interest ELSE desirability END AS key1,
 CASE WHEN bucket IN ('likely', 'wildcard') THEN 0 ELSE likelihood END AS key2 FROM deco WHERE app_status = 'new' AND bucket <> 'archive'),
sec AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY is_new DESC, key1 DESC, key2 DESC, job_id) AS rank FROM k)"""
SECTION_CAPS = {"likely": S.digest_cap, "reach": S.digest_cap, "wildcard": S.wildcard_cap}


@query("w09_section_rank", f"""WITH {ROWS_SQL}, {SECTION_SQL} SELECT bucket, rank, job_id FROM sec WHERE rank <= CASE bucket WHEN 'wildcard' THEN 5 ELSE 80 END""")
def w09(spark, d):
    rows = decorated(spark, d).where("app_status = 'new'")
    return reports.section_rank(rows, SECTION_CAPS).select("bucket", "rank", "job_id")


@query("w10_rotating_slice", """WITH n AS (SELECT slug, row_number() OVER (ORDER BY slug) - 1 AS idx, count(*) OVER () AS c FROM directory)
SELECT slug, idx FROM n WHERE (idx - 7 % c + c) % c < 3""")
def w10(spark, d):
    """The next 3 entries of the directory from a stored cursor (7), wrapping around."""
    e = view(spark, d, "directory").select("slug")
    n = ranking.global_rank(e, [("slug", "asc")]).withColumn("idx", F.col("rank") - 1)
    total = e.agg(F.count("*").alias("c"))
    return n.crossJoin(F.broadcast(total)).where(F.pmod(F.col("idx") - 7 % F.col("c"), F.col("c")) < 3).select("slug", "idx")


FEED_ORD = "CASE split_part(source, ':', 1) WHEN 'greenhouse' THEN 0 WHEN 'readme' THEN 1 ELSE 2 END"


def keyed(p):
    return p.withColumn("dedup_key", tx.dedup_key(p.company_name, p.title, p.location)).withColumn(
        "feed_ord", F.when(p.source.startswith("greenhouse"), F.lit(0)).when(p.source.startswith("readme"), F.lit(1)).otherwise(F.lit(2)))


@query("w11_first_wins_dedupe", f"""WITH k AS (SELECT job_id, source, {FEED_ORD} AS feed_ord, {o.dedup_key('company_name', 'title', 'location')} AS dedup_key FROM postings)
SELECT dedup_key, job_id, source FROM k QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY feed_ord, job_id) = 1""")
def w11(spark, d):
    p = keyed(view(spark, d, "postings", ["company_name", "title", "location", "source"]))
    return ranking.first_per_key(p.select("dedup_key", "feed_ord", "job_id", "source"), ["dedup_key"], [("feed_ord", "asc"), ("job_id", "asc")]).drop("feed_ord")


@query("w12_latest_by_time", f"""WITH {STATUS_SQL}, l AS (SELECT * FROM evals QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, eval_seq DESC) = 1)
SELECT p.job_id, l.eval_seq, l.model, coalesce(st.status, 'new') AS app_status, coalesce(st.note, '') AS note, c.name AS company,
 CASE WHEN {o.canonical_url('p.url')} <> p.url THEN least(p.url, {o.canonical_url('p.url')}) || '|' || greatest(p.url, {o.canonical_url('p.url')}) ELSE p.url END AS urls
FROM postings p LEFT JOIN l ON l.job_id = p.job_id LEFT JOIN st ON st.job_id = p.job_id LEFT JOIN company_dim c ON c.company_id = p.company_id""")
def w12(spark, d):
    """Posting detail: newest evaluation of any version, status, note, company and every known URL."""
    p = view(spark, d, "postings", ["url", "company_id"])
    e = versions.latest_by_time(view(spark, d, "evals")).select("job_id", "eval_seq", "model")
    st = versions.latest_status(view(spark, d, "apps")).select("job_id", "status", "note")
    urls = F.array_join(F.array_sort(F.array_distinct(F.array(p.url, tx.canonical_url(p.url)))), "|")
    return (p.select("job_id", "company_id", urls.alias("urls")).join(e, "job_id", "left").join(st, "job_id", "left")
            .join(view(spark, d, "company_dim").select("company_id", F.col("name").alias("company")), "company_id", "left")
            .select("job_id", "eval_seq", "model", F.coalesce("status", F.lit("new")).alias("app_status"), F.coalesce("note", F.lit("")).alias("note"), "company", "urls"))


@query("p03_decorate_rows", f"""WITH {ROWS_SQL} SELECT job_id, src, role, fit_tags, unread, track, is_new, bullets, confidence, deadline - DATE '2024-01-31' AS due_days FROM deco""")
def p03(spark, d):
    rows = reports.with_due_days(S, decorated(spark, d, deadline=True))
    return rows.select("job_id", "src", "role", "fit_tags", "unread", "track", "is_new", "bullets", "confidence", "due_days")


@query("f17_browse_filter", f"""WITH {ROWS_SQL} SELECT job_id, src, bucket, track, role FROM deco WHERE app_status = 'new' AND src IN ('fast', 'triage') AND bucket IN ('likely')
 AND (track = 'primary' OR track = 'unknown') AND (contains(lower(company_name), 'intern') OR contains(lower(title), 'intern') OR contains(lower(location), 'intern'))""")
def f17(spark, d):
    return reports.browse(decorated(spark, d), bucket="likely", status="new", term="primary", src="fast", q="Intern").select("job_id", "src", "bucket", "track", "role")


@query("a12_facet_counts", f"""WITH {ROWS_SQL}, n AS (SELECT *, src IN ('fast', 'triage') AS fast, track IN ('primary', 'unknown') AS pt, track IN ('alt', 'unknown') AS alt FROM deco WHERE app_status = 'new')
SELECT 'src' AS facet, 'all' AS value, count(*) AS n FROM n HAVING count(*) > 0 UNION ALL SELECT 'src', 'fast', count(*) FROM n WHERE fast HAVING count(*) > 0 UNION ALL SELECT 'src', 'deep', count(*) FROM n WHERE src = 'deep' HAVING count(*) > 0
UNION ALL SELECT 'bucket', bucket, count(*) FROM n WHERE fast AND pt GROUP BY bucket
UNION ALL SELECT 'term', 'all', count(*) FROM n WHERE fast AND bucket = 'likely' HAVING count(*) > 0 UNION ALL SELECT 'term', 'primary', count(*) FROM n WHERE fast AND bucket = 'likely' AND pt HAVING count(*) > 0
UNION ALL SELECT 'term', 'alt', count(*) FROM n WHERE fast AND bucket = 'likely' AND alt HAVING count(*) > 0
UNION ALL SELECT 'role', 'all', count(*) FROM n WHERE fast AND bucket = 'likely' AND pt HAVING count(*) > 0 UNION ALL SELECT 'role', role, count(*) FROM n WHERE fast AND bucket = 'likely' AND pt GROUP BY role""")
def a12(spark, d):
    rows = decorated(spark, d).where("app_status = 'new'")
    return reports.facet_counts(S, rows, bucket="likely", src="fast", term="primary")


@query("k01_browse_sort", f"""WITH {ROWS_SQL}, k AS (SELECT *, CASE bucket WHEN 'likely' THEN likelihood * desirability WHEN 'wildcard' THEN interest ELSE desirability END AS key1,
 CASE WHEN bucket IN ('likely', 'wildcard') THEN 0 ELSE likelihood END AS key2 FROM deco)
SELECT job_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY is_new DESC, key1 DESC, key2 DESC, job_id) AS by_match,
 row_number() OVER (PARTITION BY bucket ORDER BY coalesce(posted_at, CAST(first_seen_at AS DATE)) DESC, job_id) AS by_newest,
 row_number() OVER (PARTITION BY bucket ORDER BY list_position([{', '.join(o.q(t.key) for t in S.types)}, 'general'], role), likelihood DESC, job_id) AS by_role,
 row_number() OVER (PARTITION BY bucket ORDER BY deadline NULLS LAST, desirability DESC, job_id) AS by_deadline FROM k""")
def k01(spark, d):
    """The four browse orders as exact ranks within each bucket."""
    from siftwork.functions import roles
    rows = reports.bucket_key(decorated(spark, d, ["posted_at"], deadline=True)).select(
        "job_id", "bucket", "key1", "key2", "likelihood", "desirability", "deadline", F.col("is_new").cast("int").alias("fresh"),
        F.coalesce("posted_at", F.to_date("first_seen_at")).alias("newest"), roles.role_order(S, F.col("role")).alias("role_ord"))
    rows = cut_lineage(rows)          # narrow keys only; every rank below reads them twice
    specs = {
        "by_match": [("fresh", "desc"), ("key1", "desc"), ("key2", "desc"), ("job_id", "asc")], "by_newest": [("newest", "desc"), ("job_id", "asc")],
        "by_role": [("role_ord", "asc"), ("likelihood", "desc"), ("job_id", "asc")], "by_deadline": [("deadline", "asc"), ("desirability", "desc"), ("job_id", "asc")]}
    out = rows.select("job_id", "bucket")
    for name, order in specs.items():
        out = out.join(ranking.global_rank(rows, order, keys=["bucket"], name=name).select("job_id", name), "job_id")
    return out
