"""A and K: counts, panels, curves and ordered listings."""
from pyspark.sql import functions as F

from siftwork.config import DEFAULT as S
from siftwork.functions import dates, fixed_values as fv, roles, text as tx
from siftwork.functions.plan import once
from siftwork.operators import companies as co, dashboard as db, lookup, merge, queues, ranking, reports, scores, versions, windows
from siftwork.plans import oracle as o
from siftwork.plans.q_rules import RULE_COLUMNS, _READ
from siftwork.plans.q_score import FAST_SQL, fast_rows
from siftwork.plans.q_versions import DEADLINE_SQL, ROWS_SQL, STATUS_SQL, current, decorated
from siftwork.plans.registry import query
from siftwork.sources.views import raw, view


@query("a01_reject_counts", """SELECT CASE WHEN hard_reject_reason LIKE 'model:%' THEN 'model' ELSE hard_reject_reason END AS reason, count(*) AS n
FROM evals WHERE rubric_version = '2' AND hard_reject_reason IS NOT NULL AND created_at >= TIMESTAMP '2024-01-05' GROUP BY 1""")
def a01(spark, d):
    e = view(spark, d, "evals").where((F.col("rubric_version") == S.rubric) & F.col("hard_reject_reason").isNotNull() & (F.col("created_at") >= F.lit("2024-01-05").cast("timestamp_ntz")))
    r = F.when(e.hard_reject_reason.startswith("model:"), F.lit("model")).otherwise(e.hard_reject_reason)
    return e.groupBy(r.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


_LATEST = "l AS (SELECT * FROM evals WHERE profile_hash = 'cur' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY eval_seq DESC) = 1)"
_FUNNEL_SQL = f"""{_LATEST}, f AS (SELECT CASE WHEN l.job_id IS NULL THEN 'unscored' WHEN model = 'prefilter' THEN 'rules' WHEN model = 'triage' THEN 'triage'
 WHEN model = 'local' THEN 'local_' || coalesce(json_extract_string(raw, '$.fast.band'), 'no') ELSE 'deep' END AS stage FROM postings p LEFT JOIN l ON l.job_id = p.job_id WHERE p.active)"""


@query("a02_funnel", f"""WITH {_FUNNEL_SQL} SELECT c.stage, count(f.stage) AS n
FROM (VALUES ('unscored'), ('rules'), ('local_no'), ('local_ambiguous'), ('local_yes'), ('triage'), ('deep')) AS c(stage) LEFT JOIN f ON f.stage = c.stage GROUP BY 1""")
def a02(spark, d):
    return db.funnel(view(spark, d, "postings", ["active"]), view(spark, d, "evals"), S.profile)


@query("a03_bucket_counts", f"WITH {_LATEST} SELECT l.bucket, count(*) AS n FROM l JOIN postings p ON p.job_id = l.job_id WHERE p.active GROUP BY 1")
def a03(spark, d):
    e = versions.latest_by_seq(view(spark, d, "evals").select("job_id", "eval_seq", "profile_hash", "bucket"), S.profile)
    return e.join(view(spark, d, "postings", ["active"]).where("active").select("job_id"), "job_id").groupBy("bucket").agg(F.count("*").alias("n"))


@query("a04_top_reject_reasons", """SELECT e.hard_reject_reason AS reason, count(*) AS n FROM evals e JOIN postings p ON p.job_id = e.job_id
WHERE e.profile_hash = 'cur' AND e.model = 'prefilter' AND p.active GROUP BY 1 ORDER BY n DESC, reason LIMIT 8""")
def a04(spark, d):
    """The eight commonest reasons that rule rejects of active postings were stored with."""
    e = view(spark, d, "evals").where((F.col("profile_hash") == S.profile) & (F.col("model") == "prefilter")).select("job_id", F.col("hard_reject_reason").alias("reason"))
    live = view(spark, d, "postings", ["active"]).where("active").select("job_id")
    return e.join(live, "job_id").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(8)


@query("a05_open_by_source", "SELECT source, count(*) AS n FROM postings WHERE active GROUP BY 1")
def a05(spark, d):
    return view(spark, d, "postings", ["source", "active"]).where("active").groupBy("source").agg(F.count("*").alias("n"))


@query("a06_distinct_scored", """SELECT count(DISTINCT job_id) FILTER (WHERE hard_reject_reason IS NULL) AS scored,
 count(DISTINCT job_id) FILTER (WHERE hard_reject_reason IS NULL AND model NOT IN ('prefilter', 'local', 'triage')) AS deep FROM evals WHERE profile_hash = 'cur'""")
def a06(spark, d):
    """Distinct jobs by flags: one row per job first (two booleans), then counts; no expand of the input per distinct."""
    ok = F.col("hard_reject_reason").isNull()
    per = view(spark, d, "evals").where("profile_hash = 'cur'").groupBy("job_id").agg(
        F.bool_or(ok).alias("a"), F.bool_or(ok & ~F.col("model").isin("prefilter", "local", "triage")).alias("b"))
    return per.agg(F.count_if("a").alias("scored"), F.count_if("b").alias("deep"))


@query("a07_tokens_since", """WITH m AS (SELECT max(started_at) AS now FROM runs), t AS (SELECT CAST(coalesce(sum(tokens) FILTER (WHERE started_at >= now - INTERVAL 7 DAY), 0) AS BIGINT) AS week,
 CAST(coalesce(sum(tokens) FILTER (WHERE started_at >= now - INTERVAL 1 DAY), 0) AS BIGINT) AS day,
 CAST(coalesce(sum(tokens) FILTER (WHERE started_at >= now - INTERVAL 7 DAY AND kind = 'discover'), 0) AS BIGINT) AS week_discover FROM runs, m)
SELECT *, CAST(least(100, round_even(100.0 * week / 20000000, 0)) AS INT) AS pct, CASE WHEN week >= 20000000 THEN 'over' WHEN week >= 15000000 THEN 'high' ELSE 'ok' END AS level FROM t""")
def a07(spark, d):
    return db.tokens_since(view(spark, d, "runs"), 20_000_000)


_GOLD_SQL = f"g AS (SELECT p.*, g.bucket AS gold FROM gold g JOIN postings p ON p.job_id = g.job_id), {o.score_cte('g', 'gs')}"
_DROPS = "dr AS (SELECT p.* FROM evals e JOIN postings p ON p.job_id = e.job_id WHERE e.profile_hash = 'cur' AND e.model = 'triage' AND e.hard_reject_reason IS NOT NULL)"


def _gold(spark, d):
    p = view(spark, d, "postings", ["title", "company_name", "description_text"])
    return scores.scored_postings(S, view(spark, d, "gold").join(p, "job_id"), view(spark, d, "company_dim"))


@query("a10_calibration_matrix", f"""WITH {_GOLD_SQL}, {_DROPS}, {o.score_cte('dr', 'ds')},
x AS (SELECT gold.bucket, band FROM gs JOIN gold ON gold.job_id = gs.job_id UNION ALL SELECT 'triage-archived', band FROM ds)
SELECT bucket, count(*) FILTER (WHERE band = 'yes') AS yes, count(*) FILTER (WHERE band = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE band = 'no') AS no FROM x GROUP BY 1""")
def a10(spark, d):
    """Gold label x local band, plus a row for postings an external score archived."""
    p = view(spark, d, "postings", ["title", "company_name", "description_text"])
    drops = view(spark, d, "evals").where("profile_hash = 'cur' AND model = 'triage' AND hard_reject_reason IS NOT NULL").select("job_id", F.lit("triage-archived").alias("bucket"))
    rows = view(spark, d, "gold").unionByName(drops).join(p, "job_id")
    return db.calibration(scores.scored_postings(S, rows, view(spark, d, "company_dim")))


@query("a11_recall_curve", f"""WITH {_GOLD_SQL}, x AS (SELECT score FROM gs JOIN gold ON gold.job_id = gs.job_id WHERE gold.bucket IN ('likely', 'reach'))
SELECT t AS threshold, round(coalesce(avg(CAST(score > t AS INT)), 0), 6) AS recall FROM (SELECT unnest([10, 20, 25, 30, 32, 35, 40, 45, 50]) AS t) LEFT JOIN x ON true GROUP BY 1""")
def a11(spark, d):
    return db.recall_curve(_gold(spark, d))


@query("a13_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, '|')) AS tag FROM directory) WHERE tag <> '' GROUP BY 1")
def a13(spark, d):
    return view(spark, d, "directory").select(F.explode(co.list_of(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("a14_derive_company_tags", f"""WITH c AS (SELECT {o.slug('company_name')} AS slug, {o.classify('title', 'company_name')} AS role FROM postings),
n AS (SELECT slug, role, count(*) AS n FROM c WHERE role <> 'general' GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY slug) AS total, row_number() OVER (PARTITION BY slug ORDER BY n DESC, role) AS k FROM n),
t AS (SELECT slug, list(role) FILTER (WHERE k <= 3 AND n >= 2 AND n / total >= 0.15) AS strong, max(role) FILTER (WHERE k = 1) AS lone FROM r GROUP BY 1)
SELECT d.slug, array_to_string(list_sort(list_distinct(list_filter(coalesce(CASE WHEN len(t.strong) > 0 THEN t.strong WHEN t.lone IS NOT NULL THEN [t.lone] END, []) || string_split(d.tags, '|'), lambda x: x <> ''))), '|') AS tags
FROM directory d LEFT JOIN t ON t.slug = d.slug""")
def a14(spark, d):
    p = view(spark, d, "postings", ["company_name", "title", "source"])
    return co.derive_tags(S, p, view(spark, d, "directory")).select("slug", F.array_join("tags", "|").alias("tags"))


@query("a15_merge_entities", f"""WITH RECURSIVE e AS (SELECT *, {o.slug('name')} AS nk FROM entities), k AS (SELECT rec_id, 'n:' || nk AS key FROM e UNION ALL SELECT rec_id, 'b:' || board FROM e WHERE board IS NOT NULL),
reach(a, b) AS (SELECT rec_id, rec_id FROM e UNION SELECT r.a, k2.rec_id FROM reach r JOIN k k1 ON k1.rec_id = r.b JOIN k k2 ON k2.key = k1.key),
g AS (SELECT a AS rec_id, min(b) AS label FROM reach GROUP BY 1), x AS (SELECT e.*, g.label, (source <> 'yaml', source <> 'manual', board IS NULL, length(name), e.rec_id) AS rk FROM e JOIN g ON g.rec_id = e.rec_id)
SELECT label, arg_min(name, rk) AS name, arg_min(board, rk) FILTER (WHERE board IS NOT NULL) AS board, min(tier) AS tier, max(reputation) AS reputation,
 coalesce(arg_min(domain, rk) FILTER (WHERE domain <> ''), '') AS domain, count(*) AS records, len(list_distinct(list(name))) - 1 AS n_aliases FROM x GROUP BY 1""")
def a15(spark, d):
    m = co.merge_entities(view(spark, d, "entities"))
    return m.select("label", "name", "board", "tier", "reputation", "domain", "records", F.size("aliases").alias("n_aliases"))


@query("a16_common_spelling", f"""WITH n AS (SELECT company_name, {o.slug('company_name')} AS slug, count(*) AS n FROM postings WHERE contains(lower(company_name), 'supplier#') GROUP BY 1, 2)
SELECT slug, company_name, n FROM n WHERE slug NOT IN (SELECT slug FROM directory) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY n DESC, company_name) = 1 ORDER BY n DESC, lower(company_name) LIMIT 8""")
def a16(spark, d):
    best = co.common_spelling(view(spark, d, "postings", ["company_name"]), view(spark, d, "directory"), "Supplier#")
    return best.orderBy(F.desc("n"), F.lower("company_name")).limit(8).select("slug", "company_name", "n")


_CUT_SQL = """vg AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS f FROM visits WHERE user_id = 1),
vs AS (SELECT *, sum(f) OVER (ORDER BY ts) AS s FROM vg), va AS (SELECT s, min(ts) AS a, max(ts) AS b FROM vs GROUP BY 1),
cut AS (SELECT coalesce(lag(b) OVER (ORDER BY s), a) AS cutoff FROM va QUALIFY row_number() OVER (ORDER BY s DESC) = 1)"""


def _cutoff(spark, d):
    """The viewer's "new since" moment: end of the session before the current one."""
    s = windows.visit_sessions(view(spark, d, "visits").where("user_id = 1"))
    return s.agg(F.max_by("cutoff", "session_start").alias("cutoff"))


def _pairs(items):
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {e} AS value FROM {src}" for m, e, src in items)


_LIVE = "hard_reject_reason IS NULL AND bucket IN ('likely', 'reach', 'wildcard')"
_FRESH = f"{_LIVE} AND app_status = 'new' AND first_seen_at > (SELECT cutoff FROM cut)"


@query("a17_home_kpis", f"WITH {ROWS_SQL}, {_CUT_SQL} " + _pairs(
    [("new_count", f"count(*) FILTER (WHERE {_FRESH})", "r0"), *[(f"new_{b}", f"count(*) FILTER (WHERE {_FRESH} AND bucket = '{b}')", "r0") for b in ("likely", "reach", "wildcard")],
     ("unreviewed", f"count(*) FILTER (WHERE {_LIVE} AND app_status = 'new')", "r0"), ("open_now", "count(*) FILTER (WHERE hard_reject_reason IS NULL AND bucket IN ('likely', 'reach'))", "r0"),
     *[(f"bucket_{b}", f"count(*) FILTER (WHERE hard_reject_reason IS NULL AND bucket = '{b}')", "r0") for b in fv.BUCKETS],
     *[(f"stage_{s}", f"count(*) FILTER (WHERE status = '{s}')", "st") for s in fv.STAGES], ("in_flight", "count(*) FILTER (WHERE status IN ('shortlisted', 'applied', 'interview', 'offer'))", "st")]))
def a17(spark, d):
    return db.home_kpis(current(spark, d), versions.latest_status(view(spark, d, "apps")), _cutoff(spark, d))


@query("a18_run_stats", f"WITH {FAST_SQL} " + _pairs(
    [("pending", "count(*)", "fast_rows"), ("hard_rejected", "count(*) FILTER (WHERE model = 'prefilter')", "fast_rows"), ("scored_local", "count(*) FILTER (WHERE model = 'local')", "fast_rows"),
     *[(f"band_{b}", f"count(*) FILTER (WHERE band = '{b}')", "fast_rows") for b in ("yes", "no", "ambiguous")],
     *[(f"bucket_{b}", f"count(*) FILTER (WHERE model = 'local' AND bucket = '{b}')", "fast_rows") for b in fv.BUCKETS]]))
def a18(spark, d):
    return db.run_stats(fast_rows(spark, d))


@query("a21_header_stats", f"WITH {STATUS_SQL} " + _pairs(
    [("active", "count(*) FILTER (WHERE active)", "postings"), ("with_text", "count(*) FILTER (WHERE active AND description_text <> '')", "postings"),
     ("pending", f"count(*) FILTER (WHERE active AND {_READ} AND NOT EXISTS (SELECT 1 FROM evals e WHERE e.job_id = p.job_id AND e.profile_hash = 'cur'))", "postings p"),
     ("awaiting_model", "count(*) FILTER (WHERE e.profile_hash = 'cur' AND e.model = 'local' AND p.active AND json_extract_string(e.raw, '$.fast.band') = 'ambiguous')", "evals e JOIN postings p ON p.job_id = e.job_id"),
     ("evaluated", "count(DISTINCT job_id) FILTER (WHERE profile_hash = 'cur' AND hard_reject_reason IS NULL)", "evals"),
     ("deep", "count(DISTINCT job_id) FILTER (WHERE profile_hash = 'cur' AND hard_reject_reason IS NULL AND model = 'deep')", "evals"),
     ("in_flight", "count(*) FILTER (WHERE status IN ('shortlisted', 'applied', 'interview', 'offer'))", "st"),
     ("unreviewed", "count(*) FILTER (WHERE e.profile_hash = 'cur' AND e.hard_reject_reason IS NULL AND p.active AND e.bucket IN ('likely', 'reach') AND st.job_id IS NULL)", "evals e JOIN postings p ON p.job_id = e.job_id LEFT JOIN st ON st.job_id = e.job_id"),
     ("last_run", "max(run_id)", "runs")]))
def a21(spark, d):
    p = view(spark, d, "postings", ["active", "description_text", "fetch_failures"])
    return db.header_stats(S, p, view(spark, d, "evals"), versions.latest_status(view(spark, d, "apps")), view(spark, d, "runs"))


@query("a22_backlog_alerts", f"""WITH c AS (SELECT (SELECT count(*) FROM postings p WHERE active AND {_READ} AND NOT EXISTS (SELECT 1 FROM evals e WHERE e.job_id = p.job_id AND e.profile_hash = 'old')) AS pending,
 (SELECT count(*) FROM evals e JOIN postings p ON p.job_id = e.job_id WHERE e.profile_hash = 'cur' AND e.model = 'local' AND p.active AND json_extract_string(e.raw, '$.fast.band') = 'ambiguous') AS awaiting,
 (SELECT sum(tokens) FROM runs WHERE started_at >= (SELECT max(started_at) FROM runs) - INTERVAL 7 DAY) AS week)
SELECT 'warn' AS level, 'score' AS stage, pending || ' readable postings have no score yet.' AS text, 'Start a scoring run.' AS action FROM c WHERE pending > 0
UNION ALL SELECT 'warn', 'score', 'Scoring stopped at the per-run token cap. ' || format('{{:,}}', awaiting) || CASE WHEN awaiting = 1 THEN ' unclear posting is' ELSE ' unclear postings are' END || ' on the free score only.', '' FROM c WHERE awaiting > 0
UNION ALL SELECT 'warn', 'triage', 'The weekly token cap (1,000) is used up.', 'Raise the weekly cap, or set it to 0 for none.' FROM c WHERE awaiting = 0 AND week >= 1000
UNION ALL SELECT 'info', 'triage', 'The scorer is off: ambiguous postings keep their local score.', 'Turn the scorer on.'""")
def a22(spark, d):
    """Alerts of a run that the token cap cut short, with the scorer off since."""
    p = view(spark, d, "postings", ["active", "description_text", "fetch_failures"])
    e = view(spark, d, "evals")
    c = (queues.pending_fast(p, e, "old").agg(F.count("*").alias("pending"))
         .crossJoin(queues.ambiguous_queue(e, p, S.profile).agg(F.count("*").alias("awaiting")))
         .crossJoin(db.tokens_since(view(spark, d, "runs"), 1000).select("week")))
    return db.alerts(S, c, "run cap", 1000, scorer_on=False)


@query("a23_catalog_groups", f"""WITH r AS (SELECT {o.classify('title', 'company_name')} AS role, count(*) AS n FROM postings GROUP BY 1)
SELECT c.grp, string_agg(c.key, '|' ORDER BY c.ord) AS keys, CAST(sum(coalesce(r.n, 0)) AS BIGINT) AS postings FROM catalog c LEFT JOIN r ON r.role = c.key GROUP BY 1""")
def a23(spark, d):
    """Picker groups with their types and how many postings land in each group (the fallback type has no group)."""
    p = view(spark, d, "postings", ["title", "company_name"])
    n = once(p, key=roles.classify(S, p.title, p.company_name)).groupBy("key").agg(F.count("*").alias("n"))
    c = view(spark, d, "catalog").join(n, "key", "left")
    g = c.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("ord", "key"))).alias("k"), F.sum(F.coalesce("n", F.lit(0))).alias("postings"))
    return g.select("grp", F.array_join(F.transform("k", lambda x: x["key"]), "|").alias("keys"), "postings")


# ---- K --------------------------------------------------------------------------------------------

@query("k02_home_top", f"""WITH {ROWS_SQL}, {_CUT_SQL}, u AS (SELECT * FROM r0 WHERE {_LIVE} AND app_status = 'new')
(SELECT 'new' AS list, row_number() OVER (ORDER BY likelihood DESC, desirability DESC, job_id) AS rank, job_id FROM u WHERE first_seen_at > (SELECT cutoff FROM cut) ORDER BY rank LIMIT 4)
UNION ALL (SELECT 'unreviewed', row_number() OVER (ORDER BY likelihood DESC, desirability DESC, job_id) AS rank, job_id FROM u ORDER BY rank LIMIT 4)""")
def k02(spark, d):
    u = current(spark, d).where("hard_reject_reason IS NULL AND bucket IN ('likely', 'reach', 'wildcard') AND app_status = 'new'").select(
        "job_id", "likelihood", "desirability", "first_seen_at")
    order = [("likelihood", "desc"), ("desirability", "desc"), ("job_id", "asc")]
    fresh = u.crossJoin(F.broadcast(_cutoff(spark, d))).where("cutoff IS NULL OR first_seen_at > cutoff").drop("cutoff")
    a = ranking.top_rank(fresh, order, 4).select(F.lit("new").alias("list"), "rank", "job_id")
    return a.unionByName(ranking.top_rank(u, order, 4).select(F.lit("unreviewed").alias("list"), "rank", "job_id"))


@query("k03_upcoming_deadlines", f"""WITH {ROWS_SQL}, u AS (SELECT job_id, deadline - DATE '2024-01-31' AS days FROM r1 WHERE {_LIVE})
SELECT row_number() OVER (ORDER BY days, job_id) AS rank, job_id, days, days <= 5 AS urgent, count(*) OVER () AS total FROM u WHERE days BETWEEN 0 AND 14 ORDER BY rank LIMIT 4""")
def k03(spark, d):
    rows = current(spark, d, ["description_text"]).where("hard_reject_reason IS NULL AND bucket IN ('likely', 'reach', 'wildcard')")
    rows = once(rows, deadline=dates.deadline(F.col("description_text"), dates.at(S.as_of))).select("job_id", "deadline")
    due = reports.with_due_days(S, rows).where((F.col("due_days") >= 0) & (F.col("due_days") <= fv.DEADLINE_CARD_DAYS)).select("job_id", F.col("due_days").alias("days"))
    top = ranking.top_rank(due, [("days", "asc"), ("job_id", "asc")], 4)
    return top.crossJoin(due.agg(F.count("*").alias("total"))).select("rank", "job_id", "days", (F.col("days") <= fv.URGENT_DAYS).alias("urgent"), "total")


@query("k04_applications_board", f"""WITH {ROWS_SQL} SELECT app_status, list_position(['shortlisted', 'applied', 'interview', 'offer', 'rejected', 'closed', 'skipped'], app_status) - 1 AS stage_ord, job_id,
 row_number() OVER (PARTITION BY app_status ORDER BY deadline NULLS LAST, likelihood DESC, job_id) AS rank FROM r1 WHERE app_status <> 'new'""")
def k04(spark, d):
    rows = current(spark, d, ["description_text"]).where("app_status <> 'new'").select(
        "app_status", "job_id", "likelihood", dates.deadline(F.col("description_text"), dates.at(S.as_of)).alias("deadline"))
    ranked = ranking.global_rank(rows, [("deadline", "asc"), ("likelihood", "desc"), ("job_id", "asc")], keys=["app_status"])
    ordinal = roles.literal_map(F.col("app_status"), {s: i for i, s in enumerate(fv.BOARD_STAGES)}, F.lit(len(fv.BOARD_STAGES)))
    return ranked.select("app_status", ordinal.alias("stage_ord"), "job_id", "rank")


@query("k05_needs_you", f"""WITH {STATUS_SQL} SELECT p.company_name, CASE st.status WHEN 'interview' THEN 'interview scheduled' ELSE 'offer to answer' END AS what, CAST(st.updated_at AS DATE) AS day
FROM st JOIN postings p ON p.job_id = st.job_id WHERE st.status IN ('interview', 'offer') ORDER BY st.updated_at DESC, p.job_id LIMIT 3""")
def k05(spark, d):
    st = versions.latest_status(view(spark, d, "apps")).where("status IN ('interview', 'offer')")
    top = st.orderBy(F.desc("updated_at"), "job_id").limit(3)
    return top.join(view(spark, d, "postings", ["company_name"]), "job_id").select(
        "company_name", F.when(F.col("status") == "interview", F.lit("interview scheduled")).otherwise(F.lit("offer to answer")).alias("what"), F.to_date("updated_at").alias("day"))


@query("k06_directory_search", """WITH r AS (SELECT slug, name, CASE WHEN lower(name) = 'supplier#000000004' THEN 0 WHEN contains(lower(name), 'supplier#00000000') THEN 1 END AS m,
 CASE WHEN tier = '' THEN 9 ELSE CAST(tier AS INT) END AS t FROM directory)
SELECT slug, CAST(1 AS INT) AS match, row_number() OVER (ORDER BY t, lower(name), slug) AS rank, greatest(0, count(*) OVER () - 30) AS more FROM r WHERE m IS NOT NULL ORDER BY rank LIMIT 30""")
def k06(spark, d):
    hits = co.directory_search(view(spark, d, "directory"), "Supplier#00000000").withColumn("low", F.lower("name"))
    top = ranking.top_rank(hits.select("slug", "match", "tier9", "low"), [("match", "asc"), ("tier9", "asc"), ("low", "asc"), ("slug", "asc")], 30)
    return top.crossJoin(hits.agg(F.greatest(F.lit(0), F.count("*") - 30).alias("more"))).select("slug", "match", "rank", "more")


@query("k06b_search_many", r"""WITH q AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 10 = 9 THEN '' ELSE lower(trim(substr(CASE WHEN s_suppkey % 4 = 0 THEN s_name || ' Holdings' ELSE s_name END, CAST(1 + s_suppkey * 7 % 20 AS INT), CAST(1 + s_suppkey % 12 AS INT)))) END AS q FROM supplier),
n AS (SELECT slug, CASE WHEN tier = '' THEN 9 ELSE CAST(tier AS INT) END AS t, lower(name) AS low, unnest([lower(name)] || list_transform(string_split(aliases, '|'), lambda x: lower(trim(x)))) AS name FROM directory),
r AS (SELECT query_id, slug, t, low, CASE WHEN q = '' OR n.name = q THEN 0 WHEN starts_with(n.name, q) THEN 1 WHEN len(list_filter(regexp_split_to_array(trim(n.name), '[()\s]+'), lambda w: starts_with(w, q))) > 0 THEN 2 WHEN contains(n.name, q) THEN 3 END AS m FROM q, n),
b AS (SELECT query_id, slug, t, low, min(m) AS match FROM r WHERE m IS NOT NULL GROUP BY ALL)
SELECT query_id, slug, match, row_number() OVER (PARTITION BY query_id ORDER BY match, t, low, slug) AS rank, greatest(0, count(*) OVER (PARTITION BY query_id) - 30) AS more FROM b
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY match, t, low, slug) <= 30""")
def k06b(spark, d):
    """A search per supplier: pieces of names of one to twelve characters, and empty ones."""
    s = raw(spark, d, "supplier")
    k = s.s_suppkey
    text = F.when(k % 4 == 0, F.concat(s.s_name, F.lit(" Holdings"))).otherwise(s.s_name)
    q = F.when(k % 10 == 9, F.lit("")).otherwise(F.substring(text, (1 + k * 7 % 20).cast("int"), (1 + k % 12).cast("int")))
    return co.search_many(view(spark, d, "directory"), s.select(k.alias("query_id"), q.alias("q")))


@query("k07_dry_run_report", f"""WITH pend AS (SELECT * FROM postings p WHERE active AND {_READ} AND NOT EXISTS (SELECT 1 FROM evals e WHERE e.job_id = p.job_id AND e.profile_hash = 'old' AND e.rubric_version <> '2'
   AND (e.bucket = 'archive' OR e.hard_reject_reason IS NOT NULL)) AND NOT EXISTS (SELECT 1 FROM evals e WHERE e.job_id = p.job_id AND e.profile_hash = 'old' AND e.rubric_version = '2')), {o.cascade_cte('pend')}
SELECT job_id, CAST(job_id * 13 % 101 AS INT) AS score, row_number() OVER (ORDER BY job_id * 13 % 101 DESC, job_id) AS rank FROM judged WHERE reason IS NULL AND job_id % 7 <> 0 AND job_id * 13 % 101 < 35 ORDER BY rank LIMIT 40""")
def k07(spark, d):
    p = view(spark, d, "postings", [*RULE_COLUMNS, "active", "fetch_failures"]).withColumn("needs_reeval", F.lit(False))
    queue = queues.pending_evaluation(p, view(spark, d, "evals"), "old", S.rubric)
    ext = view(spark, d, "postings", []).where("job_id % 7 <> 0").select("job_id", (F.col("job_id") * 13 % 101).cast("int").alias("score"))
    passed = scores.with_reason(S, queue).where("reason IS NULL").select("job_id")
    low = passed.join(ext.where(F.col("score") < S.triage_min_score), "job_id")
    return ranking.top_rank(low, [("score", "desc"), ("job_id", "asc")], 40)


@query("k08_listings_order", "SELECT slug, status, row_number() OVER (ORDER BY status, tier NULLS FIRST, name) AS rank FROM company_dim")
def k08(spark, d):
    c = view(spark, d, "company_dim").select("slug", "status", "name", F.coalesce("tier", F.lit(-1)).alias("tier"))
    return ranking.global_rank(c, [("status", "asc"), ("tier", "asc"), ("name", "asc")]).select("slug", "status", "rank")
