"""J and E: look-ups, matches, anti/semi joins and set operations."""
from pyspark.sql import functions as F

from siftwork.config import DEFAULT as S, RolePick
from siftwork.functions import fixed_values as fv, phrases, roles, scoring, text as tx
from siftwork.functions.plan import once
from siftwork.operators import companies as co, lookup, merge, ranking, versions
from siftwork.operators.queues import ambiguous_queue
from siftwork.plans import oracle as o
from siftwork.plans.q_versions import CUR_SQL, ROWS_SQL, STATUS_SQL, current, keyed
from siftwork.plans.registry import query
from siftwork.session import cut_lineage
from siftwork.sources.views import raw, view

DEFAULT_REP = "coalesce(c.reputation, CASE c.tier WHEN 1 THEN 90 WHEN 2 THEN 70 WHEN 3 THEN 55 END, 50)"


@query("j01_current_evaluations", f"WITH {ROWS_SQL} SELECT job_id, eval_seq, company_name, bucket, app_status, tier, desirability, likelihood FROM r0")
def j01(spark, d):
    return current(spark, d).select("job_id", "eval_seq", "company_name", "bucket", "app_status", "tier", "desirability", "likelihood").orderBy(
        F.desc("desirability"), F.desc("likelihood"), "job_id")


# stored snapshot: two thirds of the postings, first per key; incoming: an overlapping two thirds, some renamed
EXTERNAL_SQL = "CASE WHEN job_id % 4 = 2 THEN 'x' || job_id END"
SNAPSHOT_SQL = f"""keyed0 AS (SELECT *, {EXTERNAL_SQL} AS external_id, {o.dedup_key('company_name', 'title', 'location')} AS dedup_key, {o.canonical_url('url')} AS curl FROM postings WHERE job_id % 3 <> 2),
stored AS (SELECT * FROM keyed0 QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY job_id) = 1)"""
INCOMING_SQL = f"""inc0 AS (SELECT * REPLACE (CASE WHEN job_id % 10 = 1 THEN 'Renamed Role Intern' ELSE title END AS title,
 CASE WHEN job_id % 4 = 1 AND description_text <> '' THEN description_text || ' v2' ELSE description_text END AS description_text) FROM postings WHERE job_id % 3 <> 0),
incoming AS (SELECT *, {EXTERNAL_SQL} AS external_id, {o.dedup_key('company_name', 'title', 'location')} AS dedup_key, {o.canonical_url('url')} AS curl FROM inc0)"""
POSTING_FIELDS = ["company_name", "title", "location", "url", "source", "active", "terms_txt", "sponsorship", "description_text", "company_id", "posted_at"]


def _with_external_id(p):
    return p.withColumn("external_id", F.when(p.job_id % 4 == 2, F.concat(F.lit("x"), p.job_id.cast("string"))))


def stored(spark, d):
    p = view(spark, d, "postings", [*POSTING_FIELDS, "first_seen_at"]).where("job_id % 3 <> 2")
    rows = merge.keyed_rows(_with_external_id(p))
    return cut_lineage(ranking.first_per_key(rows, ["dedup_key"], [("job_id", "asc")]))     # stands for a stored snapshot


def incoming(spark, d):
    p = view(spark, d, "postings", POSTING_FIELDS).where("job_id % 3 <> 0")
    p = p.withColumns({
        "title": F.when(p.job_id % 10 == 1, F.lit("Renamed Role Intern")).otherwise(p.title),
        "description_text": F.when((p.job_id % 4 == 1) & (p.description_text != ""), F.concat(p.description_text, F.lit(" v2"))).otherwise(p.description_text)})
    return merge.keyed_rows(_with_external_id(p))


@query("j02_match_existing_posting", f"""WITH {SNAPSHOT_SQL}, {INCOMING_SQL}, u AS (SELECT curl, min(job_id) AS job_id FROM stored GROUP BY 1)
SELECT i.job_id, coalesce(k.job_id, u.job_id) AS match_id, CASE WHEN k.job_id IS NOT NULL THEN 'key' WHEN u.job_id IS NOT NULL THEN 'url' END AS how
FROM incoming i LEFT JOIN stored k ON k.dedup_key = i.dedup_key LEFT JOIN u ON u.curl = i.curl AND i.curl <> ''""")
def j02(spark, d):
    return merge.match_existing(incoming(spark, d), stored(spark, d)).select("job_id", "match_id", "how")


@query("j03_deactivate_missing", f"""WITH seen AS (SELECT source, count(*) AS n FROM postings WHERE job_id // 60 % 2 = 1 GROUP BY 1)
SELECT p.job_id, p.source FROM postings p JOIN seen s ON s.source = p.source WHERE p.active AND s.n >= 5 AND p.job_id // 60 % 2 = 0""")
def j03(spark, d):
    p = view(spark, d, "postings", ["source", "active"])
    return merge.deactivate_missing(p, p.where("job_id div 60 % 2 = 1"))


@query("j04_harvest_boards", f"""WITH h AS (SELECT p.job_id, p.company_name AS name, {o.slug('p.company_name')} AS slug, CASE p.job_id % 6 WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' WHEN 3 THEN 'ashby' ELSE 'workday' END AS ats_type,
 'sup' || p.supplier_key || CASE p.job_id % 6 WHEN 4 THEN '/wd5/External' ELSE '' END AS ats_token FROM postings p LEFT JOIN company_dim c ON c.company_id = p.company_id
 WHERE p.active AND (description_text IS NULL OR description_text <> '') AND (c.company_id IS NULL OR c.ats_token IS NULL) AND p.job_id % 6 IN (1, 2, 3, 4)),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY slug ORDER BY job_id) = 1)
SELECT f.slug, f.name, f.ats_type, f.ats_token, coalesce(c.source, 'harvest') AS source, coalesce(c.status, 'approved') AS status
FROM f LEFT JOIN company_dim c ON c.slug = f.slug WHERE c.status IS NULL OR c.status NOT IN ('rejected', 'paused')""")
def j04(spark, d):
    p = view(spark, d, "postings", ["company_name", "company_id", "url", "active", "description_text"])
    return co.harvest_boards(p, view(spark, d, "company_dim"))


@query("j05_reputation_lookup", f"SELECT p.job_id, {DEFAULT_REP} AS reputation FROM postings p LEFT JOIN company_dim c ON c.company_id = p.company_id")
def j05(spark, d):
    return lookup.reputation_by_id(view(spark, d, "postings", ["company_id"]), view(spark, d, "company_dim"), S.unknown_reputation).select("job_id", "reputation")


@query("j06_reputation_by_slug", f"""SELECT p.job_id, coalesce(c.reputation, CASE c.tier WHEN 1 THEN 90 WHEN 2 THEN 70 WHEN 3 THEN 55 END) AS reputation
FROM postings p LEFT JOIN company_dim c ON c.slug = {o.slug('p.company_name')}""")
def j06(spark, d):
    return lookup.reputation_by_slug(view(spark, d, "postings", ["company_name"]), view(spark, d, "company_dim")).select("job_id", "reputation")


@query("j07_link_company_by_slug", f"""WITH f AS (SELECT DISTINCT {o.slug('company_name')} AS slug FROM postings WHERE job_id % 50 = 7)
SELECT p.job_id, f.slug, coalesce(c.company_id, -1) AS linked_id, c.company_id IS NULL AS created FROM postings p JOIN f ON f.slug = {o.slug('p.company_name')} LEFT JOIN company_dim c ON c.slug = f.slug""")
def j07(spark, d):
    """Flagging a posting's company attaches every posting with the same slug; an unknown company is created (-1 here)."""
    p = view(spark, d, "postings", ["company_name"]).select("job_id", tx.slug(F.col("company_name")).alias("slug"))
    flagged = p.where("job_id % 50 = 7").select("slug").distinct().join(view(spark, d, "company_dim").select("slug", "company_id"), "slug", "left")
    return p.join(flagged, "slug").select("job_id", "slug", F.coalesce("company_id", F.lit(-1)).alias("linked_id"), F.col("company_id").isNull().alias("created"))


# company rows as users typed them: some only match by alias or by board
_TYPED = """SELECT company_id, CASE company_id % 3 WHEN 0 THEN slug ELSE 'typed-' || CAST(company_id AS STRING) END AS slug,
 CASE company_id % 3 WHEN 1 THEN name || ' Holdings' WHEN 2 THEN 'Other ' || CAST(company_id AS STRING) ELSE name END AS name, ats_type, ats_token, status FROM company_dim"""


def typed(spark, d):
    c = view(spark, d, "company_dim")
    k = F.col("company_id")
    return c.withColumns({
        "slug": F.when(k % 3 == 0, c.slug).otherwise(F.concat(F.lit("typed-"), k.cast("string"))),
        "name": F.when(k % 3 == 1, F.concat(c.name, F.lit(" Holdings"))).when(k % 3 == 2, F.concat(F.lit("Other "), k.cast("string"))).otherwise(c.name)})


@query("j08_directory_match", f"""WITH t AS ({_TYPED.replace('STRING', 'VARCHAR')})
SELECT t.company_id, CASE t.company_id % 3 WHEN 2 THEN b.slug ELSE e.slug END AS entry, CASE WHEN t.company_id % 3 = 0 AND e.slug IS NOT NULL THEN 'slug' WHEN t.company_id % 3 = 1 AND e.slug IS NOT NULL THEN 'name'
  WHEN b.slug IS NOT NULL THEN 'board' END AS how
FROM t LEFT JOIN directory e ON CAST(split_part(e.slug, '-', 2) AS BIGINT) = t.company_id LEFT JOIN directory b ON b.ats_type = t.ats_type AND lower(b.ats_token) = lower(t.ats_token)""")
def j08(spark, d):
    return co.match_directory(typed(spark, d), view(spark, d, "directory")).select("company_id", "entry", "how")


_WATCH = """w AS (SELECT slug FROM company_dim WHERE status = 'approved')"""


@query("j09_watchlist_semi", f"WITH {_WATCH} SELECT job_id FROM postings WHERE {o.slug('company_name')} IN (SELECT slug FROM w)")
def j09(spark, d):
    p = view(spark, d, "postings", ["company_name"]).withColumn("slug", tx.slug(F.col("company_name")))
    return p.join(co.watch_slugs(view(spark, d, "company_dim"), view(spark, d, "directory")), "slug", "left_semi").select("job_id")


@query("j10_attach_scores", """SELECT q.job_id, q.eval_seq, x.s AS score, CASE WHEN x.s IS NULL THEN 'deferred' WHEN x.s < 35 THEN 'rejected' ELSE 'scored' END AS outcome,
 CASE WHEN x.s < 35 THEN 'triage: scored low (' || x.s || ')' END AS hard_reject_reason,
 CASE WHEN x.s >= 35 THEN CAST(greatest(0, least(100, round_even(CAST(0.7 AS DOUBLE) * x.s + (1 - CAST(0.7 AS DOUBLE)) * q.likelihood, 0))) AS INT) END AS final
FROM (SELECT e.* FROM evals e JOIN postings p ON p.job_id = e.job_id WHERE e.profile_hash = 'cur' AND e.model = 'local' AND p.active AND json_extract_string(e.raw, '$.fast.band') = 'ambiguous') q,
 LATERAL (SELECT CASE WHEN q.job_id % 7 <> 0 THEN CAST(q.job_id * 13 % 101 AS INT) END AS s) x""")
def j10(spark, d):
    """External scores joined back onto the queue: missing = stays on its local score, low = reject, else blended."""
    q = ambiguous_queue(view(spark, d, "evals"), view(spark, d, "postings", ["active"]), S.profile)
    ext = view(spark, d, "postings", []).where("job_id % 7 <> 0").select("job_id", (F.col("job_id") * 13 % 101).cast("int").alias("score"))
    return merge.attach_scores(S, q, ext)


@query("j11_carry_over_versions", """WITH s AS (SELECT * FROM evals WHERE rubric_version = '2'), n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, eval_seq DESC) = 1)
SELECT n.job_id, n.eval_seq, CASE WHEN regexp_matches(coalesce(n.hard_reject_reason, ''), '(?i)term|season|winter|spring|summer|fall|autumn|start (?:date|window)|20\\d\\d') THEN 'requeued' ELSE 'carried' END AS outcome,
 CASE WHEN regexp_matches(coalesce(n.hard_reject_reason, ''), '(?i)term|season|winter|spring|summer|fall|autumn|start (?:date|window)|20\\d\\d') THEN n.profile_hash ELSE 'new' END AS profile_hash
FROM n JOIN postings p ON p.job_id = n.job_id WHERE p.active AND p.job_id % 10 <> 0 AND n.model NOT IN ('prefilter', 'local') AND n.profile_hash <> 'new'
UNION ALL SELECT n.job_id, n.eval_seq, CASE WHEN regexp_matches(coalesce(n.hard_reject_reason, ''), '(?i)term|fall|start (?:date|window)') THEN 'requeued' ELSE 'carried' END,
 CASE WHEN regexp_matches(coalesce(n.hard_reject_reason, ''), '(?i)term|fall|start (?:date|window)') THEN n.profile_hash ELSE 'old' END
FROM n JOIN postings p ON p.job_id = n.job_id WHERE p.active AND p.job_id % 10 <> 0 AND n.model NOT IN ('prefilter', 'local') AND n.profile_hash <> 'old'
 AND NOT EXISTS (SELECT 1 FROM s WHERE s.job_id = n.job_id AND s.profile_hash = 'old')""")
def j11(spark, d):
    """Carry over to a brand-new profile and to the old one (where some jobs already have a row)."""
    p = view(spark, d, "postings", ["active"]).withColumn("needs_reeval", F.col("job_id") % 10 == 0)
    e = view(spark, d, "evals")
    cols = ["job_id", "eval_seq", "outcome", "profile_hash"]
    return versions.carry_over(e, p, "new", S.rubric).select(cols).unionByName(versions.carry_over(e, p, "old", S.rubric).select(cols))


@query("j12_stale_versions", """SELECT job_id, description_text = '' AS requeued, description_text <> '' AS needs_reeval FROM postings p
WHERE active AND description_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM evals e WHERE e.job_id = p.job_id AND e.rubric_version = '2' AND e.profile_hash = 'old')""")
def j12(spark, d):
    return versions.stale_jobs(view(spark, d, "postings", ["active", "description_text"]), view(spark, d, "evals"), "old", S.rubric)


_LIMITS_SQL = f"""caps0 AS (SELECT {o.slug('company_name')} AS company, job_id, job_id % 13 AS c13 FROM postings WHERE job_id % 13 IN (3, 10) AND description_text <> ''),
votes AS (SELECT company, c13, count(*) AS n, min(job_id) AS f FROM caps0 GROUP BY 1, 2),
limits AS (SELECT company, CASE c13 WHEN 3 THEN 3 ELSE 5 END AS cap, CASE c13 WHEN 3 THEN 'Candidates are limited to three (3) applications within a 30-day period.' ELSE 'Each applicant may submit up to 5 applications per year.' END AS cap_text
  FROM votes QUALIFY row_number() OVER (PARTITION BY company ORDER BY n DESC, f) = 1)"""
_USED_SQL = f"""{STATUS_SQL}, used AS (SELECT {o.slug('p.company_name')} AS company, count(*) AS used FROM st JOIN postings p ON p.job_id = st.job_id WHERE st.status IN ('applied', 'interview', 'rejected', 'offer') GROUP BY 1)"""


@query("a08_company_limits", f"WITH {_LIMITS_SQL} SELECT company, cap, cap_text FROM limits")
def a08(spark, d):
    return co.company_limits(view(spark, d, "postings", ["company_name", "description_text"]))


@query("a09_submitted_counts", f"WITH {_USED_SQL} SELECT company, used FROM used")
def a09(spark, d):
    return co.submitted_counts(versions.latest_status(view(spark, d, "apps")), view(spark, d, "postings", ["company_name"]))


@query("j13_application_cap_usage", f"""WITH {_LIMITS_SQL}, {_USED_SQL} SELECT p.job_id, l.cap, coalesce(u.used, 0) AS used, coalesce(u.used, 0) >= l.cap AS full
FROM postings p JOIN limits l ON l.company = {o.slug('p.company_name')} LEFT JOIN used u ON u.company = l.company""")
def j13(spark, d):
    p = view(spark, d, "postings", ["company_name", "description_text"])
    limits = co.company_limits(p)
    used = co.submitted_counts(versions.latest_status(view(spark, d, "apps")), p)
    per = limits.join(used, "company", "left").select("company", "cap", F.coalesce("used", F.lit(0)).alias("used"))
    return p.select("job_id", tx.company_key(p.company_name).alias("company")).join(per, "company").select("job_id", "cap", "used", (F.col("used") >= F.col("cap")).alias("full"))


@query("j14_board_open_postings", """SELECT c.slug, CASE c.ats_type WHEN 'workday' THEN 'workday:sup' || c.company_id ELSE c.ats_type || ':' || c.ats_token END AS source_key, count(p.job_id) AS postings
FROM company_dim c LEFT JOIN (SELECT job_id, 'greenhouse:sup' || supplier_key AS k FROM postings WHERE active AND job_id % 6 = 1 UNION ALL SELECT job_id, 'lever:sup' || supplier_key FROM postings WHERE active AND job_id % 6 = 2
 UNION ALL SELECT job_id, 'workday:sup' || supplier_key FROM postings WHERE active AND job_id % 6 = 4) p ON p.k = CASE c.ats_type WHEN 'workday' THEN 'workday:sup' || c.company_id ELSE c.ats_type || ':' || c.ats_token END
WHERE c.status = 'approved' AND c.ats_token IS NOT NULL GROUP BY 1, 2""")
def j14(spark, d):
    """Boards with their open postings; a posting's source key comes from the board its URL names."""
    p = co.board_rows(view(spark, d, "postings", ["url", "active"]).where("active"), "url")
    opened = p.groupBy(co.source_key(F.col("b.ats_type"), F.col("b.ats_token")).alias("source_key")).agg(F.count("*").alias("postings"))
    c = view(spark, d, "company_dim").where((F.col("status") == "approved") & F.col("ats_token").isNotNull() & F.col("ats_type").isin(fv.POLLABLE_BOARDS))
    boards = c.select("slug", co.source_key(c.ats_type, c.ats_token).alias("source_key"))
    return boards.join(opened, "source_key", "left").select("slug", "source_key", F.coalesce("postings", F.lit(0)).alias("postings"))


_TYPES = [t for t in S.types if t.keywords]


@query("j15_keyword_match", " UNION ALL ".join(f"SELECT job_id, '{t.key}' AS role, {o.hits('title', t.keywords)} AS hits FROM postings WHERE {o.hits('title', t.keywords)} > 0" for t in _TYPES))
def j15(spark, d):
    """Titles against every role vocabulary, by the phrase dictionary."""
    p = view(spark, d, "postings", ["title"])
    names = F.array(*map(F.lit, roles.role_names(S)))
    hits = F.transform(roles.role_hits(S, F.lower("title")), lambda h: F.struct(F.get(names, h["g"]).alias("role"), h["hits"].alias("hits")))
    return p.select("job_id", F.explode(hits).alias("m")).select("job_id", "m.*")


@query("j16_top_for_deep", f"""WITH {STATUS_SQL} SELECT e.job_id, e.eval_seq FROM evals e JOIN postings p ON p.job_id = e.job_id LEFT JOIN st ON st.job_id = e.job_id
WHERE e.profile_hash = 'cur' AND e.model IN ('local', 'triage') AND e.hard_reject_reason IS NULL AND p.active AND coalesce(st.status, 'new') = 'new' AND e.bucket = 'likely'
ORDER BY e.likelihood DESC, p.first_seen_at DESC, e.eval_seq LIMIT 10""")
def j16(spark, d):
    e = view(spark, d, "evals").where("profile_hash = 'cur' AND model IN ('local', 'triage') AND hard_reject_reason IS NULL AND bucket = 'likely'")
    handled = versions.latest_status(view(spark, d, "apps")).where("status <> 'new'").select("job_id")
    rows = e.join(view(spark, d, "postings", ["active", "first_seen_at"]).where("active"), "job_id").join(handled, "job_id", "left_anti")
    return rows.orderBy(F.desc("likelihood"), F.desc("first_seen_at"), "eval_seq").limit(10).select("job_id", "eval_seq")


@query("j17_watchlist_view", f"""WITH t AS ({_TYPED.replace('STRING', 'VARCHAR')}) SELECT t.slug, coalesce(CASE t.company_id % 3 WHEN 2 THEN b.name ELSE e.name END, t.name) AS name,
 coalesce(CASE t.company_id % 3 WHEN 2 THEN b.tags ELSE e.tags END, '') AS tags FROM t LEFT JOIN directory e ON CAST(split_part(e.slug, '-', 2) AS BIGINT) = t.company_id
 LEFT JOIN directory b ON b.ats_type = t.ats_type AND lower(b.ats_token) = lower(t.ats_token) WHERE t.status = 'approved'""")
def j17(spark, d):
    e = view(spark, d, "directory")
    on = co.match_directory(typed(spark, d).where("status = 'approved'"), e)
    named = e.select(F.col("slug").alias("entry"), F.col("name").alias("_n"), F.col("tags"))
    return on.join(named, "entry", "left").select("slug", F.coalesce("_n", "name").alias("name"), F.coalesce("tags", F.lit("")).alias("tags")).orderBy(F.lower("name"))


_FRONTEND = S.but(role_types=(*S.role_types, RolePick("frontend", 50)))
_J18 = [("picked", S.picked_keywords), ("off-target", S.negative_words), ("off-target, frontend picked", _FRONTEND.negative_words)]


@query("j18_picked_keywords", " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, {o.q(w)} AS keyword, (SELECT count(*) FROM postings WHERE {o.any_word('title', [w])}) AS postings" for kind, words in _J18 for w in words))
def j18(spark, d):
    """Picked keywords and off-target title words, with the number of posting titles each reaches. A word that the user picks
    leaves the off-target list: the third list is that of a user who also picks the frontend type."""
    p = view(spark, d, "postings", ["title"])
    words = sorted({w for _, some in _J18 for w in some})
    held = F.array_distinct(F.transform(phrases.occurrences(F.lower("title"), words), lambda x: x["word"]))
    counts = p.select(F.explode(held).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("postings"))
    lists = spark.createDataFrame([(kind, w) for kind, some in _J18 for w in some], "kind string, keyword string")
    return lists.join(counts, "keyword", "left").select("kind", "keyword", F.coalesce("postings", F.lit(0)).alias("postings"))


@query("e01_distinct_pairs", f"SELECT DISTINCT company_name, {o.canonical_url('url')} AS url FROM postings WHERE active")
def e01(spark, d):
    p = view(spark, d, "postings", ["company_name", "url", "active"]).where("active")
    return p.select("company_name", tx.canonical_url(p.url).alias("url")).distinct()


@query("e02_url_alias_union", f"SELECT page_id, url FROM pages UNION SELECT page_id, {o.canonical_url('url')} FROM pages")
def e02(spark, d):
    """Raw and canonical URL per page. Both spellings come from one row, so they are compared there: no shuffle."""
    p = raw(spark, d, "pages")
    return p.select("page_id", F.explode(F.array_distinct(F.array(p.url, tx.canonical_url(p.url)))).alias("url"))


@query("e03_hits_difference", f"""WITH h AS (SELECT job_id, {o.single(o.hits_list('title', S.picked_keywords, False))} AS th,
 {o.single(o.hits_list("substr(" + o.trim_boilerplate("coalesce(description_text, '')") + ", 1, 600)", S.picked_keywords, False))} AS dh FROM postings)
SELECT job_id, array_to_string(list_sort(list_filter(dh, lambda x: NOT list_contains(th, x))), '|') AS extra FROM h""")
def e03(spark, d):
    p = view(spark, d, "postings", ["title", "description_text"])
    p = once(p, head=scoring.description_head(S, p.description_text))
    h = once(p, th=scoring.keyword_hits(F.col("title"), S.picked_keywords), dh=scoring.keyword_hits(F.col("head"), S.picked_keywords))
    return h.select("job_id", F.array_join(F.array_sort(F.array_except("dh", "th")), "|").alias("extra"))


@query("e04_tag_union", """SELECT slug, array_to_string(list_sort(list_distinct(list_filter(string_split(tags || '|cloud', '|'), lambda x: x <> ''))), '|') AS tags FROM directory""")
def e04(spark, d):
    e = view(spark, d, "directory")
    return e.select("slug", F.array_join(F.array_sort(F.array_union(co.list_of(e.tags), F.array(F.lit("cloud")))), "|").alias("tags"))


@query("e05_source_overlap", f"""WITH k AS (SELECT {o.dedup_key('company_name', 'title', 'location')} AS k, bool_or(split_part(source, ':', 1) = 'greenhouse') AS board, bool_or(split_part(source, ':', 1) <> 'greenhouse') AS agg FROM postings GROUP BY 1)
SELECT count(*) FILTER (WHERE board) AS on_boards, count(*) FILTER (WHERE board AND NOT agg) AS boards_only, count(*) FILTER (WHERE board AND agg) AS both_kinds FROM k""")
def e05(spark, d):
    """Set intersection and difference of dedup keys per source class, as one aggregate per key."""
    p = keyed(view(spark, d, "postings", ["company_name", "title", "location", "source"]))
    board = p.source.startswith("greenhouse:")
    k = p.groupBy("dedup_key").agg(F.bool_or(board).alias("board"), F.bool_or(~board).alias("agg"))
    return k.agg(F.count_if("board").alias("on_boards"), F.count_if(F.col("board") & ~F.col("agg")).alias("boards_only"),
                 F.count_if(F.col("board") & F.col("agg")).alias("both_kinds"))


@query("e06_known_minus_new", "SELECT slug FROM directory EXCEPT SELECT slug FROM company_dim")
def e06(spark, d):
    return view(spark, d, "directory").select("slug").join(view(spark, d, "company_dim").select("slug"), "slug", "left_anti").distinct()
