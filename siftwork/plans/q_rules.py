"""F and P: filters, rejection rules and projections over postings."""
from pyspark.sql import functions as F

from siftwork.config import DEFAULT as S
from siftwork.functions import dates, degree, fixed_values as fv, roles, rules, terms, text as tx
from siftwork.operators import reports
from siftwork.operators.queues import ambiguous_queue, needs_description, pending_evaluation, pending_fast
from siftwork.operators.ranking import first_per_key, top_rank
from siftwork.plans import oracle as o
from siftwork.plans.registry import query
from siftwork.sources.views import raw, view

RULE_COLUMNS = ["title", "location", "terms_txt", "sponsorship", "description_text"]


def reason(p, text=None):
    return rules.first_reason(S, title=p.title, location=p.location, terms=terms.split_terms(p.terms_txt),
                              text=p.description_text if text is None else text, sponsorship=p.sponsorship)


@query("f01_filter_internship_titles", f"SELECT job_id, title FROM postings WHERE {o.rm('title', '(?i)' + chr(92) + 'b(?:' + '|'.join(fv.INTERNSHIP_WORDS) + ')' + chr(92) + 'b')}")
def f01(spark, d):
    p = view(spark, d, "postings", ["title"])
    return p.where(tx.looks_like_internship(p.title))


@query("f02_rule_cascade", f"WITH {o.cascade_cte('postings')} SELECT job_id, reason FROM judged")
def f02(spark, d):
    p = view(spark, d, "postings", RULE_COLUMNS)
    return p.select("job_id", reason(p).alias("reason"))


def _flag(name, columns, sql, build):
    @query(name, f"SELECT job_id, {sql} AS hit FROM postings")
    def run(spark, d):
        p = view(spark, d, "postings", columns)
        return p.select("job_id", F.coalesce(build(p), F.lit(False)).alias("hit"))
    return run


_flag("f03_rule_term_mismatch", ["title", "terms_txt"], o.mismatch("title", "terms_txt"),
      lambda p: terms.term_mismatch(S, p.title, terms.split_terms(p.terms_txt)))
_flag("f04_rule_sponsorship", ["sponsorship"], f"coalesce({o.has_any('sponsorship', S.sponsorship_values)}, false)",
      lambda p: rules.sponsorship_blocked(S, p.sponsorship))
_flag("f05_rule_title_excluded", ["title"], o.title_excluded("title"), lambda p: rules.title_excluded(S, p.title))
_flag("f06_rule_keyword_density", ["title", "description_text"], o.firmware("title", "description_text"),
      lambda p: rules.firmware_heavy(p.title, p.description_text))
_flag("f07_rule_location_allowed", ["location"], f"NOT {o.place_blocked('location')}", lambda p: ~rules.place_not_allowed(S, p.location))
_flag("f08_rule_location_excluded", ["title", "location"],
      f"({o.has_any('location', S.location_exclude)} OR {o.has_any('title', S.location_exclude)})", lambda p: rules.place_excluded(S, p.title, p.location))
_HAY = o.haystack("title", "location", "description_text")
_flag("f09_rule_unpaid_in_context", ["title", "location", "description_text"], o.unpaid(_HAY),
      lambda p: rules.unpaid(S, rules.haystack(p.title, p.location, p.description_text)))


@query("f10_rule_dealbreakers", f"""SELECT job_id, CASE WHEN {o.has_any(_HAY, S.clearance)} THEN 'clearance'
  WHEN {o.has_any(_HAY, S.citizenship)} THEN 'citizenship' END AS reason FROM postings""")
def f10(spark, d):
    p = view(spark, d, "postings", ["title", "location", "description_text"])
    body = rules.haystack(p.title, p.location, p.description_text)
    out = F.lit(None).cast("string")
    for code, needles in (("other", S.other), ("level", S.level), ("citizenship", S.citizenship), ("clearance", S.clearance)):
        if needles:
            out = F.when(tx.contains_any(body, needles), F.lit(code)).otherwise(out)
    return p.select("job_id", out.alias("reason"))


@query("f11_rule_degree_ceiling", f"""WITH {o.cascade_cte('postings')}
SELECT job_id, CASE low WHEN 3 THEN 'master-only' WHEN 4 THEN 'phd-only' END AS reason FROM low""")
def f11(spark, d):
    p = view(spark, d, "postings", ["title", "description_text"])
    return p.select("job_id", degree.degree_mismatch(S.degree_ceiling, p.title, p.description_text).alias("reason"))


_READ = "((description_text IS NOT NULL AND description_text <> '') OR (description_text IS NULL AND fetch_failures >= 2))"


@query("f12_pending_fast_queue", f"""SELECT job_id, first_seen_at FROM postings p WHERE active AND {_READ}
  AND NOT EXISTS (SELECT 1 FROM evals e WHERE e.job_id = p.job_id AND e.profile_hash = 'new')
UNION ALL SELECT job_id, first_seen_at FROM postings p WHERE active AND {_READ}
  AND NOT EXISTS (SELECT 1 FROM evals e WHERE e.job_id = p.job_id AND e.profile_hash = 'old')""")
def f12(spark, d):
    """Queue under a fresh profile (everything readable) and under the old profile (anti join bites)."""
    p = view(spark, d, "postings", ["first_seen_at", "active", "description_text", "fetch_failures"])
    e = view(spark, d, "evals")
    cols = ["job_id", "first_seen_at"]
    return pending_fast(p, e, "new").select(cols).unionByName(pending_fast(p, e, "old").select(cols)).orderBy(F.desc("first_seen_at"), "job_id")


@query("f13_pending_eval_queue", f"""SELECT job_id, first_seen_at FROM postings p WHERE active AND {_READ}
  AND (job_id % 10 = 0 OR (NOT EXISTS (SELECT 1 FROM evals e WHERE e.job_id = p.job_id AND e.profile_hash = 'old' AND e.rubric_version <> '2'
    AND (e.bucket = 'archive' OR e.hard_reject_reason IS NOT NULL))
  AND NOT EXISTS (SELECT 1 FROM evals e WHERE e.job_id = p.job_id AND e.profile_hash = 'old' AND e.rubric_version = '2')))""")
def f13(spark, d):
    p = view(spark, d, "postings", ["first_seen_at", "active", "description_text", "fetch_failures"]).withColumn(
        "needs_reeval", F.col("job_id") % 10 == 0)
    return pending_evaluation(p, view(spark, d, "evals"), "old", S.rubric).select("job_id", "first_seen_at").orderBy(F.desc("first_seen_at"), "job_id")


@query("f14_description_queue", """SELECT job_id, company_id IS NULL AS unknown_company, first_seen_at FROM postings
WHERE active AND description_text IS NULL AND fetch_failures < 2""")
def f14(spark, d):
    p = view(spark, d, "postings", ["company_id", "first_seen_at", "active", "description_text", "fetch_failures"])
    return needs_description(p).select("job_id", F.col("company_id").isNull().alias("unknown_company"), "first_seen_at").orderBy(
        "unknown_company", F.desc("first_seen_at"), "job_id")


@query("f15_rule_before_fetch", f"""WITH src AS (SELECT job_id, title, location, terms_txt, sponsorship, CAST(NULL AS VARCHAR) AS description_text
  FROM postings WHERE active AND description_text IS NULL AND fetch_failures < 2), {o.cascade_cte('src')}
SELECT job_id, reason, CASE WHEN reason IS NOT NULL THEN '' END AS description_text FROM judged""")
def f15(spark, d):
    """Metadata-only cascade before paying for text: rejected rows get the empty-text marker, the rest stay NULL."""
    p = needs_description(view(spark, d, "postings", [*RULE_COLUMNS, "active", "fetch_failures"]))
    r = p.select("job_id", reason(p, F.lit(None).cast("string")).alias("reason"))
    return r.withColumn("description_text", F.when(F.col("reason").isNotNull(), F.lit("")))


@query("f16_ambiguous_queue", """SELECT e.job_id, e.eval_seq, e.likelihood FROM evals e JOIN postings p ON p.job_id = e.job_id
WHERE e.profile_hash = 'cur' AND e.model = 'local' AND p.active AND json_extract_string(e.raw, '$.fast.band') = 'ambiguous'""")
def f16(spark, d):
    p = view(spark, d, "postings", ["first_seen_at", "active"])
    return ambiguous_queue(view(spark, d, "evals"), p, S.profile).select("job_id", "eval_seq", "likelihood").orderBy(F.desc("likelihood"), "job_id", "eval_seq")


@query("f18_track_filter", f"""SELECT job_id, want FROM (SELECT job_id, {o.track('title', 'terms_txt')} AS track FROM postings),
  (VALUES ('all'), ('primary'), ('alt')) AS w(want) WHERE want = 'all' OR track = want OR track = 'unknown'""")
def f18(spark, d):
    p = view(spark, d, "postings", ["title", "terms_txt"])
    t = p.select("job_id", terms.term_track(S, p.title, terms.split_terms(p.terms_txt)).alias("track"))
    wants = F.filter(F.array(*[F.when(terms.in_track(F.col("track"), w), F.lit(w)) for w in ("all", "primary", "alt")]), lambda x: x.isNotNull())
    return t.select("job_id", F.explode(wants).alias("want"))


@query("f19_pollable_boards", """SELECT slug, 'directory' AS kind FROM directory WHERE ats_type <> '' AND ats_token <> '' AND status IN ('ok', 'empty', 'unverified')
UNION ALL SELECT slug, 'watchlist' FROM company_dim WHERE status = 'approved' AND ats_token IS NOT NULL AND ats_type IN ('greenhouse', 'lever', 'ashby', 'workday')""")
def f19(spark, d):
    e, c = view(spark, d, "directory"), view(spark, d, "company_dim")
    a = e.where((e.ats_type != "") & (e.ats_token != "") & e.status.isin(fv.POLLABLE_STATUSES)).select("slug", F.lit("directory").alias("kind"))
    b = c.where((c.status == "approved") & c.ats_token.isNotNull() & c.ats_type.isin(fv.POLLABLE_BOARDS)).select("slug", F.lit("watchlist").alias("kind"))
    return a.unionByName(b)


# search hits: one per order; stars from the price, name from the customer, pushed at the order date
_HITS = """SELECT o_orderkey AS hit, 'owner/list-' || CAST(o_custkey % 200 AS STRING) AS repo, CAST(floor(o_totalprice / 5000) AS BIGINT) AS stars, o_orderdate AS pushed_at,
 CASE o_orderkey % 4 WHEN 0 THEN 'Internships board' WHEN 1 THEN 'new-grad jobs' WHEN 2 THEN 'dotfiles' END AS description FROM {orders}"""


def feed_hits(spark, d):
    from siftwork.sources.views import bind_spark
    return spark.sql(bind_spark(spark, _HITS, d))


HITS_SQL = _HITS.replace("{orders}", "orders")


@query("f20_feed_candidates", f"""WITH h AS ({HITS_SQL})
SELECT repo, max_by(stars, hit) AS stars, max_by(substr(coalesce(description, ''), 1, 200), hit) AS description FROM h
WHERE stars >= 40 AND pushed_at >= (SELECT max(pushed_at) FROM h) - INTERVAL 45 DAY AND {o.rm("lower(repo || ' ' || coalesce(description, ''))", fv.FEED_VOCABULARY)} GROUP BY repo""")
def f20(spark, d):
    h = feed_hits(spark, d)
    now = h.agg(F.max("pushed_at").alias("now"))
    text = F.lower(F.concat_ws(" ", h.repo, F.coalesce(h.description, F.lit(""))))
    ok = h.where((h.stars >= fv.FEED_MIN_STARS) & text.rlike(fv.FEED_VOCABULARY)).crossJoin(F.broadcast(now)).where(
        F.col("pushed_at") >= F.col("now") - F.expr(f"INTERVAL {fv.FEED_MAX_IDLE_DAYS} DAYS"))
    row = F.struct("stars", F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("description"))
    return ok.groupBy("repo").agg(F.max_by(row, F.col("hit")).alias("r")).select("repo", "r.*")


@query("f21_junk_names", """SELECT slug, name FROM directory WHERE CAST(split_part(slug, '-', 2) AS BIGINT) % 4 <> 3""")
def f21(spark, d):
    """Every 4th name is turned into junk ("1000"), the rest get stray slashes that must be trimmed."""
    e = view(spark, d, "directory")
    n = F.substring_index("slug", "-", -1).cast("bigint")
    typed = e.select("slug", F.when(n % 4 == 3, n.cast("string")).otherwise(F.concat(F.lit("/"), e.name, F.lit(" \\/"))).alias("name"))
    return typed.where(F.col("name").rlike("[A-Za-z]{2}")).select("slug", F.btrim("name", F.lit(" \\/")).alias("name"))


@query("f22_unread_postings", """SELECT p.job_id FROM postings p WHERE p.active AND p.description_text IS NULL""")
def f22(spark, d):
    return view(spark, d, "postings", ["active", "description_text"]).where("active AND description_text IS NULL").select("job_id")


@query("p01_term_track", f"SELECT job_id, {o.track('title', 'terms_txt')} AS track FROM postings")
def p01(spark, d):
    p = view(spark, d, "postings", ["title", "terms_txt"])
    return p.select("job_id", terms.term_track(S, p.title, terms.split_terms(p.terms_txt)).alias("track"))


@query("p02_term_badge", f"""WITH t AS (SELECT job_id, terms_txt, {o.track('title', 'terms_txt')} AS track, {o.claimed('title', 'terms_txt')} AS c FROM postings)
SELECT job_id, track, CASE WHEN track = 'primary' THEN 'Summer 2027 / Spring 2027' WHEN track = 'alt' THEN 'Winter 2027' WHEN c IS NOT NULL THEN 'either term' ELSE 'term unstated' END AS term_label,
  CASE WHEN c IS NOT NULL AND terms_txt <> '' THEN 'posting says: ' || replace(terms_txt, '|', ', ') WHEN c IS NOT NULL THEN 'term read from the title'
  ELSE 'the posting does not state a work term' END AS term_hint FROM t""")
def p02(spark, d):
    p = view(spark, d, "postings", ["title", "terms_txt"])
    return p.select("job_id", terms.term_badge(S, p.title, terms.split_terms(p.terms_txt)).alias("b")).select("job_id", "b.*")


@query("p04_role_weight", f"""WITH r AS (SELECT job_id, {o.classify('title', 'company_name')} AS role FROM postings)
SELECT job_id, role, CASE role {' '.join(f"WHEN '{p.key}' THEN {p.weight}" for p in S.role_types)}
 {' '.join(f"WHEN '{k}' THEN 12" for k in S.excluded_role_types)} ELSE 36 END AS weight FROM r""")
def p04(spark, d):
    p = view(spark, d, "postings", ["title", "company_name"])
    r = p.select("job_id", roles.classify(S, p.title, p.company_name).alias("role"))
    return r.withColumn("weight", roles.role_weight(S, F.col("role")))


_SPLIT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in fv.SPLIT_FROM.items()) + ") AS s(key, parent)"


# old weights per user: one user per part brand, weight of a role key = mean part size for that key
_WEIGHTS = """SELECT p_brand AS owner, CASE p_partkey % 6 WHEN 0 THEN 'gpu' WHEN 1 THEN 'systems' WHEN 2 THEN 'ml' WHEN 3 THEN 'hardware' WHEN 4 THEN 'cv' ELSE 'general' END AS key,
 max(p_size) + 10 AS weight FROM {part} GROUP BY 1, 2"""


@query("p05_config_migration", f"""WITH w AS ({_WEIGHTS.replace('{part}', 'part')}), split AS ({_SPLIT_SQL}),
full_w AS (SELECT owner, key, weight FROM w UNION ALL SELECT w.owner, s.key, w.weight FROM w JOIN split s ON s.parent = w.key
  WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.owner = w.owner AND x.key = s.key)),
n AS (SELECT owner, max(CASE WHEN key = 'general' THEN weight END) AS neutral FROM full_w GROUP BY owner)
SELECT f.owner, f.key, f.weight, f.weight <= coalesce(n.neutral, 36) AS excluded FROM full_w f JOIN n USING (owner) WHERE f.key <> 'general'""")
def p05(spark, d):
    """Old role weights carried onto split-out types: own weight, else the parent's; at or below neutral = excluded."""
    from siftwork.sources.views import bind_spark
    w = spark.sql(bind_spark(spark, _WEIGHTS, d))
    kids = F.create_map(*[F.lit(x) for p in sorted(set(fv.SPLIT_FROM.values())) for x in (
        p, "|".join(k for k, v in fv.SPLIT_FROM.items() if v == p))])
    inherited = w.select("owner", F.explode(F.split(F.try_element_at(kids, F.col("key")), "\\|")).alias("key"), "weight")
    both = w.withColumn("own", F.lit(1)).unionByName(inherited.withColumn("own", F.lit(0)))
    best = both.groupBy("owner", "key").agg(F.max_by("weight", "own").alias("weight"))
    neutral = best.where("key = 'general'").select("owner", F.col("weight").alias("neutral"))
    return best.where("key <> 'general'").join(neutral, "owner", "left").select(
        "owner", "key", "weight", (F.col("weight") <= F.coalesce("neutral", F.lit(S.neutral_weight))).alias("excluded"))
