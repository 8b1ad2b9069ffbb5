"""T: URL, name, HTML, text and date transforms applied to whole tables."""
from pyspark.sql import functions as F

from siftwork.config import DEFAULT as S
from siftwork.functions import caps, dates, degree, fixed_values as fv, roles, text as tx
from siftwork.functions.plan import once
from siftwork.operators.companies import board_rows
from siftwork.operators.packing import batch_prompts, posting_block, triage_block
from siftwork.operators.queues import ambiguous_queue
from siftwork.plans import oracle as o
from siftwork.plans.registry import query
from siftwork.sources.views import raw, view



@query("t01_canonical_urls", f"SELECT page_id, {o.canonical_url('url')} AS canonical_url FROM pages")
def t01(spark, d):
    return raw(spark, d, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical_url"))


@query("t02_slugs", f"SELECT job_id, {o.slug('company_name')} AS slug FROM postings")
def t02(spark, d):
    return view(spark, d, "postings", ["company_name"]).select("job_id", tx.company_key(F.col("company_name")).alias("slug"))


@query("t03_dedup_keys", f"""SELECT job_id, {o.title('title')} AS norm_title, {o.place('location')} AS norm_place,
  {o.dedup_key('company_name', 'title', 'location')} AS dedup_key FROM postings""")
def t03(spark, d):
    p = view(spark, d, "postings", ["company_name", "title", "location"])
    return p.select("job_id", tx.normalize_title(p.title).alias("norm_title"), tx.normalize_place(p.location).alias("norm_place"),
                    tx.dedup_key(p.company_name, p.title, p.location).alias("dedup_key"))


def _unescape_sql(x):
    for k, v in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "\xa9"),
                 ("&middot;", "\xb7"), ("&amp;", "&")):
        x = f"replace({x}, {o.q(k)}, {o.q(v)})"
    return x


_SPACES = r"[\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"


@query("t04_html_to_text", f"""
WITH a AS (SELECT page_id, {_unescape_sql('html')} AS s FROM pages),
b AS (SELECT page_id, {o.sub('s', f"(?i)</?(?:{'|'.join(fv.BLOCK_TAGS)})[^>]*>", chr(10))} AS s FROM a),
c AS (SELECT page_id, {_unescape_sql(o.sub('s', '<[^>]+>'))} AS s FROM b),
e AS (SELECT page_id, {o.sub('s', _SPACES)} AS s FROM c)
SELECT page_id, {o.strip(o.sub(o.sub('s', ' *\\n *', chr(10)), '\\n{3,}', chr(10) * 2))} AS text FROM e""")
def t04(spark, d):
    return raw(spark, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("t05_content_hash", f"""SELECT content_hash, count(*) AS copies, min(doc_id) AS first_doc
FROM (SELECT doc_id, sha1({o.squeeze('text')}) AS content_hash FROM documents WHERE text <> '') GROUP BY 1 HAVING count(*) > 1""")
def t05(spark, d):
    """Groups of exact copies; the text is reduced to a hash before the shuffle and counts combine map-side."""
    h = raw(spark, d, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("content_hash")).where("content_hash IS NOT NULL")
    return h.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("t06_trim_boilerplate", f"""WITH t AS (SELECT job_id, {o.trim_boilerplate('description_text')} AS t FROM postings WHERE description_text IS NOT NULL)
SELECT job_id, CASE WHEN length(t) > 2500 THEN substr(t, 1, 2500) || chr(10) || '[... truncated]' ELSE t END AS scorer_text FROM t""")
def t06(spark, d):
    p = view(spark, d, "postings", ["description_text"]).where("description_text IS NOT NULL")
    p = p.withColumn("t", tx.trim_boilerplate(p.description_text))
    return p.select("job_id", F.when(F.length("t") > fv.SCORER_TEXT_CHARS, F.concat(
        F.substring("t", 1, fv.SCORER_TEXT_CHARS), F.lit("\n[... truncated]"))).otherwise(F.col("t")).alias("scorer_text"))


@query("t07_classify_role", f"SELECT job_id, {o.classify('title', 'company_name')} AS role FROM postings")
def t07(spark, d):
    p = view(spark, d, "postings", ["title", "company_name"])
    return p.select("job_id", roles.classify(S, p.title, p.company_name).alias("role"))


_CAP_SQL = """SELECT job_id, CASE doc13 WHEN 3 THEN 3 ELSE 5 END AS cap, CASE doc13
  WHEN 3 THEN 'Candidates are limited to three (3) applications within a 30-day period.'
  ELSE 'Each applicant may submit up to 5 applications per year.' END AS cap_text, company_name
FROM (SELECT *, job_id % 13 AS doc13 FROM postings) WHERE doc13 IN (3, 10) AND description_text <> ''"""


@query("t08_application_caps", f"SELECT job_id, cap, cap_text FROM ({_CAP_SQL})")
def t08(spark, d):
    p = view(spark, d, "postings", ["description_text"])
    return once(p, c=caps.application_cap(p.description_text)).where("c IS NOT NULL").select("job_id", "c.cap", "c.cap_text")


@query("t09_degree_levels", f"SELECT job_id, {o.level_names('title')} AS levels FROM postings")
def t09(spark, d):
    p = view(spark, d, "postings", ["title"])
    return p.select("job_id", degree.level_mask(degree.undot(p.title)).alias("m")).select(
        "job_id", F.array_join(degree.mask_names(F.col("m")), "|").alias("levels"))


@query("t10_requirement_clauses", f"""WITH {o.clauses_cte("(SELECT job_id, description_text FROM postings WHERE description_text IS NOT NULL)", 'job_id', 'description_text')}
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY n) AS ord, clause FROM req""")
def t10(spark, d):
    p = view(spark, d, "postings", ["description_text"]).where("description_text IS NOT NULL")
    return p.select("job_id", F.posexplode(degree.requirement_clauses(p.description_text)).alias("ord", "clause")).withColumn(
        "ord", (F.col("ord") + 1).cast("bigint"))


@query("t11_board_from_url", """
SELECT job_id, CASE job_id % 6 WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' WHEN 3 THEN 'ashby' ELSE 'workday' END AS ats_type,
  'sup' || CAST(supplier_key AS VARCHAR) || CASE job_id % 6 WHEN 4 THEN '/wd5/External' ELSE '' END AS ats_token
FROM postings WHERE job_id % 6 IN (1, 2, 3, 4)""")
def t11(spark, d):
    p = view(spark, d, "postings", ["url"])
    return board_rows(p, "url").select("job_id", "b.ats_type", "b.ats_token")


@query("t12_deadlines", """
SELECT job_id, CASE job_id % 13 WHEN 1 THEN DATE '2024-10-15' ELSE DATE '2024-02-09' END AS deadline
FROM postings WHERE job_id % 13 IN (1, 2) AND description_text <> ''""")
def t12(spark, d):
    p = view(spark, d, "postings", ["description_text"])
    return once(p, deadline=dates.deadline(p.description_text, dates.at(S.as_of))).where("deadline IS NOT NULL").select("job_id", "deadline")


@query("t13_rolling_flag", "SELECT job_id, coalesce(job_id % 13 = 12 AND description_text <> '', false) AS rolling FROM postings")
def t13(spark, d):
    p = view(spark, d, "postings", ["description_text"])
    return p.select("job_id", dates.is_rolling(p.description_text).alias("rolling"))


@query("t14_relative_labels", f"""
WITH v AS (SELECT event_id, ts, CAST(floor((epoch_us({o.AS_OF}) - epoch_us(ts)) / 86400000000.0) AS INT) AS days FROM visits)
SELECT event_id, CASE WHEN days <= 0 THEN 'earlier today, ' || strftime(ts, '%H:%M') WHEN days = 1 THEN 'yesterday, ' || strftime(ts, '%H:%M')
  WHEN days < 7 THEN strftime(ts, '%A, %H:%M') ELSE strftime(ts, '%-d %b') END AS label FROM v""")
def t14(spark, d):
    v = view(spark, d, "visits")
    return v.select("event_id", dates.since_label(v.ts, dates.at(S.as_of)).alias("label"))


# mixed spellings derived from the stored timestamps: date only, naive, aware (+02:00), damaged
@query("t15_normalise_timestamps", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 1 THEN date_trunc('second', ts)
  WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS utc_ts FROM visits""")
def t15(spark, d):
    v = view(spark, d, "visits")
    day, sec = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(v.event_id % 4 == 0, day).when(v.event_id % 4 == 1, sec).when(
        v.event_id % 4 == 2, F.concat(sec, F.lit("+02:00"))).otherwise(F.concat(F.lit("on "), day))
    return v.select("event_id", dates.utc_timestamp(text).cast("timestamp_ntz").alias("utc_ts"))


@query("t16_slug_candidates", """
WITH c AS (SELECT slug, unnest(['supplier' || split_part(slug, '-', 2), slug, 'supplier']) AS candidate,
  unnest([1, 2, 3]) AS pos FROM directory)
SELECT slug, candidate, pos FROM c""")
def t16(spark, d):
    e = view(spark, d, "directory")
    host = F.regexp_replace(F.substring_index(F.lower("domain"), "/", 1), r"^www\.", "")
    s = tx.slug(F.col("name"))
    cands = F.array_distinct(F.filter(F.array(
        F.substring_index(host, ".", 1), s, F.replace(s, F.lit("-"), F.lit("")), F.substring_index(s, "-", 1)),
        lambda c: F.coalesce(c, F.lit("")) != ""))
    return e.select("slug", F.posexplode(cands).alias("pos", "candidate")).withColumn("pos", F.col("pos") + 1)


@query("t17_json_fields", """
SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 13 <> 0 THEN 'ok' ELSE 'bad' END AS state FROM events""")
def t17(spark, d):
    """Nested fields by path; every 13th payload is cut short and must read as the default, not fail."""
    e = raw(spark, d, "events").withColumn("p", F.expr("CASE WHEN event_id % 13 = 0 THEN substring(props, 1, 3) ELSE props END"))
    k = F.get_json_object("p", "$.k").try_cast("bigint")
    return e.select("event_id", k.alias("k"), F.when(F.try_parse_json("p").isNull(), F.lit("bad")).otherwise(F.lit("ok")).alias("state"))


@query("t18_profile_fingerprint", """
SELECT c_custkey AS profile_id, substr(sha1('{"acceptable_term_labels": ["Summer 2027"], "locations_are_hard_constraint": '
  || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "preferred_locations": ["nation ' || CAST(c_nationkey AS VARCHAR)
  || '"], "target_roles": ["' || c_mktsegment || '"], "work_term": "Summer 2027"}' || 'prose of ' || c_name), 1, 12) AS fingerprint FROM customer""")
def t18(spark, d):
    """12-hex fingerprint of each profile: key-sorted constraint JSON followed by the prose."""
    c = raw(spark, d, "customer")
    js = F.to_json(F.struct(
        F.array(F.lit("Summer 2027")).alias("acceptable_term_labels"), (c.c_custkey % 2 == 0).alias("locations_are_hard_constraint"),
        F.array(F.concat(F.lit("nation "), c.c_nationkey.cast("string"))).alias("preferred_locations"),
        F.array(c.c_mktsegment).alias("target_roles"), F.lit("Summer 2027").alias("work_term")))
    spaced = F.regexp_replace(F.regexp_replace(js, '":', '": '), '([\\]"el]),"', '$1, "')     # the separators of the stored form
    return c.select(c.c_custkey.alias("profile_id"), F.substring(F.sha1(F.concat(spaced, F.lit("prose of "), c.c_name)), 1, 12).alias("fingerprint"))


_BLOCK = f"""CASE WHEN description_text IS NULL THEN '{{UNREAD}}' ELSE {o.trim_boilerplate('description_text')} END"""


@query("t19_prompt_text", f"""
WITH t AS (SELECT *, {o.trim_boilerplate('description_text')} AS t FROM postings)
SELECT job_id, 'job_id: ' || job_id || chr(10) || 'company: ' || company_name || chr(10) || 'title: ' || title || chr(10)
  || 'location: ' || coalesce(nullif(location, ''), 'unspecified')
  || CASE WHEN terms_txt <> '' THEN chr(10) || 'terms: ' || replace(terms_txt, '|', ', ') ELSE '' END
  || coalesce(chr(10) || 'sponsorship: ' || sponsorship, '') || chr(10) || 'url: ' || {o.canonical_url('url')}
  || chr(10) || '--- description ---' || chr(10)
  || CASE WHEN description_text IS NULL THEN '[DESCRIPTION UNAVAILABLE: judge from company, title and location; keep confidence at 40 or below.]'
     WHEN length(t) > 2500 THEN substr(t, 1, 2500) || chr(10) || '[... truncated]' ELSE t END AS block FROM t""")
def t19(spark, d):
    p = view(spark, d, "postings", ["company_name", "title", "location", "terms_txt", "sponsorship", "url", "description_text"])
    return p.select("job_id", posting_block(p).alias("block"))


TRIAGE_SQL = f"""a AS (SELECT e.job_id, e.eval_seq, p.*, row_number() OVER (ORDER BY e.likelihood DESC, p.first_seen_at DESC NULLS LAST, e.eval_seq) AS n
  FROM evals e JOIN postings p ON p.job_id = e.job_id WHERE e.profile_hash = 'cur' AND e.model = 'local' AND p.active
   AND json_extract_string(e.raw, '$.fast.band') = 'ambiguous'),
t AS (SELECT *, CAST((n - 1) // 40 AS BIGINT) AS batch, replace(substr({o.trim_boilerplate("coalesce(description_text, '')")}, 1, 500), chr(10) || chr(10), chr(10)) AS head FROM a),
blocks AS (SELECT *, 'job_id: ' || job_id || ' | ' || company_name || ' | ' || title || ' | ' || coalesce(nullif(location, ''), 'unspecified') || chr(10)
  || CASE WHEN head = '' THEN '[no description available]' ELSE head END AS block FROM t)"""


@query("t19b_batch_prompts", f"""WITH {TRIAGE_SQL}
SELECT batch, count(*) AS jobs, 'Triage these ' || count(*) || ' postings. Return one entry per job_id: ' || string_agg(CAST(job_id AS VARCHAR), ', ' ORDER BY n)
  || '.' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS prompt FROM blocks GROUP BY batch""")
def t19b(spark, d):
    p = view(spark, d, "postings", ["company_name", "title", "location", "first_seen_at", "active", "description_text"])
    queue = ambiguous_queue(view(spark, d, "evals"), p, S.profile)
    return batch_prompts(queue, triage_block(S, queue), S.triage_batch).drop("job_ids")


@query("t20_compact_numbers", """
SELECT run_id, CASE WHEN tokens >= 1000000 THEN printf('%.1f', round_even(tokens / 1000000.0, 1)) || 'M' WHEN tokens >= 10000 THEN CAST(CAST(round_even(tokens / 1000.0, 0) AS BIGINT) AS VARCHAR) || 'K'
  WHEN tokens >= 1000 THEN printf('%.1f', round_even(tokens / 1000.0, 1)) || 'K' ELSE CAST(tokens AS VARCHAR) END AS label FROM runs""")
def t20(spark, d):
    r = view(spark, d, "runs")
    return r.select("run_id", tx.compact_number(r.tokens).alias("label"))


@query("t21_feed_name_normalise", """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 'owner' || s_suppkey || '/feed-' || s_suppkey END AS repo, s_suppkey % 4 <> 3 AS valid FROM supplier""")
def t21(spark, d):
    s = raw(spark, d, "supplier")
    k = s.s_suppkey.cast("string")
    name = F.concat(F.lit("owner"), k, F.lit("/feed-"), k)
    typed = (F.when(s.s_suppkey % 4 == 0, F.concat(F.lit(" https://github.com/"), name, F.lit(".git ")))
             .when(s.s_suppkey % 4 == 1, F.concat(F.lit("github.com/"), name, F.lit("/"))).when(s.s_suppkey % 4 == 2, name)
             .otherwise(F.concat(F.lit("just "), k)))
    clean = F.regexp_replace(F.regexp_replace(F.btrim(F.trim(typed), F.lit("/")), r"^(?:https?://)?(?:www\.)?github\.com/", ""), r"(?:\.git)?/*$", "")
    ok = clean.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")
    return s.select("s_suppkey", F.when(ok, clean).alias("repo"), ok.alias("valid"))
