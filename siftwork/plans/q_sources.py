"""S: landed feeds in, snapshots and reports out. Payloads are synthesised from postings and parsed back."""
from pyspark.sql import functions as F

from siftwork.config import DEFAULT as S
from siftwork.functions import dates, fixed_values as fv, text as tx
from siftwork.operators import companies as co, merge, ranking, reports, windows
from siftwork.plans import oracle as o
from siftwork.plans.q_merge import _PROPOSED  # noqa: F401
from siftwork.plans.q_text import _SPACES, _unescape_sql
from siftwork.plans.q_versions import ROWS_SQL, SECTION_CAPS, SECTION_SQL, decorated
from siftwork.plans.registry import query
from siftwork.session import scratch_dir
from siftwork.sources import feeds, sinks
from siftwork.streaming import jobs
from siftwork.sources.views import raw, view

_NULL = F.lit


def _token(p):
    return F.concat(F.lit("sup"), p.supplier_key.cast("string"))


def _ms(day, unit):
    return F.unix_seconds(day.cast("timestamp")) * unit


def listing_payloads(spark, d):
    p = view(spark, d, "postings", ["company_name", "title", "location", "url", "posted_at", "active", "terms_txt", "sponsorship", "source"])
    terms = F.when(p.terms_txt != "", F.split(p.terms_txt, "\\|"))
    item = F.struct(
        p.job_id.cast("string").alias("id"), F.when(p.job_id % 10 == 3, F.lit(" ")).otherwise(p.company_name).alias("company_name"), F.concat(F.lit(" "), p.title).alias("title"),
        F.split(p.location, "; ").alias("locations"), p.url.alias("url"), F.when(p.job_id % 4 != 1, _ms(p.posted_at, 1)).alias("date_posted"), _ms(p.posted_at, 1).alias("date_updated"),
        p.active.alias("active"), (p.job_id % 8 != 5).alias("is_visible"), terms.alias("terms"), F.when(p.job_id % 2 == 0, F.lit("Fall / Winter")).alias("season"), p.sponsorship.alias("sponsorship"))
    return p.select(F.concat(F.lit("owner/list-"), F.when(p.job_id % 3 == 0, F.lit("2027")).otherwise(F.lit("x"))).alias("feed"), F.lit(None).cast("string").alias("company"),
                    F.to_json(F.array(item)).alias("payload"))


@query("s01_read_listing_feed", """SELECT CAST(job_id AS VARCHAR) AS external_id, CASE WHEN job_id % 10 = 3 THEN 'Unknown' ELSE company_name END AS company_name, title, location, url, posted_at, active,
 CASE WHEN terms_txt <> '' THEN terms_txt WHEN job_id % 2 = 0 AND job_id % 3 = 0 THEN 'Fall 2027|Winter 2027' ELSE '' END AS terms_txt, sponsorship,
 'simplify:owner/list-' || CASE WHEN job_id % 3 = 0 THEN '2027' ELSE 'x' END AS source FROM postings WHERE job_id % 8 <> 5""")
def s01(spark, d):
    return feeds.read_listing_feed(listing_payloads(spark, d)).drop("description_text")


def markdown_lines(spark, d):
    """One README per source: heading, header, separator, one row per posting; every 9th company cell is a continuation mark."""
    p = view(spark, d, "postings", ["company_name", "title", "location", "url", "source"])
    feed = F.substring_index("source", ":", -1)
    k = p.job_id
    title = F.when(k % 10 == 1, F.concat(p.title, F.lit(" ("), p.company_name, F.lit(")"))).when(k % 10 == 2, F.lit("SWE")).otherwise(p.title)
    link = F.when(k % 4 == 0, F.concat(F.lit("[![Apply](https://img.shields.io/x.png)]("), p.url, F.lit(")"))).when(
        k % 4 == 1, F.concat(F.lit('<a href="'), p.url, F.lit('"><img src="y.png"></a>'))).when(k % 4 == 2, F.concat(F.lit("[Toronto]("), p.url, F.lit(") [home](https://root.example.org/)"))).otherwise(
        F.concat(F.lit("[Apply]("), p.url, F.lit(")")))
    cell = F.when(k % 9 == 0, F.lit("↳")).otherwise(F.concat(F.lit("**"), p.company_name, F.lit("** 🔥")))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", cell, title, p.location, link), F.lit(" |"))
    rows = p.select(feed.alias("feed"), (k + 10).alias("line_no"), row.alias("line"))
    feeds_ = p.select(feed.alias("feed")).distinct()
    top = feeds_.select("feed", F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("line_no"), F.lit(t).alias("line")) for i, t in enumerate(
        ["## Openings", "", "Some text", "| Company | Role | Location | Link |", "| --- | :--- | --- | --- |"])])).alias("x")).select("feed", "x.*")
    return top.unionByName(rows)


_MD_SQL = f"""md AS (SELECT *, split_part(source, ':', 2) AS feed, CASE WHEN job_id % 9 <> 0 THEN company_name END AS own FROM postings),
mf AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY feed ORDER BY job_id) AS company FROM md),
mr AS (SELECT job_id, company AS company_name, CASE WHEN job_id % 10 = 2 THEN 'Software Engineer Intern'
 WHEN job_id % 10 = 1 THEN CASE WHEN contains(company_name, '(') THEN title || ' (' || company_name || ')' WHEN company = company_name THEN title ELSE title || ' (' || company_name || ')' END ELSE title END
 || CASE WHEN job_id % 4 = 2 THEN ' (Toronto)' ELSE '' END AS title, location, url, 'readme:' || feed AS source FROM mf WHERE company IS NOT NULL)"""


@query("s02_read_markdown_table_feed", f"WITH {_MD_SQL} SELECT company_name, title, location, url, source FROM mr")
def s02(spark, d):
    return feeds.read_markdown_tables(markdown_lines(spark, d)).select("company_name", "title", "location", "url", "source")


@query("w07_forward_fill", """WITH m AS (SELECT split_part(source, ':', 2) AS feed, job_id, CASE WHEN job_id % 9 <> 0 THEN company_name END AS own FROM postings)
SELECT feed, job_id, last_value(own IGNORE NULLS) OVER (PARTITION BY feed ORDER BY job_id) AS company FROM m""")
def w07(spark, d):
    p = view(spark, d, "postings", ["company_name", "source"])
    m = p.select(F.substring_index("source", ":", -1).alias("feed"), "job_id", F.when(p.job_id % 9 != 0, p.company_name).alias("company"))
    return windows.forward_fill(m, "feed", "job_id", ["company"], bin_size=64)


def board_source(spark, d):
    return view(spark, d, "postings", ["company_name", "supplier_key", "title", "location", "url", "posted_at", "description_text"])


def greenhouse_payloads(spark, d):
    p = board_source(spark, d)
    html = F.concat(F.lit("<p>"), F.replace(F.replace(p.description_text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>"))
    day = F.concat(p.posted_at.cast("string"), F.lit("T00:00:00Z"))
    job = F.struct(p.job_id.alias("id"), p.title.alias("title"), F.struct(p.location.alias("name")).alias("location"), p.url.alias("absolute_url"),
                   F.when(p.job_id % 3 != 0, day).alias("first_published"), day.alias("updated_at"), html.alias("content"), F.array(F.struct(F.lit("R&D").alias("name"))).alias("departments"))
    return p.select(_token(p).alias("feed"), p.company_name.alias("company"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))


def _tidy(x):
    """Text as the HTML reader leaves it: spaces squeezed per line, blank runs cut to one line."""
    s = o.sub(f"replace(replace({x}, chr(13), chr(10)), chr(133), chr(10))", r"[\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+")
    return f"nullif({o.strip(o.sub(o.sub(s, ' *\\n *', chr(10)), '\\n{3,}', chr(10) * 2))}, '')"


_CONTENT = _unescape_sql(o.sub(o.sub("('<p>' || description_text || '</p>')", f"(?i)</?(?:{'|'.join(fv.BLOCK_TAGS)})[^>]*>", chr(10)), "<[^>]+>"))


@query("s03_read_board_greenhouse", f"""SELECT CAST(job_id AS VARCHAR) AS external_id, company_name, title, location, url, posted_at, 'greenhouse:sup' || supplier_key AS source, {_tidy(_CONTENT)} AS description_text
FROM postings""")
def s03(spark, d):
    """Content arrives escaped inside a paragraph; stray markup characters of the texts go through the HTML reader like any other."""
    r = feeds.read_greenhouse(greenhouse_payloads(spark, d))
    return r.select("external_id", "company_name", "title", "location", "url", "posted_at", "source", "description_text")


@query("s04_read_board_lever", """SELECT CAST(job_id AS VARCHAR) AS external_id, company_name, title, location, url, posted_at, 'lever:sup' || supplier_key AS source,
 nullif(concat_ws(chr(10) || chr(10), nullif(description_text, ''), CASE WHEN job_id % 2 = 0 THEN 'Perks' || chr(10) || 'Lunch' || chr(10) || chr(10) || 'Gym & pool' END, CASE WHEN job_id % 3 = 0 THEN 'Bye' END), '') AS description_text
FROM postings""")
def s04(spark, d):
    p = board_source(spark, d)
    lists = F.when(p.job_id % 2 == 0, F.array(F.struct(F.lit("Perks").alias("text"), F.lit("<ul><li>Lunch</li><li>Gym &amp; pool</li></ul>").alias("content"))))
    item = F.struct(p.job_id.alias("id"), p.title.alias("text"), F.struct(p.location.alias("location")).alias("categories"), p.description_text.alias("descriptionPlain"), lists.alias("lists"),
                    F.when(p.job_id % 3 == 0, F.lit("Bye")).alias("additionalPlain"), _ms(p.posted_at, 1000).alias("createdAt"), F.when(p.job_id % 5 != 0, p.url).alias("hostedUrl"), p.url.alias("applyUrl"))
    pay = p.select(_token(p).alias("feed"), p.company_name.alias("company"), F.to_json(F.array(item)).alias("payload"))
    r = feeds.read_lever(pay)
    return r.select("external_id", "company_name", "title", "location", "url", "posted_at", "source", "description_text")


@query("s05_read_board_ashby", """SELECT CAST(job_id AS VARCHAR) AS external_id, company_name, title, CASE WHEN job_id % 4 = 0 THEN CASE WHEN location = '' THEN 'Remote' ELSE location || '; Remote' END ELSE location END AS location,
 url, posted_at, 'ashby:sup' || supplier_key AS source, nullif(description_text, '') AS description_text FROM postings WHERE job_id % 6 <> 2""")
def s05(spark, d):
    p = board_source(spark, d)
    job = F.struct(p.job_id.alias("id"), p.title.alias("title"), p.location.alias("location"), (p.job_id % 4 == 0).alias("isRemote"), F.when(p.job_id % 6 == 2, F.lit(False)).alias("isListed"),
                   F.when(p.job_id % 5 != 0, p.url).alias("jobUrl"), p.url.alias("applyUrl"), F.concat(p.posted_at.cast("string"), F.lit("T09:00:00.000Z")).alias("publishedAt"), p.description_text.alias("descriptionPlain"))
    pay = p.select(_token(p).alias("feed"), p.company_name.alias("company"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))
    return feeds.read_ashby(pay).select("external_id", "company_name", "title", "location", "url", "posted_at", "source", "description_text")


@query("s06_read_board_workday", f"""SELECT 'https://sup' || supplier_key || '.' || CASE supplier_key % 3 WHEN 0 THEN 'wd5' ELSE 'wd1' END || '.myworkdayjobs.com/External/job/City/Intern_JR' || job_id AS url, company_name, title, location,
 'workday:sup' || supplier_key AS source, CASE WHEN job_id % 2 = 0 THEN 'REQ' || job_id ELSE 'JR' || job_id END AS external_id,
 CASE job_id % 35 WHEN 0 THEN DATE '2024-01-31' WHEN 1 THEN DATE '2024-01-30' WHEN 34 THEN NULL ELSE DATE '2024-01-31' - CAST(job_id % 35 AS INT) END AS posted_at
FROM postings WHERE supplier_key % 3 <> 2 AND {o.rm('title', '(?i)' + chr(92) + 'b(?:' + '|'.join(fv.INTERNSHIP_WORDS) + ')' + chr(92) + 'b')}""")
def s06(spark, d):
    """Board tokens with three, two or one segment (the last is an error and its board is skipped); page 0 is stale and loses to page 1."""
    p = board_source(spark, d)
    k, n = p.supplier_key, p.job_id % 35
    feed = F.concat(_token(p), F.when(k % 3 == 0, F.lit("/wd5/External")).when(k % 3 == 1, F.lit("/External")).otherwise(F.lit("")))
    posted = F.when(n == 0, F.lit("Posted Today")).when(n == 1, F.lit("Posted Yesterday")).when(n == 34, F.lit("Posted a while ago")).otherwise(
        F.concat(F.lit("Posted "), n.cast("string"), F.when(n >= 30, F.lit("+")).otherwise(F.lit("")), F.lit(" Days Ago")))
    def page(title):
        item = F.struct(title.alias("title"), F.concat(F.lit("/job/City/Intern_JR"), p.job_id.cast("string")).alias("externalPath"), p.location.alias("locationsText"), posted.alias("postedOn"),
                        F.when(p.job_id % 2 == 0, F.array(F.concat(F.lit("REQ"), p.job_id.cast("string")))).alias("bulletFields"))
        return F.to_json(F.struct(F.array(item).alias("jobPostings")))
    pay = p.select(feed.alias("feed"), p.company_name.alias("company"), F.explode(F.array(
        F.struct(F.lit(0).alias("page"), page(F.concat(F.lit("Old "), p.title)).alias("payload")), F.struct(F.lit(1).alias("page"), page(p.title).alias("payload")))).alias("x")).select("feed", "company", "x.*")
    return feeds.read_workday(pay, dates.at(S.as_of)).select("url", "company_name", "title", "location", "source", "external_id", "posted_at")



_PAGE_SQL = f"""a AS (SELECT page_id, url, {_unescape_sql('html')} AS s FROM pages), b AS (SELECT page_id, url, {o.sub('s', f"(?i)</?(?:{'|'.join(fv.BLOCK_TAGS)})[^>]*>", chr(10))} AS s FROM a),
c AS (SELECT page_id, url, {_unescape_sql(o.sub('s', '<[^>]+>'))} AS s FROM b), e AS (SELECT page_id, url, {o.sub('s', _SPACES)} AS s FROM c),
txt AS (SELECT page_id, url, {o.strip(o.sub(o.sub('s', ' *\\n *', chr(10)), '\\n{3,}', chr(10) * 2))} AS text FROM e)"""


@query("s07_read_career_pages", f"WITH {_PAGE_SQL} SELECT page_id, url, substr(split_part(text, chr(10), 1), 1, 120) AS title FROM txt WHERE length(text) >= 600 AND contains(lower(text), 'ention')")
def s07(spark, d):
    return feeds.read_career_pages(raw(spark, d, "pages"), "ention").select("page_id", "url", "title")


@query("s08_detail_payload_to_text", """SELECT job_id, CASE job_id % 6 WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' WHEN 3 THEN 'ashby' WHEN 4 THEN 'workday' WHEN 0 THEN 'smartrecruiters' ELSE 'oracle' END AS kind,
 CASE job_id % 6 WHEN 1 THEN 'A ' || title WHEN 2 THEN 'A ' || title || chr(10) || chr(10) || 'Perks' || chr(10) || 'Lunch' WHEN 3 THEN 'A ' || title
 WHEN 4 THEN CASE WHEN location <> '' THEN 'Location: ' || location || chr(10) ELSE '' END || 'Time type: Full time' || chr(10) || chr(10) || 'A ' || title
 WHEN 0 THEN 'About' || chr(10) || 'A ' || title || chr(10) || chr(10) || 'More' || chr(10) || 'B' ELSE CASE WHEN location <> '' THEN 'Location: ' || location || chr(10) || chr(10) ELSE '' END || 'A ' || title || chr(10) || chr(10) || 'Q' END AS description_text FROM postings""")
def s08(spark, d):
    p = view(spark, d, "postings", ["title", "location", "url"])
    k = p.job_id
    url = F.when(k % 6 == 0, F.concat(F.lit("https://jobs.smartrecruiters.com/acme/"), k.cast("string"))).when(
        k % 6 == 5, F.concat(F.lit("https://x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/S1/job/"), k.cast("string"))).otherwise(p.url)
    html = F.concat(F.lit("<p>A "), F.replace(p.title, F.lit("&"), F.lit("&amp;")), F.lit("</p>"))
    perks = F.array(F.struct(F.lit("Perks").alias("text"), F.lit("<p>Lunch</p>").alias("content")))
    uid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(k.cast("string"), 12, "0"))
    pay = (F.when(k % 6 == 1, F.to_json(F.struct(html.alias("content")))).when(k % 6 == 2, F.to_json(F.struct(html.alias("description"), perks.alias("lists"))))
           .when(k % 6 == 3, F.to_json(F.struct(F.array(F.struct(F.lit("other").alias("id"), F.lit("<p>no</p>").alias("descriptionHtml")), F.struct(uid.alias("id"), html.alias("descriptionHtml"))).alias("jobs"))))
           .when(k % 6 == 4, F.to_json(F.struct(F.struct(html.alias("jobDescription"), p.location.alias("location"), F.lit("Full time").alias("timeType")).alias("jobPostingInfo"))))
           .when(k % 6 == 0, F.to_json(F.struct(F.struct(F.struct(F.struct(F.lit("About").alias("title"), html.alias("text")).alias("a"), F.struct(F.lit("More").alias("title"), F.lit("B").alias("text")).alias("b")).alias("sections")).alias("jobAd"))))
           .otherwise(F.to_json(F.struct(F.array(F.struct(html.alias("ExternalDescriptionStr"), F.lit("<p>Q</p>").alias("ExternalQualificationsStr"), p.location.alias("PrimaryLocation"))).alias("items")))))
    return feeds.detail_text(p.select("job_id", url.alias("url"), pay.alias("payload")))


@query("s09_read_directory_csv", """SELECT slug, len(string_split(aliases, '|')) AS n_aliases, tags, CAST(nullif(tier, '') AS INT) AS tier, CASE WHEN reputation <> 'n/a' THEN CAST(reputation AS INT) END AS reputation,
 slug || '|' || slug || '-holdings|' || slug || '-group' AS slugs, ats_token <> '' AND ats_type <> '' AND status IN ('ok', 'empty', 'unverified') AS pollable FROM directory""")
def s09(spark, d):
    """The directory is written as CSV into scratch space and read back with a declared all-string schema."""
    e = view(spark, d, "directory")
    path = scratch_dir(spark, "directory")
    sinks.write_directory_csv(e, path)
    back = spark.read.schema(", ".join(f"{c} string" for c in e.columns)).option("header", True).option("emptyValue", "").csv(path).na.fill("")
    p = co.parse_directory(back)
    return p.select("slug", F.size("alias_list").alias("n_aliases"), F.array_join("tag_list", "|").alias("tags"), "tier", "reputation", F.array_join("slugs", "|").alias("slugs"), co.pollable(p).alias("pollable"))


@query("s15_write_directory_csv", "SELECT slug, aliases, tags, row_number() OVER (ORDER BY slug) AS line FROM directory")
def s15(spark, d):
    e = view(spark, d, "directory").select("slug", F.array_join(co.list_of(F.col("aliases")), "|").alias("aliases"), F.array_join(co.list_of(F.col("tags")), "|").alias("tags"))
    path = scratch_dir(spark, "directory")
    sinks.write_directory_csv(e, path)
    back = spark.read.schema("slug string, aliases string, tags string").option("header", True).csv(path).na.fill("")
    return ranking.global_rank(back, [("slug", "asc")], name="line")


@query("s10_seed_companies", """SELECT s.s_name AS name, lower(replace(s.s_name, '#', '-')) AS slug, coalesce(c.status, 'approved') AS status, coalesce(CASE WHEN s.s_suppkey % 2 = 0 THEN 'greenhouse' END, c.ats_type) AS ats_type,
 coalesce(CASE WHEN s.s_suppkey % 2 = 0 THEN 'tok:' || s.s_suppkey END, c.ats_token) AS ats_token FROM supplier s LEFT JOIN company_dim c ON c.slug = lower(replace(s.s_name, '#', '-'))""")
def s10(spark, d):
    """Seed rows: "type:token" is cut at the first colon; a seed never brings back a company the user removed."""
    s = raw(spark, d, "supplier")
    ats = F.when(s.s_suppkey % 2 == 0, F.concat(F.lit("greenhouse:tok:"), s.s_suppkey.cast("string")))
    seed = s.select(tx.slug(s.s_name).alias("slug"), s.s_name.alias("name"), F.lit("manual").alias("source"), ats.alias("ats"))
    dim = view(spark, d, "company_dim")
    seed = seed.join(dim.select("slug", F.col("status").alias("_st")), "slug", "left").select(
        "slug", "name", "source", F.coalesce("_st", F.lit("approved")).alias("status"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast("int").alias("reputation"),
        F.substring_index("ats", ":", 1).alias("ats_type"), F.regexp_replace("ats", "^[^:]*:", "").alias("ats_token"))
    done = merge.upsert_companies(dim, seed)
    return done.join(seed.select("slug"), "slug", "left_semi").select("name", "slug", "status", "ats_type", "ats_token")


@query("s11_union_sources", f"""WITH {_MD_SQL}, u AS (SELECT 'simplify:owner/list-' || CASE WHEN job_id % 3 = 0 THEN '2027' ELSE 'x' END AS source, title, url, false AS complete FROM postings WHERE job_id % 8 <> 5
 UNION ALL SELECT source, title, url, true FROM mr UNION ALL SELECT 'greenhouse:sup' || supplier_key, title, url, true FROM postings)
SELECT source, title, url FROM u WHERE NOT complete OR {o.rm('title', '(?i)' + chr(92) + 'b(?:' + '|'.join(fv.INTERNSHIP_WORDS) + ')' + chr(92) + 'b')}""")
def s11(spark, d):
    """Three kinds of feeds from the folders they land in, by name."""
    return feeds.union_feeds(spark, _landed(spark, simplify=listing_payloads(spark, d), readme=markdown_lines(spark, d), greenhouse=greenhouse_payloads(spark, d))).select("source", "title", "url")


def _landed(spark, **frames):
    root = scratch_dir(spark, "landed")
    for name, df in frames.items():
        df.select(*[f.split(" ")[0] for f in feeds.FEEDS[name].landed.split(", ")]).write.parquet(f"{root}/{name}")
    return {name: f"{root}/{name}" for name in frames}


@query("s11b_stream_feeds", f"""WITH u AS (SELECT 'simplify:owner/list-' || CASE WHEN job_id % 3 = 0 THEN '2027' ELSE 'x' END AS source, title, url, false AS complete FROM postings WHERE job_id % 8 <> 5
 UNION ALL SELECT 'greenhouse:sup' || supplier_key, title, url, true FROM postings)
SELECT source, title, url FROM u WHERE NOT complete OR {o.rm('title', '(?i)' + chr(92) + 'b(?:' + '|'.join(fv.INTERNSHIP_WORDS) + ')' + chr(92) + 'b')}""")
def s11b(spark, d):
    """The same readers over streams of landed payloads."""
    paths = _landed(spark, simplify=listing_payloads(spark, d), greenhouse=greenhouse_payloads(spark, d))
    return jobs.run_to_files(feeds.union_feeds(spark, paths, stream=True).select("source", "title", "url"))


@query("s12_parse_scorer_output", """SELECT eval_seq, CASE WHEN eval_seq % 13 = 0 THEN 'bad' WHEN eval_seq % 17 = 0 THEN 'bad' ELSE 'ok' END AS state, CASE WHEN eval_seq % 13 <> 0 THEN job_id END AS job_id,
 CASE WHEN eval_seq % 13 = 0 THEN NULL WHEN eval_seq % 17 = 0 THEN 101 + skills_match ELSE skills_match END AS skills_match, CASE WHEN eval_seq % 13 = 0 THEN NULL WHEN eval_seq % 5 = 0 THEN 50 ELSE confidence END AS confidence,
 CASE WHEN eval_seq % 13 = 0 THEN NULL ELSE 'a|b' END AS fit_tags FROM evals""")
def s12(spark, d):
    e = view(spark, d, "evals")
    k = e.eval_seq
    item = F.struct("job_id", F.when(k % 17 == 0, e.skills_match + 101).otherwise(e.skills_match).alias("skills_match"), "level_match", "work_alignment", "experience_quality", "interest", "wildcard",
                    F.when(k % 5 != 0, e.confidence).alias("confidence"), F.array(F.lit("a"), F.lit("b")).alias("fit_tags"))
    js = F.to_json(item)
    pay = e.select("eval_seq", F.when(k % 13 == 0, F.expr("substring(to_json(named_struct('job_id', job_id)), 1, 5)")).otherwise(js).alias("payload"))
    out = feeds.parse_scorer_output(pay)
    readable = F.col("job_id").isNotNull()
    return out.select("eval_seq", "state", "job_id", F.when(readable, F.col("skills_match")).alias("skills_match"), F.when(readable, F.col("confidence")).alias("confidence"),
                      F.when(readable, F.array_join("fit_tags", "|")).alias("fit_tags"))


@query("s13_write_snapshot", "SELECT job_id, company_name, title, location, active FROM postings")
def s13(spark, d):
    """Round trip through a versioned snapshot; the version is written twice to show that a re-run changes nothing."""
    p = view(spark, d, "postings", ["company_name", "title", "location", "active"])
    path = scratch_dir(spark, "snapshot")
    for _ in range(2):
        sinks.write_snapshot(p, path, 1)
    return sinks.read_snapshot(spark, path, 1)


_LINE_SQL = f"""'| ' || job_id || ' | ' || CASE WHEN is_new THEN '🆕 ' ELSE '' END || '**' || company_name || '** | [' || replace(title, '|', '/') || '](' || {o.canonical_url('url')} || ')'
 || CASE WHEN unread THEN ' ⚠ **unread — check manually**' ELSE '' END || ' | ' || replace(location, '|', '/') || coalesce(' · due ' || CAST(deadline AS VARCHAR), '') || ' | ' || likelihood || ' | ' || desirability || ' | ' || interest
 || ' | ' || replace(coalesce(summary, ''), chr(10), ' ') || CASE WHEN fit_tags <> '' THEN ' · ✓ ' || fit_tags ELSE '' END || ' |'"""


@query("s14_write_digest", f"""WITH {ROWS_SQL}, pr AS (SELECT * FROM deco WHERE app_status = 'new' AND bucket <> 'archive'), k AS (SELECT *, CASE bucket WHEN 'likely' THEN likelihood * desirability WHEN 'wildcard' THEN interest ELSE desirability END AS key1,
 CASE WHEN bucket IN ('likely', 'wildcard') THEN 0 ELSE likelihood END AS key2 FROM pr),
m AS (SELECT *, bucket AS section, row_number() OVER (PARTITION BY bucket ORDER BY is_new DESC, key1 DESC, key2 DESC, job_id) AS rank FROM k WHERE track IN ('primary', 'unknown')),
a AS (SELECT *, 'alt ' || bucket AS section, row_number() OVER (PARTITION BY bucket ORDER BY is_new DESC, key1 DESC, key2 DESC, job_id) AS rank FROM k WHERE track IN ('alt', 'unknown') AND bucket IN ('likely', 'reach')),
u AS (SELECT * FROM m WHERE rank <= CASE bucket WHEN 'wildcard' THEN 5 ELSE 80 END UNION ALL SELECT * FROM a)
SELECT section, rank, {_LINE_SQL} AS line FROM u
UNION ALL SELECT 'header', 0, 'Terms: Summer 2027 / Spring 2027; rubric 2; profile cur; newly scored: ' || count(*) FILTER (WHERE is_new) FROM u WHERE section NOT LIKE 'alt %'
UNION ALL SELECT section, 0, '## ' || section || ' (' || count(*) || ')' FROM (SELECT section FROM m WHERE section IN ('likely', 'reach', 'wildcard') UNION ALL SELECT section FROM a) GROUP BY section
UNION ALL SELECT section, CASE section WHEN 'wildcard' THEN 6 ELSE 81 END, '_' || (count(*) - CASE section WHEN 'wildcard' THEN 5 ELSE 80 END) || ' more not shown_' FROM m WHERE section IN ('likely', 'reach', 'wildcard') GROUP BY section
 HAVING count(*) > CASE section WHEN 'wildcard' THEN 5 ELSE 80 END
UNION ALL SELECT 'proposed', 0, '## proposed (' || count(*) || ')' FROM company_dim WHERE status = 'proposed' HAVING count(*) > 0
UNION ALL SELECT 'proposed', 31, '_' || (count(*) - 30) || ' more not shown_' FROM company_dim WHERE status = 'proposed' HAVING count(*) > 30
UNION ALL SELECT 'proposed', row_number() OVER (ORDER BY coalesce(tier, -1), name), '- `' || slug || '` **' || name || '** (tier ' || coalesce(CAST(tier AS VARCHAR), '?') || ', fit ' || CASE WHEN company_id % 2 = 0 THEN CAST(30 + company_id % 70 AS VARCHAR) ELSE '?' END
 || ', rep ' || coalesce(CAST(reputation AS VARCHAR), '?') || '; via ' || source || ') — ' || CASE WHEN company_id % 3 <> 1 THEN substr('Seen on ' || company_id || ' lists ' || repeat('and more ', 30), 1, 160) ELSE '' END FROM company_dim WHERE status = 'proposed' QUALIFY row_number() OVER (ORDER BY coalesce(tier, -1), name) <= 30
UNION ALL SELECT 'rejects', row_number() OVER (ORDER BY n DESC, r), '- ' || r || ': ' || n FROM (SELECT CASE WHEN hard_reject_reason LIKE 'model:%' THEN 'model' ELSE hard_reject_reason END AS r, count(*) AS n FROM evals WHERE rubric_version = '2' AND hard_reject_reason IS NOT NULL GROUP BY 1)""")
def s14(spark, d):
    """Digest lines by section and rank, written as ordered text files and returned. Main sections are capped reports;
    the alternate-term sections are complete, so they get exact ranks without gathering a bucket in one task."""
    rows = decorated(spark, d, ["url"], deadline=True).where("app_status = 'new' AND bucket <> 'archive'").withColumn("canonical_url", tx.canonical_url(F.col("url")))
    cols = ["job_id", "bucket", "track", "is_new", "likelihood", "desirability", "interest", "line"]
    rows = rows.withColumn("line", reports.table_line(rows)).select(*cols)
    primary = rows.where("track IN ('primary', 'unknown')")
    main = reports.section_rank(primary, SECTION_CAPS)
    head = reports.header_line(S, main)
    main = main.select(F.col("bucket").alias("section"), F.col("rank").cast("bigint").alias("rank"), "line")
    alt = reports.bucket_key(rows.where("track IN ('alt', 'unknown') AND bucket IN ('likely', 'reach')")).withColumn("fresh", F.col("is_new").cast("int"))
    alt = ranking.global_rank(alt, [("fresh", "desc"), ("key1", "desc"), ("key2", "desc"), ("job_id", "asc")], keys=["bucket"])
    alt = alt.select(F.concat(F.lit("alt "), "bucket").alias("section"), "rank", "line")
    k = F.col("company_id")
    c = view(spark, d, "company_dim").where("status = 'proposed'").withColumns({"t": F.coalesce("tier", F.lit(-1)), "fit": F.when(k % 2 == 0, 30 + k % 70), "rationale": F.when(
        k % 3 != 1, F.concat(F.lit("Seen on "), k.cast("string"), F.lit(" lists "), F.repeat(F.lit("and more "), F.lit(30)), F.lit("\nsecond line")))})
    prop = ranking.top_rank(c, [("t", "asc"), ("name", "asc")], 30).select(F.lit("proposed").alias("section"), F.col("rank").cast("bigint").alias("rank"), reports.proposal_line().alias("line"))
    sections = primary.where(F.col("bucket").isin(*SECTION_CAPS)).select(F.col("bucket").alias("section")).unionByName(alt.select("section")).unionByName(c.select(F.lit("proposed").alias("section")))
    frame = reports.section_frame(sections, {**SECTION_CAPS, "proposed": 30})
    e = view(spark, d, "evals").where((F.col("rubric_version") == S.rubric) & F.col("hard_reject_reason").isNotNull())
    n = e.groupBy(F.when(e.hard_reject_reason.startswith("model:"), F.lit("model")).when(e.hard_reject_reason.startswith("triage:"), e.hard_reject_reason).otherwise(e.hard_reject_reason).alias("r")).agg(F.count("*").alias("n"))
    rej = ranking.global_rank(n, [("n", "desc"), ("r", "asc")]).select(F.lit("rejects").alias("section"), "rank", F.concat(F.lit("- "), "r", F.lit(": "), F.col("n").cast("string")).alias("line"))
    lines = head.unionByName(frame).unionByName(main).unionByName(alt).unionByName(prop).unionByName(rej)
    path = scratch_dir(spark, "digest")
    sinks.write_snapshot(lines, path, 1)
    lines = sinks.read_snapshot(spark, path, 1)
    sinks.write_lines(lines, f"{path}/text", ["section", "rank"])
    return lines


@query("s16_append_run_log", """SELECT run_id, kind, started_at, CASE WHEN run_id % 5 <> 0 THEN started_at + INTERVAL 1 HOUR * CASE WHEN run_id % 7 IN (1, 2) THEN 2 ELSE 1 END END AS finished_at,
 CASE WHEN run_id % 5 <> 0 THEN tokens + CASE WHEN run_id % 7 = 1 THEN 1 ELSE 0 END END AS tokens, CASE WHEN run_id % 5 <> 0 AND run_id % 7 NOT IN (1, 2) AND run_id % 4 = 0 THEN '["network","' || kind || '"]' END AS errors FROM runs""")
def s16(spark, d):
    """All runs start; four of five finish; the log is compacted; some finish again, with other tokens or none; runs that never
    started are finished too."""
    r = view(spark, d, "runs").select("run_id", "kind", "started_at", "tokens")
    log = sinks.RunLog(spark, scratch_dir(spark, "runs"))
    after = lambda h: (F.col("started_at") + F.make_dt_interval(hours=F.lit(h))).alias("finished_at")
    none = F.array().cast("array<string>")
    some = r.where("run_id % 5 <> 0")
    log.start(r)
    log.finish(some.select("run_id", after(1), "tokens", F.when(F.col("run_id") % 4 == 0, F.array(F.lit("network"), F.col("kind"))).otherwise(none).alias("errors")))
    log.compact()
    again = some.where("run_id % 7 IN (1, 2)")
    log.finish(again.select("run_id", after(2), F.when(F.col("run_id") % 7 == 1, F.col("tokens") + 1).alias("tokens"), none.alias("errors")))
    log.finish(some.select((-1 - F.col("run_id")).alias("run_id"), after(3), "tokens", none.alias("errors")))
    return log.read()


_ENVELOPE_REASON = """CASE WHEN batch % 11 = 0 THEN 'malformed' WHEN batch % 7 = 3 THEN 'no_list' WHEN eval_seq % 13 = 0 THEN 'not_object' WHEN eval_seq % 19 = 0 THEN 'no_id' WHEN eval_seq % 23 = 0 THEN 'type:{0}' WHEN eval_seq % 17 = 0 THEN 'range:{0}' END"""


def _envelopes(spark, d, envelope, item, field):
    """Four records a payload; some payloads are cut off or hold another list, some records are text, lack their id, or have a word
    or too large a number for a score."""
    e = view(spark, d, "evals").withColumn("batch", F.floor(F.col("eval_seq") / 4))
    k = F.col("eval_seq")
    score = F.when(k % 23 == 0, F.lit('"high"')).when(k % 17 == 0, F.lit("101")).otherwise(F.col("skills_match").cast("string"))
    fields = F.concat(F.when(k % 19 != 0, F.concat(F.lit('"job_id":'), F.col("job_id").cast("string"), F.lit(","))).otherwise(F.lit("")), F.lit(f'"{field}":'), score, item)
    rec = F.when(k % 13 == 0, F.lit('"oops"')).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    packed = e.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), rec.alias("r")))).alias("l"))
    text = F.concat(F.when(F.col("batch") % 7 == 3, F.lit('{"others":[')).otherwise(F.lit('{"' + envelope + '":[')), F.array_join(F.transform("l", lambda x: x["r"]), ","), F.lit("]}"))
    return feeds.parse_scorer_batches(packed.select("batch", F.when(F.col("batch") % 11 == 0, F.substring(text, 1, 20)).otherwise(text).alias("payload")), envelope)


_RECORDS = f"""r AS (SELECT *, eval_seq // 4 AS batch FROM evals), x AS (SELECT *, {_ENVELOPE_REASON} AS reason FROM r),
w AS (SELECT batch, CASE WHEN reason IN ('malformed', 'no_list') THEN NULL ELSE CAST(eval_seq % 4 AS INT) END AS position, reason, job_id, eval_seq, skills_match, confidence FROM x
 QUALIFY reason IS NULL OR reason NOT IN ('malformed', 'no_list') OR row_number() OVER (PARTITION BY batch ORDER BY eval_seq) = 1)"""


@query("s12b_evaluation_batches", f"""WITH {_RECORDS.format('skills_match')} SELECT batch, position, reason, CASE WHEN reason IS NULL THEN job_id END AS job_id, CASE WHEN reason IS NULL THEN skills_match END AS skills_match,
 CASE WHEN reason IS NULL THEN CASE WHEN eval_seq % 5 = 0 THEN 50 ELSE confidence END END AS confidence, CASE WHEN reason IS NULL THEN 'a|b' END AS fit_tags, CASE WHEN reason IS NULL THEN '' END AS summary FROM w""")
def s12b(spark, d):
    """Envelopes of evaluations: every record with its verdict."""
    extra = F.concat(F.when(F.col("eval_seq") % 5 != 0, F.concat(F.lit(',"confidence":'), F.col("confidence").cast("string"))).otherwise(F.lit("")), F.lit(',"fit_tags":["a","b"],"wildcard_reason":null'))
    out = _envelopes(spark, d, "evaluations", extra, "skills_match")
    good = lambda c: F.when(F.col("verdict").isNull(), c)
    return out.select("batch", "position", F.col("verdict").alias("reason"), good(F.col("job_id")).alias("job_id"), good(F.col("skills_match")).alias("skills_match"), good(F.col("confidence")).alias("confidence"),
                      good(F.array_join("fit_tags", "|")).alias("fit_tags"), good(F.col("summary")).alias("summary"))


@query("s12c_triage_batches", f"""WITH {_RECORDS.format('score')} SELECT batch, position, reason, CASE WHEN reason IS NULL THEN job_id END AS job_id, CASE WHEN reason IS NULL THEN skills_match END AS score,
 CASE WHEN reason IS NULL THEN CASE WHEN eval_seq % 5 = 0 THEN '' ELSE 'because' END END AS why FROM w""")
def s12c(spark, d):
    """Envelopes of triage scores; the field named reason is the scorer's."""
    extra = F.when(F.col("eval_seq") % 5 != 0, F.lit(',"reason":"because"')).otherwise(F.lit(""))
    out = _envelopes(spark, d, "triages", extra, "score")
    good = lambda c: F.when(F.col("verdict").isNull(), F.col(c)).alias(c)
    return out.select("batch", "position", F.col("verdict").alias("reason"), good("job_id"), good("score"), F.when(F.col("verdict").isNull(), F.col("reason")).alias("why"))


@query("s12d_quarantine", f"WITH {_RECORDS.format('skills_match')} SELECT reason, count(*) AS records FROM w WHERE reason IS NOT NULL GROUP BY 1")
def s12d(spark, d):
    """The quarantine table of the evaluation envelopes, by reason."""
    path = scratch_dir(spark, "quarantine")
    sinks.write_snapshot(feeds.quarantined(_envelopes(spark, d, "evaluations", F.lit(""), "skills_match")), path, 0)
    return sinks.read_snapshot(spark, path, 0).groupBy(F.col("verdict").alias("reason")).agg(F.count("*").alias("records"))
