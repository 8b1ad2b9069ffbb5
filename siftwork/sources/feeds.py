"""Readers of landed feed payloads. Each takes rows (feed, company, payload) and returns postings.

A payload is one landed page or item list as text; a page is small, a feed is many rows. Nothing is gathered per feed,
so a feed holding a third of all rows is just more rows.
"""
from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import dates, fixed_values as fv
from siftwork.functions.plan import once
from siftwork.functions.text import html_to_text, looks_like_internship, squeeze, strip
from siftwork.operators.windows import forward_fill

POSTING = ["company_name", "title", "location", "url", "source", "external_id", "posted_at", "active", "terms_txt", "sponsorship", "description_text"]

LISTING = """array<struct<id:string,company_name:string,title:string,locations:array<string>,url:string,date_posted:bigint,date_updated:bigint,
active:boolean,is_visible:boolean,terms:array<string>,season:string,sponsorship:string>>"""
GREENHOUSE = """struct<jobs:array<struct<id:string,title:string,location:struct<name:string>,absolute_url:string,first_published:string,updated_at:string,
content:string,departments:array<struct<name:string>>>>>"""
LEVER = """array<struct<id:string,text:string,categories:struct<location:string,team:string,commitment:string>,descriptionPlain:string,description:string,
lists:array<struct<text:string,content:string>>,additionalPlain:string,additional:string,createdAt:bigint,hostedUrl:string,applyUrl:string>>"""
ASHBY = """struct<jobs:array<struct<id:string,title:string,location:string,isRemote:boolean,isListed:boolean,jobUrl:string,applyUrl:string,publishedAt:string,
descriptionPlain:string,descriptionHtml:string>>>"""
WORKDAY = "struct<jobPostings:array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>>"


def _blank(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def _items(payloads: DataFrame, schema: str, field: str | None = None) -> DataFrame:
    parsed = F.from_json("payload", schema)
    return payloads.select("feed", "company", F.explode(parsed[field] if field else parsed).alias("i"))


def _none(name: str, kind: str = "string") -> Column:
    return F.lit(None).cast(kind).alias(name)


def read_listing_feed(payloads: DataFrame) -> DataFrame:
    """Structured listings: hidden items dropped, epoch dates, terms or season plus the year in the feed name."""
    r = _items(payloads, LISTING).where(F.coalesce(F.col("i.is_visible"), F.lit(True)))
    year = F.regexp_extract("feed", r"(20\d\d)", 1)
    season = F.when((F.col("i.season") != "null") & (year != ""), F.transform(F.filter(
        F.transform(F.split("i.season", "/"), lambda t: F.trim(t)), lambda s: s != ""), lambda s: F.concat_ws(" ", s, year)))
    terms = F.when(F.size(F.coalesce("i.terms", F.array())) > 0, F.col("i.terms")).otherwise(season)
    epoch = F.coalesce(F.nullif(F.col("i.date_posted"), F.lit(0)), F.nullif(F.col("i.date_updated"), F.lit(0)))
    company = _blank(F.trim(F.coalesce("i.company_name", F.lit(""))))
    return r.select(
        F.coalesce(company, F.lit("Unknown")).alias("company_name"), F.trim("i.title").alias("title"),
        F.array_join(F.coalesce("i.locations", F.array().cast("array<string>")), "; ").alias("location"), F.col("i.url").alias("url"),
        F.concat(F.lit("simplify:"), "feed").alias("source"), F.col("i.id").alias("external_id"), F.to_date(F.timestamp_seconds(epoch)).alias("posted_at"),
        F.coalesce("i.active", F.lit(True)).alias("active"), F.coalesce(F.array_join(terms, "|"), F.lit("")).alias("terms_txt"),
        F.col("i.sponsorship").alias("sponsorship"), _none("description_text"))


def _board(r: DataFrame, kind: str, location: Column, url: Column, posted: Column, text: Column, title: str = "i.title") -> DataFrame:
    return r.select(
        F.col("company").alias("company_name"), F.coalesce(F.col(title), F.lit("")).alias("title"), F.coalesce(location, F.lit("")).alias("location"),
        url.alias("url"), F.concat(F.lit(f"{kind}:"), "feed").alias("source"), F.col("i.id").alias("external_id"), posted.alias("posted_at"),
        F.lit(True).alias("active"), F.lit("").alias("terms_txt"), _none("sponsorship"), _blank(text).alias("description_text"))


def _day(c: Column) -> Column:
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def read_greenhouse(payloads: DataFrame) -> DataFrame:
    r = _items(payloads, GREENHOUSE, "jobs")
    posted = _day(F.coalesce(_blank(F.col("i.first_published")), F.col("i.updated_at")))
    return _board(r, "greenhouse", F.col("i.location.name"), F.col("i.absolute_url"), posted, html_to_text(F.col("i.content")))


def part(prefix: Column, html: Column, plain: Column | None = None) -> Column:
    """A piece of description text: a fixed prefix and plain text, else HTML."""
    return F.struct(F.coalesce(prefix, F.lit("")).alias("prefix"), html.cast("string").alias("html"),
                    (plain if plain is not None else F.lit(None)).cast("string").alias("plain"))


def render(parts: Column, keep=lambda t: t != "") -> Column:
    """Pieces to text, one HTML conversion per piece and one in the plan; empty pieces are dropped."""
    texts = F.transform(parts, lambda p: F.concat(p["prefix"], F.coalesce(_blank(p["plain"]), html_to_text(p["html"]))))
    return F.array_join(F.filter(texts, keep), "\n\n")


def lever_parts(i: str, additional_html: bool = True) -> Column:
    """Description, each list block and the closing text."""
    blocks = F.transform(F.coalesce(f"{i}.lists", F.array()), lambda b: part(F.concat(F.coalesce(b["text"], F.lit("")), F.lit("\n")), b["content"]))
    tail = part(F.lit(""), F.col(f"{i}.additional") if additional_html else F.lit(None), F.col(f"{i}.additionalPlain"))
    return F.concat(F.array(part(F.lit(""), F.col(f"{i}.description"), F.col(f"{i}.descriptionPlain"))), blocks, F.array(tail))


def read_lever(payloads: DataFrame) -> DataFrame:
    r = _items(payloads, LEVER)
    posted = F.to_date(F.timestamp_millis(F.nullif(F.col("i.createdAt"), F.lit(0))))
    return _board(r, "lever", F.col("i.categories.location"), F.coalesce(_blank(F.col("i.hostedUrl")), F.col("i.applyUrl")), posted, render(lever_parts("i")), "i.text")


def read_ashby(payloads: DataFrame) -> DataFrame:
    r = _items(payloads, ASHBY, "jobs").where(F.coalesce(F.col("i.isListed"), F.lit(True)))
    place = F.when(F.coalesce(F.col("i.isRemote"), F.lit(False)), F.concat_ws("; ", _blank(F.col("i.location")), F.lit("Remote"))).otherwise(F.col("i.location"))
    text = F.coalesce(_blank(F.col("i.descriptionPlain")), html_to_text(F.col("i.descriptionHtml")))
    return _board(r, "ashby", place, F.coalesce(_blank(F.col("i.jobUrl")), F.col("i.applyUrl")), _day(F.col("i.publishedAt")), text)


def workday_token(token: Column) -> Column:
    """tenant/wd/site or tenant/site (wd1) -> struct; anything else NULL (an error of that board, not of the job)."""
    p = F.filter(F.split(token, "/"), lambda x: x != "")
    def as_struct(t, w, s):
        return F.struct(t.alias("tenant"), w.alias("wd"), s.alias("site"))
    return (F.when(F.size(p) == 3, as_struct(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))))
            .when(F.size(p) == 2, as_struct(F.get(p, F.lit(0)), F.lit("wd1"), F.get(p, F.lit(1)))))


def read_workday(payloads: DataFrame, as_of: Column) -> DataFrame:
    """Search pages (feed = board token, page = order): internships only, the last page wins for a repeated path."""
    parsed = F.from_json("payload", WORKDAY)["jobPostings"]
    r = payloads.withColumn("t", workday_token(F.col("feed"))).where("t IS NOT NULL").select(
        "feed", "company", "page", "t", F.posexplode(parsed).alias("pos", "i"))
    r = r.where((F.trim("i.title") != "") & (F.col("i.externalPath") != "") & looks_like_internship(F.col("i.title")))
    last = r.groupBy("feed", F.col("i.externalPath").alias("path")).agg(F.max_by(F.struct("company", "t", "i"), F.struct("page", "pos")).alias("r"))
    site = F.concat(F.lit("https://"), F.col("r.t.tenant"), F.lit("."), F.col("r.t.wd"), F.lit(".myworkdayjobs.com/"), F.col("r.t.site"), F.col("path"))
    ext = F.coalesce(_blank(F.get("r.i.bulletFields", F.lit(0))), F.substring_index("path", "_", -1))
    return last.select(
        F.col("r.company").alias("company_name"), F.trim("r.i.title").alias("title"), F.trim(F.coalesce("r.i.locationsText", F.lit(""))).alias("location"),
        site.alias("url"), F.concat(F.lit("workday:"), F.col("r.t.tenant")).alias("source"), ext.alias("external_id"),
        dates.relative_posted(F.col("r.i.postedOn"), as_of).alias("posted_at"), F.lit(True).alias("active"), F.lit("").alias("terms_txt"),
        _none("sponsorship"), _none("description_text"))


def read_career_pages(pages: DataFrame, keyword: str = "intern", min_chars: int = 600) -> DataFrame:
    """One page, one posting, if its text is long enough and mentions the keyword; the first line is the title."""
    p = pages.withColumn("text", html_to_text(F.col("html"))).where((F.length("text") >= min_chars) & F.lower("text").contains(keyword))
    return p.select("page_id", "url", F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"), F.col("text").alias("description_text"))


# ---- detail payloads ------------------------------------------------------------------------------

def detail_kind(url: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, rx in fv.DETAIL_URLS:
        out = out.when(url.rlike(rx), F.lit(kind))
    return out


def detail_text(rows: DataFrame) -> DataFrame:
    """(job_id, url, payload) -> (job_id, kind, description_text): the URL picks the payload format. NULL when empty."""
    j = functools.partial(F.from_json, "payload")
    rows = rows.withColumns({"kind": detail_kind(F.col("url")), "i": j(LEVER[len("array<"):-1])})
    empty = F.lit("")
    path = functools.partial(F.get_json_object, "payload")
    sections = F.map_values(j("struct<jobAd:struct<sections:map<string,struct<title:string,text:string>>>>")["jobAd"]["sections"])
    smart = F.transform(sections, lambda v: part(F.concat(F.coalesce(v["title"], empty), F.lit("\n")), v["text"]))
    ashby = F.transform(F.slice(F.filter(j(ASHBY)["jobs"], lambda x: F.instr(F.col("url"), x["id"]) > 0), 1, 1),
                        lambda x: part(empty, x["descriptionHtml"], x["descriptionPlain"]))
    names = ("ExternalDescriptionStr", "ExternalQualificationsStr", "ExternalResponsibilitiesStr")
    kind = F.col("kind")
    parts = (F.when(kind == "greenhouse", F.array(part(empty, path("$.content")))).when(kind == "lever", lever_parts("i", False)).when(kind == "ashby", ashby)
             .when(kind == "workday", F.array(part(empty, path("$.jobPostingInfo.jobDescription")))).when(kind == "smartrecruiters", smart)
             .when(kind == "oracle", F.array(*[part(empty, path(f"$.items[0].{n}")) for n in names])))
    place = F.when(kind == "workday", path("$.jobPostingInfo.location")).when(kind == "oracle", path("$.items[0].PrimaryLocation"))
    when = F.when(kind == "workday", path("$.jobPostingInfo.timeType"))
    head = F.concat_ws("\n", F.concat(F.lit("Location: "), _blank(place)), F.concat(F.lit("Time type: "), _blank(when)))
    head = F.when((kind == "workday") | (head != ""), F.concat(head, F.lit("\n\n"))).otherwise(empty)
    rows = once(rows, body=render(parts, lambda t: F.btrim(t, F.lit(fv.WS_CHARS)) != ""))
    return rows.select("job_id", "kind", F.when(F.col("body") != "", F.concat(head, "body")).alias("description_text"))


# ---- Markdown tables ------------------------------------------------------------------------------

_LINK = r"\[([^\]]*)\]\((https?://[^)\s]+)\)"
_HTML_LINK = r"(?i)<a\s[^>]*href=\"(https?://[^\"]+)\""
_HEADING = r"^#{1,6}\s+(.+?)\s*#*\s*$"


def clean_cell(c: Column) -> Column:
    t = F.regexp_replace(c, "<[^>]+>", " ")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", " ")
    t = F.regexp_replace(t, _LINK, "$1")
    t = F.replace(F.replace(t, F.lit("**"), F.lit("")), F.lit("&nbsp;"), F.lit(" "))
    return F.btrim(squeeze(F.regexp_replace(t, fv.SYMBOL_CLASS, " ")), F.lit(" -|"))


def _pick(header: Column, cells: Column, *names: str) -> Column:
    """First cell whose column name contains one of the names, names tried in order; '' if none."""
    tries = []
    for n in names:
        hits = F.transform(header, lambda h, i: F.when(h.contains(n) & (i < F.size(cells)), F.get(cells, i)))
        tries.append(F.get(F.filter(hits, lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(*tries, F.lit(""))


def read_markdown_tables(lines: DataFrame, default_term: str | None = None) -> DataFrame:
    """(feed, line_no, line) -> one posting per real link of each table row.

    State carried down the file - heading, table start, last company - is a forward fill over line numbers, done in bins,
    so even one enormous file spreads over tasks.
    """
    is_head, blank = F.col("line").rlike(_HEADING), F.trim("line") == ""
    rows = lines.select(
        "feed", "line_no", "line", (F.ltrim("line").startswith("|") & ~is_head).alias("in_table"),
        F.when(is_head, clean_cell(F.regexp_extract("line", _HEADING, 1))).alias("heading"),
        F.when(is_head | blank, F.col("line_no")).alias("block"))
    rows = forward_fill(rows, "feed", "line_no", ["heading", "block"]).where("in_table")
    bare = F.btrim(F.trim("line"), F.lit("|"))
    rows = rows.withColumn("cells", F.transform(F.split(bare, r"\|", -1), lambda t: F.trim(t))).withColumn("block", F.coalesce("block", F.lit(-1)))
    header = rows.groupBy("feed", "block").agg(F.min("line_no").alias("header_no"), F.min_by("cells", "line_no").alias("header"))
    rows = rows.join(header, ["feed", "block"]).where("line_no > header_no").withColumn("header", F.transform("header", F.lower))
    rows = rows.where(~F.forall("cells", lambda c: c.rlike("^[-: ]*$")))
    named = F.array_join("header", " ").contains("company")
    typed = clean_cell(_pick(F.col("header"), F.col("cells"), "company", "firm", "employer"))
    rows = rows.withColumn("typed", typed).withColumn("named", named)
    own = F.when(~F.col("typed").isin(fv.CONTINUATION_MARKS), F.col("typed")).when(~F.col("named"), _blank(F.col("heading")))
    rows = forward_fill(rows.withColumn("last_company", own), "feed", "line_no", ["last_company"])
    company = F.when(~F.col("typed").isin(fv.CONTINUATION_MARKS), F.col("typed")).when(F.col("named"), F.col("last_company")).otherwise(F.col("heading"))
    role = clean_cell(_pick(F.col("header"), F.col("cells"), "role", "title", "position", "job"))
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fv.ROLE_ABBREVIATIONS.items() for x in kv]), F.lower(role)), role)
    rows = rows.withColumns({"company": F.coalesce(company, F.lit("")), "role": role,
                             "location": clean_cell(_pick(F.col("header"), F.col("cells"), "location", "city"))})
    suffix = r"\s*\(([^()]{2,40})\)\s*$"
    same = F.lower(F.trim(F.regexp_extract("role", suffix, 1))) == F.lower(F.trim("company"))
    rows = rows.withColumn("role", F.when((F.col("company") != "") & same, F.rtrim(F.regexp_replace("role", suffix, ""))).otherwise(F.col("role")))
    flat = F.regexp_replace(F.regexp_replace("line", r"!\[[^\]]*\]\([^)]*\)", "Apply"), r"<img[^>]*>", "Apply")
    rows = rows.withColumn("flat", flat)
    md = F.arrays_zip(F.regexp_extract_all("flat", F.lit(_LINK), F.lit(1)).alias("text"), F.regexp_extract_all("flat", F.lit(_LINK), F.lit(2)).alias("href"))
    tags = F.transform(F.regexp_extract_all("flat", F.lit(_HTML_LINK), F.lit(1)), lambda u: F.struct(F.lit("").alias("text"), u.alias("href")))
    links = F.filter(F.concat(md, tags), lambda x: ~x["href"].rlike(fv.IMAGE_LINK) & ~x["href"].rlike(r"^https?://[^/?#]*/*(?:#.*)?$"))
    out = rows.where((F.col("company") != "") & (F.col("role") != "")).select("feed", "company", "role", "location", "heading", "line_no", F.explode(links).alias("l"))
    label = clean_cell(F.col("l.text"))
    plain = label.rlike(r"(?i)^[^\p{L}\p{N}_]*(?:apply|link|here|✅|🔒)?[^\p{L}\p{N}_]*$")
    title = F.concat("role", F.when((label != "") & (F.length(label) < 30) & ~plain, F.concat(F.lit(" ("), label, F.lit(")"))).otherwise(F.lit("")))
    return out.select(
        F.col("company").alias("company_name"), title.alias("title"), "location", F.col("l.href").alias("url"), F.concat(F.lit("readme:"), "feed").alias("source"),
        _none("external_id"), _none("posted_at", "date"), F.lit(True).alias("active"), F.lit(default_term or "").alias("terms_txt"), _none("sponsorship"), _none("description_text"))


# ---- all feeds, scorer output -----------------------------------------------------------------------

PAYLOAD = "feed string, company string, payload string"
LINES = "feed string, line_no bigint, line string"


@dataclass(frozen=True)
class Feed:
    """A kind of feed: how its landed rows become postings, and whether a fetch lists every open posting."""
    read: Callable[[DataFrame], DataFrame]
    complete_listing: bool
    landed: str = PAYLOAD


FEEDS: dict[str, Feed] = {}


def register_feed(name: str, read: Callable[[DataFrame], DataFrame], complete_listing: bool, landed: str = PAYLOAD) -> None:
    """Make a kind of feed known by name. ``read`` maps landed rows, of the schema ``landed``, to columns POSTING; it is made of
    DataFrame steps, so it serves batches and streams. A name is given once."""
    if name in FEEDS:
        raise ValueError(f"feed {name!r} is registered already")
    FEEDS[name] = Feed(read, complete_listing, landed)


def read_feed(spark: SparkSession, name: str, path: str, stream: bool = False) -> DataFrame:
    """Postings of the feed ``name`` from the folder its payloads land in, with kind and complete_listing."""
    feed = FEEDS[name]
    reader = (spark.readStream if stream else spark.read).schema(feed.landed)
    return feed.read(reader.parquet(path)).select(*POSTING, F.lit(name).alias("kind"), F.lit(feed.complete_listing).alias("complete_listing"))


def wanted(rows: DataFrame) -> DataFrame:
    """Rows with URL and title; complete listings keep internships only."""
    return rows.where((F.col("url") != "") & (F.col("title") != "") & (~F.col("complete_listing") | looks_like_internship(F.col("title"))))


def union_feeds(spark: SparkSession, landed: dict[str, str], stream: bool = False) -> DataFrame:
    """Feeds as one frame, from names and the folders they land in."""
    rows = functools.reduce(DataFrame.unionByName, [read_feed(spark, name, path, stream) for name, path in landed.items()])
    return wanted(rows).select(*POSTING)


for _name, _read, _complete in (("simplify", read_listing_feed, False), ("greenhouse", read_greenhouse, True), ("lever", read_lever, True), ("ashby", read_ashby, True)):
    register_feed(_name, _read, _complete)
register_feed("readme", read_markdown_tables, True, LINES)


EVALUATION = """struct<job_id:bigint,hard_reject_reason:string,skills_match:int,level_match:int,work_alignment:int,experience_quality:int,interest:int,
wildcard:boolean,red_flags:array<string>,fit_tags:array<string>,summary:string,application_deadline:string,confidence:int,_corrupt_record:string>"""
_SCORES = ["skills_match", "level_match", "work_alignment", "experience_quality", "interest", "confidence"]


def parse_scorer_output(rows: DataFrame) -> DataFrame:
    """(payload) -> typed rows with ``state``: ok, or bad for malformed JSON, a missing id or a score outside 0-100.
    Defaults fill what the scorer left out. Bad rows are kept for the quarantine output."""
    e = F.from_json("payload", EVALUATION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    r = rows.withColumn("e", e)
    filled = {c: F.coalesce(f"e.{c}", F.lit(50 if c == "confidence" else 0)).alias(c) for c in _SCORES}
    in_range = functools.reduce(lambda a, b: a & b, [F.coalesce(F.col(f"e.{c}").between(0, 100), F.lit(True)) for c in _SCORES])
    ok = F.col("e._corrupt_record").isNull() & F.col("e.job_id").isNotNull() & in_range
    none = F.array().cast("array<string>")
    return r.select(
        *rows.columns, F.when(ok, F.lit("ok")).otherwise(F.lit("bad")).alias("state"), F.col("e.job_id").alias("job_id"), *filled.values(),
        F.coalesce("e.wildcard", F.lit(False)).alias("wildcard"), F.coalesce("e.red_flags", none).alias("red_flags"),
        F.coalesce("e.fit_tags", none).alias("fit_tags"), F.coalesce("e.summary", F.lit("")).alias("summary"))


# ---- scorer batches: envelopes of records --------------------------------------------------------------

# field -> (kind, default); a record without an id is refused
EVALUATION_FIELDS = {
    "hard_reject_reason": ("text?", None), **{c: ("score", 50 if c == "confidence" else 0) for c in _SCORES}, "wildcard": ("flag", False), "wildcard_reason": ("text?", None),
    "red_flags": ("list", None), "fit_tags": ("list", None), "gap_tags": ("list", None), "summary": ("text", ""), "application_deadline": ("text?", None)}
TRIAGE_FIELDS = {"score": ("score", 100), "reason": ("text", "")}
ENVELOPES = {"evaluations": EVALUATION_FIELDS, "triages": TRIAGE_FIELDS}


def parse_scorer_batches(rows: DataFrame, envelope: str, payload: str = "payload") -> DataFrame:
    """Payloads ``{"<envelope>": [record, ...]}`` -> one row per record: the other columns of ``rows``, position, record (its JSON),
    verdict (NULL when the record is good), job_id and the envelope's fields.

    Every record is judged by itself, so a broken one does not cost its batch. Reasons: malformed and no_list for a whole payload (one
    row, no position), not_object, no_id, type:<field> and range:<field> for a record. Absent fields get their defaults; a
    field of the wrong type is an error, as is null where a value must be.
    """
    fields = ENVELOPES[envelope]
    keep = [c for c in rows.columns if c != payload]
    parsed = rows.withColumn("_v", F.try_parse_json(payload))
    parsed = parsed.withColumn("_l", F.try_variant_get("_v", f"$.{envelope}", "array<variant>"))
    whole = F.when(F.col("_v").isNull(), F.lit("malformed")).when(F.col("_l").isNull(), F.lit("no_list"))
    items = parsed.withColumn("_whole", whole).select(*keep, "_whole", F.posexplode_outer("_l").alias("position", "_r")).where("_whole IS NOT NULL OR position IS NOT NULL")
    is_object = F.schema_of_variant("_r").startswith("OBJECT")
    raw = {c: F.try_variant_get("_r", f"$.{c}", "variant") for c in ("job_id", *fields)}
    number = {c: F.try_variant_get("_r", f"$.{c}", "double") for c, (kind, _) in [("job_id", ("id", None)), *fields.items()] if kind in ("id", "score")}

    def value(c: str, kind: str, default) -> Column:
        if kind == "score":
            return F.coalesce(number[c].cast("int"), F.lit(default))
        if kind == "flag":
            return F.coalesce(F.try_variant_get("_r", f"$.{c}", "boolean"), F.lit(default))
        if kind == "list":
            return F.coalesce(F.try_variant_get("_r", f"$.{c}", "array<string>"), F.array().cast("array<string>"))
        return F.coalesce(F.try_variant_get("_r", f"$.{c}", "string"), F.lit(default))

    def wrong(c: str, kind: str) -> Column:
        given = raw[c].isNotNull()
        null = F.coalesce(F.is_variant_null(raw[c]), F.lit(False))
        shape = F.schema_of_variant(raw[c])
        if kind in ("id", "score"):
            return given & (null | number[c].isNull() | (number[c] != F.floor(number[c])))
        if kind == "flag":
            return given & (null | F.try_variant_get("_r", f"$.{c}", "boolean").isNull())
        if kind == "list":
            return given & (null | ~shape.startswith("ARRAY") | F.try_variant_get("_r", f"$.{c}", "array<string>").isNull())
        return given & ~null & (shape != "STRING") if kind == "text?" else given & (null | (shape != "STRING"))

    reason = F.when(F.col("_whole").isNotNull(), F.col("_whole")).when(~F.coalesce(is_object, F.lit(False)), F.lit("not_object"))
    reason = reason.when(raw["job_id"].isNull() | wrong("job_id", "id"), F.lit("no_id"))
    for c, (kind, _) in fields.items():
        reason = reason.when(wrong(c, kind), F.lit(f"type:{c}"))
    for c, (kind, _) in fields.items():
        if kind == "score":
            reason = reason.when(~F.coalesce(number[c].between(0, 100), F.lit(True)), F.lit(f"range:{c}"))
    return items.select(*keep, F.col("position").cast("int").alias("position"), F.to_json("_r").alias("record"), reason.alias("verdict"),
                        number["job_id"].cast("bigint").alias("job_id"), *[value(c, kind, default).alias(c) for c, (kind, default) in fields.items()])


def quarantined(records: DataFrame) -> DataFrame:
    """Refused records with what is needed to look into them or to try them again."""
    fixed = [c for c in records.columns if c not in {"verdict", "record", "job_id", *EVALUATION_FIELDS, *TRIAGE_FIELDS}]
    return records.where(F.col("verdict").isNotNull()).select(*fixed, "verdict", "record")
