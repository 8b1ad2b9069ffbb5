"""Decorated rows, browse filters, dashboard and digest."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.config import Settings
from siftwork.functions import dates, fixed_values as fv, roles, terms
from siftwork.functions.plan import once
from siftwork.functions.text import slug


def bullets(summary: Column) -> Column:
    """Bullet texts when every non-blank line is a bullet, else an empty array."""
    lines = F.filter(F.transform(F.split(F.coalesce(summary, F.lit("")), "\n"), lambda t: F.trim(t)), lambda x: x != "")
    ok = (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike("^[-•*] "))
    return F.when(ok, F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "(?s)^..", "")))).otherwise(F.array().cast("array<string>"))


def scorer_class(model: Column) -> Column:
    return roles.literal_map(F.coalesce(model, F.lit("")), {"prefilter": "rules", "triage": "triage", "local": "fast"}, F.lit("deep"))


def is_new(created_at: Column, s: Settings) -> Column:
    return created_at >= dates.at(s.as_of) - F.expr(f"INTERVAL {fv.NEW_WINDOW_HOURS} HOURS")


def decorate(s: Settings, rows: DataFrame) -> DataFrame:
    """Add scorer class, role and label, tags, unread flag, term track, novelty and days until the deadline."""
    tags = F.from_json(F.get_json_object("raw", "$.fit_tags"), "array<string>")
    rows = rows.withColumns({
        "src": scorer_class(F.col("model")), "fit_tags": F.coalesce(F.array_join(tags, "|"), F.lit("")),
        "unread": F.coalesce(F.get_json_object("raw", "$.description_unavailable") == "true", F.lit(False)),
        "is_new": F.coalesce(is_new(F.col("created_at"), s), F.lit(False)),
        "bullets": F.array_join(bullets(F.col("summary")), "|"),
    })
    rows = once(rows, track=terms.term_track(s, F.col("title"), terms.split_terms(F.col("terms_txt"))))
    rows = once(rows, role=F.coalesce(
        F.get_json_object("raw", "$.fast.role"),
        roles.classify(s, F.col("title"), F.col("company_name"), F.replace("fit_tags", F.lit("|"), F.lit(" | ")), F.col("summary"))))
    return rows.withColumn("role_label", roles.role_label(s, F.col("role")))


def with_due_days(s: Settings, rows: DataFrame) -> DataFrame:
    return rows.withColumn("due_days", F.datediff("deadline", F.to_date(dates.at(s.as_of))))


def browse(rows: DataFrame, *, bucket: str = "all", status: str = "new", term: str = "all", role: str = "all", q: str = "",
           unread: bool = False, src: str = "all", watched: DataFrame | None = None) -> DataFrame:
    """The browse page's filters. ``watched`` is a frame of watched company slugs (semi join)."""
    if status != "all":
        rows = rows.where(F.col("app_status") == status)
    if src == "fast":
        rows = rows.where(F.col("src").isin("fast", "triage"))
    elif src == "deep":
        rows = rows.where(F.col("src") == "deep")
    if bucket != "all":
        rows = rows.where(F.col("bucket") == bucket)
    rows = rows.where(terms.in_track(F.col("track"), term))
    if role != "all":
        rows = rows.where(F.col("role") == role)
    if unread:
        rows = rows.where("unread")
    if watched is not None:
        rows = rows.withColumn("_slug", slug(F.col("company_name"))).join(watched.select(F.col("slug").alias("_slug")), "_slug", "left_semi").drop("_slug")
    if q:
        needle = q.strip().lower()
        rows = rows.where(F.lower("company_name").contains(needle) | F.lower("title").contains(needle) | F.lower("location").contains(needle))
    return rows


def facet_counts(s: Settings, rows: DataFrame, *, bucket: str, src: str, term: str) -> DataFrame:
    """Counts per facet value, each facet under the filters that precede it (class, bucket, track, role), in one
    aggregation: every row emits the few (facet, value) pairs it counts for, and counts combine map-side."""
    in_src = F.lit(True) if src == "all" else (F.col("src").isin("fast", "triage") if src == "fast" else F.col("src") == src)
    in_term = terms.in_track(F.col("track"), term)
    in_bucket = F.lit(True) if bucket == "all" else F.col("bucket") == bucket
    pairs: list[tuple[Column, str, Column]] = [
        (F.lit(True), "src", F.lit("all")), (F.col("src").isin("fast", "triage"), "src", F.lit("fast")), (F.col("src") == "deep", "src", F.lit("deep")),
        (in_src & in_term, "bucket", F.col("bucket"))]
    pairs += [(in_src & in_bucket & terms.in_track(F.col("track"), t), "term", F.lit(t)) for t in ("all", "primary", "alt")]
    pairs += [(in_src & in_bucket & in_term, "role", F.lit("all")), (in_src & in_bucket & in_term, "role", F.col("role"))]
    emitted = F.filter(F.array(*[F.when(c, F.struct(F.lit(f).alias("facet"), v.alias("value"))) for c, f, v in pairs]), lambda x: x.isNotNull())
    return rows.select(F.explode(emitted).alias("e")).groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def bucket_key(rows: DataFrame) -> DataFrame:
    """Sort keys of a bucket: likely by product, wildcard by interest, anything else by desirability then likelihood."""
    zero = F.lit(0)
    lik, des = F.coalesce("likelihood", zero), F.coalesce("desirability", zero)
    return rows.withColumns({
        "key1": F.when(F.col("bucket") == "likely", lik * des).when(F.col("bucket") == "wildcard", F.coalesce("interest", zero)).otherwise(des),
        "key2": F.when(F.col("bucket").isin("likely", "wildcard"), zero).otherwise(lik)})


def section_rank(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Rank within bucket, newly scored first, capped per section. The cap is the feature (a top-k report); the rank
    filter lets Spark keep only the top rows per task before the shuffle."""
    w = Window.partitionBy("bucket").orderBy(F.desc("is_new"), F.desc("key1"), F.desc("key2"), F.asc("job_id"))
    out = bucket_key(rows.where(F.col("bucket").isin(*caps))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(caps.values()))
    return out.where(F.col("rank") <= roles.literal_map(F.col("bucket"), caps, F.lit(0)))


def table_line(rows: DataFrame) -> Column:
    """One Markdown table row of the digest."""
    def safe(c):
        return F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/"))
    note = F.concat(F.replace(F.coalesce("summary", F.lit("")), F.lit("\n"), F.lit(" ")),
                    F.when(F.col("fit_tags") != "", F.concat(F.lit(" · ✓ "), F.replace("fit_tags", F.lit("|"), F.lit(", ")))).otherwise(F.lit("")))
    place = F.concat(safe(F.col("location")), F.coalesce(F.concat(F.lit(" · due "), F.col("deadline").cast("string")), F.lit("")))
    return F.concat(
        F.lit("| "), F.col("job_id").cast("string"), F.lit(" | "), F.when(F.col("is_new"), F.lit("🆕 ")).otherwise(F.lit("")), F.lit("**"),
        F.col("company_name"), F.lit("** | ["), safe(F.col("title")), F.lit("]("), F.col("canonical_url"), F.lit(")"),
        F.when(F.col("unread"), F.lit(" ⚠ **unread — check manually**")).otherwise(F.lit("")), F.lit(" | "), place, F.lit(" | "),
        F.col("likelihood").cast("string"), F.lit(" | "), F.col("desirability").cast("string"), F.lit(" | "),
        F.coalesce(F.col("interest").cast("string"), F.lit("")), F.lit(" | "), note, F.lit(" |"))


def section_frame(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """(section, rank, line): the heading of each section with its size (rank 0) and, if its report is capped, how many rows
    are left out (after the last rank). ``rows`` has a section per row; sections without rows get no line."""
    sizes = rows.groupBy("section").agg(F.count("*").alias("n"))
    cap = roles.literal_map(F.col("section"), caps, F.lit(None).cast("int"))
    n = F.col("n")
    head = F.struct(F.lit(0).cast("bigint").alias("rank"), F.concat(F.lit("## "), "section", F.lit(" ("), n.cast("string"), F.lit(")")).alias("line"))
    more = F.when(n > cap, F.struct((cap + 1).cast("bigint").alias("rank"), F.concat(F.lit("_"), (n - cap).cast("string"), F.lit(" more not shown_")).alias("line")))
    return sizes.select("section", F.explode(F.array_compact(F.array(head, more))).alias("x")).select("section", "x.*")


def header_line(s: Settings, shown: DataFrame) -> DataFrame:
    """(section, rank, line): terms, rubric, profile and the number of newly scored rows among those shown."""
    text = f"Terms: {' / '.join([s.term, *s.term_also_accept])}; rubric {s.rubric}; profile {s.profile}; newly scored: "
    return shown.agg(F.count_if("is_new").alias("n")).select(F.lit("header").alias("section"), F.lit(0).cast("bigint").alias("rank"), F.concat(F.lit(text), F.col("n").cast("string")).alias("line"))


def proposal_line() -> Column:
    """One proposed company: slug, name, tier, fit, reputation, source and the first line of its rationale."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    why = F.substring(F.substring_index(F.coalesce("rationale", F.lit("")), "\n", 1), 1, 160)
    return F.concat(F.lit("- `"), "slug", F.lit("` **"), "name", F.lit("** (tier "), shown("tier"), F.lit(", fit "), shown("fit"), F.lit(", rep "), shown("reputation"), F.lit("; via "), "source", F.lit(") — "), why)
