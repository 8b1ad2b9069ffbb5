"""Upserts and reconciliation. A table is an immutable snapshot; a merge reads one and writes the next."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.config import Settings
from siftwork.functions import dates, fixed_values as fv, scoring
from siftwork.functions.text import canonical_url, dedup_key, slug, text_hash
from siftwork.session import cut_lineage, scratch_dir


def keyed_rows(postings: DataFrame) -> DataFrame:
    """Add dedup_key, curl (canonical URL) and description_hash."""
    return postings.withColumns({
        "dedup_key": dedup_key(F.col("company_name"), F.col("title"), F.col("location")),
        "curl": canonical_url(F.col("url")), "description_hash": text_hash(F.col("description_text"))})


def match_existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Add match_id and how: by dedup key, else by canonical URL. Two equi joins instead of one OR join."""
    by_key = stored.select("dedup_key", F.col("job_id").alias("_k"))
    by_url = stored.where("curl <> ''").groupBy("curl").agg(F.min("job_id").alias("_u"))
    url = F.when(F.col("curl") != "", F.col("curl"))      # rows without a URL look for none
    out = incoming.join(by_key, "dedup_key", "left").withColumn("_c", url).join(by_url.withColumnRenamed("curl", "_c"), "_c", "left").drop("_c")
    how = F.when(F.col("_k").isNotNull(), F.lit("key")).when(F.col("_u").isNotNull(), F.lit("url"))
    return out.withColumns({"match_id": F.coalesce("_k", "_u"), "how": how}).drop("_k", "_u")


def deactivate_missing(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Active postings of completely listed sources that a fetch no longer shows. A source that returned fewer than
    five rows is an outage, not a mass closure. Per-source counts are combined before the join."""
    enough = seen.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= fv.DEACTIVATE_MIN_ROWS).select("source")
    gone = stored.where("active").join(seen.select("job_id"), "job_id", "left_anti")
    return gone.join(enough, "source", "left_semi").select("job_id", "source")


def attach_scores(s: Settings, queue: DataFrame, external: DataFrame) -> DataFrame:
    rows = queue.join(external, "job_id", "left")
    low = F.col("score") < s.triage_min_score
    return rows.select(
        "job_id", "eval_seq", "score",
        F.when(F.col("score").isNull(), F.lit("deferred")).when(low, F.lit("rejected")).otherwise(F.lit("scored")).alias("outcome"),
        F.when(low, F.concat(F.lit("triage: scored low ("), F.col("score").cast("string"), F.lit(")"))).alias("hard_reject_reason"),
        F.when(~low, scoring.blend(s, F.col("likelihood"), F.col("score"))).alias("final"))


# ---- postings ------------------------------------------------------------------------------------

def resolve(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Add target and inserted: the posting that each row of an ordered batch (by job_id) belongs to.

    Rows apply one after another: a row belongs to the posting of its key, stored or inserted by an earlier row, else to the
    posting with its canonical URL, stored or inserted earlier, else it is inserted. A row is thus inserted iff no row
    inserted before it has its key or its URL: a greedy matching in row order. It is found in rounds: among the open rows
    those that are first of their key and of their URL are inserted, and rows that share either with them are settled. Only
    ids and hashes take part, a hot key or URL settles in one round, and rounds follow the longest chain of rows that
    wait for each other, not the number of rows.
    """
    spark = incoming.sparkSession
    root = scratch_dir(spark, "resolve")

    def stored_as(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    pair = [F.xxhash64("dedup_key", F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), "dedup_key").alias("k2")]
    link = [F.when(F.col("curl") != "", F.xxhash64("curl", F.lit(1))).alias("u1"), F.when(F.col("curl") != "", F.xxhash64(F.lit(2), "curl")).alias("u2")]
    found = match_existing(incoming.select("job_id", "dedup_key", "curl"), stored)
    rows = stored_as(found.select("job_id", *pair, *link, "match_id", "how"), "rows")
    # rows of one key and one URL stand or fall with their first
    left = rows.where("match_id IS NULL").groupBy("k1", "k2", "u1", "u2").agg(F.min("job_id").alias("job_id"))
    left, done, step = stored_as(left, "open-0"), None, 0
    while not left.isEmpty():
        by_key = left.groupBy("k1", "k2").agg(F.min("job_id").alias("job_id"))
        by_url = left.where("u1 IS NOT NULL").groupBy("u1", "u2").agg(F.min("job_id").alias("job_id"))
        first = left.join(by_key.select("job_id"), "job_id", "left_semi")
        won = first.where("u1 IS NULL").unionByName(first.where("u1 IS NOT NULL").join(by_url.select("job_id"), "job_id", "left_semi"))
        won = stored_as(won, f"won-{step}")
        left = left.join(won.select("k1", "k2"), ["k1", "k2"], "left_anti").join(won.select("u1", "u2"), ["u1", "u2"], "left_anti")
        step += 1
        left = stored_as(left, f"open-{step}")
        done = won if done is None else done.unionByName(won)
    done = left if done is None else stored_as(done, "won")
    own_key = done.select("k1", "k2", F.col("job_id").alias("key_id"))
    own_url = done.where("u1 IS NOT NULL").select("u1", "u2", F.col("job_id").alias("url_id"))
    late = lambda c: F.when(F.col(c) <= F.col("job_id"), F.col(c))
    target = F.coalesce(F.when(F.col("how") == "key", F.col("match_id")), late("key_id"), F.col("match_id"), late("url_id"))
    placed = rows.join(own_key, ["k1", "k2"], "left").join(own_url, ["u1", "u2"], "left").select("job_id", target.alias("target"))
    new = done.select("job_id", F.lit(True).alias("inserted"))
    placed = stored_as(placed.join(new, "job_id", "left").withColumn("inserted", F.coalesce("inserted", F.lit(False))), "placed")
    return incoming.join(placed, "job_id")


_POSTING = ["dedup_key", "curl", "company_name", "title", "location", "url", "company_id", "source", "terms_txt", "sponsorship", "description_text", "description_hash", "deadline", "active"]
_FIRST = {"external_id": "string", "posted_at": "date"}          # set when a posting is inserted, never changed


def upsert_postings(stored: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Merge an ordered batch of postings into a snapshot and return the new snapshot.

    The batch applies in job_id order, see ``resolve``. Folding updates in order reduces to min_by/max_by per field
    (first non-empty fill, last state, first or last text), so a posting reported by a third of all rows costs one partial
    row per task, never a sorted group. external_id and posted_at are those of the inserting row; first_seen_at and
    last_seen_at are ``as_of`` for inserted and for touched postings. A stored deadline and a pending re-evaluation stay
    until something else clears them. Columns that a stored snapshot lacks are worked out or null.
    """
    for c, kind in _FIRST.items():
        incoming = incoming if c in incoming.columns else incoming.withColumn(c, F.lit(None).cast(kind))
        stored = stored if c in stored.columns else stored.withColumn(c, F.lit(None).cast(kind))
    for c in ("first_seen_at", "last_seen_at"):
        stored = stored if c in stored.columns else stored.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    if "deadline" not in stored.columns:
        stored = stored.withColumn("deadline", dates.deadline(F.col("description_text"), as_of))
    now = as_of.cast("timestamp_ntz")
    inc = resolve(incoming.withColumn("deadline", dates.deadline(F.col("description_text"), as_of)), stored)
    inc = cut_lineage(inc)                  # the staged batch: keys, target and deadline are worked out once
    base_new = inc.where("inserted").select("job_id", *_POSTING, *_FIRST, now.alias("first_seen_at"), now.alias("last_seen_at"), F.lit(True).alias("is_new"), F.lit(False).alias("pending"))
    pending = F.coalesce(F.col("needs_reeval"), F.lit(False)) if "needs_reeval" in stored.columns else F.lit(False)
    base = stored.select("job_id", *_POSTING, *_FIRST, "first_seen_at", "last_seen_at", F.lit(False).alias("is_new"), pending.alias("pending")).unionByName(base_new)

    upd = inc.where(~F.col("inserted")).join(base.select(F.col("job_id").alias("target"), F.col("source").alias("base_source")), "target")
    at = F.col("job_id")
    has_text = F.coalesce(F.col("description_text") != "", F.lit(False))
    same = has_text & (F.col("source") == F.col("base_source"))
    text = F.struct("description_text", "description_hash", "deadline")
    agg = upd.groupBy("target").agg(
        F.min_by("company_id", F.when(F.col("company_id").isNotNull(), at)).alias("company_fill"),
        F.min_by("terms_txt", F.when(F.col("terms_txt") != "", at)).alias("terms_fill"),
        F.min_by("sponsorship", F.when(F.col("sponsorship") != "", at)).alias("sponsor_fill"),
        F.max_by("active", at).alias("active_last"),
        F.min_by(text, F.when(has_text, at)).alias("first_text"), F.max_by(text, F.when(same, at)).alias("last_same"),
        F.min(F.when(same, F.col("description_hash"))).alias("low_hash"), F.max(F.when(same, F.col("description_hash"))).alias("high_hash"),
        F.min_by("deadline", F.when(same & F.col("deadline").isNotNull(), at)).alias("same_deadline"))
    b, a = base.alias("b"), agg.alias("a")
    j = b.join(a, F.col("b.job_id") == F.col("a.target"), "left")
    open_text = F.col("b.description_hash").isNull()
    new_text = F.coalesce(F.col("a.last_same"), F.when(open_text, F.col("a.first_text")))
    start_hash = F.coalesce(F.col("b.description_hash"), F.col("a.first_text.description_hash"))
    touched = F.col("a.target").isNotNull()
    return j.select(
        F.col("b.job_id"), F.col("b.is_new"), F.col("b.dedup_key"), F.col("b.curl"), F.col("b.company_name"), F.col("b.title"), F.col("b.location"), F.col("b.url"), F.col("b.source"),
        F.coalesce("b.company_id", "a.company_fill").alias("company_id"),
        F.when(F.coalesce(F.col("b.terms_txt"), F.lit("")) != "", F.col("b.terms_txt")).otherwise(F.coalesce("a.terms_fill", "b.terms_txt")).alias("terms_txt"),
        F.coalesce("b.sponsorship", "a.sponsor_fill").alias("sponsorship"), F.coalesce("a.active_last", "b.active").alias("active"),
        F.coalesce(new_text["description_text"], F.col("b.description_text")).alias("description_text"),
        F.coalesce(new_text["description_hash"], F.col("b.description_hash")).alias("description_hash"),
        F.coalesce(F.col("b.deadline"), F.when(open_text, F.col("a.first_text.deadline")), F.col("a.same_deadline")).alias("deadline"),
        (F.col("b.pending") | F.coalesce((F.col("a.low_hash") != start_hash) | (F.col("a.high_hash") != start_hash), F.lit(False))).alias("needs_reeval"),
        *[F.col(f"b.{c}") for c in _FIRST], F.col("b.first_seen_at"), F.when(touched, now).otherwise(F.col("b.last_seen_at")).alias("last_seen_at"), touched.alias("touched"))


def posting_urls(resolved: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(job_id, url): every spelling under which a posting was reported, from the rows of ``resolve`` and the ``known`` ones.
    An inserting row adds its URL and its canonical form, later rows add theirs."""
    given = resolved.select(F.col("target").alias("job_id"), "url")
    own = resolved.where(F.col("inserted")).select("job_id", F.col("curl").alias("url"))
    rows = given.unionByName(own)
    return (rows if known is None else rows.unionByName(known.select("job_id", "url"))).distinct()


def ingest_stats(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per source: postings seen, postings inserted, postings deactivated."""
    m = cut_lineage(resolve(incoming, stored).select("job_id", "source", "target", "inserted"))
    seen = m.groupBy("source").agg(F.count("*").alias("seen"))
    new = m.where("inserted").groupBy("source").agg(F.count("*").alias("new"))
    hit = m.where("NOT inserted").select(F.col("target").alias("job_id"), "source")
    gone = deactivate_missing(stored, m.select("job_id", "source").unionByName(hit)).groupBy("source").agg(F.count("*").alias("deactivated"))
    zero = F.lit(0)
    return seen.join(new, "source", "left").join(gone, "source", "left").select(
        "source", "seen", F.coalesce("new", zero).alias("new"), F.coalesce("deactivated", zero).alias("deactivated"))


def mark_fetch_failures(postings: DataFrame) -> DataFrame:
    """Raise the failure counter kept in the row's JSON map; other keys stay."""
    raw = F.coalesce(F.from_json("raw", "map<string,string>"), F.create_map().cast("map<string,string>"))
    n = F.coalesce(F.try_element_at(raw, F.lit("fetch_failures")).try_cast("int"), F.lit(0)) + 1
    kept = F.map_filter(raw, lambda k, v: k != "fetch_failures")
    return postings.select("job_id", F.to_json(F.map_concat(kept, F.create_map(F.lit("fetch_failures"), n.cast("string")))).alias("raw"),
                           n.alias("failures"), (n >= fv.FETCH_GIVE_UP).alias("given_up"))


# ---- companies, feeds, applications -----------------------------------------------------------------

def upsert_companies(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """Non-null fields win; a proposal never demotes an approved or rejected company."""
    a, b = stored.alias("a"), proposed.alias("b")
    j = a.join(b, F.col("a.slug") == F.col("b.slug"), "full")
    known, touched = F.col("a.slug").isNotNull(), F.col("b.slug").isNotNull()
    may = (F.col("b.status") == "approved") | ~F.col("a.status").isin("approved", "rejected")
    status = F.when(~known, F.col("b.status")).when(touched & may, F.col("b.status")).otherwise(F.col("a.status"))
    return j.select(
        F.coalesce("a.slug", "b.slug").alias("slug"), F.coalesce("a.name", "b.name").alias("name"), F.coalesce("a.source", "b.source").alias("source"),
        status.alias("status"), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("tier", "reputation", "ats_type", "ats_token")])


def health_columns() -> list[Column]:
    """status, last_rows and last_checked of a feed, aggregated from its polls."""
    when = F.struct("at", "seq")
    good = (F.col("outcome") == "ok") & (F.col("rows") >= fv.FEED_MIN_ROWS)
    gone = ((F.col("outcome") == "http") & F.col("code").isin(fv.FEED_GONE_STATUS)) | (F.col("outcome") == "unparsable")
    verdict = F.when(good, F.lit("active")).when(gone, F.lit("broken"))
    status = F.when(F.bool_or(F.col("outcome") == "disabled"), F.lit("disabled")).otherwise(
        F.coalesce(F.max_by(verdict, F.when(verdict.isNotNull(), when)), F.lit("active")))
    return [status.alias("status"), F.max_by("rows", F.when(F.col("outcome") == "ok", when)).alias("last_rows"), F.max("at").alias("last_checked")]


def feed_health(polls: DataFrame) -> DataFrame:
    """Feed state after an ordered log of polls (feed, at, seq, outcome, rows, code).

    Disabled is final; a success with enough rows means active, a gone/unparsable feed means broken, and neither a
    network error nor a thin success changes anything. So the final state is that of the last deciding event: a plain
    aggregate instead of a fold over a feed's whole history.
    """
    return polls.groupBy("feed").agg(*health_columns())


def probe_feeds(candidates: DataFrame, known: DataFrame, days_since_search: int | None) -> DataFrame:
    """Classify probed candidates: listing feed, table feed, or broken with a reason. Known feeds are skipped, and the
    whole search is skipped within a week of the last one."""
    if days_since_search is not None and days_since_search < fv.FEED_SEARCH_EVERY_DAYS:
        candidates = candidates.limit(0)
    c = candidates.join(known, "repo", "left_anti")
    kind = F.when(F.coalesce("listing_rows", F.lit(0)) > 0, F.lit("simplify")).when(F.coalesce("table_rows", F.lit(0)) >= fv.FEED_MIN_ROWS, F.lit("readme"))
    n = F.when(F.coalesce("listing_rows", F.lit(0)) > 0, F.col("listing_rows")).otherwise(F.coalesce("table_rows", F.lit(0)))
    return c.select("repo", kind.alias("kind"), F.when(kind.isNotNull(), F.lit("active")).otherwise(F.lit("broken")).alias("status"), n.alias("rows"),
                    F.when(kind.isNull(), F.coalesce("error", F.concat(F.lit("only "), n.cast("string"), F.lit(" parsable postings")))).alias("error"))


# ---- evaluations ---------------------------------------------------------------------------------

def fresh_reasons(s: Settings, postings: DataFrame) -> DataFrame:
    """(job_id, reason): the rules re-run once per active posting."""
    from siftwork.operators.scores import with_reason
    return with_reason(s, postings.where("active")).select("job_id", "reason")


def reprefilter(s: Settings, evals: DataFrame, reasons: DataFrame, deep: bool = False) -> DataFrame:
    """Scored rows the rules now reject. Full-rubric rows only on request."""
    rows = evals.where((F.col("profile_hash") == s.profile) & F.col("hard_reject_reason").isNull())
    if not deep:
        rows = rows.where(F.col("model").isin("local", "triage"))
    return rows.join(reasons.where("reason IS NOT NULL"), "job_id").select("job_id", "eval_seq", "model", "reason")


def unreject_stale(s: Settings, evals: DataFrame, reasons: DataFrame) -> DataFrame:
    """Rule rejects whose reason no longer holds: ``freed`` rows are deleted (pending again), others re-labelled."""
    rows = evals.where((F.col("profile_hash") == s.profile) & (F.col("model") == "prefilter")).join(reasons, "job_id")
    rows = rows.where(~F.col("reason").eqNullSafe(F.col("hard_reject_reason")))
    return rows.select("job_id", "eval_seq", F.col("hard_reject_reason").alias("old_reason"), "reason",
                       F.when(F.col("reason").isNull(), F.lit("freed")).otherwise(F.lit("updated")).alias("action"))


def apply_unreject(evals: DataFrame, changes: DataFrame) -> DataFrame:
    """The evaluation table after ``unreject_stale``."""
    c = changes.select("eval_seq", F.col("reason").alias("_r"), F.col("action").alias("_a"))
    out = evals.join(c, "eval_seq", "left").where("_a IS NULL OR _a <> 'freed'")
    return out.withColumn("hard_reject_reason", F.when(F.col("_a") == "updated", F.col("_r")).otherwise(F.col("hard_reject_reason"))).drop("_r", "_a")


def reconcile_counts(rejects: DataFrame, changes: DataFrame) -> DataFrame:
    label = F.when(F.col("reason").isNull(), F.concat(F.lit("freed: "), F.col("old_reason"))).otherwise(F.concat_ws(" -> ", "old_reason", "reason"))
    return rejects.select(F.col("reason").alias("change")).unionByName(changes.select(label.alias("change"))).groupBy("change").agg(F.count("*").alias("n"))


def propose_companies(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies to propose from good postings nobody is linked to yet, one per slug."""
    from siftwork.operators.ranking import first_per_key
    good = rows.where(F.col("bucket").isin("likely", "reach") & F.col("company_id").isNull()).select(
        slug(F.col("company_name")).alias("slug"), F.col("company_name").alias("name"), "job_id",
        F.concat(F.lit("Posted a "), F.col("bucket"), F.lit(" job: "), F.col("title")).alias("rationale"))
    first = first_per_key(good, ["slug"], [("job_id", "asc")])
    return first.join(companies.select("slug"), "slug", "left_anti").select("slug", "name", "rationale", F.lit("proposed").alias("status"))


def watchlist_changes(changes: DataFrame, companies: DataFrame, directory: DataFrame, postings: DataFrame) -> DataFrame:
    """Apply add / add_known / remove requests (request, action, value): outcome, company slug and new status."""
    from siftwork.operators.companies import parse_directory, slug_index
    idx = slug_index(directory)
    key = F.when(F.col("action") == "add_known", slug(F.col("value"))).otherwise(F.col("value"))
    c = changes.withColumn("k", key).join(idx.select(F.col("alias").alias("k"), "entry"), "k", "left")
    names = parse_directory(directory).select(F.col("slug").alias("entry"), F.explode("slugs").alias("alias"))
    by_slug = names.join(companies.select(F.col("slug").alias("alias")), "alias").groupBy("entry").agg(
        F.min_by("alias", F.struct((F.col("alias") != F.col("entry")).alias("a"), F.col("alias").alias("b"))).alias("row_slug"))
    boards = directory.where("ats_token <> ''").select(F.col("slug").alias("entry"), "ats_type", F.lower("ats_token").alias("_t"))
    by_board = boards.join(companies.select("ats_type", F.lower("ats_token").alias("_t"), F.col("slug").alias("board_slug")), ["ats_type", "_t"]).groupBy(
        "entry").agg(F.min("board_slug").alias("board_slug"))
    spelled = postings.select(F.col("company_name").alias("value")).distinct().withColumn("spelled", F.lit(True))
    own = companies.select(F.col("slug").alias("k"), F.lit(True).alias("exists"))
    c = c.join(by_slug, "entry", "left").join(by_board, "entry", "left").join(spelled, "value", "left").join(own, "k", "left")
    in_directory = F.col("entry").isNotNull()
    target = F.coalesce("row_slug", "board_slug", "entry")
    adding = F.col("action").isin("add", "add_known")
    outcome = (F.when(adding & in_directory, F.lit("approved")).when((F.col("action") == "add_known") & F.coalesce("spelled", F.lit(False)), F.lit("approved"))
               .when(adding, F.lit("not_found")).when(F.coalesce("exists", F.lit(False)), F.lit("paused")).otherwise(F.lit("missing")))
    return c.select("request", "action", outcome.alias("outcome"), F.when(outcome.isin("approved", "paused"), F.when(adding & in_directory, target).otherwise(F.col("k"))).alias("slug"))
