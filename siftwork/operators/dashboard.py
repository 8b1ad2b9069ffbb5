"""Counts shown on the status, home and header panels. Each panel is one aggregation per input table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.config import Settings
from siftwork.functions import fixed_values as fv, scoring
from siftwork.operators import queues, versions

FUNNEL = ["unscored", "rules", "local_no", "local_ambiguous", "local_yes", "triage", "deep"]


def melt(row: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One wide row -> (metric, value) rows."""
    cols = columns or row.columns
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in cols])).alias("m")).select("m.*")


def counts_with_zeros(rows: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """Count per class, missing classes as 0, from one conditional aggregate."""
    wide = rows.agg(*[F.count_if(F.col(key) == c).alias(c) for c in classes])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias(key), F.col(c).alias("n")) for c in classes])).alias("m")).select("m.*")


def funnel_class(model: Column, raw: Column) -> Column:
    return (F.when(model.isNull(), F.lit("unscored")).when(model == "prefilter", F.lit("rules")).when(model == "triage", F.lit("triage"))
            .when(model == "local", F.concat(F.lit("local_"), F.coalesce(queues.json_band(raw), F.lit("no")))).otherwise(F.lit("deep")))


def funnel(postings: DataFrame, evals: DataFrame, profile: str) -> DataFrame:
    """Every active posting once, by its latest evaluation."""
    latest = versions.latest_by_seq(evals.select("job_id", "eval_seq", "profile_hash", "model", "raw"), profile).drop("profile_hash")
    rows = postings.where("active").select("job_id").join(latest, "job_id", "left")
    return counts_with_zeros(rows.select(funnel_class(F.col("model"), F.col("raw")).alias("stage")), "stage", FUNNEL)


def tokens_since(runs: DataFrame, cap: int) -> DataFrame:
    """Spend of the trailing day and week up to the newest run, and the level against a weekly cap."""
    now = runs.agg(F.max("started_at").alias("now"))
    rows = runs.crossJoin(F.broadcast(now))
    def within(days):
        return F.coalesce(F.sum(F.when(F.col("started_at") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS"), F.col("tokens"))), F.lit(0))
    out = rows.agg(within(7).alias("week"), within(1).alias("day"), F.coalesce(F.sum(F.when(
        (F.col("started_at") >= F.col("now") - F.expr("INTERVAL 7 DAYS")) & (F.col("kind") == "discover"), F.col("tokens"))), F.lit(0)).alias("week_discover"))
    if not cap:
        return out.withColumns({"pct": F.lit(0), "level": F.lit("ok")})
    return out.withColumns({
        "pct": F.least(F.lit(100), F.bround(F.lit(100.0) * F.col("week") / cap).cast("int")),
        "level": F.when(F.col("week") >= cap, F.lit("over")).when(F.col("week") >= 0.75 * cap, F.lit("high")).otherwise(F.lit("ok"))})


def calibration(scored: DataFrame, label: str = "bucket") -> DataFrame:
    """Label x local band counts."""
    return scored.groupBy(label).agg(*[F.count_if(F.col("band") == b).alias(b) for b in ("yes", "ambiguous", "no")])


RECALL_AT = [10, 20, 25, 30, 32, 35, 40, 45, 50]


def recall_curve(scored: DataFrame, label: str = "bucket") -> DataFrame:
    """Share of wanted rows scoring strictly above each threshold, all thresholds in one pass."""
    pos = scored.where(F.col(label).isin("likely", "reach"))
    wide = pos.agg(*[F.coalesce(F.avg((F.col("score") > t).cast("int")), F.lit(0.0)).alias(str(t)) for t in RECALL_AT])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(F.col(f"`{t}`"), 6).alias("recall")) for t in RECALL_AT])).alias("m")).select("m.*")


def run_stats(fast_rows: DataFrame) -> DataFrame:
    """Counters of one scoring run, from the rows it produced."""
    local = F.col("model") == "local"
    cols = [F.count("*").alias("pending"), F.count_if(F.col("model") == "prefilter").alias("hard_rejected"), F.count_if(local).alias("scored_local")]
    cols += [F.count_if(local & (F.col("band") == b)).alias(f"band_{b}") for b in ("yes", "no", "ambiguous")]
    cols += [F.count_if(local & (F.col("bucket") == b)).alias(f"bucket_{b}") for b in fv.BUCKETS]
    return melt(fast_rows.agg(*cols))


def home_kpis(rows: DataFrame, status: DataFrame, cutoff: DataFrame) -> DataFrame:
    """(metric, value): arrivals since the cutoff by bucket, unreviewed, open now, per bucket, stages, in flight."""
    clean = F.col("hard_reject_reason").isNull()
    live = clean & F.col("bucket").isin("likely", "reach", "wildcard")
    new = live & (F.col("app_status") == "new")
    fresh = new & (F.col("cutoff").isNull() | (F.col("first_seen_at") > F.col("cutoff")))
    a = rows.crossJoin(F.broadcast(cutoff)).agg(
        F.count_if(fresh).alias("new_count"), *[F.count_if(fresh & (F.col("bucket") == b)).alias(f"new_{b}") for b in ("likely", "reach", "wildcard")],
        F.count_if(new).alias("unreviewed"), F.count_if(clean & F.col("bucket").isin("likely", "reach")).alias("open_now"),
        *[F.count_if(clean & (F.col("bucket") == b)).alias(f"bucket_{b}") for b in fv.BUCKETS])
    st = status.agg(*[F.count_if(F.col("status") == x).alias(f"stage_{x}") for x in fv.STAGES], F.count_if(F.col("status").isin(fv.STAGES)).alias("in_flight"))
    return melt(a).unionByName(melt(st))


def header_stats(s: Settings, postings: DataFrame, evals: DataFrame, status: DataFrame, runs: DataFrame) -> DataFrame:
    """(metric, value) header counters. Every table is read once: evaluations are counted per job, joined to the postings and
    the statuses by job, and one aggregate over the joined rows gives all counters."""
    ok = F.col("hard_reject_reason").isNull()
    local = (F.col("model") == "local") & (queues.json_band(F.col("raw")) == "ambiguous")
    per_job = evals.where(F.col("profile_hash") == s.profile).groupBy("job_id").agg(
        F.count_if(local).alias("_awaiting"), F.bool_or(ok).alias("_ok"), F.bool_or(ok & ~F.col("model").isin("prefilter", "local", "triage")).alias("_deep"),
        F.count_if(ok & F.col("bucket").isin("likely", "reach")).alias("_open"))
    p = postings.select("job_id", "active", (F.col("description_text") != "").alias("_text"), queues.readable(F.col("description_text"), F.col("fetch_failures")).alias("_readable"))
    rows = p.join(per_job, "job_id", "full").join(status.select("job_id", "status"), "job_id", "full")
    fresh = F.coalesce(F.col("status"), F.lit("new")) == "new"
    one = rows.agg(
        F.count_if("active").alias("active"), F.count_if(F.col("active") & F.col("_text")).alias("with_text"),
        F.count_if(F.col("active") & F.col("_readable") & F.col("_ok").isNull()).alias("pending"),
        F.coalesce(F.sum(F.when(F.col("active"), F.col("_awaiting"))), F.lit(0)).alias("awaiting_model"), F.count_if("_ok").alias("evaluated"), F.count_if("_deep").alias("deep"),
        F.count_if(F.col("status").isin(fv.STAGES)).alias("in_flight"), F.coalesce(F.sum(F.when(F.col("active") & fresh, F.col("_open"))), F.lit(0)).alias("unreviewed"))
    return melt(one).unionByName(melt(runs.agg(F.max("run_id").alias("last_run"))))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def alerts(s: Settings, counts: DataFrame, reason: str, weekly_cap: int, scorer_on: bool = True) -> DataFrame:
    """Backlog alerts from a one-row frame (pending, awaiting, week): level, stage, text, action."""
    cuts = {"subscription usage limit hit": "Scoring was interrupted: the usage limit was reached.",
            "run cap": "Scoring stopped at the per-run token cap.", "weekly cap": "Scoring stopped at the weekly token cap."}
    cut = cuts.get(reason)
    a, p, w = F.col("awaiting"), F.col("pending"), F.col("week")
    warned = (a > 0) if cut else F.lit(False)
    noun = F.when(a == 1, F.lit(" unclear posting is")).otherwise(F.lit(" unclear postings are"))

    def alert(cond, level, stage, text, action=""):
        return F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(stage).alias("stage"), text.alias("text"), F.lit(action).alias("action")))
    rows = [
        alert(p > 0, "warn", "score", F.concat(p.cast("string"), F.lit(" readable postings have no score yet.")), "Start a scoring run."),
        alert(warned, "warn", "score", F.concat(F.lit((cut or "") + " "), thousands(a), noun, F.lit(" on the free score only."))),
        alert(~warned & (a > 0), "info", "score", F.concat(a.cast("string"), F.lit(f" ambiguous postings show their local score only ({reason or 'not yet refined'}).")), "The next scoring run takes them up."),
        alert(~warned & F.lit(weekly_cap > 0) & (w >= weekly_cap), "warn", "triage", F.lit(f"The weekly token cap ({weekly_cap:,}) is used up."), "Raise the weekly cap, or set it to 0 for none."),
        alert(F.lit(not scorer_on), "info", "triage", F.lit("The scorer is off: ambiguous postings keep their local score."), "Turn the scorer on."),
    ]
    return counts.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("x.*")
