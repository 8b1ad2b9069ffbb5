"""Sessions, rolling spend and forward fill, arranged so that no single key has to fit one task."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.config import Settings
from siftwork.functions import fixed_values as fv

_US = 1_000_000


def visit_sessions(visits: DataFrame, gap_minutes: int = fv.SESSION_GAP_MINUTES) -> DataFrame:
    """Sessions per user (a new one starts after a gap longer than ``gap_minutes``) and the "new since" cutoff: the
    end of the previous session, or the first visit itself for the first session.

    Visits are first combined per gap-sized time slot. Two visits in one slot are never further apart than the gap,
    so this loses nothing, and what reaches the per-user window is bounded by elapsed time, not by visits.
    """
    gap = gap_minutes * 60 * _US
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / gap)
    slots = visits.groupBy("user_id", slot.alias("slot")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("slot")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    marked = slots.withColumn("prev", F.lag("b").over(w)).withColumn(
        "first", F.coalesce((us("a") - us("prev") > gap).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("first").over(w))
    out = numbered.groupBy("user_id", "session").agg(F.min("a").alias("session_start"), F.max("b").alias("session_end"), F.sum("n").alias("visits"))
    w2 = Window.partitionBy("user_id").orderBy("session")
    return out.withColumn("cutoff", F.coalesce(F.lag("session_end").over(w2), F.col("session_start"))).drop("session")


def rolling_spend(runs: DataFrame, days: int = 7) -> DataFrame:
    """(started_at, spent): tokens of the trailing ``days`` up to each moment a run started.

    Rows are summed per moment, then cut into bins of ``days``; each bin also receives its predecessor's rows, so a
    trailing range never looks outside its bin and bins run in parallel.
    """
    span = days * 86_400 * _US
    moments = runs.groupBy("started_at").agg(F.sum("tokens").alias("tokens")).withColumn(
        "own", F.floor(F.unix_micros(F.col("started_at").cast("timestamp")) / span))
    spread = moments.select("started_at", "tokens", "own", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("bin"))
    w = Window.partitionBy("bin").orderBy(F.unix_micros(F.col("started_at").cast("timestamp"))).rangeBetween(-span, 0)
    return spread.withColumn("spent", F.sum("tokens").over(w)).where("own = bin").select("started_at", "spent")


def allowance(s: Settings, spent, run_cap: int, weekly_cap: int) -> dict:
    """Tokens a run may still spend and which cap binds; NULL = unlimited."""
    left = F.greatest(F.lit(0), F.lit(weekly_cap) - spent)
    if run_cap > 0 and weekly_cap > 0:
        allowed = F.least(F.lit(run_cap), left)
        return {"allowance": allowed, "binding": F.when(left < run_cap, F.lit("weekly cap")).otherwise(F.lit("run cap"))}
    if weekly_cap > 0:
        return {"allowance": left, "binding": F.lit("weekly cap")}
    return {"allowance": F.lit(run_cap if run_cap > 0 else None).cast("bigint"), "binding": F.lit("run cap")}


def forward_fill(df: DataFrame, key: str, order: str, columns: list[str], bin_size: int = 65_536) -> DataFrame:
    """Replace NULLs by the last earlier value within ``key``. Bins of consecutive rows fill in parallel; the value
    that enters a bin comes from a running last over the (small) table of bin-final values."""
    rows = df.withColumn("_bin", F.floor(F.col(order) / bin_size))
    inside = Window.partitionBy(key, "_bin").orderBy(order)
    ends = rows.groupBy(key, "_bin").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_bin", *[F.last(c, ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns])
    out = rows.withColumns({f"_own_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns}).join(carried, [key, "_bin"])
    return out.withColumns({c: F.coalesce(f"_own_{c}", f"_in_{c}") for c in columns}).drop(
        "_bin", *[f"_own_{c}" for c in columns], *[f"_in_{c}" for c in columns])
