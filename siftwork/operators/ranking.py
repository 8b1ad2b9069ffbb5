"""Exact ranks without one task holding a whole group.

A plain ``row_number`` over a hot group sorts that group in one task. Here rows are dealt into ranges of the whole sort
order, so ranges stay even however the values are spread; the dealt rows are written to the shared folder, so a lost
task reads the same ranges again and the input is computed once. Range sizes are counted, offsets come from that small
table, and only rows inside one range are sorted together.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.session import cut_lineage

def _order(spec: list[tuple[str, str]]) -> list[Column]:
    make = {"asc": "asc_nulls_last", "desc": "desc_nulls_last"}
    return [getattr(F.col(c), make[way])() for c, way in spec]


def global_rank(df: DataFrame, order: list[tuple[str, str]], keys: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Add a 1-based rank per ``keys`` (or over all rows) by ``order``. The sort columns must tell rows apart as far as
    a caller cares: equal rows meet in one range and are numbered in any order."""
    keys = keys or []
    bins = ["_range"]
    dealt = df.repartitionByRange(*_order([(k, "asc") for k in keys]), *_order(order))
    df = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))
    bin_order = _order([("_range", "asc")])
    sizes = df.groupBy(*keys, *bins).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(*bin_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, *bins, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inner = df.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys, *bins).orderBy(*_order(order))))
    a, b = inner.alias("a"), offsets.alias("b")
    on = None
    for c in keys + bins:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = same if on is None else on & same
    out = a.join(b, on).select("a.*", (F.col("b._before") + F.col("a._inner")).alias(name))
    return out.drop("_inner", *bins)


def top_rank(df: DataFrame, order: list[tuple[str, str]], k: int, name: str = "rank") -> DataFrame:
    """Global top k with its rank: per-task top k first, then a window over at most k rows."""
    best = df.orderBy(*_order(order)).limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*_order(order))))


def first_per_key(df: DataFrame, keys: list[str], order: list[tuple[str, str]]) -> DataFrame:
    """First row per key by ``order`` (ascending columns only, or negated numbers), as a map-side combined
    aggregate: a hot key costs one partial row per task, never a sort of the whole group."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c, _ in order])) if all(w == "asc" for _, w in order) else \
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c, _ in order]))
    assert len({w for _, w in order}) == 1, "mixed directions: negate a number first"
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*")
