"""Plan shaping helpers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add expensive columns so that they are computed exactly once.

    The optimizer may copy a projected expression into later filters and projections; a generator output is a plain
    attribute and cannot be copied. The one-element array never adds or drops a row.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    out = df.select("*", F.explode(F.array(packed)).alias("_once"))
    return out.select(*[c for c in df.columns if c not in columns], *[F.col(f"_once.{n}").alias(n) for n in columns])
