"""Connected components as joins and aggregates: rounds grow with the logarithm of the longest chain, no group is gathered."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.session import scratch_dir


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stars(links: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where((F.col("out") > 1) | (F.col("out") + F.col("into") > 1)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links, any order and repeats -> (node, label): the smallest node that each linked node reaches. Links to itself and
    null ends count for nothing. Alternates the large-star and small-star steps until the links are stars around the labels."""
    root = scratch_dir(edges.sparkSession, "components")
    u, v = F.col("u"), F.col("v")
    links = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    links, step = _stored(links, f"{root}/0"), 0
    while not _stars(links):
        step += 1
        both = links.unionByName(links.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = _stored(small, f"{root}/{step}")
    return links.select(u.alias("node"), v.alias("label")).unionByName(links.select(v.alias("node"), v.alias("label")).distinct())
