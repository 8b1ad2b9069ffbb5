"""Company reputation look-ups. The dimension is joined on its key; Catalyst broadcasts it only while it is small."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import fixed_values as fv
from siftwork.functions.roles import literal_map
from siftwork.functions.text import slug


def tier_reputation(tier: Column) -> Column:
    return literal_map(tier, fv.TIER_REPUTATION, F.lit(None).cast("int"))


def reputation_by_slug(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Add ``reputation``: explicit value, else by tier, else NULL (unknown company)."""
    dim = companies.select(F.col("slug").alias("_slug"), F.coalesce("reputation", tier_reputation(F.col("tier"))).alias("reputation"))
    return postings.withColumn("_slug", slug(F.col("company_name"))).join(dim, "_slug", "left").drop("_slug")


def reputation_by_id(rows: DataFrame, companies: DataFrame, default: int) -> DataFrame:
    """Same value looked up by ``company_id``, with a default instead of NULL."""
    dim = companies.select("company_id", F.coalesce("reputation", tier_reputation(F.col("tier"))).alias("_rep"))
    return rows.join(dim, "company_id", "left").withColumn("reputation", F.coalesce("_rep", F.lit(default))).drop("_rep")
