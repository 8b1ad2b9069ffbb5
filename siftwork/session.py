"""Session helper for local runs and tests. On a cluster pass your own session; nothing here is required."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "12g", shuffle: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("siftwork")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A folder for materialised intermediates: under ``spark.checkpoint.dir`` when the cluster names one
    (shared by all executors); only a session without that setting, as in tests, gets a local folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid
        return f"{shared.rstrip('/')}/siftwork/{purpose}-{uuid.uuid4().hex}"
    return tempfile.mkdtemp(prefix=f"spark-{purpose}-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint()
