"""Sinks: versioned snapshots, run log, directory CSV and digest lines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, version: int) -> str:
    """Write one immutable version of a table. Writing a version again replaces it, so a re-run is harmless; the path
    being read is never the path being written."""
    target = f"{path}/v={version}"
    df.write.mode("overwrite").parquet(target)
    return target


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The newest finished version of a snapshot, from the folder itself, so that a restarted job finds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    found = [int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(found) if found else None


def read_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/v={version}")


class BucketedTable:
    """A table whose versions share the files of the buckets that a version did not change.

    A row's bucket is a hash of its key column. Version v writes only the buckets it changed, as ``data/v=<v>/bucket=<b>``, and a
    manifest ``manifest/v=<v>`` with one row per bucket: the version that holds it. The manifest is written last and is the
    commit: a version without a finished manifest does not exist, and writing a version again replaces it. Folders that none
    of the last ``keep`` manifests names are deleted, so storage follows the table's size and not the number of versions.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int, keep: int = 2):
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path, key, buckets, keep

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def version(self) -> int | None:
        return newest_version(self.spark, f"{self.path}/manifest")

    def places(self, version: int) -> dict[int, int]:
        """Bucket -> version that holds it; at most ``buckets`` entries."""
        return {r.bucket: r.held for r in self.spark.read.schema("bucket int, held int").parquet(f"{self.path}/manifest/v={version}").collect()}

    def read(self, version: int, schema, buckets: set[int] | None = None) -> DataFrame:
        held = {b: v for b, v in self.places(version).items() if buckets is None or b in buckets}
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, version: int, base: int | None = None) -> None:
        """Version ``version`` = version ``base`` with the buckets of the rows of ``df`` replaced by these rows."""
        target = f"{self.path}/data/v={version}"
        df.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        places = ({} if base is None else self.places(base)) | {b: version for b in self._children(target, "bucket=")}
        rows = self.spark.createDataFrame(sorted(places.items()), "bucket int, held int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        self._retire(version)

    def _children(self, path: str, prefix: str) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def _retire(self, version: int) -> None:
        versions = [v for v in self._children(f"{self.path}/manifest", "v=") if v <= version]
        live = {(b, v) for m in versions[-self.keep:] for b, v in self.places(m).items()}
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [f"manifest/v={v}" for v in versions[:-self.keep]]
        gone += [f"data/v={v}/bucket={b}" for v in self._children(f"{self.path}/data", "v=") if v <= version for b in self._children(f"{self.path}/data/v={v}", "bucket=") if (b, v) not in live]
        for name in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


class RunLog:
    """Runs by id, merged on read. Starts and finishes are appended as numbered batches; a run's state is its start and, per
    field, the newest finish that gives a value (errors and the time are always the newest finish's). A finish of an unknown
    run counts for nothing. ``compact`` folds all batches into one, which later reads begin from."""

    SCHEMA = "run_id bigint, batch bigint, kind string, started_at timestamp_ntz, finished_at timestamp_ntz, tokens bigint, errors string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: DataFrame) -> None:
        last = newest_version(self.spark, f"{self.path}/log")
        base = newest_version(self.spark, f"{self.path}/base")
        number = max(-1 if last is None else last, -1 if base is None else base) + 1
        names = [f.split(" ")[0] for f in self.SCHEMA.split(", ")]
        filled = rows.withColumn("batch", F.lit(number).cast("bigint"))
        kinds = dict(f.split(" ") for f in self.SCHEMA.split(", "))
        write_snapshot(filled.select(*[(F.col(c) if c in filled.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names]), f"{self.path}/log", number)

    def start(self, runs: DataFrame) -> None:
        """``runs``: run_id, kind, started_at."""
        self._append(runs.select("run_id", "kind", "started_at"))

    def finish(self, runs: DataFrame) -> None:
        """``runs``: run_id, finished_at, tokens (NULL keeps what is known), errors (array of strings)."""
        errors = F.when(F.size("errors") > 0, F.to_json("errors"))
        self._append(runs.select("run_id", "finished_at", "tokens", errors.alias("errors")))

    def read(self) -> DataFrame:
        return self._merged().drop("batch")

    def compact(self) -> None:
        last = newest_version(self.spark, f"{self.path}/log")
        if last is not None:
            write_snapshot(self._merged(), f"{self.path}/base", last)

    def _merged(self) -> DataFrame:
        base, last = (newest_version(self.spark, f"{self.path}/{part}") for part in ("base", "log"))
        paths = [f"{self.path}/base/v={base}"] if base is not None else []
        paths += [f"{self.path}/log/v={n}" for n in range(0 if base is None else base + 1, 0 if last is None else last + 1)]
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        done = F.when(F.col("finished_at").isNotNull(), F.col("batch"))
        return rows.groupBy("run_id").agg(
            F.max("batch").alias("batch"), F.max_by("kind", F.when(F.col("started_at").isNotNull(), F.col("batch"))).alias("kind"), F.max("started_at").alias("started_at"),
            F.max_by("finished_at", done).alias("finished_at"), F.max_by("tokens", F.when(F.col("tokens").isNotNull(), F.col("batch"))).alias("tokens"),
            F.max_by("errors", done).alias("errors")).where("started_at IS NOT NULL")


def write_directory_csv(directory: DataFrame, path: str) -> None:
    """Directory rows sorted by slug (range-partitioned sort), lists joined with a bar."""
    directory.orderBy("slug").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
