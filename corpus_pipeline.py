"""Corpus preparation as five stages over ``documents``. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next one.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of each class of near copies the document with the smallest doc_id stays.
3. decontamination: documents that hold a benchmark window go.
4. secrets: secrets are replaced by their kind in square brackets, n_chars follows.
5. pieces: adds ids, the SentencePiece ids of the text, and n_ids; the text can be decoded from them.

Rows are decided by content, not by id alone: repeated rows of one class leave one row, and rows with a null id or text are judged
like others (a null text has no words, no window and no secret, and null ids). SQL cannot express the first, second and fifth stage,
so ``ORACLE_SQL`` is None and the stages are tested against brute force.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm import decontam, neardup, pieces, queries, secrets
from siftwork.llm.tables import kept, parted, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.quality_scores(docs.select(*COLUMNS), spark, sf_dir).where(F.col("score") >= 0.3).select(*COLUMNS)


def _did() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, _did(), F.xxhash64("text").alias("tk"))


def _without(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text hash) is not among ``marked`` (did, tk). Only rows that a bitmap of these may hold are moved."""
    marked = kept(marked, "pipeline-marked")
    met, rest = parted(_keyed(docs), marked, "did", "tk")
    return rest.unionByName(met.join(marked, ["did", "tk"], "left_anti")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = kept(neardup.classes(docs).where(F.col("class_size") > 1).select("label", "doc_id", "tk"), "pipeline-classes")
    own = found.groupBy("label", _did(), "tk").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    stays = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tk")).alias("one"))
    stay = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("tk") == F.col("one.tk"))
    # rows that go, and rows that stay once of several that are equal in (doc_id, text)
    marked = kept(own.join(stays, "label").select("did", "tk", stay.alias("stay"), "n").where("not stay or n > 1").drop("n"), "pipeline-marked")
    met, rest = parted(_keyed(docs), marked, "did", "tk")
    single = met.join(marked.select("did", "tk"), ["did", "tk"], "left_anti")
    place = F.row_number().over(Window.partitionBy("did", "tk").orderBy("lang", "source", "n_chars"))
    again = met.join(marked.where("stay").select("did", "tk"), ["did", "tk"], "left_semi").select("*", place.alias("place")).where("place = 1")
    return rest.select(*COLUMNS).unionByName(single.select(*COLUMNS)).unionByName(again.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, read(spark, sf_dir, "benchmark")).where(F.col("n_hit") > 0)
    return _without(docs, found.select(_did(), F.col("copy").alias("tk")).distinct())


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_column(docs.select(*COLUMNS), block_chars=1 << 20).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("pieces", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
