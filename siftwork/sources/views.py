"""Derived input views.

The raw tables hold no postings, so each view is a projection of them written as one SQL text that Spark
and a checking engine run unchanged. ``{table}`` placeholders become ``parquet.`path``` in Spark and stay bare
table names elsewhere. ``postings_sql`` takes the columns a caller needs and emits only the joins those
columns require, so a query that never looks at dates never shuffles for them.
"""
from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from siftwork.catalog import catalog_sql

NL = "chr(10)"

_TITLES = [
    "Software Engineer Intern - Summer 2027", "GPU Compiler Intern (Winter 2027)", "Machine Learning Intern, PhD",
    "Embedded Systems Co-op", "Data Engineering Intern - Fall 2026", "Quantitative Researcher Intern",
    "Robotics Planning & Controls Intern", "Accounting Internship", "Full Stack Developer Intern",
    "Firmware Engineer Intern", "Internal Audit Manager", "BS/MS Systems Software Intern 2027",
]
_PLACES = [
    "San Francisco, CA", "NYC", "New York, NY, United States", "Remote - US", "Vancouver, BC; Toronto, ON",
    "Austin, TX", "", "London",
]
_PHRASES = [
    "",
    "Application deadline: October 15, 2024. Please plan ahead.",
    "Please apply by Feb 9th to be considered.",
    "Candidates are limited to three (3) applications within a 30-day period.",
    "Requirements: currently enrolled in a PhD program in Computer Science.",
    "This is an unpaid internship for motivated people.",
    "Benefits: unpaid time off and a gym.",
    "Applicants must be a U.S. citizen.",
    "You will write bare metal C++ for GPU kernels on an RTOS with SPI and UART; CUDA, Linux kernel and Python help.",
    "We are an equal opportunity employer. Spark and Kafka are used here.",
    "Each applicant may submit up to 5 applications per year.",
    "Currently pursuing a BS, MS or PhD in Computer Science.",
    "Preferred qualifications - PhD in a related field. Applications reviewed on a rolling basis.",
]


def _case(expr: str, values: list[str]) -> str:
    whens = " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


_SUP = "d.doc_id % (SELECT count(*) FROM {supplier})"
_TOKEN = "'sup' || CAST(s.s_suppkey AS STRING)"
_UUID = "'00000000-0000-0000-0000-' || lpad(CAST(d.doc_id AS STRING), 12, '0')"

_POSTING_COLUMNS = {
    "job_id": "d.doc_id",
    "company_name": "s.s_name || CASE d.doc_id % 7 WHEN 1 THEN ', Inc.' WHEN 2 THEN ' (Vancouver)' "
                    "WHEN 3 THEN ' LLC' WHEN 5 THEN ' Labs' WHEN 6 THEN ' Corp.' ELSE '' END",
    "supplier_key": "s.s_suppkey",
    "title": _case("d.doc_id % 12", _TITLES),
    "location": _case("(d.doc_id * 7) % 8", _PLACES),
    "url": "CASE d.doc_id % 6 "
           f"WHEN 1 THEN 'https://boards.greenhouse.io/' || {_TOKEN} || '/jobs/' || CAST(d.doc_id AS STRING) || '?gh_src=x' "
           f"WHEN 2 THEN 'https://jobs.lever.co/' || {_TOKEN} || '/' || {_UUID} "
           f"WHEN 3 THEN 'https://jobs.ashbyhq.com/' || {_TOKEN} || '/' || {_UUID} "
           f"WHEN 4 THEN 'https://' || {_TOKEN} || '.wd5.myworkdayjobs.com/en-US/External/job/City/Intern_JR' || CAST(d.doc_id AS STRING) "
           "ELSE p.url END",
    "source": "CASE d.doc_id % 3 WHEN 0 THEN 'simplify:' WHEN 1 THEN 'greenhouse:' ELSE 'readme:' END || d.source",
    "posted_at": "CAST(o.o_orderdate AS DATE)",
    "first_seen_at": "e.ts",
    "active": "d.doc_id % 11 <> 0",
    "terms_txt": "CASE d.doc_id % 5 WHEN 0 THEN 'Summer 2027' WHEN 1 THEN '' WHEN 2 THEN 'Winter 2027|Summer 2027' "
                 "WHEN 3 THEN 'N/A' ELSE 'Fall 2026' END",
    "sponsorship": "CASE d.doc_id % 9 WHEN 0 THEN 'U.S. Citizenship is Required' WHEN 4 THEN 'Does Not Offer Sponsorship' END",
    "fetch_failures": "CAST(d.doc_id % 4 AS INT)",
    "description_text": "CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 19 = 0 THEN '' "
                        f"ELSE d.text || {NL} || {_case('d.doc_id % 13', _PHRASES)} END",
    "company_id": "CASE WHEN s.s_suppkey % 7 <> 6 THEN s.s_suppkey END",
}
_NEEDS = {
    "s": ("company_name", "supplier_key", "url", "company_id"),
    "p": ("url",), "o": ("posted_at",), "e": ("first_seen_at",),
}
_JOINS = {
    "s": f"JOIN {{supplier}} s ON s.s_suppkey = {_SUP}",
    "p": "JOIN {pages} p ON p.page_id = d.doc_id % (SELECT count(*) FROM {pages})",
    "o": "LEFT JOIN {orders} o ON o.o_orderkey = d.doc_id",
    "e": "LEFT JOIN {events} e ON e.event_id = d.doc_id",
}
POSTING_COLUMNS = list(_POSTING_COLUMNS)


def postings_sql(columns: Iterable[str] | None = None) -> str:
    cols = list(dict.fromkeys(["job_id", *(columns or POSTING_COLUMNS)]))
    joins = [_JOINS[a] for a in "spoe" if any(c in _NEEDS[a] for c in cols)]
    select = ",\n  ".join(f"{_POSTING_COLUMNS[c]} AS {c}" for c in cols)
    return f"SELECT {select}\nFROM {{documents}} d\n" + "\n".join(joins)


def _sub(a: int, b: int) -> str:
    return f"(d.doc_id * {a} + v.v * {b}) % 101"


_K = "(d.doc_id + v.v) % 5"
_FAST = _sub(37, 11)
_REASON = (f"CASE WHEN {_K} = 0 THEN 'unpaid' WHEN {_K} = 3 AND d.doc_id % 8 = 3 THEN 'triage: off target (12)' "
           f"WHEN {_K} = 4 AND d.doc_id % 6 = 5 THEN 'model: start window is fall' "
           f"WHEN {_K} = 4 AND d.doc_id % 6 = 2 THEN 'model: needs a clearance' END")

VIEWS: dict[str, str] = {
    "company_dim": """
SELECT s_suppkey AS company_id, lower(replace(s_name, '#', '-')) AS slug, s_name AS name,
  CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE CAST(1 + s_suppkey % 4 AS INT) END AS tier,
  CASE WHEN s_suppkey % 5 = 0 THEN CAST(40 + s_suppkey % 60 AS INT) END AS reputation,
  CASE s_suppkey % 8 WHEN 0 THEN 'paused' WHEN 3 THEN 'proposed' WHEN 5 THEN 'rejected' ELSE 'approved' END AS status,
  CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' END AS ats_type,
  CASE s_suppkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 'sup' || CAST(s_suppkey AS STRING) || '/wd5/External'
    ELSE 'sup' || CAST(s_suppkey AS STRING) END AS ats_token,
  CASE s_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'harvest' ELSE 'directory' END AS source
FROM {supplier} WHERE s_suppkey % 7 <> 6""",
    "directory": """
SELECT lower(replace(s_name, '#', '-')) AS slug, s_name AS name, s_name || ' Holdings|' || s_name || ' Group' AS aliases,
  CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' ELSE '' END AS ats_type,
  CASE s_suppkey % 4 WHEN 3 THEN '' WHEN 2 THEN 'sup' || CAST(s_suppkey AS STRING) || '/wd5/External'
    ELSE 'SUP' || CAST(s_suppkey AS STRING) END AS ats_token,
  CASE s_suppkey % 5 WHEN 0 THEN 'dead' WHEN 1 THEN 'empty' WHEN 2 THEN 'unverified' ELSE 'ok' END AS status,
  CASE s_suppkey % 3 WHEN 0 THEN 'gpu|ml' WHEN 1 THEN 'systems' ELSE '' END AS tags,
  CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE CAST(1 + s_suppkey % 3 AS STRING) END AS tier,
  CASE WHEN s_suppkey % 5 = 0 THEN 'n/a' ELSE CAST(50 + s_suppkey % 50 AS STRING) END AS reputation,
  'www.' || lower(replace(s_name, '#', '')) || '.example.com/careers' AS domain
FROM {supplier} WHERE s_suppkey % 9 <> 8""",
    "evals": f"""
SELECT d.doc_id * 3 + v.v AS eval_seq, d.doc_id AS job_id,
  CASE WHEN v.v = 0 THEN '1' ELSE '2' END AS rubric_version,
  CASE WHEN (d.doc_id + v.v) % 7 = 0 THEN 'old' ELSE 'cur' END AS profile_hash,
  CASE {_K} WHEN 0 THEN 'prefilter' WHEN 3 THEN 'triage' WHEN 4 THEN 'deep' ELSE 'local' END AS model,
  {_REASON} AS hard_reject_reason,
  CASE WHEN {_K} = 4 THEN 'deep' ELSE 'fast' END AS family,
  CAST({_FAST} AS INT) AS skills_match, CAST({_sub(53, 7)} AS INT) AS level_match,
  CAST({_sub(29, 13)} AS INT) AS work_alignment, CAST({_sub(41, 5)} AS INT) AS experience_quality,
  CAST({_sub(23, 17)} AS INT) AS interest, (d.doc_id + v.v) % 4 = 0 AS wildcard,
  CAST({_sub(31, 3)} AS INT) AS confidence,
  CAST({_FAST} AS INT) AS likelihood,
  CAST(CASE WHEN {_K} = 4 THEN {_sub(29, 13)} ELSE {_FAST} END AS INT) AS desirability,
  CASE WHEN {_REASON} IS NOT NULL THEN 'archive'
    WHEN {_K} = 4 AND {_FAST} >= 65 AND {_sub(29, 13)} >= 50 THEN 'likely'
    WHEN {_K} = 4 AND {_sub(29, 13)} >= 70 AND {_FAST} >= 25 THEN 'reach'
    WHEN {_K} = 4 AND (d.doc_id + v.v) % 4 = 0 AND {_sub(23, 17)} >= 70 THEN 'wildcard'
    WHEN {_K} <> 4 AND {_FAST} >= 68 THEN 'likely' WHEN {_K} <> 4 AND {_FAST} >= 50 THEN 'reach'
    ELSE 'archive' END AS bucket,
  CASE WHEN {_K} = 0 THEN NULL ELSE '{{"fast":{{"band":"' || CASE (d.doc_id + v.v) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'ambiguous' ELSE 'no' END
    || '","local":' || CAST({_FAST} AS STRING) || ',"triage":'
    || CASE WHEN {_K} = 3 THEN CAST({_sub(43, 19)} AS STRING) ELSE 'null' END || '}},"fit_tags":["'
    || CASE d.doc_id % 4 WHEN 0 THEN 'cuda' WHEN 1 THEN 'linux' WHEN 2 THEN 'robotics' ELSE 'kafka' END
    || '"],"description_unavailable":' || CASE WHEN d.doc_id % 17 = 0 THEN 'true' ELSE 'false' END || '}}' END AS raw,
  CASE d.doc_id % 3 WHEN 0 THEN '- strong fit' || {NL} || '- ' || CASE d.doc_id % 2 WHEN 0 THEN 'gpu work' ELSE 'spark and kafka' END
    WHEN 1 THEN 'Prose summary about linux.' END AS summary,
  e.ts AS created_at
FROM {{documents}} d CROSS JOIN (VALUES (0), (1), (2)) AS v(v)
LEFT JOIN {{events}} e ON e.event_id = (d.doc_id * 3 + v.v) % (SELECT count(*) FROM {{events}})""",
    "apps": """
SELECT event_id, event_id % (SELECT count(*) FROM {documents}) AS job_id,
  CASE event_type WHEN 'view' THEN 'shortlisted' WHEN 'click' THEN 'applied' WHEN 'signup' THEN 'interview'
    WHEN 'purchase' THEN 'offer' ELSE 'rejected' END AS status,
  CASE WHEN event_id % 4 = 0 THEN 'note ' || CAST(event_id AS STRING) END AS note, ts AS updated_at
FROM {events} WHERE user_id % 3 = 0""",
    "runs": """
SELECT o_orderkey AS run_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'discover' ELSE 'run' END AS kind,
  o_orderdate AS started_at, CAST(floor(o_totalprice) AS BIGINT) AS tokens FROM {orders}""",
    "visits": "SELECT event_id, user_id, ts FROM {events}",
    "gold": """
SELECT doc_id AS job_id, CASE WHEN quality = 1 AND toxic = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'likely' ELSE 'reach' END
  WHEN quality = 1 THEN 'wildcard' ELSE 'archive' END AS bucket FROM {labels}""",
    "entities": """
SELECT c_custkey AS rec_id, 'Org ' || CAST(c_custkey % 400 AS STRING)
    || CASE c_custkey % 7 WHEN 1 THEN ' Inc.' WHEN 2 THEN ' LLC' ELSE '' END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 'b' || CAST(c_custkey % 300 AS STRING) END AS board,
  CASE c_custkey % 5 WHEN 0 THEN 'yaml' WHEN 1 THEN 'manual' ELSE 'harvest' END AS source,
  CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE CAST(1 + c_custkey % 3 AS INT) END AS tier,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(30 + c_custkey % 70 AS INT) END AS reputation,
  CASE WHEN c_custkey % 6 = 1 THEN 'd' || CAST(c_custkey AS STRING) || '.example.com' ELSE '' END AS domain
FROM {customer}""",
    "catalog": catalog_sql(),
}

_TABLE = re.compile(r"\{([a-z]+)\}")
_COUNT = re.compile(r"\(SELECT count\(\*\) FROM \{([a-z]+)\}\)")


def view_sql(name: str, columns: Iterable[str] | None = None) -> str:
    return postings_sql(columns) if name == "postings" else VIEWS[name]


# Tables whose rows cost real CPU time (whole texts go through many patterns) and the key that spreads them.
_HEAVY = {"documents": "doc_id", "pages": "page_id"}


def _spread_to(spark: SparkSession, path: str) -> int | None:
    """Number of partitions to spread a heavy table to, or None. A table in fewer splits than there are cores (one
    file, say) would leave cores idle; a large table arrives in more splits than cores and is never shuffled for this."""
    cores = spark.sparkContext.defaultParallelism
    return cores if spark.read.parquet(path).rdd.getNumPartitions() < cores else None


def _source(spark: SparkSession, sf_dir: str, table: str) -> str:
    path = os.path.join(sf_dir, f"{table}.parquet")
    n = _spread_to(spark, path) if table in _HEAVY else None
    return f"(SELECT /*+ REPARTITION({n}, {_HEAVY[table]}) */ * FROM parquet.`{path}`)" if n else f"parquet.`{path}`"


def bind_counts(spark: SparkSession, sql: str, sf_dir: str) -> str:
    """Put the row counts that keys are dealt by into the statement, read from the file footers. As scalar subqueries inside
    join keys they can still be running when an adaptive plan evaluates a key that was moved to another stage ("Subquery has
    not finished"). No rows give NULL, as an empty remainder does elsewhere."""
    def count(m: re.Match) -> str:
        n = spark.read.parquet(os.path.join(sf_dir, f"{m.group(1)}.parquet")).count()
        return f"{n}L" if n else "CAST(NULL AS BIGINT)"
    return _COUNT.sub(count, sql)


def bind_spark(spark: SparkSession, sql: str, sf_dir: str) -> str:
    sql = bind_counts(spark, sql, sf_dir)
    return _TABLE.sub(lambda m: _source(spark, sf_dir, m.group(1)), sql)


def bind_plain(sql: str) -> str:
    return _TABLE.sub(lambda m: m.group(1), sql)


def view(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    return spark.sql(bind_spark(spark, view_sql(name, columns), sf_dir))


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_source(spark, sf_dir, table)}")
