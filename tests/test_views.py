"""Views bound for Spark: row counts that keys are dealt by are plain numbers, not subqueries inside join keys."""
import datetime as dt

from siftwork.plans import load_all
from siftwork.sources import views

T0 = dt.datetime(2024, 1, 5)


def _write(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")


def _documents(spark, folder, n=20):
    _write(spark, folder, "documents", [(i, f"text {i}", "en", "web", 6) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")


def _events(spark, folder, n):
    _write(spark, folder, "events", [(i, T0, i, "view", 1.0, "") for i in range(n)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_reject_counts_hold_no_subquery_in_a_key(spark, tmp_path):
    d = str(tmp_path)
    _documents(spark, d)
    _events(spark, d, 7)
    bound = views.bind_spark(spark, views.view_sql("evals"), d)
    assert "SELECT count" not in bound and "% 7L" in bound
    got = {r.reason: r.n for r in load_all().QUERIES["a01_reject_counts"](spark, d).collect()}
    rows = spark.sql(bound).where("rubric_version = '2' AND hard_reject_reason IS NOT NULL").collect()
    assert sum(got.values()) == len(rows) and all(r.created_at == T0 for r in rows)


def test_no_events_leave_evaluations_without_a_time(spark, tmp_path):
    """A remainder by no rows is NULL, as in SQL, and no division by zero."""
    d = str(tmp_path)
    _documents(spark, d)
    _events(spark, d, 0)
    rows = views.view(spark, d, "evals").collect()
    assert len(rows) == 60 and all(r.created_at is None for r in rows)


def test_posting_urls_hold_no_subquery_in_a_key(spark, tmp_path):
    d = str(tmp_path)
    _documents(spark, d)
    _write(spark, d, "supplier", [(i, f"Supplier#{i:09d}", 1, 1.0) for i in range(3)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    _write(spark, d, "pages", [(i, f"https://example.org/p/{i}", "<p>x</p>") for i in range(4)], "page_id long, url string, html string")
    _write(spark, d, "orders", [(i, dt.datetime(2024, 1, 1)) for i in range(20)], "o_orderkey long, o_orderdate timestamp_ntz")
    _events(spark, d, 7)
    bound = views.bind_spark(spark, views.view_sql("postings"), d)
    assert "SELECT count" not in bound and "% 3L" in bound and "% 4L" in bound
    urls = {(r.job_id, r.url) for r in load_all().QUERIES["u01b_posting_urls"](spark, d).collect()}
    given = {r.job_id: r.url for r in spark.sql(bound).collect() if r.job_id % 3 != 0}
    assert set(given.values()) <= {u for _, u in urls}
