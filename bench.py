"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "t01_canonical_urls", "t03_dedup_keys", "t04_html_to_text", "t05_content_hash", "t07_classify_role", "t08_application_caps", "t12_deadlines",
    "f02_rule_cascade", "f11_rule_degree_ceiling", "x01_local_score", "x08_fast_scoring", "j01_current_evaluations", "a02_funnel", "a08_company_limits",
    "w03_visit_sessions", "w06_token_allowance", "w11_first_wins_dedupe", "u03_upsert_feed_health",
]


def main() -> None:
    from siftwork.plans import load_all
    from siftwork.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = load_all().QUERIES
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
