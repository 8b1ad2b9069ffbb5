"""A cross-section of registered queries beside their SQL statements on the small tables (check_oracles.py runs all)."""
import pytest
from check_oracles import compare, connect, entry_module

SF = "/root/testdata/sf0.001"
NAMES = ["t01_canonical_urls", "t05_content_hash", "f02_rule_cascade", "x01_local_score", "x00_top_scored", "w03_visit_sessions", "w04_budget_waves",
         "w08_slug_uniquify", "j08_directory_match", "a02_funnel", "a15_merge_entities", "u03_upsert_feed_health", "s02_read_markdown_table_feed", "st3_stream_sessions"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    m = entry_module()
    why, n = compare(spark, con, SF, m.queries()[name], m.oracle_sql()[name])
    assert why is None and n > 0


def test_every_query_has_a_statement():
    from siftwork.plans import load_all
    m = load_all()
    assert set(m.QUERIES) == set(m.ORACLES)


def test_the_registry_needs_neither_a_session_nor_the_corpus_package():
    """In a fresh interpreter, with the corpus operators absent."""
    import subprocess
    import sys

    from check_oracles import ROOT
    code = ("import sys; sys.modules['siftwork.llm'] = None; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, '.')\n"
            "import __spark_entry__ as e\nassert set(e.queries()) == set(e.oracle_sql()) and len(e.queries()) > 160 and not any(k.startswith('op') for k in e.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
