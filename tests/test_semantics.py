"""Metamorphic and invariant checks on small frames."""
import datetime as dt

from pyspark.sql import functions as F

from siftwork.config import DEFAULT as S
from siftwork.functions import dates
from siftwork.operators import companies, merge, packing, ranking, windows


def test_global_rank_equals_a_plain_sort(spark):
    rows = [(i, (i * 37) % 10) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, score int")
    got = {r.id: r.rank for r in ranking.global_rank(df, [("score", "desc"), ("id", "asc")]).collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_forward_fill_crosses_bins(spark):
    rows = [("a", i, "v0" if i == 1 else "v50" if i == 50 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    got = [r.v for r in windows.forward_fill(df, "k", "n", ["v"], bin_size=8).orderBy("n").collect()]
    assert got == [None] + ["v0"] * 49 + ["v50"] * 70


def test_sessions_merge_at_exactly_the_gap(spark):
    t0 = dt.datetime(2024, 1, 1, 8)
    at = [0, 45, 90, 136, 500]
    df = spark.createDataFrame([(i, 1, t0 + dt.timedelta(minutes=m)) for i, m in enumerate(at)], "event_id int, user_id int, ts timestamp_ntz")
    got = [(r.visits, r.cutoff) for r in windows.visit_sessions(df).orderBy("session_start").collect()]
    assert got == [(3, t0), (1, t0 + dt.timedelta(minutes=90)), (1, t0 + dt.timedelta(minutes=136))]


def test_budget_waves_keep_running_after_a_partial_wave(spark):
    """The first guess lets one of two batches start; its cheap measured cost lets later waves start again."""
    df = spark.createDataFrame([(i, 10_000) for i in range(8)], "batch bigint, tokens bigint")
    got = [r.batch for r in packing.budget_waves(S, df, 45_000).where("runs").orderBy("batch").collect()]
    assert got == [0, 2, 3, 4]


def test_waves_in_chunks_equal_a_plain_loop(spark):
    """Chunks of every size, a cheap batch that makes all waves reachable, an empty queue, and no budget at all."""
    costs = [1 if i % 5 == 2 else 9_000 + 37 * i % 500 for i in range(40)]
    k, guess = S.concurrency, 26_000
    for budget in (20_000, 120_000, 10**9):
        spent, most, want = 0, 0, []
        for w in range(0, 40, k):
            fit = (budget - spent) // (most or guess)
            if fit <= 0:
                break
            wave = list(range(w, 40))[:min(fit, k)]
            spent, most, want = spent + sum(costs[i] for i in wave), max([most, *[costs[i] for i in wave]]), want + wave
        df = spark.createDataFrame(list(enumerate(costs)), "batch bigint, tokens bigint")
        for chunk in (1, 3, 512):
            got = packing.budget_waves(S, df, budget, chunk).collect()
            assert sorted(r.batch for r in got if r.runs) == want and len(got) == 40
    assert all(r.runs and r.wave == 0 for r in packing.budget_waves(S, df, None).collect())
    assert packing.budget_waves(S, df.limit(0), 1).collect() == []


def _posting(i, company, title, url, text, source="simplify:a", **kw):
    base = dict(job_id=i, company_name=company, title=title, location="Oslo", url=url, source=source, active=True, terms_txt="", sponsorship=None,
                description_text=text, company_id=None)
    return {**base, **kw}


_SCHEMA = ("job_id bigint, company_name string, title string, location string, url string, source string, active boolean, terms_txt string, "
           "sponsorship string, description_text string, company_id bigint")


def test_upsert_rules_and_idempotence(spark):
    now = dates.at("2024-01-31 00:00:00")
    make = lambda rows: merge.keyed_rows(spark.createDataFrame([tuple(r[c.split()[0]] for c in _SCHEMA.split(", ")) for r in rows], _SCHEMA))
    stored = make([_posting(1, "Vega", "SWE Intern", "https://x.org/1", "old"), _posting(2, "Lyra", "ML Intern", "https://x.org/2", None),
                   _posting(3, "Mira", "Web Intern", "https://x.org/3", "kept")])
    inc = make([_posting(11, "Vega", "SWE Intern", "https://y.org/9", "new text", terms_txt="Summer 2027"),
                _posting(12, "Lyra", "ML Intern", "https://x.org/2", "first text. Apply by 2024-03-01", source="readme:b"),
                _posting(13, "Renamed", "Another", "https://x.org/3", "other source", source="readme:b", active=False),
                _posting(14, "Nova", "GPU Intern", "https://x.org/4", None), _posting(15, "Nova", "GPU Intern", "https://x.org/5", "later")])
    out = {r.job_id: r for r in merge.upsert_postings(stored, inc, now).collect()}
    assert sorted(out) == [1, 2, 3, 14]
    assert out[1].description_text == "new text" and out[1].needs_reeval and out[1].terms_txt == "Summer 2027"
    assert out[2].description_text.startswith("first") and not out[2].needs_reeval and out[2].deadline == dt.date(2024, 3, 1)
    assert out[3].description_text == "kept" and not out[3].active and not out[3].needs_reeval
    assert out[14].is_new and out[14].description_text == "later" and not out[14].needs_reeval


def test_feed_health_is_sticky_when_disabled(spark):
    rows = [(1, i, i, o, n, c) for i, (o, n, c) in enumerate([("http", 0, 404), ("ok", 3, None), ("network", 0, None)])]
    rows += [(2, i, i, o, n, c) for i, (o, n, c) in enumerate([("http", 0, 404), ("ok", 20, None), ("http", 0, 503)])]
    rows += [(3, i, i, o, n, c) for i, (o, n, c) in enumerate([("disabled", 0, None), ("ok", 50, None)])]
    df = spark.createDataFrame(rows, "feed int, at int, seq int, outcome string, rows int, code int")
    assert {r.feed: r.status for r in merge.feed_health(df).collect()} == {1: "broken", 2: "active", 3: "disabled"}


def test_unreject_after_reprefilter_is_a_no_op(spark):
    evals = spark.createDataFrame([(1, 10, "cur", "prefilter", "unpaid"), (2, 11, "cur", "prefilter", "level"), (3, 12, "cur", "local", None)],
                                  "job_id int, eval_seq int, profile_hash string, model string, hard_reject_reason string")
    reasons = spark.createDataFrame([(1, None), (2, "unpaid"), (3, "other")], "job_id int, reason string")
    changes = merge.unreject_stale(S, evals, reasons)
    after = merge.apply_unreject(evals, changes)
    assert {(r.job_id, r.hard_reject_reason) for r in after.collect()} == {(2, "unpaid"), (3, None)}
    assert merge.unreject_stale(S, after, reasons).count() == 0


def test_entities_bridge_through_a_shared_board(spark):
    rows = [(1, "Vega Inc.", "b1", "harvest", 2, 50, ""), (2, "Vega Systems", "B1", "yaml", None, 70, "v.org"), (3, "Vega", None, "harvest", 1, None, ""), (4, "Lyra", None, "manual", 3, 10, "")]
    df = spark.createDataFrame(rows, "rec_id int, name string, board string, source string, tier int, reputation int, domain string")
    got = {r.label: (r.name, r.tier, r.reputation, r.records) for r in companies.merge_entities(df).collect()}
    assert got == {1: ("Vega Systems", 1, 70, 3), 4: ("Lyra", 3, 10, 1)}


def test_a_second_batch_keeps_deadline_and_pending_evaluation(spark):
    now = dates.at("2024-01-31 00:00:00")
    make = lambda rows: merge.keyed_rows(spark.createDataFrame([tuple(r[c.split()[0]] for c in _SCHEMA.split(", ")) for r in rows], _SCHEMA))
    stored = make([_posting(1, "Vega", "SWE Intern", "https://x.org/1", "Apply by 2024-03-01")])
    first = merge.upsert_postings(stored, make([_posting(11, "Vega", "SWE Intern", "https://x.org/1", "changed text")]), now)
    for batch in ([_posting(12, "Nova", "GPU Intern", "https://x.org/4", "unrelated")], []):
        out = {r.job_id: r for r in merge.upsert_postings(first, make(batch) if batch else make([_posting(9, "x", "y", "", "")]).limit(0), now).collect()}
        assert out[1].deadline == dt.date(2024, 3, 1) and out[1].needs_reeval and out[1].description_text == "changed text"
        assert out[1].title == "SWE Intern" and out[1].url == "https://x.org/1"


def test_a_long_chain_of_records_is_one_company(spark):
    rows = [(i, f"Name {i // 2}", f"board{(i + 1) // 2}", "yaml", None, None, "") for i in range(140)]
    df = spark.createDataFrame(rows, "rec_id bigint, name string, board string, source string, tier int, reputation int, domain string")
    out = companies.merge_entities(df).collect()
    assert len(out) == 1 and out[0].label == 0 and out[0].records == 140


def test_ranks_over_one_hot_value(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") < 450, F.lit("same")).otherwise(F.col("id").cast("string")).alias("day"))
    got = {r.id: r.rank for r in ranking.global_rank(df, [("day", "desc"), ("id", "asc")]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda t: t[1])] == [*range(450), *range(499, 449, -1)]


def test_a_resumed_upsert_stream_equals_batches(spark, tmp_path):
    from siftwork.streaming import jobs
    now = dates.at("2024-01-31 00:00:00")
    make = lambda rows: merge.keyed_rows(spark.createDataFrame([tuple(r[c.split()[0]] for c in _SCHEMA.split(", ")) for r in rows], _SCHEMA))
    state = make([_posting(1, "Vega", "SWE Intern", "https://x.org/1", "Apply by 2024-03-01")])
    stored = state
    batches = [make([_posting(11, "Vega", "SWE Intern", "https://x.org/1", "changed")]), make([_posting(12, "Nova", "GPU Intern", "https://x.org/4", None)]), make([_posting(13, "Nova", "GPU Intern", "https://x.org/4", "text")])]
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
        stream = jobs.file_stream(spark, f"{tmp_path}/landed", b.schema, maxFilesPerTrigger=1)
        if i:  # two calls over one folder: the second takes up the first's state
            out = jobs.upsert_stream(stream, stored, now, root=f"{tmp_path}/job")
        state = merge.upsert_postings(state, b, now)
    columns = ["job_id", "deadline", "needs_reeval", "description_text", "active", "title"]
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, state.select(*columns).collect()))


def test_batch_inference_retries_and_passes_failures_through(spark):
    rows = [(0, [1, 2], "p"), (1, [3], "p"), (2, [4], "p"), (3, [5], "p")]
    df = spark.createDataFrame(rows, "batch bigint, job_ids array<bigint>, prompt string").coalesce(1)
    calls = []

    def scorer(batch, prompt):
        calls.append(batch)
        if batch == 1 or (batch == 3 and calls.count(3) == 1):
            raise RuntimeError("down")
        return {4: 200} if batch == 2 else {1: 7} if batch == 0 else {5: 9}
    got = sorted(map(tuple, packing.batch_inference(df, scorer).collect()))
    assert got == [(0, 1, 7, None), (0, 2, None, None), (1, 3, None, "down"), (2, 4, None, "invalid scorer output"), (3, 5, 9, None)]


def test_custom_role_types_are_checked(spark, tmp_path):
    import pytest

    from siftwork import catalog
    from siftwork.config import RolePick
    from siftwork.functions import roles
    picks = (RolePick("My Photonics!", 190, "Photonics", ("c++", " ", "Photonic", "ray optics")), RolePick("gpu", 10), RolePick("gpu", 90))
    s = S.but(role_types=picks)
    assert [(p.key, p.weight, p.keywords) for p in s.role_types] == [("my-photonics", 100, ("photonic", "ray optics")), ("gpu", 90, ())]
    with pytest.raises(ValueError):
        RolePick(" !! ")
    titles = ["Ray Optics Intern (photonic)", "Security Engineer Intern", "Quantitative Researcher, photonic", "Chief of Staff", None, "photonics"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, title string")
    got = [r.role for r in df.select("i", roles.classify(s, F.col("title")).alias("role")).orderBy("i").collect()]
    assert got == ["my-photonics", "security", "quantresearch", "general", "general", "general"]
    catalog.catalog_frame(spark).write.parquet(str(tmp_path / "c"))
    assert catalog.read_catalog(spark, str(tmp_path / "c")) == catalog.default_catalog()
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, str(tmp_path / "c"), most=3)


def test_phrases_as_an_alternation_finds_them(values):
    """Leftmost, first listed, not overlapping, between word boundaries: the same as one pattern over all words."""
    import re

    from siftwork.functions import phrases, roles, scoring
    words = ["gpu", "gpu kernels", "kernels", "linux", "bare-metal", "a b c", "b c", "c d e f", "c++", "node js"]
    texts = ["GPU kernels on Linux", "kernels, gpu kernels", "bare-metal bare metal", "a b c d e f", "b c d e f", "xlinux linux2 linux", "c++ and C++11", "node  js node js", "", "gpu-linux.gpu"]
    order = [w.lower() for w in words if w != "c++"]
    rx = re.compile("|".join(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])" for w in order))
    want = [sorted(set(rx.findall(t.lower())) | ({"c++"} if "c++" in t.lower() else set())) for t in texts]
    assert [sorted(v) for v in values([(t,) for t in texts], "t string", lambda df: scoring.keyword_hits(df.t, words))] == want
    groups = [("gpu", "gpu kernels", "kernels"), ("kernels", "linux"), ("b c", "a b c", "c d e f")]
    longest = [re.compile("|".join(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])" for w in sorted(g, key=len, reverse=True))) for g in groups]
    counts = [{i: len(set(rx.findall(t.lower()))) for i, rx in enumerate(longest) if rx.search(t.lower())} for t in texts]
    got = values([(t,) for t in texts], "t string", lambda df: phrases.group_counts(F.lower(df.t), groups))
    assert [{h.g: h.hits for h in v} for v in got] == counts


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Links that are stars around their smallest node are the answer already; others take rounds until they are."""
    from siftwork.operators import components as module
    stored, paths = module._stored, []
    monkeypatch.setattr(module, "_stored", lambda df, path: paths.append(path) or stored(df, path))
    star = spark.createDataFrame([(1, 2), (3, 1), (1, 4), (4, 1), (7, 8), (9, 9)], "u long, v long")
    assert sorted(map(tuple, module.components(star).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]
    assert len(paths) == 1
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 32), (31, 32)], "u long, v long")
    assert sorted(map(tuple, module.components(chain).collect())) == [(i, 0) for i in range(21)] + [(30, 30), (31, 30), (32, 30)]
    assert module.components(star.limit(0)).count() == 0
