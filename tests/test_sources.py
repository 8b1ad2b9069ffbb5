"""Scorer envelopes and the run log."""
import datetime as dt

from siftwork.sources import feeds, sinks


def test_each_record_is_judged_by_itself(spark):
    cases = [
        ('{"evaluations":[{"job_id":1,"skills_match":7,"fit_tags":["x"]},{"job_id":2,"confidence":null},{"skills_match":1},{"job_id":"x"},7,null,{"job_id":3,"interest":101},{"job_id":4,"interest":2.5},'
         '{"job_id":5,"fit_tags":"x"},{"job_id":6,"summary":null},{"job_id":7,"hard_reject_reason":null,"wildcard":true},{"job_id":8,"wildcard":"perhaps"}]}',
         [None, "type:confidence", "no_id", "no_id", "not_object", "not_object", "range:interest", "type:interest", "type:fit_tags", "type:summary", None, "type:wildcard"]),
        ('{"evaluations":[]}', []), ('{"evaluations":{"job_id":1}}', ["no_list"]), ('{"triages":[]}', ["no_list"]), ('{"evaluations":[', ["malformed"]), (None, ["malformed"]), ("[]", ["no_list"])]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "batch int, payload string")
    out = feeds.parse_scorer_batches(df, "evaluations")
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.batch, r.position or 0)):
        got.setdefault(r.batch, []).append(r)
    assert [[r.verdict for r in got.get(i, [])] for i in range(len(cases))] == [want for _, want in cases]
    first, wild = got[0][0], got[0][10]
    assert (first.job_id, first.skills_match, first.confidence, first.fit_tags, first.red_flags, first.summary, first.wildcard) == (1, 7, 50, ["x"], [], "", False)
    assert wild.wildcard and wild.hard_reject_reason is None
    refused = feeds.quarantined(out).collect()
    assert len(refused) == 15 and {r.record for r in refused if r.verdict == "range:interest"} == {'{"interest":101,"job_id":3}'}


def test_triage_defaults(spark):
    df = spark.createDataFrame([('{"triages":[{"job_id":1},{"job_id":2,"score":12,"reason":"far"},{"job_id":3,"score":-1}]}',)], "payload string")
    got = [(r.verdict, r.job_id, r.score, r.reason) for r in feeds.parse_scorer_batches(df, "triages").orderBy("position").collect()]
    assert got == [(None, 1, 100, ""), (None, 2, 12, "far"), ("range:score", 3, -1, "")]


def test_a_run_log_is_merged_on_read(spark, tmp_path):
    log = sinks.RunLog(spark, str(tmp_path / "log"))
    at = lambda h: dt.datetime(2024, 1, 1, h)
    start = lambda *rows: log.start(spark.createDataFrame(rows, "run_id bigint, kind string, started_at timestamp_ntz"))
    finish = lambda *rows: log.finish(spark.createDataFrame(rows, "run_id bigint, finished_at timestamp_ntz, tokens bigint, errors array<string>"))
    state = lambda: {r.run_id: (r.kind, r.finished_at, r.tokens, r.errors) for r in log.read().collect()}
    assert state() == {}
    start((1, "run", at(1)), (2, "discover", at(2)))
    finish((1, at(3), 10, ["slow"]), (9, at(3), 1, []))
    want = {1: ("run", at(3), 10, '["slow"]'), 2: ("discover", None, None, None)}
    assert state() == want
    log.compact()
    assert state() == want
    finish((1, at(4), None, []))
    start((3, "run", at(5)))
    want = {1: ("run", at(4), 10, None), 2: want[2], 3: ("run", None, None, None)}
    assert state() == want
    log.compact()
    log.compact()
    assert state() == want
