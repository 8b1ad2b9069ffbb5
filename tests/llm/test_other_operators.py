"""Pages, conversations, vectors and the pipeline."""
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import ann, chat, mainblocks, neardup, pieces, tables
from siftwork.llm.queries import QUERIES


def test_blocks_of_broken_markup():
    read = lambda h: [(p[-1] if p else "", t) for p, t, _ in mainblocks.read_blocks(h)]
    assert read("<p>a &amp; b<p>c<br>d</div> e<script>x</p></script> f") == [("p", "a & b"), ("p", "c d"), ("p", "e f")]
    assert read(None) == [] and read("") == [] and read("plain   text") == [("", "plain text")]
    assert read("<ul><li>1<li>2</ul><!-- no -->3") == [("li", "1"), ("li", "2"), ("", "3")]
    assert read("<!doctype html><html><head><title>t</title><article><p>x y</p></article>") == [("p", "x y")]
    assert read("<html><head><meta charset=u><article><p>x <math><mi>y</mi></math></p></article></html>") == [("p", "x y")]
    assert read("<html><head><title>t</title><noscript><style>a</style></noscript><script>var x</script><body><p>b") == [("p", "b")]
    assert read("<head><title>t</title>\n<link rel=x>plain <b>text</b>") == [("", "plain text")]
    assert read("<head><style>p {}</style></head><body class=x><p>b<noscript>no</noscript> c") == [("p", "b c")]


def test_gradient_of_the_recurrent_net():
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(4, 2, 3)), rng.normal(size=(3 + mainblocks.HIDDEN, 4 * mainblocks.HIDDEN)) * 0.3, rng.normal(size=4 * mainblocks.HIDDEN) * 0.1
    grad = rng.normal(size=(4, 2, mainblocks.HIDDEN))
    value = lambda w: (mainblocks._lstm(x, w, b)[0] * grad).sum()
    dw, _ = mainblocks._lstm_back(grad, mainblocks._lstm(x, w, b)[1], w)
    for i, j in ((0, 0), (2, 20), (5, 40), (10, 60)):
        step = np.zeros_like(w)
        step[i, j] = 1e-5
        assert abs((value(w + step) - value(w - step)) / 2e-5 - dw[i, j]) < 1e-5


def test_extraction(spark):
    page = lambda i: f"<html><head><title>t</title></head><body><nav><ul><li><a href=/x>Home {i}</a></ul></nav><article><h1>Title {i}</h1><p>First text of page {i}, with words.<p>Second &lt;text&gt;.</article><footer>Rights {i}</footer></body></html>"
    rows = [(i, "u", page(i), "x") for i in range(30)] + [(None, None, None, None), (40, "u", "", "x"), (41, "u", page(41) * 400, "x"), (1, "u", page(1), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    model = mainblocks.fit(pages, copies=2)
    got = {r.page_id: r.text for r in mainblocks.extract(pages, model).collect()}
    assert got[3] == "Title 3\nFirst text of page 3, with words.\nSecond <text>." and got[None] == "" and got[40] == ""
    assert got[41].count("\n") == 3 * 400 - 1
    assert mainblocks.extract(pages.limit(0), mainblocks.fit(pages.limit(0), copies=1)).count() == 0


def test_perspectives_edges(spark):
    rows = [("c", 0, "system", "be kind"), ("c", 1, "ann b", "hi <|im_end|>"), ("c", 2, "bob", "yo"), ("c", 2, "bob", "yo"), ("c", 200, None, None), (None, None, "x", "alone"), ("s", 0, "system", "only")]
    found = chat.perspectives(spark.createDataFrame([(*r, "z") for r in rows], "conv_id string, turn long, role string, text string, part string")).collect()
    by = {(r.conv_id, r.speaker, r.part): r for r in found}
    assert set(by) == {("c", s, p) for s in ("ann b", "bob", "unknown") for p in (0, 3)} | {(None, "x", None)}
    first = by["c", "ann b", 0]
    assert first.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <\\|im_end|><|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n"
    assert [first.text[m.start:m.end] for m in first.mask] == ["hi <\\|im_end|><|im_end|>"]
    assert "user name=ann_b" in by["c", "bob", 0].text and by["c", "unknown", 3].n_learned == 1


def exact(ids, x, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [int(ids[i]) for i in order], d[order]


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 8)).astype(np.float32)
    x[300:700] = x[300]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [None] + [1.0] * 7), (5003, [float("nan")] * 8), (None, [1.0] * 8), (5004, [1.0]), (5005, []), rows[7]]
    frame = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, score int")
    found = {}
    for r in ann.search(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, hits = np.arange(1200), 0
    assert sorted(found) == list(range(0, 1200, 100))
    for q, got in found.items():
        want, d = exact(ids, x.astype(float), q, 10)
        hits += len(set(want) & {v for v, _ in got})
        assert len(got) == 10 and got == sorted(got, key=lambda t: (t[1], t[0]))
    assert hits >= 0.9 * 120
    assert [v for v, _ in found[300]] == [*range(301, 311)] and [v for v, _ in found[400]] == [*range(300, 310)]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.search(few, F.col("vec_id") == 0).count() == 2 and ann.search(few.limit(0), F.lit(True)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    good = lambda i: " ".join(f"word{(i * 7919 + j * j * 31 + j * i) % 997}" for j in range(60))
    item = "a benchmark question of exactly twelve words that must not leak anywhere"
    texts = {i: good(i) for i in range(40)}
    texts[100] = texts[101] = texts[5]
    texts[102] = texts[6] + " tail"
    texts[103] = texts[7] + " " + item
    texts[104] = good(104) + " password = hunter2hunter2"
    for i in range(200, 240):
        texts[i] = "BUY!! NOW!! " * (20 + i % 5)
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[3], (300, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(kept) and set(kept) - {300} == set(range(40)) | {104}  # 102 is a near copy of 6
    assert "[assign]" in kept[104].text and kept[104].n_chars == len(kept[104].text) and re.search("hunter", kept[104].text) is None
    assert all(kept[i].text == texts[i] for i in range(40)) and all(r.ids for r in kept.values() if r.text)


def test_every_contract_query_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


def test_rest_of_a_parted_table_is_not_shuffled(spark):
    docs = spark.range(4000).selectExpr("cast(id as string) as did", "id * 7 as tk", "concat('t', id) as text")
    marked = docs.where("tk % 5 = 0").select("did", "tk")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bits in (24, 9):
            met, rest = tables.parted(docs, marked, "did", "tk", bits=bits)
            got, others = sorted(map(tuple, met.collect())), sorted(map(tuple, rest.collect()))
            assert sorted(got + others) == sorted(map(tuple, docs.collect())) and {(r.did, r.tk) for r in marked.collect()} <= {x[:2] for x in got}
            assert bits == 9 or len(got) <= 803
            assert "SortMergeJoin" not in (plan := rest._jdf.queryExecution().executedPlan().toString()) and "Python" not in plan
        met, rest = tables.parted(docs, marked.limit(0), "did", "tk")
        assert met.count() == 0 and rest.count() == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near_duplicate_stage_keeps_one_row_of_each_class(spark):
    """Nulls, repeated rows of the one that stays and of one that goes, and as many rows alone; whatever the bitmap lets through."""
    text = lambda i: " ".join(f"word{(i * 7919 + j * j * 31 + j * i) % 997}" for j in range(60))
    rows = [(i, text(i), "en", "s", i) for i in range(20)]
    rows += [(30, text(3), "en", "s", 1), (30, text(3), "en", "s", 2), (3, text(3), "de", "s", 3), (3, text(3), "en", "a", 3)]
    rows += [(None, text(4), "en", "s", 4), (None, text(50), "en", "s", 50), (None, text(50), "en", "s", 51), (None, None, None, None, None), (None, None, None, None, None), (60, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    want = [r for r in rows[:20] if r[0] != 3] + [(3, text(3), "de", "s", 3), rows[25], *rows[27:]]
    assert got == sorted(want, key=repr)


def test_vectors_take_one_python_worker_a_task(spark, monkeypatch):
    """The choice of texts and the vectors run in stages of their own: together each task held two Python workers, on top of the JVM."""
    whole, plans = neardup.vectors, []

    def seen(docs, *rest):
        out = whole(docs, *rest)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(neardup, "vectors", seen)
    words = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, words), (2, words + " more"), (3, "other")], "doc_id long, text string")
    assert neardup.classes(docs).count() == 3
    assert plans and all(p.count("MapInArrow") == 1 and "EvalPython" not in p for p in plans)


def test_blocks_of_any_size_give_the_same_ids(spark):
    rows = [(0, None), (1, ""), (2, "one two  three \u2581 é"), (3, "日本 \U0001F600 " * 50), (4, "x" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    few, many = ([tuple(r) for r in pieces.encode_column(docs, check="back", block_chars=n).orderBy("doc_id").collect()] for n in (1, 1 << 22))
    assert few == many and [r[-1] for r in few] == [None, *[True] * 4]
