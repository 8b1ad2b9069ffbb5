"""The n-gram Jaccard join beside all pairs."""
import random
import re

import numpy as np
import pytest

from siftwork.llm import overlap


def sets(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))}


def brute(rows, percent=80):
    found = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(found):
        for j in range(i):
            if a and found[j] and 100 * len(a & found[j]) >= percent * len(a | found[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted([(d, len(found[i]), least.get(root(i)) if found[i] else d) for i, (d, _) in enumerate(rows)], key=repr)


def corpus(seed):
    g = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    draw = lambda n: [g.choice(words) for _ in range(n)]
    rows, at = [], 0
    common = draw(30)
    for size in (8, 25, 60, 200):
        for _ in range(4):
            base = draw(size) + (common if g.random() < 0.5 else [])
            for _ in range(12):  # copies edited apart: some pairs reach the threshold, some do not
                words_now = list(base)
                for _ in range(g.randrange(0, 4)):
                    words_now[g.randrange(len(words_now))] = g.choice(words)
                rows.append((at, " ".join(words_now)))
                at += 1
    hot = draw(40)
    rows += [(at + i, " ".join(hot[: 40 - i % 5])) for i in range(60)]  # a large group of copies and near copies
    return rows


@pytest.mark.parametrize("percent", [80, 55])
def test_components_equal_all_pairs(spark, percent):
    rows = corpus(percent)
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, set string, node int, n int").repartition(5)
    got = sorted(map(tuple, overlap.classes(df, percent=percent).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute(rows, percent)


def test_short_lists_lose_chance_only(spark, monkeypatch):
    """Lists of every length are cut down before the search, whatever counts as short; documents that share single shingles go no further."""
    g = random.Random(3)
    draw = lambda n: [g.choice([f"w{i}" for i in range(5000)]) for _ in range(n)]
    rare = [draw(5) for _ in range(40)]
    rows = [(i, " ".join(draw(50) + rare[i % 40] + draw(50))) for i in range(120)]  # three documents a rare shingle, nothing else alike
    rows += [(1000 + i, rows[i][1] + " and more") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(overlap, "bucket_counts", lambda docs, size: np.ones(1 << 14, np.uint32))  # no shingle counts as rare: as in a very large corpus
    whole, left = overlap.without_chance, []
    for few in (0, 8):
        def cut(lists, percent):
            out = whole(lists, percent, few)
            left.append(out.select("node").distinct().count())
            return out
        monkeypatch.setattr(overlap, "without_chance", cut)
        assert sorted(map(tuple, overlap.classes(df).collect()), key=repr) == brute(rows)
    assert left[0] > left[1] == 20


def test_needed_texts_hold_every_key(spark):
    docs = spark.range(4000).selectExpr("cast(id as string) as did", "id * 7 as tk", "concat('t', id) as text")
    wanted = docs.where("tk % 5 = 0").unionByName(docs.limit(5)).select("did", "tk")
    want = {r.did for r in wanted.collect()}
    wide, narrow = ({r.did for r in overlap.needed_texts(docs, wanted, bits).collect()} for bits in (27, 9))
    assert want <= wide and len(wide - want) <= 3 and want <= narrow
    assert overlap.needed_texts(docs, wanted.limit(0)).count() == 0


def test_fixed_size_tables_take_a_few_jobs(spark):
    """Bitmaps and bucket counts come in one job (and those of adaptive stages), not in one for each shuffle partition."""
    docs = spark.range(300).selectExpr("cast(id as string) as did", "id as tk", "concat('a b c d e f ', id) as text")
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("fixed-size", "tables of fixed size")
        assert overlap.needed_texts(docs, docs.select("did", "tk").limit(40)).count() >= 40
        assert overlap.bucket_counts(docs, 5, 16).sum() == 300 * 3
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fixed-size")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in overlap.classes(odd_docs).collect()], key=repr)
    assert got == brute(rows)
    assert overlap.classes(no_docs).collect() == []


def test_words_end_at_blanks_only_and_fold_ascii(spark):
    rows = [(1, "One two\tTHREE,\x0bfour É"), (2, "one two three, four É"), (3, "one two three, four é"), (4, "one-two"), (5, "ONE-TWO\n"), (6, "a b c d"), (7, "a b c d e"), (8, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, overlap.classes(df).collect())) == brute(rows)


def test_search_is_exact():
    g = np.random.default_rng(5)
    universe = g.integers(0, 1 << 63, 120).astype(np.uint64)
    some = [np.unique(g.choice(universe, g.integers(1, 100), replace=False)) for _ in range(80)]
    some += [np.unique(np.concatenate([some[0], g.choice(universe, 3)])) for _ in range(30)]
    index = overlap.Index(some)
    for percent in (80, 50, 100):
        for q in some[:40]:
            want = [i for i, x in enumerate(some) if 100 * len(np.intersect1d(q, x)) >= percent * len(np.union1d(q, x))]
            assert sorted(index.search(q, percent)) == want
