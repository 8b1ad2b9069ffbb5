"""Ordered matching of postings, and tables whose versions share untouched buckets."""
import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import merge
from siftwork.sources.sinks import BucketedTable


def _in_order(batch, stored):
    keys, urls = {k: i for i, k, _ in stored}, {}
    for i, _, u in sorted(stored, reverse=True):
        if u:
            urls[u] = i
    out, own_urls = {}, {}
    for i, k, u in sorted(batch):
        target = keys.get(k, None)
        if target is None and u:
            target = urls.get(u, own_urls.get(u))
        if target is None:
            keys[k] = target = i
            if u:
                own_urls[u] = i
            out[i] = (i, True)
        else:
            out[i] = (target, False)
    return out


def _resolved(spark, batch, stored):
    schema = "job_id bigint, dedup_key string, curl string"
    got = merge.resolve(spark.createDataFrame(batch, schema), spark.createDataFrame(stored, schema)).collect()
    assert len(got) == len(batch)
    return {r.job_id: (r.target, r.inserted) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_a_loop_over_the_rows(spark, seed):
    g = random.Random(seed)
    row = lambda i: (i, f"k{g.randrange(25)}", g.choice(["", *[f"u{n}" for n in range(25)]]))
    stored = [(1000 + n, f"k{n}", f"u{g.randrange(40)}") for n in range(6)]
    batch = [row(i) for i in range(120)]
    assert _resolved(spark, batch, stored) == _in_order(batch, stored)


def test_a_chain_of_keys_and_urls(spark):
    """The second row has the first one's URL, the third the first one's key and a URL of its own, which the fourth shares."""
    batch = [(1, "a", "u"), (2, "b", "u"), (3, "a", "v"), (4, "c", "v"), (5, "b", "w"), (6, "d", "w"), (7, "e", ""), (8, "f", "")]
    got = _resolved(spark, batch, [(90, "z", "")])
    assert got == _in_order(batch, [(90, "z", "")])
    assert got[2] == (1, False) and got[3] == (1, False) and got[4] == (4, True) and got[6] == (5, False) and got[8] == (8, True)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "k", 8)
    schema = "k string, n int"
    rows = {f"k{i}": 0 for i in range(60)}
    table.write(spark.createDataFrame(list(rows.items()), schema), 0)

    def files():
        return {str(p.relative_to(tmp_path)) for p in (tmp_path / "t/data").rglob("*.parquet")}

    changed, seen = ["k3", "k7"], files()
    for version in (1, 2, 3, 3):     # the last one is a replay
        old = table.read(version - 1, schema)
        touched = {r.b for r in spark.createDataFrame([(k,) for k in changed], "k string").select(table.bucket().alias("b")).collect()}
        part = table.read(version - 1, schema, touched).withColumn("n", F.when(F.col("k").isin(changed), F.lit(version)).otherwise(F.col("n")))
        table.write(part, version, version - 1)
        now = {r.k: r.n for r in table.read(version, schema).collect()}
        assert now == {k: version if k in changed else 0 for k in rows} and old.count() == 60
        assert seen & files() == {f for f in seen if int(f.split("bucket=")[1].split("/")[0]) not in touched or f"v={version - 1}/" in f}
        seen = {f for f in seen & files() if "v=0/" in f and int(f.split("bucket=")[1].split("/")[0]) not in touched} | {f for f in files() if f"v={version}/" in f}
    held = {f.split("/")[2] for f in files()}
    assert held == {"v=0", "v=2", "v=3"} and table.version() == 3


def test_a_version_without_a_manifest_does_not_exist(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "k", 4)
    table.write(spark.createDataFrame([("a", 1)], "k string, n int"), 0)
    spark.createDataFrame([("a", 2)], "k string, n int").withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"{tmp_path}/t/data/v=1")
    assert table.version() == 0 and [tuple(r) for r in table.read(0, "k string, n int").collect()] == [("a", 1)]
