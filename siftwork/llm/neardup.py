"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A shingle is ``SHINGLE`` consecutive words (letters, digits and non-ASCII, A-Z lower-cased); a text of fewer words is one shingle. Its
weight in a document is its count times an inverse document frequency. Frequencies are counted over all documents in ``2**BUCKETS``
hash buckets, the hashing form of TF-IDF: exact counts per shingle would move every shingle of the corpus through two shuffles.

1. Every document draws ``BANDS * ROWS`` samples by improved consistent weighted sampling; a band's samples hash to a key. Equal texts
   (word for word) are one node from here on. Nodes that share no band key with another are done.
2. The remaining nodes are candidates. Their shingles are put in one global order, rarest among the candidates first; two documents of
   similarity ``threshold`` must share a shingle among those that come before ``1 - threshold`` of the weight, and the weights before a
   shared shingle bound the similarity (prefix and positional filters, exact). Copies edited apart and documents that only share a
   passage thus do not turn into pairs.
3. In each prefix group a few pivots are compared with all members by exact weighted Jaccard, and classes are merged: a group of a third
   of all rows costs a few comparisons a member. Last, members of different classes that the filters still admit are compared.
   Pairs already in one class are never compared, and no link between classes is missed.

Class ids are the smallest doc_id of the class. Nothing is capped. Broadcast: the bucket weights, ``2**BUCKETS`` floats, and bitmaps of
``2**BITS`` bits (16 MB) of the candidates' texts and of the vectors that a comparison needs, so that others are not shuffled.

Nulls and edges: null texts and texts without words are their own class each and never linked; a null doc_id takes part, and a class
of only such rows has a null id; repeated rows are one class; ties in the choice of pivots go to the smaller node number; empty tables
give empty results. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.tables import arrow_map, kept, picked, signed
from siftwork.llm.words import Words, byte_classes, column_bytes, hash_words, mix
from siftwork.operators.components import components

LETTERS = byte_classes(c0=[x for x in range(128) if not chr(x).isalnum()])
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
BUCKETS = 18
PIVOTS = 16
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) for every shingle, in order."""
    n = np.diff(w.offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = w.offsets[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    h = np.zeros(len(text), np.uint64)
    padded = np.concatenate([w.hash, np.zeros(size, np.uint64)])
    for j in range(size):
        inside = at + j < w.offsets[text + 1]
        h = mix(h * _STEP + np.where(inside, padded[at + j], np.uint64(0)) + np.uint64(j + 1))
    return text, h


@lru_cache(1)
def _tables(samples: int) -> dict[str, np.ndarray]:
    """Random numbers of the sampler, looked up by bits of a shingle's hash: sums of two exponentials and of two uniforms, and the
    logarithm of a gamma variable."""
    g = np.random.default_rng(20240229)
    draw = lambda f, n: f((1 << n, samples)).astype(np.float32)
    exp, uni = (lambda s: g.exponential(size=s)), (lambda s: g.random(size=s))
    return {"r1": draw(exp, 12), "r2": draw(exp, 12), "b1": draw(uni, 12), "b2": draw(uni, 12), "c": draw(lambda s: np.log(g.gamma(2.0, size=s)), 14)}


def weighted_samples(h: np.ndarray, weight: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """Improved consistent weighted sampling of one weighted set (distinct ``h``): one hash per sample of the chosen (element, level)."""
    t, low, high = _tables(samples), np.uint64(0xFFF), np.uint64(0x3FFF)
    best = np.full(samples, np.inf, np.float32)
    out = np.zeros(samples, np.uint64)
    every = np.arange(samples)
    for i in range(0, len(h), 1024):
        x, log_w = h[i:i + 1024], np.log(weight[i:i + 1024]).astype(np.float32)[:, None]
        pick = lambda name, shift, mask: t[name][((x >> np.uint64(shift)) & mask).astype(np.intp)]
        r = pick("r1", 0, low) + pick("r2", 12, low)
        beta = pick("b1", 38, low) + pick("b2", 50, low)
        beta -= np.floor(beta)
        level = np.floor(log_w / r + beta)
        a = pick("c", 24, high) - r * (level - beta) - r
        least = a.argmin(0)
        better = a[least, every] < best
        best = np.where(better, a[least, every], best)
        out = np.where(better, mix(x[least] + level[least, every].astype(np.int64).view(np.uint64) * _STEP), out)
    return out


def bucket_weights(docs: DataFrame, size: int = SHINGLE, bits: int = BUCKETS) -> np.ndarray:
    """Inverse document frequency of each hash bucket over all documents."""
    counts: list[np.ndarray] = []

    def step(batch) -> None:
        if not counts:
            counts.append(np.zeros((1 << bits) + 1, np.int64))
        text, h = shingles(hash_words(column_bytes(batch, "text"), LETTERS), size)
        seen = np.unique(text << bits | (h >> np.uint64(64 - bits)).astype(np.int64))
        counts[0][:-1] += np.bincount(seen & (1 << bits) - 1, minlength=1 << bits)
        counts[0][-1] += batch.num_rows

    def finish() -> dict | None:
        if not counts:
            return None
        at = np.flatnonzero(counts[0])
        return {"bucket": at.astype(np.int32), "n": counts[0][at]}

    rows = arrow_map(docs.select("text"), step, "bucket int, n bigint", finish).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2**bits + 1 numbers
    df = np.zeros((1 << bits) + 1)
    df[rows.bucket.to_numpy(int)] = rows.n.to_numpy(float)
    return np.append(1 + np.log((1 + df[-1]) / (1 + df[:-1])), 0.0).astype(np.float32)[:-1]


def _weighted(batch, idf: np.ndarray, size: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(row, content key, sorted distinct shingles, weights) of each text with words."""
    w = hash_words(column_bytes(batch, "text"), LETTERS)
    text, h = shingles(w, size)
    ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
    shift = np.uint64(64 - int(np.log2(len(idf))))
    for i in range(batch.num_rows):
        if ends[i] < ends[i + 1]:
            x, n = np.unique(h[ends[i]:ends[i + 1]], return_counts=True)
            yield i, hashlib.md5(w.hash[w.offsets[i]:w.offsets[i + 1]].tobytes()).digest(), x, n * idf[(x >> shift).astype(np.intp)].astype(float)


def signatures(docs: DataFrame, idf, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, tk, node, bands): node is null for texts without words."""
    def step(batch) -> dict:
        node: list = [None] * batch.num_rows
        keys: list = [None] * batch.num_rows
        number = np.arange(bands, dtype=np.uint64)
        for i, content, x, weight in _weighted(batch, idf.value, size):
            s = weighted_samples(x, weight, bands * rows).reshape(bands, rows)
            key = number
            for j in range(rows):
                key = mix(key * _STEP + s[:, j] + np.uint64(1))
            node[i], keys[i] = content, signed(key)
        return {"doc_id": batch.column(0), "tk": batch.column(1), "node": node, "bands": keys}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("tk"), "text"), step, f"doc_id {kind}, tk bigint, node binary, bands array<bigint>")


def vectors(docs: DataFrame, idf, size: int) -> DataFrame:
    """(did, tk, total, shingles, weights): the sparse vector of each text with words of ``docs`` (did, tk, text)."""
    def step(batch) -> dict:
        out: dict[str, list] = {k: [] for k in ("did", "tk", "total", "shingles", "weights")}
        did, tk = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, _, x, weight in _weighted(batch, idf.value, size):
            small = weight.astype(np.float32)
            for k, v in zip(out, (did[i], tk[i], small.sum(dtype=float), signed(x), small)):
                out[k].append(v)
        return out
    return arrow_map(docs.select("did", "tk", "text"), step, "did string, tk bigint, total double, shingles array<bigint>, weights array<float>")


def candidate_nodes(signed_docs: DataFrame) -> DataFrame:
    """(content, did, tk, node): of the nodes that share a band key with another, one document each and a number. Only 8-byte hashes of nodes
    go along with the keys; two nodes of one hash would at most make a candidate more."""
    own = signed_docs.where(F.col("node").isNotNull())
    keyed = own.groupBy("node").agg(F.first("bands").alias("bands")).select(F.xxhash64("node").alias("h"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    hits = keyed.join(shared, "key").select("h").distinct()
    one = own.groupBy("node").agg(F.min(F.struct("did", "tk")).alias("one")).withColumn("h", F.xxhash64("node"))
    return one.join(hits, "h", "left_semi").select(F.col("node").alias("content"), "one.*", F.monotonically_increasing_id().alias("node"))


def prefix_groups(vecs: DataFrame, threshold: float) -> DataFrame:
    """(k, node, total, before, degree): the shingles of a node's prefix that other candidates hold too, and the weight before each."""
    rows = vecs.select("node", "total", F.inline(F.arrays_zip(F.col("shingles").alias("k"), F.col("weights").cast("array<double>").alias("w"))))
    frequency = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("node")
    upto = own.orderBy("n", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("total") - F.sum("w").over(own) + F.sum("w").over(upto) - F.col("w")  # shingles of no other candidate come first
    placed = rows.join(frequency, "k").select("k", "node", "total", "n", before.alias("before")).where(F.col("before") <= (1 - threshold) * F.col("total") * (1 + 1e-6))
    return placed.select("k", "node", "total", "before", F.sum("n").over(own).alias("degree"))


def _similar(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for f in frames:
        j = np.zeros(len(f))
        for i, (xs, xw, ys, yw) in enumerate(zip(f["xs"], f["xw"], f["ys"], f["yw"])):
            _, a, b = np.intersect1d(xs, ys, assume_unique=True, return_indices=True)
            both = np.minimum(xw[a], yw[b]).sum(dtype=float)
            j[i] = both / (xw.sum(dtype=float) + yw.sum(dtype=float) - both)
        yield f.loc[j >= threshold - 1e-7, ["u", "v"]]


def linked_nodes(members: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """(node, label) of the nodes that similarity links, from groups ``members`` (k, node, total, before, degree)."""
    members = kept(members, "near-members")
    labels = None
    for pivots in (1, PIVOTS, None):
        now = members.withColumn("label", F.col("node"))  # all labels differ at first
        if labels is not None:
            now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            mixed = now.groupBy("k").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("k")
            now = kept(now.join(mixed, "k"), "near-mixed")
        p, x = now.alias("p"), now.alias("x")
        if pivots is not None:
            place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("degree"), "node"))
            p = now.select("*", place.alias("place")).where(F.col("place") <= pivots).alias("p")
        # what can still be shared from this shingle on bounds the similarity
        most = F.least(F.col("p.total") - F.col("p.before"), F.col("x.total") - F.col("x.before"))
        apart = F.col("p.label") != F.col("x.label") if pivots is not None else F.col("p.label") < F.col("x.label")
        pairs = (p.join(x, "k").where(apart & (most * (1 + 1e-6) >= threshold * (F.col("p.total") + F.col("x.total") - most)))
                 .select(F.least("p.node", "x.node").alias("u"), F.greatest("p.node", "x.node").alias("v")).distinct())
        pairs = kept(pairs, "near-pairs")
        if labels is not None and pairs.isEmpty():
            continue
        # only vectors of these pairs are moved; written, so that no stage of small joins chains three Python workers a task
        vec = kept(picked(vecs.select("node", "shingles", "weights"), pairs.select(F.explode(F.array("u", "v")).alias("node")), "node"), "near-compared")
        with_u = pairs.join(vec.select(F.col("node").alias("u"), F.col("shingles").alias("xs"), F.col("weights").alias("xw")), "u")
        with_both = with_u.join(vec.select(F.col("node").alias("v"), F.col("shingles").alias("ys"), F.col("weights").alias("yw")), "v")
        found = kept(with_both.mapInPandas(lambda fs: _similar(fs, threshold), "u bigint, v bigint"), "near-links")
        if labels is None:
            labels = components(found)
        elif not found.isEmpty():
            labels = components(found.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    return labels


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, tk (hash of the text), node (key of the text's words), label (node of the class), class_id, class_size."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(bucket_weights(docs, size))
    signed_docs = kept(signatures(docs, idf, size, bands, rows), "near-signatures")
    did = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did")
    # from here on a candidate goes by a number, a third of its key's size in every row of the groups
    candidates = kept(candidate_nodes(signed_docs.withColumn("did", did)), "near-candidates")
    # no text is moved: vectors are made where the texts are read, and a text's copies under one id are one before the join
    # written: in one stage with the vectors, each task would hold two Python workers
    texts = kept(picked(docs.select(did, F.xxhash64("text").alias("tk"), "text"), candidates, "did", "tk"), "near-texts")
    once = vectors(texts, idf, size).dropDuplicates(["did", "tk"])
    vecs = kept(once.join(candidates.select("did", "tk", "node"), ["did", "tk"]).drop("did", "tk"), "near-vectors")
    labels = linked_nodes(prefix_groups(vecs, threshold), vecs, threshold)
    # tables on both sides, so that Spark can split a class or a text of a third of all rows
    linked = kept(labels.join(candidates.select("node", "content"), "node").select(F.col("content").alias("node"), "label"), "near-linked")
    heads = kept(linked.groupBy("label").agg(F.min("node").alias("head")), "near-heads")
    headed = kept(linked.join(heads, "label").select("node", F.col("head").alias("label")), "near-labels")
    named = kept(signed_docs.select("doc_id", "tk", "node").join(headed, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-named")
    ids = kept(named.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "near-classes")
    alone = F.col("label").isNull()
    return named.join(ids, "label", "left").select("doc_id", "tk", "node", "label", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("class_size")).alias("class_size"))
