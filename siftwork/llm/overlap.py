"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, by T-occurrence search over inverted lists.

A document's set holds its distinct ``SHINGLE``-word shingles (A-Z lower-cased; a shorter text is one shingle). Two documents link when
their Jaccard similarity reaches ``PERCENT``; documents that reach one another by links are one component.

1. Equal sets are one node from here on, whatever the number of copies.
2. Candidates: similar sets of n elements share at least ceil(0.8 n), so they share one among the n - ceil(0.8 n) + 1 that come first in a
   global order (rarest first, by counts of all shingles in hash buckets; the order decides the speed, never the result). The inverted
   lists of these elements are built by one shuffle; lists of one node go, lists of the same nodes become one. The pairs of
   lists of ``FEW`` nodes or fewer are counted at once, and what is in no pair that can still link leaves these lists: documents that
   share a rare shingle by chance, ever more of them in a larger corpus, go no further.
   Of these lists, which are the short ones of a set, a pair must share as many as the overlap it needs exceeds what can follow them.
3. Search, in cells of bounded size: a cell holds some query nodes and some nodes of one list, with their whole texts. Its task builds the
   inverted lists of all their shingles and answers each query by DivideSkip: of the T occurrences that a result needs, the longest
   lists can hold at most their number L, so only the shorter lists are merged (by a heap) and what occurs there T - L times is
   looked up in the long lists by binary search. What reaches the overlap for its size is a link; the count is exact.
4. Queries first are the nodes that share most lists (one a list, then ``PIVOTS``), against the nodes not yet connected to them; last, all
   nodes of a list that still belong to different components and whose sizes and places in the lists allow a link. A large group of
   near copies thus costs a few searches a member. No link between different components is missed.

A list of very many nodes that are all similar just below the threshold is compared pair by pair in step 4; everything else is bounded
by the lists' lengths. Nothing is capped. Broadcast: the bucket counts, ``2**BUCKETS`` numbers (16 MB), and a bitmap of ``2**BITS`` bits
(16 MB) of the texts that a search needs. The bitmap only spares shuffling others: beyond some 100 million needed texts it lets more through.

Nulls and edges: null texts and texts without words have an empty set and link with nothing; a null doc_id takes part, and a component of
only such rows has a null id; repeated rows are one node; an empty table gives no rows. Texts are read whole. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.neardup import shingles
from siftwork.llm.tables import BITS, arrow_map, kept, picked, signed
from siftwork.llm.words import byte_classes, column_bytes, hash_words, in_sorted
from siftwork.operators.components import components

WORDS = byte_classes(c0=[32, *range(9, 14)])
SHINGLE, PERCENT = 5, 80
BUCKETS = 22
SLICE = 14
PIVOTS = 16
FEW = 8                   # nodes of a list whose pairs are counted at once
QUERIES, NODES = 32, 256  # of a cell, about
SKIP = 0.0085             # of DivideSkip's rule for the number of long lists


def needed(a, b, percent: int = PERCENT):
    """Least overlap of sets of a and b elements that link."""
    return -(-percent * (a + b) // (100 + percent))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text with words."""
    text, h = shingles(hash_words(column_bytes(batch, "text"), WORDS), size)
    ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        if ends[i] < ends[i + 1]:
            yield i, np.unique(h[ends[i]:ends[i + 1]])


def bucket_counts(docs: DataFrame, size: int = SHINGLE, bits: int = BUCKETS) -> np.ndarray:
    """Shingles of all documents by hash bucket. Tasks send their counts as packed slices, which are added up one after another."""
    counts: list[np.ndarray] = []

    def step(batch) -> None:
        if not counts:
            counts.append(np.zeros(1 << bits, np.uint32))
        _, h = shingles(hash_words(column_bytes(batch, "text"), WORDS), size)
        np.add.at(counts[0], (h >> np.uint64(64 - bits)).astype(np.intp), np.uint32(1))

    def packed(numbers: list, arrays: list[np.ndarray]) -> dict:
        return {"slice": numbers, "data": [zlib.compress(x.tobytes(), 1) for x in arrays]}

    def finish() -> dict | None:
        return packed(list(range(1 << bits - SLICE)), np.split(counts[0], 1 << bits - SLICE)) if counts else None

    total: dict = {"slice": None, "sum": None}

    def add(batch) -> Iterator[dict]:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if number != total["slice"]:
                if total["slice"] is not None:
                    yield packed([total["slice"]], [total["sum"]])
                total["slice"], total["sum"] = number, np.zeros(1 << SLICE, np.uint32)
            total["sum"] += np.minimum(np.frombuffer(zlib.decompress(data), np.uint32), 0xFFFFFFFF - total["sum"])

    def last() -> dict | None:
        return packed([total["slice"]], [total["sum"]]) if total["slice"] is not None else None

    parts = arrow_map(docs.select("text"), step, "slice int, data binary", finish).repartition("slice").sortWithinPartitions("slice")
    out = np.zeros(1 << bits, np.uint32)
    for row in arrow_map(parts, add, "slice int, data binary", last).collect():  # 2**bits numbers in all, in one job
        out[row.slice << SLICE:row.slice + 1 << SLICE] = np.frombuffer(zlib.decompress(row.data), np.uint32)
    return out


def sketches(docs: DataFrame, counts, size: int, percent: int) -> DataFrame:
    """(doc_id, tk, set, n, first, end): a key of the set, its size, its first elements in the global order and where in the order the
    last of these stands; set is null without words."""
    def step(batch) -> dict:
        rows = batch.num_rows
        out: dict = {"doc_id": batch.column(0), "tk": batch.column(1), "set": [None] * rows, "n": [0] * rows, "first": [None] * rows, "end": [None] * rows}
        shift = np.uint64(64 - int(np.log2(len(counts.value))))
        for i, x in _sets(batch, size):
            order = np.lexsort((x, counts.value[(x >> shift).astype(np.intp)]))
            out["set"][i], out["n"][i] = hashlib.md5(x.tobytes()).digest(), len(x)
            first = order[:len(x) + percent * len(x) // -100 + 1]
            last = x[first[-1]]
            out["first"][i], out["end"][i] = signed(x[first]), [int(counts.value[int(last >> shift)]), int(last) - (1 << 63)]
        return out
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("tk"), "text"), step, f"doc_id {kind}, tk bigint, set binary, n bigint, first array<bigint>, end array<bigint>")


def inverted_lists(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, node, n, end, place, times, size, degree): lists of two nodes or more. Lists of the same nodes are one, ``times`` is their number;
    place of the first such element among the node's; size: nodes of the list; degree: how many nodes the lists of the node hold in all."""
    own = found.select("set", "did", "tk", "first").join(nodes.select("set", "did", "tk", "node"), ["set", "did", "tk"]).dropDuplicates(["set", "did", "tk"])
    rows = own.select("node", F.posexplode("first").alias("place", "k"))
    by = Window.partitionBy("k")
    rows = rows.select("node", "place", F.count("*").over(by).alias("size"), F.bit_xor(F.xxhash64("node")).over(by).alias("g")).where("size > 1")
    lists = kept(rows.groupBy("g", "node").agg(F.min("place").alias("place"), F.count("*").alias("times"), F.first("size").alias("size")), "overlap-held")
    lists = lists.join(nodes.select("node", "n", "end"), "node")
    return lists.select("g", "node", "n", "end", "place", "times", "size", F.sum(F.col("size") * F.col("times")).over(Window.partitionBy("node")).alias("degree"))


def _can_link(shared, q: str, x: str, percent: int):
    """Whether two sets that share so many of their first elements can link: the rest follows the first elements of the set whose first
    elements end first in the global order."""
    follow = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    rest = F.when(F.col(f"{q}end") <= F.col(f"{x}end"), follow(f"{q}n")).otherwise(follow(f"{x}n"))
    return (shared + rest) * (100 + percent) >= percent * (F.col(f"{q}n") + F.col(f"{x}n"))


def without_chance(lists: DataFrame, percent: int, few: int = FEW) -> DataFrame:
    """The lists less the nodes of short lists (``few`` nodes at most) that no other node of the list can link with. Two sets share what
    their common short lists count, and of long lists at most what the set with fewer of them has there. A pair that can link keeps
    all its common lists, so that later counts stay right."""
    of_node = Window.partitionBy("node")
    long = F.sum(F.when(F.col("size") > few, F.col("times")).otherwise(0)).over(of_node)
    all_lists = lists.withColumn("long", long)
    short = all_lists.where(F.col("size") <= few)
    q, x = (short.select("g", F.col("node").alias(t), "times", *[F.col(c).alias(f"{t}_{c}") for c in ("n", "end", "long")]) for t in "qx")
    pairs = q.join(x.drop("times"), "g").where("q < x")
    sides = [f"{t}_{c}" for t in "qx" for c in ("n", "end", "long")]
    pairs = pairs.groupBy("q", "x").agg(F.sum("times").alias("shared"), F.collect_list("g").alias("gs"), *[F.first(c).alias(c) for c in sides])
    pairs = pairs.where(_can_link(F.col("shared") + F.least("q_long", "x_long"), "q_", "x_", percent))
    held = pairs.select(F.explode("gs").alias("g"), "q", "x").select("g", F.explode(F.array("q", "x")).alias("node")).distinct()
    return lists.where(F.col("size") <= few).join(held, ["g", "node"]).select(*lists.columns).unionByName(lists.where(F.col("size") > few))


def held_lists(lists: DataFrame) -> DataFrame:
    """(node, n, end, held): the lists of each node, at most its set's first elements."""
    return lists.groupBy("node").agg(F.first("n").alias("n"), F.first("end").alias("end"), F.collect_list(F.struct("g", "times")).alias("held"))


def occurring(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (q, node, ...) that the short lists (``held_lists``) admit: of the sets' first elements, which the lists hold, as many occur in
    both as the needed overlap exceeds what can follow them."""
    side = lambda name, tag: own.select(F.col("node").alias(name), *[F.col(c).alias(f"{tag}_{c}") for c in ("n", "end", "held")])
    both = pairs.join(side("q", "q"), "q").join(side("node", "x"), "node")
    held = F.transform("q_held", lambda e: e["g"])
    shared = F.aggregate(F.filter("x_held", lambda e: F.array_contains(held, e["g"])), F.lit(0).cast("bigint"), lambda a, e: a + e["times"])
    return both.where(_can_link(shared, "q_", "x_", percent)).select(*pairs.columns)


class Index:
    """Inverted lists over the shingles of a few sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.keys, self.start = np.unique(flat[order], return_index=True)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.end = np.append(self.start[1:], len(flat))
        self.owners = self.owner.tolist()
        # (list, owner) as one ascending number, for binary search inside any list
        self.both = np.repeat(np.arange(len(self.keys)), self.end - self.start) * len(sets) + self.owner

    def search(self, query: np.ndarray, percent: int = PERCENT) -> list[int]:
        """Numbers of the sets that link with the query."""
        need = needed(len(query), self.sizes, percent)
        fits = need <= np.minimum(len(query), self.sizes)
        if not fits.any():
            return []
        least = int(need[fits].min())
        lists = in_sorted(self.keys, query)
        lists = lists[lists >= 0]
        if len(lists) < least:
            return []
        length = self.end[lists] - self.start[lists]
        by_length = np.argsort(-length, kind="stable")
        skip = min(least - 1, int(least / (SKIP * log2(int(length.max()) + 1) + 1)))
        long, short = lists[by_length[:skip]], lists[by_length[skip:]]
        merged = merge(*[self.owners[a:b] for a, b in zip(self.start[short].tolist(), self.end[short].tolist())])
        seen = [(owner, count) for owner, run in groupby(merged) if fits[owner] and (count := sum(1 for _ in run)) >= least - skip]
        if not seen:
            return []
        owner, count = np.array(seen).T
        probes = (np.sort(long)[:, None] * len(self.sizes) + owner).ravel()
        hits = (in_sorted(self.both, probes) >= 0).reshape(len(long), len(owner)).sum(0)
        return owner[count + hits >= need[owner]].tolist()


def _search_cells(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (g, qb, nb, role, node, text), role 0 a query and 1 a listed node of the cell (g, qb, nb) -> links (u, v)."""
    dealt = rows.repartition("g", "qb", "nb").sortWithinPartitions("g", "qb", "nb", "role")

    def answers(queries: list, listed: list) -> dict:
        out: dict = {"u": [], "v": []}
        if queries and listed:
            index = Index([x for _, x in listed])
            for node, x in queries:
                for i in index.search(x, percent):
                    if listed[i][0] != node:
                        out["u"].append(node)
                        out["v"].append(listed[i][0])
        return out

    state: dict = {"cell": None, "rows": ([], [])}

    def step(batch) -> Iterator[dict]:
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        cells, role, node = list(zip(column("g"), column("qb"), column("nb"))), column("role"), column("node")
        for i, x in _sets(batch, size):
            if cells[i] != state["cell"]:
                yield answers(*state["rows"])
                state["cell"], state["rows"] = cells[i], ([], [])
            state["rows"][role[i]].append((node[i], x))

    return arrow_map(dealt, step, "u bigint, v bigint", lambda: answers(*state["rows"]))


def needed_texts(docs: DataFrame, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """(did, tk, text) of ``docs`` (did, tk, text): all rows with a key (did, tk) of ``wanted``, and few others, as a bitmap of the keys' hashes
    tells before any text is moved."""
    return picked(docs, wanted, "did", "tk", bits=bits)


def linked(lists: DataFrame, keys: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label) of all nodes that links connect; ``keys`` (node, did, tk) has the nodes of the lists, ``docs`` (did, tk, text) their texts."""
    labels = lists.select("node", F.col("node").alias("label")).limit(0)
    own = kept(held_lists(lists), "overlap-held")
    block = lambda c, n, most: F.pmod(F.xxhash64(c), F.ceil(F.col(n) / most)).cast("int")
    for pivots in (1, PIVOTS, None):
        now = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = now.groupBy("g").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("g")
        now = kept(now.join(mixed, "g"), "overlap-mixed")
        p, x = now, now.alias("x")
        if pivots is not None:
            p = now.withColumn("order", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("degree"), "node"))).where(F.col("order") <= pivots)
        p = p.alias("p")
        # what can still be shared from this list on bounds the overlap
        most = F.least(F.col("p.n") - F.col("p.place"), F.col("x.n") - F.col("x.place"))
        apart = F.col("p.label") != F.col("x.label") if pivots is not None else F.col("p.label") < F.col("x.label")
        pairs = p.join(x, "g").where(apart & (most * (100 + percent) >= percent * (F.col("p.n") + F.col("x.n")))).groupBy(F.col("p.node").alias("q"), F.col("x.node").alias("node")).agg(F.min("g").alias("g"))
        pairs = kept(occurring(pairs, own, percent), "overlap-pairs")
        if pairs.isEmpty():
            continue
        sizes = pairs.groupBy("g").agg(F.countDistinct("q").alias("qs"), F.countDistinct("node").alias("ns"))
        cells = pairs.join(sizes, "g").select("g", block("q", "qs", QUERIES).alias("qb"), block("node", "ns", NODES).alias("nb"), F.explode(F.array(
            F.struct(F.lit(0).alias("role"), F.col("q").alias("node")), F.struct(F.lit(1).alias("role"), F.col("node").alias("node")))).alias("r")).select("g", "qb", "nb", "r.*").distinct()
        cells = kept(cells.join(keys, "node"), "overlap-cells")
        texts = needed_texts(docs, cells).groupBy("did", "tk").agg(F.first("text").alias("text"))
        found = kept(_search_cells(cells.join(texts, ["did", "tk"]).drop("did", "tk"), size, percent).distinct(), "overlap-links")
        if not found.isEmpty():
            labels = components(found.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    return labels


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included)."""
    did = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, size))
    found = kept(sketches(docs, counts, size, percent).withColumn("did", did), "overlap-sketches")
    one = found.where(F.col("set").isNotNull()).groupBy("set").agg(F.min(F.struct("did", "tk")).alias("one"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("end").alias("end"))
    nodes = kept(one.select("set", "one.*", "least", "n", "end", F.monotonically_increasing_id().alias("node")), "overlap-nodes")
    lists = kept(without_chance(kept(inverted_lists(found, nodes), "overlap-all-lists"), percent), "overlap-lists")
    wanted = kept(lists.select("node").distinct().join(nodes.select("node", "did", "tk"), "node"), "overlap-wanted")
    labels = linked(lists, wanted, docs.select(did.alias("did"), F.xxhash64("text").alias("tk"), "text"), size, percent)
    named = kept(nodes.select("set", "node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "overlap-named")
    # both sides are tables, so that Spark can split a component or a set of a third of all rows
    ids = kept(named.groupBy("label").agg(F.min("least").alias("component_id")), "overlap-components")
    placed = kept(named.join(ids, "label").select("set", "component_id"), "overlap-placed")
    joined = found.select("doc_id", "n", "set").join(placed, "set", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
