"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first search, leaf visits widened to a calibrated recall.

The tree is fitted on at most ``MAX_SAMPLE`` vectors (smallest hashed ids), a fixed bound, so it can be broadcast; every vector is
then put into its leaf. A query takes leaves from a priority queue of branches by distance to their centres. How many it takes is
calibrated: for ``PROBES`` sample vectors the exact neighbours among all vectors are found by a scan, and visits are widened until
``TARGET`` of them lie in visited leaves; a query also goes on until its leaves hold enough vectors. Visited leaves meet their vectors
by a shuffle on the leaf, large leaves are split, and distances are computed in double precision on the original components.

Equal vectors are one entry with its k + 1 smallest ids, which is all a result can name, so a vector that a third of all rows share
is searched once and stands in one place. Equal query vectors are searched once too.

Nulls and edges: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part,
neither do null ids; repeated rows count once; ties go to the smaller id; with fewer than k candidates all are returned; an empty table
gives an empty result. Extra columns are ignored.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.tables import kept

MAX_SAMPLE, PROBES, TARGET = 20_000, 200, 0.97
BRANCHES, LEAF = 12, 24
SPLIT = 4096


@dataclass
class Tree:
    centres: list[np.ndarray]       # of node i: centres of its children
    children: list[np.ndarray]      # node numbers; a leaf is -1 - leaf number
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest centre at each level."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            near = nearest_centre(x[rows], self.centres[node])
            for c, child in enumerate(self.children[node]):
                part = rows[near == c]
                if child < 0:
                    out[part] = -1 - child
                else:
                    todo.append((int(child), part))
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while node >= 0:
                d = ((self.centres[node] - q) ** 2).sum(1)
                best = int(d.argmin())
                for c, child in enumerate(self.children[node]):
                    if c != best:
                        heapq.heappush(queue, (float(d[c]), int(child)))
                node = int(self.children[node][best])
            yield -1 - node


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)


def build(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, rounds: int = 8) -> Tree:
    """Hierarchical k-means of the sample."""
    tree, rng = Tree([], [], 0), np.random.default_rng(11)

    def split(rows: np.ndarray) -> int:
        node = len(tree.centres)
        tree.centres.append(np.empty(0))
        tree.children.append(np.empty(0))
        k = max(1, min(branches, -(-len(rows) // leaf)))
        centres = x[rows[np.sort(rng.choice(len(rows), k, replace=False))]]
        for _ in range(rounds):
            near = nearest_centre(x[rows], centres)
            centres = np.stack([x[rows[near == c]].mean(0) if (near == c).any() else centres[c] for c in range(k)])
        near = nearest_centre(x[rows], centres)
        tree.centres[node] = centres
        children = []
        for c in range(k):
            part = rows[near == c]
            if len(part) <= leaf or len(part) == len(rows):
                children.append(-1 - tree.leaves)
                tree.leaves += 1
            else:
                children.append(split(part))
        tree.children[node] = np.array(children)
        return node
    split(np.arange(len(x)))
    return tree


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, each once."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).distinct()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    rows = rows.where(F.size("v") == sizes.d)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = kept(rows.select("*", place.alias("place")).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("e", F.get("ids", F.lit(0))), "ann-entries")

    sample = entries.select("e", "v").orderBy(F.xxhash64("e"), "e").limit(max_sample)

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(frames)).sort_values("e")
        tree = build(_matrix(found.v))
        yield pd.DataFrame({"node": range(len(tree.centres)), "centres": [c.ravel().tolist() for c in tree.centres], "children": [c.tolist() for c in tree.children]})
    nodes = sample.repartition(1).mapInPandas(grow, "node int, centres array<double>, children array<int>").toPandas().sort_values("node")
    tree = Tree([np.reshape(c, (-1, sizes.d)) for c in nodes.centres], [np.asarray(c) for c in nodes.children], 0)
    shared = spark.sparkContext.broadcast(tree)

    def place_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(leaf=shared.value.assign(_matrix(f.v)) if len(f) else np.empty(0, np.int32))
    entries = kept(entries.mapInPandas(place_all, "v array<float>, ids array<bigint>, e bigint, leaf int" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "v array<double>, ids array<bigint>, e bigint, leaf int"), "ann-leaves")
    held = entries.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).toPandas()  # at most one row per leaf
    n_ids = dict(zip(held.leaf, held.ids))

    # exact neighbours of the probes, by a scan of all entries
    probes = sample.orderBy(F.xxhash64("e", F.lit(1)), "e").limit(PROBES).toPandas()
    base = spark.sparkContext.broadcast((_matrix(probes.v), probes.e.to_numpy()))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, own = base.value
        for f in frames:
            if len(f):
                d = (q ** 2).sum(1)[:, None] - 2 * q @ (x := _matrix(f.v)).T + (x ** 2).sum(1)
                d[own[:, None] == f.e.to_numpy()] = np.inf
                best = np.argpartition(d, min(k, len(f)) - 1, axis=1)[:, :k]
                yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), best.shape[1]), "d": np.take_along_axis(d, best, 1).ravel(), "leaf": f.leaf.to_numpy()[best.ravel()]})
    near = entries.mapInPandas(scan, "q int, d double, leaf int").where(F.col("d") < float("inf"))
    truth = near.select("*", F.row_number().over(Window.partitionBy("q").orderBy("d", "leaf")).alias("r")).where(F.col("r") <= k).toPandas()
    needed = []
    for q, group in truth.groupby("q"):
        order = {leaf: i + 1 for i, leaf in enumerate(tree.visits(base.value[0][q]))}
        needed += [order[leaf] for leaf in group.leaf]
    visits = int(np.quantile(needed, target, method="higher")) if needed else 1

    limit = spark.sparkContext.broadcast((visits, n_ids))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most, counts = limit.value
        for f in frames:
            out = []
            for e, v in zip(f.e, f.v):
                enough = 0
                for i, leaf in enumerate(shared.value.visits(np.asarray(v, np.float64))):
                    if i >= most and enough > k:
                        break
                    enough += counts.get(leaf, 0)
                    if counts.get(leaf, 0):
                        out.append((e, v, leaf))
            yield pd.DataFrame(out, columns=["qe", "qv", "leaf"])
    kind = entries.schema["v"].dataType.simpleString()
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    asked = queries.join(entries.select(F.col("v").alias("qv"), "e"), "qv").select("query_id", "e", "qv")
    routed = asked.select("e", F.col("qv").alias("v")).dropDuplicates(["e"]).mapInPandas(route, f"qe bigint, qv {kind}, leaf int")
    parts = spark.createDataFrame(pd.DataFrame({"leaf": held.leaf, "parts": -(-held.n // SPLIT)}), "leaf int, parts int")
    split = entries.join(F.broadcast(parts), "leaf").select("e", "v", "ids", "leaf", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int").alias("part"))
    again = F.broadcast(parts.select(F.col("leaf").alias("of"), F.col("parts").alias("n")))
    routed = routed.join(again, F.col("leaf") == F.col("of")).select("qe", "qv", F.col("of").alias("qleaf"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("qpart"))

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            points = _matrix(x.v)
            for e, v in zip(q.qe, q.qv):
                d = np.sqrt(((points - np.asarray(v, np.float64)) ** 2).sum(1))
                best = np.lexsort((x.e.to_numpy(), d))[: k + 1]
                found = sorted((d[i], int(n)) for i in best for n in x.ids.iloc[i])[: k + 1]
                out += [(e, n, float(s)) for s, n in found]
        return pd.DataFrame(out, columns=["e", "vec_id", "score"])
    found = routed.groupBy("qleaf", "qpart").cogroup(split.groupBy("leaf", "part")).applyInPandas(compare, "e bigint, vec_id bigint, score double")
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("score", "vec_id"))
    best = found.select("*", order("e").alias("r")).where(F.col("r") <= k + 1)
    named = asked.select("query_id", "e").join(best, "e").where(F.col("vec_id") != F.col("query_id"))
    return named.select("query_id", order("query_id").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
