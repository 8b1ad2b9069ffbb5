"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, distance-weighted votes.

Terms are words (letters, digits and non-ASCII bytes, A-Z lower-cased) and the first ``STEMS`` bytes of longer words, so that inflected
forms meet; of these, the ones that speak for label 1 in the training examples, by a likelihood-ratio test over document counts. An example and a document are vectors of 1 + log(count) times the inverse document
frequency over all documents, of unit length. The ``NEIGHBOURS`` most similar examples vote, each with its similarity to the power
``SHARPNESS``; a logistic curve fitted on the examples' leave-one-out votes turns the share of votes into a probability. A document
that shares no term with any example gets the share of toxic ones among such examples.

The index keeps, per term, the examples with that term in blocks of ``BLOCK`` example numbers and the largest weight in each block. A
query sums the block maxima of its terms to bounds, scores blocks by falling bound, and stops where no block can reach the result:
the outcome is exact. At most ``max_examples`` labelled rows are learned from (smallest hashed ids) and ``max_terms`` terms kept, so the
broadcast index has a fixed bound; frequencies and scores cover all documents, whole texts, in passes without a shuffle of texts.

Nulls and edges: null and empty texts have no terms; null labels and labels without a document are not learned from; repeated label
rows count once (largest label); equal similarities go to the smaller example number; without examples every score is 0. Repeated
rows and null ids are scored like others; a column named as a result is replaced.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.neardup import LETTERS
from siftwork.llm.tables import ROWS, arrow_map, signed
from siftwork.llm.words import column_bytes, hash_words, in_sorted

MAX_EXAMPLES, MAX_TERMS = 12_000, 2_000
NEIGHBOURS, SHARPNESS, BLOCK = 15, 2.0, 64
LEAST_GAIN, LEAST_LIFT = 20.0, 20.0
STEMS = (4, 5, 6)


def term_counts(texts: list[bytes | None], keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term, count), by text; terms are hashes, or places in the sorted ``keys``."""
    w = hash_words(texts, LETTERS, STEMS)
    text, term = np.tile(w.text, 1 + len(STEMS)), np.concatenate([signed(w.hash), *map(signed, w.prefix)])
    text, term = text[term != 0], term[term != 0]
    if keys is not None:
        term = in_sorted(keys, term)
        text, term = text[term >= 0], term[term >= 0]
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    first = np.flatnonzero(np.concatenate([[len(text) > 0], (text[1:] != text[:-1]) | (term[1:] != term[:-1])])) if len(text) else np.empty(0, int)
    return text[first], term[first], np.diff(np.append(first, len(text)))


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers first[0]..last[0], first[1]..last[1], ... (ends exclusive) in one array."""
    n = last - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


@dataclass
class Index:
    keys: np.ndarray            # sorted hashes of the terms
    idf: np.ndarray
    labels: np.ndarray          # label of each example
    starts: np.ndarray          # postings of term t: starts[t]..starts[t+1]
    example: np.ndarray         # postings, by example number
    weight: np.ndarray
    block_starts: np.ndarray    # blocks of term t: block_starts[t]..block_starts[t+1]
    block: np.ndarray
    block_max: np.ndarray
    block_from: np.ndarray      # first posting of a block; one more entry at the end
    curve: tuple[float, float] = (0.0, 0.0)
    without: float = 0.0        # score of a document without neighbours

    def vector(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[term]
        return x / np.sqrt((x * x).sum()) if len(x) else x

    def nearest(self, term: np.ndarray, x: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the k most similar examples that share a term, best first. ``leave``: one not to count."""
        n_blocks = -(-len(self.labels) // BLOCK)
        a, b = self.block_starts[term], self.block_starts[term + 1]
        parts, value = ranges(a, b), np.repeat(x, b - a)           # the block entries of the query's terms
        bound = np.bincount(self.block[parts], value * self.block_max[parts], minlength=n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        place = np.full(n_blocks, n_blocks)
        place[order] = np.arange(len(order))
        turn = place[self.block[parts]]
        by = np.argsort(turn, kind="stable")
        parts, value, turn = parts[by], value[by], turn[by]
        found, scores, floor, at, wave = np.empty(0, np.int64), np.empty(0), 0.0, 0, 16
        while at < len(order) and (len(found) < k or bound[order[at]] >= floor - 1e-12):
            lo, hi = np.searchsorted(turn, [at, at + wave])
            first, last = self.block_from[parts[lo:hi]], self.block_from[parts[lo:hi] + 1]
            entry = ranges(first, last)
            spot = np.repeat(turn[lo:hi] - at, last - first) * BLOCK + self.example[entry] % BLOCK
            total = np.bincount(spot, self.weight[entry] * np.repeat(value[lo:hi], last - first), minlength=wave * BLOCK)
            spot = np.flatnonzero(total)
            number = order[at + spot // BLOCK] * BLOCK + spot % BLOCK
            found, scores = np.append(found, number[number != leave]), np.append(scores, total[spot][number != leave])
            best = np.lexsort((found, -np.round(scores, 12)))[:k]
            found, scores = found[best], scores[best]
            floor = scores[-1] if len(found) == k else 0.0
            at, wave = at + wave, wave * 2
        return found, scores

    def share(self, found: np.ndarray, scores: np.ndarray) -> float:
        w = scores ** SHARPNESS
        return float((w * self.labels[found]).sum() / w.sum())

    def calibrated(self, share: float) -> float:
        return float(1 / (1 + np.exp(-(self.curve[0] * share + self.curve[1]))))


def build(keys: np.ndarray, idf: np.ndarray, labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> Index:
    """Index of the examples ``rows`` (terms, counts), calibrated on their leave-one-out votes."""
    number = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    term = np.concatenate([np.empty(0, np.int64), *[t for t, _ in rows]])
    out = Index(keys, idf, labels, *[np.empty(0, np.int64)] * 7)
    vectors = [out.vector(t, c) for t, c in rows]
    weight = np.concatenate([np.empty(0), *vectors])
    order = np.lexsort((number, term))
    number, term, weight = number[order], term[order], weight[order]
    out.starts = np.searchsorted(term, np.arange(len(keys) + 1))
    out.example, out.weight = number, weight
    block = number // BLOCK
    first = np.flatnonzero(np.concatenate([[len(term) > 0], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.empty(0, int)
    out.block, out.block_max = block[first], np.maximum.reduceat(weight, first) if len(first) else np.empty(0)
    out.block_from = np.append(first, len(term))
    out.block_starts = np.searchsorted(term[first], np.arange(len(keys) + 1))
    shares, known, lone = [], [], []
    for i, ((t, _), x) in enumerate(zip(rows, vectors)):
        found, scores = out.nearest(t, x, NEIGHBOURS, leave=i) if len(t) else (np.empty(0, int), np.empty(0))
        if len(found):
            shares.append(out.share(found, scores))
            known.append(labels[i])
        else:
            lone.append(labels[i])
    out.curve = _logistic(np.array(shares), np.array(known, float))
    out.without = (sum(lone) + 0.5 * np.mean(labels)) / (len(lone) + 0.5) if len(labels) else 0.0
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge."""
    w = np.zeros(2)
    a = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + ridge * np.eye(2), a.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Index:
    chosen = (labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))
    examples = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def pairs(batch) -> dict:
        text, term, _ = term_counts(column_bytes(batch, "text"))
        return {"y": batch.column(1).to_numpy()[text], "term": term}
    sizes = examples.groupBy("y").count().collect()
    n1, n0 = (float(sum(r["count"] for r in sizes if r.y == v)) for v in (1, 0))
    counted = arrow_map(examples, pairs, "y int, term bigint").groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    n = n1 + n0
    cells = [(a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n - a - b), (n0 - b, n0, n - a - b)]
    gain = sum((F.when(x > 0, x * F.ln(x * n / (side * both))).otherwise(0.0) for x, side, both in cells), F.lit(0.0)) * 2
    judged = counted.select("term", gain.alias("gain"), ((a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))).alias("lift")).where((F.col("gain") >= LEAST_GAIN) & (F.col("lift") >= LEAST_LIFT)) if n1 and n0 else None
    terms = judged.orderBy(F.desc("gain"), "term").limit(max_terms).toPandas() if judged is not None else None
    keys = np.sort(terms.term.to_numpy(np.int64)) if terms is not None else np.empty(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    seen: list[np.ndarray] = []

    def count(batch) -> None:
        if not seen:
            seen.append(np.zeros(len(shared.value) + 1, np.int64))
        _, term, _ = term_counts(column_bytes(batch, "text"), shared.value)
        seen[0] += np.append(np.bincount(term, minlength=len(shared.value)), batch.num_rows)
    frequency = arrow_map(docs.select("text"), count, "term bigint, n bigint", lambda: {"term": np.arange(len(seen[0])), "n": seen[0]} if seen else None).groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(keys) + 1)
    df[frequency.term.to_numpy(int)] = frequency.n.to_numpy(float)

    def vectors(batch) -> dict:
        text, term, times = term_counts(column_bytes(batch, "text"), shared.value)
        ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
        cut = lambda x: [x[i:j].tolist() for i, j in zip(ends[:-1], ends[1:])]
        return {"doc_id": batch.column(0).cast(pa.string()), "y": batch.column(1), "terms": cut(term), "times": cut(times)}
    rows = arrow_map(examples, vectors, "doc_id string, y int, terms array<bigint>, times array<bigint>").toPandas()  # at most max_examples
    rows = rows.sort_values(["doc_id", "y"], kind="stable")
    return build(keys, 1 + np.log((1 + df[-1]) / (1 + df[:-1])), rows.y.to_numpy(float), [(np.asarray(t, np.int64), np.asarray(c, float)) for t, c in zip(rows.terms, rows.times)])


def score(docs: DataFrame, index: Index, out: str = "score", evidence: str = "evidence") -> DataFrame:
    """``docs`` with the probability of label 1 and the evidence: (example number, label, similarity) of the voters, best first."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    plain = docs.drop(out, evidence)
    proof = T.ArrayType(T.StructType([T.StructField("example", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
    target = T.StructType([*plain.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(evidence, proof)])
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(proof)

    def run(batches):
        ix = shared.value
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            text, term, times = term_counts(column_bytes(b, "text"), ix.keys)
            ends = np.searchsorted(text, np.arange(b.num_rows + 1))
            scores, proofs = np.full(b.num_rows, ix.without), [[] for _ in range(b.num_rows)]
            for i in np.flatnonzero(np.diff(ends)):
                t = term[ends[i]:ends[i + 1]]
                found, near = ix.nearest(t, ix.vector(t, times[ends[i]:ends[i + 1]]), NEIGHBOURS)
                if len(found):
                    scores[i] = ix.calibrated(ix.share(found, near))
                    proofs[i] = [{"example": int(e), "label": int(ix.labels[e]), "similarity": float(s)} for e, s in zip(found, near)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array(proofs, kind)], names=[f.name for f in target.fields])
    return plain.mapInArrow(run, target)
