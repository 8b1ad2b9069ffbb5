"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

Words are runs of letters, digits and non-ASCII bytes, or runs of punctuation. Two kinds of words are replaced by a marker before
n-grams are formed: a word equal to the one before it, and a word in capitals. N-grams of
one and two words are hashed into ``2**bits`` columns; a value is the n-gram's share of the text times ``SCALE``.

Learning takes at most ``max_examples`` labelled rows (those with the smallest hashed ids), a fixed bound; their feature rows, not
their texts, meet in one task. Scoring is one pass over all documents, whole texts, no shuffle.

Nulls and edges: a null or empty text has no features and gets the model's bias as its score; a null id is scored like any other;
repeated rows give repeated results; labels that are null, or whose text is missing, are not learned from; with no usable label of
either kind every score is the share of label 1 so far (0.5 without any). Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.tables import arrow_map, given_back, sliced
from siftwork.llm.words import byte_classes, column_bytes, hash_words, mix

TOKENS = byte_classes(c0=[*range(33), 127], c2=[x for x in range(33, 127) if not chr(x).isalnum()])
SCALE = 20.0
BITS = 18
MAX_EXAMPLES = 12_000
_CAPITALS, _AGAIN, _PAIR = np.uint64(0xC0FFEE1234567891), np.uint64(0xA5A5F00DBEEF7771), np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[bytes | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, column) of every n-gram occurrence."""
    w = hash_words(texts, TOKENS)
    text = w.text
    h = w.hash.copy()
    same = np.zeros(len(h), bool)
    same[1:] = (text[1:] == text[:-1]) & (w.hash[1:] == w.hash[:-1])
    h[(w.upper >= 2) & (w.lower == 0)] = _CAPITALS
    h[same] = _AGAIN
    joint = np.flatnonzero(text[1:] == text[:-1]) if len(h) else np.empty(0, np.int64)
    pair = mix(h[joint] * _PAIR + h[joint + 1]) if len(joint) else np.empty(0, np.uint64)
    shift = np.uint64(64 - bits)
    return np.concatenate([text, text[joint]]), np.concatenate([mix(h) >> shift, pair >> shift]).astype(np.int64)


def scores(texts: list[bytes | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Sparse dot products through the logistic function."""
    bits = int(np.log2(len(weights)))
    out = np.zeros(len(texts))
    sizes = np.cumsum([len(t or b"") for t in texts])
    for part in np.split(np.arange(len(texts)), np.searchsorted(sizes, np.arange(1 << 22, int(sizes[-1]) if len(sizes) else 0, 1 << 22))):
        if len(part):  # about four megabytes of text at a time
            row, column = features([texts[i] for i in part], bits)
            n = np.bincount(row, minlength=len(part))
            out[part] = np.bincount(row, weights[column], minlength=len(part)) * SCALE / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(out + bias, -30, 30)))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Follow-the-regularised-leader, proximal form: per-column adaptive steps, L1 keeps rare columns at zero. Last weight: the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7)
    positive = sum(y for _, _, y in rows)
    z[-1] = -np.log((positive + 1) / (len(rows) - positive + 1)) * (beta / alpha + l2)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = _weights(z[at], n[at], alpha, beta, l1, l2)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return _weights(z, n, alpha, beta, l1, l2)


def _weights(z, n, alpha, beta, l1, l2):
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, bits: int = BITS, max_examples: int = MAX_EXAMPLES) -> np.ndarray:
    """Weights and, last, the bias. ``train`` chooses label rows; at most ``max_examples`` of them are used."""
    chosen = (labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))

    def encode(batch) -> Iterator[dict]:
        row, column = features(column_bytes(batch, "text"), bits)
        y = batch.column(batch.schema.get_field_index("y")).to_numpy()
        key, count = np.unique(row << bits | column, return_counts=True)
        total = np.bincount(row, minlength=batch.num_rows)
        for i, (a, b) in enumerate(np.searchsorted(key, np.array([[i << bits, i + 1 << bits] for i in range(batch.num_rows)]))):
            yield {"y": [int(y[i])], "at": [(key[a:b] & (1 << bits) - 1).tolist()], "x": [(count[a:b] * SCALE / max(1, total[i])).astype(np.float32).tolist()]}

    def train_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(np.asarray(at, np.int64), np.asarray(x, float), int(y)) for f in frames for y, at, x in zip(f.y, f["at"], f.x)]
        rows.sort(key=lambda r: (len(r[0]), r[0][:4].tolist(), r[2]))  # the same order however the rows arrived
        yield pd.DataFrame({"w": [fit_ftrl(rows, bits).astype(np.float32)]})

    known = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "y")
    rows = arrow_map(known, encode, "y int, at array<int>, x array<float>")
    return np.asarray(rows.repartition(1).mapInPandas(train_all, "w array<float>").first()["w"], float)


def score(docs: DataFrame, weights: np.ndarray, out: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of label 1."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    plain = docs.drop(out)
    target = T.StructType([*plain.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        w = model.value
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(column_bytes(b, "text"), w[:-1], w[-1]), pa.float64())], names=[*b.schema.names, out])
    return plain.mapInArrow(given_back(run), target)
