"""SentencePiece encoding and decoding by batched Viterbi.

A text is cut into units before each run of spaces; no piece crosses such a place, so the best segmentation of a text is that of its
units, and each distinct unit of a block is segmented once. Units of equal length advance together, one end position at a time: the
hashes of the substrings that end there come from one prefix sum and are looked up in the sorted hashes of all pieces, and the best
total score per unit and its backpointer are kept as arrays. A character without a piece falls back to the pieces of its bytes.

The score of a segmentation is the sum of its pieces' scores, the unigram form; for vocabularies made by pair merging, whose scores
are negative merge ranks, ``log_rank`` takes -log(2 + rank) instead, a Zipf estimate of a piece's log frequency. Either way decoding
gives the text back exactly; see the README for how often the ids equal those of greedy merging.

Conventions of the vocabulary files: spaces are written U+2581, one is put before the text, nothing is normalised. A literal U+2581 in
a text is encoded as bytes, so that it survives; very long texts are read whole, an empty table gives no rows. Nulls and edges: null gives null, empty gives no ids; a lone surrogate cannot occur in
Spark strings; ids, ties and repeated rows pass through; equal totals prefer the longer last piece. Result columns replace clashing ones.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siftwork.llm.tables import given_back
from siftwork.llm.words import in_sorted, mix

SPACE, LITERAL = "▁", "\ud800"  # a lone surrogate stands for a literal U+2581 inside units: no Spark string holds one
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_CHARS = 4 << 20
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_M = 0x9E3779B97F4A7C15
_LONGEST_TABLE = 4096


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (_M, pow(_M, -1, 1 << 64)):
        a = np.full(n, x, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _codes(strings: list[str], n: int) -> np.ndarray:
    return np.array(strings, f"<U{n}").view(np.uint32).reshape(len(strings), n).astype(np.uint64)


def _prefix(codes: np.ndarray, power: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * power[: codes.shape[1]], axis=1, out=out[:, 1:])
    return out


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray   # id of the piece of each byte
    keys: np.ndarray       # sorted hashes of pieces
    ids: np.ndarray        # their ids
    longest: int


def load(path: str = VOCABULARY, log_rank: bool = True) -> Vocabulary:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)])
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    if log_rank:
        scores = -np.log(2.0 - np.minimum(scores, 0.0))
    power, _ = _powers(64)
    longest = max(len(pieces[i]) for i in plain)
    hashes = np.empty(len(plain), np.uint64)
    size = np.array([len(pieces[i]) for i in plain])
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        hashes[at] = mix(_prefix(_codes([pieces[plain[i]] for i in at], length), power)[:, -1] + np.uint64(length))
    order = np.argsort(hashes)
    assert len(np.unique(hashes)) == len(hashes)
    return Vocabulary(pieces, scores, byte_ids, hashes[order], np.array(plain)[order], int(longest))


def viterbi(units: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Units of one length -> (ids of all units in order, number of ids per unit)."""
    n = len(units[0])
    power, back = _powers(max(n + 1, 2))
    prefix = _prefix(_codes(units, n), power)
    rows = len(units)
    worst = v.scores[v.ids].min() - 10.0
    best = np.full((n + 1, rows), -np.inf)
    best[0] = 0
    length = np.zeros((n + 1, rows), np.int16)
    piece = np.full((n + 1, rows), -1, np.int32)
    for j in range(1, n + 1):
        best[j], length[j] = best[j - 1] + worst, 1  # the character's bytes
        for size in range(1, min(v.longest, j) + 1):
            h = mix((prefix[:, j] - prefix[:, j - size]) * back[j - size] + np.uint64(size))
            at = in_sorted(v.keys, h)
            hit = np.flatnonzero(at >= 0)
            if len(hit):
                ids = v.ids[at[hit]]
                total = best[j - size, hit] + v.scores[ids]
                better = total >= best[j, hit]
                hit, ids, total = hit[better], ids[better], total[better]
                best[j, hit], length[j, hit], piece[j, hit] = total, size, ids
    out, spot, place = [], [], np.full(rows, n)
    live = np.arange(rows)
    while len(live):  # all units step back together
        j = place[live]
        out.append(np.where(piece[j, live] >= 0, piece[j, live], -j))
        spot.append(live)
        place[live] = j - length[j, live]
        live = live[place[live] > 0]
    unit, ids = np.concatenate(spot), np.concatenate(out)
    order = np.lexsort((-np.arange(len(unit)), unit))
    unit, ids = unit[order], ids[order]
    missing = np.flatnonzero(ids < 0)
    if len(missing):  # replace by bytes
        data = [_restore(units[unit[i]][-ids[i] - 1]).encode() for i in missing]
        count = np.ones(len(ids), np.int64)
        count[missing] = [len(x) for x in data]
        unit, ids = np.repeat(unit, count), np.repeat(ids, count)
        ids[ids < 0] = v.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
    return ids.astype(np.int32), np.bincount(unit, minlength=rows)


def _restore(c: str) -> str:
    return SPACE if c == LITERAL else c


def encode(texts: list[str | None], v: Vocabulary) -> list[np.ndarray | None]:
    """Ids of each text."""
    words = [_UNIT.findall(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
    seen: dict[str, int] = {}
    number = np.fromiter((seen.setdefault(u, len(seen)) for w in words for u in w), np.int64)
    distinct = list(seen)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    chunks, where, count = [], np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    held = 0
    for n in np.unique(size):
        same = np.flatnonzero(size == n)
        step = max(1, (1 << 20) // int(n))  # bounds the arrays, not the units
        for i in range(0, len(same), step):
            part = same[i:i + step]
            ids, per = viterbi([distinct[k] for k in part], v)
            where[part], count[part] = held + np.cumsum(per) - per, per
            chunks.append(ids)
            held += len(ids)
    flat = np.concatenate(chunks) if chunks else np.empty(0, np.int32)
    out: list[np.ndarray | None] = []
    at = 0
    for t, w in zip(texts, words):
        k = number[at:at + len(w)]
        at += len(w)
        n = count[k]
        ends = np.cumsum(n)
        out.append(None if t is None else flat[np.repeat(where[k] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)])
    return out


def decode(ids: np.ndarray | None, v: Vocabulary, names: np.ndarray, byte_of: dict[int, int]) -> str | None:
    if ids is None:
        return None
    if not len(ids):
        return ""
    parts = names[ids]
    raw = np.flatnonzero(np.isin(ids, v.byte_ids))
    if not len(raw):
        return "".join(parts)[1:]
    out = [p.encode() for p in parts]
    for i in raw:
        out[i] = bytes([byte_of[int(ids[i])]])
    return b"".join(out)[1:].decode("utf-8", "replace")


def _blocks(sizes: list[int | None], most: int = BLOCK_CHARS) -> Iterator[slice]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += n or 0
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _columns(df: DataFrame, spark: SparkSession, new: dict[str, T.DataType], path: str, log_rank: bool, value) -> DataFrame:
    shared = spark.sparkContext.broadcast(load(path, log_rank))  # as large as the vocabulary
    plain = df.drop(*new)
    target = T.StructType([*plain.schema.fields, *[T.StructField(k, t) for k, t in new.items()]])
    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(t) for t in new.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        names = np.array([p.replace(SPACE, " ") for p in v.pieces], object)
        byte_of = {int(k): b for b, k in enumerate(v.byte_ids)}
        for b in batches:
            for part in value(b, v, names, byte_of):
                rows, columns = part
                yield pa.RecordBatch.from_arrays([*b.slice(rows.start, rows.stop - rows.start).columns, *[c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]], names=[f.name for f in target.fields])
    return plain.mapInArrow(given_back(run), target)


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY, log_rank: bool = True, check: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with ``out``, the ids of ``text``; ``check`` names a further column: whether decoding gives the text back. Smaller blocks take
    less memory and more time, and give the same ids."""
    new: dict[str, T.DataType] = {out: T.ArrayType(T.IntegerType())} | ({check: T.BooleanType()} if check else {})

    def value(b, v, names, byte_of):
        texts = b.column(b.schema.get_field_index(text))
        for rows in _blocks(pc.utf8_length(texts).to_pylist(), block_chars):
            part = texts.slice(rows.start, rows.stop - rows.start).to_pylist()  # a block's texts at a time
            ids = encode(part, v)
            flat = np.concatenate([np.empty(0, np.int32), *[x for x in ids if x is not None]])
            ends = np.cumsum([0, *[0 if x is None else len(x) for x in ids]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))
            yield rows, [lists] + ([[None if t is None else decode(x, v, names, byte_of) == t for t, x in zip(part, ids)]] if check else [])
    return _columns(df, df.sparkSession, new, path, log_rank, value)


def decode_column(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """``df`` with ``out``, the text of ``ids``; ids outside the vocabulary are an error, null gives null."""
    def value(b, v, names, byte_of):
        lists = b.column(b.schema.get_field_index(ids))
        flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *[x or 0 for x in lists.value_lengths().to_pylist()]])
        yield slice(0, b.num_rows), [[decode(flat[ends[i]:ends[i + 1]] if lists[i].is_valid else None, v, names, byte_of) for i in range(b.num_rows)]]
    return _columns(df, df.sparkSession, {out: T.StringType()}, path, True, value)
