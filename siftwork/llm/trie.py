"""Conversation prefix trie: the distinct prefixes of all conversations with their members, from sorted common prefixes and range minima.

A node is a distinct sequence of first turns (role, text). Conversations that share it are neighbours once sequences are sorted, and
the interval is as far as the common prefixes (LCP) between neighbours reach the node's depth. A sparse table holds the minima of the
LCPs over ranges of power-of-two length; each candidate prefix finds its left and right extent by binary search over it, on its own,
many candidates at once with numpy. Everything asked of a node or its subtree is a sum or minimum over its interval:

- members: rows; smallest member: a range minimum;
- leaves below: rows whose sequence no following row extends or repeats;
- tokens saved below: bytes of the members' turns from the node on, less the bytes of the distinct nodes there, where a distinct node
  counts at the first row that has it. So no tree is walked, and parts of an interval add up.

Spark sorts the sequences by range; tasks work through sorted rows in pieces of bounded size, so a prefix of a third of all conversations
is many pieces, each of which sends one partial row per node; those add up by node. The lists of conversations that end at a node travel
as joined text of many ids a row; their hash, which is sequential by nature, reads these rows one after another in bounded memory.

A conversation is cut into segments of ``SEGMENT`` turns, at equal depths in all, so that no conversation has to fit a row: a segment
row starts from the key of the prefix before it. A prefix's key is the sum of 128-bit hashes of (depth, turn) over its turns; the sums up to a
segment come from a window over segments, those inside it are computed in the task.

Nulls and edges: a null role or text is empty; turns go by turn number, null first, then by role, then by a hash of the text; repeated rows are
turns of their own; rows with a null conv_id belong to no conversation and are left out; an empty table has no nodes, conversations
without turns are members of the root alone. Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.tables import kept
from siftwork.llm.words import mix
from siftwork.operators.ranking import global_rank
from siftwork.session import cut_lineage

SEGMENT = 256
PIECE_ROWS, PIECE_TURNS = 4096, 1 << 16
ROOT = b"\0" * 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, rank, key, bytes): every conversation's turns, ranked from 1; key is a 128-bit hash of (role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = messages.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    ranked = global_rank(kept(rows, "trie-turns"), [("known", "asc"), ("turn", "asc"), ("role", "asc"), ("key", "asc")], keys=["conv_id"])
    return ranked.select("conv_id", F.col("rank").cast("long").alias("rank"), "key", "bytes")


def borrowed(rows: DataFrame, source: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Replace the first ``head`` (at most ``most``) turns of each conversation by those of the conversation ``source`` (none if absent).
    ``rows`` as of turns(); -> (conv_id, pos, key, bytes) and (conv_id, length) of all conversations."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("own"))
    first = rows.where(F.col("rank") <= most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "bytes"))).alias("first"))  # at most ``most``
    lent = sizes.select("conv_id", "own", head.cast("long").alias("h"), source.alias("src")).join(first.withColumnRenamed("conv_id", "src"), "src", "left")
    lent = lent.select("conv_id", "h", "own", F.coalesce(F.slice("first", 1, F.greatest(F.col("h"), F.lit(0)).cast("int")), F.array().cast(first.schema["first"].dataType)).alias("lent"))
    lent = kept(lent.withColumn("shift", F.size("lent") - F.col("h")), "trie-lent")
    kept_own = rows.join(lent.select("conv_id", "h", "shift"), "conv_id").where(F.col("rank") > F.col("h")).select("conv_id", (F.col("rank") + F.col("shift")).alias("pos"), "key", "bytes")
    length = F.size("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return kept_own.unionByName(lent.select("conv_id", F.inline("lent")).select("conv_id", F.col("rank").alias("pos"), "key", "bytes")), lent.select("conv_id", length.cast("long").alias("length"))


def _terms(keys: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """(n, 4) 32-bit words, as uint64, of the hash of (depth, turn)."""
    at = pos.astype(np.uint64) * _STEP
    pair = np.stack([mix(keys[:, 0] ^ mix(at + np.uint64(1)) ^ mix(keys[:, 1] + at)), mix(keys[:, 1] ^ mix(at + np.uint64(2)) ^ mix(keys[:, 0] - at))], 1)
    return pair.view(np.uint32).astype(np.uint64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    sizes = np.diff(lists.offsets.to_numpy())
    return sizes, lists.flatten()


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _segments(placed: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """(conv_id, seg, ends, before, chain, bytes): before is the key of the prefix that the segment starts from, chain the keys of its prefixes."""
    rows = placed.withColumn("seg", F.floor((F.col("pos") - 1) / size).cast("long"))
    packed = rows.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "bytes"))).alias("t"))  # at most ``size``
    flat = packed.select("conv_id", "seg", F.transform("t", lambda x: x["key"]).alias("keys"), F.transform("t", lambda x: x["bytes"]).alias("bytes"))
    words = [f"w{i}" for i in range(4)]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys = _flat(_column(b, "keys"))
            seg = _column(b, "seg").to_numpy()
            at = np.cumsum(sizes) - sizes
            pos = np.arange(len(keys)) - np.repeat(at, sizes) + np.repeat(seg * size + 1, sizes)
            sums = np.add.reduceat(_terms(_keys(keys), pos), at, axis=0) if len(keys) else np.zeros((0, 4), np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array((sums[:, i] & np.uint64(0xFFFFFFFF)).astype(np.int64)) for i in range(4)]], names=[*b.schema.names, *words])

    summed = flat.mapInArrow(totals, "conv_id long, seg long, keys array<binary>, bytes array<long>, " + ", ".join(f"{w} long" for w in words))
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    started = summed.select("conv_id", "seg", "keys", "bytes", F.array(*[F.coalesce(F.sum(w).over(earlier), F.lit(0)) for w in words]).alias("start"))
    started = started.join(lengths, "conv_id").withColumn("ends", F.col("length") <= (F.col("seg") + 1) * size).drop("length")

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys = _flat(_column(b, "keys"))
            if not b.num_rows:
                continue
            seg = _column(b, "seg").to_numpy()
            at = np.cumsum(sizes) - sizes
            pos = np.arange(len(keys)) - np.repeat(at, sizes) + np.repeat(seg * size + 1, sizes)
            start = np.array(_column(b, "start").to_pylist(), np.uint64)
            run = np.cumsum(_terms(_keys(keys), pos), axis=0)
            base = np.where((at > 0)[:, None], run[np.maximum(at, 1) - 1], np.uint64(0))
            made = ((run - np.repeat(base - start, sizes, axis=0)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            before = (start & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            raw = made.tobytes()
            chain = pa.ListArray.from_arrays(pa.array(np.append(at, len(keys)), pa.int32()), pa.array([raw[i:i + 16] for i in range(0, len(raw), 16)], pa.binary()))
            yield pa.RecordBatch.from_arrays([_column(b, "conv_id"), _column(b, "seg"), _column(b, "ends"), pa.array([r.tobytes() for r in before], pa.binary()), chain, _column(b, "bytes")], names=["conv_id", "seg", "ends", "before", "chain", "bytes"])

    made = started.mapInArrow(chains, "conv_id long, seg long, ends boolean, before binary, chain array<binary>, bytes array<long>")
    none = lengths.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("seg"), F.lit(True).alias("ends"), F.lit(ROOT).alias("before"), F.array().cast("array<binary>").alias("chain"), F.array().cast("array<bigint>").alias("bytes"))
    return made.unionByName(none)


ORDER = ["before", "chain", "goes_on", "conv_id"]


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("goes_on", ~F.col("ends")).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Common first entries of two chains; equal entries have equal ones before them."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid - 1] == b[mid - 1] else (low, mid - 1)
    return low


def _neighbours(rows: DataFrame) -> DataFrame:
    """Adds lcp and next: the common turns with the row before and after in the whole order."""
    dealt = cut_lineage(_sorted(rows).withColumn("pid", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, held_lcp = None, None, None  # (before, chain) of the row ahead; the rows that wait for what follows them

        def out(following: int | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*held.columns, pa.array(held_lcp, pa.int64()), pa.array([*held_lcp[1:], following], pa.int64())], names=[*held.schema.names, "lcp", "next"])

        for b in batches:
            if not b.num_rows:
                continue
            lcp = []
            for x in zip(_column(b, "before").to_pylist(), _column(b, "chain").to_pylist()):
                lcp.append(None if last is None else _common(last[1], x[1]) if last[0] == x[0] else 0)
                last = x
            if held is not None:
                yield out(lcp[0])
            held, held_lcp = b, lcp
        if held is not None:
            yield out(None)

    fields = "conv_id long, seg long, ends boolean, before binary, chain array<binary>, bytes array<long>, goes_on boolean, pid int"
    inner = kept(dealt.mapInArrow(run, fields + ", lcp long, next long"), "trie-sorted")
    # the first row of a partition looks at the last one of the partition before: one row per partition
    row = F.struct("before", "chain", "goes_on", "conv_id")
    edge = dealt.groupBy("pid").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    by = Window.orderBy("pid")
    a, b = F.col("x.chain"), F.col("first.chain")
    same = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    common = F.when(F.col("x").isNull() | (F.col("x.before") != F.col("first.before")), 0).when(same > 0, same - 1).otherwise(F.least(F.size(a), F.size(b)))
    edge = edge.withColumn("x", F.lag("last").over(by)).select("pid", common.cast("long").alias("edge"))
    edge = edge.withColumn("after", F.coalesce(F.lead("edge").over(by), F.lit(0)))
    return inner.join(edge, "pid").withColumn("lcp", F.coalesce("lcp", "edge")).withColumn("next", F.coalesce("next", "after")).drop("edge", "after", "pid", "goes_on")


def _weighed(rows: DataFrame) -> DataFrame:
    """Adds what a conversation counts for beyond a segment: later_total, bytes of its later turns; later_fresh, bytes of those that no row
    before has; and leaf, the leaves that it ends in this segment or a later one: it ends one if no row follows with its whole sequence."""
    own_bytes = F.aggregate("bytes", F.lit(0).cast("long"), lambda a, x: a + x)
    own_fresh = F.aggregate(F.slice("bytes", F.col("lcp").cast("int") + 1, F.greatest(F.size("bytes"), F.lit(1))), F.lit(0).cast("long"), lambda a, x: a + x)
    ends_leaf = (F.col("ends") & (F.col("next") < F.size("chain"))).cast("long")
    rows = rows.withColumn("t", own_bytes).withColumn("f", own_fresh).withColumn("l", ends_leaf).drop("next")
    after = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    later = lambda c: F.coalesce(F.sum(c).over(after), F.lit(0))
    return rows.withColumn("later_total", later("t")).withColumn("later_fresh", later("f")).withColumn("leaf", F.col("l") + later("l")).drop("t", "f", "l")


class RangeMinima:
    """Minima of a sequence over ranges of power-of-two length."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minimum over [left, right], both inside."""
        k = np.frexp((right - left + 1).astype(float))[1] - 1
        out = np.empty(len(left), self.rows[0].dtype)
        for j in np.unique(k):
            i = np.flatnonzero(k == j)
            out[i] = np.minimum(self.rows[j][left[i]], self.rows[j][right[i] - (1 << j) + 1])
        return out

    def reach(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extents of the candidates (row, depth) when the sequence holds each row's LCP with the row before: how far left and right every
        LCP between is at least ``depth``. Binary search from the longest range to the shortest, each candidate by itself."""
        left, right, n = at.copy(), at.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            span, row = 1 << k, self.rows[k]
            fits = right + span < n
            go = fits & (row[np.where(fits, right + 1, 0)] >= depth)
            right[go] += span
            fits = left - span >= 0
            go = fits & (row[np.where(fits, left - span + 1, 0)] >= depth)
            left[go] -= span
        return left, right


PARTIAL = "key binary, parent binary, depth long, last_bytes long, conv_id long, n_convs long, total long, fresh long, leaves long, first_end long, ends string"


def _pieces(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[dict]:
    """Sorted rows in pieces of bounded rows and turns."""
    names = ("conv_id", "seg", "ends", "before", "chain", "bytes", "lcp", "leaf", "later_total", "later_fresh")
    held: dict[str, list] = {n: [] for n in names}
    turns_held = 0
    for b in batches:
        columns = {n: _column(b, n).to_pylist() for n in names}
        for i in range(b.num_rows):
            for n in names:
                held[n].append(columns[n][i])
            turns_held += len(columns["chain"][i])
            if len(held["seg"]) >= most_rows or turns_held >= PIECE_TURNS:
                yield held
                held, turns_held = {n: [] for n in names}, 0
    if held["seg"]:
        yield held


def _nodes(piece: dict, size: int) -> dict:
    """Partial rows of all nodes with members among the piece's rows."""
    n = len(piece["conv_id"])
    lens = np.array([len(c) for c in piece["chain"]], np.int64)
    off = np.cumsum(lens) - lens
    conv, seg = np.array(piece["conv_id"], np.int64), np.array(piece["seg"], np.int64)
    ends, leaf = np.array(piece["ends"], bool), np.array(piece["leaf"], np.int64)
    keys = [k for c in piece["chain"] for k in c]
    nbytes = np.array([x for c in piece["bytes"] for x in c], np.int64)
    upto = np.concatenate([[0], np.cumsum(nbytes)])
    far = np.array(piece["lcp"], np.int64)          # with the row before in the whole order
    lcp = far.copy()
    lcp[0] = 0                                      # with the row before in the piece
    later_total, later_fresh = np.array(piece["later_total"], np.int64), np.array(piece["later_fresh"], np.int64)
    row = np.repeat(np.arange(n), lens)
    depth = np.arange(len(row)) - off[row] + 1
    new = np.flatnonzero(depth > lcp[row])          # each distinct prefix of the piece once
    at, d = row[new], depth[new]
    minima = RangeMinima(lcp)
    left, right = minima.reach(at, d)
    total = upto[off + lens] - upto[off] + later_total
    fresh = upto[off + lens] - upto[np.minimum(off + far, off + lens)] + later_fresh
    run = lambda x: np.concatenate([[0], np.cumsum(x)])
    s_total, s_fresh, s_leaf = run(total), run(fresh), run(leaf)
    members = right - left + 1
    above = upto[off[left] + d - 1] - upto[off[left]]  # bytes of the turns before the node
    first = upto[off[left] + lens[left]] - upto[off[left] + np.maximum(d - 1, np.minimum(far[left], lens[left]))] + later_fresh[left]
    out = {
        "key": [keys[i] for i in new], "parent": [keys[i - 1] if k > 1 else piece["before"][r] for i, r, k in zip(new.tolist(), at.tolist(), d.tolist())],
        "depth": seg[at] * size + d, "last_bytes": nbytes[new], "conv_id": RangeMinima(conv).least(left, right), "n_convs": members,
        "total": s_total[right + 1] - s_total[left] - members * above, "fresh": s_fresh[right + 1] - s_fresh[left + 1] + first, "leaves": s_leaf[right + 1] - s_leaf[left]}
    # rows that end at a node are its interval's first ones, by conv_id
    first_end, joined = np.full(len(new), -1, object), np.full(len(new), None, object)
    whole = np.flatnonzero((lens[left] == d) & ends[left])
    stops = np.flatnonzero(np.concatenate([[True], (lcp[1:] < lens[1:]) | (lens[1:] != lens[:-1]) | (ends[1:] != ends[:-1]), [True]]))
    for i in whole.tolist():
        until = stops[np.searchsorted(stops, left[i], "right")]
        first_end[i], joined[i] = int(conv[left[i]]), ",".join(map(str, conv[left[i]:until].tolist()))
    out["first_end"], out["ends"] = [None if x == -1 else x for x in first_end], list(joined)
    top = np.flatnonzero((seg == 0))
    if len(top):  # the root's part
        a, z = int(top[0]), int(top[-1])
        bare = conv[a:z + 1][lens[a:z + 1] == 0]
        add = {"key": ROOT, "parent": None, "depth": 0, "last_bytes": 0, "conv_id": int(conv[a:z + 1].min()), "n_convs": z + 1 - a, "total": int(total[a:z + 1].sum()), "fresh": int(fresh[a:z + 1].sum()),
               "leaves": int(leaf[a:z + 1].sum()), "first_end": int(bare[0]) if len(bare) else None, "ends": ",".join(map(str, bare.tolist())) if len(bare) else None}
        out = {k: [*v, add[k]] for k, v in out.items()}
    return out


def _hashed(lists: DataFrame) -> DataFrame:
    """(key, first_end, ends) -> (key, ends_sha256): the texts of a key, in order of first_end, joined by commas and hashed as they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            keys, digests = [], []
            for k, text in zip(_column(b, "key").to_pylist(), _column(b, "ends").to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        digests.append(state.hexdigest())
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])
    return lists.repartition("key").sortWithinPartitions("key", "first_end").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(messages: DataFrame, source: Column | None = None, head: Column | None = None, most: int = 0, segment: int = SEGMENT, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per node: key (hex; the root's is zeros), parent (its key, null for the root), conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_bytes (bytes of texts that members repeat in the node's subtree), ends_sha256 (of the ids of the
    conversations that end there). With ``source`` and ``head``, columns over conv_id, conversations are rebuilt first, see borrowed()."""
    rows = turns(messages)
    if source is not None:
        rows = kept(rows, "trie-ranked")
        placed, lengths = borrowed(rows, source, head, most)
    else:
        placed, lengths = rows.withColumnRenamed("rank", "pos"), rows.groupBy("conv_id").agg(F.count("*").alias("length"))
    weighed = _weighed(_neighbours(_segments(placed, lengths, segment)))
    names = [f.split(" ")[0] for f in PARTIAL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
        for piece in _pieces(batches, piece_rows):
            out = _nodes(piece, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds[f.split(" ")[1]]) for n, f in zip(names, PARTIAL.split(", "))], names=names)

    parts = kept(_sorted(weighed).mapInArrow(run, PARTIAL), "trie-parts")
    nodes = kept(parts.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        (F.sum("total") - F.sum("fresh")).alias("saved_bytes"), F.sum("leaves").alias("leaves")), "trie-nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children"))
    lists = _hashed(parts.where(F.col("ends").isNotNull()).select("key", "first_end", "ends"))
    n = F.coalesce("children", F.lit(0))
    whole = nodes.join(children, "key", "left").join(lists, "key", "left").select(
        "key", "parent", "conv_id", "depth", "n_convs", n.alias("n_children"), F.when(n == 0, 1).otherwise(F.col("leaves")).alias("n_leaves"), "saved_bytes",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    # most children may have one parent: this join comes last and has both sides dealt for it alone, so that Spark splits a hot parent
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, "parent", "left").select(F.lower(F.hex("key")).alias("key"), F.lower(F.hex("parent")).alias("parent"), *whole.columns[2:], "parent_conv_id")
