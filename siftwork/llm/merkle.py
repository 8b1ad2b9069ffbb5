"""Merkle dataset manifest: a SHA midstate tree over all rows, with a proof for each row and a way to verify a row without the others.

A leaf is the SHA-256 of a row's fields. The leaves of one source, in order of doc_id, are hashed ``FANOUT`` at a time, level by level,
to the source's subroot; the subroots, in order of source (null first, bytewise), are hashed likewise to the root. Digests are hashed as
hex text, so one child is exactly one 64-byte SHA block, and a parent can retain the state of its hash before each child slot. Folding a
replaced child resumes the state of its slot with the replacement and then needs the right siblings only. ``hashlib`` cannot hand out
its states, so the compression function is written here with numpy, over many nodes at once; states are 32 bytes and travel in rows.

Spark does the rest. Positions come from exact ranks over ranges of the whole order, so a source of a third of all rows is many tasks.
``FANOUT ** LEVELS`` consecutive nodes are one block, a task's unit of work; blocks' tops are the nodes of the next round. Rounds are the
logarithm of the largest source. A row carries its proof through one shuffle; what stands above its block is joined to it by block.

Nulls and edges: null fields are ``-``; a null doc_id comes first in its source; rows equal in source and doc_id follow their leaf digests, so
repeated rows are leaves of their own; a null source is a source; an empty table has no rows. Texts are hashed whole, in the JVM.
Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.tables import kept
from siftwork.operators.ranking import global_rank

FANOUT, LEVELS = 3, 6
NODES = 8192  # nodes hashed at once
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PROOF = "array<struct<left:string,right:string>>"
STEPS = "array<struct<state:binary,left:string,right:string>>"


def _cube_root(x: int) -> int:
    r = int(round(x ** (1 / 3)))
    while r ** 3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


def _fractions() -> tuple[np.ndarray, np.ndarray]:
    """SHA-256's round constants and first state: the first 32 bits of the fractions of cube and square roots of the first primes."""
    primes = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
    low = (1 << 32) - 1
    return np.array([_cube_root(p << 96) & low for p in primes], np.uint32), np.array([isqrt(p << 64) & low for p in primes[:8]], np.uint32)


_ROUND, START = _fractions()
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One SHA-256 block for many messages: ``state`` (8, n) and ``block`` (16, n) -> the next state (8, n)."""
    w = list(block)
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.array([a, b, c, d, e, f, g, h])


def _words(digests: np.ndarray) -> np.ndarray:
    """Hex digests (n, 64) of bytes as SHA blocks (16, n)."""
    return np.ascontiguousarray(np.ascontiguousarray(digests).view(">u4").astype(np.uint32).T)


def _finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests, as hex (n, 64), of messages of so many whole blocks that have come to ``state``."""
    pad = np.zeros((16, state.shape[1]), np.uint32)
    pad[0] = 1 << 31
    pad[15] = blocks * 512
    raw = np.ascontiguousarray(compress(state, pad).T).astype(">u4").view(np.uint8)
    return np.stack([_HEX[raw >> 4], _HEX[raw & 15]], 2).reshape(len(raw), 64)


def fold(state: np.ndarray, slot: np.ndarray, value: np.ndarray, right: list[np.ndarray], rights: np.ndarray) -> np.ndarray:
    """Parents' digests after one child each was replaced: resumes ``state`` (8, n), the hash before ``slot``, with the replacement
    ``value`` (n, 64), then the ``rights`` (n) right siblings, ``right[k]`` (n, 64)."""
    state = compress(state, _words(value))
    for k, sibling in enumerate(right):
        more = np.flatnonzero(rights > k)
        if len(more):
            state[:, more] = compress(state[:, more], _words(sibling[more]))
    return _finish(state, slot + 1 + rights)


class Level:
    """Nodes of blocks (given one after another, ``sizes`` each) and their parents, which retain the states before each child slot."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray):
        self.nodes = nodes
        start = np.cumsum(sizes) - sizes
        self.sizes = -(-sizes // FANOUT)
        place = np.arange(len(nodes)) - np.repeat(start, sizes)
        self.slot = place % FANOUT
        self.parent = np.repeat(np.cumsum(self.sizes) - self.sizes, sizes) + place // FANOUT
        self.first = np.flatnonzero(self.slot == 0)
        self.width = np.bincount(self.parent, minlength=int(self.sizes.sum()))
        state = np.repeat(START[:, None], len(self.first), 1)
        self.states = [state]  # before slot 0, 1, ...
        for k in range(FANOUT):
            has = np.flatnonzero(self.width > k)
            state = state.copy()
            if len(has):
                state[:, has] = compress(state[:, has], _words(nodes[self.first[has] + k]))
            self.states.append(state)
        self.digests = _finish(state, self.width)

    def state(self, child: np.ndarray) -> np.ndarray:
        """(8, n): what the parents retain before these children's slots."""
        return np.stack(self.states)[self.slot[child], :, self.parent[child]].T.copy()

    def siblings(self, child: int) -> tuple[bytes, bytes]:
        first = child - self.slot[child]
        end = first + self.width[self.parent[child]]
        return self.nodes[first:child].tobytes(), self.nodes[child + 1:end].tobytes()

    def fold(self, child: np.ndarray, value: np.ndarray) -> np.ndarray:
        rights = self.width[self.parent[child]] - 1 - self.slot[child]
        last = len(self.nodes) - 1
        right = [self.nodes[np.minimum(child + 1 + k, last)] for k in range(FANOUT - 1)]
        return fold(self.state(child), self.slot[child], value, right, rights)


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, 64)


def _hex(nodes: np.ndarray) -> list[str]:
    text = nodes.tobytes().decode()
    return [text[i:i + 64] for i in range(0, len(text), 64)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of (g, block) as tables that hold whole blocks, about ``NODES`` rows each."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows >= NODES:
            g, block = held.column("g").to_pylist(), held.column("block").to_pylist()
            cut = held.num_rows - 1
            while cut and (g[cut - 1], block[cut - 1]) == (g[-1], block[-1]):
                cut -= 1
            if cut:
                yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks()


def _climbed(nodes: DataFrame, levels: int, folds: bool) -> DataFrame:
    """Hash the blocks of ``nodes`` (g, pos, n, node, ...; n nodes in g) upwards. Adds block, top (the block's top node) and either
    steps (state, left and right siblings by level) or, with ``folds``, proof (siblings by level) and folded, what ``changed`` comes to."""
    size = FANOUT ** levels
    dealt = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    dealt = dealt.repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    extra = f"top string, proof {PROOF}, folded string" if folds else f"top string, steps {STEPS}"
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(nodes.sparkSession.createDataFrame([], f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema)}, {extra}").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            key = list(zip(t.column("g").to_pylist(), t.column("block").to_pylist()))
            start = np.array([i for i in range(len(key)) if not i or key[i] != key[i - 1]])
            sizes = np.diff(np.append(start, len(key)))
            left = t.column("n").to_numpy()[start].copy()  # nodes of g at this level
            now, at = _digests(t.column("node").combine_chunks()), np.arange(len(key))
            value = _digests(t.column("changed").combine_chunks()).copy() if folds else None
            path: list[list[dict]] = [[] for _ in key]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            for _ in range(levels):
                open_ = left > 1
                if not open_.any():
                    break
                # finished blocks keep their single node; the others go one level up
                held = np.repeat(np.arange(len(sizes)), sizes)
                up = open_[held]
                place = np.cumsum(up) - 1
                level = Level(now[up], sizes[open_])
                rows = np.flatnonzero(open_[owner])
                child = place[at[rows]]
                states = None if folds else np.ascontiguousarray(level.state(child).T)
                if folds:
                    value[rows] = level.fold(child, value[rows])
                known: dict[int, tuple[str, str]] = {}
                for i, (r, c) in enumerate(zip(rows.tolist(), child.tolist())):
                    if c not in known:
                        a, b = level.siblings(c)
                        known[c] = (a.decode(), b.decode())
                    step = {"left": known[c][0], "right": known[c][1]}
                    path[r].append(step if folds else {"state": states[i].tobytes(), **step})
                new_sizes = sizes.copy()
                new_sizes[open_] = level.sizes
                begin = np.cumsum(new_sizes) - new_sizes
                merged = np.empty((int(new_sizes.sum()), 64), np.uint8)
                closed = ~open_
                merged[begin[closed]] = now[(np.cumsum(sizes) - sizes)[closed]]
                merged[np.repeat(open_, new_sizes)] = level.digests
                inner = np.cumsum(level.sizes) - level.sizes
                shift = np.zeros(len(sizes), np.int64)
                shift[open_] = begin[open_] - inner
                at[closed[owner]] = begin[owner[closed[owner]]]
                at[rows] = level.parent[child] + shift[owner[rows]]
                now, sizes, left = merged, new_sizes, np.where(open_, -(-left // FANOUT), left)
            add = {"top": pa.array(_hex(now[at])), "steps" if not folds else "proof": pa.array(path, out.field("steps" if not folds else "proof").type)}
            if folds:
                add["folded"] = pa.array(_hex(value))
            columns = [add[f.name] if f.name in add else t.column(f.name).combine_chunks() for f in out]
            yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out).to_batches()
    return dealt.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", " + extra)


def tower(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(g, pos, n, node) -> (g, pos, steps, top): every node's way to the top of its g."""
    here = kept(_climbed(nodes.select("g", "pos", "n", "node"), levels, False), "merkle-tower")
    if (here.agg(F.max("n")).first()[0] or 0) <= FANOUT ** levels:
        return here.select("g", "pos", "steps", "top")
    above = tower(_tops(here, levels), levels).select("g", F.col("pos").alias("block"), F.col("steps").alias("more"), F.col("top").alias("end"))
    return here.join(above, ["g", "block"]).select("g", "pos", F.concat("steps", "more").alias("steps"), F.col("end").alias("top"))


def _tops(climbed: DataFrame, levels: int) -> DataFrame:
    size = FANOUT ** levels
    return climbed.where(F.col("pos") % size == 0).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("node"))


def digest(*fields: Column) -> Column:
    """SHA-256 of fields, each ``-`` if null, else its bytes' count, ``:``, and itself."""
    shown = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*shown), 256)


def leaves(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, changed): ``changed`` is the leaf with another text; a null text there means the row is as it was."""
    own = [F.col(c) for c in FIELDS[:-1]]
    leaf = digest(*own, F.col("text"))
    changed = F.when(changed_text.isNotNull(), digest(*own, changed_text)) if changed_text is not None else F.lit(None).cast("string")
    return docs.select("doc_id", "source", leaf.alias("leaf"), changed.alias("changed")).withColumn("changed", F.coalesce("changed", "leaf"))


def manifest(docs: DataFrame, changed_text: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs`` (columns FIELDS): doc_id, source, position in the source, leaf, subroot, root, proof (siblings to the left and to
    the right at every level, from the leaf to the root), and folded_root: the root that the leaf with ``changed_text``, or else the
    leaf itself, comes to when it is folded into the retained states."""
    g = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    rows = kept(leaves(docs, changed_text).withColumn("g", g).withColumn("known", F.col("doc_id").isNotNull()), "merkle-leaves")
    ranked = global_rank(rows, [("known", "asc"), ("doc_id", "asc"), ("leaf", "asc")], keys=["g"], name="pos")
    counts = rows.groupBy("g").agg(F.count("*").alias("n"))
    placed = ranked.join(counts, "g").select("g", (F.col("pos") - 1).cast("long").alias("pos"), "n", F.col("leaf").alias("node"), "changed", "doc_id", "source")
    members = kept(_climbed(placed, levels, True), "merkle-members")
    above = tower(_tops(members, levels), levels)
    subroots = above.where("pos = 0").select(F.col("g").alias("key"), F.col("top").alias("node"))
    order = global_rank(kept(subroots, "merkle-subroots"), [("key", "asc")], name="pos")
    total = order.agg(F.count("*").alias("n"))
    sources = tower(order.crossJoin(F.broadcast(total)).select(F.lit("").alias("g"), (F.col("pos") - 1).cast("long").alias("pos"), "n", "node"), levels)
    named = sources.join(order.select("key", (F.col("pos") - 1).alias("pos")), "pos").select(F.col("key").alias("g"), F.col("steps").alias("last"), F.col("top").alias("root"))
    ways = above.join(named, "g").select("g", F.col("pos").alias("block"), F.col("top").alias("subroot"), "root", F.concat("steps", "last").alias("steps"))
    joined = members.select("doc_id", "source", F.col("pos").alias("position"), F.col("node").alias("leaf"), "proof", "folded", "g", "block").join(ways, ["g", "block"]).drop("g", "block")
    whole = F.concat("proof", F.transform("steps", lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right"))))
    return _resumed(joined).select("doc_id", "source", "position", "leaf", "subroot", "root", whole.alias("proof"), "folded_root")


def _resumed(rows: DataFrame) -> DataFrame:
    """Adds folded_root: ``folded`` taken up all ``steps``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", folded_root string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023,E731
            steps = column("steps")
            begin, ends = steps.offsets.to_numpy()[:-1], steps.offsets.to_numpy()[1:]
            flat = steps.values
            state = np.frombuffer(b"".join(flat.field("state").to_pylist()), np.uint32).reshape(-1, 8)
            slot = np.array([len(x) for x in flat.field("left").to_pylist()], np.int64) // 64
            texts = flat.field("right").to_pylist()
            value = _digests(column("folded")).copy()
            for k in range(int((ends - begin).max(initial=0))):
                go = np.flatnonzero(ends - begin > k)
                s = begin[go] + k
                rights = np.array([len(texts[x]) for x in s], np.int64) // 64
                right = np.frombuffer("".join(texts[x].ljust(64 * (FANOUT - 1), "0") for x in s).encode(), np.uint8).reshape(len(s), FANOUT - 1, 64)
                value[go] = fold(np.ascontiguousarray(state[s].T), slot[s], value[go], [right[:, j] for j in range(FANOUT - 1)], rights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_hex(value), pa.string())], names=[*batch.schema.names, "folded_root"])
    return rows.mapInArrow(run, schema)
