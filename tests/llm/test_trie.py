"""The prefix trie beside a plain dictionary of prefixes."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, rank int, bytes string, depth int, ends boolean"


def text_key(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def rebuilt(rows, join):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text_key(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}
    if not join:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[:h[c]] + own[c][h[c]:] for c in own}


def brute(rows, join):
    convs = rebuilt(rows, join)
    nodes = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, join, **sizes):
    df = spark.createDataFrame([(*r, "k", 1, "b", 2, True) for r in rows], SCHEMA).repartition(3)
    c = F.col("conv_id")
    how = dict(source=c - c % 5, head=F.crc32(c.cast("string").cast("binary")) % 9, most=8) if join else {}
    got = trie.prefix_trie(df, **how, **sizes).collect()
    return sorted([(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_bytes, r.ends_sha256) for r in got], key=repr)


def odd_rows(seed):
    g = random.Random(seed)
    rows = []
    for c in range(90):
        hot = c % 3 == 0  # a third of all conversations are one conversation
        for t in range(11 if hot else g.randrange(1, 14)):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", f"hot {t}" if hot else f"{g.choice('abé')}" if g.random() < 0.9 else None))
    rows += [(200, None, None, "x"), (200, None, None, "x"), (200, 1, "user", None), (201, 0, "", "x"), (202, 5, "a", "long " * 30_000), (None, 1, "user", "lost"), (203, 0, "u", "1"), (203, 0, "u", "2"), (203, 0, "t", "3")]
    rows += [(300, i, "u", "same") for i in range(40)]  # one long conversation, and one that is its beginning
    rows += [(301, i, "u", "same") for i in range(36)]
    return rows


@pytest.mark.parametrize("join,sizes", [(True, {}), (True, {"segment": 3, "piece_rows": 7}), (False, {"segment": 4, "piece_rows": 1})])
def test_nodes_equal_a_dictionary_of_prefixes(spark, join, sizes):
    rows = odd_rows(3)
    assert run(spark, rows, join, **sizes) == brute(rows, join)


def test_conversations_without_turns_and_none(spark):
    only = [(c, 0, "u", "x") for c in (7, 13) if zlib.crc32(str(c).encode()) % 9 > 0]
    assert only and run(spark, only, True) == brute(only, True)
    assert run(spark, only, True)[0][1] == 0 and run(spark, [], True) == []


def test_each_candidate_finds_its_extents():
    g = np.random.default_rng(1)
    lcp = g.integers(0, 6, 200)
    lcp[0] = 0
    at, depth = g.integers(0, 200, 500), g.integers(1, 7, 500)
    left, right = trie.RangeMinima(lcp).reach(at, depth)
    for a, d, x, y in zip(at, depth, left, right):
        i = j = a
        while i > 0 and lcp[i] >= d:
            i -= 1
        while j + 1 < 200 and lcp[j + 1] >= d:
            j += 1
        assert (x, y) == (i, j)
