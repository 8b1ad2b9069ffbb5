"""The Merkle manifest beside a plain hashlib tree."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, pos int, g string, leaf string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def show(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def proof(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at - at % 3
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + 3])))
        at //= 3
    return out


def brute(rows):
    by = {}
    for i, r in enumerate(rows):
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha(*map(show, r[:5])), i))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s, members in by.items():
        members.sort()
        trees[s] = tree([m[2] for m in members])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for p, (_, _, leaf, i) in enumerate(by[s]):
            steps = proof(trees[s], p) + proof(top, at)
            row = list(rows[i][:5])
            if row[4] is not None:
                row[4] = row[4].replace("\n", "")
            h = sha(*map(show, row))
            for a, b in steps:
                h = sha(a, h, b)
            out.append((rows[i][0], s, p, leaf, trees[s][-1][0], top[-1][0], steps, h))
    return sorted(out, key=repr)


def run(spark, rows, levels):
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(docs, F.replace("text", F.lit("\n"), F.lit("")), levels).collect()
    return sorted([(r.doc_id, r.source, r.position, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.proof], r.folded_root) for r in got], key=repr)


def test_states_are_those_of_sha256():
    for n in (0, 1, 3):
        digests = [hashlib.sha256(bytes([i])).hexdigest() for i in range(n + 1)]
        level = merkle.Level(np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64), np.array([n + 1]))
        assert [bytes(d).decode() for d in level.digests] == [sha(*digests[i:i + 3]) for i in range(0, n + 1, 3)]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_every_row_equals_the_plain_tree(spark, levels):
    """Blocks of one and two levels stack many rounds; sources of all sizes, a hot one, null sources and ids, repeated rows."""
    g = random.Random(levels)
    rows = [(i, f"s{i % 13}" if i % 3 else "hot", "en", i, f"line {i}\nmore" if g.random() < 0.5 else f"line {i}") for i in range(160)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, "hot", None, 1, ""), (5, "hot", None, 1, ""), (7, "é", "x", -4, "é\n\n日本"), (8, "", "x", 0, "w " * 60_000 + "\n")]
    assert run(spark, rows, levels) == brute(rows)


def test_one_row_one_source_and_none(spark):
    rows = [(1, "a", "en", 3, "x")]
    got = run(spark, rows, 2)
    assert got == brute(rows) and got[0][3] == got[0][4] == got[0][5] == got[0][7] and got[0][6] == []
    assert run(spark, [], 2) == []


def test_a_changed_text_is_noticed_and_an_unchanged_one_is_not(spark):
    rows = [(i, f"s{i % 4}", "en", 1, "a\nb" if i % 2 else "ab") for i in range(40)]
    got = run(spark, rows, 1)
    assert {r[0] for r in got if r[7] != r[5]} == {i for i in range(40) if i % 2}
