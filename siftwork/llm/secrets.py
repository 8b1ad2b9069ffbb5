"""Secret scanning with a trigram index.

Every rule's regular expression is turned into a Boolean query over trigrams that any match must contain: literal runs give a
conjunction of their trigrams, alternatives a disjunction. Texts come in blocks; a block's index maps each trigram that some rule asks
for to the sorted row numbers of the texts that hold it (letters folded). Postings are intersected and united as the query says, and
only the candidates are searched with the rule itself. A rule without a mandatory trigram, such as a run of hexadecimal digits, scans
every text of the block. Blocks are parts of Spark's partitions, so the scan is one pass without a shuffle.

Nulls and edges: a null text counts as empty and has no spans; ids and repeated rows pass through; spans of one kind never overlap,
spans of different kinds may; an empty table gives an empty result. A column named ``secrets`` is replaced; others are kept.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.tables import given_back

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
MOST_STRINGS = 64
BLOCK = 512


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0       # the group whose length counts
    least: int = 0       # characters it needs
    base: bool = False


#: The three base rules of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # runs of 24 or more: the runs that `[0-9a-f]+` finds, without the short ones
)
#: Further kinds of secrets with public, documented shapes.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]+@", True),
)
RULES = BASE_RULES + MORE_RULES


# Queries are True (no condition), a trigram, or ("and" | "or", frozenset of queries).

def _all(parts) -> object:
    parts = frozenset(p for p in parts if p is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any(parts) -> object:
    parts = frozenset(parts)
    return True if True in parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]) -> object:
    if min(map(len, strings)) < 3:
        return True
    return _any(_all(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(op, arg) -> set[str] | None:
    """All folded strings a node can match, if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {""}
    if op is C.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                out.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < MOST_STRINGS:
                out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is C.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
        body = _sequence_strings(arg[2])
        if body is None:
            return None
        out, now = set(), {""}
        for n in range(int(arg[1]) + 1):
            out |= now if n >= arg[0] else set()
            now = {a + b for a in now for b in body}
            if len(now) > MOST_STRINGS:
                return None
        return out
    return None


def _sequence_strings(items) -> set[str] | None:
    run = {""}
    for op, arg in items:
        more = _strings(op, arg)
        if more is None or len(run) * len(more) > MOST_STRINGS:
            return None
        run = {a + b for a in run for b in more}
    return run


def _sequence_query(items) -> object:
    run, clauses = {""}, []
    for op, arg in items:
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        clauses.append(_of_strings(run))
        run = {""} if more is None else more
        if more is None and op is C.SUBPATTERN:
            clauses.append(_sequence_query(arg[-1]))
        elif more is None and op is C.BRANCH:
            clauses.append(_any(_sequence_query(x) for x in arg[1]))
        elif more is None and op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            clauses.append(_sequence_query(arg[2]))
    return _all([*clauses, _of_strings(run)])


def trigram_query(pattern: str) -> object:
    """The trigrams (folded) that every match of ``pattern`` contains, as a Boolean query; True if none can be named."""
    return _sequence_query(_parser.parse(pattern, re.ASCII))


def trigrams_of(query: object) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams_of, query[1]))


class Postings:
    """Inverted index of a block of folded texts over the trigrams asked for."""

    def __init__(self, folded: list[str], trigrams: set[str]):
        self.n = len(folded)
        self.lists = {t: np.fromiter((i for i, x in enumerate(folded) if t in x), np.int32) for t in trigrams}

    def find(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.lists[query]
        found = sorted(map(self.find, query[1]), key=len)
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII | re.IGNORECASE * r.ignore_case), trigram_query(r.pattern)) for r in rules]
        self.trigrams = set().union(*(trigrams_of(q) for _, _, q in self.rules))

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        for at in range(0, len(texts), BLOCK):
            block = [t or "" for t in texts[at:at + BLOCK]]
            index = Postings([t.lower() for t in block], self.trigrams)
            for rank, (rule, compiled, query) in enumerate(self.rules):
                for i in index.find(query):
                    for m in compiled.finditer(block[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            out[at + i].append({"kind": rule.kind, "start": m.start(), "end": m.end(), "rank": rank})
        for spans in out:
            spans.sort(key=lambda s: (s["start"], s.pop("rank")))
        return out


def _map(docs: DataFrame, name: str, kind: T.DataType, rules: tuple[Rule, ...], value) -> DataFrame:
    plain = docs.drop(name) if name != "text" else docs
    fields = [f if f.name != name else T.StructField(name, kind) for f in plain.schema.fields]
    target = T.StructType(fields if name == "text" else [*fields, T.StructField(name, kind)])
    from pyspark.sql.pandas.types import to_arrow_type
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            new = pa.array(value(texts, scanner.scan(texts)), arrow_kind)
            columns = [new if n == name else c for n, c in zip(b.schema.names, b.columns)]
            yield pa.RecordBatch.from_arrays(columns if name == "text" else [*columns, new], names=[f.name for f in target.fields])
    return plain.mapInArrow(given_back(run), target)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, start, end) by start, then in the order of the rules; code points, end exclusive."""
    return _map(docs, "secrets", SPANS, rules, lambda texts, spans: spans)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[kind]`` (overlapping spans by the first one's)."""
    return _map(docs, "text", T.StringType(), rules, lambda texts, spans: [t if not s else _replaced(t, s) for t, s in zip(texts, spans)])


def _replaced(text: str, spans: list[dict]) -> str:
    out, end = [], 0
    for s in spans:
        if s["start"] >= end:
            out += [text[end:s["start"]], f"[{s['kind']}]"]
        end = max(end, s["end"])
    return "".join([*out, text[end:]])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
