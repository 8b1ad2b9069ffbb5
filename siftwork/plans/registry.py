"""Query registry. A plan is a function (spark, sf_dir) -> DataFrame; an optional SQL text states the same result."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwork.sources.views import VIEWS, bind_plain, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_VIEW_NAMES = ["postings", *VIEWS]
_DEPENDS = {"evals": [], "postings": []}


def with_views(sql: str) -> str:
    """Prepend the derived views a statement mentions as common table expressions."""
    used = [v for v in _VIEW_NAMES if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql, re.I)]
    ctes = [f"{v} AS ({bind_plain(view_sql(v))})" for v in used]
    body = sql.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if m:
        head = "WITH RECURSIVE " if m.group(1) else "WITH "
        return head + ",\n".join(ctes + [body[m.end():]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return add
