"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of ``WORD`` in the text with A-Z lower-cased. A document word is hit if it lies in an occurrence of ``WINDOW``
consecutive words of an item; an item with fewer words is one window of its own length.

Both sides are fingerprinted the same way: of every ``span - gram + 1`` consecutive hashes of ``gram`` words the smallest is kept
(the last of equals), once per position. Any shared run of ``span`` words therefore has a fingerprint in common; ``gram`` 5 and
``span`` 10 do that for full windows, and items shorter than that are kept whole (``gram = span``). Fingerprints are joined, and every
match is compared word by word and extended to both sides by at most ``span - gram`` words, which reaches every window around it.

Scale: one pass over the documents and one shuffle of a short row per document plus its hits. The item fingerprints are broadcast only
while a measured size stays under ``BROADCAST_BYTES``; beyond it the fingerprints are joined by a shuffle (AQE splits hot ones) and only
documents with a match are read again. The collected spans of a document are bounded by its own words times the items sharing them.

Nulls and edges: null and empty texts have no words and give a row of zeros; a null doc_id is kept; every input row gives one
output row, repeated rows too; items without words are ignored, repeated item ids count once, a null item id counts as one item
that adds nothing to the id list; empty tables give empty or all-clean results. Extra columns are ignored.
"""
from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
BROADCAST_BYTES = 32 << 20


def hashed_words(df: DataFrame, key: str) -> DataFrame:
    """(key, copy, h): ``h`` holds one hash per word, ``copy`` tells rows of equal key but different text apart."""
    found = F.regexp_extract_all(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))
    return df.select(key, F.xxhash64("text").alias("copy"), F.coalesce(F.transform(found, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>")).alias("h"))


def _run(equal: list[Column]) -> Column:
    """How many leading conditions hold."""
    out = F.lit(len(equal))
    for j in reversed(range(len(equal))):
        out = F.when(~F.coalesce(equal[j], F.lit(False)), j).otherwise(out)
    return out


def fingerprints(hashed: DataFrame, gram: int, span: int, marked: bool = False) -> DataFrame:
    """Rows of ``hashed`` with (at, fp) for each winnowed position: one whose gram is the last smallest of some window around it, that
    is, the larger grams before it and after it make up a window. ``marked`` adds one row per input row with at -1 and null fp."""
    width = span - gram + 1
    n = F.size("h")
    grams = F.transform(F.sequence(F.lit(0), n - gram), lambda i: F.xxhash64(*[F.get("h", i + x) for x in range(gram)]))
    base = hashed.select("*", F.when(n >= span, grams).otherwise(F.array().cast("array<bigint>")).alias("_g"))
    rows = (base if marked else base.where(n >= span)).select("*", F.explode(F.sequence(F.lit(-1 if marked else 0), F.size("_g") - 1)).alias("at"))
    near = lambda j: F.get("_g", F.col("at") + j)
    room = _run([near(-j) >= near(0) for j in range(1, width)]) + _run([near(j) > near(0) for j in range(1, width)])
    return rows.where((F.col("at") < 0) | (room >= width - 1)).select(*hashed.columns, "at", near(0).alias("fp"))


def _extended(joined: DataFrame, gram: int, span: int) -> DataFrame:
    """Adds (first, last) of the shared run around a match, null where the words differ or the run is shorter than ``span``."""
    same = lambda j: F.get("h", F.col("at") + j) == F.get("ih", F.col("q") + j)
    left, right = (_run([same(-j) for j in range(1, span - gram + 1)]), _run([same(gram + j) for j in range(span - gram)])) if span > gram else (F.lit(0), F.lit(0))
    joined = joined.withColumns({"_l": left, "_r": right})
    whole = reduce(lambda a, b: a & b, [same(j) for j in range(gram)]) & (F.col("_l") + F.col("_r") + gram >= span)
    return joined.withColumns({"first": F.when(whole, F.col("at") - F.col("_l")), "last": F.when(whole, F.col("at") + gram - 1 + F.col("_r"))})


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, copy, n, row, item_id, first, last): one row per document row (``row`` 1, no item) and one per shared run found
    (``row`` 0); runs can repeat and overlap."""
    hashed_docs = hashed_words(docs, "doc_id")
    hashed_items = hashed_words(items, "item_id").where(F.size("h") > 0).withColumnRenamed("copy", "icopy").dropDuplicates(["item_id", "icopy"])
    measured = hashed_items.groupBy(F.least(F.size("h"), F.lit(window)).alias("span")).agg(F.sum(F.size("h") * (F.size("h") * 8 + 64.0)).alias("bytes")).collect()
    sizes = {r["span"]: r["bytes"] for r in measured}  # at most `window` rows
    parts = []
    for span in sorted({window, *sizes}, reverse=True):
        size_of = gram if span == window else span
        marked = span == window
        fps = fingerprints(hashed_docs, size_of, span, marked)
        item_fps = fingerprints(hashed_items.where(F.size("h") >= window if marked else F.size("h") == span), size_of, span).select(F.col("fp"), F.col("at").alias("q"), "item_id", "icopy", F.col("h").alias("ih"))
        if sizes.get(span, 0) <= broadcast_bytes:
            parts.append(_rows(_extended(fps.join(F.broadcast(item_fps), "fp", "left" if marked else "inner"), size_of, span)))
            continue
        if marked:
            parts.append(hashed_docs.select("doc_id", "copy", F.size("h").alias("n"), F.lit(1).alias("row"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")))
        plain = fingerprints(hashed_docs, size_of, span).select("doc_id", "copy", "at", "fp")
        found = plain.join(item_fps.select("fp", "q", F.xxhash64("item_id", "icopy").alias("ik")), "fp").dropDuplicates(["doc_id", "copy", "at", "q", "ik"])
        whole_items = hashed_items.select("item_id", F.col("h").alias("ih"), F.xxhash64("item_id", "icopy").alias("ik"))
        a, b = found.alias("a"), hashed_docs.dropDuplicates(["doc_id", "copy"]).alias("b")
        with_words = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.copy") == F.col("b.copy"))).select("b.*", "at", "q", "ik").join(whole_items, "ik")
        parts.append(_rows(_extended(with_words, size_of, span)))
    return reduce(DataFrame.unionByName, parts)


def _rows(extended: DataFrame) -> DataFrame:
    mark = F.col("at") < 0
    return extended.where(mark | F.col("first").isNotNull()).select("doc_id", "copy", F.size("h").alias("n"), mark.cast("int").alias("row"), "item_id", "first", "last")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document row: doc_id, copy, n_words, n_hit, spans (merged [first, last] word positions), item_ids (sorted as strings), n_items."""
    run = F.when(F.col("row") == 0, F.struct("first", "last"))
    item = F.when(F.col("row") == 0, F.struct(F.col("item_id").cast("string").alias("id")))
    grouped = hits(docs, items, window, gram, broadcast_bytes).groupBy("doc_id", "copy").agg(
        F.max("n").cast("long").alias("n_words"), F.sum("row").alias("_rows"), F.sort_array(F.collect_set(run)).alias("_runs"), F.sort_array(F.collect_set(item)).alias("_items"))
    merged = F.aggregate(  # runs are sorted by first: lengthen the last span or open another
        "_runs", F.array().cast("array<struct<first:int,last:int>>"),
        lambda acc, r: F.when((F.size(acc) > 0) & (r["first"] <= F.get(acc, F.size(acc) - 1)["last"] + 1), F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["first"].alias("first"), F.greatest(F.get(acc, F.size(acc) - 1)["last"], r["last"]).alias("last")))
        )).otherwise(F.concat(acc, F.array(F.struct(r["first"].alias("first"), r["last"].alias("last"))))))
    out = grouped.select("*", F.when(F.size("_runs") > 0, merged).otherwise(F.array().cast("array<struct<first:int,last:int>>")).alias("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    out = out.select("doc_id", "copy", "n_words", hit.alias("n_hit"), "spans", F.filter(F.transform("_items", lambda s: s["id"]), lambda x: x.isNotNull()).alias("item_ids"), F.size("_items").cast("long").alias("n_items"), "_rows")
    return out.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))).alias("_again")).drop("_rows", "_again")
