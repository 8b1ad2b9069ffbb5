"""Phrase dictionary: which phrases of a vocabulary a text holds, by looking its word n-grams up in literal sets.

A phrase matches where it stands between non-alphanumerics. The text is split into words with the separators that follow them; n-grams
of as many words as a phrase has are intersected with the phrases of that length, longer ones only from words that begin a phrase.
The plan holds the vocabulary as literals, not as code: its size does not grow the generated code, and a text is read once however many
phrases there are. Texts must be lower-cased.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"


def literal(words: Iterable[str]) -> str:
    """SQL text of an array of strings: one expression to parse instead of a call per word."""
    return "array(" + ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words) + ")"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def is_phrase(word: str) -> bool:
    """Does a phrase begin and end with a word? Others, like c++, need a pattern of their own."""
    return bool(re.fullmatch(r"[a-z0-9](.*[a-z0-9])?", word, re.S))


def occurrences(low: Column, phrases: Iterable[str]) -> Column:
    """array<struct<at, n, word>>: where each phrase begins and ends, in words; overlapping ones all count."""
    by_length: dict[int, list[str]] = {}
    for p in dict.fromkeys(phrases):
        by_length.setdefault(len(re.findall(WORD, p)), []).append(p)
    if not by_length:
        return F.array().cast("array<struct<at:int,n:int,word:string>>")

    def held(some: Column, of: Iterable[str], use: Callable[[Column], Column]) -> Column:
        return let(F.array_intersect(some, F.expr(literal(of))), use)

    def of_length(pieces: Column, words: Column, n: int, some: list[str]) -> Column:
        whole = lambda at: held(F.transform(at, lambda x: x["word"]), some, lambda known: F.filter(at, lambda x: F.array_contains(known, x["word"])))
        if n == 1:
            at = F.transform(words, lambda w, i: F.struct(i.alias("at"), F.lit(1).alias("n"), w.alias("word")))
            return held(words, some, lambda known: F.filter(at, lambda x: F.array_contains(known, x["word"])))
        begins = sorted({re.match(WORD, p)[0] for p in some})
        gram = lambda i: F.concat(*[F.get(pieces, i + k) for k in range(n - 1)], F.get(words, i + (n - 1)))

        def at_starts(known: Column) -> Column:
            starts = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(known, w), i)), lambda i: i.isNotNull() & (i + F.lit(n) <= F.size(words)))
            return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), gram(i).alias("word")))
        return let(held(words, begins, at_starts), whole)

    def found(pieces: Column, words: Column) -> Column:
        return F.concat(*[of_length(pieces, words, n, some) for n, some in sorted(by_length.items())])

    return let(F.struct(F.regexp_extract_all(low, F.lit(f"{WORD}[^a-z0-9]*"), F.lit(0)).alias("p"), F.regexp_extract_all(low, F.lit(f"({WORD})[^a-z0-9]*"), F.lit(1)).alias("w")),
               lambda t: found(t["p"], t["w"]))


def leftmost(found: Column) -> Column:
    """The non-overlapping ones among array<struct<g, at, rank, n, word>>, for each group g as an alternation would find them: from
    left to right, at one place the phrase of the lowest rank, and on from its end. -> array<struct<g, word>>"""
    none = F.array().cast("array<struct<g:int,word:string>>")
    start = F.struct(F.lit(-1).alias("g"), F.lit(0).alias("free"), none.alias("out"))

    def step(st: Column, x: Column) -> Column:
        take = (x["g"] != st["g"]) | (x["at"] >= st["free"])
        return F.struct(x["g"].alias("g"), F.when(take, x["at"] + x["n"]).otherwise(st["free"]).alias("free"),
                        F.when(take, F.array_append(st["out"], F.struct(x["g"].alias("g"), x["word"].alias("word")))).otherwise(st["out"]).alias("out"))
    return F.aggregate(F.array_sort(found), start, step, lambda st: F.array_distinct(st["out"]))


def distinct_phrases(low: Column, phrases: list[str]) -> Column:
    """Distinct phrases found as one alternation in list order finds them."""
    order = {p: i for i, p in reversed(list(enumerate(phrases)))}
    ranks = F.expr(f"map_from_arrays({literal(order)}, array({', '.join(map(str, order.values()))}))")
    ranked = F.transform(occurrences(low, phrases), lambda x: F.struct(F.lit(0).alias("g"), x["at"].alias("at"), F.try_element_at(ranks, x["word"]).alias("rank"), x["n"].alias("n"), x["word"].alias("word")))
    return F.transform(leftmost(ranked), lambda x: x["word"])


def group_counts(low: Column, groups: list[tuple[str, ...]]) -> Column:
    """array<struct<g, hits>>: number of distinct phrases found of each group (by its number) that has any. Within a group
    the longest phrase wins; groups do not hide one another's phrases."""
    members: dict[str, list[int]] = {}
    for g, words in enumerate(groups):
        for w in dict.fromkeys(words):
            members.setdefault(w, []).append(g)
    if not members:
        return F.array().cast("array<struct<g:int,hits:int>>")
    table = F.expr(f"map_from_arrays({literal(members)}, array({', '.join('array(' + ', '.join(map(str, gs)) + ')' for gs in members.values())}))")
    spread = F.flatten(F.transform(occurrences(low, members), lambda x: F.transform(F.try_element_at(table, x["word"]), lambda g: F.struct(
        g.alias("g"), x["at"].alias("at"), (-F.length(x["word"])).alias("rank"), x["n"].alias("n"), x["word"].alias("word")))))
    return let(leftmost(spread), lambda d: F.transform(F.array_distinct(F.transform(d, lambda x: x["g"])), lambda g: F.struct(
        g.alias("g"), F.size(F.filter(d, lambda x: x["g"] == g)).alias("hits"))))
