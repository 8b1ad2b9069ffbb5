"""Per-company application caps stated in posting text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions import fixed_values as fv
from siftwork.functions.text import squeeze

def _offsets(text: Column, rx: Column) -> Column:
    """0-based (start, length) of each match, from running sums of piece lengths."""
    found = F.regexp_extract_all(text, rx, F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, rx, -1), 1, F.size(found)).alias("p"), found.alias("m"))
    none = F.array().cast("array<struct<start:int,size:int>>")
    return F.aggregate(
        pairs, F.struct(F.lit(0).alias("pos"), none.alias("out")),
        lambda st, x: F.struct(
            (st["pos"] + F.length(x["p"]) + F.length(x["m"])).alias("pos"),
            F.array_append(st["out"], F.struct((st["pos"] + F.length(x["p"])).alias("start"),
                                               F.length(x["m"]).alias("size"))).alias("out")))["out"]


def _sentence(text: Column, start: Column, size: Column) -> Column:
    """The sentence around a match: back to the last ". " or line end, on to the next one."""
    before = F.element_at(F.split(F.substring(text, F.lit(1), start), r"\. |\n", -1), -1)
    rest = F.substring(text, start + size + 1, F.length(text))
    tail = r"(?s)^(.*?)(?:(\.) |\n|$)"
    return squeeze(F.concat(before, F.substring(text, start + 1, size), F.regexp_extract(rest, tail, 1),
                            F.regexp_extract(rest, tail, 2)))


def _count(match: Column) -> Column:
    n = F.lower(F.concat(F.regexp_extract(match, fv.CAP_PATTERN, 1), F.regexp_extract(match, fv.CAP_PATTERN, 2)))
    word = F.array_position(F.array(*[F.lit(w) for w in fv.NUMBER_WORDS]), n).cast("int")
    return F.when(n == "", F.lit(1)).when(n.rlike("^[0-9]"), n.try_cast("int")).otherwise(word)


def application_cap(text: Column) -> Column:
    """Struct(cap, cap_text) or NULL. Anchors are tried in list order, each at its places in text order;
    the pattern runs only in a small window around an anchor, and only when the text talks of applying."""
    low = F.lower(text)
    anchors = F.array(*[F.lit(a) for a in fv.CAP_ANCHORS])

    def near(o: Column) -> Column:
        lo = F.greatest(o["start"] - fv.CAP_WINDOW_BEFORE, F.lit(0))
        return F.struct(lo.alias("lo"), F.substring(text, lo + 1, o["start"] + fv.CAP_WINDOW_AFTER - lo).alias("win"))

    def found(w: Column) -> Column:
        return F.transform(_offsets(w["win"], F.lit(fv.CAP_PATTERN)), lambda m: F.struct(
            F.substring(w["win"], m["start"] + 1, m["size"]).alias("hit"),
            _sentence(text, w["lo"] + m["start"], m["size"]).alias("said")))

    windows = F.flatten(F.transform(anchors, lambda a: F.transform(_offsets(low, a), near)))
    hits = F.filter(F.flatten(F.transform(windows, found)), lambda h: (
        h["said"].rlike(fv.ABOUT_APPLYING) & (F.length(h["said"]) <= fv.CAP_SENTENCE_MAX) & ~h["hit"].rlike(fv.PER_ROLE)))
    first = F.get(F.transform(hits, lambda h: F.struct(_count(h["hit"]).alias("cap"), h["said"].alias("cap_text"))), F.lit(0))
    return F.when(low.contains("appl") & low.rlike("|".join(fv.CAP_ANCHORS)), first)
