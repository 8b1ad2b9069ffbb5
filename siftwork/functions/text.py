"""Column builders for URLs, names, titles, places, HTML and text. Everything stays in the JVM."""
from __future__ import annotations

import functools
import html.entities
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions import fixed_values as fv


def words_rx(words, before=r"\b", after=r"\b", flags="(?i)") -> str:
    """One alternation over regex fragments inside one pair of boundaries."""
    return f"{flags}{before}(?:{'|'.join(words)}){after}"


def literal_rx(words) -> str:
    return "|".join(re.escape(w) for w in words)


def bounded_rx(words, flags="(?i)") -> str:
    """Literal keywords, each bounded only on the sides where it starts or ends with a letter or digit."""
    def one(w: str) -> str:
        left = "(?<![A-Za-z0-9])" if w[:1].isalnum() else ""
        right = "(?![A-Za-z0-9])" if w[-1:].isalnum() else ""
        return left + re.escape(w) + right
    return flags + "|".join(one(w) for w in words)


def holds_any(low: Column, needles) -> Column:
    """Does a lower-cased text hold any of the needles?"""
    out = F.lit(False)
    for n in needles:
        if n:
            out = out | low.contains(n.lower())
    return out


def contains_any(c: Column, needles) -> Column:
    return holds_any(F.lower(c), needles)


def squeeze(c: Column) -> Column:
    """Collapse every whitespace run to one space and trim, as ``' '.join(s.split())``."""
    return F.trim(F.regexp_replace(c, fv.WS + "+", " "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(fv.WS_CHARS))


def array_text(c: Column) -> Column:
    return F.array_join(c, "|")


# ---- URLs ------------------------------------------------------------------------------------

_URL = r"^[^:/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def _plain(c: Column) -> Column:
    """Percent-decoded; bad escapes are kept as text."""
    return F.coalesce(F.try_url_decode(c), F.regexp_replace(c, r"\+", " "))


def _encode(plain: Column) -> Column:
    enc = F.url_encode(plain)
    return F.replace(F.replace(enc, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _param_key(p: Column) -> Column:
    return F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)))


def canonical_url(url: Column) -> Column:
    u = strip(url)
    u = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, _URL, 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, _URL, 2), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(u, _URL, 3)
    kept = F.filter(
        F.split(query, "&"),
        lambda p: p.rlike("(?s)^[^=]*=.") & ~_param_key(p).isin(fv.TRACKING_PARAMS) & ~_param_key(p).startswith("utm_"))
    pairs = F.array_sort(F.transform(kept, lambda p: F.struct(
        _plain(F.substring_index(p, "=", 1)).alias("k"), _plain(F.regexp_replace(p, "^[^=]*=", "")).alias("v"))))   # decoded first: spellings of one URL sort alike
    encoded = F.array_join(F.transform(pairs, lambda s: F.concat(_encode(s["k"]), F.lit("="), _encode(s["v"]))), "&")
    tail = F.when(query == "", F.lit("")).otherwise(F.when(encoded == "", F.lit("")).otherwise(F.concat(F.lit("?"), encoded)))
    return F.when(url.isNull(), None).when(strip(url) == "", F.lit("")).otherwise(
        F.concat(F.lit("https://"), host, path, tail))


def board_from_url(url: Column) -> Column:
    """Struct(ats_type, ats_token) named by a public posting URL, or NULL."""
    site = F.regexp_extract(url, fv.WORKDAY_URL, 3)
    token = F.concat_ws("/", F.regexp_extract(url, fv.WORKDAY_URL, 1), F.regexp_extract(url, fv.WORKDAY_URL, 2), site)
    out = F.when((site != "") & ~F.lower(site).isin(fv.WORKDAY_RESERVED_SITES),
                 F.struct(F.lit("workday").alias("ats_type"), token.alias("ats_token")))
    for ats, rx in fv.BOARD_URLS:
        out = out.when(url.rlike(rx), F.struct(F.lit(ats).alias("ats_type"), F.regexp_extract(url, rx, 1).alias("ats_token")))
    return out


# ---- names, titles, places -------------------------------------------------------------------

_BRACKETS = r"[\(\[].*?[\)\]]"


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.lower(name), _BRACKETS, " ")
    s = F.regexp_replace(s, rf"\b(?:{'|'.join(fv.COMPANY_SUFFIXES)})\b\.?", " ")
    s = F.btrim(F.regexp_replace(s, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def company_key(name: Column) -> Column:
    s = slug(F.coalesce(name, F.lit("")))
    out = None
    for alias, canonical in fv.COMPANY_ALIASES.items():
        out = (F.when if out is None else out.when)(s == alias, F.lit(canonical))
    return out.otherwise(s)


def normalize_title(title: Column) -> Column:
    t = F.regexp_replace(F.lower(unescape(title)), _BRACKETS, " ")
    t = F.regexp_replace(t, words_rx(fv.TITLE_NOISE), " ")
    t = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    for suffix in ("ing", "er", "s"):        # light stemming; at least four letters must remain
        t = F.regexp_replace(t, rf"\b([a-z0-9]{{4,}}){suffix}\b", "$1")
    return t


def normalize_place(location: Column) -> Column:
    city = F.lower(unescape(F.coalesce(location, F.lit(""))))
    city = F.regexp_extract(city, r"(?s)^(.*?)(?:[;|/]|\band\b|\bor\b|$)", 1)
    city = F.substring_index(city, ",", 1)
    city = F.regexp_replace(city, words_rx(fv.PLACE_NOISE, flags=""), " ")
    city = F.trim(F.regexp_replace(city, "[^a-z0-9]+", " "))
    known = F.transform(F.array(city), lambda c: F.coalesce(F.try_element_at(_small_map(fv.PLACE_ALIASES), c), c))
    return F.element_at(known, 1)


def dedup_key(company: Column, title: Column, location: Column) -> Column:
    return F.sha1(F.concat_ws("|", slug(company), normalize_title(title), normalize_place(location)))


def text_hash(text: Column) -> Column:
    return F.when(text.isNull() | (text == ""), None).otherwise(F.sha1(squeeze(text)))


def looks_like_internship(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(words_rx(fv.INTERNSHIP_WORDS))


# ---- HTML ------------------------------------------------------------------------------------

_COMMON = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": "\xa0", "copy;": "\xa9", "middot;": "\xb7",
           "#39;": "'", "#x27;": "'", "mdash;": "—", "ndash;": "–", "rsquo;": "’", "amp": "&"}
_LEGACY = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True)
_ENTITY = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:{'|'.join(_LEGACY)}))"
_LEGACY_HEAD = rf"^({'|'.join(_LEGACY)})"
# numeric references that HTML maps to another character (windows-1252 range)
_C1 = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


_TABLE = "\x01" + "".join(f"{k}\x02{v}\x01" for k, v in html.entities.html5.items())


def _small_map(m: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in m.items() for x in (str(k), v)])


def _table_lookup(name: Column) -> Column:
    """Look a name up in the full entity table, kept as one string literal (rare path)."""
    probe = F.concat(F.lit("\x01"), name, F.lit("\x02"))
    return F.when(F.contains(F.lit(_TABLE), probe), F.substring_index(
        F.call_function("substring_index", F.lit(_TABLE), probe, F.lit(-1)), "\x01", 1))


def _code_point(n: Column) -> Column:
    ok = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    dropped = n.between(1, 8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.when(n.between(0x80, 0x9F), F.coalesce(F.try_element_at(_small_map(_C1), n.cast("string")), char)).when(
        ok & dropped, F.lit("")).when(ok, char).otherwise(F.lit("�"))


def _entity(m: Column) -> Column:
    name = F.regexp_replace(m, "^&", "")
    head = F.regexp_extract(name, _LEGACY_HEAD, 1)
    digits = F.regexp_extract(name, "^#([0-9]+)", 1)
    hexits = F.regexp_extract(name, "^#[xX]([0-9a-fA-F]+)", 1)
    short = F.regexp_replace(hexits, "^0+(?=.)", "")
    return F.coalesce(
        F.try_element_at(_small_map(_COMMON), name),
        F.when(digits != "", _code_point(F.coalesce(digits.try_cast("bigint"), F.lit(0)))),
        F.when(hexits != "", _code_point(F.when(F.length(short) <= 8, F.conv(short, 16, 10).try_cast("bigint")).otherwise(F.lit(0)))),
        _table_lookup(name),
        F.when(head != "", F.concat(_table_lookup(head), F.regexp_replace(name, _LEGACY_HEAD, ""))),
        m)


def let(value: Column, use) -> Column:
    """Bind an expression to a variable, so that a formula using it several times computes it once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def unescape(c: Column) -> Column:
    """Decode HTML character references (full HTML5 table) without leaving the JVM.

    The text is cut at each reference; references are looked up and the pieces are glued back together.
    Rows without ``&`` skip all of it.
    """
    def decode(v: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(v, F.lit(_ENTITY), F.lit(0)), lambda m: _entity(m))
        glued = let(F.split(v, _ENTITY, -1), lambda pieces: F.concat(F.element_at(pieces, 1), F.array_join(
            F.zip_with(refs, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
                       lambda r, p: F.concat(F.coalesce(r, F.lit("")), F.coalesce(p, F.lit("")))), "")))
        return F.when(v.contains("&"), glued).otherwise(v)
    return let(c, decode)


def html_to_text(c: Column) -> Column:
    """Markup to text: block tags break lines, other tags become a space, blank runs shrink to one line."""
    def tidy(s: Column) -> Column:
        s = F.regexp_replace(s, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", "\n")   # other line ends
        s = F.regexp_replace(s, r"[\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+", " ")
        return strip(F.regexp_replace(F.regexp_replace(s, " *\n *", "\n"), "\n{3,}", "\n\n"))

    def untag(s: Column) -> Column:
        s = F.regexp_replace(s, rf"(?i)</?(?:{'|'.join(fv.BLOCK_TAGS)})[^>]*>", "\n")
        return tidy(unescape(F.regexp_replace(s, "<[^>]+>", " ")))

    once = let(unescape(c), lambda s: F.when(s.contains("&lt;") & ~s.contains("<"), unescape(s)).otherwise(s))
    return F.coalesce(untag(once), F.lit(""))


# ---- matches and their surroundings -------------------------------------------------------------

def match_windows(text: Column, rx: str, before: int, after: int) -> Column:
    """For every match, the substring from ``before`` characters ahead of it to ``after`` behind it.

    ``split`` and ``regexp_extract_all`` see the same matches, so running sums of piece lengths are match
    offsets; no UDF is needed. Rows without a match get an empty array cheaply.
    """
    pieces = F.split(text, rx, -1)
    found = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"))
    spans = F.aggregate(
        pairs, F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")),
        lambda st, x: F.struct(
            (st["pos"] + F.length(x["p"]) + F.length(x["m"])).alias("pos"),
            F.array_append(st["out"], _cut(text, st["pos"] + F.length(x["p"]), F.length(x["m"]), before, after)).alias("out")))
    return F.when(text.rlike(rx), spans["out"]).otherwise(F.array().cast("array<string>"))


def _cut(text: Column, start: Column, size: Column, before: int, after: int) -> Column:
    lo = F.greatest(start - before, F.lit(0))
    return F.substring(text, lo + 1, start + size + after - lo)


def windows_after(text: Column, rx: str, chars: int) -> Column:
    """The ``chars`` characters following every match (a capturing look-ahead, so matching never skips text).

    ``rx`` must contain no capture group.
    """
    return F.regexp_extract_all(text, F.lit(rf"{rx}(?=([\s\S]{{0,{chars}}}))"), F.lit(1))


def hints(text: Column, words) -> Column:
    """Cheap superset test: does the lower-cased text contain any of these substrings?"""
    low = F.lower(text)
    return functools.reduce(operator.or_, [low.contains(w) for w in words])


def _first_marker(text: Column) -> Column:
    """1-based place of the first boilerplate marker, 0 if none. Plain substring searches; the pattern itself runs
    only where lower-casing changed the length (places would shift)."""
    def search(low: Column) -> Column:
        at = [F.when(low.contains(p), F.instr(low, F.lit(p))) for p in fv.BOILERPLATE_PHRASES]
        at.append(F.when(low.contains("eeo"), F.nullif(F.regexp_instr(low, F.lit(r"eeo\b")), F.lit(0))))
        return F.when(F.length(low) != F.length(text), F.regexp_instr(text, F.lit(fv.BOILERPLATE))).otherwise(F.coalesce(F.least(*at), F.lit(0)))
    return let(F.lower(text), search)


def trim_boilerplate(text: Column) -> Column:
    """Cut at the first legal/benefit marker unless it sits near the top, then collapse blank lines."""
    cut = let(_first_marker(text), lambda at: F.when(at > fv.BOILERPLATE_MIN_START, F.substring(text, F.lit(1), at - 1)).otherwise(text))
    return strip(F.regexp_replace(cut, "\n{3,}", "\n\n"))


def compact_number(n: Column) -> Column:
    v = F.coalesce(n, F.lit(0)).cast("double")
    return (F.when(v >= 1_000_000, F.concat(F.format_string("%.1f", F.bround(v / 1_000_000, 1)), F.lit("M")))
            .when(v >= 10_000, F.concat(F.bround(v / 1000, 0).cast("bigint").cast("string"), F.lit("K")))
            .when(v >= 1000, F.concat(F.format_string("%.1f", F.bround(v / 1000, 1)), F.lit("K")))
            .otherwise(F.coalesce(n, F.lit(0)).cast("string")))
