"""SQL fragments for the checking statements (RE2 syntax: no look-around, so boundaries are spelled out)."""
from __future__ import annotations

import re

from siftwork.config import DEFAULT as S
from siftwork.functions import fixed_values as fv
from siftwork.functions.terms import alt_pairs, primary_pairs

AS_OF = f"TIMESTAMP '{S.as_of}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rm(x: str, rx: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {q(rx)}{', ' + q(flags) if flags else ''})"


def sub(x: str, rx: str, to: str = " ", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(rx)}, {q(to)}, {q(flags)})"


def has_any(x: str, needles) -> str:
    return "(" + (" OR ".join(f"contains(lower({x}), {q(n.lower())})" for n in needles) or "false") + ")"


def slug(x: str) -> str:
    s = sub(f"lower({x})", r"[\(\[].*?[\)\]]")
    s = sub(s, rf"\b(?:{'|'.join(fv.COMPANY_SUFFIXES)})\b\.?")
    s = f"trim({sub(s, '[^a-z0-9]+', '-')}, '-')"
    return f"CASE WHEN {s} = '' THEN 'unknown' ELSE {s} END"


def title(x: str) -> str:
    t = sub(f"lower({x})", r"[\(\[].*?[\)\]]")
    t = sub(t, rf"\b(?:{'|'.join(fv.TITLE_NOISE)})\b", " ", "gi")
    t = f"trim({sub(t, '[^a-z0-9]+')})"
    for s in ("ing", "er", "s"):
        t = sub(t, rf"\b([a-z0-9]{{4,}}){s}\b", r"\1")
    return t


def place(x: str) -> str:
    c = f"regexp_extract(lower(coalesce({x}, '')), '^(.*?)(?:[;|/]|\\band\\b|\\bor\\b|$)', 1)"
    c = f"split_part({c}, ',', 1)"
    c = sub(c, rf"\b(?:{'|'.join(fv.PLACE_NOISE)})\b")
    c = f"trim({sub(c, '[^a-z0-9]+')})"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.PLACE_ALIASES.items())
    return f"(CASE {c} {whens} ELSE {c} END)"


def dedup_key(company: str, t: str, loc: str) -> str:
    return f"sha1(concat_ws('|', {slug(company)}, {title(t)}, {place(loc)}))"


def squeeze(x: str) -> str:
    return f"trim({sub(x, fv.WS + '+', ' ')})"


def strip(x: str) -> str:
    return sub(x, rf"^{fv.WS}+|{fv.WS}+$", "")


def trim_boilerplate(x: str) -> str:
    head = f"regexp_extract({x}, {q('^([\\s\\S]*?)' + fv.BOILERPLATE[4:])}, 1, 'i')"
    cut = f"CASE WHEN {rm(x, fv.BOILERPLATE)} AND length({head}) >= {fv.BOILERPLATE_MIN_START} THEN {head} ELSE {x} END"
    return strip(sub(cut, r"\n{3,}", "\n\n"))


def canonical_url(x: str) -> str:
    u = f"(CASE WHEN contains(trim({x}), '://') THEN trim({x}) ELSE 'https://' || trim({x}) END)"
    rx = r"^[^:/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    host = sub(f"lower(regexp_extract({u}, {q(rx)}, 1))", r"^www\.", "", "")
    path = f"coalesce(nullif({sub(f'regexp_extract({u}, {q(rx)}, 2)', '/+$', '', '')}, ''), '/')"
    drop = ", ".join(q(p) for p in fv.TRACKING_PARAMS)
    kept = (f"list_sort(list_filter(string_split(regexp_extract({u}, {q(rx)}, 3), '&'), lambda p: regexp_matches(p, '^[^=]*=.') "
            f"AND lower(split_part(p, '=', 1)) NOT IN ({drop}) AND NOT starts_with(lower(p), 'utm_')))")
    tail = f"CASE WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END"
    return f"'https://' || {host} || {path} || {tail}"


# ---- keyword hits: doubling every separator lets neighbouring keywords each consume their own boundary ----

def doubled(x: str) -> str:
    return f"regexp_replace(lower({x}), '([^a-z0-9])', '\\1\\1', 'g')"


def _dbl(w: str) -> str:
    return "".join(re.escape(c) * (1 if c.isalnum() else 2) for c in w.lower())


def hits_list(x: str, words, longest_first=True) -> str:
    """List of distinct keywords found, still with doubled separators."""
    words = [w for w in words if w[-1:].isalnum()]
    order = sorted(words, key=len, reverse=True) if longest_first else list(words)
    rx = rf"(?:^|[^a-z0-9])({'|'.join(_dbl(w) for w in order)})(?:[^a-z0-9]|$)"
    return f"list_distinct(regexp_extract_all({doubled(x)}, {q(rx)}, 1))"


def hits(x: str, words) -> str:
    return f"len({hits_list(x, words)})"


def single(lst: str) -> str:
    return f"list_transform({lst}, lambda h: regexp_replace(h, '([^a-z0-9])[^a-z0-9]', '\\1', 'g'))"


def any_word(x: str, words) -> str:
    rx = "|".join(("(?:^|[^a-z0-9])" if w[:1].isalnum() else "") + re.escape(w.lower())
                  + ("(?:[^a-z0-9]|$)" if w[-1:].isalnum() else "") for w in words)
    return f"regexp_matches(lower({x}), {q(rx)})"


def classify(t: str, company: str | None = None, tags: str | None = None, summary: str | None = None) -> str:
    types = [r for r in S.types if r.keywords]
    best = "list_sort([" + ", ".join(f"(-({hits(t, r.keywords)}), {i}, {q(r.key)})" for i, r in enumerate(types)) + "])[1]"
    decisive = " ".join(f"WHEN {hits(t, r.keywords)} > 0 THEN {q(r.key)}" for r in types if r.decisive)
    firm = f"WHEN {hits(company, fv.TRADING_FIRMS)} > 0 THEN 'quant'" if company else ""
    out = f"CASE {decisive} {firm} WHEN ({best})[1] < 0 THEN ({best})[3]"
    if tags or summary:
        fall = "list_sort([" + ", ".join(
            f"(-({(hits(tags, r.keywords) + ' * 2') if tags else '0'} + {hits(summary, r.keywords) if summary else '0'}), {i}, {q(r.key)})"
            for i, r in enumerate(types)) + "])[1]"
        out += f" WHEN ({fall})[1] <= -2 THEN ({fall})[3]"
    return out + " ELSE 'general' END"


# ---- terms -------------------------------------------------------------------------------------

def _season(x: str) -> str:
    return f"replace(lower({x}), 'autumn', 'fall')"


def claimed(t: str, terms: str) -> str:
    """List of 'season:year' strings, NULL when nothing is claimed."""
    sy = r"(?i)\b(spring|summer|fall|autumn|winter)\s*(?:of\s*)?(20\d\d)\b"
    parsed = (f"list_filter(list_transform(string_split({terms}, '|'), lambda x: CASE WHEN regexp_matches(x, {q(sy)}) "
              f"THEN {_season(f'regexp_extract(x, {q(sy)}, 1)')} || ':' || regexp_extract(x, {q(sy)}, 2) "
              f"ELSE ':' || regexp_extract(x, '\\b(20\\d\\d)\\b', 1) END), lambda p: NOT ends_with(p, ':'))")
    years = f"list_distinct(regexp_extract_all({t}, '\\b(20\\d\\d)\\b', 1))"
    seasons = f"list_distinct(list_transform(regexp_extract_all({t}, '(?i)\\b(spring|summer|fall|autumn|winter)\\b', 1), lambda z: {_season('z')}))"
    seasons = f"CASE WHEN len({seasons}) = 0 THEN [''] ELSE {seasons} END"
    cross = f"flatten(list_transform({years}, lambda y: list_transform({seasons}, lambda z: z || ':' || y)))"
    return f"CASE WHEN len({parsed}) > 0 THEN {parsed} WHEN len({years}) > 0 THEN {cross} END"


def matches(c: str, pairs) -> str:
    ok = ", ".join(q(x) for s, y in pairs for x in ([f"{s}:{y}", f":{y}"] if s else [f"{z}:{y}" for z in ("", "spring", "summer", "fall", "winter")]))
    return f"coalesce(len(list_filter({c}, lambda p: p IN ({ok}))) > 0, false)"


def mismatch(t: str, terms: str) -> str:
    c = claimed(t, terms)
    return f"(({c}) IS NOT NULL AND NOT {matches(f'({c})', primary_pairs(S) + alt_pairs(S))})"


def track(t: str, terms: str) -> str:
    c = f"({claimed(t, terms)})"
    a, b = matches(c, primary_pairs(S)), matches(c, alt_pairs(S))
    return f"CASE WHEN {a} AND NOT {b} THEN 'primary' WHEN {b} AND NOT {a} THEN 'alt' ELSE 'unknown' END"


# ---- rules -------------------------------------------------------------------------------------

def title_excluded(t: str) -> str:
    return rm(t, rf"(?i)\b(?:{'|'.join(re.escape(w) for w in S.title_exclude)})")


def firmware(t: str, d: str) -> str:
    body = f"({t} || chr(10) || coalesce({d}, ''))"
    sigs = " + ".join(f"CAST({rm(body, '(?i)' + rx)} AS INT)" for rx in fv.FIRMWARE_SIGNALS)
    gate = rm(t, rf"(?i)\b(?:{'|'.join(fv.FIRMWARE_TITLE_GATE)})\b")
    return f"({rm(t, '(?i)\\bfirmware\\b')} OR ({gate} AND ({sigs}) >= 3))"


def place_blocked(loc: str) -> str:
    return f"(coalesce({loc}, '') <> '' AND NOT {has_any(loc, S.locations)} AND NOT {rm(loc, '(?i)\\bremote\\b')})"


def unpaid(body: str) -> str:
    """Benefit phrases are blanked first (no look-ahead here); then a pay word within 60 characters either side."""
    clean = sub(body, r"(?i)\b(?:unpaid|non-?paid|no (?:pay|compensation|salary|stipend))\s*(?:time off|leave|pto|vacation|absence|days?|hours?)", "####")
    ctx = r"\b(?:salary|compensation|pay|stipend|position|internship|role|opportunity|this is)\b"
    hit = r"\b(?:unpaid|non-?paid|no (?:pay|compensation|salary|stipend))\b"
    near = rm(clean, rf"(?i){ctx}[\s\S]{{0,53}}{hit}|{hit}[\s\S]{{0,53}}{ctx}|\bno (?:pay|compensation|salary|stipend)\b")
    return f"({near} OR {has_any(body, [n for n in S.unpaid if n != 'unpaid'])})"


def haystack(t: str, loc: str, d: str) -> str:
    return f"concat_ws(chr(10), nullif({t}, ''), nullif({loc}, ''), nullif({d}, ''))"


def _levels(x: str) -> dict[str, str]:
    out = {"associate": [], "bachelor": [], "master": [], "phd": []}
    for level, rx in fv.DEGREE_PATTERNS:
        rx = rx.replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])").replace("(?![A-Za-z])", "(?:[^A-Za-z]|$)")
        out[level].append(rm(x, rx))
    grad = rm(x, r"(?i)\bgraduate\s+(?:student|degree|level\s+(?:student|coursework))|\bgraduate\s+program\b")
    out["master"].append(f"({grad} AND NOT {rm(x, fv.GRAD_FALSE_FRIENDS)})")
    out["bachelor"].append(rm(x, fv.UNDERGRAD_YEARS))
    return {k: "(" + " OR ".join(v) + ")" for k, v in out.items()}


def level_names(x: str) -> str:
    lv = _levels(x)
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {lv[n]} THEN '{n}' END" for n in ("associate", "bachelor", "master", "phd")) + ")"


def clauses_cte(src: str, key: str, text: str) -> str:
    """CTEs ending in ``req(key, clause, lv)``: requirement clauses with the levels they name."""
    rx = "(?:[.;:!?\\n\\r•|]|\\s[-–—*]\\s)+"
    return f"""
parts AS (SELECT {key}, unnest(string_split(regexp_replace({text}, {q(rx)}, chr(1), 'g'), chr(1))) AS p0,
  generate_subscripts(string_split(regexp_replace({text}, {q(rx)}, chr(1), 'g'), chr(1)), 1) AS n FROM {src}),
named AS (SELECT {key}, n, {strip('p0')} AS clause FROM parts),
lvl AS (SELECT *, {level_names('clause')} AS lv FROM named WHERE clause <> ''),
heads AS (SELECT *, CASE WHEN length(clause) <= 60 AND lv = '' THEN CASE WHEN {rm('clause', fv.PREFERRED_HEADING)} THEN 1
  WHEN {rm('clause', fv.REQUIRED_HEADING)} THEN 0 END END AS flag FROM lvl),
filled AS (SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY n), 0) AS off FROM heads),
req AS (SELECT {key}, n, clause, lv FROM filled WHERE off = 0 AND length(clause) <= 400 AND {rm('clause', fv.REQUIREMENT_WORDS)}
  AND NOT {rm('clause', fv.OPTIONAL_WORDS)} AND NOT {rm('clause', fv.PAY_WORDS)})"""


# the whole cascade as CTEs ending in ``judged(job_id, reason)`` over a relation with posting columns
def cascade_cte(src: str) -> str:
    b = haystack("title", "location", "description_text")
    return clauses_cte(f"(SELECT job_id, description_text FROM {src} WHERE description_text IS NOT NULL)", "job_id", "description_text") + f""",
want AS (SELECT job_id, min(CASE WHEN contains(lv, 'associate') THEN 1 WHEN contains(lv, 'bachelor') THEN 2
   WHEN contains(lv, 'master') THEN 3 WHEN contains(lv, 'phd') THEN 4 END) AS low FROM req WHERE lv <> '' GROUP BY job_id),
own AS (SELECT job_id, {level_names('title')} AS lv FROM {src}),
low AS (SELECT own.job_id, CASE WHEN own.lv <> '' THEN CASE WHEN contains(own.lv, 'associate') THEN 1 WHEN contains(own.lv, 'bachelor') THEN 2
   WHEN contains(own.lv, 'master') THEN 3 ELSE 4 END ELSE want.low END AS low FROM own LEFT JOIN want USING (job_id)),
judged AS (SELECT s.job_id, CASE WHEN {mismatch('title', 'terms_txt')} THEN 'term_mismatch'
  WHEN coalesce({has_any('sponsorship', S.sponsorship_values)}, false) THEN 'citizenship'
  WHEN {title_excluded('title')} THEN 'out_of_scope' WHEN {firmware('title', 'description_text')} THEN 'firmware_heavy'
  WHEN {place_blocked('location')} THEN 'location_not_allowed'
  WHEN {has_any("coalesce(location, '')", S.location_exclude)} OR {has_any('title', S.location_exclude)} THEN 'location_excluded'
  WHEN {unpaid(b)} THEN 'unpaid' WHEN {has_any(b, S.clearance)} THEN 'clearance' WHEN {has_any(b, S.citizenship)} THEN 'citizenship'
  WHEN low.low = 3 THEN 'master-only' WHEN low.low = 4 THEN 'phd-only' END AS reason
  FROM {src} s JOIN low ON low.job_id = s.job_id)"""


# ---- local score: CTE ``scored(job_id, role, score, band, why, unread, off)`` ---------------------

def score_cte(src: str, name: str = "scored") -> str:
    """``src`` has job_id, title, company_name, description_text."""
    weights = {p.key: p.weight for p in S.role_types} | {k: S.excluded_weight for k in S.excluded_role_types}
    w = "CASE role " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in weights.items()) + f" ELSE {S.neutral_weight} END"
    soft = S.software_keywords
    cpp = lambda x: f"CAST(regexp_matches(lower({x}), '(?:^|[^a-z0-9])c\\+\\+') AS INT)"
    neg = sorted(S.negative_words, key=len, reverse=True)
    neg_rx = "|".join(_dbl(x) for x in S.negative_words)
    del neg
    off = rf"regexp_extract({doubled('title')}, {q(rf'(?:^|[^a-z0-9])({neg_rx})(?:[^a-z0-9]|$)')}, 1)"
    return f"""
{name}_a AS (SELECT job_id, title, company_name, description_text IS NULL AS unread,
    substr({trim_boilerplate("coalesce(description_text, '')")}, 1, {S.desc_chars}) AS head, {slug('company_name')} AS slug FROM {src}),
{name}_b AS (SELECT a.*, {classify('title', 'company_name')} AS role,
    {single(hits_list('title', S.picked_keywords, False))} AS th, {single(hits_list('head', S.picked_keywords, False))} AS dh0,
    {hits('head', soft)} + {cpp('head')} AS sh, {any_word('title', soft)} AS st,
    regexp_replace({off}, '([^a-z0-9])[^a-z0-9]', '\\1', 'g') AS off,
    coalesce(c.reputation, CASE c.tier WHEN 1 THEN 90 WHEN 2 THEN 70 WHEN 3 THEN 55 END) AS rep
  FROM {name}_a a LEFT JOIN company_dim c ON c.slug = a.slug),
{name}_c AS (SELECT *, list_sort(list_filter(dh0, lambda h: NOT list_contains(th, h))) AS dh FROM {name}_b),
{name}_d AS (SELECT *, CAST(greatest(0, least(100, round_even({w} + least({S.title_domain_cap}, {S.title_domain_points} * len(th))
    + CASE WHEN st THEN {S.software_title_bonus} ELSE 0 END
    + CASE WHEN unread THEN 0 ELSE least({S.desc_domain_cap}, {S.desc_domain_points} * len(dh)) + least({S.software_desc_cap}, {S.software_desc_points} * sh) END
    + coalesce((rep - 50) * CAST(0.3 AS DOUBLE), 0) - CASE WHEN off <> '' THEN {S.negative_title_penalty} ELSE 0 END, 0))) AS INT) AS score FROM {name}_c),
{name} AS (SELECT job_id, role, score, unread, off, rep,
    CASE WHEN score >= {S.hi} THEN 'yes' WHEN score <= {S.lo} AND unread AND off = '' THEN 'ambiguous' WHEN score <= {S.lo} THEN 'no' ELSE 'ambiguous' END AS band,
    array_to_string((list_sort(th)[:2] || CASE WHEN st THEN ['software title'] ELSE [] END
      || CASE WHEN unread THEN [] ELSE dh[:CASE WHEN len(th) > 0 THEN 1 ELSE 2 END] END
      || CASE WHEN rep >= 70 THEN ['known company'] ELSE [] END
      || CASE WHEN off <> '' THEN ['off-target: ' || off] ELSE [] END)[:6], '|') AS why FROM {name}_d)"""
