"""Rules written as SQL text for the comparison engine (RE2 patterns, list functions)."""

from __future__ import annotations

from collections.abc import Sequence

from scanmill.functions.rules import FEMALE, MALE, Field, Pack, Probe
from scanmill.sources.identity import quote


def contains(lower: str, w: str) -> str:
    return f"contains({lower}, {quote(w)})"


def rx(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {quote(('(?i)' if ignore_case else '') + pattern)})"


def count_hits(words: Sequence[str], lower: str) -> str:
    return "(" + " + ".join(f"CAST({contains(lower, w)} AS INTEGER)" for w in words) + ")"


def predicate(p: tuple, text: str = "text", lower: str = "low") -> str:
    kind = p[0]
    if kind == "any":
        return "(" + " OR ".join(contains(lower, w) for w in p[1]) + ")"
    if kind == "count":
        return f"({count_hits(p[1], lower)} >= {p[2]})"
    if kind in ("rx", "rxi"):
        return rx(text, p[1], kind == "rxi")
    return "(" + (" AND " if kind == "and" else " OR ").join(predicate(q, text, lower) for q in p[1:]) + ")"


def criteria(p: tuple, text: str = "text", lower: str = "low") -> str:
    kind = p[0]
    if kind in ("any", "count"):
        return count_hits(p[1], lower)
    if kind in ("rx", "rxi"):
        return f"CAST({predicate(p, text, lower)} AS INTEGER)"
    return "(" + " + ".join(criteria(q, text, lower) for q in p[1:]) + ")"


def probe_pattern(p: Probe) -> str:
    flags = ("i" if p.ignore_case else "") + ("m" if p.multiline else "") + ("s" if p.dotall else "")
    return (f"(?{flags})" if flags else "") + p.pattern


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _valid(d: str, m: str, y: str) -> str:
    return f"TRY_CAST({d} AS INTEGER) BETWEEN 1 AND 31 AND TRY_CAST({m} AS INTEGER) BETWEEN 1 AND 12 AND TRY_CAST({y} AS INTEGER) BETWEEN 1900 AND 2100"


def strict_date(v: str) -> str:
    from scanmill.functions.dates import MONTHS, STRICT

    t = f"regexp_replace({strip(v)}, '\\s+', ' ', 'g')"
    named = "CASE " + " ".join(f"WHEN contains(upper({t}), '{m}') THEN replace(upper({t}), '{m}', '{n}')" for m, n in MONTHS) + f" ELSE {t} END"
    tries = []
    for pat, year_first in STRICT:
        a, b, c = (f"regexp_extract(nd, {quote(pat)}, {i})" for i in (1, 2, 3))
        d, m, y = (c, b, a) if year_first else (a, b, c)
        tries.append(f"WHEN {_valid(d, m, y)} THEN lpad({d}, 2, '0') || '/' || lpad({m}, 2, '0') || '/' || {y}")
    # A list function binds the replaced text once.
    return f"CASE WHEN {v} <> '' THEN list_transform([{named}], lambda nd: CASE {' '.join(tries)} ELSE nd END)[1] END"


def mrz_date(v: str) -> str:
    yy = f"TRY_CAST(substr({v}, 1, 2) AS INTEGER)"
    return (
        f"CASE WHEN regexp_matches({v}, '^[0-9]{{6}}$') THEN substr({v}, 5, 2) || '/' || substr({v}, 3, 2) || '/' || "
        f"CAST(CASE WHEN {yy} <= 30 THEN {yy} + 2000 ELSE {yy} + 1900 END AS VARCHAR) ELSE {v} END"
    )


def era_date(v: str) -> str:
    from scanmill.functions.dates import ERA, KANJI, WESTERN, WESTERN_YEAR_FIRST

    g = lambda p, i: f"regexp_extract({v}, {quote(p)}, {i})"
    pad = lambda p, i: f"lpad({g(p, i)}, 2, '0')"
    year = f"CAST(CAST({g(ERA, 2)} AS INTEGER) + CASE WHEN lower({g(ERA, 1)}) = 'h' THEN 1988 ELSE 2018 END AS VARCHAR)"
    return (
        f"CASE WHEN {rx(v, ERA)} THEN {pad(ERA, 4)} || '/' || {pad(ERA, 3)} || '/' || {year}"
        f" WHEN {rx(v, KANJI)} THEN {pad(KANJI, 3)} || '/' || {pad(KANJI, 2)} || '/' || {g(KANJI, 1)}"
        f" WHEN {rx(v, WESTERN)} THEN {pad(WESTERN, 1)} || '/' || {pad(WESTERN, 2)} || '/' || {g(WESTERN, 3)}"
        f" WHEN {rx(v, WESTERN_YEAR_FIRST)} THEN {pad(WESTERN_YEAR_FIRST, 3)} || '/' || {pad(WESTERN_YEAR_FIRST, 2)} || '/' || {g(WESTERN_YEAR_FIRST, 1)}"
        f" ELSE {v} END"
    )


def final_value(kind: str, v: str) -> str:
    sexes = lambda m, f: (
        f"CASE WHEN upper({v}) IN ({', '.join(map(quote, MALE))}) THEN '{m}' WHEN upper({v}) IN ({', '.join(map(quote, FEMALE))}) THEN '{f}' END"
    )
    if kind == "upper":
        return f"upper({v})"
    if kind == "sex":
        return sexes("M", "F")
    if kind == "gender":
        return sexes("Male", "Female")
    if kind == "spaces":
        return f"regexp_replace({v}, '\\s+', ' ', 'g')"
    if kind == "plain_number":
        return f"regexp_replace({v}, '[-\\s]', '', 'g')"
    if kind == "alien":
        return f"CASE WHEN starts_with(upper({v}), 'A') THEN {v} ELSE 'A' || {v} END"
    if kind == "emirates":
        return f"regexp_replace({v}, '^784[-\\s]?([0-9]{{4}})[-\\s]?([0-9]{{7}})[-\\s]?([0-9])$', '784-\\1-\\2-\\3')"
    if kind in ("dmy", "mdy"):
        pat = r"^([0-9]{1,2})[./\s-]+([0-9]{1,2})[./\s-]+([0-9]{4})$"
        a, b, y = (f"regexp_extract({v}, {quote(pat)}, {i})" for i in (1, 2, 3))
        d, m = (b, a) if kind == "mdy" else (a, b)
        return f"CASE WHEN {rx(v, pat)} AND {_valid(d, m, y)} THEN lpad({a}, 2, '0') || '/' || lpad({b}, 2, '0') || '/' || {y} ELSE {v} END"
    if kind == "era":
        return era_date(v)
    if kind == "named_dmy":
        return f"CASE WHEN regexp_matches({v}, '^[0-9]{{6}}$') THEN {mrz_date(v)} ELSE {strict_date(v)} END"
    return v


def field_value(f: Field, text: str) -> str:
    if f.const:
        return "CASE WHEN " + " OR ".join(rx(text, probe_pattern(p)) for p in f.probes) + f" THEN {quote(f.const)} END"
    vals = ", ".join(strip(f"regexp_extract({text}, {quote(probe_pattern(p))}, {p.group})") for p in f.probes)
    cond = f"length(x) > {f.min_len}"
    if f.stop_words:
        cond += "".join(f" AND NOT contains(lower(x), {quote(w)})" for w in f.stop_words)
    if f.max_words:
        cond += f" AND len(regexp_split_to_array(x, '\\s+')) <= {f.max_words}"
    if f.between:
        cond += f" AND TRY_CAST(x AS INTEGER) BETWEEN {f.between[0]} AND {f.between[1]}"
    first = f"list_filter([{vals}], lambda x: {cond})[1]"
    return f"list_transform([{first}], lambda v: {final_value(f.final, 'v')})[1]" if f.final else first


def pack_text(p: Pack) -> str:
    return "replace(text, chr(10), ' ')" if p.single_line else "text"
