"""Rules as data, compiled to Catalyst columns.

A predicate is a nested tuple, a field is a list of probes (patterns tried in order) with a cleaning
step. Rule tables are small and known at plan time, so each rule becomes a native expression and
a document is read once, without a join and without Python.

Patterns use only syntax that means the same in Java and in RE2. Word boundaries are written out
(start or a character that is no letter, digit or underscore), because engines disagree about \\b
next to accented letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

LEFT = r"(?:^|[^\p{L}\p{N}_])"
RIGHT = r"(?:[^\p{L}\p{N}_]|$)"


def word(body: str) -> str:
    """Body between word boundaries."""
    return f"{LEFT}(?:{body}){RIGHT}"


def word_group(body: str) -> str:
    """Body between word boundaries as group 1."""
    return f"{LEFT}({body}){RIGHT}"


def after(labels: str, body: str, stops: str = "", sep: str = r"[:\s]+") -> str:
    """Value after one of the labels (``|`` separated), up to one of the stops."""
    alts = "|".join(f"{x}{sep}" for x in labels.split("|"))
    return f"(?:{alts})({body})" + (f"(?:{stops})" if stops else "")


@dataclass(frozen=True)
class Probe:
    pattern: str
    ignore_case: bool = True
    multiline: bool = False
    dotall: bool = False
    group: int = 1

    def java(self) -> str:
        flags = ("iu" if self.ignore_case else "") + ("m" if self.multiline else "") + ("s" if self.dotall else "")
        return (f"(?{flags})" if flags else "") + self.pattern


@dataclass(frozen=True)
class Field:
    """Probes in order; a value counts when it is longer than ``min_len`` and passes the filters."""

    name: str
    probes: Sequence[Probe]
    min_len: int = 0
    max_words: int = 0
    stop_words: Sequence[str] = ()
    between: tuple[int, int] | None = None
    final: str = ""
    const: str = ""


@dataclass(frozen=True)
class Pack:
    code: str
    country: str
    detect: tuple
    fields: Sequence[Field]
    threshold: float
    weights: Sequence[tuple[float, str, str]] = field(default_factory=tuple)
    single_line: bool = False


def sql_str(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(items: Sequence[str]) -> str:
    return "array(" + ", ".join(sql_str(x) for x in items) + ")"


def words(items: Sequence[str]) -> Column:
    """Array literal of strings."""
    return F.expr(sql_array(items))


def literal_rows(rows: Sequence[Sequence[str]], names: Sequence[str]) -> Column:
    """Array literal of structs of strings."""
    one = lambda r: "named_struct(" + ", ".join(f"'{n}', {sql_str(v)}" for n, v in zip(names, r)) + ")"
    return F.expr("array(" + ", ".join(one(r) for r in rows) + ")")


# ---- predicates, as SQL text over a text and its lower-case form ----


def contains(lower: str, w: str) -> str:
    return f"contains({lower}, {sql_str(w)})"


def matches(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"rlike({text}, {sql_str(('(?iu)' if ignore_case else '') + pattern)})"


def lower_pattern(p: str) -> str:
    """Pattern for lower-case text: letters outside escapes in lower case."""
    return re.sub(r"(\\[pPx]\{[^}]*\}|\\.)|([^\\]+)", lambda m: m.group(1) or m.group(2).lower(), p)


def match_lower(lower: str, pattern: str) -> str:
    """Case-insensitive search as a plain search in lower-case text.

    Plain words are substring tests. A pattern that starts with a word is tried only where the word
    occurs: case-insensitive matching of whole texts is several times slower.
    """
    body = pattern[3:-1] if re.fullmatch(r"\(\?:[^()]*\)", pattern) else pattern
    if "|" in body and not re.search(r"[()\[\]]", body):
        return "(" + " OR ".join(match_lower(lower, alt) for alt in body.split("|")) + ")"
    q = lower_pattern(body)
    head = re.match(r"[^\\.\[\](){}|^$*+?]*", q).group(0)
    if head == q:
        return contains(lower, q)
    if q[len(head)] in "*+?{":
        head = head[:-1]
    return f"({contains(lower, head)} AND {matches(lower, q)})" if len(head) > 2 else match_number(lower, q)


def digit_run(pattern: str) -> int:
    """Digits in a row that every alternative of a pattern needs, 0 when some alternative needs none."""
    body = pattern.replace(LEFT, "").replace(RIGHT, "")
    runs = [max((int(n) for n in re.findall(r"\[0-9\]\{(\d+)", alt)), default=0) for alt in body.split("|")]
    return min(runs)


def match_number(text: str, pattern: str) -> str:
    """Search for a number shape; the scan with word boundaries runs only where enough digits follow each other."""
    n = digit_run(pattern)
    found = matches(text, pattern)
    return f"({matches(text, f'[0-9]{{{n}}}')} AND {found})" if n > 2 else found


def match_any(lower: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(match_lower(lower, p) for p in patterns) + ")"


def hits(items: Sequence[str], lower: str) -> str:
    """How many of the words occur."""
    return "(" + " + ".join(f"int({contains(lower, w)})" for w in items) + ")"


def any_of(items: Sequence[str], lower: str) -> str:
    return "(" + " OR ".join(contains(lower, w) for w in items) + ")"


def cost(p: tuple) -> int:
    """About how many word searches a predicate takes: a pattern is several, and one more per alternative."""
    kind = p[0]
    if kind in ("any", "count"):
        return len(p[1])
    if kind in ("rx", "rxi"):
        return 4 + p[1].count("|")
    return sum(cost(q) for q in p[1:])


def predicate(p: tuple, text: str, lower: str) -> str:
    """("any", words), ("count", words, n), ("rx", pattern), ("rxi", pattern), ("and"|"or", ...).

    The cheapest part is tested first: most texts fail it, and lists of all countries or states are then not read.
    """
    kind = p[0]
    if kind == "any":
        return any_of(p[1], lower)
    if kind == "count":
        return f"({hits(p[1], lower)} >= {p[2]})"
    if kind == "rx":
        return match_number(text, p[1])
    if kind == "rxi":
        return match_lower(lower, p[1])
    return "(" + (" AND " if kind == "and" else " OR ").join(predicate(q, text, lower) for q in sorted(p[1:], key=cost)) + ")"


def criteria(p: tuple, text: str, lower: str) -> str:
    """Number of matched criteria of a predicate: one per word or pattern."""
    kind = p[0]
    if kind in ("any", "count"):
        return hits(p[1], lower)
    if kind in ("rx", "rxi"):
        return f"int({predicate(p, text, lower)})"
    return "(" + " + ".join(criteria(q, text, lower) for q in p[1:]) + ")"


def let_sql(value: str, name: str, body: str) -> str:
    """SQL text that binds a value to a name once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it several times in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- fields ----


def strip_sql(v: str) -> str:
    return f"regexp_replace({v}, {sql_str(WHITE_ENDS)}, '')"


WHITE_ENDS = r"^\s+|\s+$"


def raw_value(f: Field, text: str) -> str:
    """SQL text of the first probe whose stripped value passes the filters of the field."""
    if f.const:
        hit = " OR ".join(f"rlike({text}, {sql_str(p.java())})" for p in f.probes)
        return f"CASE WHEN {hit} THEN {sql_str(f.const)} END"
    ok = f"length(x) > {f.min_len}"
    if f.stop_words:
        ok += f" AND NOT {any_of(f.stop_words, 'lower(x)')}"
    if f.max_words:
        ok += f" AND size(split(x, {sql_str(chr(92) + 's+')})) <= {f.max_words}"
    if f.between:
        n = "int(nullif(regexp_extract(x, '^[0-9]{1,9}$', 0), ''))"
        ok += f" AND {n} BETWEEN {f.between[0]} AND {f.between[1]}"
    probe = lambda p: strip_sql(f"regexp_extract({text}, {sql_str(p.java())}, {p.group})")
    return "coalesce(" + ", ".join(let_sql(probe(p), "x", f"CASE WHEN {ok} THEN x END") for p in f.probes) + ")"


def strip(c: Column) -> Column:
    """Trim all white space at both ends."""
    return F.regexp_replace(c, WHITE_ENDS, "")


# Spellings of the two sexes.
MALE = ["M", "MALE", "पुरुष", "MASCULIN", "MÄNNLICH", "男", "ذكر"]
FEMALE = ["F", "FEMALE", "महिला", "FÉMININ", "WEIBLICH", "W", "女", "أنثى"]


def final_value(kind: str, v: Column) -> Column:
    """Normal form of a found value."""
    if kind == "upper":
        return F.upper(v)
    if kind in ("sex", "gender"):
        m, f = ("M", "F") if kind == "sex" else ("Male", "Female")
        return let(F.upper(v), lambda x: F.when(x.isin(MALE), m).when(x.isin(FEMALE), f))
    if kind == "spaces":
        return F.regexp_replace(v, r"\s+", " ")
    if kind == "plain_number":
        return F.regexp_replace(v, r"[-\s]", "")
    if kind == "alien":
        return let(v, lambda x: F.when(F.upper(x).startswith("A"), x).otherwise(F.concat(F.lit("A"), x)))
    if kind == "emirates":
        return F.regexp_replace(v, r"^784[-\s]?([0-9]{4})[-\s]?([0-9]{7})[-\s]?([0-9])$", "784-$1-$2-$3")
    if kind == "dmy":
        return let(v, lambda x: slash_date(x, False))
    if kind == "mdy":
        return let(v, lambda x: slash_date(x, True))
    if kind == "era":
        from scanmill.functions.dates import japanese_era_date

        return japanese_era_date(v)
    if kind == "named_dmy":
        from scanmill.functions.dates import named_dmy

        return let(v, named_dmy)
    return v


def slash_date(v: Column, month_first: bool) -> Column:
    """Two-digit day and month in the given order when the parts are in range, else the value unchanged."""
    rx = r"^([0-9]{1,2})[./\s-]+([0-9]{1,2})[./\s-]+([0-9]{4})$"
    a, b, y = (F.regexp_extract(v, rx, i) for i in (1, 2, 3))
    d, m = (b, a) if month_first else (a, b)
    num = lambda c: F.nullif(c, F.lit("")).cast("int")
    valid = v.rlike(rx) & num(d).between(1, 31) & num(m).between(1, 12) & num(y).between(1900, 2100)
    return F.when(valid, F.concat_ws("/", F.lpad(a, 2, "0"), F.lpad(b, 2, "0"), y)).otherwise(v)


FINALS = ("upper", "sex", "gender", "spaces", "plain_number", "alien", "emirates", "dmy", "mdy", "era", "named_dmy")


def extract(f: Field, text: str) -> Column:
    """Value of one field from a text column, in its normal form."""
    v = F.expr(raw_value(f, text))
    return final_value(f.final, v) if f.final else v
