"""Date normalisation as column expressions. Results are DD/MM/YYYY strings, the display form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanmill.functions.rules import let, literal_rows

# Month names and numbers, long names first.
MONTHS = [
    ("JANUARY", "01"), ("JAN", "01"), ("FEBRUARY", "02"), ("FEB", "02"), ("MARCH", "03"), ("MAR", "03"),
    ("APRIL", "04"), ("APR", "04"), ("MAY", "05"), ("JUNE", "06"), ("JUN", "06"), ("JULY", "07"), ("JUL", "07"),
    ("AUGUST", "08"), ("AUG", "08"), ("SEPTEMBER", "09"), ("SEP", "09"), ("OCTOBER", "10"), ("OCT", "10"),
    ("NOVEMBER", "11"), ("NOV", "11"), ("DECEMBER", "12"), ("DEC", "12"),
]
# Two-digit years below the pivot belong to this century.
DISPLAY_PIVOT = 50
MRZ_PIVOT = 31


def _month_number(name: Column) -> Column:
    short = {m: n for m, n in MONTHS if len(m) == 3}
    table = F.expr("map(" + ", ".join(f"'{m}', '{n}'" for m, n in short.items()) + ")")
    return F.element_at(table, F.upper(F.substring(name, 1, 3)))


def number(digits: Column) -> Column:
    """Whole number of a matched digit group; no match gives null (a failing try_cast costs an exception)."""
    return F.nullif(digits, F.lit("")).cast("int")


def _pad(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def _year(y: Column, pivot: int, exact_two: bool = False) -> Column:
    n = number(y)
    full = F.when(n < pivot, n + 2000).otherwise(n + 1900).cast("string")
    return F.when(F.length(y) == 2, full).otherwise(y) if exact_two else F.when(F.length(y) == 4, y).otherwise(full)


def clean_date_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s./-]", ""), r"^\s+|\s+$", "")


# Accepted layouts.
NUMERIC = r"^([0-9]{1,2})[\s./-]([0-9]{1,2})[\s./-]([0-9]{2,4})$"
DAY_NAME = r"^([0-9]{1,2})[\s-]([A-Za-z]{3,9})[\s-]([0-9]{2,4})$"
NAME_DAY = r"^([A-Za-z]{3,9})[\s-]([0-9]{1,2})[\s-]([0-9]{2,4})$"
YEAR_FIRST = r"^([0-9]{4})[\s./-]([0-9]{1,2})[\s./-]([0-9]{1,2})$"
SIX = r"^([0-9]{2})([0-9]{2})([0-9]{2})$"
EIGHT = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"


def normalize_date(c: Column, month_first: bool = False) -> Column:
    """Layout by layout; text in none of them comes back cleaned, an unknown month name gives null."""
    return F.when(F.length(c) > 0, let(clean_date_text(c), lambda t: _layouts(t, month_first)))


def _layouts(t: Column, month_first: bool) -> Column:
    g = lambda rx, i: F.regexp_extract(t, rx, i)
    d, m = (2, 1) if month_first else (1, 2)
    return (
        F.when(t.rlike(NUMERIC), F.concat_ws("/", _pad(g(NUMERIC, d)), _pad(g(NUMERIC, m)), _year(g(NUMERIC, 3), DISPLAY_PIVOT)))
        .when(t.rlike(DAY_NAME), F.concat(_pad(g(DAY_NAME, 1)), F.lit("/"), _month_number(g(DAY_NAME, 2)), F.lit("/"), _year(g(DAY_NAME, 3), DISPLAY_PIVOT, True)))
        .when(t.rlike(NAME_DAY), F.concat(_pad(g(NAME_DAY, 2)), F.lit("/"), _month_number(g(NAME_DAY, 1)), F.lit("/"), _year(g(NAME_DAY, 3), DISPLAY_PIVOT, True)))
        .when(t.rlike(YEAR_FIRST), F.concat_ws("/", _pad(g(YEAR_FIRST, 3)), _pad(g(YEAR_FIRST, 2)), g(YEAR_FIRST, 1)))
        .when(t.rlike(SIX), F.concat_ws("/", g(SIX, 3), g(SIX, 2), _year(g(SIX, 1), DISPLAY_PIVOT)))
        .when(t.rlike(EIGHT), F.concat_ws("/", g(EIGHT, 3), g(EIGHT, 2), g(EIGHT, 1)))
        .otherwise(t)
    )


def mrz_date(c: Column) -> Column:
    """YYMMDD of a machine readable zone; years up to 30 belong to this century."""
    return F.when(c.rlike(r"^[0-9]{6}$"), F.concat_ws("/", F.substring(c, 5, 2), F.substring(c, 3, 2), _year(F.substring(c, 1, 2), MRZ_PIVOT))).otherwise(c)


# Strict layouts as (pattern, year first).
STRICT = [
    (r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})", False),
    (r"([0-9]{1,2})[.\s]([0-9]{1,2})[.\s]([0-9]{4})", False),
    (r"([0-9]{1,2})\s+([0-9]{1,2})\s+([0-9]{4})", False),
    (r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})", True),
]


def normalize_date_strict(c: Column) -> Column:
    """Month names become numbers; the first layout whose parts are in range gives the date."""
    t = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " ")
    names = literal_rows(MONTHS, ["m", "n"])

    def numbered(x: Column) -> Column:
        up = F.upper(x)
        first = F.get(F.filter(names, lambda k: F.contains(up, k["m"])), F.lit(0))
        return let(first, lambda k: F.coalesce(F.replace(up, k["m"], k["n"]), x))

    def layouts(x: Column) -> Column:
        tries = []
        for rx, year_first in STRICT:
            a, b, e = (F.regexp_extract(x, rx, i) for i in (1, 2, 3))
            d, m, y = (e, b, a) if year_first else (a, b, e)
            ok = number(d).between(1, 31) & number(m).between(1, 12) & number(y).between(1900, 2100)
            tries.append(F.when(ok, F.concat_ws("/", _pad(d), _pad(m), y)))
        return F.coalesce(*tries, x)

    return F.when(F.length(c) > 0, let(let(t, numbered), layouts))


# First years of the Heisei and Reiwa eras less one.
HEISEI, REIWA = 1988, 2018
ERA = r"^([HhRr])([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{1,2})"
KANJI = r"^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日?"
WESTERN = r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"
WESTERN_YEAR_FIRST = r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})"


def japanese_era_date(c: Column) -> Column:
    """Era, kanji and western dates."""
    return let(c, _eras)


def _eras(c: Column) -> Column:
    g = lambda rx, i: F.regexp_extract(c, rx, i)
    year = (number(g(ERA, 2)) + F.when(F.lower(g(ERA, 1)) == "h", HEISEI).otherwise(REIWA)).cast("string")
    dmy = lambda rx, d, m, y: F.concat_ws("/", _pad(g(rx, d)), _pad(g(rx, m)), g(rx, y))
    return (
        F.when(c.rlike(ERA), F.concat_ws("/", _pad(g(ERA, 4)), _pad(g(ERA, 3)), year))
        .when(c.rlike(KANJI), dmy(KANJI, 3, 2, 1))
        .when(c.rlike(WESTERN), dmy(WESTERN, 1, 2, 3))
        .when(c.rlike(WESTERN_YEAR_FIRST), dmy(WESTERN_YEAR_FIRST, 3, 2, 1))
        .otherwise(c)
    )


def named_dmy(c: Column) -> Column:
    """Date after a label: a machine readable date or one of the strict layouts."""
    return F.when(c.rlike(r"^[0-9]{6}$"), mrz_date(c)).otherwise(normalize_date_strict(c))
