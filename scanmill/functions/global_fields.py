"""Number, name, birth date and gender by the country rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.classify import java_digits, rule_hits
from scanmill.functions.identifiers import found, gender_code
from scanmill.functions.rules import let, let_sql, sql_str, strip, strip_sql

# Labels of names and birth dates in several languages, and the least length of a name is three.
NAME_LABELLED = r"(?i)(?:name[:\s]+|nom[:\s]+|nombre[:\s]+)([A-Za-z\s]+?)\n"
DATE_BARE = r"([0-9]{1,2}[\s./-][0-9]{1,2}[\s./-][0-9]{2,4})"
DATE_LABELLED = r"(?i)(?:birth|born|naissance|nacimiento)[:\s]*" + DATE_BARE


def number_pattern(rule: Sequence) -> str:
    """The number shapes of a rule as one pattern; the leftmost match counts, earlier shapes first."""
    return "|".join(java_digits(p) for p in rule[5])


def full_name(text: Column) -> Column:
    return let(strip(F.regexp_extract(text, NAME_LABELLED, 1)), lambda n: F.when(F.length(n) > 2, n))


def birth_date(text: Column) -> Column:
    return F.coalesce(found(F.regexp_extract(text, DATE_LABELLED, 1)), found(F.regexp_extract(text, DATE_BARE, 1)))


def extract_global(df: DataFrame, rules: Sequence, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """One row per document and country rule with at least ``least`` matches, in any number of rules.

    The number is the rule's own; name, birth date and gender are read once per document. Null and empty texts match nothing.
    """
    rows = []
    for rule in rules:
        number = strip_sql(f"regexp_extract(t, {sql_str('(?iu)' + number_pattern(rule))}, 0)")
        row = f"named_struct('rule', {sql_str(f'{rule[0]}/{rule[1]}')}, 'document_number', nullif({number}, ''))"
        rows.append(f"CASE WHEN {rule_hits(rule)} >= {least} THEN {row} END")
    matched = let_sql(text, "t", let_sql("lower(t)", "low", f"array_compact(array({', '.join(rows)}))"))
    c = F.col(text)
    found_rules = df.select(key, c, F.expr(matched).alias("_rules")).filter(F.size("_rules") > 0)
    once = found_rules.select(
        key, "_rules", full_name(c).alias("full_name"), birth_date(c).alias("date_of_birth"), gender_code(c).alias("gender"),
    )
    return once.select(key, F.inline("_rules"), "full_name", "date_of_birth", "gender")
