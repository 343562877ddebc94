"""Type-independent extraction of the main document fields with ordered fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.classify import detect_type
from scanmill.functions.dates import normalize_date
from scanmill.functions.identifiers import clean_document_number, extract_place, found, nationality
from scanmill.functions.names import best_name, clean_name
from scanmill.functions.rules import LEFT, Probe, let, strip, words

# Labels and value shapes of the general extraction, in order of preference.
_NUM = r"[0-9]{1,2}[\s./-][0-9]{1,2}[\s./-][0-9]{2,4}"
_DMON = r"[0-9]{1,2}[\s./-][A-Za-z]{3}[\s./-][0-9]{2,4}"
_MOND = r"[A-Za-z]{3,9}[\s./-][0-9]{1,2}[\s./-][0-9]{2,4}"
_BORN = r"(?:date of birth|birth date|born|dob)[.:\s]*"
_EXPIRES = r"(?:date of expiry|expiry date|expiration|exp|expires)[.:\s]*"
_ISSUED = r"(?:issue|issued)\s*(?:date|on)[.:\s]*"
EMIRATES = r"([0-9]{3}-[0-9]{4}-[0-9]{7}-[0-9])"
EMIRATES_WORDS = ["emirates id", "هوية إماراتية"]
LICENSE_WORDS = ["driving", "license", "رخصة قيادة"]
PROBES = {
    "emirates_name": [Probe(r"(?:name|full name|الاسم)[:\s]+([\p{L}\p{N}_\s]+)")],
    "license_number": [
        Probe(r"(?:license|licence)\s*(?:no|number)[.:\s]*([0-9]+)"),
        Probe(r"(?:file|ملف)\s*(?:no|number|رقم)[.:\s]*([0-9]+)"),
        Probe(r"(?:رقم الرخصة)[.:\s]*([0-9]+)"),
    ],
    "issue_date": [Probe(f"{_ISSUED}({_DMON})"), Probe(f"{_ISSUED}({_MOND})"), Probe(rf"(?:تاريخ الإصدار)[.:\s]*({_NUM})")],
    "document_number": [
        Probe(r"(?:document|passport|id)\s*(?:no|number|#|num)[.:\s]*([A-Z0-9]{5,})"),
        Probe(r"(?:no|number|#|num)[.:\s]*([A-Z0-9]{5,})"),
        Probe(r"([A-Z][0-9]{7,9})"),
        Probe(r"([0-9]{9}[A-Z])"),
        Probe(EMIRATES),
    ],
    "date_of_birth": [Probe(f"{_BORN}({_NUM})"), Probe(f"{_BORN}({_DMON})"), Probe(f"{_BORN}({_MOND})"), Probe(rf"(?:تاريخ الميلاد)[.:\s]*({_NUM})")],
    "date_of_expiry": [Probe(f"{_EXPIRES}({_NUM})"), Probe(f"{_EXPIRES}({_DMON})"), Probe(f"{_EXPIRES}({_MOND})"), Probe(rf"(?:تاريخ الانتهاء)[.:\s]*({_NUM})")],
    "nationality": [
        Probe(r"(?:nationality|country)[.:\s]*([\p{L}\p{N}_\s]+?)(?:\n|date|document|$)", multiline=True),
        Probe(r"(?:nat)[.:\s]*([\p{L}\p{N}_\s]{3,20})(?:\n|date|document|$)", multiline=True),
        Probe(r"(?:الجنسية)[.:\s]*([\p{L}\p{N}_\s]+?)(?:\n|$)", multiline=True),
    ],
}
SURNAME_LINE = r"(?i)(?:surname|family name)[.:\s]*([\p{L}\p{N}_\s]+?)$"
GIVEN_LINE = r"(?i)(?:given names?|first names?)[.:\s]*([\p{L}\p{N}_\s]+?)$"
GENDER = [(rf"{LEFT}(?:gender|sex)[.:\s]*[mM](?:[^\p{{L}}\p{{N}}_]|$|ale)", "M"), (rf"{LEFT}(?:gender|sex)[.:\s]*[fF](?:[^\p{{L}}\p{{N}}_]|$|emale)", "F"), (r"(?:^|\n)\s*[sS]ex:\s*[mM]\s*(?:\n|$)", "M"), (r"(?:^|\n)\s*[sS]ex:\s*[fF]\s*(?:\n|$)", "F")]


def first_probe(name: str, text: Column) -> Column:
    return F.coalesce(*[found(F.regexp_extract(text, p.java(), 1)) for p in PROBES[name]])


def labelled_line(text: Column, line_rx: str, other: str | None) -> Column:
    """Cleaned name of the last line with the label; lines with the other label are not read."""
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, r"[^\p{L}\p{N}_\s:]", " ")))
    if other:
        lines = F.filter(lines, lambda x: ~x.rlike(other))
    hits = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, line_rx, 1)), lambda x: x != "")
    return let(hits, lambda h: clean_name(F.get(h, F.size(h) - 1)))


def document_info(df: DataFrame, countries: Sequence[tuple[str, str]], text: str = "text") -> DataFrame:
    """Eleven fields of a document of any kind; null where nothing is found."""
    has = lambda c, ws: let(
        F.lower(c), lambda low: F.exists(words(ws), lambda w: F.contains(low, w))
    )
    has_eid = lambda c: has(c, EMIRATES_WORDS) | c.rlike(EMIRATES)
    eid = lambda c: F.when(has_eid(c), found(F.regexp_extract(c, EMIRATES, 1)))
    licence = lambda c: F.when(has(c, LICENSE_WORDS), first_probe("license_number", c))

    def full_name(c: Column) -> Column:
        surname = labelled_line(c, SURNAME_LINE, None)
        given = labelled_line(c, GIVEN_LINE, "(?i)(?:surname|family name)")
        labelled = let(
            F.struct(given.alias("g"), surname.alias("s")),
            lambda n: F.when(n["g"].isNotNull() & n["s"].isNotNull(), F.concat_ws(" ", n["g"], n["s"])).otherwise(F.coalesce(n["g"], n["s"])),
        )
        return F.coalesce(F.when(has_eid(c), clean_name(first_probe("emirates_name", c))), labelled, clean_name(best_name(c)))

    def country(c: Column) -> Column:
        return F.coalesce(
            *[
                let(F.regexp_extract(c, p.java(), 1), lambda x: F.when(strip(x) != "", F.nullif(nationality(x, countries), F.lit("UNKNOWN"))))
                for p in PROBES["nationality"]
            ]
        )

    fields = {
        "full_name": full_name,
        "document_number": lambda c: F.coalesce(eid(c), clean_document_number(licence(c)), clean_document_number(first_probe("document_number", c))),
        "date_of_birth": lambda c: normalize_date(first_probe("date_of_birth", c)),
        "date_of_expiry": lambda c: normalize_date(first_probe("date_of_expiry", c)),
        "nationality": country,
        "gender": lambda c: F.coalesce(*[F.when(c.rlike(rx), F.lit(v)) for rx, v in GENDER]),
        "unified_number": lambda c: F.replace(eid(c), F.lit("-"), F.lit("")),
        "license_number": licence,
        "issue_date": lambda c: F.when(has(c, LICENSE_WORDS), normalize_date(first_probe("issue_date", c))),
        "place_of_issue": lambda c: F.when(F.col("document_type") == "passport", extract_place(c)),
    }
    out = df.withColumn("document_type", detect_type(text))
    # Each field is one bound expression over the text: unused ones are pruned, and no generated method grows too large.
    return out.withColumns({n: let(F.col(text), fn) for n, fn in fields.items()})
