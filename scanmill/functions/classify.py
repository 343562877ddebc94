"""Document classification and routing by rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanmill.functions.packs import DEFAULT_WEIGHTS, PACKS
from scanmill.functions.quality import completeness
from scanmill.functions.rules import (
    Pack, any_of, contains, criteria, extract, final_value, FINALS, hits, let_sql, match_any, match_lower, matches, predicate, raw_value, sql_str, word,
)

# Name of the lower-case text inside bound expressions.
LOW = "low"
# Keyword rules as (type, keywords, negative keywords), required score and least confidence.
KEYWORD_RULES = [
    ("emirates_id", ["emirates id", "بطاقة الهوية", "federal authority", "uae"], ["passport", "license", "driving"]),
    ("aadhaar_card", ["aadhaar", "आधार", "government of india", "unique identification"], ["passport", "license", "pan card"]),
    ("driving_license", ["driving license", "driver license", "dl", "motor vehicle"], ["passport", "id card", "aadhaar"]),
    ("passport", ["passport", "travel document", "republic of", "nationality"], ["license", "id card"]),
]
REQUIRED_SCORE = 2
MIN_CONFIDENCE = 0.3
# Number shapes per type.
NUMBER_RULES = [
    ("emirates_id", [r"784[-\s]?[0-9]{4}[-\s]?[0-9]{7}[-\s]?[0-9]"]),
    ("aadhaar_card", [r"[0-9]{4}\s*[0-9]{4}\s*[0-9]{4}", r"[0-9]{12}"]),
    ("driving_license", [r"[A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{7}"]),
    ("passport", [r"[A-Z][0-9]{7}", r"[A-Z]{2}[0-9]{6,8}"]),
]


def classify_keywords(df: DataFrame, key: str, text: str = "text", rules=KEYWORD_RULES, whole_word: bool = False) -> DataFrame:
    """One row per type whose keyword score (+1, negatives -0.5) reaches the least confidence."""
    found = lambda w: matches("low", "(?U)" + word(w)) if whole_word else contains("low", w)
    rows = []
    for t, pos, neg in rules:
        half = " + ".join(f"2 * int({found(w)})" for w in pos) + "".join(f" - int({found(w)})" for w in neg)
        rows.append(f"named_struct('type', {sql_str(t)}, 'score', ({half}) / 2)")
    scores = F.expr(let_sql(f"lower({text})", "low", f"array({', '.join(rows)})"))
    kept = F.filter(scores, lambda r: F.least(r["score"] / REQUIRED_SCORE, F.lit(1.0)) > MIN_CONFIDENCE)
    # The outer form keeps the optimiser from evaluating the array again in a filter of its own.
    return (
        df.select(key, F.inline_outer(kept))
        .filter("type IS NOT NULL")
        .withColumn("confidence", F.least(F.col("score") / REQUIRED_SCORE, F.lit(1.0)))
    )


def classify_numbers(df: DataFrame, key: str, text: str = "text", rules=NUMBER_RULES) -> DataFrame:
    """One row per type with a matching number shape: the share of its shapes found."""
    rows = [
        f"named_struct('type', {sql_str(t)}, 'matches', {' + '.join(f'int({match_lower(LOW, p)})' for p in shapes)}, 'shapes', {len(shapes)})"
        for t, shapes in rules
    ]
    kept = F.filter(F.expr(let_sql(f"lower({text})", LOW, f"array({', '.join(rows)})")), lambda r: r["matches"] > 0)
    out = df.select(key, F.inline_outer(kept)).filter("type IS NOT NULL")
    return out.withColumn("confidence", F.col("matches") / F.col("shapes")).drop("shapes")


def merge_classifications(by_text: DataFrame, by_number: DataFrame, key: str, top: int = 3) -> DataFrame:
    """Mean confidence per document and type over both methods; best types first."""
    u = by_text.select(key, "type", "confidence", F.lit("text_features").alias("feature")).unionByName(
        by_number.select(key, "type", "confidence", F.lit("number_patterns").alias("feature"))
    )
    # At most two rows per document and type meet here.
    g = u.groupBy(key, "type").agg(
        (F.sum("confidence") / F.count("*")).alias("confidence"), F.array_join(F.array_sort(F.collect_set("feature")), "|").alias("features")
    )
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "type")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


# The cascade as (type, words, confidence), with patterns that raise the first two to 0.9.
CASCADE = [
    ("Aadhaar Card", ["aadhaar", "aadhar", "unique identification"], 0.7),
    ("PAN Card", ["permanent account", "income tax", "pan"], 0.7),
    ("Passport", ["passport", "republic of india", "type p"], 0.85),
    ("Driving License", ["driving", "license", "transport"], 0.8),
    ("Voter ID", ["election", "voter", "epic"], 0.8),
    ("Emirates ID", ["emirates", "uae", "united arab emirates"], 0.8),
]
CASCADE_SURE = 0.9
CASCADE_OTHER = ("Other Document", 0.4)
# Pattern groups of the feature flags.
FLAG_PATTERNS = {
    "aadhaar": [word(r"[0-9]{4}\s*[0-9]{4}\s*[0-9]{4}"), "आधार|aadhaar|aadhar", "unique identification", "government of india", "भारत सरकार"],
    "pan": [word(r"[A-Z]{5}[0-9]{4}[A-Z]"), "permanent account number", "income tax department", "pan card"],
    "passport": ["passport", "republic of india", "type.*p", "country code.*ind", "nationality.*indian"],
    "driving_license": ["driving.*licen[cs]e", "transport.*department", "dl.*no", "license.*no"],
    "voter_id": ["election.*commission", "voter.*id", "epic.*no", "electoral.*photo"],
    "emirates_id": ["emirates.*id", "united arab emirates", "identity.*card", "الإمارات العربية المتحدة"],
    "date": [
        word(r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"), word(r"[0-9]{1,2}\s+[\p{L}\p{N}_]+\s+[0-9]{4}"), "date.*of.*birth", "dob", "expiry.*date",
    ],
    "government": ["government|ministry|department|authority|commission|republic|भारत|सरकार|india|official"],
}
SCRIPTS = {"hindi": r"[\x{0900}-\x{097F}]", "arabic": r"[\x{0600}-\x{06FF}]", "japanese": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}]"}


def flag(lower: str, group: str) -> str:
    """SQL text of a pattern group test on lower-case text."""
    return match_any(lower, FLAG_PATTERNS[group])


def script_flags(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns({f"has_{n}": F.col(text).rlike(p) for n, p in SCRIPTS.items()})


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts, character ratios and pattern flags of a text."""
    c = F.col(text)
    n = F.length(c).cast("double")
    ratio = lambda rx: F.when(n > 0, F.regexp_count(c, F.lit(rx)).cast("double") / n).otherwise(0.0)
    lines = F.regexp_count(c, F.lit("\n")) + F.when((c != "") & ~c.endswith("\n"), 1).otherwise(0)
    return df.withColumns(
        {
            "text_length": F.length(c),
            "word_count": F.regexp_count(c, F.lit(r"\S+")),
            "line_count": lines,
            "digit_ratio": ratio(r"\p{Nd}"),
            "upper_ratio": ratio(r"\p{Lu}"),
            "special_char_ratio": ratio(r"[^\p{L}\p{N}\s]"),
            **{f"has_{g}_pattern": F.expr(flag(f"lower({text})", g)) for g in FLAG_PATTERNS},
            "has_hindi_text": c.rlike(SCRIPTS["hindi"]),
            "has_arabic_text": c.rlike(SCRIPTS["arabic"]),
        }
    )


def classify_cascade(df: DataFrame, text: str = "text") -> DataFrame:
    """Ordered word rules with fixed confidences."""
    groups = {"Aadhaar Card": "aadhaar", "PAN Card": "pan"}
    row = lambda t, p: f"named_struct('document_type', {sql_str(t)}, 'confidence', double({p}))"
    sure = lambda t, p: f"CASE WHEN {flag('low', groups[t])} THEN {CASCADE_SURE} ELSE {p} END" if t in groups else p
    cases = " ".join(f"WHEN {any_of(ws, 'low')} THEN {row(t, sure(t, p))}" for t, ws, p in CASCADE)
    cascade = let_sql(f"lower({text})", "low", f"CASE {cases} ELSE {row(*CASCADE_OTHER)} END")
    return df.withColumn("_c", F.expr(cascade)).select(*df.columns, "_c.*")


# Words and patterns of the coarse detection, tested in this order.
COARSE_ID_PATTERNS = [
    r"[0-9]{4}\s*[0-9]{4}\s*[0-9]{4}", r"[0-9]{4}-[0-9]{4}-[0-9]{4}", r"आधार\s*संख्या", r"aadhaar\s*number", r"government\s*of\s*india",
    r"भारत\s*सरकार", r"मेरा\s*आधार", r"my\s*aadhaar", r"[0-9]{3}-[0-9]{4}-[0-9]{7}-[0-9]", "بطاقة الهوية",
]
COARSE_LICENSE_PATTERNS = ["رخصة قيادة", "driving license", r"license no\.?\s*[0-9]+", "ملف مروري", "traffic file"]
COARSE_PASSPORT = ["passport", "passeport", "reisepass", "pasaporte", "паспорт", "جواز سفر", "पासपोर्ट", "护照", "パスポート", "여권", "pass", "passaporte", "passaporto"]
COARSE_ID = [
    "identity card", "id card", "identification", "national id", "بطاقة الهوية", "carte d'identité", "personalausweis", "dni", "cédula", "cedula",
    "удостоверение", "पहचान पत्र", "身份证", "運転免許証", "주민등록증", "emirates id", "residence", "resident card", "green card", "هوية إماراتية",
    "uae id", "id number", "aadhaar", "aadhar", "आधार", "government of india", "भारत सरकार", "unique identification",
]
COARSE_LICENSE = [
    "driver license", "driving licence", "license", "permit", "رخصة قيادة", "driver's licence", "road transport", "traffic", "المرور",
    "هيئة الطرق", "rta", "driving class", "vehicle category",
]
MRZ_LENGTH = 40


def detect_type(text: str, mrz_type: str | None = None) -> Column:
    """passport, id_card, driving_license or other: machine readable type, patterns, MRZ line, then words."""
    mrz_line = (
        f"exists(split(t, '\\n'), x -> length(trim(x)) >= {MRZ_LENGTH} AND length(x) - length(replace(x, '<', '')) >= 5)"
    )
    cases = (
        f"WHEN {match_any('low', COARSE_ID_PATTERNS)} THEN 'id_card' WHEN {match_any('low', COARSE_LICENSE_PATTERNS)} THEN 'driving_license' WHEN {mrz_line} THEN 'passport' "
        f"WHEN {any_of(COARSE_PASSPORT, 'low')} THEN 'passport' WHEN {any_of(COARSE_ID, 'low')} THEN 'id_card' "
        f"WHEN {any_of(COARSE_LICENSE, 'low')} THEN 'driving_license'"
    )
    by_text = let_sql(text, "t", let_sql("lower(t)", "low", f"CASE {cases} END"))
    if mrz_type is None:
        return F.expr(f"coalesce({by_text}, 'other')")
    first = f"CASE WHEN {mrz_type} = 'P' THEN 'passport' WHEN {mrz_type} IN ('I', 'ID', 'IC', 'C') THEN 'id_card' END"
    return F.expr(f"coalesce({first}, {by_text}, CASE WHEN {mrz_type} IS NOT NULL THEN 'passport' END, 'other')")


def route_document(df: DataFrame, text: str = "text", packs: Sequence[Pack] = PACKS, order: str = "first") -> DataFrame:
    """Pack of a document: the first that recognises it, or with ``order='specific'`` the one with most matched criteria."""
    if order == "first":
        body = "coalesce(" + ", ".join(f"CASE WHEN {predicate(p.detect, 't', 'low')} THEN '{p.code}' END" for p in packs) + ")"
    elif order == "specific":
        ranked = ", ".join(
            f"named_struct('n', CASE WHEN {predicate(p.detect, 't', 'low')} THEN {criteria(p.detect, 't', 'low')} ELSE 0 END, 'before', {-i}, 'code', '{p.code}')"
            for i, p in enumerate(packs)
        )
        body = let_sql(f"array_max(array({ranked}))", "b", "CASE WHEN b.n > 0 THEN b.code END")
    else:
        raise ValueError(f"unknown order: {order}")
    # The text is bound too: a filter on the pack may be pushed below the place where the text is computed.
    return df.withColumn("pack", F.expr(let_sql(text, "t", let_sql("lower(t)", "low", body))))


def pack_text(p: Pack, text: str) -> str:
    return f"replace({text}, '\\n', ' ')" if p.single_line else text


def recognised_packs(df: DataFrame, text: str = "text", packs: Sequence[Pack] = PACKS) -> DataFrame:
    """One row for each pack that recognises a document, in one pass over the texts."""
    codes = ", ".join(f"CASE WHEN {predicate(p.detect, 't', 'low')} THEN '{p.code}' END" for p in packs)
    found = let_sql(text, "t", let_sql("lower(t)", "low", f"array_compact(array({codes}))"))
    return df.withColumn("pack", F.explode(F.expr(found)))


ADDRESS_PACKS = ("aadhaar", "driving_license")
NEXT_LINE_PACKS = ("us_drivers_license",)


def next_line_address(text: str) -> Column:
    """Line after the first line that names an address."""
    lines = f"transform(split({text}, '\\n'), x -> trim(x))"
    body = let_sql("array_position(transform(ls, x -> contains(lower(x), 'addr')), true)", "i", "CASE WHEN i > 0 THEN get(ls, int(i)) END")
    return F.expr(let_sql(lines, "ls", body))


def pack_fields(p: Pack, text: str) -> dict[str, Column]:
    """Columns of one pack by field name."""
    from scanmill.functions.identifiers import address_block

    out = {f.name: extract(f, pack_text(p, text)) for f in p.fields}
    if p.code in ADDRESS_PACKS:
        out["address"] = address_block(F.col(text))
    if p.code in NEXT_LINE_PACKS:
        out["address"] = next_line_address(text)
    return out


def extract_fields(df: DataFrame, key: str, pack: Pack, text: str = "text") -> DataFrame:
    """Wide table of the fields of one pack; use on documents routed to it."""
    return df.select(key, *[c.alias(n) for n, c in pack_fields(pack, text).items()])


def extract_routed(df: DataFrame, text: str = "text", packs: Sequence[Pack] = PACKS) -> DataFrame:
    """Map of the non-null fields of the routed pack; only that pack's patterns run on a document.

    The patterns sit inside one bound expression: generated code for hundreds of them would exceed
    what the compiler takes in one method. Values are brought to normal form after that, once per
    kind and not once per field.
    """
    from scanmill.functions.identifiers import address_block

    def entries(p: Pack) -> str:
        rows = ", ".join(f"named_struct('k', '{f.name}', 'f', '{f.final}', 'v', {raw_value(f, 't')})" for f in p.fields)
        return let_sql(pack_text(p, "s"), "t", f"array({rows})")

    cases = " ".join(f"WHEN pack = '{p.code}' THEN {entries(p)}" for p in packs)
    raw = F.filter(F.expr(let_sql(text, "s", f"CASE {cases} END")), lambda e: e["v"].isNotNull())

    def normal(e: Column) -> Column:
        out = None
        for kind in FINALS:
            cond, v = e["f"] == kind, final_value(kind, e["v"])
            out = F.when(cond, v) if out is None else out.when(cond, v)
        return F.struct(e["k"].alias("k"), out.otherwise(e["v"]).alias("v"))

    address = F.when(F.col("pack").isin(*ADDRESS_PACKS), address_block(F.col(text))).when(
        F.col("pack").isin(*NEXT_LINE_PACKS), next_line_address(text)
    )
    named = F.array(F.struct(F.lit("address").alias("k"), address.alias("v")))
    both = F.filter(F.concat(F.transform(raw, normal), named), lambda e: e["v"].isNotNull())
    return df.withColumn("fields", F.map_from_entries(both))


def extraction_confidence(df: DataFrame, fields: str = "fields", packs: Sequence[Pack] = PACKS) -> DataFrame:
    """Weighted completeness of the routed pack and its level."""
    conf = " ".join(f"WHEN '{p.code}' THEN {completeness(p.weights or DEFAULT_WEIGHTS, fields)}" for p in packs)
    limit = " ".join(f"WHEN '{p.code}' THEN double({p.threshold})" for p in packs)
    level = f"CASE WHEN confidence > CASE pack {limit} END THEN 'high' WHEN confidence IS NOT NULL THEN 'medium' END"
    return df.withColumn("confidence", F.expr(f"CASE pack {conf} END")).withColumn("level", F.expr(level))


def java_digits(p: str) -> str:
    return p.replace(r"\d", "[0-9]")


def rule_hits(rule: Sequence) -> str:
    """SQL text: how many keywords, marks and number shapes of a country rule the bound lower-case text holds."""
    _, _, _, _, keywords, shapes, marks = rule
    return hits([w.lower() for w in [*keywords, *marks]], LOW) + "".join(f" + int({match_lower(LOW, java_digits(p))})" for p in shapes)


def detect_global(df: DataFrame, rules: Sequence, text: str = "text", least: int = 2) -> DataFrame:
    """Country rules with at least two matches, as ``country/type`` names in rule order."""
    found = [f"CASE WHEN {rule_hits(r)} >= {least} THEN {sql_str(f'{r[0]}/{r[1]}')} END" for r in rules]
    body = let_sql("lower(t)", "low", f"array_compact(array({', '.join(found)}))")
    return df.withColumn("global_types", F.expr(let_sql(text, "t", body)))
