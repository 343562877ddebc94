"""Registered text queries: normalisation, classification, routing, extraction, screening and quality."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scanmill.functions import classify as K
from scanmill.functions import dates as Dt
from scanmill.functions import global_fields as G
from scanmill.functions import identifiers as I
from scanmill.functions import names as N
from scanmill.functions.catalogue import COUNTRY_RULES
from scanmill.functions.packs import DEFAULT_WEIGHTS, EU_COUNTRIES, PACKS
from scanmill.functions.rules import LEFT, RIGHT
from scanmill.plans import rule_sql as R
from scanmill.plans.registry import query
from scanmill.sources import tables as T
from scanmill.sources.identity import CORPUS_SQL, corpus, quote

LOW = "SELECT doc_id, text, lower(text) AS low FROM corpus"


def C(body: str) -> str:
    return f"WITH {CORPUS_SQL}, c AS ({LOW}) {body}"


def sql_list(items) -> str:
    return "[" + ", ".join(quote(x) for x in items) + "]"


# ---- dates ----


def date_strings(spark, d):
    """Order dates written in ten layouts by key."""
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 10
    f = lambda p: F.date_format(t, p)
    s = F.when(k == 0, f("dd/MM/yyyy")).when(k == 1, f("yyyy.MM.dd")).when(k == 2, f("yyyyMMdd")).when(k == 3, f("yyMMdd"))
    s = s.when(k == 4, F.concat(f("dd"), F.lit(" "), F.upper(f("MMM")), F.lit(" "), f("yyyy"))).when(k == 5, F.concat(f("MMM"), F.lit(" "), f("dd"), F.lit(", "), f("yyyy")))
    s = s.when(k == 6, f("d-M-yy")).when(k == 7, F.lit("unknown")).when(k == 8, F.concat(f("d"), F.lit(" Xyz "), f("yyyy"))).otherwise(F.lit(""))
    return T.table(spark, d, "orders").select("o_orderkey", s.alias("raw"))


DATE_SQL = """dates AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y.%m.%d')
  WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN strftime(o_orderdate, '%y%m%d') WHEN 4 THEN upper(strftime(o_orderdate, '%d %b %Y'))
  WHEN 5 THEN strftime(o_orderdate, '%b %d, %Y') WHEN 6 THEN strftime(o_orderdate, '%-d-%-m-%y') WHEN 7 THEN 'unknown'
  WHEN 8 THEN strftime(o_orderdate, '%-d Xyz %Y') ELSE '' END AS raw FROM orders)"""


@query("normalize_date", f"""WITH {DATE_SQL} SELECT o_orderkey, raw, CASE o_orderkey % 10 WHEN 7 THEN 'unknown' WHEN 8 THEN NULL WHEN 9 THEN NULL
  ELSE strftime(o_orderdate, '%d/%m/%Y') END AS normalized FROM dates JOIN orders USING (o_orderkey)""")
def normalize_date(spark, d):
    return date_strings(spark, d).select("o_orderkey", "raw", Dt.normalize_date(F.col("raw")).alias("normalized"))


@query("normalize_date_strict", f"WITH {DATE_SQL} SELECT o_orderkey, {R.strict_date('raw')} AS normalized FROM dates")
def normalize_date_strict(spark, d):
    return date_strings(spark, d).select("o_orderkey", Dt.normalize_date_strict(F.col("raw")).alias("normalized"))


@query("mrz_date_pivot30", """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/') || CASE WHEN year(o_orderdate) % 100 <= 30 THEN '20' ELSE '19' END
  || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS expiry FROM orders""")
def mrz_date_pivot30(spark, d):
    return T.table(spark, d, "orders").select("o_orderkey", Dt.mrz_date(F.date_format("o_orderdate", "yyMMdd")).alias("expiry"))


@query("japanese_era_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'n/a' ELSE strftime(o_orderdate, '%d/%m/')
  || CASE o_orderkey % 5 WHEN 0 THEN 1988 + year(o_orderdate) % 30 WHEN 1 THEN 2018 + year(o_orderdate) % 30 ELSE year(o_orderdate) END END AS normalized FROM orders""")
def japanese_era_date(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    f = lambda p: F.date_format(t, p)
    era = (F.year(t) % 30).cast("string")
    raw = F.when(k == 0, F.concat(F.lit("H"), era, f(".M.d"))).when(k == 1, F.concat(F.lit("r"), era, f(".M.d")))
    raw = raw.when(k == 2, F.concat(f("yyyy"), F.lit("年"), f("M"), F.lit("月"), f("d"), F.lit("日"))).when(k == 3, f("yyyy-MM-dd")).otherwise(F.lit("n/a"))
    return T.table(spark, d, "orders").select("o_orderkey", Dt.japanese_era_date(raw).alias("normalized"))


# ---- numbers, contacts, places ----



@query("clean_document_number", """WITH k AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 31) % 10000000 AS VARCHAR), 7, '0') AS n7,
  CAST(c_custkey % 10 AS VARCHAR) AS d1 FROM customer)
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'AB' || n7 WHEN 1 THEN '784-1990-' || n7 || '-' || d1 WHEN 2 THEN 'KA' || substr(n7, 1, 6)
  WHEN 3 THEN 'É-' || d1 || 'É-2É' WHEN 4 THEN NULL ELSE 'x-' || d1 END AS cleaned FROM k""")
def clean_document_number(spark, d):
    k = F.col("c_custkey")
    n7 = F.lpad(((k * 7919 + 31) % 10000000).cast("string"), 7, "0")
    d1 = (k % 10).cast("string")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("Passport No: AB"), n7)).when(k % 6 == 1, F.concat(F.lit("784-1990-"), n7, F.lit("-"), d1))
        .when(k % 6 == 2, F.concat(F.lit(" KA"), F.substring(n7, 1, 6))).when(k % 6 == 3, F.concat(F.lit("no é-"), d1, F.lit("é-2é")))
        .when(k % 6 == 4, F.lit("")).otherwise(F.concat(F.lit("x-"), d1))
    )
    return T.table(spark, d, "customer").select("c_custkey", I.clean_document_number(raw).alias("cleaned"))


@query("format_emirates_id", C(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '784[-\s]?([0-9]{4})[-\s]?([0-9]{7})[-\s]?([0-9])') THEN
  '784-' || regexp_extract(text, '784[-\s]?([0-9]{4})[-\s]?([0-9]{7})[-\s]?([0-9])', 1) || '-' || regexp_extract(text, '784[-\s]?([0-9]{4})[-\s]?([0-9]{7})[-\s]?([0-9])', 2)
  || '-' || regexp_extract(text, '784[-\s]?([0-9]{4})[-\s]?([0-9]{7})[-\s]?([0-9])', 3) END AS emirates_id FROM c"""))
def format_emirates_id(spark, d):
    return corpus(spark, d).select("doc_id", I.format_emirates_id(F.col("text")).alias("emirates_id"))


@query("extract_contacts", C(f"""SELECT doc_id, nullif(regexp_extract(text, {quote(I.EMAIL)}, 1), '') AS email,
  nullif(regexp_extract(text, {quote(I.MOBILE)}, 1), '') AS mobile, nullif(regexp_extract(text, {quote(I.ZIP)}, 1), '') AS zip_code FROM c"""))
def extract_contacts(spark, d):
    return I.contacts(corpus(spark, d)).select("doc_id", "email", "mobile", "zip_code")


_ADDR_MARK = "list_contains(list_transform(" + sql_list(I.ADDRESS_MARKS) + ", lambda w: contains(lower(x), w)), true)"
_ADDR_STOP = "list_contains(list_transform(" + sql_list(I.ADDRESS_STOPS) + ", lambda w: contains(lower(x), w)), true)"


ADDRESS_SQL = f"""l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: {R.strip('x')}), lambda x: x <> '')) AS x,
        generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: {R.strip('x')}), lambda x: x <> ''), 1) AS i FROM c),
f AS (SELECT *, {_ADDR_MARK} AS mark, NOT {_ADDR_MARK} AND {_ADDR_STOP} AS stop FROM l),
s AS (SELECT doc_id, min(i) FILTER (mark) AS a FROM f GROUP BY doc_id),
e AS (SELECT f.doc_id, a, coalesce(min(i) FILTER (stop AND i > a), 1000000000) AS z FROM f JOIN s USING (doc_id) GROUP BY f.doc_id, a),
v AS (SELECT f.doc_id, i, CASE WHEN mark THEN nullif({R.strip(f"regexp_extract(x, {quote(I.ADDRESS_LABEL.replace('(?iu)', '(?i)'))}, 1)")}, '')
  WHEN length(x) > 5 AND NOT {R.rx('x', I.NOT_ADDRESS)} THEN x END AS y FROM f JOIN e USING (doc_id) WHERE i >= a AND i < z),
addr AS (SELECT c.doc_id, nullif(string_agg(y, ' ' ORDER BY i), '') AS address FROM c LEFT JOIN v USING (doc_id) GROUP BY c.doc_id)"""


@query("extract_address_block", C(f", {ADDRESS_SQL} SELECT * FROM addr"))
def extract_address_block(spark, d):
    return corpus(spark, d).select("doc_id", I.address_block(F.col("text")).alias("address"))


def _place_sql() -> str:
    tries = []
    for p in I.PLACE_PROBES:
        v = f"regexp_extract(text, {quote(R.probe_pattern(p))}, 1)"
        t = R.strip(f"regexp_replace(regexp_replace({v}, '[^\\p{{L}}\\p{{N}}_\\s,]', '', 'g'), '\\s+', ' ', 'g')")
        ws = f"list_filter(string_split({t}, ' '), lambda w: NOT list_contains({sql_list(I.NOT_PLACES)}, lower(w)) AND length(w) > 1)"
        tries.append(f"nullif(array_to_string(list_transform({ws}, lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' '), '')")
    return "coalesce(" + ", ".join(tries) + ")"


@query("extract_place", C(f"SELECT doc_id, {_place_sql()} AS place FROM c"))
def extract_place(spark, d):
    return corpus(spark, d).select("doc_id", I.extract_place(F.col("text")).alias("place"))


_COUNTRIES = I.country_table()


def _kw_sql() -> str:
    return "kw(ord, code, k, pat) AS (VALUES " + ", ".join(
        f"({i}, {quote(c)}, {quote(k.lower())}, {quote(LEFT + '(?:' + re.escape(k.lower()).replace(chr(92) + ' ', ' ') + ')' + RIGHT)})"
        for i, (c, k) in enumerate(_COUNTRIES)
    ) + ")"


@query("nationality_code", C(f""", {_kw_sql()},
m AS (SELECT doc_id, code, ord + CASE WHEN regexp_matches(low, pat) THEN 0 ELSE 10000 END AS r FROM c JOIN kw ON contains(low, k))
SELECT c.doc_id, coalesce(arg_min(code, r), 'UNKNOWN') AS nationality FROM c LEFT JOIN m USING (doc_id) GROUP BY c.doc_id"""))
def nationality_code(spark, d):
    return corpus(spark, d).select("doc_id", I.nationality("text", _COUNTRIES).alias("nationality"))


@query("issuing_country", C(f""", eu(ord, code, adj, k) AS (VALUES {', '.join(f"({i}, '{c}', '{a}', {quote(n)})" for i, (c, a, ns) in enumerate(EU_COUNTRIES) for n in ns)}),
m AS (SELECT doc_id, arg_min(code, ord) AS code, arg_min(adj, ord) AS adj FROM c JOIN eu ON contains(low, k) GROUP BY doc_id)
SELECT c.doc_id, code AS country_code, coalesce(adj, nullif(regexp_extract(text, {quote(I.NATIONALITY_LABEL.replace('(?iu)', '(?i)'))}, 1), ''),
  nullif(regexp_extract(text, {quote('(?i)' + I.word_group('|'.join(a for c, a, _ in EU_COUNTRIES if a != c)))}, 1), '')) AS nationality
FROM c LEFT JOIN m USING (doc_id)"""))
def issuing_country(spark, d):
    return I.issuing_country(corpus(spark, d)).select("doc_id", "country_code", "nationality")


GENDER_SQL = f"""SELECT doc_id, CASE WHEN g IN ('MALE', 'M', 'HOMME', 'MASCULINO') THEN 'M' WHEN g IN ('FEMALE', 'F', 'FEMME', 'FEMENINO') THEN 'F' END AS gender
FROM (SELECT doc_id, upper(coalesce(nullif(regexp_extract(text, {quote(I.GENDER_LABELLED.replace('(?iu)', '(?i)'))}, 1), ''),
  nullif(regexp_extract(text, {quote(I.GENDER_BARE.replace('(?iu)', '(?i)'))}, 1), ''))) AS g FROM c)"""


@query("gender_code", C(GENDER_SQL))
def gender_code(spark, d):
    return corpus(spark, d).select("doc_id", I.gender_code(F.col("text")).alias("gender"))


# ---- names ----

_WORDS_SQL = "words AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM corpus)"
_ART = "(" + " OR ".join(f"contains(x, '{a}')" for a in N.ARTEFACTS) + ")"
_RUNS = "|".join(ch * 3 for ch in "abcdefghijklmnopqrstuvwxyz")


def artefact_sql(w: str) -> str:
    x = f"regexp_replace(lower({w}), '[^a-zA-Z]', '', 'g')"
    return (
        f"(length({w}) < 2 OR list_transform([{x}], lambda x: length(x) < 2 OR regexp_matches(x, '{_RUNS}')"
        f" OR (len(list_distinct(string_split(x, ''))) <= 2 AND length(x) > 4) OR {_ART})[1])"
    )


def plausible_sql(w: str) -> str:
    v = f"length(regexp_replace({w}, '[^aeiouAEIOU]', '', 'g'))"
    return (
        f"(length({w}) >= 2 AND regexp_matches({w}, '^\\p{{L}}+$') AND length({w}) <= 20 AND NOT (length({w}) > 3 AND {v} = 0)"
        f" AND NOT (length({w}) > 4 AND {v} = length({w})))"
    )


@query("name_quality_flags", f"WITH {CORPUS_SQL}, {_WORDS_SQL} SELECT w AS word, {artefact_sql('w')} AS is_artefact, {plausible_sql('w')} AS is_plausible FROM words WHERE w <> ''")
def name_quality_flags(spark, d):
    w = corpus(spark, d).select(F.explode(F.split("text", r"\s+")).alias("word")).filter("word <> ''").distinct()
    return w.select("word", N.is_artefact(F.col("word")).alias("is_artefact"), N.is_plausible(F.col("word")).alias("is_plausible"))


# Invented lists of the test names.
GIVEN = ["LIORA", "AHMED", "MOHAMMED", "SARA", "ALI"]
FIXES = {"KLIORA": "LIORA", "OLIORA": "LIORA", "K/IORA": "LIORA"}


def raw_names(spark, d):
    """Names as recognised: labels, titles, artefacts, repeats and swapped order mixed in by key."""
    k = F.col("c_custkey")
    g = ["rajesh", "MOHAMMED", "sara", "John", "KLIORA", "Anna", "LIORA", "É-lise"]
    s = ["KUMAR", "hassan", "Smith", "tamlin", "Müller", "llllk", "o'neil"]
    pick = lambda xs, m: F.element_at(F.array(*map(F.lit, xs)), ((k * m) % len(xs) + 1).cast("int"))
    pre = pick(["Mr ", "Name: ", "", "surname ", "123 "], 1)
    mid = pick([" ", "  kkkkk ", " Singh ", "-"], 3)
    raw = F.when(k % 17 == 0, F.lit("")).when(k % 19 == 0, F.lit("xx 12 zz")).otherwise(
        F.when(k % 2 == 0, F.concat(pre, pick(s, 5), mid, pick(g, 7))).otherwise(F.concat(pre, pick(g, 7), mid, pick(s, 5), F.lit(" "), pick(g, 7)))
    )
    return T.table(spark, d, "customer").select("c_custkey", raw.alias("raw"))


RAW_NAMES_SQL = """raw_names AS (SELECT k AS c_custkey, CASE WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN 'xx 12 zz' WHEN k % 2 = 0 THEN pre || s || mid || g ELSE pre || g || mid || s || ' ' || g END AS raw
FROM (SELECT c_custkey AS k, ['Mr ', 'Name: ', '', 'surname ', '123 '][c_custkey % 5 + 1] AS pre, [' ', '  kkkkk ', ' Singh ', '-'][(c_custkey * 3) % 4 + 1] AS mid,
  ['rajesh', 'MOHAMMED', 'sara', 'John', 'KLIORA', 'Anna', 'LIORA', 'É-lise'][(c_custkey * 7) % 8 + 1] AS g,
  ['KUMAR', 'hassan', 'Smith', 'tamlin', 'Müller', 'llllk', 'o''neil'][(c_custkey * 5) % 7 + 1] AS s FROM customer))"""


def reorder_sql(c: str) -> str:
    fix = "CASE " + " ".join(f"WHEN w = {quote(a)} THEN {quote(b)}" for a, b in FIXES.items()) + " ELSE w END"
    parts = f"list_transform(regexp_split_to_array({R.strip(f'upper({c})')}, '\\s+'), lambda w: {fix})"
    known = sql_list(GIVEN)
    at = f"list_position(p, list_filter(p, lambda w: list_contains({known}, w))[1])"
    return (
        f"list_transform([{parts}], lambda p: CASE WHEN {at} > 1 OR ({at} >= 1 AND len(p) >= 3) THEN array_to_string(list_concat([p[{at}]], p[1:{at} - 1], p[{at} + 1:]), ' ')"
        f" WHEN array_to_string(p, ' ') <> upper({c}) THEN array_to_string(p, ' ') ELSE {c} END)[1]"
    )


@query("reorder_name", f"WITH {RAW_NAMES_SQL} SELECT c_custkey, CASE WHEN raw = '' THEN raw ELSE {reorder_sql('raw')} END AS name FROM raw_names")
def reorder_name(spark, d):
    return raw_names(spark, d).select("c_custkey", N.reorder_name(F.col("raw"), GIVEN, FIXES).alias("name"))


def clean_name_sql(c: str) -> str:
    lt = lambda w: f"regexp_replace({w}, '[^a-zA-Z]', '', 'g')"
    cleaned = f"regexp_replace({R.strip(f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")}, '\\s+', ' ', 'g')"
    good = (
        f"list_filter(string_split({cleaned}, ' '), lambda w: NOT {artefact_sql('w')} AND NOT list_contains({sql_list(N.NOT_NAMES)}, lower(w))"
        f" AND {plausible_sql(lt('w'))})"
    )
    caps = f"list_transform({good}, lambda w: upper(substr({lt('w')}, 1, 1)) || lower(substr({lt('w')}, 2)))"
    # First occurrences only: keep a word when it does not occur before its position.
    uniq = f"list_transform([{caps}], lambda a: list_filter(a, lambda w, i: list_position(a, w) = i))[1]"
    title = f"array_to_string(list_transform(string_split({R.strip(c)}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    return f"coalesce(nullif(array_to_string({uniq}, ' '), ''), {title})"


@query("clean_name", f"""WITH {RAW_NAMES_SQL}, x AS (SELECT c_custkey, raw, CASE WHEN raw <> '' THEN {clean_name_sql('raw')} END AS n FROM raw_names)
SELECT c_custkey, CASE WHEN n IS NOT NULL THEN {reorder_sql('n')} END AS name FROM x""")
def clean_name(spark, d):
    return raw_names(spark, d).select("c_custkey", N.clean_name(F.col("raw"), GIVEN, FIXES).alias("name"))


_BAD = "(" + " OR ".join(f"contains(lower(p), '{w}')" for w in N.BAD_WORDS) + ")"


@query("best_name_candidate", C(f""", a AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}]', '_', 'g'), '[^\\x00-\\x7F]', ' ', 'g'),
  {quote(N.PHRASE.replace('*+', '*'))}, 1) AS ps FROM c),
p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM a),
s AS (SELECT doc_id, p, i, CASE WHEN n BETWEEN 2 AND 3 THEN 2 WHEN n = 1 THEN 1 ELSE 0 END + CASE WHEN length(p) BETWEEN 6 AND 30 THEN 1 ELSE 0 END
  + CASE WHEN {_BAD} THEN 0 ELSE 1 END AS score FROM (SELECT *, len(regexp_split_to_array(p, '[ \\t]+')) AS n FROM p)),
b AS (SELECT doc_id, arg_max(p, score * 1000000 - i) AS best_name FROM s WHERE score > 0 GROUP BY doc_id)
SELECT c.doc_id, best_name FROM c LEFT JOIN b USING (doc_id)"""))
def best_name_candidate(spark, d):
    return corpus(spark, d).select("doc_id", N.best_name(F.col("text")).alias("best_name"))


# ---- classification and routing ----


def flag_sql(group: str) -> str:
    return R.rx("text", "|".join(f"(?:{p})" for p in K.FLAG_PATTERNS[group]), True)


def _ratio_sql(p: str) -> str:
    return f"CASE WHEN text <> '' THEN CAST(length(text) - length(regexp_replace(text, {quote(p)}, '', 'g')) AS DOUBLE) / CAST(length(text) AS DOUBLE) ELSE 0.0 END"


@query("text_features", C(f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS word_count,
  CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS INTEGER) AS line_count,
  {_ratio_sql(chr(92) + 'p{Nd}')} AS digit_ratio, {_ratio_sql(chr(92) + 'p{Lu}')} AS upper_ratio, {_ratio_sql('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]')} AS special_char_ratio,
  {', '.join(f'{flag_sql(g)} AS has_{g}_pattern' for g in K.FLAG_PATTERNS)},
  {R.rx('text', K.SCRIPTS['hindi'])} AS has_hindi_text, {R.rx('text', K.SCRIPTS['arabic'])} AS has_arabic_text FROM c"""))
def text_features(spark, d):
    return K.text_features(corpus(spark, d)).drop("text")


def _kw_score(pos, neg) -> str:
    return " + ".join(f"CAST({R.contains('low', w)} AS INTEGER) * 2" for w in pos) + "".join(f" - CAST({R.contains('low', w)} AS INTEGER)" for w in neg)


CK_SQL = "ck AS (SELECT doc_id, type, s / 2 AS score, least(s / 2 / 2, 1.0) AS confidence FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS type, {_kw_score(p, n)} AS s FROM c" for t, p, n in K.KEYWORD_RULES) + ") WHERE least(s / 2 / 2, 1.0) > 0.3::DOUBLE)"
CN_SQL = "cn AS (SELECT doc_id, type, m AS matches, m / n AS confidence FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS type, {' + '.join(f'CAST({R.rx("text", p, True)} AS INTEGER)' for p in ps)} AS m, {len(ps)} AS n FROM c" for t, ps in K.NUMBER_RULES) + ") WHERE m > 0)"


@query("classify_keywords", C(f", {CK_SQL} SELECT * FROM ck"))
def classify_keywords(spark, d):
    return K.classify_keywords(corpus(spark, d), "doc_id")


@query("classify_number_patterns", C(f", {CN_SQL} SELECT * FROM cn"))
def classify_number_patterns(spark, d):
    return K.classify_numbers(corpus(spark, d), "doc_id")


MERGED_SQL = f"""{CK_SQL}, {CN_SQL}, u AS (SELECT doc_id, type, confidence, 'text_features' AS f FROM ck UNION ALL SELECT doc_id, type, confidence, 'number_patterns' FROM cn),
g AS (SELECT doc_id, type, sum(confidence) / count(*) AS confidence, string_agg(f, '|' ORDER BY f) AS features FROM u GROUP BY ALL),
merged AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, type) AS INTEGER) AS rank FROM g)"""


def merged(spark, d):
    c = corpus(spark, d)
    return K.merge_classifications(K.classify_keywords(c, "doc_id"), K.classify_numbers(c, "doc_id"), "doc_id")


@query("merge_classifications", C(f", {MERGED_SQL} SELECT * FROM merged WHERE rank <= 3"))
def merge_classifications(spark, d):
    return merged(spark, d)


@query("topk_per_document", C(f", {MERGED_SQL} SELECT doc_id, type, confidence FROM merged WHERE rank <= 1"))
def topk_per_document(spark, d):
    from scanmill.operators.ranking import top_k_per

    return top_k_per(merged(spark, d).drop("rank"), "doc_id", [F.desc("confidence"), F.asc("type")], 1).select("doc_id", "type", "confidence")


def _cascade_sql() -> str:
    kind = "CASE " + " ".join(f"WHEN {R.count_hits(ws, 'low')} > 0 THEN {quote(t)}" for t, ws, _ in K.CASCADE) + " ELSE 'Other Document' END"
    g = {"Aadhaar Card": "aadhaar", "PAN Card": "pan"}
    conf = "CASE " + " ".join(
        f"WHEN {R.count_hits(ws, 'low')} > 0 THEN {f'CASE WHEN {flag_sql(g[t])} THEN 0.9 ELSE {p} END' if t in g else p}" for t, ws, p in K.CASCADE
    ) + " ELSE 0.4 END"
    return f"{kind} AS document_type, CAST({conf} AS DOUBLE) AS confidence"


@query("classify_cascade", C(f"SELECT doc_id, {_cascade_sql()} FROM c"))
def classify_cascade(spark, d):
    return K.classify_cascade(corpus(spark, d)).drop("text")


def _coarse_sql() -> str:
    alt = lambda ps: R.rx("text", "|".join(f"(?:{p})" for p in ps), True)
    return f"""CASE WHEN {alt(K.COARSE_ID_PATTERNS)} THEN 'id_card' WHEN {alt(K.COARSE_LICENSE_PATTERNS)} THEN 'driving_license'
  WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 40 AND length(x) - length(replace(x, '<', '')) >= 5)) > 0 THEN 'passport'
  WHEN {R.count_hits(K.COARSE_PASSPORT, 'low')} > 0 THEN 'passport' WHEN {R.count_hits(K.COARSE_ID, 'low')} > 0 THEN 'id_card'
  WHEN {R.count_hits(K.COARSE_LICENSE, 'low')} > 0 THEN 'driving_license' ELSE 'other' END"""


@query("detect_type_coarse", C(f"SELECT doc_id, {_coarse_sql()} AS document_type FROM c"))
def detect_type_coarse(spark, d):
    return corpus(spark, d).select("doc_id", K.detect_type("text").alias("document_type"))


ROUTE_SQL = "routed AS (SELECT doc_id, text, low, CASE " + " ".join(f"WHEN {R.predicate(p.detect)} THEN '{p.code}'" for p in PACKS) + " END AS pack FROM c)"


@query("detect_processor_priority", C(f", {ROUTE_SQL} SELECT doc_id, pack FROM routed"))
def detect_processor_priority(spark, d):
    return K.route_document(corpus(spark, d)).select("doc_id", "pack")


@query("detect_processor_specific", C(", s AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{p.code}' AS code, {R.criteria(p.detect)} * 100 - {i} AS score FROM c WHERE {R.predicate(p.detect)}" for i, p in enumerate(PACKS)
) + ") SELECT c.doc_id, arg_max(code, score) AS pack FROM c LEFT JOIN s USING (doc_id) GROUP BY c.doc_id"))
def detect_processor_specific(spark, d):
    return K.route_document(corpus(spark, d), order="specific").select("doc_id", "pack")


def _global_sql() -> str:
    parts = []
    for country, kind, _, _, words, shapes, marks in COUNTRY_RULES:
        n = R.count_hits([w.lower() for w in [*words, *marks]], "low") + "".join(f" + CAST({R.rx('text', K.java_digits(p), True)} AS INTEGER)" for p in shapes)
        parts.append(f"CASE WHEN {n} >= 2 THEN {quote(f'{country}/{kind}')} END")
    return "concat_ws('|', " + ", ".join(parts) + ")"


@query("detect_global_types", C(f"SELECT doc_id, {_global_sql()} AS global_types FROM c"))
def detect_global_types(spark, d):
    return K.detect_global(corpus(spark, d), COUNTRY_RULES).select("doc_id", F.array_join("global_types", "|").alias("global_types"))


@query("script_flags", C("SELECT doc_id, " + ", ".join(f"{R.rx('text', p)} AS has_{n}" for n, p in K.SCRIPTS.items()) + " FROM c"))
def script_flags(spark, d):
    return K.script_flags(corpus(spark, d)).drop("text")


# ---- extraction ----


def _pack_rows_sql(p) -> str:
    """Long rows of the regex fields of one pack on its routed documents."""
    t = R.pack_text(p)
    items = ", ".join(f"{{'field': '{f.name}', 'value': {R.field_value(f, 't')}}}" for f in p.fields)
    return f"SELECT doc_id, pack, x.field AS field, x.value AS value FROM (SELECT doc_id, pack, unnest([{items}]) AS x FROM (SELECT doc_id, pack, {t} AS t FROM routed WHERE pack = '{p.code}')) WHERE x.value IS NOT NULL"


EXTRACT_SQL = f"{ROUTE_SQL}, fields AS (" + " UNION ALL ".join(_pack_rows_sql(p) for p in PACKS) + ")"


def routed_fields(spark, d):
    return K.extract_routed(K.route_document(corpus(spark, d)))


_NEXT_LINE = "list_transform(string_split(text, chr(10)), lambda x: trim(x))"


def _fields_sql(routed: str) -> str:
    return C(f""", {routed}, fields AS ({" UNION ALL ".join(_pack_rows_sql(p) for p in PACKS)}), {ADDRESS_SQL},
next_line AS (SELECT doc_id, {_NEXT_LINE}[list_position(list_transform({_NEXT_LINE}, lambda x: contains(lower(x), 'addr')), true) + 1] AS address FROM c)
SELECT * FROM fields
UNION ALL SELECT doc_id, pack, 'address', address FROM routed JOIN addr USING (doc_id) WHERE pack IN ({sql_list(K.ADDRESS_PACKS)[1:-1]}) AND address IS NOT NULL
UNION ALL SELECT doc_id, pack, 'address', address FROM routed JOIN next_line USING (doc_id) WHERE pack IN ({sql_list(K.NEXT_LINE_PACKS)[1:-1]}) AND address IS NOT NULL""")


@query("extract_fields", _fields_sql(ROUTE_SQL))
def extract_fields(spark, d):
    """Every field of every pack that has a value."""
    return routed_fields(spark, d).select("doc_id", "pack", F.explode_outer("fields").alias("field", "value")).filter("value IS NOT NULL")


RECOGNISED_SQL = "routed AS (" + " UNION ALL ".join(f"SELECT doc_id, text, low, '{p.code}' AS pack FROM c WHERE {R.predicate(p.detect)}" for p in PACKS) + ")"


@query("extract_fields_by_pack", _fields_sql(RECOGNISED_SQL))
def extract_fields_by_pack(spark, d):
    """All fourteen packs, each on every document that it recognises, not only on the first pack's."""
    e = K.extract_routed(K.recognised_packs(corpus(spark, d)))
    return e.select("doc_id", "pack", F.explode_outer("fields").alias("field", "value")).filter("value IS NOT NULL")


@query("first_match_wins", C(f", {EXTRACT_SQL} SELECT doc_id, value AS document_number FROM fields WHERE pack = 'voter_id' AND field = 'document_number'"))
def first_match_wins(spark, d):
    """One pack as a wide table: the first pattern that matches gives the value."""
    p = next(p for p in PACKS if p.code == "voter_id")
    number = F.when(F.col("pack") == p.code, K.pack_fields(p, "text")["document_number"])
    # A filter on the pack or the value would be pushed below and evaluate both again on every text.
    found = K.route_document(corpus(spark, d)).select("doc_id", F.explode_outer(F.array(number)).alias("document_number"))
    return found.filter("document_number IS NOT NULL")


def _met(names: str, pattern: str) -> str:
    """Some alternative has all its fields matching."""
    one = lambda n: f"coalesce(bool_or(field = '{n}' AND {R.rx('value', pattern)}), FALSE)"
    return " OR ".join("(" + " AND ".join(one(n) for n in alt.split("&")) + ")" for alt in names.split("|"))


def _confidence_sql() -> str:
    sums = {p.code: " + ".join(f"CASE WHEN {_met(ns, rx)} THEN {round(w * 100)} ELSE 0 END" for w, ns, rx in (p.weights or DEFAULT_WEIGHTS)) for p in PACKS}
    conf = "CASE pack " + " ".join(f"WHEN '{c}' THEN least({x}, 100) / 100" for c, x in sums.items()) + " END"
    limit = "CASE pack " + " ".join(f"WHEN '{p.code}' THEN {p.threshold}::DOUBLE" for p in PACKS) + " END"
    return f"""{EXTRACT_SQL}, {ADDRESS_SQL}, allf AS (SELECT doc_id, field, value FROM fields UNION ALL SELECT doc_id, 'address', address FROM addr),
g AS (SELECT r.doc_id, r.pack, {conf} AS confidence FROM routed r LEFT JOIN allf USING (doc_id) GROUP BY r.doc_id, r.pack)
SELECT *, CASE WHEN confidence > {limit} THEN 'high' WHEN confidence IS NOT NULL THEN 'medium' END AS level FROM g"""


@query("extraction_confidence", C(f", {_confidence_sql()}"))
def extraction_confidence(spark, d):
    e = K.extraction_confidence(routed_fields(spark, d))
    return e.select("doc_id", "pack", "confidence", "level")


@query("route_counts", C(f", {ROUTE_SQL} SELECT pack, count(*) AS documents FROM routed GROUP BY pack"))
def route_counts(spark, d):
    return K.route_document(corpus(spark, d)).groupBy("pack").agg(F.count("*").alias("documents"))


_GNUM = {f"{r[0]}/{r[1]}": G.number_pattern(r) for r in COUNTRY_RULES}


@query("extract_fields_global", C(f""", g AS (SELECT doc_id, text, string_split({_global_sql()}, '|') AS matched FROM c),
x AS (SELECT doc_id, text, unnest(matched) AS rule, {R.strip(f"regexp_extract(text, {quote(G.NAME_LABELLED)}, 1)")} AS n FROM g WHERE matched[1] <> '')
SELECT doc_id, rule, nullif({R.strip('CASE rule ' + ' '.join(f"WHEN {quote(r)} THEN regexp_extract(text, {quote('(?i)' + p)}, 0)" for r, p in _GNUM.items()) + ' END')}, '') AS document_number,
  CASE WHEN length(n) > 2 THEN n END AS full_name,
  coalesce(nullif(regexp_extract(text, {quote(G.DATE_LABELLED)}, 1), ''), nullif(regexp_extract(text, {quote(G.DATE_BARE)}, 1), '')) AS date_of_birth,
  gender FROM x JOIN ({GENDER_SQL}) USING (doc_id)"""))
def extract_fields_global(spark, d):
    """Every country rule that matches a document is a row."""
    return G.extract_global(corpus(spark, d), COUNTRY_RULES)
