"""Identity documents rendered from the customer table, and the text corpus made of them and the documents table.

Each customer becomes one document text: a template picked by key, filled with names, numbers and
dates derived from the key. The rows grow with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.functions.rules import sql_array, words
from scanmill.sources.tables import spread, table

ID_OFFSET = 1_000_000_000
#: Several tasks a core, as the templates differ in cost.
TASKS_PER_CORE = 4

GIVEN = ["Rajesh", "Mohammed", "Sara", "John", "Marie", "Ahmed", "Yuki", "Anna", "Liora", "Carlos", "Ünal"]
SURNAMES = ["Kumar", "Hassan", "Smith", "Dupont", "Müller", "Sharma", "Tanaka", "Garcia", "Tamlin", "Rossi", "O'Neil", "Lee", "Kllllk"]
CITIES = ["Mumbai", "Dubai", "London", "Paris", "Berlin", "Toronto", "Sydney", "Osaka", "Madrid"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
SEXES = ["M", "F", "Male", "Female", "X"]
LETTERS = list("ABCDEFGHJKLMNPQRSTUVWXYZ")

TEMPLATES = [
    "Government of India\nआधार\nAadhaar\n{n4} {m4} {o4}\n{G} {S}\nपुरुष\nMALE\nजन्म तिथि\nDOB: {dmy}\nAddress:\n12 Lake Road, {city}\nTest City, Test State - {n6}\nissued by UIDAI",
    "United Arab Emirates\nالإمارات العربية المتحدة\nIdentity Card\n784-{y}-{n7}-{d1}\n{G} {S}\nDate of Birth: {dmy}\nExpiry Date: {exp}",
    "UNITED ARAB EMIRATES\nEMIRATES ID\n784 {y} {n7} {d1}\nName: {G} {S}\nDate of Birth: {dmy}\nGender: {sex}\nNationality: UAE\nExpiry: {exp}",
    "REPUBLIC OF INDIA\nPASSPORT\nPassport No: {L}{n7}\nSurname/उपनाम\n{S}\nGiven Name: {G}\nNationality: INDIAN\nSex: {sex}\nDate of Birth: {dmy}\nPlace of Birth: {city}\nDate of Issue: {dd} {mon} 2015\nDate of Expiry: {exp}",
    "GOVERNMENT OF INDIA\nDRIVING LICENCE\nDL Number: DL-{n4}{m4}{o4}\nName: {G} {S}\nDOB: {dmy}\nValid Till: {exp}\nClass of Vehicle: LMV\nBlood Group: B+",
    "TRANSPORT DEPARTMENT\nDL NO: KA{n4}{m4}{o4}{d1}\nName: {G} {S}\nS/o {S} {G}\nDOB: {dmy}\nAddress: {n4} Hill Street\n{city} Main Post\nIssue Date: {dmy}\nValidity: {exp}\nClass of Vehicle: LMV",
    "CALIFORNIA\nDRIVER LICENSE\nDL {L}{n7}\nLN {S}\nFN {G}\nDOB {mdy}\n123 MAIN ST\n{city}, CA {n5}\nEXP {mdy}\nClass C\nSEX {sex}\nEYES BRN\nHAIR BLK\nHT 5'-09\"\nWT 165",
    "PASSPORT\nSurname: {S}\nGiven Names: {G}\nDate of Birth: {dd} {mon} {y}\nP<USA{S}<<{G}<<<<<<<<<<<<<<<<<<<<<<<<<<<\n{L}{M}{n7}USA{yy}{mm}{dd}9M3006018<<<<<<<<<<<<<<04",
    "UNITED STATES OF AMERICA\nU.S. CITIZENSHIP AND IMMIGRATION SERVICES\nPERMANENT RESIDENT CARD\nSurname: {S}\nGiven Name: {G}\nA{n9}\nCard Number: ABC{n7}{d1}{d1}{d1}\nCategory: IR1\nCountry of Birth: Canada\nResident Since: {mdy}\nCard Expires: {mdy}\nSex: {sex}",
    "P<GBR{S}<<{G}<<<<<<<<<<<<<<<<<<<<<<<<<<\nUNITED KINGDOM OF GREAT BRITAIN AND NORTHERN IRELAND\nPASSPORT\nSurname: {S}\nGiven Names: {G}\nNationality: British\nDate of Birth: {dmy}\nPlace of Birth: {city}\nSex: {sex}\nDate of Issue: {dmy}\nDate of Expiry: {exp}\nHM Passport Office",
    "CANADA\nPASSPORT\nPASSEPORT\nGovernment of Canada\nSurname: {S}\nGiven Names: {G}\nNationality: Canadian\nDate of Birth: {dmy}\nDate of Expiry: {exp}\nPlace of Birth: {city}",
    "AUSTRALIA\nPASSPORT\nCommonwealth of Australia\nSurname: {S}\nGiven Names: {G}\nNationality: Australian\nDate of Birth: {dmy}\nSex: {sex}\nExpires: {exp}",
    "DEUTSCHER REISEPASS\nFamilienname: {S}\nVorname: {G}\nStaatsangehörigkeit: Deutsch\nGeburtsdatum: {dd}.{mm}.{y}\nGeburtsort: {city}\nGeschlecht: {sex}\nGültig bis: {dd}.{mm}.2031",
    "Bundesrepublik Deutschland\nPersonalausweis\nName: {S}\nVornamen: {G}\nGeburtsdatum: {dd}.{mm}.{y}\nID: {L}{n8}\nGültig bis: {dd}.{mm}.2030\nIssuing Authority: Stadt {city}",
    "INCOME TAX DEPARTMENT\nPermanent Account Number\nABCD{L}{n4}{M}\nName: {G} {S}\nFather's Name: {S} {G}\nDate of Birth: {dmy}\nSignature",
    "ELECTION COMMISSION OF INDIA\nElector's Photo Identity Card\n{L}{M}X{n7}\nElector Name: {G} {S}\nHusband's Name: {S} {G}\nAge: {age}\nSex: {sex}\nHouse No: {n4}/2\nPart No: 12\nSerial No: {n4}",
    "日本\nマイナンバーカード\n個人番号: {n4} {m4} {o4}\n氏名: 田中 太郎\nフリガナ: タナカ タロウ\n生年月日: {y}年{mm}月{dd}日\n性別: 男\n住所: 東京都千代田区千代田1-1\n有効期限: 2030年{mm}月{dd}日\n総務省",
    "REPÚBLICA ARGENTINA\nDocumento Nacional de Identidad\nNombre: {G}\n{n8}\nNacimiento: {dmy}\nSexo {sex}",
    "Republic of Singapore\nNational Registration Identity Card\nS{n7}{L}\nName: {G} {S}\nDate of birth {dd}-{mm}-{y}\nSex: {sex}",
    "Invoice from {G} {S}\nContact: {g}.{n4}@example.com or +91 9{n9}\nShip to {city} {n5}\nTotal due by {mon} {dd}, 2024",
    "SAMPLE SPECIMEN\nName: {G} {S}\nBirth date {mon} {dd} {y}\nValid until {exp}\nNationality: {city}",
    "EUROPEAN UNION\nIDENTITY CARD\nFrance\nFR{n7}\nSurname: {S}\nGiven Names: {G}\nDate of Birth: {dd}.{mm}.{y}\nPlace of Birth: {city}\nSex: {sex}\nNationality: French\nDate of Issue: {dd}.{mm}.2019\nDate of Expiry: {dd}.{mm}.2029\nIssuing Authority: Prefecture of {city}",
    "REPUBLIC OF INDIA\nType: P\nCountry Code: IND\nPassport No: {L}{n7}\nSurname: {S}\nGiven Name: {G}\nNationality: INDIAN\nDate of Birth: {dmy}\nSex: {sex}\nPlace of Birth: {city}\nPlace of Issue: {city}\nDate of Issue: {dmy}\nDate of Expiry: {exp}\nFile No: BO{n7}/15",
    "日本\nマイナンバーカード\n個人番号: {n4} {m4} {o4}\n氏名: 佐藤 花子\nフリガナ: サトウ ハナコ\n生年月日: {y}年{mm}月{dd}日\n性別: 女\n住所: 大阪府大阪市北区梅田2-2\n発行日: 2020年{mm}月{dd}日\n有効期限: 2030年{mm}月{dd}日\nデジタル庁",
    "name: {G}\n<script>alert('{S}')</script>\nselect * from users where 1 = 1",
]

# Value expressions as (Spark SQL, DuckDB SQL) over the customer key k.
_VALUES = {
    "dd": "lpad(cast(k % 28 + 1 as {s}), 2, '0')",
    "mm": "lpad(cast(k % 12 + 1 as {s}), 2, '0')",
    "y": "cast(1950 + k % 55 as {s})",
    "yy": "lpad(cast((1950 + k % 55) % 100 as {s}), 2, '0')",
    "n4": "lpad(cast((k * 37 + 13) % 10000 as {s}), 4, '0')",
    "m4": "lpad(cast((k * 53 + 7) % 10000 as {s}), 4, '0')",
    "o4": "lpad(cast((k * 71 + 3) % 10000 as {s}), 4, '0')",
    "n5": "lpad(cast((k * 97 + 11) % 100000 as {s}), 5, '0')",
    "n6": "lpad(cast((k * 101 + 17) % 1000000 as {s}), 6, '0')",
    "n7": "lpad(cast((k * 7919 + 31) % 10000000 as {s}), 7, '0')",
    "n8": "lpad(cast((k * 7919 + 101) % 100000000 as {s}), 8, '0')",
    "n9": "lpad(cast((k * 104729 + 5) % 1000000000 as {s}), 9, '0')",
    "d1": "cast(k % 10 as {s})",
    "age": "cast(k % 130 as {s})",
    "dmy": "lpad(cast(k % 28 + 1 as {s}), 2, '0') || '/' || lpad(cast(k % 12 + 1 as {s}), 2, '0') || '/' || cast(1950 + k % 55 as {s})",
    "mdy": "lpad(cast(k % 12 + 1 as {s}), 2, '0') || '/' || lpad(cast(k % 28 + 1 as {s}), 2, '0') || '/' || cast(1950 + k % 55 as {s})",
    "exp": "lpad(cast(k % 28 + 1 as {s}), 2, '0') || '/' || lpad(cast(k % 12 + 1 as {s}), 2, '0') || '/' || cast(2018 + k % 15 as {s})",
}
_PICKS = {
    "G": (GIVEN, 1, str.upper), "g": (GIVEN, 1, str.lower), "S": (SURNAMES, 3, str.upper), "city": (CITIES, 5, str), "mon": (MONTHS, 1, str),
    "sex": (SEXES, 7, str), "L": (LETTERS, 11, str), "M": (LETTERS, 17, str),
}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spark_value(name: str) -> str:
    if name in _VALUES:
        return _VALUES[name].format(s="string")
    items, step, case = _PICKS[name]
    return f"element_at({sql_array([case(x) for x in items])}, int((k * {step}) % {len(items)} + 1))"


def _sql_value(name: str) -> str:
    if name in _VALUES:
        return _VALUES[name].format(s="varchar")
    items, step, case = _PICKS[name]
    return f"[{', '.join(quote(case(x)) for x in items)}][(k * {step}) % {len(items)} + 1]"


def _parts(template: str) -> list[tuple[bool, str]]:
    """Split into (is placeholder, text)."""
    return [(bool(i % 2), p) for i, p in enumerate(re.split(r"\{(\w+)\}", template)) if p]


def identity_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity document of each customer."""
    return rendered(table(spark, sf_dir, "customer"))


def rendered(customers: DataFrame) -> DataFrame:
    """Template of the key with every placeholder replaced by its value, for a table or a stream of customers.

    The keys are dealt to all cores first: a key is a few bytes in the file and much work as a text, so the splits
    of the file say nothing about the work, and a file with one row group would leave it all to one task.
    """
    names = sorted({p for tpl in TEMPLATES for ph, p in _parts(tpl) if ph})
    pairs = ", ".join(f"named_struct('name', '{{{n}}}', 'value', {_spark_value(n)})" for n in names)
    values = F.expr(f"array({pairs})")
    template = F.element_at(words(TEMPLATES), (F.col("k") % len(TEMPLATES) + 1).cast("int"))
    text = F.aggregate(values, template, lambda t, v: F.replace(t, v["name"], v["value"]))
    return dealt(customers.select(F.col("c_custkey").alias("k"))).select((F.col("k") + ID_OFFSET).alias("doc_id"), text.alias("text"))


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, several tasks each."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


IDENTITY_SQL = (
    "identity_docs AS (SELECT k + "
    + str(ID_OFFSET)
    + f" AS doc_id, CASE k % {len(TEMPLATES)} "
    + " ".join(
        f"WHEN {i} THEN " + " || ".join(f"({_sql_value(p)})" if ph else quote(p) for ph, p in _parts(tpl)) for i, tpl in enumerate(TEMPLATES)
    )
    + " END AS text FROM (SELECT c_custkey AS k FROM customer))"
)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents table and the rendered identity documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.unionByName(identity_docs(spark, sf_dir))


CORPUS_SQL = f"{IDENTITY_SQL}, corpus AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM identity_docs)"
