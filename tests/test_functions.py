"""Hand-derived values of the text functions."""

import pytest
from pyspark.sql import functions as F

from scanmill.functions import classify as K
from scanmill.functions import dates as Dt
from scanmill.functions import document_info as DI
from scanmill.functions import identifiers as I
from scanmill.functions import names as N
from scanmill.functions import quality as Q
from scanmill.functions import screening as X
from scanmill.functions.extension import pack_from_json, pack_to_json, register_pack
from scanmill.functions.packs import PACKS
from scanmill.operators import filters as Fi
from scanmill.operators import memory as M


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "fn, pairs",
    [
        (Dt.normalize_date, [
            ("15 JAN 1985", "15/01/1985"), ("2020.06.01", "01/06/2020"), ("20200601", "01/06/2020"), ("850115", "15/01/1985"),
            ("1/2/49", "01/02/2049"), ("1/2/50", "01/02/1950"), ("Jan 5, 2020", "05/01/2020"), ("03/25/2020", "03/25/2020"),
            ("unknown", "unknown"), ("", None), (None, None), ("5 Xyz 2020", None),
        ]),
        (Dt.normalize_date_strict, [("15 January 1985", "15/01/1985"), ("2020-6-1", "01/06/2020"), ("40/01/2020", "40/01/2020"), ("1.2.1999", "01/02/1999")]),
        (Dt.mrz_date, [("300601", "01/06/2030"), ("310601", "01/06/1931"), ("x", "x")]),
        (Dt.japanese_era_date, [("H31.4.30", "30/04/2019"), ("R1.5.1", "01/05/2019"), ("2020年1月2日", "02/01/2020")]),
        (I.clean_document_number, [("AB1234567", "AB1234567"), ("Passport No: AB1234567", "AB1234567"), ("784-1990-1234567-8", "784-1990-1234567-8"), ("KA123456", "KA123456"), ("", None)]),
        (I.format_emirates_id, [("ID 784 1990 1234567 8", "784-1990-1234567-8"), ("none", None)]),
        (lambda c: N.reorder_name(c, ["LIORA"], {"KLIORA": "LIORA"}), [("TAMLIN LIORA", "LIORA TAMLIN"), ("KLIORA", "LIORA"), ("Jane Doe", "Jane Doe"), ("", "")]),
        (N.clean_name, [("Mr. JOHN smith smith", "John Smith"), ("Name: lllll Anna", "Anna"), (None, None)]),
        (N.best_name, [("the Passport Office of John Michael Smith", "John Michael Smith"), ("nothing here", None)]),
        (I.extract_place, [("Place of birth: new delhi\nx", "New Delhi"), ("no such thing", None)]),
        (I.gender_code, [("Sex: Female", "F"), ("M", "M"), ("none given", None)]),
        (X.sanitize_filename, [("../a?b..pdf", "_a_b.pdf"), ("", "unnamed_file"), (None, "unnamed_file")]),
        (X.sanitize_text, [("<b>hi</b> javascript:x", "hi x"), ("a\x00b", "ab")]),
        (I.email_valid, [("a.b@x.org", True), ("a@b", False)]),
        (I.ip_valid, [("10.0.0.1", True), ("256.1.1.1", False), ("::1", True), ("fe80::1:2", True), ("x", False)]),
        (I.address_block, [("Name\nAddress: 1 Long Road\nSecond street\nIssue date", "1 Long Road Second street"), ("none", None)]),
    ],
)
def test_values(spark, fn, pairs):
    assert values(spark, fn, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_nationality_prefers_whole_words_in_table_order(spark):
    fn = lambda c: I.nationality(c, [("AAA", "land"), ("BBB", "finland"), ("CCC", "chile")])
    assert values(spark, fn, ["from Finland", "Chile and Finland", "islands", "nowhere"]) == ["BBB", "BBB", "AAA", "UNKNOWN"]


# Texts and the pack that takes them: first-match order, and the most matched criteria.
ROUTES = [
    ("Government of India\nAadhaar\n1234 5678 9012", "aadhaar", "aadhaar"),
    ("UNITED ARAB EMIRATES\nEMIRATES ID\n784-2020-1234567-8", "emirates_id", "emirates_id"),
    ("REPUBLIC OF INDIA\nPASSPORT\nPassport No.\nA1234567\nSurname\nSHARMA\nNationality", "australian_passport", "passport"),
    ("CALIFORNIA\nDRIVER LICENSE\nDL A1234567\nEXP 01/15/2025\nClass C", "us_drivers_license", "us_drivers_license"),
    ("PERMANENT RESIDENT CARD\nA123456789", "us_green_card", "us_green_card"),
    ("P<GBRGBR<\nUNITED KINGDOM OF GREAT BRITAIN AND NORTHERN IRELAND\nPASSPORT\nNationality BRITISH", "uk_passport", "uk_passport"),
    ("AUSTRALIA\nPASSPORT\nCommonwealth of Australia\nPassport No A12345678", "eu_id_card", "australian_passport"),
    ("nothing to see", None, None),
]


def test_routing_orders(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(ROUTES)], "i int, text string")
    got = [(r["first"], r["specific"]) for r in K.route_document(K.route_document(df).withColumnRenamed("pack", "first"), order="specific").withColumnRenamed("pack", "specific").orderBy("i").collect()]
    assert got == [(a, b) for _, a, b in ROUTES]


def test_extraction_and_confidence(spark):
    text = "INCOME TAX DEPARTMENT\nName: RAVI KUMAR\nFather's Name: MOHAN KUMAR\nDate of Birth: 1/2/1990\nABCDE1234F"
    df = K.extraction_confidence(K.extract_routed(K.route_document(spark.createDataFrame([(text,)], "text string"))))
    r = df.collect()[0]
    assert r["pack"] == "pan_card"
    assert r["fields"] == {"document_number": "ABCDE1234F", "full_name": "RAVI KUMAR", "father_name": "MOHAN KUMAR", "date_of_birth": "01/02/1990"}
    assert (r["confidence"], r["level"]) == (1.0, "high")


def test_document_info(spark):
    text = "PASSPORT\nSurname: SMITH\nGiven names: JOHN MICHAEL\nNationality: canada\nDate of birth: 15 JAN 1985\nPlace of birth: toronto\nSex: M\nPassport No: AB1234567"
    r = DI.document_info(spark.createDataFrame([(text,)], "text string"), I.country_table()).collect()[0]
    assert r["document_type"] == "passport"
    assert r["full_name"] == "John Michael Smith"
    assert r["date_of_birth"] == "15/01/1985"
    assert (r["nationality"], r["gender"], r["document_number"]) == ("CAN", "M", "AB1234567")


def test_fraud_scores(spark):
    df = spark.createDataFrame([(1, [], []), (2, ["x"], [])], "i int, indicators array<string>, security_features array<string>")
    a, b = X.fraud_scores(df).orderBy("i").collect()
    assert (a["fraud_score"], a["authenticity_score"], a["fraud_risk_level"], a["validation_passed"]) == (0.0, 0.5, "LOW", True)
    assert (b["fraud_score"], round(b["authenticity_score"], 6), b["fraud_risk_level"], b["validation_passed"]) == (0.2, 0.35, "MEDIUM", False)


def test_field_confidence_and_batch_quality(spark):
    df = spark.createDataFrame(
        [({"full_name": "Jane Doe", "dob": None, "processor": "x"}, [], False), ({"full_name": "Jane Doe"}, ["full_name"], False)],
        "fields map<string,string>, corrected array<string>, validated boolean",
    )
    rows = {(r["field"], r["method"]): r["confidence"] for r in Q.field_confidence(df, []).collect()}
    assert rows == {("full_name", "regex_match"): 0.8, ("dob", "regex_match"): 0.0, ("full_name", "vision_corrected"): 0.85}
    q = spark.createDataFrame([(0.95, 85.0, {"a": "x", "b": "y"})], "c double, o double, f map<string,string>")
    assert round(Q.batch_quality(q, "c", "o", "f").collect()[0]["quality"], 4) == 0.9333


def test_json_payload(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": "drop table x"}',), ('{"password": "drop table x"}',), ("{",), ("[" * 12 + "1" + "]" * 12,)], "p string")
    assert [r["reason"] for r in sorted(X.json_payload_scan(df, "p").collect(), key=lambda r: len(r["p"]))] == ["invalid", "ok", "malicious", "too deep", "ok"]


def test_filters_reject_unknown(spark):
    df = spark.createDataFrame([(1, "a_b")], "n int, s string")
    for spec in ({"zzz": 1}, {"n": {"$bad": 1}}):
        with pytest.raises(ValueError):
            Fi.apply_filters(df, spec)
    assert Fi.apply_filters(df, {"s": {"$like": "a_b"}}).count() == 1
    assert Fi.apply_filters(df, {"s": {"$like": "a%"}}).count() == 0
    with pytest.raises(ValueError):
        Fi.order_by_spec(df, "n SIDEWAYS")


def test_pack_round_trip():
    for p in PACKS:
        assert pack_from_json(pack_to_json(p)).code == p.code
    with pytest.raises(ValueError):
        register_pack(PACKS[0])


def test_payloads_of_any_size_and_depth_are_scanned(spark):
    big = '{"notes": [' + ", ".join(['"plain words %d"' % i for i in range(260_000)]) + ', "javascript: x"], "password": {"a": "eval(1)"}}'
    cases = [
        (1, big, ("too large", 1, 2, True)),
        (2, "[" * 40 + '"../x"' + "]" * 40, ("too deep", 1, 40, False)),
        (3, '{"onload =": 1, "file": {"onload =": "eval(1)"}, "n": 1, "b": null, "img": "data:image eval(1)"}', ("malicious", 1, 2, False)),
        (4, "[1,", ("invalid", 0, None, False)),
        (5, None, (None, None, None, None)),
        (6, '"eval(1)"', ("malicious", 1, 0, False)),
        (7, "{}", ("ok", 0, 0, False)),
        (7, "{}", ("ok", 0, 0, False)),
    ]
    df = X.json_payload_scan(spark.createDataFrame([c[:2] for c in cases], "k int, p string").repartition(3), "p")
    assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()
    assert len(big) > 5 << 20
    got = sorted((r["k"], (r["reason"], r["hits"], r["depth"], r["too_large"])) for r in df.collect())
    assert got == [(k, want) for k, _, want in cases]


def test_every_matching_country_rule_is_a_row(spark):
    from scanmill.functions.catalogue import COUNTRY_RULES
    from scanmill.functions.global_fields import extract_global

    text = "Reino de España\nDocumento Nacional de Identidad DNI 12345678Z\nNombre: Ana Ruiz\nNacimiento: 01/02/1990\nSexe: femme"
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.rule): r for r in extract_global(docs, COUNTRY_RULES).collect()}
    assert {k for k in got} >= {(1, "Spain/dni"), (1, "Argentina/dni")} and {k[0] for k in got} == {1}
    spain, argentina = got[1, "Spain/dni"], got[1, "Argentina/dni"]
    assert (spain.document_number, argentina.document_number) == ("12345678Z", "12345678")
    assert {(r.full_name, r.date_of_birth, r.gender) for r in got.values()} == {("Ana Ruiz", "01/02/1990", "F")}


def test_memory_dated_ten_days_ahead_has_a_score(spark):
    """One plus a tenth of minus ten days is zero."""
    df = spark.sql("SELECT timestamp_ntz '2024-03-11 00:00:00' AS timestamp, 0.5D AS importance, 2L AS access_count UNION ALL SELECT timestamp_ntz '2024-03-01 00:00:00', 0.5D, 2L")
    got = [r[0] for r in df.select(M.memory_score("2024-03-01 00:00:00").alias("s")).collect()]
    assert got == [1.0, pytest.approx(0.25 + 0.3 + 0.04)]
