"""The fourteen document packs in registration order.

A pack says how its documents are recognised, where its fields stand and how complete an extraction
is. Fields are built from label lists and value shapes.
"""

from __future__ import annotations

from scanmill.functions.rules import Field, Pack, Probe, after, word, word_group

# Value shapes.
WORDS = r"[A-Za-z\s]+?"
PLACE = r"[A-Za-z\s,]+?"
OFFICE = r"[A-Za-z\s,.-]+?"
SLASHED = r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}"
SLASHED2 = r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2}"
DOTTED = r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}"
TWELVE = r"[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}"
EOL = r"\n|$"


def P(pattern: str, **kw) -> Probe:
    return Probe(pattern, **kw)


def cs(pattern: str) -> Probe:
    """Case-sensitive probe."""
    return Probe(pattern, ignore_case=False)


def dated(name: str, labels: list[str], shape: str = SLASHED, final: str = "dmy", bare: bool = False) -> Field:
    """A date after one of the label groups, or anywhere when ``bare``."""
    probes = [P(after(g, shape)) for g in labels]
    return Field(name, probes + ([P(f"({shape})")] if bare else []), final=final)


def named(name: str, labels: str, stops: str, tail: str = "", shape: str = WORDS, min_len: int = 1, final: str = "") -> Field:
    """Words after a label up to a stop, or up to the end of line for the ``tail`` labels."""
    probes = [P(after(labels, shape, r"\n|" + stops))]
    probes += [P(after(t, shape, EOL)) for t in tail.split("|") if t]
    return Field(name, probes, min_len=min_len, final=final)


def sexed(labels: str, values: str, final: str = "sex", ignore_case: bool = True, sep: str = r"[:\s]+", name: str = "sex") -> Field:
    return Field(
        name,
        [P(after(labels, values, sep=sep), ignore_case=ignore_case), P(word_group(values), ignore_case=ignore_case)],
        final=final,
    )


# Recognition rules, field labels, patterns, weights and thresholds of each pack.
AADHAAR = Pack(
    "aadhaar",
    "India",
    ("or", ("any", ["aadhaar", "आधार", "unique identification authority", "uidai", "government of india", "भारत सरकार"]), ("rx", word(TWELVE))),
    [
        Field("document_number", [cs(word_group(TWELVE))], final="spaces"),
        Field(
            "full_name",
            [
                P(after("Name|नाम", WORDS, r"\n|Date|DOB|जन्म|Father|S/o"), multiline=True, dotall=True),
                P(r"(?:नाम\s*/\s*Name[:\s]+)([A-Za-z\s]+?)(?:\n|Date|DOB|जन्म)", multiline=True, dotall=True),
                P(r"^([A-Z][A-Za-z\s]+?)(?:\n|Date|DOB|Father|S/o|जन्म)", multiline=True, dotall=True),
                P(r"([A-Z][A-Za-z\s]{5,30}?)(?:\s+(?:Male|Female|पुरुष|महिला))", multiline=True, dotall=True),
                P(r"([A-Z][A-Za-z\s]{3,25}?)\s*\n?\s*(?:[0-9]{4}\s?[0-9]{4}\s?[0-9]{4})", multiline=True, dotall=True),
                P(r"(?:Government of India|भारत सरकार).*?([A-Z][A-Za-z\s]{5,25}?)(?:\n|Date|DOB)", multiline=True, dotall=True),
            ],
            min_len=2,
            max_words=4,
            stop_words=["government", "india", "aadhaar", "unique", "identification", "authority", "qr code", "photo"],
        ),
        Field("date_of_birth", [P(after("DOB|Date of Birth|जन्म तिथि", SLASHED)), P(f"({SLASHED})"), P(r"([0-9]{1,2}\s+[\p{L}\p{N}_]+\s+[0-9]{4})")]),
        Field("gender", [P(r"(?:Gender[:\s]+|लिंग[:\s]+)?(Male|Female|पुरुष|महिला)")], final="gender"),
        Field(
            "father_name",
            [P(after("Father|पिता|S/o", WORDS, r"\n|Address")), P(after("S/o", WORDS, EOL)), P(after("Father", WORDS, EOL))],
            min_len=2,
        ),
        Field("mobile", [Probe(r"(?:Mobile[:\s]+|Mob[:\s]+)?(\+91[\s-]?)?([6-9][0-9]{9})", ignore_case=False, group=2)]),
        Field("email", [cs(word_group(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}"))]),
    ],
    0.6,
    [(0.4, "document_number", r"^[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}$"), (0.2, "full_name", r"(?s)^.{3,}"), (0.2, "date_of_birth", "."), (0.1, "gender", "."), (0.1, "address", r"(?s)^.{11,}")],
)

PAN_CARD = Pack(
    "pan_card",
    "India",
    (
        "or",
        ("rx", word(r"[A-Z]{5}[0-9]{4}[A-Z]")),
        ("count", ["permanent account number", "income tax department", "govt. of india", "government of india", "pan card", "account number", "signature", "father's name", "date of birth"], 2),
    ),
    [
        Field("document_number", [cs(word_group(r"[A-Z]{5}[0-9]{4}[A-Z]"))]),
        Field(
            "full_name",
            [
                P(r"(?:Name[:\s]+)([A-Z][A-Za-z\s]+?)(?:\n|Father|DOB|Date)", multiline=True),
                P(r"^([A-Z][A-Za-z\s]{5,40}?)(?:\n|Father|Son|Daughter)", multiline=True),
                P(r"([A-Z][A-Za-z\s]{8,35}?)(?:\s+Father|\s+Son|\s+Daughter)", multiline=True),
            ],
            min_len=3,
            stop_words=["permanent", "account", "number", "income"],
        ),
        Field("father_name", [P(after(x, r"[A-Z][A-Za-z\s]+?", r"\n|Date|DOB")) for x in ("Father's Name", "Father", "S/o", "Son of")], min_len=3),
        dated("date_of_birth", ["Date of Birth|DOB", "Birth"], bare=True),
    ],
    0.7,
    [(0.5, "document_number", r"^[A-Z]{5}[0-9]{4}[A-Z]$"), (0.2, "full_name", r"(?s)^.{4,}"), (0.15, "father_name", r"(?s)^.{4,}"), (0.15, "date_of_birth", ".")],
)

VOTER_ID = Pack(
    "voter_id",
    "India",
    (
        "or",
        ("rx", word(r"[A-Z]{3}[0-9]{7}|[A-Z]{2}[0-9]{8}|[A-Z]{4}[0-9]{6}")),
        (
            "count",
            ["election commission", "electors photo identity card", "epic", "chief electoral officer", "elector's photo identity card", "भारत निर्वाचन आयोग", "मतदाता पहचान पत्र", "voter id", "electoral", "assembly constituency", "part number", "serial number"],
            2,
        ),
    ),
    [
        Field("document_number", [cs(word_group(x)) for x in (r"[A-Z]{3}[0-9]{7}", r"[A-Z]{2}[0-9]{8}", r"[A-Z]{4}[0-9]{6}")]),
        Field(
            "full_name",
            [
                P(after("Name|नाम", r"[A-Z][A-Za-z\s]+?", r"\n|Father|Husband|House|Age"), multiline=True),
                P(r"^([A-Z][A-Za-z\s]{5,40}?)(?:\n|Father|Husband|S/o|W/o|D/o)", multiline=True),
                P(r"([A-Z][A-Za-z\s]{8,35}?)(?:\s+(?:Father|Husband|S/o|W/o|D/o))", multiline=True),
            ],
            min_len=3,
            stop_words=["election", "commission", "identity", "elector"],
        ),
        Field("father_name", [P(after("Father's Name|Father|S/o", r"[A-Z][A-Za-z\s]+?", r"\n|House|Age|Sex")), P(after("पिता का नाम", WORDS, r"\n|House|Age|Sex"))], min_len=3),
        Field("husband_name", [P(after("Husband's Name|Husband|W/o", r"[A-Z][A-Za-z\s]+?", r"\n|House|Age|Sex")), P(after("पति का नाम", WORDS, r"\n|House|Age|Sex"))], min_len=3),
        Field("house_number", [P(after("House No|House Number|घर संख्या", r"[A-Z0-9/-]+"))]),
        Field("age", [P(after("Age|उम्र", r"[0-9]{1,3}")), P(r"(?:^|[^\p{L}\p{N}_])([0-9]{1,3})\s*(?:years|yrs|Y)(?:[^\p{L}\p{N}_]|$)")], between=(18, 120)),
        sexed("Sex|Gender|लिंग", "Male|Female|पुरुष|महिला|M|F", final="gender"),
        Field("constituency", [P(after("Assembly Constituency|Constituency|विधानसभा क्षेत्र", WORDS, r"\n|Part|Serial"))], min_len=3),
        Field("part_number", [P(after("Part No|Part Number|भाग संख्या", r"[0-9]+"))]),
        Field("serial_number", [P(after("Serial No|Serial Number|Sl No|क्रम संख्या", r"[0-9]+"))]),
    ],
    0.65,
    [
        (0.4, "document_number", r"^(?:[A-Z]{3}[0-9]{7}|[A-Z]{2}[0-9]{8}|[A-Z]{4}[0-9]{6})$"),
        (0.2, "full_name", r"(?s)^.{4,}"),
        (0.15, "father_name|husband_name", "."),
        (0.1, "age", "."),
        (0.1, "sex", "."),
        (0.05, "part_number|serial_number", "."),
    ],
)

DRIVING_LICENSE = Pack(
    "driving_license",
    "India",
    (
        "or",
        (
            "any",
            ["driving licence", "driving license", "ड्राइविंग लाइसेंस", "government of india", "भारत सरकार", "transport", "motor vehicle", "dl no", "licence no", "license no", "class of vehicle", "validity", "issue date", "issuing authority", "rto"],
        ),
        ("rxi", word(r"[A-Z]{2}-?[0-9]{2}-?[0-9]{4}-?[0-9]{7}")),
        ("rxi", word(r"DL\s*NO[:\s]+[A-Z0-9-]{10,20}|LICENCE\s*NO[:\s]+[A-Z0-9-]{10,20}")),
    ),
    [
        Field(
            "document_number",
            [P(after(r"DL\s*NO|LICENCE\s*NO|LICENSE\s*NO", r"[A-Z0-9-]{10,20}")), P(word_group(r"[A-Z]{2}-?[0-9]{2}-?[0-9]{4}-?[0-9]{7}"))],
            final="plain_number",
        ),
        Field(
            "full_name",
            [
                P(after("Name|नाम", WORDS, r"\n|S/o|Father|DOB|Date"), multiline=True),
                P(r"^([A-Z][A-Za-z\s]+?)(?:\n|S/o|Father)", multiline=True),
                P(r"([A-Z][A-Za-z\s]{5,40}?)(?:\s+S/o|\s+Father|\s+DOB)", multiline=True),
            ],
            min_len=2,
            stop_words=["government", "india", "licence", "authority"],
        ),
        Field("father_name", [P(after("S/o|Father|Son of", WORDS, r"\n|DOB|Date|Address")), P(after("S/o", WORDS, EOL)), P(after("Father", WORDS, r"\n|DOB|Date", sep=r"[:\s]*"))], min_len=2),
        Field("date_of_birth", [P(after("DOB|Date of Birth|जन्म तिथि", SLASHED)), P(f"({SLASHED})")]),
        Field("issue_date", [P(after("Issue Date|Issued on|Date of Issue", SLASHED)), P(after("Issue", SLASHED))]),
        Field("validity_upto", [P(after(r"Valid\s*till|Validity|Valid\s*upto", SLASHED))]),
        Field("issuing_authority", [P(after("Issuing Authority|RTO", OFFICE, EOL)), P(r"(RTO[A-Za-z\s,-]*)"), P(r"(Transport.*Authority.*[A-Za-z\s,.-]+)")], min_len=3),
        Field("class_of_vehicle", [P(after("Class of Vehicle|COV|Class", r"[A-Za-z0-9\s,/-]+?", r"\n|Blood|Issue")), P(after("Class", r"[A-Z0-9,\s/-]+?", EOL))], min_len=1),
        Field("blood_group", [P(after("Blood Group|BG", r"[ABO][+-]?")), P(r"(?:^|[^\p{L}\p{N}_])([ABO][+-])[\p{L}\p{N}_]")], final="upper"),
    ],
    0.65,
    [(0.35, "document_number", r"^.{10,}"), (0.25, "full_name", r"(?s)^.{3,}"), (0.15, "date_of_birth", "."), (0.15, "issue_date|validity_upto", "."), (0.1, "class_of_vehicle", ".")],
)

_EMIRATES_WORDS = ["emirates id", "بطاقة الهوية", "federal authority", "uae", "united arab emirates", "الإمارات"]
_EMIRATES_ID = r"784[-\s]?[0-9]{4}[-\s]?[0-9]{7}[-\s]?[0-9]"
EMIRATES_ID = Pack(
    "emirates_id",
    "United Arab Emirates",
    ("or", ("count", _EMIRATES_WORDS, 2), ("and", ("any", _EMIRATES_WORDS), ("rx", _EMIRATES_ID))),
    [
        Field("document_number", [cs(f"({_EMIRATES_ID})")], final="emirates"),
        Field(
            "full_name",
            [
                P(after("Name", r"[A-Z][A-Za-z\s]+?", r"\n|$|[0-9]")),
                P(after("اسم", WORDS, EOL)),
                P(after("Name|اسم", r"[A-Z][A-Za-z\s]{2,40}?", r"\s*(?:ID|Date|DOB|Born|[0-9])", sep=r"[:\s]*")),
                P(r"([A-Z][A-Z\s]{5,40}?)(?:\s+(?:Male|Female|M|F|[0-9]{2}[/-][0-9]{2}))"),
            ],
            min_len=4,
            stop_words=["emirates", "authority", "identity", "card", "uae"],
        ),
        Field("date_of_birth", [P(after("DOB|Date of Birth|Born|تاريخ الميلاد", r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}", sep=r"[:\s]*")), P(r"([0-9]{1,2}[/-][0-9]{1,2}[/-](?:19|20)[0-9]{2})")], final="dmy"),
        Field("date_of_expiry", [P(r"(?:Expiry|Expires|Valid Until|انتهاء الصلاحية)(?:\s+Date)?[:\s]*([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})")], final="dmy"),
        Field("nationality", [P(".", dotall=True)], const="UAE"),
        Field("gender", [P(after("Gender|Sex", "Male|Female|M|F", sep=r"[:\s]*")), P(after("الجنس", "ذكر|أنثى|Male|Female", sep=r"[:\s]*"))], final="sex"),
    ],
    0.8,
    [(0.4, "document_number", "784"), (0.2, "full_name", r"(?s)^.{5,}"), (0.2, "date_of_birth", "."), (0.1, "nationality", "^UAE$"), (0.1, "gender", "^[MF]$")],
    single_line=True,
)

EU_COUNTRIES = [
    ("DEU", "German", ["deutschland", "germany", "bundesrepublik"]),
    ("FRA", "French", ["france", "république française", "republique francaise"]),
    ("ITA", "Italian", ["italia", "italy", "repubblica italiana"]),
    ("ESP", "Spanish", ["españa", "spain", "reino de españa"]),
    ("NLD", "Dutch", ["nederland", "netherlands", "koninkrijk der nederlanden"]),
    ("BEL", "Belgian", ["belgique", "belgium", "belgië", "koninkrijk belgië"]),
    ("AUT", "Austrian", ["österreich", "austria", "republik österreich"]),
    ("PRT", "Portuguese", ["portugal", "república portuguesa"]),
    ("GRC", "Greek", ["ελλάδα", "greece", "hellenic republic"]),
    ("IRL", "Irish", ["ireland", "éire", "poblacht na héireann"]),
    ("FIN", "Finnish", ["finland", "suomi", "republic of finland"]),
    ("SWE", "Swedish", ["sweden", "sverige", "kingdom of sweden"]),
    ("DNK", "Danish", ["denmark", "danmark", "kingdom of denmark"]),
    ("POL", "Polish", ["poland", "polska", "republic of poland"]),
    ("CZE", "Czech", ["czech republic", "česká republika"]),
    ("HUN", "Hungarian", ["hungary", "magyarország"]),
    ("SVK", "SVK", ["slovakia", "slovenská republika"]),
    ("SVN", "SVN", ["slovenia", "slovenija"]),
    ("EST", "EST", ["estonia", "eesti"]),
    ("LVA", "LVA", ["latvia", "latvija"]),
    ("LTU", "LTU", ["lithuania", "lietuva"]),
    ("LUX", "LUX", ["luxembourg", "lëtzebuerg"]),
    ("MLT", "MLT", ["malta", "repubblika ta' malta"]),
    ("CYP", "CYP", ["cyprus", "κύπρος"]),
    ("BGR", "BGR", ["bulgaria", "българия"]),
    ("ROU", "ROU", ["romania", "românia"]),
    ("HRV", "HRV", ["croatia", "hrvatska"]),
]

EU_ID_CARD = Pack(
    "eu_id_card",
    "European Union",
    (
        "or",
        (
            "and",
            ("any", [n for _, _, names in EU_COUNTRIES for n in names]),
            ("any", ["identity card", "personalausweis", "carte d'identité", "carta d'identità", "documento nacional de identidad", "identiteitskaart", "documento de identidade", "european union", "union européenne", "unión europea", "europäische union"]),
        ),
        ("rx", word(r"[A-Z]{2}[0-9]{6,9}|[0-9]{9}|[A-Z][0-9]{8}|[0-9]{6}[A-Z]{2}")),
    ),
    [
        Field("document_number", [cs(word_group(x)) for x in (r"[A-Z]{2}[0-9]{6,9}", r"[0-9]{9}", r"[A-Z][0-9]{8}", r"[0-9]{6}[A-Z]{2}")] + [cs(after("ID|Nr|No", r"[A-Z0-9]{6,12}"))]),
        Field(
            "surname",
            [
                P(after("Surname|Nachname|Nom|Cognome|Apellidos", r"[A-Z][A-Za-z\s-]+?", r"\n|Given|Vorname|Prénom"), multiline=True),
                P(after("Family Name|Nom de famille", r"[A-Z][A-Za-z\s-]+?", r"\n|Given|First"), multiline=True),
                P(r"^([A-Z][A-Z\s-]+?)(?:\n|,|\s{2,})", multiline=True),
            ],
            min_len=1,
        ),
        Field(
            "given_names",
            [
                P(after("Given Names|Vornamen|Prénoms|Nomi|Nombres", WORDS, r"\n|Date|Sex")),
                P(after("First Name|Prénom", WORDS, r"\n|Date|Sex")),
                P(after("Vorname", WORDS, r"\n|Geburtsdatum|Geschlecht")),
            ],
            min_len=1,
        ),
        dated("date_of_birth", ["Date of Birth|Geburtsdatum|Date de naissance", "Born|Né|Geboren"], DOTTED, bare=True),
        Field("place_of_birth", [P(after("Place of Birth|Geburtsort|Lieu de naissance", OFFICE, r"\n|Sex|Nationality")), P(after("Born in|Né à|Geboren in", OFFICE, EOL))], min_len=2),
        sexed("Sex|Geschlecht|Sexe", "Male|Female|Männlich|Weiblich|Masculin|Féminin|M|F"),
        dated("date_of_issue", ["Date of Issue|Ausstellungsdatum|Date de délivrance", "Issued|Délivré|Ausgestellt"], DOTTED),
        dated("date_of_expiry", ["Date of Expiry|Gültig bis|Valable jusqu'au", "Expires|Expire|Ablauf", "Valid until|Valide jusqu'au"], DOTTED),
        Field("issuing_authority", [P(after("Issuing Authority|Ausstellende Behörde|Autorité de délivrance", OFFICE, EOL)), P(after("Issued by|Délivré par|Ausgestellt von", OFFICE, EOL))], min_len=3),
    ],
    0.7,
    [(0.3, "document_number", "."), (0.2, "country_code", "."), (0.15, "surname", "."), (0.1, "given_names", "."), (0.1, "date_of_birth", "."), (0.1, "nationality", "."), (0.05, "sex", ".")],
)

_JP_DATE = r"[0-9]{4}[年/.-][0-9]{1,2}[月/.-][0-9]{1,2}日?"
JAPANESE_MY_NUMBER = Pack(
    "japanese_my_number",
    "Japan",
    (
        "or",
        ("and", ("rx", word(TWELVE)), ("rx", r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}]")),
        ("count", ["マイナンバーカード", "my number card", "individual number card", "個人番号カード", "japan", "日本", "digital agency", "デジタル庁", "総務省", "ministry of internal affairs"], 2),
    ),
    [
        Field("document_number", [cs(after("個人番号|マイナンバー|My Number", TWELVE, sep=r"[:\s]*")), cs(word_group(TWELVE))], final="spaces"),
        Field("full_name", [cs(r"(?:氏名|名前)[:\s]*([一-龯ひ-ゖ\s]+?)(?:\n|生年月日|住所)"), cs(r"([一-龯]{2,10}\s*[一-龯]{1,10})"), cs(r"([ひ-ゖ]{2,15}\s*[ひ-ゖ]{1,15})")], min_len=1),
        Field("full_name_kana", [cs(r"(?:フリガナ|カナ)[:\s]*([ァ-ヾ\s]+?)(?:\n|生年月日|住所)"), cs(r"([ァ-ヾ]{2,15}\s*[ァ-ヾ]{1,15})")], min_len=1),
        Field(
            "date_of_birth",
            [cs(after("生年月日|生まれ", _JP_DATE, sep=r"[:\s]*")), cs(after("Date of Birth", SLASHED, sep=r"[:\s]*")), cs(r"([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)"), cs(r"([Hh][0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2})"), cs(r"([Rr][0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2})")],
            final="era",
        ),
        Field("address", [cs(r"(?:住所)[:\s]*([0-9一-龯ひ-ゖァ-ヾー\s-]+?)(?:\n|性別|有効期限)"), cs(r"([都道府県][市区町村][一-龯0-9\s-]+)"), cs(r"([0-9]{3}-[0-9]{4}\s*[都道府県市区町村一-龯\s-]+)")], min_len=5),
        sexed("性別", "男|女|Male|Female|M|F", final="gender", ignore_case=False, sep=r"[:\s]*"),
        Field("date_of_issue", [cs(after("交付年月日|発行日", _JP_DATE, sep=r"[:\s]*")), cs(r"([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)交付"), cs(r"([HRhr][0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2})交付")], final="era"),
        Field("date_of_expiry", [cs(after("有効期限", _JP_DATE, sep=r"[:\s]*")), cs(r"([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)まで"), cs(r"([HRhr][0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2})まで")], final="era"),
        Field("issuing_authority", [cs(f"({x})") for x in ("デジタル庁", "総務省", "市区町村長", "[一-龯]{2,10}市長", "[一-龯]{2,10}区長", "[一-龯]{2,10}町長", "[一-龯]{2,10}村長")]),
        Field("nationality", [P(".", dotall=True)], const="Japanese"),
    ],
    0.75,
    [(0.4, "document_number", r"^[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}$"), (0.2, "full_name", "."), (0.1, "full_name_kana", "."), (0.15, "date_of_birth", "."), (0.1, "address", "."), (0.05, "sex", ".")],
)

US_GREEN_CARD = Pack(
    "us_green_card",
    "United States",
    (
        "or",
        ("any", ["permanent resident card", "department of homeland security", "u.s. citizenship and immigration services", "uscis", "alien registration", "alien number", "green card", "lawful permanent resident", "card expires", "resident since"]),
        ("rx", word(r"[0-9]{9}")),
        ("rx", r"A[0-9]{8,9}"),
        ("rx", word(r"[A-Z]{3}[0-9]{10}")),
        ("count", ["united states of america", "category", "country of birth"], 2),
    ),
    [
        Field("card_number", [cs(word_group(r"[A-Z]{3}[0-9]{10}")), cs(after(r"Card\s*No|Card\s*Number|Card|Number", r"[A-Z]{3}[0-9]{10}"))]),
        Field("alien_number", [P(r"(?:Alien\s*(?:Registration\s*)?(?:No|Number)[:\s]+|A\s*#\s*)(A?[0-9]{8,9})"), P(word_group(r"A[0-9]{8,9}"))], final="alien"),
        Field("uscis_number", [cs(after(r"USCIS\s*No|USCIS\s*Number", r"[0-9]{9}")), cs(word_group(r"[0-9]{9}"))]),
        named("given_name", r"Given\s*Name|First\s*Name", "Family|Last|Sex", r"Given\s*Name"),
        named("family_name", r"Family\s*Name|Last\s*Name|Surname", "Given|Date", r"Family\s*Name"),
        dated("date_of_birth", ["Date of Birth|DOB", "Birth Date", "Born"], final="mdy"),
        named("country_of_birth", "Country of Birth|Birth Country", "Sex|Date", "Country of Birth", min_len=2),
        sexed("Sex", "Male|Female|M|F"),
        dated("date_of_expiry", ["Card Expires|Expires|Expiry", "Valid until", "Expiration Date"], final="mdy"),
        dated("card_expires", ["Card Expires|Expires|Expiry", "Valid until", "Expiration Date"], final="mdy"),
        dated("resident_since", ["Resident Since|Since", "LPR Since"], final="mdy"),
        Field("category", [P(after("Category", r"[A-Z0-9]{2,5}")), P(after("Class", r"[A-Z0-9]{2,5}"))]),
    ],
    0.7,
)

US_STATES = (
    "alabama|alaska|arizona|arkansas|california|colorado|connecticut|delaware|florida|georgia|hawaii|idaho|illinois|indiana|iowa|kansas|"
    "kentucky|louisiana|maine|maryland|massachusetts|michigan|minnesota|mississippi|missouri|montana|nebraska|nevada|new hampshire|"
    "new jersey|new mexico|new york|north carolina|north dakota|ohio|oklahoma|oregon|pennsylvania|rhode island|south carolina|"
    "south dakota|tennessee|texas|utah|vermont|virginia|washington|west virginia|wisconsin|wyoming"
)
US_DRIVERS_LICENSE = Pack(
    "us_drivers_license",
    "United States",
    (
        "or",
        ("any", ["driver license", "drivers license", "driver's license", "department of motor vehicles", "dmv", "dl no", "lic no", "license no", "license number", "restrictions", "endorsements"]),
        ("and", ("any", ["license", "driver", "dmv"]), ("rx", word(r"[A-Z]{1,2}[0-9]{6,8}|[0-9]{8,9}"))),
        ("and", ("any", ["license", "driver"]), ("rxi", word(US_STATES))),
        ("count", ["expires", "issued", "height", "weight", "eyes", "hair", "class"], 3),
    ),
    [
        Field("document_number", [P(after(r"DL\s*NO|LIC\s*NO|LICENSE\s*NO", r"[A-Z0-9]{6,12}")), P(after("DL|LIC", r"[A-Z0-9]{6,12}")), P(word_group(r"[A-Z]{1,2}[0-9]{6,8}")), P(word_group(r"[0-9]{8,9}"))]),
        Field("full_name", [cs(r"([A-Z][A-Za-z]+,\s*[A-Z][A-Za-z]+)"), cs(r"([A-Z][A-Za-z]+\s+[A-Z][A-Za-z]+)")], min_len=3),
        Field("first_name", [P(after("FN|FIRST", r"[A-Za-z]+")), P(r",\s*([A-Z][A-Za-z]+)")]),
        Field("last_name", [P(after("LN|LAST", r"[A-Za-z]+")), P(r"([A-Z][A-Za-z]+),")]),
        Field("date_of_birth", [P(after("DOB|DATE OF BIRTH", SLASHED)), P(after("DOB", SLASHED2)), P(f"({SLASHED})")]),
        Field("city", [P(after("CITY", r"[A-Za-z\s]+")), P(r"([A-Za-z\s]+),\s*[A-Z]{2}\s*[0-9]{5}")]),
        Field("state", [cs(after("STATE", r"[A-Z]{2}")), cs(r",\s*([A-Z]{2})\s*[0-9]{5}")]),
        Field("zip_code", [cs(word_group(r"[0-9]{5}(?:-[0-9]{4})?"))]),
        Field("issue_date", [P(after("ISSUED|ISS", SLASHED)), P(after("ISSUED", SLASHED2))]),
        Field("expiration_date", [P(after("EXPIRES|EXP", SLASHED)), P(after("EXPIRES", SLASHED2))]),
        Field("class", [P(after("CLASS", r"[A-Z0-9]+")), P(after("CL", r"[A-Z0-9]+"))]),
        Field("restrictions", [P(after("RESTRICTIONS", r"[A-Z0-9\s,]+")), P(after("RESTR", r"[A-Z0-9\s,]+"))]),
        Field("endorsements", [P(after("ENDORSEMENTS", r"[A-Z0-9\s,]+")), P(after("ENDORSE", r"[A-Z0-9\s,]+"))]),
        Field("height", [P(after("HEIGHT|HT", r"""[0-9]+'-[0-9]+"|[5-7]'-[0-9]"|[5-7][0-9]+\"""")), P(after("HEIGHT", r"[0-9]{3}"))]),
        Field("weight", [P(after("WEIGHT|WT", r"[0-9]{2,3}"))]),
        Field("sex", [P(after("SEX", "[MF]")), P(word_group("MALE|FEMALE|M|F"))], final="sex"),
        Field("eyes", [P(after("EYES|EYE", r"[A-Z]{3}"))], final="upper"),
        Field("hair", [P(after("HAIR", r"[A-Z]{3}"))], final="upper"),
    ],
    0.65,
    [(0.3, "document_number", "."), (0.25, "full_name|first_name&last_name", "."), (0.2, "date_of_birth", "."), (0.15, "state", "."), (0.1, "expiration_date", ".")],
)


def _passport(
    code: str, country: str, detect: tuple, number: list[Probe], nationality: tuple[list[str], str], country_words: str,
    surname: Field, given: Field, birth: Field, place: Field, sex: Field, issue: Field, expiry: Field, authority: list[Probe],
    extra: list[Field] = [],
) -> Pack:
    """Passport packs share their fields and differ in labels."""
    probes, value = nationality
    return Pack(
        code,
        country,
        detect,
        [
            Field("passport_number", number),
            surname,
            given,
            Field("nationality", [P(x) for x in probes], const=value),
            birth,
            place,
            sex,
            issue,
            expiry,
            Field("issuing_authority", authority),
            *extra,
            Field("country_code", [P(country_words)], const=value),
        ],
        0.75,
    )


_GIVEN = named("given_names", r"Given\s*Names?", "Nationality|Date", r"Given\s*Names?", final="upper")
_GIVEN_FIRST = Field(
    "given_names",
    [P(after(r"Given\s*Names?", WORDS, r"\n|Nationality|Date")), P(after(r"First\s*Name", WORDS, r"\n|Date")), P(after(r"Given\s*Names?", WORDS, EOL))],
    min_len=1,
    final="upper",
)
_SURNAME = Field("surname", [P(after(r"Surname|Family\s*Name", WORDS, r"\n|Given|First")), P(after("Surname", WORDS, EOL))], min_len=1, final="upper")
_SEX = sexed("Sex", "Male|Female|M|F")
_ISSUE = dated("date_of_issue", ["Date of Issue|Issued", "Issue Date"])

UK_PASSPORT = _passport(
    "uk_passport",
    "United Kingdom",
    (
        "or",
        ("any", ["united kingdom", "great britain", "british passport", "british citizen", "hm passport office", "passport office", "nationality british", "british national", "gbr", "british isles", "england", "scotland", "wales", "northern ireland"]),
        ("rx", word(r"[0-9]{9}|[A-Z][0-9]{8}")),
        ("rx", "P<GBR"),
        ("and", ("count", ["european union", "passport no", "place of birth", "date of birth", "date of issue", "date of expiry"], 4), ("any", ["british", "kingdom"])),
    ),
    [P(after(r"Passport\s*No|Passport\s*Number", r"[0-9]{9}")), P(after(r"Document\s*No|Document\s*Number", r"[A-Z][0-9]{8}")), P(word_group(r"[0-9]{9}")), P(word_group(r"[A-Z][0-9]{8}"))],
    ([after("Nationality", "British|GBR|United Kingdom"), after("Citizen of", "United Kingdom|Great Britain"), word("British")], "GBR"),
    "united kingdom|great britain|british|gbr",
    _SURNAME,
    _GIVEN_FIRST,
    dated("date_of_birth", ["Date of Birth|DOB", "Birth Date", "Born"]),
    Field("place_of_birth", [P(after("Place of Birth", PLACE, r"\n|Date|Sex")), P(after("Born in", PLACE, r"\n|Date")), P(after("Place of Birth", PLACE, EOL))], min_len=2),
    _SEX,
    _ISSUE,
    dated("date_of_expiry", ["Date of Expiry|Expires", "Expiry Date", "Valid until"]),
    [P(after("Issuing Authority", WORDS, r"\n|Date")), P("(HM Passport Office|Passport Office)")],
    [Field("document_type", [P("passport")], const="P")],
)

CANADIAN_PASSPORT = _passport(
    "canadian_passport",
    "Canada",
    (
        "or",
        ("any", ["canadian passport", "passeport canadien", "passport canada", "gouvernement du canada", "government of canada", "citizenship and immigration", "citoyenneté et immigration", "passport office", "bureau des passeports", "nationality canadian", "nationalité canadienne"]),
        ("rx", word(r"[A-Z]{2}[0-9]{6}")),
        ("rx", "P<CAN"),
        ("and", ("any", ["canada", "can", "ottawa"]), ("any", ["passport"])),
    ),
    [P(after(r"Passport\s*No|Passport\s*Number", r"[A-Z]{2}[0-9]{6}")), P(after(r"Passeport\s*No|Passeport\s*Numéro", r"[A-Z]{2}[0-9]{6}")), P(word_group(r"[A-Z]{2}[0-9]{6}"))],
    ([after("Nationality|Nationalité", "Canadian|CAN|Canada"), word("Canadian")], "CAN"),
    "can",
    named("surname", "Surname|Nom de famille", "Given|Prénoms", "Surname|Nom de famille", final="upper"),
    named("given_names", r"Given\s*Names?|Prénoms", "Nationality|Date", r"Given\s*Names?|Prénoms", final="upper"),
    dated("date_of_birth", ["Date of Birth|Date de naissance", "DOB"]),
    named("place_of_birth", "Place of Birth|Lieu de naissance", "Date|Sex", "Place of Birth", PLACE, 2),
    sexed("Sex|Sexe", "Male|Female|Masculin|Féminin|M|F"),
    dated("date_of_issue", ["Date of Issue|Date de délivrance", "Issued|Délivré"]),
    dated("date_of_expiry", ["Date of Expiry|Date d'expiration", "Expires|Expire"]),
    [P("(Government of Canada|Gouvernement du Canada)"), P("(Passport Office|Bureau des passeports)"), P("(Citizenship and Immigration|Citoyenneté et Immigration)")],
)

AUSTRALIAN_PASSPORT = _passport(
    "australian_passport",
    "Australia",
    (
        "or",
        ("any", ["australia", "australian passport", "commonwealth of australia", "australian government", "department of foreign affairs", "passport office", "australian citizen", "nationality australian", "aus", "canberra", "passport australia"]),
        ("rx", word(r"[A-Z][0-9]{7,8}")),
        ("rx", "P<AUS"),
    ),
    [P(after(r"Passport\s*No|Passport\s*Number", r"[A-Z][0-9]{7,8}")), P(word_group(r"[A-Z][0-9]{7,8}"))],
    ([after("Nationality", "Australian|AUS|Australia"), word("Australian")], "AUS"),
    "aus",
    _SURNAME,
    _GIVEN_FIRST,
    dated("date_of_birth", ["Date of Birth|DOB", "Birth Date"]),
    named("place_of_birth", "Place of Birth", "Date|Sex", "Place of Birth", PLACE, 2),
    _SEX,
    _ISSUE,
    dated("date_of_expiry", ["Date of Expiry|Expires", "Expiry Date"]),
    [P("(Australian Government)"), P("(Department of Foreign Affairs)"), P("(Passport Office)"), P("(Commonwealth of Australia)")],
)

_UMLAUTS = r"[A-Za-z\s,äöüßÄÖÜ]+?"
GERMAN_PASSPORT = _passport(
    "german_passport",
    "Germany",
    (
        "or",
        ("any", ["deutschland", "germany", "deutscher reisepass", "german passport", "bundesrepublik deutschland", "federal republic of germany", "deutsche", "deu", "german", "reisepass", "passport", "staatsangehörigkeit", "nationality", "geburtsort", "place of birth", "geburtsdatum", "date of birth"]),
        ("rx", word(r"[A-Z][0-9]{8}")),
        ("rx", "P<DEU"),
    ),
    [P(after(r"Reisepass\s*Nr|Reisepass\s*Nummer", r"[A-Z][0-9]{8}")), P(after(r"Passport\s*No|Passport\s*Number", r"[A-Z][0-9]{8}")), P(word_group(r"[A-Z][0-9]{8}"))],
    ([after("Staatsangehörigkeit|Nationality", "Deutsch|German|DEU|Deutschland"), word("Deutsch|German")], "DEU"),
    "deu|german",
    named("surname", "Familienname|Surname", "Vorname|Given", "Familienname|Surname", final="upper"),
    named("given_names", r"Vorname|Given\s*Names?", "Staatsangehörigkeit|Nationality", r"Vorname|Given\s*Names?", final="upper"),
    dated("date_of_birth", ["Geburtsdatum|Date of Birth", "DOB"], DOTTED),
    named("place_of_birth", "Geburtsort|Place of Birth", "Date|Geschlecht", "Geburtsort", _UMLAUTS, 2),
    sexed("Geschlecht|Sex", "Male|Female|Männlich|Weiblich|M|F|W"),
    dated("date_of_issue", ["Ausstellungsdatum|Date of Issue", "Issued|Ausgestellt"], DOTTED),
    dated("date_of_expiry", ["Gültig bis|Date of Expiry", "Expires|Ablaufdatum"], DOTTED),
    [P(after("Ausstellende Behörde", _UMLAUTS, r"\n|Date")), P("(Bundesrepublik Deutschland)"), P("(Federal Republic of Germany)")],
)

_S = r"[/:\s]+"
_MONTHS = "JANUARY|FEBRUARY|MARCH|APRIL|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"


def _indian_dates(kind: str, hindi: str, word_: str, past: str) -> list[Probe]:
    return [
        P(after(f"Date of {kind}|{hindi}", SLASHED, sep=_S)),
        P(after(f"{kind} Date", SLASHED, sep=_S)),
        P(after(f"Date of {kind}|{hindi}", r"[0-9]{1,2}[.\s][0-9]{1,2}[.\s][0-9]{4}", sep=_S)),
        P(after(f"Date of {kind}|{kind} Date", rf"[0-9]{{1,2}}\s+(?:{_MONTHS})\s+[0-9]{{4}}", sep=_S)),
        P(after(f"{word_}|{past}", SLASHED)),
        P(f"{word_}[^0-9]*({SLASHED})"),
        P(after(f"0ate of {kind}|Dale of {kind}", SLASHED, sep=_S)),
    ]


PASSPORT = Pack(
    "passport",
    "India",
    (
        "or",
        (
            "any",
            ["passport", "republic of india", "भारत गणराज्य", "government of india", "भारत सरकार", "ministry of external affairs", "विदेश मंत्रालय", "type/प्रकार", "country code/देश कोड", "passport no", "given name", "surname", "nationality", "place of birth", "date of issue", "date of expiry"],
        ),
        ("rx", word(r"[A-Z][0-9]{7}")),
        ("rx", r"P<IND[A-Z0-9<]+|[A-Z0-9<]{44}"),
    ),
    [
        Field("document_number", [cs(after(r"Passport\s*No|PASSPORT\s*NO", r"[A-Z][0-9]{7}")), cs(word_group(r"[A-Z][0-9]{7}"))]),
        Field("document_type", [cs(after("Type|प्रकार", r"[A-Z]+", sep=_S))]),
        Field("country_code", [cs(after(r"Country\s*Code|देश\s*कोड", r"[A-Z]{3}", sep=_S))]),
        Field("surname", [P(after("Surname|उपनाम", WORDS, r"\n|Given|Name", sep=_S)), P(after("Surname", WORDS, EOL, sep=_S))], min_len=1),
        Field("given_name", [P(after(r"Given\s*Name|नाम", WORDS, r"\n|Nationality|Sex", sep=_S)), P(after(r"Given\s*Name", WORDS, EOL, sep=_S))], min_len=1),
        Field("nationality", [P(after("Nationality|राष्ट्रीयता", WORDS, r"\n|Date|Sex", sep=_S)), P(after("Nationality", r"[A-Z]{3}", sep=_S))], min_len=1),
        Field("date_of_birth", [P(after("Date of Birth|जन्म तिथि", SLASHED, sep=_S)), P(after("DOB", SLASHED, sep=_S))]),
        Field("place_of_birth", [P(after("Place of Birth|जन्म स्थान", PLACE, r"\n|Date|Sex", sep=_S)), P(after("Place of Birth", PLACE, EOL, sep=_S))], min_len=2),
        sexed("Sex|लिंग", "Male|Female|M|F", sep=_S),
        Field("date_of_issue", _indian_dates("Issue", "जारी करने की तिथि", "Issue", "Issued"), final="named_dmy"),
        Field("date_of_expiry", _indian_dates("Expiry", "समाप्ति तिथि", "Expiry", "Expires|Valid until") + [P(r"[A-Z0-9<]*([0-9]{6})[A-Z0-9<]*$", multiline=True)], final="named_dmy"),
        Field("place_of_issue", [P(after("Place of Issue|जारी करने का स्थान", PLACE, r"\n|Date|File", sep=_S)), P(after("Place of Issue", PLACE, EOL, sep=_S))], min_len=2),
        Field("file_number", [P(after(r"File\s*No|फाइल नं", r"[A-Z0-9/-]+", sep=_S))]),
    ],
    0.7,
    [(0.4, "document_number", r"^[A-Z][0-9]{7}$"), (0.2, "given_name", r"(?s)^.{2,}"), (0.2, "surname", r"(?s)^.{2,}"), (0.1, "date_of_birth", "."), (0.05, "date_of_expiry", "."), (0.05, "date_of_issue", ".")],
)

PACKS = [
    AADHAAR,
    PAN_CARD,
    VOTER_ID,
    DRIVING_LICENSE,
    EMIRATES_ID,
    EU_ID_CARD,
    JAPANESE_MY_NUMBER,
    US_GREEN_CARD,
    US_DRIVERS_LICENSE,
    UK_PASSPORT,
    CANADIAN_PASSPORT,
    AUSTRALIAN_PASSPORT,
    GERMAN_PASSPORT,
    PASSPORT,
]

# Weight of each key field where a pack has no weights of its own.
DEFAULT_WEIGHTS = [(0.25, "document_number", r"\S"), (0.25, "full_name", r"\S"), (0.25, "date_of_birth", r"\S"), (0.25, "nationality", r"\S")]
