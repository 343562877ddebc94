"""Document numbers, contacts, addresses, places, countries and gender."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.packs import EU_COUNTRIES
from scanmill.functions.rules import LEFT, RIGHT, Probe, let, let_sql, literal_rows, sql_str, strip, word_group, words as word_array

# Number shapes in order of preference, and prefixes to drop.
NUMBER_SHAPES = [
    r"([A-Z]{1,2}[0-9]{7,9})",
    r"([0-9]{9}[A-Z])",
    r"([0-9]{3}-[0-9]{4}-[0-9]{7}-[0-9])",
    r"([A-Z]{1,3}[0-9]{6,8})",
    r"([0-9]{8,12})",
    r"([A-Z0-9]{6,15})",
]
NUMBER_PREFIXES = [
    "passportno", "passportnumber", "documentno", "documentnumber", "idno", "idnumber", "licenseno", "licensenumber", "number", "no",
]


def found(v: Column) -> Column:
    """Null instead of the empty match."""
    return F.nullif(v, F.lit(""))


def clean_document_number(c: Column) -> Column:
    """Best number shape in the cleaned text; else the text without its prefix when 6 to 15 long; else as given."""
    def pick(t: Column) -> Column:
        rx = "^(?:" + "|".join(NUMBER_PREFIXES) + ")"
        bare = F.regexp_replace(t, "(?i)" + rx, "")
        shapes = [found(F.regexp_extract(F.upper(t), p, 1)) for p in NUMBER_SHAPES]
        return F.coalesce(*shapes, F.when(F.length(bare).between(6, 15), F.upper(bare)), strip(c))

    return F.when(F.length(c) > 0, let(F.regexp_replace(strip(c), r"[^\p{L}\p{N}_-]", ""), pick))


def format_emirates_id(c: Column) -> Column:
    """784-YYYY-NNNNNNN-C from any spacing; other text gives null."""
    rx = r"784[-\s]?([0-9]{4})[-\s]?([0-9]{7})[-\s]?([0-9])"
    parts = [F.regexp_extract(c, rx, i) for i in (1, 2, 3)]
    return F.when(c.rlike(rx), F.concat_ws("-", F.lit("784"), *parts))


# Contact patterns.
EMAIL = word_group(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
MOBILE = r"(?:\+91[\s-]?)?([6-9][0-9]{9})"
ZIP = word_group(r"[0-9]{5}(?:-[0-9]{4})?")
EMAIL_FULL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
IPV6 = (
    r"^(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,5}(?::[0-9A-Fa-f]{1,4}){1,2}|(?:[0-9A-Fa-f]{1,4}:){1,4}(?::[0-9A-Fa-f]{1,4}){1,3}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,3}(?::[0-9A-Fa-f]{1,4}){1,4}|(?:[0-9A-Fa-f]{1,4}:){1,2}(?::[0-9A-Fa-f]{1,4}){1,5}"
    r"|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,6}|:(?:(?::[0-9A-Fa-f]{1,4}){1,7}|:))$"
)


def contacts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns(
        {
            "email": found(F.regexp_extract(text, EMAIL, 1)),
            "mobile": found(F.regexp_extract(text, MOBILE, 1)),
            "zip_code": found(F.regexp_extract(text, ZIP, 1)),
        }
    )


def email_valid(c: Column) -> Column:
    return c.rlike(EMAIL_FULL)


def ip_valid(c: Column) -> Column:
    return c.rlike(IPV4) | c.rlike(IPV6)


# Address markers and the words that end an address block.
ADDRESS_MARKS = ["address", "पता", "addr"]
ADDRESS_LABEL = r"(?iu)(?:Address[:\s]+|पता[:\s]+|Addr[:\s]+)(.+)"
ADDRESS_STOPS = ["aadhaar", "आधार", "uid", "issue", "enrol", "validity", "rto", "class", "blood"]
NOT_ADDRESS = r"^[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}$|^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}$"


def address_block(text: Column, stops: Sequence[str] = ADDRESS_STOPS) -> Column:
    """Lines after the first address marker up to the first stop line, joined by blanks.

    Text after a marker on its own line counts; short lines, numbers and dates do not.
    """
    has = lambda x, ws: F.exists(word_array(ws), lambda w: F.contains(F.lower(x), w))
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > 0)
    mark = lambda x: has(x, ADDRESS_MARKS)

    def block(ls: Column) -> Column:
        flags = F.transform(ls, lambda x: F.when(mark(x), F.lit("m")).when(has(x, stops), F.lit("s")).otherwise(F.lit("l")))

        def cut(fl: Column) -> Column:
            at = F.array_position(fl, F.lit("m")).cast("int")
            tail_flags = F.slice(fl, at + 1, F.size(fl))
            end = F.array_position(tail_flags, F.lit("s")).cast("int")
            length = F.when(end > 0, end).otherwise(F.size(fl) - at + 1)
            kept = F.transform(
                F.slice(ls, at, length),
                lambda x: F.when(mark(x), found(strip(F.regexp_extract(x, ADDRESS_LABEL, 1)))).when(
                    (F.length(x) > 5) & ~x.rlike(NOT_ADDRESS), x
                ),
            )
            return F.when(at > 0, found(F.array_join(F.array_compact(F.when(at > 0, kept)), " ")))

        return let(flags, cut)

    return let(lines, block)


# Place patterns in order, and words that are no place.
PLACE_PROBES = [
    Probe(r"(?:place of issue|place of birth|issued at|issued in|authority)[:\s]*([A-Za-z\s,]+?)(?:\n|$)", multiline=True),
    Probe(r"(?:issuing office)[:\s]*([A-Za-z\s,]+?)(?:\n|$)", multiline=True),
    Probe(r"(?:طرف|صادر از)[:\s]*([A-Za-z\s,\x{0622}-\x{06CC}]+?)(?:\n|$)", multiline=True),
    Probe(r"(?:issued in|place)[:\s]*([A-Za-z\s,]+?)(?:on|[0-9]{1,2})", multiline=True),
    Probe(r"([A-Z][A-Z\s]*[A-Z])\s+(?:passport|authority|office)", multiline=True),
]
NOT_PLACES = ["passport", "office", "authority", "department", "ministry", "date", "number"]


def extract_place(text: Column) -> Column:
    """Place of issue or birth: first pattern that leaves a real word."""
    stop = word_array(NOT_PLACES)

    def words(raw: Column) -> Column:
        t = strip(F.regexp_replace(F.regexp_replace(raw, r"[^\p{L}\p{N}_\s,]", ""), r"\s+", " "))
        return F.filter(F.split(t, " "), lambda w: ~F.array_contains(stop, F.lower(w)) & (F.length(w) > 1))

    # The last pattern backtracks over whole sentences: it runs only where one of its words occurs.
    gate = F.lower(text).rlike("passport|authority|office")
    raw = [F.regexp_extract(text, p.java(), 1) for p in PLACE_PROBES]
    raw[-1] = F.when(gate, raw[-1]).otherwise("")
    tries = [
        let(words(r), lambda ws: F.when(F.size(ws) > 0, F.initcap(F.array_join(ws, " "))))
        for r in raw
    ]
    return F.coalesce(*tries)


# Countries as (code, names), in the order in which they are tried. A caller can pass another table.
COUNTRIES = [
    ("USA", ["united states", "america", "usa", "u.s.a", "u.s.", "united states of america"]),
    ("GBR", ["united kingdom", "great britain", "uk", "england", "britain", "scotland", "wales", "northern ireland"]),
    ("CAN", ["canada", "canadian"]),
    ("AUS", ["australia", "australian"]),
    ("DEU", ["germany", "german", "deutschland", "allemagne"]),
    ("FRA", ["france", "french", "république française", "republique francaise"]),
    ("ESP", ["spain", "spanish", "españa", "espana"]),
    ("ITA", ["italy", "italian", "italia"]),
    ("JPN", ["japan", "japanese", "日本", "nihon", "nippon"]),
    ("CHN", ["china", "chinese", "中国", "zhongguo"]),
    ("IND", ["india", "indian", "भारत", "hindustan", "bharatiya", "bharat"]),
    ("RUS", ["russia", "russian", "россия", "rossiya"]),
    ("BRA", ["brazil", "brazilian", "brasil"]),
    ("MEX", ["mexico", "mexican", "méxico"]),
    ("KOR", ["korea", "korean", "south korea", "한국", "hanguk"]),
    ("SAU", ["saudi arabia", "saudi", "المملكة العربية السعودية"]),
    ("UAE", ["united arab emirates", "uae", "emirates", "الإمارات العربية المتحدة"]),
    ("EGY", ["egypt", "egyptian", "مصر", "misr"]),
    ("ZAF", ["south africa", "south african"]),
    ("NGA", ["nigeria", "nigerian"]),
    ("KEN", ["kenya", "kenyan"]),
    ("GHA", ["ghana", "ghanaian"]),
    ("SGP", ["singapore", "singaporean"]),
    ("MYS", ["malaysia", "malaysian"]),
    ("IDN", ["indonesia", "indonesian"]),
    ("THA", ["thailand", "thai"]),
    ("VNM", ["vietnam", "vietnamese"]),
    ("PHL", ["philippines", "filipino", "philippine"]),
    ("PAK", ["pakistan", "pakistani"]),
    ("BGD", ["bangladesh", "bangladeshi"]),
    ("TUR", ["turkey", "turkish", "türkiye", "turkiye"]),
    ("IRN", ["iran", "iranian", "persia", "persian"]),
    ("ISR", ["israel", "israeli"]),
    ("NLD", ["netherlands", "dutch", "holland"]),
    ("BEL", ["belgium", "belgian"]),
    ("CHE", ["switzerland", "swiss"]),
    ("SWE", ["sweden", "swedish"]),
    ("NOR", ["norway", "norwegian"]),
    ("DNK", ["denmark", "danish"]),
    ("FIN", ["finland", "finnish"]),
    ("POL", ["poland", "polish"]),
    ("AUT", ["austria", "austrian"]),
    ("HUN", ["hungary", "hungarian"]),
    ("CZE", ["czech republic", "czech", "czechia"]),
    ("GRC", ["greece", "greek", "hellenic"]),
    ("PRT", ["portugal", "portuguese"]),
    ("IRL", ["ireland", "irish"]),
    ("NZL", ["new zealand", "kiwi"]),
    ("ARG", ["argentina", "argentinian"]),
    ("CHL", ["chile", "chilean"]),
    ("COL", ["colombia", "colombian"]),
    ("PER", ["peru", "peruvian"]),
    ("VEN", ["venezuela", "venezuelan"]),
    ("CUB", ["cuba", "cuban"]),
    ("JAM", ["jamaica", "jamaican"]),
    ("CRI", ["costa rica", "costa rican"]),
    ("PAN", ["panama", "panamanian"]),
    ("UKR", ["ukraine", "ukrainian"]),
    ("BLR", ["belarus", "belarusian"]),
    ("KAZ", ["kazakhstan", "kazakh"]),
    ("UZB", ["uzbekistan", "uzbek"]),
    ("MAR", ["morocco", "moroccan"]),
    ("DZA", ["algeria", "algerian"]),
    ("TUN", ["tunisia", "tunisian"]),
    ("LBY", ["libya", "libyan"]),
    ("ETH", ["ethiopia", "ethiopian"]),
    ("ZWE", ["zimbabwe", "zimbabwean"]),
    ("NPL", ["nepal", "nepalese"]),
    ("LKA", ["sri lanka", "sri lankan"]),
    ("MMR", ["myanmar", "burmese", "burma"]),
    ("KHM", ["cambodia", "cambodian"]),
    ("LAO", ["laos", "lao"]),
    ("MNG", ["mongolia", "mongolian"]),
    ("PRK", ["north korea", "dprk"]),
    ("TWN", ["taiwan", "taiwanese"]),
    ("HKG", ["hong kong"]),
    ("MAC", ["macao", "macau"]),
    ("FJI", ["fiji", "fijian"]),
    ("PNG", ["papua new guinea"]),
    ("ISL", ["iceland", "icelandic"]),
    ("LUX", ["luxembourg", "luxembourgish"]),
    ("MLT", ["malta", "maltese"]),
    ("CYP", ["cyprus", "cypriot"]),
    ("EST", ["estonia", "estonian"]),
    ("LVA", ["latvia", "latvian"]),
    ("LTU", ["lithuania", "lithuanian"]),
    ("SVN", ["slovenia", "slovenian"]),
    ("SVK", ["slovakia", "slovak"]),
    ("HRV", ["croatia", "croatian"]),
    ("BIH", ["bosnia", "bosnian", "herzegovina"]),
    ("SRB", ["serbia", "serbian"]),
    ("MNE", ["montenegro", "montenegrin"]),
    ("ALB", ["albania", "albanian"]),
    ("MKD", ["north macedonia", "macedonian"]),
    ("BGR", ["bulgaria", "bulgarian"]),
    ("ROU", ["romania", "romanian"]),
    ("MDA", ["moldova", "moldovan"]),
    ("QAT", ["qatar", "qatari"]),
    ("BHR", ["bahrain", "bahraini"]),
    ("KWT", ["kuwait", "kuwaiti"]),
    ("OMN", ["oman", "omani"]),
    ("JOR", ["jordan", "jordanian"]),
    ("LBN", ["lebanon", "lebanese"]),
    ("SYR", ["syria", "syrian"]),
    ("IRQ", ["iraq", "iraqi"]),
    ("AFG", ["afghanistan", "afghan"]),
    ("YEM", ["yemen", "yemeni"]),
]


def country_table() -> list[tuple[str, str]]:
    """(code, keyword) in table order."""
    return [(c, k) for c, names in COUNTRIES for k in names]


def nationality(text: Column | str, countries: Sequence[tuple[str, str]], number: Column | None = None) -> Column:
    """Country code of a text: first keyword found as a whole word, else first keyword found at all, else by number shape.

    Each keyword is a literal test; the pattern for the whole word is only tried on texts that hold it. For a column given
    by name the tests are written as SQL text, which is much faster to build for a long table.
    """
    # A regular expression special character in a keyword stands for itself.
    quoted = lambda k: re.sub(r"([.\\+*?\[\]^$(){}|-])", r"\\\1", k)
    rows = [(c, k.lower()) for c, k in countries]
    pattern = lambda k: LEFT + "(?:" + quoted(k) + ")" + RIGHT
    if isinstance(text, str):
        # The keywords that occur are found once; most texts hold none and try no pattern.
        table = ", ".join(f"named_struct('c', '{c}', 'k', {sql_str(k)}, 'p', {sql_str(pattern(k))})" for c, k in rows)
        first = "coalesce(get(filter(held, x -> rlike(t, x.p)), 0).c, get(held, 0).c)"
        named = F.expr(let_sql(f"lower({text})", "t", let_sql(f"filter(array({table}), x -> contains(t, x.k))", "held", first)))
    else:
        named = let(
            F.lower(text),
            lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(k)) & t.rlike(pattern(k)), c) for c, k in rows], *[F.when(F.contains(t, F.lit(k)), c) for c, k in rows]),
        )
    by_number = (
        F.lit(None).cast("string")
        if number is None
        else F.when(number.rlike(r"^[A-Z][0-9]{8}$"), "USA").when(number.rlike(r"^[0-9]{9}[A-Z]$"), "GBR")
    )
    return F.coalesce(named, by_number, F.lit("UNKNOWN"))


# Labelled nationality patterns used when no country is named.
NATIONALITY_LABEL = r"(?iu)(?:Nationality[:\s]+|Nationalité[:\s]+|Staatsangehörigkeit[:\s]+)([A-Za-z]+)"


def issuing_country(df: DataFrame, text: str = "text") -> DataFrame:
    """Country code and nationality word; the labelled value or adjective when no country is named."""
    adjective = F.create_map(*[F.lit(x) for c, adj, _ in EU_COUNTRIES for x in (c, adj)])
    words = "|".join(adj for code, adj, _ in EU_COUNTRIES if adj != code)
    bare = "(?iu)" + word_group(words)
    table = literal_rows([(c, n) for c, _, ns in EU_COUNTRIES for n in ns], ["code", "kw"])
    code = let(F.lower(text), lambda t: F.get(F.filter(table, lambda k: F.contains(t, k["kw"])), F.lit(0))["code"])
    return df.withColumn("country_code", code).withColumn(
        "nationality",
        F.when(F.col("country_code").isNotNull(), F.element_at(adjective, F.col("country_code"))).otherwise(
            F.coalesce(found(F.regexp_extract(text, NATIONALITY_LABEL, 1)), found(F.regexp_extract(text, bare, 1)))
        ),
    )


# Gender patterns.
GENDER_LABELLED = r"(?iu)(?:gender|sex|sexe)[:\s]*(male|female|homme|femme|masculino|femenino|m|f)"
GENDER_BARE = "(?iu)" + word_group("male|female|m|f")


def gender_code(text: Column) -> Column:
    """M or F after a label, else from a bare word."""
    raw = F.upper(F.coalesce(found(F.regexp_extract(text, GENDER_LABELLED, 1)), found(F.regexp_extract(text, GENDER_BARE, 1))))
    return F.when(raw.isin("MALE", "M", "HOMME", "MASCULINO"), "M").when(raw.isin("FEMALE", "F", "FEMME", "FEMENINO"), "F")
