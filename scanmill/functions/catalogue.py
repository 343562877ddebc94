"""Document type catalogue, name aliases and the country rule catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported type codes, their country and display name.
TYPES = [
    ("aadhaar", "India", "Aadhaar Card"),
    ("emirates_id", "United Arab Emirates", "Emirates ID"),
    ("driving_license", "India", "Indian Driving License"),
    ("passport", "India", "Indian Passport"),
    ("us_drivers_license", "United States", "US Driver's License"),
    ("us_green_card", "United States", "US Green Card"),
    ("pan_card", "India", "PAN Card"),
    ("voter_id", "India", "Voter ID"),
    ("uk_passport", "United Kingdom", "UK Passport"),
    ("canadian_passport", "Canada", "Canadian Passport"),
    ("australian_passport", "Australia", "Australian Passport"),
    ("german_passport", "Germany", "German Passport"),
    ("eu_id_card", "European Union", "EU ID Card"),
    ("japanese_my_number", "Japan", "Japanese My Number Card"),
]

# Further names for a type.
EXTRA_ALIASES = {
    "aadhar": "aadhaar",
    "emirates id card": "emirates_id",
    "uae id": "emirates_id",
    "indian driving licence": "driving_license",
    "driving licence": "driving_license",
    "us drivers license": "us_drivers_license",
    "american driver's license": "us_drivers_license",
    "green card": "us_green_card",
    "permanent resident card": "us_green_card",
    "election card": "voter_id",
    "british passport": "uk_passport",
    "european id card": "eu_id_card",
    "my number card": "japanese_my_number",
    "japanese my number": "japanese_my_number",
}


def aliases() -> dict[str, str]:
    """Lower-case name to code: codes, display names and the further names."""
    out: dict[str, str] = {}
    for code, _, display in TYPES:
        out[code] = code
        out[display.lower()] = code
    return {**out, **EXTRA_ALIASES}


# Country rules as (country, type, name, languages, keywords, number formats, text indicators).
COUNTRY_RULES = [
    ("United Arab Emirates", "emirates_id", "Emirates ID", ["ar", "en"], ["emirates id", "بطاقة الهوية", "federal authority"], [r"784-\d{4}-\d{7}-\d"], ["uae", "united arab emirates", "الإمارات"]),
    ("India", "aadhaar_card", "Aadhaar Card", ["hi", "en"], ["aadhaar", "आधार", "government of india", "भारत सरकार"], [r"\d{4}\s*\d{4}\s*\d{4}"], ["india", "भारत", "unique identification"]),
    ("United States", "drivers_license", "Driver's License", ["en"], ["driver license", "drivers license", "dl", "motor vehicle"], [r"[A-Z0-9]{8,15}", r"[A-Z]\d{7,12}"], ["united states", "state of", "department of motor vehicles"]),
    ("United States", "state_id", "State ID", ["en"], ["identification card", "state id", "identity card"], [r"[A-Z0-9]{8,15}"], ["state of", "identification", "not a driver license"]),
    ("United Kingdom", "driving_licence", "UK Driving Licence", ["en"], ["driving licence", "dvla", "driver and vehicle licensing agency"], [r"[A-Z]{5}\d{6}[A-Z]{2}\d[A-Z]{2}"], ["united kingdom", "great britain", "driving licence"]),
    ("Canada", "drivers_license", "Driver's License", ["en", "fr"], ["driver's license", "permis de conduire", "licence"], [r"[A-Z0-9]{8,15}"], ["canada", "province", "ontario", "quebec", "british columbia"]),
    ("Australia", "drivers_license", "Driver Licence", ["en"], ["driver licence", "drivers licence", "transport"], [r"\d{8,10}", r"[A-Z]\d{7,9}"], ["australia", "new south wales", "victoria", "queensland"]),
    ("Germany", "personalausweis", "Personalausweis", ["de"], ["personalausweis", "bundesrepublik deutschland", "ausweis"], [r"[A-Z]\d{8}", r"\d{9}[A-Z]"], ["deutschland", "germany", "bundesrepublik"]),
    ("Germany", "fuhrerschein", "Führerschein", ["de"], ["führerschein", "fahrerlaubnis", "driving licence"], [r"\d{11}"], ["deutschland", "führerschein", "klasse"]),
    ("France", "carte_identite", "Carte d'identité", ["fr"], ["carte d'identité", "république française", "identité"], [r"\d{12}"], ["france", "république française", "carte nationale"]),
    ("Spain", "dni", "DNI", ["es"], ["documento nacional de identidad", "dni", "españa"], [r"\d{8}[A-Z]"], ["españa", "spain", "reino de españa"]),
    ("Italy", "carta_identita", "Carta d'identità", ["it"], ["carta d'identità", "repubblica italiana", "comune"], [r"[A-Z]{2}\d{7}"], ["italia", "italy", "repubblica italiana"]),
    ("Netherlands", "identiteitskaart", "Nederlandse identiteitskaart", ["nl"], ["identiteitskaart", "nederland", "koninkrijk"], [r"[A-Z]{2}[A-Z0-9]{6}"], ["nederland", "netherlands", "koninkrijk"]),
    ("Japan", "mynumber_card", "My Number Card", ["ja", "en"], ["個人番号カード", "my number", "マイナンバー"], [r"\d{4}\s\d{4}\s\d{4}"], ["japan", "日本", "個人番号"]),
    ("South Korea", "resident_card", "Resident Registration Card", ["ko", "en"], ["주민등록증", "resident registration", "대한민국"], [r"\d{6}-\d{7}"], ["korea", "대한민국", "주민등록"]),
    ("Singapore", "nric", "NRIC", ["en"], ["nric", "national registration identity card", "singapore"], [r"[STFG]\d{7}[A-Z]"], ["singapore", "republic of singapore"]),
    ("Malaysia", "mykad", "MyKad", ["ms", "en"], ["mykad", "malaysia", "kad pengenalan"], [r"\d{6}-\d{2}-\d{4}"], ["malaysia", "kad pengenalan"]),
    ("Thailand", "thai_id", "Thai National ID Card", ["th", "en"], ["บัตรประชาชน", "national id card", "thailand"], [r"\d{1}-\d{4}-\d{5}-\d{2}-\d{1}"], ["thailand", "ประเทศไทย", "บัตรประชาชน"]),
    ("Brazil", "rg", "RG", ["pt"], ["registro geral", "rg", "república federativa do brasil"], [r"\d{1,2}\.\d{3}\.\d{3}-\d{1}"], ["brasil", "brazil", "república federativa"]),
    ("Mexico", "ine", "INE", ["es"], ["instituto nacional electoral", "ine", "méxico"], [r"\d{13}"], ["méxico", "mexico", "estados unidos mexicanos"]),
    ("Argentina", "dni", "DNI", ["es"], ["documento nacional de identidad", "república argentina"], [r"\d{7,8}"], ["argentina", "república argentina"]),
    ("South Africa", "green_id", "Green ID Book", ["en", "af"], ["identity document", "south africa", "republic"], [r"\d{13}"], ["south africa", "republic of south africa"]),
    ("Nigeria", "nin", "National Identification Number", ["en"], ["national identification number", "nin", "nigeria"], [r"\d{11}"], ["nigeria", "federal republic of nigeria"]),
    ("Egypt", "national_id", "National ID Card", ["ar", "en"], ["بطاقة الرقم القومي", "national id", "egypt", "مصر"], [r"\d{14}"], ["egypt", "مصر", "جمهورية مصر العربية"]),
]

RULE_SCHEMA = (
    "country STRING, type STRING, name STRING, languages ARRAY<STRING>, keywords ARRAY<STRING>, "
    "number_formats ARRAY<STRING>, text_indicators ARRAY<STRING>"
)


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Long pattern table (country, type, kind, pattern) of the built-in rules or of a JSON/Parquet rule file."""
    if path is None:
        r = spark.createDataFrame(COUNTRY_RULES, RULE_SCHEMA)
    else:
        r = spark.read.schema(RULE_SCHEMA).format("parquet" if path.endswith(".parquet") else "json").load(path)
    kinds = F.create_map(
        F.lit("keyword"), "keywords", F.lit("number_format"), "number_formats", F.lit("text_indicator"), "text_indicators"
    )
    e = r.select("country", "type", F.explode(kinds).alias("kind", "patterns"))
    return e.select("country", "type", "kind", F.explode("patterns").alias("pattern"))


def supported_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPES, "code STRING, country STRING, display_name STRING")
