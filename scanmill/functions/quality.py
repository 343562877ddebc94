"""Quality scores of images (from metric columns), texts, extractions and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions.rules import sql_str

# Weights of the image metrics and the bands of the total.
IMAGE_WEIGHTS = {
    "blur": 0.25, "brightness": 0.15, "contrast": 0.20, "noise": 0.15, "skew": 0.10, "resolution": 0.10, "text_coverage": 0.05,
}
# Issue texts by broken threshold, and enhancement texts.
ISSUES = {
    "blur": "Image is blurry", "dark": "Image is too dark", "bright": "Image is too bright/overexposed",
    "contrast": "Low contrast between text and background", "noise": "High noise level detected", "skew": "Document is skewed",
    "resolution": "Low resolution may affect text recognition", "coverage": "Limited text content detected",
}
SUGGESTIONS = {
    "blur": "Apply sharpening filter before OCR processing",
    "contrast": "Apply CLAHE (Contrast Limited Adaptive Histogram Equalization)",
    "dark": "Apply gamma correction to brighten image", "bright": "Apply gamma correction to darken image",
    "noise": "Apply bilateral filtering to reduce noise", "skew": "Apply skew correction before processing",
    "coverage": "Crop image to focus on text regions",
}


def listed(*pairs: tuple[Column, str]) -> Column:
    """Array of the texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))


def image_quality(df: DataFrame) -> DataFrame:
    """Weighted score in [0, 1], band, issues and suggestions of seven image metrics."""
    one, zero = F.lit(1.0), F.lit(0.0)
    blur, bright, contrast = F.col("blur"), F.col("brightness"), F.col("contrast")
    noise, skew, res, cover = F.col("noise"), F.abs("skew"), F.col("resolution"), F.col("text_coverage")
    off = F.least(F.abs(bright - 80), F.abs(bright - 180))
    parts = [
        ("blur", F.least(blur / 100, one)),
        ("brightness", F.when(bright.between(80, 180), one).otherwise(F.greatest(zero, one - off / 100))),
        ("contrast", F.least(contrast / 50, one)),
        ("noise", F.greatest(zero, one - noise)),
        ("skew", F.greatest(zero, one - skew / 45)),
        ("resolution", res),
        ("text_coverage", cover),
    ]
    total = zero
    for name, part in parts:
        total = total + part * F.lit(IMAGE_WEIGHTS[name])
    score = F.least(F.greatest(total, zero), one)
    # Thresholds of the checks.
    issues = listed(
        (blur < 100, ISSUES["blur"]), (bright < 50, ISSUES["dark"]), (bright > 200, ISSUES["bright"]),
        (contrast < 30, ISSUES["contrast"]), (noise > 0.1, ISSUES["noise"]), (skew > 5.0, ISSUES["skew"]),
        (res < 0.7, ISSUES["resolution"]), (cover < 0.3, ISSUES["coverage"]),
    )
    todo = listed(
        (blur < 50, SUGGESTIONS["blur"]), (contrast < 25, SUGGESTIONS["contrast"]), (bright < 60, SUGGESTIONS["dark"]),
        (bright > 190, SUGGESTIONS["bright"]), (noise > 0.08, SUGGESTIONS["noise"]), (skew > 3, SUGGESTIONS["skew"]),
        (cover < 0.4, SUGGESTIONS["coverage"]),
    )
    return df.withColumn("score", score).withColumns(
        {
            "confidence": F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.6, "medium").otherwise("low"),
            "issues": issues,
            "suggestions": todo,
        }
    )


# Feedback of the live gate.
FEEDBACK = {
    "sharpness": "Hold camera steady - image is blurry", "brightness": "Increase lighting - image is too dark",
    "contrast": "Improve contrast - image lacks definition", "noise": "Reduce noise - improve image quality", "none": "Image quality is good",
}
LIVE_THRESHOLD = 0.6


def live_quality(df: DataFrame) -> DataFrame:
    """Mean of four normalised frame metrics, acceptance, feedback and grade."""
    one = F.lit(1.0)
    df = df.withColumns(
        {
            "s_sharp": F.least(F.col("blur") / 1000, one),
            "s_bright": one - F.abs(F.col("brightness") - 127) / 127,
            "s_contrast": F.least(F.col("contrast") / 64, one),
            "s_noise": F.greatest(F.lit(0.0), one - F.col("noise") / 20),
        }
    )
    fb = listed(
        (F.col("s_sharp") < 0.5, FEEDBACK["sharpness"]), (F.col("s_bright") < 0.5, FEEDBACK["brightness"]),
        (F.col("s_contrast") < 0.5, FEEDBACK["contrast"]), (F.col("s_noise") < 0.5, FEEDBACK["noise"]),
    )
    q = F.col("overall_quality")
    return (
        df.withColumn("overall_quality", (F.col("s_sharp") + F.col("s_bright") + F.col("s_contrast") + F.col("s_noise")) / 4)
        .withColumn("is_acceptable", q >= LIVE_THRESHOLD)
        .withColumn("feedback", F.when(F.size(fb) == 0, F.array(F.lit(FEEDBACK["none"]))).otherwise(fb))
        .withColumn("grade", F.when(q >= 0.8, "Excellent").when(q >= 0.6, "Good").when(q >= 0.4, "Fair").otherwise("Poor"))
    )


def unique_chars(c: Column) -> Column:
    return F.size(F.array_distinct(F.split(c, "")))


def text_quality(text: Column, image_quality: Column) -> Column:
    """30 % image quality, 70 % mean of length and variety of the text; blank text scores no text part."""
    variety = F.least(unique_chars(text).cast("double") / 50.0, F.lit(1.0))
    length = F.least(F.length(text).cast("double") / 100.0, F.lit(1.0))
    part = F.when(F.trim(text) != "", (length + variety) / 2.0).otherwise(F.lit(0.0))
    return image_quality * 0.3 + part * 0.7


# Preprocessing steps in order.
STEPS = [
    "basic_enhancement", "intelligent_upscale", "advanced_denoise", "adaptive_contrast", "lighting_correction", "text_sharpening",
    "morphological_cleanup",
]


def preprocess_plan(df: DataFrame) -> DataFrame:
    b = F.col("brightness")
    needed = [
        F.lit(True), F.col("resolution") < 0.8, F.col("noise") > 0.1, F.col("contrast") < 30, (b < 80) | (b > 180),
        F.col("blur") < 100, F.col("edge_density") > 0.1,
    ]
    return df.withColumn("steps", listed(*zip(needed, STEPS)))


# Keys of a result that are not extracted fields.
METADATA_KEYS = [
    "document_type", "processing_method", "confidence", "country_code", "processor", "error", "raw_text", "vision_validated",
    "vision_corrections", "vision_confidence", "vision_missing_fields", "vision_assisted", "vision_notes", "field_confidence",
]


def field_confidence(df: DataFrame, keys: Sequence[str], fields: str = "fields", corrected: str = "corrected", validated: str = "validated") -> DataFrame:
    """One row per extracted field: value, confidence and method.

    0.5 for a value, 0.3 more when longer than one character, 0.15 more when validated; a corrected
    field has 0.85.
    """
    e = df.select(*keys, F.col(corrected).alias("_c"), F.col(validated).alias("_v"), F.explode(fields).alias("field", "value")).filter(
        ~F.col("field").isin(METADATA_KEYS)
    )
    has = F.coalesce(F.trim("value") != "", F.lit(False))
    base = F.lit(50) + F.when(F.length("value") > 1, 30).otherwise(0) + F.when(F.col("_v"), 15).otherwise(0)
    fixed = F.array_contains("_c", F.col("field"))
    return e.select(
        *keys, "field", "value",
        (F.when(has & fixed, 85).when(has, F.least(base, F.lit(100))).otherwise(0) / 100).alias("confidence"),
        F.when(has & fixed, "vision_corrected").when(has & F.col("_v"), "vision_validated").otherwise("regex_match").alias("method"),
    )


def completeness(weights: Sequence[tuple[float, str, str]], fields: str) -> str:
    """SQL text: sum of the weights whose field of a map matches, capped at one.

    ``a|b`` is met by either field, ``a|b&c`` by a or by both b and c.
    """
    terms = []
    for w, names, rx in weights:
        one = lambda n: f"coalesce(rlike(element_at({fields}, '{n}'), {sql_str(rx)}), false)"  # noqa: B023, E731
        met = " OR ".join("(" + " AND ".join(one(n) for n in alt.split("&")) + ")" for alt in names.split("|"))
        terms.append(f"CASE WHEN {met} THEN {round(w * 100)} ELSE 0 END")
    return f"least({' + '.join(terms)}, 100) / 100"


def batch_quality(df: DataFrame, class_conf: str, ocr_conf: str, fields: str) -> DataFrame:
    """Mean of class confidence, OCR confidence (percent or share) and the share of filled fields, if any."""
    ocr = F.when(F.col(ocr_conf) > 1, F.col(ocr_conf) / 100).otherwise(F.col(ocr_conf))
    filled = F.size(F.filter(F.map_values(fields), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))).cast("double")
    n = F.size(fields)
    two = F.col(class_conf) + ocr
    return df.withColumn("quality", F.when(n > 0, (two + filled / n) / 3.0).otherwise(two / 2.0))
