"""Frames of a document stream: gate by quality, classify, extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanmill.functions import classify as K

# Fixed value: the least quality of an accepted frame.
LEAST_QUALITY = 0.6


def extract_frames(frames: DataFrame, quality: Column, text: str = "text", least: float = LEAST_QUALITY) -> DataFrame:
    """Accepted frames with their type, its confidence, the pack that recognises them and its fields.

    A frame below the least quality, or without one, is left out before its text is read. The steps are narrow and keep
    no state, so they run alike on a stream and on a table. A frame that no pack recognises has no fields; a null text
    is the type for everything else.
    """
    accepted = frames.filter(F.coalesce(quality >= least, F.lit(False)))
    return K.extract_routed(K.route_document(K.classify_cascade(accepted, text), text), text)
