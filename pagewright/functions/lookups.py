"""Small fixed lookups and progress steps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# OCR language packs by source language.
OCR_LANG_PACKS = {
    "ja": "jpn+jpn_vert+eng",
    "zh": "chi_sim+eng",
    "en": "eng",
    "ko": "kor+eng",
    "auto": "eng+chi_sim+jpn+jpn_vert",
}
OCR_LANG_PACK_DEFAULT = "eng+chi_sim"

# Model used when a provider comes without one.
DEFAULT_MODELS = {"openai": "gpt-4o-mini", "deepseek": "deepseek-chat", "custom": "gpt-4o-mini"}
DEFAULT_MODEL = "gemini-2.5-flash"

# Fixed values: (first percent, share of the stage's own percent) per stage.
PROGRESS_STAGES = {"ocr": (10.0, 60.0), "lines": (40.0, 50.0)}
PROGRESS_MARKS = {"start": 10, "image_sent": 30, "ocr_done": 75, "done": 100}


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    literal = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(literal, key), F.lit(default))


def ocr_lang_pack(lang: Column) -> Column:
    return _lookup(OCR_LANG_PACKS, lang, OCR_LANG_PACK_DEFAULT)


def default_model(provider: Column) -> Column:
    return _lookup(DEFAULT_MODELS, provider, DEFAULT_MODEL)


def progress_of(stage: Column, percent: Column) -> Column:
    """Percent inside a stage to percent of the whole run; null for an unknown stage."""
    out = F.lit(None).cast("int")
    for name, (first, share) in PROGRESS_STAGES.items():
        step = (F.lit(first) + F.floor(percent / 100 * share + 0.5)).cast("int")
        out = F.when(stage == name, step).otherwise(out)
    for name, mark in PROGRESS_MARKS.items():
        out = F.when(stage == name, F.lit(mark)).otherwise(out)
    return out
