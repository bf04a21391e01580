"""File names: natural order, artifact owners, export names, block ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which listed files are page images, and the generated ones among them.
IMAGE_NAME = r"(?i)\.(jpe?g|png|webp|bmp)$"
GENERATED_SUFFIXES = ("_erased.png", "_translated.png")
# Artifact suffixes in the order they are tested.
ARTIFACT_SUFFIXES = (("blocks", "_blocks.json"), ("erased", "_erased.png"), ("translated", "_translated.png"))
CACHE_FOLDER = "translation_cache"

# ASCII punctuation in Unicode root collation order: all of it sorts before digits.
COLLATION_PUNCTUATION = " _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"
PUNCTUATION_RANKS = "".join(chr(i + 1) for i in range(len(COLLATION_PUNCTUATION)))
# Latin letters with marks and their bases: order ignores case and marks.
MARKED_LETTERS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BASE_LETTERS = "aaaaaaceeeeiiiinooooouuuuyy"


def natural_key(name: Column) -> Column:
    """A string whose plain order is the natural, case-blind order of names.

    A run of digits becomes its length in ten digits, which no string exceeds,
    followed by the run without leading zeros, so runs compare by value.
    """
    folded = F.translate(F.translate(F.lower(name), MARKED_LETTERS, BASE_LETTERS),
                         COLLATION_PUNCTUATION, PUNCTUATION_RANKS)
    runs = F.regexp_extract_all(folded, F.lit(r"(\d+|\D+)"), F.lit(1))

    def encode(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, encode), "")


def is_page_image(name: Column) -> Column:
    keep = name.rlike(IMAGE_NAME)
    for suffix in GENERATED_SUFFIXES:
        keep = keep & ~name.endswith(suffix)
    return keep


def artifact_kind(file_name: Column) -> Column:
    kind = F.lit(None).cast("string")
    for label, suffix in reversed(ARTIFACT_SUFFIXES):
        kind = F.when(file_name.endswith(suffix), F.lit(label)).otherwise(kind)
    return kind


def artifact_owner(file_name: Column) -> Column:
    """Name of the page an artifact belongs to; null for an unknown suffix."""
    owner = F.lit(None).cast("string")
    for _, suffix in reversed(ARTIFACT_SUFFIXES):
        stem = F.substring(file_name, F.lit(1), F.length(file_name) - len(suffix))
        owner = F.when(file_name.endswith(suffix), stem).otherwise(owner)
    return owner


def export_name(name: Column, compressed: bool) -> Column:
    has_dot = F.instr(name, ".") > 0
    base = F.when(has_dot, F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name)
    own = F.when(has_dot, F.regexp_extract(name, r"(?s)\.([^.]*)$", 1)).otherwise(F.lit("png"))
    return F.concat(F.lit("translated_"), base, F.lit("."), F.lit("webp") if compressed else own)


def block_id(page_id: Column, ordinal: Column) -> Column:
    """Stable id of a block; the same input always gives the same id."""
    return F.concat_ws("_", F.lit("block"), page_id.cast("string"), ordinal.cast("string"))
