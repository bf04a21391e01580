"""Schemas of the tables that go in and out, and the two settings records."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

OCR_REPLY = T.StructType([
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("box", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("confidence", T.DoubleType()),
    ]))),
])

BLOCK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("original_text", T.StringType()),
    T.StructField("translated_text", T.StringType()),
    T.StructField("ymin", T.DoubleType()),
    T.StructField("xmin", T.DoubleType()),
    T.StructField("ymax", T.DoubleType()),
    T.StructField("xmax", T.DoubleType()),
    T.StructField("text_color", T.StringType()),
    T.StructField("bg_color", T.StringType()),
    T.StructField("font_size_pct", T.DoubleType()),
    T.StructField("type", T.StringType()),
])

BLOCK_FIELDS = [f.name for f in BLOCK.fields]

BBOX_LINE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("bbox", T.StructType([
        T.StructField(name, T.DoubleType()) for name in ("x0", "y0", "x1", "y1")
    ])),
])

# `binaryFile` rows, needed explicitly when the source is streamed.
BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


@dataclass(frozen=True)
class StyleConfig:
    """One style for all pages. The defaults are fixed values."""

    font_family: str = "Outfit"
    font_size_scale: float = 1.0
    text_color_mode: str = "original"  # original | custom
    custom_text_color: str = "#FFFFFF"
    bg_color_mode: str = "original"  # original | custom | none
    custom_bg_color: str = "#000000"
    bg_opacity: int = 90
    text_shadow: bool = True
    text_stroke: bool = False
    stroke_color: str = "#000000"
    stroke_width: int = 2
    font_bold: bool = True
    font_italic: bool = False
    auto_fit_font_size: bool = True
    onomatopoeia_mode: str = "ignore"  # ignore | transparent | normal
    export_compressed: bool = False

    @classmethod
    def from_table(cls, style: DataFrame) -> "StyleConfig":
        """Read the one-row settings table."""
        row = style.select([f.name for f in fields(cls)]).head(1)[0]
        return cls(**row.asDict())


@dataclass(frozen=True)
class RunConfig:
    """One translation run. The defaults are fixed values."""

    provider: str = "gemini"
    model: str = "gemini-2.5-flash"
    custom_endpoint: str = ""
    target_lang: str = "简体中文"
    source_lang: str = "auto"
