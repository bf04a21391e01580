"""Brightness and hex colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import round_half_up


def luma_permille(r: Column, g: Column, b: Column) -> Column:
    """Brightness with whole weights over 1000, used for text colours."""
    return (r * 299 + g * 587 + b * 114) / 1000


def luma_float(r: Column, g: Column, b: Column) -> Column:
    """Brightness with decimal weights, used for backgrounds."""
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def grey_of_background(r: Column, g: Column, b: Column) -> Column:
    return luma_float(r, g, b).cast("int")


def grey_fixed_point(r: Column, g: Column, b: Column) -> Column:
    """8-bit grey as image libraries compute it: 15-bit fixed point, rounded."""
    return F.shiftright((r * 9798 + g * 19235 + b * 3735 + 16384).cast("int"), 15)


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    def channel(value: Column) -> Column:
        whole = F.greatest(F.lit(0), F.least(F.lit(255), round_half_up(value))).cast("int")
        return F.lpad(F.lower(F.hex(whole)), 2, "0")

    return F.concat(F.lit("#"), channel(r), channel(g), channel(b))
