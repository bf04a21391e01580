import math

import pytest
from pyspark.sql import functions as F

from pagewright.functions import names as N
from pagewright.functions import semantics as S
from pagewright.functions.json_text import with_json


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_clamp(spark):
    got = column(spark, [None, math.nan, -1.0, 0.0, 55.5, 101.0], "double", lambda v: S.clamp(v, 0.0, 100.0))
    assert got == [0.0, 0.0, 0.0, 0.0, 55.5, 100.0]


def test_defaults(spark):
    assert column(spark, [None, "", "x"], "string", lambda v: S.text_or(v, "d")) == ["d", "d", "x"]
    assert column(spark, [None, 0.0, math.nan, 3.0], "double", lambda v: S.number_or(v, 2.0)) == [2.0, 2.0, 2.0, 3.0]


def test_browser_trim(spark):
    got = column(spark, ["　あ ﻿", "\t a b \n", "　"], "string", S.browser_trim)
    assert got == ["あ", "a b", ""]


def test_medians(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 4, 8)], "v int")
    row = df.agg(S.median_avg_trunc(F.col("v")), S.median_upper("v")).head()
    assert tuple(row) == (3, 4)
    odd = spark.createDataFrame([(v,) for v in (5, 1, 9)], "v int")
    assert tuple(odd.agg(S.median_avg_trunc(F.col("v")), S.median_upper("v")).head()) == (5, 5)


def test_round_half_up(spark):
    assert column(spark, [2.5, -2.5, 2.4], "double", S.round_half_up) == [3, -2, 2]


@pytest.mark.parametrize("text, ok", [
    ('{"a":1}', True), ('[1,2]', True), ('"x"', True), ("12", True), (' {"a":1} ', True),
    ('{"a":1} junk', False), ('{"a":1} {"b":2}', False), ("1] junk", False), ("1} junk", False), ("1,2", False),
    ("{'a':1}", False), ("", False), ("{", False), ("nope", False),
])
def test_strict_json(spark, text, ok):
    df = with_json(spark.createDataFrame([(text,)], "t string"), "t", "v")
    got = df.select(F.col("v").isNotNull()).head()[0]
    # The brace step may rescue a text with junk round one object.
    rescued = text == '{"a":1} junk'
    assert got == (ok or rescued)


def test_extract_steps(spark):
    texts = ['{"k":1}', '```json\n{"k":1}\n```', '```\n{"k":1}\n```', 'so: {"k":1} ok', '{"k":[{"a":1}]', "[1,2] x", "x"]
    rows = with_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "v")
    got = [r[0] for r in rows.orderBy("i").select(F.to_json("v")).collect()]
    # Without a brace span the bracket step never runs.
    assert got == ['{"k":1}'] * 4 + ['[{"a":1}]', None, None]


def test_natural_order(spark):
    names = ["p10.png", "p9a.png", "P2.png", "p02.png", "9.png", "10.png", "p1.png", "p_1.png", "é1.png", "f1.png", "e2.png",
             "p000.png", "p00000000000000000000123.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.orderBy(N.natural_key(F.col("n")), "n").collect()]
    assert got == ["9.png", "10.png", "é1.png", "e2.png", "f1.png", "p_1.png", "p000.png", "p1.png", "P2.png", "p02.png", "p9a.png",
                   "p10.png", "p00000000000000000000123.png"]


def test_page_image_names(spark):
    names = ["a.JPG", "a.jpeg", "a.webp", "a.bmp", "a.png", "a.gif", "noext", "x_erased.png", "y_ERASED.PNG", "x_translated.png",
             "x_translated.jpg"]
    got = column(spark, names, "string", N.is_page_image)
    assert got == [True, True, True, True, True, False, False, False, True, False, True]


def test_export_name(spark):
    names = ["a.png", "a.b.jpg", "noext", ".hidden", "dot."]
    assert column(spark, names, "string", lambda v: N.export_name(v, False)) == [
        "translated_a.png", "translated_a.b.jpg", "translated_noext.png", "translated_.hidden", "translated_dot.."[:-1]]
    assert column(spark, ["a.png"], "string", lambda v: N.export_name(v, True)) == ["translated_a.webp"]


def test_artifact_parts(spark):
    names = ["a.png_blocks.json", "a.png_erased.png", "a.png_translated.png", "_blocks.json", "a.tmp"]
    assert column(spark, names, "string", N.artifact_owner) == ["a.png", "a.png", "a.png", "", None]
    assert column(spark, names, "string", N.artifact_kind) == ["blocks", "erased", "translated", "blocks", None]
