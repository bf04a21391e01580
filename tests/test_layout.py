"""Layout against plain Python on small and awkward inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagewright.functions import breaks as BR
from pagewright.functions import text as TX
from pagewright.functions.semantics import has_cjk
from pagewright.operators import layout as Y
from pagewright.operators.blocks import normalise
from pagewright.schema import StyleConfig


def em(text):
    def one(c):
        if ord(c) >= 0x2E80:
            return 1.0
        return next((w for _, chars, w in TX.GLYPH_EM if c in chars), 0.5)

    return sum(map(one, text))


def columns_brute(n, font, max_h):
    """Fill columns glyph by glyph."""
    sizes, current = [], 0
    for _ in range(n):
        if current and (current + 1) * (font * 1.1) > max_h:
            sizes.append(current)
            current = 1
        else:
            current += 1
    return sizes + ([current] if current else [])


def lines_brute(text, font, max_w, cjk):
    parts, gap = (list(text), "") if cjk else (text.split(" "), " ")
    lines, current = [], ""
    for part in parts:
        trial = current + gap + part if current else part
        if current and em(trial) * font > max_w:
            lines.append(current)
            current = part
        else:
            current = trial
    return lines + ([current] if current else [])


def test_column_length_on_boundaries(spark):
    random.seed(5)
    cases = []
    for _ in range(4000):
        font = random.choice([7.0, 8.0, 12.3, random.uniform(6, 40)])
        k = random.randint(1, 30)
        cases.append((random.randint(1, 60), font, random.choice([k * (font * 1.1), k * font * 1.1, random.uniform(-5, 300)])))
    df = spark.createDataFrame(cases, "n int, font double, h double")
    got = df.select("n", "font", "h", TX.glyphs_per_column(F.col("font"), F.col("h")).alias("k")).collect()
    for r in got:
        sizes = columns_brute(r.n, r.font, r.h)
        assert sizes[0] == min(r.n, r.k), r
        assert len(sizes) == -(-r.n // r.k)


def test_wrap_matches_brute_force(spark):
    random.seed(7)
    words = ["a", "mill", "WW", "iii", "longerword", "x" * 40, "", "Q"]
    cases = []
    for i in range(300):
        if i % 3 == 0:
            text = "".join(random.choice("あ漢字ab i") for _ in range(random.randint(1, 700)))
            text = "漢" + text
        else:
            text = " ".join(random.choice(words[:-2] if i % 2 else words) for _ in range(random.randint(1, 600)))
            text = " ".join(text.split())
        cases.append((i, text, random.uniform(6, 20), random.uniform(-10, 200)))
    df = spark.createDataFrame(cases, "i int, t string, font double, w double")
    got = Y.wrap_lines(df, "t", F.col("font"), F.col("w")).collect()
    for r in got:
        cjk = r.i % 3 == 0
        assert r.lines == lines_brute(r.t, r.font, r.w, cjk), r.i
        assert ("" if cjk else " ").join(r.lines) == r.t


def blocks(spark, rows):
    return spark.createDataFrame(rows, "page_id int, ordinal int, translated_text string, xmin double, ymin double, xmax double, "
                                       "ymax double, font_size_pct double, width int, height int, type string, text_color string, "
                                       "bg_color string")


def test_fit_properties(spark):
    random.seed(3)
    rows = []
    for i in range(200):
        text = random.choice(["吹き出しの文字です。" * random.randint(1, 6), "some words to set in a box " * random.randint(1, 5)])
        x, y = random.uniform(0, 50), random.uniform(0, 50)
        rows.append((1, i, text.strip(), x, y, x + random.uniform(1, 40), y + random.uniform(1, 40), random.uniform(0, 6), 800, 1200,
                     None, "#000000", "#ffffff"))
    style = StyleConfig()
    for r in Y.fit_font(blocks(spark, rows), style).collect():
        assert 7.0 <= r.font_px <= r.font_px0
        fs = r.font_px
        if r.layout_dir == "vertical":
            cols = columns_brute(len(r.translated_text), fs, r.h - fs * 0.8)
            fits = len(cols) * fs * 1.1 <= r.w - fs * 0.4 + 1e-9 and max(cols) * fs * 1.1 <= r.h - fs * 0.8 + 1e-9
        else:
            fits = len(lines_brute(r.translated_text, fs, r.w - fs * 0.8, r.is_cjk)) * fs * 1.2 <= r.h - fs * 0.6 + 1e-9
        assert fits or fs == 7.0, r


def test_fit_off_keeps_first_size(spark):
    df = blocks(spark, [(1, 0, "abc " * 90, 0.0, 0.0, 5.0, 5.0, 3.0, 800, 1200, None, "#000000", "#ffffff")])
    assert Y.fit_font(df, StyleConfig(auto_fit_font_size=False, font_size_scale=2.0)).head().font_px == 72.0


def test_vertical_places_right_to_left(spark):
    df = blocks(spark, [(1, 0, "一二三四五六七八九十", 10.0, 10.0, 16.0, 20.0, 1.0, 1000, 1000, None, "#000000", "#ffffff")])
    placed = Y.place_vertical(Y.fit_font(df, StyleConfig())).orderBy("line", "spot").collect()
    assert "".join(r.glyph for r in placed) == "一二三四五六七八九十"
    assert placed[-1].line == 1 and placed[0].glyph_x > placed[-1].glyph_x
    assert abs((placed[0].glyph_x + placed[-1].glyph_x) / 2 - 130) < 1e-9


def test_covers(spark):
    rows = [(1, 0, "x", 0.0, 0.0, 10.0, 10.0, 2.0, 100, 100, "bubble", "#000000", "#ffffff"),
            (1, 1, "x", 0.0, 0.0, 10.0, 10.0, 2.0, 100, 100, "onomatopoeia", "#000000", "#ffffff"),
            (1, 2, "x", 0.0, 0.0, 0.0, 10.0, 2.0, 100, 100, None, "#000000", "#ffffff")]
    df = blocks(spark, rows)
    count = lambda **k: Y.cover_rects(df, StyleConfig(**k.pop("style", {})), **k).count()
    assert count() == 1
    assert count(style={"onomatopoeia_mode": "normal"}) == 2
    assert count(style={"bg_color_mode": "none"}) == 0
    assert count(erased=True) == 0
    assert count(erased=True, cover_erased=True) == 1
    assert count(erased=True, style={"bg_color_mode": "custom"}) == 1


def test_breaks_over_prefix_sums_equal_the_step_by_step_form(spark):
    """Random texts with words, gaps of all kinds, wide characters and boxes that are too narrow."""
    rng = random.Random(3)
    pools = ("abcimwMW@ABC .,!  \t\n　あ漢字éß", "abcimwMW .  \n")
    rows = [(k, "".join(rng.choice(pools[k % 2]) for _ in range(rng.randint(0, 60))), rng.choice([6.0, 7.3, 11.0, 16.0, 9.7]),
             rng.choice([-5.0, 0.0, 10.0, 33.3, 50.0, 120.0]), rng.choice([10.0, 40.0, 90.0])) for k in range(1500)] + [(-1, None, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k int, t string, px double, w double, h double").withColumn("c", has_cjk(F.col("t")))
    df = df.withColumns({"g": F.when(F.col("c"), F.lit("")).otherwise(F.lit(" ")), "ge": F.when(F.col("c"), F.lit(0.0)).otherwise(F.lit(TX.SPACE_EM)),
                         "tk": TX.tokens(F.col("t"), F.col("c"))}).withColumn("wd", F.transform("tk", lambda x: x["em"]))
    size = TX.shrink_to_fit(lambda fs: TX.fits_horizontal(F.col("wd"), F.col("ge"), fs, F.col("w"), F.col("h")), F.col("px"), 5.0)
    out = df.select("t", TX.wrap_text(*[F.col(c) for c in ("tk", "g", "ge", "px", "w")]).alias("lines"), size.alias("size"),
                    BR.broken_lines(F.col("t"), F.col("c"), F.col("px"), F.col("w")).alias("own_lines"),
                    BR.largest_font(F.col("t"), F.col("c"), F.col("px"), 5.0, F.col("w"), F.col("h")).alias("own_size")).collect()
    assert all(r.lines == r.own_lines for r in out) and all(r.size == r.own_size for r in out if r.t is not None)
    assert len({r.size for r in out}) > 20 and max(len(r.lines or []) for r in out) > 10


def test_largest_vertical_font_equals_the_expression(spark):
    rng = random.Random(4)
    rows = [("漢" * rng.randint(0, 80), rng.choice([8.0, 9.7, 16.0, 31.4, 120.0]), rng.choice([0.5, 9.0, 40.0, 77.7, 300.0]), rng.choice([2.0, 30.0, 99.9, 400.0])) for _ in range(800)]
    df = spark.createDataFrame(rows, "t string, px double, w double, h double")
    size = TX.shrink_to_fit(lambda fs: TX.fits_vertical(F.length("t"), fs, F.col("w"), F.col("h")), F.col("px"), 6.0)
    own = BR.largest_font(F.col("t"), F.lit(True), F.col("px"), 6.0, F.col("w"), F.col("h"), F.lit(True))
    out = df.select(size.alias("size"), own.alias("own")).collect()
    assert all(r.size == r.own for r in out) and len({r.size for r in out}) > 20


def test_font_search_looks_at_a_batch_as_a_whole(spark):
    """No search per row inside the engine: it took over 80 s for six million blocks, eleven steps over all tokens each."""
    df = blocks(spark, [(1, 1, "some words", 0.0, 0.0, 50.0, 50.0, 2.0, 100, 100, None, "#000000", "#ffffff"),
                        (1, 2, None, 0.0, 0.0, 50.0, 50.0, 2.0, 100, 100, None, "#000000", "#ffffff")])
    fitted = Y.fit_font(df, StyleConfig())
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    assert {r.ordinal: r.font_px for r in fitted.collect()}[2] == TX.EXPORT_MIN_PX


def test_the_layout_plans_look_at_a_text_once_and_compile(spark):
    """The JVM interprets a method of over 8000 bytes: copies of box and text in the join of blocks and pages took fit_vertical past that."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    regions = spark.createDataFrame([(1, 0, "漢字", 1, 2, 30, 90, "bubble")], "page_id long, ordinal int, text string, px0 int, py0 int, px1 int, py1 int, type string")
    pages = spark.createDataFrame([(1, 600, 900)], "page_id long, width int, height int")
    df = normalise(regions, pages).withColumn("translated_text", F.col("original_text"))
    fitted = Y.fit_font(df, StyleConfig(onomatopoeia_mode="normal"))
    for out in (fitted, fitted.where(F.col("layout_dir") == "vertical"), Y.place_vertical(fitted), Y.place_horizontal(fitted)):
        execution = out._jdf.queryExecution()
        assert execution.optimizedPlan().toString().count("RLIKE") == 1
        out.collect()
        stages = debug.codegenStringSeq(execution.executedPlan())
        assert max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 6000


def test_short_texts_are_broken_together(monkeypatch):
    """A batch is broken line by line of all texts at once, as one by one; texts that are long and odd sizes are left to `Tokens`."""
    rng = random.Random(6)
    pools = ("abcimwMW@ABC .,!  \t\n　あ漢字éß😀", "abcimwMW .  \n", " 　")
    texts = ["".join(rng.choice(pools[k % 3]) for _ in range(rng.choice([0, 1, 5, 60, 255, 700]))) for k in range(600)]
    per_char = np.array([rng.random() < 0.5 for _ in texts])
    px = np.array([rng.choice([6.0, 7.3, 9.7, 16.0, 0.1, 0.0, -3.0, float("nan")]) for _ in texts])
    w = np.array([rng.choice([-5.0, -0.01, 0.0, 3.65, 33.3, 120.0, 1e12, float("inf"), float("nan")]) for _ in texts])
    alone = [BR.Tokens(t, bool(c)).broken(float(s), float(m)) for t, c, s, m in zip(texts, per_char, px, w)]
    assert BR._lines(texts, per_char, px, w) == alone and BR._lines([], per_char[:0], px[:0], w[:0]) == []

    def used(*_):
        raise AssertionError("a text was broken alone")

    monkeypatch.setattr(BR, "Tokens", used)
    plain = np.flatnonzero([len(t) < BR.SHORT and s > 0 and np.isfinite(m) for t, s, m in zip(texts, px, w)])
    assert len(plain) > 100 and BR._lines([texts[k] for k in plain], per_char[plain], px[plain], w[plain]) == [alone[k] for k in plain]


def test_line_ends_are_looked_up_only_where_they_decide(monkeypatch):
    """A box too low for one line, or high enough for one line per word, needs no search; else the lines count."""
    texts = ["two words", "漢字", "", "three short words"]
    flat, rows = BR.Texts(texts, np.array([False, True, False, False])), np.arange(4)
    px, narrow = np.full(4, 10.0), np.full(4, 20.0)
    three_lines = 3 * 10.0 * TX.LINE_PITCH + 10.0 * TX.PADDING * 1.5
    assert flat.fit(rows, px, narrow, np.full(4, three_lines - 1)).tolist() == [True, True, True, False]
    assert flat.fit(rows, px, np.full(4, 200.0), np.full(4, three_lines - 1)).all()

    def looked_up(*_):
        raise AssertionError("a line end was looked up")

    monkeypatch.setattr(BR.np, "searchsorted", looked_up)
    assert flat.fit(rows, px, narrow, np.full(4, 10.0)).tolist() == [False, False, True, False]
    assert flat.fit(rows, px, narrow, np.full(4, three_lines)).all()
