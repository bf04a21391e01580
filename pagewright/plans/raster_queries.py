"""Queries over pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..operators import erase as E
from ..operators import pyramid as P
from ..operators import raster as R
from ..operators import routing as W
from ..plugins import run_inpainter
from .block_queries import r6
from .fixtures import Tables
from .oracle_views import with_views
from .registry import query

KEYS = ["crop_id"]


def crops(t: Tables) -> DataFrame:
    return t["fx_colour_pixels"].select("crop_id", "x", "y", *R.CHANNELS)


def sized(t: Tables) -> DataFrame:
    return R.with_size(crops(t), KEYS)


def border_sql(pixels: str, key: str) -> str:
    """The border as four lists: both rows whole, both sides without their corners."""
    base = f"SELECT {key}, x, y, b, g, r FROM {pixels} WHERE"
    inner = "ch > 2 AND y > 0 AND y < ch - 1"
    return " UNION ALL ".join([f"{base} y = 0", f"{base} y = ch - 1", f"{base} {inner} AND x = 0", f"{base} {inner} AND x = cw - 1"])


LUMA_SQL = "(0.299e0 * r + 0.587e0 * g + 0.114e0 * b)"
GREY_SQL = "((r * 9798 + g * 19235 + b * 3735 + 16384) >> 15)"


def mask_ctes(key: str, pixels: str) -> tuple[tuple[str, str], ...]:
    return (
        ("edge", border_sql(pixels, key)),
        ("bg", f"""SELECT {key}, CAST(floor(median(b)) AS INT) AS bg_b, CAST(floor(median(g)) AS INT) AS bg_g, CAST(floor(median(r)) AS INT) AS bg_r,
            coalesce(stddev_pop({LUMA_SQL}) < 15, true) AS is_uniform FROM edge GROUP BY {key}"""),
        ("mask", f"""SELECT {key}, x, y FROM {pixels} JOIN bg USING ({key})
            WHERE abs({GREY_SQL} - CAST(trunc(0.299e0 * bg_r + 0.587e0 * bg_g + 0.114e0 * bg_b) AS INT)) > 25"""),
    )


PX = (("px", "SELECT crop_id, x, y, b, g, r, 8 AS cw, 8 AS ch FROM fx_colour_pixels"),)
MASKED = PX + mask_ctes("crop_id", "px")
SPREAD = ("spread", "SELECT crop_id, label, CAST(i - 3 AS INT) AS d FROM (SELECT DISTINCT crop_id, label FROM fx_pixels), range(7) v(i) WHERE abs(i - 3) <= label % 3 + 1")
GROWN = MASKED + (SPREAD, ("grown", """SELECT DISTINCT m.crop_id, m.x + h.d AS x, m.y + v.d AS y FROM mask m JOIN spread h ON m.crop_id = h.crop_id
  JOIN spread v ON m.crop_id = v.crop_id WHERE m.x + h.d BETWEEN 0 AND 7 AND m.y + v.d BETWEEN 0 AND 7"""))


def grown_mask(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(mask grown by 1 to 3 pixels by label, background)."""
    pixels = sized(t)
    bg = R.background(pixels, KEYS)
    radius = t["fx_pixels"].groupBy("crop_id").agg((F.max("label") % 3 + 1).alias("radius"))
    sizes = pixels.select("crop_id", "cw", "ch").distinct().join(radius, "crop_id")
    return R.dilate(R.text_mask(pixels, bg, KEYS), sizes, KEYS), bg


@query("pixel_luma", with_views(("fx_colour_pixels",), f"""
SELECT crop_id, x, y, round((r * 299 + g * 587 + b * 114) / 1000, 6) AS luma_permille, round({LUMA_SQL}, 6) AS luma_float,
  CAST({GREY_SQL} AS INT) AS grey, '#' || lower(printf('%02x%02x%02x', r, g, b)) AS hex FROM fx_colour_pixels"""))
def pixel_luma(t: Tables) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return crops(t).select("crop_id", "x", "y", r6(C.luma_permille(r, g, b), "luma_permille"),
                           r6(C.luma_float(r, g, b), "luma_float"), C.grey_fixed_point(r, g, b).alias("grey"),
                           C.rgb_hex(r, g, b).alias("hex"))


@query("crop_border", with_views(("fx_colour_pixels",), "SELECT * FROM edge", MASKED[:2]))
def crop_border(t: Tables) -> DataFrame:
    return R.border(sized(t)).select("crop_id", "x", "y", *R.CHANNELS)


@query("bg_colour", with_views(("fx_colour_pixels",), "SELECT * FROM bg", MASKED))
def bg_colour(t: Tables) -> DataFrame:
    return R.background(sized(t), KEYS)


UPPER = ", ".join(f"list_sort(list({c}))[len(list({c})) // 2 + 1] AS bg_{c}" for c in R.CHANNELS)


@query("bg_upper", with_views(("fx_colour_pixels",), f"SELECT crop_id, {UPPER} FROM edge GROUP BY crop_id", MASKED[:2]))
def bg_upper(t: Tables) -> DataFrame:
    return R.background_upper(sized(t), KEYS)


@query("text_mask", with_views(("fx_colour_pixels",), "SELECT * FROM mask", MASKED))
def text_mask(t: Tables) -> DataFrame:
    pixels = sized(t)
    return R.text_mask(pixels, R.background(pixels, KEYS), KEYS)


@query("dilated_mask", with_views(("fx_pixels", "fx_colour_pixels"), "SELECT * FROM grown", GROWN))
def dilated_mask(t: Tables) -> DataFrame:
    return grown_mask(t)[0]


@query("flat_fill", with_views(("fx_pixels", "fx_colour_pixels"), """
SELECT p.crop_id, p.x, p.y, CASE WHEN m.x IS NULL THEN b ELSE bg_b END AS b, CASE WHEN m.x IS NULL THEN g ELSE bg_g END AS g,
  CASE WHEN m.x IS NULL THEN r ELSE bg_r END AS r, m.x IS NOT NULL AS is_filled
FROM px p JOIN bg USING (crop_id) LEFT JOIN grown m ON p.crop_id = m.crop_id AND p.x = m.x AND p.y = m.y""", GROWN))
def flat_fill(t: Tables) -> DataFrame:
    mask, bg = grown_mask(t)
    return R.flat_fill(crops(t), mask, bg, KEYS)


@query("union_masks", with_views(("fx_colour_pixels",), """
SELECT crop_id, x, y FROM mask UNION SELECT crop_id, x, y FROM edge""", MASKED))
def union_masks(t: Tables) -> DataFrame:
    pixels = sized(t)
    mask = R.text_mask(pixels, R.background(pixels, KEYS), KEYS)
    return R.union_masks(mask, R.border(pixels).select("crop_id", "x", "y"))


@query("needs_inpaint", with_views(("fx_colour_pixels",), """
SELECT crop_id AS page_id FROM (SELECT DISTINCT crop_id FROM px) WHERE crop_id IN (SELECT crop_id FROM mask)""", MASKED))
def needs_inpaint(t: Tables) -> DataFrame:
    pixels = sized(t)
    mask = R.text_mask(pixels, R.background(pixels, KEYS), KEYS)
    pages = t["embeddings"].select(F.col("vec_id").alias("page_id"))
    return R.needs_inpaint(pages, mask.withColumnRenamed("crop_id", "page_id"))


@query("erase_route", with_views(("fx_colour_pixels",), """
SELECT crop_id, CASE WHEN crop_id % 3 <> 0 AND is_uniform THEN 'flat' ELSE 'inpaint' END AS erase_route FROM bg""", MASKED))
def erase_route(t: Tables) -> DataFrame:
    kind = F.when(F.col("crop_id") % 3 == 0, "onomatopoeia").when(F.col("crop_id") % 3 == 1, "bubble")
    return W.erase_route(R.background(sized(t), KEYS).withColumn("type", kind)).select("crop_id", "erase_route")


MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
# Crops have radius 1, 2 or 4 by turns.
BLUR = (("bells", "SELECT i - 4 AS o, exp(-((i - 4) * (i - 4)) / (2 * 1.7e0 * 1.7e0)) AS w FROM range(9) v(i)"),
        ("taps", """SELECT 1 AS r, i - 1 AS o, [0.25e0, 0.5e0, 0.25e0][i + 1] AS w FROM range(3) v(i)
          UNION ALL SELECT 2, i - 2, [0.0625e0, 0.25e0, 0.375e0, 0.25e0, 0.0625e0][i + 1] FROM range(5) v(i)
          UNION ALL SELECT 4, o, w / (SELECT sum(w) FROM bells) FROM bells"""),
        ("blurred", f"""SELECT p.crop_id, p.x, p.y, sum(h.w * v.w) AS alpha FROM px p, taps h, taps v, mask m
          WHERE h.r = CASE p.crop_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AND v.r = h.r AND m.crop_id = p.crop_id AND m.x = {MIRROR.format('(p.x + h.o)')} AND m.y = {MIRROR.format('(p.y + v.o)')} GROUP BY ALL"""))


def radius_sizes(pixels: DataFrame) -> DataFrame:
    """Crop sizes with a feather radius of their own."""
    k = F.col("crop_id") % 3
    return pixels.select("crop_id", "cw", "ch").distinct().withColumn("feather_radius", F.when(k == 0, 1).when(k == 1, 2).otherwise(4))


@query("blurred_mask", with_views(("fx_colour_pixels",), "SELECT crop_id, x, y, round(alpha, 6) AS alpha FROM blurred", MASKED + BLUR))
def blurred_mask(t: Tables) -> DataFrame:
    pixels = sized(t)
    mask = R.text_mask(pixels, R.background(pixels, KEYS), KEYS)
    return R.blur_mask(mask, radius_sizes(pixels), KEYS, "feather_radius").withColumn("alpha", F.round("alpha", 6))


MIXED = ", ".join(f"CAST(floor((255 - p.{c}) * coalesce(alpha, 0) + p.{c} * (1 - coalesce(alpha, 0)) + 1e-9) AS INT) AS {c}" for c in R.CHANNELS)


@query("feather_blend", with_views(("fx_colour_pixels",), f"""
SELECT p.crop_id, p.x, p.y, {MIXED} FROM px p LEFT JOIN blurred a ON p.crop_id = a.crop_id AND p.x = a.x AND p.y = a.y""", MASKED + BLUR))
def feather_blend(t: Tables) -> DataFrame:
    """The negative of a crop blended over the crop along its text mask."""
    pixels = sized(t)
    mask = R.text_mask(pixels, R.background(pixels, KEYS), KEYS)
    negative = crops(t).withColumns({c: 255 - F.col(c) for c in R.CHANNELS})
    return R.feather_blend(crops(t), negative, mask, radius_sizes(pixels), KEYS, "feather_radius")


@query("composite", with_views(("fx_colour_pixels",), ", ".join([
    "SELECT crop_id, x, y", *[f"CAST(floor((255 - {c}) * (x / 8e0) + {c} * (1 - x / 8e0) + 1e-9) AS INT) AS {c}" for c in R.CHANNELS]])
    + " FROM fx_colour_pixels"))
def composite(t: Tables) -> DataFrame:
    negative = crops(t).withColumns({c: 255 - F.col(c) for c in R.CHANNELS})
    alpha = crops(t).select("crop_id", "x", "y", (F.col("x") / 8).alias("alpha"))
    return R.composite(crops(t), negative, alpha, KEYS)


BILATERAL_SQL = """
SELECT crop_id, x, y, CAST(floor(sum(nb * w) / sum(w) + 0.5e0) AS INT) AS b, CAST(floor(sum(ng * w) / sum(w) + 0.5e0) AS INT) AS g,
  CAST(floor(sum(nr * w) / sum(w) + 0.5e0) AS INT) AS r
FROM (SELECT p.crop_id, p.x, p.y, q.b AS nb, q.g AS ng, q.r AS nr,
    exp(-(dx.o * dx.o + dy.o * dy.o) / 5000e0) * exp(-pow(abs(p.b - q.b) + abs(p.g - q.g) + abs(p.r - q.r), 2) / 5000e0) AS w
  FROM px p, (SELECT i - 2 AS o FROM range(5) v(i)) dx, (SELECT i - 2 AS o FROM range(5) v(i)) dy, px q
  WHERE dx.o * dx.o + dy.o * dy.o <= 4 AND q.crop_id = p.crop_id AND q.x = """ + MIRROR.format("(p.x + dx.o)") + " AND q.y = " \
    + MIRROR.format("(p.y + dy.o)") + ") GROUP BY crop_id, x, y"


@query("bilateral", with_views(("fx_colour_pixels",), BILATERAL_SQL, PX))
def bilateral(t: Tables) -> DataFrame:
    return R.bilateral(sized(t), KEYS)


@query("solid_crops", with_views(("fx_pixels",), """
SELECT p.crop_id, bool_and(abs(p.v - f.v) <= 8) AS is_solid FROM flat p JOIN flat f ON p.crop_id = f.crop_id AND f.x = 0 AND f.y = 0 GROUP BY p.crop_id""",
    (("flat", "SELECT crop_id, x, y, CASE WHEN label % 3 = 0 THEN 100 + gray % (7 + label % 5) ELSE gray END AS v FROM fx_pixels"),)))
def solid_crops(t: Tables) -> DataFrame:
    g, label = F.col("gray"), F.col("label")
    value = F.when(label % 3 == 0, 100 + g % (7 + label % 5)).otherwise(g)
    return R.is_solid(t["fx_pixels"].select("crop_id", "x", "y", *[value.alias(c) for c in R.CHANNELS]), KEYS)


@query("blank_pages", with_views(("fx_pages", "fx_pixels"), """
SELECT page_id, name, CASE WHEN solid THEN 'completed' ELSE status END AS status, solid AS is_blank
FROM (SELECT p.*, coalesce(s.solid, false) AS solid FROM fx_pages p LEFT JOIN (
  SELECT crop_id, max(v) - min(v) = 0 AS solid FROM (SELECT crop_id, CASE WHEN label % 2 = 0 THEN 7 ELSE gray END AS v FROM fx_pixels) GROUP BY crop_id) s
  ON s.crop_id = p.page_id)"""))
def blank_pages(t: Tables) -> DataFrame:
    value = F.when(F.col("label") % 2 == 0, F.lit(7)).otherwise(F.col("gray"))
    pixels = t["fx_pixels"].select(F.col("crop_id").alias("page_id"), "x", "y", *[value.alias(c) for c in R.CHANNELS])
    solid = R.is_solid(pixels, ["page_id"], 0)
    blank, rest = W.split_blank(t["fx_pages"].select("page_id", "name", "status"), solid)
    columns = ["page_id", "name", "status"]
    return blank.select(*columns, F.lit(True).alias("is_blank")).unionByName(rest.select(*columns, F.lit(False).alias("is_blank")))


def hex_sql(r: str, g: str, b: str) -> str:
    parts = ", ".join(f"CAST(floor({c} + 0.5e0) AS INT)" for c in (r, g, b))
    return f"printf('#%02x%02x%02x', {parts})"


@query("block_colours", with_views(("fx_colour_pixels",), f"""
SELECT crop_id, CASE WHEN n > 8 THEN {hex_sql('sr / n', 'sg / n', 'sb / n')}
    WHEN (bg_r * 299 + bg_g * 587 + bg_b * 114) / 1000e0 > 127 THEN {hex_sql('dark.r', 'dark.g', 'dark.b')}
    ELSE {hex_sql('light.r', 'light.g', 'light.b')} END AS text_color, {hex_sql('bg_r', 'bg_g', 'bg_b')} AS bg_color
FROM (SELECT crop_id, bg_b, bg_g, bg_r, count(*) FILTER (WHERE far) AS n, CAST(sum(r) FILTER (WHERE far) AS DOUBLE) AS sr,
    CAST(sum(g) FILTER (WHERE far) AS DOUBLE) AS sg, CAST(sum(b) FILTER (WHERE far) AS DOUBLE) AS sb,
    arg_min({{'r': r, 'g': g, 'b': b}}, {{'l': luma, 'i': y * 8 + x}}) AS dark, arg_max({{'r': r, 'g': g, 'b': b}}, {{'l': luma, 'i': -(y * 8 + x)}}) AS light
  FROM (SELECT *, abs(r - bg_r) + abs(g - bg_g) + abs(b - bg_b) > 60 AS far, (r * 299 + g * 587 + b * 114) / 1000e0 AS luma FROM px JOIN upper_bg USING (crop_id))
  GROUP BY ALL)""", MASKED[:2] + (("upper_bg", f"SELECT crop_id, {UPPER} FROM edge GROUP BY crop_id"),)))
def block_colours(t: Tables) -> DataFrame:
    return R.block_colours(sized(t), KEYS)


RECTS_SQL = ("areas", """SELECT vec_id AS page_id, i AS ordinal, CASE i WHEN 0 THEN 1 ELSE CAST(vec_id % 4 AS INT) END AS x0, CASE i WHEN 0 THEN 2 ELSE 0 END AS y0,
  CASE i WHEN 0 THEN 5 ELSE 8 END AS x1, CASE i WHEN 0 THEN 8 ELSE 3 END AS y1 FROM embeddings, (VALUES (0), (1)) v(i)""")


@query("crop_pixels", with_views(("fx_colour_pixels",), """
SELECT page_id, ordinal, x - x0 AS x, y - y0 AS y, b, g, r, x0, y0 FROM px JOIN areas ON page_id = crop_id
WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1""", PX + (RECTS_SQL,)))
def crop_pixels(t: Tables) -> DataFrame:
    """Two overlapping rectangles per crop, on tiles of 4 pixels."""
    second = (F.col("vec_id") % 4).cast("int")
    rect = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x1).alias("x1"),
                              F.lit(y1).alias("y1")) for i, x0, y0, x1, y1 in ((0, 1, 2, 5, 8), (1, 0, 0, 8, 3))])
    areas = t["embeddings"].select(F.col("vec_id").alias("page_id"), second.alias("_s"), F.explode(rect).alias("q"))
    areas = areas.select("page_id", "q.ordinal", F.when(F.col("q.ordinal") == 1, F.col("_s")).otherwise(F.col("q.x0")).alias("x0"),
                         "q.y0", "q.x1", "q.y1")
    return R.crop_pixels(crops(t).withColumnRenamed("crop_id", "page_id"), areas, tile=4)


COVERS = (("covers", """SELECT vec_id AS page_id, i AS ordinal, CASE i WHEN 0 THEN 1.2e0 ELSE CAST(vec_id % 4 AS DOUBLE) END AS x0, CASE i WHEN 0 THEN 2e0 ELSE 0.5e0 END AS y0,
    CASE i WHEN 0 THEN 5.7e0 ELSE 8e0 END AS x1, CASE i WHEN 0 THEN 8e0 ELSE 3.5e0 END AS y1, CASE i WHEN 0 THEN 255 ELSE 16 END AS cr, CASE i WHEN 0 THEN 255 ELSE 32 END AS cg,
    CASE i WHEN 0 THEN 255 ELSE 48 END AS cb FROM embeddings, (VALUES (0), (1)) v(i)"""),
          ("layered", """SELECT p.*, c0.page_id IS NOT NULL AS h0, c1.page_id IS NOT NULL AS h1 FROM px p
    LEFT JOIN covers c0 ON c0.ordinal = 0 AND c0.page_id = crop_id AND x + 0.5e0 >= c0.x0 AND x + 0.5e0 < c0.x1 AND y + 0.5e0 >= c0.y0 AND y + 0.5e0 < c0.y1
    LEFT JOIN covers c1 ON c1.ordinal = 1 AND c1.page_id = crop_id AND x + 0.5e0 >= c1.x0 AND x + 0.5e0 < c1.x1 AND y + 0.5e0 >= c1.y0 AND y + 0.5e0 < c1.y1"""))


def painted_sql(c: str, top: int) -> str:
    first = f"CASE WHEN h0 THEN 255 * 0.75e0 + {c} * (1 - 0.75e0) ELSE CAST({c} AS DOUBLE) END"
    both = f"CASE WHEN h1 THEN {top} * 0.75e0 + ({first}) * (1 - 0.75e0) ELSE {first} END"
    return f"CASE WHEN h0 OR h1 THEN CAST(floor({both} + 0.5e0) AS INT) ELSE {c} END AS {c}"


@query("painted_covers", with_views(("fx_colour_pixels",), "SELECT crop_id AS page_id, x, y, " + ", ".join(
    painted_sql(c, top) for c, top in (("b", 48), ("g", 32), ("r", 16))) + " FROM layered", PX + COVERS))
def painted_covers(t: Tables) -> DataFrame:
    """Two overlapping covers per crop, the second on top."""
    second = (F.col("vec_id") % 4).cast("double")
    rect = F.array(*[F.struct(*[v.alias(n) for n, v in zip(("ordinal", "x", "y", "x1", "y1", "cover_color"), map(F.lit, r))])
                     for r in ((0, 1.2, 2.0, 5.7, 8.0, "#ffffff"), (1, 0.0, 0.5, 8.0, 3.5, "#102030"))])
    rows = t["embeddings"].select(F.col("vec_id").alias("page_id"), second.alias("_s"), F.explode(rect).alias("q")).select("page_id", "_s", "q.*")
    rows = rows.withColumn("x", F.when(F.col("ordinal") == 1, F.col("_s")).otherwise(F.col("x")))
    covers = rows.withColumns({"w": F.col("x1") - F.col("x"), "h": F.col("y1") - F.col("y"), "cover_alpha": F.lit(0.75)})
    return R.paint_covers(crops(t).withColumnRenamed("crop_id", "page_id"), covers)


HALVES = (("half", """SELECT crop_id * 2 + i AS k, crop_id, i AS ordinal, x, x - 4 * i AS cx, y, b, g, r, 4 AS cw, 8 AS ch
    FROM fx_colour_pixels, (VALUES (0), (1)) v(i) WHERE x >= 4 * i AND x < 4 * i + 4"""),
          ("half_px", "SELECT k, cx AS x, y, b, g, r, cw, ch FROM half"), *mask_ctes("k", "half_px"),
          ("routed", """SELECT k, k // 2 AS page_id, CAST(k % 2 AS INT) AS ordinal, bg_b, bg_g, bg_r,
             CASE WHEN is_uniform AND NOT (k % 2 = 1 AND (k // 2) % 2 = 1) THEN 'flat' ELSE 'inpaint' END AS erase_route FROM bg"""),
          ("offsets", "SELECT erase_route, CAST(i - 2 AS INT) AS d FROM (VALUES ('flat', 1), ('inpaint', 2)) v(erase_route, rad), range(5) w(i) WHERE abs(i - 2) <= rad"),
          ("grown", """SELECT DISTINCT r.page_id, r.ordinal, m.x + h.d + 4 * r.ordinal AS x, m.y + v.d AS y, r.erase_route, bg_b, bg_g, bg_r
             FROM mask m JOIN routed r USING (k) JOIN offsets h ON h.erase_route = r.erase_route JOIN offsets v ON v.erase_route = r.erase_route
             WHERE m.x + h.d BETWEEN 0 AND 3 AND m.y + v.d BETWEEN 0 AND 7"""))


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each crop as a page of 8 by 8 with a left and a right block."""
    i = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = t["embeddings"].select(F.col("vec_id").alias("page_id"), i.alias("ordinal"))
    kind = F.when((F.col("ordinal") == 1) & (F.col("page_id") % 2 == 1), "onomatopoeia").when(F.col("ordinal") == 0, "bubble")
    blocks = rows.select("page_id", "ordinal", kind.alias("type"), (F.col("ordinal") * 50.0).alias("xmin"), F.lit(0.0).alias("ymin"),
                         (F.col("ordinal") * 50.0 + 50).alias("xmax"), F.lit(100.0).alias("ymax"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return crops(t).withColumnRenamed("crop_id", "page_id"), blocks


ERASED = """SELECT p.crop_id AS page_id, p.x, p.y, coalesce(f.bg_b, p.b) AS b, coalesce(f.bg_g, p.g) AS g, coalesce(f.bg_r, p.r) AS r
FROM fx_colour_pixels p LEFT JOIN grown f ON f.page_id = p.crop_id AND f.x = p.x AND f.y = p.y AND f.erase_route = 'flat'"""


@query("erased_pixels", with_views(("fx_colour_pixels",), ERASED, HALVES))
def erased_pixels(t: Tables) -> DataFrame:
    """Flat fills, blocks known not to overlap."""
    pixels, blocks = _halves(t)
    return E.erase_page(pixels, blocks, "normal", disjoint=True).pixels


@query("erased_in_order", with_views(("fx_colour_pixels",), ERASED, HALVES))
def erased_in_order(t: Tables) -> DataFrame:
    """The same through the ordered steps, which serve overlapping blocks too."""
    pixels, blocks = _halves(t)
    return E.erase_page(pixels, blocks, "normal").pixels


FINISHED = ", ".join(f"CAST(floor(s.{c} * coalesce(alpha, 0) + p.{c} * (1 - coalesce(alpha, 0)) + 1e-9) AS INT) AS {c}" for c in R.CHANNELS)


@query("finish_inpaint", with_views(("fx_colour_pixels",), f"""
SELECT p.crop_id AS page_id, p.x, p.y, {FINISHED} FROM px p JOIN smooth s ON p.crop_id = s.crop_id AND p.x = s.x AND p.y = s.y
LEFT JOIN blurred a ON p.crop_id = a.crop_id AND p.x = a.x AND p.y = a.y""", MASKED + BLUR + (("smooth", BILATERAL_SQL),)))
def finish_inpaint(t: Tables) -> DataFrame:
    """Smooth a crop and blend it back along its text mask."""
    pixels = sized(t)
    mask = R.text_mask(pixels, R.background(pixels, KEYS), KEYS).withColumnRenamed("crop_id", "page_id")
    own = pixels.withColumnRenamed("crop_id", "page_id")
    sizes = radius_sizes(pixels).withColumnRenamed("crop_id", "page_id")
    own = own.drop("cw", "ch")
    return E.finish_inpaint(own, own, mask, sizes)


@query("inpainted_pixels", with_views(("fx_colour_pixels",), ", ".join([
    "SELECT p.crop_id AS page_id, p.x, p.y",
    *[f"CASE WHEN m.x IS NULL THEN p.{c} ELSE coalesce(CAST(floor(fill_{c}) AS INT), 255) END AS {c}" for c in R.CHANNELS]]) + """
FROM px p LEFT JOIN mask m ON m.crop_id = p.crop_id AND m.x = p.x AND m.y = p.y LEFT JOIN fills f ON f.crop_id = p.crop_id""",
    MASKED + (("fills", "SELECT p.crop_id, " + ", ".join(f"median({c}) AS fill_{c}" for c in R.CHANNELS) + """
      FROM px p ANTI JOIN mask m ON m.crop_id = p.crop_id AND m.x = p.x AND m.y = p.y GROUP BY p.crop_id"""),)))
def inpainted_pixels(t: Tables) -> DataFrame:
    """The built-in inpainter on the text mask of every crop."""
    pixels = sized(t)
    mask = R.text_mask(pixels, R.background(pixels, KEYS), KEYS).withColumnRenamed("crop_id", "page_id")
    return run_inpainter(crops(t).withColumnRenamed("crop_id", "page_id"), mask)


def _pyramid_sql(top: int) -> tuple[tuple[str, str], ...]:
    """The pyramid of averages over the mask's holes, `top` levels high: sums going up, weighted means going down."""
    ctes: list[tuple[str, str]] = [
        ("known0", "SELECT crop_id, x, y, 1 AS n, " + ", ".join(f"{c} AS s_{c}" for c in R.CHANNELS)
         + " FROM px p ANTI JOIN mask m ON m.crop_id = p.crop_id AND m.x = p.x AND m.y = p.y"),
        ("missing0", "SELECT DISTINCT crop_id, x, y FROM mask")]
    for k in range(1, top + 1):
        ctes.append((f"known{k}", f"SELECT crop_id, x >> 1 AS x, y >> 1 AS y, CAST(sum(n) AS BIGINT) AS n, "
                     + ", ".join(f"CAST(sum(s_{c}) AS BIGINT) AS s_{c}" for c in R.CHANNELS) + f" FROM known{k - 1} GROUP BY 1, 2, 3"))
        ctes.append((f"missing{k}", f"""SELECT DISTINCT m.crop_id, m.x >> 1 AS x, m.y >> 1 AS y FROM missing{k - 1} m
            ANTI JOIN known{k} n ON n.crop_id = m.crop_id AND n.x = m.x >> 1 AND n.y = m.y >> 1"""))
    for k in range(top, 0, -1):
        own = f"SELECT crop_id, x, y, " + ", ".join(f"s_{c} * {P.UNIT} // n AS v_{c}" for c in R.CHANNELS) + f" FROM known{k}"
        ctes.append((f"value{k}", own if k == top else f"{own} UNION ALL SELECT * FROM filled{k}"))
        ctes.append((f"filled{k - 1}", f"""SELECT m.crop_id, m.x, m.y, """ + ", ".join(f"CAST(sum(h.w * v.w * a.v_{c}) // sum(h.w * v.w) AS BIGINT) AS v_{c}" for c in R.CHANNELS) + f"""
            FROM missing{k - 1} m, (VALUES (0, {P.NEAR}), (1, {P.FAR})) h(o, w), (VALUES (0, {P.NEAR}), (1, {P.FAR})) v(o, w), value{k} a
            WHERE a.crop_id = m.crop_id AND a.x = (m.x >> 1) + h.o * (CASE WHEN m.x % 2 = 1 THEN 1 ELSE -1 END)
              AND a.y = (m.y >> 1) + v.o * (CASE WHEN m.y % 2 = 1 THEN 1 ELSE -1 END)
            GROUP BY ALL"""))
    return tuple(ctes)


@query("filled_around", with_views(("fx_colour_pixels",), "SELECT p.crop_id AS page_id, p.x, p.y, " + ", ".join(
    f"CAST(CASE WHEN m.x IS NULL THEN p.{c} ELSE coalesce((v_{c} + {P.UNIT // 2}) // {P.UNIT}, {P.WHITE}) END AS INT) AS {c}" for c in R.CHANNELS) + """
FROM px p LEFT JOIN mask m ON m.crop_id = p.crop_id AND m.x = p.x AND m.y = p.y
LEFT JOIN filled0 f ON f.crop_id = p.crop_id AND f.x = p.x AND f.y = p.y""", MASKED + _pyramid_sql(3)))
def filled_around(t: Tables) -> DataFrame:
    """The text mask of every crop filled from its surroundings."""
    pixels = sized(t)
    mask = R.text_mask(pixels, R.background(pixels, KEYS), KEYS).withColumnRenamed("crop_id", "page_id")
    return run_inpainter(crops(t).withColumnRenamed("crop_id", "page_id"), mask, fill="around")


@query("inpaint_mask", with_views(("fx_colour_pixels",), "SELECT DISTINCT page_id, x, y FROM grown WHERE erase_route = 'inpaint'", HALVES))
def inpaint_mask(t: Tables) -> DataFrame:
    pixels, blocks = _halves(t)
    return E.erase_page(pixels, blocks, "normal", disjoint=True).mask
