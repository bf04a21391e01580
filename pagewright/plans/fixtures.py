"""Page, block, reply, edit and pixel views derived from the driver tables.

Each view exists twice: as a Spark plan built from this package's operators and
as SQL for the DuckDB check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import normalise
from ..operators.ranking import with_ordinal
from ..session import tune

_PLANS: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    """Driver tables and derived views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        """A view or table. Only plans are kept, no rows."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _PLANS:
            view = VIEWS.get(name)
            _PLANS[key] = view(self) if view else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return _PLANS[key]


def _fx_pages(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".PNG", ".jpg", ".webp", ".bmp", ".txt")]), (key % 5 + 1).cast("int"))
    return t["orders"].select(
        key.alias("page_id"),
        F.concat(F.lit("ch"), (F.col("o_custkey") % 20).cast("string"), F.lit("_p"), (key % 400).cast("string"), ext).alias("name"),
        (600 + (key % 7) * 100).cast("int").alias("width"), (900 + (key % 5) * 150).cast("int").alias("height"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "idle")
        .otherwise("failed").alias("status"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


def _fx_ocr(t: Tables) -> DataFrame:
    part, supp, flag = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")
    # Names come first, so that the rows stay dealt by page from the window on. Lines without a part count in the ordinals.
    named = t["lineitem"].join(t["part"].select("p_partkey", "p_name"), part == F.col("p_partkey"), "left")
    rows = with_ordinal(named, ["l_orderkey"], LINE_ORDER, bound=t["lineitem"]).where("p_partkey IS NOT NULL")
    px0 = ((part * 37) % 560).cast("int")
    py0 = ((supp * 91 + F.col("l_linenumber") * 83) % 880).cast("int")
    bw = F.when(F.col("l_quantity") == 50, F.lit(0)).otherwise((10 + F.col("l_quantity") * 4).cast("int"))
    bh = (12 + (part * 13) % 240).cast("int")
    text = F.when(flag == "R", F.translate("p_name", "aeiou", "あえいおう")).otherwise(
        F.concat(F.lit("  "), "p_name", F.lit(" ")))
    kind = F.when(flag == "R", "onomatopoeia").when(flag == "A", "bubble")
    boxed = rows.select(F.col("l_orderkey").alias("page_id"), "ordinal", text.alias("text"),
                        (1.0 - F.col("l_discount")).alias("confidence"), px0.alias("px0"), py0.alias("py0"),
                        bw.alias("bw"), bh.alias("bh"), kind.alias("kind"))
    return boxed.withColumns({"px1": F.col("px0") + F.col("bw"), "py1": F.col("py0") + F.col("bh")})


def _fx_ocr_edited(t: Tables) -> DataFrame:
    page = F.col("page_id")
    shift = F.when(page % 3 == 0, 5).otherwise(0)
    kept = t["fx_ocr"].where(~((page % 5 == 0) & (F.col("ordinal") >= 3)))
    return kept.select("page_id", "ordinal", "text", (F.col("px0") + shift).alias("px0"), "py0",
                       (F.col("px1") + shift).alias("px1"), "py1",
                       F.when(page % 7 == 0, "bubble").otherwise(F.col("kind")).alias("kind"))


def _fx_artifacts(t: Tables) -> DataFrame:
    page = F.col("page_id")
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("_blocks.json", "_erased.png", "_translated.png", ".tmp")]),
                          (page % 4 + 1).cast("int"))
    return t["fx_pages"].select(
        F.concat(F.when(page % 11 == 0, "gone_").otherwise(""), "name", suffix).alias("file_name"),
        F.when(F.col("width") % 200 == 0, "cache").otherwise("root").alias("location"))


def _fx_replies(t: Tables) -> DataFrame:
    e = F.col("event_id")
    ident = [F.concat(F.lit('{"id":"b'), (n % 7).cast("string"), F.lit('","translated_text":"')) for n in (e, e * 3)]
    body = F.concat(F.lit('{"translations":['), ident[0], "event_type", F.lit('"},'), ident[1],
                    F.lit('","type":"onomatopoeia"}]'))
    before = F.when(e % 5 == 1, "```json\n").when(e % 5 == 2, "```\n").when(e % 5 == 3, "Sure: ").otherwise("")
    brace = F.when(e % 5 == 4, "").otherwise("}")
    after = F.when((e % 5).isin(1, 2), "\n```").when(e % 5 == 3, " done.").otherwise("")
    return t["events"].select(e.alias("event_id"), F.col("user_id").alias("page_id"),
                              F.concat(before, body, brace, after).alias("raw"))


def _fx_edits(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    op = (F.when(kind == "click", "text").when(kind == "view", "text_color").when(kind == "purchase", "move")
          .when(kind == "signup", "type").otherwise("delete"))
    return t["events"].select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("page_id"),
        F.concat(F.lit("b"), (F.col("event_id") % 4).cast("string")).alias("block_id"), "ts", op.alias("op"),
        F.col("props").alias("payload"), (F.col("value") / 10).alias("dx"), ((200 - F.col("value")) / 10).alias("dy"))


def _fx_pixels(t: Tables) -> DataFrame:
    cells = t["embeddings"].select(F.col("vec_id").alias("crop_id"), "label", F.posexplode("embedding").alias("pos", "e"))
    rows = cells.select("crop_id", "label", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), "e")
    edge = F.col("x").isin(0, 7) | F.col("y").isin(0, 7)
    damped = F.when((F.col("label") % 2 == 0) & edge, F.lit(0.3)).otherwise(F.lit(1.0))
    level = (F.col("e").cast("double") * damped + 0.5) * 255
    return rows.select("crop_id", "label", "x", "y",
                       F.floor(F.least(F.greatest(level, F.lit(0.0)), F.lit(255.0))).cast("int").alias("gray"))


def _fx_blocks(t: Tables) -> DataFrame:
    """Blocks in percent with colours; the text doubles as its translation."""
    ocr = t["fx_ocr"].select("page_id", "ordinal", "text", "px0", "py0", "px1", "py1", F.col("kind").alias("type"))
    o = F.col("ordinal")
    return normalise(ocr, t["fx_pages"]).withColumns({
        "translated_text": F.col("original_text"),
        "text_color": F.when(o % 2 == 0, "#000000").otherwise("#112233"),
        "bg_color": F.when(o % 3 == 0, "#ffffff").otherwise("#eeeecc")})


def _fx_colour_pixels(t: Tables) -> DataFrame:
    """Crops with three different channels: blue is mirrored, red is halved."""
    g = F.col("gray")
    return t["fx_pixels"].select("crop_id", "label", "x", "y", (255 - g).alias("b"), g.alias("g"),
                                 F.floor(g / 2).cast("int").alias("r"))


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "fx_pages": _fx_pages, "fx_ocr": _fx_ocr, "fx_ocr_edited": _fx_ocr_edited, "fx_artifacts": _fx_artifacts,
    "fx_replies": _fx_replies, "fx_edits": _fx_edits, "fx_pixels": _fx_pixels, "fx_blocks": _fx_blocks,
    "fx_colour_pixels": _fx_colour_pixels,
}
