"""Places where models plug in. The models themselves are not part of this package.

A plug-in is a factory without arguments; it runs once per task at most and
returns the function that does the work, so a model is loaded once per task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.semantics import median_avg_trunc
from .functions.text import GLYPH_EM, OTHER_EM, WIDE_CLASS, WIDE_EM, text_em
from .operators.pyramid import fill_holes, hole_values

INPAINT_TILE = 512  # side of the tiles a plugged-in model sees


def _guarded(work: Callable[[], str]) -> tuple[str | None, str | None]:
    try:
        return work(), None
    except Exception as failure:  # one bad page must not stop the others
        return None, str(failure) or type(failure).__name__


def run_decoder(files: DataFrame, decoder: Callable[[], Callable[[bytes], np.ndarray]]) -> DataFrame:
    """(page_id, name, content) to (page_id, name, width, height, n_channels, data).

    The decoder gives rows of BGR, BGRA or grey bytes as an array; where it
    fails, all but the first two columns are null.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = decoder()
        for batch in batches:
            done = []
            for content in batch["content"]:
                try:
                    image = np.asarray(model(bytes(content)), np.uint8)
                    h, w, n = image.shape if image.ndim == 3 else (*image.shape, 1)
                    done.append((w, h, n, image.tobytes()) if w and h else (None,) * 4)
                except Exception:  # one bad page must not stop the others
                    done.append((None,) * 4)
            out = pd.DataFrame(done, columns=["width", "height", "n_channels", "data"])
            out.insert(0, "page_id", batch["page_id"].to_numpy())
            out.insert(1, "name", batch["name"].to_numpy())
            yield out.astype({c: "Int32" for c in ("width", "height", "n_channels")})

    return files.select("page_id", "name", "content").mapInPandas(
        decode, "page_id string, name string, width int, height int, n_channels int, data binary")


def run_ocr(images: DataFrame, engine: Callable[[], Callable[[bytes], list[dict]]],
            content: str = "content") -> DataFrame:
    """(page_id, content) to (page_id, reply, error); the reply is canonical JSON."""

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = engine()
        for batch in batches:
            done = [_guarded(lambda c=c: json.dumps({"blocks": model(bytes(c))}, ensure_ascii=False))
                    for c in batch[content]]
            yield pd.DataFrame({"page_id": batch["page_id"], "reply": [d[0] for d in done],
                                "error": [d[1] for d in done]})

    key = images.schema["page_id"].dataType.simpleString()
    return images.select("page_id", content).mapInPandas(detect, f"page_id {key}, reply string, error string")


def run_translator(requests: DataFrame, translator: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(page_id, part, payload) to (page_id, part, raw, error)."""

    def translate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = translator()
        for batch in batches:
            done = [_guarded(lambda p=p: model(p)) for p in batch["payload"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "part": batch["part"], "raw": [d[0] for d in done],
                                "error": [d[1] for d in done]})

    key = requests.schema["page_id"].dataType.simpleString()
    return requests.select("page_id", "part", "payload").mapInPandas(
        translate, f"page_id {key}, part int, raw string, error string")


def echo_translator() -> Callable[[str], str]:
    """Stub for tests: upper-cases each text and answers with a fenced reply."""

    def answer(payload: str) -> str:
        items = [{"id": b["id"], "translated_text": b["text"].upper(), "type": "bubble"} for b in json.loads(payload)]
        return "```json\n" + json.dumps({"translations": items}, ensure_ascii=False) + "\n```"

    return answer


def fill_median(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Built-in fill: masked pixels take, per channel, the median colour of the page's other pixels.

    The middle pair is averaged and cut; a page without other pixels turns
    white. Medians are counted over the 256 values, so the page's size and its
    cutting into tiles do not matter.
    """
    return _with_fill(_marked(pixels, mask)).select(
        "page_id", "x", "y", *[F.when(F.col("m"), F.col(f"_fill_{c}")).otherwise(F.col(c)).cast("int").alias(c) for c in "bgr"])


def _marked(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels with `m`, true under the mask. A position that the mask names twice counts once."""
    unique = mask.select("page_id", "x", "y").distinct()
    marked = pixels.select("page_id", "x", "y", "b", "g", "r").join(unique.withColumn("m", F.lit(True)), ["page_id", "x", "y"], "left")
    return marked.withColumn("m", F.coalesce("m", F.lit(False)))


def _with_fill(marked: DataFrame) -> DataFrame:
    rest = marked.where(~F.col("m")).groupBy("page_id").agg(*[median_avg_trunc(F.col(c)).alias(f"_fill_{c}") for c in "bgr"])
    return marked.join(rest, "page_id", "left").withColumns({f"_fill_{c}": F.coalesce(f"_fill_{c}", F.lit(255)).cast("int") for c in "bgr"})


def _with_around(marked: DataFrame, values: DataFrame) -> DataFrame:
    fills = values.select("page_id", "x", "y", *[F.col(c).alias(f"_fill_{c}") for c in "bgr"])
    return marked.join(fills, ["page_id", "x", "y"], "left").withColumns({f"_fill_{c}": F.coalesce(f"_fill_{c}", c).cast("int") for c in "bgr"})


def run_inpainter(pixels: DataFrame, mask: DataFrame,
                  inpainter: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None,
                  tile: int = INPAINT_TILE, halo: int = 16, fill: str = "median") -> DataFrame:
    """Pixels (page_id, x, y, b, g, r) with masked positions replaced.

    The built-in `fill` is "median" (one colour per page, `fill_median`) or
    "around" (every hole from its surroundings, `pyramid.fill_holes`). A
    plugged-in model sees tiles with a halo, so a group holds at most
    (tile + 2 halo)^2 pixels whatever the page size; `tile` and `halo` are part
    of what such a model gives. Tiles without mask pixels skip Python. Where
    the model fails, the built-in fill takes its place.
    """
    if fill not in ("median", "around"):
        raise ValueError(f"no such fill: {fill}")
    if inpainter is None:
        return fill_median(pixels, mask) if fill == "median" else fill_holes(pixels, mask)

    def tiles(axis: str) -> Column:
        low = F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / tile)).cast("int")
        return F.sequence(low, F.floor((F.col(axis) + halo) / tile).cast("int"))

    marked = _with_fill(_marked(pixels, mask)) if fill == "median" else _with_around(_marked(pixels, mask), hole_values(pixels, mask))
    busy = marked.where("m").select("page_id", F.floor(F.col("x") / tile).cast("int").alias("tx"),
                                    F.floor(F.col("y") / tile).cast("int").alias("ty")).distinct()
    spread = marked.withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y")))
    wanted = spread.join(busy, ["page_id", "tx", "ty"], "left_semi")
    loaded: list = []  # travels empty with the function, so it is filled once per task

    def work(tile_pixels: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = tile_pixels["x"].min(), tile_pixels["y"].min()
        xs, ys = (tile_pixels["x"] - x0).to_numpy(), (tile_pixels["y"] - y0).to_numpy()
        image = np.zeros((ys.max() + 1, xs.max() + 1, 3), np.uint8)
        hole = np.zeros(image.shape[:2], bool)
        image[ys, xs] = tile_pixels[["b", "g", "r"]].to_numpy()
        hole[ys, xs] = tile_pixels["m"].to_numpy()
        try:
            if not loaded:
                loaded.append(inpainter())
            done = loaded[0](image, hole)
        except Exception:  # the model first, the built-in fill where it fails
            done = image.copy()
            done[ys, xs] = np.where(tile_pixels["m"].to_numpy()[:, None], tile_pixels[["_fill_b", "_fill_g", "_fill_r"]].to_numpy(), done[ys, xs])
        own = (tile_pixels["m"] & (tile_pixels["x"] // tile == tile_pixels["tx"])
               & (tile_pixels["y"] // tile == tile_pixels["ty"])).to_numpy()
        out = tile_pixels.loc[own, ["page_id", "x", "y"]].copy()
        for i, c in enumerate("bgr"):
            out[c] = done[ys[own], xs[own], i].astype("int32")
        return out

    key = pixels.schema["page_id"].dataType.simpleString()
    filled = wanted.groupBy("page_id", "tx", "ty").applyInPandas(work, f"page_id {key}, x int, y int, b int, g int, r int")
    return marked.where(~F.col("m")).select("page_id", "x", "y", "b", "g", "r").unionByName(filled)


def glyph_widths(spark: SparkSession) -> DataFrame:
    """The width model as a table: (char_class, characters, em); the wide class is a pattern."""
    rows = [("wide", WIDE_CLASS, WIDE_EM), *GLYPH_EM, ("other", None, OTHER_EM)]
    return spark.createDataFrame(rows, "char_class string, characters string, em double")


def text_width_px(text: Column, font_px: Column) -> Column:
    return text_em(text) * font_px
