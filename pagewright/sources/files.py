"""Page folders, images and cached files as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import strict_json
from ..functions.names import CACHE_FOLDER, is_page_image
from ..operators.manifest import with_artifact_parts
from ..operators.raster import CHANNELS, SOLID_TOLERANCE, within_tolerance
from ..plugins import run_decoder
from ..schema import BLOCK

PNG_MAGIC = "89504E470D0A1A0A"
STRIP_ROWS = 64
# Byte runs that are unpacked into pixel rows at once.
RUNS_PER_YIELD = 512
DECODE_ERROR = "Failed to decode image"
PIXELS = "page_id string, x int, y int, b int, g int, r int"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def page_path(path: Column) -> Column:
    """One spelling of local paths for all sources (file:/x, not file:///x)."""
    return F.regexp_replace(path, "^file:///", "file:/")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """Files right under `path`. The content column is never read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(file_name(F.col("path")).alias("file_name"), "path", "length", "modificationTime")


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page images of a folder: page_id (the path), name, path, length."""
    files = _listing(spark, path).where(is_page_image(F.col("file_name")))
    return files.select(page_path(F.col("path")).alias("page_id"), F.col("file_name").alias("name"), "path", "length")


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """Page images as stored: page_id, name, content."""
    files = spark.read.format("binaryFile").load(path).withColumn("name", file_name(F.col("path")))
    return files.where(is_page_image(F.col("name"))).select(page_path(F.col("path")).alias("page_id"), "name", "content")


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Files of the cache folder and of the page folder with location, kind and owner."""
    root = _listing(spark, path).withColumn("location", F.lit("root"))
    cache = f"{path}/{CACHE_FOLDER}"
    if path_exists(spark, cache):
        root = root.unionByName(_listing(spark, cache).withColumn("location", F.lit("cache")))
    return with_artifact_parts(root)


def read_block_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached block lists: (name, has_ocr_cache, blocks).

    The file in the cache folder counts if it exists, also when it is no JSON;
    then the page has no cache.
    """
    def load(folder: str, rank: int) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*_blocks.json").load(folder)
        return files.select(file_name(F.col("path")).alias("file_name"), F.lit(rank).alias("_rank"),
                            F.decode("content", "UTF-8").alias("text"))

    cache = f"{path}/{CACHE_FOLDER}"
    files = load(path, 1)
    if path_exists(spark, cache):
        files = load(cache, 0).unionByName(files)
    owned = with_artifact_parts(files).where(F.col("kind") == "blocks")
    chosen = owned.groupBy(F.col("owner").alias("name")).agg(F.min_by("text", "_rank").alias("text"))
    valid = strict_json(F.col("text")).isNotNull()
    return chosen.select("name", valid.alias("has_ocr_cache"),
                         F.when(valid, F.from_json("text", f"array<{BLOCK.simpleString()}>")).alias("blocks"))


def cached_blocks(cache: DataFrame) -> DataFrame:
    """`read_block_cache` rows as block rows with their ordinal."""
    rows = cache.select("name", F.posexplode_outer("blocks").alias("ordinal", "_b")).where(F.col("ordinal").isNotNull())
    return rows.select("name", "ordinal", *[F.col("_b")[f.name].alias("block_id" if f.name == "id" else f.name)
                                            for f in BLOCK.fields])


def png_dims(content: Column) -> dict[str, Column]:
    """Width and height out of a PNG header; null for anything else."""
    is_png = F.hex(F.substring(content, 1, 8)) == PNG_MAGIC

    def number(start: int) -> Column:
        return F.when(is_png, F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("int"))

    return {"width": number(17), "height": number(21)}


def read_images(spark: SparkSession, path: str, decoder: Callable | None = None) -> DataFrame:
    """Decoded images: page_id, name, width, height, n_channels, data (BGR rows), status, error.

    `decoder` (see `plugins.run_decoder`) gets the files that the image source
    cannot read. A file that does not decode stays as a row with status failed.
    """
    images = spark.read.format("image").load(path).select("image.*").where(is_page_image(file_name(F.col("origin"))))
    ok = F.col("width") > 0
    out = images.select(
        page_path(F.col("origin")).alias("page_id"), file_name(F.col("origin")).alias("name"),
        F.when(ok, F.col("width")).alias("width"), F.when(ok, F.col("height")).alias("height"),
        F.when(ok, F.col("nChannels")).alias("n_channels"), F.when(ok, F.col("data")).alias("data"),
        F.when(ok, F.lit("idle")).otherwise(F.lit("failed")).alias("status"),
        F.when(~ok, F.lit(DECODE_ERROR)).alias("error"))
    if decoder is None:
        return out
    undecoded = out.where(F.col("status") == "failed").select("page_id")
    rest = run_decoder(read_content(spark, path).join(undecoded, "page_id", "left_semi"), decoder)
    return out.where(F.col("status") != "failed").unionByName(rest.select(
        "page_id", "name", "width", "height", "n_channels", "data",
        F.when(F.col("data").isNull(), F.lit("failed")).otherwise(F.lit("idle")).alias("status"),
        F.when(F.col("data").isNull(), F.lit(DECODE_ERROR)).alias("error")))


def image_dims(images: DataFrame) -> DataFrame:
    return images.select("page_id", "width", "height")


def strips(images: DataFrame, rows: int = STRIP_ROWS) -> DataFrame:
    """Images cut into strips of whole rows, so one large image is many rows."""
    n, w = F.col("n_channels"), F.col("width")
    good = images.where(F.col("data").isNotNull())
    cut = good.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(rows))))
    return cut.select("page_id", "width", "height", n.alias("n_channels"), "y0",
                      F.substring("data", F.col("y0") * w * n + 1, w * n * rows).alias("strip"))


def _bgr(data: bytes, n: int) -> np.ndarray:
    """Grey, BGR or BGRA bytes as (pixels, 3); alpha is dropped."""
    flat = np.frombuffer(data, np.uint8).reshape(-1, n)
    return np.repeat(flat, 3, axis=1) if n == 1 else flat[:, :3]


def read_pixels(images: DataFrame) -> DataFrame:
    """All pixels of decoded images. For block work take `read_crops`, which reads less."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                bgr = _bgr(row.strip, row.n_channels)
                at = np.arange(len(bgr))
                yield pd.DataFrame({"page_id": row.page_id, "x": at % row.width, "y": row.y0 + at // row.width,
                                    "b": bgr[:, 0], "g": bgr[:, 1], "r": bgr[:, 2]})

    return strips(images).mapInPandas(explode, PIXELS)


def solid_pages(images: DataFrame, tolerance: int = SOLID_TOLERANCE) -> DataFrame:
    """(page_id, is_solid) over all pixels. Each strip is reduced to its extremes, so no pixel becomes a row."""

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                bgr = _bgr(row.strip, row.n_channels)
                first = bgr[0].astype(int).tolist() if row.y0 == 0 else [None] * 3
                found.append((row.page_id, *first, *bgr.min(axis=0).tolist(), *bgr.max(axis=0).tolist()))
            out = pd.DataFrame(found, columns=["page_id", *[f"{e}_{c}" for e in ("f", "lo", "hi") for c in CHANNELS]])
            yield out.astype({c: "Int32" for c in out.columns[1:]})

    columns = ", ".join(f"{e}_{c} int" for e in ("f", "lo", "hi") for c in CHANNELS)
    parts = strips(images).mapInPandas(extremes, f"page_id string, {columns}")
    ends = parts.groupBy("page_id").agg(
        *[F.max(f"f_{c}").alias(f"f_{c}") for c in CHANNELS], *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in CHANNELS],
        *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in CHANNELS])
    return ends.select("page_id", within_tolerance(tolerance).alias("is_solid"))


def page_facts(images: DataFrame, tolerance: int = SOLID_TOLERANCE) -> DataFrame:
    """(page_id, name, width, height, status, error, is_solid) of `read_images`, from one pass over the pictures.

    `is_solid` is null for a picture that does not decode.
    """
    facts = {"name": "string", "width": "int", "height": "int", "status": "string", "error": "string"}

    def reduce_strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                ends = [None] * 9
                if row.strip is not None:
                    bgr = _bgr(row.strip, int(row.n_channels))
                    first = bgr[0].astype(int).tolist() if row.y0 == 0 else [None] * 3
                    ends = [*first, *bgr.min(axis=0).tolist(), *bgr.max(axis=0).tolist()]
                found.append((row.page_id, row.name, row.width, row.height, row.status, row.error, *ends))
            out = pd.DataFrame(found, columns=["page_id", *facts, *names])
            yield out.astype({c: "Int32" for c in ("width", "height", *names)})

    names = [f"{e}_{c}" for e in ("f", "lo", "hi") for c in CHANNELS]
    n, w = F.col("n_channels"), F.col("width")
    starts = F.when(F.col("data").isNotNull(), F.sequence(F.lit(0), F.col("height") - 1, F.lit(STRIP_ROWS)))
    cut = images.select("*", F.explode_outer(starts).alias("y0")).select(
        "page_id", *facts, "n_channels", "y0", F.substring("data", F.col("y0") * w * n + 1, w * n * STRIP_ROWS).alias("strip"))
    parts = cut.mapInPandas(reduce_strips, "page_id string, " + ", ".join(f"{c} {t}" for c, t in facts.items()) + ", " + ", ".join(f"{c} int" for c in names))
    ends = parts.groupBy("page_id").agg(
        *[F.max(c).alias(c) for c in facts], *[F.max(f"f_{c}").alias(f"f_{c}") for c in CHANNELS],
        *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in CHANNELS], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in CHANNELS])
    return ends.select("page_id", *facts, F.when(F.col("status") != "failed", within_tolerance(tolerance)).alias("is_solid"))


def read_crops(images: DataFrame, rects: DataFrame, rows: int = STRIP_ROWS) -> DataFrame:
    """Pixels under rectangles: page_id, ordinal, x, y (in the crop), b, g, r.

    Strips and rectangles meet on page and strip number, the JVM cuts out the
    byte runs, and only those reach Python.
    """
    number = F.floor(F.col("y0") / rows).cast("int")
    cut = strips(images, rows).withColumn("_s", number)
    spans = F.sequence(F.floor(F.col("y0") / rows).cast("int"), F.floor((F.col("y1") - 1) / rows).cast("int"))
    wanted = rects.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select(
        "page_id", "ordinal", "x0", "x1", F.col("y0").alias("_top"), F.col("y1").alias("_end"), F.explode(spans).alias("_s"))
    met = cut.join(wanted, ["page_id", "_s"])
    line = F.explode(F.sequence(F.greatest(F.col("y0"), F.col("_top")),
                                F.least(F.col("y0") + rows, F.col("height"), F.col("_end")) - 1))
    start = ((F.col("_y") - F.col("y0")) * F.col("width") + F.col("x0")) * F.col("n_channels") + 1
    runs = met.withColumn("_y", line).select(
        "page_id", "ordinal", "n_channels", (F.col("_y") - F.col("_top")).alias("y"),
        F.substring("strip", start, (F.col("x1") - F.col("x0")) * F.col("n_channels")).alias("run"))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), RUNS_PER_YIELD):
                for n, part in batch[start:start + RUNS_PER_YIELD].groupby("n_channels"):
                    lengths = part["run"].map(len).to_numpy() // n
                    bgr = _bgr(b"".join(part["run"]), n)
                    ends = np.cumsum(lengths)
                    x = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
                    repeated = {c: np.repeat(part[c].to_numpy(), lengths) for c in ("page_id", "ordinal", "y")}
                    yield pd.DataFrame({**repeated, "x": x, "b": bgr[:, 0], "g": bgr[:, 1], "r": bgr[:, 2]})

    return runs.mapInPandas(explode, "page_id string, ordinal int, x int, y int, b int, g int, r int")


def with_base64(df: DataFrame, content: str = "content", mime: str = "media_type") -> DataFrame:
    """Adds the base64 text of the content on one line and the media type, image/jpeg by default."""
    return df.withColumns({
        "base64": F.regexp_replace(F.base64(content), r"\s", ""),
        "mime": F.coalesce(F.nullif(F.col(mime), F.lit("")), F.lit("image/jpeg"))}).drop(content)
