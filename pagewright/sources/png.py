"""Pictures put together again: changed pixels go into the strips they come from, strips become PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import CHANNELS, STRIP_ROWS, strips

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
TRUE_COLOUR = 2


def encode_png(width: int, height: int, bgr: bytes) -> bytes:
    """Rows of BGR bytes as a PNG picture in true colour."""
    rgb = np.frombuffer(bgr, np.uint8).reshape(height, width, 3)[..., ::-1]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)], axis=1)  # each line begins with its filter, none

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, TRUE_COLOUR, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def patched_pages(images: DataFrame, changed: DataFrame, rows: int = STRIP_ROWS) -> DataFrame:
    """(page_id, width, height, content): PNG pictures of the pages that have changed pixels.

    `images` as `read_images` gives them; `changed`: page_id, x, y, b, g, r,
    positions once each. Only changed pixels are rows; all others stay bytes of
    their strip. A whole picture is one value, as the file it becomes.
    """
    own = strips(images.join(changed.select(F.col("page_id").alias("_page")).distinct(), F.col("page_id") == F.col("_page"), "left_semi"), rows).withColumn("_s", F.floor(F.col("y0") / rows))
    spots = changed.select(F.col("page_id").alias("_page"), F.floor(F.col("y") / rows).alias("_at"), "x", "y", *CHANNELS)

    def patch(strip: pa.Table, spots: pa.Table) -> pa.Table:
        out = []
        for r in strip.to_pylist():
            n, w = r["n_channels"], r["width"]
            flat = np.frombuffer(r["strip"], np.uint8).reshape(-1, n)
            bgr = (np.repeat(flat, 3, axis=1) if n == 1 else flat[:, :3]).copy()
            at = (spots.column("y").to_numpy() - r["y0"]) * w + spots.column("x").to_numpy()
            bgr[at] = np.stack([spots.column(c).to_numpy() for c in CHANNELS], 1)
            out.append(bgr.tobytes())
        return pa.table({**{c: strip.column(c) for c in ("page_id", "width", "height", "y0")}, "strip": pa.array(out, pa.binary())})

    done = own.groupBy("page_id", "_s").cogroup(spots.groupBy("_page", "_at")).applyInArrow(
        patch, "page_id string, width int, height int, y0 int, strip binary")
    whole = done.groupBy("page_id").agg(F.first("width").alias("width"), F.first("height").alias("height"),
                                        F.transform(F.array_sort(F.collect_list(F.struct("y0", "strip"))), lambda s: s["strip"]).alias("strips"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode_png(r["width"], r["height"], b"".join(r["strips"])) for r in batch.select(["width", "height", "strips"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "width", "height")), pa.array(made, pa.binary())], ["page_id", "width", "height", "content"])

    return whole.mapInArrow(encode, "page_id string, width int, height int, content binary")
