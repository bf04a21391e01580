"""Block lists and artifacts as append-only Parquet tables, and as files of a page folder.

Every write adds rows with a version; readers take the newest version per key.
A repeated or half-finished write therefore never damages earlier content, and
nothing is rewritten in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import CACHE_FOLDER

from ..operators.payload import blocks_json
from ..operators.ranking import last_wins
from ..schema import BLOCK

BUCKETS = 256
FILES_PER_BUCKET = 4
# Hadoop names of a store, as Arrow calls them.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}
FILE_RESULT = "path string, error string"


def _with_bucket(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def _listed(blocks: DataFrame, pages: DataFrame | None, part_rows: int | None, dealt_by: Sequence[str] = ()) -> DataFrame:
    """(page_name, part, blocks_json); pages of `pages` (page_name) without a block have an empty list."""
    listed = blocks_json(blocks, "page_name", part_rows, dealt_by).select("page_name", "part", "blocks_json")
    if pages is None:
        return listed
    emptied = pages.select("page_name").distinct().join(blocks.select("page_name"), "page_name", "left_anti")
    return listed.unionByName(emptied.select("page_name", F.lit(0).alias("part"), F.lit("[]").alias("blocks_json")))


def block_lists(blocks: DataFrame, version: int, pages: DataFrame | None = None, part_rows: int | None = None, dealt_by: Sequence[str] = ()) -> DataFrame:
    """The rows that `write_blocks` stores, without buckets: page_name, part, part_rows, blocks_json, version.

    `dealt_by` as in `blocks_json`.
    """
    listed = _listed(blocks, pages, part_rows, dealt_by)
    return listed.select("page_name", "part", F.lit(part_rows or 0).alias("part_rows"), "blocks_json", F.lit(version).cast("long").alias("version"))


def write_blocks(blocks: DataFrame, path: str, version: int, pages: DataFrame | None = None, part_rows: int | None = None) -> None:
    """One JSON list per page name (and part), in block order.

    `pages` names the pages this version decides on: one that has lost its last
    block is stored as an empty list, so its older blocks do not come back. A
    bucket is written by at most FILES_PER_BUCKET tasks.
    """
    listed = _listed(blocks, pages, part_rows).withColumn("part_rows", F.lit(part_rows or 0))
    rows = _with_bucket(listed.withColumn("version", F.lit(version).cast("long")), "page_name")
    _by_bucket(rows).write.partitionBy("bucket").mode("append").parquet(path)


def _by_bucket(rows: DataFrame) -> DataFrame:
    share = F.pmod(F.xxhash64("page_name", F.lit(1)), F.lit(FILES_PER_BUCKET))
    return rows.repartition("bucket", share)


def compact(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """The newest rows per key of a sink's table as a new table, so that reads stop to see all history.

    `keys`: ["page_name"] for block lists, ["page_name", "kind"] for artifacts.
    """
    rows = spark.read.parquet(path)
    best = rows.groupBy(*keys).agg(F.max("version").alias("version"))
    unique = [*keys, "version", *[c for c in ("part",) if c in rows.columns]]
    _by_bucket(rows.join(best, [*keys, "version"], "left_semi").dropDuplicates(unique)).write.partitionBy("bucket").parquet(target)


def newest(table: DataFrame, key: str) -> DataFrame:
    top = table.groupBy(key).agg(F.max("version").alias("version"))
    return table.join(top, [key, "version"], "left_semi")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The newest block rows of every page name. A repeated write of one version counts once."""
    rows = newest(spark.read.parquet(path), "page_name").dropDuplicates(["page_name", "version", "part"])
    items = rows.select("page_name", (F.col("part") * F.col("part_rows")).alias("_base"),
                        F.posexplode(F.from_json("blocks_json", f"array<{BLOCK.simpleString()}>")).alias("_pos", "_b"))
    return items.select("page_name", (F.col("_base") + F.col("_pos")).alias("ordinal"),
                        *[F.col("_b")[f.name].alias("block_id" if f.name == "id" else f.name) for f in BLOCK.fields])


def write_artifacts(artifacts: DataFrame, path: str, version: int) -> None:
    """Records (page_name, kind, render_hash, content)."""
    rows = _with_bucket(artifacts.withColumn("version", F.lit(version).cast("long")), "page_name")
    _by_bucket(rows).write.partitionBy("bucket").mode("append").parquet(path)


def read_artifacts(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """The newest record per page name and kind. Without content the bytes are not read."""
    rows = spark.read.parquet(path).drop("bucket")
    if with_content:
        # Decide on the narrow columns first; the bytes are shuffled once, without sorting.
        best = rows.groupBy("page_name", "kind").agg(F.max("version").alias("version"))
        return rows.join(best, ["page_name", "kind", "version"], "left_semi").dropDuplicates(["page_name", "kind"])
    return last_wins(rows.drop("content"), ["page_name", "kind"], ["version"])


def replace_pages(new: DataFrame, path: str) -> None:
    """The manifest of a newly opened folder replaces the old one."""
    new.write.mode("overwrite").parquet(path)


def _open_folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path. Paths without a scheme are local, so a cluster needs a shared mount or a scheme."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return arrow_fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return arrow_fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{quote(rest, safe='/:@?=&%')}")


def write_block_files(blocks: DataFrame, folder: str, pages: DataFrame | None = None) -> DataFrame:
    """Write `<page_name>_blocks.json` into the cache folder, one file per page; gives (path, error).

    `pages` (page_name) as in `write_blocks`: a page without blocks is written
    as an empty list. Executors write when the result is read. A file is
    written under another name and then moved, so a reader never sees half a
    file and a repeated task writes the same one again; a page that cannot be
    written gives its error and the others go on.
    """
    listed = _listed(blocks, pages, None)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = f"{folder}/{CACHE_FOLDER}"
        for batch in batches:
            errors = []
            for row in batch.itertuples(index=False):
                try:
                    files, place = _open_folder(root)
                    files.create_dir(place, recursive=True)
                    draft = f"{place}/.{row.page_name}.{uuid.uuid4().hex}"
                    with files.open_output_stream(draft) as stream:
                        stream.write(row.blocks_json.encode())
                    files.move(draft, f"{place}/{row.page_name}_blocks.json")
                    errors.append(None)
                except (OSError, ValueError) as failure:
                    errors.append(str(failure))
            yield pd.DataFrame({"path": [f"{root}/{name}_blocks.json" for name in batch["page_name"]], "error": errors})

    return listed.mapInPandas(write, FILE_RESULT)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) as files of `folder`, such as `<page>_erased.png`; gives (path, error).

    As `write_block_files`: moved into place when whole, one error per file that cannot be written.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for row in batch.itertuples(index=False):
                try:
                    place, root = _open_folder(folder)
                    place.create_dir(root, recursive=True)
                    draft = f"{root}/.{row.name}.{uuid.uuid4().hex}"
                    with place.open_output_stream(draft) as stream:
                        stream.write(bytes(row.content))
                    place.move(draft, f"{root}/{row.name}")
                    errors.append(None)
                except (OSError, ValueError, TypeError) as failure:
                    errors.append(str(failure))
            yield pd.DataFrame({"path": [f"{folder}/{name}" for name in batch["name"]], "error": errors})

    return files.select("name", "content").mapInPandas(write, FILE_RESULT)


def artifact_files(artifacts: DataFrame, folder: str) -> DataFrame:
    """Write artifact records (page_name, kind, content) into the cache folder under the names that `list_artifacts` knows."""
    return write_files(artifacts.select(F.concat("page_name", F.lit("_"), "kind", F.lit(".png")).alias("name"), "content"), f"{folder}/{CACHE_FOLDER}")


def delete_files(listing: DataFrame) -> DataFrame:
    """Delete the files of `path` (such as orphans); gives (path, error). A file that is gone already is no error.

    Executors delete when the result is read.
    """
    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for path in batch["path"]:
                try:
                    files, name = _open_folder(path)
                    files.delete_file(name)
                    errors.append(None)
                except FileNotFoundError:
                    errors.append(None)
                except (OSError, ValueError) as failure:
                    errors.append(str(failure))
            yield pd.DataFrame({"path": batch["path"], "error": errors})

    return listing.select("path").mapInPandas(delete, FILE_RESULT)
