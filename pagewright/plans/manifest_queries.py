"""Queries over page manifests and artifact listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import export_name, is_page_image
from ..operators import manifest as M
from ..operators import payload as P
from ..operators import ranking as K
from ..operators import routing as W
from ..schema import StyleConfig
from .block_queries import BOX, HASH_SQL
from .fixtures import Tables
from .oracle_views import with_views
from .registry import query

OWNER_SQL = """CASE WHEN ends_with(file_name, '_blocks.json') THEN substr(file_name, 1, length(file_name) - 12)
  WHEN ends_with(file_name, '_erased.png') THEN substr(file_name, 1, length(file_name) - 11)
  WHEN ends_with(file_name, '_translated.png') THEN substr(file_name, 1, length(file_name) - 15) END"""
KIND_SQL = """CASE WHEN ends_with(file_name, '_blocks.json') THEN 'blocks' WHEN ends_with(file_name, '_erased.png') THEN 'erased'
  WHEN ends_with(file_name, '_translated.png') THEN 'translated' END"""
OWNED = (("owned", f"SELECT file_name, location, {OWNER_SQL} AS owner, {KIND_SQL} AS kind FROM fx_artifacts"),)
FLAGS = OWNED + (("flags", """SELECT owner, bool_or(kind = 'blocks') AS has_ocr_cache, bool_or(kind <> 'blocks') AS has_erased_cache
  FROM owned WHERE owner <> '' GROUP BY owner"""),)
# Natural order of the ASCII names of fx_pages.
NATURAL_SQL = """array_to_string(list_transform(regexp_extract_all(translate(lower(name), '_.', chr(2) || chr(8)), '(\\d+|\\D+)', 1),
  lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN concat(lpad(CAST(length(ltrim(r, '0')) AS VARCHAR), 3, '0'), ltrim(r, '0')) ELSE r END), '')"""


def _pages_with_hash(t: Tables) -> DataFrame:
    """Pages with block count, current hash, and a last hash that is current on odd pages."""
    hashed = P.render_hash(t["fx_blocks"], StyleConfig(), [F.count("*").alias("n_blocks")])
    return t["fx_pages"].join(hashed, "page_id", "left").withColumn(
        "last_rendered_hash", F.when(F.col("page_id") % 2 == 1, F.col("render_hash")).otherwise(F.lit("old")))


HASHED = (("hashed", HASH_SQL),
          ("hashed_pages", """SELECT p.*, n_blocks, render_hash, CASE WHEN p.page_id % 2 = 1 THEN render_hash ELSE 'old' END AS last_hash
            FROM fx_pages p LEFT JOIN hashed USING (page_id)"""))


@query("scan_names", with_views(("fx_pages", "fx_artifacts"), """
SELECT name, count(*) AS n FROM (SELECT name FROM fx_pages UNION ALL SELECT file_name FROM fx_artifacts)
WHERE regexp_matches(name, '\\.(jpe?g|png|webp|bmp)$', 'i') AND NOT ends_with(name, '_erased.png') AND NOT ends_with(name, '_translated.png')
GROUP BY name"""))
def scan_names(t: Tables) -> DataFrame:
    listed = t["fx_pages"].select("name").unionByName(t["fx_artifacts"].select(F.col("file_name").alias("name")))
    return listed.where(is_page_image(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query("accepted_media", """
SELECT page_id, url FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' END AS m FROM pages)
WHERE m LIKE 'image/%'""")
def accepted_media(t: Tables) -> DataFrame:
    media = F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "text/html")
    return M.filter_media(t["pages"].withColumn("media_type", media)).select("page_id", "url")


@query("media_summary", """
SELECT count(*) FILTER (WHERE page_id % 3 = 0) AS accepted, count(*) AS offered, CAST(NULL AS VARCHAR) AS error FROM pages""")
def media_summary(t: Tables) -> DataFrame:
    media = F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "text/html")
    return M.media_summary(t["pages"].select(media.alias("media_type")))


@query("artifact_parts", with_views(("fx_artifacts",), "SELECT file_name, location, kind, owner FROM owned", OWNED))
def artifact_parts(t: Tables) -> DataFrame:
    return M.with_artifact_parts(t["fx_artifacts"])


@query("artifact_flags", with_views(("fx_artifacts",), "SELECT * FROM flags", FLAGS))
def artifact_flags(t: Tables) -> DataFrame:
    return M.artifact_flags(t["fx_artifacts"])


@query("mark_cached", with_views(("fx_pages", "fx_artifacts"), """
SELECT page_id, name, CASE WHEN has_ocr_cache THEN 'completed' ELSE 'idle' END AS status, CASE WHEN has_ocr_cache THEN 100 ELSE 0 END AS progress,
  coalesce(has_ocr_cache, false) AS has_ocr_cache, coalesce(has_erased_cache, false) AS has_erased_cache
FROM fx_pages LEFT JOIN flags ON owner = name""", FLAGS))
def mark_cached(t: Tables) -> DataFrame:
    return M.mark_cached(t["fx_pages"].select("page_id", "name"), t["fx_artifacts"])


@query("import_summary", with_views(("fx_pages", "fx_artifacts"), """
SELECT count(*) AS pages, count(*) FILTER (WHERE has_ocr_cache) AS cached FROM fx_pages LEFT JOIN flags ON owner = name""", FLAGS))
def import_summary(t: Tables) -> DataFrame:
    return M.import_summary(M.mark_cached(t["fx_pages"].select("page_id", "name"), t["fx_artifacts"]))


@query("orphans", with_views(("fx_pages", "fx_artifacts"), """
SELECT file_name, location, kind, owner FROM owned WHERE owner <> '' AND owner NOT IN (SELECT name FROM fx_pages)""", OWNED))
def orphans(t: Tables) -> DataFrame:
    return M.orphans(t["fx_artifacts"], t["fx_pages"]).select("file_name", "location", "kind", "owner")


@query("cleanup_summary", with_views(("fx_pages", "fx_artifacts"), """
SELECT count(*) FILTER (WHERE gone) AS deleted, count(*) FILTER (WHERE NOT gone) AS kept
FROM (SELECT coalesce(owner, '') <> '' AND coalesce(owner NOT IN (SELECT name FROM fx_pages), false) AS gone FROM owned)""", OWNED))
def cleanup_summary(t: Tables) -> DataFrame:
    return M.cleanup_summary(t["fx_artifacts"], t["fx_pages"])


BEST_SQL = (("ranked", """SELECT owner, kind, location || '/' || file_name AS path,
    CASE kind WHEN 'translated' THEN 0 WHEN 'erased' THEN 2 END + CASE location WHEN 'root' THEN 1 ELSE 0 END AS rank FROM owned WHERE kind <> 'blocks'"""),
            ("best", """SELECT owner, arg_min(path, {'r': rank, 'p': path}) AS translated_path,
    arg_min(path, {'r': rank, 'p': path}) FILTER (WHERE kind = 'erased') AS erased_path FROM ranked GROUP BY owner"""))


@query("best_artifact", with_views(("fx_pages", "fx_artifacts"), """
SELECT page_id, name, status, CASE WHEN status = 'completed' THEN translated_path END AS translated_path, erased_path
FROM fx_pages LEFT JOIN best ON owner = name""", OWNED + BEST_SQL))
def best_artifact(t: Tables) -> DataFrame:
    return M.best_artifact(t["fx_pages"].select("page_id", "name", "status"), t["fx_artifacts"]).select(
        "page_id", "name", "status", "translated_path", "erased_path")


# The same names in three folders; every artifact lies in one of them.
FOLDERS = (
    ("shelf", "SELECT *, 'f' || page_id % 3 AS folder, 'p' || page_id % 40 || '.png' AS page FROM fx_pages"),
    ("filed", """SELECT 'f' || page_id % 3 AS folder, location, owner, kind, file_name FROM (SELECT page_id, 'p' || page_id % 40 || '.png' AS owner,
        CASE page_id % 4 WHEN 0 THEN 'blocks' WHEN 1 THEN 'erased' WHEN 2 THEN 'translated' END AS kind, CASE WHEN width % 200 = 0 THEN 'cache' ELSE 'root' END AS location,
        'p' || page_id % 40 || '.png' || CASE page_id % 4 WHEN 0 THEN '_blocks.json' WHEN 1 THEN '_erased.png' WHEN 2 THEN '_translated.png' ELSE '.tmp' END AS file_name
      FROM fx_pages WHERE page_id % 7 = 0) WHERE kind IS NOT NULL"""),
)


def _shelves(t: Tables) -> tuple[DataFrame, DataFrame]:
    page = F.col("page_id")
    shelf = t["fx_pages"].withColumns({"folder": F.concat(F.lit("f"), page % 3), "name": F.concat(F.lit("p"), page % 40, F.lit(".png"))})
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("_blocks.json", "_erased.png", "_translated.png", ".tmp")]), (page % 4 + 1).cast("int"))
    filed = shelf.where(page % 7 == 0).select("folder", F.concat("name", suffix).alias("file_name"),
                                             F.when(F.col("width") % 200 == 0, "cache").otherwise("root").alias("location"))
    return shelf, filed


@query("mark_cached_folders", with_views(("fx_pages",), """
SELECT page_id, folder, page AS name, CASE WHEN b THEN 'completed' ELSE 'idle' END AS status, CASE WHEN b THEN 100 ELSE 0 END AS progress, b AS has_ocr_cache, e AS has_erased_cache
FROM (SELECT page_id, folder, page, coalesce(b, false) AS b, coalesce(e, false) AS e FROM shelf LEFT JOIN
  (SELECT folder, owner, bool_or(kind = 'blocks') AS b, bool_or(kind <> 'blocks') AS e FROM filed GROUP BY folder, owner) f USING (folder) WHERE f.owner = page
  UNION ALL SELECT page_id, folder, page, false, false FROM shelf s WHERE NOT EXISTS (SELECT 1 FROM filed f WHERE f.folder = s.folder AND f.owner = s.page))""", FOLDERS))
def mark_cached_folders(t: Tables) -> DataFrame:
    shelf, filed = _shelves(t)
    return M.mark_cached(shelf.select("page_id", "folder", "name"), filed, ["folder"])


@query("orphans_folders", with_views(("fx_pages",), """
SELECT folder, location, owner, kind, file_name FROM filed f WHERE NOT EXISTS (
  SELECT 1 FROM shelf s WHERE s.folder = f.folder AND s.page = f.owner AND (s.page_id % 3 + s.page_id % 40) % 2 = 0)""", FOLDERS))
def orphans_folders(t: Tables) -> DataFrame:
    """In each folder every other page is gone."""
    shelf, filed = _shelves(t)
    return M.orphans(filed, shelf.where((F.col("page_id") % 3 + F.col("page_id") % 40) % 2 == 0), ["folder"]).select("folder", "location", "owner", "kind", "file_name")


@query("best_artifact_folders", with_views(("fx_pages",), """
SELECT page_id, folder, page AS name, CASE WHEN status = 'completed' THEN t END AS translated_path, e AS erased_path FROM shelf LEFT JOIN (
  SELECT folder, owner, arg_min(path, {'r': r, 'p': path}) AS t, arg_min(path, {'r': r, 'p': path}) FILTER (WHERE kind = 'erased') AS e FROM (
    SELECT *, location || '/' || file_name AS path, CASE kind WHEN 'translated' THEN 0 WHEN 'erased' THEN 2 END + CASE location WHEN 'root' THEN 1 ELSE 0 END AS r
    FROM filed WHERE kind <> 'blocks') GROUP BY folder, owner) b ON b.folder = shelf.folder AND b.owner = shelf.page""".replace("SELECT page_id, folder,", "SELECT page_id, shelf.folder,"), FOLDERS))
def best_artifact_folders(t: Tables) -> DataFrame:
    shelf, filed = _shelves(t)
    return M.best_artifact(shelf.select("page_id", "folder", "name", "status"), filed, ["folder"]).select(
        "page_id", "folder", "name", "translated_path", "erased_path")


@query("export_manifest_folders", with_views(("fx_pages",), """
SELECT folder, 'translated_' || page AS entry_name, page_id, page AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY folder, page ORDER BY page_id DESC) AS k FROM shelf WHERE status = 'completed') WHERE k = 1""", FOLDERS))
def export_manifest_folders(t: Tables) -> DataFrame:
    shelf, _ = _shelves(t)
    pages = shelf.withColumns({"n_blocks": F.lit(1), "render_hash": F.lit("h"), "last_rendered_hash": F.lit("h"), "has_translated": F.lit(True)})
    return M.export_manifest(pages, StyleConfig(), ["folder"]).select("folder", "entry_name", "page_id", "name")


@query("display_paths", with_views(("fx_pages", "fx_artifacts"), """
SELECT page_id, CASE WHEN status = 'completed' THEN coalesce(translated_path, name) ELSE name END AS display_path
FROM fx_pages LEFT JOIN best ON owner = name""", OWNED + BEST_SQL))
def display_paths(t: Tables) -> DataFrame:
    pages = M.best_artifact(t["fx_pages"].select("page_id", "name", "status"), t["fx_artifacts"])
    return M.display_path(pages.withColumn("path", F.col("name"))).select("page_id", "display_path")


@query("merge_pages", with_views(("fx_pages",), """
SELECT page_id, name, CASE status WHEN 'failed' THEN 'completed' ELSE status END AS status, page_id % 3 = 0 OR (status = 'failed' AND page_id % 8 = 0) AS has_ocr_cache
FROM fx_pages"""))
def merge_pages(t: Tables) -> DataFrame:
    pages = t["fx_pages"].select("page_id", "name", "status", (F.col("page_id") % 3 == 0).alias("has_ocr_cache"))
    updates = t["fx_pages"].where(F.col("status") == "failed").select(
        "page_id", F.lit("completed").alias("status"), (F.col("page_id") % 8 == 0).alias("has_ocr_cache"))
    return M.merge_pages(pages, updates)


@query("append_pages", with_views(("fx_pages",), """
SELECT page_id, name FROM fx_pages UNION ALL SELECT page_id + 1000000, name FROM fx_pages WHERE status = 'failed'"""))
def append_pages(t: Tables) -> DataFrame:
    pages = t["fx_pages"].select("page_id", "name")
    new = t["fx_pages"].where(F.col("status") == "failed").select((F.col("page_id") + 1000000).alias("page_id"), "name")
    return M.append_pages(pages, new)


@query("remove_pages", with_views(("fx_pages",), """
SELECT page_id, name FROM fx_pages WHERE page_id NOT IN (SELECT user_id FROM events)"""))
def remove_pages(t: Tables) -> DataFrame:
    return M.remove_pages(t["fx_pages"].select("page_id", "name"), t["events"].select(F.col("user_id").alias("page_id")))


@query("known_names", with_views(("fx_pages",), "SELECT DISTINCT name FROM fx_pages"))
def known_names(t: Tables) -> DataFrame:
    return M.known_names(t["fx_pages"])


@query("last_wins", """
SELECT conv_id, role, turn, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) = 1""")
def last_wins(t: Tables) -> DataFrame:
    return K.last_wins(t["conversations"].select("conv_id", "role", "turn", "text"), ["conv_id", "role"], ["turn", "text"])


@query("struct_diff", with_views(("fx_ocr", "fx_ocr_edited"), """
SELECT coalesce(o.page_id, n.page_id) AS page_id, count(*) FILTER (WHERE changed) AS n_changed, bool_or(changed) AS is_stale
FROM (SELECT *, true AS here FROM fx_ocr) o FULL JOIN (SELECT *, true AS here FROM fx_ocr_edited) n
  ON o.page_id = n.page_id AND o.ordinal = n.ordinal,
  LATERAL (SELECT o.here IS DISTINCT FROM n.here OR o.px0 IS DISTINCT FROM n.px0 OR o.px1 IS DISTINCT FROM n.px1
    OR o.py0 IS DISTINCT FROM n.py0 OR o.py1 IS DISTINCT FROM n.py1 OR o.kind IS DISTINCT FROM n.kind AS changed)
GROUP BY ALL"""))
def struct_diff(t: Tables) -> DataFrame:
    names = {"px0": "xmin", "px1": "xmax", "py0": "ymin", "py1": "ymax", "kind": "type"}
    return M.struct_diff(t["fx_ocr"].withColumnsRenamed(names), t["fx_ocr_edited"].withColumnsRenamed(names))


@query("status_counts", with_views(("fx_pages",), """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'idle') AS idle, count(*) FILTER (WHERE status = 'processing') AS processing,
  count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM fx_pages"""))
def status_counts(t: Tables) -> DataFrame:
    return M.status_counts(t["fx_pages"])


@query("renderable", with_views(("fx_pages", "fx_ocr"), """
SELECT page_id, name, n_blocks FROM fx_pages JOIN (SELECT page_id, count(*) AS n_blocks FROM fx_ocr GROUP BY page_id) USING (page_id)
WHERE status = 'completed'"""))
def renderable(t: Tables) -> DataFrame:
    counts = t["fx_ocr"].groupBy("page_id").agg(F.count("*").alias("n_blocks"))
    return W.renderable(t["fx_pages"].join(counts, "page_id", "left")).select("page_id", "name", "n_blocks")


@query("stale_pages", with_views(("fx_pages", "fx_blocks"), """
SELECT page_id, name FROM hashed_pages WHERE status = 'completed' AND n_blocks > 0 AND render_hash IS DISTINCT FROM last_hash""", HASHED))
def stale_pages(t: Tables) -> DataFrame:
    return W.stale(W.renderable(_pages_with_hash(t))).select("page_id", "name")


@query("render_count", with_views(("fx_pages", "fx_blocks"), """
SELECT count(*) AS n_render FROM hashed_pages WHERE status = 'completed' AND n_blocks > 0 AND render_hash IS DISTINCT FROM last_hash""", HASHED))
def render_count(t: Tables) -> DataFrame:
    return W.stale(W.renderable(_pages_with_hash(t))).agg(F.count("*").alias("n_render"))


@query("export_names", with_views(("fx_pages",), """
SELECT page_id, 'translated_' || CASE WHEN contains(n, '.') THEN regexp_extract(n, '^(.*)\\.[^.]*$', 1) ELSE n END || '.'
    || CASE WHEN contains(n, '.') THEN regexp_extract(n, '\\.([^.]*)$', 1) ELSE 'png' END AS entry_name,
  'translated_' || CASE WHEN contains(n, '.') THEN regexp_extract(n, '^(.*)\\.[^.]*$', 1) ELSE n END || '.webp' AS small_name
FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'a.b' || name WHEN page_id % 6 = 1 THEN replace(name, '.', '') ELSE name END AS n FROM fx_pages)"""))
def export_names(t: Tables) -> DataFrame:
    p = F.col("page_id") % 6
    name = F.when(p == 0, F.concat(F.lit("a.b"), "name")).when(p == 1, F.replace("name", F.lit("."), F.lit(""))).otherwise(F.col("name"))
    return t["fx_pages"].select("page_id", export_name(name, False).alias("entry_name"), export_name(name, True).alias("small_name"))


@query("export_manifest", with_views(("fx_pages", "fx_blocks"), f"""
SELECT 'translated_' || name AS entry_name, page_id, name, n_blocks,
  CASE WHEN page_id % 4 <> 3 AND render_hash IS NOT DISTINCT FROM last_hash THEN 'reuse' ELSE 'render' END AS action, 'image/png' AS content_type
FROM hashed_pages WHERE status = 'completed' AND n_blocks IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY name ORDER BY {NATURAL_SQL} DESC, page_id DESC) = 1""", HASHED))
def export_manifest(t: Tables) -> DataFrame:
    pages = _pages_with_hash(t).withColumn("has_translated", F.col("page_id") % 4 != 3)
    return M.export_manifest(pages, StyleConfig())


@query("natural_order", with_views(("fx_pages",), f"""
SELECT page_id, name, row_number() OVER (ORDER BY {NATURAL_SQL}, page_id) AS page_rank FROM fx_pages"""))
def natural_order(t: Tables) -> DataFrame:
    return M.natural_order(t["fx_pages"].select("page_id", "name"))


@query("page_neighbours", with_views(("fx_pages",), f"""
SELECT page_id, page_rank, coalesce(lag(page_id) OVER w, -1) AS prev_page, coalesce(lead(page_id) OVER w, -1) AS next_page,
  lag(page_id) OVER w IS NOT NULL AS has_prev, lead(page_id) OVER w IS NOT NULL AS has_next
FROM (SELECT page_id, row_number() OVER (ORDER BY {NATURAL_SQL}, page_id) AS page_rank FROM fx_pages)
WINDOW w AS (ORDER BY page_rank)"""))
def page_neighbours(t: Tables) -> DataFrame:
    out = M.page_neighbours(M.natural_order(t["fx_pages"].select("page_id", "name")))
    return out.drop("name").withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("prev_page", "next_page")})


@query("chapter_neighbours", with_views(("fx_pages",), f"""
SELECT page_id, page_rank, coalesce(lag(page_id) OVER w, -1) AS prev_page, coalesce(lead(page_id) OVER w, -1) AS next_page
FROM (SELECT page_id, split_part(name, '_', 1) AS chapter,
    row_number() OVER (PARTITION BY split_part(name, '_', 1) ORDER BY {NATURAL_SQL}, page_id) AS page_rank FROM fx_pages)
WINDOW w AS (PARTITION BY chapter ORDER BY page_rank)"""))
def chapter_neighbours(t: Tables) -> DataFrame:
    pages = t["fx_pages"].select("page_id", "name", F.split_part("name", F.lit("_"), F.lit(1)).alias("chapter"))
    out = M.page_neighbours(M.natural_order(pages, ["chapter"]), ["chapter"])
    return out.select("page_id", "page_rank", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("prev_page", "next_page")])


@query("page_batches", with_views(("fx_pages",), f"""
SELECT page_id, CAST((row_number() OVER (ORDER BY {NATURAL_SQL}, page_id) - 1) // 5 AS BIGINT) AS batch_no FROM fx_pages"""))
def page_batches(t: Tables) -> DataFrame:
    return K.batches(M.natural_order(t["fx_pages"].select("page_id", "name")), "page_rank").select("page_id", "batch_no")


@query("work_priority", with_views(("fx_pages",), f"""
SELECT page_id, row_number() OVER (ORDER BY {NATURAL_SQL}, page_id) AS page_rank FROM fx_pages WHERE status IN ('idle', 'failed')"""))
def work_priority(t: Tables) -> DataFrame:
    return M.natural_order(W.work_list(t["fx_pages"]).select("page_id", "name")).select("page_id", "page_rank")
