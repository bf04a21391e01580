"""Hot groups take another way through the operators and must give the same rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators import blocks as B
from pagewright.operators import manifest as M
from pagewright.operators import payload as P
from pagewright.operators import ranking as K
from pagewright.plans.fixtures import LINE_ORDER
from pagewright.schema import StyleConfig


def skewed(spark, n=3000):
    """A third of all rows has one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("g"), (F.xxhash64("id") % 1000).alias("v"), "id")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hot_groups_rank_like_a_window(spark):
    df = skewed(spark)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("long"))
    assert rows(K.row_numbers(df, ["g"], ["v", "id"], "n")) == rows(want)


def test_a_hot_null_group_ranks_like_any_other(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("g"), "id")
    got = K.row_numbers(df, ["g"], ["id"], "n").where("g IS NULL").orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, 301))


def test_heavy_groups_beside_light_ones(spark, monkeypatch):
    """Heavy groups, a null one too, take the range sort; light ones a window without a stored copy."""
    monkeypatch.setattr(K, "HEAVY_ROWS", 200)
    df = skewed(spark).withColumn("g", F.when(F.col("g") != 8, F.col("g"))).withColumn("h", F.when(F.col("id") % 2 == 0, "x"))
    for group in (["g"], ["g", "h"]):
        want = df.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("v", "id")).cast("long"))
        key = lambda r: r["id"]
        for bound in (None, df.select(*group).union(df.select(*group))):
            got = K.row_numbers(df, group, ["v", "id"], "n", bound)
            assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_light_groups_are_shuffled_once_and_not_stored(spark):
    plan = K.row_numbers(skewed(spark), ["g"], ["v", "id"], "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Scan ExistingRDD" not in plan


def test_global_rank(spark):
    df = skewed(spark)
    got = K.row_numbers(df, [], ["v", "id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 3001))
    assert [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)


def test_ordinals_of_line_items(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    window = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    plain = lines.withColumn("ordinal", (F.row_number().over(window) - 1).cast("int"))
    assert rows(K.with_ordinal(lines, ["l_orderkey"], LINE_ORDER)) == rows(plain)


def test_natural_order_has_no_single_task(spark):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.concat(F.lit("p"), "id").alias("name"))
    assert "SinglePartition" not in M.natural_order(pages)._jdf.queryExecution().executedPlan().toString()


def test_neighbours_across_slices_and_gaps(spark):
    df = spark.createDataFrame([(g, p, f"{g}-{p}") for g in (1, 2, None) for p in (0, 1, 2, 5, 9, 10, 31)], "g int, p int, v string")
    w = Window.partitionBy("g").orderBy("p")
    want = df.withColumn("a", F.lag("v").over(w)).withColumn("b", F.lead("v").over(w))
    got = K.neighbours(df, ["g"], "p", "v", "a", "b", part_rows=3)
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_page_neighbours_over_all_pages(spark):
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("p"), F.col("id"), F.lit(".png")).alias("name"))
    out = M.page_neighbours(M.natural_order(pages)).orderBy("page_rank").collect()
    assert [r.page_id for r in out] == list(range(100))
    assert [r.prev_page for r in out] == [None, *range(99)]
    assert (out[0].has_prev, out[0].has_next, out[-1].has_next) == (False, True, False)


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "y"), ("b", 1, "z"), ("a", 3, None)], "k string, n int, v string")
    assert rows(K.last_wins(df, ["k"], ["n"]).select("k", "n")) == [("a", 3), ("b", 1)]
    assert K.last_wins(df, ["k"], ["n"]).where("k = 'a'").head().v is None


def sample_blocks(spark, n=25):
    return spark.range(n).select(
        F.lit(1).alias("page_id"), F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("b"), "id").alias("block_id"),
        F.concat(F.lit("t"), "id").alias("original_text"), F.concat(F.lit("T"), "id").alias("translated_text"),
        *[F.col("id").cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
        F.lit("#000000").alias("text_color"), F.lit("#ffffff").alias("bg_color"), F.lit(2.0).alias("font_size_pct"),
        F.lit(None).cast("string").alias("type"))


def test_payload_parts_hold_the_whole_page(spark):
    import json

    blocks = sample_blocks(spark)
    whole = json.loads(P.request_payload(blocks).head().payload)
    parts = P.request_payload(blocks, part_rows=10).orderBy("part").collect()
    assert [p.n_items for p in parts] == [10, 10, 5]
    assert sum((json.loads(p.payload) for p in parts), []) == whole
    assert [b["id"] for b in whole] == [f"b{i}" for i in range(25)]


def test_hash_ignores_geometry_but_not_order(spark):
    blocks = sample_blocks(spark)
    style = StyleConfig()
    h = P.render_hash(blocks, style).head().render_hash
    assert P.render_hash(blocks.withColumn("xmin", F.lit(0.0)), style).head().render_hash == h
    assert P.layout_hash(blocks.withColumn("xmin", F.lit(0.5)), style).head() != P.layout_hash(blocks, style).head()
    assert P.render_hash(blocks.withColumn("ordinal", 24 - F.col("ordinal")), style).head().render_hash != h
    assert P.render_hash(blocks, StyleConfig(export_compressed=True)).head().render_hash == h
    assert P.render_hash(blocks, StyleConfig(font_size_scale=1.2)).head().render_hash != h
    assert P.render_hash(blocks.repartition(3), style).head().render_hash == h


def test_one_rule_for_pages_of_any_size(spark):
    """A page of 10,050 blocks is one request and one document; its hash sees its last block."""
    import json

    blocks = sample_blocks(spark, 10_050)
    request = P.request_payload(blocks).collect()
    assert [(r.part, r.n_items) for r in request] == [(0, 10_050)] and len(json.loads(request[0].payload)) == 10_050
    assert P.blocks_json(blocks).count() == 1
    changed = blocks.withColumn("translated_text", F.when(F.col("ordinal") == 10_049, "other").otherwise(F.col("translated_text")))
    assert P.render_hash(changed, StyleConfig()).head() != P.render_hash(blocks, StyleConfig()).head()


def test_stale_is_empty_after_rendering(spark):
    from pagewright.operators.routing import stale

    pages = P.render_hash(sample_blocks(spark), StyleConfig()).withColumn("last_rendered_hash", F.col("render_hash"))
    assert stale(pages).count() == 0
    assert stale(pages.withColumn("last_rendered_hash", F.lit(None).cast("string"))).count() == 1


def test_ocr_shapes(spark):
    ocr = spark.createDataFrame([(1, '{"blocks":[{"text":" あ ","box":[[10,20],[60,20],[60,140],[10,140]],"confidence":0.9}]}'),
                                 (2, '{"blocks":[]}'), (3, "broken")], "page_id int, reply string")
    got = B.corners_to_bounds(B.read_ocr(ocr)).collect()
    assert [tuple(r) for r in got] == [(1, 0, " あ ", 0.9, 10.0, 20.0, 60.0, 140.0)]
    assert [r.page_id for r in B.ocr_errors(ocr).collect()] == [3]
    pages = spark.createDataFrame([(1, 200, 400)], "page_id int, width int, height int")
    block = B.normalise(B.corners_to_bounds(B.read_ocr(ocr)), pages).head()
    assert (block.original_text, block.is_vertical, block.xmin, block.ymax, block.font_size_pct) == ("あ", True, 5.0, 35.0, 12.5)
    pages = spark.createDataFrame([(1, 0, 0)], "page_id int, width int, height int")
    assert B.normalise(B.corners_to_bounds(B.read_ocr(ocr)), pages).head().xmin == 0.0


def test_parallel_arrays(spark):
    df = spark.sql("""SELECT 1 page_id, array('a','b','c') rec_texts, array(0.5D, 0.25D) rec_scores,
      array(array(array(1.9D,2D),array(3D,4D)), array(array(5D,6D),array(7D,8D))) rec_polys""")
    got = [(r.ordinal, r.text, r.confidence, r.box[0]) for r in B.from_parallel_arrays(df).collect()]
    assert got == [(0, "a", 0.5, [1, 2]), (1, "b", 0.25, [5, 6])]


def test_neighbours_of_all_rows_have_no_single_task(spark):
    """No group, slices of five positions with gaps between them: lag and lead of the whole order, without one window over it."""
    places = [i for i in range(400) if (i // 5) % 4 != 2 and i % 7]
    df = spark.createDataFrame([(p, f"v{p}") for p in places], "position long, name string").repartition(5)
    out = K.neighbours(df, [], "position", "name", "before", "after", part_rows=5)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.position: (r.before, r.after) for r in out.collect()}
    assert got == {p: (f"v{places[i - 1]}" if i else None, f"v{places[i + 1]}" if i + 1 < len(places) else None) for i, p in enumerate(places)}
