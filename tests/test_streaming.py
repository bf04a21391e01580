"""Streams give what the batch forms give."""

import datetime as dt
import itertools
import time

import pandas as pd
from pyspark.sql import functions as F

from pagewright.operators import edits as D
from pagewright.streaming import edits as T
from pagewright.streaming.invalidation import stale_pages
from pagewright.streaming.intake import latest_replies, ocr_to_table, page_stream, start_intake
from pagewright.streaming.state import page_state_stream
from pagewright.streaming.timers import Debounce, debounce_timed

START = dt.datetime(2024, 1, 1)
EDIT = "page_id long, seq long, ts timestamp, payload string"


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def stream_of(spark, tmp_path, batches, schema):
    """A file stream with one file per micro-batch."""
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


def drain(df, tmp_path, name, mode):
    query = (df.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name)


EDITS = [(1, 1, at(0), "a"), (1, 2, at(799), "b"), (1, 3, at(1599), "c"), (1, 4, at(2400), "d"), (1, 5, at(2400), "e"),
         (2, 6, at(0), "x"), (2, 7, at(801), "y")]


def test_debounce_gaps(spark):
    got = {(r.page_id, r.seq, r.payload) for r in D.debounce(spark.createDataFrame(EDITS, EDIT), "payload").collect()}
    # 799 and exactly 800 ms join, 801 ms does not; of equal times the later number counts.
    assert got == {(1, 3, "c"), (1, 5, "e"), (2, 6, "x"), (2, 7, "y")}


def test_debounce_across_slices(spark):
    rows = [(1, i, at(700 * i), str(i)) for i in range(200)] + [(1, 1000 + i, at(1_000_000 + 900 * i), "s") for i in range(100)]
    got = sorted(r.seq for r in D.debounce(spark.createDataFrame(rows, EDIT), "payload").collect())
    assert got == [199, *range(1000, 1100)]


def test_debounce_stream_equals_batch(spark, tmp_path):
    flush = [(99, 999, at(60_000), "flush")]
    edits = stream_of(spark, tmp_path, [EDITS[:3], EDITS[3:], [EDITS[0]], flush], EDIT)
    rows = drain(T.debounce_stream(T.with_watermark(edits, "5 seconds"), "payload"), tmp_path, "debounced", "append")
    got = {tuple(r) for r in rows.select("page_id", "fire_at", "seq", "payload").collect()}
    want = {tuple(r) for r in D.debounce(spark.createDataFrame(EDITS, EDIT), "payload").collect()}
    assert got == want  # the replayed edit counts once


def test_late_edit_is_dropped(spark, tmp_path):
    late = [(1, 50, at(1000), "late")]
    edits = stream_of(spark, tmp_path, [EDITS[:1], [(99, 998, at(60_000), "f")], [(99, 999, at(90_000), "f")], late,
                                        [(99, 1000, at(120_000), "f")]], EDIT)
    rows = drain(T.debounce_stream(T.with_watermark(edits, "5 seconds"), "payload"), tmp_path, "late", "append")
    assert [r.payload for r in rows.where("page_id = 1").collect()] == ["a"]


EVENT = "page_id long, seq long, ts timestamp, event string, progress double, error string"
EVENTS = [(1, 1, at(0), "started", None, None), (1, 2, at(10), "progress", 40.0, None), (1, 3, at(20), "failed", None, "boom"),
          (1, 4, at(30), "started", None, None), (1, 5, at(40), "finished", None, None),
          (2, 6, at(0), "started", None, None), (2, 7, at(5), "progress", 70.0, None), (3, 8, at(0), "started", None, None),
          (3, 9, at(9), "failed", None, None)]


def test_page_state(spark, tmp_path):
    batch = {tuple(r) for r in D.page_state(spark.createDataFrame(EVENTS, EVENT)).collect()}
    assert batch == {(1, "completed", 100, None, 2), (2, "processing", 70, None, 1), (3, "failed", 0, "Unknown error", 1)}
    stream = stream_of(spark, tmp_path, [EVENTS[:3], EVENTS[3:]], EVENT)
    updates = drain(page_state_stream(stream), tmp_path, "states", "update").collect()
    last = {r.page_id: tuple(r) for r in updates}
    assert set(last.values()) == batch
    assert (1, "failed", 40, "boom", 1) in {tuple(r) for r in updates}


def test_progress_stream(spark, tmp_path):
    columns = "page_id long, seq long, ts timestamp, progress int"
    batches = [[(1, 1, at(0), 10), (2, 2, at(0), 5)], [(1, 4, at(9), 90), (1, 3, at(5), 30)]]
    updates = drain(D.latest_progress(stream_of(spark, tmp_path, batches, columns)), tmp_path, "progress", "update").collect()
    assert sorted(map(tuple, updates)) == [(1, 10), (1, 90), (2, 5)]


def test_intake_writes_replies(spark, tmp_path):
    source, table = tmp_path / "pages", str(tmp_path / "replies")
    source.mkdir()
    for name in ("a.png", "b.png"):
        (source / name).write_bytes(name.encode())

    def engine():
        def detect(content):
            if content == b"b.png":
                raise ValueError("broken")
            return [{"text": "x", "box": [[0, 0], [1, 0], [1, 1], [0, 1]], "confidence": 1.0}]

        return detect

    work = ocr_to_table(engine, table)
    query = start_intake(page_stream(spark, str(source)), work, str(tmp_path / "ck"), available_now=True)
    query.awaitTermination(120)
    assert query.exception() is None
    work(page_batch(spark, source), 0)  # the same batch once more
    got = {r.page_id.rsplit("/", 1)[1]: (r.reply is not None, r.error) for r in latest_replies(spark, table).collect()}
    assert got == {"a.png": (True, None), "b.png": (False, "broken")}


def page_batch(spark, source):
    files = spark.read.format("binaryFile").load(str(source))
    return files.select(F.col("path").alias("page_id"), "content")


def test_fold_drags_in_steps(spark):
    blocks = spark.createDataFrame([(1, "b0", 10.0, 10.0, 30.0, 20.0), (1, "b1", 0.0, 0.0, 5.0, 5.0)],
                                   "page_id int, block_id string, xmin double, ymin double, xmax double, ymax double")
    rows, box = [], [10.0, 10.0, 30.0, 20.0]
    for i in range(57):
        dx, dy, op = (i * 37) % 50 - 25.0, (i * 23) % 40 - 20.0, "resize" if i % 4 == 3 else "move"
        rows.append((1, "b0", at(i // 2), i, op, dx, dy))
        for low, high, d in ((0, 2, dx), (1, 3, dy)):
            if op == "resize":
                box[high] = min(100, max(box[low] + 2, box[high] + d))
            else:
                size = box[high] - box[low]
                new = (0.0, size) if box[low] + d < 0 else (box[low] + d, box[high] + d)
                box[low], box[high] = (100 - size, 100.0) if new[1] > 100 else new
    drags = spark.createDataFrame(rows, "page_id int, block_id string, ts timestamp, seq int, op string, dx double, dy double")
    for part_rows in (1000, 10):
        got = {r.block_id: tuple(r)[2:] for r in D.fold_drags(blocks, drags, part_rows).collect()}
        assert [round(v, 6) for v in got["b0"]] == [round(v, 6) for v in box] and got["b1"] == (0.0, 0.0, 5.0, 5.0)
    assert D.fold_drags(blocks, drags.limit(0)).count() == 2


def test_latest_progress(spark):
    rows = spark.createDataFrame([(1, 1, at(0), 10), (1, 3, at(5), 30), (1, 2, at(5), 20)], "page_id int, seq int, ts timestamp, progress int")
    assert [tuple(r) for r in D.latest_progress(rows).collect()] == [(1, 30)]


BLOCKS = "page_id int, block_id string, ordinal int, original_text string, translated_text string, xmin double, ymin double, xmax double, " \
         "ymax double, text_color string, bg_color string, font_size_pct double, type string"


def test_apply_edits(spark):
    blocks = spark.createDataFrame([(1, f"b{i}", i, "o", "t", 10.0, 10.0, 30.0, 20.0, "#000000", "#ffffff", 2.0, "bubble") for i in range(4)], BLOCKS)
    log = [(1, "b0", 1, "text", "one", None), (1, "b0", 2, "text", "two", None), (1, "b0", 3, "bg_color", "#123456", None),
           (1, "b1", 4, "delete", None, None), (1, "b1", 5, "text", "ghost", None), (1, "b2", 6, "move", None, 90.0),
           (1, "b3", 7, "resize", None, -50.0), (1, "n1", 8, "create", None, None), (1, "n1", 9, "type", "onomatopoeia", None),
           (1, "n2", 10, "text", "never made", None)]
    edits = spark.createDataFrame([(p, b, at(s), s, o, v, d) for p, b, s, o, v, d in log],
                                  "page_id int, block_id string, ts timestamp, seq int, op string, value string, d double")
    box = D.drag_box({c: F.lit(v) for c, v in zip(("xmin", "ymin", "xmax", "ymax"), (10.0, 10.0, 30.0, 20.0))}, F.col("op"), F.col("d"), F.col("d"))
    edits = edits.withColumn("box", F.when(F.col("op").isin("move", "resize"), box))
    got = {r.block_id: r for r in D.apply_edits(blocks, edits).collect()}
    assert {b: r.ordinal for b, r in got.items()} == {"b0": 0, "b2": 1, "b3": 2, "n1": 3}
    assert (got["b0"].translated_text, got["b0"].bg_color, got["b0"].text_color) == ("two", "#123456", "#000000")
    assert (got["b2"].xmin, got["b2"].xmax, got["b2"].ymin, got["b2"].ymax) == (80.0, 100.0, 90.0, 100.0)
    assert (got["b3"].xmin, got["b3"].xmax, got["b3"].ymax) == (10.0, 12.0, 12.0)
    made = got["n1"]
    assert (made.translated_text, made.xmin, made.ymax, made.font_size_pct, made.type) == ("新文字框", 40.0, 48.0, 2.2, "onomatopoeia")
    sized = blocks.withColumns({"width": F.lit(600), "height": F.lit(900)})
    for pages in (None, spark.createDataFrame([(1, 600, 900)], "page_id int, width int, height int")):
        assert {(r.width, r.height) for r in D.apply_edits(sized, edits, pages).collect()} == {(600, 900)}
    fresh = D.new_blocks(spark.createDataFrame([(1, "n9")], "page_id int, block_id string")).head()
    assert (fresh.xmin, fresh.xmax, fresh.bg_color) == (40.0, 60.0, "#000000")


def test_drags_by_distance_start_from_the_blocks(spark):
    """The log is not joined with the blocks first; boxes are those of the log that was."""
    blocks = spark.createDataFrame([(1, f"b{i}", i, "o", "t", 10.0, 10.0, 30.0, 20.0, "#000000", "#ffffff", 2.0, "bubble") for i in range(5)], BLOCKS)
    log = [(1, "b0", 1, "move", 5.0), (1, "b0", 2, "resize", 3.0), (1, "b1", 3, "move", 90.0), (1, "b2", 4, "move", -50.0), (1, "b3", 5, "text", 7.0),
           (1, "n1", 6, "create", None), (1, "n1", 7, "move", 4.0), (1, "n2", 8, "move", 4.0), (1, "b4", 9, "move", None)]
    edits = spark.createDataFrame([(p, b, at(s), s, o, "v", d) for p, b, s, o, d in log], "page_id int, block_id string, ts timestamp, seq int, op string, value string, d double")
    box = ("xmin", "ymin", "xmax", "ymax")
    starts = blocks.select("page_id", "block_id", F.struct(*box).alias("start"))
    joined = edits.join(starts, ["page_id", "block_id"], "left")
    drag = D.drag_box({c: F.col(f"start.{c}") for c in box}, F.col("op"), F.col("d"), F.col("d"))
    want = D.apply_edits(blocks, joined.withColumn("box", F.when(F.col("op").isin("move", "resize"), drag)).drop("start"))
    got = D.apply_edits(blocks, edits.withColumn("drag", F.struct("op", F.col("d").alias("dx"), F.col("d").alias("dy"))))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 6


def test_invalidate_erased(spark):
    columns = "page_id int, ordinal int, xmin double, ymin double, xmax double, ymax double, type string"
    old = spark.createDataFrame([(p, i, 1.0, 1.0, 2.0, 2.0, None) for p in (1, 2, 3) for i in (0, 1)], columns)
    new = spark.createDataFrame([(1, 0, 1.0, 1.0, 2.0, 2.0, None), (1, 1, 1.0, 1.0, 2.0, 2.0, None), (2, 0, 1.0, 1.0, 2.0, 2.0, None)], columns)
    assert [tuple(r) for r in T.invalidate_erased(new, old).collect()] == [(2, 1)]
    batch = spark.createDataFrame([(1,), (2,), (3,)], "page_id int")
    assert sorted(tuple(r) for r in T.invalidate_erased(new, old, batch).collect()) == [(2, 1), (3, 2)]


def test_intake_goes_on_where_it_stopped(spark, tmp_path):
    source, seen = tmp_path / "pages", []
    source.mkdir()
    (source / "p1.png").write_bytes(b"1")
    (source / "p1.png_erased.png").write_bytes(b"1")
    checkpoint = str(tmp_path / "ck")

    def work(batch, batch_id):
        seen.extend(r.name for r in batch.select("name").collect())

    def run():
        query = start_intake(page_stream(spark, str(source)), work, checkpoint, available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    (source / "p2.jpg").write_bytes(b"2")
    run()
    assert seen == ["p1.png", "p2.jpg"]


def test_the_last_burst_of_a_silent_stream_fires(spark, tmp_path):
    """No edit follows, and yet every burst comes out, with the rows of the batch form."""
    edits = stream_of(spark, tmp_path, [EDITS[:3], EDITS[3:]], EDIT)
    query = (debounce_timed(edits, "payload").writeStream.format("memory").queryName("timed").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start())
    want = {tuple(r) for r in D.debounce(spark.createDataFrame(EDITS, EDIT), "payload").collect()}
    until = time.time() + 120
    while time.time() < until and spark.table("timed").count() < len(want):
        time.sleep(0.5)
    query.stop()
    got = [tuple(r) for r in spark.table("timed").select("page_id", "fire_at", "seq", "payload").collect()]
    assert set(got) == want and len(got) == len(want)


def test_bursts_join_whatever_the_order_of_arrival():
    """Edits of one micro-batch in any order, with one that closes the gap between two others."""
    class Value:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Handle:
        timers = []

        def getValueState(self, name, schema):
            return Value()

        def listTimers(self):
            return iter(list(self.timers))

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 5000

    rows = [(at(0), 1, "a"), (at(1500), 2, "b"), (at(750), 3, "c"), (at(9000), 4, "d"), (at(5000), 5, "e")]
    for order in itertools.permutations(rows):
        processor = Debounce(0.8, "string")
        processor.init(Handle())
        Handle.timers.clear()
        out = list(processor.handleInputRows((7,), iter([pd.DataFrame(order, columns=["ts", "seq", "payload"])]), Clock()))
        fired = [tuple(r) for f in out for r in f[["seq", "payload"]].itertuples(index=False)]
        assert fired == [(2, "b"), (5, "e")] and processor.open.get()[3] == "d" and Handle.timers == [5800]


def test_stale_pages_without_reading_the_store(spark, tmp_path):
    """Against struct_diff, batch by batch: moved, retyped, shortened, emptied and unknown pages; the plan reads no stored table."""
    shape = "page_id long, version long, ordinal int, xmin double, ymin double, xmax double, ymax double, type string"

    def listed(page, version, *boxes):
        return [(page, version, i, *b) for i, b in enumerate(boxes)] or [(page, version, None, None, None, None, None, None)]

    a, b, c = (1.0, 1.0, 2.0, 2.0, None), (3.0, 1.0, 4.0, 2.0, "bubble"), (3.0, 1.0, 4.5, 2.0, "bubble")
    first = listed(1, 0, a, b) + listed(2, 0, a, b) + listed(3, 0, a) + listed(4, 0, a, b)
    batches = [listed(1, 1, a, b) + listed(2, 1, a, c) + listed(3, 1) + listed(5, 1, a),
               listed(1, 2, a[:4] + ("other",)) + listed(3, 2, a) + listed(2, 2, a, b) + listed(2, 3, a, c)]
    stored = spark.createDataFrame([r[:1] + r[2:] for r in first], shape.replace("version long, ", ""))
    out = stale_pages(stream_of(spark, tmp_path, batches, shape), stored)
    rows = drain(out, tmp_path, "stale", "append").collect()
    want, known = [], {r[0]: [] for r in first}
    for r in first:
        known[r[0]].append(r[2:])
    for batch in batches:
        last = {p: max(r[1] for r in batch if r[0] == p) for p in {r[0] for r in batch}}
        new = {p: [r[2:] for r in batch if r[0] == p and r[1] == v and r[2] is not None] for p, v in last.items()}
        frame = lambda lists: spark.createDataFrame([(p, *x) for p, xs in lists.items() for x in xs], shape.replace("version long, ", ""))
        pages = spark.createDataFrame([(p,) for p in new], "page_id long")
        want += [tuple(r) for r in T.invalidate_erased(frame(new), frame(known), pages).collect()]
        known |= new
    assert sorted(map(tuple, rows)) == sorted(want) and len(want) == 5
    state_only = stale_pages(spark.readStream.schema(shape).parquet(str(tmp_path / "in")))
    plan = state_only._jdf.queryExecution().logical().toString()
    assert "Join" not in plan
