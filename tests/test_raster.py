"""Pixel operators against NumPy on small images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import plugins as V
from pagewright.operators import erase as E
from pagewright.operators import pyramid as P
from pagewright.operators import raster as R
from pagewright.operators.overlap import overlap_groups

KEYS = ["page_id"]


def to_rows(spark, images):
    rows = [(int(i), x, y, *map(int, img[y, x])) for i, img in enumerate(images) for y in range(img.shape[0]) for x in range(img.shape[1])]
    return spark.createDataFrame(rows, "page_id int, x int, y int, b int, g int, r int")


def to_image(df, page, shape):
    out = np.full((*shape, 3), -1)
    for r in df.where(F.col("page_id") == page).collect():
        out[r.y, r.x] = (r.b, r.g, r.r)
    return out


def border_np(crop):
    h, w = crop.shape[:2]
    parts = [crop[0], crop[h - 1]]
    if h > 2:
        parts += [crop[1:h - 1, 0], crop[1:h - 1, w - 1]]
    return np.concatenate(parts)


SHAPES = [(1, 1), (1, 5), (5, 1), (2, 2), (3, 4), (7, 9)]


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(4)
    return [rng.integers(0, 256, (*s, 3)) for s in SHAPES]


def test_border_and_backgrounds(spark, images):
    sized = R.with_size(to_rows(spark, images), KEYS).cache()
    bag = {r.page_id: r.n for r in R.border(sized).groupBy("page_id").agg(F.count("*").alias("n")).collect()}
    avg = {r.page_id: r for r in R.background(sized, KEYS).collect()}
    upper = {r.page_id: r for r in R.background_upper(sized, KEYS).collect()}
    for i, img in enumerate(images):
        edge = border_np(img)
        assert bag[i] == len(edge)
        assert [avg[i].bg_b, avg[i].bg_g, avg[i].bg_r] == list(np.median(edge, axis=0).astype(int))
        assert [upper[i].bg_b, upper[i].bg_g, upper[i].bg_r] == [int(np.sort(edge[:, c])[len(edge) // 2]) for c in range(3)]
        luma = 0.299 * edge[:, 2] + 0.587 * edge[:, 1] + 0.114 * edge[:, 0]
        assert avg[i].is_uniform == (np.std(luma) < 15.0)


def pad_reflect(arr, r):
    """Mirror without the edge pixel, also for sides shorter than the radius."""
    def index(n):
        period = max(1, 2 * (n - 1))
        pos = np.arange(-r, n + r) % period
        return np.minimum(pos, period - pos) if n > 1 else np.zeros(n + 2 * r, int)

    return arr[np.ix_(index(arr.shape[0]), index(arr.shape[1]))]


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_blur(spark, radius):
    rng = np.random.default_rng(radius)
    masks = [rng.random(s) < 0.4 for s in SHAPES]
    rows = [(i, int(x), int(y)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    sizes = spark.createDataFrame([(i, s[1], s[0]) for i, s in enumerate(SHAPES)], "page_id int, cw int, ch int")
    got = R.blur_mask(spark.createDataFrame(rows, "page_id int, x int, y int"), sizes, KEYS, radius).collect()
    kernel = np.array(R.gaussian_kernel(2 * radius + 1))
    out = [np.zeros(s) for s in SHAPES]
    for r in got:
        out[r.page_id][r.y, r.x] = r.alpha
    for m, o in zip(masks, out):
        padded = pad_reflect(m.astype(float), radius)
        want = np.zeros(m.shape)
        for dy in range(2 * radius + 1):
            for dx in range(2 * radius + 1):
                want += kernel[dy] * kernel[dx] * padded[dy:dy + m.shape[0], dx:dx + m.shape[1]]
        assert np.allclose(o, want, atol=1e-12)


def dilate_np(mask, d):
    out = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        out[max(0, y - d):y + d + 1, max(0, x - d):x + d + 1] = True
    return out


def test_dilate_contains_mask(spark):
    rng = np.random.default_rng(9)
    masks = [rng.random(s) < 0.2 for s in SHAPES]
    rows = [(i, int(x), int(y)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    sizes = spark.createDataFrame([(i, s[1], s[0], i % 3 + 1) for i, s in enumerate(SHAPES)], "page_id int, cw int, ch int, radius int")
    got = {tuple(r) for r in R.dilate(spark.createDataFrame(rows, "page_id int, x int, y int"), sizes, KEYS).collect()}
    want = {(i, int(x), int(y)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(dilate_np(m, i % 3 + 1)))}
    assert got == want and set(rows) <= got


def test_solid_and_colours(spark):
    white = np.full((6, 6, 3), 250)
    spot = white.copy()
    spot[2, 2] = 241
    near = white.copy()
    near[2, 2] = 242
    eight, nine = white.copy(), white.copy()
    eight.reshape(-1, 3)[10:18] = (0, 0, 200)
    nine[1:4, 1:4] = (0, 0, 200)
    eight = np.full((6, 6, 3), 250)
    eight[1:5, 2:4] = (0, 0, 200)
    dark = np.full((6, 6, 3), 10)
    dark[3, 3] = (40, 40, 40)
    dark[3, 4] = (40, 40, 40)
    rows = to_rows(spark, [white, spot, near, eight, nine, dark])
    assert {r.page_id: r.is_solid for r in R.is_solid(rows, KEYS).collect()} == {0: True, 1: False, 2: True, 3: False, 4: False, 5: False}
    colours = {r.page_id: (r.text_color, r.bg_color) for r in R.block_colours(R.with_size(rows, KEYS), KEYS).collect()}
    assert colours[0] == ("#fafafa", "#fafafa")
    assert colours[3] == ("#c80000", "#fafafa")  # eight pixels: darkest
    assert colours[4] == ("#c80000", "#fafafa")  # nine pixels: their mean
    assert colours[5] == ("#282828", "#0a0a0a")


def erase_np(img, blocks):
    """Blocks one after another on one buffer."""
    out, mask = img.copy(), np.zeros(img.shape[:2], bool)
    h, w = img.shape[:2]
    small, large = max(1, int(max(h, w) * 0.002)), max(2, int(max(h, w) * 0.004))
    for kind, x0, y0, x1, y1 in blocks:
        crop = out[y0:y1, x0:x1]
        edge = border_np(crop)
        bg = np.median(edge, axis=0).astype(int)
        grey = (crop[..., 2] * 9798 + crop[..., 1] * 19235 + crop[..., 0] * 3735 + 16384) >> 15
        text = abs(grey - int(0.299 * bg[2] + 0.587 * bg[1] + 0.114 * bg[0])) > 25
        if kind == "bubble" and np.std(0.299 * edge[:, 2] + 0.587 * edge[:, 1] + 0.114 * edge[:, 0]) < 15.0:
            crop[dilate_np(text, small)] = bg
        else:
            mask[y0:y1, x0:x1] |= dilate_np(text, large)
    return out, mask


def test_erase_with_overlaps(spark):
    rng = np.random.default_rng(21)
    pages, blocks, rows = [], [], []
    for page in range(4):
        img = np.full((100, 100, 3), 230) + rng.integers(-3, 4, (100, 100, 3))
        for _ in range(25):
            y, x = rng.integers(5, 90, 2)
            img[y:y + 4, x:x + 5] = rng.integers(0, 120, 3)
        mine = []
        for ordinal in range(7):
            x0, y0 = (int(v) for v in rng.integers(0, 70, 2))
            x1, y1 = x0 + int(rng.integers(8, 30)), y0 + int(rng.integers(8, 30))
            kind = "onomatopoeia" if ordinal == 3 else "bubble"
            mine.append((kind, *(int(v / 100.0 * 100) for v in (x0, y0, x1, y1))))  # percents can lose a pixel
            rows.append((page, ordinal, kind, float(x0), float(y0), float(x1), float(y1), 100, 100))
        pages.append(img)
        blocks.append(mine)
    table = spark.createDataFrame(rows, "page_id int, ordinal int, type string, xmin double, ymin double, xmax double, ymax double, "
                                        "width int, height int")
    assert E.erase_order(E.rects(table)).agg(F.max("step")).head()[0] > 0
    plan = E.erase_page(to_rows(spark, pages), table, "normal")
    mask = {tuple(r) for r in plan.mask.collect()}
    for page, (img, mine) in enumerate(zip(pages, blocks)):
        want, want_mask = erase_np(img, mine)
        assert (to_image(plan.pixels, page, (100, 100)) == want).all()
        assert {(x, y) for p, x, y in mask if p == page} == {(int(x), int(y)) for y, x in zip(*np.nonzero(want_mask))}
    ignored = E.erase_page(to_rows(spark, pages), table, "ignore")
    assert ignored.routes.where("ordinal = 3").count() == 0


def test_finish_inpaint_leaves_far_pixels(spark):
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (20, 20, 3))
    pixels = to_rows(spark, [img])
    mask = spark.createDataFrame([(0, x, y) for x in range(8, 11) for y in range(8, 11)], "page_id int, x int, y int")
    sizes = spark.createDataFrame([(0, 20, 20)], "page_id int, cw int, ch int")
    flat = pixels.withColumns({c: F.lit(100) for c in "bgr"})
    out = to_image(E.finish_inpaint(pixels, flat, mask, sizes, 2), 0, (20, 20))
    assert (out[9, 9] == 100).all() or abs(out[9, 9] - 100).max() < abs(img[9, 9] - 100).max() + 1
    assert (out[:5] == img[:5]).all()
    hard = to_image(R.feather_blend(pixels, flat, mask, sizes, KEYS, 0), 0, (20, 20))
    assert (hard[8:11, 8:11] == 100).all() and (hard[:8] == img[:8]).all()


def overlapping_pairs(rects):
    """Groups by all pairs: {(page, ordinal): least ordinal of the group}, groups of several only."""
    parent = {(p, o): (p, o) for p, o, *_ in rects}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (p, o, x0, y0, x1, y1) in enumerate(rects):
        for q, u, a0, b0, a1, b1 in rects[:i]:
            if p == q and x0 < a1 and a0 < x1 and y0 < b1 and b0 < y1:
                low, high = sorted((root((p, o)), root((q, u))))
                parent[high] = low
    groups = {k: root(k)[1] for k in parent}
    sizes = {}
    for (p, _), g in groups.items():
        sizes[p, g] = sizes.get((p, g), 0) + 1
    return {k: g for k, g in groups.items() if sizes[k[0], g] > 1}


@pytest.mark.parametrize("strip", [7, 64, 1024])
def test_overlap_groups_match_all_pairs(spark, strip):
    rng = np.random.default_rng(strip)
    rects = []
    for page in range(3):
        for ordinal in range(60):
            x0, y0 = (int(v) for v in rng.integers(0, 150, 2))
            rects.append((page, ordinal, x0, y0, x0 + int(rng.integers(1, 14)), y0 + int(rng.integers(1, 30))))
    rects += [(0, 100, 500, 500, 510, 510), (0, 101, 500, 500, 510, 510), (0, 102, 510, 500, 520, 510)]  # equal rectangles; a shared edge is no overlap
    areas = spark.createDataFrame(rects, "page_id int, ordinal int, x0 int, y0 int, x1 int, y1 int").repartition(4)
    got = {(r.page_id, r.ordinal): r.component for r in overlap_groups(areas, strip).collect()}
    assert got == overlapping_pairs(rects) and got[0, 101] == 100 and (0, 102) not in got


def test_stacked_boxes_are_one_group_and_few_jobs(spark):
    """2,000 boxes that wait for each other in turn: no pairs, and as many jobs as for ten of them."""
    rng = np.random.default_rng(3)
    img = np.full((120, 120, 3), 230) + rng.integers(-3, 4, (120, 120, 3))
    img[40:60, 40:70] = 10
    counts = []
    tracker = spark.sparkContext.statusTracker()
    for n in (10, 2000):
        boxes = [(int(x), int(y)) for x, y in rng.integers(10, 40, (n, 2))]
        rows = [(0, i, "bubble", x / 1.2 + 0.01, y / 1.2 + 0.01, (x + 60) / 1.2 + 0.01, (y + 60) / 1.2 + 0.01, 120, 120) for i, (x, y) in enumerate(boxes)]
        table = spark.createDataFrame(rows, "page_id int, ordinal int, type string, xmin double, ymin double, xmax double, ymax double, width int, height int")
        ordered = E.erase_order(E.rects(table))
        assert ordered.count() == n and ordered.where("bound AND component = 0").count() == n
        assert ordered.agg(F.max("step")).head()[0] == n - 1
        spark.sparkContext.setJobGroup(f"stack{n}", "")
        plan = E.erase_page(to_rows(spark, [img]), table, "normal")
        got = to_image(plan.pixels, 0, (120, 120))
        spark.sparkContext.setJobGroup("other", "")
        counts.append(len(tracker.getJobIdsForGroup(f"stack{n}")))
        mine = [("bubble", r.x0, r.y0, r.x1, r.y1) for r in E.rects(table).orderBy("ordinal").collect()]
        assert (got == erase_np(img, mine)[0]).all()
    assert counts[1] <= counts[0] + 2


def test_components_of_a_page_over_many_tiles(spark, monkeypatch):
    """A chain over several strips and tiles; pixels that the table lacks are neither read nor made."""
    monkeypatch.setattr(E, "COMPONENT_TILE", 16)
    rng = np.random.default_rng(8)
    img = np.full((90, 90, 3), 200) + rng.integers(-2, 3, (90, 90, 3))
    img[::9, ::7] = 20
    rows = [(0, i, "bubble" if i % 3 else "other", 5.0 + 8 * i, 5.0 + 8 * i, 20.0 + 8 * i, 20.0 + 8 * i, 90, 90) for i in range(9)]
    table = spark.createDataFrame(rows, "page_id int, ordinal int, type string, xmin double, ymin double, xmax double, ymax double, width int, height int")
    plan = E.erase_page(to_rows(spark, [img]), table, "normal")
    mine = [(r.type, r.x0, r.y0, r.x1, r.y1) for r in E.rects(table).orderBy("ordinal").collect()]
    want, want_mask = erase_np(img, mine)
    assert (to_image(plan.pixels, 0, (90, 90)) == want).all()
    assert {(r.x, r.y) for r in plan.mask.collect()} == {(int(x), int(y)) for y, x in zip(*np.nonzero(want_mask))}
    holes = to_rows(spark, [img]).where("(x + y) % 5 != 0")
    part = E.erase_page(holes, table, "normal").pixels
    assert part.count() == holes.count() and part.select("page_id", "x", "y").exceptAll(holes.select("page_id", "x", "y")).isEmpty()


def fill_np(img, hole):
    """The pyramid by plain loops over all cells."""
    unit, levels = 65536, []
    sums, counts = np.where(hole[..., None], 0, img).astype(object), (~hole).astype(int)
    while True:
        levels.append((sums, counts))
        h, w = counts.shape
        if h == w == 1:
            break
        up, n = np.zeros(((h + 1) // 2, (w + 1) // 2, 3), object), np.zeros(((h + 1) // 2, (w + 1) // 2), int)
        for y in range(h):
            for x in range(w):
                up[y // 2, x // 2] += sums[y, x]
                n[y // 2, x // 2] += counts[y, x]
        sums, counts = up, n
    value = None
    for sums, counts in reversed(levels):
        h, w = counts.shape
        now = {}
        for y in range(h):
            for x in range(w):
                if counts[y, x]:
                    now[y, x] = [int(s) * unit // int(counts[y, x]) for s in sums[y, x]]
                elif value:
                    near = [(a * b, value.get((y // 2 + dy, x // 2 + dx))) for dy, a in ((0, 3), (1 if y % 2 else -1, 1)) for dx, b in ((0, 3), (1 if x % 2 else -1, 1))]
                    near = [(k, v) for k, v in near if v]
                    if near:
                        now[y, x] = [sum(k * v[c] for k, v in near) // sum(k for k, _ in near) for c in range(3)]
        value = now
    return np.array([[[(v + unit // 2) // unit for v in value[y, x]] if (y, x) in value else [255] * 3 for x in range(img.shape[1])] for y in range(img.shape[0])])


def mask_rows(spark, holes):
    return spark.createDataFrame([(i, int(x), int(y)) for i, m in enumerate(holes) for y, x in zip(*np.nonzero(m))] * 2, "page_id int, x int, y int")


def test_holes_are_filled_from_around(spark):
    rng = np.random.default_rng(6)
    shapes = [(1, 1), (1, 9), (6, 6), (13, 20), (33, 17)]
    images = [rng.integers(0, 256, (*s, 3)) for s in shapes]
    holes = [rng.random(s) < 0.4 for s in shapes]
    holes[3][2:11, 3:18] = True
    holes[1][:] = True  # all hole: white
    images.append(images[2])  # a page without a mask stays as it is
    out = P.fill_holes(to_rows(spark, images), mask_rows(spark, holes)).cache()
    for i, (img, hole) in enumerate(zip(images, holes)):
        assert (to_image(out, i, img.shape[:2]) == fill_np(img, hole)).all(), i
    assert (to_image(out, 5, (6, 6)) == images[2]).all() and out.count() == sum(i.shape[0] * i.shape[1] for i in images)


def test_a_gradient_goes_on_over_the_hole_and_pages_differ(spark):
    ramp = np.repeat(np.repeat((np.arange(64) * 3)[None, :, None], 64, 0), 3, 2)
    other = 255 - ramp
    hole = np.zeros((64, 64), bool)
    hole[20:44, 24:40] = True
    out = P.fill_holes(to_rows(spark, [ramp, other]), mask_rows(spark, [hole, hole])).cache()
    for i, img in enumerate((ramp, other)):
        got = to_image(out, i, (64, 64))
        assert abs(got - img)[hole].max() <= 12 and (got[~hole] == img[~hole]).all()  # the hole spans 48 steps of brightness
        row = got[32, 24:40, 0]
        assert (np.diff(row) >= 0).all() if i == 0 else (np.diff(row) <= 0).all()


def test_inpainter_falls_back_to_the_surroundings(spark):
    ramp = np.repeat(np.repeat((np.arange(40) * 5)[None, :, None], 24, 0), 3, 2)
    hole = np.zeros((24, 40), bool)
    hole[8:16, 10:30] = True
    pixels, mask = to_rows(spark, [ramp]), mask_rows(spark, [hole])

    def broken():
        raise MemoryError

    failing = to_image(V.run_inpainter(pixels, mask, broken, tile=16, halo=4, fill="around"), 0, (24, 40))
    assert (failing == to_image(V.run_inpainter(pixels, mask, fill="around"), 0, (24, 40))).all()
    with pytest.raises(ValueError):
        V.run_inpainter(pixels, mask, fill="other")


def test_bilateral_over_tile_borders(spark):
    """A crop of several tiles and narrow ones, against plain loops; every pixel is shuffled about once, not once per tap."""
    sizes, rng = {1: (70, 35), 2: (1, 5), 3: (2, 3)}, np.random.default_rng(4)
    crops = {k: rng.integers(0, 120, (h, w, 3)) for k, (w, h) in sizes.items()}
    rows = [(k, x, y, *map(int, v[y, x])) for k, v in crops.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    df = R.with_size(spark.createDataFrame(rows, "k int, x int, y int, b int, g int, r int").repartition(3), ["k"])
    mirror = lambda p, n: 0 if n == 1 else min(p % (2 * n - 2), 2 * n - 2 - p % (2 * n - 2))

    def plain(k, x, y):
        v, total, weight = crops[k], np.zeros(3), 0.0
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if dx * dx + dy * dy <= 4:
                    q = v[mirror(y + dy, v.shape[0]), mirror(x + dx, v.shape[1])]
                    w = np.exp(-(dx * dx + dy * dy) / 5000) * np.exp(-float(abs(q - v[y, x]).sum()) ** 2 / 5000)
                    total, weight = total + q * w, weight + w
        return tuple(int(c) for c in np.floor(total / weight + 0.5))

    got = R.bilateral(df, ["k"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # that of with_size
    assert {(r.k, r.x, r.y): (r.b, r.g, r.r) for r in got.collect()} == {(k, x, y): plain(k, x, y) for k, x, y, *_ in rows}
    some = spark.createDataFrame([(1, 31, 3), (1, 32, 34), (2, 0, 4), (1, 31, 3)], "k int, x int, y int")
    assert {(r.k, r.x, r.y): (r.b, r.g, r.r) for r in R.bilateral(df, ["k"], at=some).collect()} == {p: plain(*p) for p in ((1, 31, 3), (1, 32, 34), (2, 0, 4))}
