import hashlib
import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F
from scenequarry.functions import geometry as g
from scenequarry.functions import masks
from scenequarry.operators import coders, crops, depth, views

R = random.Random(11)


def test_medians_in_rounds(spark):
    groups = {0: [R.random() for _ in range(500)], 1: [R.choice([0.0, 1.0, 1e9]) for _ in range(40)], 2: [5.0], 3: [0.0] * 50 + [1.0] * 50, 4: [R.gauss(0, 1) for _ in range(301)], 5: [-1e300, 1e-300, 2e-300, 3e-300, 4e-300, 5e-300]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(7, None)], "k long, v double").repartition(3)
    for few, parts in ((4, 3), (100, 8), (65_536, 1024)):
        assert {r.k: r.v for r in depth.medians(df, ["k"], "v", few, parts).collect()} == pytest.approx({k: median(vs) for k, vs in groups.items()})
    assert depth.medians(df.limit(0), ["k"], "v").count() == 0


def test_depth_in_boxes(spark):
    maps = {i: {(x, y): R.choice([0.0, math.nan, R.random(), 0.5]) for x in range(23) for y in range(17)} for i in range(2)}
    pixels = spark.createDataFrame([(i, x, y, d) for i, m in maps.items() for (x, y), d in m.items()] + [(0, 30, 30, None)], "image_id long, x long, y long, depth double")
    boxes = [(i, k, R.uniform(-9, 20), R.uniform(-9, 14), R.uniform(0, 40), R.uniform(0, 30)) for i in range(3) for k in range(25)] + [(0, 90, 0.0, 0.0, 1e12, 1e12), (1, 91, 4.9, 4.9, 4.95, 9.0), (1, 92, 100.0, 3.0, 200.0, 9.0)]
    want = {}
    for i, k, x1, y1, x2, y2 in boxes:
        inside = [d for (x, y), d in maps.get(i, {}).items() if max(0, int(x1)) <= x < int(x2) and max(0, int(y1)) <= y < int(y2) and d and not math.isnan(d)]
        if inside:
            want[i, k] = median(inside)
    got = depth.median_depths(depth.tiled(pixels, ["image_id"], 8), spark.createDataFrame(boxes, "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double"), ["image_id"], "box_id", 8)
    assert {(r.image_id, r.box_id): r.depth for r in got.collect()} == pytest.approx(want)


def loop_patch(image, w, h, boxes, seed, floors=(0.1, 0.3, 0.5, 0.7, 0.9), least=0.3, attempts=50, rounds=4):
    draw = lambda *p: int(hashlib.md5(":".join(map(str, (seed, image, *p))).encode()).hexdigest()[:8], 16) / 2**32
    for turn in range(rounds):
        need = (1.0, *floors, 0.0)[int(draw(turn, "mode") * (len(floors) + 2))]
        if need == 1:
            return (turn, -1, 0, 0, int(w), int(h))
        for k in range(attempts):
            a, b = w * least + (w - w * least) * draw(turn, "w", k), h * least + (h - h * least) * draw(turn, "h", k)
            if not 0.5 <= b / a <= 2:
                continue
            x, y = (w - a) * draw(turn, "x", k), (h - b) * draw(turn, "y", k)
            p = (math.floor(x), math.floor(y), math.floor(x + a), math.floor(y + b))
            if p[2] <= p[0] or p[3] <= p[1]:
                continue
            shares, centred = [], False
            for x1, y1, x2, y2 in boxes:
                i = max(min(p[2], x2) - max(p[0], x1), 0) * max(min(p[3], y2) - max(p[1], y1), 0)
                shares.append(i / max((p[2] - p[0]) * (p[3] - p[1]) + (x2 - x1) * (y2 - y1) - i, 1e-6))
                centred |= p[0] < (x1 + x2) / 2 < p[2] and p[1] < (y1 + y2) / 2 < p[3]
            if not boxes or (min(shares) >= need and centred):
                return (turn, k, *p)
    return (None, -1, 0, 0, int(w), int(h))


def test_crops_are_the_loop_s(spark):
    images = [(i, float(R.randrange(1, 300)), float(R.randrange(1, 300))) for i in range(60)]
    boxes = {i: [(x := R.uniform(0, w), y := R.uniform(0, h), R.uniform(x, w), R.uniform(y, h)) for _ in range(R.choice([0, 1, 1, 4]))] for i, w, h in images}
    table = spark.createDataFrame([(i, *b) for i, bs in boxes.items() for b in bs], "image_id long, x1 double, y1 double, x2 double, y2 double")
    got = crops.by_overlap(spark.createDataFrame(images, "image_id long, width double, height double").repartition(3), table, 5).collect()
    want = {i: loop_patch(i, w, h, boxes[i], 5) for i, w, h in images}
    assert len(got) == 60 and {r.image_id: tuple(r)[1:] for r in got} == want
    assert {None} < {p[0] for p in want.values()} and any(p[1] > 0 for p in want.values())
    out = crops.cropped(spark.createDataFrame([(1, 10.0, 10.0, 50.0, 30.0), (1, 0.0, 0.0, 21.0, 21.0), (2, 0.0, 0.0, 9.0, 9.0)], table.schema), spark.createDataFrame([(1, 20, 5, 40, 45)], "image_id long, px1 long, py1 long, px2 long, py2 long"))
    assert [tuple(r) for r in out.collect()] == [(1, 0.0, 5.0, 20.0, 25.0)]


def test_bucket_coder_is_the_loop_s(spark):
    rows = [(k, *b, *(v + R.uniform(-8, 8) for v in b)) for k in range(40) for x in [R.uniform(0, 50)] for y in [R.uniform(0, 50)] for b in [(x, y, x + R.uniform(20, 60), y + R.uniform(20, 60))]]
    df = spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double, t1 double, u1 double, t2 double, u2 double")
    truth = g.of(*(F.col(c) for c in ("t1", "u1", "t2", "u2")))
    coded = df.select("k", *g.FIELDS, *(c.alias(s) for s, c in coders.bucket_targets(g.box(), truth, 10, 1.5).items()))
    scores = {s: F.transform(F.col(s)["offsets"], lambda v: -2 * v * v) for s in coders.SIDES}
    box, sure = coders.bucket_boxes(g.box(), scores, {s: F.col(s)["offsets"] for s in coders.SIDES}, 10, 1.5)
    got = {r.k: r for r in coded.select("k", *coders.SIDES, *g.columns(box), sure.alias("sure")).collect()}
    for k, x1, y1, x2, y2, t1, u1, t2, u2 in rows:
        shares = []
        for side, low, high, goal, sign in (("left", x1, x2, t1, 1), ("right", x1, x2, t2, -1), ("top", y1, y2, u1, 1), ("bottom", y1, y2, u2, -1)):
            width = (high - low) * 1.5 / 10
            start = (low + high) / 2 - sign * (high - low) * 1.5 / 2
            off = [(start + sign * (i + 0.5) * width - goal) / width for i in range(5)]
            order = sorted(range(5), key=lambda i: abs(off[i]))  # noqa: B023
            cell = got[k][side]
            assert cell.bucket == order[0] and cell.offsets == pytest.approx(off)
            assert cell.weights == [float(i == order[0] or (i == order[1] and abs(off[i]) < 1)) for i in range(5)]
            assert cell.classes == [float(not (abs(off[i]) < 1 and i != order[0])) for i in range(5)]
            e = [math.exp(-2 * v * v) for v in off]
            shares.append((e[order[0]] + (e[order[1]] if abs(order[0] - order[1]) == 1 else 0)) / sum(e))
        assert [got[k][f] for f in g.FIELDS] == pytest.approx([t1, u1, t2, u2]) and got[k].sure == pytest.approx(sum(shares) / 4)
    # the second best lies apart, and corners are clipped
    one = df.limit(1).select(g.struct(coders.bucket_boxes(g.box(), {s: F.array(*map(F.lit, (3.0, 0.0, 2.0))) for s in coders.SIDES}, {s: F.array(*map(F.lit, (99.0, 0.0, 0.0))) for s in coders.SIDES}, 6, 1.0, (30, 20))[0]).alias("b"), coders.bucket_boxes(g.box(), {s: F.array(*map(F.lit, (3.0, 0.0, 2.0))) for s in coders.SIDES}, {s: F.array(*map(F.lit, (99.0, 0.0, 0.0))) for s in coders.SIDES}, 6)[1].alias("sure")).first()
    assert one.b.x1 == 0 and one.b.y1 == 0 and one.sure == pytest.approx(math.exp(3) / (math.exp(3) + 1 + math.exp(2)))


def test_views_come_back(spark):
    rows = [(i, k, x, y, x + R.uniform(1, 30), y + R.uniform(1, 30), R.random(), 100.0, 80.0) for i in range(3) for k in range(6) for x in [R.uniform(0, 60)] for y in [R.uniform(0, 40)]]
    df = spark.createDataFrame(rows, "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double, width double, height double")
    seen = views.fan_out(df, [(s, f) for s in (0.5, 2.0) for f in views.FLIPS])
    assert {(r.x1, r.y1, r.x2, r.y2) for r in seen.filter("view = 7 and image_id = 0 and det_id = 0").collect()} == {(200 - rows[0][4] * 2, 160 - rows[0][5] * 2, 200 - rows[0][2] * 2, 160 - rows[0][3] * 2)}
    got = views.merged_boxes(views.restored(seen), ["image_id", "det_id"], F.col("view") + 1.0)
    assert {(r.image_id, r.det_id): tuple(r)[2:] for r in got.collect()} == {r[:2]: pytest.approx(r[2:7]) for r in rows}
    weighted = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0, 1.0, 1.0), (1, 2.0, 2.0, 8.0, 8.0, 0.2, 3.0)], "image_id long, x1 double, y1 double, x2 double, y2 double, score double, w double")
    assert tuple(views.merged_boxes(weighted, ["image_id"], F.col("w")).first()) == pytest.approx((1, 1.5, 1.5, 7.0, 7.0, 0.4))
    every = views.restored(seen).withColumn("det_id", F.col("det_id") * 8 + F.col("view"))
    best = views.merged_proposals(every, 0.95, 4).collect()
    top = {i: sorted((-r[6], r[1]) for r in rows if r[0] == i)[:4] for i in range(3)}
    assert sorted((r.image_id, r.det_id // 8) for r in best) == sorted((i, k) for i, t in top.items() for _, k in t)
    with pytest.raises(ValueError, match="flips"):
        views.fan_out(df, [(1.0, "up")])


def test_votes_are_what_pixels_say(spark):
    w, h, weights = 7, 5, {0: 1.0, 1: 2.0, 2: 0.5}
    table, want = [], {}
    for k in range(6):
        share = [0.0] * (w * h)
        for view, (flip, weight) in enumerate(zip(("", "horizontal", "diagonal"), weights.values(), strict=True)):
            at = 0
            while at < w * h:
                n = R.randrange(1, 9)
                if R.random() < 0.5:
                    table.append((k, view, flip, weight, at, min(at + n, w * h), w, h))
                    for p in range(at, min(at + n, w * h)):
                        x, y = divmod(p, h)
                        x, y = (w - 1 - x if flip else x), (h - 1 - y if flip == "diagonal" else y)
                        share[x * h + y] += weight
                at += n
        want |= {(k, p): 1 for p, v in enumerate(share) if v / 3.5 > 0.5}
    runs = spark.createDataFrame(table, "k long, view long, flip string, w double, start long, end long, width long, height long")
    got = views.voted(views.flipped_runs(runs, ["k", "view", "w"]), ["k"], "w", F.lit(3.5)).collect()
    assert {(r.k, p) for r in got for p in range(r.start, r.end)} == set(want) and all(r.end > r.start for r in got)
    ends = [(r.k, r.end) for r in got]
    assert not {(r.k, r.start) for r in got} & set(ends)


def test_mask_targets_are_what_a_bitmap_says(spark):
    w, h, size = 9, 6, 4
    spans, boxes, want, bits = [], [], set(), {}
    for k in range(5):
        at, bits[k] = 0, set()
        while at < w * h:
            n = R.randrange(1, 8)
            if R.random() < 0.6:
                spans.append((k, at, min(at + n, w * h), h))
                bits[k] |= set(range(at, min(at + n, w * h)))
            at += n
    for k in range(5):
        for b in range(6):
            x, y = R.randrange(-2, 7), R.randrange(-2, 4)
            x2, y2 = x + R.choice([1, 2, 4, 8]), y + R.choice([1, 2, 4, 8])
            boxes.append((k, b, float(x), float(y), float(x2), float(y2)))
            for j in range(size):
                for i in range(size):
                    # sixteenths of a cell fall on whole pixels, since sides are powers of two
                    inside = [(math.floor(x + (j + (a + 0.5) / 16) * (x2 - x) / size), math.floor(y + (i + (c + 0.5) / 16) * (y2 - y) / size)) for a in range(16) for c in range(16)]
                    if sum(0 <= px < w and 0 <= py < h and px * h + py in bits[k] for px, py in inside) >= 128:
                        want.add((k, b, j * size + i))
    boxes += [(0, 90, 1.0, 1.0, 1.0, 3.0), (9, 91, 0.0, 0.0, 2.0, 2.0)]
    schema = "k long, b long, x1 double, y1 double, x2 double, y2 double"
    got = masks.targets(spark.createDataFrame(spans, "k long, start long, end long, height long").repartition(3), spark.createDataFrame(boxes, schema), ["k"], "b", size).collect()
    assert {(r.k, r.b, p) for r in got for p in range(r.start, r.end)} == want and want


def test_coded_boxes_read_back_in_one_go(spark):
    rows = [(k, *b, *(v + R.uniform(-8, 8) for v in b)) for k in range(50) for x in [R.uniform(0, 50)] for y in [R.uniform(0, 50)] for b in [(x, y, x + R.uniform(20, 60), y + R.uniform(20, 60))]]
    rows.append((50, None, 0.0, 9.0, 9.0, 0.0, 0.0, 9.0, 9.0))
    df = spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double, t1 double, u1 double, t2 double, u2 double").coalesce(1)
    truth = g.of(*(F.col(c) for c in ("t1", "u1", "t2", "u2")))
    cells = df.select("k", *g.FIELDS, coders.round_trip(g.box(), truth, rows=7).alias("r"), *(c.alias(s) for s, c in coders.bucket_targets(g.box(), truth).items()))
    offsets = {s: F.col(s)["offsets"] for s in coders.SIDES}
    box, sure = coders.bucket_boxes(g.box(), {s: F.transform(o, lambda v: -F.abs(v)) for s, o in offsets.items()}, offsets)
    for r in cells.select("k", "r", *coders.SIDES, g.struct(box).alias("box"), sure.alias("sure")).collect():
        sides = [r[s] for s in coders.SIDES]
        assert [r.r[s] for s in coders.SIDES] == [s.bucket for s in sides]
        assert (r.r.weighed, r.r.spared) == (sum(sum(s.weights) for s in sides), 28 - sum(sum(s.classes) for s in sides))
        assert [r.r[f] for f in g.FIELDS] == list(r.box) and r.r.sure == r.sure
        if r.k < 50:
            assert r.r.offsets == pytest.approx(sum(s.offsets[s.bucket] for s in sides)) and list(r.box) == pytest.approx(rows[r.k][5:])
        else:
            assert (r.r.x1, r.r.x2, r.r.offsets, r.sure) == (None,) * 4 and (r.r.y1, r.r.y2) == pytest.approx((0, 9))


def test_the_bucket_coder_s_query_codes_boxes_in_batches(spark):
    from compare import SF
    from scenequarry.plans.queries import QUERIES

    plan = QUERIES["g8_bucket_coder"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("ArrowEvalPython") == 1
