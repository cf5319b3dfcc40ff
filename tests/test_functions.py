import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenequarry.functions import geometry as g
from scenequarry.functions import losses, masks
from scenequarry.functions import text as x
from scenequarry.operators import assign
from scenequarry.operators import detections as d
from scenequarry.operators import matching as m

R = random.Random(3)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(*v):
    return g.of(*(F.lit(float(c)) for c in v))


def test_box_algebra(spark):
    a, b = lit(0, 0, 10, 10), lit(5, 5, 15, 15)
    r = one(spark, g.iou(a, b), g.iou(a, b, 1), g.dice(a, b, 0), g.giou(a, b), g.iof(a, b), g.inside(lit(1, 1, 9, 9), a), g.inside(b, a))
    assert [round(v, 6) if isinstance(v, float) else v for v in r] == [round(25 / 175, 6), round(36 / 206, 6), 0.25, round(25 / 175 - 50 / 225, 6), 0.25, True, False]


@pytest.mark.parametrize("kind", ["log", "linear", "square", "giou", "diou", "ciou"])
def test_losses_vanish_on_equal_boxes(spark, kind):
    a = lit(2, 3, 12, 9)
    assert abs(one(spark, losses.iou_loss(a, a, kind))[0]) < 1e-4


def test_coders_invert(spark):
    anchor, target = lit(10, 20, 50, 80), lit(15, 18, 70, 90)
    back = g.decode_deltas(anchor, g.encode_deltas(anchor, target, stds=(0.1, 0.1, 0.2, 0.2)), stds=(0.1, 0.1, 0.2, 0.2))
    sides = g.decode_sides(anchor, g.encode_sides(anchor, target))
    assert [round(v, 9) for v in one(spark, *g.columns(back), *g.columns(sides))] == [15, 18, 70, 90] * 2


def random_boxes(n=40):
    return [(i, k, *(lambda p: (p[0], p[1], p[0] + R.randint(5, 40), p[1] + R.randint(5, 40)))((R.randint(0, 60), R.randint(0, 60))), R.randint(0, 20) / 20, R.randint(0, 4)) for i in range(3) for k in range(n)]


def iou(a, b, p=0):
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + p, min(a[3], b[3]) - max(a[1], b[1]) + p
    i = max(w, 0) * max(h, 0)
    return i / ((a[2] - a[0] + p) * (a[3] - a[1] + p) + (b[2] - b[0] + p) * (b[3] - b[1] + p) - i)


@pytest.fixture(scope="module")
def boxes(spark):
    rows = random_boxes()
    return rows, spark.createDataFrame([(i, k, *map(float, c), s, m_, "A") for i, k, *c, s, m_ in rows], "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double, model_id long, label string")


def test_suppression_equals_a_loop(spark, boxes):
    rows, df = boxes
    want = set()
    for i in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[6], r[1])):
            if all(iou(k[2:6], r[2:6]) <= 0.3 for k in kept):
                kept.append(r)
        want |= {r[:2] for r in kept}
    assert {(r.image_id, r.det_id) for r in d.suppress(df, 0.0, 0.3).collect()} == want
    unique = df.withColumn("det_id", F.col("image_id") * 1000 + F.col("det_id"))
    assert {(r.image_id, r.det_id % 1000) for r in d.suppress_in_rounds(unique, 0.3).collect()} == want


def test_grouping_equals_a_loop(spark, boxes):
    rows, df = boxes
    want = {}
    for i in range(3):
        todo = sorted((r for r in rows if r[0] == i), key=lambda r: (r[7], r[1]))
        seeds = []
        for r in todo:
            own = next((s for s in seeds if s[7] < r[7] and iou(s[2:6], r[2:6], 1) >= 0.4), None)
            if own is None:
                seeds.append(r)
            want[r[:2]] = (own or r)[1]
    assert {(r.image_id, r.det_id): r.seed_id for r in d.group_across_models(df, 0.4).collect()} == want


def test_one_to_one_equals_a_loop(spark, boxes):
    rows, df = boxes
    a, b = df.filter("det_id % 2 = 0"), df.filter("det_id % 2 = 1").withColumnRenamed("det_id", "gt_id")
    got = {(r.det_id, r.gt_id, r.image_id) for r in m.one_to_one(m.pairs_of(a, b, "det_id", "gt_id"), "det_id", "gt_id").collect()}
    want = set()
    for i in range(3):
        mine = [r for r in rows if r[0] == i]
        pairs = sorted((-iou(p[2:6], q[2:6]), p[1], q[1]) for p in mine for q in mine if p[1] % 2 == 0 and q[1] % 2 == 1)
        used_a, used_b = set(), set()
        for o, p, q in pairs:
            if o < 0 and p not in used_a and q not in used_b:
                want.add((p, q, i))
                used_a.add(p)
                used_b.add(q)
    assert got == want


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (5, 3), (6, 6)])
def test_assignment_is_the_cheapest(shape):
    cost = np.random.default_rng(sum(shape)).random(shape)
    rows, cols = assign.assignment(cost)
    small, large = min(shape), max(shape)
    c = cost if shape[0] <= shape[1] else cost.T
    best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
    assert len(rows) == small and len(set(cols)) == small and abs(cost[rows, cols].sum() - best) < 1e-9


def test_mask_runs(spark):
    bits = [[R.randint(0, 1) for _ in range(30)] for _ in range(4)] + [[1] * 5, [0] * 5]
    px = spark.createDataFrame([(k, p, v) for k, b in enumerate(bits) for p, v in enumerate(b)], "k long, p int, v int")
    rle = masks.encode(px, ["k"], ["p"], "v")
    got = {r.k: r.counts for r in rle.collect()}
    for k, b in enumerate(bits):
        want = [len(list(v)) for _, v in itertools.groupby(b)]
        assert got[k] == ([0] if b[0] else []) + want
    spans = {(r.k, p) for r in masks.runs(rle, ["k"]).collect() for p in range(r.start, r.end)}
    assert spans == {(k, p) for k, b in enumerate(bits) for p, v in enumerate(b) if v}
    area = {r.k: r.a for r in rle.select("k", masks.run_area(F.col("counts")).alias("a")).collect()}
    assert area == {k: sum(b) for k, b in enumerate(bits)}


def test_text(spark):
    s = lambda v: F.lit(v)
    t = F.array(F.struct(s("USER").alias("role"), s("hi").alias("text")), F.struct(s("BOT").alias("role"), s("yo").alias("text")))
    r = one(spark, x.after_colon(s("attr: red: big")), x.after_colon(s("plain")), x.without_assistant(s("ASSISTANT: yes")), x.without_punctuation(s("a-b, c.")), x.differs_by_s(s("cat"), s("cats")), x.tagged(s("a cat sat"), F.array(F.struct(s(2).alias("start"), s(5).alias("end")))), x.cleaned(s("USER: q ASSISTANT: <p> it's </p>  [SEG] ok")), x.prompt(t, "two", "S"), x.prompt(t, "llama2", "S"), x.prompt(t, "plain"))
    assert list(r) == ["red  big", "plain", "yes", "ab, c.", True, "a <p> cat </p> [SEG] sat", "its ok", "S USER: hi BOT: yo</s>", "[INST] <<SYS>>\nS\n<</SYS>>\n\nhi [/INST] yo </s>", "hi yo</s>"]
