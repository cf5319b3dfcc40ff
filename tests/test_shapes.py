import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenequarry.functions import masks, raster
from scenequarry.operators import assign, captions, grounding

R = random.Random(7)


def inside(px, py, xs, ys):
    odd = False
    for i in range(len(xs)):
        j = i - 1
        if (ys[i] > py) != (ys[j] > py) and px < (xs[j] - xs[i]) * (py - ys[i]) / (ys[j] - ys[i]) + xs[i]:
            odd = not odd
    return odd


def test_rasters_equal_point_tests(spark):
    polygons = [[(R.uniform(-2, 14), R.uniform(-2, 11)) for _ in range(R.randint(3, 7))] for _ in range(20)]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in enumerate(polygons)], "k long, p array<struct<x:double,y:double>>")
    got = {r.k: r.c for r in df.select("k", raster.rasterized(F.col("p"), F.lit(9), F.lit(12)).alias("c")).collect()}
    for k, p in enumerate(polygons):
        xs, ys = zip(*p, strict=True)
        want = np.array([[inside(x + 0.5, y + 0.5, xs, ys) for x in range(12)] for y in range(9)])
        assert (raster.bitmap_of(got[k], 9, 12) == want).all()
        assert raster.runs_of(want) == got[k]


def flood(bitmap):
    left, sizes = {tuple(p) for p in np.argwhere(bitmap)}, []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            y, x = todo.pop()
            n += 1
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        sizes.append(n)
    return sorted(sizes)


def test_components_equal_a_flood_fill():
    for seed in range(30):
        bitmap = np.random.default_rng(seed).random((9, 13)) < 0.4
        parts, sizes = raster.labelled(bitmap)
        assert sorted(sizes.tolist()) == flood(bitmap) and ((parts > 0) == bitmap).all()
    assert raster.labelled(np.zeros((3, 4), bool))[1].tolist() == [] and raster.labelled(np.ones((2, 2), bool))[1].tolist() == [4]


def test_small_regions(spark):
    bitmap = np.zeros((8, 12), bool)
    bitmap[1:6, 1:6] = True
    bitmap[3, 3] = False
    bitmap[7, 11] = True
    df = spark.createDataFrame([(raster.runs_of(bitmap), [8, 12]), (raster.runs_of(bitmap & (np.indices(bitmap.shape)[1] > 9)), [8, 12]), (None, [8, 12]), ([96], [8, 12])], "c array<int>, s array<int>")
    got = df.select(masks.run_area(raster.without_small_regions(F.col("c"), F.col("s"), 3, False)).alias("a"), masks.run_area(raster.without_small_regions(F.col("c"), F.col("s"), 3, True)).alias("b")).collect()
    assert [tuple(r) for r in got] == [(24, 26), (1, 1), (None, None), (0, 0)]


def test_polygon_expressions(spark):
    lit = lambda *v: raster.points(*((F.lit(x), F.lit(y)) for x, y in v))
    p = lit((0, 0), (4, 0), (4, 3), (0, 3))
    r = spark.range(1).select(raster.polygon_area(p), raster.polygon_area(lit((0, 0), (1, 1))), raster.polygon_area(raster.resized(raster.flipped(p, 9, 9, "diagonal"), 2, 2)), raster.stability(F.array(F.lit(0.0), F.lit(2.0), F.lit(-3.0))), raster.stability(F.array(F.lit(-3.0))), F.to_json(raster.split_by_lengths(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(2))))).first()
    assert tuple(r) == (12.0, None, 48.0, 0.5, None, "[[1],[2,3]]")


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rouge_equals_the_usual_table(spark):
    rows = [(i, R.choices("abcd", k=R.randrange(9)), R.choices("abcd", k=R.randrange(9))) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a array<string>, b array<string>").repartition(3)
    got = {r.k: r.rouge for r in captions.rouge_l(df.select("k", F.col("a").alias("words")), df.select("k", F.col("b").alias("words")), "k").collect()}
    for k, a, b in rows:
        n = lcs(a, b)
        p, r = n / max(len(a), 1), n / max(len(b), 1)
        assert abs(got[k] - (2.44 * p * r / (r + 1.44 * p) if n else 0)) < 1e-12


def test_phrases(spark):
    said = spark.createDataFrame([("k ite fly ing", ["a b", "a b"], "x"), ("zz top", ["no way", "the cat"], "see the cat sit"), (None, ["abc", "abd"], "abd!"), ("", None, "x")], "s string, o array<string>, c string")
    words = spark.createDataFrame([("kite",), ("flying",), ("top",)], "word string")
    got = grounding.rejoined_words(said, "s", words).select(F.col("rejoined").alias("s"), grounding.best_phrase(F.col("o"), F.col("c")).alias("b")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("kite flying", "a b"), ("zztop", "the cat"), (None, "abd"), ("", None)]))
    r = spark.range(1).select(grounding.noun_phrases(F.lit("The red dogs, and a Tall tree of oak")), grounding.content_words(F.lit("the Red dogs by glass")), grounding.phrase_similarity(F.lit("red dogs"), F.lit("a big red dog runs")), grounding.phrase_similarity(F.lit("the"), F.lit("an apple"))).first()
    assert tuple(r) == (["red dogs", "tall tree", "oak"], ["red", "dog", "glass"], 1.0, 0.0)


@pytest.mark.parametrize("num", [1, 3, 6])
def test_balanced_positives_spread_over_truths(spark, num):
    rows = [(1, i, 1 + (i % 7 == 0) + 2 * (i % 11 == 0)) for i in range(40)] + [(2, 100, 5), (2, 101, 0)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, gt long")
    got = assign.balanced_positives(df, num).collect()
    by = {}
    for r in got:
        by.setdefault(r.image_id, []).append(r.gt)
    assert len(by[1]) == num and by[2] == [5]
    assert all(by[1].count(k) <= int(num / 4 + 0.5) + 1 for k in by[1])  # four truths, of which each has that share at most


def test_polygons_of_one_call_equal_point_tests(spark):
    r = random.Random(11)
    rows = [(k, None if k == 7 else [{"x": float(r.randint(-4, 14)) / r.choice([1, 2]), "y": float(r.randint(-4, 11))} for _ in range(r.randint(0, 6))], r.randint(0, 9), r.randint(0, 12)) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, p array<struct<x:double,y:double>>, h int, w int").coalesce(1)
    counts = raster.rasterized(F.col("p"), F.col("h"), F.col("w"), 100)
    got = {x.k: x for x in df.select("k", counts.alias("c"), raster.pixels_set(counts).alias("set"), masks.run_area(counts).alias("area")).collect()}
    for k, p, h, w in rows:
        if p is None:
            assert tuple(got[k])[1:] == (None, None, None)
            continue
        xs, ys = [v["x"] for v in p], [v["y"] for v in p]
        want = np.array([[inside(x + 0.5, y + 0.5, xs, ys) for x in range(w)] for y in range(h)], bool).reshape(h, w)
        assert got[k].c == raster.runs_of(want) and got[k].set == got[k].area == want.sum()
