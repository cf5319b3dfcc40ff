"""Steps that must not keep a large group in one task, one row of Python at a time, or as all its pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
from scenequarry.functions import geometry as g
from scenequarry.functions import masks, raster
from scenequarry.operators import assign
from scenequarry.operators import matching as m

R = random.Random(9)


def drawn(n, span):
    rows = []
    for k in range(n):
        cuts = sorted(R.sample(range(span), 2 * R.randint(1, 6)))
        rows += [(k % 2, k, cuts[i], cuts[i + 1]) for i in range(0, len(cuts), 2)]
    return rows


def test_masks_of_a_group_meet_in_chunks_of_their_own(spark):
    for span in (40, 100_000):
        rows = drawn(60, span)
        spans = spark.createDataFrame([*rows, (3, 900, 5, 9), (3, 901, 9, 12)], "image_id long, k long, start long, end long")
        pixels = {}
        for i, k, s, e in rows:
            pixels.setdefault((i, k), set()).update(range(s, e))
        want = {(i, a, b, len(p & q)) for (i, a), p in pixels.items() for (j, b), q in pixels.items() if i == j and a < b and p & q}
        for weight in (64, 1 << 15):
            got = [tuple(r) for r in masks.overlaps_within(spans, ["image_id"], "k", weight).select("image_id", "k", "other", "inter").collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_masks_are_looked_up_where_places_are_many():
    flat = lambda ms: (np.array([s for m in ms for s, _ in m]), np.array([e for m in ms for _, e in m]), np.cumsum([0, *map(len, ms)]))
    ms = [[(0, 4), (6, 9)], [(2, 7)], [(20, 30)], [(8, 25), (26, 27)]]
    few, many = masks._meeting(*flat(ms), *flat(ms)), masks._meeting(*flat(ms), *flat(ms), dense=0)
    assert [x.tolist() for x in few] == [x.tolist() for x in many]
    assert (0, 1, 3) in zip(*(x.tolist() for x in few))


def boxes(spark, key, n):
    rows = [(k % 3, k, x := R.randint(0, 20), y := R.randint(0, 20), x + R.randint(1, 20), y + R.randint(1, 20), k % 2) for k in range(n)]
    return spark.createDataFrame([(*r[:2], *map(float, r[2:6]), r[6]) for r in rows], f"image_id long, {key} long, x1 double, y1 double, x2 double, y2 double, kind int")


def test_pairs_of_an_image_are_neither_joined_nor_sorted_nor_shuffled(spark):
    a, b = boxes(spark, "det_id", 30), boxes(spark, "gt_id", 20)
    cost = lambda p, q: 1 - g.iou_arrays(p[:, :, None], q[:, None, :], 0, 1e-6)
    for got in (assign.by_overlap(a, b), assign.uniform(a, b), assign.least_cost(a, b, "det_id", "gt_id", cost), m.nearest(a, b, "det_id", "gt_id"), m.best_of_groups(a, b, "kind", "gt_id")):
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "Join" not in plan and "Window" not in plan and plan.count("Exchange ") == 1


def test_pairs_come_in_parts():
    kind = pa.list_(pa.struct([("id", pa.int64()), *((c, pa.float64()) for c in g.FIELDS)]))
    row = lambda *ids: [{"id": i, **dict.fromkeys(g.FIELDS, float(i))} for i in ids]
    a, b = m.Side(pa.array([row(3, 1), row(), row(5), row(7, 8, 9)], kind), "id"), m.Side(pa.array([row(2, 4), row(6), row(), row(10, 11)], kind), "id")
    for cells in (1, 3, 100):
        pairs = [(int(a.box[0, i]), int(b.box[0, j])) for part in a.pairs(b, cells) for i, j in zip(*part, strict=True)]
        assert pairs == [(1, 2), (1, 4), (3, 2), (3, 4), (7, 10), (7, 11), (8, 10), (8, 11), (9, 10), (9, 11)]


def test_matrices_are_solved_together():
    rng = np.random.default_rng(3)
    costs = [rng.integers(0, 9, (rng.integers(1, 6), rng.integers(1, 6))).astype(float) for _ in range(80)]
    for c, (rows, cols) in zip(costs, assign.assignments(costs, 200), strict=True):
        w = c if c.shape[0] <= c.shape[1] else c.T
        least = min(sum(w[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(w.shape[1]), w.shape[0]))
        assert len(set(rows)) == len(set(cols)) == min(c.shape) and c[rows, cols].sum() == least


def test_bitmaps_are_cleaned_together():
    rng = np.random.default_rng(5)
    bitmaps = [rng.random((h, w)) < 0.35 for h, w in ((5, 7), (1, 1), (9, 4), (3, 12), (6, 6)) * 6] + [np.ones((2, 3), bool), np.zeros((2, 3), bool), np.eye(4, dtype=bool)[::3]]
    for holes in (False, True):
        got = raster.cleaned([raster.runs_of(b) for b in bitmaps], np.array([b.shape for b in bitmaps]), 4, holes)
        for b, c in zip(bitmaps, got, strict=True):
            parts, sizes = raster.labelled(~b if holes else b)
            small = np.flatnonzero(sizes < 4) + 1
            if not holes and len(small) == len(sizes) and len(sizes):
                small = np.setdiff1d(small, [sizes.argmax() + 1])
            want = b | np.isin(parts, small) if holes else b & ~np.isin(parts, small)
            assert c.tolist() == raster.runs_of(want)


def test_pixels_on_an_edge_and_beyond_the_bitmap():
    got = raster.inside_polygon([0.5, 2.5, 2.5, 0.5], [-3, -3, 9, 9], 2, 4)
    assert got.tolist() == [[True, True, False, False]] * 2
    assert not raster.inside_polygon([9, 12, 12], [0, 0, 2], 3, 4).any()
