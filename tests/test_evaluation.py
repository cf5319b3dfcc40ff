import math
import random

import pytest
from pyspark.sql import functions as F
from scenequarry.operators import evaluation as ev
from scenequarry.operators import matching


def test_top_classes_equal_a_loop(spark):
    r, names = random.Random(3), list("abcde")
    rows = [(i, [float(r.randint(-3, 3)) for _ in names]) for i in range(40)] + [(40, [])]
    got = spark.createDataFrame(rows, "k long, v array<double>").select("k", ev.top_classes(F.col("v"), names, 3).alias("t")).collect()
    for k, t in got:
        v = rows[k][1]
        order = sorted(range(len(v)), key=lambda i: (-v[i], i))[:3]
        assert [x.name for x in t] == [names[i] for i in order]
        assert [x.share for x in t] == pytest.approx([math.exp(v[i]) / sum(map(math.exp, v)) for i in order])


def test_labels_outside_the_tree_stay(spark):
    tree = spark.createDataFrame([("all", "dog"), ("dog", "dog")], "ancestor string, node string")
    rows = spark.createDataFrame([(1, "dog"), (1, "dog"), (2, "cat"), (3, None)], "image_id long, label string")
    assert sorted((r.image_id, r.label or "") for r in ev.with_ancestors(rows, tree).collect()) == [(1, "all"), (1, "all"), (1, "dog"), (1, "dog"), (2, "cat"), (3, "")]
    assert ev.with_ancestors(rows.limit(0), tree).count() == 0


def test_only_judged_labels_count(spark):
    d = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "a")], "det_id long, image_id long, label string")
    known = spark.createDataFrame([(1, "a"), (1, "a")], "image_id long, label string")
    lack = spark.createDataFrame([(1, "b"), (None, None)], "image_id long, label string")
    judged = ev.federated(d, known, lack)
    assert sorted(r.det_id for r in judged.collect()) == [1, 2]
    hits = judged.withColumns({"tp": F.lit(0), "fp": F.lit(1)})
    assert {r.det_id: r.fp for r in ev.lenient(hits, known).collect()} == {1: 0, 2: 1}


def test_names_spans_and_sizes(spark):
    rows = spark.createDataFrame([("m/x/checkpoint-7/",), ("checkpoint-7",), ("/a/b",), ("",), (None,)], "p string")
    assert [r[0] for r in rows.select(ev.model_name(F.col("p"))).collect()] == ["x_checkpoint-7", "checkpoint-7", "b", "", None]
    one = spark.range(1)
    s = one.select(ev.span_in_lower(F.lit("A Dog ran"), F.lit("Dog")).alias("a"), ev.span_in_lower(F.lit("A dog"), F.lit("dog")).alias("b")).first()
    assert (s.a.start, s.b.start, s.b.end) == (-1, 2, 5)
    assert tuple(one.select(*ev.fit_long_edge(F.lit(500), F.lit(333))).first()) == (384, 255)
    assert tuple(one.select(*ev.fit_long_edge(F.lit(333), F.lit(500))).first()) == (255, 384)


def test_reduction_and_empty_images(spark):
    rows = spark.createDataFrame([(1, 2.0, 0.5), (1, 4.0, None)], "k long, v double, w double")
    assert ev.reduced(rows, ["k"], "v", "w", "sum").first().loss == 1.0
    with pytest.raises(ValueError):
        ev.reduced(rows, ["k"], "v", kind="sum", avg_factor="k")
    labels = ev.labels_of(rows.limit(0).select(F.col("k").alias("image_id"), F.lit("a").alias("label")), rows.limit(0).select(F.col("k").alias("image_id"), F.lit("a").alias("label")))
    assert labels.count() == 0


def overlap(a, b, of_first):
    both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    own, other = ((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))
    return both / max(own if of_first else own + other - both, 1e-6)


def test_grouped_positives_of_a_tree_equal_a_loop(spark):
    r = random.Random(5)
    box = lambda: (x := float(r.randint(0, 12)), y := float(r.randint(0, 12)), x + r.randint(4, 16), y + r.randint(4, 16))
    label = lambda: r.choice(["A", "A", "N", "R", None])
    dets = [(i, 100 * i + k, *box(), r.choice([0.1, 0.5, 0.5, 0.9, None]), label()) for i in range(12) for k in range(r.choice([0, 3, 15]))]
    truths = [(i, 100 * i + k, *box(), label(), r.choice([True, False, False])) for i in range(12) for k in range(r.choice([0, 2, 9]))]
    tree = [("all", "all"), ("A", "A"), ("N", "N"), ("all", "A"), ("all", "N")]
    up = lambda x: [a for a, n in tree if n == x] or [x]
    want, groups = set(), {(d[0], x) for d in dets for x in up(d[7])}
    for image, name in groups:
        mine = sorted((d for d in dets if d[0] == image and name in up(d[7])), key=lambda d: (-(d[6] or -1), d[1]))
        own = [g for g in truths if g[0] == image and name is not None and name in up(g[6])]
        taken, whole = set(), set()
        for d in mine:
            single = min(((-overlap(d[2:6], g[2:6], False), g[1]) for g in own if not g[7]), default=(0, None))
            hit = single[1] if single[0] <= -0.5 else None
            if hit is not None and hit not in taken:
                taken.add(hit)
                want.add((image, d[1], name, 1, 0, hit, None))
                continue
            group = min(((-overlap(d[2:6], g[2:6], True), g[1]) for g in own if g[7]), default=(0, None))
            if group[0] > -0.5:
                want.add((image, d[1], name, 0, 1, hit, None))
            elif group[1] not in whole:
                whole.add(group[1])
                want.add((image, d[1], name, 1, 0, hit, group[1]))
    closure = spark.createDataFrame(tree, "ancestor string, node string")
    d = spark.createDataFrame(dets, "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double, label string")
    t = spark.createDataFrame(truths, "image_id long, gt_id long, x1 double, y1 double, x2 double, y2 double, label string, is_group boolean")
    got = matching.grouped_positives(ev.ancestors(d, closure), ev.ancestors(t, closure)).select("image_id", "det_id", "label", "tp", "fp", "gt_id", "group_id").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    plain = matching.grouped_positives(ev.with_ancestors(d, closure).filter("label = 'all'"), ev.with_ancestors(t, closure).filter("label = 'all'")).select("image_id", "det_id", "label", "tp", "fp", "gt_id", "group_id").collect()
    assert {tuple(x) for x in plain} == {x for x in want if x[2] == "all"}


def test_rows_of_hierarchical_ap_are_shuffled_by_image_once(spark):
    from compare import SF
    from scenequarry.plans import evaluation_queries as eq
    from scenequarry.plans import tables

    tree = spark.createDataFrame(eq.TREE, "ancestor string, node string")
    gt = tables.truths(spark, SF).withColumn("is_group", F.lit(False))
    hits = matching.grouped_positives(ev.ancestors(tables.predictions(spark, SF), tree), ev.ancestors(gt, tree))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") == 1 and "SortMergeJoin" not in plan and "Window" not in plan
