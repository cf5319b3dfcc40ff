"""Queries over detections: filters, projections, suppression, grouping, matching and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import losses
from ..operators import assign, detections as d, matching as m, metrics as mt, mixing
from . import tables as t
from .registry import area_sql, fold_sql, iou_sql, query

W = "WITH RECURSIVE " + t.DETECTIONS
THRESHOLDS = [(i, 0.1 * i) for i in range(7)]
THR_SQL = "thr(model_id, threshold) AS (VALUES " + ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in THRESHOLDS) + ")"


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("f1_score_filter", f"{W}, {THR_SQL} SELECT image_id, model_id, label, count(*) AS n, round(sum(score), 6) AS total FROM dets JOIN thr USING (model_id) WHERE score > CASE WHEN label = 'A' AND model_id IN (1, 2) THEN 0.2 ELSE threshold END GROUP BY ALL")
def f1(spark, sf):
    thr = spark.createDataFrame(THRESHOLDS, "model_id long, threshold double")
    return d.score_filter(t.detections(spark, sf), thr, "A", (1, 2), 0.2).groupBy("image_id", "model_id", "label").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score"), "total"))


@query("f4_routing", f"{W} SELECT CASE WHEN model_id = 6 THEN 'attribute' WHEN label = 'A' AND model_id IN (0, 1, 2) AND score > 0.7 THEN 'object' WHEN label = 'A' AND model_id IN (0, 1, 2) AND score > 0.3 THEN 'floating' WHEN label = 'A' THEN 'none' ELSE 'floating' END AS bucket, count(*) AS n FROM dets GROUP BY 1")
def f4(spark, sf):
    dets = t.detections(spark, sf).withColumn("label", F.when(F.col("label") == "A", "person").otherwise(F.col("label")))
    return d.routed(dets, (0, 1, 2), 0.7, 0.3, 6).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("f5_tag_threshold", f"{W} SELECT image_id, string_agg(label, ',' ORDER BY label) AS tags, CAST(count(*) AS BIGINT) AS n FROM (SELECT image_id, label, max(score) AS s FROM dets GROUP BY ALL) WHERE s >= CASE label WHEN 'A' THEN 0.9 WHEN 'N' THEN 0.95 ELSE 0.65 END GROUP BY image_id")
def f5(spark, sf):
    limit = F.when(F.col("label") == "A", 0.9).when(F.col("label") == "N", 0.95).otherwise(0.65)
    tags = t.detections(spark, sf).groupBy("image_id", "label").agg(F.max("score").alias("s")).filter(F.col("s") >= limit)
    return tags.groupBy("image_id").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("tags"), F.count(F.lit(1)).alias("n"))


@query("f10_relative_area", f"{W} SELECT image_id, det_id FROM dets WHERE 100 * (x2 - x1) * (y2 - y1) / (400 * 300) > 6")
def f10(spark, sf):
    return t.detections(spark, sf).filter(100 * g.area(g.box()) / (400 * 300) > 6).select("image_id", "det_id")


@query("f13_clip_to_image", f"{W} SELECT det_id, greatest(0, least(x1, 200)) AS x1, greatest(0, least(y1, 120)) AS y1, greatest(0, least(x2, 200)) AS x2, greatest(0, least(y2, 120)) AS y2 FROM dets WHERE x1 < 200 AND y1 < 120")
def f13(spark, sf):
    return t.detections(spark, sf).filter("x1 < 200 and y1 < 120").select("det_id", *g.columns(g.clipped(g.box(), 200.0, 120.0)))


@query("f14_valid_annotations", f"{W} SELECT det_id, label, (x2 - x1) * (y2 - y1) AS area FROM dets WHERE least(x2, 150) > greatest(x1, 0) AND least(y2, 100) > greatest(y1, 0) AND (x2 - x1) >= 70 AND (y2 - y1) >= 65 AND label IN ('A', 'N')")
def f14(spark, sf):
    meets = g.in_image(g.box(), F.lit(150), F.lit(100))
    return t.detections(spark, sf).filter(meets & (g.width(g.box()) >= 70) & (g.height(g.box()) >= 65) & F.col("label").isin("A", "N")).select("det_id", "label", g.area(g.box()).alias("area"))


@query("f16_images_with_label", f"{W} SELECT DISTINCT image_id FROM dets WHERE image_id IN (SELECT image_id FROM dets WHERE label = 'R' AND score > 0.95)")
def f16(spark, sf):
    dets = t.detections(spark, sf)
    return dets.join(dets.filter("label = 'R' and score > 0.95").select("image_id").distinct(), "image_id", "left_semi").select("image_id").distinct()


@query("f23_near_crop_edge", f"{W} SELECT det_id FROM dets WHERE (abs(x1 - 40) <= 20 AND NOT abs(x1) <= 20) OR (abs(y1 - 40) <= 20 AND NOT abs(y1) <= 20) OR (abs(x2 - 160) <= 20 AND NOT abs(x2 - 400) <= 20) OR (abs(y2 - 120) <= 20 AND NOT abs(y2 - 300) <= 20)")
def f23(spark, sf):
    lit = lambda *v: g.of(*(F.lit(float(x)) for x in v))
    return t.detections(spark, sf).filter(g.near_crop_edge(g.box(), lit(40, 40, 160, 120), lit(0, 0, 400, 300))).select("det_id")


@query("f24_allowed_labels", f"{W}, {t.TRUTHS} SELECT p.image_id, p.det_id FROM preds p WHERE EXISTS (SELECT 1 FROM gts g WHERE g.image_id = p.image_id AND g.label = p.label)")
def f24(spark, sf):
    return t.predictions(spark, sf).join(t.truths(spark, sf).select("image_id", "label").distinct(), ["image_id", "label"], "left_semi").select("image_id", "det_id")


@query("p7_p8_box_forms", f"{W} SELECT det_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM dets")
def p7(spark, sf):
    cx, cy, w, h = g.to_center(g.box())
    return t.detections(spark, sf).select("det_id", "x1", "y1", w.alias("w"), h.alias("h"), cx.alias("cx"), cy.alias("cy"))


@query("p9_p10_resize", f"{W}, s AS (SELECT *, CAST(l % 700 + 50 AS DOUBLE) AS w, CAST(l % 431 + 50 AS DOUBLE) AS h FROM (SELECT *, det_id AS l FROM dets)) SELECT det_id, CAST(floor(w * (1024.0 / greatest(w, h)) + 0.5) AS BIGINT) AS nw, CAST(floor(h * (1024.0 / greatest(w, h)) + 0.5) AS BIGINT) AS nh, round(x1 / w, 6) AS rx, round(y2 / h, 6) AS ry FROM s")
def p9(spark, sf):
    s = t.detections(spark, sf).withColumns({"w": (F.col("det_id") % 700 + 50).cast("double"), "h": (F.col("det_id") % 431 + 50).cast("double")})
    nw, nh = g.longest_side(F.col("w"), F.col("h"), 1024)
    return s.select("det_id", nw.alias("nw"), nh.alias("nh"), r6(F.col("x1") / F.col("w"), "rx"), r6(F.col("y2") / F.col("h"), "ry"))


@query("p11_flip_and_scale", f"{W} SELECT det_id, 400 - x2 AS hx1, 400 - x1 AS hx2, 300 - y2 AS vy1, 300 - y1 AS vy2, (x1 + x2) / 2 - (x2 - x1) * 1.5 / 2 AS cx1, (y1 + y2) / 2 + (y2 - y1) * 1.5 / 2 AS cy2, x1 + 7 AS mx1 FROM dets")
def p11(spark, sf):
    b = g.box()
    both, big = g.flipped(b, 400, 300, "diagonal"), g.about_center(b, 1.5)
    return t.detections(spark, sf).select("det_id", both["x1"].alias("hx1"), both["x2"].alias("hx2"), both["y1"].alias("vy1"), both["y2"].alias("vy2"), big["x1"].alias("cx1"), big["y2"].alias("cy2"), g.moved(b, 7, 0)["x1"].alias("mx1"))


@query("p12_point_distances", f"{W} SELECT det_id, greatest(0, least(100 - x1, 64)) AS l, greatest(0, least(80 - y1, 64)) AS t, greatest(0, least(x2 - 100, 64)) AS r, greatest(0, least(y2 - 80, 64)) AS b FROM dets")
def p12(spark, sf):
    return t.detections(spark, sf).select("det_id", *(c.alias(n) for c, n in zip(g.to_distances(g.box(), F.lit(100.0), F.lit(80.0), 64.0), "ltrb", strict=True)))


@query("p13_boxes_by_image_and_label", f"{W} SELECT image_id, string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY det_id) AS ids, count(*) AS n FROM dets GROUP BY image_id, label")
def p13(spark, sf):
    return t.detections(spark, sf).groupBy("image_id", "label").agg(F.array_join(F.transform(F.sort_array(F.collect_list("det_id")), lambda x: x.cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n")).drop("label")


@query("p18_crop_grid", "SELECT CAST(layer AS BIGINT) AS layer, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(floor(1000 / pow(2, layer)) AS BIGINT) AS side FROM (SELECT unnest(range(0, 4)) AS layer) a, LATERAL (SELECT unnest(range(0, CAST(pow(2, layer) AS BIGINT))) AS i) b, LATERAL (SELECT unnest(range(0, CAST(pow(2, layer) AS BIGINT))) AS j) c")
def p18(spark, sf):
    layers = spark.range(4).select(F.col("id").alias("layer"), F.pow(F.lit(2.0), "id").cast("long").alias("n"))
    return layers.select("layer", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("layer", "i", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j")).select("layer", "i", "j", F.floor(1000 / F.col("n")).alias("side"))


@query("a1_suppression", f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rk FROM dets WHERE score >= 0.1),
{fold_sql('r', 'image_id', iou_sql('k', 'e', 0, '1e-5') + ' > 0.9')} SELECT r.image_id, r.det_id, round(r.score, 6) AS score FROM r JOIN kept USING (image_id, rk)""")
def a1(spark, sf):
    return d.suppress(t.detections(spark, sf)).select("image_id", "det_id", r6(F.col("score"), "score"))


@query("a1_suppression_in_rounds", f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rk FROM dets),
{fold_sql('r', 'image_id', iou_sql('k', 'e', 0, '1e-5') + ' > 0.6')} SELECT r.image_id, r.det_id FROM r JOIN kept USING (image_id, rk)""")
def a1_rounds(spark, sf):
    return d.suppress_in_rounds(t.detections(spark, sf).select("image_id", "det_id", "score", *g.FIELDS), 0.6).select("image_id", "det_id")


@query("a2_suppression_by_label", f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y2 DESC, det_id) AS rk FROM dets),
{fold_sql('r', 'image_id', f"k.label = e.label AND (greatest(least(k.x2, e.x2) - greatest(k.x1, e.x1) + 1, 0) * greatest(least(k.y2, e.y2) - greatest(k.y1, e.y1) + 1, 0)) / {area_sql('e', 1)} > 0.9")}
SELECT r.image_id, r.det_id, r.label FROM r JOIN kept USING (image_id, rk)""")
def a2(spark, sf):
    return d.suppress_same_label(t.detections(spark, sf)).select("image_id", "det_id", "label")


@query("a33_fast_suppression", f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id) AS rk FROM dets)
SELECT e.image_id, e.det_id FROM r e LEFT JOIN r k ON k.image_id = e.image_id AND k.label = e.label AND k.rk < e.rk GROUP BY e.image_id, e.det_id HAVING coalesce(max({iou_sql('k', 'e', 0, '1e-6')}) FILTER (WHERE k.rk IS NOT NULL), 0) <= 0.7""")
def a33(spark, sf):
    return d.parallel_suppress(t.detections(spark, sf), 0.7).select("image_id", "det_id")


@query("a33_matrix_suppression", f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id) AS rk FROM dets),
p AS (SELECT e.image_id, e.label, k.rk AS i, e.rk AS j, {iou_sql('k', 'e', 0, '1e-6')} AS o FROM r k JOIN r e ON k.image_id = e.image_id AND k.label = e.label AND k.rk < e.rk),
mo AS (SELECT image_id, label, j, max(o) AS most FROM p GROUP BY ALL), f AS (SELECT p.image_id, p.label, p.j, min(exp(-2 * (o * o - coalesce(most, 0) * coalesce(most, 0)))) AS f FROM p LEFT JOIN mo ON mo.image_id = p.image_id AND mo.label = p.label AND mo.j = p.i GROUP BY ALL)
SELECT r.image_id, r.det_id, round(r.score * coalesce(f.f, 1), 6) AS score FROM r LEFT JOIN f ON f.image_id = r.image_id AND f.label = r.label AND f.j = r.rk""")
def a33m(spark, sf):
    return d.parallel_suppress(t.detections(spark, sf), decay="gaussian").select("image_id", "det_id", r6(F.col("score"), "score"))


SEEDS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY model_id, det_id) AS rk FROM dets),
{fold_sql('r', 'image_id', 'k.model_id < e.model_id AND ' + iou_sql('k', 'e', 1) + ' >= 0.65')},
seeds AS (SELECT r.* FROM r JOIN kept USING (image_id, rk)),
owned AS (SELECT e.image_id, e.det_id, min_by(k.det_id, k.rk) AS seed_id FROM r e JOIN seeds k ON k.image_id = e.image_id AND (k.rk = e.rk OR (k.rk < e.rk AND k.model_id < e.model_id AND {iou_sql('k', 'e', 1)} >= 0.65)) GROUP BY ALL)"""


@query("j4_group_across_models", f"{W}, {SEEDS} SELECT image_id, det_id, seed_id FROM owned")
def j4(spark, sf):
    return d.group_across_models(t.detections(spark, sf))


@query("a3_label_sets", f"{W}, {SEEDS} SELECT o.image_id, o.seed_id, string_agg(DISTINCT dets.label, ',' ORDER BY dets.label) FILTER (WHERE dets.model_id < 6) AS labels, count(*) FILTER (WHERE dets.model_id = 6) AS n_attributes FROM owned o JOIN dets USING (image_id, det_id) GROUP BY ALL")
def a3(spark, sf):
    dets = t.detections(spark, sf)
    all_of = d.group_across_models(dets).join(dets.select("image_id", "det_id", "label", "model_id"), ["image_id", "det_id"])
    return all_of.groupBy("image_id", "seed_id").agg(F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(F.col("model_id") < 6, F.col("label")))), ","), F.lit("")).alias("labels"), F.count_if(F.col("model_id") == 6).alias("n_attributes"))


@query("w1_object_ids", f"{W} SELECT image_id, det_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN score >= 0.5 THEN 0 ELSE 1 END, det_id) - 1 AS BIGINT) AS id FROM dets")
def w1(spark, sf):
    return d.numbered(t.detections(spark, sf).withColumn("bucket", F.when(F.col("score") >= 0.5, "object").otherwise("floating"))).select("image_id", "det_id", "id")


@query("w2_renumber", f"{W}, b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN score >= 0.5 THEN 0 ELSE 1 END, det_id) - 1 AS old_id, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN score >= 0.5 THEN 0 WHEN label = 'R' THEN 1 ELSE 2 END, det_id) - 1 AS new_id FROM dets) SELECT image_id, CAST(old_id AS BIGINT) AS old_id, CAST(new_id AS BIGINT) AS new_id FROM b WHERE old_id <> new_id")
def w2(spark, sf):
    order = F.when(F.col("score") >= 0.5, 0).when(F.col("label") == "R", 1).otherwise(2)
    rows = d.numbered(t.detections(spark, sf).withColumn("bucket", F.when(F.col("score") >= 0.5, "object").otherwise("floating"))).withColumnRenamed("id", "old_id")
    return rows.withColumn("new_id", (F.row_number().over(Window.partitionBy("image_id").orderBy(order, "det_id")) - 1).cast("long")).filter("old_id <> new_id").select("image_id", "old_id", "new_id")


@query("a6_g15_depth_bands", f"{W}, {t.DEPTHS}, n AS (SELECT *, CASE WHEN max(depth) OVER w = min(depth) OVER w THEN 0.5 ELSE 1 - (depth - min(depth) OVER w) / (max(depth) OVER w - min(depth) OVER w) END AS nd FROM deps WINDOW w AS (PARTITION BY image_id)) SELECT image_id, CASE WHEN nd < 0.1 THEN 'Immediate Foreground' WHEN nd < 0.6 THEN 'Foreground' WHEN nd < 0.85 THEN 'Midground' ELSE 'Background' END AS band, count(*) AS n, round(sum(nd), 6) AS total FROM n GROUP BY 1, 2")
def a6(spark, sf):
    return d.depth_bands(t.depths(spark, sf)).groupBy("image_id", "band").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("nd"), "total"))


@query("a7_median_depth", f"{W}, {t.DEPTHS} SELECT image_id, round(median(depth), 3) AS depth FROM deps WHERE depth <> 0 GROUP BY image_id")
def a7(spark, sf):
    return t.depths(spark, sf).filter("depth <> 0").groupBy("image_id").agg(F.round(F.median("depth"), 3).alias("depth"))


@query("a8_a9_promoted", f"""{W}, o AS (SELECT * FROM dets WHERE model_id < 3), f AS (SELECT * FROM dets WHERE model_id >= 3), big AS (SELECT image_id, max((x2 - x1) * (y2 - y1)) AS biggest FROM o GROUP BY 1),
l AS (SELECT f.* FROM f LEFT JOIN big USING (image_id) WHERE (f.x2 - f.x1) * (f.y2 - f.y1) > 7000 / 2.0 AND (f.x2 - f.x1) * (f.y2 - f.y1) > coalesce(biggest, 0)),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id) = 1), h AS (SELECT image_id, label, max(score) AS have FROM o GROUP BY ALL)
SELECT b.image_id, b.label, b.det_id, round(b.score, 6) AS score FROM b LEFT JOIN h USING (image_id, label) WHERE have IS NULL OR b.score > have""")
def a9(spark, sf):
    dets = t.detections(spark, sf)
    return d.promoted(dets.filter("model_id >= 3"), dets.filter("model_id < 3"), F.lit(7000.0)).select("image_id", "label", "det_id", r6(F.col("score"), "score"))


@query("w9_proximity_groups", f"""{W}, q AS (SELECT *, CAST(model_id % 3 AS BIGINT) AS band FROM dets), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, band ORDER BY det_id) AS rk FROM q),
{fold_sql('r', 'image_id, band', 'sqrt(pow((k.x1 + k.x2) / 2 - (e.x1 + e.x2) / 2, 2) + pow((k.y1 + k.y2) / 2 - (e.y1 + e.y2) / 2, 2)) < 60')},
seeds AS (SELECT r.* FROM r JOIN kept USING (image_id, band, rk)),
owned AS (SELECT e.image_id, e.band, e.det_id, min_by(k.det_id, k.rk) AS seed FROM r e JOIN seeds k ON k.image_id = e.image_id AND k.band = e.band AND (k.rk = e.rk OR (k.rk < e.rk AND sqrt(pow((k.x1 + k.x2) / 2 - (e.x1 + e.x2) / 2, 2) + pow((k.y1 + k.y2) / 2 - (e.y1 + e.y2) / 2, 2)) < 60)) GROUP BY ALL)
SELECT image_id, det_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY band, seed) - 1 AS BIGINT) AS group_id FROM owned""")
def w9(spark, sf):
    return d.nearby_groups(t.detections(spark, sf).withColumn("band", F.col("model_id") % 3), "band", 60.0)


@query("j5_pair_overlaps", f"{W} SELECT a.image_id, count(*) AS n, round(sum({iou_sql('a', 'b', 1)}), 4) AS total, count(*) FILTER (WHERE {iou_sql('a', 'b', 1)} >= 0.65) AS high FROM dets a JOIN dets b ON a.image_id = b.image_id AND a.det_id < b.det_id GROUP BY 1")
def j5(spark, sf):
    dets = t.detections(spark, sf)
    pairs = m.pairs_of(dets, dets.withColumnRenamed("det_id", "other"), "det_id", "other", 1).filter("det_id < other")
    return pairs.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("overlap"), 4).alias("total"), F.count_if(F.col("overlap") >= 0.65).alias("high"))


@query("j6_first_match", f"{W}, {t.TRUTHS} SELECT p.image_id, p.det_id, min(g.gt_id) AS match FROM preds p LEFT JOIN gts g ON g.image_id = p.image_id AND {iou_sql('p', 'g', 1)} > 0.75 GROUP BY ALL")
def j6(spark, sf):
    return m.first_match(t.predictions(spark, sf), t.truths(spark, sf), "det_id", "gt_id", 0.75).select("image_id", "det_id", "match")


@query("j7_unmatched", f"{W}, {t.TRUTHS} SELECT p.image_id, p.det_id, CAST(row_number() OVER (PARTITION BY p.image_id ORDER BY p.det_id) AS BIGINT) AS new_id FROM preds p WHERE NOT EXISTS (SELECT 1 FROM gts g WHERE g.image_id = p.image_id AND {iou_sql('p', 'g', 1)} > 0.75)")
def j7(spark, sf):
    none = m.first_match(t.predictions(spark, sf), t.truths(spark, sf), "det_id", "gt_id", 0.75).filter("match is null")
    return none.select("image_id", "det_id", F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")).cast("long").alias("new_id"))


NEAREST = f"near AS (SELECT p.image_id, p.det_id, g.gt_id, {iou_sql('p', 'g', 1)} AS o FROM preds p JOIN gts g ON g.image_id = p.image_id QUALIFY row_number() OVER (PARTITION BY p.image_id, p.det_id ORDER BY o DESC, g.gt_id) = 1)"


@query("j8_nearest_mask", f"{W}, {t.TRUTHS}, {NEAREST} SELECT image_id, det_id, gt_id, round(o, 6) AS overlap, round(2 * o / (1 + o), 6) AS dice FROM near WHERE o >= 0.65")
def j8(spark, sf):
    got = m.nearest(t.predictions(spark, sf), t.truths(spark, sf), "det_id", "gt_id")
    return got.select("image_id", "det_id", "gt_id", r6(F.col("overlap"), "overlap"), r6(2 * F.col("overlap") / (1 + F.col("overlap")), "dice"))


@query("j9_mask_fallback", f"{W}, {t.TRUTHS}, {NEAREST} SELECT p.det_id, CASE WHEN o >= 0.65 THEN 'first' WHEN p.model_id = 3 THEN 'second' WHEN p.label = 'N' THEN 'third' END AS source FROM preds p LEFT JOIN near USING (image_id, det_id)")
def j9(spark, sf):
    p = t.predictions(spark, sf)
    keys = ["image_id", "det_id"]
    sources = [("first", m.nearest(p, t.truths(spark, sf), "det_id", "gt_id").select(*keys, F.col("gt_id").alias("mask"))), ("second", p.filter("model_id = 3").select(*keys, F.lit(0).cast("long").alias("mask"))), ("third", p.filter("label = 'N'").select(*keys, F.lit(0).cast("long").alias("mask")))]
    return m.with_fallback(p, keys, sources, "mask").select("det_id", "source")


PAIRS = f"p AS (SELECT p.image_id, p.det_id, g.gt_id, {iou_sql('p', 'g', 0, '1e-6')} AS o FROM preds p JOIN gts g ON g.image_id = p.image_id), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY o DESC, det_id, gt_id) AS rk FROM p WHERE o > 0)"


@query("j23_one_to_one", f"{W}, {t.TRUTHS}, {PAIRS}, {fold_sql('r', 'image_id', '(k.det_id = e.det_id OR k.gt_id = e.gt_id)')} SELECT r.image_id, r.det_id, r.gt_id, round(r.o, 6) AS overlap FROM r JOIN kept USING (image_id, rk)")
def j23(spark, sf):
    return j23_matches(spark, sf).withColumn("overlap", F.round("overlap", 6))


@query("a11_mean_miou", f"{W}, {t.TRUTHS}, {PAIRS}, {fold_sql('r', 'image_id', '(k.det_id = e.det_id OR k.gt_id = e.gt_id)')} SELECT round(avg(x), 6) AS miou, count(*) AS n FROM (SELECT image_id, avg(o) AS x FROM r JOIN kept USING (image_id, rk) GROUP BY 1)")
def a11(spark, sf):
    return j23_matches(spark, sf).groupBy("image_id").agg(F.avg("overlap").alias("x")).agg(r6(F.avg("x"), "miou"), F.count(F.lit(1)).alias("n"))


def j23_matches(spark, sf):
    return m.one_to_one(m.pairs_of(t.predictions(spark, sf), t.truths(spark, sf), "det_id", "gt_id", 0, 1e-6), "det_id", "gt_id")


SIM = "1 - abs(r.det_id - r.gt_id) % 7 / 10.0"


@query("j24_gated_matching", f"{W}, {t.TRUTHS}, {PAIRS}, {fold_sql('r', 'image_id', '(k.det_id = e.det_id OR k.gt_id = e.gt_id)')}, x AS (SELECT r.*, {SIM} AS sim FROM r JOIN kept USING (image_id, rk)), y AS (SELECT *, sum(CASE WHEN o >= 0.5 AND sim >= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY o DESC, det_id ROWS UNBOUNDED PRECEDING) AS bad FROM x) SELECT image_id, det_id, gt_id FROM y WHERE bad = 0")
def j24(spark, sf):
    got = j23_matches(spark, sf).withColumn("sim", 1 - F.abs(F.col("det_id") - F.col("gt_id")) % 7 / 10.0)
    return m.gated(got, "sim", tie="det_id").select("image_id", "det_id", "gt_id")


@query("a12_grounding_recall", f"{W}, {t.TRUTHS}, {PAIRS}, {fold_sql('r', 'image_id', '(k.det_id = e.det_id OR k.gt_id = e.gt_id)')}, h AS (SELECT count(*) AS hits FROM r JOIN kept USING (image_id, rk) WHERE o >= 0.5), n AS (SELECT count(*) AS n FROM gts) SELECT hits, n, round(hits / n, 6) AS recall FROM h, n")
def a12(spark, sf):
    hits = j23_matches(spark, sf).filter("overlap >= 0.5").agg(F.count(F.lit(1)).alias("hits"))
    n = t.truths(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return hits.join(F.broadcast(n)).withColumn("recall", F.round(F.col("hits") / F.col("n"), 6))


TP = f"""bo AS (SELECT p.image_id, p.det_id, p.label, p.score, g.gt_id, {iou_sql('p', 'g', 0, '1e-6')} AS o FROM preds p JOIN gts g ON g.image_id = p.image_id AND g.label = p.label QUALIFY row_number() OVER (PARTITION BY p.image_id, p.label, p.det_id ORDER BY o DESC, g.gt_id) = 1),
tpx AS (SELECT p.image_id, p.label, p.det_id, p.score, p.x1, p.y1, p.x2, p.y2, CASE WHEN o >= 0.5 AND row_number() OVER (PARTITION BY p.image_id, p.label, coalesce(o >= 0.5, false), bo.gt_id ORDER BY p.score DESC, p.det_id) = 1 THEN 1 ELSE 0 END AS tp FROM preds p LEFT JOIN bo USING (image_id, label, det_id)),
cu AS (SELECT *, 1 - tp AS fp, sum(tp) OVER w AS ctp, sum(1 - tp) OVER w AS cfp FROM tpx WINDOW w AS (PARTITION BY label ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT cu.*, n_gt, ctp / n_gt AS recall, ctp / (ctp + cfp) AS precision FROM cu JOIN (SELECT label, count(*) AS n_gt FROM gts GROUP BY 1) USING (label))"""
AP = f"{TP}, en AS (SELECT *, max(precision) OVER (PARTITION BY label ORDER BY score DESC, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, recall - coalesce(lag(recall) OVER (PARTITION BY label ORDER BY score DESC, det_id), 0) AS step FROM pr)"


def hits(spark, sf):
    return m.true_positives(t.predictions(spark, sf), t.truths(spark, sf), 0.5, ("image_id", "label"))


def totals(spark, sf):
    return t.truths(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n_gt"))


def ap_over_limits(spark, sf):
    """label, limit, ap: the 101-point precision at ten overlap limits."""
    limits = [k / 100 for k in range(50, 100, 5)]
    claims = m.claimed_limits(t.predictions(spark, sf), t.truths(spark, sf), limits, ("image_id", "label"))
    return mt.interpolated_precision(mt.hits_over_limits(claims, totals(spark, sf), ["label"], limits), ["label", "limit"], 101)


@query("j27_true_positives", f"{W}, {t.TRUTHS}, {TP} SELECT label, count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp FROM tpx GROUP BY 1")
def j27(spark, sf):
    return hits(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"))


@query("w3_w4_curve", f"{W}, {t.TRUTHS}, {AP} SELECT label, det_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(env, 6) AS env FROM en")
def w3(spark, sf):
    pts = mt.curve(hits(spark, sf), totals(spark, sf), ["label"])
    return mt.envelope(pts, ["label"]).select("label", "det_id", r6(F.col("recall"), "recall"), r6(F.col("precision"), "precision"), r6(F.col("env"), "env"))


@query("a16_average_precision", f"{W}, {t.TRUTHS}, {AP} SELECT label, round(sum(env * step), 6) AS ap FROM en GROUP BY 1")
def a16(spark, sf):
    return mt.average_precision(mt.curve(hits(spark, sf), totals(spark, sf), ["label"]), ["label"]).withColumn("ap", F.round("ap", 6))


@query("a16_eleven_points", f"{W}, {t.TRUTHS}, {TP}, lv AS (SELECT unnest(range(0, 11)) / 10.0 AS level), b AS (SELECT label, level, max(precision) FILTER (WHERE recall >= level) AS p FROM pr, lv GROUP BY ALL) SELECT label, round(sum(coalesce(p, 0)) / 11, 6) AS ap FROM b GROUP BY 1")
def a16b(spark, sf):
    return mt.interpolated_precision(mt.curve(hits(spark, sf), totals(spark, sf), ["label"]), ["label"]).withColumn("ap", F.round("ap", 6))


@query("a17_mean_ap", f"{W}, {t.TRUTHS}, {AP} SELECT round(avg(ap), 6) AS map, count(*) AS n FROM (SELECT label, sum(env * step) AS ap FROM en GROUP BY 1)")
def a17(spark, sf):
    return mt.average_precision(mt.curve(hits(spark, sf), totals(spark, sf), ["label"]), ["label"]).agg(r6(F.avg("ap"), "map"), F.count(F.lit(1)).alias("n"))


@query("a18_by_scale", f"{W}, {t.TRUTHS}, {TP}, bk(bucket, lo, hi) AS (VALUES ('all', 0.0, 1e10), ('small', 0.0, 4500.0), ('large', 4500.0, 1e10)) SELECT bucket, label, count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp FROM tpx JOIN bk ON (x2 - x1) * (y2 - y1) >= lo AND (x2 - x1) * (y2 - y1) < hi GROUP BY ALL")
def a18(spark, sf):
    return mt.area_buckets(hits(spark, sf), g.area(g.box()), [("all", 0.0, 1e10), ("small", 0.0, 4500.0), ("large", 4500.0, 1e10)]).groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"))


@query("a19_a20_recall", f"{W}, {t.TRUTHS}, {PAIRS}, {fold_sql('r', 'image_id', '(k.det_id = e.det_id OR k.gt_id = e.gt_id)')}, x AS (SELECT r.o FROM r JOIN kept USING (image_id, rk)), n AS (SELECT count(*) AS n FROM gts), th AS (SELECT unnest(range(0, 10)) * 5 AS k) SELECT CAST(k + 50 AS BIGINT) AS threshold, round(count(*) FILTER (WHERE o >= (k + 50) / 100.0) / max(n), 6) AS recall FROM x, th, n GROUP BY k")
def a19(spark, sf):
    at = F.explode(F.sequence(F.lit(50), F.lit(95), F.lit(5))).alias("threshold")
    n = t.truths(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    x = j23_matches(spark, sf).select("overlap", at).join(F.broadcast(n))
    return x.groupBy(F.col("threshold").cast("long").alias("threshold")).agg(r6(F.count_if(F.col("overlap") >= F.col("threshold") / 100.0) / F.max("n"), "recall"))


@query("a13_meter", f"{W} SELECT model_id, round(sum(score * (x2 - x1)), 4) AS total, round(sum(x2 - x1), 4) AS count, round(sum(score * (x2 - x1)) / (sum(x2 - x1) + 1e-5), 6) AS avg FROM dets GROUP BY 1")
def a13(spark, sf):
    got = mt.meter(t.detections(spark, sf).withColumn("w", F.col("x2") - F.col("x1")), ["model_id"], "score", "w")
    return got.select("model_id", F.round("total", 4).alias("total"), F.round("count", 4).alias("count"), r6(F.col("avg"), "avg"))


@query("a14_a15_class_overlap", f"{W}, px AS (SELECT image_id, model_id AS pred, CAST((det_id // 1000) % 7 AS BIGINT) AS target, CAST((x2 - x1) AS BIGINT) AS n FROM dets), c AS (SELECT unnest(range(0, 7)) AS cls), o AS (SELECT cls, sum(n) FILTER (WHERE pred = cls AND target = cls) AS inter, sum(n) FILTER (WHERE pred = cls) AS np, sum(n) FILTER (WHERE target = cls) AS nt FROM px, c WHERE target <> 3 GROUP BY 1) SELECT CAST(cls AS BIGINT) AS cls, CAST(coalesce(inter, 0) AS BIGINT) AS inter, CAST(coalesce(np, 0) + coalesce(nt, 0) - coalesce(inter, 0) AS BIGINT) AS \"union\" FROM o")
def a14(spark, sf):
    px = t.detections(spark, sf).select("image_id", F.col("model_id").alias("pred"), (F.floor(F.col("det_id") / 1000) % 7).alias("target"), (F.col("x2") - F.col("x1")).cast("long").alias("n"))
    return mt.class_overlap(px, "pred", "target", [], 3).select("cls", "inter", "union")


@query("a15_giou_ciou", f"{W}, {t.TRUTHS}, mk AS (SELECT p.label, greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS i, {area_sql('p')} + {area_sql('g')} - greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS u FROM preds p JOIN gts g ON p.image_id = g.image_id) SELECT label, round(avg(CASE WHEN u = 0 THEN 1 ELSE i / (u + 1e-5) END), 6) AS giou, round(sum(i) / (sum(u) + 1e-10), 6) AS ciou FROM mk GROUP BY 1")
def a15(spark, sf):
    gt = t.truths(spark, sf).select("image_id", *g.columns(g.box(), "_g"))
    pairs = t.predictions(spark, sf).join(gt, "image_id")
    masks = pairs.select("label", g.intersection(g.box(), g.box("", "_g")).alias("inter"), g.union(g.box(), g.box("", "_g")).alias("union"))
    return mt.mask_scores(masks, ["label"]).select("label", r6(F.col("giou"), "giou"), r6(F.col("ciou"), "ciou"))


@query("a25_panoptic_quality", f"""{W}, {t.TRUTHS}, hit AS (SELECT g.label AS cat, {iou_sql('g', 'p')} AS o FROM gts g JOIN preds p ON g.image_id = p.image_id AND g.label = p.label WHERE {iou_sql('g', 'p')} > 0.5),
c AS (SELECT label AS cat, label = 'A' AS isthing, count(*) AS n_gt FROM gts GROUP BY ALL), n AS (SELECT label AS cat, count(*) AS n_pred FROM preds GROUP BY 1), h AS (SELECT cat, count(*) AS tp, sum(o) AS s FROM hit GROUP BY 1),
e AS (SELECT isthing, coalesce(tp, 0) AS tp, coalesce(s, 0) AS s, n_gt - coalesce(tp, 0) AS fn, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp FROM c LEFT JOIN n USING (cat) LEFT JOIN h USING (cat))
SELECT CASE WHEN grouping(isthing) = 1 THEN 'all' WHEN isthing THEN 'things' ELSE 'stuff' END AS part, round(avg(s / (tp + 0.5 * fp + 0.5 * fn)), 6) AS pq, round(avg(CASE WHEN tp > 0 THEN s / tp ELSE 0 END), 6) AS sq, round(avg(tp / (tp + 0.5 * fp + 0.5 * fn)), 6) AS rq, count(*) AS n FROM e GROUP BY ROLLUP (isthing)""")
def a25(spark, sf):
    gt, pr = t.truths(spark, sf), t.predictions(spark, sf)
    p2 = pr.select("image_id", F.col("det_id").alias("pred_id"), F.col("label").alias("pred_cat"), *g.columns(g.box(), "_p"))
    pairs = gt.join(p2, "image_id").filter(F.col("label") == F.col("pred_cat")).select("gt_id", "pred_id", F.col("label").alias("gt_cat"), "pred_cat", g.intersection(g.box(), g.box("", "_p")).alias("inter"), g.union(g.box(), g.box("", "_p")).alias("union"))
    got = mt.panoptic_quality(pairs, gt.select(F.col("label").alias("cat"), (F.col("label") == "A").alias("isthing")), pr.select(F.col("label").alias("cat")))
    part = F.when(F.col("isthing").isNull(), "all").when(F.col("isthing"), "things").otherwise("stuff")
    return got.select(part.alias("part"), r6(F.col("pq"), "pq"), r6(F.col("sq"), "sq"), r6(F.col("rq"), "rq"), "n")


@query("a28_class_counts", f"{W} SELECT label, count(*) AS n, count(DISTINCT image_id) AS images FROM dets GROUP BY 1")
def a28(spark, sf):
    return t.detections(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("images"))


RF = "pairs AS (SELECT DISTINCT image_id, model_id * 10 + length(label) AS label FROM dets WHERE score > 0.8), n AS (SELECT count(DISTINCT image_id) AS n FROM pairs), rf AS (SELECT label, greatest(1.0, sqrt(0.7 / (count(*) / max(n)))) AS r FROM pairs, n GROUP BY 1), im AS (SELECT image_id, max(r) AS factor FROM pairs JOIN rf USING (label) GROUP BY 1)"


@query("a29_repeat_factors", f"{W}, {RF} SELECT image_id, round(factor, 6) AS factor FROM im")
def a29(spark, sf):
    return repeat_factors(spark, sf).select("image_id", r6(F.col("factor"), "factor"))


def repeat_factors(spark, sf):
    rows = t.detections(spark, sf).filter("score > 0.8").select("image_id", (F.col("model_id") * 10 + F.length("label")).alias("label"))
    return mixing.repeat_factors(rows, 0.7)


@query("u4_class_balanced_copies", f"{W}, {RF} SELECT image_id, CAST(unnest(range(1, CAST(ceil(factor) AS BIGINT) + 1)) AS BIGINT) AS copy FROM im")
def u4(spark, sf):
    return mixing.replicated(repeat_factors(spark, sf)).select("image_id", F.col("copy").cast("long").alias("copy"))


@query("g5_g6_overlap_kinds", f"{W}, {t.TRUTHS}, q AS (SELECT p.det_id, g.gt_id, {iou_sql('p', 'g', 0, '1e-6')} AS iou, greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) / greatest({area_sql('p')}, 1e-6) AS iof, (greatest(p.x2, g.x2) - least(p.x1, g.x1)) * (greatest(p.y2, g.y2) - least(p.y1, g.y1)) AS h, {area_sql('p')} + {area_sql('g')} - greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS u FROM preds p JOIN gts g ON p.image_id = g.image_id) SELECT det_id, gt_id, round(iou, 6) AS iou, round(iof, 6) AS iof, round(iou - (h - u) / h, 7) AS giou FROM q")
def g5(spark, sf):
    gt = t.truths(spark, sf).select("image_id", "gt_id", *g.columns(g.box(), "_g"))
    a, b = g.box(), g.box("", "_g")
    return t.predictions(spark, sf).join(gt, "image_id").select("det_id", "gt_id", r6(g.iou(a, b, 0, 1e-6), "iou"), r6(g.iof(a, b, 0, 1e-6), "iof"), F.round(g.giou(a, b), 7).alias("giou"))


@query("g7_deltas", f"{W} SELECT det_id, round(((x1 + x2) / 2 - 130) / 100, 6) AS dx, round(((y1 + y2) / 2 - 100) / 80, 6) AS dy, round(ln((x2 - x1) / 100), 6) AS dw, round(ln((y2 - y1) / 80), 6) AS dh, round(x1, 4) AS x1, round(y2, 4) AS y2 FROM dets")
def g7(spark, sf):
    anchor = g.of(*(F.lit(float(v)) for v in (80, 60, 180, 140)))
    enc = g.encode_deltas(anchor, g.box())
    back = g.decode_deltas(anchor, enc)
    return t.detections(spark, sf).select("det_id", *(r6(c, n) for c, n in zip(enc, ("dx", "dy", "dw", "dh"), strict=True)), F.round(back["x1"], 4).alias("x1"), F.round(back["y2"], 4).alias("y2"))


@query("g8_side_coder", f"{W} SELECT det_id, round((100 - y1) / 320, 6) AS t, round((y2 - 100) / 320, 6) AS b, round((130 - x1) / 400, 6) AS l, round((x2 - 130) / 400, 6) AS r FROM dets")
def g8(spark, sf):
    anchor = g.of(*(F.lit(float(v)) for v in (80, 60, 180, 140)))
    return t.detections(spark, sf).select("det_id", *(r6(c, n) for c, n in zip(g.encode_sides(anchor, g.box()), "tblr", strict=True)))


@query("g9_g10_costs", f"{W}, q AS (SELECT *, {iou_sql('dets', 'a', 0, '1e-6')} AS o FROM dets, (SELECT 80.0 AS x1, 60.0 AS y1, 180.0 AS x2, 140.0 AS y2) a) SELECT det_id, round(-ln(greatest(o, 1e-6)), 6) AS log_loss, round(1 - greatest(o, 1e-6) * greatest(o, 1e-6), 6) AS square_loss, round(abs(score - 0.5), 6) AS l1, round(CASE WHEN abs(score - 0.5) < 0.3 THEN 0.5 * (score - 0.5) * (score - 0.5) / 0.3 ELSE abs(score - 0.5) - 0.15 END, 6) AS smooth FROM q")
def g9(spark, sf):
    a = g.of(*(F.lit(float(v)) for v in (80, 60, 180, 140)))
    s, h = F.col("score"), F.lit(0.5)
    return t.detections(spark, sf).select("det_id", r6(losses.iou_loss(g.box(), a), "log_loss"), r6(losses.iou_loss(g.box(), a, "square"), "square_loss"), r6(losses.l1(s, h), "l1"), r6(losses.smooth_l1(s, h, 0.3), "smooth"))


@query("g11_class_losses", f"{W}, q AS (SELECT det_id, 0.05 + score * 0.9 AS p, CASE WHEN label = 'A' THEN 1 ELSE 0 END AS t FROM dets) SELECT det_id, round(-(t * ln(p) + (1 - t) * ln(1 - p)), 6) AS bce, round(-(t * ln(p) + (1 - t) * ln(1 - p)) * (0.25 * t + 0.75 * (1 - t)) * pow((1 - p) * t + p * (1 - t), 2), 6) AS focal, round((p - t) * (p - t), 6) AS mse FROM q")
def g11(spark, sf):
    p, y = 0.05 + F.col("score") * 0.9, F.when(F.col("label") == "A", 1).otherwise(0)
    return t.detections(spark, sf).select("det_id", r6(losses.cross_entropy(p, y), "bce"), r6(losses.focal(p, y), "focal"), r6(losses.mse(p, y), "mse"))


MAXIOU = f"q AS (SELECT p.image_id, p.det_id, g.gt_id, {iou_sql('p', 'g', 0, '1e-6')} AS o FROM preds p JOIN gts g ON p.image_id = g.image_id), b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY o DESC, gt_id) = 1), f AS (SELECT image_id, det_id, max(gt_id) AS forced FROM (SELECT *, max(o) OVER (PARTITION BY image_id, gt_id) AS top FROM q) WHERE o = top AND o >= 0.3 GROUP BY ALL), asg AS (SELECT p.*, CASE WHEN forced IS NOT NULL THEN forced + 1 WHEN b.o >= 0.5 THEN b.gt_id + 1 WHEN coalesce(b.o, 0) < 0.4 THEN 0 ELSE -1 END AS gt, b.o AS o FROM preds p LEFT JOIN b USING (image_id, det_id) LEFT JOIN f USING (image_id, det_id))"


def priors(spark, sf, *more):
    """Predictions with no more columns than an assigner needs, as it carries all that it is given."""
    return t.predictions(spark, sf).select("image_id", "det_id", *g.FIELDS, *more)


@query("m1_assign_by_overlap", f"{W}, {t.TRUTHS}, {MAXIOU} SELECT image_id, det_id, CAST(gt AS BIGINT) AS gt FROM asg")
def m1(spark, sf):
    return assign.by_overlap(priors(spark, sf), t.truths(spark, sf)).select("image_id", "det_id", "gt")


@query("m3_adaptive_assign", f"""{W}, {t.TRUTHS}, q AS (SELECT p.image_id, p.det_id, p.model_id % 2 AS level, g.gt_id, {iou_sql('p', 'g', 0, '1e-6')} AS o, sqrt(pow((p.x1 + p.x2) / 2 - (g.x1 + g.x2) / 2, 2) + pow((p.y1 + p.y2) / 2 - (g.y1 + g.y2) / 2, 2)) AS far, ((p.x1 + p.x2) / 2 - g.x1 > 0.01 AND (p.y1 + p.y2) / 2 - g.y1 > 0.01 AND g.x2 - (p.x1 + p.x2) / 2 > 0.01 AND g.y2 - (p.y1 + p.y2) / 2 > 0.01) AS inside FROM preds p JOIN gts g ON p.image_id = g.image_id),
n AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY image_id, gt_id, level ORDER BY far, det_id) <= 3), l AS (SELECT *, avg(o) OVER (PARTITION BY image_id, gt_id) + coalesce(stddev_samp(o) OVER (PARTITION BY image_id, gt_id), 0) AS lim FROM n),
b AS (SELECT image_id, det_id, gt_id FROM l WHERE o >= lim - 1e-12 AND inside QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY o DESC, gt_id) = 1)
SELECT p.image_id, p.det_id, coalesce(gt_id + 1, 0) AS gt FROM preds p LEFT JOIN b USING (image_id, det_id)""")
def m3(spark, sf):
    return assign.adaptive(t.predictions(spark, sf).withColumn("level", F.col("model_id") % 2), t.truths(spark, sf), 3).select("image_id", "det_id", "gt")


@query("m6_task_aligned", f"""{W}, {t.TRUTHS}, q AS (SELECT p.image_id, p.det_id, g.gt_id, {iou_sql('p', 'g', 0, '1e-6')} AS o, p.score * pow({iou_sql('p', 'g', 0, '1e-6')}, 6.0) AS metric, ((p.x1 + p.x2) / 2 - g.x1 > 0.01 AND (p.y1 + p.y2) / 2 - g.y1 > 0.01 AND g.x2 - (p.x1 + p.x2) / 2 > 0.01 AND g.y2 - (p.y1 + p.y2) / 2 > 0.01) AS inside FROM preds p JOIN gts g ON p.image_id = g.image_id),
n AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY image_id, gt_id ORDER BY round(metric, 12) DESC, det_id) <= 4), b AS (SELECT * FROM n WHERE metric > 0 AND inside QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY o DESC, gt_id) = 1)
SELECT p.image_id, p.det_id, coalesce(gt_id + 1, 0) AS gt, round(coalesce(metric, 0), 6) AS metric FROM preds p LEFT JOIN b USING (image_id, det_id)""")
def m6(spark, sf):
    return assign.task_aligned(t.predictions(spark, sf), t.truths(spark, sf), 4).select("image_id", "det_id", "gt", r6(F.col("metric"), "metric"))


@query("m11_center_region", f"""{W}, {t.TRUTHS}, q AS (SELECT p.image_id, p.det_id, g.gt_id, (g.x2 - g.x1) * (g.y2 - g.y1) AS size, abs((p.x1 + p.x2) / 2 - (g.x1 + g.x2) / 2) / (g.x2 - g.x1) AS ax, abs((p.y1 + p.y2) / 2 - (g.y1 + g.y2) / 2) / (g.y2 - g.y1) AS ay FROM preds p JOIN gts g ON p.image_id = g.image_id),
b AS (SELECT * FROM q WHERE ax < 0.25 AND ay < 0.25 QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY CASE WHEN ax < 0.1 AND ay < 0.1 THEN 0 ELSE 1 END, size, gt_id) = 1)
SELECT p.image_id, p.det_id, CASE WHEN ax < 0.1 AND ay < 0.1 THEN gt_id + 1 WHEN gt_id IS NOT NULL THEN -1 ELSE 0 END AS gt FROM preds p LEFT JOIN b USING (image_id, det_id)""")
def m11(spark, sf):
    return assign.by_center(t.predictions(spark, sf), t.truths(spark, sf)).select("image_id", "det_id", "gt")


@query("m12_random_sample")
def m12(spark, sf):
    return assign.sample(assign.by_overlap(priors(spark, sf), t.truths(spark, sf)), 8, 0.25).groupBy("image_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("m15_hardest", f"{W}, {t.TRUTHS}, {MAXIOU}, h AS (SELECT image_id, det_id, CASE WHEN gt > 0 THEN 'pos' WHEN gt = 0 THEN 'neg' END AS role, score FROM asg WHERE gt >= 0) SELECT image_id, det_id, role FROM h QUALIFY row_number() OVER (PARTITION BY image_id, role ORDER BY score DESC, det_id) <= CASE role WHEN 'pos' THEN 2 ELSE 6 END")
def m15(spark, sf):
    return assign.hardest(assign.by_overlap(priors(spark, sf, "score"), t.truths(spark, sf)), 8, 0.25, "score").select("image_id", "det_id", "role")


@query("m4_least_cost_assignment")
def m4(spark, sf):
    got = assign.least_cost(t.predictions(spark, sf), t.truths(spark, sf), "det_id", "gt_id", lambda p, q: 1 - g.iou_arrays(p[:, :, None], q[:, None, :], 0, 1e-6))
    return got.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("cost"), "cost"))


@query("g22_anchors", "SELECT CAST(l AS BIGINT) AS level, CAST(k // w AS BIGINT) AS y, CAST(k % w AS BIGINT) AS x, (k % w) * s - side * s / 2 AS x1, (k // w) * s + side * s / 2 AS y2 FROM (VALUES (0, 8, 12, 8), (1, 4, 6, 16)) v(l, h, w, s), LATERAL (SELECT unnest(range(0, h * w)) AS k) c, (VALUES (4.0), (8.0)) z(side)")
def g22(spark, sf):
    return assign.grid_anchors([(8, 12, 8), (4, 6, 16)], [4.0, 8.0], spark).select(F.col("level").cast("long").alias("level"), "y", "x", "x1", "y2")


@query("t8_t11_top_scores", f"{W} SELECT image_id, det_id FROM dets WHERE score > 0.05 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) <= 5")
def t8(spark, sf):
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    return t.detections(spark, sf).filter("score > 0.05").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("image_id", "det_id")


@query("t2_object_choice", f"{W} SELECT image_id, det_id FROM dets QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN model_id = 6 THEN 0 ELSE 1 END, det_id) <= 10")
def t2(spark, sf):
    w = Window.partitionBy("image_id").orderBy(F.when(F.col("model_id") == 6, 0).otherwise(1), "det_id")
    return t.detections(spark, sf).withColumn("r", F.row_number().over(w)).filter("r <= 10").select("image_id", "det_id")


@query("s26_result_rows", f"{W} SELECT image_id, CASE label WHEN 'A' THEN 10 WHEN 'N' THEN 20 ELSE 30 END AS category_id, concat_ws(',', CAST(CAST(x1 AS BIGINT) AS VARCHAR), CAST(CAST(y1 AS BIGINT) AS VARCHAR), CAST(CAST(x2 - x1 AS BIGINT) AS VARCHAR), CAST(CAST(y2 - y1 AS BIGINT) AS VARCHAR)) AS bbox, round(score, 6) AS score FROM dets")
def s26(spark, sf):
    from ..sources import writers

    cats = spark.createDataFrame([("A", 10), ("N", 20), ("R", 30)], "label string, id int")
    return writers.coco_results(t.detections(spark, sf), cats).select("image_id", "category_id", F.array_join(F.transform("bbox", lambda x: x.cast("long").cast("string")), ",").alias("bbox"), r6(F.col("score"), "score"))


@query("u7_unprocessed", f"{W} SELECT DISTINCT image_id FROM dets WHERE image_id NOT IN (SELECT image_id FROM dets WHERE score > 0.95)")
def u7(spark, sf):
    from ..sources import writers

    dets = t.detections(spark, sf)
    return writers.unprocessed(dets.select("image_id").distinct(), dets.filter("score > 0.95"))
