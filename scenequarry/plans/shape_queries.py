"""Queries over polygons, bitmaps and the further assigners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import masks, raster
from ..operators import assign
from . import tables as t
from .detection_queries import MAXIOU, W, priors, r6
from .registry import iou_sql, query


def roofs(spark, sf):
    """A house over each box: its corners, with a ridge in the middle of the upper side."""
    d = t.detections(spark, sf)
    mid = (F.col("x1") + F.col("x2")) / 2
    return d.withColumn("p", raster.points((F.col("x1"), F.col("y1") + 20), (mid, F.col("y1")), (F.col("x2"), F.col("y1") + 20), (F.col("x2"), F.col("y2")), (F.col("x1"), F.col("y2"))))


@query("a36_house_area", f"{W} SELECT det_id, (x2 - x1) * (y2 - y1 - 20) + (x2 - x1) * 20 / 2 AS area, x1, y1, x2, y2 FROM dets")
def a36_house(spark, sf):
    return roofs(spark, sf).select("det_id", raster.polygon_area(F.col("p")).alias("area"), *(c.alias(n) for n, c in raster.polygon_bounds(F.col("p")).items()))


@query("g19_moved_polygons", f"{W} SELECT det_id, 400 - (x1 + x2) / 2 AS ridge_x, 2 * (300 - y2) AS low_y, least(x2 + 100, 260.0) AS right_x, x2 - 30 AS crop_x, x1 + 0.5 * y2 AS shear_x FROM dets")
def g19(spark, sf):
    p = F.col("p")
    at = lambda q, i, c: F.get(q, F.lit(i))[c]
    both = raster.resized(raster.flipped(p, 400, 300, "diagonal"), 1, 2)
    return roofs(spark, sf).select("det_id", at(both, 1, "x").alias("ridge_x"), at(both, 3, "y").alias("low_y"), at(raster.translated(p, 100, 0, 260.0, 400.0), 2, "x").alias("right_x"), at(raster.cropped(p, 30, 10), 3, "x").alias("crop_x"), at(raster.sheared(p, 0.5), 4, "x").alias("shear_x"))


@query("g17_g18_polygon_masks", f"{W} SELECT det_id, CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS area FROM dets")
def g17(spark, sf):
    """Bitmaps of whole-numbered boxes, from their corner on."""
    w, h = g.width(g.box()), g.height(g.box())
    zero = F.lit(0.0)
    p = raster.points((zero, zero), (w, zero), (w, h), (zero, h))
    rows = t.detections(spark, sf)  # before the masks: reading lets Python workers import this package
    return rows.select("det_id", raster.pixels_set(raster.rasterized(p, F.ceil(h).cast("int") + 3, F.ceil(w).cast("int") + 2)).alias("area"))


@query("g20_split_polygons", f"{W} SELECT image_id, len(l[1:2]) + 10 * len(l[3:5]) AS sizes, l[3] AS third FROM (SELECT image_id, list(det_id ORDER BY det_id) AS l FROM dets GROUP BY 1) WHERE len(l) >= 3")
def g20(spark, sf):
    rows = t.detections(spark, sf).groupBy("image_id").agg(F.sort_array(F.collect_list("det_id")).alias("l")).filter(F.size("l") >= 3)
    cut = rows.withColumn("s", raster.split_by_lengths(F.col("l"), F.array(F.lit(2), F.lit(3))))
    return cut.select("image_id", (F.size(F.get("s", 0)) + 10 * F.size(F.get("s", 1))).cast("long").alias("sizes"), F.get(F.get("s", 1), 0).alias("third"))


@query("a37_stability", f"{W} SELECT image_id, round(count(*) FILTER (WHERE score > 0.6) / nullif(count(*) FILTER (WHERE score > 0.2), 0), 6) AS stability FROM dets GROUP BY 1")
def a37(spark, sf):
    rows = t.detections(spark, sf).groupBy("image_id").agg(F.collect_list("score").alias("v"))
    return rows.select("image_id", r6(raster.stability(F.col("v"), 0.4, 0.2), "stability"))


@query("f29_small_regions", f"{W} SELECT det_id, CASE WHEN w * 4 >= 30 THEN w * 4 WHEN w * 4 >= 5 THEN w * 4 ELSE 5 END + CASE WHEN w * 4 < 30 AND w * 4 < 5 THEN 0 ELSE 0 END AS area FROM (SELECT det_id, CAST(l % 9 + 2 AS BIGINT) AS w FROM (SELECT det_id, det_id // 1000 AS l FROM dets))")
def f29(spark, sf):
    """A block of 4 rows and a speck of 5 pixels two columns behind it: specks under 8 pixels go."""
    w = (F.floor(F.col("det_id") / 1000) % 9 + 2).cast("int")
    rows = t.detections(spark, sf).select("det_id", w.alias("w"))
    counts = F.concat(F.flatten(F.array_repeat(F.array(F.lit(0), F.lit(4)), 1)), F.flatten(F.array_repeat(F.array(F.lit(2), F.lit(4)), F.col("w") - 1)), F.array(F.lit(2 + 12), F.lit(5), F.lit(1)))
    clean = raster.without_small_regions(counts, F.array(F.lit(6), F.col("w") + 3), 8, False)
    return rows.select("det_id", masks.run_area(clean).alias("area"))


OTA = f"""pr AS (SELECT p.*, 16.0 AS stride FROM preds p), q AS (SELECT p.image_id, p.det_id, g.gt_id, p.score, {iou_sql('p', 'g', 0, '1e-6')} AS o, p.label = g.label AS same,
((p.x1 + p.x2) / 2 - g.x1 > 0 AND (p.y1 + p.y2) / 2 - g.y1 > 0 AND g.x2 - (p.x1 + p.x2) / 2 > 0 AND g.y2 - (p.y1 + p.y2) / 2 > 0) AS ins, (abs((p.x1 + p.x2) / 2 - (g.x1 + g.x2) / 2) < 40 AND abs((p.y1 + p.y2) / 2 - (g.y1 + g.y2) / 2) < 40) AS cen FROM pr p JOIN gts g ON g.image_id = p.image_id),
v AS (SELECT *, least(greatest(sqrt(score), 1e-12), 1 - 1e-12) AS pp FROM q QUALIFY bool_or(ins OR cen) OVER (PARTITION BY image_id, det_id)),
k AS (SELECT *, CASE WHEN same THEN -ln(pp) ELSE -ln(1 - pp) END - 3 * ln(o + 1e-8) + CASE WHEN ins AND cen THEN 0 ELSE 1e8 END AS cost FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, gt_id ORDER BY o DESC, det_id) AS ro, row_number() OVER (PARTITION BY image_id, gt_id ORDER BY round(cost, 6), det_id) AS rc FROM k),
d AS (SELECT *, greatest(1, CAST(floor(sum(CASE WHEN ro <= 10 THEN o ELSE 0 END) OVER (PARTITION BY image_id, gt_id)) AS BIGINT)) AS kk FROM r),
b AS (SELECT image_id, det_id, CASE WHEN count(*) FILTER (WHERE rc <= kk) > 1 THEN min_by(gt_id, (round(cost, 6), gt_id)) ELSE max(gt_id) FILTER (WHERE rc <= kk) END AS gt_id FROM d GROUP BY ALL HAVING count(*) FILTER (WHERE rc <= kk) > 0)"""


@query("m5_sim_ota", f"{W}, {t.TRUTHS}, {OTA} SELECT count(*) AS n, count(gt_id) AS taken FROM preds p LEFT JOIN b USING (image_id, det_id)")
def m5(spark, sf):
    got = assign.sim_ota(t.predictions(spark, sf).withColumn("stride", F.lit(16.0)), t.truths(spark, sf))
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt") > 0).alias("taken"))


@query("m7_uniform_assign", f"""{W}, {t.TRUTHS}, q AS (SELECT p.image_id, p.det_id, g.gt_id, {iou_sql('p', 'g', 0, '1e-6')} AS o, abs((p.x1 + p.x2) / 2 - (g.x1 + g.x2) / 2) + abs((p.y1 + p.y2) / 2 - (g.y1 + g.y2) / 2) + abs((p.x2 - p.x1) - (g.x2 - g.x1)) + abs((p.y2 - p.y1) - (g.y2 - g.y1)) AS far FROM preds p JOIN gts g ON g.image_id = p.image_id),
n AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY image_id, gt_id ORDER BY far, det_id) <= 4), b AS (SELECT image_id, det_id, max(gt_id) AS gt_id, max_by(o, gt_id) AS o FROM n GROUP BY ALL), m AS (SELECT image_id, det_id, max(o) AS most FROM q GROUP BY ALL)
SELECT p.image_id, p.det_id, CASE WHEN b.o < 0.15 THEN -1 WHEN b.gt_id IS NOT NULL THEN b.gt_id + 1 WHEN most > 0.7 THEN -1 ELSE 0 END AS gt FROM preds p LEFT JOIN b USING (image_id, det_id) LEFT JOIN m USING (image_id, det_id)""")
def m7(spark, sf):
    return assign.uniform(priors(spark, sf), t.truths(spark, sf)).select("image_id", "det_id", "gt")


def grid_sql(where):
    return MAXIOU.replace("FROM preds p JOIN gts g ON p.image_id = g.image_id)", f"FROM (SELECT * FROM preds WHERE {where}) p JOIN gts g ON p.image_id = g.image_id)").replace("FROM preds p LEFT JOIN b", f"FROM (SELECT * FROM preds WHERE {where}) p LEFT JOIN b")


@query("m9_grid_assign", f"{W}, {t.TRUTHS}, {grid_sql('model_id % 2 = 0')}, rest AS (SELECT p.image_id, p.det_id, CASE WHEN coalesce(max({iou_sql('p', 'g', 0, '1e-6')}), 0) < 0.4 THEN 0 ELSE -1 END AS gt FROM preds p LEFT JOIN gts g ON g.image_id = p.image_id WHERE p.model_id % 2 = 1 GROUP BY ALL) SELECT image_id, det_id, CAST(gt AS BIGINT) AS gt FROM (SELECT image_id, det_id, gt FROM asg UNION ALL SELECT image_id, det_id, gt FROM rest)")
def m9(spark, sf):
    p = t.predictions(spark, sf).withColumn("responsible", F.col("model_id") % 2 == 0)
    return assign.by_grid(p, t.truths(spark, sf)).select("image_id", "det_id", "gt")


@query("m10_region_assign", f"""{W}, {t.TRUTHS}, gl AS (SELECT *, greatest(0, least(4, CAST(floor(log2(sqrt((x2 - x1) * (y2 - y1))) - 3 + 0.5) AS BIGINT))) AS level FROM gts), q AS (SELECT p.image_id, p.det_id, g.gt_id, abs((p.x1 + p.x2) / 2 - (g.x1 + g.x2) / 2) / (g.x2 - g.x1) AS ax, abs((p.y1 + p.y2) / 2 - (g.y1 + g.y2) / 2) / (g.y2 - g.y1) AS ay FROM preds p JOIN gl g ON p.image_id = g.image_id AND g.level = p.model_id % 2 + 3),
b AS (SELECT image_id, det_id, max(CASE WHEN ax < 0.2 AND ay < 0.2 THEN gt_id END) AS own FROM q WHERE ax < 0.3 AND ay < 0.3 GROUP BY ALL) SELECT p.image_id, p.det_id, CASE WHEN own IS NOT NULL THEN own + 1 WHEN b.det_id IS NOT NULL THEN -1 ELSE 0 END AS gt FROM preds p LEFT JOIN b USING (image_id, det_id)""")
def m10(spark, sf):
    p = t.predictions(spark, sf).withColumn("level", F.col("model_id") % 2 + 3)
    return assign.by_region(p, t.truths(spark, sf)).select("image_id", "det_id", "gt")


@query("m13_balanced_positives", f"{W}, {t.TRUTHS}, {MAXIOU} SELECT image_id, least(4, count(*)) AS n FROM asg WHERE gt > 0 GROUP BY 1")
def m13(spark, sf):
    got = assign.balanced_positives(assign.by_overlap(priors(spark, sf), t.truths(spark, sf)), 4)
    return got.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query("m16_w11_ranked_negatives", f"{W}, {t.TRUTHS}, {MAXIOU}, n AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id) AS place FROM asg WHERE gt = 0), i AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n - place + score DESC, det_id) AS rank FROM n) SELECT image_id, det_id, CAST(rank AS BIGINT) AS rank, round((n - rank + 1) / n, 6) AS weight FROM i WHERE rank <= 3")
def m16(spark, sf):
    got = assign.ranked_negatives(assign.by_overlap(priors(spark, sf, "score", "label"), t.truths(spark, sf)), 3, "label")
    return got.select("image_id", "det_id", F.col("rank").cast("long").alias("rank"), r6(F.col("weight"), "weight"))
