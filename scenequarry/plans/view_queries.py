"""Depth in boxes, crops by overlap, the bucket coder and test-time views. A user's events in order are the pixels of the
image with the user's number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import masks
from ..operators import coders, crops, depth, views
from . import tables as t
from .registry import iou_sql, query

W = "WITH RECURSIVE " + t.DETECTIONS
PX = "px AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events)"


def pixels(spark, sf):
    return t.read(spark, sf, "events").withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)


@query("a7_depth_in_boxes", f"""{W}, {PX}, m AS (SELECT user_id AS image_id, p % 8 AS x, p // 8 AS y, value AS depth FROM px WHERE event_type <> 'error' AND value <> 0)
SELECT image_id, det_id, round(median(depth), 4) AS depth FROM dets JOIN m USING (image_id) WHERE x >= floor(x1 / 20) AND x < floor(x2 / 20) AND y >= floor(y1 / 20) AND y < floor(y2 / 20) GROUP BY ALL""")
def a7(spark, sf):
    """Eight pixels a row; an error's depth is unknown."""
    p = pixels(spark, sf).select(F.col("user_id").alias("image_id"), (F.col("p") % 8).cast("long").alias("x"), F.floor(F.col("p") / 8).alias("y"), F.when(F.col("event_type") != "error", F.col("value")).otherwise(0.0).alias("depth"))
    boxes = t.detections(spark, sf).select("image_id", "det_id", *g.columns(g.scaled(g.box(), 1 / 20, 1 / 20)))
    return depth.median_depths(depth.tiled(p, ["image_id"], 4), boxes, ["image_id"], "det_id", 4).withColumn("depth", F.round("depth", 4))


def draw_sql(what: str, more: str = "") -> str:
    return f"(CAST(CAST('0x' || substr(md5('7:' || image_id || ':' || turn || ':{what}'{more}), 1, 8) AS UBIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


EACH = " || ':' || attempt"
PATCHES = f"""im AS (SELECT image_id, max(x2) AS width, max(y2) AS height FROM dets GROUP BY 1),
tu AS (SELECT im.*, turn, list_extract([CAST(1.0 AS DOUBLE), 0.1, 0.3, 0.5, 0.7, 0.9, 0.0], 1 + CAST(floor({draw_sql('mode')} * 7) AS INTEGER)) AS need FROM im, range(4) r(turn)),
tr AS (SELECT *, width * CAST(0.3 AS DOUBLE) + (width - width * CAST(0.3 AS DOUBLE)) * {draw_sql('w', EACH)} AS w, height * CAST(0.3 AS DOUBLE) + (height - height * CAST(0.3 AS DOUBLE)) * {draw_sql('h', EACH)} AS h FROM tu, range(50) a(attempt) WHERE need < 1),
pl AS (SELECT *, (width - w) * {draw_sql('x', EACH)} AS x, (height - h) * {draw_sql('y', EACH)} AS y FROM tr WHERE h / w >= 0.5 AND h / w <= 2),
pa AS (SELECT image_id, turn, attempt, need, floor(x) AS x1, floor(y) AS y1, floor(x + w) AS x2, floor(y + h) AS y2 FROM pl),
ok AS (SELECT p.image_id, p.turn, p.attempt, p.x1, p.y1, p.x2, p.y2 FROM pa p JOIN dets b USING (image_id) WHERE p.x2 > p.x1 AND p.y2 > p.y1 GROUP BY p.image_id, p.turn, p.attempt, p.x1, p.y1, p.x2, p.y2, p.need HAVING min({iou_sql('p', 'b', 0, '1e-6')}) >= p.need
    AND bool_or((b.x1 + b.x2) / 2 > p.x1 AND (b.x1 + b.x2) / 2 < p.x2 AND (b.y1 + b.y2) / 2 > p.y1 AND (b.y1 + b.y2) / 2 < p.y2)),
al AS (SELECT * FROM ok UNION ALL SELECT image_id, turn, -1, 0, 0, floor(width), floor(height) FROM tu WHERE need = 1 UNION ALL SELECT image_id, NULL, -1, 0, 0, floor(width), floor(height) FROM im),
ch AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY turn NULLS LAST, attempt) = 1)"""


def patches(spark, sf):
    d = t.detections(spark, sf)
    return crops.by_overlap(d.groupBy("image_id").agg(F.max("x2").alias("width"), F.max("y2").alias("height")), d, 7)


@query("e5_overlap_patches", f"{W}, {PATCHES} SELECT image_id, CAST(turn AS INTEGER) AS turn, CAST(attempt AS INTEGER) AS attempt, CAST(x1 AS BIGINT) AS px1, CAST(y1 AS BIGINT) AS py1, CAST(x2 AS BIGINT) AS px2, CAST(y2 AS BIGINT) AS py2 FROM ch")
def e5_patches(spark, sf):
    return patches(spark, sf)


@query("e5_overlap_crops", f"""{W}, {PATCHES} SELECT b.image_id, b.det_id, greatest(b.x1 - p.x1, 0) AS x1, greatest(b.y1 - p.y1, 0) AS y1, least(b.x2 - p.x1, p.x2 - p.x1) AS x2, least(b.y2 - p.y1, p.y2 - p.y1) AS y2
FROM dets b JOIN ch p USING (image_id) WHERE (b.x1 + b.x2) / 2 > p.x1 AND (b.x1 + b.x2) / 2 < p.x2 AND (b.y1 + b.y2) / 2 > p.y1 AND (b.y1 + b.y2) / 2 < p.y2""")
def e5_crops(spark, sf):
    return crops.cropped(t.detections(spark, sf), patches(spark, sf)).select("image_id", "det_id", *g.FIELDS)


@query("g8_bucket_coder", f"""{W}, si AS (SELECT det_id, unnest([{{'side': 'left', 'at': (x1 + x2) / 2 - (x2 - x1) * 1.7 / 2, 'step': ((x1 + x2) / 2 + (x2 - x1) * 1.7 / 2 - ((x1 + x2) / 2 - (x2 - x1) * 1.7 / 2)) / 14, 'dir': 1, 'g': x1 + l_q}},
    {{'side': 'right', 'at': (x1 + x2) / 2 + (x2 - x1) * 1.7 / 2, 'step': ((x1 + x2) / 2 + (x2 - x1) * 1.7 / 2 - ((x1 + x2) / 2 - (x2 - x1) * 1.7 / 2)) / 14, 'dir': -1, 'g': x2 - l_q * 0.7}},
    {{'side': 'top', 'at': (y1 + y2) / 2 - (y2 - y1) * 1.7 / 2, 'step': ((y1 + y2) / 2 + (y2 - y1) * 1.7 / 2 - ((y1 + y2) / 2 - (y2 - y1) * 1.7 / 2)) / 14, 'dir': 1, 'g': y1 - l_q * 0.3}},
    {{'side': 'bottom', 'at': (y1 + y2) / 2 + (y2 - y1) * 1.7 / 2, 'step': ((y1 + y2) / 2 + (y2 - y1) * 1.7 / 2 - ((y1 + y2) / 2 - (y2 - y1) * 1.7 / 2)) / 14, 'dir': -1, 'g': y2 + l_q * 0.9}}]) AS s FROM (SELECT *, score * 1.37 + 0.11 AS l_q FROM dets)),
o AS (SELECT det_id, s.side, s.g, i, (s.at + s.dir * (i + 0.5) * s.step - s.g) / s.step AS f FROM si, range(7) r(i)), n AS (SELECT *, row_number() OVER (PARTITION BY det_id, side ORDER BY abs(f), i) AS rk, sum(exp(-abs(f))) OVER (PARTITION BY det_id, side) AS z FROM o),
c AS (SELECT det_id, side, any_value(g) AS g, max(i) FILTER (WHERE rk = 1) AS bucket, max(f) FILTER (WHERE rk = 1) AS f, sum(CASE WHEN rk = 1 OR (rk = 2 AND abs(f) < 1) THEN 1 ELSE 0 END) AS weighed, sum(CASE WHEN abs(f) < 1 AND rk > 1 THEN 1 ELSE 0 END) AS spared, sum(exp(-abs(f)) / z) FILTER (WHERE rk <= 2) AS sure FROM n GROUP BY ALL)
SELECT det_id, string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY side) AS buckets, CAST(sum(weighed) AS BIGINT) AS weighed, CAST(sum(spared) AS BIGINT) AS spared, round(sum(f), 6) AS offsets, round(max(g) FILTER (WHERE side = 'left'), 6) AS x1, round(max(g) FILTER (WHERE side = 'top'), 6) AS y1, round(max(g) FILTER (WHERE side = 'right'), 6) AS x2, round(max(g) FILTER (WHERE side = 'bottom'), 6) AS y2, round(avg(sure), 6) AS sure FROM c GROUP BY 1""")
def g8(spark, sf):
    """A moved box against the box itself, coded and read back with nearness as the buckets' scores."""
    q = F.col("score") * 1.37 + 0.11
    truth = g.of(F.col("x1") + q, F.col("y1") - q * 0.3, F.col("x2") - q * 0.7, F.col("y2") + q * 0.9)
    sides = t.detections(spark, sf).select("det_id", coders.round_trip(g.box(), truth).alias("r")).select("det_id", "r.*")
    return sides.select("det_id", F.concat_ws(",", *sorted(coders.SIDES)).alias("buckets"), "weighed", "spared", *(F.round(c, 6).alias(c) for c in ("offsets", *g.FIELDS, "sure")))


@query("a32_merged_views", f"{W} SELECT image_id, det_id, round(x1 + CAST(3.5 AS DOUBLE) / 3, 4) AS x1, round(y1 - CAST(3.5 AS DOUBLE) / 3, 4) AS y1, round(x2 + CAST(3.5 AS DOUBLE) / 3, 4) AS x2, round(y2 - CAST(3.5 AS DOUBLE) / 3, 4) AS y2, round(score * 2, 4) AS score FROM dets")
def a32(spark, sf):
    """Three views, each of which finds every box so many pixels off as its number, with its number and one times its score."""
    seen = views.fan_out(t.detections(spark, sf).withColumns({"width": F.lit(400.0), "height": F.lit(300.0)}), [(1.0, ""), (2.0, "horizontal"), (0.5, "vertical")])
    off = seen.withColumns(g.moved(g.box(), F.col("view"), F.col("view"))).withColumn("score", F.col("score") * (F.col("view") + 1))
    got = views.merged_boxes(views.restored(off), ["image_id", "det_id"])
    return got.select("image_id", "det_id", *(F.round(c, 4).alias(c) for c in (*g.FIELDS, "score")))


@query("a32_voted_masks", f"""WITH {PX}, k AS (SELECT user_id, p FROM px WHERE CASE WHEN event_type = 'click' THEN 1 ELSE 0 END + CASE WHEN value > 60 THEN 1 ELSE 0 END + CASE WHEN value > 40 THEN 2 ELSE 0 END > 2),
i AS (SELECT *, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS island FROM k) SELECT user_id, CAST(min(p) AS BIGINT) AS "start", CAST(max(p) + 1 AS BIGINT) AS "end" FROM i GROUP BY user_id, island""")
def a32_masks(spark, sf):
    """Masks of three views, mirrored as the views show them and back, the last view with double weight; eight pixels a column."""
    mask = lambda view, flip, w, on: F.struct(F.lit(view).alias("view"), F.lit(flip).alias("flip"), F.lit(w).alias("w"), on.cast("int").alias("on"))
    each = F.array(mask(0, "", 1.0, F.col("event_type") == "click"), mask(1, "vertical", 1.0, F.col("value") > 60), mask(2, "diagonal", 2.0, F.col("value") > 40))
    keys = ["user_id", "view", "flip", "w"]
    coded = masks.encode(pixels(spark, sf).select("user_id", "p", F.explode(each).alias("m")).select("user_id", "p", "m.*"), keys, ["p"], "on")
    runs = masks.runs(coded.withColumn("width", F.ceil(F.col("size") / 8)), [*keys, "width"]).withColumn("height", F.lit(8).cast("long"))
    own = ["user_id", "view", "w"]
    return views.voted(views.flipped_runs(views.flipped_runs(runs, own), own), ["user_id"], "w", F.lit(4.0))


@query("m18_mask_targets", f"""{W}, {PX}, on_ AS (SELECT user_id AS image_id, p // 8 AS c, p % 8 AS r FROM px WHERE event_type = 'click'), b AS (SELECT image_id, det_id, x1 / 20 AS x1, y1 / 20 AS y1, x2 / 20 AS x2, y2 / 20 AS y2 FROM dets),
t AS (SELECT image_id, det_id, (c - x1) * 7 / (x2 - x1) AS l, (c + 1 - x1) * 7 / (x2 - x1) AS r_, (r - y1) * 7 / (y2 - y1) AS u, (r + 1 - y1) * 7 / (y2 - y1) AS d FROM b JOIN on_ USING (image_id)),
a AS (SELECT image_id, det_id, j * 7 + i AS k, sum((least(r_, j + 1) - greatest(l, j)) * (least(d, i + 1) - greatest(u, i))) AS s FROM t, range(7) x(j), range(7) y(i) WHERE l < j + 1 AND r_ > j AND u < i + 1 AND d > i GROUP BY ALL),
n AS (SELECT *, k - row_number() OVER (PARTITION BY image_id, det_id ORDER BY k) AS island FROM a WHERE round(s, 9) >= 0.5)
SELECT image_id, det_id, CAST(min(k) AS BIGINT) AS "start", CAST(max(k) + 1 AS BIGINT) AS "end" FROM n GROUP BY image_id, det_id, island""")
def m18(spark, sf):
    """Clicks are the mask, eight pixels a column; boxes of an image take part of its mask to seven cells a side."""
    coded = masks.encode(pixels(spark, sf).select(F.col("user_id").alias("image_id"), "p", (F.col("event_type") == "click").cast("int").alias("on")), ["image_id"], ["p"], "on")
    boxes = t.detections(spark, sf).select("image_id", "det_id", *g.columns(g.of(*(F.col(f) / 20 for f in g.FIELDS))))
    return masks.targets(masks.runs(coded, ["image_id"]).withColumn("height", F.lit(8).cast("long")), boxes, ["image_id"], "det_id", 7)
