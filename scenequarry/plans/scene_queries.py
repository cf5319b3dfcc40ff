"""Queries that build scenes: fan-ins, lookups, affordances, groundings, text and further matching rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import assign
from ..operators import matching as m
from ..operators import metrics as mt
from ..operators import mixing
from . import tables as t
from .detection_queries import AP, MAXIOU, NEAREST, SEEDS, W, ap_over_limits, hits, priors, r6, totals
from .registry import area_sql, fold_sql, iou_sql, query
from .tables import read


@query("j1_model_fan_in", f"{W} SELECT image_id, count(*) FILTER (WHERE model_id = 0) AS m0, count(*) FILTER (WHERE model_id = 1) AS m1, count(*) FILTER (WHERE model_id = 2) AS m2, count(*) AS n FROM dets GROUP BY 1")
def j1(spark, sf):
    """Models arrive as separate tables and meet in one long table, so that an absent model is just absent."""
    dets = t.detections(spark, sf)
    long = None
    for k in range(7):
        part = dets.filter(F.col("model_id") == k)
        long = part if long is None else long.unionByName(part)
    return long.groupBy("image_id").agg(*(F.count_if(F.col("model_id") == k).alias(f"m{k}") for k in range(3)), F.count(F.lit(1)).alias("n"))


@query("j2_j3_inner_fan_in", "SELECT d.doc_id, d.source, l.quality, p.url FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN pages p ON p.page_id = d.doc_id")
def j2(spark, sf):
    p = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").join(p, "doc_id").select("doc_id", "source", "quality", "url")


@query("j10_assigned_label", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0")
def j10(spark, sf):
    assigned = read(spark, sf, "labels").filter("toxic = 0").select("doc_id", F.col("quality").cast("string").alias("a"))
    return read(spark, sf, "documents").join(assigned, "doc_id", "left").select("doc_id", F.coalesce("a", "lang").alias("label"))


@query("j11_depth_key", "SELECT page_id, 'sa_' || CAST(page_id AS VARCHAR) || '.jpg' AS image, CAST(0.5 AS DOUBLE) AS \"min\", CAST(12.25 AS DOUBLE) AS \"max\" FROM pages")
def j11(spark, sf):
    from ..sources import readers

    path = F.concat(F.lit("depth/sa_"), F.col("page_id").cast("string"), F.lit("_min_0.5_max_12.25.jpg"))
    return read(spark, sf, "pages").withColumn("path", path).select("page_id", readers.depth_key(F.col("path")).alias("image"), *readers.depth_range(F.col("path")))


AFF = [("A", "sit", "to sit on"), ("N", "hold", "to hold things"), ("A", "lean", "to lean on")]


@query("j12_a4_affordances", f"{W}, aff(label, category, description) AS (VALUES {', '.join(map(str, AFF))}) SELECT image_id, category, any_value(description) AS description, count(DISTINCT det_id) AS n_objects, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM dets JOIN aff USING (label) GROUP BY ALL")
def j12(spark, sf):
    aff = spark.createDataFrame(AFF, "label string, category string, description string")
    return t.detections(spark, sf).join(F.broadcast(aff), "label").groupBy("image_id", "category").agg(F.first("description").alias("description"), F.countDistinct("det_id").alias("n_objects"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


@query("j13_box_by_id", f"{W}, {t.TRUTHS} SELECT d.det_id, coalesce(g.x1, p.x1) AS x1, CASE WHEN g.gt_id IS NOT NULL THEN 'object' ELSE 'floating' END AS kind FROM dets d LEFT JOIN gts g ON g.gt_id = d.det_id AND g.image_id = d.image_id LEFT JOIN preds p ON p.det_id = d.det_id AND p.image_id = d.image_id")
def j13(spark, sf):
    keys = ["image_id", "det_id"]
    first = t.truths(spark, sf).select("image_id", F.col("gt_id").alias("det_id"), "x1")
    return m.with_fallback(t.detections(spark, sf).select(*keys), keys, [("object", first), ("floating", t.predictions(spark, sf).select(*keys, "x1"))], "x1").select("det_id", "x1", F.col("source").alias("kind"))


@query("j15_a5_grounded_groups", f"{W}, {t.TRUTHS}, fm AS (SELECT p.image_id, p.label AS phrase, p.det_id, min(g.gt_id) AS gt_id FROM preds p LEFT JOIN gts g ON g.image_id = p.image_id AND {iou_sql('p', 'g', 1)} > 0.75 GROUP BY ALL) SELECT image_id, phrase, string_agg(CAST(coalesce(gt_id % 5, -1) AS VARCHAR), ',' ORDER BY det_id) AS groups FROM fm GROUP BY ALL")
def j15(spark, sf):
    got = m.first_match(t.predictions(spark, sf), t.truths(spark, sf), "det_id", "gt_id", 0.75).withColumn("grp", F.coalesce(F.col("match") % 5, F.lit(-1)))
    rows = got.groupBy("image_id", F.col("label").alias("phrase")).agg(F.sort_array(F.collect_list(F.struct("det_id", "grp"))).alias("g"))
    return rows.select("image_id", "phrase", F.array_join(F.transform("g", lambda v: v["grp"].cast("string")), ",").alias("groups"))


@query("j19_noun_label_counts", f"{W}, q AS (SELECT image_id, label, count(*) AS n, min(det_id) AS a, max(det_id) AS b FROM dets GROUP BY ALL) SELECT q.image_id, q.label, CASE WHEN n = 1 THEN q.a WHEN n = 2 AND x.x1 <= y.x1 AND x.y1 <= y.y1 AND x.x2 >= y.x2 AND x.y2 >= y.y2 THEN q.a WHEN n = 2 AND y.x1 <= x.x1 AND y.y1 <= x.y1 AND y.x2 >= x.x2 AND y.y2 >= x.y2 THEN q.b END AS grounded FROM q JOIN dets x ON x.det_id = q.a AND x.image_id = q.image_id JOIN dets y ON y.det_id = q.b AND y.image_id = q.image_id WHERE n <= 2")
def j19(spark, sf):
    each = t.detections(spark, sf).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("det_id", "x1", "y1", "x2", "y2")).alias("a"), F.max(F.struct("det_id", "x1", "y1", "x2", "y2")).alias("b")).filter("n <= 2")
    a, b = g.box(F.col("a")), g.box(F.col("b"))
    pick = F.when((F.col("n") == 1) | g.inside(b, a), F.col("a.det_id")).when(g.inside(a, b), F.col("b.det_id"))
    return each.select("image_id", "label", pick.alias("grounded"))


@query("j25_tag_fan_in", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) || ',trees' AS tags FROM documents GROUP BY 1")
def j25(spark, sf):
    tags = read(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("a"))
    return tags.select("source", F.array_join(F.array_append("a", F.lit("trees")), ",").alias("tags"))


@query("j26_j34_context", "SELECT d.doc_id, coalesce(p.url, '') AS context FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def j26(spark, sf):
    p = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return read(spark, sf, "documents").join(p, "doc_id", "left").select("doc_id", F.coalesce("url", F.lit("")).alias("context"))


GROUPS = "gg AS (SELECT *, CAST(gt_id // 1000 AS BIGINT) % 3 = 0 AS is_group FROM gts)"


@query("j29_group_matching", f"""{W}, {t.TRUTHS}, {GROUPS}, bo AS (SELECT p.image_id, p.label, p.det_id, g.gt_id, {iou_sql('p', 'g', 0, '1e-6')} AS o FROM preds p JOIN gg g ON g.image_id = p.image_id AND g.label = p.label AND NOT is_group QUALIFY row_number() OVER (PARTITION BY p.image_id, p.label, p.det_id ORDER BY o DESC, g.gt_id) = 1),
s1 AS (SELECT p.*, CASE WHEN o >= 0.5 AND row_number() OVER (PARTITION BY p.image_id, p.label, coalesce(o >= 0.5, false), bo.gt_id ORDER BY p.score DESC, p.det_id) = 1 THEN 1 ELSE 0 END AS tp FROM preds p LEFT JOIN bo USING (image_id, label, det_id)),
go AS (SELECT s.image_id, s.label, s.det_id, g.gt_id AS group_id, greatest(least(s.x2, g.x2) - greatest(s.x1, g.x1), 0) * greatest(least(s.y2, g.y2) - greatest(s.y1, g.y1), 0) / greatest({area_sql('s')}, 1e-6) AS f FROM s1 s JOIN gg g ON g.image_id = s.image_id AND g.label = s.label AND is_group WHERE tp = 0 QUALIFY row_number() OVER (PARTITION BY s.image_id, s.label, s.det_id ORDER BY f DESC, g.gt_id) = 1),
s2 AS (SELECT s.*, group_id, row_number() OVER (PARTITION BY s.image_id, s.label, group_id ORDER BY s.score DESC, s.det_id) AS k FROM s1 s LEFT JOIN (SELECT * FROM go WHERE f >= 0.5) USING (image_id, label, det_id))
SELECT label, CAST(sum(CASE WHEN group_id IS NOT NULL THEN 1 ELSE tp END) AS BIGINT) AS tp, count(*) AS n FROM s2 WHERE group_id IS NULL OR k = 1 GROUP BY 1""")
def j29(spark, sf):
    gt = t.truths(spark, sf).withColumn("is_group", F.floor(F.col("gt_id") / 1000) % 3 == 0)
    return m.grouped_positives(t.predictions(spark, sf), gt).groupBy("label").agg(F.sum("tp").cast("long").alias("tp"), F.count(F.lit(1)).alias("n"))


@query("j28_threshold_matching", f"{W}, {t.TRUTHS}, sm AS (SELECT * FROM preds), rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS dr FROM sm), q AS (SELECT p.image_id, p.det_id, g.gt_id, p.dr, {iou_sql('p', 'g', 0, '1e-6')} AS o, least(0.5, {area_sql('g')} / ((g.x2 - g.x1 + 10) * (g.y2 - g.y1 + 10))) AS lim FROM rk p JOIN gts g ON g.image_id = p.image_id), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY dr, o DESC, gt_id) AS rk FROM q WHERE o > 0 AND o >= lim), {fold_sql('r', 'image_id', '(k.det_id = e.det_id OR k.gt_id = e.gt_id)')} SELECT r.image_id, r.det_id, r.gt_id FROM r JOIN kept USING (image_id, rk)")
def j28(spark, sf):
    """Detections in score order take their best unclaimed truth over a threshold that is lower for small truths."""
    p = t.predictions(spark, sf).withColumn("dr", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")))
    gt = t.truths(spark, sf).select("image_id", "gt_id", *g.columns(g.box(), "_g"))
    b = g.box("", "_g")
    limit = F.least(F.lit(0.5), g.area(b) / ((g.width(b) + 10) * (g.height(b) + 10)))
    pairs = p.join(gt, "image_id").withColumns({"overlap": g.iou(g.box(), b, 0, 1e-6), "limit": limit}).filter("overlap >= limit")
    return m.one_to_one(pairs, "det_id", "gt_id", order=[F.col("dr"), -F.col("overlap"), F.col("gt_id")]).select("image_id", "det_id", "gt_id")


@query("j31_pixel_confusion", "WITH px AS (SELECT user_id % 10 AS image_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_type, user_id FROM events) SELECT a.image_id, a.event_type AS gt, b.event_type AS pred, count(*) AS n FROM px a JOIN px b ON a.image_id = b.image_id AND a.p = b.p AND b.user_id = a.user_id + 10 GROUP BY ALL")
def j31(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    px = read(spark, sf, "events").select((F.col("user_id") % 10).alias("image_id"), F.row_number().over(w).alias("p"), "event_type", "user_id")
    other = px.select("image_id", "p", F.col("event_type").alias("pred"), (F.col("user_id") - 10).alias("user_id"))
    return px.join(other, ["image_id", "p", "user_id"]).groupBy("image_id", F.col("event_type").alias("gt"), "pred").agg(F.count(F.lit(1)).alias("n"))


@query("a10_multi_label_promotion", f"{W}, {SEEDS}, l AS (SELECT o.image_id, o.seed_id, count(DISTINCT dets.label) AS n FROM owned o JOIN dets USING (image_id, det_id) GROUP BY ALL) SELECT image_id, seed_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN n > 1 THEN 0 ELSE 1 END, seed_id) - 1 AS BIGINT) AS id FROM l")
def a10(spark, sf):
    from ..operators import detections as d

    dets = t.detections(spark, sf)
    n = d.group_across_models(dets).join(dets.select("image_id", "det_id", "label"), ["image_id", "det_id"]).groupBy("image_id", "seed_id").agg(F.countDistinct("label").alias("n"))
    w = Window.partitionBy("image_id").orderBy(F.when(F.col("n") > 1, 0).otherwise(1), "seed_id")
    return n.select("image_id", "seed_id", (F.row_number().over(w) - 1).cast("long").alias("id"))


@query("a21_ap_over_thresholds", f"""{W}, {t.TRUTHS}, bo AS (SELECT p.image_id, p.det_id, p.label, g.gt_id, {iou_sql('p', 'g', 0, '1e-6')} AS o FROM preds p JOIN gts g ON g.image_id = p.image_id AND g.label = p.label QUALIFY row_number() OVER (PARTITION BY p.image_id, p.label, p.det_id ORDER BY o DESC, g.gt_id) = 1), th AS (SELECT unnest(range(50, 100, 5)) AS k),
tpx AS (SELECT p.label, p.det_id, p.score, k, CASE WHEN o >= k / 100.0 AND row_number() OVER (PARTITION BY p.image_id, p.label, k, coalesce(o >= k / 100.0, false), bo.gt_id ORDER BY p.score DESC, p.det_id) = 1 THEN 1 ELSE 0 END AS tp FROM preds p LEFT JOIN bo USING (image_id, label, det_id), th),
cu AS (SELECT *, sum(tp) OVER w AS ctp, sum(1 - tp) OVER w AS cfp FROM tpx WINDOW w AS (PARTITION BY label, k ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)), pr AS (SELECT label, k, ctp / n_gt AS recall, ctp / (ctp + cfp) AS precision FROM cu JOIN (SELECT label, count(*) AS n_gt FROM gts GROUP BY 1) USING (label)),
lv AS (SELECT unnest(range(0, 101)) AS i), b AS (SELECT label, k, i, max(precision) FILTER (WHERE recall >= i / 100.0) AS p FROM pr, lv GROUP BY ALL) SELECT label, round(avg(coalesce(p, 0)), 6) AS ap FROM b GROUP BY 1""")
def a21(spark, sf):
    """Mean over ten overlap thresholds of the 101-point precision; overlaps are computed once."""
    return ap_over_limits(spark, sf).groupBy("label").agg(r6(F.avg("ap"), "ap"))


@query("a32_mean_boxes", f"{W} SELECT image_id, label, round(avg(x1), 6) AS x1, round(avg(y1), 6) AS y1, round(avg(x2), 6) AS x2, round(avg(y2), 6) AS y2, round(avg(score), 6) AS score FROM dets GROUP BY ALL")
def a32(spark, sf):
    return t.detections(spark, sf).groupBy("image_id", "label").agg(*(r6(F.avg(c), c) for c in ("x1", "y1", "x2", "y2", "score")))


@query("a35_center_of_mass", f"{W} SELECT image_id, round(sum(score * (x1 + x2) / 2) / greatest(sum(score), 1e-6), 5) AS cx, round(sum(score * (y1 + y2) / 2) / greatest(sum(score), 1e-6), 5) AS cy FROM dets GROUP BY 1")
def a35(spark, sf):
    cx, cy = g.center(g.box())
    s = F.col("score")
    mean = lambda c, n: F.round(F.sum(s * c) / F.greatest(F.sum(s), F.lit(1e-6)), 5).alias(n)
    return t.detections(spark, sf).groupBy("image_id").agg(mean(cx, "cx"), mean(cy, "cy"))


@query("a36_polygon_area", f"{W} SELECT det_id, (x2 - x1) * (y2 - y1) / 2 AS area, x1 AS left_x, y2 AS low_y FROM dets")
def a36(spark, sf):
    """Shoelace of the triangle over a box, with the bounds of its points."""
    pts = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y1")), (F.col("x1"), F.col("y2")))))
    turned = F.concat(F.slice("p", 2, 1 << 20), F.slice("p", 1, 1))
    cross = F.zip_with("p", turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    rows = t.detections(spark, sf).withColumn("p", pts)
    return rows.select("det_id", (F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2).alias("area"), F.array_min(F.transform("p", lambda v: v["x"])).alias("left_x"), F.array_max(F.transform("p", lambda v: v["y"])).alias("low_y"))


@query("a38_top_k_accuracy", f"{W}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS k FROM dets) SELECT round(100.0 * avg(CASE WHEN hit THEN 1 ELSE 0 END), 6) AS accuracy FROM (SELECT image_id, bool_or(model_id = image_id % 7) AS hit FROM r WHERE k <= 5 GROUP BY 1)")
def a38(spark, sf):
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    top = t.detections(spark, sf).withColumn("k", F.row_number().over(w)).filter("k <= 5").groupBy("image_id").agg(F.collect_list("model_id").alias("top"))
    return top.agg(F.round(F.avg(F.array_contains("top", F.col("image_id") % 7).cast("int")) * 100.0, 6).alias("accuracy"))


@query("f9_first_box_of_phrase", f"{W} SELECT image_id, label, min(det_id) AS det_id FROM dets WHERE 1 - score > 0.5 GROUP BY ALL")
def f9(spark, sf):
    return t.detections(spark, sf).filter(1 - F.col("score") > 0.5).groupBy("image_id", "label").agg(F.min("det_id").alias("det_id"))


@query("f6_f8_f11_score_floors", f"{W} SELECT model_id, count(*) FILTER (WHERE score >= 0.05) AS owl, count(*) FILTER (WHERE score > 0.0) AS detr, count(*) FILTER (WHERE score > 0.05) AS eva, count(*) FILTER (WHERE score > 0.1) AS sam FROM dets GROUP BY 1")
def f6(spark, sf):
    s = F.col("score")
    return t.detections(spark, sf).groupBy("model_id").agg(F.count_if(s >= 0.05).alias("owl"), F.count_if(s > 0.0).alias("detr"), F.count_if(s > 0.05).alias("eva"), F.count_if(s > 0.1).alias("sam"))


@query("f15_f21_sizes", f"{W} SELECT image_id, count(*) AS n FROM dets WHERE least(x2 - x1, y2 - y1) >= 65 GROUP BY 1")
def f15(spark, sf):
    return t.detections(spark, sf).filter(F.least(g.width(g.box()), g.height(g.box())) >= 65).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query("f20_finished_batches", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) = count(*) FILTER (WHERE length(text) < 3000)")
def f20(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") < 3000).alias("ok")).filter("n = ok").drop("ok")


@query("m2_best_of_approximations", f"{W}, {t.TRUTHS} SELECT p.image_id, p.model_id AS square, g.gt_id, round(max({iou_sql('p', 'g', 0, '1e-6')}), 6) AS overlap FROM preds p JOIN gts g ON p.image_id = g.image_id GROUP BY ALL")
def m2(spark, sf):
    got = m.best_of_groups(t.predictions(spark, sf).withColumnRenamed("model_id", "square"), t.truths(spark, sf), "square", "gt_id", 0, 1e-6)
    return got.withColumn("overlap", r6(F.col("overlap"), "overlap"))


@query("m8_point_levels", f"{W}, {t.TRUTHS} SELECT gt_id, CAST(greatest(0, least(4, floor((log2((x2 - x1) / 4) + log2((y2 - y1) / 4)) / 2))) AS BIGINT) AS level FROM gts")
def m8(spark, sf):
    lv = F.floor((F.log2(g.width(g.box()) / 4) + F.log2(g.height(g.box()) / 4)) / 2)
    return t.truths(spark, sf).select("gt_id", F.greatest(F.lit(0), F.least(F.lit(4), lv)).cast("long").alias("level"))


@query("m14_balanced_negatives")
def m14(spark, sf):
    got = assign.by_overlap(priors(spark, sf), t.truths(spark, sf), overlap="overlap").filter("overlap is not null")
    return assign.balanced_negatives(got, 6).groupBy("image_id", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("z20_unmap", f"{W}, {t.TRUTHS}, {MAXIOU} SELECT d.det_id, coalesce(a.gt, -1) AS gt FROM dets d LEFT JOIN asg a USING (image_id, det_id)")
def z20(spark, sf):
    got = assign.by_overlap(priors(spark, sf), t.truths(spark, sf)).select("image_id", "det_id", "gt")
    return t.detections(spark, sf).join(got, ["image_id", "det_id"], "left").select("det_id", F.coalesce("gt", F.lit(-1)).cast("long").alias("gt"))


@query("z21_truths_as_proposals", f"{W}, {t.TRUTHS} SELECT image_id, count(*) AS n, CAST(sum(own) AS BIGINT) AS own FROM (SELECT image_id, 1 AS own FROM gts UNION ALL SELECT image_id, 0 FROM preds) GROUP BY 1")
def z21(spark, sf):
    both = t.truths(spark, sf).select("image_id", F.lit(1).alias("own")).unionByName(t.predictions(spark, sf).select("image_id", F.lit(0).alias("own")))
    return both.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("own"))


@query("z28_schedule", "WITH ms(epoch, step) AS (VALUES (0, 10), (100, 5), (300, 1)) SELECT doc_id, max_by(step, epoch) AS step FROM documents JOIN ms ON ms.epoch <= doc_id GROUP BY 1")
def z28(spark, sf):
    step = F.when(F.col("doc_id") >= 300, 1).when(F.col("doc_id") >= 100, 5).when(F.col("doc_id") >= 0, 10)
    return read(spark, sf, "documents").select("doc_id", step.alias("step")).filter("step is not null")


@query("z29_vote", "SELECT user_id, event_type AS kind, n AS votes FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def z29(spark, sf):
    n = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("votes"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "event_type")).alias("b")).select("user_id", F.col("b.event_type").alias("kind"), (-F.col("b.v")).alias("votes"))


@query("x19_category_names", "SELECT p_partkey, split_part(p_name, ' ', 1) AS obj, nullif(split_part(p_name, ' ', 2), '') AS part FROM part")
def x19(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("obj"), F.nullif(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("")).alias("part"))


@query("x21_landmark_options", "SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'french' WHEN contains(url, '/de/') THEN 'german' WHEN contains(url, 'https') THEN 'secure' ELSE 'none' END AS kind FROM pages")
def x21(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", F.when(u.contains("/fr/"), "french").when(u.contains("/de/"), "german").when(u.contains("https"), "secure").otherwise("none").alias("kind"))


@query("x25_image_token", "SELECT conv_id, turn, md5('<image>' || chr(10) || trim(replace(text, 'the', ''))) AS digest FROM conversations")
def x25(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.concat(F.lit("<image>\n"), F.trim(F.replace("text", F.lit("the"), F.lit("")))).cast("binary")).alias("digest"))


@query("x26_target_mask", "SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END) AS BIGINT) AS targets, CAST(sum(CASE WHEN role <> 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END) AS BIGINT) AS masked FROM conversations GROUP BY 1")
def x26(spark, sf):
    n = F.size(F.split("text", " "))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("targets"), F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)).alias("masked"))


@query("x30_scene_text", f"{W} SELECT image_id, md5(string_agg(label || '/' || CAST(model_id AS VARCHAR), ', ' ORDER BY det_id)) AS digest FROM (SELECT * FROM dets QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN model_id = 6 THEN 0 ELSE 1 END, det_id) <= 30) GROUP BY 1")
def x30(spark, sf):
    """Every image has its text; of more than 30 objects those with attributes come first, then the others in order."""
    w = Window.partitionBy("image_id").orderBy(F.when(F.col("model_id") == 6, 0).otherwise(1), "det_id")
    chosen = t.detections(spark, sf).withColumn("r", F.row_number().over(w)).filter("r <= 30")
    rows = chosen.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("det_id", F.concat("label", F.lit("/"), F.col("model_id").cast("string")).alias("line")))).alias("l"))
    return rows.select("image_id", F.md5(F.array_join(F.transform("l", lambda v: v["line"]), ", ").cast("binary")).alias("digest"))


@query("r9_padded_batches", r"WITH w AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n FROM conversations) SELECT conv_id, turn, CAST(least(max(n) OVER (PARTITION BY conv_id), 64) AS BIGINT) AS width, CAST(least(n, 64) AS BIGINT) AS used FROM w")
def r9(spark, sf):
    tok = read(spark, sf, "conversations").withColumn("tok", F.transform(F.split("text", " "), F.length))
    got = mixing.padded(tok, ["conv_id"], "turn", "tok", 0, 64)
    return got.select("conv_id", "turn", F.size("ids").cast("long").alias("width"), F.aggregate("mask", F.lit(0), lambda a, v: a + v).cast("long").alias("used"))


@query("e3_e4_augmented_boxes", f"{W} SELECT det_id, 800 - least(x2 * 2, 700) AS x1, least(y1 * 2, 500) AS y1, 800 - least(x1 * 2, 700) AS x2, least(y2 * 2, 500) AS y2 FROM dets")
def e3(spark, sf):
    b = g.flipped(g.clipped(g.scaled(g.box(), 2, 2), 700.0, 500.0), 800, 500, "horizontal")
    return t.detections(spark, sf).select("det_id", *g.columns(b))


@query("e5_cropped_boxes", f"{W} SELECT det_id, greatest(x1 - 50, 0) AS x1, greatest(y1 - 30, 0) AS y1, least(x2 - 50, 100) AS x2, least(y2 - 30, 80) AS y2 FROM dets WHERE least(x2 - 50, 100) > greatest(x1 - 50, 0) AND least(y2 - 30, 80) > greatest(y1 - 30, 0)")
def e5(spark, sf):
    b = g.clipped(g.moved(g.box(), -50, -30), 100.0, 80.0)
    return t.detections(spark, sf).select("det_id", *g.columns(b)).filter("x2 > x1 and y2 > y1")


@query("e9_sheared_boxes", f"{W} SELECT det_id, x1 + y1 * 0.5 AS x1, x2 + y2 * 0.5 AS x2 FROM dets")
def e9(spark, sf):
    b = g.sheared(g.box(), 0.5)
    return t.detections(spark, sf).select("det_id", b["x1"].alias("x1"), b["x2"].alias("x2"))


@query("e10_view_fan_out", f"{W} SELECT image_id, scale, flip, count(*) AS n FROM dets, (VALUES (1), (2)) s(scale), (VALUES (true), (false)) f(flip) GROUP BY ALL")
def e10(spark, sf):
    views = F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), F.lit(f).alias("flip")) for s in (1, 2) for f in (True, False)))).alias("v")
    return t.detections(spark, sf).select("image_id", views).groupBy("image_id", "v.scale", "v.flip").agg(F.count(F.lit(1)).alias("n"))


@query("j8_summary", f"{W}, {t.TRUTHS}, {NEAREST} SELECT count(*) AS n, round(avg(o), 5) AS mean FROM near WHERE o >= 0.65")
def j8s(spark, sf):
    return m.nearest(t.predictions(spark, sf), t.truths(spark, sf), "det_id", "gt_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overlap"), 5).alias("mean"))


@query("a23_voc_ap", f"{W}, {t.TRUTHS}, {AP} SELECT label, round(sum(env * step), 5) AS ap, CAST(max(ctp) AS BIGINT) AS hits FROM en GROUP BY 1")
def a23(spark, sf):
    pts = mt.curve(hits(spark, sf), totals(spark, sf), ["label"])
    return mt.average_precision(pts, ["label"]).join(pts.groupBy("label").agg(F.max("ctp").alias("hits")), "label").select("label", F.round("ap", 5).alias("ap"), "hits")


@query("x20_part_phrases", "SELECT p_partkey, 'the ' || lower(p_type) || ' of the ' || p_name AS phrase FROM part")
def x20(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.format_string("the %s of the %s", F.lower("p_type"), "p_name").alias("phrase"))
