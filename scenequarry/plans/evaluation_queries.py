"""Queries over evaluators of partly labelled data, and small steps of reading and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import assign, evaluation as ev, matching as m, metrics as mt
from . import scene_queries  # noqa: F401  (its SQL is extended here)
from . import tables as t
from .detection_queries import MAXIOU, W, ap_over_limits, priors, r6
from .registry import ORACLE_SQL, iou_sql, query
from .tables import read

KEYS = ("image_id", "label")


def hits_sql(dets: str, truths: str, name: str) -> str:
    """CTEs ending in name(image_id, label, det_id, score, tp) at an overlap of 0.5."""
    return f"""bo_{name} AS (SELECT p.image_id, p.label, p.det_id, g.gt_id, {iou_sql('p', 'g', 0, '1e-6')} AS o FROM {dets} p JOIN {truths} g ON g.image_id = p.image_id AND g.label = p.label QUALIFY row_number() OVER (PARTITION BY p.image_id, p.label, p.det_id ORDER BY o DESC, g.gt_id) = 1),
{name} AS (SELECT p.*, CASE WHEN o >= 0.5 AND row_number() OVER (PARTITION BY p.image_id, p.label, coalesce(o >= 0.5, false), b.gt_id ORDER BY p.score DESC, p.det_id) = 1 THEN 1 ELSE 0 END AS tp FROM {dets} p LEFT JOIN bo_{name} b USING (image_id, label, det_id))"""


def curve_sql(hits: str, truths: str) -> str:
    return f"""cu AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM {hits} WINDOW w AS (PARTITION BY label ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT label, det_id, score, tp, n_gt, ctp / n_gt AS recall, ctp / greatest(ctp + cfp, 1e-9) AS precision FROM cu JOIN (SELECT label, count(*) AS n_gt FROM {truths} GROUP BY 1) USING (label))"""


@query("a22_federated_ap", f"""{W}, {t.TRUTHS}, jd AS (SELECT DISTINCT image_id, label FROM gts UNION SELECT image_id, label FROM dets WHERE model_id = 2), pj AS (SELECT p.* FROM preds p JOIN jd USING (image_id, label)), {hits_sql('pj', 'gts', 'tpx')}, fx AS (SELECT *, CASE WHEN tp = 1 OR image_id % 5 = 0 THEN 0 ELSE 1 END AS fp FROM tpx), {curve_sql('fx', 'gts')},
lv AS (SELECT unnest(range(0, 101)) AS i), b AS (SELECT label, i, max(precision) FILTER (WHERE recall >= i / 100.0) AS p FROM pr, lv GROUP BY ALL), ap AS (SELECT label, avg(coalesce(p, 0)) AS ap FROM b GROUP BY 1),
fr AS (SELECT label, CASE WHEN n <= 1000 THEN 'r' WHEN n <= 2000 THEN 'c' ELSE 'f' END AS frequency FROM (SELECT label, count(DISTINCT image_id) AS n FROM gts GROUP BY 1)) SELECT frequency, round(avg(ap), 6) AS ap, count(*) AS n FROM ap JOIN fr USING (label) GROUP BY 1""")
def a22(spark, sf):
    """Labels count where an image is known to have or to lack them; images of a fifth have some boxes unmarked."""
    d, gt = t.detections(spark, sf), t.truths(spark, sf)
    judged = ev.federated(t.predictions(spark, sf), gt, d.filter("model_id = 2"))
    hits = ev.lenient(m.true_positives(judged, gt, 0.5, KEYS), d.filter("image_id % 5 = 0"))
    totals = gt.groupBy("label").agg(F.count(F.lit(1)).alias("n_gt"))
    ap = mt.interpolated_precision(mt.curve(hits, totals, ["label"]), ["label"], 101)
    return ap.join(ev.frequency_groups(gt, 1000, 2000), "label").groupBy("frequency").agg(r6(F.avg("ap"), "ap"), F.count(F.lit(1)).alias("n"))


TREE = [("all", "all"), ("A", "A"), ("N", "N"), ("all", "A"), ("all", "N")]
TREE_SQL = "cl(ancestor, node) AS (VALUES " + ", ".join(str(p) for p in TREE) + ")"


@query("a24_hierarchical_ap", f"""{W}, {t.TRUTHS}, {TREE_SQL}, pe AS (SELECT p.* REPLACE (coalesce(ancestor, label) AS label) FROM preds p LEFT JOIN cl ON node = label), ge AS (SELECT g.* REPLACE (coalesce(ancestor, label) AS label), (gt_id // 1000) % 3 = 0 AS is_group FROM gts g LEFT JOIN cl ON node = label), gs AS (SELECT * FROM ge WHERE NOT is_group), {hits_sql('pe', 'gs', 's1')},
go AS (SELECT s.image_id, s.label, s.det_id, g.gt_id AS group_id, greatest(least(s.x2, g.x2) - greatest(s.x1, g.x1), 0) * greatest(least(s.y2, g.y2) - greatest(s.y1, g.y1), 0) / greatest((s.x2 - s.x1) * (s.y2 - s.y1), 1e-6) AS f FROM s1 s JOIN ge g ON g.image_id = s.image_id AND g.label = s.label AND is_group WHERE tp = 0 QUALIFY row_number() OVER (PARTITION BY s.image_id, s.label, s.det_id ORDER BY f DESC, g.gt_id) = 1),
s2 AS (SELECT s.*, group_id, row_number() OVER (PARTITION BY s.image_id, s.label, group_id ORDER BY s.score DESC, s.det_id) AS k FROM s1 s LEFT JOIN (SELECT * FROM go WHERE f >= 0.5) USING (image_id, label, det_id)),
hx AS (SELECT label, det_id, score, CASE WHEN group_id IS NOT NULL THEN 1 ELSE tp END AS tp, CASE WHEN group_id IS NOT NULL OR tp = 1 THEN 0 ELSE 1 END AS fp FROM s2 WHERE group_id IS NULL OR k = 1), {curve_sql('hx', 'ge')},
en AS (SELECT *, max(precision) OVER (PARTITION BY label ORDER BY score, det_id DESC ROWS UNBOUNDED PRECEDING) AS env FROM pr) SELECT label, round(sum(env * tp / n_gt), 6) AS ap FROM en GROUP BY 1""")
def a24(spark, sf):
    """Boxes count for the classes above theirs too, and group boxes take one detection."""
    tree = spark.createDataFrame(TREE, "ancestor string, node string")
    gt = t.truths(spark, sf).withColumn("is_group", F.floor(F.col("gt_id") / 1000) % 3 == 0)
    hits = m.grouped_positives(ev.ancestors(t.predictions(spark, sf), tree), ev.ancestors(gt, tree))
    totals = ev.with_ancestors(gt.groupBy("label").agg(F.count(F.lit(1)).alias("n")), tree).groupBy("label").agg(F.sum("n").alias("n_gt"))
    return mt.average_precision(mt.curve(hits.select("label", "det_id", "score", "tp", "fp"), totals, ["label"]), ["label"]).withColumn("ap", F.round("ap", 6))


A21 = ORACLE_SQL["a21_ap_over_thresholds"].rsplit(" SELECT label, round(", 1)[0]


@query("a26_instance_report", f"{A21}, ap AS (SELECT label, k, avg(coalesce(p, 0)) AS ap FROM b GROUP BY ALL) SELECT CASE WHEN grouping(label) = 1 THEN 'all' ELSE label END AS label, round(avg(ap), 6) AS ap, round(avg(ap) FILTER (WHERE k = 50), 6) AS ap50 FROM ap GROUP BY ROLLUP (label)")
def a26(spark, sf):
    """Mean over ten limits and at 0.5, of each class and of all."""
    return ev.instance_report(ap_over_limits(spark, sf)).select("label", r6(F.col("ap"), "ap"), r6(F.col("ap50"), "ap50"))


@query("t9_top_classes", f"{W}, l AS (SELECT det_id, unnest([x1 / 40, y1 / 40, score, CAST(model_id AS DOUBLE)]) AS v, unnest([0, 1, 2, 3]) AS i FROM dets), e AS (SELECT det_id, i, exp(v) / sum(exp(v)) OVER (PARTITION BY det_id) AS s, row_number() OVER (PARTITION BY det_id ORDER BY v DESC, i) AS r FROM l) SELECT det_id, string_agg(substr('abcd', i + 1, 1), '' ORDER BY r) AS names, round(max(s), 6) AS best FROM e WHERE r <= 2 GROUP BY 1")
def t9(spark, sf):
    logits = F.array(F.col("x1") / 40, F.col("y1") / 40, F.col("score").cast("double"), F.col("model_id").cast("double"))
    got = t.detections(spark, sf).select("det_id", ev.top_classes(logits, list("abcd"), 2).alias("t"))
    return got.select("det_id", F.array_join(F.transform("t", lambda x: x["name"]), "").alias("names"), r6(F.get("t", 0)["share"], "best"))


@query("u8_labels_of_images", f"{W} SELECT image_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM dets WHERE det_id % 2 = 0 OR model_id = 3 GROUP BY 1")
def u8(spark, sf):
    got = ev.labels_of(t.truths(spark, sf), t.detections(spark, sf).filter("model_id = 3"))
    return got.withColumn("labels", F.array_join("labels", ","))


@query("x7_x32_names", "SELECT doc_id, lang || ' ' || source AS spaced, CASE WHEN doc_id % 2 = 0 THEN lang || '_checkpoint-' || doc_id ELSE lang END AS model FROM documents")
def x7(spark, sf):
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/m/"), "lang", F.lit("/checkpoint-"), F.col("doc_id").cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("m/"), "lang"))
    return read(spark, sf, "documents").select("doc_id", ev.spaced(F.concat("lang", F.lit("_"), "source")).alias("spaced"), ev.model_name(path).alias("model"))


@query("x18_spans_in_lower_case", "SELECT conv_id, turn, CAST(instr(lower(text), w) - 1 AS BIGINT) AS start, CAST(instr(lower(text), w) - 1 + length(w) AS BIGINT) AS \"end\" FROM (SELECT *, split_part(text, ' ', 1) AS w FROM conversations) WHERE w <> ''")
def x18(spark, sf):
    rows = read(spark, sf, "conversations").withColumn("w", F.split_part("text", F.lit(" "), F.lit(1))).filter("w <> ''")
    return rows.select("conv_id", "turn", ev.span_in_lower(F.col("text"), F.col("w")).alias("s")).select("conv_id", "turn", "s.start", "s.end")


@query("p15_denormalized", f"{W} SELECT det_id, round(x1 / 400 * (640 + image_id % 3), 6) AS x1, round(y2 / 400 * 480, 6) AS y2 FROM dets")
def p15(spark, sf):
    d = t.detections(spark, sf)
    sizes = d.select("image_id").distinct().select("image_id", (640 + F.col("image_id") % 3).alias("width"), F.lit(480).alias("height"))
    relative = d.select("image_id", "det_id", *((F.col(c) / 400).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return ev.denormalized(relative, sizes).select("det_id", r6(F.col("x1"), "x1"), r6(F.col("y2"), "y2"))


@query("z7_z8_region_labels", "SELECT conv_id, turn, substr(text, 3, 5) AS label FROM conversations WHERE turn % 2 = 0")
def z7(spark, sf):
    span = F.struct(F.lit(2).alias("start"), F.lit(7).alias("end"))
    rows = read(spark, sf, "conversations").withColumn("spans", F.when(F.col("turn") % 2 == 0, F.array(span, span)))
    return rows.filter("size(spans) > 0").select("conv_id", "turn", ev.region_label(F.col("text"), F.col("spans")).alias("label"))


@query("z19_images_with_class", f"{W} SELECT image_id FROM dets GROUP BY 1 HAVING max(CASE WHEN label = 'A' AND model_id = 1 THEN 1 ELSE 0 END) = 1 AND image_id % 7 >= 2")
def z19(spark, sf):
    d = t.detections(spark, sf)
    images = d.select("image_id").distinct().select("image_id", (30 + F.col("image_id") % 7).alias("width"), F.lit(100).alias("height"))
    return ev.images_with_class(images, d.filter("model_id = 1"), ["A"], 32).select("image_id")


@query("z24_side_buckets", f"{W}, w AS (SELECT det_id, (x1 + x2) / 2 - (x2 - x1) * 0.85 AS a, (x1 + x2) / 2 + (x2 - x1) * 0.85 AS c, (y1 + y2) / 2 - (y2 - y1) * 0.85 AS b, (y1 + y2) / 2 + (y2 - y1) * 0.85 AS d FROM dets) SELECT det_id, 7 AS n, round(a + (c - a) / 14 * 0.5, 4) AS l0, round(c - (c - a) / 14 * 6.5, 4) AS r6, round(b + (d - b) / 14 * 2.5, 4) AS t2, round(d - (d - b) / 14 * 3.5, 4) AS b3 FROM w")
def z24(spark, sf):
    s = ev.side_buckets(g.box())
    at = lambda side, i, name: F.round(F.get(s[side], F.lit(i)), 4).alias(name)
    return t.detections(spark, sf).select("det_id", F.size(s["left"]).alias("n"), at("left", 0, "l0"), at("right", 6, "r6"), at("top", 2, "t2"), at("bottom", 3, "b3"))


@query("z30_tag_lines", f"{W} SELECT image_id, CAST(image_id AS VARCHAR) || ',' || string_agg(label, ',' ORDER BY det_id) AS line FROM dets GROUP BY 1")
def z30(spark, sf):
    return ev.tag_lines(t.detections(spark, sf).select("image_id", F.col("det_id").alias("pos"), F.col("label").alias("tag")))


@query("z34_fitted_sizes", f"{W} SELECT det_id, CAST(CASE WHEN w >= h THEN 384 ELSE floor(384 * w / h) END AS INTEGER) AS width, CAST(CASE WHEN w >= h THEN floor(384 * h / w) ELSE 384 END AS INTEGER) AS height FROM (SELECT det_id, x2 - x1 AS w, y2 - y1 AS h FROM dets)")
def z34(spark, sf):
    w, h = ev.fit_long_edge(g.width(g.box()), g.height(g.box()))
    return t.detections(spark, sf).select("det_id", w.alias("width"), h.alias("height"))


@query("s21_label_maps", f"{W} SELECT det_id, CASE WHEN model_id = 0 THEN 255 ELSE model_id - 1 END AS shifted, CASE WHEN model_id IN (2, 5) THEN 255 ELSE model_id END AS joint FROM dets")
def s21(spark, sf):
    names = ["sky", "tree", "sky-other", "wall", "road", "wall-brick", "sea"]
    return t.detections(spark, sf).select("det_id", ev.shifted_class(F.col("model_id")).alias("shifted"), ev.joint_classes_ignored(F.col("model_id"), names).alias("joint"))


@query("g12_reduced_losses", f"{W} SELECT label, round(avg(score * (x2 - x1)), 6) AS mean, round(sum(score * (x2 - x1)), 4) AS total, round(sum(score * (x2 - x1)) / 50, 6) AS over FROM dets GROUP BY 1")
def g12(spark, sf):
    rows = t.detections(spark, sf).withColumn("w", g.width(g.box())).withColumn("n", F.lit(50.0))
    one = lambda name, digits, **k: ev.reduced(rows, ["label"], "score", "w", **k).select("label", F.round("loss", digits).alias(name))
    return one("mean", 6).join(one("total", 4, kind="sum"), "label").join(one("over", 6, avg_factor="n"), "label")


@query("m17_z22_all_sampled", f"{W}, {t.TRUTHS}, {MAXIOU} SELECT image_id, count(*) FILTER (WHERE gt > 0) AS positives, count(*) FILTER (WHERE gt = 0) AS negatives FROM asg WHERE gt >= 0 GROUP BY 1")
def m17(spark, sf):
    got = ev.all_sampled(assign.by_overlap(priors(spark, sf), t.truths(spark, sf)))
    return got.groupBy("image_id").agg(F.count_if("positive").alias("positives"), F.count_if(~F.col("positive")).alias("negatives"))
