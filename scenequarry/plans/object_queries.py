"""Queries over scene objects, referring expressions, augmented boxes, panoptic ids and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import scenes as s
from ..sources import readers
from . import tables as t
from .detection_queries import W, r6
from .registry import query
from .tables import read


@query("f12_large_regions", f"{W} SELECT image_id, det_id FROM dets WHERE (x2 - x1) * (y2 - y1) / (500 * 400) >= 0.04")
def f12(spark, sf):
    return s.large_regions(t.detections(spark, sf), F.lit(500), F.lit(400), 0.04).select("image_id", "det_id")


@query("f19_with_depth", f"{W} SELECT d.image_id, count(*) AS n FROM dets d JOIN orders ON o_orderkey = det_id // 1000000000 WHERE o_orderstatus = 'O' GROUP BY 1")
def f19(spark, sf):
    price = read(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("depth"))
    rows = t.detections(spark, sf).withColumn("k", F.floor(F.col("det_id") / 1_000_000_000)).join(price, "k", "left")
    return s.with_depth(rows).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query("f25_f26_f27_object_filters", f"{W} SELECT image_id, count(*) FILTER (WHERE model_id = 6) AS attributes, count(*) FILTER (WHERE score <= 0.5) AS unmasked FROM dets GROUP BY 1 HAVING count(*) FILTER (WHERE model_id = 6) > 0 AND count(*) FILTER (WHERE score <= 0.5) > 0")
def f25(spark, sf):
    d = t.detections(spark, sf)
    objects = d.groupBy("image_id").agg(F.collect_list(F.when(F.col("model_id") == 6, F.col("det_id"))).alias("attributes"))
    bare = s.without_mask(d.withColumn("segmentation", F.when(F.col("score") > 0.5, "m"))).groupBy("image_id").agg(F.count(F.lit(1)).alias("unmasked"))
    return s.with_some(objects, "attributes").join(bare, "image_id").select("image_id", F.size("attributes").cast("long").alias("attributes"), "unmasked")


@query("s34_p2_p3_exports", f"{W} SELECT image_id, count(*) AS n, round(sum(round_even(score, 2)), 4) AS total FROM dets GROUP BY 1")
def s34(spark, sf):
    body = F.struct("det_id", s.rounded(F.col("score")).alias("score"), F.lit("mask").alias("sam_mask"))
    scenes = t.detections(spark, sf).groupBy("image_id").agg(F.collect_list(body).alias("objects"), F.first("label").alias("caption"))
    lean = s.objects_only(s.without_fields(scenes, "objects", "sam_mask"))
    assert "sam_mask" not in lean.schema["objects"].dataType.simpleString()
    return lean.select("image_id", F.size("objects").cast("long").alias("n"), F.round(F.aggregate("objects", F.lit(0.0), lambda a, o: a + o["score"]), 4).alias("total"))


@query("j14_segment_by_id", f"{W} SELECT det_id, CASE WHEN model_id < 3 THEN label || CAST(model_id AS VARCHAR) END AS segmentation FROM dets")
def j14(spark, sf):
    d, keys = t.detections(spark, sf), ["image_id", "det_id"]
    objects = d.filter("model_id < 3").withColumn("segmentation", F.concat("label", F.col("model_id").cast("string")))
    return s.segment_of(d.select(*keys), objects, keys).select("det_id", "segmentation")


@query("t3_chosen_objects", f"{W}, o AS (SELECT * FROM dets WHERE model_id = 0), f AS (SELECT * FROM dets WHERE model_id > 0 AND image_id NOT IN (SELECT image_id FROM o)) SELECT image_id, det_id FROM (SELECT * FROM o UNION ALL SELECT * FROM f) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN label = 'R' THEN 0 ELSE 1 END, det_id) <= 3")
def t3(spark, sf):
    d = t.detections(spark, sf)
    return s.chosen_objects(d.filter("model_id = 0"), d.filter("model_id > 0"), 3, F.col("label") == "R").select("image_id", "det_id")


def refs(spark, sf):
    """Documents as referring expressions of ten images' worth each, their lines as sentences."""
    return read(spark, sf, "documents").select((F.col("doc_id") % 97).alias("image_id"), F.col("doc_id").alias("ref_id"), (F.col("doc_id") * 3).alias("ann_id"), F.split("text", "\n").alias("sentences"))


@query("j21_refs_by_image", "SELECT doc_id % 97 AS image_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS refs FROM documents GROUP BY 1")
def j21(spark, sf):
    return s.refs_by_image(refs(spark, sf)).select("image_id", F.array_join(F.transform("ref_ids", lambda i: i.cast("string")), ",").alias("refs"))


@query("j35_sampled_expressions", r"SELECT doc_id % 97 AS image_id, CAST(least(5, sum(len(string_split(text, chr(10))))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def j35(spark, sf):
    return s.sampled_expressions(refs(spark, sf), 5).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query("s7_s8_j20_refer_targets", "SELECT doc_id AS ref_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS targets, doc_id % 3 = 0 AS asked FROM documents")
def s8(spark, sf):
    """References to two objects, or to none (-1); those of categories 0 or 6 are asked."""
    d = read(spark, sf, "documents")
    r = d.select(F.col("doc_id").alias("ref_id"), (F.col("doc_id") % 97).alias("image_id"), F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array("doc_id", F.col("doc_id") + 1_000_000)).alias("ann_id"), (F.col("doc_id") % 3 * 2).alias("category_id"), F.lit("train").alias("split"), F.array("lang").alias("sentences"))
    anns = d.select("doc_id").unionByName(d.select((F.col("doc_id") + 1_000_000).alias("doc_id"))).select(F.col("doc_id").alias("id"), F.lit(1.0).alias("area"))
    targets = readers.refer(r, anns)["targets"].groupBy("ref_id").agg(F.count("area").cast("int").alias("targets"))
    return targets.join(r.select("ref_id", s.any_of(F.array("category_id"), [0, 6]).alias("asked")), "ref_id")


@query("r5_valid_sample", "SELECT source, least(4, count(*)) AS n FROM documents WHERE n_chars > 900 GROUP BY 1")
def r5(spark, sf):
    got = s.valid_sample(read(spark, sf, "documents"), F.col("n_chars") > 900, ["source"], "doc_id", 4)
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("r2_r3_task_mix")
def r2(spark, sf):
    rates = {"caption": {"short": 3, "dense": 1}, "region": {"vg": 1, "flickr": 1, "coco": 2}, "segm": {"refer": 1}}
    return s.task_mix(read(spark, sf, "documents"), "doc_id", rates, {"caption": 15, "region": 40, "segm": 45}).groupBy("family", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query("r7_epochs", "SELECT CAST(e AS INTEGER) AS epoch, count(*) AS n, count(*) AS places, CAST(count(*) - 1 AS BIGINT) AS last FROM documents, (SELECT unnest(range(0, 3)) AS e) GROUP BY 1")
def r7(spark, sf):
    return s.epochs(read(spark, sf, "documents"), "doc_id", 3, 4).groupBy("epoch").agg(F.countDistinct("doc_id").alias("n"), F.countDistinct("place").alias("places"), F.max("place").alias("last"))


@query("e6_expanded_boxes", f"{W} SELECT det_id, x1 + 37 AS x1, y2 + 11 AS y2 FROM dets")
def e6(spark, sf):
    b = s.expanded(g.box(), 37, 11)
    return t.detections(spark, sf).select("det_id", b["x1"].alias("x1"), b["y2"].alias("y2"))


@query("e7_u5_mosaic", f"{W}, q AS (SELECT *, image_id // 4 AS mosaic_id, image_id % 4 AS quarter FROM dets), b AS (SELECT mosaic_id, det_id, least(x1, 150) + (quarter % 2) * 150 AS x1, least(y1, 150) + CASE WHEN quarter >= 2 THEN 150 ELSE 0 END AS y1, least(x2, 150) + (quarter % 2) * 150 AS x2, least(y2, 150) + CASE WHEN quarter >= 2 THEN 150 ELSE 0 END AS y2 FROM q) SELECT mosaic_id, det_id, x1, y1, x2, y2 FROM b WHERE x2 - x1 > 1 AND y2 - y1 > 1")
def e7(spark, sf):
    d = t.detections(spark, sf)
    groups = d.select("image_id").distinct().select("image_id", F.floor(F.col("image_id") / 4).alias("mosaic_id"), (F.col("image_id") % 4).alias("quarter"))
    return s.mosaic(d, groups, 300.0).drop("label")


@query("e7_mixed_up", f"{W} SELECT image_id, count(*) AS n, round(sum(x1), 3) AS xs FROM (SELECT image_id, x1 FROM dets UNION ALL SELECT image_id - 1, least(greatest((400 - x2) * 1.5, 0), 400) FROM dets WHERE image_id > 0) GROUP BY 1")
def e7m(spark, sf):
    d = t.detections(spark, sf)
    pairs = d.select("image_id").distinct().filter("image_id > 0").select((F.col("image_id") - 1).alias("image_id"), F.col("image_id").alias("partner"))
    return s.mixed_up(d, pairs, 1.5, 400.0, 300.0).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x1"), 3).alias("xs"))


@query("e7_affine", f"{W}, a AS (SELECT det_id, x1 + 0.5 * y1 - 20 AS ax, 0.5 * y1 - 10 AS ay, x2 + 0.5 * y2 - 20 AS bx, 0.5 * y2 - 10 AS by_ FROM dets), c AS (SELECT *, greatest(0, least(ax, 250)) AS x1, greatest(0, least(ay, 90)) AS y1, greatest(0, least(bx, 250)) AS x2, greatest(0, least(by_, 90)) AS y2 FROM a) SELECT det_id, x1, y1, x2, y2 FROM c WHERE x2 - x1 > 2 AND y2 - y1 > 2 AND (x2 - x1) * (y2 - y1) / ((bx - ax) * (by_ - ay) + 1e-16) > 0.2 AND greatest((x2 - x1) / (y2 - y1 + 1e-16), (y2 - y1) / (x2 - x1 + 1e-16)) < 20")
def e7a(spark, sf):
    return s.affine(t.detections(spark, sf), (1.0, 0.5, -20.0, 0.0, 0.5, -10.0), 250.0, 90.0).drop("image_id", "label")


@query("s29_z5_panoptic_ids", f"{W} SELECT det_id, model_id + (det_id % 50) * 1000 AS code, model_id AS category, det_id % 50 AS instance FROM dets WHERE (x2 - x1) * (y2 - y1) >= 5000")
def s29(spark, sf):
    b = F.struct(F.col("det_id").alias("id"), F.col("model_id").alias("category_id"), g.area(g.box()).alias("area"), F.lit(None).cast("int").alias("iscrowd"))
    docs = t.detections(spark, sf).groupBy("image_id").agg(F.collect_list(b).alias("segments_info"))
    seg = readers.panoptic_segments(docs).filter("area >= 5000 and iscrowd = 0").withColumn("code", readers.panoptic_id(F.col("category_id"), F.col("id") % 50))
    parts = readers.panoptic_parts(F.col("code"))
    return seg.select(F.col("id").alias("det_id"), "code", parts["category"].alias("category"), parts["instance"].alias("instance"))


@query("s31_proposals", f"{W}, i AS (SELECT DISTINCT image_id FROM dets) SELECT i.image_id, count(r) AS n, round(coalesce(sum(score), 0), 6) AS total FROM i LEFT JOIN (SELECT image_id, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r FROM dets WHERE model_id = 1) p ON p.image_id = i.image_id AND r <= 2 GROUP BY 1")
def s31(spark, sf):
    d = t.detections(spark, sf)
    got = readers.proposals(d.select("image_id").distinct(), d.filter("model_id = 1"), 2)
    return got.select("image_id", F.size("proposals").cast("long").alias("n"), r6(F.aggregate("proposals", F.lit(0.0), lambda a, p: a + p["score"]), "total"))


@query("s30_z18_file_names", "SELECT page_id, list_extract(string_split(url, '/'), -2) || '/' || list_extract(string_split(url, '/'), -1) AS by_url, right('COCO_' || printf('%016d', page_id), 16) AS by_name FROM pages")
def s30(spark, sf):
    name = F.concat(F.lit("COCO_"), F.lpad(F.col("page_id").cast("string"), 16, "0"))
    return read(spark, sf, "pages").select("page_id", readers.file_name(name, F.col("url")).alias("by_url"), readers.file_name(name).alias("by_name"))


FINE = {"indoor": ["home", "office"], "outdoor": ["urban", "rural", "aquatic"]}


@query("x21_x22_landmarks", "WITH w AS (SELECT page_id, (page_id % 5) AS k FROM pages), q AS (SELECT page_id, CASE k WHEN 0 THEN 'INDOOR office' WHEN 1 THEN 'an Outdoor, Rural scene' WHEN 2 THEN 'outdoor' WHEN 3 THEN 'urban' ELSE 'Indoor aquatic' END AS said FROM w) SELECT page_id, CASE WHEN lower(said) LIKE '%indoor%' THEN 'indoor' WHEN lower(said) LIKE '%outdoor%' THEN 'outdoor' ELSE 'none' END AS main, CASE said WHEN 'INDOOR office' THEN 'office' WHEN 'an Outdoor, Rural scene' THEN 'rural' ELSE 'none' END AS fine, CASE WHEN lower(said) LIKE '%indoor%' THEN 'Which kind of indoor is it: home, office?' WHEN lower(said) LIKE '%outdoor%' THEN 'Which kind of outdoor is it: urban, rural, aquatic?' END AS prompt FROM q")
def x21_x22(spark, sf):
    said = F.get(F.array(*(F.lit(v) for v in ("INDOOR office", "an Outdoor, Rural scene", "outdoor", "urban", "Indoor aquatic"))), (F.col("page_id") % 5).cast("int"))
    got = s.landmark(said, FINE)
    return read(spark, sf, "pages").select("page_id", got["main"].alias("main"), got["fine"].alias("fine"), s.option_prompt(got["main"], FINE).alias("prompt"))


@query("x29_scene_json_lines", f"{W} SELECT image_id, md5(string_agg('{{\"id\":' || CAST(det_id AS VARCHAR) || ',\"label\":\"' || label || '\"}}', chr(10) ORDER BY det_id) || chr(10) || '{{\"phrase\":\"all\",\"object_ids\":[' || string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY det_id) || ']}}') AS digest FROM dets GROUP BY 1")
def x29(spark, sf):
    d = t.detections(spark, sf)
    objects = d.select("image_id", F.col("det_id").alias("pos"), F.col("det_id").alias("id"), "label")
    relations = d.groupBy("image_id").agg(F.sort_array(F.collect_list("det_id")).alias("object_ids")).select("image_id", F.lit(0).cast("long").alias("pos"), F.lit("all").alias("phrase"), "object_ids")
    return s.scene_lines(objects, relations).select("image_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("x31_x33_prompts", r"SELECT conv_id, turn, md5('Do so.' || chr(10) || chr(10) || 'Input: a' || chr(10) || 'Output: b' || chr(10) || chr(10) || 'Input: ' || text || chr(10) || 'Output:') AS digest, contains(text, '###') OR contains(text, 'the') AS stopped FROM conversations")
def x31(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(s.few_shot([("a", "b")], "Do so.", F.col("text")).cast("binary")).alias("digest"), s.stopped(F.col("text"), ["###", "the"]).alias("stopped"))
