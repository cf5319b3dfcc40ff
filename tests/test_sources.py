import json
import struct

import numpy as np
from pyspark.sql import functions as F
from scenequarry.sources import readers, writers
from scenequarry.streaming import streams


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"a.jpg": {"m": [{"bbox": [0, 1, 2, 3], "score": 0.5, "label": "x"}, {"bbox": [1, 1, 2, 2], "score": 0.2, "description": "d"}]}}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"c.jpg": {"other": []}}))
    got = readers.documents(spark, str(tmp_path), "m").orderBy("pos").collect()
    assert [(r.image_id, r.pos, r.x2, r.label) for r in got] == [("a", 0, 2.0, "x"), ("a", 1, 2.0, "d")]
    assert {r.image_id for r in readers.listing(spark, str(tmp_path), "*.json").collect()} == {"a", "b", "c"}


def test_coco(spark, tmp_path):
    ann = [{"id": 1, "image_id": 7, "category_id": 3, "bbox": [1, 2, 30, 40], "area": 1200, "iscrowd": 0}, {"id": 2, "image_id": 7, "category_id": 9, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 0}, {"id": 3, "image_id": 7, "category_id": 3, "bbox": [500, 2, 3, 4], "area": 12, "iscrowd": 1}]
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 7, "file_name": "7.jpg", "width": 100, "height": 90}], "annotations": ann, "categories": [{"id": 3, "name": "cat"}]}))
    t = readers.coco(spark, str(tmp_path / "c.json"))
    ok = readers.valid_annotations(t["annotations"], t["images"], t["categories"]).collect()
    assert [(r.id, r.label, r.x2, r.ignore) for r in ok] == [(1, 0, 31.0, False)]
    assert readers.repeated_ids(t["annotations"]).count() == 0


def test_text_formats(spark, tmp_path):
    (tmp_path / "v.xml").write_text("<annotation><filename>v.jpg</filename><object><name>dog</name><difficult>1</difficult><bndbox><xmin>11</xmin><ymin>21</ymin><xmax>31</xmax><ymax>41</ymax></bndbox></object><object><name>cat</name><difficult>0</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert [(r.image_id, r.name, r.x1, r.ignore) for r in readers.voc(spark, str(tmp_path / "v.xml")).collect()] == [("v", "dog", 10.0, True), ("v", "cat", 0.0, False)]
    (tmp_path / "o.csv").write_text("ImageID,Source,LabelName,Confidence,XMin,XMax,YMin,YMax,a,b,c,d,e\ni,s,/m/1,1,0.1,0.5,0.2,0.6,0,0,1,0,0\n")
    r = readers.csv_boxes(spark, str(tmp_path / "o.csv")).first()
    assert (r.x1, r.y1, r.x2, r.y2, r.is_group) == (0.1, 0.2, 0.5, 0.6, True)
    (tmp_path / "t.txt").write_text("img_a\nskip me 1\n2\n1 0.1 0.2 0.3 0.4 0\n2 0.5 0.5 0.6 0.6 1\n")
    assert [(r.image_id, r.label, r.is_group) for r in readers.text_blocks(spark, str(tmp_path / "t.txt")).collect()] == [("img_a", 0, False), ("img_a", 1, True)]
    (tmp_path / "l.txt").write_text("one\n\n two\n")
    assert [r.value for r in readers.split_list(spark, str(tmp_path / "l.txt"), 1).collect()] == ["one"]


def test_depth_files(spark, tmp_path):
    x = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "d.pfm").write_bytes(b"Pf\n3 2\n-1.0\n" + x[::-1].tobytes())
    (tmp_path / "bad.pfm").write_bytes(struct.pack("<i", 5))
    got = readers.pfm(spark, str(tmp_path)).collect()
    assert [(r.image_id, r.height, r.width, r["values"]) for r in got] == [("d", 2, 3, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])]
    r = spark.range(1).select(*readers.depth_range(F.lit("p/sa_1_min_0.5_max_12.25.jpg")), readers.depth_key(F.lit("p/sa_1_min_0.5_max_12.25.jpg")).alias("k")).first()
    assert tuple(r) == (0.5, 12.25, "sa_1.jpg")


def test_key_value_round_trip(spark, tmp_path):
    df = spark.range(100).select(F.format_string("k%03d", "id").alias("image_id"), (F.col("id") * 2).alias("v"))
    writers.key_value(df, str(tmp_path / "kv"), buckets=4)
    assert [json.loads(r.value) for r in writers.lookup(spark, str(tmp_path / "kv"), ["k007"]).collect()] == [{"v": 14}]
    writers.keys(df, str(tmp_path / "keys"))
    assert spark.read.text(str(tmp_path / "keys")).count() == 100


def test_incremental_reads_files_once(spark, tmp_path):
    land, out, cp = (str(tmp_path / n) for n in ("land", "out", "cp"))
    run = lambda: streams.incremental(spark, land, "id long", out, cp, lambda s: s.withColumn("twice", F.col("id") * 2))
    spark.range(5).write.parquet(land)
    run()
    spark.range(5, 8).write.mode("append").parquet(land)
    run()
    run()
    assert sorted(r.twice for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8, 10, 12, 14]


def test_chat_history_and_windows(spark, tmp_path):
    land = str(tmp_path / "turns")
    spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (1, 2, "d")], "conv_id long, turn long, text string").coalesce(1).write.parquet(land)
    q = streams.chat_history(spark.readStream.schema("conv_id long, turn long, text string").parquet(land), "conv_id", "text", 2).writeStream.format("memory").queryName("chat").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {(r.conv_id, r.turn, r.history) for r in spark.table("chat").collect()} == {(1, 3, "b\nd"), (2, 1, "c")}
    ev = str(tmp_path / "ev")
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' ts, 1.0D value union all select timestamp_ntz'2024-01-01 05:00:00', 2.0D").coalesce(1).write.parquet(ev)
    w = streams.windowed(streams.events(spark, ev, "ts timestamp_ntz, value double"), "1 hour")
    q = w.writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("win").count() == 1


def test_further_loaders(spark, tmp_path):
    ann = [{"id": 1, "image_id": 7, "bbox": [1, 2, 30, 40], "caption": " a dog "}, {"id": 2, "image_id": 7, "bbox": [1, 2, 3, 4]}]
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 7, "file_name": "7.jpg", "width": 100, "height": 90, "caption": "whole"}], "annotations": ann, "categories": []}))
    got = readers.region_captions(readers.coco(spark, str(tmp_path / "c.json"))).orderBy("ann_id").collect()
    assert [(r.caption, r.x2) for r in got] == [("a dog", 31.0), ("whole", 4.0)]
    (tmp_path / "l.csv").write_text("ImageID,Source,LabelName,Confidence\ni,v,/m/1,1\ni,v,/m/2,0\nj,v,/m/9,1\n")
    classes = spark.createDataFrame([("/m/1", 0), ("/m/2", 1)], "name string, label int")
    labels = readers.image_labels(spark, str(tmp_path / "l.csv"), classes)
    images = spark.createDataFrame([("i",), ("k",)], "image_id string")
    assert {r.image_id: [tuple(x) for x in r.labels] for r in readers.with_labels(images, labels).collect()} == {"i": [(0, 1.0), (1, 0.0)], "k": []}
    (tmp_path / "sam").mkdir()
    (tmp_path / "sam" / "sa_1.json").write_text(json.dumps({"annotations": [{"bbox": [1, 2, 3, 4], "segmentation": {"size": [9, 9], "counts": "abc"}}]}))
    (tmp_path / "sam" / "sa_2.json").write_text("")
    assert [(r.image_id, r.x2, r.y2, r.counts) for r in readers.segment_annotations(spark, str(tmp_path / "sam")).collect()] == [("sa_1", 4.0, 6.0, "abc")]
    (tmp_path / "res").mkdir()
    for n, v in (("a", 1), ("b", 2), ("merged", 3)):
        (tmp_path / "res" / f"{n}.json").write_text(json.dumps([{"v": v}]))
    assert sorted(r.v for r in readers.result_shards(spark, str(tmp_path / "res"), "v int").collect()) == [1, 2]


def test_predictions_with_and_without_the_image_around(spark):
    body = {"caption": "c", "phrases": ["p"], "pred_masks": [{"size": [2, 2], "counts": "04"}]}
    docs = spark.createDataFrame([("a", json.dumps(body)), ("b", json.dumps({"b.jpg": body})), ("x", "{bad"), ("n", None)], "image_id string, doc string")
    caps, masks = readers.predictions(docs)
    assert {(r.image_id, r.caption) for r in caps.collect()} == {("a", "c"), ("b", "c")} and masks.count() == 2


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    got = {(r.ancestor, r.node) for r in readers.closure(edges).collect()}
    assert got == {(x, y) for x in "abc" for y in "abcd"} | {("d", "d")}
