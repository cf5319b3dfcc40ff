"""Readers of annotation formats into tables with fixed schemas; files are listed, read and parsed by Spark.

Malformed documents give null rows or are left out, as each docstring says; they never fail a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DETECTION = "struct<bbox:array<double>,score:double,label:string,description:string,sam_mask:struct<size:array<int>,counts:string>>"
DOCUMENT = f"map<string,map<string,array<{DETECTION}>>>"
COCO = "info string, images array<struct<id:long,file_name:string,width:int,height:int,coco_url:string,caption:string>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int,caption:string,segmentation:string>>, categories array<struct<id:long,name:string,supercategory:string>>"


def stem(path: Column) -> Column:
    """The file's name without folder and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def listing(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """image_id of each file; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(stem(F.col("path")).alias("image_id"))


def documents(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """Long detections of a model from one JSON document per image: {image: {model: [detection]}}.

    A document that doesn't parse, or has no entry for the model, gives no rows. `description` stands in for a label.
    """
    raw = spark.read.text(folder, wholetext=True).select(F.from_json("value", DOCUMENT).alias("doc")).filter("doc is not null")
    each = raw.select(F.explode("doc").alias("image", "models")).select(F.regexp_replace("image", r"\.jpg$", "").alias("image_id"), F.posexplode(F.element_at("models", F.lit(model))).alias("pos", "d"))
    b = F.col("d.bbox")
    return each.select("image_id", F.lit(model).alias("model"), "pos", *(F.get(b, i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), "d.score", F.coalesce("d.description", "d.label").alias("label"), "d.sam_mask")


def coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations (with corners beside the box) and categories (with a running label) of a COCO file."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    a = doc.select(F.explode("annotations").alias("a")).select("a.*")
    box = [F.get("bbox", i) for i in range(4)]
    a = a.withColumns({"x1": box[0], "y1": box[1], "x2": box[0] + box[2], "y2": box[1] + box[3]})
    cats = doc.select(F.posexplode("categories").alias("label", "c")).select("label", "c.*")
    return {"images": doc.select(F.explode("images").alias("i")).select("i.*"), "annotations": a, "categories": cats}


def repeated_ids(annotations: DataFrame, key: str = "id") -> DataFrame:
    """Ids that occur more than once, which a well-formed file has none of."""
    return annotations.groupBy(key).count().filter("count > 1")


def valid_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame, least: float = 1.0) -> DataFrame:
    """Annotations of known categories that meet their image and aren't too small; crowd ones are marked ignored."""
    size = images.select(F.col("id").alias("image_id"), "width", "height")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    meets = (F.least("x2", "width") > F.greatest("x1", F.lit(0.0))) & (F.least("y2", "height") > F.greatest("y1", F.lit(0.0)))
    known = F.broadcast(categories.select(F.col("id").alias("category_id"), "label"))
    return annotations.join(size, "image_id").join(known, "category_id").filter(meets & (F.col("area") > 0) & (w >= least) & (h >= least)).withColumn("ignore", F.coalesce(F.col("iscrowd") == 1, F.lit(False)))


def voc(spark: SparkSession, folder: str, least: int = 0) -> DataFrame:
    """image_id, name, corners less one, ignore of each object in one XML file per image; difficult or small ones are ignored."""
    schema = "filename string, size struct<width:int,height:int>, object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    raw = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(folder)
    o = raw.select(stem(F.col("filename")).alias("image_id"), F.explode("object").alias("o"))
    b = [F.col(f"o.bndbox.{c}") - 1 for c in ("xmin", "ymin", "xmax", "ymax")]
    small = (b[2] - b[0] < least) | (b[3] - b[1] < least)
    return o.select("image_id", "o.name", *(c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)), (small | (F.col("o.difficult") == 1)).alias("ignore"))


def csv_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of an open-images CSV: image, class and relative corners, with the flags that follow."""
    raw = spark.read.option("header", True).csv(path)
    c = raw.columns
    flags = {n: F.col(x).cast("int").cast("boolean") for n, x in zip(("occluded", "truncated", "is_group", "depiction", "inside"), c[8:13], strict=False)}
    return raw.select(F.col(c[0]).alias("image_id"), F.col(c[2]).alias("label"), F.col(c[4]).cast("double").alias("x1"), F.col(c[6]).cast("double").alias("y1"), F.col(c[5]).cast("double").alias("x2"), F.col(c[7]).cast("double").alias("y2"), *(v.alias(k) for k, v in flags.items()))


def text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of block text files: a name line, a skipped line, a count, then as many rows of label (from 1), corners, group."""
    lines = spark.read.text(folder, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"), F.xxhash64("value").alias("file")).filter(F.trim("line") != "")
    w = Window.partitionBy("file").orderBy("pos")
    t = F.split(F.trim("line"), r"\s+")
    name = F.when(F.size(t) == 1, F.when(~F.col("line").rlike(r"^\s*\d+\s*$"), F.trim("line")))
    rows = lines.withColumn("image_id", F.last(name, ignorenulls=True).over(w)).withColumn("t", t).filter(F.size("t") == 6)
    n = lambda i: F.get("t", F.lit(i)).cast("double")
    return rows.select("image_id", (n(0).cast("int") - 1).alias("label"), n(1).alias("x1"), n(2).alias("y1"), n(3).alias("x2"), n(4).alias("y2"), (n(5) == 1).alias("is_group"))


def class_names(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """label, name from class lists: `json` of [name] or {label, readable}, `colon` lines "id: name", `pair` lines "obj:part"."""
    if shape == "json":
        return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("label", "name"))
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("label", "line")).filter(F.trim("line") != "")
    if shape == "colon":
        return lines.select(F.trim(F.split_part("line", F.lit(":"), F.lit(1))).cast("int").alias("label"), F.trim(F.split_part("line", F.lit(":"), F.lit(2))).alias("name"))
    return lines.select("label", F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("name"), F.nullif(F.trim(F.split_part("line", F.lit(":"), F.lit(2))), F.lit("")).alias("part"))


def split_list(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """pos and value of the lines that aren't blank, the first `most` of them where a cap is asked."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value")).filter(F.trim("value") != "")
    return lines if most is None else lines.orderBy("pos").limit(most)


def side_texts(spark: SparkSession, folder: str) -> DataFrame:
    """image_id and the trimmed text of one file per image."""
    return spark.read.text(folder, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("image_id"), F.trim("value").alias("text"))


def instructions(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, turn, role, text, image of a JSON list of {id, image, conversations: [{from, value}]}."""
    raw = spark.read.schema("id string, image string, conversations array<struct<`from`:string,value:string>>").json(path, multiLine=True)
    return raw.select(F.col("id").alias("conv_id"), "image", F.posexplode("conversations").alias("turn", "t")).select("conv_id", "turn", F.col("t.from").alias("role"), F.col("t.value").alias("text"), "image")


def refer(refs: DataFrame, annotations: DataFrame) -> dict[str, DataFrame]:
    """The tables of a referring-expression set from refs (ref_id, image_id, ann_id array, category_id, split, sentences).

    -1 among annotation ids means that nothing is referred to; such rows keep a null annotation.
    """
    each = refs.select("ref_id", "image_id", "split", F.explode("ann_id").alias("ann_id"))
    ann = each.join(annotations.withColumnRenamed("id", "ann_id").drop("image_id"), "ann_id", "left")
    return {"refs": refs.select("ref_id", "image_id", "split"), "sentences": refs.select("ref_id", F.posexplode("sentences").alias("pos", "sentence")), "targets": ann}


def split_filter(split: Column, asked: str) -> Column:
    """testA and the like by the last letter, test by substring, others by equality."""
    if asked in ("testA", "testB", "testC"):
        return split.contains(asked[-1])
    return split.contains("test") if asked == "test" else split == asked


def closure(edges: DataFrame) -> DataFrame:
    """ancestor, node of all pairs that (parent, child) edges connect, each node being its own ancestor.

    Each round joins pairs with pairs, which doubles the length of what they span, and ends when no pair is new, so that
    cycles do no harm.
    """
    from ..plans.tables import cut

    own = edges.select(F.col("parent").alias("ancestor"), F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("ancestor"), F.col("child").alias("node")))
    pairs, n = cut(own.unionByName(edges.toDF("ancestor", "node")).distinct()), -1
    while pairs.count() > n:
        n = pairs.count()
        step = pairs.select(F.col("ancestor"), F.col("node").alias("via")).join(pairs.select(F.col("ancestor").alias("via"), "node"), "via")
        pairs = cut(step.select("ancestor", "node").distinct())
    return pairs


def depth_range(path: Column) -> list[Column]:
    """The least and greatest depth that a quantised depth map's name holds."""
    return [F.regexp_extract(path, rf"_{n}_(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)", 1).cast("double").alias(n) for n in ("min", "max")]


def depth_key(path: Column) -> Column:
    """The image of a depth map: the first two parts of its name."""
    return F.concat(F.array_join(F.slice(F.split(stem(path), "_"), 1, 2), "_"), F.lit(".jpg"))


def pfm(spark: SparkSession, folder: str) -> DataFrame:
    """image_id, height, width, values (row by row from the top) of PFM rasters; a file that isn't one gives no row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfm").load(folder).select(stem(F.col("path")).alias("image_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = [(k, *x) for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (x := parse_pfm(data))]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.float32()))], ["image_id", "height", "width", "values"])

    return raw.mapInArrow(run, "image_id string, height int, width int, values array<float>")


def parse_pfm(data: bytes) -> tuple[int, int, np.ndarray] | None:
    """Height, width and values of a one-channel PFM; the scale's sign tells the byte order."""
    parts = data.split(b"\n", 3)
    if len(parts) < 4 or parts[0].strip() != b"Pf":
        return None
    try:
        w, h = map(int, parts[1].split())
        x = np.frombuffer(parts[3], "<f4" if float(parts[2]) < 0 else ">f4", w * h)
    except ValueError:
        return None
    return h, w, x.reshape(h, w)[::-1].ravel().astype(np.float32)


PREDICTION = "struct<caption:string,phrases:array<string>,pred_masks:array<struct<size:array<int>,counts:string>>>"


def predictions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image_id, caption, labels) and (image_id, category_id, segmentation, score) of grounded-caption predictions.

    docs: image_id, doc, a JSON text {image: {caption, phrases, pred_masks}}, or the inner part alone. Masks have score 1
    and category 1; a document that doesn't parse gives no row.
    """
    bare = F.from_json("doc", PREDICTION)
    wrapped = F.get(F.map_values(F.from_json("doc", f"map<string,{PREDICTION}>")), 0)
    p = F.when(bare["caption"].isNotNull(), bare).otherwise(wrapped)
    rows = docs.select("image_id", p.alias("p")).filter("p.caption is not null")
    masks = rows.select("image_id", F.explode("p.pred_masks").alias("segmentation")).select("image_id", F.lit(1).alias("category_id"), "segmentation", F.lit(1.0).alias("score"))
    return rows.select("image_id", "p.caption", F.col("p.phrases").alias("labels")), masks


def region_captions(tables: dict[str, DataFrame]) -> DataFrame:
    """image_id, file_name, caption, ann_id and corners of each region of a COCO file whose images carry captions; the
    region's own caption comes first."""
    images = tables["images"].select(F.col("id").alias("image_id"), "file_name", F.col("caption").alias("__whole"))
    a = tables["annotations"].select(F.col("id").alias("ann_id"), "image_id", F.col("caption").alias("__own"), "x1", "y1", "x2", "y2")
    return a.join(images, "image_id").select("image_id", "file_name", F.trim(F.coalesce("__own", "__whole")).alias("caption"), "ann_id", "x1", "y1", "x2", "y2")


def image_labels(spark: SparkSession, path: str, classes: DataFrame) -> DataFrame:
    """image_id, labels: (label, confidence) of a CSV of ImageID, Source, LabelName, Confidence; classes (name, label)."""
    raw = spark.read.option("header", True).csv(path)
    c = raw.columns
    rows = raw.select(F.col(c[0]).alias("image_id"), F.col(c[2]).alias("name"), F.col(c[3]).cast("double").alias("confidence")).join(classes, "name")
    return rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("label", "confidence"))).alias("labels"))


def with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """images with their labels, an empty array where there are none."""
    kind = labels.schema["labels"].dataType
    return images.join(labels, "image_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast(kind)))


def segment_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """image_id, corners, size and counts of mask annotations, one JSON document per image."""
    schema = "annotations array<struct<bbox:array<double>,segmentation:struct<size:array<int>,counts:string>>>"
    raw = spark.read.text(folder, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("image_id"), F.from_json("value", schema).alias("d"))
    a = raw.select("image_id", F.posexplode("d.annotations").alias("pos", "a"))
    b = [F.get("a.bbox", i) for i in range(4)]
    return a.select("image_id", "pos", b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"), "a.segmentation.size", "a.segmentation.counts")


def result_shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all JSON result files of a folder but the merged one."""
    files = spark.read.schema(schema).option("multiLine", True).json(folder).select("*", F.col("_metadata.file_name").alias("__f"))
    return files.filter("__f <> 'merged.json'").drop("__f")


def proposals(images: DataFrame, boxes: DataFrame, most: int) -> DataFrame:
    """images with their `most` best scored proposals as an array, empty without any."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    top = boxes.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most)
    each = top.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("__r").alias("r"), "x1", "y1", "x2", "y2", "score"))).alias("proposals"))
    out = images.join(each, "image_id", "left")
    return out.withColumn("proposals", F.coalesce("proposals", F.array().cast(each.schema["proposals"].dataType)))


#: Fixed value: the step between instances of a class in encoded panoptic ids.
INSTANCE_OFFSET = 1000


def panoptic_segments(docs: DataFrame) -> DataFrame:
    """image_id, id, category_id, area, iscrowd of panoptic annotations: docs (image_id, segments_info)."""
    return docs.select("image_id", F.explode("segments_info").alias("s")).select("image_id", "s.id", "s.category_id", "s.area", F.coalesce(F.col("s.iscrowd"), F.lit(0)).alias("iscrowd"))


def panoptic_id(category: Column, instance: Column) -> Column:
    return category + instance * INSTANCE_OFFSET


def panoptic_parts(code: Column) -> dict[str, Column]:
    return {"category": code % INSTANCE_OFFSET, "instance": F.floor(code / INSTANCE_OFFSET)}


def file_name(name: Column, url: Column | None = None) -> Column:
    """A file's name in an image folder: the last two parts of its address where it has one, else the name without a
    data set's prefix, which are its last 16 characters."""
    short = F.when(name.startswith("COCO"), F.right(name, F.lit(16))).otherwise(name)
    return short if url is None else F.coalesce(F.substring_index(url, "/", -2), short)
