"""Evaluators of data sets with partial labels or class trees, and small steps of reading and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def federated(dets: DataFrame, truths: DataFrame, negatives: DataFrame) -> DataFrame:
    """Detections of labels that their image is known to have (truths) or to lack (negatives: image_id, label); others
    can't be judged."""
    judged = truths.select("image_id", "label").unionByName(negatives.select("image_id", "label")).distinct()
    return dets.join(judged, ["image_id", "label"], "left_semi")


def lenient(hits: DataFrame, partial: DataFrame) -> DataFrame:
    """hits in which a miss doesn't count where an image's boxes of a label aren't all marked (partial: image_id, label)."""
    out = hits.join(partial.select("image_id", "label").distinct().withColumn("__p", F.lit(True)), ["image_id", "label"], "left")
    return out.withColumn("fp", F.when(F.col("__p"), 0).otherwise(F.col("fp"))).drop("__p")


def frequency_groups(truths: DataFrame, rare: int = 10, common: int = 100) -> DataFrame:
    """label, frequency: r, c or f by the number of images that have the label."""
    n = truths.groupBy("label").agg(F.countDistinct("image_id").alias("n"))
    return n.select("label", F.when(F.col("n") <= rare, "r").when(F.col("n") <= common, "c").otherwise("f").alias("frequency"))


def with_ancestors(rows: DataFrame, closure: DataFrame) -> DataFrame:
    """Each row once for every ancestor of its label (closure: ancestor, node, nodes being their own); a label outside the
    tree stays as it is."""
    up = closure.select(F.col("ancestor").alias("__up"), F.col("node").alias("label"))
    return rows.join(up, "label", "left").withColumn("label", F.coalesce("__up", "label")).drop("__up").select(*rows.columns)


def ancestors(rows: DataFrame, closure: DataFrame) -> DataFrame:
    """rows with an array of labels, the ancestors that with_ancestors gives a row each. A class tree is small by its nature."""
    up = closure.groupBy(F.col("node").alias("label")).agg(F.collect_list(F.coalesce("ancestor", "node")).alias("__up"))
    return rows.join(F.broadcast(up), "label", "left").withColumn("label", F.coalesce("__up", F.array("label"))).select(*rows.columns)


def instance_report(ap: DataFrame, label: str = "label", limit: str = "limit") -> DataFrame:
    """label, ap, ap50: means over all limits and at 0.5, for each label and as `all`; ap (label, limit, ap)."""
    half = F.avg(F.when(F.abs(F.col(limit) - 0.5) < 1e-9, F.col("ap")))
    out = ap.rollup(label).agg(F.avg("ap").alias("__ap"), half.alias("ap50"), F.grouping(label).alias("__all"))
    return out.select(F.when(F.col("__all") == 1, "all").otherwise(F.col(label)).alias(label), F.col("__ap").alias("ap"), "ap50")


def top_classes(logits: Column, names: list[str], k: int) -> Column:
    """The k best classes as (share, name), the shares being those of a soft-max; of equal ones the earlier class is better."""
    top = F.array_max(logits)
    parts = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    each = F.transform(parts, lambda v, i: F.struct((-v / total).alias("s"), i.alias("i")))
    of = F.array(*(F.lit(n) for n in names))
    return F.transform(F.slice(F.array_sort(each), 1, k), lambda e: F.struct((-e["s"]).alias("share"), F.get(of, e["i"]).alias("name")))


def labels_of(truths: DataFrame, image_labels: DataFrame) -> DataFrame:
    """image_id, labels: the different labels of an image's boxes and of the image itself, in order."""
    both = truths.select("image_id", "label").unionByName(image_labels.select("image_id", "label"))
    return both.distinct().groupBy("image_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))


def spaced(name: Column) -> Column:
    """Words of a class name."""
    return F.replace(name, F.lit("_"), F.lit(" "))


def model_name(path: Column) -> Column:
    """The last part of a model's path; a checkpoint is named after the part before as well."""
    parts = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when(last.startswith("checkpoint-") & (F.size(parts) > 1), F.concat(F.get(parts, F.size(parts) - 2), F.lit("_"), last)).otherwise(last)


def span_in_lower(caption: Column, phrase: Column) -> Column:
    """(start, end) of a phrase, case as given, in the lower-cased caption; a start of -1 where it isn't found."""
    start = (F.instr(F.lower(caption), phrase) - 1).cast("long")
    return F.struct(start.alias("start"), (start + F.length(phrase)).alias("end"))


def denormalized(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes in shares of their image's sides as pixels (sizes: image_id, width, height); an image without a size has no row."""
    b = g.scaled(g.box(), F.col("__w"), F.col("__h"))
    rest = [c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")]
    return boxes.join(sizes.select("image_id", F.col("width").alias("__w"), F.col("height").alias("__h")), "image_id").select(*rest, *g.columns(b))


def region_label(caption: Column, spans: Column) -> Column:
    """The part of a caption that the first of a region's spans (start, end) names; null without spans."""
    first = F.get(spans, 0)
    return F.substring(caption, first["start"].cast("int") + 1, (first["end"] - first["start"]).cast("int"))


def images_with_class(images: DataFrame, objects: DataFrame, wanted: list[str], least: int) -> DataFrame:
    """Images of `least` pixels a side or more that have an object of a wanted class."""
    some = objects.filter(F.col("label").isin(wanted)).select("image_id").distinct()
    return images.filter(F.least("width", "height") >= least).join(some, "image_id", "left_semi")


def side_buckets(b: g.Box, n: int = 14, scale: float = 1.7) -> dict[str, Column]:
    """The middles of the buckets that lie along each side of a box widened about its centre: half of n, from outside in."""
    wide = g.about_center(b, scale)
    half = F.sequence(F.lit(0), F.lit((n + 1) // 2 - 1))
    w, h = g.width(wide) / n, g.height(wide) / n
    along = lambda at, step: F.transform(half, lambda i: at + (i + 0.5) * step)
    return {"left": along(wide["x1"], w), "top": along(wide["y1"], h), "right": along(wide["x2"], -w), "bottom": along(wide["y2"], -h)}


def tag_lines(tags: DataFrame) -> DataFrame:
    """image_id, line: an image's name and its tags, comma-joined, in the order pos."""
    each = tags.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tag"))).alias("t"))
    return each.select("image_id", F.concat_ws(",", F.col("image_id").cast("string"), F.transform("t", lambda x: x["tag"])).alias("line"))


def fit_long_edge(w: Column, h: Column, edge: int = 384) -> tuple[Column, Column]:
    """Sizes with the longer side at `edge` and the other cut to a whole number."""
    return F.when(w >= h, edge).otherwise(F.floor(edge * w / h)).cast("int"), F.when(w >= h, F.floor(edge * h / w)).otherwise(edge).cast("int")


def shifted_class(pixel: Column, ignore: int = 255) -> Column:
    """Label-map values that count from 1: 0 is to be ignored."""
    return F.when((pixel == 0) | (pixel == ignore), ignore).otherwise(pixel - 1)


def joint_classes_ignored(pixel: Column, names: list[str], ignore: int = 255) -> Column:
    """Label-map values, those of classes with a hyphen in their name being ignored."""
    return F.when(pixel.isin([i for i, n in enumerate(names) if "-" in n]), ignore).otherwise(pixel)


def reduced(rows: DataFrame, by: list[str], loss: str, weight: str | None = None, kind: str = "mean", avg_factor: str | None = None) -> DataFrame:
    """by..., loss: the weighted sum or mean; with avg_factor a sum over it, which only a mean may have."""
    if avg_factor and kind != "mean":
        raise ValueError("avg_factor goes with the mean")
    each = F.col(loss) * (F.col(weight) if weight else F.lit(1.0))
    out = F.sum(each) / F.max(avg_factor) if avg_factor else F.sum(each) if kind == "sum" else F.avg(each)
    return rows.groupBy(*by).agg(out.alias("loss"))


def all_sampled(assigned: DataFrame) -> DataFrame:
    """Every assigned box as a sample, positive or negative; those to ignore (-1) aren't any."""
    return assigned.filter("gt >= 0").withColumn("positive", F.col("gt") > 0)
