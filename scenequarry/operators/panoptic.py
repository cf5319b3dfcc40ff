"""Panoptic evaluation from runs, without pixels.

A side is a table of runs (by, label, start, end) that don't overlap within an image: a segmentation of part of it. Both
sides are swept together over the sorted boundaries of an image, which gives the shared pixels of every pair of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_runs(pixels: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """by, label, start, end of each run of equal labels in order; pixels without a label are part of no run."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = pixels.withColumn("__at", F.row_number().over(w) - 1).withColumn("__new", F.when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col(label).isNotNull())
    each = rows.groupBy(*by, "__run", F.col(label).alias("label")).agg(F.min("__at").cast("long").alias("start"), (F.max("__at") + 1).cast("long").alias("end"))
    return each.select(*by, "label", "start", "end")


def swept(truths: DataFrame, preds: DataFrame, by: list[str]) -> DataFrame:
    """by, gt, pred, pixels: shared pixels of each pair of segments; null on one side is what that side leaves out.

    At a boundary a run that begins wins over one that ends there, so between two boundaries each side has one segment.
    """

    def events(runs: DataFrame, side: str) -> DataFrame:
        both = F.array(F.struct(F.col("start").alias("pos"), F.col("label").alias("label"), F.lit(True).alias("begins")), F.struct(F.col("end").alias("pos"), F.lit(None).cast(runs.schema["label"].dataType).alias("label"), F.lit(False).alias("begins")))
        at = runs.filter("end > start").select(*by, F.explode(both).alias("e")).groupBy(*by, "e.pos").agg(F.max_by("e.label", "e.begins").alias("label"))
        return at.select(*by, "pos", F.struct("label").alias(side))

    at = events(truths, "gt").join(events(preds, "pred"), [*by, "pos"], "full_outer")
    w = Window.partitionBy(*by).orderBy("pos")
    now = lambda side: F.last(side, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["label"].alias(side)
    spans = at.select(*by, now("gt"), now("pred"), (F.lead("pos").over(w) - F.col("pos")).alias("pixels"))
    return spans.filter("pixels is not null and (gt is not null or pred is not null)").groupBy(*by, "gt", "pred").agg(F.sum("pixels").alias("pixels"))


def report(shared: DataFrame, by: list[str], category: Column, things: Column) -> DataFrame:
    """part, pq, sq, rq, tp, fp, fn, n for each category and for things, stuff and all, as means over categories.

    shared: by, gt, pred, pixels as from `swept`. category and things are expressions of a column `segment`. A predicted
    and a true segment of one category match over an overlap of a half, what the truth leaves out not counting; a
    prediction that lies by over a half where the truth leaves out is no false one. Categories without segments don't count.
    """
    own = F.sum(F.when(F.col("gt").isNull(), F.col("pixels")).otherwise(0))
    truth = shared.filter("gt is not null").groupBy(*by, F.col("gt").alias("segment")).agg(F.sum("pixels").alias("gt_area"))
    pred = shared.filter("pred is not null").groupBy(*by, F.col("pred").alias("segment")).agg(F.sum("pixels").alias("pred_area"), own.alias("left_out"))
    named = lambda rows, name: rows.withColumn("cat", category).withColumn("isthing", things).withColumnRenamed("segment", name)
    truth, pred = named(truth, "gt"), named(pred, "pred")
    pairs = shared.join(truth, [*by, "gt"]).join(pred.withColumnsRenamed({"cat": "pred_cat", "isthing": "__t"}), [*by, "pred"]).filter("cat = pred_cat")
    iou = F.col("pixels") / (F.col("gt_area") + F.col("pred_area") - F.col("left_out") - F.col("pixels"))
    hit = pairs.withColumn("iou", iou).filter("iou > 0.5").select(*by, "gt", "pred", "iou")
    t = truth.join(hit, [*by, "gt"], "left").select("cat", "isthing", "iou", F.when(F.col("iou").isNull(), 1).otherwise(0).alias("fn"), F.lit(0).alias("fp"))
    p = pred.join(hit.select(*by, "pred"), [*by, "pred"], "left_anti").filter("left_out * 2 <= pred_area").select("cat", "isthing", F.lit(None).cast("double").alias("iou"), F.lit(0).alias("fn"), F.lit(1).alias("fp"))
    cats = t.unionByName(p).groupBy("cat", "isthing").agg(F.count("iou").alias("tp"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("iou"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    half = F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    each = cats.withColumns({"pq": F.col("iou") / half, "sq": F.when(F.col("tp") > 0, F.col("iou") / F.col("tp")).otherwise(0.0), "rq": F.col("tp") / half})
    sets = each.groupingSets([["cat"], ["isthing"], []], "cat", "isthing")
    got = sets.agg(F.grouping("cat").alias("__c"), F.grouping("isthing").alias("__t"), *(F.avg(c).alias(c) for c in ("pq", "sq", "rq")), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count(F.lit(1)).alias("n"))
    part = F.when(F.col("__c") == 0, F.col("cat")).when(F.col("__t") == 1, "all").when(F.col("isthing"), "things").otherwise("stuff")
    return got.select(part.alias("part"), "pq", "sq", "rq", "tp", "fp", "fn", "n")
