"""Test-time views: an image's boxes and masks at several scales and mirrored, brought back and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import masks
from . import detections

FLIPS = ("", "horizontal", "vertical", "diagonal")


def _mirrored(b: g.Box, w: Column, h: Column) -> g.Box:
    across, down = F.col("flip").isin("horizontal", "diagonal"), F.col("flip").isin("vertical", "diagonal")
    both = g.flipped(b, w, h, "diagonal")
    return g.of(*(F.when(turn, both[f]).otherwise(b[f]) for f, turn in zip(g.FIELDS, (across, down, across, down), strict=True)))


def fan_out(boxes: DataFrame, views: list[tuple[float, str]]) -> DataFrame:
    """Each box as every view shows it, with view, scale and flip; boxes have their image's width and height."""
    if any(f not in FLIPS for _, f in views):
        raise ValueError(f"flips are {FLIPS}")
    each = F.array(*(F.struct(F.lit(i).alias("view"), F.lit(float(s)).alias("scale"), F.lit(f).alias("flip")) for i, (s, f) in enumerate(views)))
    rows = boxes.select("*", F.explode(each).alias("v")).select(*boxes.columns, "v.*")
    s = F.col("scale")
    return rows.withColumns(_mirrored(g.scaled(g.box(), s, s), F.col("width") * s, F.col("height") * s))


def restored(rows: DataFrame) -> DataFrame:
    """Boxes of views as the image has them."""
    s = F.col("scale")
    back = _mirrored(g.box(), F.col("width") * s, F.col("height") * s)
    return rows.withColumns(g.of(*(back[f] / s for f in g.FIELDS)))


def merged_boxes(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """keys, x1..y2, score: the weighted means of restored boxes and of their scores."""
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*keys).agg(*((F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in (*g.FIELDS, "score")))


def merged_proposals(rows: DataFrame, limit: float = 0.7, most: int = 1000) -> DataFrame:
    """The restored proposals of all views in one list by image: suppressed, then the `most` best scored.

    det_id has to tell an image's boxes of all views apart.
    """
    kept = detections.suppress_in_rounds(rows, limit)
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def flipped_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The runs (keys, start, end, width, height, flip) of mirrored masks, cut at columns; twice gives the same pixels."""
    w, h = F.col("width"), F.col("height")
    cut = runs.filter("end > start").select("*", F.explode(F.sequence(F.floor(F.col("start") / h), F.floor((F.col("end") - 1) / h))).alias("c"))
    top, bottom = F.greatest(F.col("start") - F.col("c") * h, F.lit(0)), F.least(F.col("end") - F.col("c") * h, h)
    column = F.when(F.col("flip").isin("horizontal", "diagonal"), w - 1 - F.col("c")).otherwise(F.col("c"))
    down = F.col("flip").isin("vertical", "diagonal")
    place = lambda plain, turned: (column * h + F.when(down, h - turned).otherwise(plain)).cast("long")
    return cut.select(*keys, place(top, bottom).alias("start"), place(bottom, top).alias("end"), "width", "height", "flip")


def votes(runs: DataFrame, keys: list[str], weight: str, total: Column) -> DataFrame:
    """keys, start, end, share: the weighted share of the views in which each stretch of pixels is set, from run ends
    alone. `total` is the weight of all views of a key, those with an empty mask too; it may name columns among keys."""
    ends = runs.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.col(weight).cast("double").alias("w")), F.struct(F.col("end").alias("at"), (-F.col(weight)).cast("double").alias("w")))).alias("e"))
    at = ends.groupBy(*keys, "e.at").agg(F.sum("e.w").alias("w"))
    order = Window.partitionBy(*keys).orderBy("at")
    rows = at.select(*keys, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.round(F.sum("w").over(order) / total, 9).alias("share"))
    return rows.filter("end is not null and share > 0")


def voted(runs: DataFrame, keys: list[str], weight: str, total: Column, over: float = 0.5) -> DataFrame:
    """keys, start, end: the runs of pixels whose share is over a limit."""
    return masks.merged(votes(runs, keys, weight, total).filter(F.col("share") > over).drop("share"), keys)
