"""Depth of boxes from depth maps.

A depth map is a table of pixels (image keys, x, y, depth) or of square tiles of it; depth 0, null and NaN are unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tiled(pixels: DataFrame, keys: list[str], side: int = 64) -> DataFrame:
    """keys, tx, ty, pixels: the known pixels of each tile, at most side * side in a row."""
    known = pixels.filter((F.col("depth") != 0) & ~F.isnan("depth"))
    place = [F.floor(F.col(c) / side).alias(f"t{c}") for c in "xy"]
    return known.select(*keys, *place, F.struct("x", "y", "depth").alias("p")).groupBy(*keys, "tx", "ty").agg(F.collect_list("p").alias("pixels"))


def in_boxes(tiles: DataFrame, boxes: DataFrame, keys: list[str], box_id: str, side: int = 64) -> DataFrame:
    """keys, box_id, depth of every known pixel in each box: corners without their fractions, the far ones exclusive.

    A box meets the tiles that it covers, up to the map's last ones; images without a known pixel have no rows.
    """
    last = tiles.groupBy(*keys).agg(F.max("tx").alias("mx"), F.max("ty").alias("my"))
    low = lambda c: F.greatest(F.col(c).cast("long"), F.lit(0)).alias(c)
    b = boxes.select(*keys, box_id, low("x1"), low("y1"), F.col("x2").cast("long").alias("x2"), F.col("y2").cast("long").alias("y2")).join(last, keys)
    span = lambda c: (F.floor(F.col(f"{c}1") / side), F.least(F.floor((F.col(f"{c}2") - 1) / side), F.col(f"m{c}")))
    (ax, bx), (ay, by) = span("x"), span("y")
    b = b.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (ax <= bx) & (ay <= by))
    b = b.select("*", F.explode(F.sequence(ax, bx)).alias("tx")).select("*", F.explode(F.sequence(ay, by)).alias("ty"))
    inside = lambda p: (p["x"] >= F.col("x1")) & (p["x"] < F.col("x2")) & (p["y"] >= F.col("y1")) & (p["y"] < F.col("y2"))
    met = b.join(tiles, [*keys, "tx", "ty"])
    return met.select(*keys, box_id, F.explode(F.filter("pixels", inside)).alias("p")).select(*keys, box_id, F.col("p.depth").cast("double").alias("depth"))


def medians(rows: DataFrame, keys: list[str], value: str, few: int = 65_536, parts: int = 1024) -> DataFrame:
    """keys, value: the exact median of each group, the mean of the two middle values of an even number.

    Equal values are counted first. A group of over `few` different values is narrowed in rounds: its range is cut into
    `parts`, whose sums tell where the wanted place lies, and only that part's values go on. No task sorts more than
    `few` values of a group. Least and largest value fall into different parts, so each round leaves fewer values.
    """
    from ..plans.tables import cut

    counts = cut(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    places = F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))
    left = counts.join(total.select(*keys, F.posexplode(places).alias("half", "place")), keys)
    one = [*keys, "half"]
    while True:
        many = left.groupBy(*one).agg(F.count(F.lit(1)).alias("size"), F.min(value).alias("lo"), F.max(value).alias("hi")).filter(F.col("size") > few)
        if not many.limit(1).count():
            break
        part = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts)
        wide = left.join(many.drop("size"), one).withColumn("part", part)
        sums = wide.groupBy(*one, "place", "part").agg(F.sum("n").alias("here"))
        before = F.sum("here").over(Window.partitionBy(*one).orderBy("part")) - F.col("here")
        chosen = sums.withColumn("before", before).filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("here")))
        narrow = wide.join(chosen.select(*one, "part", "before"), [*one, "part"]).withColumn("place", F.col("place") - F.col("before"))
        left = cut(left.join(many, one, "left_anti").unionByName(narrow.select(left.columns)))
    upto = F.sum("n").over(Window.partitionBy(*one).orderBy(value))
    picked = left.withColumn("upto", upto).filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
    return picked.groupBy(*keys).agg(F.avg(value).alias(value))


def median_depths(tiles: DataFrame, boxes: DataFrame, keys: list[str], box_id: str, side: int = 64) -> DataFrame:
    """keys, box_id, depth: the median of the known depths in each box. Boxes without any have no row."""
    return medians(in_boxes(tiles, boxes, keys, box_id, side), [*keys, box_id], "depth")
