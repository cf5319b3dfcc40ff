"""Random crops whose overlap with every box of the image is large enough, drawn by hash, so that they can be told again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

PATCH = ["px1", "py1", "px2", "py2"]


def drawn(seed: int, *parts) -> Column:
    """A number from 0 up to 1 by the hash of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def by_overlap(images: DataFrame, boxes: DataFrame, seed: int = 0, floors: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9), least: float = 0.3, attempts: int = 50, rounds: int = 4) -> DataFrame:
    """image_id, turn, attempt, px1..py2: one patch for each image (image_id, width, height).

    A turn draws either to keep the whole image (attempt -1) or the overlap that each box needs, one of `floors` or none.
    Then the first of its attempts is taken that has sides from `least` of the image's on, a ratio of sides from 1/2 to 2,
    this overlap with each box and a box's centre within; images without boxes need but the ratio. If no attempt is good,
    the next turn draws again; after `rounds` turns the whole image stays (turn null). Only open images go on.

    Attempts are drawn once for an image, before it meets its boxes by a join. Those go before it that the image's extremes
    rule out: a patch beside a box overlaps it by nothing, and overlap is at most the smaller area over the larger.
    """
    from ..plans.tables import cut

    modes = F.array(*(F.lit(float(x)) for x in (1.0, *floors, 0.0)))
    whole = [F.lit(0).cast("long").alias("px1"), F.lit(0).cast("long").alias("py1"), F.floor("width").alias("px2"), F.floor("height").alias("py2")]
    b, box = boxes.select("image_id", g.struct(g.box()).alias("box")), g.box(F.col("box"))
    ends = [F.min(c).alias(f"min_{c}") for c in ("x2", "y2")] + [F.max(c).alias(f"max_{c}") for c in ("x1", "y1")]
    extremes = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("boxes"), *ends, F.min(g.area(g.box())).alias("least_area"), F.max(g.area(g.box())).alias("most_area"))
    spark = images.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda df: cut(df.repartition(tasks, "image_id"))  # noqa: E731  # rows are small but dear, so they aren't put together by size
    left, taken = dealt(images.select("image_id", "width", "height").join(extremes, "image_id", "left")), []
    for turn in range(rounds):
        draw = lambda what, *more: drawn(seed, "image_id", F.lit(turn), F.lit(what), *more)  # noqa: B023, E731
        now = left.withColumn("need", F.get(modes, F.floor(draw("mode") * (len(floors) + 2)).cast("int")))
        kept = now.filter("need = 1").select("image_id", F.lit(-1).alias("attempt"), *whole)
        draws = F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda a: F.struct(a.alias("attempt"), *(draw(c, a).alias(f"d{c}") for c in "whxy")))  # noqa: B023
        each = now.filter("need < 1").select("*", F.explode(draws).alias("d")).select("*", "d.*").drop("d")
        size = lambda c, side: F.col(side) * least + (F.col(side) - F.col(side) * least) * F.col(f"d{c}")
        each = each.withColumns({"w": size("w", "width"), "h": size("h", "height")}).filter((F.col("h") / F.col("w") >= 0.5) & (F.col("h") / F.col("w") <= 2))
        each = each.withColumns({"x": (F.col("width") - F.col("w")) * F.col("dx"), "y": (F.col("height") - F.col("h")) * F.col("dy")})
        each = each.withColumns({"px1": F.floor("x"), "py1": F.floor("y"), "px2": F.floor(F.col("x") + F.col("w")), "py2": F.floor(F.col("y") + F.col("h"))}).filter("px2 > px1 and py2 > py1")
        patch = dict(zip(g.FIELDS, (F.col(c).cast("double") for c in PATCH), strict=True))
        all_met = (patch["x1"] < F.col("min_x2")) & (patch["x2"] > F.col("max_x1")) & (patch["y1"] < F.col("min_y2")) & (patch["y2"] > F.col("max_y1"))
        alike = (F.col("least_area") >= g.area(patch) * F.col("need") * (1 - 1e-9)) & (g.area(patch) >= F.col("most_area") * F.col("need") * (1 - 1e-9))
        open_ = each.filter((F.col("need") <= 0) | (all_met & alike)).filter("boxes is not null").select("image_id", "need", "attempt", *PATCH)
        found = open_.join(b, "image_id").groupBy("image_id", "need", "attempt", *PATCH)
        found = found.agg(F.min(g.iou(patch, box, 0, 1e-6)).alias("worst"), F.max(g.holds(patch, *g.center(box))).alias("any"))
        good = found.filter((F.col("worst") >= F.col("need")) & F.col("any")).select("image_id", "attempt", *PATCH).unionByName(each.filter("boxes is null").select("image_id", "attempt", *PATCH))
        first = good.groupBy("image_id").agg(F.min_by(F.struct("attempt", *PATCH), "attempt").alias("p")).select("image_id", "p.*")
        new = cut(kept.unionByName(first).withColumn("turn", F.lit(turn)))
        taken.append(new)
        left = dealt(left.join(new, "image_id", "left_anti"))
        if not left.limit(1).count():
            break
    out = left.select("image_id", F.lit(-1).alias("attempt"), *whole, F.lit(None).cast("int").alias("turn"))
    for new in taken:
        out = out.unionByName(new)
    return out.select("image_id", "turn", "attempt", *PATCH)


def cropped(boxes: DataFrame, patches: DataFrame) -> DataFrame:
    """The boxes whose centre lies strictly in their image's patch, clipped to it and moved to its corner."""
    b = boxes.join(patches.select("image_id", *PATCH), "image_id")
    patch = dict(zip(g.FIELDS, (F.col(c).cast("double") for c in PATCH), strict=True))
    b = b.filter(g.holds(patch, *g.center(g.box())))
    new = g.clipped(g.moved(g.box(), -patch["x1"], -patch["y1"]), g.width(patch), g.height(patch))
    return b.withColumns(new).drop(*PATCH)
