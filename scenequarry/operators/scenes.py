"""Scene objects and referring expressions: filters, exports, samples, and augmentations of an image's boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .mixing import share


def large_regions(objects: DataFrame, width: Column, height: Column, least: float = 0.02) -> DataFrame:
    """Objects whose box has the share `least` of their image's area or more."""
    return objects.filter(g.area(g.box()) / (width * height) >= least)


def with_depth(objects: DataFrame, depth: str = "depth") -> DataFrame:
    return objects.filter(F.col(depth).isNotNull())


def with_some(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose array has an element: objects with attributes, phrases with objects. Null counts as empty."""
    return rows.filter(F.coalesce(F.size(column), F.lit(0)) > 0)


def without_mask(objects: DataFrame, mask: str = "segmentation") -> DataFrame:
    """Objects for the fallback masker."""
    return objects.filter(F.col(mask).isNull())


def objects_only(scenes: DataFrame, key: str = "image_id") -> DataFrame:
    """The export of an image's objects without whatever else its scene has."""
    return scenes.select(key, "objects")


def without_fields(scenes: DataFrame, column: str, *fields: str) -> DataFrame:
    """Scenes whose array of objects lacks the fields, such as masks."""
    return scenes.withColumn(column, F.transform(column, lambda o: o.dropFields(*fields)))


def rounded(column: Column) -> Column:
    """Two digits, halves to the even one."""
    return F.bround(column, 2)


def segment_of(asked: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """asked with the segmentation of the object of that id; null without one."""
    return asked.join(objects.select(*keys, "segmentation"), keys, "left")


def chosen_objects(objects: DataFrame, floating: DataFrame, most: int, has_attribute: Column) -> DataFrame:
    """An image's objects, or its floating ones where it has none; of more than `most`, those with attributes first."""
    lone = floating.join(objects.select("image_id").distinct(), "image_id", "left_anti")
    rows = objects.unionByName(lone).withColumn("__r", F.row_number().over(Window.partitionBy("image_id").orderBy(F.when(has_attribute, 0).otherwise(1), "det_id")))
    return rows.filter(F.col("__r") <= most).drop("__r")


def refs_by_image(refs: DataFrame) -> DataFrame:
    """image_id, ref_ids in order."""
    return refs.groupBy("image_id").agg(F.sort_array(F.collect_list("ref_id")).alias("ref_ids"))


def sampled_expressions(refs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """image_id, ref_id, ann_id, sentence: k of the sentences of all of an image's refs, all if fewer, by a seeded hash."""
    each = refs.select("image_id", "ref_id", "ann_id", F.posexplode("sentences").alias("pos", "sentence"))
    w = Window.partitionBy("image_id").orderBy(F.xxhash64(F.lit(seed), "ref_id", "pos"), "ref_id", "pos")
    return each.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r", "pos")


def any_of(values: Column, asked: list) -> Column:
    """Whether an array, or one value, has something in common with the list."""
    return F.arrays_overlap(values, F.array(*(F.lit(x) for x in asked)))


def valid_sample(rows: DataFrame, valid: Column, by: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group of those that are valid: what drawing again until a valid one comes amounts to."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.filter(valid).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def task_mix(steps: DataFrame, step: str, rates: dict[str, dict[str, float]], families: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds family and dataset: a family by its rate, then a dataset of that family by its own rates."""
    from .mixing import mixed

    out = mixed(steps, step, families, seed).withColumnRenamed("dataset", "family")
    pick = F.lit(None).cast("string")
    for name, own in rates.items():
        total, at, inner = sum(own.values()), 1.0, F.lit(list(own)[-1])
        for d in reversed(list(own)[:-1]):
            at -= own[list(own)[list(own).index(d) + 1]] / total
            inner = F.when(share(seed + 1, step) < at, d).otherwise(inner)
        pick = F.when(F.col("family") == name, inner).otherwise(pick)
    return out.withColumn("dataset", pick)


def epochs(rows: DataFrame, key: str, n: int, world: int = 1, seed: int = 0) -> DataFrame:
    """epoch, place, rank: an endless sampler's first n permutations, dealt to ranks in turn.

    Places come from counts by hash bucket, so that no task orders an epoch.
    """
    each = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("epoch"))
    h = F.xxhash64(F.lit(seed), "epoch", key)
    each = each.withColumn("__b", F.pmod(F.shiftright(h, 20), F.lit(1024)).cast("int"))
    counts = each.groupBy("epoch", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("epoch", "__b", (F.sum("__n").over(Window.partitionBy("epoch").orderBy("__b")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("epoch", "__b").orderBy(h, key)) - 1
    out = each.join(before, ["epoch", "__b"]).withColumn("place", F.col("__before") + place)
    return out.select("epoch", key, "place", F.pmod("place", F.lit(world)).cast("int").alias("rank"))


def expanded(b: g.Box, left, top) -> g.Box:
    """Boxes on a larger canvas that the image lies in."""
    return g.moved(b, left, top)


def mosaic(dets: DataFrame, groups: DataFrame, size: float, least: float = 1.0) -> DataFrame:
    """Boxes of four images side by side on a canvas of size x size: groups (mosaic_id, image_id, quarter 0 to 3); what is
    cut off by its quarter goes, and so do boxes with a side of `least` or less."""
    half = size / 2
    rows = dets.join(groups, "image_id")
    dx, dy = F.when(F.col("quarter") % 2 == 1, half).otherwise(0.0), F.when(F.col("quarter") >= 2, half).otherwise(0.0)
    b = g.moved(g.clipped(g.box(), half, half), dx, dy)
    out = rows.select("mosaic_id", "det_id", "label", *g.columns(b))
    return out.filter((g.width(g.box()) > least) & (g.height(g.box()) > least))


def mixed_up(dets: DataFrame, pairs: DataFrame, scale: float, w: float, h: float) -> DataFrame:
    """Boxes of an image and of its partner, which is mirrored, scaled and clipped: pairs (image_id, partner)."""
    own = dets.select("image_id", "det_id", "label", *g.columns(g.box()))
    other = dets.withColumnRenamed("image_id", "partner").join(pairs, "partner")
    b = g.clipped(g.scaled(g.flipped(g.box(), w, h, "horizontal"), scale, scale), w, h)
    return own.unionByName(other.select("image_id", "det_id", "label", *g.columns(b)))


def affine(dets: DataFrame, m: tuple[float, ...], w: float, h: float, least: float = 2.0, share_left: float = 0.2, aspect: float = 20.0) -> DataFrame:
    """Upright hulls of boxes under x' = m0 x + m1 y + m2, y' = m3 x + m4 y + m5, clipped; small, mostly cut or thin ones go."""
    corners = [(x, y) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs = [m[0] * F.col(x) + m[1] * F.col(y) + m[2] for x, y in corners]
    ys = [m[3] * F.col(x) + m[4] * F.col(y) + m[5] for x, y in corners]
    whole = g.of(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    rows = dets.select("image_id", "det_id", "label", g.struct(whole).alias("w"), *g.columns(g.clipped(whole, w, h)))
    bw, bh = g.width(g.box()), g.height(g.box())
    ratio = F.greatest(bw / (bh + 1e-16), bh / (bw + 1e-16))
    return rows.filter((bw > least) & (bh > least) & (bw * bh / (g.area(g.box(F.col("w"))) + 1e-16) > share_left) & (ratio < aspect)).drop("w")


def scene_lines(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """image_id, text: JSON lines of an image's objects, then of its relations, in order."""
    line = lambda rows, part, *c: rows.select("image_id", F.lit(part).alias("part"), "pos", F.to_json(F.struct(*c)).alias("line"))
    both = line(objects, 0, "id", "label").unionByName(line(relations, 1, "phrase", "object_ids"))
    return both.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "pos", "line"))), lambda v: v["line"]), "\n").alias("text"))


def few_shot(examples: list[tuple[str, str]], instruction: str, query: Column) -> Column:
    """A prompt of an instruction, worked examples, and what is asked."""
    head = instruction + "".join(f"\n\nInput: {a}\nOutput: {b}" for a, b in examples)
    return F.concat(F.lit(head + "\n\nInput: "), query, F.lit("\nOutput:"))


def first_option(text: Column, options: list[str], other: str = "none") -> Column:
    """The first option that the text holds, regardless of case."""
    out = F.lit(other)
    for o in reversed(options):
        out = F.when(F.lower(text).contains(o.lower()), o).otherwise(out)
    return out


def landmark(text: Column, fine: dict[str, list[str]]) -> Column:
    """(main, fine): the first main category that the text holds, and the first of its own finer ones."""
    main = first_option(text, list(fine))
    out = F.lit("none")
    for name, options in fine.items():
        out = F.when(main == name, first_option(text, options)).otherwise(out)
    return F.struct(main.alias("main"), out.alias("fine"))


def option_prompt(main: Column, fine: dict[str, list[str]]) -> Column:
    """The question that lists a main category's options."""
    out = F.lit(None).cast("string")
    for name, options in fine.items():
        out = F.when(main == name, f"Which kind of {name} is it: {', '.join(options)}?").otherwise(out)
    return out


def stopped(text: Column, stops: list[str]) -> Column:
    """Whether a text ends with one of the stop words or holds it."""
    out = F.lit(False)
    for s in stops:
        out = out | text.contains(s)
    return out
