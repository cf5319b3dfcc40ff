"""Binary masks as runs.

counts: alternating run lengths from column-major pixels, the first of zeros. A run table has (start, end) of ones,
ends exclusive, so that areas, unions and intersections are interval arithmetic and no pixel is ever materialised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_area(counts: Column) -> Column:
    """Pixels that are set: the sum of the odd runs."""
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, c: a + c)


def runs(masks: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """keys, start, end of each run of ones."""
    ends = F.when(F.size(counts) > 0, _running(counts))
    spans = F.filter(F.transform(ends, lambda e, i: F.struct((e - F.get(F.col(counts), i)).alias("start"), e.alias("end"), (i % 2).alias("odd"))), lambda s: (s["odd"] == 1) & (s["end"] > s["start"]))
    return masks.select(*keys, F.explode(spans).alias("s")).select(*keys, F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def _running(counts: str) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))
    step = lambda acc, c: F.struct((acc["sum"] + c).alias("sum"), F.array_append(acc["out"], acc["sum"] + c).alias("out"))
    return F.aggregate(counts, zero, step, lambda acc: acc["out"])


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The union of overlapping or touching (start, end) runs of each key."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlaps(a: DataFrame, b: DataFrame, on: list[str], a_key: str, b_key: str) -> DataFrame:
    """on, a_key, b_key, inter: shared pixels of every pair of masks that meet; a and b are run tables."""
    x = a.select(*on, a_key, F.col("start").alias("s1"), F.col("end").alias("e1"))
    y = b.select(*on, b_key, F.col("start").alias("s2"), F.col("end").alias("e2"))
    shared = F.least("e1", "e2") - F.greatest("s1", "s2")
    return x.join(y, on).filter("s1 < e2 and s2 < e1").groupBy(*on, a_key, b_key).agg(F.sum(shared).alias("inter"))


def overlaps_within(spans: DataFrame, on: list[str], key: str, weight: int = 1 << 15) -> DataFrame:
    """on, key, other, inter: shared pixels of every two masks of a group that meet, once, key < other; runs of a mask are disjoint.

    A group's masks are dealt to chunks of about `weight` runs, and every two chunks are a task's work of their own, so a
    large group is spread and no task holds more than two chunks and their pairs.
    """
    each = spans.filter("end > start").groupBy(*on, key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("r"))
    each = each.select(*on, key, F.col("r.start").alias("start"), F.col("r.end").alias("end"))
    total = each.groupBy(*on).agg(F.ceil(F.sum(F.size("start") + 16) / weight).cast("int").alias("chunks"))
    dealt = each.join(total, on).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    met = dealt.select(*on, key, "start", "end", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("partner"))
    met = met.select(*on, key, "start", "end", F.least("chunk", "partner").alias("low"), F.greatest("chunk", "partner").alias("high"), (F.col("chunk") <= F.col("partner")).alias("left"))
    kinds = dict(spans.dtypes)

    def pairs(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        if group["low"][0] == group["high"][0]:
            a = b = group
        else:
            a, b = group.filter(group["left"]), group.filter(pc.invert(group["left"]))
        i, j, inter = _meeting(*_flat(a), *_flat(b))
        x, y = a[key].to_numpy()[i], b[key].to_numpy()[j]
        if a is b:
            ok = x < y
            x, y, inter = x[ok], y[ok], inter[ok]
        low, high = np.where(x < y, x, y), np.where(x < y, y, x)
        same = {c: pa.array([group[c][0].as_py()] * len(low), group[c].type) for c in on}
        return pa.table({**same, key: pa.array(low, group[key].type), "other": pa.array(high, group[key].type), "inter": pa.array(inter, pa.int64())})

    names = ", ".join(f"{c} {kinds[c]}" for c in on)
    # a number given, as little is shuffled for the work that it makes, and small partitions would be put together
    met = met.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, "low", "high")
    return met.groupBy(*on, "low", "high").applyInArrow(pairs, f"{names}, {key} {kinds[key]}, other {kinds[key]}, inter long")


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all masks in a row, and where each mask begins."""
    start, end = (pa.concat_arrays(rows[c].chunks) if rows.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("start", "end"))
    sizes = pc.list_value_length(start).to_numpy(zero_copy_only=False).astype(int)
    return start.flatten().to_numpy(), end.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


def _meeting(start, end, at, start2, end2, at2, dense: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of masks of both sides that meet and their shared pixels.

    With the pixels that a mask has before a place, its share of a run is a difference of two such numbers. Of few places
    these differences are a product of matrices; of many they are looked up, a mask at a time. Both are whole numbers.
    """
    n, m = len(at) - 1, len(at2) - 1
    if not n or not m:
        return (np.empty(0, int),) * 3
    places = np.unique(np.concatenate([start2, end2]))

    def before(i, where):
        s, e = start[at[i] : at[i + 1]], end[at[i] : at[i + 1]]
        covered = np.concatenate([[0], np.cumsum(e - s)])
        k = np.searchsorted(s, where, side="right")
        return covered[k] - np.where(k > 0, np.maximum(e[np.maximum(k - 1, 0)] - where, 0), 0)

    if len(places) <= dense:
        run = np.zeros((len(places), m))
        which = np.repeat(np.arange(m), np.diff(at2))
        np.add.at(run, (np.searchsorted(places, end2), which), 1)
        np.add.at(run, (np.searchsorted(places, start2), which), -1)
        inter = np.rint(np.stack([before(i, places) for i in range(n)]).astype(float) @ run).astype(np.int64)
        i, j = np.nonzero(inter)
        return i, j, inter[i, j]
    out = []
    for i in range(n):
        inter = np.add.reduceat(before(i, end2) - before(i, start2), at2[:-1])
        j = np.flatnonzero(inter)
        out.append((np.full(len(j), i), j, inter[j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def encode(pixels: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, counts, size: run lengths of a 0/1 column in order, the first of zeros."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.col(value) != F.coalesce(F.lag(value).over(w), F.lit(0)), 1).otherwise(0)
    run = F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0))
    each = pixels.withColumn("run", run).groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"))
    whole = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("run", "n"))).alias("r"), F.sum("n").alias("size"))
    counts = F.transform("r", lambda x: x["n"])
    return whole.select(*keys, F.when(F.col("r")[0]["run"] == 0, counts).otherwise(F.concat(F.array(F.lit(0).cast("long")), counts)).alias("counts"), "size")


def by_column(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c, top, bottom: the runs (keys, start, end, height) cut at columns; bottom is exclusive."""
    h = F.col("height")
    each = spans.filter("end > start").select("*", F.explode(F.sequence(F.floor(F.col("start") / h), F.floor((F.col("end") - 1) / h))).alias("c"))
    return each.select(*keys, "c", F.greatest(F.col("start") - F.col("c") * h, F.lit(0)).alias("top"), F.least(F.col("end") - F.col("c") * h, h).alias("bottom"))


def targets(spans: DataFrame, boxes: DataFrame, keys: list[str], box_id: str, size: int = 28, share: float = 0.5) -> DataFrame:
    """keys, box_id, start, end: each box's part of its mask, resampled to size x size cells, as column-major runs.

    A cell is set if the mask covers at least `share` of its area; outside the image nothing is set. spans are the runs of
    disjoint pixels of masks (keys, start, end, height); boxes (keys, box_id, x1..y2) name theirs by keys. Pieces of
    columns are moved to cells by arithmetic, so no bitmap is made. Boxes without a set cell, or without area, have no row.
    """
    b = boxes.select(*keys, box_id, "x1", "y1", "x2", "y2").filter("x2 > x1 and y2 > y1")
    met = by_column(spans, keys).join(b, keys)

    def cell(v, low: str, high: str):
        return F.greatest(F.least((v - F.col(low)) * size / (F.col(high) - F.col(low)), F.lit(float(size))), F.lit(0.0))

    at = {"left": cell(F.col("c"), "x1", "x2"), "right": cell(F.col("c") + 1, "x1", "x2"), "up": cell(F.col("top"), "y1", "y2"), "down": cell(F.col("bottom"), "y1", "y2")}
    met = met.select(*keys, box_id, *(v.alias(k) for k, v in at.items())).filter("right > left and down > up")
    over = lambda low, high: F.explode(F.sequence(F.floor(low), F.ceil(high) - 1))
    met = met.select("*", over("left", "right").alias("j")).select("*", over("up", "down").alias("i"))
    part = lambda low, high, n: F.least(F.col(high), F.col(n) + 1.0) - F.greatest(F.col(low), F.col(n).cast("double"))
    area = met.groupBy(*keys, box_id, "j", "i").agg(F.sum(part("left", "right", "j") * part("up", "down", "i")).alias("area"))
    start = F.col("j") * size + F.col("i")
    return merged(area.filter(F.round("area", 9) >= share).select(*keys, box_id, start.alias("start"), (start + 1).alias("end")), [*keys, box_id])


def packed(counts: Column) -> Column:
    """Run lengths as the COCO string: from the fourth on as differences to those two before, each in groups of five bits
    from the lowest, a sixth bit saying that more follow, as characters from '0' on."""
    number = F.transform(counts, lambda c, i: F.when(i > 2, c - F.get(counts, i - 2)).otherwise(c).cast("long"))

    def characters(d: Column) -> Column:
        groups = F.lit(1)
        for k in range(7):
            groups = groups + F.when((d >= (16 << 5 * k)) | (d < -(16 << 5 * k)), 1).otherwise(0)
        bits = lambda k: F.call_function("shiftright", d, k * 5).bitwiseAND(F.lit(31))
        return F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), lambda k: F.char(F.lit(48) + bits(k) + F.when(k < groups - 1, 32).otherwise(0))), "")

    return F.array_join(F.transform(number, characters), "")


def unpacked(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, counts of masks written as COCO strings; empty strings have no runs and give no row.

    Differences are summed by a window over every second number, so long masks stay linear.
    """
    parts = rows.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit("([P-o]*[0-O])"), 1)).alias("pos", "part"))
    n = F.length("part")
    code = lambda k: F.ascii(F.substring(F.col("part"), k + 1, F.lit(1))).cast("long") - 48
    low = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda acc, k: acc + F.call_function("shiftleft", code(k).bitwiseAND(F.lit(31)), k * 5))
    below = F.when(code(n - 1).bitwiseAND(F.lit(16)) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), n * 5)).otherwise(F.lit(0).cast("long"))
    turn = F.when(F.col("pos") == 0, -1).otherwise(F.col("pos") % 2).alias("turn")
    w = Window.partitionBy(*keys, "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = parts.select(*keys, "pos", turn, (low - below).alias("d")).withColumn("c", F.sum("d").over(w))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("counts"))
