import random
from collections import Counter

from pyspark.sql import functions as F
from scenequarry.functions import masks
from scenequarry.operators import matching, panoptic

R = random.Random(4)


def by_groups(counts):
    """The string format, number by number."""
    out = []
    for i, c in enumerate(counts):
        v = c - counts[i - 2] if i > 2 else c
        n = next(n for n in range(1, 13) if -(1 << 5 * n - 1) <= v < 1 << 5 * n - 1)
        out += [chr(48 + (v >> 5 * k & 31 | (32 if k < n - 1 else 0))) for k in range(n)]
    return "".join(out)


def test_mask_strings(spark):
    rows = [(k, [R.choice([0, 1, 15, 16, 17, 511, 512, 513, 10**6, R.randrange(1 << 31)]) for _ in range(R.randrange(1, 40))]) for k in range(80)] + [(90, [5]), (91, [0, 7]), (92, [1 << 33, 1, 1, 1 << 33])]
    df = spark.createDataFrame(rows, "k long, counts array<long>").repartition(3).withColumn("s", masks.packed(F.col("counts")))
    assert {r.k: r.s for r in df.collect()} == {k: by_groups(c) for k, c in rows}
    assert {r.k: r.counts for r in masks.unpacked(df, ["k"], "s").collect()} == dict(rows)
    assert by_groups([6, 1, 40, 4, 5]) == "61X13mN"


def test_swept_is_what_pixels_say(spark):
    want, truths, preds = Counter(), [], []
    for image in range(12):
        sides = []
        for table in (truths, preds):
            at, line = 0, [None] * 200
            while at < 200:
                n, label = R.randrange(1, 30), R.choice([None, "a", "b", "c"])
                if label:
                    table.append((image, label, at, min(at + n, 200)))
                    line[at : at + n] = [label] * len(line[at : at + n])
                at += n
            sides.append(line)
        want.update((image, a, b) for a, b in zip(*sides, strict=True) if a or b)
    schema = "image_id long, label string, start long, end long"
    truths.append((3, "a", 7, 7))  # a run without pixels
    got = panoptic.swept(spark.createDataFrame(truths, schema).repartition(3), spark.createDataFrame(preds, schema), ["image_id"])
    assert {(r.image_id, r.gt, r.pred): r.pixels for r in got.collect()} == dict(want)
    assert panoptic.swept(spark.createDataFrame([], schema), spark.createDataFrame([], schema), ["image_id"]).count() == 0


def test_report_of_a_small_case(spark):
    rows = [(1, "a:1", "a:1", 8), (1, "a:1", None, 2), (1, None, "a:2", 6), (1, "b:", "a:2", 4), (1, "b:", "b:", 3), (1, "b:", "a:3", 5), (1, None, "b:", 50)]
    df = spark.createDataFrame(rows, "image_id long, gt string, pred string, pixels long")
    cat = F.split_part("segment", F.lit(":"), F.lit(1))
    got = {r.part: (round(r.pq, 6), r.tp, r.fp, r.fn, r.n) for r in panoptic.report(df, ["image_id"], cat, cat == "a").collect()}
    # a:1 has 8 of 10; a:2 lies mostly outside the truth; a:3 is false; b: has 3 of 12
    assert got == {"a": (round(0.8 / 1.5, 6), 1, 1, 0, 1), "b": (0.0, 0, 0, 1, 1), "things": (round(0.8 / 1.5, 6), 1, 1, 0, 1), "stuff": (0.0, 0, 0, 1, 1), "all": (round(0.4 / 1.5, 6), 1, 1, 1, 2)}


def test_best_of_own_labels(spark):
    names = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0]), ("cow", [1.0, 0.0]), ("bird", [1.0, 1.0])], "label string, vector array<double>")
    objects = spark.createDataFrame([(1, [2.0, 0.1], ["dog", "cow", "cat", "cow"]), (2, [1.0, 1.0], ["dog", "unknown"]), (3, [1.0, 1.0], []), (4, [0.0, 3.0], ["bird", "dog"])], "id long, vector array<double>, labels array<string>")
    assert {r.id: r.label for r in matching.best_of_own(objects, names, "id").collect()} == {1: "cat", 2: "dog", 4: "dog"}
