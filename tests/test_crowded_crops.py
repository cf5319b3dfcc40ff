"""Crops of images with very many boxes."""

import time

from pyspark.sql import functions as F
from scenequarry.operators import crops


def test_copies_of_boxes_neither_change_a_crop_nor_draw_again(spark):
    images = spark.createDataFrame([(i, 200.0, 160.0) for i in range(8)], "image_id long, width double, height double")
    few = [(i, 10.0 * k, 5.0 * k, 10.0 * k + 90, 5.0 * k + 70) for i in range(6) for k in range(3)] + [(6, 0.0, 0.0, 200.0, 160.0)]
    boxes = spark.createDataFrame(few, "image_id long, x1 double, y1 double, x2 double, y2 double")
    want = sorted(map(tuple, crops.by_overlap(images, boxes, 3).collect()), key=str)
    assert len(want) == 8
    start = time.monotonic()
    many = boxes.crossJoin(spark.range(60_000)).drop("id")
    assert sorted(map(tuple, crops.by_overlap(images, many, 3).collect()), key=str) == want
    assert time.monotonic() - start < 30
