import os
import subprocess
import sys

import pytest
from compare import SF
from scenequarry.plans import tables as t
from scenequarry.plans.queries import QUERIES


def test_least_cost_assignment_sees_every_image(spark):
    ids = lambda df: {r.image_id for r in df.select("image_id").distinct().collect()}
    assert ids(QUERIES["m4_least_cost_assignment"](spark, SF)) == ids(t.predictions(spark, SF)) & ids(t.truths(spark, SF))


def test_polygon_masks_are_of_every_box(spark):
    got, dets = QUERIES["g17_g18_polygon_masks"](spark, SF), t.detections(spark, SF)
    assert got.count() == dets.count() and not dets.select("det_id").exceptAll(got.select("det_id")).count()


@pytest.mark.parametrize("name", ["g17_g18_polygon_masks", "g8_bucket_coder", "a24_hierarchical_ap"])
def test_workers_import_the_package_from_any_folder(tmp_path, name):
    code = f"""
import sys
sys.path.insert(0, {t.ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from scenequarry.plans.queries import QUERIES
QUERIES[{name!r}](spark, "/root/testdata/sf0.001").collect()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
