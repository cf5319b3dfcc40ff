"""The domain tables that queries work on, derived from the given tables, and cutting lineage in iterative plans."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder. Python workers can then import this package where it lies at the same place everywhere."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where there is none, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the checkpoint folder; plans above don't recompute what is below."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with whole-number corners, an image for five orders, about twenty boxes, at every scale: image_id, det_id, model_id, x1..y2, score, label."""
    return read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 5).alias("image_id"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).cast("long").alias("det_id"), (F.col("l_suppkey") % 7).alias("model_id"),
        ((F.col("l_partkey") % 5) * 40).cast("double").alias("x1"), ((F.col("l_partkey") % 3) * 40).cast("double").alias("y1"),
        ((F.col("l_partkey") % 5) * 40 + 60 + F.col("l_quantity")).cast("double").alias("x2"), ((F.col("l_partkey") % 3) * 40 + 60 + F.col("l_suppkey") % 20).cast("double").alias("y2"),
        (F.col("l_discount") * 10).alias("score"), F.col("l_returnflag").alias("label"),
    )


#: The same in SQL, for oracles.
DETECTIONS = """dets AS (
    SELECT l_orderkey // 5 AS image_id, CAST(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS BIGINT) AS det_id, l_suppkey % 7 AS model_id,
        CAST((l_partkey % 5) * 40 AS DOUBLE) AS x1, CAST((l_partkey % 3) * 40 AS DOUBLE) AS y1,
        CAST((l_partkey % 5) * 40 + 60 + l_quantity AS DOUBLE) AS x2, CAST((l_partkey % 3) * 40 + 60 + l_suppkey % 20 AS DOUBLE) AS y2,
        l_discount * 10 AS score, l_returnflag AS label FROM lineitem)"""


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even detections as ground truth: image_id, gt_id, x1..y2, label."""
    return detections(spark, sf_dir).filter("det_id % 2 = 0").select("image_id", F.col("det_id").alias("gt_id"), "x1", "y1", "x2", "y2", "label")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).filter("det_id % 2 = 1")


TRUTHS = "gts AS (SELECT image_id, det_id AS gt_id, x1, y1, x2, y2, label FROM dets WHERE det_id % 2 = 0), preds AS (SELECT * FROM dets WHERE det_id % 2 = 1)"


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with a depth from order prices."""
    price = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("depth"))
    d = detections(spark, sf_dir)
    return d.withColumn("k", F.floor(F.col("det_id") / 1_000_000_000)).join(price, "k").drop("k")


DEPTHS = "deps AS (SELECT d.*, o_totalprice AS depth FROM dets d JOIN orders ON o_orderkey = CAST(floor(det_id / 1000000000) AS BIGINT))"


