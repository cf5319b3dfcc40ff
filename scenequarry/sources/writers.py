"""Writers of annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def key_value(scenes: DataFrame, path: str, key: str = "image_id", buckets: int | None = None) -> None:
    """One row per key with its whole document as JSON, clustered by key so that lookups prune files."""
    out = scenes.select(key, F.to_json(F.struct(*[c for c in scenes.columns if c != key])).alias("value"))
    n = buckets or int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(n, key).sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def lookup(spark, path: str, keys: list[str], key: str = "image_id") -> DataFrame:
    return spark.read.parquet(path).filter(F.col(key).isin(keys))


def keys(scenes: DataFrame, path: str, key: str = "image_id") -> None:
    """All keys in order, one a line."""
    scenes.select(key).distinct().orderBy(key).write.text(path)


def coco_results(dets: DataFrame, categories: DataFrame) -> DataFrame:
    """image_id, category_id, bbox (corner and size), score: rows of a COCO result file."""
    b = g.box()
    return dets.join(F.broadcast(categories.select("label", F.col("id").alias("category_id"))), "label").select("image_id", "category_id", F.array(*g.to_xywh(b)).alias("bbox"), "score")


def unprocessed(inputs: DataFrame, done: DataFrame, key: str = "image_id") -> DataFrame:
    """Inputs whose key isn't among the outputs yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def metrics(values: DataFrame, path: str) -> None:
    """Appends name: value lines."""
    values.select(F.concat_ws(": ", "name", F.col("value").cast("string"))).write.mode("append").text(path)
