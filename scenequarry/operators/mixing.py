"""Dataset mixing, replication, sampling and batching, seeded by hashes so that reruns and retries agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) by a hash of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def mixed(steps: DataFrame, step: str, rates: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds dataset: for each step one name, drawn by the normalised rates."""
    total, at, pick = sum(rates.values()), 0.0, F.lit(list(rates)[-1])
    bounds = []
    for name, r in rates.items():
        at += r / total
        bounds.append((name, at))
    for name, b in reversed(bounds[:-1]):
        pick = F.when(share(seed, step) < b, name).otherwise(pick)
    return steps.withColumn("dataset", pick)


def concatenated(parts: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of datasets with their name."""
    out = None
    for name, df in parts.items():
        x = df.withColumn("dataset", F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def repeated(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def repeat_factors(labels: DataFrame, t: float, image: str = "image_id", label: str = "label") -> DataFrame:
    """image, factor: max over its labels of max(1, sqrt(t / share of images that have the label))."""
    pairs = labels.select(image, label).distinct()
    n = pairs.select(F.countDistinct(image).alias("n_images"))
    freq = pairs.groupBy(label).agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n))
    r = freq.select(label, F.greatest(F.lit(1.0), F.sqrt(t / (F.col("c") / F.col("n_images")))).alias("r"))
    return pairs.join(r, label).groupBy(image).agg(F.max("r").alias("factor"))


def replicated(images: DataFrame, factor: str = "factor") -> DataFrame:
    return images.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(factor).cast("int"))))


def sampled(rows: DataFrame, by: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group without replacement, all if fewer."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), key), key))).filter(F.col("__r") <= k).drop("__r")


def aspect_batches(images: DataFrame, w: str, h: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """Adds flag (wider than high) and batch: images of a flag only, in hash order.

    Places come from counts by hash bucket, so that no flag is ordered in one task.
    """
    flag = F.when(F.col(w) > F.col(h), 1).otherwise(0)
    rows = images.withColumn("flag", flag).withColumn("__b", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1024)).cast("int"))
    counts = rows.groupBy("flag", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("flag").orderBy("__b")) - F.col("__n")
    place = F.row_number().over(Window.partitionBy("flag", "__b").orderBy(F.xxhash64(F.lit(seed + 1), key), key)) - 1
    rows = rows.join(F.broadcast(counts.withColumn("__before", before)), ["flag", "__b"]).withColumn("__p", F.col("__before") + place)
    return rows.withColumn("batch", F.floor(F.col("__p") / size)).drop("__b", "__n", "__before", "__p")


def striped(rows: DataFrame, order: str, world: int) -> DataFrame:
    """Adds rank: rows dealt to ranks in turn by their order number."""
    return rows.withColumn("rank", F.pmod(F.col(order), F.lit(world)))


def even_chunks(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Adds chunk: n chunks of each group in order, the first ones longer by one."""
    return rows.withColumn("chunk", F.ntile(n).over(Window.partitionBy(*by).orderBy(*order)) - 1)


def padded(rows: DataFrame, by: list[str], order: str, tokens: str, fill: int, most: int | None = None) -> DataFrame:
    """by, ids, mask: each group's token arrays in order, padded to the group's longest, cut at most."""
    longest = F.max(F.size(tokens)).over(Window.partitionBy(*by))
    n = longest if most is None else F.least(longest, F.lit(most))
    ids = F.slice(F.concat(F.col(tokens), F.array_repeat(F.lit(fill), F.greatest(n - F.size(tokens), F.lit(0)))), 1, n)
    mask = F.transform(F.sequence(F.lit(1), n), lambda i: (i <= F.size(tokens)).cast("int"))
    return rows.withColumn("ids", ids).withColumn("mask", mask).select(*by, order, "ids", "mask")
