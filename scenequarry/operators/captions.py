"""Caption metrics: BLEU, ROUGE-L and CIDEr of one candidate and one reference per key, as joins of n-gram counts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import clipped, gram_counts

#: Bits of a count where some are packed in one number, and their range.
BITS = 28
PLACE = 1 << BITS


def bleu(candidates: DataFrame, references: DataFrame, key: str, n: int = 4) -> DataFrame:
    """One row: bleu1..bleu<n> over the corpus, with the brevity penalty; tables (key, words)."""
    sizes = candidates.select(key, F.size("words").alias("c")).join(references.select(key, F.size("words").alias("r")), key).agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    counts = clipped(gram_counts(candidates, references, key, list(range(1, n + 1))).filter("c > 0").groupBy("n"))
    of = lambda k, c: F.max(F.when(F.col("n") == k, F.col(c)))
    out = sizes.join(F.broadcast(counts.agg(*(of(k, c).alias(f"{c[0]}{k}") for k in range(1, n + 1) for c in ("matched", "total")))))  # one row each
    short = F.when(F.col("c") >= F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.greatest(F.col("c"), F.lit(1))))
    logs = [F.log(F.greatest(F.col(f"m{k}").cast("double"), F.lit(1e-9)) / F.greatest(F.col(f"t{k}"), F.lit(1))) for k in range(1, n + 1)]
    return out.select(*((short * F.exp(sum(logs[:k]) / k)).alias(f"bleu{k}") for k in range(1, n + 1)))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: rows of the usual table, one after the other."""
    zeros = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(before: Column, word: Column) -> Column:
        step = lambda acc, i: F.array_append(acc, F.when(F.get(b, i) == word, F.get(before, i) + 1).otherwise(F.greatest(F.get(before, i + 1), F.element_at(acc, -1))))
        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(F.lit(0)), step)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, zeros, row), -1))


def rouge_l(candidates: DataFrame, references: DataFrame, key: str, beta: float = 1.2) -> DataFrame:
    """key, rouge: the F measure of the longest common subsequence's share of either side."""
    both = candidates.select(key, F.col("words").alias("c")).join(references.select(key, F.col("words").alias("r")), key).withColumn("l", common_length(F.col("c"), F.col("r")).cast("double"))
    p, r = F.col("l") / F.greatest(F.size("c"), F.lit(1)), F.col("l") / F.greatest(F.size("r"), F.lit(1))
    return both.select(key, F.when(F.col("l") > 0, (1 + beta**2) * p * r / (r + beta**2 * p)).otherwise(0.0).alias("rouge"))


def cider(candidates: DataFrame, references: DataFrame, key: str, n: int = 4, sigma: float = 6.0) -> DataFrame:
    """key, cider: cosine of clipped tf-idf n-gram vectors, with a penalty for lengths that differ, mean over 1..n, times 10.

    Document frequencies come from the references. Keys have one candidate and one reference.

    A run that fewer than two references have weighs log(references), whichever it is; such runs are summed where they are
    counted, in whole numbers. Of the others only 96 bits of hashes are shuffled, once, with their counts, and what two or
    more references have goes back to its key.
    """
    sizes = range(1, n + 1)
    grams = gram_counts(candidates, references, key, list(sizes))
    parts = {"x": F.col("c") * F.col("c"), "y": F.col("r") * F.col("r"), "d": F.least("c", "r") * F.col("r")}  # norms and product without weights
    of = lambda k, value: F.sum(F.when(F.col("n") == k, value).otherwise(0))
    all_of = grams.groupBy(key).agg(*(of(k, v).alias(f"{p}{k}") for p, v in parts.items() for k in sizes))
    packed = (F.col("n").cast("bigint") * PLACE + F.col("c")) * PLACE + F.col("r")
    hashed = grams.select(key, F.xxhash64("n", "gram").alias("h"), F.hash("n", "gram").alias("g"), packed.alias("counts"))
    df = F.count_if(F.col("counts") % PLACE > 0).over(Window.partitionBy("h", "g"))
    log_n = F.log(F.count(F.lit(1)).cast("double"))
    known = hashed.withColumn("df", df).filter("df > 1").select(key, "counts", "df").repartition(key)
    unpacked = known.select(key, F.shiftright("counts", 2 * BITS).alias("n"), (F.shiftright("counts", BITS) % PLACE).alias("c"), (F.col("counts") % PLACE).alias("r"), "df")
    known = unpacked.join(F.broadcast(references.agg(log_n.alias("log_n")))).withColumn("w", F.col("log_n") - F.log(F.col("df").cast("double")))
    some_of = known.groupBy(key).agg(*(of(k, v).alias(f"{p}{k}_n") for p, v in parts.items() for k in sizes), *(of(k, v * F.col("w") * F.col("w")).alias(f"{p}{k}_w") for p, v in parts.items() for k in sizes))
    sides = candidates.select(key, F.size("words").alias("__c")).join(references.select(key, F.size("words").alias("__r")), key)
    rows = sides.join(all_of, key, "left").join(some_of, key, "left").join(F.broadcast(references.agg(log_n.alias("log_n"))))

    def share(k: int) -> Column:
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        total = lambda p: (zero(f"{p}{k}") - zero(f"{p}{k}_n")) * F.col("log_n") * F.col("log_n") + zero(f"{p}{k}_w")
        norms = F.sqrt(total("x")) * F.sqrt(total("y"))
        return F.when(norms > 0, total("d") / norms).otherwise(0.0)

    gap = F.exp(-F.pow(F.col("__c") - F.col("__r"), F.lit(2)) / (2 * sigma**2))
    return rows.select(key, (10 * sum(map(share, sizes)) / n * gap).alias("cider"))
