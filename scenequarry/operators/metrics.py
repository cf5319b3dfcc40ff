"""Detection, grounding, segmentation and caption metrics as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F


def in_parts(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds part: numbers of ranges of (by, order), about as many as there are shuffle partitions, so that a large group
    lies in many of them, in order. Stored, so that what is computed per part agrees with the rows."""
    from ..plans.tables import cut

    return cut(rows.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()))


def curve(hits: DataFrame, totals: DataFrame, by: list[str], on: list[str] | None = None) -> DataFrame:
    """Cumulative tp and fp in score order, with recall and precision; totals: on..., n_gt.

    Sums run within ranges of a group, from the sums of the ranges before; part names a row's range.
    """
    rows = in_parts(hits, by, [F.desc("score"), F.asc("det_id")])
    sums = rows.groupBy(*by, "part").agg(F.sum("tp").alias("t"), F.sum("fp").alias("f"))
    ahead = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c)
    sums = sums.select(*by, "part", before("t"), before("f")).join(totals, on or by)  # not the rows: totals may be joined by a shuffle
    w = Window.partitionBy(*by, "part").orderBy(F.desc("score"), "det_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"ctp": F.sum("tp").over(w), "cfp": F.sum("fp").over(w)}).join(sums, [*by, "part"])
    out = out.withColumns({"ctp": F.col("ctp") + F.col("t"), "cfp": F.col("cfp") + F.col("f")}).drop("t", "f")
    return out.withColumns({"recall": F.col("ctp") / F.greatest(F.col("n_gt"), F.lit(1e-9)), "precision": F.col("ctp") / F.greatest(F.col("ctp") + F.col("cfp"), F.lit(1e-9))})


def hits_over_limits(claims: DataFrame, totals: DataFrame, by: list[str], limits: list[float]) -> DataFrame:
    """by..., limit, recall, precision of the hits of each limit's curve, and a point at zero for each curve.

    claims: by..., score, det_id, tp_from, tp_to, skip_to (matching.claimed_limits); totals: by..., n_gt. A detection is
    one row up to its sums over all limits. A miss isn't a point: the hit before it has its recall and more precision.
    """
    at = range(len(limits))
    rows = in_parts(claims.join(totals, by, "left_semi").select(*by, "score", "det_id", "tp_from", "tp_to", "skip_to"), by, [F.desc("score"), F.asc("det_id")])
    one = {f"t{k}": F.when((F.col("tp_from") <= k) & (F.col("tp_to") > k), 1).otherwise(0) for k in at} | {f"n{k}": F.when(F.col("skip_to") <= k, 1).otherwise(0) for k in at}
    sums = rows.groupBy(*by, "part").agg(*(F.sum(v).alias(c) for c, v in one.items()))
    ahead = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select(*by, "part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in one)).join(totals, by)
    w = Window.partitionBy(*by, "part").orderBy(F.desc("score"), "det_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({c: F.sum(v).over(w) for c, v in one.items()}).filter("tp_to > tp_from").join(sums, [*by, "part"])
    of = lambda c: F.get(F.array(*(F.col(f"{c}{k}") + F.col(f"{c}{k}_before") for k in at)), F.col("k"))
    out = out.withColumn("k", F.explode(F.sequence(F.col("tp_from").cast("int"), F.col("tp_to") - 1)))
    n = F.greatest(F.col("n_gt"), F.lit(1e-9))
    limit = F.get(F.array(*(F.lit(x) for x in limits)), F.col("k")).alias("limit")
    hits = out.select(*by, limit, (of("t") / n).alias("recall"), (of("t") / F.greatest(of("n"), F.lit(1e-9))).alias("precision"))
    zero = sums.select(*by).distinct().select(*by, F.explode(F.array(*(F.lit(x) for x in limits))).alias("limit"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("precision"))
    return hits.unionByName(zero)


def envelope(points: DataFrame, by: list[str]) -> DataFrame:
    """Adds env, the greatest precision from a point of the curve on: within its range, and of the ranges behind."""
    best = points.groupBy(*by, "part").agg(F.max("precision").alias("m"))
    behind = F.max("m").over(Window.partitionBy(*by).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))
    w = Window.partitionBy(*by, "part").orderBy(F.asc("score"), F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
    out = points.withColumn("env", F.max("precision").over(w)).join(best.select(*by, "part", behind.alias("behind")), [*by, "part"])
    return out.withColumn("env", F.greatest("env", "behind")).drop("behind")


def average_precision(points: DataFrame, by: list[str]) -> DataFrame:
    """by..., ap: area under the falling envelope of precision over recall; a hit adds one truth's share of recall."""
    step = F.col("tp") / F.greatest(F.col("n_gt"), F.lit(1e-9))
    return envelope(points, by).groupBy(*by).agg(F.sum(F.col("env") * step).alias("ap"))


def interpolated_precision(points: DataFrame, by: list[str], levels: int = 11) -> DataFrame:
    """by..., ap: mean over evenly spaced recall levels of the best precision at that recall or more.

    Points are grouped by the highest level they reach, and levels take the best of those behind.
    """
    n = float(levels - 1)
    reached = F.floor(F.col("recall") * n)
    reached = F.when(F.col("recall") >= (reached + 1) / n, reached + 1).when(F.col("recall") < reached / n, reached - 1).otherwise(reached)
    best = points.groupBy(*by, F.least(reached, F.lit(levels - 1)).cast("int").alias("reached")).agg(F.max("precision").alias("p"))
    at = best.groupBy(*by).agg(F.collect_list(F.struct("reached", "p")).alias("best")).select(*by, "best", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    p = F.array_max(F.transform(F.filter("best", lambda x: x["reached"] >= F.col("level")), lambda x: x["p"]))
    return at.select(*by, F.coalesce(p, F.lit(0.0)).alias("p")).groupBy(*by).agg((F.sum("p") / levels).alias("ap"))


def area_buckets(rows: DataFrame, area: Column, edges: list[tuple[str, float, float]]) -> DataFrame:
    """Each row once for every bucket [low, high) that its area lies in."""
    some = F.array(*(F.struct(F.lit(n).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in edges))
    return rows.select("*", F.explode(F.filter(some, lambda e: (area >= e["lo"]) & (area < e["hi"]))).alias("__e")).withColumn("bucket", F.col("__e.bucket")).drop("__e")


def meter(rows: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """Weighted sum, count and their ratio, the count padded so that empty meters are zero."""
    return rows.groupBy(*by).agg(F.sum(F.col(value) * F.col(n)).alias("total"), F.sum(n).alias("count")).withColumn("avg", F.col("total") / (F.col("count") + 1e-5))


def class_overlap(pixels: DataFrame, pred: str, target: str, by: list[str], ignore: int = 255) -> DataFrame:
    """by..., cls, inter, n_pred, n_target, union from rows of (pred, target, n); targets to ignore don't count."""
    rows = pixels.filter(F.col(target) != ignore)
    each = rows.select(*by, F.explode(F.array_distinct(F.array(F.col(pred), F.col(target)))).alias("cls"), pred, target, "n")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = each.groupBy(*by, "cls").agg(count((F.col(pred) == F.col(target)) & (F.col(pred) == F.col("cls"))).alias("inter"), count(F.col(pred) == F.col("cls")).alias("n_pred"), count(F.col(target) == F.col("cls")).alias("n_target"))
    return out.withColumn("union", F.col("n_pred") + F.col("n_target") - F.col("inter"))


def mask_scores(masks: DataFrame, by: list[str]) -> DataFrame:
    """giou: mean overlap of masks with one where both are empty; ciou: overlap of the sums."""
    each = F.when(F.col("union") == 0, F.lit(1.0)).otherwise(F.col("inter") / (F.col("union") + 1e-5))
    return masks.groupBy(*by).agg(F.avg(each).alias("giou"), (F.sum("inter") / (F.sum("union") + 1e-10)).alias("ciou"))


def panoptic_quality(pairs: DataFrame, truths: DataFrame, preds: DataFrame) -> DataFrame:
    """Per category and rolled up over things, stuff and all: pq, sq, rq.

    pairs: gt_id, pred_id, gt_cat, pred_cat, inter, union. truths and preds: id, cat, isthing.
    """
    hit = pairs.filter((F.col("gt_cat") == F.col("pred_cat")) & (F.col("inter") / F.col("union") > 0.5))
    tp = hit.groupBy(F.col("gt_cat").alias("cat")).agg(F.count(F.lit(1)).alias("tp"), F.sum(F.col("inter") / F.col("union")).alias("iou"))
    n_gt = truths.groupBy("cat", "isthing").agg(F.count(F.lit(1)).alias("n_gt"))
    n_pred = preds.groupBy("cat").agg(F.count(F.lit(1)).alias("n_pred"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cat = n_gt.join(n_pred, "cat", "left").join(tp, "cat", "left").select("cat", "isthing", zero("tp").alias("tp"), F.coalesce("iou", F.lit(0.0)).alias("iou"), (F.col("n_gt") - zero("tp")).alias("fn"), (zero("n_pred") - zero("tp")).alias("fp"))
    pq = F.col("iou") / (F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn"))
    each = cat.withColumns({"pq": pq, "sq": F.when(F.col("tp") > 0, F.col("iou") / F.col("tp")).otherwise(0.0), "rq": F.col("tp") / (F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn"))})
    return each.rollup("isthing").agg(F.avg("pq").alias("pq"), F.avg("sq").alias("sq"), F.avg("rq").alias("rq"), F.count(F.lit(1)).alias("n"))


def gram_counts(candidates: DataFrame, references: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """key, n, gram, c, r: how often each run of n words occurs in a key's candidate and in its reference (key, words).

    Only words are shuffled, by key; their runs are counted where they lie.
    """
    side = lambda t, i: t.select(key, "words", F.lit(i).alias("__side"))
    rows = side(candidates, 0).unionByName(side(references, 1)).repartition(key)

    def runs(n: int) -> Column:
        at = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("words", i, n), " ").alias("gram")))

    each = rows.select(key, "__side", F.explode(F.concat(*map(runs, sizes))).alias("g")).select(key, "g.n", "g.gram", "__side")
    return each.groupBy(key, "n", "gram").agg(F.count_if(F.col("__side") == 0).alias("c"), F.count_if(F.col("__side") == 1).alias("r"))


def clipped_precision(candidates: DataFrame, references: DataFrame, key: str, n: int) -> DataFrame:
    """key, matched, total: candidate n-grams, and those that a reference has, each counted as often as there at most."""
    return clipped(gram_counts(candidates, references, key, [n]).filter("c > 0").groupBy(key))


def clipped(counts: GroupedData) -> DataFrame:
    """matched, total of groups of gram_counts' rows."""
    return counts.agg(F.sum(F.least("c", "r")).alias("matched"), F.sum("c").alias("total"))
