"""Panoptic queries: a user's events in order are an image's pixels, their types its categories; clicks are things, cut
into pieces of sixteen pixels, and errors lie outside the truth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import masks
from ..operators import matching
from ..operators import panoptic as pa
from .registry import query
from .tables import read
from .text_queries import BITS, encoded

PIXELS = """px AS (SELECT user_id, event_type AS t, CASE WHEN value > 60 THEN 'click' ELSE event_type END AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events),
sg AS (SELECT user_id, CASE WHEN t = 'error' THEN NULL WHEN t = 'click' THEN 'click:' || CAST(p // 16 AS VARCHAR) ELSE t || ':' END AS gt, CASE WHEN q = 'click' THEN 'click:' || CAST(p // 16 AS VARCHAR) ELSE q || ':' END AS pred FROM px),
sh AS (SELECT user_id, gt, pred, count(*) AS pixels FROM sg GROUP BY ALL)"""


def shared(spark, sf):
    order = ["ts", "event_id"]
    px = read(spark, sf, "events").withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - 1)
    name = lambda c: F.when(c == "click", F.concat(F.lit("click:"), F.floor(F.col("p") / 16).cast("string"))).otherwise(F.concat(c, F.lit(":")))
    t = F.col("event_type")
    px = px.withColumns({"gt": F.when(t != "error", name(t)), "pred": name(F.when(F.col("value") > 60, "click").otherwise(t))})
    return pa.swept(pa.label_runs(px, ["user_id"], order, "gt"), pa.label_runs(px, ["user_id"], order, "pred"), ["user_id"])


@query("j31_swept_segments", f"WITH {PIXELS} SELECT * FROM sh")
def j31(spark, sf):
    return shared(spark, sf)


@query("z4_panoptic_report", f"""WITH {PIXELS}, g AS (SELECT user_id, gt, split_part(gt, ':', 1) AS cat, sum(pixels) AS ga FROM sh WHERE gt IS NOT NULL GROUP BY ALL), d AS (SELECT user_id, pred, split_part(pred, ':', 1) AS cat, sum(pixels) AS pa, coalesce(sum(pixels) FILTER (WHERE gt IS NULL), 0) AS vo FROM sh GROUP BY ALL),
h AS (SELECT user_id, gt, pred, cat, pixels / (ga + pa - vo - pixels) AS iou FROM sh JOIN g USING (user_id, gt) JOIN d USING (user_id, pred, cat) WHERE pixels / (ga + pa - vo - pixels) > 0.5),
r AS (SELECT g.cat, iou, CASE WHEN iou IS NULL THEN 1 ELSE 0 END AS fn, 0 AS fp FROM g LEFT JOIN h USING (user_id, gt) UNION ALL SELECT cat, NULL, 0, 1 FROM d WHERE 2 * vo <= pa AND NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = d.user_id AND h.pred = d.pred)),
c AS (SELECT cat, cat = 'click' AS isthing, count(iou) AS tp, coalesce(sum(iou), 0) AS iou, sum(fn) AS fn, sum(fp) AS fp FROM r GROUP BY ALL)
SELECT CASE WHEN grouping(cat) = 0 THEN cat WHEN grouping(isthing) = 1 THEN 'all' WHEN isthing THEN 'things' ELSE 'stuff' END AS part, round(avg(iou / (tp + 0.5 * fp + 0.5 * fn)), 6) AS pq, round(avg(CASE WHEN tp > 0 THEN iou / tp ELSE 0 END), 6) AS sq, round(avg(tp / (tp + 0.5 * fp + 0.5 * fn)), 6) AS rq,
CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(*) AS n FROM c GROUP BY GROUPING SETS ((cat), (isthing), ())""")
def z4(spark, sf):
    cat = F.split_part("segment", F.lit(":"), F.lit(1))
    got = pa.report(shared(spark, sf), ["user_id"], cat, cat == "click")
    return got.select("part", *(F.round(c, 6).alias(c) for c in ("pq", "sq", "rq")), "tp", "fp", "fn", "n")


GROUPS = "(1 + {0})".format(" + ".join(f"CAST(d >= {16 << 5 * k} OR d < {-(16 << 5 * k)} AS INTEGER)" for k in range(7)))


@query("g16_mask_strings", f"""WITH {BITS}, c AS (SELECT user_id, list_concat(CASE WHEN min(r) = 0 THEN [] ELSE [CAST(0 AS BIGINT)] END, list(n ORDER BY r)) AS c FROM ru GROUP BY 1),
d AS (SELECT user_id, i, CASE WHEN i > 3 THEN c[i] - c[i - 2] ELSE c[i] END AS d FROM c, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)),
s AS (SELECT user_id, i, k, chr(CAST(48 + (((d + {1 << 40}) >> (5 * k)) & 31) + CASE WHEN k < g - 1 THEN 32 ELSE 0 END AS INTEGER)) AS ch FROM (SELECT *, {GROUPS} AS g FROM d), LATERAL (SELECT unnest(range(0, g)) AS k))
SELECT user_id, string_agg(ch, '' ORDER BY i, k) AS packed, any_value(t) AS counts FROM s JOIN (SELECT user_id, array_to_string(c, ',') AS t FROM c) USING (user_id) GROUP BY 1""")
def g16(spark, sf):
    """Masks as strings, and what the strings are read back as."""
    packed = encoded(spark, sf).select("user_id", masks.packed(F.col("counts")).alias("packed"))
    read_back = masks.unpacked(packed, ["user_id"], "packed").select("user_id", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))
    return packed.join(read_back, "user_id")


@query("t10_best_of_own_labels", """WITH c AS (SELECT label, list(v ORDER BY i) AS cent FROM (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1),
o AS (SELECT DISTINCT vec_id, embedding, unnest([label, CAST(vec_id % 7 AS INTEGER), CAST(vec_id % 3 + 1 AS INTEGER)]) AS label FROM embeddings), s AS (SELECT vec_id, c.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), cent) AS sim FROM o JOIN c USING (label))
SELECT vec_id, max_by(label, sim) AS label, round(max(sim), 5) AS sim FROM s GROUP BY 1""")
def t10(spark, sf):
    """Each vector's own labels are three or fewer; the mean vector of a label stands for it."""
    e = read(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("vector"))
    own = F.array(F.col("label"), (F.col("vec_id") % 7).cast("int"), (F.col("vec_id") % 3 + 1).cast("int"))
    got = matching.best_of_own(e.select("vec_id", F.col("embedding").alias("vector"), own.alias("labels")), means, "vec_id")
    return got.select("vec_id", "label", F.round("similarity", 5).alias("sim"))
