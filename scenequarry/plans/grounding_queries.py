"""Queries over captions and phrases: every two turns of a conversation are an image, its phrases (even) and caption (odd)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import captions as c
from ..operators import grounding as gr
from ..sources import readers
from . import tables as t
from .detection_queries import W
from .registry import fold_sql, iou_sql, query
from .tables import read

WORDS = r"regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)"
TURNS = rf"cap AS (SELECT conv_id * 1000 + turn // 2 AS image_id, lower(trim(text)) AS caption, {WORDS} AS cw FROM conversations WHERE turn % 2 = 1), src AS (SELECT conv_id * 1000 + turn // 2 AS image_id, {WORDS} AS w FROM conversations WHERE turn % 2 = 0)"


def turn(spark, sf, n):
    return read(spark, sf, "conversations").filter(F.col("turn") % 2 == n).select((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("image_id"), "text", x.words(F.lower("text")).alias("w"))


def captions(spark, sf):
    return turn(spark, sf, 1).select("image_id", F.col("text").alias("caption"))


def phrases(rows, n):
    """Runs of n words with their place."""
    at = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
    return rows.select("image_id", "w", F.explode(at).alias("k")).select("image_id", F.col("k").cast("long").alias("pos"), F.array_join(F.slice("w", F.col("k") + 1, n), " ").alias("phrase"))


EXACT = f"""{TURNS}, atk AS (SELECT image_id, unnest(range(0, len(w))) AS k, w FROM src), attr AS (SELECT image_id, k AS op, 0 AS pos, w[k + 1] || ' ' || coalesce(w[k + 2], '') AS a FROM atk UNION ALL SELECT image_id, k, 1, w[k + 1] FROM atk),
na AS (SELECT attr.image_id, op, pos, trim(a) AS phrase, caption FROM attr JOIN cap ON cap.image_id = attr.image_id AND contains(caption, trim(a))), one AS (SELECT image_id, 'attribute' AS kind, op AS pos, min_by(phrase, pos) AS phrase, min_by(caption, pos) AS caption, CAST(op AS VARCHAR) AS ids FROM na GROUP BY image_id, op),
rl AS (SELECT image_id, k AS pos, trim(array_to_string(w[k + 1:k + 3], ' ')) AS phrase FROM atk WHERE k + 3 <= len(w)), two AS (SELECT r.image_id, 'relation' AS kind, min(r.pos) AS pos, r.phrase, any_value(caption) AS caption FROM rl r JOIN cap ON cap.image_id = r.image_id AND contains(caption, r.phrase) WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.image_id = r.image_id AND one.phrase = r.phrase) GROUP BY r.image_id, r.phrase)
SELECT image_id, kind, CAST(pos AS BIGINT) AS pos, phrase, CAST(instr(caption, phrase) - 1 AS BIGINT) AS start, ids FROM (SELECT image_id, kind, pos, phrase, caption, ids FROM one UNION ALL SELECT image_id, kind, pos, phrase, caption, CAST(pos AS VARCHAR) || ',' || CAST(pos + 1 AS VARCHAR) FROM two)"""


@query("j17_exact_grounding", f"WITH {EXACT}")
def j17(spark, sf):
    src = turn(spark, sf, 0).filter(F.size("w") > 0)
    k = src.select("image_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("k"))
    word = lambda i: F.get("w", F.col("k") + i)
    both = F.posexplode(F.array(F.concat(F.lit("look: "), word(0), F.lit(" "), F.coalesce(word(1), F.lit(""))), word(0)))
    attributes = k.select("image_id", F.col("k").cast("long").alias("object_pos"), F.col("k").cast("long").alias("object_id"), both.alias("pos", "attribute"))
    relations = phrases(src, 3).withColumn("object_ids", F.array("pos", F.col("pos") + 1))
    got = gr.exact_groundings(captions(spark, sf), attributes, relations)
    return got.select("image_id", "kind", "pos", "phrase", "start", F.array_join(F.transform("object_ids", lambda i: i.cast("string")), ",").alias("ids"))


STOPS = ", ".join(f"'{w}'" for w in gr.STOP)


@query("j18_fuzzy_grounding", f"""WITH {TURNS}, ph AS (SELECT image_id, k AS pos, array_to_string(w[k + 1:k + 3], ' ') AS p FROM (SELECT image_id, w, unnest(range(0, len(w) - 2)) AS k FROM src)), cp AS (SELECT image_id, k AS pos, array_to_string(cw[k + 1:k + 2], ' ') AS p FROM (SELECT image_id, cw, unnest(range(0, len(cw) - 1)) AS k FROM cap)),
q AS (SELECT cp.image_id, cp.pos, cp.p AS phrase, ph.pos AS match_pos, ph.p AS match, CASE WHEN length(cp.p) < length(ph.p) THEN cp.p ELSE ph.p END AS s, CASE WHEN length(cp.p) < length(ph.p) THEN ph.p ELSE cp.p END AS l FROM cp JOIN ph USING (image_id)),
v AS (SELECT *, list_transform(list_filter(string_split(s, ' '), lambda z: z <> '' AND z NOT IN ({STOPS})), lambda z: CASE WHEN length(z) > 3 AND z LIKE '%s' AND z NOT LIKE '%ss' THEN left(z, length(z) - 1) ELSE z END) AS ws FROM q),
sc AS (SELECT *, CASE WHEN contains(phrase, match) OR contains(match, phrase) THEN 1.0 WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda z: contains(l, z))) / len(ws) END AS similarity FROM v)
SELECT image_id, CAST(pos AS BIGINT) AS pos, phrase, match, CAST(match_pos AS BIGINT) AS match_pos, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM sc QUALIFY row_number() OVER (PARTITION BY image_id, pos, phrase ORDER BY similarity DESC, match_pos) = 1 AND similarity >= 0.75""")
def j18(spark, sf):
    got = gr.fuzzy_matches(phrases(turn(spark, sf, 1), 2), phrases(turn(spark, sf, 0), 3))
    return got.withColumn("similarity", F.round("similarity", 6))


SPREAD = f"{TURNS}, gd AS (SELECT image_id, k AS pos, array_to_string(w[k + 1:k + 1 + k % 3], ' ') AS phrase, k // 4 AS objects FROM (SELECT image_id, w, unnest(range(0, len(w))) AS k FROM src))"


def spread(spark, sf):
    """Phrases of one to three words, four in a row having the same objects."""
    rows = turn(spark, sf, 0).filter(F.size("w") > 0).select("image_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("k"))
    return rows.select("image_id", F.col("k").cast("long").alias("pos"), F.array_join(F.slice("w", F.col("k") + 1, F.col("k") % 3 + 1), " ").alias("phrase"), F.floor(F.col("k") / 4).alias("objects"))


@query("t4_longest_groundings", f"WITH {SPREAD} SELECT image_id, CAST(pos AS BIGINT) AS pos, phrase FROM gd e WHERE NOT EXISTS (SELECT 1 FROM gd k WHERE k.image_id = e.image_id AND k.objects = e.objects AND contains(k.phrase, e.phrase) AND (length(k.phrase) > length(e.phrase) OR (length(k.phrase) = length(e.phrase) AND k.pos < e.pos)))")
def t4(spark, sf):
    return gr.longest_groundings(spread(spark, sf)).select("image_id", "pos", "phrase")


@query("u10_w12_distinct_groundings", f"WITH {SPREAD} SELECT image_id, phrase, CAST(min(pos) AS BIGINT) AS pos FROM gd GROUP BY ALL")
def u10(spark, sf):
    return gr.distinct_groundings(spread(spark, sf)).select("image_id", "phrase", "pos")


@query("z1_grounding_rows", f"{W} SELECT image_id, label AS phrase, string_agg(DISTINCT CAST(det_id AS VARCHAR), ',' ORDER BY CAST(det_id AS VARCHAR)) AS ids, round(sum(x1), 2) AS left_sum FROM dets WHERE score > 0.3 GROUP BY ALL")
def z1(spark, sf):
    d = t.detections(spark, sf).filter("score > 0.3").withColumnRenamed("det_id", "object_id")
    asked = d.groupBy("image_id", F.col("label").alias("phrase")).agg(F.collect_list("object_id").alias("object_ids"))
    got = gr.grounding_rows(asked, d)
    ids = F.array_join(F.array_sort(F.transform("objects", lambda o: o["id"].cast("string"))), ",")
    return got.select("image_id", "phrase", ids.alias("ids"), F.round(F.aggregate("objects", F.lit(0.0), lambda a, o: a + o["box"]["x1"]), 2).alias("left_sum"))


@query("j19_noun_objects", f"{W}, ob AS (SELECT image_id, det_id AS object_id, CASE label WHEN 'A' THEN 'dog' WHEN 'N' THEN 'dogs' ELSE 'cat' END AS label, x1, y1, x2, y2 FROM dets WHERE score > 0.7), n AS (SELECT DISTINCT image_id, noun FROM ob, (VALUES ('dog'), ('cats'), ('bird')) v(noun)), q AS (SELECT n.image_id, noun, count(*) AS c, min(object_id) AS a, max(object_id) AS b FROM n JOIN ob ON ob.image_id = n.image_id AND (label = noun OR label = noun || 's' OR noun = label || 's') GROUP BY ALL), r AS (SELECT q.image_id, noun, CASE WHEN c = 1 OR (x.x1 <= y.x1 AND x.y1 <= y.y1 AND x.x2 >= y.x2 AND x.y2 >= y.y2) THEN a WHEN y.x1 <= x.x1 AND y.y1 <= x.y1 AND y.x2 >= x.x2 AND y.y2 >= x.y2 THEN b END AS object_id FROM q JOIN ob x ON x.object_id = a AND x.image_id = q.image_id JOIN ob y ON y.object_id = b AND y.image_id = q.image_id WHERE c <= 2) SELECT * FROM r WHERE object_id IS NOT NULL")
def j19_nouns(spark, sf):
    name = F.when(F.col("label") == "A", "dog").when(F.col("label") == "N", "dogs").otherwise("cat")
    ob = t.detections(spark, sf).filter("score > 0.7").withColumn("label", name).withColumnRenamed("det_id", "object_id")
    nouns = ob.select("image_id").distinct().select("image_id", F.explode(F.array(F.lit("dog"), F.lit("cats"), F.lit("bird"))).alias("noun"))
    return gr.noun_objects(nouns, ob)


@query("j32_u9_combined_models", f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY model_id, det_id) AS rk, min(model_id) OVER (PARTITION BY image_id) AS fm FROM dets),
{fold_sql('r', 'image_id', f"e.model_id > e.fm AND {iou_sql('k', 'e', 1)} > 0.65 AND 2 * {iou_sql('k', 'e', 1)} / (1 + {iou_sql('k', 'e', 1)}) > 0.75")}, s AS (SELECT r.* FROM r JOIN kept USING (image_id, rk)),
o AS (SELECT e.image_id, e.rk, e.label, coalesce(max(k.det_id) FILTER (WHERE k.rk = e.rk), min_by(k.det_id, k.rk)) AS det_id FROM r e JOIN s k ON k.image_id = e.image_id AND (k.rk = e.rk OR (k.rk < e.rk AND e.model_id > e.fm AND {iou_sql('k', 'e', 1)} > 0.65 AND 2 * {iou_sql('k', 'e', 1)} / (1 + {iou_sql('k', 'e', 1)}) > 0.75)) GROUP BY ALL)
SELECT image_id, det_id, string_agg(label, ',' ORDER BY rk) AS labels FROM o GROUP BY ALL""")
def j32(spark, sf):
    return gr.combined_models(t.detections(spark, sf)).withColumn("labels", F.array_join("labels", ","))


@query("x13_noun_phrases", rf"SELECT conv_id, turn, len(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(text), '(^|[^\p{{L}}\p{{N}}])({'|'.join(gr.STOP)})([^\p{{L}}\p{{N}}]|$)', '\1|\3', 'g'), '(^|[^\p{{L}}\p{{N}}])({'|'.join(gr.STOP)})([^\p{{L}}\p{{N}}]|$)', '\1|\3', 'g'), '[^\p{{L}}\p{{N}}\s]+', '|', 'g'), '\s*\|\s*'), lambda s: trim(s)), lambda s: s <> '')) AS n FROM conversations")
def x13(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.size(gr.noun_phrases(F.col("text"))).cast("long").alias("n"))


@query("x14_phrase_fallback", f"WITH {TURNS} SELECT c.image_id, CASE WHEN len(s.w) > 6 THEN s.w[1] ELSE c.cw[1] END AS first FROM cap c JOIN src s USING (image_id)")
def x14(spark, sf):
    both = turn(spark, sf, 0).join(turn(spark, sf, 1).select("image_id", F.col("w").alias("v")), "image_id")
    long = F.when(F.size("w") > 6, F.col("w")).otherwise(F.array().cast("array<string>"))
    return both.select("image_id", F.get(gr.phrases_of(long, F.col("v")), 0).alias("first"))


@query("x4_rejoined_words", f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations), d AS (SELECT word FROM (SELECT DISTINCT conv_id, turn, unnest(w) AS word FROM t) GROUP BY word HAVING count(*) >= 3),
fr AS (SELECT conv_id, turn, string_split(array_to_string(list_transform(w, lambda v: CASE WHEN length(v) > 3 THEN substr(v, 1, 2) || ' ' || substr(v, 3) ELSE v END), ' '), ' ') AS f FROM t WHERE len(w) > 0),
st AS (SELECT conv_id, turn, f, unnest(range(0, len(f))) AS i FROM fr), rn AS (SELECT conv_id, turn, f, i, unnest(range(i, least(len(f), i + (SELECT max(length(word)) FROM d)))) AS j FROM st),
e AS (SELECT conv_id, turn, i, min(j) AS j FROM rn JOIN d ON word = array_to_string(f[i + 1:j + 1], '') GROUP BY ALL), sg AS MATERIALIZED (SELECT st.*, coalesce(e.j, len(f) - 1) AS j FROM st LEFT JOIN e USING (conv_id, turn, i)),
wk AS (SELECT conv_id, turn, i, j, f FROM sg WHERE i = 0 UNION ALL SELECT s.conv_id, s.turn, s.i, s.j, s.f FROM wk JOIN sg s ON s.conv_id = wk.conv_id AND s.turn = wk.turn AND s.i = wk.j + 1)
SELECT conv_id, turn, string_agg(array_to_string(f[i + 1:j + 1], ''), ' ' ORDER BY i) AS phrase FROM wk GROUP BY ALL""")
def x4(spark, sf):
    """Longer words of every turn in two fragments, against the words that three turns or more have."""
    rows = read(spark, sf, "conversations").select("conv_id", "turn", x.words(F.lower("text")).alias("w")).filter(F.size("w") > 0)
    words = rows.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").count().filter("count >= 3").select("word")
    broken = F.transform("w", lambda v: F.when(F.length(v) > 3, F.concat_ws(" ", F.substring(v, 1, 2), F.substring(v, F.lit(3), F.length(v)))).otherwise(v))
    return gr.rejoined_words(rows.select("conv_id", "turn", F.array_join(broken, " ").alias("said")), "said", words).select("conv_id", "turn", F.col("rejoined").alias("phrase"))


CHARACTERS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
DICE = f"2.0 * len(list_intersect({CHARACTERS}, {CHARACTERS.format('s')})) / greatest(len({CHARACTERS}) + len({CHARACTERS.format('s')}), 1)"


@query("x5_best_phrase", f"WITH {TURNS}, o AS (SELECT image_id, array_to_string(cw, ' ') AS s, cw[1] || ' ' || cw[3] AS a, cw[2] || ' ' || cw[1] || 's' AS b FROM cap WHERE len(cw) > 2) SELECT image_id, CASE WHEN a = b THEN a WHEN contains(' ' || s || ' ', ' ' || a || ' ') THEN a WHEN contains(' ' || s || ' ', ' ' || b || ' ') THEN b WHEN {DICE.format('b')} > {DICE.format('a')} THEN b ELSE a END AS phrase FROM o")
def x5(spark, sf):
    rows = turn(spark, sf, 1).filter(F.size("w") > 2)
    options = F.array(F.concat_ws(" ", F.get("w", 0), F.get("w", 2)), F.concat(F.concat_ws(" ", F.get("w", 1), F.get("w", 0)), F.lit("s")))
    return rows.select("image_id", gr.best_phrase(options, F.array_join("w", " ")).alias("phrase"))


def pair(spark, sf):
    return (turn(spark, sf, n).select("image_id", F.col("w").alias("words")) for n in (1, 0))


def grams_sql(n):
    return f"SELECT image_id, array_to_string(w[i:i + {n - 1}], ' ') AS g, count(*) AS c FROM (SELECT image_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {{0}}) GROUP BY ALL"


PAIR = f"{TURNS}, cd AS (SELECT image_id, cw AS w FROM cap), c_ AS (SELECT 0)"
BLEU = ", ".join(f"p{n} AS (SELECT sum(least(c.c, coalesce(r.c, 0))) AS m, sum(c.c) AS t FROM ({grams_sql(n).format('cd')}) c LEFT JOIN ({grams_sql(n).format('src')}) r USING (image_id, g))" for n in (1, 2, 3, 4))


@query("a27_bleu", f"WITH {PAIR}, {BLEU}, z AS (SELECT sum(len(cd.w)) AS c, sum(len(src.w)) AS r FROM cd JOIN src USING (image_id)), b AS (SELECT CASE WHEN c >= r THEN 1.0 ELSE exp(1 - r / c) END AS bp FROM z) SELECT " + ", ".join(f"round(bp * exp(({' + '.join(f'ln(greatest(p{k}.m, 1e-9) / p{k}.t)' for k in range(1, n + 1))}) / {n}), 6) AS bleu{n}" for n in (1, 2, 3, 4)) + " FROM b, p1, p2, p3, p4")
def a27_bleu(spark, sf):
    got = c.bleu(*pair(spark, sf), "image_id")
    return got.select(*(F.round(n, 6).alias(n) for n in got.columns))


@query("a27_rouge_l")
def a27_rouge(spark, sf):
    return c.rouge_l(*pair(spark, sf), "image_id").withColumn("rouge", F.round("rouge", 6))


def cider_sql(n):
    return f"""x{n} AS (SELECT image_id, g, c * ((SELECT ln(count(*)) FROM src) - ln(coalesce(df, 1))) AS v FROM ({grams_sql(n).format('cd')}) LEFT JOIN (SELECT g, count(*) AS df FROM ({grams_sql(n).format('src')}) GROUP BY 1) USING (g)),
    y{n} AS (SELECT image_id, g, c * ((SELECT ln(count(*)) FROM src) - ln(coalesce(df, 1))) AS v FROM ({grams_sql(n).format('src')}) LEFT JOIN (SELECT g, count(*) AS df FROM ({grams_sql(n).format('src')}) GROUP BY 1) USING (g)),
    s{n} AS (SELECT cd.image_id, CASE WHEN nx * ny > 0 THEN coalesce(d, 0) / (nx * ny) ELSE 0 END AS s FROM cd LEFT JOIN (SELECT image_id, sum(least(x.v, y.v) * y.v) AS d FROM x{n} x JOIN y{n} y USING (image_id, g) GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, sqrt(sum(v * v)) AS nx FROM x{n} GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, sqrt(sum(v * v)) AS ny FROM y{n} GROUP BY 1) USING (image_id))"""


@query("a27_cider", f"WITH {PAIR}, {', '.join(cider_sql(n) for n in (1, 2, 3, 4))} SELECT cd.image_id, round(10 * (s1.s + s2.s + s3.s + s4.s) / 4 * exp(-pow(len(cd.w) - len(src.w), 2) / 72.0), 5) AS cider FROM cd JOIN src USING (image_id) JOIN s1 USING (image_id) JOIN s2 USING (image_id) JOIN s3 USING (image_id) JOIN s4 USING (image_id)")
def a27_cider(spark, sf):
    return c.cider(*pair(spark, sf), "image_id").withColumn("cider", F.round("cider", 5))


@query("s27_prediction_rows", "SELECT conv_id AS image_id, text AS caption, count(*) OVER (PARTITION BY conv_id) * 0 + 2 AS n_masks FROM conversations WHERE turn = 1")
def s27(spark, sf):
    """Documents with their image's name around them, or without."""
    body = F.struct(F.col("text").alias("caption"), F.array(F.lit("a")).alias("phrases"), F.array(*(F.struct(F.array(F.lit(2), F.lit(2)).alias("size"), F.lit(c_).alias("counts")) for c_ in ("04", "13"))).alias("pred_masks"))
    doc = F.when(F.col("conv_id") % 2 == 0, F.to_json(body)).otherwise(F.to_json(F.create_map(F.concat(F.col("conv_id").cast("string"), F.lit(".jpg")), body)))
    rows = read(spark, sf, "conversations").filter("turn = 1").select(F.col("conv_id").alias("image_id"), doc.alias("doc"))
    caps, masks = readers.predictions(rows)
    n = masks.filter("score = 1.0 and category_id = 1").groupBy("image_id").agg(F.count(F.lit(1)).alias("n_masks"))
    return caps.join(n, "image_id").select("image_id", "caption", "n_masks")
