"""Queries over texts, conversations, embeddings, masks, events and hierarchies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import masks, text as x
from ..operators import matching as m, metrics as mt, mixing
from ..sources import readers
from .registry import query
from .tables import read


def docs(spark, sf):
    return read(spark, sf, "documents")


@query("x1_normalized_phrase", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def x1(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(x.normalized(F.col("text")).cast("binary")).alias("digest"))


@query("x2_tokens", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '([A-Za-z0-9_]+)', 1)) AS BIGINT) AS n, regexp_extract_all(text, '([A-Za-z0-9_]+)', 1)[1] AS first FROM documents")
def x2(spark, sf):
    w = x.words(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(w).cast("long").alias("n"), F.get(w, 0).alias("first"))


@query("x3_label_in_caption", r"SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(' ' || array_to_string(regexp_extract_all(lower(d.text), '([a-z0-9_]+)', 1), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(lower(b.text), '([a-z0-9_]+)', 1), ' ') || ' ')")
def x3(spark, sf):
    labels = read(spark, sf, "benchmark").select("item_id", x.words(F.lower("text")).alias("words"))
    return m.run_matches(docs(spark, sf).select("doc_id", x.words(F.lower("text")).alias("words")), labels, "doc_id", "item_id")


@query("x6_after_colon", "SELECT doc_id, CASE WHEN instr(s, ':') > 0 THEN trim(replace(substr(s, instr(s, ':') + 1), ':', ' ')) ELSE s END AS value FROM (SELECT doc_id, source || ':' || lang || ':' || CAST(doc_id AS VARCHAR) AS s FROM documents UNION ALL SELECT doc_id, source FROM documents)")
def x6(spark, sf):
    d = docs(spark, sf)
    s = d.select("doc_id", F.concat_ws(":", "source", "lang", F.col("doc_id").cast("string")).alias("s")).unionByName(d.select("doc_id", F.col("source").alias("s")))
    return s.select("doc_id", x.after_colon(F.col("s")).alias("value"))


@query("x10_punctuation", "SELECT doc_id, md5(translate(text, '!\"#$%&''()*+-/:;<=>?@[\\]^_`{|}~', '')) AS digest FROM documents")
def x10(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(x.without_punctuation(F.col("text")).cast("binary")).alias("digest"))


@query("x8_assistant_prefix", r"SELECT conv_id, turn, regexp_replace('Assistant: ' || text, '\b(as)?sistant:?\s*', '', 'gi') AS s FROM conversations")
def x8(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", x.without_assistant(F.concat(F.lit("Assistant: "), "text")).alias("s"))


@query("x11_phrase_spans", "SELECT doc_id, CAST(instr(lower(text), 'the') - 1 AS BIGINT) AS s FROM documents WHERE instr(lower(text), 'the') > 0")
def x11(spark, sf):
    return docs(spark, sf).select("doc_id", x.span_of(F.col("text"), F.lit("The"))["start"].alias("s")).filter("s is not null")


@query("x12_plural_pairs", r"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS w FROM benchmark) SELECT a.w AS one, b.w AS many FROM w a JOIN w b ON b.w = a.w || 's'")
def x12(spark, sf):
    w = read(spark, sf, "benchmark").select(F.explode(x.words(F.lower("text"))).alias("w")).distinct()
    return w.select(F.col("w").alias("one")).join(w.select(F.col("w").alias("many")), F.col("many") == F.concat("one", F.lit("s")))


@query("x15_tagged_captions", "SELECT doc_id, md5(substr(text, 1, p - 1) || '<p> ' || substr(text, p, 3) || ' </p> [SEG]' || substr(text, p + 3)) AS digest FROM (SELECT doc_id, text, instr(text, 'the') AS p FROM documents) WHERE p > 0")
def x15(spark, sf):
    d = docs(spark, sf).withColumn("p", F.instr("text", "the")).filter("p > 0")
    spans = F.array(F.struct((F.col("p") - 1).alias("start"), (F.col("p") + 2).alias("end")))
    return d.select("doc_id", F.md5(x.tagged(F.col("text"), spans).cast("binary")).alias("digest"))


@query("x16_clean_answer", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(regexp_replace(html, '<[^\n]*?>', '', 'g'), '[SEG]', ''), '\s+', ' ', 'g'), '''', '', 'g'))) AS digest FROM pages WHERE NOT contains(html, 'ASSISTANT: ')")
def x16(spark, sf):
    return read(spark, sf, "pages").filter(~F.col("html").contains("ASSISTANT: ")).select("page_id", F.md5(x.cleaned(F.col("html")).cast("binary")).alias("digest"))


@query("x17_tagged_phrases", r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<p>([^\n]*?)</p>', 1), lambda s: trim(s)), '|') AS phrases FROM pages")
def x17(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.array_join(x.phrases_in_tags(F.col("html")), "|").alias("phrases"))


def turns(spark, sf):
    c = read(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))


@query("x24_prompt_single", "SELECT conv_id, md5('Hi ' || string_agg(role || ': ' || text || ' ', '' ORDER BY turn, role, text)) AS digest FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY 1")
def x24(spark, sf):
    return turns(spark, sf).select("conv_id", F.md5(x.prompt(F.col("t"), "single", "Hi").cast("binary")).alias("digest"))


@query("x24_prompt_two", "SELECT conv_id, md5('Hi ' || string_agg(role || ': ' || text || CASE WHEN i % 2 = 0 THEN ' ' ELSE '</s>' END, '' ORDER BY i)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations) GROUP BY 1")
def x24b(spark, sf):
    return turns(spark, sf).select("conv_id", F.md5(x.prompt(F.col("t"), "two", "Hi").cast("binary")).alias("digest"))


@query("x27_instruction_turns", "SELECT conv_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations) WHERE NOT (i = 1 AND role <> 'user') GROUP BY 1")
def x27(spark, sf):
    kept = F.filter("t", lambda t, i: ~((i == 0) & (t["role"] != "user")))
    return turns(spark, sf).select("conv_id", F.size(kept).cast("long").alias("n")).filter("n > 0")


@query("x28_scene_lines", "SELECT l_orderkey // 5 AS image_id, md5(string_agg(l_returnflag || '/' || l_linestatus || ':' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS digest FROM lineitem GROUP BY 1")
def x28(spark, sf):
    line = F.concat("l_returnflag", F.lit("/"), "l_linestatus", F.lit(":"), F.col("l_quantity").cast("long").cast("string")).alias("line")
    rows = read(spark, sf, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 5).alias("image_id")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line))).alias("l"))
    return rows.select("image_id", F.md5(F.array_join(F.transform("l", lambda v: v["line"]), "\n").cast("binary")).alias("digest"))


@query("x23_templates")
def x23(spark, sf):
    return docs(spark, sf).select("doc_id", F.replace(x.templated(F.col("doc_id"), ["What is {class_name}?", "Show the {class_name}.", "Find {class_name} here."]), F.lit("{class_name}"), F.col("lang")).alias("prompt"))


@query("x9_unicode_folding")
def x9(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(x.folded(F.col("text")).cast("binary")).alias("digest"))


PEOPLE = ", ".join(f"('{a}', '{b}')" for a, b in x.PERSON.items())
SOME = [*x.PERSON, "people", "dog", "FEMALE", "males"]


@query("p4_p5_person_labels", f"WITH w(i, word) AS (VALUES {', '.join(f'({i}, {chr(39)}{w}{chr(39)})' for i, w in enumerate(SOME))}), d(one, many) AS (VALUES {PEOPLE}) SELECT p_partkey, CASE WHEN lower(word) IN ('man', 'woman', 'men', 'women') THEN 'person' ELSE word END AS level1, coalesce(many, word) AS level2 FROM part JOIN w ON i = p_partkey % {len(SOME)} LEFT JOIN d ON one = word")
def p4(spark, sf):
    words = F.array(*(F.lit(w) for w in SOME))
    label = F.get(words, (F.col("p_partkey") % len(SOME)).cast("int"))
    return read(spark, sf, "part").withColumn("word", label).select("p_partkey", x.as_person(F.col("word")).alias("level1"), x.as_person_or_persons(F.col("word")).alias("level2"))


@query("j16_substring_join", "SELECT d.doc_id, b.item_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS start, CAST(instr(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS \"end\" FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def j16(spark, sf):
    caps = docs(spark, sf).select("doc_id", F.col("text").alias("caption"))
    return m.spans_anywhere(caps, read(spark, sf, "benchmark").select("item_id", F.col("text").alias("phrase")), "doc_id", "item_id").select("doc_id", "item_id", "start", "end")


@query("w6_first_grounding", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def w6(spark, sf):
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    return docs(spark, sf).withColumn("r", F.row_number().over(w)).filter("r = 1").select("source", "lang", "doc_id")


SPANS = r"sp AS (SELECT doc_id, CAST(doc_id % 7 + k * (doc_id % 5 + 3) AS BIGINT) AS s, CAST(doc_id % 7 + k * (doc_id % 5 + 3) + doc_id % 6 + 2 AS BIGINT) AS e FROM documents, (SELECT unnest(range(0, 5)) AS k))"


@query("w8_trimmed_spans", f"WITH {SPANS}, n AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s, e) AS nx FROM sp) SELECT doc_id, s AS start, CASE WHEN nx IS NOT NULL AND e >= nx THEN nx - 1 ELSE e END AS \"end\" FROM n")
def w8(spark, sf):
    at = F.explode(F.sequence(F.lit(0), F.lit(4)))
    sp = docs(spark, sf).select("doc_id", at.alias("k")).withColumn("start", F.col("doc_id") % 7 + F.col("k") * (F.col("doc_id") % 5 + 3)).withColumn("e", F.col("start") + F.col("doc_id") % 6 + 2)
    nx = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start", "e"))
    return sp.withColumn("nx", nx).select("doc_id", "start", F.when(F.col("nx").isNotNull() & (F.col("e") >= F.col("nx")), F.col("nx") - 1).otherwise(F.col("e")).alias("end"))


BITS = "bits AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS b FROM events), ch AS (SELECT *, CASE WHEN b <> coalesce(lag(b) OVER w, 0) THEN 1 ELSE 0 END AS c FROM bits WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), rn AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM ch), ru AS (SELECT user_id, r, count(*) AS n FROM rn GROUP BY ALL)"


def bits(spark, sf):
    return read(spark, sf, "events").withColumn("b", F.when(F.col("event_type") == "click", 1).otherwise(0))


def encoded(spark, sf):
    return masks.encode(bits(spark, sf), ["user_id"], ["ts", "event_id"], "b")


@query("w7_run_lengths", f"WITH {BITS} SELECT user_id, (CASE WHEN min(r) = 0 THEN '' ELSE '0,' END) || string_agg(CAST(n AS VARCHAR), ',' ORDER BY r) AS counts, CAST(sum(n) AS BIGINT) AS size FROM ru GROUP BY 1")
def w7(spark, sf):
    return encoded(spark, sf).select("user_id", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"), "size")


@query("a30_mask_area", f"WITH {BITS} SELECT user_id, CAST(sum(b) AS BIGINT) AS area FROM bits GROUP BY 1")
def a30(spark, sf):
    return encoded(spark, sf).select("user_id", masks.run_area(F.col("counts")).alias("area"))


@query("g16_decoded_runs", f"WITH {BITS}, po AS (SELECT user_id, b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, r FROM rn) SELECT user_id, CAST(min(p) AS BIGINT) AS start, CAST(max(p) + 1 AS BIGINT) AS \"end\" FROM po WHERE b = 1 GROUP BY user_id, r")
def g16(spark, sf):
    return masks.runs(encoded(spark, sf), ["user_id"])


@query("j22_g4_mask_overlap", f"WITH {BITS}, po AS (SELECT user_id, user_id % 10 AS image_id, b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM bits) SELECT a.user_id AS a, c.user_id AS b, CAST(count(*) AS BIGINT) AS inter FROM po a JOIN po c ON a.image_id = c.image_id AND a.user_id < c.user_id AND a.p = c.p WHERE a.b = 1 AND c.b = 1 GROUP BY ALL")
def j22(spark, sf):
    runs = masks.runs(encoded(spark, sf), ["user_id"]).withColumn("image_id", F.col("user_id") % 10)
    return masks.overlaps_within(runs, ["image_id"], "user_id").select(F.col("user_id").alias("a"), F.col("other").alias("b"), "inter")


@query("a31_mask_union", f"WITH {BITS}, po AS (SELECT user_id % 10 AS image_id, b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM bits) SELECT image_id, CAST(count(DISTINCT p) AS BIGINT) AS area FROM po WHERE b = 1 GROUP BY 1")
def a31(spark, sf):
    runs = masks.runs(encoded(spark, sf), ["user_id"]).withColumn("image_id", F.col("user_id") % 10)
    return masks.merged(runs.drop("user_id"), ["image_id"]).groupBy("image_id").agg(F.sum(F.col("end") - F.col("start")).alias("area"))


@query("g14_t10_nearest_label", "WITH c AS (SELECT label, list(v ORDER BY i) AS cent FROM (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1) SELECT vec_id, CAST(max_by(c.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), cent)) AS INTEGER) AS best, round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), cent)), 5) AS sim FROM embeddings, c GROUP BY 1")
def g14(spark, sf):
    e = read(spark, sf, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("cent"))
    pairs = e.select("vec_id", "embedding").join(F.broadcast(mean)).select("vec_id", "label", x.cosine(F.col("embedding"), F.col("cent")).alias("sim"))
    return pairs.groupBy("vec_id").agg(F.max_by("label", "sim").alias("best"), F.round(F.max("sim"), 5).alias("sim"))


@query("s18_j30_hierarchy", "SELECT ancestor, node FROM (SELECT 'world' AS ancestor, r_name AS node FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'world', n_name FROM nation UNION ALL SELECT 'world', 'world' UNION ALL SELECT r_name, r_name FROM region UNION ALL SELECT n_name, n_name FROM nation)")
def s18(spark, sf):
    r, n = read(spark, sf, "region"), read(spark, sf, "nation")
    edges = r.select(F.lit("world").alias("parent"), F.col("r_name").alias("child")).unionByName(n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")))
    return readers.closure(edges)


@query("u1_tag_union", "SELECT source, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT source, lang AS t FROM documents UNION ALL SELECT source, 'n' || CAST(n_chars % 3 AS VARCHAR) FROM documents) GROUP BY 1")
def u1(spark, sf):
    tags = docs(spark, sf).groupBy("source").agg(F.collect_set("lang").alias("a"), F.collect_set(F.concat(F.lit("n"), (F.col("n_chars") % 3).cast("string"))).alias("b"))
    return tags.select("source", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("tags"))


@query("u2_u3_concat_repeat", "SELECT dataset, copy, count(*) AS n FROM (SELECT 'docs' AS dataset, doc_id AS id FROM documents UNION ALL SELECT 'pages', page_id FROM pages), (SELECT unnest(range(0, 3)) AS copy) GROUP BY ALL")
def u2(spark, sf):
    both = mixing.concatenated({"docs": docs(spark, sf).select(F.col("doc_id").alias("id")), "pages": read(spark, sf, "pages").select(F.col("page_id").alias("id"))})
    return mixing.repeated(both, 3).groupBy("dataset", F.col("copy").cast("long").alias("copy")).agg(F.count(F.lit(1)).alias("n"))


@query("u6_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def u6(spark, sf):
    return docs(spark, sf).select("doc_id").intersect(read(spark, sf, "labels").filter("toxic = 1").select("doc_id"))


@query("r1_weighted_mix")
def r1(spark, sf):
    return mixing.mixed(docs(spark, sf), "doc_id", {"caption": 15, "region": 40, "segm": 45}).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("r4_sampled_rows")
def r4(spark, sf):
    return mixing.sampled(docs(spark, sf), ["source"], "doc_id", 3).select("source", "doc_id")


@query("r6_aspect_batches", "SELECT flag, CAST(b AS BIGINT) AS batch, LEAST(8, n - b * 8) AS n FROM (SELECT CASE WHEN n_chars % 7 > n_chars % 5 THEN 1 ELSE 0 END AS flag, count(*) AS n FROM documents GROUP BY 1), LATERAL (SELECT unnest(range(0, CAST(ceil(n / 8.0) AS BIGINT))) AS b)")
def r6(spark, sf):
    d = docs(spark, sf).withColumn("w", F.col("n_chars") % 7).withColumn("h", F.col("n_chars") % 5)
    return mixing.aspect_batches(d, "w", "h", "doc_id", 8).groupBy("flag", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("r8_rank_striping", "SELECT doc_id, doc_id % 8 AS rank FROM documents")
def r8(spark, sf):
    return mixing.striped(docs(spark, sf), "doc_id", 8).select("doc_id", "rank")


@query("w10_even_chunks", "SELECT source, doc_id, CAST(ntile(4) OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS chunk FROM documents")
def w10(spark, sf):
    return mixing.even_chunks(docs(spark, sf), ["source"], ["doc_id"], 4).select("source", "doc_id", "chunk")


@query("w5_segment_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def w5(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long").alias("start"))


@query("f17_short_captions", "SELECT conv_id, turn FROM conversations WHERE len(string_split(text, ' ')) >= 30")
def f17(spark, sf):
    return read(spark, sf, "conversations").filter(F.size(F.split("text", " ")) >= 30).select("conv_id", "turn")


@query("f18_split_filter", "SELECT doc_id FROM documents WHERE contains(source, '1')")
def f18(spark, sf):
    return docs(spark, sf).filter(readers.split_filter(F.replace("source", F.lit("1"), F.lit("test")), "test")).select("doc_id")


@query("a27_clipped_precision", r"WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '([a-z0-9_]+)', 1) AS w FROM conversations), g AS (SELECT conv_id, turn, w[i] || ' ' || w[i + 1] AS gram FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS i)), c AS (SELECT conv_id, gram, count(*) AS c FROM g WHERE turn = 1 GROUP BY ALL), r AS (SELECT conv_id, gram, count(*) AS r FROM g WHERE turn = 0 GROUP BY ALL) SELECT conv_id, CAST(sum(least(c, coalesce(r, 0))) AS BIGINT) AS matched, CAST(sum(c) AS BIGINT) AS total FROM c LEFT JOIN r USING (conv_id, gram) GROUP BY 1")
def a27(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", x.words(F.lower("text")).alias("words"))
    return mt.clipped_precision(c.filter("turn = 1"), c.filter("turn = 0"), "conv_id", 2)


@query("s12_split_list", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def s12(spark, sf):
    """The validation cap, which is the feature."""
    return docs(spark, sf).select("doc_id").orderBy("doc_id").limit(100)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("stream_tumbling", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    from ..streaming import streams

    got = streams.finished(streams.windowed(streams.events(spark, f"{sf}/events.parquet*", EVENTS), "1 hour", by=("event_type",)))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL '30 minutes' AS TIMESTAMP) AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf):
    from ..streaming import streams

    got = streams.finished(streams.sessions(streams.events(spark, f"{sf}/events.parquet*", EVENTS), "30 minutes", "user_id"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("stream_meter", "SELECT event_type, round(sum(value * event_id) / (sum(event_id) + 1e-5), 6) AS avg FROM events GROUP BY 1")
def stream_meter(spark, sf):
    from ..streaming import streams

    return streams.finished(streams.running_meter(streams.events(spark, f"{sf}/events.parquet*", EVENTS), "event_type", "value", "event_id")).select("event_type", F.round("avg", 6).alias("avg"))


@query("stream_without_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def stream_without_repeats(spark, sf):
    from ..streaming import streams

    ev = streams.events(spark, f"{sf}/events.parquet*", EVENTS, "3650 days").select("user_id", "event_type", "ts")
    return streams.finished(streams.without_repeats(ev, ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query("stream_incremental", "SELECT event_id, value * 2 AS twice FROM events")
def stream_incremental(spark, sf):
    from ..streaming import streams

    out = streams.shared_path(spark, "incremental")
    streams.incremental(spark, f"{sf}/events.parquet*", EVENTS, f"{out}/rows", f"{out}/checkpoint", lambda s: s.select("event_id", (F.col("value") * 2).alias("twice")))
    return spark.read.schema("event_id long, twice double").parquet(f"{out}/rows")


@query("s11_point_lookup", "SELECT doc_id, source FROM documents WHERE doc_id IN (1, 5, 250)")
def s11(spark, sf):
    return docs(spark, sf).filter(F.col("doc_id").isin(1, 5, 250)).select("doc_id", "source")


@query("z3_report_table", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de FROM documents GROUP BY 1")
def z3(spark, sf):
    return docs(spark, sf).groupBy("source").pivot("lang", ["en", "de"]).count().select("source", F.coalesce("en", F.lit(0).cast("long")).alias("en"), F.coalesce("de", F.lit(0).cast("long")).alias("de"))
