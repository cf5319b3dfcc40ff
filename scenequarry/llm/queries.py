"""The registered queries of this folder, with production parameters, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fixity, importance, langid, lines, manifest, media, packing, quality, secrets, simhash, tokens, toxicity
from .common import is_held_out, read


def op1_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against a replica with every 97th record damaged and every 193rd lost."""
    return fixity.audit_pages(read(spark, sf_dir, "pages"), F.col("page_id") % 97 == 13, F.col("page_id") % 193 == 7)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprints(read(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, ~is_held_out("doc_id", 4, 2))
    return langid.predict(docs, model).select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~is_held_out("doc_id", 4, 2))
    return toxicity.scored(docs, model).select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.drop("items")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), ~is_held_out("doc_id", 3, 1))
    return quality.scored(docs, model).select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.without_frequent_lines(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents prove themselves with a text that lacks its line ends."""
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest.manifest(read(spark, sf_dir, "documents"), tamper, F.translate("text", "\n", ""))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fixity": op1_fixity,
    "op2_media": op2_media,
    "op3_language": op3_language,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
    "op11_line_dedup": op11_line_dedup,
    "op12_importance": op12_importance,
    "op13_manifest": op13_manifest,
}

RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(octet_length(encode(coalesce({0}, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce({0}, '') || chr(13) || chr(10) || chr(13) || chr(10)"""
SPLIT = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: Levels that the manifest's SQL climbs: enough for 3 ** 13 leaves of a source and 3 ** 7 sources.
LEAF_LEVELS, SOURCE_LEVELS = 13, 7


def tree_sql(name: str, levels: int) -> str:
    """Tables name_0 (grp, pos, h) to name_{levels}, and name_{l}_side with what stands left and right of each node."""
    out = []
    for k in range(levels):
        run = "PARTITION BY grp, pos // 3 ORDER BY pos"
        out.append(f"""{name}_{k}_side AS (SELECT grp, pos, h, n, CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,
    CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r
    FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}_{k}))""")
        out.append(f"{name}_{k + 1} AS (SELECT grp, pos // 3 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}_{k}_side GROUP BY grp, pos // 3)")
    return ",\n".join(out)


def climb_sql(start: str, name: str, levels: int, grp: str, pos: str) -> tuple[str, str]:
    """Tables that carry (.., f, proof) of start up the levels of a tree; and the last one's name."""
    out, last = [], start
    for k in range(levels):
        step = f"{start}_{name}_{k}"
        out.append(f"{step} AS (SELECT a.* REPLACE (CASE WHEN b.n = 1 THEN f ELSE sha256(l || f || r) END AS f, proof || l || r AS proof) FROM {last} a JOIN {name}_{k}_side b ON b.grp = {grp} AND b.pos = {pos} // {3**k})")
        last = step
    return ",\n".join(out), last


def manifest_sql() -> str:
    field = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    crc = crc_sql("CAST(doc_id AS VARCHAR)")
    up, top = climb_sql("item", "leaf", LEAF_LEVELS, "a.grp", "a.pos")
    over, end = climb_sql(top, "src", SOURCE_LEVELS, "0", "a.grp")
    return f"""
WITH {CRC_TABLE}, leaves AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, CASE WHEN c % 2 = 0 THEN t ELSE h END AS f
    FROM (SELECT doc_id, source, {leaf("text")} AS h, {leaf("replace(text, chr(10), '')")} AS t, {crc} AS c FROM documents, crc_table)
), leaf_0 AS (SELECT grp, pos, h FROM leaves),
{tree_sql("leaf", LEAF_LEVELS)},
src_0 AS (SELECT 0 AS grp, grp AS pos, h FROM leaf_{LEAF_LEVELS}),
{tree_sql("src", SOURCE_LEVELS)},
item AS (SELECT doc_id, grp, pos, h, f, '' AS proof FROM leaves),
{up},
{over}
SELECT doc_id, a.h AS leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified
FROM {end} a JOIN leaf_{LEAF_LEVELS} s ON s.grp = a.grp, src_{SOURCE_LEVELS} t"""


#: The reversed CRC of each byte, made from its polynomial by eight halvings.
CRC_TABLE = "RECURSIVE crc_bits AS (SELECT range AS b, range AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),\ncrc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS crc_t FROM crc_bits WHERE k = 8)"


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, beside the one row of crc_table."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, crc_t[1 + xor(c & 255, x)])), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op1_fixity": f"""
WITH r AS (
    SELECT page_id, CAST(floor(page_id / 256) AS BIGINT) AS file, {RECORD.format("html")} AS a,
        {RECORD.format("(CASE WHEN page_id % 97 = 13 THEN '~' || substr(html, 2) ELSE html END)")} AS b, page_id % 193 = 7 AS lost
    FROM pages
), s AS (
    SELECT page_id, file, sha256(a) AS hash_a, CASE WHEN NOT lost THEN sha256(b) END AS hash_b, CAST(octet_length(encode(a)) AS BIGINT) AS n_bytes FROM r
), p AS (
    SELECT *, CAST(coalesce(sum(n_bytes) OVER (PARTITION BY file ORDER BY page_id, hash_a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s
)
SELECT 'file' AS kind, file, CAST(NULL AS BIGINT) AS "offset", CAST(NULL AS BIGINT) AS page_id, CAST(NULL AS VARCHAR) AS hash_a, CAST(NULL AS VARCHAR) AS hash_b,
    CAST(sum(n_bytes) AS BIGINT) AS n_bytes, count(*) AS n_records, count(*) FILTER (WHERE hash_a IS DISTINCT FROM hash_b) AS n_bad
FROM p GROUP BY file
UNION ALL
SELECT CASE WHEN hash_b IS NULL THEN 'missing' ELSE 'changed' END, file, "offset", page_id, hash_a, hash_b, n_bytes, 1, 1 FROM p WHERE hash_a IS DISTINCT FROM hash_b""",
    "op7_decontamination": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {SPLIT} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, len(w[i:i + 12]) AS n FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0),
d AS (SELECT doc_id, {SPLIT} AS w FROM documents),
pl AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM win) s, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
occ AS (SELECT doc_id, i, pl.n, item_id FROM pl JOIN win USING (win, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM occ GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op11_line_dedup": """
WITH l AS (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id""",
    "op12_importance": f"""
WITH {CRC_TABLE}, w AS (
    SELECT 0 AS part, doc_id AS id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {SPLIT} AS w FROM documents)
    UNION ALL SELECT 1, item_id, unnest(w), generate_subscripts(w, 1) FROM (SELECT item_id, {SPLIT} AS w FROM benchmark)
), a AS (
    SELECT part, id, w AS x, ' ' || lead(w, 1) OVER p AS y, ' ' || lead(w, 2) OVER p AS z FROM w WINDOW p AS (PARTITION BY part, id ORDER BY i)
), g AS (
    SELECT part, id, x AS gram FROM a UNION ALL SELECT part, id, x || y FROM a WHERE y IS NOT NULL UNION ALL SELECT part, id, x || y || z FROM a WHERE z IS NOT NULL
), h AS (
    SELECT gram, {crc_sql("gram")} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM g), crc_table
), f AS MATERIALIZED (SELECT part, id, bucket, count(*) AS n FROM g JOIN h USING (gram) GROUP BY ALL),
c AS (SELECT range AS bucket, coalesce(sum(n) FILTER (WHERE part = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE part = 1), 0) AS t FROM range(10000) LEFT JOIN f ON bucket = range GROUP BY range),
v AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM c) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM c) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c),
m AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN v USING (bucket) WHERE part = 0 GROUP BY id),
r AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
    FROM documents LEFT JOIN m ON id = doc_id
), k AS (SELECT *, n_features >= 57 AS fit, row_number() OVER (PARTITION BY n_features >= 57 ORDER BY score DESC, doc_id) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT 5 * count(*) // 100 FROM k WHERE fit) THEN place END AS rank FROM k""",
    "op13_manifest": manifest_sql(),
}
