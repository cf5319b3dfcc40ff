"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is 13 consecutive words of a benchmark item, or all of a shorter one. Its tokens are its shingles of up to
three words with their places. As a window must be contained whole, the prefix that a match needs is one token: the
window's rarest over all documents. So

1. each benchmark shingle is counted over all documents, by a hash; tasks add up first, and nothing else leaves them,
2. every window gets its prefix shingle; windows with a shingle that stands nowhere can't match and go,
3. documents join on prefix shingles alone, a place whose window would begin before the document or end behind it is
   no candidate, and a candidate counts if the words at its place equal the window's, which is exact containment.

Benchmark tables are broadcast if their counted bytes are within `broadcast_bytes`; beyond it, Spark shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

WINDOW = 13
SHINGLE = 3
#: What isn't a word character, as a Java pattern.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none.

    The text is lower-cased whole, which is fast, if that can't touch anything but A-Z.
    """
    t = F.coalesce(text, F.lit(""))
    lowered = F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def shingles_of(words: str, sizes: list[int]) -> Column:
    """Array of (pos, size, hash): hashed runs of words, of each size."""
    def runs(s: int) -> Column:
        last = F.size(words) - s
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(s), *(F.get(F.col(words), i + k) for k in range(s))))

    return runs(sizes[0]) if len(sizes) == 1 else F.concat(*(runs(s) for s in sizes))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """window_id, words, item_id: each item's windows; equal windows share an id."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.greatest(F.size("words") - window, F.lit(0))
    w = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("words", i + 1, window))).alias("words"))
    return w.select(F.unhex(F.sha2(F.array_join("words", " "), 256)).alias("window_id"), "words", "item_id").distinct()


def fits(df: DataFrame, most: int) -> DataFrame:
    """With a broadcast hint if the bytes of its rows, counted here, are within the bound."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def places(keyed: DataFrame, size: int) -> DataFrame:
    """key, words, pos, h: every place of every text with the hash of the shingle that begins there; null h without one."""
    rows = keyed.select("key", words_of(F.col("text")).alias("words"))
    # the outer form keeps Spark from adding a filter that would split the text anew for each element
    return rows.select("key", "words", shingles_of("words", [size]).alias("hashes")).select("key", "words", F.posexplode_outer("hashes").alias("pos", "h"))


def prefixes(keyed: DataFrame, windows: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, list[int]]:
    """(window_id, len, words, s, at, h) with each window's rarest shingle and its place, and the shingle sizes there are.

    Windows that hold a shingle which no document has are left out.
    """
    s = F.least(F.lit(SHINGLE), F.size("words"))
    parts = windows.select("window_id", F.size("words").alias("len"), "words", s.alias("s"))
    hashed = lambda n: shingles_of("words", [n])
    by_size = hashed(SHINGLE)
    for n in range(1, SHINGLE):
        by_size = F.when(F.col("s") == n, hashed(n)).otherwise(by_size)
    parts = cut(parts.select("window_id", "len", "words", "s", F.posexplode(by_size).alias("at", "h")))
    sizes = sorted(r.s for r in parts.select("s").distinct().collect())  # one to three sizes
    counts = None
    for n in sizes:
        wanted = fits(parts.filter(F.col("s") == n).select("h").distinct(), broadcast_bytes)
        c = places(keyed, n).filter("h is not null").select("h").join(wanted, "h").groupBy("h").agg(F.count(F.lit(1)).alias("df")).withColumn("s", F.lit(n))
        counts = c if counts is None else counts.unionByName(c)
    if counts is None:
        return parts, sizes
    ranked = parts.join(cut(counts), ["s", "h"], "left").groupBy("window_id", "len", "words", "s").agg(F.min(F.struct("df", "h", "at")).alias("rarest"), F.count_if(F.col("df").isNull()).alias("absent"))
    return cut(ranked.filter("absent = 0").select("window_id", "len", "words", "s", "rarest.at", "rarest.h")), sizes


def occurrences(keyed: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(key, start, len, window_id) of every place where a window stands, and the (window_id, item_id) table.

    keyed: key, text; rows of one key have one text. Copies of a text give their places once.
    """
    named = cut(windows_of(items, window))
    prefix, sizes = prefixes(keyed, named.select("window_id", "words").distinct(), broadcast_bytes)
    found = keyed.select("key", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(None).cast("binary").alias("window_id")).limit(0)
    start = (F.col("pos") - F.col("at")).alias("start")
    for n in sizes:
        asked = prefix.filter(F.col("s") == n).select("window_id", "len", F.col("words").alias("win"), "at", "h")
        small = fits(asked, broadcast_bytes)
        d = places(keyed, n)
        if small is not asked:
            whole = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.size("words")) & (F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("len")) == F.col("win"))
            got = d.join(small, "h").select("key", start, "len", "window_id", "words", "win").filter(whole)
        else:  # what is shuffled are places alone; the few candidates get their words by the key
            near = d.filter("h is not null").select("key", "pos", "h", F.size("words").alias("n")).join(asked, "h").select("key", start, "len", "window_id", "win", "n").filter("start >= 0 and start + len <= n").distinct()
            text = keyed.select("key", words_of(F.col("text")).alias("words")).dropDuplicates(["key"])
            got = near.join(text, "key").filter(F.slice("words", F.col("start") + 1, F.col("len")) == F.col("win"))
        found = found.unionByName(got.select("key", "start", "len", "window_id").distinct())
    return found, named


def digest_of(text: str) -> Column:
    """32 bytes that know a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def covered(spans: str) -> Column:
    """How many places the union of sorted (start, end) spans holds."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end")
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, share: int = 20, window: int = WINDOW, broadcast_bytes: int = 64 << 20, keep_key: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    n_hit counts the words inside any occurrence of a window. Contaminated: n_hit > 0 and share * n_hit >= n_words.
    Null and empty texts have no words and are clean; repeated rows get equal results; items without words match
    nothing; other columns, whatever their names, don't matter. A document is known by its text's digest, so ids may be
    null or repeat.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", digest_of("text"))
    texts = keyed.select("key", "text")
    found, named = occurrences(texts, items.select("item_id", "text"), window, broadcast_bytes)
    found = cut(found)
    spans = found.select("key", F.struct("start", (F.col("start") + F.col("len")).alias("end")).alias("span")).distinct()
    hit = spans.groupBy("key").agg(F.sort_array(F.collect_list("span")).alias("spans")).select("key", covered("spans").alias("n_hit"))
    of = found.select("key", "window_id").distinct().join(named.select("window_id", "item_id"), "window_id").select("key", "item_id").distinct()
    of = of.groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    marks = stored(hit.join(of, "key"))  # so that the last join deals both its sides anew and Spark can split a frequent text
    out = keyed.select("key", "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words")).join(marks, "key", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), items_of.alias("items"), *["key"] * keep_key,
    )


def keep_clean(docs: DataFrame, items: DataFrame, share: int = 20, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The rows of docs, same columns, that aren't contaminated; null and empty texts stay.

    What goes is known by the text's digest, so that ids don't matter, nor names of other columns.
    """
    bad = cut(contamination(docs, items, share, keep_key=True).filter("contaminated").select("key").distinct())
    rows = docs.select(F.struct("*").alias("row"), digest_of("text").alias("key"))
    return rows.join(fits(bad, broadcast_bytes), "key", "left_anti").select("row.*")
