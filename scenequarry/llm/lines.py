"""Lines that many documents share are dropped.

Lines are exploded with their places, normalised and hashed to 128 bits; the documents of each hash are counted after
repeats within a document are gone, so that a line of a third of all documents is summed in the tasks that read it.
Hashes over the threshold meet the exploded lines again, which gives every text the places that it loses, and the text
is put together from the runs between them. Only hashes and places move until then; the lines themselves don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored
from .decontam import LOWER, UPPER

BLANK = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    """A text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    t = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def hashed(*columns: str) -> list[Column]:
    """128 bits of the columns, in two."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def places(keyed: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, r1, r2 (the row), pos, h1, h2 (the key) of every line whose key has least_chars code points or more."""
    rows = keyed.select("doc_id", "r1", "r2", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.select("doc_id", "r1", "r2", "pos", key_of(F.col("line")).alias("key")).filter(F.length("key") >= least_chars)
    h1, h2 = hashed("key")
    return rows.select("doc_id", "r1", "r2", "pos", h1.alias("h1"), h2.alias("h2"))


def frequent(found: DataFrame, least_docs: int) -> DataFrame:
    """h1, h2 of the keys that least_docs documents or more have; rows of one id are one document, those without an id too."""
    once = found.select("h1", "h2", "doc_id").distinct()
    return once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= least_docs).select("h1", "h2")


def without_frequent_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """For each row of docs: doc_id, n_lines, n_dropped, kept (the lines that stay, joined).

    A line goes from every text if its key, of least_chars code points or more, stands in least_docs documents or more.
    Null counts as an empty text, which has one line. A document is an id: repeated rows of one count once, and so do
    all rows without an id together; equal rows get equal results. Very long texts are handled whole; an empty table
    gives no rows; other columns, whatever their names, don't matter. What is frequent is broadcast if its counted bytes
    are within broadcast_bytes, else Spark shuffles both sides.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    r1, r2 = hashed("doc_id", "text")
    keyed = keyed.select("doc_id", "text", r1.alias("r1"), r2.alias("r2"))
    found = places(keyed, least_chars)
    common = cut(frequent(found, least_docs))
    if common.count() * 64 <= broadcast_bytes:
        common = F.broadcast(common)
    lost = found.join(common, ["h1", "h2"]).groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    # a table of its own, so that the join deals both sides anew and Spark can split a row that repeats
    rows = keyed.join(stored(lost), ["r1", "r2"], "left")
    rows = rows.select("doc_id", lines_of(F.col("text")).alias("lines"), F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    last = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("lost", i - 1))
    until = lambda i: F.coalesce(F.get("lost", i), F.size("lines"))
    runs = F.transform(F.sequence(F.lit(0), F.size("lost")), lambda i: F.slice("lines", last(i) + 2, until(i) - last(i) - 1))
    kept = F.when(F.size("lost") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"), kept.alias("kept"))
