"""Importance resampling towards a target distribution, on hashed n-grams.

Each task hands its texts, some megabytes at a time, to a DuckDB of its own: SQL takes the words, unnests them, looks
ahead over a window for runs of up to three words, and counts registered functions' results by document and bucket: zlib's
CRC of every different word, and what it becomes when a word follows. So no n-gram is ever written out. The bucket counts
of each document are spilled to a Parquet table in the shared folder. Spark merges them: sums over all documents and over
the target give each bucket's gain, the spilled counts give each document's weight, and a noise that depends on the id
alone turns the choice of the highest scores into a draw without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, numbered, parts, stored, texts

BUCKETS = 10_000
LONGEST = 3
#: Bytes of text that one statement gets.
BLOCK = 1 << 20
#: Pieces of text that one statement gets.
PIECES = 4096
#: Bytes that a CRC is moved on by at a time.
SHIFTED = 32
#: What DuckDB may hold; blocks need a small part of it.
MEMORY = "384MB"
BETWEEN = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

#: Rows (doc, bucket, n) of the texts `piece` (doc, nth, text, after): `after` words at a text's end belong to the next piece.
COUNTS = r"""
WITH word AS MATERIALIZED (
    SELECT doc, nth, len(words) - after AS own, unnest(words) AS w, generate_subscripts(words, 1) AS i
    FROM (SELECT doc, nth, after, list_filter(string_split_regex(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM piece)
), known AS MATERIALIZED (
    SELECT w, crc(w) AS alone, crc(' ' || w) AS behind, CAST(strlen(w) + 1 AS INTEGER) AS size FROM (SELECT DISTINCT w FROM word)
), ahead AS (
    SELECT doc, i, own, alone AS one, lead(behind, 1) OVER run AS behind_2, lead(size, 1) OVER run AS size_2, lead(behind, 2) OVER run AS behind_3, lead(size, 2) OVER run AS size_3
    FROM word JOIN known USING (w) WINDOW run AS (PARTITION BY nth ORDER BY i)
), two AS (
    SELECT doc, one, crc_on(one, behind_2, size_2) AS two, behind_3, size_3 FROM ahead WHERE i <= own
), three AS (
    SELECT doc, [one, two, crc_on(two, behind_3, size_3)] AS runs FROM two
)
SELECT doc, bucket, count(*) AS n FROM (SELECT doc, unnest(runs) % 10000 AS bucket FROM three) WHERE bucket IS NOT NULL GROUP BY doc, bucket ORDER BY doc, bucket"""


def shifts() -> np.ndarray:
    """What SHIFTED zero bytes or fewer make of each byte of a CRC, by zlib itself: sizes x 4 x 256. A CRC is linear, so
    that of a text followed by another is the first one moved on by the second one's bytes, xor the second one's."""
    moved = lambda c, n: zlib.crc32(bytes(n), c) ^ zlib.crc32(bytes(n))
    return np.array([[[moved(c << 8 * k, n) for c in range(256)] for k in range(4)] for n in range(SHIFTED + 1)], np.uint32)


def database():
    """An in-memory DuckDB of one thread that spills nowhere, with zlib's CRC: crc(text), and crc_on(a, b, size), the CRC of
    a text of CRC a followed by `size` bytes of CRC b."""
    import duckdb

    table = shifts()

    def crc(text: pa.ChunkedArray) -> pa.Array:
        return pa.array([zlib.crc32(x) for x in text.cast(pa.binary()).to_pylist()], pa.uint32())

    def crc_on(a: pa.ChunkedArray, b: pa.ChunkedArray, size: pa.ChunkedArray) -> pa.Array:
        c, left = a.to_numpy().copy(), size.to_numpy().copy()
        while True:
            n = np.minimum(left, SHIFTED)
            c = table[n, 0, c & 255] ^ table[n, 1, c >> 8 & 255] ^ table[n, 2, c >> 16 & 255] ^ table[n, 3, c >> 24]
            left = left - n
            if not left.any():
                return pa.array(c ^ b.to_numpy(), pa.uint32())

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.create_function("crc", crc, ["VARCHAR"], "UINTEGER", type="arrow")
    con.create_function("crc_on", crc_on, ["UINTEGER", "UINTEGER", "INTEGER"], "UINTEGER", type="arrow")
    return con


def pieces(data: bytes) -> Iterator[tuple[bytes, int]]:
    """A lower-cased text in pieces of about BLOCK bytes, each with the words behind it that its last runs need, and how
    many these are."""
    at = 0
    while True:
        m = BETWEEN.search(data, at + BLOCK) if len(data) - at > BLOCK else None
        if m is None:
            yield data[at:], 0
            return
        ahead = [x.group() for x, _ in zip(WORD.finditer(data, m.start()), range(LONGEST - 1), strict=False)]
        yield b" ".join([data[at : m.start()], *ahead]), len(ahead)
        at = m.start()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[tuple[int, bytes, int]]]]:
    """(ids of the texts that end here, pieces (number of text, text, words ahead)); a text's first pieces may come in
    blocks without an id, and the number counts from the first text that hasn't ended."""
    ids, block, size = [], [], 0
    for b in batches:
        for doc_id, data in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
            for text, after in pieces((data or b"").lower()):
                if block and (size + len(text) > BLOCK or len(block) >= PIECES):
                    yield ids, block
                    ids, block, size = [], [], 0
                block.append((len(ids), text, after))
                size += len(text)
            ids.append(doc_id)
    if ids:
        yield ids, block


def bucket_counts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, buckets (ascending), counts of every row; null texts have none."""

    def run(batches):
        con, started = database(), np.zeros(BUCKETS, np.int64)
        for ids, block in blocks(batches):
            con.register("piece", pa.table({"doc": pa.array([d for d, _, _ in block], pa.int64()), "nth": pa.array(range(len(block)), pa.int64()), "text": pa.array([t for _, t, _ in block], pa.binary()).cast(pa.string()), "after": pa.array([a for _, _, a in block], pa.int64())}))
            got = con.sql(COUNTS).fetchnumpy()
            con.unregister("piece")
            doc, bucket, n = (np.asarray(got[c]).astype(np.int64) for c in ("doc", "bucket", "n"))
            if started.any():  # the first text began in an earlier block
                first = np.searchsorted(doc, 1)
                np.add.at(started, bucket[:first], n[:first])
                at = np.flatnonzero(started)
                doc, bucket, n = (np.concatenate(x) for x in ((np.zeros(len(at), np.int64), doc[first:]), (at, bucket[first:]), (started[at], n[first:])))
            ends = np.searchsorted(doc, np.arange(len(ids) + 1))
            started = np.zeros(BUCKETS, np.int64)
            started[bucket[ends[-1] :]] = n[ends[-1] :]  # of a text that doesn't end here
            if ids:
                offsets, sums = pa.array(ends, pa.int32()), np.diff(np.append(0, np.cumsum(n))[ends])
                words = np.where(sums > 0, (sums + 3) // 3, 0)  # n words have 1, 3, 6, 9, 12, ... runs
                columns = [pa.array(ids, pa.int64()), pa.array(words), pa.array(sums), pa.ListArray.from_arrays(offsets, pa.array(bucket[: ends[-1]], pa.int16())), pa.ListArray.from_arrays(offsets, pa.array(n[: ends[-1]], pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets", "counts"])
        con.close()

    return texts(docs, id_col).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<short>, counts array<int>")


def merged(spilled: DataFrame) -> np.ndarray:
    """How many features each bucket holds over all rows; a task sends one row for each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in parts(batches):
            np.add.at(total, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in spilled.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Each bucket's gain: a thousand times the logarithm of its smoothed share in the target over that in the corpus."""
    S, T = int(have.sum()), int(want.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(S + BUCKETS) / (float(s + 1) * float(T + BUCKETS)))) for s, t in zip(have.tolist(), want.tolist(), strict=True)], np.int64)


def weights(spilled: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a row's features."""

    def run(batches):
        for b in parts(batches):
            buckets, counts = b.column(3), b.column(4)
            summed = np.append(0, np.cumsum(gain[buckets.flatten().to_numpy()] * counts.flatten().to_numpy()))
            at = np.append(0, np.cumsum(buckets.value_lengths().to_numpy()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(summed[at]).astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    return spilled.select("doc_id", "n_words", "n_features", "buckets", "counts").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, target_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of docs.

    rank counts the drawn rows from the highest score down: floor(percent * N / 100) of the N rows of least_words words
    or more; of equal scores the smaller id comes first, rows without an id last, then fewer features; other ranks are
    null. The noise of a row without an id is that of an empty one. Null and empty texts have no features and weight
    zero; very long texts are counted whole, piece by piece; repeated rows are rows; an empty table gives none, an empty
    target adds nothing to a bucket. Other columns, whatever their names, don't matter.
    """
    spilled = stored(bucket_counts(docs))
    gain = gains(merged(spilled), merged(bucket_counts(target, target_id)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(weights(spilled, gain).withColumn("score", (F.col("weight") + noise).cast("long")))
    fit = scored.filter(F.col("n_words") >= least_words)
    n = percent * fit.count() // 100
    drawn = numbered(fit, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")], "rank").withColumn("rank", F.when(F.col("rank") < n, F.col("rank") + 1))
    return drawn.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
