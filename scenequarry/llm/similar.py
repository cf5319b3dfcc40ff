"""Near copies by the similarity of their shingles, verified on whole texts.

Candidates. Texts meet in groups: the classes of the SimHash search, made of five-word shingles, which it finds exactly
within its radius; and, as texts at a similarity of 0.8 lie far beyond any radius that tells texts apart, BANDS groups of
texts that agree in ROWS minima of rehashed shingles. A pair of similarity s shares a band with the probability
1 - (1 - s ** ROWS) ** BANDS, 0.96 at 0.8. Groups of the same members are kept once.

Verification. Texts that share a group get the sets of their shingles, and a pair counts if the sets themselves are as
similar as asked. A group of up to `most` texts is compared in one task through an inverted list of its shingles; texts
that links connect already are not compared again. Larger groups are compared in chunks. First every text meets some centres of
its largest group, which makes one component of most copies of a text. Where few texts of a group stay outside its
largest component, these are compared with all others, and the group is done. Where many do, some texts of different
components are compared with all others and taken out, and the rest is dealt again under as many bands of new minima
within the group, so that a pair at the limit meets again with the same probability, and rounds end without a limit on
what a group holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, parts, stored, texts
from .simhash import BITS, SEED, components, links, mixed, word_blocks

WIDTH = 5
BANDS, ROWS = 8, 5
#: Texts that a task compares with one another, and shingles that it holds for it, unless there are only two texts.
MOST, WEIGHT = 512, 1 << 21
#: Of a larger group: texts that a task compares with its centres, centres of a round, and texts outside the largest
#: component that may all be centres.
CHUNK, CENTERS, OUTSIDE = 512, 8, 512
#: Bytes of a text's digest that name it.
NAME = 16
EMPTY = np.zeros(1, np.uint64)


def shingles(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Ascending hashes of a text's different shingles; the whole sequence as one below `width` words, zero without any."""
    from xxhash import xxh64_intdigest

    parts = []
    for words in word_blocks(data or b"", width):
        w = np.array([xxh64_intdigest(x, SEED) for x in words], np.uint64)
        n = min(width, len(w))
        if not n or (n < width and parts):
            continue
        h = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
        parts.append(h)
    return np.unique(np.concatenate(parts)) if parts else EMPTY


def bands(h: np.ndarray, level: int) -> np.ndarray:
    """BANDS keys of a set of hashes: each of ROWS minima, the level's own."""
    odd = np.random.default_rng([SEED, level]).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 1 << 12):
        np.minimum(least, (h[at : at + (1 << 12), None] * odd).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for m in least.reshape(ROWS, BANDS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + m)
    return key


def simhash_of(h: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def prints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, id (the text's name), size (its shingles), fp, keys of every row; null counts as empty."""

    def run(batches):
        for b in parts(batches):
            names, sizes, fps, keys = [], [], [], []
            for x in as_bytes(b.column(1)):
                h = shingles(x, width)
                names.append(hashlib.sha256(x or b"").digest()[:NAME])
                sizes.append(len(h))
                fps.append(simhash_of(h))
                keys.append(bands(h, 0).view(np.int64))
            keys = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), keys], ["doc_id", "id", "size", "fp", "keys"])

    return texts(docs).mapInArrow(run, "doc_id long, id binary, size long, fp long, keys array<long>")


def name_of(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, 2 * NAME))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, data (the shingles' hashes) of the texts `wanted` (id, doc_id: one row that has the text)."""
    rows = texts(docs).withColumn("id", name_of(F.col("text")))
    w = wanted.select(F.col("id").alias("w_id"), F.col("doc_id").alias("w_doc"))
    rows = rows.join(w, (F.col("id") == F.col("w_id")) & F.col("doc_id").eqNullSafe(F.col("w_doc")), "left_semi").select("id", "text").dropDuplicates(["id"])

    def run(batches):
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x, width).tobytes() for x in as_bytes(b.column(1))], pa.binary())], ["id", "data"])

    return rows.mapInArrow(run, "id binary, data binary")


def spanning(sets: list[np.ndarray], share: Fraction, centers: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of places that connect whatever pairs of sets as similar as `share` connect; with centres, pairs with one."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    holder = np.repeat(np.arange(n), sizes)[order]
    first = np.searchsorted(inverse[order], np.arange(len(tokens) + 1))
    at, root, out = np.append(0, np.cumsum(sizes)), np.arange(n), []
    for i in range(n - 1) if centers is None else centers:
        if (root[i + 1 if centers is None else 0 :] == root[i]).all():
            continue
        own = inverse[at[i] : at[i + 1]]
        lens = first[own + 1] - first[own]
        places = np.repeat(first[own] - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(lens.sum())
        common = np.bincount(holder[places], minlength=n)
        near = common * share.denominator >= (sizes[i] + sizes - common) * share.numerator
        near[: i + 1 if centers is None else 0] = False
        for j in np.flatnonzero(near):
            if root[i] != root[j]:
                out.append((i, int(j)))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return out


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
    """The other columns' values of one key at a time, from batches sorted by key, the first column."""
    key, held = None, []
    for b in parts(batches):
        for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key and held:
                yield tuple(zip(*held, strict=True))
                held = []
            key = k
            held.append(row)
    if held:
        yield tuple(zip(*held, strict=True))


def links_of(ids: tuple[bytes, ...], data: tuple[bytes, ...], share: Fraction, centers: list[int] | None = None) -> pa.RecordBatch:
    found = spanning([np.frombuffer(d, np.uint64) for d in data], share, centers)
    return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.binary()), pa.array([ids[j] for _, j in found], pa.binary())], ["a", "b"])


def compared(rows: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Links (a, b) of groups (key, id) that a task can hold."""

    def run(batches):
        for ids, data in groups(batches):
            yield links_of(ids, data, share)

    return rows.join(sets, "id").select("key", "id", "data").repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a binary, b binary")


def beside(rows: DataFrame, centers: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Links (a, b) between each row (key, id, n, weight) and the centres (key, id) of its group, chunk by chunk of its n rows."""
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("weight") / WEIGHT)).cast("int")
    mine = rows.select(F.xxhash64("key", F.pmod(F.xxhash64("id"), chunks).cast("int")).alias("part"), "id", F.lit(False).alias("center"))
    sizes = rows.groupBy("key").agg(F.max("n").alias("n"), F.max("weight").alias("weight"))
    theirs = centers.join(sizes, "key").select("key", "id", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")).select(F.xxhash64("key", "chunk").alias("part"), "id", F.lit(True).alias("center"))
    both = mine.unionByName(theirs).groupBy("part", "id").agg(F.max("center").alias("center"))

    def run(batches):
        for ids, data, center in groups(batches):
            if any(center):
                yield links_of(ids, data, share, [i for i, x in enumerate(center) if x])

    return both.join(sets, "id").select("part", "id", "data", "center").repartition("part").sortWithinPartitions("part", "id").mapInArrow(run, "a binary, b binary")


def shared(rows: DataFrame) -> DataFrame:
    """key, n, weight of the groups of rows (key, id, size, comp) with texts of more than one component; equal groups once."""
    g = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x2")
    )
    return cut(g.filter("n > 1 and c1 <> c2").groupBy("x1", "x2", "n", "weight").agg(F.min("key").alias("key")).select("key", "n", "weight"))


def dealt_again(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """key, id, size, comp under the level's bands within the old groups."""

    def run(batches):
        for b in parts(batches):
            for old, i, size, d in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                h = mixed(bands(np.frombuffer(d, np.uint64), level) + np.uint64(old & 0xFFFFFFFFFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([i] * BANDS, pa.binary()), pa.array([size] * BANDS, pa.int64())], ["key", "id", "size"])

    return rows.join(sets, "id").select("key", "id", "size", "data").mapInArrow(run, "key long, id binary, size long")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (key, id, size) with comp, the text's component, from labels (id, comp) of the texts that have links."""
    return rows.join(labels.withColumnRenamed("comp", "named"), "id", "left").select("key", "id", "size", F.coalesce("named", "id").alias("comp"))


def named_by(found: DataFrame) -> DataFrame:
    """id, comp of every text with links (a, b), a > b: the least name that they reach."""
    tree = stored(components(found))
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("id"), F.col("root").alias("comp"))


def some_centers(rows: DataFrame) -> DataFrame:
    """key, id of CENTERS texts of each group of rows (key, id, comp), of different components."""
    place = F.pmod(F.xxhash64("comp"), F.lit(CENTERS)).alias("place")
    return rows.groupBy("key", place).agg(F.min_by("id", F.xxhash64("key", "id")).alias("id")).select("key", "id")


def similar(docs: DataFrame, known: DataFrame, similarity: float = 0.8, width: int = WIDTH, most: int = MOST, weight: int = WEIGHT) -> DataFrame:
    """Links (a, b), a > b, that connect the texts known (id, doc_id, size, fp, keys) as far as candidates reach."""
    share = Fraction(similarity).limit_denominator(1000)
    fps = cut(known.select("fp").distinct())
    near = known.join(named_by(links(fps)).toDF("fp", "root"), "fp", "left").select(F.xxhash64(F.coalesce("root", "fp")).alias("key"), "id", "size")
    rows = stored(near.unionByName(known.select(F.explode("keys").alias("key"), "id", "size"))).withColumn("comp", F.col("id"))
    small = (F.col("n") == 2) | (F.col("n") <= most) & (F.col("weight") <= weight)
    ordered = lambda x: x.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    sets, found, level = None, None, 0
    while True:
        sizes = shared(rows)
        few = stored(rows.join(sizes.filter(small), "key").select("key", "id"))
        hot = stored(rows.join(sizes.filter(~small), "key").select("key", "id", "size", "comp", "n", "weight"))
        if sets is None:
            wanted = few.select("id").unionByName(hot.select("id")).distinct()
            sets = stored(sets_of(docs, known.join(wanted, "id").select("id", "doc_id"), width))
        got = compared(few, sets, share)
        found = stored(ordered(got if found is None else got.unionByName(found)))
        if not hot.limit(1).count():
            return found
        largest = stored(hot.groupBy("id").agg(F.max(F.struct("n", "key", "comp", "weight")).alias("g")).select("g.*", "id"))
        found = stored(ordered(found.unionByName(beside(largest, some_centers(largest), sets, share))))
        rest = stored(labelled(hot, named_by(found)))
        of_comp = rest.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
        split = of_comp.groupBy("key").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max(F.struct("n", "weight", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
        many = (F.col("n") - F.col("top.n") > OUTSIDE) | (F.col("weight") - F.col("top.weight") > weight)
        split = cut(split.filter("comps > 1").select("key", "n", "weight", F.col("top.comp").alias("top"), many.alias("many")))
        rest = stored(rest.join(split, "key").select("key", "id", "size", "comp", "n", "weight", "top", "many"))
        outside = rest.filter("not many and comp <> top").select("key", "id")
        centers = cut(outside.unionByName(some_centers(rest.filter("many"))))
        found = stored(ordered(found.unionByName(beside(rest, centers, sets, share))))
        rest = rest.filter("many").select("key", "id", "size").join(centers, ["key", "id"], "left_anti")
        level += 1
        rows = stored(labelled(dealt_again(rest, sets, level), named_by(found)))


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = WIDTH, most: int = MOST, weight: int = WEIGHT) -> DataFrame:
    """The rows of docs, same columns, that stand for their class of similar texts: one row of each, with the least id.

    Texts are similar if `similarity` of their different shingles of `width` words agree; a class is what verified links
    connect. Null ids come last; among rows of an id the least digest of a text decides, so that an id that repeats with
    other texts leads several classes; of equal rows one stays. Null and empty texts, and all without words, are one
    class. Very long texts are compared whole; an empty table gives no rows. Other columns, whatever their names, don't
    matter.
    """
    rows = stored(prints(docs, width))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("rep")
    known = stored(rows.groupBy("id").agg(least, F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    linked = cut(named_by(similar(docs, known.select("id", "rep.doc_id", "size", "fp", "keys"), similarity, width, most, weight)))
    first = linked.join(known, "id").groupBy("comp").agg(F.min(F.struct("rep", "id")).alias("first"))
    gone = stored(linked.join(first, "comp").filter("id <> first.id").select("id"))
    kept = known.join(gone, "id", "left_anti").select(F.col("id").alias("k_id"), F.col("rep.doc_id").alias("k_doc"))
    # how often a kept (id, text) stands in docs: nothing but kept rows is grouped
    same = (F.col("id") == F.col("k_id")) & F.col("doc_id").eqNullSafe(F.col("k_doc"))
    times = stored(rows.select("doc_id", "id").join(kept, same).groupBy("k_id", "k_doc").agg(F.count(F.lit(1)).alias("times")))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), name_of(F.col("text")).alias("id"))
    once = whole.join(times.filter("times = 1"), same, "left_semi").select("row.*")
    if not times.filter("times > 1").limit(1).count():
        return once
    return once.unionByName(whole.join(times.filter("times > 1"), same, "left_semi").dropDuplicates(["doc_id", "id"]).select("row.*"))
