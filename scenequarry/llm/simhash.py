"""SimHash near-duplicates with the general pigeonhole principle.

Fingerprints: 64 bits, a bit being set if it is set in over half of the hashes of a text's word shingles. Documents
link at `radius` or fewer differing bits; a class is what links connect.

Search. Equal fingerprints collapse to one row first. The bits fall into m partitions, correlated bits together, and
partition i gets a threshold e_i with sum(e_i + 1) = radius + 1, so that a pair within the radius differs in at most
e_i bits of some partition i. m and the thresholds come from a dynamic program over estimated candidate counts. A
threshold e means one mask for each choice of e bits left out; rows that agree under a mask form a group and are
verified there. A group over `most` rows isn't compared whole: the bits that its mask leaves open are cut in radius + 1
parts, one of which must agree in a linked pair, so it is dealt again under longer masks until groups are small or
all the bits left open fit in the radius. Nothing is capped, and no two rows are paired twice for being equal.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, stored, texts

BITS = 64
SEED = 42
#: Bytes of text that are split into words at a time.
BLOCK = 1 << 20
#: Tasks for a table of up to SMALL edges: more of them would hold no rows, yet leave files and records of their own.
FEW, SMALL = 8, 1 << 18
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(data: bytes, width: int) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, block by block; each block begins with the last width - 1 words of the one before."""
    at, carry = 0, []
    while at < len(data):
        end = len(data)
        if end - at > BLOCK and (m := SPACE.search(data, at + BLOCK)):
            end = m.start()
        words = carry + data[at:end].lower().split()
        yield words
        carry, at = words[max(0, len(words) - width + 1) :] if width > 1 else [], end


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; 0 without words, the whole sequence as one shingle below `width` words."""
    from xxhash import xxh64_intdigest

    total, ones, short = 0, np.zeros(BITS, np.int64), []
    for words in word_blocks(data or b"", width):
        if len(words) < width:
            short = words
            continue
        h = np.array([xxh64_intdigest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(width)), strict=False)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    if not total and short:
        return xxh64_intdigest(b" ".join(short), SEED)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > total))) if total else 0


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers: other random bits of the same hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row; a null text has no words."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, width) for x in as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def bit_pairs(classes: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set; each task sends its sums only."""

    def run(batches):
        both = np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                both += bits[at : at + (1 << 16)].T @ bits[at : at + (1 << 16)]
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j].astype(np.int64))], ["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in classes.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 2080 rows
        out[r.i, r.j] = out[r.j, r.i] = r.n
    return out


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of the bits of about equal size, grown greedily so that correlated bits meet."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(part[0])
        while len(part) < size:
            part.append(max(sorted(left), key=lambda b: corr[b, part].sum()))
            left.discard(part[-1])
        parts.append(sorted(part))
    return parts


def as_mask(bits) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plan_masks(classes: DataFrame, n: int, radius: int, row_cost: float = 4.0) -> list[int]:
    """Masks under which every pair within the radius agrees at least once.

    For m partitions the pairs that agree in each are counted over all fingerprints; what a threshold e adds follows
    from the bits' shares. The program picks the thresholds, then the m, of the least cost: pairs to compare, and
    row_cost for each row dealt out.
    """
    both = bit_pairs(classes)
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    plans = {m: correlated_parts(both, n, m) for m in range(2, radius + 2)} or {1: [list(range(BITS))]}
    names = [(m, i) for m, parts in plans.items() for i in range(len(parts))]
    values = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(as_mask(plans[m][i])))).alias("v")) for k, (m, i) in enumerate(names)))
    counted = classes.select(F.explode(values).alias("x")).groupBy("x").count().groupBy(F.col("x.k").alias("k")).agg(F.sum((F.col("count") * (F.col("count") - 1) / 2).cast("double")).alias("pairs"))
    equal = {names[r.k]: r.pairs for r in counted.collect()}  # one row for each partition

    best: tuple[float, list[int]] = (float("inf"), [])
    for m, parts in plans.items():
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for i, part in enumerate(parts):
            odds = sorted((differ / (1 - differ))[part])
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (cost, chosen) in table.items():
                for e in range(-1, radius + 1 - spent):
                    masks = list(itertools.combinations(range(len(part)), e)) if e >= 0 else []
                    if len(masks) > 600:
                        continue
                    pairs = sum(equal.get((m, i), 0.0) * np.prod([1 + odds[b] for b in x]) for x in masks)
                    now = cost + pairs + row_cost * n * len(masks)
                    if now < nxt.get(spent + e + 1, (float("inf"),))[0]:
                        nxt[spent + e + 1] = (now, (*chosen, e))
            table = nxt
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            masks = [as_mask(set(part) - set(x)) for part, e in zip(parts, table[radius + 1][1], strict=True) if e >= 0 for x in itertools.combinations(part, e)]
            best = (table[radius + 1][0], masks)
    return best[1]


def longer_masks(mask: int, radius: int) -> list[int]:
    """The mask with one of radius + 1 parts of its open bits added, for each part."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | as_mask(free[i :: radius + 1]) for i in range(radius + 1)]


def spanning(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint it is connected to) of rows that links connect within contiguous groups.

    Rows are sorted by group and fingerprint. Links are found at one distance between places after the other and
    merged as they come, so that memory stays in proportion to the rows.
    """
    n = len(fp)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    root, at, d = np.arange(n), np.arange(n), 1
    while len(at := at[at + d < end[at]]):
        hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        a, b = hit, hit + d
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := root[root] != root).any():
                root[up] = root[root[up]]
        d += 1
    linked = root != np.arange(n)
    return fp[linked], fp[root[linked]]


def verify(rows: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a, b) of each (mask, value) group, found in numpy where the group's rows meet in order."""

    def run(batches):
        held: list[np.ndarray] = []

        def solve(x):
            group = np.cumsum(np.append(0, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])))
            a, b = spanning(group, np.ascontiguousarray(x[:, 2]).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            new = np.flatnonzero((x[1:, :2] != x[:-1, :2]).any(axis=1)) + 1
            if held and (x[0, :2] != held[-1][-1, :2]).any():
                new = np.append(0, new)
            if len(new):
                whole = np.concatenate([*held, x[: new[-1]]])
                if len(whole):
                    yield solve(whole)
                held = [x[new[-1] :]]
            else:
                held.append(x)
        if held:
            yield solve(np.concatenate(held))

    return rows.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(run, "a long, b long")


def links(classes: DataFrame, radius: int = 3, most: int = 256) -> DataFrame:
    """(a, b) with a > b: pairs that connect whatever fingerprints `fp` within the radius connect; cut from lineage."""
    spark = classes.sparkSession
    n = classes.count()
    none = spark.createDataFrame([], "a long, b long")
    if n < 2:
        return none
    masks = plan_masks(classes, n, radius)
    rows = classes.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    found = none
    while masks:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        # a table of its own, so that the join deals both sides anew and Spark can split a hot bucket
        sizes = cut(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        live = cut(rows.join(sizes, ["mask", "value"]))
        found = found.unionByName(verify(live.filter(F.col("size") <= most), radius))
        hot = live.filter(F.col("size") > most)
        big = [r.mask & (1 << 64) - 1 for r in hot.select("mask").distinct().collect()]  # masks, of which there are few
        closed = [m for m in big if BITS - m.bit_count() <= radius]
        if closed:  # whatever agrees under such a mask is within the radius
            w = hot.filter(F.col("mask").isin([signed(m) for m in closed]))
            least = cut(w.groupBy("mask", "value").agg(F.min("fp").alias("b")))
            found = found.unionByName(w.join(least, ["mask", "value"]).filter("fp > b").select(F.col("fp").alias("a"), "b"))
        deeper = {m: longer_masks(m, radius) for m in big if m not in closed}
        masks = sorted({x for v in deeper.values() for x in v})
        if deeper:
            step = spark.createDataFrame([(signed(m), [signed(x) for x in v]) for m, v in deeper.items()], "mask long, next array<long>")
            rows = hot.join(F.broadcast(step), "mask").select("fp", F.explode("next").alias("mask")).distinct()
    return cut(found.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node, root (the least node it is connected to) of every node of the edges (a, b) with a > b.

    Alternates large-star and small-star steps: each joins nodes to the least of their neighbours until every edge is a
    star's, which the count of neighbours tells; the number of steps grows with the logarithm of a component's size. No
    step adds edges, so up to `small` of them stay with FEW tasks.
    """
    few = (lambda x: x.coalesce(FEW)) if edges.count() <= small else lambda x: x
    while True:
        both = few(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        below = F.count_if(F.col("b") < F.col("a"))
        # stored, so that the join deals both sides anew and Spark can split a hot star
        least = cut(few(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), below.alias("below"), F.count(F.lit(1)).alias("n"))))
        if not least.filter("below > 1 or below = 1 and n > 1").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large = few(both.filter("b > a").join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(few(large.filter("a <> b").distinct()))
        least = cut(few(large.groupBy("a").agg(F.min("b").alias("m"))))
        ends = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        both = few(large.join(least, "a")).select(F.explode(ends).alias("e"))
        edges = cut(few(both.select("e.a", "e.b").filter("a <> b").distinct()))


def named_classes(prints: DataFrame, order: list[str], tree_of) -> DataFrame:
    """fp and rep for each fingerprint of prints: the least (order) of all rows of its class.

    tree_of finds the links between the fingerprints of a one-column table of different ones.
    """
    classes = cut(prints.groupBy("fp").agg(F.min(F.struct(*order)).alias("rep")))
    tree = cut(components(tree_of(classes)))
    linked = tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
    least = cut(classes.join(linked, classes.fp == linked.node).groupBy("root").agg(F.min("rep").alias("least")))
    named = linked.join(least, "root").select(F.col("node").alias("fp"), "least")
    return classes.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("rep"))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, most: int = 256) -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    component_id is the least doc_id that links reach, the row's own included. Null and empty texts have fingerprint
    zero and link like others; a null doc_id takes part but names a class only if the class has no other id. Repeated
    rows stay repeated; other columns, whatever their names, don't matter.
    """
    prints = cut(fingerprints(docs, width)).withColumn("none", F.col("doc_id").isNull())
    # a table of its own, so that the last join deals both its sides anew and Spark can split a frequent fingerprint
    whole = stored(named_classes(prints, ["none", "doc_id"], lambda classes: links(classes, radius, most)))
    return prints.join(whole, "fp").select("doc_id", "fp", F.col("rep.doc_id").alias("component_id"))
