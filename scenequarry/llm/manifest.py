"""Merkle manifest of a dataset: a tree of each source, a tree of the sources' roots, and a proof for every row.

Leaves are numbered within their source by ranges that Spark deals out, and come together in aligned blocks of
FAN ** LEVELS consecutive leaves, so that a source which holds a third of all rows is many blocks. In a block the digests
are one contiguous matrix of 64-byte hex rows: reshaped by the fan, its rows are the runs of the level, and hashing them
gives the next matrix. The tops of the blocks are the nodes of the next pass, until each source has one.

Proofs go down the same way. A node's path is, level by level, what stands left and right of it in its run; a block gets
the path of its own top from the pass above, and index arithmetic finds every sibling inside. Each leaf's proof and its
folded root are made where its block is; only paths of tops are stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

FAN = 3
LEVELS = 5
HEX = 64
#: Steps from a node to the root, from below: the hex digests left and right of it in its run.
PATH = "array<struct<left: string, right: string>>"


def leaf_of(doc: dict[str, Column]) -> Column:
    """Hash of the fields' byte counts and values in order; a null field is a dash."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(part(c.cast("string")) for c in doc.values())), 256)


def hashed(rows: np.ndarray) -> np.ndarray:
    """Hex SHA-256 of each row of bytes, as a matrix."""
    return np.frombuffer("".join([hashlib.sha256(r).hexdigest() for r in rows]).encode(), np.uint8).reshape(-1, HEX)


def up(nodes: np.ndarray) -> np.ndarray:
    """The level above a matrix of digests: runs of FAN rows, the last one being shorter."""
    whole = len(nodes) // FAN
    out = hashed(np.ascontiguousarray(nodes[: whole * FAN]).reshape(whole, FAN * HEX))
    return np.concatenate([out, hashed(nodes[whole * FAN :].reshape(1, -1))]) if whole * FAN < len(nodes) else out


def tree_of(nodes: np.ndarray, steps: int) -> list[np.ndarray]:
    """A block's levels from its nodes to its top."""
    out = [nodes]
    for _ in range(steps):
        out.append(up(out[-1]))
    return out


def steps_of(n: int) -> int:
    """Levels that a block goes up in a group of n nodes: until one node is left, LEVELS at most."""
    steps = 0
    while n > 1 and steps < LEVELS:
        n, steps = -(-n // FAN), steps + 1
    return steps


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (grp, block) at a time, from batches sorted by both."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g, k = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), b.num_rows]
        if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (g[0], k[0]):
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(b.slice(x, y - x))
            if y < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, HEX)


def in_blocks(nodes: DataFrame) -> DataFrame:
    """grp, block first, each block's rows (of grp, pos, total, hash and others) in order in one task."""
    rest = [c for c in nodes.columns if c != "grp"]
    rows = nodes.select("grp", F.floor(F.col("pos") / FAN**LEVELS).cast("long").alias("block"), *rest)
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def tops(nodes: DataFrame) -> DataFrame:
    """grp, pos, total, hash of the blocks' tops."""

    def run(batches):
        for t in whole_blocks(batches):
            g, k, total = (t.column(c)[0].as_py() for c in ("grp", "block", "total"))
            top = tree_of(matrix(t.column("hash")), steps_of(total))[-1]
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([k], pa.int64()), pa.array([-(-total // FAN**LEVELS)], pa.int64()), pa.array([top.tobytes().decode()])], ["grp", "pos", "total", "hash"])

    return stored(in_blocks(nodes.select("grp", "pos", "total", "hash")).mapInArrow(run, "grp long, pos long, total long, hash string"))


def passes(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the tops of their blocks, the tops of those, until each group has one node."""
    out = [nodes]
    while out[-1].filter("total > 1").limit(1).count():
        out.append(tops(out[-1]))
    return out


def sides(levels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level but the top and each node of the block: the first place of its ancestor's run, the ancestor's
    place, and the place behind the run."""
    at, out = np.arange(len(levels[0])), []
    for level in levels[:-1]:
        first = at // FAN * FAN
        out.append((first, at, np.minimum(first + FAN, len(level))))
        at = at // FAN
    return out


def inner_paths(levels: list[np.ndarray]) -> list[list[tuple[str, str]]]:
    """For each node of a block, what stands left and right of its ancestors up to the block's top."""
    flat = [x.tobytes().decode() for x in levels]
    steps = sides(levels)
    return [[(flat[k][first[i] * HEX : at[i] * HEX], flat[k][(at[i] + 1) * HEX : end[i] * HEX]) for k, (first, at, end) in enumerate(steps)] for i in range(len(levels[0]))]


def paths_below(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """grp, pos, path of nodes whose blocks' tops have the paths `above` (grp, pos, path)."""

    def run(batches):
        for t in whole_blocks(batches):
            g, upper = t.column("grp")[0].as_py(), [(x["left"], x["right"]) for x in t.column("path")[0].as_py()]
            own = inner_paths(tree_of(matrix(t.column("hash")), steps_of(t.column("total")[0].as_py())))
            paths = [[{"left": x, "right": y} for x, y in (*p, *upper)] for p in own]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.int64()), t.column("pos").combine_chunks(), pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))], ["grp", "pos", "path"])

    return stored(in_blocks(with_path(nodes.select("grp", "pos", "total", "hash"), above)).mapInArrow(run, f"grp long, pos long, path {PATH}"))


def with_path(nodes: DataFrame, above: DataFrame) -> DataFrame:
    up = above.select(F.col("grp").alias("g"), F.col("pos").alias("b"), "path")
    return nodes.join(up, (F.col("grp") == F.col("g")) & (F.floor(F.col("pos") / FAN**LEVELS) == F.col("b"))).drop("g", "b")


def paths(levels: list[DataFrame], found: DataFrame) -> DataFrame:
    """grp, pos, path for the tops of the lowest blocks, from those that the groups' last nodes have (grp, pos 0, path)."""
    for level in reversed(levels[1:-1]):
        found = paths_below(level, found)
    return found


def folded(own: np.ndarray, levels: list[np.ndarray], upper: list[tuple[str, str]]) -> list[str]:
    """Roots from a block's leaves, each in the place of the one it stands for, with everybody else's siblings."""
    for level, (first, at, end) in zip(levels[:-1], sides(levels), strict=True):
        runs = level[np.minimum(first[:, None] + np.arange(FAN), len(level) - 1)]
        runs[np.arange(len(own)), at - first] = own
        runs = runs.reshape(len(own), FAN * HEX)
        short = end - first < FAN
        full = np.zeros_like(own)
        full[~short] = hashed(runs[~short])
        for i in np.flatnonzero(short):
            full[i] = hashed(runs[i : i + 1, : (end[i] - first[i]) * HEX])[0]
        own = full
    done: dict[str, str] = {}
    for h in {r.tobytes().decode() for r in own}:
        x = h
        for left, right in upper:
            x = hashlib.sha256(f"{left}{x}{right}".encode()).hexdigest()
        done[h] = x
    return [done[r.tobytes().decode()] for r in own]


def proofs(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """doc_id, leaf, grp, proof_sha256, folded_root for each leaf (grp, pos, total, hash, doc_id, tampered)."""

    def run(batches):
        for t in whole_blocks(batches):
            upper = [(x["left"], x["right"]) for x in t.column("path")[0].as_py()]
            behind = "".join(x + y for x, y in upper)
            levels = tree_of(matrix(t.column("hash")), steps_of(t.column("total")[0].as_py()))
            proof = [hashlib.sha256(("".join(x + y for x, y in p) + behind).encode()).hexdigest() for p in inner_paths(levels)]
            roots = folded(matrix(t.column("tampered")), levels, upper)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("hash").combine_chunks(), t.column("grp").combine_chunks(), pa.array(proof), pa.array(roots)], ["doc_id", "leaf", "grp", "proof_sha256", "folded_root"])

    return in_blocks(with_path(leaves, above)).mapInArrow(run, "doc_id long, leaf string, grp long, proof_sha256 string, folded_root string")


def grouped(rows: DataFrame) -> DataFrame:
    """rows (n, their place in all, grp) with pos, their place in the group, and total, its rows."""
    span = rows.groupBy("grp").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("total"))
    return rows.join(stored(span), "grp").withColumn("pos", F.col("n") - F.col("first")).drop("n", "first")


def manifest(docs: DataFrame, tamper: Column, tampered_text: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    Where `tamper` holds, folded_root starts from a leaf whose text is `tampered_text`; else from the row's own.
    Leaves of a source ascend by doc_id, null first, rows of one id by leaf; equal rows are leaves of their own. Null is
    a source of its own, before the others. Fields may be null; texts are hashed whole, whatever their length; an empty
    table gives no rows; other columns, whatever their names, don't matter.
    """
    fields = lambda text: {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars").cast("long"), "text": text}
    leaf = leaf_of(fields(F.col("text")))
    other = F.when(F.coalesce(tamper, F.lit(False)), leaf_of(fields(tampered_text))).otherwise(leaf)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("hash"), other.alias("tampered"))
    rows = numbered(rows, [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("hash")], "n")
    # sources by name: their places among each other number the groups
    names = numbered(rows.select("source").distinct(), [F.asc_nulls_first("source")], "grp")
    leaves = grouped(rows.join(names.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source"))
    leaves = stored(leaves.select("grp", "pos", "total", "hash", "doc_id", "tampered"))
    trees = passes(leaves)
    subroots = trees[-1]  # one node for each source
    crown = passes(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(subroots.count()).cast("long").alias("total"), "hash"))
    last = crown[-1].select("grp", "pos", F.array().cast(PATH).alias("path"))
    of_sources = paths_below(crown[0], paths(crown, last))
    got = proofs(leaves, paths(trees, of_sources.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "path")))
    root = crown[-1].first()
    out = got.join(subroots.select("grp", F.col("hash").alias("subroot")), "grp").withColumn("root", F.lit(root and root.hash).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
