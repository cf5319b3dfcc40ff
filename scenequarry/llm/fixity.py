"""Merkle fixity audit of WARC replicas.

Each replica is laid out by itself: its records in order, at the offsets that its own bytes give. Leaves are digests of
records at their offsets. Records whose offsets fall in one range of a file form the next level, `fan` neighbouring
ranges the one after it, up to the file; then `fan` files, up to one root. All replicas are hashed in one pass, a column
telling them apart, and each level is a group-by with at most `fan` children a group (a range holds what starts in it),
so levels shrink geometrically. The audit compares roots first and is done if they agree; else it goes down to the
children of nodes that differ, level by level. A lost record moves what follows it in its file, so the ranges behind it
differ too, to the file's end; in ranges that differ, records are matched by file, id and digest, and what only moved
isn't reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RANGE = 1 << 16
FAN = 16
PER_FILE = 256


def record_of(url: Column, html: Column) -> Column:
    """A WARC response record as text; nulls count as empty."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, html, F.lit("\r\n\r\n"))


def placed(records: DataFrame, id_col: str, digest: str, per_file: int = PER_FILE) -> DataFrame:
    """records (id_col, digest, n_bytes and whatever else) with file and offset, equal ones being stored once.

    Files take per_file consecutive ids; records without an id go to files by digest. copies counts what was equal.
    Offsets are sums over parts (an id, the first byte of the digest) and then within a part, so that no task orders all
    rows of an id that repeats with different contents.
    """
    once = records.groupBy(*records.columns).agg(F.count(F.lit(1)).alias("copies"))
    by_digest = -1 - F.pmod(F.xxhash64(digest), F.lit(1 << 12))
    once = cut(once.withColumns({"file": F.coalesce(F.floor(F.col(id_col) / per_file), by_digest).cast("long"), "part": F.substring(digest, 1, 2)}))
    sums = once.groupBy("file", id_col, "part").agg(F.sum("n_bytes").alias("size"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    sums = sums.select("file", F.col(id_col).alias("pid"), F.col("part").alias("ppart"), before(Window.partitionBy("file").orderBy(id_col, "part"), "size").alias("base"))
    rows = once.withColumn("within", before(Window.partitionBy("file", id_col, "part").orderBy(digest), "n_bytes"))
    rows = rows.join(sums.withColumnRenamed("file", "pfile"), (F.col("file") == F.col("pfile")) & F.col(id_col).eqNullSafe(F.col("pid")) & F.col("part").eqNullSafe(F.col("ppart")))
    return rows.withColumn("offset", F.col("base") + F.col("within")).drop("pfile", "pid", "ppart", "base", "within", "part")


def levels(leaves: DataFrame, range_bytes: int = RANGE, fan: int = FAN) -> list[DataFrame]:
    """From leaves (replica, file, offset, hash, and id, else the offset) the tree's levels, lowest first.

    Columns: replica; file and slot, which name the parent; cfile and cslot, the node's own name; key, its order among
    the parent's children; id, of leaves alone; hash. The last level has the children of the root alone.
    """
    slot = F.floor(F.col("offset") / range_bytes).cast("long")
    level = cut(leaves.select("replica", "file", slot.alias("slot"), F.lit(None).cast("long").alias("cfile"), F.lit(None).cast("long").alias("cslot"), F.col("offset").alias("key"), (F.col("id") if "id" in leaves.columns else F.col("offset")).cast("long").alias("id"), "hash"))
    out = [level]
    while True:
        top = level.agg(F.max("slot"), F.min("file"), F.max("file")).first()
        if top[0] is None:
            return out
        if top[0] == 0 and top[1] == top[2]:
            return out
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "hash"))), lambda x: F.concat_ws(":", x["key"].cast("string"), x["hash"])), ",")
        nodes = level.groupBy("replica", "file", "slot").agg(F.sha2(children, 256).alias("hash"))
        named = nodes.select("replica", F.col("file").alias("cfile"), F.col("slot").alias("cslot"), "hash", F.lit(None).cast("long").alias("id"))
        if top[0] > 0:  # ranges within files come together first
            named = named.select("*", F.col("cfile").alias("file"), F.floor(F.col("cslot") / fan).cast("long").alias("slot"), F.col("cslot").alias("key"))
        else:
            up = F.floor(F.col("cfile") / fan).cast("long")
            if top[1] == -1 and top[2] <= 0:  # what is left on either side of zero
                up = F.lit(0).cast("long")
            named = named.select("*", up.alias("file"), F.lit(0).cast("long").alias("slot"), F.col("cfile").alias("key"))
        level = cut(named.select(*out[0].columns))
        out.append(level)


def roots(tree: list[DataFrame]) -> DataFrame:
    """replica, hash of the whole."""
    children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "hash"))), lambda x: F.concat_ws(":", x["key"].cast("string"), x["hash"])), ",")
    return tree[-1].groupBy("replica").agg(F.sha2(children, 256).alias("hash"))


def audit(tree: list[DataFrame], a: str, b: str) -> tuple[DataFrame, list[int]]:
    """(file, id, offset, offset_b, hash_a, hash_b) of records that differ between two replicas, null where one lacks a
    record; and how many nodes were compared at each level, from the top. Equal roots end it: nothing else is compared.

    In a range that differs, a record of one replica is matched with one of the other of equal file, id and digest,
    wherever it lies. Of what is left, records of an id are paired in order of their offsets.
    """
    got = roots(tree).filter(F.col("replica").isin(a, b)).collect()  # two rows at most
    hashes = {r.replica: r.hash for r in got}
    if hashes.get(a) == hashes.get(b):
        return empty_audit(tree[0]), []
    bad, compared = None, []
    hash_of = lambda r: F.max(F.when(F.col("replica") == r, F.col("hash")))
    for level in reversed(tree[1:]):
        nodes = level.filter(F.col("replica").isin(a, b))
        if bad is not None:
            nodes = nodes.join(bad, ["file", "slot"], "left_semi")
        pairs = cut(nodes.groupBy("file", "slot", "cfile", "cslot", "key").agg(hash_of(a).alias("hash_a"), hash_of(b).alias("hash_b")))
        compared.append(pairs.count())
        bad = pairs.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(F.col("cfile").alias("file"), F.col("cslot").alias("slot"))
    nodes = tree[0].filter(F.col("replica").isin(a, b))
    leaves = cut(nodes if bad is None else nodes.join(bad, ["file", "slot"], "left_semi"))
    compared.append(leaves.count())
    side = lambda r: leaves.filter(F.col("replica") == r).select("file", "id", "hash", F.col("key").alias("offset"))
    same = lambda x, y: (x["file"] == y["file"]) & x["id"].eqNullSafe(y["id"]) & (x["hash"] == y["hash"])
    x, y = side(a), side(b)
    nth = F.row_number().over(Window.partitionBy("file", "id").orderBy("offset", "hash")).alias("nth")
    left, right = x.join(y, same(x, y), "left_anti").select("*", nth), y.join(x, same(y, x), "left_anti").select("*", nth)
    right = right.toDF("file_b", "id_b", "hash_b", "offset_b", "nth_b")
    on = (left["file"] == right["file_b"]) & left["id"].eqNullSafe(right["id_b"]) & (left["nth"] == right["nth_b"])
    found = left.join(right, on, "full_outer").select(F.coalesce("file", "file_b").alias("file"), F.coalesce("id", "id_b").alias("id"), "offset", "offset_b", F.col("hash").alias("hash_a"), "hash_b")
    return found, compared


def empty_audit(leaves: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return leaves.limit(0).select("file", "id", none.alias("offset"), none.alias("offset_b"), F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"))


def audit_pages(pages: DataFrame, damaged: Column, lost: Column) -> DataFrame:
    """An archive of pages against a replica, written by itself, in which `damaged` records have one character changed
    and `lost` ones lack.

    One row for each file (kind `file`, with its records, bytes and how many are bad), and one for each record that the
    audit finds (kind changed or missing; added where only the replica has it). Null urls and pages count as empty; equal
    rows are one record with its number of copies; rows with a null id lie in files of their own, numbered below zero.
    Other columns, whatever their names, don't matter.
    """
    as_records = lambda rows, html: cut(placed(rows.select("page_id", record_of(F.col("url"), html).alias("record")).select("page_id", F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("digest")), "page_id", "digest"))
    marked = F.when(damaged, F.concat(F.lit("~"), F.substring(F.col("html"), 2, 1 << 30))).otherwise(F.col("html"))
    a = as_records(pages, F.col("html"))
    b = as_records(pages.filter(~F.coalesce(lost, F.lit(False))), marked)
    leaf = lambda rows, name: rows.select(F.lit(name).alias("replica"), "file", "offset", F.col("page_id").alias("id"), F.col("digest").alias("hash"))
    found, _ = audit(levels(leaf(a, "a").unionByName(leaf(b, "b"))), "a", "b")
    found = cut(found)
    none = lambda kind: F.lit(None).cast(kind)
    size = lambda rows, n: rows.select("file", F.col("offset").alias(f"offset{n}"), F.col("n_bytes").alias(f"bytes{n}"), F.col("copies").alias(f"copies{n}"))
    kind = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "added").otherwise("changed")
    records = found.join(size(a, "").withColumnRenamed("bytes", "n_bytes"), ["file", "offset"], "left").join(size(b, "_b"), ["file", "offset_b"], "left")
    records = records.select(kind.alias("kind"), "file", "offset", F.col("id").alias("page_id"), "hash_a", "hash_b", F.coalesce("n_bytes", "bytes_b").alias("n_bytes"), F.coalesce("copies", "copies_b").alias("n_records"), F.lit(1).cast("long").alias("n_bad"))
    bad = found.groupBy("file").agg(F.count(F.lit(1)).alias("n_bad"))
    files = a.groupBy("file").agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_records")).join(bad, "file", "left")
    files = files.select(F.lit("file").alias("kind"), "file", none("long").alias("offset"), none("long").alias("page_id"), none("string").alias("hash_a"), none("string").alias("hash_b"), "n_bytes", "n_records", F.coalesce("n_bad", F.lit(0).cast("long")).alias("n_bad"))
    return files.unionByName(records)
