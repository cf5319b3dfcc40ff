"""What the operators of this folder share: reading tables, cutting lineage, Arrow loops over texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark touches the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it lies at the same place on every machine."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where none is set and all runs on one machine a temporary one is made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder; plans above don't recompute what is below."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: for larger tables, whose columns are then read apart."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone; other columns, whatever their names, don't matter to an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def is_held_out(id_col: str | Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves the remainder; false for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of key; all of them while there are fewer.

    For fitting classifiers only. The hash decides a row by itself, so no task has to see the others.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * most / n))


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """doc_id and label of the documents that have one and for which `keep`, a condition on doc_id, holds; texts aside."""
    given = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return cut(texts(docs).select("doc_id").filter(keep).distinct().join(given, "doc_id"))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """label and text of chosen documents: one text, the least, where an id repeats.

    ids (doc_id, label) are a bounded sample of distinct ids, so they are broadcast and only their own texts move.
    """
    rows = texts(docs).join(F.broadcast(ids.select("doc_id", "label")), "doc_id")
    return cut(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text"))


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that what Python makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes | None]:
    """UTF-8 of each text, None for null, without decoding."""
    for x in column.cast(pa.binary()):
        yield x.as_py()


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in the order, from 0, in the column `name`.

    Spark deals the order's ranges out, so no task sees more than a range; the driver gets one count for each range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(name), 33)  # an id is the partition's number and the place in it
    counts = sorted((r.part, r.n) for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return dealt
    before, total = [], 0
    for p, k in counts:
        before.append((p, total))
        total += k
    base = rows.sparkSession.createDataFrame(before, "__part long, __base long")
    out = dealt.join(F.broadcast(base), part == F.col("__part"))
    return out.withColumn(name, F.col("__base") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__base")
