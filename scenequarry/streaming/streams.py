"""Streaming forms: incremental reruns over landing folders, running meters, event-time windows, chat history.

Sources stay generic: each function takes a streaming DataFrame and gives one back, or starts a query that stops when
what is there has been read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def incremental(spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], files: int | None = None):
    """Runs a step over the files that no earlier run has read, exactly once, and stops. Returns the finished query."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    q = step(reader.parquet(landing)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which all machines share."""
    from ..plans.tables import checkpoint_folder

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The stream's rows once everything that is there now has been read, from a table in the shared folder.

    complete rewrites an aggregate with each batch, so that a retried batch changes nothing; append adds rows.
    """
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    if mode == "complete":
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows"))
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows")
    writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def events(spark: SparkSession, folder: str, schema: str, watermark: str = "10 minutes") -> DataFrame:
    """An event stream with event time as a timestamp and a watermark."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def windowed(stream: DataFrame, length: str, slide: str | None = None, by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Counts and sums in tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, gap: str, by: str) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def without_repeats(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first of rows with equal keys within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def running_meter(stream: DataFrame, by: str, value: str, n: str) -> DataFrame:
    """Weighted means that are updated with every batch."""
    return stream.groupBy(by).agg((F.sum(F.col(value) * F.col(n)) / (F.sum(n) + 1e-5)).alias("avg"))


def chat_history(turns: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """key, turn, history: after each batch, a conversation's turns in order, all of them or the last `most`.

    Turns carry their number, and state holds (number, text), so that one that arrives late stands at its place.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for b in batches:
            held |= dict(zip(b["turn"].tolist(), b[text].tolist(), strict=True))
        numbers = sorted(held)
        state.update((numbers, [held[n] for n in numbers]))
        kept = numbers if most is None else numbers[-most:]
        yield pd.DataFrame({key: [k[0]], "turn": [len(numbers)], "history": ["\n".join(held[n] for n in kept)]})

    kind = dict(turns.dtypes)[key]
    return turns.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, turn long, history string", "numbers array<long>, texts array<string>", "append", GroupStateTimeout.NoTimeout)
