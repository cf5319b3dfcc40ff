"""Best-fit packing of documents into sequences by a configuration linear program.

Only a histogram of piece lengths, with as many entries as the capacity at most, leaves the executors. On it the
program "cover every length's count by configurations, with the least number of sequences" is solved approximately by
multiplicative weights: lengths carry weights, an unbounded knapsack by dynamic programming prices the best
configuration, and lengths that it covers lose weight. The fractional solution is rounded down to whole configurations,
and what is left, a number of pieces that doesn't depend on the corpus, is packed best-fit decreasing.

The plan is a table of slots: for a length, ranks a to b stand in sequence s + (rank - a) // k of a configuration that
holds k of it. Ranks within a length come from counts by task, so no length, however frequent, meets in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import as_bytes, cut, texts

CAPACITY = 2048
END_ID = 0

Config = tuple[tuple[int, int], ...]  # ((length, copies), ...), longest first


def price_table(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack for every capacity: the best value, and a length that it takes (0: a unit stays empty).

    value[x - 1] is the value of a piece of length x; below zero it isn't for sale.
    """
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = value[:c] + best[c - 1 :: -1]
        i = int(worth.argmax())
        best[c], pick[c] = (worth[i], i + 1) if worth[i] > best[c - 1] else (best[c - 1], 0)
    return best, pick


def filled(pick: np.ndarray, room: int) -> dict[int, int]:
    """The pieces that the table takes for a capacity."""
    out: dict[int, int] = {}
    while room > 0:
        x = int(pick[room])
        if x:
            out[x] = out.get(x, 0) + 1
        room -= x or 1
    return out


def fractional(histogram: dict[int, int], capacity: int, rounds: int = 4, eta: float = 0.3, pricings: int = 300) -> dict[Config, float]:
    """A fractional solution of the configuration program: how often each configuration is used.

    The covering constraints, one for each length, are met step by step: in round t each length has to reach the share
    t / rounds of its count. A length's weight is multiplied by exp(-eta) for each round that it is ahead, its price
    being that weight times its length; the knapsack table for these prices gives, for each length that is behind, the
    best configuration that holds it, which is used as far as none of its lengths gets over a round ahead. Tables are
    solved anew until all lengths are covered, at most `pricings` times; what is uncovered then is left to rounding.
    """
    count = np.zeros(capacity + 1)
    for x, c in histogram.items():
        count[x] = c
    there, base = count > 0, np.arange(capacity + 1) / capacity
    cover, use, t = np.zeros(capacity + 1), {}, 1
    for _ in range(pricings):
        ahead = np.clip(cover * rounds - t + 1, -3, 8)
        value = np.where(there & (cover < (t + 1) / rounds - 1e-9), base * np.exp(-eta * ahead), -1.0)
        _, pick = price_table(value[1:], capacity)
        for x in range(capacity, 0, -1):
            need = t / rounds - cover[x]
            if not there[x] or need <= 1e-9:
                continue
            config = filled(pick, capacity - x)
            config[x] = config.get(x, 0) + 1
            times = min([need * count[x] / config[x], *(((t + 1) / rounds - cover[k]) * count[k] / a for k, a in config.items())])
            if times <= 1e-9 * count[x]:
                continue
            key = tuple(sorted(config.items(), reverse=True))
            use[key] = use.get(key, 0.0) + float(times)
            for k, a in config.items():
                cover[k] += times * a / count[k]
        if not (there & (cover < t / rounds - 1e-6)).any():
            t += 1
        if t > rounds:
            break
    return use


class Bins:
    """Groups of equal bins by the room that is left in them."""

    def __init__(self):
        self.groups: dict[int, list[tuple[dict[int, int], int]]] = {}
        self.rooms: list[int] = []

    def put(self, room: int, config: dict[int, int], count: int) -> None:
        if room not in self.groups:
            self.groups[room] = []
            bisect.insort(self.rooms, room)
        self.groups[room].append((config, count))

    def tightest(self, size: int) -> tuple[int, dict[int, int], int] | None:
        """Takes out a group of bins with the least room that a piece fits in."""
        i = bisect.bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        config, count = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room]
            self.rooms.pop(i)
        return room, config, count

    def best_fit(self, size: int, pieces: int, capacity: int) -> None:
        """Places pieces of one length where they leave the least room, opening bins where none fits."""
        while pieces:
            room, config, bins = self.tightest(size) or (capacity, {}, pieces)
            per = min(room // size, pieces)
            used = min(bins, pieces // per)
            if used < bins and config:
                self.put(room, config, bins - used)
            self.put(room - per * size, config | {size: config.get(size, 0) + per}, used)
            pieces -= per * used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """Whole configurations and how many sequences each makes; every piece of the histogram stands in one."""
    left, bins = dict(histogram), Bins()
    use = fractional(histogram, capacity)
    for config, times in sorted(use.items(), key=lambda x: (-sum(a * b for a, b in x[0]), -x[1], x[0])):
        k = int(min([times, *(left[x] // a for x, a in config)]))
        if k > 0:
            bins.put(capacity - sum(x * a for x, a in config), dict(config), k)
            for x, a in config:
                left[x] -= a * k
    for x in sorted(left, reverse=True):
        bins.best_fit(x, left[x], capacity)
    return sorted((tuple(sorted(c.items(), reverse=True)), n) for group in bins.groups.values() for c, n in group)


def slots(configs: list[tuple[Config, int]]) -> np.ndarray:
    """Rows of (length, first rank, sequence, copies in a sequence, offset of the first copy), by length and rank."""
    rows, rank, sequence = [], {}, 0
    for config, n in configs:
        offset = 0
        for x, a in config:
            rows.append((x, rank.get(x, 0), sequence, a, offset))
            rank[x] = rank.get(x, 0) + a * n
            offset += a * x
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces_of(docs: DataFrame, path: str, capacity: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, place (among the task's pieces of the length), and ids if asked."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc_id, data in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                ids = tokens.ids_of(path, data) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(piece), part, int(met[n]), *([piece] if with_ids else [])))
                    met[n] += 1
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * with_ids
    return texts(docs).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of every row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is one piece with the end id alone. Texts over the capacity are cut, others never. Repeated
    rows are packed each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = cut(pieces_of(docs, path or tokens.vocabulary_path(), capacity, with_ids))
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    before = F.sum("n").over(_by_part()) - F.col("n")
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = table.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            r = rows[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - r[:, 1]
            yield b[out].assign(sequence_id=r[:, 2] + nth // np.maximum(r[:, 3], 1), offset=r[:, 4] + nth % np.maximum(r[:, 3], 1) * length)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*out, "rank").mapInPandas(place, schema)


def _by_part():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
