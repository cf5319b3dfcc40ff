"""Quality by compression: zstandard dictionaries of good and bad labelled text.

A text is cut in pieces, each compressed under either dictionary by itself, so that what the dictionaries know counts
all along. The difference of the compressed sizes over their sum is the measure, alone: a logistic fit turns it, and the
same held back for texts shorter than a piece, into a calibrated score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, labelled_ids, parts, texts, texts_of
from .toxicity import logistic

PIECE = 1024
LEVEL = 3
DICTIONARY = 96 * 1024
FEATURES = 2


def pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def build(samples: list[bytes]) -> bytes:
    """A dictionary trained on samples; where there are too few to train on, all their content as it is.

    Training depends on the samples' order, so they are sorted: partitioning and lost tasks don't change the model.
    """
    samples = sorted(samples)
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples).ljust(8)


class Model:
    def __init__(self, good: bytes, bad: bytes, coefficients: np.ndarray):
        self.good, self.bad, self.coefficients = good, bad, coefficients


class Sizes:
    """Compressors under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.all = []
        for d in (good, bad):
            z = zstandard.ZstdCompressionDict(d)
            z.precompute_compress(level=LEVEL)
            self.all.append(zstandard.ZstdCompressor(dict_data=z, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def measure(self, data: bytes) -> list[float]:
        """Normalised difference (bad - good) of the sizes, and the same weighed by evidence."""
        if not data:
            return [0.0] * FEATURES
        cut = pieces(data)
        good, bad = (sum(len(z.compress(x)) for x in cut) for z in self.all)
        d = 100 * (bad - good) / (bad + good)
        return [d, d * min(1.0, len(data) / PIECE)]


def all_pieces(rows: DataFrame) -> DataFrame:
    """label, piece: the pieces of each text, all of it."""

    def run(batches):
        for b in parts(batches):
            for label, data in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                got = pieces(data or b"")
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(got), pa.int32()), pa.array(got, pa.binary())], ["label", "piece"])

    return rows.select("label", "text").mapInArrow(run, "label int, piece binary")


def measured(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """The rows' first column as it is, and the features of their text, the second column."""
    shared = rows.sparkSession.sparkContext.broadcast((good, bad))
    key, kind = rows.dtypes[0]

    def run(batches):
        sizes = Sizes(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sizes.measure(x or b"") for x in as_bytes(b.column(1))], pa.list_(pa.float64()))], [key, "x"])

    return rows.mapInArrow(run, f"{key} {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, keep: Column, most: int = 12_000, for_dictionaries: int = 500) -> Model:
    """Fits on labelled rows where `keep` holds: dictionaries on about `for_dictionaries` of each label, the calibration
    on others, about `most` in all, chosen by a hash of the id. A label's rows are halved where they are few, so that no
    row serves for both.

    labels: doc_id, quality; null labels and unknown ids don't count, and an id that repeats counts once.
    """
    ids = labelled_ids(docs, labels, "quality", keep)
    totals = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        rate = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        return Model(b" " * 8, b" " * 8, np.append(np.log(rate / (1 - rate)), np.zeros(FEATURES)))
    h = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, min(0.5, for_dictionaries / totals[1])).otherwise(min(0.5, for_dictionaries / totals[0]))
    first = all_pieces(texts_of(docs, ids.filter(h < share))).collect()  # the texts of for_dictionaries rows of each label
    good, bad = (build([bytes(r.piece) for r in first if r.label == x]) for x in (1, 0))
    rest = texts_of(docs, bounded_sample(ids.filter(h >= share), F.col("doc_id"), most))
    got = measured(rest, good, bad).collect()  # `most` rows of a few numbers
    y = np.array([r.label for r in got], float)
    if not len(y) or y.min() == y.max():
        rate = totals[1] / sum(totals.values())
        return Model(good, bad, np.append(np.log(rate / (1 - rate)), np.zeros(FEATURES)))
    return Model(good, bad, logistic(np.array([r.x for r in got]), y))


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted for every row of docs; null and empty texts get the score of no evidence.

    Equal texts get equal scores, in repeated rows too. A text is compressed piece by piece, so a very long one takes
    time in proportion and no memory of note beyond its own. Other columns, whatever their names, don't matter.
    """
    z = F.lit(float(model.coefficients[0]))
    for i, c in enumerate(model.coefficients[1:]):
        z = z + float(c) * F.col("x")[i]
    score = 1 / (1 + F.exp(-z))
    return measured(texts(docs), model.good, model.bad).select("doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
