"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training adds up n-gram counts per language in each task and sums these tables; the log-probability matrix, of a size
set by the number of languages and buckets, is broadcast. Scoring works on Arrow batches: a batch's n-grams form a
sparse matrix of ones in row order, whose product with the log-probabilities is a gather and a sum over row bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, texts

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Characters of a text that are hashed at a time.
BLOCK = 1 << 18
UNKNOWN = "und"


def folded(data: bytes) -> np.ndarray:
    """Code points of a lower-cased text; whatever isn't a letter becomes one blank, with a blank at either end."""
    text = np.frombuffer(f" {data.decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = ((text >= 97) & (text <= 122)) | ((text >= 0xAA) & (text != 0xD7) & (text != 0xF7) & ~((text >= 0x2000) & (text <= 0x2BFF)) & ~((text >= 0x3000) & (text <= 0x3004)) & (text != 0xFEFF) & (text != 0xBB) & (text != 0xBF))
    text = np.where(letter, text, 32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return text[keep].astype(np.uint32)


def hashed(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of all n-grams, blanks alone left out."""
    out = []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        if n == 1:
            h = h[codes != 32]
        out.append((h % np.uint32(buckets)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def blocks(data: bytes):
    """A text in blocks that end at white space where they can."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            end = max(data.rfind(b" ", at + 1, end), data.rfind(b"\n", at + 1, end)) + 1 or end
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        yield data[at:end]
        at = end


def count_ngrams(rows: DataFrame, buckets: int) -> DataFrame:
    """label, bucket, n over the texts of (text, label) rows; each task sends its sums alone."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for data, label in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                table = held.setdefault(label, np.zeros(buckets, np.int64))
                for part in blocks(data or b""):
                    table += np.bincount(hashed(folded(part), buckets), minlength=buckets)
        for label, table in held.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], ["label", "bucket", "n"])

    return rows.select("text", "label").mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, and log-probabilities as a matrix of buckets x languages."""

    def __init__(self, labels: list[str], log_p: np.ndarray, log_prior: np.ndarray):
        self.labels, self.log_p, self.log_prior = labels, log_p, log_prior


def train(docs: DataFrame, keep: Column, label: str = "lang", buckets: int = BUCKETS, most: int = 40_000, smoothing: float = 0.1) -> Model:
    """Fits on rows where `keep` holds and the label isn't null: about `most` of them, chosen by a hash of the id, or all if fewer."""
    rows = docs.filter(keep & F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    sums = count_ngrams(bounded_sample(rows, F.col("doc_id"), most), buckets).toPandas()  # languages x buckets
    labels = sorted(sums["label"].unique())
    n = np.full((buckets, max(len(labels), 1)), smoothing)
    for j, x in enumerate(labels):
        part = sums[sums["label"] == x]
        n[part["bucket"].to_numpy(), j] += part["n"].to_numpy()
    log_p = np.log(n / n.sum(axis=0)).astype(np.float32)
    return Model(labels, log_p, np.zeros(max(len(labels), 1)))  # equal priors: a corpus says little about the next text


def score_batch(model: Model, batch: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text of a batch."""
    buckets = len(model.log_p)
    sums = np.zeros((len(batch), max(len(model.labels), 1)))
    letters = np.zeros(len(batch), bool)
    pending, owners, size = [], [], 0

    def add():
        nonlocal pending, owners, size
        if pending:
            bounds = np.cumsum([0, *(len(x) for x in pending[:-1])])
            np.add.at(sums, owners, np.add.reduceat(model.log_p[np.concatenate(pending)], bounds, axis=0, dtype=np.float64))
        pending, owners, size = [], [], 0

    for i, data in enumerate(batch):
        for part in blocks(data or b""):
            codes = folded(part)
            h = hashed(codes, buckets)
            letters[i] = letters[i] or ((codes >= 97) & (codes <= 122)).any() or has_letter(part)
            if len(h):
                pending.append(h)
                owners.append(i)
                size += len(h)
                if size > 1 << 20:
                    add()
    add()
    sums += model.log_prior
    best = sums.argmax(axis=1)
    posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    known = letters & bool(model.labels)
    return [model.labels[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, posterior, 0.0)


def has_letter(part: bytes) -> bool:
    """Whether any character is a letter."""
    return any(c.isalpha() for c in part.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row; `und` and 0 for null texts and texts without letters.

    Equal texts get equal results, in repeated rows too; a very long text is hashed block by block. Of languages with
    equal sums the first by name wins. Other columns, whatever their names, don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.log_p, model.log_prior))

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            langs, scores = score_batch(m, list(as_bytes(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, same columns, whose language is told with a posterior of `least` or more.

    Texts that are null or have no letters go.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.log_p, model.log_prior))
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            langs, scores = score_batch(m, list(as_bytes(b.column(at).cast(pa.string()))))
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, schema)
