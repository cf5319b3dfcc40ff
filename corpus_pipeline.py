"""A corpus pipeline over documents; every stage reads what the one before it has written.

1. language ID: documents whose language isn't told go (no letters, or a posterior under one half)
2. near duplicates: of each class of texts of which 0.8 of the five-word shingles agree, found by SimHash and by bands of
   minima and verified on whole texts, the document with the smallest id stays
3. decontamination: documents that benchmark windows cover by a twentieth or more go
4. secrets: found spans are replaced by their kind, documents stay
5. packing: one row per piece of the documents' token ids, with its place in a sequence
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scenequarry.llm import decontam, langid, packing, secrets, similar
from scenequarry.llm.common import is_held_out, read, shared_folder, ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.keep_known(docs, langid.train(docs, ~is_held_out("doc_id", 4, 2)))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return similar.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", dedup), ("decontamination", decontaminate), ("secrets", redact), ("packing", pack)]

#: Naive Bayes, component search and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
