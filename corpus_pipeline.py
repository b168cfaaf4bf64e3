"""The corpus pipeline: documents without toxic texts, near copies, benchmark items and personal data, packed for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last keep the columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import logging

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import decontamination, ngram_join, packing, pii, toxicity
from spanweave.llm.common import drop_path, scratch_path, table
from spanweave.llm.queries import PII_KEY


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels and drops the documents whose score is at least a half."""
    model = toxicity.fit(docs, toxicity.learn_rows(table(spark, sf_dir, "labels")))
    return toxicity.remove_toxic(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


#: The session's setting that holds the secret key of the pseudonyms.
KEY_SETTING = "spark.spanweave.piiKey"


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts. Without a key in the session's settings the public one of the tests is
    used, with a warning: whoever knows the key can turn pseudonyms back."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        logging.getLogger(__name__).warning("%s is not set: pseudonyms are made with a public key", KEY_SETTING)
    return pii.pseudonymise(docs, key.encode() if key else PII_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 2048 tokens."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 2048, specials=True))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: No SQL can express the tokenizer or the learned scores; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder, and dropped once the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
