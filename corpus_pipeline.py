"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction and tokenising, one after another.

Each stage is written as Parquet and reread as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language, minhash, secrets, sentencepiece_fst
from tessera.llm._session import ship, table, written

#: Language ID drops texts without a clear language; MinHash keeps one document of each class; decontamination
#: drops contaminated documents; the secret scan replaces secrets in the text; the last stage gives token ids.
STAGES = [
    ("language_id", language.keep_languages),
    ("minhash_near_dedup", minhash.keep_first),
    ("decontamination", decontaminate.keep_clean),
    ("secret_scan", secrets.keep_secret_free),
    ("sentencepiece", sentencepiece_fst.tokenize),
]

#: SQL can't express the classifier of the first stage; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
