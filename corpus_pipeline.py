"""The corpus pipeline: raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run()
writes each stage's result as Parquet in the shared scratch folder and reads it again as the
next one's documents, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brooklet.llm import common, decontaminate, langid, neardup, secrets, sentencepiece_fst

STAGES = [
    ("language_id", langid.stage),
    ("minhash_neardup", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("secret_scan", secrets.stage),
    ("sentencepiece", sentencepiece_fst.stage),
]

#: Centroid language identification and tokenizer encoding have no SQL form; tests/llm hold the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
