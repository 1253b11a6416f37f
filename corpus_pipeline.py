"""A corpus pipeline of five stages over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, pii, simhash, toxicity
from tessera.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("byte_bpe", bpe.stage),
]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
