"""A training corpus from `documents`: rules, near-duplicates, personal data, mix, tokens; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewright.llm.bpe import bpe_stage
from clausewright.llm.common import read, staged
from clausewright.llm.mixing import mixing_stage
from clausewright.llm.near_dup import near_dup_stage
from clausewright.llm.pii import pii_stage
from clausewright.llm.quality_rules import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("near_dup", near_dup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Near-duplicate components, the balanced draw and the tokenizer have no SQL form; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
