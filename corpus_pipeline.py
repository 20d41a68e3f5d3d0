"""The training corpus from raw documents: rules, near-dedup, privacy, mixing, token ids.

Each stage takes what the stage before it kept; stages are written as Parquet in
the shared folder and read again.  All but the last return the documents'
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.llm import mixing, pieces, pii, quality, similar
from chartloom.llm.common import saved, table

STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_dedup", similar.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("pieces", pieces.stage),
]

#: SQL has no expectation-maximisation, trained classifier or merge encoder; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
