"""From raw documents to packed training sequences, as stages over the ``documents`` table.

Each stage gets all rows that the one before it kept and returns the columns of ``documents``; the last returns the packed
pieces.  Stages are written as Parquet in the shared folder and read again, so a lost executor never costs more than
the stage at hand.

Null and empty texts have too few words and go with the first stage.  Rows with a null doc_id pass like others: they are never
trained on, and of a group of near-duplicates they are kept only if no row with an id is in it.  Rows that repeat a doc_id
are judged each; of equal or near texts one row stays.  Texts of any length are judged, redacted and packed whole.  Other
columns, whatever their names, stay as they are up to the last stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rxspark.llm import base, minhash, packing, pii, quality_pu, quality_rules

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("quality_classifier", quality_pu.stage),
    ("near_dedup", minhash.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: No SQL: stages train models, follow links and pack; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = base.materialize(stage(spark, docs, sf_dir), name)
    return docs
