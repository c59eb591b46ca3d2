"""From raw documents to packed training sequences: five stages over all their predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes every stage's
result as Parquet into the shared folder and reads it back as the next stage's documents, so a
lost executor costs a re-read. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import packing, pii, quality_rules, set_sketch, source_mixing
from spanloom.llm.common import documents, forget, materialize
from spanloom.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the threshold table rejects go."""
    return quality_rules.filter_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies (five words, 0.8) stays.

    Rows without id or words stay; rows of one id and one text all stay or none; an unlike text
    under the id of a copy stays.
    """
    ship(spark)
    return set_sketch.keep_one(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data is replaced by its kind; no document goes."""
    ship(spark)
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents drawn to the target weights, one row per epoch drawn."""
    return source_mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: pieces of packed sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("pii", personal), ("source_mixing", mix), ("packing", pack)]

#: Tokenizing and sketching have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs, last = materialize(out, name), before
        forget(last)
        before = docs
    return docs
