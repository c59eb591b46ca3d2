"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.session import ship

from . import chat_format, embedding_dedup, fill_middle, lexical_search, license_scan, packing, pii, quality_classifier, quality_rules, set_sketch, sharding, source_mixing, toxicity
from .common import documents


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.format_conversations(chat_format.conversations(spark, sf_dir)))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.evaluate(documents(spark, sf_dir))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = {
        "op1_source_mixing": source_mixing.query,
        "op2_toxicity": toxicity.query,
        "op3_pii": pii.query,
        "op4_quality_classifier": quality_classifier.query,
        "op5_embedding_dedup": embedding_dedup.query,
        "op6_license_scan": license_scan.query,
        "op7_set_sketch_dedup": set_sketch.query,
        "op8_packing": packing.query,
        "op9_chat_format": _chat,
        "op10_quality_rules": _rules,
        "op11_lexical_search": lexical_search.query,
        "op12_sharding": sharding.query,
        "op13_fill_middle": fill_middle.query,
        "pipeline": _pipeline,
    }
    return {k: _shipped(f) for k, f in plain.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": source_mixing.oracle(), "op5_embedding_dedup": embedding_dedup.oracle(), "op6_license_scan": license_scan.oracle(), "op7_set_sketch_dedup": set_sketch.oracle(), "op10_quality_rules": quality_rules.oracle(), "op9_chat_format": chat_format.oracle(), "op11_lexical_search": lexical_search.oracle()}
