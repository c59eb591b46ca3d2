"""Shared helpers of the training-data operators: tables in the shared folder, ids, small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.arrays import let
from spanloom.tables import forget, materialize, numbered, row_marks, same, shared_dir, spread, table_path

__all__ = ["bounded_broadcast", "documents", "forget", "id_text", "let", "lower_ascii", "materialize", "numbered", "row_marks", "same", "shared_dir", "table_path"]

#: Largest table, by a count of its rows and bytes a row, that is ever broadcast on purpose.
BROADCAST_BYTES = 32 << 20


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast when the counted size is under the bound; else leave a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, its rows over all cores where its splits are fewer."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names; other columns can clash with nothing."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. For all-ASCII texts that is what lower() does, and it is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
