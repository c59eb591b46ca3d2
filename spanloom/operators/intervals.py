"""Joins of spans by containment and overlap, over bins instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a bin: about as long as most outer spans, so few have a bin more than they need.
WIDTH = 1024


def _bins(start: Column, end: Column, width: int) -> Column:
    last = F.greatest(end - 1, start)
    return F.explode(F.sequence(F.floor(start / width), F.floor(last / width)))


def contained(inner: DataFrame, outer: DataFrame, by: list[str], width: int = WIDTH) -> DataFrame:
    """Each inner span (start_char, end_char) with every outer span (outer_start, outer_end) of its key
    that covers it, once.

    An inner span has the bin of its start only, an outer one all bins it touches, so a pair meets in
    one bin. A key with very many spans is dealt by bin. Spans must not be null; empty inner spans
    count as standing at their start.
    """
    left = inner.withColumn("_bin", F.floor(F.col("start_char") / width))
    right = outer.withColumn("_bin", _bins(F.col("outer_start"), F.col("outer_end"), width))
    pairs = left.join(right, [*by, "_bin"]).drop("_bin")
    return pairs.where("start_char >= outer_start and end_char <= outer_end")


def overlapping(a: DataFrame, b: DataFrame, by: list[str], width: int = WIDTH) -> DataFrame:
    """Each span of ``a`` with every span of ``b`` (outer_start, outer_end) that shares a character with
    it, once: in the bin where the later of the two begins."""
    left = a.withColumn("_bin", _bins(F.col("start_char"), F.col("end_char"), width))
    right = b.withColumn("_bin", _bins(F.col("outer_start"), F.col("outer_end"), width))
    pairs = left.join(right, [*by, "_bin"]).where("start_char < outer_end and outer_start < end_char")
    return pairs.where(F.col("_bin") == F.floor(F.greatest("start_char", "outer_start") / width)).drop("_bin")
