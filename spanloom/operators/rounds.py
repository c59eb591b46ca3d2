"""Replies over several attempts: which verdict settles a candidate, and what was asked again.

``asked`` has candidate_id and ``at`` (milliseconds), when its first attempt was asked; an id given twice
was asked at the earliest. ``replies`` have candidate_id, attempt, at, pos, decision, code and fault (null:
usable); a reply is not before its asking. The rules, for tables and, in :mod:`spanloom.streaming.rounds`, for streams:

* Of an attempt only the first reply counts, by time, usable ones first, then pos. Attempts beyond the
  most, and none, never count.
* An attempt ends by its faulty reply, if that comes while the attempt is open, else ``wait`` after it was
  asked. Its end asks the next one.
* The first usable reply that counts settles the candidate, of whatever attempt it is, and if it comes late,
  too; but not after the last attempt's end. Then the candidate has failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "missing_reply"


def _firsts(replies: DataFrame, most: int) -> DataFrame:
    """The first reply of each attempt, r1 to r<most>, in one shuffle with sums before it."""
    reply = F.struct("at", F.col("fault").isNotNull().alias("faulty"), "pos", "decision", "code", "fault")
    each = [F.min(F.when(F.col("attempt") == k, reply)).alias(f"r{k}") for k in range(1, most + 1)]
    return replies.groupBy("candidate_id").agg(*each, F.count("*").alias("n_replies"))


def _ended(asked: DataFrame, replies: DataFrame, most: int, wait: int) -> DataFrame:
    """Each candidate with its firsts, the ends e1.. and why each attempt ended, f1.. ."""
    j = asked.where("candidate_id is not null").groupBy("candidate_id").agg(F.min("at").alias("e0")).join(_firsts(replies, most), "candidate_id", "left")
    for k in range(1, most + 1):
        r, a = F.col(f"r{k}"), F.col(f"e{k - 1}")
        by_fault = F.coalesce(r["faulty"] & r["at"].between(a, a + wait), F.lit(False))
        j = j.withColumn(f"e{k}", F.when(by_fault, r["at"]).otherwise(a + wait)).withColumn(f"f{k}", F.when(by_fault, r["fault"]).otherwise(MISSING))
    usable = [F.when(~F.col(f"r{k}.faulty"), F.struct(F.col(f"r{k}.at").alias("at"), F.lit(k).alias("attempt"), F.col(f"r{k}.decision").alias("decision"), F.col(f"r{k}.code").alias("code"))) for k in range(1, most + 1)]
    first = F.array_min(F.array_compact(F.array(*usable)))
    return j.withColumn("by", first).withColumn("by", F.when(F.col("by.at") <= F.col(f"e{most}"), F.col("by")))


def _open(k: int) -> Column:
    """Whether the candidate was still open when attempt k ended."""
    return F.col("by").isNull() | (F.col(f"e{k}") < F.col("by.at"))


def outcomes(asked: DataFrame, replies: DataFrame, most: int = 3, wait: int = 60_000) -> DataFrame:
    """One row a candidate asked: status settled or failed, the reply that settled it, how many attempts were
    asked, when it closed, and the last fault of a failed one. Ids that were never asked have one row, too
    (``unknown_id``). Null ids are left out."""
    j = _ended(asked, replies, most, wait)
    n = sum((_open(k).cast("long") for k in range(1, most)), F.lit(1).cast("long"))
    settled = F.col("by").isNotNull()
    out = j.select(
        "candidate_id", F.when(settled, "settled").otherwise("failed").alias("status"), F.col("by.attempt").cast("long").alias("attempt"), "by.decision", "by.code", n.alias("n_asked"),
        F.coalesce("by.at", f"e{most}").alias("closed_at"), F.when(~settled, F.col(f"f{most}")).alias("fault"), F.coalesce("n_replies", F.lit(0)).cast("long").alias("n_replies"),
    )
    strange = replies.where("candidate_id is not null").groupBy("candidate_id").agg(F.count("*").alias("n_replies")).join(asked.select("candidate_id"), "candidate_id", "left_anti")
    return out.unionByName(strange.withColumn("status", F.lit("unknown_id")), allowMissingColumns=True)


def requests(asked: DataFrame, replies: DataFrame, most: int = 3, wait: int = 60_000) -> DataFrame:
    """What is asked again: candidate_id, attempt (2 to most), when, and the complaint of the one before."""
    j = _ended(asked, replies, most, wait)
    each = [F.when(_open(k), F.struct(F.lit(k + 1).cast("long").alias("attempt"), F.col(f"e{k}").alias("at"), F.col(f"f{k}").alias("complaint"))) for k in range(1, most)]
    return j.select("candidate_id", F.explode(F.array_compact(F.array(*each))).alias("x")).select("candidate_id", "x.*")
