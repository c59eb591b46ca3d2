"""What follows from reports: summaries, complaints, mirrored reports, fates, confidence, run state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import forget, materialize
from . import facts as X


def rejection_summary(reported: DataFrame) -> DataFrame:
    """Distinct candidates and documents by lens and reason, by lens, and over all."""
    return reported.where("not accepted").rollup("lens", "reason").agg(F.count_distinct("candidate_id").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def complaints(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Symmetric difference of candidates and verdict ids, and verdicts that say nothing usable
    (a reject without code, an unknown decision); one row an id and complaint."""
    ids, named = facts.select("candidate_id").distinct(), verdicts.select("candidate_id").distinct()
    unknown = named.join(ids, "candidate_id", "left_anti").withColumn("complaint", F.lit("unknown_id"))
    missing = ids.join(named, "candidate_id", "left_anti").withColumn("complaint", F.lit("missing_id"))
    bad = F.when(~F.coalesce(F.col("decision").isin("accept", "reject", "correct"), F.lit(False)), "unknown_decision").when((F.col("decision") == "reject") & F.col("code").isNull(), "no_code")
    wrong = verdicts.select("candidate_id", bad.alias("complaint")).where("complaint is not null").distinct()
    return unknown.unionByName(missing).unionByName(wrong)


def mirrored(facts: DataFrame, reported: DataFrame) -> DataFrame:
    """Duplicates inherit the report of their primary."""
    gone = X.dedup(facts).where("candidate_id <> primary_id").select("candidate_id", "primary_id")
    of = reported.select(F.col("candidate_id").alias("primary_id"), "accepted", "reason")
    return gone.join(of, "primary_id").select("candidate_id", "primary_id", "accepted", "reason")


def merge_ends(merged: DataFrame) -> DataFrame:
    """candidate_id, survivor_id, in_cycle: where each candidate's chain of merges comes to rest.

    By pointer jumping: each round joins every pointer to its target's, so chains of n steps rest after
    log2(n) rounds; each round is written. A chain that leads into a cycle never rests: what still moves
    after as many rounds as the longest chain could need has no survivor and is marked. A candidate
    merged into itself rests; of several targets the smallest counts; null ids are left out.
    """
    at = merged.where("candidate_id <> primary_id").groupBy("candidate_id").agg(F.min("primary_id").alias("primary_id"))
    at = materialize(at, "merges")
    rounds = at.count().bit_length() + 1
    for k in range(rounds + 1):
        step = at.select(F.col("candidate_id").alias("primary_id"), F.col("primary_id").alias("next"))
        moved = at.select("candidate_id", "primary_id").join(step, "primary_id", "left")
        new = materialize(moved.select("candidate_id", F.coalesce("next", "primary_id").alias("primary_id"), F.col("next").isNotNull().alias("moves")), "merges")
        forget(at)
        at = new
        if at.where("moves").isEmpty():
            break
    return at.select("candidate_id", F.when(~F.col("moves"), F.col("primary_id")).alias("survivor_id"), F.col("moves").alias("in_cycle"))


#: Stages in which a candidate can end, the first that rejects it decides.
STAGES = ("executor", "critic", "verifier", "reconciler")


def fates(candidates: DataFrame, merged: DataFrame, rejections: DataFrame, members: DataFrame) -> DataFrame:
    """What became of each candidate: data_point, <stage>_rejected, dedup_then_<fate of the survivor>,
    merge_cycle or no_outcome. ``merged`` has candidate_id and primary_id, ``rejections`` candidate_id and
    stage, ``members`` the candidates in facts. Merges may form chains of any length; the survivor is
    the candidate in which the chain rests (:func:`merge_ends`)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    first = rejections.withColumn("rank", rank).where("rank > 0").groupBy("candidate_id").agg(F.min_by("stage", "rank").alias("stage"))
    kept = members.select("candidate_id").distinct().withColumn("kept", F.lit(True))
    own = candidates.select("candidate_id").distinct().join(first, "candidate_id", "left").join(kept, "candidate_id", "left").join(merge_ends(merged), "candidate_id", "left")
    fate = F.when(F.col("kept"), "data_point").when(F.col("stage").isNotNull(), F.concat("stage", F.lit("_rejected"))).when(F.col("in_cycle"), "merge_cycle")
    own = own.withColumn("own", F.coalesce(fate, F.when(F.col("survivor_id").isNull(), "no_outcome")))
    end = own.select(F.col("candidate_id").alias("survivor_id"), F.coalesce("own", F.lit("no_outcome")).alias("end"))
    return own.join(end, "survivor_id", "left").select("candidate_id", F.coalesce("own", F.concat(F.lit("dedup_then_"), F.coalesce("end", F.lit("unknown")))).alias("fate"))


def fact_confidence(facts: DataFrame, reported: DataFrame) -> DataFrame:
    """Confidence of a deduplicated fact: the least of its members' and of its report's score."""
    least = X.dedup(facts).groupBy("primary_id").agg(F.min("confidence").alias("least"), F.count("*").alias("members"))
    of = reported.select(F.col("candidate_id").alias("primary_id"), "score")
    return least.join(of, "primary_id").select(F.col("primary_id").alias("candidate_id"), "members", F.least("least", "score").alias("confidence"))


#: Which status may follow which.
STEPS = {None: ("created",), "created": ("running", "failed"), "running": ("completed", "failed", "refused"), "failed": ("running",), "completed": (), "refused": ()}


def run_status(events: DataFrame) -> DataFrame:
    """Current status of each run, its latest event by (time, id), the number of events, and how many
    were steps that a run may not take. ``events`` has run_id, ts, event_id, status."""
    w = W.partitionBy("run_id").orderBy("ts", "event_id")
    before = F.lag("status").over(w)
    legal = F.lit(False)
    for a, follow in STEPS.items():
        here = before.isNull() if a is None else before == a
        for b in follow:
            legal = legal | (here & (F.col("status") == b))
    e = events.withColumn("illegal", (~F.coalesce(legal, F.lit(False))).cast("long"))
    last = e.groupBy("run_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("x"), F.count("*").alias("n_events"), F.sum("illegal").alias("illegal"))
    return last.select("run_id", F.col("x.status").alias("status"), F.col("x.event_id").alias("last_event"), "n_events", "illegal")


def contiguity(spans: DataFrame) -> DataFrame:
    """Whether a document's spans (start_char, end_char) follow one another without gap from 0, and
    the characters they cover."""
    w = W.partitionBy("doc_id").orderBy("start_char", "end_char")
    due = F.coalesce(F.lag("end_char").over(w), F.lit(0))
    marked = spans.select("doc_id", (F.col("end_char") - F.col("start_char")).alias("chars"), (F.col("start_char") == due).alias("fits"))
    return marked.groupBy("doc_id").agg(F.bool_and("fits").alias("contiguous"), F.sum("chars").alias("covered"))
