"""The audit store: append-only Parquet tables by run, with keys, insert modes and inspection.

Writers of one table and run must take turns, as Parquet folders have no transactions: a check for
repeated keys and the append that follows are two steps. Each append is one Spark write, committed
as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review as R
from ..operators.verdicts import STEPS

#: Tables, their keys, and the table and column a foreign key names.
TABLES = {
    "documents": (("doc_id",), ()), "runs": (("run_id", "status"), ()), "chunks": (("chunk_id",), (("doc_id", "documents", "doc_id"),)),
    "plans": (("run_id", "category", "field"), ()), "candidates": (("candidate_id",), (("chunk_id", "chunks", "chunk_id"),)),
    "critic_reports": (("report_id",), (("candidate_id", "candidates", "candidate_id"),)), "verifier_reports": (("report_id",), (("candidate_id", "candidates", "candidate_id"),)),
    "rejections": (("rejection_id",), (("candidate_id", "candidates", "candidate_id"),)), "data_points": (("data_point_id",), ()), "stage_states": (("run_id", "stage"), ()),
    "call_logs": (("call_id",), ()), "cross_runs": (("run_id", "status"), ()), "cross_groups": (("group_id",), ()), "cross_conflicts": (("conflict_id",), ()), "integrity_events": (("event_id",), ()),
}


class AuditError(ValueError):
    """A row that the store must not take."""


class AuditTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        if name not in TABLES:
            raise AuditError(f"unknown table {name}")
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self, name: str, run_id: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self._path(name))
        return df.where(F.col("run_id") == run_id) if run_id else df

    def _faults(self, name: str, rows: DataFrame, same_ok: bool) -> DataFrame:
        """Keys repeated in ``rows`` or stored already (with another payload, if equal ones may come)."""
        keys, foreign = TABLES[name]
        cols = sorted(c for c in rows.columns)
        mark = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("_mark")
        new = rows.select(*keys, mark)
        bad = new.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("_mark").alias("m"))
        out = bad.where("m > 1" if same_ok else "n > 1").select(F.lit("repeated key").alias("fault"))
        if self.has(name):
            old = self.read(name).select(*keys, mark).withColumnRenamed("_mark", "_old")
            met = new.join(old, list(keys))
            out = out.unionByName((met.where("_mark <> _old") if same_ok else met).select(F.lit("stored key").alias("fault")))
        for col, table, other in foreign:
            if col in rows.columns and self.has(table):
                known = self.read(table).select(F.col(other).alias(col)).distinct()
                out = out.unionByName(rows.where(F.col(col).isNotNull()).join(known, col, "left_anti").select(F.lit(f"unknown {col}").alias("fault")))
        return out

    def append(self, name: str, rows: DataFrame) -> None:
        """Insert: a key that is repeated or stored, or a foreign key that names nothing, is an error."""
        fault = self._faults(name, rows, False).take(1)
        if fault:
            raise AuditError(f"{name}: {fault[0]['fault']}")
        rows.write.mode("append").partitionBy("run_id").parquet(self._path(name))

    def append_new(self, name: str, rows: DataFrame) -> None:
        """Insert if identical: a stored key with the same payload is left alone, another is an error."""
        fault = self._faults(name, rows, True).take(1)
        if fault:
            raise AuditError(f"{name}: {fault[0]['fault']}")
        keys = list(TABLES[name][0])
        new = rows.dropDuplicates(keys)
        new = new.join(self.read(name).select(*keys), keys, "left_anti") if self.has(name) else new
        new.write.mode("append").partitionBy("run_id").parquet(self._path(name))

    def replace(self, name: str, rows: DataFrame, run_id: str) -> None:
        """Update: rewrite a run's partition; keys that are not stored are an error."""
        keys = list(TABLES[name][0])
        if not self.has(name) or rows.join(self.read(name, run_id).select(*keys), keys, "left_anti").take(1):
            raise AuditError(f"{name}: a row to update is not stored")
        kept = self.read(name, run_id).join(rows.select(*keys), keys, "left_anti").unionByName(rows)
        from ..tables import materialize

        done = materialize(kept.drop("run_id"), "audit-update")
        done.write.mode("overwrite").parquet(f"{self._path(name)}/run_id={run_id}")

    # Runs and stages

    def move(self, run_id: str, status: str, ts: int) -> None:
        """A run's next status; a step that no run may take is an error."""
        now = self.status(run_id) if self.has("runs") else None
        if status not in STEPS.get(now, ()):
            raise AuditError(f"a run may not go from {now} to {status}")
        self.spark.createDataFrame([(run_id, status, ts)], "run_id string, status string, ts long").write.mode("append").partitionBy("run_id").parquet(self._path("runs"))

    def status(self, run_id: str) -> str | None:
        got = self.read("runs", run_id).agg(F.max_by("status", F.struct("ts", "status")).alias("s")).first()
        return got["s"]

    def latest_run(self) -> str | None:
        """The run that started last; of equal ones the first by id."""
        got = self.read("runs").where("status = 'created'").orderBy(F.desc("ts"), "run_id").limit(1).collect()
        return got[0]["run_id"] if got else None

    def chain_head(self) -> str:
        if not self.has("integrity_events"):
            return "0" * 64
        got = self.read("integrity_events").agg(F.max_by("chain_hash", F.struct("created_at", "event_id")).alias("h")).first()
        return got["h"] or "0" * 64

    # Inspection

    def inspect(self, run_id: str | None = None, details: bool = False) -> dict:
        """A run's dashboard: counts by stage, reason and acceptance, usage and its checks."""
        run = run_id or self.latest_run()
        if run is None:
            raise AuditError("no run is stored")
        if not self.read("runs", run).take(1):
            raise AuditError(f"unknown run {run}")
        table = lambda n: self.read(n, run) if self.has(n) else None
        size = lambda n: 0 if (t := table(n)) is None else t.count()
        out = {"run": {"run_id": run, "status": self.status(run)}, "counts": {n: size(n) for n in ("chunks", "call_logs", "candidates", "data_points")}}
        for n in ("critic_reports", "verifier_reports"):
            t = table(n)
            got = t.agg(F.count("*").alias("total"), F.count_if("accepted").alias("accepted")).first() if t is not None else {"total": 0, "accepted": 0}
            out["counts"][n] = {"total": got["total"], "accepted": got["accepted"], "rejected": got["total"] - got["accepted"]}
        rejections = table("rejections")
        if rejections is not None:
            per = R.drop_summary(rejections).collect()  # stages times codes
            out["counts"]["rejections"] = {
                "total": next(r["n"] for r in per if r["stage"] is None), "by_stage": {r["stage"]: r["n"] for r in per if r["stage"] and not r["code"]},
                "by_reason": {f"{r['stage']}:{r['code']}": r["n"] for r in per if r["code"]},
            }
            merged = rejections.where("stage = 'dedup'").count()
            reviewed = out["counts"]["candidates"] - rejections.where("stage = 'executor'").select("candidate_id").distinct().count()
            out["counts"]["dedup"] = {"duplicates": merged, "canonical_of_all": out["counts"]["candidates"] - merged, "canonical_of_accepted": reviewed - merged}
        logs = table("call_logs")
        if logs is not None:
            usage = R.usage_by_stage(logs)
            out["usage"] = {r["stage"]: {c: r[c] for c in ("calls", *R.USAGE)} for r in usage.collect()}
            out["acceptance_checks"] = {r["check"]: {"passed": r["passed"], "actual": r["actual"], "limit": r["limit"]} for r in R.acceptance(usage).collect()}
        if details:
            out["details"] = {n: [r.asDict(True) for r in t.orderBy(*TABLES[n][0]).collect()] for n in ("candidates", "critic_reports", "verifier_reports", "rejections", "data_points") if (t := table(n)) is not None}
        return out

    # Resume

    def stage_result(self, run_id: str, stage: str) -> DataFrame:
        """A stage's output rebuilt from stored rows: candidate_id, accepted, and the rejection's codes.

        A report or rejection of an unknown candidate, or a stage that accounts for some candidates
        only, is an error; a stage with nothing stored gives no rows.
        """
        ids = self.read("candidates", run_id).select("candidate_id")
        reports = self.read(f"{stage}_reports", run_id).select("candidate_id", "accepted") if self.has(f"{stage}_reports") else ids.limit(0).withColumn("accepted", F.lit(False))
        gone = self.read("rejections", run_id).where(F.col("stage") == stage).select("candidate_id", "codes") if self.has("rejections") else ids.limit(0).withColumn("codes", F.array().cast("array<string>"))
        if reports.select("candidate_id").unionByName(gone.select("candidate_id")).join(ids, "candidate_id", "left_anti").take(1):
            raise AuditError(f"{stage}: a stored row names an unknown candidate")
        j = ids.join(reports, "candidate_id", "left").join(gone, "candidate_id", "left")
        n = j.agg(F.count("*").alias("n"), F.count_if(F.col("accepted").isNotNull() | F.col("codes").isNotNull()).alias("done")).first()
        if 0 < n["done"] < n["n"]:
            raise AuditError(f"{stage}: the stored output is partial")
        return j.where("accepted is not null or codes is not null").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def resume_errors(document: DataFrame, stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Why runs of these documents cannot resume: doc_id and error.

    The document must be the stored one; its chunks must be numbered from 0 without gap, still be
    slices of its text, and name only chunks that are there as parents and dependencies.
    """
    now = document.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = stored.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    changed = now.join(old, "doc_id", "left").where(F.col("h").isNull() | (F.col("h") != F.sha2("text", 256))).select("doc_id", F.lit("document_changed").alias("error"))
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_index").alias("d"), F.min("chunk_index").alias("a"), F.max("chunk_index").alias("b"))
    gaps = now.select("doc_id").join(per, "doc_id", "left").where("n is null or d <> n or a <> 0 or b <> n - 1").select("doc_id", F.when(F.col("n").isNull(), "no_chunks").otherwise("indexes_not_contiguous").alias("error"))
    cut = F.substring(F.col("d.text"), (F.col("c.start_char") + 1).cast("int"), (F.col("c.end_char") - F.col("c.start_char")).cast("int"))
    moved = chunks.alias("c").join(now.alias("d"), F.col("c.doc_id") == F.col("d.doc_id")).where(cut != F.col("c.text")).select(F.col("c.doc_id").alias("doc_id"), F.lit("chunk_text_changed").alias("error"))
    out = changed.unionByName(gaps).unionByName(moved)
    named = []
    if "parent_chunk_id" in chunks.columns:
        named.append(chunks.where("parent_chunk_id is not null").select("doc_id", "chunk_id", F.col("parent_chunk_id").alias("other")))
    if "depends_on_chunk_ids" in chunks.columns:
        named.append(chunks.select("doc_id", "chunk_id", F.explode("depends_on_chunk_ids").alias("other")))
    known = chunks.select("doc_id", F.col("chunk_id").alias("other"), F.lit(True).alias("there"))
    for n in named:
        out = out.unionByName(n.join(known, ["doc_id", "other"], "left").where("there is null or other = chunk_id").select("doc_id", F.lit("missing_chunk_named").alias("error")))
    return out.distinct()
