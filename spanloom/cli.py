"""Command line: run, audit, report (diff, sign, verify, provenance), eval.

``run`` takes a file (text, Markdown, HTML, e-mail, DOCX) to a fact report. Exit codes: 0 done or
passed, 1 a check that fails, 2 an evaluation that does not pass.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .operators import facts as X
from .operators import review as R
from .plans import config as conf
from .plans import evaluation, reports
from .plans.audit import AuditTables

SIGNING = {"key_id": "local", "key_env": "SPANLOOM_SIGNING_KEY"}
FACT = "doc_id string, category string, field string, value string, start_char long, end_char long, confidence double, candidate_id string"


def _json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def run(spark, args) -> int:
    from pyspark.sql import functions as F

    from .operators.documents import chunks
    from .session import ship
    from .sources.mail import ingest

    ship(spark)
    raw = Path(args.source).read_bytes()
    doc = ingest(spark.createDataFrame([(args.source, bytearray(raw))], "path string, content binary")).first()
    if doc["error"]:
        print(doc["error"])
        return 1
    doc_id = "doc-" + doc["source_sha256"][:32]
    table = spark.createDataFrame([(doc_id, doc["text"], args.source)], "doc_id string, text string, source string")
    found = X.propose(chunks(table, args.window, args.overlap, keep=("source",)))
    kept = X.dedup(found).where("candidate_id = primary_id")
    rows = [r.asDict() for r in kept.select(F.col("candidate_id").alias("data_point_id"), "doc_id", "category", "field", "value", "start_char", "end_char", "start_byte", "end_byte", "confidence").collect()]  # one document's facts
    report = reports.fact_report({"run_id": args.run_id or f"run-{doc_id[4:16]}", "doc_id": doc_id}, rows, {"schema_id": "rule-lenses", "domain_hints": args.domain_hint})
    print(json.dumps(reports.write_text(args.output, reports.render(report))))
    return 0


def audit(spark, args) -> int:
    print(reports.render(AuditTables(spark, args.root).inspect(args.run_id, args.details)), end="")
    return 0


def _table(spark, report: dict):
    return spark.createDataFrame([(f["doc_id"], f["category"], f["field"], f["value"], f["start_char"], f["end_char"], float(f["confidence"]), f["data_point_id"]) for f in report["data_points"]], FACT)


def report(spark, args) -> int:
    if args.action == "diff":
        base, new = _json(args.base), _json(args.candidate)
        entries = [r.asDict() for r in R.run_diff(_table(spark, base), _table(spark, new)).collect()]
        out = reports.diff_report(args.id, base, new, entries, R.SUMMARY_ORDER)
    elif args.action == "sign":
        made = _json(args.report)
        artifact = {"path": args.report, "sha256": reports.digest(made)}
        out, _ = reports.signed_manifest(made, artifact, {"schema": [reports.digest(made["schema_metadata"])]}, {}, [], None, SIGNING)
    elif args.action == "verify":
        manifest = _json(args.manifest)
        good = reports.manifest_holds(manifest, **SIGNING) and manifest["artifact"]["sha256"] == reports.digest(_json(args.report))
        print("valid" if good else "not valid")
        return 0 if good else 1
    else:
        made, text = _json(args.report), Path(args.source).read_text(encoding="utf-8") if args.source else None
        docs = spark.createDataFrame([(made["doc_id"], text)], "doc_id string, text string")
        facts = _table(spark, made).withColumnRenamed("candidate_id", "data_point_id")
        from pyspark.sql import functions as F

        rows = X.context(facts.select(F.col("data_point_id").alias("candidate_id"), "doc_id", F.lit("").alias("lens"), F.lit(0).alias("ordinal"), "value", "start_char", "end_char"), docs).collect()
        contexts = {r["candidate_id"]: {k: r[k] or "" for k in ("status", "prefix", "highlight", "suffix")} for r in rows}
        view = reports.provenance(made, contexts, {"doc_id": made["doc_id"], "text": text} if text is not None else None)
        print(json.dumps(reports.write_text(args.output, reports.provenance_page(view))))
        return 0
    print(json.dumps(reports.write_text(args.output, reports.render(out))))
    return 0


def evaluate(spark, args) -> int:
    if args.case:
        got = evaluation.evaluate(spark, evaluation.load_case(args.case), evaluation.load_report(args.report))
    else:
        kind = {"suite": evaluation.evaluate_suite, "adversarial": evaluation.evaluate_adversarial, "mutation": evaluation.evaluate_mutations}[args.kind]
        got = kind(spark, args.manifest, args.root)
    print(reports.render(got), end="")
    return 0 if got["passed"] else 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    top = p.add_subparsers(dest="command", required=True)
    r = top.add_parser("run", help="a document to a fact report")
    r.add_argument("source")
    r.add_argument("-o", "--output", required=True)
    r.add_argument("--run-id")
    r.add_argument("--domain-hint", action="append", default=[])
    r.add_argument("--window", type=int, default=1200)
    r.add_argument("--overlap", type=int, default=120)
    a = top.add_parser("audit", help="a run's dashboard")
    a.add_argument("root")
    a.add_argument("--run-id")
    a.add_argument("--details", action="store_true")
    actions = top.add_parser("report").add_subparsers(dest="action", required=True)
    for name, needs in (("diff", ("base", "candidate")), ("sign", ("report",)), ("verify", ("report", "manifest")), ("provenance", ("report",))):
        q = actions.add_parser(name)
        for n in needs:
            q.add_argument(n)
        if name != "verify":
            q.add_argument("-o", "--output", required=True)
        if name == "diff":
            q.add_argument("--id", default="diff")
        if name == "provenance":
            q.add_argument("--source")
    e = top.add_parser("eval")
    e.add_argument("--case")
    e.add_argument("--report")
    e.add_argument("--manifest")
    e.add_argument("--kind", choices=("suite", "adversarial", "mutation"), default="suite")
    e.add_argument("--root", default=".")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "eval" and bool(args.case) == bool(args.manifest):
        parser().error("give a case with its report, or a manifest")
    conf.configure_logging("WARNING")
    if spark is None:
        from .session import local_session

        spark = local_session()
    return {"run": run, "audit": audit, "report": report, "eval": evaluate}[args.command](spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
