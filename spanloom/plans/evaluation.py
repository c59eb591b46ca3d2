"""Label cases, reports and suite manifests from JSON, and scores of single files."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import review as R

LABELS = "expected_id string, doc_id string, category string, field string, value string, source_text string, start_char long, end_char long, start_byte long, end_byte long"
FACTS = "candidate_id string, doc_id string, category string, field string, value string, source_text string, start_char long, end_char long, start_byte long, end_byte long, confidence double"
MODES = ("paraphrase", "reordering", "distractor_insertion", "label_replacement", "formatting_change")


class CaseError(ValueError):
    """A case, report or manifest that does not hold together."""


def _json(path: Path) -> dict:
    return json.loads(path.read_text(encoding="utf-8"))


def load_case(path: str) -> dict:
    """A label case with its source text and hash; every label's two slices must be its text."""
    where = Path(path)
    case = _json(where)
    raw = (where.parent / case["source_path"]).read_bytes()
    text, labels = raw.decode("utf-8"), case["expected_data_points"]
    if len({x["expected_id"] for x in labels}) < len(labels):
        raise CaseError(f"{path}: an expected_id is repeated")
    for x in labels:
        if text[x["start_char"] : x["end_char"]] != x["source_text"] or raw[x["start_byte"] : x["end_byte"]] != x["source_text"].encode():
            raise CaseError(f"{path}: {x['expected_id']} does not quote its source")
    return {**case, "source_text": text, "source_sha256": hashlib.sha256(raw).hexdigest()}


def load_report(path: str) -> dict:
    report = _json(Path(path))
    ids = [f["data_point_id"] for f in report["data_points"]]
    if ids != report.get("output_data_point_ids", ids) or len(set(ids)) < len(ids):
        raise CaseError(f"{path}: fact ids are repeated or not those announced")
    return report


def frames(spark: SparkSession, case: dict, report: dict, fixture: str) -> tuple[DataFrame, DataFrame]:
    """Labels and facts of one fixture as the tables that the scorer takes."""
    label = [(f"{fixture}:{x['expected_id']}", fixture, x["category"], x["field_name"], x["value"], x["source_text"], x["start_char"], x["end_char"], x["start_byte"], x["end_byte"]) for x in case["expected_data_points"]]
    span = lambda f: (f["source_span"]["text"], f["source_span"]["start_char"], f["source_span"]["end_char"], f["source_span"]["start_byte"], f["source_span"]["end_byte"])
    fact = [(f"{fixture}:{f['data_point_id']}", fixture, f["category"], f["field_name"], f["value"], *span(f), float(f["confidence"])) for f in report["data_points"]]
    return spark.createDataFrame(label, LABELS), spark.createDataFrame(fact, FACTS)


def evaluate(spark: SparkSession, case: dict, report: dict, fixture: str = "case") -> dict:
    """Metrics of one report, its violations, and whether the case's thresholds hold."""
    labels, facts = frames(spark, case, report, fixture)
    docs = spark.createDataFrame([(fixture, case["source_text"])], "doc_id string, text string")
    faults = R.violations(facts.withColumn("value", facts["source_text"]), docs)
    m = R.metrics(R.counts(labels, facts, R.match(labels, facts), faults)).where("scope = 'suite'").first()
    got = {k: m[k] for k in (*R.COUNTS, *R.RATIOS)} if m else {**dict.fromkeys(R.COUNTS, 0), "precision": 0.0, "recall": 1.0, "f1": 0.0, "provenance_recall": 1.0}
    t = case.get("thresholds", {})
    passed = all(got[k] >= t.get(f"min_{k}", 0.0) for k in R.RATIOS) and got["violations"] <= t.get("max_invariant_violations", 0)
    return {**got, "passed": passed}


def inside(root: str, path: str) -> Path:
    """A manifest's path: relative, below the root, and there."""
    base = Path(root).resolve()
    found = (base / path).resolve()
    if Path(path).is_absolute() or not found.is_relative_to(base) or not found.is_file():
        raise CaseError(f"not a file below {root}: {path}")
    return found


def load_manifest(path: str, root: str, kind: str) -> dict:
    """A suite manifest (``suite``, ``adversarial`` or ``mutation``), all of whose files load."""
    m = _json(Path(path))
    rows, keys = {
        "suite": (m.get("fixtures"), ("case_path", "report_path")), "adversarial": (m.get("pairs"), ("base_case_path", "base_report_path", "variant_case_path", "variant_report_path")),
        "mutation": (m.get("mutations"), ("base_case_path", "base_report_path", "mutated_case_path", "mutated_report_path")),
    }[kind]
    if not rows:
        raise CaseError(f"{path}: nothing to evaluate")
    for r in rows:
        if kind == "adversarial" and r["mode"] not in MODES:
            raise CaseError(f"{path}: unknown mode {r['mode']}")
        for k in keys:
            (load_case if "case" in k else load_report)(str(inside(root, r[k])))
    return m


def evaluate_suite(spark: SparkSession, path: str, root: str) -> dict:
    """Micro-averages over a suite's fixtures by scope, and the thresholds that fail."""
    m = load_manifest(path, root, "suite")
    pairs = [frames(spark, load_case(str(inside(root, f["case_path"]))), load_report(str(inside(root, f["report_path"]))), f["fixture_id"]) for f in m["fixtures"]]
    labels, facts = pairs[0]
    for a, b in pairs[1:]:
        labels, facts = labels.unionByName(a), facts.unionByName(b)
    scored = R.metrics(R.counts(labels, facts, R.match(labels, facts)), "fixture")
    t, rows = m.get("thresholds", {}), []
    for scope, group in (("suite", [t.get("global", {})]), ("category", t.get("categories", [])), ("field", t.get("fields", []))):
        for g in group:
            rows += [(scope, g.get("category"), g.get("field_name"), k, "min", float(g[f"min_{k}"])) for k in R.RATIOS if f"min_{k}" in g]
            rows += [(scope, g.get("category"), g.get("field_name"), "violations", "max", float(g["max_invariant_violations"]))] if "max_invariant_violations" in g else []
    shape = "scope string, category string, field string, metric string, comparator string, threshold double"
    failures = [r.asDict() for r in R.threshold_failures(scored.where("scope <> 'fixture'").drop("fixture"), spark.createDataFrame(rows, shape)).collect()]
    return {"suite_id": m.get("suite_id"), "metrics": [r.asDict() for r in scored.orderBy("scope", "fixture", "category", "field").collect()], "failures": failures, "passed": not failures}


def evaluate_adversarial(spark: SparkSession, path: str, root: str) -> dict:
    m = load_manifest(path, root, "adversarial")
    got = [(p["pair_id"], evaluate(spark, load_case(str(inside(root, p["variant_case_path"]))), load_report(str(inside(root, p["variant_report_path"]))))["passed"]) for p in m["pairs"]]
    return R.adversarial_suite(spark.createDataFrame(got, "pair_id string, passed boolean")).first().asDict()


def evaluate_mutations(spark: SparkSession, path: str, root: str) -> dict:
    """Source sensitivity of a mutation suite; declared changes that the cases contradict are an error."""
    m = load_manifest(path, root, "mutation")
    changes, values, sides = [], [], {"base": [], "mutated": []}
    for x in m["mutations"]:
        changes += [(x["mutation_id"], c["expected_id"], c.get("retired_source_value"), c.get("introduced_source_value")) for c in x["changes"]]
        for f in load_report(str(inside(root, x["mutated_report_path"])))["data_points"]:
            values += [(x["mutation_id"], f["value"]), (x["mutation_id"], f["source_span"]["text"])]
        for side, rows in sides.items():
            rows += [(x["mutation_id"], p["expected_id"], p["value"], p["source_text"], p["start_char"], p["end_char"]) for p in load_case(str(inside(root, x[f"{side}_case_path"])))["expected_data_points"]]
    c = spark.createDataFrame(changes, "mutation_id string, expected_id string, retired string, introduced string")
    label = "mutation_id string, expected_id string, value string, source_text string, start_char long, end_char long"
    errors = R.mutation_errors(c, *[spark.createDataFrame(r, label) for r in sides.values()]).collect()
    if errors:
        raise CaseError(f"{path}: {errors[0].asDict()}")
    failures = R.mutation_failures(c, spark.createDataFrame(values, "mutation_id string, value string"))
    return R.mutation_suite(R.mutation_scores(c, failures)).first().asDict()
