"""Reports, signatures, provenance pages and report differences: the small, driver-side part.

A run's report has the facts of one document; reports of many documents are written in bulk by the
executors (:func:`write_facts`). What a report is built from comes as rows of small tables.
"""

from __future__ import annotations

import hashlib
import hmac
import html
import json
import os
import tempfile
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZEROS = "0" * 64
ORDER = ("category", "field", "start_char", "end_char", "data_point_id")


class ReportError(RuntimeError):
    """A report that must not be written, signed or trusted."""


def canonical_json(payload) -> bytes:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str).encode()


def digest(payload) -> str:
    return hashlib.sha256(canonical_json(payload)).hexdigest()


def render(report) -> str:
    """Readable JSON with sorted keys."""
    return json.dumps(report, indent=2, sort_keys=True, default=str) + "\n"


def write_text(path: str, text: str) -> dict:
    """Write through a temporary file beside the target, so that no reader sees half of it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=target.name)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, target)
    raw = text.encode()
    return {"path": str(target), "sha256": hashlib.sha256(raw).hexdigest(), "byte_length": len(raw)}


# Reports


def fact_report(run: dict, facts: list[dict], schema: dict, stored_ids: set[str] | None = None) -> dict:
    """Facts in report order. Repeated ids, and ids that differ from the stored ones, are refused."""
    ordered = sorted(facts, key=lambda f: tuple(f[c] for c in ORDER))
    ids = [f["data_point_id"] for f in ordered]
    if len(set(ids)) < len(ids):
        raise ReportError("a data point id is repeated")
    if stored_ids is not None and set(ids) != stored_ids:
        raise ReportError("the report's facts are not those stored")
    if any(f.get("doc_id", run["doc_id"]) != run["doc_id"] for f in ordered):
        raise ReportError("a fact is of another document")
    return {"report_schema_version": "report.v2", "run_id": run["run_id"], "doc_id": run["doc_id"], "generated_at": run.get("generated_at") or _now(), "schema_metadata": schema, "output_data_point_ids": ids, "data_points": ordered}


def refusal_report(run: dict, refusal: dict) -> dict:
    """What a run that refused its document leaves: the codes and what they rest on."""
    if not refusal.get("reason_codes"):
        raise ReportError("a refusal needs a reason")
    return {"report_schema_version": "refusal.v1", "run_id": run["run_id"], "doc_id": run["doc_id"], "generated_at": run.get("generated_at") or _now(), "refusal": refusal}


def cross_document_report(run: dict, groups: list[dict], conflicts: list[dict], skipped: list[dict]) -> dict:
    """Groups, conflicts and skipped inputs of a run over documents, each in its order."""
    for rows, key in ((groups, "group_id"), (conflicts, "conflict_id")):
        if len({r[key] for r in rows}) < len(rows):
            raise ReportError(f"a {key} is repeated")
    return {
        "report_schema_version": "cross_document_report.v1", "cross_document_run_id": run["cross_document_run_id"], "generated_at": run.get("generated_at") or _now(),
        "groups": sorted(groups, key=lambda g: (g["category"], g["field"], g["key"], g["group_id"])), "conflicts": sorted(conflicts, key=lambda c: (c["category"], c["field"], c["conflict_id"])),
        "skipped_inputs": sorted(skipped, key=lambda s: (s["input_kind"], s["input_id"], s["reason"])),
        "output_group_ids": sorted(g["group_id"] for g in groups), "output_conflict_ids": sorted(c["conflict_id"] for c in conflicts),
    }


def diff_report(diff_run_id: str, base: dict, candidate: dict, entries: list[dict], kinds: tuple[str, ...]) -> dict:
    """Entries in list order with the count of every kind and references to both reports."""
    ref = lambda r: {"run_id": r["run_id"], "doc_id": r["doc_id"], "report_schema_version": r["report_schema_version"], "artifact_sha256": digest(r), "byte_length": len(canonical_json(r))}
    return {
        "report_schema_version": "run_diff_report.v1", "diff_run_id": diff_run_id, "generated_at": _now(), "base_artifact": ref(base), "candidate_artifact": ref(candidate),
        "entries": sorted(entries, key=lambda e: (e["ord"], e["entry_id"])), "summary_counts": {k: sum(e["kind"] == k for e in entries) for k in kinds},
    }


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts of any number of documents in report order as JSON lines; sorted and written by the executors."""
    id_ = "data_point_id" if "data_point_id" in facts.columns else "candidate_id"
    ordered = facts.orderBy("doc_id", "category", "field", "start_char", "end_char", id_)
    ordered.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


# Signatures


def sign(payload, key: bytes) -> str:
    return hmac.new(key, canonical_json(payload), hashlib.sha256).hexdigest()


def envelope(payload, key_id: str, key_env: str, env: dict | None = None) -> dict:
    """Signature of a payload with the key that the environment holds; no key is an error."""
    secret = (os.environ if env is None else env).get(key_env, "")
    if not secret:
        raise ReportError(f"no signing key in {key_env}")
    return {"algorithm": "hmac-sha256", "key_id": key_id, "payload_sha256": digest(payload), "signature": sign(payload, secret.encode())}


def verify(payload, signed: dict, key_id: str, key_env: str, env: dict | None = None) -> dict[str, bool]:
    """Four checks, all of which must hold: algorithm, key, digest, signature."""
    secret = (os.environ if env is None else env).get(key_env, "").encode()
    return {
        "algorithm": signed.get("algorithm") == "hmac-sha256", "key_id": signed.get("key_id") == key_id,
        "payload": hmac.compare_digest(str(signed.get("payload_sha256")), digest(payload)),
        "signature": bool(secret) and hmac.compare_digest(str(signed.get("signature")), sign(payload, secret)),
    }


def signed_manifest(report: dict, artifact: dict, hashes: dict[str, list[str]], config: dict, buckets: list[dict], chain_head: str | None, signing: dict, env: dict | None = None) -> tuple[dict, dict]:
    """The manifest of a written report and the event that extends the audit chain by it.

    ``hashes`` has the lists source, text, schema and prompt; each is made distinct and sorted.
    """
    h = {f"{k}_sha256s" if k in ("source", "text", "prompt") else "schema_hashes": sorted(set(v)) for k, v in hashes.items()}
    head = chain_head or ZEROS
    body = {"manifest_schema_version": "signed_report_manifest.v1", "artifact": artifact, **h, "config_sha256": digest(config), "confidence_buckets": buckets, "audit_chain_head_sha256": head}
    body["audit_digest_sha256"] = digest({"artifact": artifact, **h, "config_sha256": body["config_sha256"]})
    manifest = {**body, "signature": envelope(body, signing["key_id"], signing["key_env"], env)}
    payload = digest(manifest)
    chain = digest({"previous_chain_hash": head, "payload_sha256": payload})
    event = {
        "event_id": f"aie-{chain[:24]}", "event_kind": "report_manifest_signed", "run_id": report.get("run_id"), "artifact_sha256": artifact["sha256"], "payload_sha256": payload,
        "previous_chain_hash": head, "chain_hash": chain, "created_at": _now(), "payload_json": canonical_json(manifest).decode(),
    }
    return manifest, event


def manifest_holds(manifest: dict, key_id: str, key_env: str, env: dict | None = None) -> bool:
    body = {k: v for k, v in manifest.items() if k != "signature"}
    return all(verify(body, manifest.get("signature", {}), key_id, key_env, env).values())


def hashes_of(facts: DataFrame, documents: DataFrame) -> list[str]:
    """Distinct sorted hashes of the documents that facts come from; a fact without document is an error."""
    d = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    j = facts.select("doc_id").distinct().join(d, "doc_id", "left")
    if j.where("h is null").take(1):
        raise ReportError("a fact's document is missing")
    return [r["h"] for r in j.select("h").distinct().orderBy("h").collect()]  # one report's documents


# Provenance


def provenance(report: dict, contexts: dict[str, dict], document: dict | None = None, rejections: list[dict] = (), diff: dict | None = None, manifest: dict | None = None) -> dict:
    """The view of a report's facts with their source context, and a warning for each missing input."""
    warnings = []
    if manifest is None:
        warnings.append(("signed_manifest_not_supplied", "low"))
    if document is None:
        warnings.append(("audit_document_not_supplied", "medium"))
    elif document["doc_id"] != report["doc_id"]:
        warnings.append(("audit_document_doc_id_mismatch", "high"))
    if diff is None:
        warnings.append(("run_diff_not_supplied", "low"))
    bucket = {i: b["bucket"] for b in (manifest or {}).get("confidence_buckets", []) for i in b.get("item_ids", [])}
    views = []
    for f in report["data_points"]:
        c = contexts.get(f["data_point_id"]) or {"status": "unavailable", "prefix": "", "highlight": "", "suffix": ""}
        if c["status"] != "matched":
            warnings.append((f"source_context_{c['status']}:{f['data_point_id']}", "medium"))
        views.append({**f, "source_context": c, "confidence_bucket": bucket.get(f["data_point_id"])})
    counts: dict[tuple[str, str], set[str]] = {}
    for r in rejections:
        for code in r["codes"]:
            counts.setdefault((r["stage"], code), set()).add(r["candidate_id"])
    return {
        "artifact_schema_version": "static_provenance_artifact.v1", "run_id": report["run_id"], "doc_id": report["doc_id"], "schema": report["schema_metadata"],
        "document": None if document is None else {k: v for k, v in document.items() if k != "text"}, "data_points": views,
        "rejections": [{"stage": s, "code": c, "count": len(ids), "candidate_ids": sorted(ids)} for (s, c), ids in sorted(counts.items())],
        "diff": None if diff is None else {"diff_run_id": diff["diff_run_id"], "summary_counts": diff["summary_counts"]},
        "manifest": None if manifest is None else {k: v for k, v in manifest.items() if k != "confidence_buckets"}, "warnings": [{"code": c, "severity": s} for c, s in warnings],
    }


def provenance_page(view: dict) -> str:
    """Deterministic escaped HTML of a provenance view, in seven sections."""
    e = lambda x: html.escape(str("" if x is None else x), quote=True)
    table = lambda rows: "<table>" + "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in rows) + "</table>"
    facts = "".join(
        f"<li id=\"{e(f['data_point_id'])}\"><b>{e(f['category'])}.{e(f['field'])}</b> {e(f['value'])} ({e(f.get('confidence'))}, {e(f['confidence_bucket'])})"
        f"<q>{e(f['source_context']['prefix'])}<mark>{e(f['source_context']['highlight'])}</mark>{e(f['source_context']['suffix'])}</q></li>"
        for f in view["data_points"]
    )
    sections = (
        ("Run", table((k, view[k]) for k in ("run_id", "doc_id", "artifact_schema_version"))), ("Document", table(sorted((view["document"] or {}).items()))),
        ("Schema", table(sorted((view["schema"] or {}).items()))), ("Facts", f"<ol>{facts}</ol>"),
        ("Rejections", table((f"{r['stage']} {r['code']}", r["count"]) for r in view["rejections"])),
        ("Differences", table(sorted(((view["diff"] or {}).get("summary_counts") or {}).items()))), ("Warnings", table((w["code"], w["severity"]) for w in view["warnings"])),
    )
    body = "".join(f"<section><h2>{e(name)}</h2>{text}</section>" for name, text in sections)
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{e(view["run_id"])}</title></head><body>{body}</body></html>\n'
