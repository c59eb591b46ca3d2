"""Planning: schema registry and domain packs from YAML, schema hashes, the plan and its refusal."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path


class PlanError(ValueError):
    """A registry, pack or plan that does not hold together."""


def _yaml(path: Path) -> dict:
    import yaml  # optional: only registries and packs need it

    got = yaml.safe_load(path.read_text(encoding="utf-8"))
    if not isinstance(got, dict):
        raise PlanError(f"{path}: not a mapping")
    return got


def schema_hash(categories: list[dict], source_kind: str, version: str, hints=(), pack_id: str | None = None, document_class: str | None = None) -> str:
    """Hash of a schema, whatever the order of its categories, fields and hints."""
    if not categories:
        raise PlanError("a schema needs a category")
    fields = lambda c: [{k: f.get(k) for k in ("description", "name", "required", "value_type")} for f in sorted(c["fields"], key=lambda f: f["name"])]
    body = {
        "approved_categories": [{"description": c["description"], "fields": fields(c), "name": c["name"]} for c in sorted(categories, key=lambda c: c["name"])],
        "document_class": document_class, "domain_hints": sorted(hints), "domain_pack_id": pack_id, "schema_version": version, "source_kind": source_kind,
    }
    return hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def load_schemas(folder: str) -> list[dict]:
    """Approved schemas of a folder, by id; repeated ids and hashes that are not the schema's are errors."""
    out: dict[str, dict] = {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        s = _yaml(path)
        if s["schema_id"] in out:
            raise PlanError(f"{path}: schema {s['schema_id']} is there already")
        own = schema_hash(s["approved_categories"], s.get("source_kind", "approved_registry"), str(s["schema_version"]), s.get("domain_hints", ()), s.get("domain_pack_id"), s.get("document_class"))
        if s.get("schema_hash") not in (None, own):
            raise PlanError(f"{path}: the schema hash is not the schema's")
        out[s["schema_id"]] = {**s, "schema_hash": own}
    return [out[k] for k in sorted(out)]


def load_packs(folder: str) -> list[dict]:
    """Domain packs of a folder; the templates a pack's metadata names must be those it has."""
    out: dict[str, dict] = {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        p = _yaml(path)
        meta, own = p["metadata"], [t["template_id"] for t in p.get("schema_templates", [])]
        if len(set(own)) < len(own) or set(meta.get("template_ids", own)) != set(own):
            raise PlanError(f"{path}: template ids do not agree")
        if meta["pack_id"] in out:
            raise PlanError(f"{path}: pack {meta['pack_id']} is there already")
        out[meta["pack_id"]] = p
    return [out[k] for k in sorted(out)]


def merge_hints(asked, found) -> tuple[str, ...]:
    """Ordered distinct union."""
    return tuple(dict.fromkeys((*asked, *found)))


@dataclass(frozen=True)
class Rule:
    """A rewrite of descriptions by rule instead of by name: ``when`` is a predicate of (category,
    field or None), ``text`` replaces the description, or is appended where ``append`` is set."""

    when: object
    text: str
    append: bool = False


#: Rules over schema descriptions, and fields that a category gets if it lacks them.
RULES = (Rule(lambda c, f: f is not None and f["name"].endswith("_type"), "Prefer a short label that the source words support; its span stays on those words.", True),)
ADDED: dict[str, tuple[dict, ...]] = {}


def generalize(categories: list[dict], rules=RULES, added=None) -> list[dict]:
    """Descriptions rewritten by the rules, and missing fields added. A text is appended once."""

    def told(text: str, c: dict, f: dict | None) -> str:
        for r in rules:
            if r.when(c, f):
                text = r.text if not r.append else text if r.text in text else f"{text}{'' if text.endswith(('.', '!', '?')) else '.'} {r.text}"
        return text

    out = []
    for c in categories:
        fields = [{**f, "description": told(f["description"], c, f)} for f in c["fields"]]
        fields += [f for f in (ADDED if added is None else added).get(c["name"], ()) if f["name"] not in {x["name"] for x in fields}]
        out.append({**c, "description": told(c["description"], c, None), "fields": fields})
    return out


@dataclass
class Plan:
    run_id: str
    doc_id: str
    categories: list[dict]
    lenses: tuple[str, ...]
    schema: dict
    steps: list[str] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        """(category, field, description, value_type, required), for createDataFrame."""
        return [(c["name"], f["name"], f["description"], f.get("value_type", "text"), bool(f.get("required"))) for c in self.categories for f in c["fields"]]


def create_plan(run_id: str, doc_id: str, ask, schemas: list[dict], hints=(), least_coverage: float = 0.8, fallback: bool = True, budget: int = 100) -> Plan | dict:
    """Five questions to ``ask(step, payload)``; two are left out where an approved schema is reused.

    Returns a plan, or a refusal with its codes. Lenses that do not execute, or more calls than the
    budget, are errors.
    """
    from ..operators.facts import REGISTRY

    steps = ["classify_document"]
    kind = ask("classify_document", {"doc_id": doc_id})
    given = merge_hints(hints, kind.get("domain_hints", ()))
    fits = [s for s in schemas if s.get("document_class") == kind["document_type"] and set(s.get("domain_hints", ())) <= set(given)]
    good = fits if kind["confidence"] >= least_coverage else []
    if len(good) == 1:
        s = good[0]
        categories, schema = s["approved_categories"], {k: s.get(k) for k in ("schema_id", "schema_version", "schema_hash")} | {"source_kind": "approved_registry"}
    elif not fallback:
        code = "document_out_of_scope" if not fits and kind["document_type"] == "unknown_document" else "no_approved_schema_candidates" if not fits else "ambiguous_schema_candidates" if len(good) > 1 else "coverage_below_threshold"
        return {"run_id": run_id, "doc_id": doc_id, "document_class": kind["document_type"], "candidate_schema_ids": [s["schema_id"] for s in fits], "reason_codes": [code]}
    else:
        steps += ["propose_schema", "critique_schema"]
        proposed = ask("propose_schema", {"document_class": kind["document_type"], "hints": given})
        categories = generalize(ask("critique_schema", proposed)["categories"])
        own = schema_hash(categories, "planner_generated", "1", given, None, kind["document_type"])
        schema = {"schema_id": f"schema:{own[:16]}", "schema_version": "1", "schema_hash": own, "source_kind": "planner_generated"}
    steps += ["select_strategy", "allocate_budget"]
    lenses = tuple(ask("select_strategy", {"categories": [c["name"] for c in categories]})["lenses"])
    unknown = set(lenses) - {n for n, _, runs in REGISTRY if runs}
    if unknown:
        raise PlanError(f"lenses that do not execute: {sorted(unknown)}")
    calls = ask("allocate_budget", {"lenses": lenses}).get("calls", 0)
    if calls > budget:
        raise PlanError(f"{calls} calls are over the budget of {budget}")
    return Plan(run_id, doc_id, categories, lenses, schema, steps)
