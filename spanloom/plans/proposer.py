"""The model boundary: proposers, replayed or remote, with validation, bounded retries and call logs.

No remote model can be reached from here; a remote adapter is any object with ``propose``. Replies
are tables, so a run can be replayed from what was logged.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.facts import LENSES

SECTIONS = ("Role", "Task", "Input", "Output", "Rules")


class Proposer(Protocol):
    """What lenses ask: payloads (dicts) for a lens and a chunk's text, given earlier complaints."""

    def propose(self, lens: str, text: str, complaints: list[str]) -> list[dict]: ...


class RuleProposer:
    """The rule lenses as a proposer."""

    def __init__(self, lenses=LENSES):
        self.lenses = lenses

    def propose(self, lens: str, text: str, complaints: list[str]) -> list[dict]:
        found = [(m, x) for x in self.lenses if x[0] == lens for m in re.finditer(x[3], text)]
        return [{"category": x[1], "field_name": x[2], "value": m[0], "start_char": m.start(), "source_length": len(m[0]), "confidence": 1.0} for m, x in found]


class ReplayProposer:
    """Logged replies by (lens, hash of the text); the n-th request of one gets its n-th reply."""

    def __init__(self, replies: dict[tuple[str, str], list[list[dict]]]):
        self.replies, self.asked = replies, {}

    def propose(self, lens: str, text: str, complaints: list[str]) -> list[dict]:
        key = (lens, hashlib.sha256(text.encode()).hexdigest())
        n = self.asked[key] = self.asked.get(key, -1) + 1
        replies = self.replies.get(key, [])
        return replies[min(n, len(replies) - 1)] if replies else []


def complaints_of(payloads: list[dict], text: str, slots: set[tuple[str, str]]) -> dict[int, str]:
    """What is wrong with each payload of a batch, by its place."""
    out = {}
    for i, p in enumerate(payloads):
        a, n = p.get("start_char", p.get("start_text")), p.get("source_length", p.get("length"))
        if not str(p.get("value") or "").strip():
            out[i] = "the value is empty"
        elif (p.get("category"), p.get("field_name")) not in slots:
            out[i] = f"{p.get('category')}.{p.get('field_name')} is not in the plan"
        elif not isinstance(a, int) or not isinstance(n, int) or not 0 <= a <= a + n <= len(text):
            out[i] = "the span does not lie in the text"
    return out


def ask(proposer: Proposer, lens: str, text: str, slots: set[tuple[str, str]], most_retries: int = 2) -> tuple[list[dict], dict[int, str], int]:
    """(payloads, complaints that remain by place, calls). A retry's items take the places of those
    complained about; further ones are appended."""
    got, calls = list(proposer.propose(lens, text, [])), 1
    wrong = complaints_of(got, text, slots)
    while wrong and calls <= most_retries:
        again = list(proposer.propose(lens, text, [f"item {i}: {m}" for i, m in sorted(wrong.items())]))
        calls += 1
        for i, new in zip(sorted(wrong), again):
            got[i] = new
        got += again[len(wrong) :]
        wrong = complaints_of(got, text, slots)
    return got, wrong, calls


CLAIMS = "chunk_id string, lens string, claim_index bigint, category string, field string, value string, start_char bigint, length bigint, confidence double, complaint string, calls bigint"


def execute(chunks: DataFrame, lenses: tuple[str, ...], proposer: Proposer, slots: set[tuple[str, str]], most_retries: int = 2) -> DataFrame:
    """Claims of every (chunk, lens), chunk by chunk in the workers; complaints stay in their rows."""
    names = [c.split()[0] for c in CLAIMS.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for chunk, text, base in zip(pdf.chunk_id, pdf.text, pdf.start_char):
                for lens in lenses:
                    got, wrong, calls = ask(proposer, lens, text, slots, most_retries)
                    for i, p in enumerate(got):
                        a = p.get("start_char", p.get("start_text"))
                        out.append((chunk, lens, i, p.get("category"), p.get("field_name"), p.get("value"), None if a is None else int(a) + int(base), p.get("source_length", p.get("length")), float(p.get("confidence", 1.0)), wrong.get(i), calls))
            yield pd.DataFrame(out, columns=names).astype({"start_char": "Int64", "length": "Int64"})

    return chunks.select("chunk_id", "text", "start_char").mapInPandas(run, CLAIMS)


# Settings, prompts, views and logs of remote calls


@dataclass(frozen=True)
class Settings:
    provider: str
    model: str
    max_tokens: int = 4096
    temperature: float = 0.0
    extra: dict = field(default_factory=dict)


def settings_for(config: dict, stage: str) -> Settings:
    """Settings of a stage: the provider's, then those of its stage family, then of the stage itself."""
    names = [stage.split(".")[0], stage] if "." in stage else [stage]
    merged = dict(config["default"])
    for n in names:
        merged |= config.get("stages", {}).get(n, {})
    known = {k: merged.pop(k) for k in ("provider", "model", "max_tokens", "temperature") if k in merged}
    return Settings(**known, extra=merged)


def load_prompt(path: str) -> dict:
    """A Markdown prompt by its sections, all of which must be there and hold text, and its hash."""
    text = Path(path).read_text(encoding="utf-8")
    parts = re.split(r"^## +(.+?) *$", text, flags=re.MULTILINE)
    found = {k.strip(): v.strip() for k, v in zip(parts[1::2], parts[2::2])}
    lacking = [s for s in SECTIONS if not found.get(s)]
    if lacking:
        raise ValueError(f"{path}: sections without text: {lacking}")
    return {"text": text, "sections": found, "prompt_sha256": hashlib.sha256(text.encode()).hexdigest()}


def schema_card(categories: list[dict]) -> list[dict]:
    """The slim view of a schema that a model sees."""
    return [{"name": c["name"], "fields": [{k: f.get(k) for k in ("name", "description", "value_type")} for f in c["fields"]]} for c in categories]


def candidate_view(candidates: DataFrame) -> DataFrame:
    """The slim view of candidates: short id, slot, value, span."""
    from ..operators.reconcile import short_id

    return candidates.select(short_id(F.col("candidate_id")).alias("id"), "category", "field", "value", "source_text", "start_char")


def split_before(payload: dict, name: str) -> tuple[str, str]:
    """JSON cut before a top-level field's value, so that the part before can be cached; joined they are the JSON."""
    text = json.dumps(payload, separators=(",", ":"), ensure_ascii=False)
    at = text.find(f'"{name}":')
    if at < 0 or name not in payload:
        raise ValueError(f"no field {name}")
    head = json.dumps({k: v for k, v in list(payload.items())[: list(payload).index(name)]}, separators=(",", ":"), ensure_ascii=False)[:-1]
    at = len(head) + (1 if len(head) > 1 else 0) + len(f'"{name}":')
    return text[:at], text[at:]


def tool_call(reply: dict, tool: str) -> dict:
    """The one call of a tool in a reply, whichever of the two wire shapes it has; none or several are errors."""
    calls = [b for b in reply.get("content", []) if isinstance(b, dict) and b.get("type") == "tool_use" and b.get("name") == tool]
    found = [(b.get("id"), b["input"]) for b in calls]
    for choice in reply.get("choices", []):
        for c in choice.get("message", {}).get("tool_calls") or []:
            if c["function"]["name"] == tool:
                found.append((c.get("id"), json.loads(c["function"]["arguments"])))
    if len(found) != 1:
        raise ValueError(f"{len(found)} calls of {tool}")
    return {"tool_use_id": found[0][0], "input": found[0][1]}


def call_log(run_id: str, stage: str, attempt: int, reply: dict, model: str, latency_ms: int, prompt_sha256: str) -> dict:
    """A row of call_logs: usage under one set of names, whichever shape the reply has."""
    u = reply.get("usage", {})
    cached = u.get("cache_read_input_tokens", (u.get("prompt_tokens_details") or {}).get("cached_tokens", 0)) or 0
    return {
        "call_id": hashlib.sha256(f"{run_id}|{stage}|{attempt}|{reply.get('id')}".encode()).hexdigest()[:32], "run_id": run_id, "stage": stage, "model": model, "attempt": attempt, "latency_ms": latency_ms, "prompt_sha256": prompt_sha256,
        "input_tokens": u.get("input_tokens", u.get("prompt_tokens", 0)) or 0, "output_tokens": u.get("output_tokens", u.get("completion_tokens", 0)) or 0, "cache_read_tokens": cached, "cache_creation_tokens": u.get("cache_creation_input_tokens", 0) or 0,
    }
