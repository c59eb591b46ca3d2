"""Reports, signatures, audit store, planner, proposers, evaluation files, configuration, command line."""

import io
import json

import pytest

from spanloom import cli
from spanloom.operators import documents as D
from spanloom.plans import audit, config, evaluation, planner, proposer, reports

FACT = {"doc_id": "d", "category": "c", "field": "f", "value": "v", "start_char": 0, "end_char": 1, "start_byte": 0, "end_byte": 1, "confidence": 0.9}
KEY = {"key_id": "k", "key_env": "K"}


def test_reports_refuse_what_is_wrong(tmp_path):
    run = {"run_id": "r", "doc_id": "d", "generated_at": "t"}
    a, b = {**FACT, "data_point_id": "2"}, {**FACT, "data_point_id": "1"}
    r = reports.fact_report(run, [a, b], {"schema_hash": "h"}, {"1", "2"})
    assert r["output_data_point_ids"] == ["1", "2"]
    for wrong in ([a, a], [{**a, "doc_id": "other"}]):
        with pytest.raises(reports.ReportError):
            reports.fact_report(run, wrong, {})
    with pytest.raises(reports.ReportError):
        reports.fact_report(run, [a], {}, {"9"})
    done = reports.write_text(str(tmp_path / "x" / "r.json"), reports.render(r))
    assert json.loads((tmp_path / "x" / "r.json").read_text()) == r and done["byte_length"] == (tmp_path / "x" / "r.json").stat().st_size and len(list((tmp_path / "x").iterdir())) == 1
    assert reports.refusal_report(run, {"reason_codes": ["x"]})["report_schema_version"] == "refusal.v1"
    cross = reports.cross_document_report({"cross_document_run_id": "x"}, [{"group_id": "g", "category": "c", "field": "f", "key": "k"}], [], [{"input_kind": "k", "input_id": "i", "reason": "r"}])
    assert cross["output_group_ids"] == ["g"]
    with pytest.raises(reports.ReportError):
        reports.refusal_report(run, {})


def test_signatures_and_manifests():
    env = {"K": "secret"}
    e = reports.envelope({"b": 1, "a": "é"}, env=env, **KEY)
    assert all(reports.verify({"a": "é", "b": 1}, e, env=env, **KEY).values())
    assert not reports.verify({"a": "e", "b": 1}, e, env=env, **KEY)["payload"] and not reports.verify({"a": "é", "b": 1}, e, env={"K": "x"}, **KEY)["signature"]
    with pytest.raises(reports.ReportError):
        reports.envelope({}, env={}, **KEY)
    m, event = reports.signed_manifest({"run_id": "r"}, {"sha256": "s"}, {"source": ["b", "a", "b"], "schema": ["h"]}, {"x": 1}, [], None, KEY, env)
    assert m["source_sha256s"] == ["a", "b"] and reports.manifest_holds(m, env=env, **KEY) and event["previous_chain_hash"] == reports.ZEROS
    assert not reports.manifest_holds({**m, "config_sha256": "0"}, env=env, **KEY)
    _, second = reports.signed_manifest({"run_id": "r"}, {"sha256": "s"}, {"source": []}, {}, [], event["chain_hash"], KEY, env)
    assert second["previous_chain_hash"] == event["chain_hash"] != second["chain_hash"]


def test_provenance_views_and_pages():
    r = reports.fact_report({"run_id": "r<", "doc_id": "d", "generated_at": "t"}, [{**FACT, "data_point_id": "1"}], {"schema_hash": "h"})
    view = reports.provenance(r, {}, {"doc_id": "e", "text": "x"}, [{"stage": "critic", "candidate_id": "a", "codes": ["x", "x"]}])
    codes = [w["code"] for w in view["warnings"]]
    assert codes == ["signed_manifest_not_supplied", "audit_document_doc_id_mismatch", "run_diff_not_supplied", "source_context_unavailable:1"] and view["rejections"][0]["count"] == 1
    page = reports.provenance_page(view)
    assert page.count("<section>") == 7 and "r&lt;" in page and "r<" not in page and page == reports.provenance_page(view)


def test_audit_tables(spark, tmp_path):
    store = audit.AuditTables(spark, str(tmp_path / "audit"))
    c = spark.createDataFrame([("r1", "c1", 1.0), ("r1", "c2", 1.0)], "run_id string, candidate_id string, confidence double")
    store.append("candidates", c)
    for wrong in (c, c.limit(1).unionByName(c.limit(1))):
        with pytest.raises(audit.AuditError):
            store.append("candidates", wrong)
    store.append_new("candidates", c)
    with pytest.raises(audit.AuditError):
        store.append_new("candidates", c.withColumn("confidence", c["confidence"] / 2))
    with pytest.raises(audit.AuditError):
        store.append("critic_reports", spark.createDataFrame([("r1", "k", "nope", True)], "run_id string, report_id string, candidate_id string, accepted boolean"))
    store.replace("candidates", c.where("candidate_id = 'c1'").withColumn("confidence", c["confidence"] / 4), "r1")
    assert {r["candidate_id"]: r["confidence"] for r in store.read("candidates", "r1").collect()} == {"c1": 0.25, "c2": 1.0}
    store.append("critic_reports", spark.createDataFrame([("r1", "k1", "c1", True)], "run_id string, report_id string, candidate_id string, accepted boolean"))
    with pytest.raises(audit.AuditError, match="partial"):
        store.stage_result("r1", "critic")
    store.append("rejections", spark.createDataFrame([("r1", "x1", "c2", "critic", ["critic_rejected"])], "run_id string, rejection_id string, candidate_id string, stage string, codes array<string>"))
    assert {r["candidate_id"]: r["accepted"] for r in store.stage_result("r1", "critic").collect()} == {"c1": True, "c2": False} and store.stage_result("r1", "verifier").count() == 0
    for k, s in enumerate(("created", "running", "completed")):
        store.move("r1", s, k)
    with pytest.raises(audit.AuditError):
        store.move("r1", "running", 9)
    store.append("call_logs", spark.createDataFrame([("r1", "l1", "critic", 5, 6, 7, 8)], "run_id string, call_id string, stage string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long"))
    got = store.inspect(details=True)
    assert got["run"] == {"run_id": "r1", "status": "completed"} and got["counts"]["critic_reports"] == {"total": 1, "accepted": 1, "rejected": 0} and got["counts"]["rejections"]["by_reason"] == {"critic:critic_rejected": 1}
    assert got["acceptance_checks"]["verifier_cache_read_tokens_nonzero"]["passed"] is False and got["acceptance_checks"]["critic_batches_le_6"]["passed"] and len(got["details"]["candidates"]) == 2 and store.chain_head() == "0" * 64


def test_resume_needs_the_same_document_and_chunks(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six"), (3, "seven")], "doc_id long, text string")
    chunks = D.chunks(docs, 2, 1)
    assert audit.resume_errors(docs, docs, chunks).count() == 0
    other = docs.replace("five six", "five sex").where("doc_id <> 3")
    bad = chunks.where("not (doc_id = 1 and chunk_index = 1)").withColumn("parent_chunk_id", chunks["chunk_id"])
    got = {(r[0], r[1]) for r in audit.resume_errors(other, docs, bad).collect()}
    assert got == {(2, "document_changed"), (2, "chunk_text_changed"), (1, "indexes_not_contiguous"), (1, "missing_chunk_named"), (2, "missing_chunk_named")} | {(3, "missing_chunk_named")}


CATS = [{"name": "B", "description": "b", "fields": [{"name": "y_type", "description": "Y", "value_type": "text", "required": False}, {"name": "x", "description": "X.", "value_type": "text", "required": True}]}, {"name": "A", "description": "a", "fields": []}]


def test_schemas_packs_and_plans(tmp_path):
    one = planner.schema_hash(CATS, "approved_registry", "1", ("p", "q"))
    swapped = [CATS[1], {**CATS[0], "fields": CATS[0]["fields"][::-1]}]
    assert one == planner.schema_hash(swapped, "approved_registry", "1", ("q", "p")) != planner.schema_hash(CATS, "approved_registry", "2")
    schema = {"schema_id": "s", "schema_version": 1, "document_class": "contract", "domain_hints": ["p"], "approved_categories": CATS}
    (tmp_path / "a.yaml").write_text(json.dumps(schema))
    loaded = planner.load_schemas(str(tmp_path))
    (tmp_path / "b.yaml").write_text(json.dumps(schema))
    with pytest.raises(planner.PlanError):
        planner.load_schemas(str(tmp_path))
    (tmp_path / "b.yaml").write_text(json.dumps({**schema, "schema_id": "t", "schema_hash": "0"}))
    with pytest.raises(planner.PlanError):
        planner.load_schemas(str(tmp_path))
    packs = tmp_path / "packs"
    packs.mkdir()
    (packs / "p.yaml").write_text(json.dumps({"metadata": {"pack_id": "p", "template_ids": ["x"]}, "schema_templates": [{"template_id": "x"}]}))
    assert [p["metadata"]["pack_id"] for p in planner.load_packs(str(packs))] == ["p"]
    (packs / "q.yaml").write_text(json.dumps({"metadata": {"pack_id": "q", "template_ids": ["z"]}, "schema_templates": [{"template_id": "x"}]}))
    with pytest.raises(planner.PlanError):
        planner.load_packs(str(packs))
    g = planner.generalize(planner.generalize(CATS, added={"A": ({"name": "n", "description": "", "value_type": "text"},)}), added={})
    assert g[0]["fields"][0]["description"].count(planner.RULES[0].text) == 1 and g[0]["fields"][1]["description"] == "X." and g[1]["fields"][0]["name"] == "n"
    asked = []

    def ask(step, payload):
        asked.append(step)
        return {"classify_document": {"document_type": "contract", "confidence": 0.9, "domain_hints": ["p"]}, "propose_schema": {}, "critique_schema": {"categories": CATS}, "select_strategy": {"lenses": ["number"]}, "allocate_budget": {"calls": 3}}[step]

    plan = planner.create_plan("r", "d", ask, loaded)
    assert plan.schema["schema_id"] == "s" and asked == ["classify_document", "select_strategy", "allocate_budget"] and len(plan.rows()) == 2
    asked.clear()
    assert planner.create_plan("r", "d", ask, []).schema["source_kind"] == "planner_generated" and len(asked) == 5
    assert planner.create_plan("r", "d", ask, [], fallback=False)["reason_codes"] == ["no_approved_schema_candidates"]
    assert planner.create_plan("r", "d", ask, loaded * 2, fallback=False)["reason_codes"] == ["ambiguous_schema_candidates"]
    assert planner.create_plan("r", "d", ask, loaded, least_coverage=0.95, fallback=False)["reason_codes"] == ["coverage_below_threshold"]
    with pytest.raises(planner.PlanError):
        planner.create_plan("r", "d", ask, loaded, budget=2)
    assert planner.merge_hints(("b", "a"), ("a", "c")) == ("b", "a", "c")


def test_proposers_retry_and_replay(spark, tmp_path):
    text, slots = "12 and 13", {("Quantity", "number")}
    good = {"category": "Quantity", "field_name": "number", "value": "12", "start_char": 0, "source_length": 2}
    import hashlib

    key = ("number", hashlib.sha256(text.encode()).hexdigest())
    replay = proposer.ReplayProposer({key: [[good, {**good, "category": "X"}, {**good, "start_char": 99}], [good, {**good, "value": " "}], [{**good, "value": "13", "start_char": 7}]]})
    got, wrong, calls = proposer.ask(replay, "number", text, slots)
    assert calls == 3 and not wrong and [p["value"] for p in got] == ["12", "12", "13"]
    docs = spark.createDataFrame([(1, text + " é 14")], "doc_id long, text string")
    from spanloom.session import ship

    ship(spark)
    rows = proposer.execute(D.chunks(docs, 3, 0), ("number",), proposer.RuleProposer(), slots).collect()
    assert sorted((r["value"], r["start_char"], r["complaint"]) for r in rows) == [("12", 0, None), ("13", 7, None), ("14", 12, None)]
    a, b = proposer.split_before({"x": 'a "y": b', "y": [1], "z": 2}, "y")
    assert json.loads(a + b) == {"x": 'a "y": b', "y": [1], "z": 2} and b.startswith("[1]")
    one = {"content": [{"type": "tool_use", "name": "t", "id": "i", "input": {"k": 1}}], "usage": {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 5}}
    two = {"choices": [{"message": {"tool_calls": [{"id": "j", "function": {"name": "t", "arguments": '{"k": 1}'}}]}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4, "prompt_tokens_details": {"cached_tokens": 5}}}
    logs = [proposer.call_log("r", "critic", 1, x, "m", 9, "h") for x in (one, two)]
    assert proposer.tool_call(one, "t")["input"] == proposer.tool_call(two, "t")["input"] and all(x["cache_read_tokens"] == 5 and x["input_tokens"] == 3 for x in logs)
    with pytest.raises(ValueError):
        proposer.tool_call({"content": []}, "t")
    conf = {"default": {"provider": "p", "model": "m"}, "stages": {"executor": {"model": "n"}, "executor.number": {"temperature": 0.5, "top": 1}}}
    s = proposer.settings_for(conf, "executor.number")
    assert (s.model, s.temperature, s.extra) == ("n", 0.5, {"top": 1}) and proposer.settings_for(conf, "critic").model == "m"
    prompt = tmp_path / "p.md"
    prompt.write_text("".join(f"## {x}\ntext\n" for x in proposer.SECTIONS))
    assert set(proposer.load_prompt(str(prompt))["sections"]) == set(proposer.SECTIONS)
    prompt.write_text("## Role\n")
    with pytest.raises(ValueError):
        proposer.load_prompt(str(prompt))


def _case(folder, name, text, value, mutate=None):
    at = text.index(value)
    span = {"start_char": at, "end_char": at + len(value), "start_byte": len(text[:at].encode()), "end_byte": len(text[: at + len(value)].encode())}
    (folder / f"{name}.txt").write_text(text)
    label = {"expected_id": "e1", "category": "C", "field_name": "f", "value": value, "source_text": value, **span}
    (folder / f"{name}.case.json").write_text(json.dumps({"case_id": name, "source_path": f"{name}.txt", "thresholds": {"min_precision": 1.0, "min_recall": 1.0}, "expected_data_points": [label]}))
    said = mutate or value
    point = {"data_point_id": "p1", "category": "C", "field_name": "f", "value": said, "confidence": 0.9, "source_span": {"text": value, **span}}
    (folder / f"{name}.report.json").write_text(json.dumps({"output_data_point_ids": ["p1"], "data_points": [point]}))


def test_cases_suites_and_the_command_line(spark, tmp_path, capsys):
    _case(tmp_path, "a", "é is 12 now", "12")
    _case(tmp_path, "b", "é is 13 now", "13", mutate="wrong")
    case, report = evaluation.load_case(str(tmp_path / "a.case.json")), evaluation.load_report(str(tmp_path / "a.report.json"))
    got = evaluation.evaluate(spark, case, report)
    assert got["passed"] and got["provenance_recall"] == 1.0
    fixtures = [{"fixture_id": n, "case_path": f"{n}.case.json", "report_path": f"{n}.report.json"} for n in "ab"]
    (tmp_path / "suite.json").write_text(json.dumps({"suite_id": "s", "fixtures": fixtures, "thresholds": {"global": {"min_recall": 0.5, "min_precision": 0.9}}}))
    suite = evaluation.evaluate_suite(spark, str(tmp_path / "suite.json"), str(tmp_path))
    assert not suite["passed"] and [f["metric"] for f in suite["failures"]] == ["precision"]
    (tmp_path / "bad.json").write_text(json.dumps({"fixtures": [{**fixtures[0], "case_path": "../x"}]}))
    with pytest.raises(evaluation.CaseError):
        evaluation.load_manifest(str(tmp_path / "bad.json"), str(tmp_path), "suite")
    m = {"mutation_id": "m", "base_case_path": "a.case.json", "base_report_path": "a.report.json", "mutated_case_path": "b.case.json", "mutated_report_path": "b.report.json", "changes": [{"expected_id": "e1", "retired_source_value": "12", "introduced_source_value": "13"}]}
    (tmp_path / "mut.json").write_text(json.dumps({"mutations": [m]}))
    assert evaluation.evaluate_mutations(spark, str(tmp_path / "mut.json"), str(tmp_path))["passed"]
    pair = {"pair_id": "p", "mode": "paraphrase", "base_case_path": "a.case.json", "base_report_path": "a.report.json", "variant_case_path": "b.case.json", "variant_report_path": "b.report.json"}
    (tmp_path / "adv.json").write_text(json.dumps({"pairs": [pair]}))
    assert cli.main(["eval", "--manifest", str(tmp_path / "adv.json"), "--kind", "adversarial", "--root", str(tmp_path)], spark) == 2
    assert cli.main(["eval", "--case", str(tmp_path / "a.case.json"), "--report", str(tmp_path / "a.report.json")], spark) == 0
    wrong = json.loads((tmp_path / "a.case.json").read_text())
    wrong["expected_data_points"][0]["start_byte"] += 1
    (tmp_path / "a.case.json").write_text(json.dumps(wrong))
    with pytest.raises(evaluation.CaseError):
        evaluation.load_case(str(tmp_path / "a.case.json"))


def test_run_sign_verify_diff_and_provenance(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("SPANLOOM_SIGNING_KEY", "s")
    src, one, two = tmp_path / "d.txt", tmp_path / "one.json", tmp_path / "two.json"
    src.write_text("Paid 12 on 2024-05-01 <b>. See Section 4.")
    assert cli.main(["run", str(src), "-o", str(one)], spark) == 0
    made = json.loads(one.read_text())
    assert {"12", "2024-05-01", "Section 4"} <= {f["value"] for f in made["data_points"]}
    made["data_points"][0]["value"] += "!"
    two.write_text(json.dumps(made))
    assert cli.main(["report", "diff", str(one), str(two), "-o", str(tmp_path / "diff.json")], spark) == 0
    counts = json.loads((tmp_path / "diff.json").read_text())["summary_counts"]
    assert sum(counts.values()) >= 1 and set(counts) == {"added", "removed", "changed_value", "changed_provenance", "changed_confidence", "unchanged", "ambiguous_match"}
    assert cli.main(["report", "sign", str(one), "-o", str(tmp_path / "m.json")], spark) == 0
    assert cli.main(["report", "verify", str(one), str(tmp_path / "m.json")], spark) == 0 and cli.main(["report", "verify", str(two), str(tmp_path / "m.json")], spark) == 1
    assert cli.main(["report", "provenance", str(one), "--source", str(src), "-o", str(tmp_path / "p.html")], spark) == 0
    assert "&lt;b&gt;" in (tmp_path / "p.html").read_text()
    bad = tmp_path / "x.zip"
    bad.write_bytes(b"x")
    assert cli.main(["run", str(bad), "-o", str(one)], spark) == 1


def test_configuration_and_logs(tmp_path):
    (tmp_path / "default.yaml").write_text("a: {b: 1, c: [1]}\nflag: false\n")
    (tmp_path / "local.json").write_text('{"a": {"b": 2}}')
    (tmp_path / ".env").write_text("# no\nexport SPANLOOM__A__D='x y'\nOTHER=1\n")
    got = config.load({"z": 0.5}, str(tmp_path), {"SPANLOOM__FLAG": "Yes", "SPANLOOM__Z": "2", "SPANLOOM__A__C": "[3]"}, str(tmp_path / ".env"))
    assert got == {"z": 2.0, "a": {"b": 2, "c": [3], "d": "x y"}, "flag": True}
    assert config.load({}, str(tmp_path), {}, local=False)["a"]["b"] == 1
    out = io.StringIO()
    config.trace(config.configure_logging("info", out), "critic", calls=3)
    assert json.loads(out.getvalue())["calls"] == 3
