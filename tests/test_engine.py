"""Claims, policies, layout, sources and evaluation operators on small tables, against plain versions."""

import io
import json
import re
import zipfile

import numpy as np
import pytest

from spanloom.functions.text import canonical_key, stems, value_supported
from spanloom.operators import claims as C
from spanloom.operators import documents as D
from spanloom.operators import layout as L
from spanloom.operators import policies as P
from spanloom.operators import reconcile as M
from spanloom.operators import review as R
from spanloom.operators import verdicts as V

CHUNK = "chunk_id string, doc_id long, text string, start_char long, start_byte long"
CLAIM = "claim_id string, chunk_id string, lens string, category string, field string, value string, start_char long, length long, confidence double"


def test_keys_keep_signs_and_units(spark):
    given = {
        "-5": "-5", "+5": "+5", "$5": "$5", "5%": "5%", "5": "5", "(5).": "5", "...": "...", " a―b ": "a-b", "“Groß”": "gross", "ﬁne  X": "fine x", "": "", None: None,
        " x y ": "x y", "ΣΑΣ": "σασ", "'' ''": " ", "‘q’": "q", "½": "1⁄2",
    }
    df = spark.createDataFrame([(k,) for k in given], "v string")
    assert {r["v"]: r["k"] for r in df.select("v", canonical_key(df["v"]).alias("k")).collect()} == given


def test_stems_and_support(spark):
    words = {"approved": "approv", "acquisition": "acquis", "acquires": "acquis", "started": "commenc", "operations": "operat", "agreements": "agree", "seemingly": "seem", "bus": "bus", "buses": "buse", "running": "runn", "uses": "uses", "used": "used"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", stems(df["w"])[0].alias("s")).collect()} == words
    pairs = [("Net  sales", "the net sales rose", True), ("approval", "was approved", True), ("began operation", "commenced operations", True), ("12 days", "12 months", False), ("", "x", True), ("???", "x", False), ("straße", "STRASSE", True)]
    df = spark.createDataFrame([p[:2] for p in pairs], "v string, s string")
    assert [r[0] for r in df.select(value_supported(df["v"], df["s"])).collect()] == [p[2] for p in pairs]


def test_sentences_and_their_guards(spark):
    cases = {
        "Dr. Who met Mr. X. He ran! ok? Yes": ["Dr. Who met Mr. X.", "He ran! ok?", "Yes"], "U.S. Court ruled. A.B. C": ["U.S. Court ruled.", "A.B. C"],
        "# Head\n\nText one. two. Three\n\n- - -\n\nEnd": ["Text one. two.", "Three", "End"], "v1.2 is out. É fin.": ["v1.2 is out.", "É fin."], "": [], " . ! ": [], "a. B": ["a.", "B"],
        "x\u0001y. Z": ["x\u0001y.", "Z"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {i: [] for i in range(len(cases))}
    for r in D.sentences(df).orderBy("doc_id", "sentence_index").collect():
        got[r["doc_id"]].append(list(cases)[r["doc_id"]][r["start_char"] : r["end_char"]])
    assert list(got.values()) == list(cases.values())


def test_claims_are_resolved_repaired_or_rejected(spark):
    text = "# Sales\nSales rose 12 percent. Profit was 12 in Q3 2025. A unique phrase that is longer than the limit; a unique phrase that is longer than the limit"
    base = 100
    at = lambda s, k=0: [m.start() for m in re.finditer(re.escape(s), text)][k] + base
    cases = [
        ("rose", "f", at("rose"), 4, "claimed", at("rose"), ""), ("rose", "f", at("rose") + 2, 4, "repaired", at("rose"), ""), ("ROSE", "f", at("Profit"), 6, "repaired", at("rose"), ""),
        ("rose", "f", 5, 4, "repaired", at("rose"), ""), ("gone", "f", 5, 4, "rejected", base, "invalid_source_offsets"), ("12", "f", 5, 2, "rejected", base, "invalid_source_offsets,ambiguous_source_span"),
        ("12", "f", at("12"), 2, "rejected", at("12"), "ambiguous_source_span"), ("12", "f", at("12"), 10, "claimed", at("12"), ""),
        ("Sales", "metric_name", base, 3, "repaired", at("Sales", 1), ""), ("Sales", "f", at("Profit"), 20, "rejected", at("Profit"), "invalid_source_offsets,ambiguous_source_span"),
        ("gone", "f", at("Profit"), 6, "claimed", at("Profit"), ""), ("a unique phrase that is longer than the limit", "f", at("a unique"), 45, "claimed", at("a unique"), ""),
        ("rose", "f", at("rose"), 0, "repaired", at("rose"), ""), ("appointment", "f", at("Profit"), 12, "claimed", at("Profit"), ""),
    ]
    chunks = spark.createDataFrame([("c", 1, text, base, 200)], CHUNK)
    claims = spark.createDataFrame([(str(i), "c", "number", "K", f, v, a, n, 1.0) for i, (v, f, a, n, *_) in enumerate(cases)], CLAIM)
    got = {int(r["claim_id"]): (r["resolution"], r["resolved_start"], ",".join(r["codes"])) for r in C.resolve(claims, chunks).collect()}
    assert got == {i: c[4:] for i, c in enumerate(cases)}


NORMS = [
    ("event_type", "began", "The plant commenced operation in May", "Facility commencement", "commenced operation"), ("change_type", "x", "She was appointed CFO", "appointment", "appointed"),
    ("prior_period_value", "12", "up from $12 million in Q2 2024 and 12 million in Q3 2023", None, None), ("effective_date", "May 5, 2026", "May 5, 2026", "May 5, 2026 Annual Meeting", "May 5, 2026 Annual Meeting"),
    ("margin", "up to 12.5% margin", "up to 12.5% margin", "up to 12.5%", "up to 12.5%"), ("margin", "12 target", "12 target", None, None), ("condition", "with consent", "with consent", "consent under section 5", "consent under section 5"),
    ("notable_qualifier", "subject to", "sales, Subject To audit", "Subject To", "Subject To"), ("asset_detail", "x", " It operates 14 plants in Ohio. ", "14 plants in Ohio", "14 plants in Ohio"), ("asset_detail", "x", "It operates plants.", None, None),
    ("speaker", "x", "Chief Executive Officer Ada Byron", "Ada Byron", "Ada Byron"), ("speaker", "x", "CEO Ada", None, None), ("other", "CEO Ada Byron", "CEO Ada Byron", None, None),
]


@pytest.mark.parametrize("field,value,source,want,span", NORMS)
def test_normalizers(spark, field, value, source, want, span):
    text = f"é Lead. {source} Annual Meeting under section 5; then more."
    if field == "condition":
        text = f"é Lead. {source} under section 5; then more."
    if field == "prior_period_value":
        want = span = "12 million in Q3 2023"
        source = "and 12 million"  # long enough to stand once: an ambiguous claim is not normalized
    a = text.index(source)
    chunks = spark.createDataFrame([("c", 1, text, 10, 20)], CHUNK)
    row = C.resolve(spark.createDataFrame([("k", "c", "claim", "K", field, value, a + 10, len(source), 1.0)], CLAIM), chunks)
    row = row.withColumn("codes", row["codes"].cast("array<string>"))
    got = C.materialize_candidates(C.normalize(row, chunks)).first()
    if want is None:
        assert got["value"] == value and got["source_text"] == source
        return
    assert (got["value"], got["source_text"]) == (want, span)
    assert text[got["start_char"] - 10 : got["end_char"] - 10] == span and text.encode()[got["start_byte"] - 20 : got["end_byte"] - 20] == span.encode()
    assert got["status"] == ("verbatim_only" if want == span else "canonicalized") and C.normalization_errors(C.materialize_candidates(C.normalize(row, chunks))).first()["error"] is None


def test_events_are_expanded_once(spark):
    text = "Head.\n\nThe mine began commercial operations in 2024. The board approved the acquisition of Acme. Nothing else."
    chunks = spark.createDataFrame([("c", 1, text, 50, 50)], CHUNK)
    plan = spark.createDataFrame([("Event", "event_type"), ("Event", "summary"), ("Thing", "name")], "category string, field string")
    a = text.index("began") + 50
    claims = spark.createDataFrame([("1", "c", "event", "Event", "event_type", "facility  COMMENCEMENT", a, len("began commercial operations"), 0.9), ("2", "c", "number", "Q", "n", "2024", 60, 4, 1.0)], CLAIM)
    got = C.expand(claims, chunks, plan).collect()
    new = sorted((r["field"], r["value"], text[r["start_char"] - 50 : r["start_char"] - 50 + r["length"]]) for r in got if r["confidence"] == C.DERIVED_CONFIDENCE)
    one, two = "The mine began commercial operations in 2024.", "The board approved the acquisition of Acme."
    assert new == sorted([("summary", one, one), ("event_type", "Acquisition approval", "approved the acquisition of"), ("summary", two, two)]) and len(got) == 5


def test_payloads_and_verdicts_are_read_tolerantly(spark):
    p = [json.dumps(x) for x in ({"category": "C", "field_name": "f", "value": "v", "start_char": "12", "source_length": 3}, {"category": "C", "field_name": "f", "value": "v", "start_text": 4, "length": "2", "confidence": 0.5}, {"category": "C", "field_name": "f", "value": " ", "start_char": 1, "source_length": 1}, {"category": "C", "field_name": "f", "value": "v", "start_char": "x", "source_length": 1}, {"value": "v", "start_char": 1, "source_length": 1})] + ["{", "[1]"]
    got = [(r["start_char"], r["length"], r["confidence"], r["error"]) for r in C.decode_payloads(spark.createDataFrame([(x,) for x in p], "payload string")).collect()]
    assert got[:2] == [(12, 3, 1.0, None), (4, 2, 0.5, None)] and [g[3] for g in got[2:]] == ["no_value", "no_span", "no_field", "not_json", "no_value"]
    v = [
        '["a1", "a"]', '["a2", "R", "invented_span", "why"]', json.dumps(json.dumps(["a3", "c", None, None, {"value": "x"}])), '{"id": "a4", "decision": "reject"}', '{"id": "a5", "decision": "accept", "correction": {"value": "y"}}',
        json.dumps(["a6", "r", "critic_rejected", "e" * 201]), "[1]", '["a7", "zz"]', "nope", '["a8", "r", "made_up"]',
    ]
    got = {i: r for i, r in enumerate(P.decode_verdicts(spark.createDataFrame([(x,) for x in v], "payload string"), default_code="critic_rejected").collect())}
    assert [(got[i]["verdict_id"], got[i]["decision"], got[i]["code"]) for i in range(6)] == [("a1", "accept", None), ("a2", "reject", "invented_span"), ("a3", "correct", None), ("a4", "reject", "critic_rejected"), ("a5", "accept", None), ("a6", "reject", "critic_rejected")]
    assert json.loads(got[2]["correction"]) == {"value": "x"} and got[4]["correction"] is None and got[5]["evidence"] is None and got[1]["evidence"] == "why"
    assert [got[i]["error"] for i in range(6, 10)] == ["wrong_length", "unknown_decision", "not_json", "unknown_code"]
    strict = P.decode_verdicts(spark.createDataFrame([('["a", "c"]',)], "payload string"), corrections=False).first()
    assert strict["error"] == "correction_not_allowed"


def _candidates(spark, rows, text="é about 12 days, no more than 30 units. Approved by the board."):
    chunks = spark.createDataFrame([("k", 1, text, 5, 5)], CHUNK)
    plan = spark.createDataFrame([("Q", "amount"), ("Q", "event_type"), ("Q", "note")], "category string, field string")
    data = []
    for i, (category, field, value, span) in enumerate(rows):
        a = text.index(span)
        b = len(text[:a].encode())
        data.append((f"c{i}", 1, "k", category, field, value, span, 5 + a, 5 + a + len(span), 5 + b, 5 + b + len(span.encode())))
    s = "candidate_id string, doc_id long, chunk_id string, category string, field string, value string, source_text string, start_char long, end_char long, start_byte long, end_byte long"
    return P.checked(spark.createDataFrame(data, s), chunks, plan), text


VERDICT = "candidate_id string, pos int, decision string, code string, evidence string, " + P.CORRECTION


def test_corrections_and_critic_reports(spark):
    rows = [("Q", "amount", "about 12 days", "about 12 days")] * 8 + [("Q", "event_type", "approval", "Approved")] + [("Z", "amount", "30", "30")] + [("Q", "amount", "12 days", "about 12 days")] * 2
    c, text = _candidates(spark, rows)
    at = lambda s: 5 + text.index(s)
    fix = lambda i, value=None, field=None, start=None, span=None: (f"c{i}", 0, "correct", None, None, value, None, field, start, span)
    said = [
        fix(0, "about 12", None, at("about"), "about 12"), fix(1, "12 days"), fix(2, field="note"), fix(3, start=at("about"), span="about 12 days, no"), fix(4, span="nothing"), fix(5, "about 12 weeks"), fix(6),
        ("c7", 0, "reject", "critic_rejected", "the field stands alone without its companion record and is vague", *[None] * 5), fix(8, "board approval"), fix(9, "30 units", span="30 units"),
        ("c10", 0, "reject", "invalid_source_offsets", None, *[None] * 5), ("c10", 1, "reject", "critic_rejected", None, *[None] * 5),
    ]
    v = spark.createDataFrame(said, VERDICT)
    got = {r["candidate_id"]: (r["outcome"], ",".join(r["faults"])) for r in P.correct(c.join(P.first_verdicts(v), "candidate_id")).collect()}
    assert got["c0"] == ("corrected", "") and got["c1"] == ("rejected", "qualifier_lost") and got["c2"] == ("preserved", "slot_not_approved")
    assert got["c3"] == ("preserved", "span_expanded") and got["c4"] == ("preserved", "span_text_mismatch") and got["c5"] == ("rejected", "value_not_grounded")
    assert got["c6"] == ("rejected", "no_correction") and got["c8"] == ("corrected", "") and got["c9"] == ("rejected", "slot_not_approved,span_expanded")
    r = {x["candidate_id"]: x for x in P.critic_reports(c, v).collect()}
    assert (r["c0"]["value"], r["c0"]["end_char"], r["c0"]["corrected"]) == ("about 12", at("about") + 8, True) and r["c1"]["reason"] == "invalid_correction"
    assert r["c7"]["accepted"] and r["c10"]["accepted"] and r["c11"]["reason"] == "critic_missing_report" and r["c2"]["accepted"] and not r["c2"]["corrected"]


def test_verifier_drops_what_checks_contradict(spark):
    c, _ = _candidates(spark, [("Q", "amount", "about 12 days", "about 12 days"), ("Q", "amount", "13 days", "about 12 days"), ("Q", "event_type", "merger", "Approved"), ("Q", "other", "30", "30"), ("Z", "amount", "30", "30")])
    v = spark.createDataFrame([(f"c{i}", 0, "reject", code) for i, code in enumerate(("invented_span", "invented_span", "invented_span", "schema_violation", "verifier_rejected"))], "candidate_id string, pos int, decision string, code string")
    got = {r["candidate_id"]: (r["accepted"], r["codes"], r["span_verified"], r["category_verified"]) for r in P.verifier_reports(c, v).collect()}
    assert got == {
        "c0": (True, "", True, True), "c1": (False, "invented_span", False, True), "c2": (False, "invented_span", False, True),
        "c3": (False, "schema_violation", True, False), "c4": (False, "verifier_rejected,category_not_approved", True, False),
    }
    ok = {r["candidate_id"]: r["x"] for r in c.select("candidate_id", P.executor_reasons().alias("x")).collect()}
    assert ok["c0"] == [] and ok["c3"] == ["schema_violation"] and ok["c4"] == ["category_not_approved"]


def test_retries_and_stage_inputs(spark):
    ids = lambda *x: spark.createDataFrame([(i, n) for i, n in x], "candidate_id string, said string")
    got = P.merge_retry(ids(("a", "1"), ("b", "1"), ("c", "1"), ("y", "1")), ids(("b", "2"), ("d", "2"), ("x", "2"), ("a", "2")), ids(("b", ""), ("c", "")), ids(("a", ""), ("b", ""), ("c", ""), ("d", "")))
    assert sorted((r[0], r[1]) for r in got.collect()) == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "2")]
    c = spark.createDataFrame([("a", 1, "k"), ("b", 2, "k"), ("c", 1, "z"), ("d", 1, "k"), ("d", 1, "k")], "candidate_id string, doc_id long, chunk_id string")
    reports = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("c", True), ("d", False)], "candidate_id string, accepted boolean")
    errors = {(r[0], r[1]) for r in P.stage_input_errors(c, spark.createDataFrame([("k", 1)], "chunk_id string, doc_id long"), reports).collect()}
    assert errors == {("b", "foreign_chunk"), ("c", "unknown_chunk"), ("c", "not_one_accepted_report"), ("d", "repeated_id"), ("d", "not_one_accepted_report")}


def test_specificity_ranks(spark):
    rows = [("Q", "event_type", "approval", "was approved by all", "a"), ("Q", "event_type", "approval", "approved", "b"), ("Q", "growth_pct", "about 5%", "about 5%", "c"), ("Q", "growth_pct", "5%", "about 5%", "d"), ("Q", "x", "5", "5 units", "e"), ("Q", "x", "5", "5", "f"), ("Q", "x", "6", "5", "g")]
    df = spark.createDataFrame(rows, "category string, field string, value string, source_text string, candidate_id string")
    order = lambda f: [r[0] for r in df.where(df["field"] == f).orderBy(M.specificity()).select("candidate_id").collect()]
    assert order("event_type") == ["b", "a"] and order("growth_pct") == ["c", "d"] and order("x") == ["f", "e", "g"]


def test_short_ids_come_back(spark):
    c = spark.createDataFrame([(1, "cand-" + "a" * 32), (1, "cand-" + "b" * 32)], "doc_id long, candidate_id string")
    g = spark.createDataFrame([(1, 0, "a" * 12, ["b" * 12, "zz"])], "doc_id long, group_pos long, source_id string, member_ids array<string>")
    got = M.expand_ids(g, c).first()
    assert got["source_id"] == "cand-" + "a" * 32 and got["member_ids"] == ["cand-" + "b" * 32, "zz"]
    assert [r["candidate_id"] for r in M.unknown_ids(M.expand_ids(g, c), c.limit(0), c).collect()] == ["zz"]


def test_conflicts_mark_all_facts_of_a_field(spark):
    p = spark.createDataFrame([(1, "c", "f", "A"), (1, "c", "f", "a."), (1, "c", "g", "A"), (1, "c", "g", "B"), (2, "c", "g", "A")], "doc_id long, category string, field string, value string")
    got = {(r["doc_id"], r["field"], r["value"]): r["conflict_id"] for r in M.mark_conflicts(p).collect()}
    assert got[(1, "g", "A")] == got[(1, "g", "B")] is not None and got[(1, "f", "A")] is got[(2, "g", "A")] is None


# Layout


def _plain_pack(text, layout, tables, window):
    """The packing rules once more, with token counts taken from slices."""
    count = lambda a, b: len(text[a:b].split())
    out, now = [], []
    for a, b, kind, span, table in L.blocks_of(text, layout, tables):
        if kind in ("table", "section") or count(a, b) > window:
            out, now = out + ([(now[0], now[-1])] if now else []), []
        if kind == "table":
            out.append(((a, b), (a, b)))
        elif count(a, b) > window:
            start = done = a
            ends = [a + m.end() for m in re.finditer(r"[.!?](?=\s|\Z)", text[a:b])]
            ends += [b] if not ends or ends[-1] != b else []
            for e in ends:
                if count(done, e) > window or len(ends) == 1:
                    out += [((start, done), (start, done))] if done > start else []
                    while done < e:
                        cut = max((x for x in range(done + 1, e + 1) if count(done, x) <= window), default=done + 1)
                        out.append(((done, cut), (done, cut)))
                        done = cut
                    start = e
                elif count(start, e) > window and done > start:
                    out.append(((start, done), (start, done)))
                    start = done
                done = e
            out += [((start, done), (start, done))] if done > start else []
        else:
            if now and count(now[0][0], b) > window:
                out, now = out + [(now[0], now[-1])], []
            now.append((a, b))
    out += [(now[0], now[-1])] if now else []
    return [(first[0], last[1]) for first, last in out]


@pytest.mark.parametrize("window", [1, 3, 7, 20, 1000])
def test_packing_against_a_plain_version(window):
    rng = np.random.default_rng(window)
    for _ in range(60):
        text, layout, tables = "", [], []
        for k in range(int(rng.integers(1, 9))):
            line = " ".join(rng.choice(["a", "bb.", "c!", "ddd", "é"], int(rng.integers(1, 14))))
            role = rng.choice(["heading", "paragraph", "list_item", "table", "unknown"])
            a = len(text)
            text += line
            span = {"start_char": a, "end_char": len(text)}
            if role == "table":
                tables.append({"table_id": f"t{k}", **span})
            layout.append({"span_id": f"s{k}", "role": role, **span})
            text += rng.choice(["\n", "\n\n", " x "])
        got = L.pack_blocks(text, layout, tables, window)
        assert [(a, b) for a, b, *_ in got] == _plain_pack(text, layout, tables, window)
        assert "".join(text[a:b] for a, b, *_ in got) == text


def test_packed_chunks_carry_sections_pages_and_errors(spark):
    text = "Head one\npara é one two three\n| a | b |\nHead two\n- item"
    docs = L.line_layout(spark.createDataFrame([(1, text)], "doc_id long, text string"), 2)
    got = L.packed_chunks(docs, 50).orderBy("chunk_index").collect()
    assert [(r["kind"], r["section"], r["pages"]) for r in got] == [("section", "Head one", [1]), ("table", "Head one", [1]), ("section", "Head two", [1])]
    assert all(text.encode()[r["start_byte"] : r["end_byte"]].decode() == text[r["start_char"] : r["end_char"]] for r in got) and got[1]["table_ids"] == ["line:2"]
    small = L.packed_chunks(docs, 3, whole_tables=False).collect()
    assert [r["error"] for r in small] == ["a table exceeds the window"]
    assert L.packed_chunks(docs, 3).where("split_reason = 'atomic_table_overflow'").count() == 1


def test_pages_join_and_spans_align(spark):
    pages = spark.createDataFrame([(1, 7, "é one"), (1, 3, ""), (1, 9, "two"), (2, 1, None)], "doc_id long, page_number long, text string")
    got = {r["doc_id"]: r for r in L.join_pages(pages).collect()}
    assert got[1]["text"] == "\n\né one\n\ntwo" and [(p["page_number"], p["start_char"], p["end_byte"]) for p in got[1]["page_map"]] == [(1, 0, 0), (2, 2, 8), (3, 9, 13)]
    assert [s["kind"] for s in got[1]["source_map"]] == ["generated", "unmapped", "generated", "unmapped"] and got[2]["text"] == ""
    d = spark.createDataFrame([("a é b a", ["a", "b", "a"], [["a", "é"], ["b", "a"]]), ("a b", ["b", "a"], [["b", None]])], "t string, w array<string>, c array<array<string>>")
    first, second = d.select(L.aligned_words()("t", "w").alias("w"), L.aligned_cells()("t", "c").alias("c")).collect()
    assert [(s["start_char"], s["start_byte"]) for s in first["w"]] == [(0, 0), (4, 5), (6, 7)] and second["w"] is None and second["c"] is None
    assert [(c["row_index"], c["start_char"], c["header_labels"]) for c in first["c"]] == [(0, 0, []), (0, 2, []), (1, 4, ["a"]), (1, 6, ["é"])]


def test_layout_faults_and_source_backing(spark):
    r = lambda a, b: {"start_char": a, "end_char": b, "start_byte": a, "end_byte": b}
    seg = "array<struct<segment_id: string, kind: string, start_char: bigint, end_char: bigint, start_byte: bigint, end_byte: bigint>>"
    docs = spark.createDataFrame(
        [
            (1, "abcdef", [{"page_number": 1, **r(0, 6)}], [{"span_id": "a", "role": "x", "page_number": 1, **r(0, 2)}], [], [{"segment_id": "s", "kind": "source", **r(0, 6)}]),
            (2, "abc", [{"page_number": 1, **r(0, 3)}, {"page_number": 1, **r(2, 9)}], [{"span_id": "a", "role": "x", "page_number": 4, **r(0, 9)}] * 2, [], [{"segment_id": "s", "kind": "source", **r(0, 1)}, {"segment_id": "t", "kind": "generated", **r(2, 3)}]),
            (3, "abc", [], [], [], []),
        ],
        f"doc_id long, text string, page_map {L.PAGES}, layout {L.LAYOUT}, tables {L.TABLES}, source_map {seg}",
    )
    got = {x["doc_id"]: set(x["errors"]) for x in L.layout_errors(docs).collect()}
    assert got[1] == set() == got[3] and got[2] == {"pages_overlap", "page_beyond_text", "page_repeated", "unknown_page", "range_beyond_text", "id_repeated", "source_map_not_contiguous"}
    from pyspark.sql import functions as F

    backed = docs.select("doc_id", L.source_backed(F.col("source_map"), F.lit(0), F.lit(1)).alias("a"), L.source_backed(F.col("source_map"), F.lit(0), F.lit(3)).alias("b")).collect()
    assert [(x["a"], x["b"]) for x in sorted(backed)] == [(True, True), (True, False), (True, True)]
    moved = spark.createDataFrame([([r(1, 2)],)], "s array<struct<start_char: bigint, end_char: bigint, start_byte: bigint, end_byte: bigint>>").select(L.shift(F.col("s"), F.lit(10), F.lit(20))[0]).first()[0]
    assert moved.asDict() == {"start_char": 11, "end_char": 12, "start_byte": 21, "end_byte": 22}


# Sources


def _docx(body, core=None):
    out = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if core:
            z.writestr("docProps/core.xml", core)
    return bytearray(out.getvalue())


def test_files_become_documents_with_layout(spark):
    from spanloom.sources.mail import ingest

    p = lambda t, style="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda *ts: "<w:tr>" + "".join(f"<w:tc>{p(t)}</w:tc>" for t in ts) + "</w:tr>"
    core = '<c:p xmlns:c="c" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"><dc:title>T é</dc:title><dcterms:created>2024-01-02T03:04:05Z</dcterms:created></c:p>'
    mail = "Subject: Hi é\r\nFrom: a@b.c\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<h1>Größe</h1><p>x <b>y</b></p>".encode()
    files = [
        ("a.docx", _docx(p("Head", "Heading1") + p("one") + p("item", "ListParagraph") + f"<w:tbl>{cell('k', 'v')}{cell('é', '2')}</w:tbl>", core)), ("b.eml", bytearray(mail)), ("c.txt", bytearray(b"\xff")), ("d.md", bytearray("# é".encode())),
        ("e.zip", bytearray(b"x")), ("f.html", bytearray("<meta charset=latin-1><title>t</title><p>gr\xfcn</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>".encode("latin-1"))), ("g.txt", bytearray(b"  \n")),
        ("h.pdf", bytearray(b"%PDF")), ("i.docx", _docx(f"<w:tbl>{cell('k', '')}</w:tbl>")), ("j.docx", _docx(p("x"), core.replace("2024-01-02T03:04:05Z", "soon"))), ("k", None),
    ]
    got = {r["source_path"]: r for r in ingest(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert {k for k, r in got.items() if r["error"]} == {"c.txt", "e.zip", "g.txt", "h.pdf", "i.docx", "j.docx", "k"}
    a = got["a.docx"]
    assert a["text"] == "Head\none\nitem\nk v\né 2" and [s["role"] for s in a["layout"]] == ["heading", "paragraph", "list_item", "table"] and a["metadata"]["title"] == "T é" and a["metadata"]["created"].startswith("2024-01-02")
    cells = a["tables"][0]["cells"]
    assert [(a["text"][c["start_char"] : c["end_char"]], c["header_labels"]) for c in cells] == [("k", []), ("v", []), ("é", ["k"]), ("2", ["v"])]
    for r in (a, got["b.eml"], got["f.html"], got["d.md"]):
        raw = r["text"].encode()
        for s in [*r["layout"], *r["source_map"], *[c for t in r["tables"] for c in t["cells"]]]:
            assert raw[s["start_byte"] : s["end_byte"]].decode() == r["text"][s["start_char"] : s["end_char"]]
        ends = [0, *[s["end_char"] for s in r["source_map"]]]
        assert [s["start_char"] for s in r["source_map"]] == ends[:-1] and ends[-1] == len(r["text"])
    b = got["b.eml"]
    assert [b["text"][s["start_char"] : s["end_char"]] for s in b["layout"]] == ["Größe", "x y"] and b["text"].startswith("Subject: Hi é\nFrom: a@b.c\n\n")
    assert got["f.html"]["text"] == "grün\na b\n1 2" and got["d.md"]["source_map"][0]["kind"] == "source" and got["f.html"]["metadata"]["declared_encoding"] == "latin-1"


def test_html_rows_and_errors(spark):
    from spanloom.sources import html

    pages = spark.createDataFrame([(1, "<title>A  b</title><meta name=Description content='d e'><script>no</script>out<p>one<p>two<table><tr><td>x</td></tr></table>"), (2, "<table><tr><td></td><td>y</td></tr></table>"), (3, None)], "page_id long, html string")
    rows = html.blocks(pages).orderBy("page_id", "block_index").collect()
    assert [(r["page_id"], r["role"], r["text"]) for r in rows if not r["error"]] == [(1, "paragraph", "one"), (1, "paragraph", "two"), (1, "table", "x")] and [r["page_id"] for r in rows if r["error"]] == [2]
    meta = {r["page_id"]: r for r in html.title_meta(pages).collect()}
    assert json.loads(meta[1]["meta"]) == {"description": "d e", "title": "A b"} and meta[3]["title"] is None
    assert [(r["table_id"], r["start_char"]) for r in html.table_cells(pages).where("error is null").collect()] == [("table:0", 8)]


# Evaluation


def test_mutations_and_their_declarations(spark):
    ch = spark.createDataFrame([("m", "a", "12", "13"), ("m", "b", None, "new"), ("m", "c", "old", None), ("n", "a", None, None)], "mutation_id string, expected_id string, retired string, introduced string")
    vals = spark.createDataFrame([("m", "It is 12  now"), ("m", "NEW thing")], "mutation_id string, value string")
    f = R.mutation_failures(ch, vals)
    assert sorted((r["expected_id"], r["code"]) for r in f.collect()) == [("a", "introduced_value_missing"), ("a", "retired_value_retained")]
    scored = {r["mutation_id"]: r["sensitivity"] for r in R.mutation_scores(ch, f).collect()}
    assert scored["m"] == pytest.approx(2 / 3, abs=1e-6) and scored["n"] == 1.0
    label = "mutation_id string, expected_id string, value string, source_text string, start_char long, end_char long"
    base = spark.createDataFrame([("m", "a", "12", "it is 12", 0, 8), ("m", "z", "q", "q", 9, 10)], label)
    mutated = spark.createDataFrame([("m", "a", "13", "it is 13", 0, 8), ("m", "z", "r", "r", 9, 10)], label)
    errors = {(r["expected_id"], r["error"]) for r in R.mutation_errors(ch.where("mutation_id = 'm'"), base, mutated).collect()}
    assert errors == {("b", "unknown_expected_id"), ("b", "introduced_not_in_mutated"), ("c", "unknown_expected_id"), ("c", "retired_not_in_base"), ("z", "undeclared_change")}
    assert R.adversarial_suite(spark.createDataFrame([("p", True), ("q", False)], "pair_id string, passed boolean")).first()["passed"] is False


def test_fates_follow_the_merge(spark):
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "candidate_id string")
    merged = spark.createDataFrame([("b", "a"), ("d", "c"), ("f", "zz")], "candidate_id string, primary_id string")
    rejections = spark.createDataFrame([("c", "verifier"), ("c", "critic"), ("e", "executor")], "candidate_id string, stage string")
    got = {r[0]: r[1] for r in V.fates(one(*"abcdefg"), merged, rejections, one("a")).collect()}
    assert got == {"a": "data_point", "b": "dedup_then_data_point", "c": "critic_rejected", "d": "dedup_then_critic_rejected", "e": "executor_rejected", "f": "dedup_then_unknown", "g": "no_outcome"}


def test_chains_of_merges_come_to_rest(spark):
    """Chains of any length, branches, a chain into a cycle, a loop on itself, and repeated merges."""
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(37)] + [("b", "c3"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("c5", "c6"), ("c5", "zz"), (None, "c1")]
    got = {r["candidate_id"]: (r["survivor_id"], r["in_cycle"]) for r in V.merge_ends(spark.createDataFrame(pairs, "candidate_id string, primary_id string")).collect()}
    assert got == {**{f"c{i}": ("c37", False) for i in range(37)}, "b": ("c37", False), **{k: (None, True) for k in "xyz"}}
    ids = spark.createDataFrame([(k,) for k in ("c0", "c37", "x", "s")], "candidate_id string")
    fates = V.fates(ids, spark.createDataFrame(pairs, "candidate_id string, primary_id string"), spark.createDataFrame([], "candidate_id string, stage string"), ids.where("candidate_id = 'c37'"))
    assert {r["candidate_id"]: r["fate"] for r in fates.collect()} == {"c0": "dedup_then_data_point", "c37": "data_point", "x": "merge_cycle", "s": "no_outcome"}
    assert V.merge_ends(spark.createDataFrame([], "candidate_id string, primary_id string")).count() == 0


def test_violations_of_supporting_spans(spark):
    r = lambda a, b, c, d, t: {"start_char": a, "end_char": b, "start_byte": c, "end_byte": d, "text": t}
    s = "candidate_id string, doc_id long, value string, start_char long, end_char long, start_byte long, end_byte long, supporting array<struct<start_char: bigint, end_char: bigint, start_byte: bigint, end_byte: bigint, text: string>>"
    f = spark.createDataFrame([("a", 1, "é", 0, 1, 0, 2, [r(1, 2, 2, 3, "x"), r(1, 2, 1, 3, "y"), r(0, 99, 0, 99, "")])], s)
    got = [x["code"] for x in R.violations(f, spark.createDataFrame([(1, "éx")], "doc_id long, text string")).collect()]
    p = "supporting_source_span_"
    assert sorted(got) == sorted([p + "byte_offset_mismatch", p + "text_mismatch", p + "byte_mismatch", p + "out_of_bounds"])
