"""Cases that queries once did in part only, against plain versions."""

import pandas as pd
import pytest
from conftest import SF, rows

from spanloom import registry
from spanloom.operators import facts as X
from spanloom.operators import occurrences as O
from spanloom.operators import review as R


def _fold(s):
    return " ".join((s or "").split()).casefold()


def _lookup(items, texts):
    out = {}
    texts = [_fold(x) for x in texts]
    for i, t in ((i, _fold(t)) for i, t in items):
        if t:
            kept, changed = (sum(v in x for x in texts) for v in (t, t[0] + "x" + t[1:]))
            out[i] = (kept, changed, float(not kept and changed > 0))
    return out


def _got(df):
    return {r["item_id"]: (r["kept_in"], r["changed_in"], r["sensitivity"]) for r in df.collect()}


def test_passages_are_found_at_every_offset(spark):
    passage = "alpha beta gamma delta epsilon zeta"
    items = [(1, passage), (2, "one two"), (3, "Große ΣΑΣ drei\nvier fünf sechs"), (4, ""), (5, None), (6, "never seen in any of them")]
    texts = [" ".join(["pad"] * k + [passage] + ["end"]) for k in range(7)] + [passage.upper().replace(" ", "\n\t"), "x" + passage + "xy", "alpha beta gamma", "one  TWO", "oxne two", "AXlpha beta gamma delta epsilon zeta", "GROSSE σας drei vier fünf sechs", None, ""]
    docs = spark.createDataFrame([(k % 9, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = _got(R.mutation_sensitivity(spark.createDataFrame(items, "item_id long, text string"), docs))
    assert got == _lookup(items, texts) and got[1] == (9, 1, 0.0) and got[6] == (0, 0, 0.0)
    new = spark.createDataFrame([(1, "here are txwelve old monks")], "doc_id long, text string")
    assert _got(R.mutation_sensitivity(spark.createDataFrame([(7, "twelve old monks")], "item_id long, text string"), new)) == {7: (0, 1, 1.0)}


def test_passages_of_the_tables(spark):
    sf = SF.replace("0.001", "0.01")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = _got(registry.queries()["mutation_sensitivity"](spark, sf))
    assert got == _lookup(items, texts) and sum(k for k, _, _ in got.values()) >= 26


def test_equal_values_at_different_places_stay(spark):
    docs = spark.createDataFrame([(1, "12 then 12 and 13", "s"), (2, "12", "s")], "doc_id long, text string, source string")
    facts = X.propose(docs, [x for x in X.LENSES if x[0] == "number"])
    assert X.survivors(facts).count() == 4 and X.rejections(facts).count() == 0 and X.clusters(facts).count() == 0


def test_candidates_merge_at_one_place_or_canonicalized(spark):
    rows = [("a", 0, "verbatim_only"), ("b", 0, "verbatim_only"), ("c", 8, "verbatim_only"), ("e", 0, "canonicalized"), ("d", 8, "canonicalized"), ("f", 20, None)]
    s = "candidate_id string, doc_id long, lens string, category string, field string, value string, start_char long, end_char long, status string"
    facts = spark.createDataFrame([(i, 1, "number", "Quantity", "number", "12", at, at + 2, k) for i, at, k in rows], s)
    got = {r["candidate_id"]: r["primary_id"] for r in X.dedup(facts).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "f"}
    assert sorted((r["primary_id"], r["members"], r["spans"]) for r in X.clusters(facts).collect()) == [("a", 2, 1), ("d", 2, 2)]
    assert sorted(r["candidate_id"] for r in X.rejections(facts).collect()) == ["b", "e"]


def test_overlapping_chunks_find_facts_twice(spark):
    """Each fact of a document survives once, though chunks that overlap propose it twice."""
    from spanloom import samples

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lens = [x for x in X.LENSES if x[0] == "number"]
    whole = {(r["doc_id"], r["value"], r["start_char"]) for r in X.propose(docs, lens).collect()}
    c = X.propose(samples.chunked(docs), lens)
    kept = X.dedup(c).where("candidate_id = primary_id").collect()
    assert {(r["doc_id"], r["value"], r["start_char"]) for r in kept} == whole and len(kept) == len(whole)


def _values(spark, lens, text):
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    facts = X.propose(docs, [x for x in X.LENSES if x[0] == lens])
    assert all(r["span_ok"] for r in X.span_check(facts, docs).collect())
    return sorted(r["value"] for r in facts.collect())


def test_temporal_lens_takes_times_only(spark):
    times = ["2024-05-01", "12:30", "2024-05-01T07:15:00Z", "March 31, 2026", "3 April 2025", "June 2024", "31.12.2023", "5/6/2024", "9:05 pm", "Q3 2024", "second quarter of 2025", "fiscal quarter ended June 30, 2026", "15 days", "30 business days", "2 hours"]
    assert _values(spark, "temporal", "é " + "; ".join(times) + ".") == sorted(times)
    assert _values(spark, "temporal", "192.168.100.12 10.0.0.255 port 99:99 3.14 1:305 2024-13-45 12 daylight") == []


def test_citation_lens_takes_references(spark):
    refs = ["Version 2.0", "Section 4.2(b)", "Exhibit A", "Table 3", "Appendix B-1", "§ 12.3", "ISO 9001", "ISO/IEC 27001", "RFC 2119", "Article IV", "Item 5a"]
    assert _values(spark, "citation", "see " + "; ".join(refs) + ".") == sorted(refs)
    assert _values(spark, "citation", "this section is a table of parts, Table Also, Section Beta, Parts 4th") == []


def test_values_are_found_by_all_four_steps():
    text = "é The  Quick\tBrown fox\n ran. aXa Xa\u2003end abab ababa Net  Sales net sales"
    at = text.index
    cases = {
        " fox ": [(at("fox"), at("fox") + 3)], "quick\tbrown": [(at("Quick"), at("Quick") + 11)], "The Quick Brown": [(at("The"), at("Brown") + 5)],
        "Xa end": [(at("Xa\u2003"), at("end") + 3)], "ababa": [(at("ababa"), at("ababa") + 5)], "axa": [(at("aXa"), at("aXa") + 3)],
        "NET SALES": [(at("net sales"), at("net sales") + 9)], "missing": [], "": [], "   ": [], "the quick brown": [],
    }
    assert dict(zip(cases, O.locate(text, list(cases)))) == cases
    assert all(O.locate(text, [v]) == [spans] for v, spans in cases.items())
    assert O.locate("ababa", ["aba", "aba", None]) == [[(0, 3), (2, 5)], [(0, 3), (2, 5)], []] and O.locate(None, ["a"]) == [[]]


REVIEWS = ["approved_fields", "critic_reports", "corrections", "verifier_reports", "mirrored_reports", "candidate_fates", "stage_completeness"]
SPANS = ["span_roundtrip_check", "span_invariants", "source_context"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three folders: some rows; the same rows twice; and other texts under ids of theirs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 12 = 0")
    other = docs.where("doc_id % 24 = 0").selectExpr("doc_id", "concat('In 2023, 12 and 345 ', text) as text", "lang", "source", "n_chars")
    out = {}
    for name, df in {"one": docs, "two": docs.unionByName(docs), "other": other, "both": docs.unionByName(other)}.items():
        out[name] = str(tmp_path_factory.mktemp(name))
        df.coalesce(1).write.parquet(f"{out[name]}/documents.parquet")
    return out


@pytest.mark.parametrize("name", REVIEWS)
def test_repeated_documents_are_reviewed_once(spark, tables, name):
    q = registry.queries()[name]
    assert rows(q(spark, tables["two"]).toPandas()) == rows(q(spark, tables["one"]).toPandas())


@pytest.mark.parametrize("name", SPANS)
def test_repeated_documents_repeat_their_facts(spark, tables, name):
    q = registry.queries()[name]
    one, two = q(spark, tables["one"]).toPandas(), q(spark, tables["two"]).toPandas()
    assert rows(two) == rows(pd.concat([one, one]))


@pytest.mark.parametrize("name", [*SPANS, "critic_reports", "approved_fields", "resolve_claim_offsets", "value_matches"])
def test_unlike_texts_of_one_id_do_not_mix(spark, tables, name):
    q = registry.queries()[name]
    one, other, both = (q(spark, tables[k]).toPandas() for k in ("one", "other", "both"))
    assert rows(both) == rows(pd.concat([one, other]))
    assert name != "span_roundtrip_check" or both["span_ok"].all()
