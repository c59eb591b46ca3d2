"""Every query of the fact engine against its oracle, plus the invariants of facts."""

import re

import pytest
from conftest import SF, rows

from spanloom import registry
from spanloom import samples as S
from spanloom.operators import documents as D
from spanloom.operators import facts as X
from spanloom.operators import review as R
from spanloom.operators import verdicts as V

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert len(got) > 0


@pytest.mark.parametrize("name", ["crossdoc_groups", "dedup_survivors", "score_by_field", "run_diff", "critic_reports", "candidate_fates", "data_points", "span_roundtrip_check"])
def test_plans_read_documents_twice_at_most(spark, name):
    """Facts that a query reads more than once are written first; no plan scans the corpus per use."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Location: InMemoryFileIndex[^\n]*documents", plan)) <= 2


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, source string")


def test_spans_hold_for_multibyte_text(spark):
    docs = _docs(spark, [(1, "é😀 12 ß 3,4"), (2, None), (3, "")])
    facts = X.propose(docs)
    assert {r["value"] for r in facts.collect()} >= {"12", "3,4"}
    assert all(r["span_ok"] for r in X.span_check(facts, docs).collect())


def test_rows_of_one_id_have_offsets_of_their_own(spark):
    docs = _docs(spark, [(1, "12 and 345"), (1, "x 7 yy 89"), (1, "a 5\u00016 b")])
    got = sorted((r["value"], r["start_char"], r["start_byte"]) for r in X.propose(docs, X.LENSES[:1]).collect())
    assert got == sorted([("12", 0, 0), ("345", 7, 7), ("7", 2, 2), ("89", 7, 7), ("5", 2, 2), ("6", 4, 4)])


def test_many_matches_in_one_text(spark):
    text = " ".join(f"é{k}" for k in range(3000))
    facts = X.propose(_docs(spark, [(1, text)]), X.LENSES[:1]).collect()
    assert [(r["value"], r["start_char"], r["end_byte"]) for r in sorted(facts, key=lambda r: r["ordinal"])] == [
        (m[0], m.start(), len(text[: m.end()].encode())) for m in re.finditer("[0-9]+", text)
    ]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_windows_cover_all_tokens(spark):
    text = "  " + " ".join(map(str, range(450))) + "\n é "
    got = D.chunks(_docs(spark, [(1, text)]), 200, 20).orderBy("chunk_index").collect()
    assert [(r["token_start"], r["token_end"]) for r in got] == [(0, 200), (180, 380), (360, 452)]
    for r in got:
        assert text[r["start_char"] : r["end_char"]] == r["text"] and text.encode()[r["start_byte"] : r["end_byte"]] == r["text"].encode()
    with pytest.raises(ValueError):
        D.chunks(_docs(spark, [(1, "a")]), 20, 20)


def test_matching_is_one_to_one(spark):
    s = "doc_id long, category string, field string, value string, start_char long, end_char long, start_byte long, end_byte long"
    want = spark.createDataFrame([(f"e{k}", 1, "C", "f", "V  v", a, a + 4, a, a + 4) for k, a in enumerate((0, 9, 9, 50))] + [("e9", 1, "C", "f", "gone", 0, 4, 0, 4)], "expected_id string, " + s)
    got = spark.createDataFrame([(f"c{k}", 1, "c", "f", "V  v", a, a + 4, a, a + 4) for k, a in enumerate((9, 20, 30, 50))] + [("c9", 1, "c", "f", "new", 0, 3, 0, 3)], "candidate_id string, " + s)
    m = R.match(want, got).collect()
    by = lambda k: sorted((r["expected_id"], r["data_point_id"]) for r in m if r["status"] == k)
    assert by("exact") == [("e1", "c0"), ("e3", "c3")] and by("matched") == [("e0", "c1"), ("e2", "c2")]
    assert by("missing") == [("e9", None)] and by("unexpected") == [(None, "c9")]


def test_metrics_without_labels_or_facts(spark):
    labels, facts = S.labels_of(X.propose(_docs(spark, [(1, "12 and 13")]))), X.propose(_docs(spark, [(1, "12 and 13")]))
    none = R.metrics(R.counts(labels.limit(0), facts, R.match(labels.limit(0), facts))).where("scope = 'suite'").first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 1.0, 0.0)
    lost = R.metrics(R.counts(labels, facts.limit(0), R.match(labels, facts.limit(0)))).where("scope = 'suite'").first()
    assert (lost["precision"], lost["recall"], lost["f1"]) == (0.0, 0.0, 0.0)


def test_run_states(spark):
    rows_ = [("a", 1, 1, "created"), ("a", 2, 2, "running"), ("a", 3, 3, "completed"), ("b", 1, 4, "running"), ("c", 1, 5, "created"), ("c", 1, 6, "running"), ("c", 2, 7, "failed"), ("c", 3, 8, "running")]
    e = spark.createDataFrame(rows_, "run_id string, ts int, event_id int, status string")
    got = {r["run_id"]: (r["status"], r["illegal"]) for r in V.run_status(e).collect()}
    assert got == {"a": ("completed", 0), "b": ("running", 1), "c": ("running", 0)}


def test_stream_ingest_stores_a_document_once(spark, tmp_path):
    from spanloom.streaming.ingest import start

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("first", "again"):
        docs.write.mode("append").parquet(str(tmp_path / "in"))
        q = start(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == X.propose(docs).count()
