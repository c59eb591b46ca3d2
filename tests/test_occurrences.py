"""The search of many values in one text against the plain search of each."""

import random
import re

import pytest
from conftest import SF

from spanloom import registry
from spanloom.operators import claims as C
from spanloom.operators import occurrences as O

CHUNK = "chunk_id string, doc_id long, text string, start_char long, start_byte long"
CLAIM = "claim_id string, chunk_id string, lens string, category string, field string, value string, start_char long, length long, confidence double"


def plain(text, value):
    def exact(t, v):
        return [(i, i + len(v)) for i in range(len(t) - len(v) + 1) if t.startswith(v, i)] if v else []

    if not text or not value:
        return []
    found = exact(text, value) or exact(text, value.strip())
    found = found or [m.span() for m in re.finditer(re.escape(value), text, re.IGNORECASE)]
    if found or not value.strip() or not re.search(r"\s", value):
        return found
    flat, back = "", []
    for i, c in enumerate(text):
        if not c.isspace():
            flat, back = flat + c, [*back, i]
        elif flat and not flat.endswith(" "):
            flat, back = flat + " ", [*back, i]
    return [(back[a], back[z - 1] + 1) for a, z in exact(flat, " ".join(value.split()))]


@pytest.mark.parametrize("seed", range(40))
def test_all_values_at_once_equal_each_alone(seed):
    rng = random.Random(seed)
    letters = "aAbB  \n\tßẞſsσςİi-." if seed % 2 else "ab A\n"
    text = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
    values = ["".join(rng.choice(letters) for _ in range(rng.randrange(6))) for _ in range(80)]
    values += [text[a : a + rng.randrange(1, 9)] for a in range(0, len(text), 7)]
    values += [v.upper() for v in values[-5:]] + [v.replace(" ", " \n ") for v in values[-5:]] + [None]
    assert O.locate(text, values) == [plain(text, v) for v in values]


def test_a_text_with_very_many_values(spark):
    """Dealt to rows of a few values each; every value still gets all its places, repeated rows too."""
    values = spark.createDataFrame([("k" if i % 9 else "other", i, f"v{i % 50} ") for i in range(900)] + [("none", 0, "x"), ("k", 7, None)], "k string, i long, value string")
    text = " ".join(f"v{j}" for j in range(60))
    texts = spark.createDataFrame([("k", text), ("k", text), ("other", None), ("unasked", "v1")], "k string, text string")
    g = O.beside(values, texts, ["k"], 16)
    assert g.count() > 30 and max(len(r["rows"]) for r in g.collect()) < 60
    got = O.value_places(values, texts, ["k"]).collect()
    assert len(got) == 901
    for r in got:
        assert [tuple(p) for p in r["places"]] == (plain(text, r["value"]) if r["k"] == "k" else [])


def test_repeated_chunks_and_claims(spark):
    """Chunks of one id are one chunk; each claim row gives one row, also where repeated."""
    chunks = spark.createDataFrame([("c", 1, "rose 12 percent", 0, 0)] * 3 + [("d", 2, None, 5, 5)], CHUNK)
    rows = [("1", "c", "n", "K", "f", "12", 5, 2, 1.0)] * 2 + [("2", "d", "n", "K", "f", "12", 5, 2, 1.0), ("3", "gone", "n", "K", "f", "12", 5, 2, 1.0), ("4", "c", "n", "K", "f", None, 5, 2, 1.0), ("5", "c", "n", "K", "f", "12", None, 2, 1.0)]
    got = C.resolve(spark.createDataFrame(rows, CLAIM), chunks)
    assert sorted((r["claim_id"], r["resolution"], r["resolved_start"], r["source_text"]) for r in got.collect()) == [("1", "claimed", 5, "12")] * 2 + [("2", "rejected", 5, "")]
    done = C.materialize_candidates(C.normalize(got.where("size(codes) = 0"), chunks, fields=None)).collect()
    assert [(r["value"], r["start_char"], r["end_byte"]) for r in done] == [("12", 5, 7)] * 2
    assert C.resolve(spark.createDataFrame([], CLAIM), chunks).count() == 0


def test_claims_reach_every_step(spark):
    """The registered claims are found by each of the four steps, repaired beside headings, and rejected."""
    got = registry.queries()["resolve_claim_offsets"](spark, SF).toPandas()
    assert {"claimed", "repaired", "rejected"} <= set(got["resolution"])
    assert {"", "invalid_source_offsets", "ambiguous_source_span", "invalid_source_offsets,ambiguous_source_span"} == set(got["codes"])
    made = registry.queries()["value_matches"](spark, SF).toPandas()
    assert (made["n"] == 0).any() and (made["n"] > 1).any()


def test_plans_carry_no_text_a_claim(spark):
    """Texts meet arrays of claims, and what leaves the row has no text of a chunk."""
    df = registry.queries()["resolve_claim_offsets"](spark, SF)
    assert "chunk_text" not in df.columns
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[: plan.index("Join Inner")]
    assert "Generate explode" in joins and "Join" not in joins
    passages = registry.queries()["mutation_sensitivity"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in passages and "Cartesian" not in passages and "CollectLimit" not in passages


def test_needles_in_blocks(spark):
    texts = spark.createDataFrame([("one two",), ("two two three",), (None,), ("",)], "text string")
    needles = spark.createDataFrame([("two",), ("o",), ("two two",), ("four",), ("",), (None,), ("two",)], "needle string")
    for most in (1, 4, 1000):
        assert sorted(tuple(r) for r in O.documents_with(needles, texts, most).collect()) == [("o", 2), ("two", 2), ("two two", 1)]
    assert O.documents_with(needles.where("false"), texts).count() == 0
