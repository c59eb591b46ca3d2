"""Interval joins against all pairs, lenses over sentences, and lenses on texts without sentence ends."""

import random
import re
import time

import pytest

from spanloom.operators import clauses as K
from spanloom.operators import facts as X
from spanloom.operators import intervals as I

DOC = "doc_id long, text string, source string"


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_joins_of_spans_equal_all_pairs(spark, width):
    rng = random.Random(width)
    span = lambda: (a := rng.randrange(60), a + rng.randrange(20))
    inner, outer = [(rng.randrange(3), i, *span()) for i in range(80)], [(rng.randrange(3), i, *span()) for i in range(60)]
    a = spark.createDataFrame(inner, "k int, i int, start_char long, end_char long")
    b = spark.createDataFrame(outer, "k int, j int, outer_start long, outer_end long")
    pairs = [(x, y) for x in inner for y in outer if x[0] == y[0]]
    got = sorted((r["i"], r["j"]) for r in I.contained(a, b, ["k"], width).collect())
    assert got == sorted((x[1], y[1]) for x, y in pairs if x[2] >= y[2] and x[3] <= y[3] and (x[2] < y[3] or x[2] == y[2]) or x[0] == y[0] and x[2] == x[3] == y[3] and x[2] // width in range(y[2] // width, max(y[3] - 1, y[2]) // width + 1))
    got = sorted((r["i"], r["j"]) for r in I.overlapping(a, b, ["k"], width).collect())
    assert got == sorted((x[1], y[1]) for x, y in pairs if x[2] < y[3] and y[2] < x[3])


def values(df, docs):
    out = []
    for r in df.collect():
        texts = [t for i, t, _ in docs if i == r["doc_id"] and t and t[r["start_char"] : r["end_char"]] == r["value"]]
        assert any(t.encode()[r["start_byte"] : r["end_byte"]].decode() == r["value"] for t in texts)
        out.append((r["doc_id"], r["value"]))
    return sorted(out)


TEXT = "é # Head\n\nThis is agreed; the Seller shall deliver, and must insure; the rest is his. Unless Dr. Who objects, if asked, all stands! No cue here. Save for holidays; otherwise free, except that none may sleep"
DOCS = [(1, TEXT, "s"), (1, TEXT, "s"), (1, "He is obliged to wait", "s"), (2, None, "s"), (3, "", "s"), (4, "# A heading shall not bind", "s"), (None, "They must go.", None)]


@pytest.mark.parametrize(("lens", "want"), [
    ("obligation", [(1, "He is obliged to wait"), (1, "and must insure"), (1, "the Seller shall deliver, and must insure"), (None, "They must go.")]),
    ("condition", [(1, "Unless Dr. Who objects"), (1, "if asked")]),
    ("exception", [(1, "Save for holidays"), (1, "except that none may sleep")]),
])
def test_clauses(spark, lens, want):
    got = values(K.clauses(spark.createDataFrame(DOCS, DOC), lens).where("doc_id is not null"), DOCS)
    assert got == sorted(x for x in want if x[0] is not None)
    assert K.clauses(spark.createDataFrame([], DOC), lens).count() == 0


def test_relations_are_neighbours_in_a_sentence(spark):
    docs = [(1, "Contractor é works with Wholesaler and Distributor, Electrician. Manufacturer sells to a@bcd.efg now. Wholesalers 12 Distributors", "s")]
    got = values(K.relations(spark.createDataFrame(docs, DOC)), docs)
    assert got == sorted([(1, "Contractor é works with Wholesaler"), (1, "Wholesaler and Distributor"), (1, "Manufacturer sells to a@bcd.efg")])


def test_definitions_are_definitions(spark):
    text = 'A "quoted word" is none. "Net Sales" means sales less returns; Affiliate refers to any company. Mean things happen.'
    facts = X.propose(spark.createDataFrame([(1, text, "s")], DOC), [x for x in X.LENSES if x[0] == "definition"]).collect()
    assert [r["value"] for r in facts] == ['"Net Sales" means sales less returns', "Affiliate refers to any company"]


STRETCHES = ["Alpha beta Alpha acquired x. no. Éa Bb signed", "acquired Alpha. B acquired! iPhone opened? X\nY opened.", "Alpha.Beta closed.Gamma merged!", "", "A.", "Zz began began began\n."]


def test_stretches_equal_the_pattern(spark):
    rng = random.Random(4)
    texts = STRETCHES + ["".join(rng.choice(["Aa ", "bb ", "iPh ", "acquired", " signed ", ".", "!\n", "\n", "é", " "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOC)
    for lens in [x for x in X.LENSES if x[0] in ("event", "claim")]:
        got = sorted((r["doc_id"], r["ordinal"], r["value"], r["start_char"], r["end_byte"]) for r in X.propose(docs, [lens]).collect())
        assert got == [(i, k, m[0], m.start(), len(t[: m.end()].encode())) for i, t in enumerate(texts) for k, m in enumerate(re.finditer(lens[3], t))]


@pytest.mark.parametrize("text", ["Alpha beta " * 90_000 + " acquired ", "Alpha acquired " * 66_000, "A" * 1_000_000 + " acquired", "Alpha must beta\n" * 60_000])
def test_lenses_are_linear_without_sentence_ends(spark, text):
    docs = spark.createDataFrame([(1, text, "s")], DOC)
    lenses = [x for x in X.LENSES if x[0] in ("event", "claim")]
    X.propose(docs.limit(0), lenses).count()
    began = time.time()
    assert X.propose(docs, lenses).count() == 0
    assert time.time() - began < 10
