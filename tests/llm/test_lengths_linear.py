"""Long texts without blanks, long spans, and weights of nought."""

import random
import re
import time

import pytest
from test_rows import docs_of

from spanloom.llm import pii, source_mixing, toxicity


@pytest.mark.parametrize("text", ["a" * 1_000_000, "a1" * 500_000, "中文字" * 333_333, "a." * 499_999 + "a", ("a" * 99 + "1") * 10_000, "idi0t" * 200_000])
def test_toxicity_features_are_linear_without_blanks(text):
    began = time.time()
    toxicity.features(text, toxicity._Hits(frozenset(toxicity.SEEDS)))
    assert time.time() - began < 5


def test_hidden_pieces_equal_the_plain_pattern():
    rng = random.Random(3)
    for _ in range(3000):
        low = "".join(rng.choice("ab1$.-é\n   ") for _ in range(rng.randrange(40)))
        assert list(toxicity.hidden_pieces(low)) == re.findall(r"\S*[a-z][0-9@$!|*._-]+[a-z]\S*", low)


def test_votes_read_whole_spans():
    """The digits that a secret needs may stand at its end."""
    for n in (100, 4096, 50_000):
        text = "password=" + "abcdefgh" * (n // 8) + "1234"
        spans = [s for s in pii.judged_spans(text) if pii.KINDS[s["kind"]] == "secret"]
        assert [(s["end"], int(pii.decode([s["votes"]], len(pii.LABELLERS))[0][0])) for s in spans] == [(len(text), 2)]


def test_a_weight_of_nought_draws_nothing(spark):
    docs = docs_of(spark, [(1, "a b c"), (2, "d e f g")])
    both = docs.withColumn("source", docs.doc_id.cast("string"))
    for weights in ({"source": {"1": 0}}, {"lang": {"en": 0}}):
        mix = source_mixing.Mix(**{"domain": {}, "lang": {}, "source": {}, **weights}, budget_tokens=100, max_epochs=1)
        assert sorted(r["doc_id"] for r in source_mixing.mix_documents(both, mix).collect()) == ([2] if "source" in weights else [])
