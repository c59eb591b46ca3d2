"""Cases that operators once did in part only."""

import numpy as np
import pytest

from spanloom.llm import pii, quality_classifier, quality_rules


@pytest.mark.parametrize("size", [8, 200, 201, 1000, 100_000])
def test_secret_is_redacted_whole(spark, size):
    rng = np.random.default_rng(12)
    token = "".join(rng.choice(list("abcdefXYZ0123456789._-"), size - 1)) + "Q"
    card = token[: size // 2] + "x4111111111111111x" + token[size // 2 :]
    texts = [f"login api_key={t} and then more" for t in (token, card)] + ["plain prose without any of it"] * 3
    for t, s in zip(texts, (token, card)):
        assert (4, 14, 14 + len(s)) in pii.more_spans(t, pii.base_spans(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert got == ["login api_key=[secret] and then more"] * 2 + texts[2:]


def _repeats_vote(text):
    return quality_classifier.votes(quality_classifier.signals(text)[1])[7]


@pytest.mark.parametrize("n", [60, 399, 400, 401, 5000])
def test_repeated_words_count_at_any_length(n):
    assert _repeats_vote(" ".join(f"w{k % 7}" for k in range(n))) == 1
    assert _repeats_vote("\n".join(" ".join(f"w{k % 7}" for k in range(i, i + 11)) + f" end{i}" for i in range(0, n, 11))) == 1
    rng = np.random.default_rng(13)
    assert _repeats_vote(" ".join(f"w{x}" for x in rng.integers(0, 6, n))) == 1
    assert _repeats_vote(" ".join(f"w{k}" for k in range(n))) == 2


def test_phrases_repeated_far_apart_are_bad():
    assert _repeats_vote(" ".join(f"w{k % 1000}" for k in range(4000))) == 1


def test_repeated_windows_are_those_of_operator_10(spark):
    rng = np.random.default_rng(14)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, top, n)) for top, n in ((900, 5), (30, 300), (40, 3000), (400, 3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.evaluate(docs).collect():
        words = texts[r["doc_id"]].split()
        own = 1 - sum(len(set(words[k : k + 400])) for k in range(0, len(words), 400)) / len(words)
        assert quality_classifier._repeats(words) == pytest.approx(max(own, r["n_repeat_words"] / r["n_words"]))
