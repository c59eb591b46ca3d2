"""Readers of quantities and the normalizers made of them, on edges and on very long texts."""

import time

import pytest

from spanloom.functions import phrases as Q
from spanloom.operators import claims as C


@pytest.mark.parametrize(
    "text, read",
    [("12 x", "12"), ("$ 1,200.50.", "$ 1,200.50"), ("3.x", "3"), ("5percent", "5"), ("€7", "€7"), ("x", None), ("$", None), ("", None), ("1,", "1,")],
)
def test_amounts(text, read):
    end = Q.amount(text, 0)
    assert (text[:end] if end >= 0 else None) == read


@pytest.mark.parametrize("text, read", [("12 basis  points", "12 basis  points"), ("3% million", "3% million"), ("4 MEGAWATT-HOURS", "4 MEGAWATT-HOURS"), ("5 bps days old", "5 bps days"), ("6 to 7", "6")])
def test_quantities(text, read):
    assert text[: Q.quantity(text, 0)] == read


@pytest.mark.parametrize("text, start", [("a 12", 2), ("v1.2.30", 3), ("$ 5", 0), ("x ,,7", 4), ("7.", -1), ("a", -1), ("", -1), ("1,000.5", 0)])
def test_amounts_backwards(text, start):
    assert Q.amount_before(text, len(text)) == start


def claim(field, source, value="", text=None, start=0):
    return {"field": field, "value": value, "start": start + 10, "source": source, "text": text or source, "base": 10}


@pytest.mark.parametrize(
    "field, source, want",
    [
        ("margin", " about 5% to 7% margin", (" about 5% to 7% margin", 1, 15)), ("margin", "5% forecast", None), ("target_value", "at  least $ 3 million target", ("at  least $ 3 million target", 0, 21)),
        ("forecast_value", "5 to 9 bps forecast", None), ("forecast_value", "2 - 3 days Forecast", ("2 - 3 days Forecast", 0, 10)), ("margin", "5 margins", None), ("margin", "five margin", None), ("other", "5% margin", None), ("margin", "", None),
    ],
)
def test_roles(field, source, want):
    got = C.role_value(claim(field, source))
    assert got == (want and (want[0][want[1] : want[2]], 10 + want[1], want[0][want[1] : want[2]]))


def test_quarters_nearest_amount_wins():
    text = "It was 12 million in Q3 2022. Then 12 in  q4 2023, not 112 in Q1 2020 or 12million in Q1 2019."
    assert [text[a:b] for a, b, _ in C.quarters(text)] == ["12 million in Q3 2022", "12 in  q4 2023", "112 in Q1 2020"]
    at = text.index("not")
    assert C.prior_period(claim("prior_period_value", "not", "12", text, at))[0] == "12 in  q4 2023"
    assert C.prior_period(claim("prior_period_value", "not", "13", text, at)) is None


def test_meetings_and_speakers():
    text = "1 May  Shareholders' Meeting. 2 May Board Meetings"
    assert C.effective_date(claim("effective_date", "1 May", text=text))[0] == "1 May  Shareholders' Meeting"
    assert C.effective_date(claim("effective_date", "2 May", text=text, start=30)) is None
    assert C.speaker(claim("speaker", "chief executive officer  Ada B. King"))[:2] == ("Ada B. King", 35)
    assert C.speaker(claim("speaker", "Chairman Ada King"))[:2] == ("Ada King", 19)
    assert C.speaker(claim("speaker", "CEO King")) is C.speaker(claim("speaker", "CEOs Ada King")) is C.speaker(claim("speaker", "")) is None


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("1" * 1_000_000, "1," * 500_000, " " * 1_000_000, "1 in Q1 2020 " * 80_000):
        C.quarters(text)
        C.role_value(claim("margin", text))
    assert time.time() - began < 5
