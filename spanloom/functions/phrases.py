"""Reading of quantities and phrases from a place in a text: each reader gives the place behind what
it read, and reads a character once. Words are told apart without case; blanks between them may be of any length."""

from __future__ import annotations

#: Words of quantities.
CURRENCIES = "$€£"
SHARES = ("%", "percent")
RATES = ("%", "percent", "basis points", "bps")
MAGNITUDES = ("million", "billion", "thousand")
UNITS = ("million", "billion", "thousand", "gigawatt-hours", "megawatt-hours", "gigawatts", "megawatts", "hours", "days", "months", "years")


def blanks(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def phrase(text: str, at: int, words: str) -> int:
    """Behind the phrase, or -1."""
    for i, word in enumerate(words.casefold().split()):
        start = blanks(text, at) if i else at
        if (i and start == at) or text[start : start + len(word)].casefold() != word:
            return -1
        at = start + len(word)
    return at


def maybe(text: str, at: int, phrases: tuple[str, ...], gap: int = 1) -> int:
    """Behind the longest of the phrases that follows at least ``gap`` blanks; ``at`` if none does."""
    start = blanks(text, at)
    return max([at] + [phrase(text, start, p) for p in phrases]) if start - at >= gap else at


def ends_word(text: str, at: int) -> bool:
    return not (at < len(text) and (text[at].isalnum() or text[at] == "_"))


def amount(text: str, at: int) -> int:
    """Behind a number with commas and a fraction, a currency before it or not; or -1."""
    if at < len(text) and text[at] in CURRENCIES:
        at = blanks(text, at + 1)
    if at >= len(text) or not text[at].isdecimal():
        return -1
    while at < len(text) and (text[at].isdecimal() or text[at] == ","):
        at += 1
    end = at + 1
    while text[at : at + 1] == "." and end < len(text) and text[end].isdecimal():
        end += 1
    return end if end > at + 1 else at


def quantity(text: str, at: int, rates: tuple[str, ...] = RATES) -> int:
    """Behind an amount with its rate and unit, if it has them; or -1."""
    end = amount(text, at)
    return maybe(text, maybe(text, end, rates, 0), UNITS) if end >= 0 else -1


def amount_before(text: str, end: int) -> int:
    """Where the amount begins that ends at ``end``, or -1: a reading backwards."""
    a = end
    while a and (text[a - 1].isdecimal() or text[a - 1] in ",."):
        a -= 1
    parts = text[a:end].split(".")
    whole = parts[-2].lstrip(",") if len(parts) > 1 and parts[-1].isdecimal() else ""
    size = len(whole) + 1 + len(parts[-1]) if whole else len(parts[-1].lstrip(","))
    if not size:
        return -1
    start = b = end - size
    while b and text[b - 1].isspace():
        b -= 1
    return b - 1 if b and text[b - 1] in CURRENCIES else start
