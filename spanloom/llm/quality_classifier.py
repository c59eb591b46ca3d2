"""Quality classifier: overlapping heuristic labellers, EM, and a hashed linear scorer.

1. Eight labellers vote good, bad or abstain on each whole text. Counts per vote pattern over
   all documents (at most 3^8 of them) reach the driver, where EM estimates the accuracies.
2. A seeded sample of documents, bounded in rows (``sample_rows``) and in features
   (``sample_slots``, four bytes each), trains a logistic scorer over hashed word, word-shape and
   signal-level features, with the pattern's posterior as target.
3. The scorer rates every document.

Defined results: null text is empty; an empty text is bad by its length vote and gets a score
like any other; repeated rows, and equal texts under unlike ids, get equal scores; very long texts
and words are read whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import documents, id_text
from .quality_rules import STOP_FORMS
from .weak_labels import code, decode, estimate, reliability

LABELLERS = ("length", "symbols", "exclamations", "capitals", "pipes", "stop_words", "word_length", "repeats")


@dataclass(frozen=True)
class Fit:
    sample_rows: int = 20_000
    sample_slots: int = 10_000_000
    bits: int = 15
    passes: int = 8
    rate: float = 0.5
    threshold: float = 0.5
    seed: int = 11


def _drop(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


CAPITALS, SMALL = bytes(range(65, 91)), bytes(range(97, 123))
STOPS = frozenset(STOP_FORMS)


#: Words in a block whose repeated words are counted, so that the share means the same at any length.
BLOCK = 400


def _repeats(words: list[str]) -> float:
    """Share of words repeated in their block, or inside 3-word windows found twice in the text.

    Windows are compared by a 64-bit hash, as in operator 10.
    """
    n = len(words)
    own = 1 - sum(len(set(words[k : k + BLOCK])) for k in range(0, n, BLOCK)) / max(n, 1)
    if n < 4:
        return own
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    w = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return own
    at, inside = np.union1d(order[1:][same], order[:-1][same]), np.zeros(n, dtype=bool)
    inside[at] = inside[at + 1] = inside[at + 2] = True
    return max(own, float(inside.mean()))


def signals(text: str) -> tuple[list[str], list[float]]:
    """Words and eight ratios of a whole text, in C-speed passes."""
    words, raw = text.split(), text.encode()
    n = max(len(words), 1)
    upper, lower = _drop(raw, CAPITALS), _drop(raw, SMALL)
    lines = [x for x in text.split("\n") if x.strip()]
    return words, [
        float(len(words)),
        _drop(raw, b"#*$%&<>") / n,
        _drop(raw, b"!") / n,
        upper / max(upper + lower, 1),
        _drop(raw, b"|") / n,
        sum(map(STOPS.__contains__, words)) / n,
        (len(text) - len(words)) / n,
        max(1 - len(set(lines)) / max(len(lines), 1), _repeats(words)),
    ]


def votes(s: list[float]) -> list[int]:
    """One vote a labeller: 2 good, 1 bad, 0 abstains between the two."""

    def low(x, good, bad):
        return 2 if x <= good else 1 if x >= bad else 0

    return [
        1 if s[0] < 8 else 2 if s[0] >= 80 else 0,
        low(s[1], 0.02, 0.2),
        low(s[2], 0.05, 0.3),
        low(s[3], 0.12, 0.5),
        low(s[4], 0.02, 0.3),
        2 if s[5] >= 0.1 else 1 if s[5] < 0.03 else 0,
        2 if 3.0 <= s[6] <= 8.0 else 1 if s[6] > 12 or s[6] < 2 else 0,
        low(s[7], 0.65, 0.85),
    ]


MARKS = frozenset(",.;:!?")


def _shape(word: str) -> str:
    """Letters as x or X, digits as 9, runs of one character squeezed."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", re.sub(r"\d", "9", word)))


class _Slots(dict):
    """Feature slots of a word and of its shape (letter cases, digits, marks, runs squeezed), both in
    one number, so that a text's words become an array at C speed."""

    def __init__(self, bits: int):
        super().__init__()
        self.bits, self.mask = bits, (1 << bits) - 1

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        # Most words are small letters, perhaps with a capital first or a mark behind.
        core, mark = (word[:-1], word[-1]) if word[-1] in MARKS else (word, "")
        shape = mark
        if core.isalpha():
            shape = ("x" if core.islower() else "X" if core.isupper() else "Xx" if core[0].isupper() and core[1:].islower() else _shape(core)) + mark
        elif core:
            shape = _shape(word)
        own, like = zlib.crc32(b"w" + word.lower().encode()) & self.mask, zlib.crc32(b"s" + shape.encode()) & self.mask
        self[word] = out = own << self.bits | like
        return out


def slots(words: list[str], s: list[float], cache: _Slots) -> np.ndarray:
    """The text's slots, each once, in order."""
    kinds = set(words)
    both = np.fromiter(map(cache.__getitem__, kinds), dtype=np.int64, count=len(kinds))
    levels = [zlib.crc32(b"l%d:%d" % (i, int(np.log2(x + 1)) if i == 0 else int(min(x, 1.5) * 12))) & cache.mask for i, x in enumerate(s)]
    return np.unique(np.concatenate([both >> cache.bits, both & cache.mask, levels]))


def pattern_counts(docs: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows, and words of all of them, per vote pattern."""

    def run(batches):
        for pdf in batches:
            rows = [signals(t) for t in pdf.text]
            each = pd.DataFrame({"p": [code(votes(s)) for _, s in rows], "n": 1, "w": [len(w) for w, _ in rows]})
            yield each.groupby("p", as_index=False).sum()

    counted = id_text(docs).select("text").mapInPandas(run, "p long, n long, w long")
    return {r["p"]: (r["n"], r["w"]) for r in counted.groupBy("p").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()}


@dataclass
class Model:
    #: One weight a slot, the bias last.
    weights: np.ndarray
    #: Estimated chance that a labeller's vote is right, where it votes.
    accuracy: dict[str, float | None]
    #: Vote pattern -> chance of being good.
    posterior: dict[int, float]


def train(docs: DataFrame, fit: Fit = Fit()) -> Model:
    counts = pattern_counts(docs)
    codes = np.array(sorted(counts), dtype=np.int64)
    patterns = decode(codes, len(LABELLERS))
    post, chances, share = estimate(patterns, np.array([counts[c][0] for c in codes], dtype=float), prior=0.8)
    if not counts:  # an empty table
        return Model(np.zeros((1 << fit.bits) + 1), {}, {})
    accuracy = dict(zip(LABELLERS, reliability(chances, share)))
    target_of = dict(zip(codes.tolist(), post.tolist()))
    total, words = (sum(v) for v in zip(*counts.values()))
    weights = np.zeros((1 << fit.bits) + 1)
    # A word brings two slots at most, a text eight more.
    part = min(1.0, fit.sample_rows / total, fit.sample_slots / (2 * words + 8 * total))
    picked = id_text(docs).where(F.pmod(F.xxhash64("doc_id", "text", F.lit(fit.seed)), F.lit(1_000_000)) < int(part * 1_000_000))

    def run(batches):
        cache = _Slots(fit.bits)
        for pdf in batches:
            rows = [signals(t) for t in pdf.text]
            xs = [slots(w, s, cache) for w, s in rows]
            yield pd.DataFrame({"p": [code(votes(s)) for _, s in rows], "h": [zlib.crc32(x.tobytes()) for x in xs], "x": xs})

    sample = picked.select("doc_id", "text").mapInPandas(run, "p long, h long, x array<int>").toPandas()
    order = np.lexsort((sample["h"], sample["x"].str.len(), sample["p"]))
    y = np.array([target_of[p] for p in sample["p"]])[order]
    xs = [np.asarray(x, dtype=np.int64) for x in sample["x"].iloc[order]]
    squares, rng = np.full(len(weights), 1e-2), np.random.default_rng(fit.seed)
    for _ in range(fit.passes):
        mixed = rng.permutation(len(xs))
        for k in range(0, len(mixed), 64):
            rows = mixed[k : k + 64]
            at = np.concatenate([xs[r] for r in rows])
            size = np.array([len(xs[r]) for r in rows])
            owner, scale = np.repeat(np.arange(len(rows)), size), 1 / np.sqrt(np.maximum(size, 1))
            z = np.bincount(owner, weights[at] * scale[owner], minlength=len(rows)) + weights[-1]
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]
            step = np.bincount(at, (g * scale)[owner], minlength=len(weights))
            step[-1] = g.sum()
            squares += step * step
            weights -= fit.rate * step / np.sqrt(squares)
    return Model(weights, accuracy, target_of)


def score_documents(docs: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id, score (0 to 1, higher is better), vote pattern and kept, for every row."""
    weights = train(docs, fit).weights

    @pandas_udf("struct<score: double, pattern: long>")
    def rate(batches: pd.Series) -> pd.DataFrame:
        cache, out = _Slots(fit.bits), []
        for t in batches:
            w, s = signals(t)
            at = slots(w, s, cache)
            z = weights[at].sum() / np.sqrt(max(len(at), 1)) + weights[-1]
            out.append((1 / (1 + np.exp(-np.clip(z, -30, 30))), code(votes(s))))
        return pd.DataFrame(out, columns=["score", "pattern"])

    rated = id_text(docs).select("doc_id", rate("text").alias("r"))
    return rated.select("doc_id", F.col("r.score").alias("score"), F.col("r.pattern").alias("pattern"), (F.col("r.score") >= fit.threshold).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
