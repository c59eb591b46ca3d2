"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon, second-person words near its hits, capitals,
punctuation and obfuscation rates. The lexicon is a small fixed list plus words and word
beginnings that the labelled training rows show to mark toxic texts. Trees and lexicon are
fitted on a bounded, seeded sample (``sample_rows``) of labelled rows outside the held-out
fold. A quarter of that sample, split off before anything is learnt, only calibrates.

Defined results: null text is empty and gets the score of a text without any hit; without
labels of both kinds the score is a fixed one for texts with and without lexicon hits; a doc_id
labelled twice counts as toxic if one label says so; unlike texts of one labelled id all carry its
label; repeated rows get equal scores; rows without doc_id are scored and never held out; very
long texts, with or without blanks, are read whole in linear time; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import documents, forget, id_text, materialize
from .quality_classifier import _drop

#: Insults the lexicon starts from, and second-person words.
SEEDS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown".split()
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú ti tus".split())
LEET = str.maketrans("013457@$!|", "oieastasii")
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters with marks between them, and where a run without blanks ends.
HIDDEN, BLANK = re.compile(r"[a-z][0-9@$!|*._-]+[a-z]"), re.compile(r"\s")
#: Longest word whose verdict is kept.
KEPT_WORD = 64
FEATURES = 14


@dataclass(frozen=True)
class Fit:
    sample_rows: int = 16_000
    lexicon_rows: int = 6_000
    lexicon_size: int = 400
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    threshold: float = 0.3
    seed: int = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class _Hits(dict):
    """Whether a word (or its first four or five letters) is in the lexicon."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        x = self.lexicon
        out = int(w in x or f"{w[:4]}-" in x or f"{w[:5]}-" in x)
        if len(w) <= KEPT_WORD:
            self[w] = out
        return out


def hidden_pieces(low: str):
    """Runs without blanks that hold marks between letters. Each run is looked at once, so a text
    without blanks takes time in proportion to its length."""
    done = 0
    while found := HIDDEN.search(low, done):
        a, end = found.start(), BLANK.search(low, found.end())
        while a > done and not low[a - 1].isspace():
            a -= 1
        done = end.start() if end else len(low)
        yield low[a:done]


def features(text: str, hits: _Hits) -> list[float]:
    low = text.lower()
    words = LETTERS.findall(low)
    n = max(len(words), 1)
    marks = np.fromiter(map(hits.__getitem__, words), dtype=np.int8, count=len(words))
    at = np.flatnonzero(marks)
    near = 0
    for i in at:
        near += any(w in SECOND for w in words[max(0, i - 4) : i + 5])
    hidden = 0
    for piece in hidden_pieces(low):
        plain = re.sub(r"[^a-zß-ÿ]", "", piece.translate(LEET))
        hidden += bool(plain) and hits[plain] and piece.strip(".,!?;:") != plain
    raw = text.encode()
    letters = set(text)
    upper = sum(text.count(c) for c in letters if c.isupper())
    lower = sum(text.count(c) for c in letters if c.islower())
    kinds = {words[i] for i in at}
    return [
        float(len(at)), len(at) / n, float(len(kinds)), len(kinds) / n, float(near), near / n,
        upper / max(upper + lower, 1), _drop(raw, b"!") / n, _drop(raw, b"?") / n, _drop(raw, b"#*$%&<>|@") / n,
        float(hidden), hidden / n, float(np.log1p(n)), sum(map(len, words)) / n,
    ]


def learn_lexicon(texts: DataFrame, size: int) -> frozenset[str]:
    """Words and beginnings ("abcd-") far more frequent in toxic texts, at most ``size`` of them."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^\\p{L}]+", -1), lambda w: F.length(w) > 3))
    begun = F.flatten(F.transform(words, lambda w: F.array(w, F.concat(F.substring(w, 1, 4), F.lit("-")), F.concat(F.substring(w, 1, 5), F.lit("-")))))
    seen = texts.select("toxic", F.explode(F.array_distinct(begun)).alias("w")).groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    total = texts.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    pos, neg = total["p"] or 0, total["n"] or 0
    if not pos or not neg:
        return frozenset(SEEDS)
    least = max(3, int(0.01 * pos))
    ratio = (F.col("p") / pos) / ((F.col("n") + 0.5) / neg)
    top = seen.where((F.col("p") >= least) & (ratio >= 30)).orderBy(F.desc("p"), "w").limit(size).collect()
    return frozenset(SEEDS) | {r["w"] for r in top}


class Boosted:
    """Histogram gradient boosting for the logistic loss; plain arrays, so it ships to workers."""

    def __init__(self, trees: int, depth: int, rate: float):
        self.n_trees, self.depth, self.rate = trees, depth, rate
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.cuts = 0.0, []

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 32))) for j in range(x.shape[1])]
        for j in range(x.shape[1]):  # rare non-zero values lie beyond the quantiles
            some = x[x[:, j] > x[:, j].min(), j] if len(x) else x[:, j]
            if len(some):
                self.cuts[j] = np.unique(np.concatenate([self.cuts[j], np.quantile(some, np.linspace(0, 0.9, 10))]))
        b, p = self._bins(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, q * (1 - q)
            nodes = 2 ** (self.depth + 1) - 1
            feat, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            where = np.zeros(len(y), dtype=int)
            for node in range(nodes):
                rows = np.flatnonzero(where == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = self.rate * gs / (hs + 1.0)
                if 2 * node + 2 >= nodes or len(rows) < 40:
                    continue
                best = (1e-6, -1, 0)
                for j, c in enumerate(self.cuts):
                    gl = np.cumsum(np.bincount(b[rows, j], g[rows], minlength=len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, j], h[rows], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
                if best[1] < 0:
                    continue
                feat[node], cut[node] = best[1], self.cuts[best[1]][best[2]]
                where[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
            self.trees.append((feat, cut, value))
            z += value[where]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feat[node]
                go = x[np.arange(len(x)), np.maximum(f, 0)] >= cut[node]
                node = np.where(f >= 0, 2 * node + 1 + go, node)
            z += value[node]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their non-decreasing levels."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(z[order], y[order]):
        blocks.append([a, a, float(b), 1.0])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3] or blocks[-2][1] == blocks[-1][0]):
            lo = blocks.pop()
            blocks[-1] = [blocks[-1][0], lo[1], blocks[-1][2] + lo[2], blocks[-1][3] + lo[3]]
    knots = np.array([v for x in blocks for v in (x[0], x[1])])
    levels = np.array([(x[2]) / x[3] for x in blocks for _ in (0, 1)])
    return knots, levels


class Model:
    def __init__(self, lexicon: frozenset[str], trees: Boosted | None, knots=None, levels=None):
        self.lexicon, self.trees, self.knots, self.levels = lexicon, trees, knots, levels

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.where(x[:, 0] > 0, 0.9, 0.05)
        z = self.trees.raw(x)
        # A thousandth of the uncalibrated value keeps the order inside a level.
        return 0.999 * np.interp(z, self.knots, self.levels) + 0.001 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    total = marks.count()
    part = min(1.0, fit.sample_rows / max(total, 1))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(fit.seed)), F.lit(1_000_000))
    # Bounded by sample_rows (8 to 12 bytes a row), so small enough to send to every task.
    some = materialize(marks.where(chance < int(part * 1_000_000)), "tox-sample")
    rows = id_text(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text", F.lit(fit.seed))).withColumn("last", F.pmod("h", F.lit(4)) == 0)
    rows = materialize(rows, "tox-texts")
    narrow = rows.where(~F.col("last")).where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(min(1.0, fit.lexicon_rows / max(part * total, 1)) * 1_000_000))
    lexicon = learn_lexicon(narrow.select("text", "toxic"), fit.lexicon_size)

    def run(batches):
        hits = _Hits(lexicon)
        for pdf in batches:
            yield pd.DataFrame({"h": pdf.h, "last": pdf["last"], "y": pdf.toxic, "x": [features(t, hits) for t in pdf.text]})

    got = rows.mapInPandas(run, "h long, last boolean, y int, x array<double>").toPandas().sort_values(["h", "y"])
    forget(some, rows)
    x, y = np.array(got["x"].tolist(), dtype=float).reshape(-1, FEATURES), got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None)
    last = got["last"].to_numpy(bool)
    if y[last].max(initial=0) == y[last].min(initial=1) or y[~last].max(initial=0) == y[~last].min(initial=1):
        last = np.zeros(len(y), dtype=bool)  # too few rows to split: trees and levels share them
    trees = Boosted(fit.trees, fit.depth, fit.rate).fit(x[~last], y[~last])
    on = last if last.any() else ~last
    return Model(lexicon, trees, *isotonic(trees.raw(x[on]), y[on]))


def score_documents(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    model = train(docs, labels, fit)

    @pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        hits = _Hits(model.lexicon)
        x = np.array([features(t, hits) for t in texts], dtype=float).reshape(-1, FEATURES)
        return pd.Series(model.score(x))

    rated = id_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rate("text").alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= fit.threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
