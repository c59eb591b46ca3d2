"""Packing by cutting-stock column generation.

1. Tokenize each whole text, append the end id, cut whole 2048-token pieces off the front. A
   whole piece is a sequence of its own and needs no rank.
2. Round tail lengths up to classes of 8 tokens; count them (256 counts reach the driver).
3. Solve the cutting-stock linear program over fill patterns: a revised simplex on the driver,
   whose columns come from an unbounded knapsack dynamic program over the dual prices. Demands
   are perturbed, so no step is degenerate and none can cycle; it ends at the optimum, or where
   its own lower bound proves that less than a ten-thousandth of the sequences could be saved.
4. Round the pattern uses down; a first-fit-decreasing pass covers the few remaining tails.
5. Rank the tails of a class and find their rank in the pattern table by binary search: that gives
   the sequence and the slot. Offsets are running sums of true lengths inside a sequence.

Ranks are taken in hash ranges of about RANGE_ROWS rows, so that no task gets a whole hot class.

Defined results: null and empty texts give one piece with the end id alone; repeated rows, and rows
without doc_id, are packed as separate documents, told apart by the number of their written row;
very long texts are cut into as many pieces as they fill; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import documents, id_text, materialize, numbered

CAPACITY, GRAIN, END_ID, RANGE_ROWS = 2048, 8, 1, 16_384
#: Words kept in the tokenizer's cache, per generation and worker.
CACHED_WORDS = 250_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class WordIds(dict):
    """Ids (as bytes) of lower-cased blank-separated words. No pre-token of this tokenizer spans
    a blank, so a text's ids are its words' ids in order. Two generations bound the memory."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.old = self.tokenizer.model, {}
        self.letters, self.easy = _byte_letters(), re.compile("[a-zß-öø-ÿ]+")

    def __missing__(self, word: bytes) -> bytes:
        tail = word[-1:]
        if tail in (b",", b".") and word[-2:-1].isalpha():  # an ASCII letter, then one mark
            return self[word[:-1]] + self[tail]
        found = self.old.get(word)
        if found is None:
            text = word.decode().lower()
            if self.easy.fullmatch(text):
                coded = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
                found = array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
            else:
                found = self.slow(word.decode())
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def slow(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if "<|" in text:  # could hold a special token, which is matched before lower-casing
            return self.slow(text)
        return b"".join(map(self.__getitem__, text.encode().lower().split()))


def tokenized_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece, cut at multiples of the capacity."""

    def run(batches):
        words, end = WordIds(tokenizer_path), array("I", [END_ID]).tobytes()
        step = CAPACITY * 4
        for pdf in batches:
            out = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                ids = words.ids(text) + end
                n = len(ids) // 4
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    out.append((doc, k // 4, len(part) // 4, zlib.crc32(part), n))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return id_text(docs).mapInPandas(run, PIECES)


def _knapsack(price: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Best fill of ``size`` units; class c (1..size) costs c units and brings price[c]."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, dtype=int)
    for room in range(1, size + 1):
        values = price[1 : room + 1] + best[room - 1 :: -1][:room]
        c = int(values.argmax()) + 1
        if values[c - 1] > best[room - 1] + 1e-12:
            best[room], took[room] = values[c - 1], c
        else:
            best[room] = best[room - 1]
    use, room = np.zeros(size + 1, dtype=int), size
    while room > 0:
        if took[room]:
            use[took[room]] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[size]), use


def cutting_stock(counts: dict[int, int], size: int, gap: float = 1e-4) -> tuple[list[tuple[dict[int, int], int]], float]:
    """([(class -> pieces in one sequence, sequences)], lower bound); every counted piece gets a slot.

    The bound holds for any packing of these classes: prices that no pattern beats by more than a
    factor v make price . need / v of sequences unavoidable. Each simplex step lowers the perturbed
    objective, so no basis comes twice and the loop ends.
    """
    classes = sorted(c for c, n in counts.items() if n > 0)
    if not classes:
        return [], 0.0
    real = np.array([counts[c] for c in classes], dtype=float)
    m = len(classes)
    # Unlike tiny surpluses, in no simple ratio, keep every basic amount above nought.
    need = real * (1 + 1e-9) + 1e-6 * (1 + np.random.default_rng(17).random(m))
    columns = [np.eye(m)[:, i] * (size // c) for i, c in enumerate(classes)]
    costs = np.ones(m)
    inverse = np.diag([1.0 / (size // c) for c in classes])
    # Plain elementwise sums: these arrays are too small to be worth a threaded BLAS.
    x, bound = (inverse * need).sum(axis=1), 0.0
    while True:
        dual = inverse[costs > 0].sum(axis=0)
        if dual.min() < -1e-9:  # a slot may stay unused: column -e, cost 0
            i = int(dual.argmin())
            column, cost = -np.eye(m)[:, i], 0.0
        else:
            price = np.zeros(size + 1)
            price[classes] = np.maximum(dual, 0)
            value, use = _knapsack(price, size)
            bound = max(bound, float((price[classes] * real).sum() / max(value, 1.0)))
            if value <= 1 + 1e-9 or float(x[costs > 0].sum()) <= bound * (1 + gap):
                break
            column, cost = use[classes].astype(float), 1.0
        way = (inverse * column).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            ratio = np.where(way > 1e-9, x / way, np.inf)
        out = int(ratio.argmin())
        columns[out], costs[out] = column, cost
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        x = (inverse * need).sum(axis=1)
    left = {c: counts[c] for c in classes}
    plan: list[tuple[dict[int, int], int]] = []
    for column, cost, amount in sorted(zip(columns, costs, x), key=lambda p: -p[2]):
        use = {c: round(a) for c, a in zip(classes, column) if a > 0.5}
        times = min([int(max(amount, 0)), *(left[c] // a for c, a in use.items())]) if cost else 0
        if times > 0:
            plan.append((use, times))
            for c, a in use.items():
                left[c] -= a * times
    while any(left.values()):  # first fit, largest first, whole groups of equal sequences at once
        use, room = {}, size
        for c in reversed(classes):
            fits = min(left[c], room // c)
            if fits:
                use[c], room = fits, room - fits * c
        times = min(left[c] // a for c, a in use.items())
        plan.append((use, times))
        for c, a in use.items():
            left[c] -= a * times
    return plan, bound


def _slots(plan) -> list[tuple]:
    """(class, first rank, end rank, first sequence, pieces a sequence, first slot)."""
    rows, rank, sequence = [], {}, 0
    for use, times in plan:
        slot = 0
        for c in sorted(use, reverse=True):
            lo = rank.get(c, 0)
            rank[c] = lo + use[c] * times
            rows.append((c, lo, rank[c], sequence, use[c], slot))
            slot += use[c]
        sequence += times
    return rows


def _placed(plan):
    """A function from (class, rank) to (sequence, slot): a binary search in the class's patterns."""
    table: dict[int, list[tuple]] = {}
    for c, *rest in _slots(plan):
        table.setdefault(c, []).append(rest)
    found = {c: np.array(rows, dtype=np.int64).reshape(-1, 5) for c, rows in table.items()}  # in rank order

    @pandas_udf("struct<sequence: long, slot: long>")
    def place(classes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, slot = np.zeros(len(classes), dtype=np.int64), np.zeros(len(classes), dtype=np.int64)
        kinds, rank = classes.to_numpy(), ranks.to_numpy()
        for c in np.unique(kinds):
            at = np.flatnonzero(kinds == c)
            lo, _, first, per, start = found[int(c)].T
            row = np.searchsorted(lo, rank[at], side="right") - 1
            past = rank[at] - lo[row]
            sequence[at], slot[at] = first[row] + past // per[row], start[row] + past % per[row]
        return pd.DataFrame({"sequence": sequence, "slot": slot})

    return place


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: its place in the document and in a sequence of at most 2048 ids."""
    pieces = numbered(tokenized_pieces(docs, tokenizer_path or default_tokenizer()), "pack-pieces", "row")
    tails = pieces.where(F.col("length") < CAPACITY).withColumn("class", F.expr(f"cast((length + {GRAIN - 1}) div {GRAIN} as int)"))
    counts = {r["class"]: r["n"] for r in tails.groupBy("class").agg(F.count("*").alias("n")).collect()}  # 256 rows at most
    plan, _ = cutting_stock(counts, CAPACITY // GRAIN)
    ranges = max(1, -(-max(counts.values(), default=0) // RANGE_ROWS))
    salted = tails.withColumn("range", F.pmod(F.xxhash64("row"), F.lit(ranges)).cast("int"))
    sizes = salted.groupBy("class", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("class").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = salted.withColumn("r", F.row_number().over(W.partitionBy("class", "range").orderBy("row")) - 1)
    ranked = ranked.join(sizes.select("class", "range", before.alias("b")), ["class", "range"]).withColumn("rank", F.col("r") + F.col("b"))
    placed = ranked.withColumn("p", _placed(plan)("class", "rank")).withColumn("sequence_id", F.col("p.sequence"))
    inside = W.partitionBy("sequence_id").orderBy("p.slot").rowsBetween(W.unboundedPreceding, -1)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    placed = placed.select(*cols, F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    # A whole piece is called by its row, past the numbers of the plan.
    full = pieces.where(F.col("length") == CAPACITY).withColumn("sequence_id", F.col("row") + F.lit(sum(n for _, n in plan)).cast("long"))
    return placed.unionByName(full.select(*cols, F.lit(0).cast("long").alias("offset")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
