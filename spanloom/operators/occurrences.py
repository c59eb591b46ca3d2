"""Many values in one text at once: an Aho-Corasick automaton over all values of a text.

Values are grouped by the text they belong to and meet it once, as a row of the text and an array of
values; so a join copies a text per group of values, not per value, and the text is read once however
many values it has. Groups hold MOST values at most: a text that a third of all values ask about is
dealt to many rows.

A place is found in four steps, each for the values that the steps before it found nowhere: as
written, with overlaps; without its outer blanks; in any case, without overlaps; with runs of blanks
as one. A step is one automaton over all values that are left.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

PLACES = "array<struct<start: bigint, end: bigint>>"
#: Values of a text that one row holds.
MOST = 2048
#: Characters of needles in one automaton that is streamed past all texts.
NEEDLE_CHARS = 4 << 20


def found_in(text: str, words: dict[str, list[int]]) -> dict[str, list[int]]:
    """Starts of every word in the text, overlaps and words inside words included."""
    auto = ahocorasick.Automaton()
    for w in words:
        auto.add_word(w, w)
    out = defaultdict(list)
    if len(auto):
        auto.make_automaton()
        for end, w in auto.iter(text):
            out[w].append(end - len(w) + 1)
    return out


def _loose(text: str) -> str:
    """One character for each, equal where two characters may match in any case."""
    return text.lower() if text.isascii() else "".join(c.casefold()[0] for c in text)


class _Respaced:
    """A text with one blank between words, and the way back."""

    def __init__(self, text: str):
        self.words = [m.span() for m in re.finditer(r"\S+", text)]
        self.starts, size = [], 0
        for a, b in self.words:
            self.starts.append(size)
            size += b - a + 1
        self.text = " ".join(text[a:b] for a, b in self.words)

    def back(self, k: int) -> int:
        w = bisect_right(self.starts, k) - 1
        return self.words[w][0] + k - self.starts[w]


def locate(text: str | None, values: list[str | None]) -> list[list[tuple[int, int]]]:
    """Places of each value by the four steps; none in a null text or of a null or empty value."""
    out: list[list[tuple[int, int]]] = [[] for _ in values]
    open_ = defaultdict(list)
    for i, v in enumerate(values):
        if v and text:
            open_[v].append(i)

    def settle(value: str, spans: list[tuple[int, int]]) -> None:
        for i in open_.pop(value) if spans else ():
            out[i] = spans

    def asked(form) -> dict[str, list[str]]:
        by = defaultdict(list)
        for v in open_:
            if w := form(v):
                by[w].append(v)
        return by

    both = asked(lambda v: v)
    for v in list(open_):
        if bare := v.strip():
            both[bare]  # noqa: B018  a form to search, too
    starts = found_in(text or "", both)
    for v in list(open_):
        w = v if starts.get(v) else v.strip()
        settle(v, [(a, a + len(w)) for a in starts.get(w, ())])
    by = asked(_loose)
    for w, at in found_in(_loose(text or "") if by else "", by).items():
        for v in by[w]:
            exact, spans = re.compile(re.escape(v), re.IGNORECASE), []
            for a in at:
                if (not spans or a >= spans[-1][1]) and exact.match(text, a):
                    spans.append((a, a + len(v)))
            settle(v, spans)
    by = asked(lambda v: " ".join(v.split()) if any(c.isspace() for c in v) else "")
    if by:
        flat = _Respaced(text)
        for w, at in found_in(flat.text, by).items():
            spans = [(flat.back(a), flat.back(a + len(w) - 1) + 1) for a in at]
            for v in by[w]:
                settle(v, spans)
    return out


def places() -> Column:
    """(text, array of values) to an array with the places of each."""

    @arrow_udf(f"array<{PLACES}>")
    def run(texts: pa.Array, values: pa.Array) -> pa.Array:
        found = [[[{"start": a, "end": b} for a, b in spans] for spans in locate(t.as_py(), v.as_py() or [])] for t, v in zip(texts, values)]
        return pa.array(found, pa.list_(pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))

    return run


def beside(rows: DataFrame, texts: DataFrame, by: list[str], most: int = MOST, how: str = "inner") -> DataFrame:
    """``texts`` (distinct by ``by``) with ``rows``: an array of structs of each one's rows, ``most`` at most.

    Rows are counted per key before, and a key with more is dealt by a hash of its rows.
    """
    cols = [c for c in rows.columns if c not in by]
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    dealt = rows.join(n, by).withColumn("_part", F.pmod(F.xxhash64(*cols), F.ceil(F.col("_n") / most)))
    grouped = dealt.groupBy(*by, "_part").agg(F.collect_list(F.struct(*cols)).alias("rows")).drop("_part")
    return grouped.join(texts.dropDuplicates(by), by, how)


def value_places(values: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """Each row of ``values`` (a column ``value``) with the places of its value in the text of its key."""
    g = beside(values, texts.select(*by, "text"), by)
    g = g.withColumn("found", places()("text", F.transform("rows", lambda r: r["value"])))
    each = g.select(*by, F.explode(F.arrays_zip("rows", "found")).alias("z"))
    return each.select(*by, "z.rows.*", F.col("z.found").alias("places"))


def documents_with(needles: DataFrame, texts: DataFrame, most_chars: int = NEEDLE_CHARS) -> DataFrame:
    """needle (its text) and n, the number of rows of ``texts`` that hold it; needles in none are left out.

    The needles, whatever their lengths, form one automaton that is streamed past the texts: no join,
    no window is ever made. They come in blocks of ``most_chars`` characters, so what a task holds is
    bounded; each block is a pass over the texts.
    """
    spark, out = texts.sparkSession, None

    def passed(block: list[str]) -> DataFrame:
        def run(batches):
            auto = ahocorasick.Automaton()
            for i, w in enumerate(block):
                auto.add_word(w, i)
            auto.make_automaton()
            n = defaultdict(int)
            for batch in batches:
                for t in batch.column(0):
                    for i in {i for _, i in auto.iter(t.as_py() or "")}:
                        n[i] += 1
            yield pa.RecordBatch.from_pydict({"needle": [block[i] for i in n], "n": list(n.values())}, pa.schema([("needle", pa.string()), ("n", pa.int64())]))

        return texts.select("text").mapInArrow(run, "needle string, n long")

    block, size = [], 0
    for r in needles.select("needle").where("needle <> ''").distinct().toLocalIterator():
        block.append(r["needle"])
        size += len(r["needle"])
        if size >= most_chars:
            out = passed(block) if out is None else out.unionByName(passed(block))
            block, size = [], 0
    if block:
        out = passed(block) if out is None else out.unionByName(passed(block))
    if out is None:
        return spark.createDataFrame([], "needle string, n long")
    return out.groupBy("needle").agg(F.sum("n").alias("n"))
