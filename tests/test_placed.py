"""Words and cells as rows, found by one pattern a block, against a plain search."""

import random

from pyspark.sql import functions as F
from test_alignment import WORDS, found, plain

from spanloom import registry
from spanloom.operators import layout as L

OFFSETS = ("start_char", "end_char", "start_byte", "end_byte")


def odd_pages():
    """Texts and words full of marks, quotes, groups and characters of all widths."""
    r = random.Random(11)
    pieces = ["\0", "\0\0", "\1", "\\E", "\\Q", "\\", "E", "$1", "(", ")", ".*", "a", "é", "€", "😀", "\n", " ", "\r\n", "1"]
    given = []
    for _ in range(200):
        text = "".join(r.choices(pieces, k=r.randint(0, 400)))
        given.append((text, r.choices(pieces, k=r.choice([0, 1, 3, 10, L.BLOCK, L.BLOCK + 1]))))
    for _ in range(60):  # blocks far apart, of which the text close by holds a part
        words = ["".join(r.choices(pieces, k=3)) for _ in range(r.choice([L.BLOCK, 2 * L.BLOCK + 1]))]
        given.append(("".join("é" * r.choice([0, 1, 90]) + w for w in words), words))
    many = ["ab", "é"] * (L.MOST * L.BLOCKS // 64)
    given += [(" ".join(many), many), (None, []), ("a", [None, "a"]), ("a", ["a", ""]), ("\\E", ["\\E"]), ("a\0", ["a", "\0"]), ("\1\0\1", ["\1", "\0", "\1"])]
    return given


def test_odd_pages_as_arrays(spark):
    given = odd_pages()
    assert found(spark, given) == {i: plain(t, w) for i, (t, w) in enumerate(given)}


def test_odd_pages_as_rows(spark):
    given = odd_pages()
    d = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(given)], "i long, " + WORDS)
    got = {}
    for r in L.placed(d, "t", "w").collect():
        got.setdefault(r["i"], []).append((r["at"], r["part"], *[r[n] for n in OFFSETS]))
    want = {i: [(k, w[k], *s) for k, s in enumerate(plain(t, w) or [])] or [(None,) * 6] for i, (t, w) in enumerate(given)}
    assert {i: sorted(x) for i, x in got.items()} == want


def test_cells_as_rows_equal_cells_as_arrays(spark):
    text = "n é 1 2 3 4 5 6"
    tables = [[["n", "é"], ["1", "2"], [], ["3", "4", "5"]], [["n", "", "é"], ["1", "2"]], None, [None, ["n"]], [["6", "n"]], [[], ["n", "é"]], [["n"], [None]]]
    d = spark.createDataFrame([(i, text, t) for i, t in enumerate(tables)] + [(9, None, None)], "i long, t string, c array<array<string>>")
    names = ("row_index", "column_index", "start_char", "end_char", "header_labels")
    got = sorted((tuple(r[n] for n in ("i", *names)) for r in L.placed_cells(d, "t", "c").collect()), key=str)
    each = d.select("i", F.explode_outer(L.aligned_cells()("t", "c")).alias("x")).select("i", *[f"x.{n}" for n in names])
    assert got == sorted((tuple(r) for r in each.collect()), key=str) and len(got) > 12


def test_words_are_made_once_and_leave_the_row_in_blocks(spark):
    for name in ("word_alignment", "cell_alignment"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(text") == 1 and "posexplode(_blocks" in plan and "locate" not in plan
