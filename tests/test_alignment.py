"""Words and cells found in their page's text, against a plain search."""

import random
import time

from conftest import rows
from pyspark.sql import functions as F

from spanloom import oracles, registry
from spanloom.operators import layout as L

WORDS = "t string, w array<string>"


def plain(text, words):
    """Each word looked for behind the one before; None if one is missing or empty."""
    out, at = [], 0
    for w in words or []:
        start = (text or "").find(w, at) if w else -1
        if start < 0:
            return None
        at = start + len(w)
        out.append((start, at, len(text[:start].encode()), len(text[:at].encode())))
    return out


def found(spark, given):
    d = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(given)], "i long, " + WORDS)
    got = d.select("i", L.aligned_words()("t", "w").alias("s")).collect()
    return {r["i"]: None if r["s"] is None else [tuple(s) for s in r["s"]] for r in got}


def test_words_equal_a_plain_search(spark):
    r = random.Random(5)
    pieces = ["a", "ab", "é", "b", "aa", " ", "\n", "€€", "😀", "ba"]
    given = []
    for _ in range(300):
        text = "".join(r.choices(pieces, k=r.randint(0, 1500)))
        given.append((text, r.choices([p for p in pieces if p.strip()], k=r.choice([0, 1, 5, L.BLOCK - 1, L.BLOCK, L.BLOCK + 1]))))
    given += [(None, []), (None, None), ("a", None), ("a", [""]), ("a", [None]), ("", ["a"]), ("aaa", ["aa", "a", "a"])]
    assert found(spark, given) == {i: plain(t, w) for i, (t, w) in enumerate(given)}


def test_blocks_end_anywhere(spark):
    given = [(" ".join(["xy"] * n), ["xy"] * m) for n in (L.BLOCK - 1, L.BLOCK, L.BLOCK + 1, 2 * L.BLOCK, 2 * L.BLOCK + 1) for m in (n, n + 1)]
    got = found(spark, given)
    assert got == {i: plain(t, w) for i, (t, w) in enumerate(given)} and got[1] is None


def test_long_texts_are_read_whole(spark):
    text = "é word " * 150_000
    begun = time.time()
    got = found(spark, [(text, text.split()), (text, text.split() + ["nowhere"]), ("a" * 1_000_000, ["a"] * 20_000)])
    assert len(got[0]) == 300_000 and got[0][-1][1] == len(text) - 1 and got[1] is None and len(got[2]) == 20_000
    assert time.time() - begun < 60


def test_cells_carry_the_labels_of_their_column(spark):
    rows_ = [["n", "", "é"], ["1", "2"], [], ["3", "4", "5", "6"]]
    text = "n é 1 2 3 4 5 6"
    d = spark.createDataFrame([(text, [["n", "é"], ["1", "2"], [], ["3", "4", "5"]]), (text, rows_), (None, None), (text, [None, ["n"]]), (text, [["6", "n"]])], "t string, c array<array<string>>")
    got = [r[0] for r in d.select(L.aligned_cells()("t", "c")).collect()]
    assert [(c["row_index"], c["column_index"], text[c["start_char"] : c["end_char"]], c["header_labels"]) for c in got[0]] == [
        (0, 0, "n", []), (0, 1, "é", []), (1, 0, "1", ["n"]), (1, 1, "2", ["é"]), (3, 0, "3", ["n"]), (3, 1, "4", ["é"]), (3, 2, "5", []),
    ]
    assert got[1] is None and got[2] == [] and got[4] is None and [c["row_index"] for c in got[3]] == [1]


def test_queries_equal_sql_and_leave_python_out(spark, duck):
    sql = oracles.oracle_sql()
    for name in ("word_alignment", "cell_alignment"):
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert "Python" not in df._jdf.queryExecution().toString()
        got, want = rows(df.toPandas()), rows(duck.execute(sql[name]).df())
        assert got == want and df.where(F.col("start_char").isNull()).count() > 0
