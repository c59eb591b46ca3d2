"""Operators 11 to 13 against brute force: on the tables, on planted cases, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows

from spanloom.llm import fill_middle, lexical_search, sharding

#: Columns that clash with names used inside.
EXTRA = "doc_id long, text string, row string, chunk int, k1 string, `a.b` int, shard string, tags map<string,int>"


def wide(spark, pairs):
    return spark.createDataFrame([(i, t, "r", 1, "k", 2, "s", {"x": 1}) for i, t in pairs], EXTRA)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (None, "né\n一二\n" * 40), (None, "né\n一二\n" * 40), (6, "x<P>y\n"), (7, "<<P\n>\n<"), (8, "é" * 70_000 + "\n" + "z\n" * 9), (8, "other of one id"), (9, "\n" * 3000), (9, "\n" * 3000), (10, "\u0000\U0001f600 A.a a-A"), (11, "a" * 40_000 + "<M>")]

# Search


def ranked(docs, items, k):
    found = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    sets = [(i, Counter(w), len(w)) for i, t in docs if (w := found(t))]
    n_docs, total, df = len(sets), sum(n for _, _, n in sets), Counter(t for _, c, _ in sets for t in c)
    queries = defaultdict(set)
    for i, t in items:
        queries[i] |= set(found(t))
    out = []
    for item, terms in queries.items():
        scored = []
        for doc, c, n in sets:
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def searched(out):
    return sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in out.collect())


def test_search_equals_sql(spark, duck):
    assert rows(lexical_search.query(spark, SF).toPandas()) == rows(duck.execute(lexical_search.oracle()).df())


@pytest.mark.parametrize("most", [1, 10**6])
def test_search_on_odd_rows_and_query_blocks(spark, most):
    items = [(1, "a né"), (1, "A other id"), (2, None), (3, "..."), (None, "z 一二"), (5, "nothing has this"), (6, "z " * 5)]
    got = lexical_search.search(wide(spark, ODD), spark.createDataFrame(items, "item_id long, text string"), 5, most)
    assert searched(got) == ranked(ODD, items, 5)


def test_search_of_empty_tables(spark):
    none, some = wide(spark, []), wide(spark, [(1, "a b")])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(some, items.where("false")).count() == 0
    assert lexical_search.search(wide(spark, [(1, None)]), items).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_stopping_early_loses_nothing(seed):
    """Ties, heavy tails and long queries: the block's best equal those of all scores."""
    rng = np.random.default_rng(seed)
    sets = [np.sort(rng.choice(60, rng.integers(0, 30), replace=False)).astype(np.int32) for _ in range(700)]
    edges = np.append(0, np.cumsum([len(s) for s in sets]))
    term, tf = np.concatenate(sets), rng.integers(1, 4, edges[-1]).astype(np.int64) ** 3
    n, weights = rng.integers(1, 60, 700), rng.integers(0, 9000, 60)
    block = lexical_search.Block(edges, term, tf, n, weights, 700, int(n.sum()))
    gain = weights[term] * ((10**9 * tf) // (1000 * tf + 20 * (50 + (50 * n * 700) // n.sum())[np.repeat(np.arange(700), np.diff(edges))]))
    for size in (1, 3, 40, 60):
        query = np.sort(rng.choice(70, size, replace=False)).astype(np.int32)
        whole = np.bincount(np.repeat(np.arange(700), np.diff(edges)), np.where(np.isin(term, query), gain, 0), 700).astype(np.int64)
        kth = int(np.sort(whole)[-10])
        for least in (0, kth, kth + 1):
            at, scores = block.best(query, least, 10)
            assert (whole[at] == scores).all()
            assert set(np.flatnonzero(whole >= max(kth, least, 1))) <= set(at.tolist())


# Sharding


def least_capacity(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid, n, held = (low + high) // 2, 1, 0
        for x in sizes:
            n, held = (n + 1, x) if held + x > mid else (n, held + x)
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def check_shards(docs, shards, **how):
    out, r = sharding.shard(docs, shards, **how).toPandas(), sharding.sized(docs).toPandas()
    texts = Counter((t["doc_id"], len((t["text"] or "").encode()) + 8, zlib.crc32((t["text"] or "").encode())) for t in docs.select("doc_id", "text").collect())
    key = lambda x: None if x is None or x != x else int(x)
    assert Counter((key(a), b, c) for a, b, c in zip(out["doc_id"], out["size"], out["text_crc32"])) == texts
    for _, x in out.groupby("shard"):
        assert sorted(x["slot"]) == list(range(len(x)))
    assert out["shard"].between(0, shards - 1).all()
    where = defaultdict(set)
    for size, crc, k in zip(out["size"], out["text_crc32"], out["shard"]):
        where[size, crc].add(k)
    assert all(len(v) == 1 for v in where.values())
    # The order by its definition, and the smallest capacity by a greedy search over it.
    g = r.groupby(["k1", "k2"])["size"].sum()
    total, grain = int(g.sum()), how.get("grain", sharding.GRAIN)
    heavy = sorted((b for b in g if b * shards * grain > total), reverse=True)
    own, left = 0, total
    while own < min(len(heavy), shards - 1) and heavy[own] * (shards - own) >= left:
        left, own = left - heavy[own], own + 1
    order = heavy[own:] + [b for b in g if b * shards * grain <= total]
    per = out.groupby("shard")["size"].sum()
    assert max((int(per.get(k, 0)) for k in range(own, shards)), default=0) == (least_capacity(order, shards - own) if order else 0)
    assert [int(per.get(k, 0)) for k in range(own)] == heavy[:own]


@pytest.mark.parametrize(("shards", "how"), [(24, {}), (24, {"grain": 1, "cells": 16}), (5, {"grain": 0.001, "cells": 4, "range_rows": 7}), (1, {})])
def test_shards_of_the_table_are_minimax(spark, shards, how):
    check_shards(spark.read.parquet(f"{SF}/documents.parquet"), shards, **how)


@pytest.mark.parametrize("how", [{}, {"grain": 0.001, "cells": 4}])
def test_shards_with_a_third_of_the_rows_in_one_text(spark, how):
    check_shards(wide(spark, [(i, "copy of one text" if i % 3 == 0 else f"text {'x' * (i % 37)} {i}") for i in range(900)]), 24, **how)


def test_shards_of_odd_rows(spark):
    check_shards(wide(spark, ODD), 4)
    check_shards(wide(spark, ODD), 40)
    check_shards(wide(spark, [(1, None)]), 24)
    assert sharding.shard(wide(spark, []), 24).count() == 0


def test_a_plan_is_settled_with_equal_first_hashes(spark):
    """Groups of one first hash are told apart by the second."""
    groups = spark.createDataFrame([(7, k, 10 + k) for k in range(40)] + [(8, 0, 5)], "k1 long, k2 long, bytes long")
    p = sharding.plan(groups, 4, grain=0.001, cells=4)
    sizes = [10 + k for k in range(40)] + [5]
    assert p.heavy == [] and len(p.cuts) == 3 and p.capacity == least_capacity(sizes, 4)


# Fill in the middle


def cut(doc, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return str((doc, len(units), "plain", None, None, text))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return str((doc, len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out))


@pytest.mark.parametrize("chunk", [64, 1000, fill_middle.CHUNK])
def test_middles_of_the_table(spark, chunk):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(str(tuple(r)) for r in fill_middle.transform(docs, chunk=chunk).collect()) == sorted(cut(r["doc_id"], r["text"]) for r in docs.collect())


@pytest.mark.parametrize("chunk", [300, fill_middle.CHUNK])
def test_middles_of_odd_rows(spark, chunk):
    docs = wide(spark, ODD)
    for percent, spm in ((100, 50), (40, 0), (100, 100)):
        got = fill_middle.transform(docs, percent=percent, spm=spm, chunk=chunk)
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(cut(i, t, percent, spm) for i, t in ODD)
    assert fill_middle.transform(wide(spark, [])).count() == 0


def test_middles_are_restored(spark):
    """Sentinels half written at the cuts do not mislead the way back."""
    pairs = [(i, t) for i in range(60) for t in ("<\nP>\n<P\n>S>\n<\n", "M>\n<S\n<", "<<<\n<P\n<S\nS>")] + ODD
    from pyspark.sql import functions as F

    out = fill_middle.transform(wide(spark, pairs)).select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str((i, t or "")) for i, t in pairs)


def test_query_digests(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in fill_middle.query(spark, SF).collect():
        want = eval(cut(r["doc_id"], docs[r["doc_id"]]))
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (*want[1:5], sha(want[5]), sha(docs[r["doc_id"]] or ""))


@pytest.mark.parametrize("marks", [("<P>", "<S>", "<M>"), ("aab", "ab", "\nb"), ("é",)])
def test_functions_compose(marks):
    """Any split of a text into chunks gives, composed, the function of the whole."""
    auto = fill_middle.Automaton(marks)
    rng = np.random.default_rng(5)
    for _ in range(20):
        text = "".join(rng.choice(list("ab\n<>PSMé"), 900)).encode()
        data = np.frombuffer(text, np.uint8)
        to, n = (x[0] for x in auto.scan(data, np.array([0]), np.array([len(text)])).functions())
        edges = np.unique(np.append(rng.integers(0, len(text), 5), [0, len(text)]))
        parts = auto.scan(data, edges[:-1], edges[1:]).functions()
        q, k = np.arange(auto.states), np.zeros(auto.states, np.int64)
        for a, b in zip(*parts):
            k, q = k + b[q], a[q]
        assert (q == to).all() and (k == n).all()
        assert n[0] == len(re.findall(rb"[^\n]*\n|[^\n]+", text)) and auto.seen[to[0]] == any(m.encode() in text for m in marks)


def test_ranges_of_sliced_arrays():
    a = pa.array(["ab", "", "cde", None, "f"]).slice(1)
    data, lo, hi = fill_middle._ranges(a.fill_null(""))
    assert [bytes(data[x:y]) for x, y in zip(lo, hi)] == [b"", b"cde", b"", b"f"]
