"""Each stage of the corpus pipeline against a plain version, and on odd tables."""

from collections import Counter

import numpy as np
import pytest
from conftest import SF
from test_operators import _components, _sets

import corpus_pipeline as cp
from spanloom.llm import packing, pii, quality_rules, source_mixing
from spanloom.llm.common import materialize

STAGE = dict(cp.STAGES)


def _pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "pii", "source_mixing", "packing"]


def test_quality_stage(spark, table):
    kept = {r["doc_id"] for r in quality_rules.evaluate(table).where("kept").collect()}
    assert _pairs(STAGE["quality_rules"](spark, table, SF)) == Counter({k: n for k, n in _pairs(table).items() if k[0] in kept})


def test_near_dedup_stage_against_all_pairs(spark, table):
    """Five words and 0.8, all pairs of the table: one document of each group stays."""
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    s = _sets([t for _, t in rows], 5)
    pairs = [(rows[i][0], rows[j][0]) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    low = _components(pairs, [i for i, _ in rows])
    assert _pairs(STAGE["near_dedup"](spark, table, SF)) == Counter((i, t) for i, t in rows if low[i] == i) and len(pairs) > 3


def test_pii_stage_against_a_plain_version(spark, table):
    """Spans found and judged text by text in this process, cut out one by one from the end."""
    keep = pii.accept(pii.train(pii.judged(table)).weights, pii.Fit().threshold)
    want = Counter()
    for r in table.collect():
        text, spans = r["text"], sorted(((x["start"], x["end"], x["kind"]) for x in keep(pii.judged_spans(r["text"] or ""))), key=lambda x: (x[0], -x[1]))
        merged = []
        for a, b, k in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b, k])
        for a, b, k in reversed(merged):
            text = text[:a] + f"[{pii.KINDS[k]}]" + text[b:]
        want[(r["doc_id"], text)] += 1
    got = STAGE["pii"](spark, table, SF)
    assert got.columns == table.columns and _pairs(got) == want and sum("[" in (t or "") for _, t in want) > 0
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_mixing_stage_draws_prefixes(spark, table):
    n = {r["doc_id"]: r["text"] for r in table.collect()}
    drawn = source_mixing.draw(table).toPandas()
    got = STAGE["source_mixing"](spark, table, SF).collect()
    assert len(got) == len(drawn) and sorted(len(r["text"].split()) for r in got) == sorted(drawn["take_tokens"])
    assert all(n[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split() for r in got)


def test_packing_stage_covers_every_id(spark, table):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = STAGE["packing"](spark, table, SF).toPandas()
    sizes = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in table.collect()}
    assert got.groupby("doc_id")["length"].sum().to_dict() == sizes
    full = got.groupby("sequence_id")["length"].sum()
    assert full.max() <= 2048 and len(full) <= 1.02 * sum(sizes.values()) / 2048 + 3


def test_stages_on_odd_and_empty_tables(spark):
    words = " ".join(f"the word{i} of" for i in range(60))
    rng = np.random.default_rng(3)
    other = " ".join(f"and term{i} in" for i in rng.integers(0, 9999, 80))
    rows = [(1, words, "en", None, 5), (1, words, "en", None, 5), (1, other, None, "src1", 5), (None, words, "en", "src2", 5), (2, words + " me@x.org", "de", "src2", 5), (3, None, None, None, None), (4, "", "en", "src0", 0), (5, "short", "en", "src0", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "7 as `a.b`", "'x' as _draw", "map('k', 1) as tags", "1 as row", "2 as k1", "3 as spans", "4 as new")
    for docs in (df, df.limit(0)):
        names, empty = docs.columns, docs.count() == 0
        for name, stage in cp.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
            if name != "packing":
                assert docs.columns == names
                assert all(r["a.b"] == 7 and r["_draw"] == "x" and r["tags"] == {"k": 1} for r in docs.collect())
            if name == "near_dedup" and not empty:
                assert Counter(r["doc_id"] for r in docs.collect()) == Counter({1: 3, None: 1})
        assert (docs.count() == 0) == empty
