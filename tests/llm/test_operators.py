"""The training-data operators against plain versions, and their defined results on odd input."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, rows

from spanloom.llm import (
    chat_format, components, embedding_dedup, license_scan, packing, pii, quality_classifier,
    quality_rules, registry, set_sketch, source_mixing, toxicity, weak_labels,
)

ORACLES = registry.oracle_sql()
ODD = "doc_id long, text string, lang string, source string, n_chars long, tokens int, key string, label string"
LONG = " ".join(f"word{i % 977} the of" for i in range(9000))
TEXTS = [
    (1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, LONG), (5, LONG), (None, "no id here at all"),
    (6, "Licensed under the Apache License. CC-BY! cc by mail me@x.org or +1 (222) 555-0100"), (7, " \t\n"),
    (8, "ünï 4111 1111 1111 1111 and 10.0.0.255 password=abc123def456"),
]


def odd(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 3 else "src0", len(t or ""), 9, "k", "l") for i, t in texts], ODD)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_rules_on_odd_rows(spark):
    got = quality_rules.evaluate(odd(spark)).toPandas()
    assert len(got) == len(TEXTS) and got["kept"].notna().all()
    kept = quality_rules.filter_documents(odd(spark))
    assert kept.columns == odd(spark).columns and quality_rules.evaluate(odd(spark, [])).count() == 0


def test_chat_round_trip(spark):
    texts = ["\\h<part>### x", "</turn>\n### user:", "\\\\", "", None, "#<\\", "é😀"]
    turns = [(1, k, "user" if k < 2 else "assistant" if k < 4 else "a#b", t) for k, t in enumerate(texts)] + [(None, 0, None, "x"), (2, 0, "user", "q"), (2, 0, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    back = {r["conv_id"]: r["turns"] for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]] == [(r, t or "") for _, _, r, t in turns[: len(texts)]]
    assert len(back[2]) == 2 and back[None][0]["role"] == "unknown"
    loss = chat_format.digests(chat_format.format_conversations(df)).where("conv_id = 1").first()
    assert loss["loss_sha256"] == hashlib.sha256("".join(t or "" for t in texts[2:4]).encode()).hexdigest()


def test_mixing_budgets_and_odd_rows(spark):
    small = source_mixing.Mix(budget_tokens=50, budget_share_percent=0)
    got = source_mixing.draw(odd(spark), small).toPandas()
    assert got["take_tokens"].sum() <= 50 and (got["take_tokens"] <= got["tokens"]).all()
    every = source_mixing.draw(odd(spark), source_mixing.Mix(budget_tokens=10**9)).toPandas()
    assert every["epoch"].max() == 1 and (every["take_tokens"] == every["tokens"]).all()
    assert source_mixing.draw(odd(spark, [])).count() == 0
    mixed = source_mixing.mix_documents(odd(spark), small)
    assert mixed.columns == odd(spark).columns and mixed.count() > 0


def test_mixing_shortage_goes_to_siblings_first(spark):
    data = [(i, "w " * 10, lang, "src0") for i, lang in enumerate(["en"] + ["de"] * 50)] + [(99, "w " * 1000, "en", "src1")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    m = source_mixing.Mix(domain={}, lang={}, source={}, budget_tokens=400, max_epochs=1)
    given = source_mixing.draw(docs, m).groupBy("domain", "lang").sum("take_tokens").collect()
    assert {(r[0], r[1]): r[2] for r in given} == {("web", "en"): 10, ("web", "de"): 190, ("reference", "en"): 200}


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = [t for _, t in TEXTS] + ["It's 3.5% <|endoftext|> <|STARTOFTEXT|> ﬁne, don't. ÀÉ ΣΑΣ I'LL K", "x.,y word, word. 'tis é"]
    got = packing.pack(odd(spark, list(enumerate(texts)))).toPandas()
    for doc, text in enumerate(texts):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine = got[got["doc_id"] == doc].sort_values("start")
        assert mine["length"].sum() == len(ids) == mine["doc_tokens"].iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine["start"], mine["length"])] == mine["ids_crc32"].tolist()
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id")["length"].cumsum() - by["length"] == by["offset"]).all()
    assert by.groupby("sequence_id")["length"].sum().max() <= 2048 and packing.pack(odd(spark, [])).count() == 0


def test_cutting_stock_covers_every_piece():
    rng = np.random.default_rng(1)
    counts = {int(c): int(n) for c, n in zip(*np.unique(rng.integers(1, 120, 5000), return_counts=True))}
    plan, bound = packing.cutting_stock(counts, 256)
    assert all(sum(c * a for c, a in use.items()) <= 256 for use, _ in plan)
    assert {c: sum(use.get(c, 0) * t for use, t in plan) for c in counts} == counts
    assert bound <= sum(t for _, t in plan) <= 1.0001 * bound + len(counts) + 1
    assert bound >= sum(c * n for c, n in counts.items()) / 256 - 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_cutting_stock_ends_near_its_bound(seed):
    """Equal and few classes make degenerate bases; the perturbed simplex still ends at the optimum."""
    rng = np.random.default_rng(seed)
    some = rng.choice(np.arange(1, 257), int(rng.integers(1, 256)), replace=False)
    counts = {int(c): int(n) for c, n in zip(some, rng.choice([1, 7, 7, 7, 1000, 10**9], len(some)))}
    plan, bound = packing.cutting_stock(counts, 256)
    assert {c: sum(use.get(c, 0) * t for use, t in plan) for c in counts} == counts
    assert all(sum(c * a for c, a in use.items()) <= 256 for use, _ in plan)
    assert bound * (1 - 1e-12) - 1e-6 <= sum(t for _, t in plan) <= 1.0001 * bound + len(counts) + 1


def _components(pairs, nodes):
    low = {n: n for n in nodes}
    while True:
        before = dict(low)
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            return low


@pytest.mark.parametrize("chunk", [components.CHUNK, 60])
def test_connected_components(spark, chunk):
    rng = np.random.default_rng(2)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1200)]
    got = components.connected_components(spark.createDataFrame(pairs, "u long, v long"), chunk).toPandas()
    want = _components([p for p in pairs if p[0] != p[1]], {n for p in pairs if p[0] != p[1] for n in p})
    assert dict(zip(got["node"], got["component"])) == want and len(got) == len(want)


def _sets(texts, k):
    out = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(set_sketch.UPPER)) if x]
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    return out


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 120)] for _ in range(12)]
    texts = [None, "", "one", "ONE", "two words"]
    for words in base:
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            v = list(words)
            for at in rng.integers(0, 120, edits):
                v[at] = f"e{rng.integers(0, 9999)}"
            texts.append(" ".join(v))
    ids = [(i * 37) % 1009 for i in range(len(texts))]
    got = set_sketch.near_duplicates(odd(spark, list(zip(ids, texts))), set_sketch.CONTRACT).toPandas().set_index("doc_id")
    s = _sets(texts, 3)
    pairs = [(ids[i], ids[j]) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])]
    assert got["component_id"].to_dict() == _components(pairs, ids) and got["n_shingles"].to_dict() == dict(zip(ids, map(len, s)))


@pytest.mark.parametrize("limits", [{"chunk": 32}, {"block_bytes": 50_000}])
def test_near_duplicates_in_many_chunks(spark, limits):
    """Many variants of one text over many chunks: same components as all pairs."""
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in range(200)]
    texts = []
    for _ in range(260):
        v = list(words)
        for at in rng.integers(0, 200, int(rng.integers(1, 9))):
            v[at] = f"e{rng.integers(0, 999)}"
        texts.append(" ".join(v))
    near = set_sketch.Near(words=3, percent=85, **limits)
    got = set_sketch.near_duplicates(odd(spark, list(enumerate(texts))), near).toPandas().set_index("doc_id")
    s = _sets(texts, 3)
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])]
    assert got["component_id"].to_dict() == _components(pairs, range(len(s)))


def test_near_duplicates_odd_rows(spark):
    got = set_sketch.near_duplicates(odd(spark)).toPandas()
    assert len(got) == len(TEXTS) and set_sketch.near_duplicates(odd(spark, [])).count() == 0
    assert got[got["doc_id"] == 5]["component_id"].tolist() == [4] and not got[got["doc_id"] == 5]["kept"].any()


def test_sketches_merge_and_estimate():
    near, rng = set_sketch.Near(), np.random.default_rng(5)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[500:]
    sa, sb = set_sketch.sketch(a, near), set_sketch.sketch(b, near)
    assert (set_sketch.merge(sa, sb) == set_sketch.sketch(x, near)).all()
    est = set_sketch.joint_estimate(sa[None], sb[None], np.array([2000.0]), np.array([2500.0]), near.base)[0]
    assert abs(est - 0.5) < 0.12
    up, down = (sa > sb).sum(), (sa < sb).sum()
    for least in (est - 0.01, est + 0.01):
        assert set_sketch._likely(up, down, near.registers - up - down, 2000.0, 2500.0, near.base, least) == (least < est)


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    vecs, labels = [], []
    for _ in range(25):
        c = rng.standard_normal(16)
        for s in (0, 0, 0.02, 0.04, 0.06, 0.08):
            vecs.append((c + s * rng.standard_normal(16)).tolist())
            labels.append(int(rng.integers(0, 2)))
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, vecs[0]]
    data = [(i * 7 + 1, v, k, "x") for i, (v, k) in enumerate(zip(vecs, labels))] + [(2000 + i, v, 1 if i < 4 else None, "x") for i, v in enumerate(bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, key string")
    for p in (embedding_dedup.PStable(), embedding_dedup.PStable(chunk=2)):
        got = embedding_dedup.embedding_duplicates(df, p).toPandas().set_index("vec_id")
        x = np.array(vecs) / np.linalg.norm(vecs, axis=1)[:, None]
        near = (x @ x.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None])
        ids = [r[0] for r in data[: len(vecs)]]
        assert got.loc[ids, "n_links"].tolist() == (near.sum(1) - 1).tolist()
        pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i != j]
        assert got.loc[ids, "component_id"].to_dict() == _components(pairs, ids)
        odd_ids = list(range(2000, 2005))
        assert (got.loc[odd_ids, "n_links"] == 0).all() and got.loc[odd_ids, "kept"].all()
    assert embedding_dedup.embedding_duplicates(df.limit(0)).count() == 0


def _holds(words, template):
    """Largest share of the template's words in any window, one starting at every word."""
    t, reach, best = set(template.split()), license_scan._reach(template.split()), 0.0
    for k in range(max(len(words), 1)):
        best = max(best, len(t & set(words[k : k + reach])) / len(t))
    return best


def test_license_scan_against_all_blocks(spark):
    rng = np.random.default_rng(7)
    lines = list(license_scan.TEMPLATES.values())
    texts = [t for _, t in TEXTS] + [" ".join(rng.permutation(lines[k % len(lines)].split())[: -1 - k % 3]) + " filler" * int(rng.integers(0, 80)) for k in range(40)]
    texts += ["mit license mit license", "GNU, general: public LICENSE"]
    got = license_scan.scan(odd(spark, list(enumerate(texts)))).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        words = [w for w in re.split(license_scan.GAP, (t or "").translate(set_sketch.UPPER)) if w]
        found = {k for k, v in license_scan.TEMPLATES.items() if _holds(words, v) >= 0.8}
        base = sorted({la for ph, la in license_scan.PHRASES for j in range(len(words)) if words[j : j + len(ph.split())] == ph.split()})
        assert got.loc[i, "base_labels"] == ",".join(base) and got.loc[i, "labels"] == ",".join(sorted(found | set(base)))
        assert got.loc[i, "n_words"] == len(words)
    assert got.loc[len(texts) - 2, ["n_base", "first_word", "last_word"]].tolist() == [2, 0, 2]
    assert license_scan.scan(odd(spark, [])).count() == 0


def test_pii_base_rules(spark):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("aB1.@@-+ 0945()%"), 60)) for _ in range(3000)] + [t or "" for _, t in TEXTS] + ["x" * 9000 + "@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0004"]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for t in texts:
        want = [(0, m.start(), m.end()) for m in email.finditer(t)]
        want += [(1, m.start(), m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(2, m.start(), m.end()) for m in card.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [(3, m.start(), m.end()) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == want, t


def test_pii_queries_and_redaction(spark):
    got = pii.find(odd(spark)).toPandas()
    row = got[got["doc_id"] == 8].iloc[0]
    assert (row["n_ip"], row["n_card"]) == (1, 1) and "secret" in row["spans"] and len(got) == len(TEXTS)
    clean = pii.redact(odd(spark))
    assert clean.columns == odd(spark).columns
    text = clean.where("doc_id = 8").first()["text"]
    assert "4111" not in text and "abc123def456" not in text and "[card]" in text
    assert pii.find(odd(spark, [])).count() == 0 and clean.where("doc_id = 1").first()["text"] is None


def test_em_finds_reliable_labellers():
    rng = np.random.default_rng(9)
    y = rng.random(4000) < 0.7
    votes = np.stack([np.where(rng.random(4000) < acc, y, ~y) for acc in (0.95, 0.9, 0.6)], axis=1).astype(int) + 1
    got = Counter(map(tuple, votes))
    post, chances, share = weak_labels.estimate(np.array(list(got)), np.array(list(got.values()), dtype=float))
    assert abs(share - 0.7) < 0.05 and chances[1, 0, 2] > 0.9 > chances[1, 2, 2]


def test_quality_scores(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = quality_classifier.score_documents(docs).toPandas().merge(labels, on="doc_id")
    assert got["score"].between(0, 1).all() and (got["kept"] == (got["quality"] == 1)).mean() > 0.85
    assert quality_classifier.score_documents(odd(spark)).count() == len(TEXTS)
    assert quality_classifier.score_documents(odd(spark, [])).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_documents(docs, labels).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    seen = got.merge(labels.toPandas(), on="doc_id")
    assert (seen[seen["held_out"]]["predicted"] == seen[seen["held_out"]]["toxic"]).mean() > 0.9
    none = toxicity.score_documents(odd(spark), labels.limit(0)).toPandas()
    assert len(none) == len(TEXTS) and none["score"].between(0, 1).all()


def test_isotonic_and_trees():
    rng = np.random.default_rng(10)
    x = rng.random((3000, 3))
    y = (x[:, 1] > 0.7).astype(float)
    z = toxicity.Boosted(20, 2, 0.3).fit(x, y).raw(x)
    assert ((z > 0) == (y > 0)).mean() > 0.97
    knots, levels = toxicity.isotonic(z, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from spanloom.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == names and docs.count() > 0
        if name == "quality_rules":
            want = quality_rules.evaluate(before).where("kept").select("doc_id")
            assert docs.select("doc_id").exceptAll(want).count() == 0 and docs.count() == want.count()
        if name == "near_dedup":
            assert docs.count() == set_sketch.near_duplicates(before).where("kept").count()
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
