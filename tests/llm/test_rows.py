"""Rows that share an id, repeat, or are odd: every row has a result of its own."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF, rows
from test_operators import LONG, ODD, TEXTS, _components, _sets, odd

from spanloom.llm import chat_format, embedding_dedup, license_scan, packing, pii, quality_classifier, registry, set_sketch, source_mixing, toxicity, weak_labels

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in pairs], TEXT)


# Mixing


def _texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_mixing_draws_rows_of_one_id_each_for_itself(spark):
    docs = docs_of(spark, [(3, "a b c d e f g h i"), (3, "x y z u v w x y z"), (4, "one two"), (4, "one two"), (None, "no id at all"), (None, "none")])
    full = source_mixing.Mix(budget_tokens=10**6, max_epochs=1)
    assert _texts(source_mixing.mix_documents(docs, full)) == _texts(docs)
    twice = source_mixing.Mix(budget_tokens=10**6, max_epochs=2)
    assert _texts(source_mixing.mix_documents(docs, twice)) == {k: 2 * n for k, n in _texts(docs).items()}


@pytest.mark.parametrize("budget", [1, 5, 9, 17, 23, 30])
def test_mixing_keeps_the_budget_with_repeated_rows(spark, budget):
    docs = docs_of(spark, [(3, "a b c d e f g h i"), (3, "x y z u v w x y z"), (3, "a b c d e f g h i"), (5, "p q")])
    mix = source_mixing.Mix(domain={}, lang={}, source={}, budget_tokens=budget, max_epochs=2)
    drawn = source_mixing.draw(docs, mix).toPandas()
    mixed = source_mixing.mix_documents(docs, mix).toPandas()
    assert drawn["take_tokens"].sum() == budget == sum(len(t.split()) for t in mixed["text"])
    assert len(drawn) == len(mixed) and sorted(drawn["take_tokens"]) == sorted(len(t.split()) for t in mixed["text"])
    whole = {"a b c d e f g h i", "x y z u v w x y z", "p q"}
    assert all(any(w.startswith(t) for w in whole) for t in mixed["text"])


def test_mixing_against_a_plain_version(spark):
    """Every drawn text of the table is a prefix of its document, as long as the draw says."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = Counter()
    for r in source_mixing.draw(docs).collect():
        words = [w for w in re.split("[\x20\x09-\x0d]+", text[r["doc_id"]]) if w]
        want[(r["doc_id"], text[r["doc_id"]] if r["take_tokens"] == len(words) else " ".join(words[: r["take_tokens"]]))] += 1
    assert _texts(source_mixing.mix_documents(docs)) == want


def test_mixing_keeps_columns_that_clash(spark):
    schema = TEXT + ", _draw int, k1 string, `a.b` int, row string, tags map<string,int>"
    docs = spark.createDataFrame([(1, "a b", "en", "src0", 3, 7, "k", 5, "r", {"x": 1}), (1, "a b", "en", "src0", 3, 7, "k", 5, "r", {"x": 2})], schema)
    got = source_mixing.mix_documents(docs, source_mixing.Mix(budget_tokens=100, max_epochs=1))
    assert got.columns == docs.columns and sorted(r["tags"]["x"] for r in got.collect()) == [1, 2]
    assert {(r["_draw"], r["k1"], r["a.b"], r["row"]) for r in got.collect()} == {(7, "k", 5, "r")}


# Near duplicates

A, B, C = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
NEAR_B, NEAR_C = B + " more", C + " more"


def _dups(spark, pairs, near=set_sketch.CONTRACT):
    got = set_sketch.near_duplicates(docs_of(spark, pairs), near).collect()
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)


def test_unlike_texts_under_one_id_keep_their_links(spark):
    assert _dups(spark, [(1, B), (1, C), (2, NEAR_B), (3, NEAR_C), (4, A)]) == Counter(
        [(1, 58, 1, True), (1, 58, 1, True), (2, 59, 1, False), (3, 59, 1, False), (4, 58, 4, True)]
    )
    assert _dups(spark, [(1, B), (2, A), (2, B)]) == Counter([(1, 58, 1, True), (2, 58, 2, True), (2, 58, 1, False)])
    assert _dups(spark, [(7, A), (7, A), (None, A), (9, A)]) == Counter([(7, 58, 7, True), (7, 58, 7, True), (None, 58, None, True), (9, 58, 7, False)])


def test_stage_keeps_unique_texts_under_a_copied_id(spark):
    docs = docs_of(spark, [(1, B), (2, A), (2, B), (3, NEAR_B), (None, B), (None, B), (5, ""), (6, None)])
    kept = set_sketch.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, B), (2, A), (None, B), (None, B), (5, ""), (6, None)])
    odd_names = docs_of(spark, [(1, B), (2, B)]).selectExpr("*", "1 as k1", "2 as `x.y`", "3 as row")
    assert [(r["doc_id"], r["x.y"]) for r in set_sketch.keep_one(odd_names).collect()] == [(1, 2)]


@pytest.mark.parametrize("near", [set_sketch.Near(), set_sketch.CONTRACT])
def test_near_duplicates_at_the_threshold(spark, near):
    """Pairs just at the threshold are found as well at 80 percent as at 85."""
    rng, texts = np.random.default_rng(21), []
    for k in range(300):
        words = [f"v{k}x{i}" for i in range(200)]
        other = list(words)
        for at in range(10, 10 + 12 * (5 if near.percent == 85 else 4), 12):
            other[at] = f"e{k}x{at}"
        texts += [" ".join(words), " ".join(other)]
    s = _sets(texts, near.words)
    pairs = [(2 * k, 2 * k + 1) for k in range(300) if 100 * len(s[2 * k] & s[2 * k + 1]) >= near.percent * len(s[2 * k] | s[2 * k + 1])]
    share = len(s[0] & s[1]) / len(s[0] | s[1])
    assert len(pairs) == 300 and near.percent / 100 <= share <= near.percent / 100 + 0.02
    got = {r["doc_id"]: r["component_id"] for r in set_sketch.near_duplicates(docs_of(spark, list(enumerate(texts))), near).collect()}
    assert got == _components(pairs, range(len(texts)))


# Embeddings


def _vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")


def test_vectors_of_one_id_are_linked_each_for_itself(spark):
    got = embedding_dedup.embedding_duplicates(_vectors(spark, [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0)])).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == Counter([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False)])
    got = embedding_dedup.embedding_duplicates(_vectors(spark, [(5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (6, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (7, [2.0, 0.0], 0)])).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == Counter([(5, 1, 5, True), (5, 1, 5, True), (6, 0, 6, True), (None, 0, None, True), (7, 1, 5, False)])


def test_embedding_recall_and_oracle_near_the_threshold(spark, duck):
    """Planted pairs at cosines from 0.95 to 0.999: every link at or over 0.98 is found, no other."""
    rng, data = np.random.default_rng(31), []
    for k in range(1500):
        x = rng.standard_normal(48)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(48)
        y -= (y @ x) * x
        c = rng.choice([0.95, 0.979, 0.9801, 0.982, 0.99, 0.999])
        y = c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)
        data += [(2 * k, (x * 3).tolist(), k % 3), (2 * k + 1, y.tolist(), k % 3)]
    data += [(9001, [0.0] * 48, 1), (9002, None, 1), (9003, [float("nan")] * 48, 1), (9004, data[0][1], None)]
    df = _vectors(spark, data)
    got = embedding_dedup.embedding_duplicates(df).toPandas()
    c = duck.cursor()
    c.register("frame_", df.toPandas())
    want = c.execute(embedding_dedup.oracle().replace("FROM embeddings", "FROM frame_")).df()
    assert rows(got) == rows(want) and (want["n_links"] > 0).sum() > 1500


def test_projections_follow_from_the_count():
    p = embedding_dedup.PStable()
    for n in (10, 10**4, 10**7, 10**10):
        k, tables = embedding_dedup.shape(p, n)
        far, near = (embedding_dedup.agree(d, p.width) for d in (2**0.5, 0.2))
        assert n * far**k <= 1 and (1 - near**k) ** tables <= p.miss
    assert embedding_dedup.embedding_duplicates(_vectors(__import__("pyspark").sql.SparkSession.active(), [(1, [1.0, 2.0], 0)]).limit(0)).count() == 0


# Licenses


def test_labels_stay_in_their_row(spark):
    licensed = "released under the mit license " + "word " * 10
    got = license_scan.scan(docs_of(spark, [(1, licensed), (1, "plain words here"), (None, licensed), (None, "other plain words"), (2, None)])).collect()
    assert Counter((r["doc_id"], r["labels"], r["score"]) for r in got) == Counter([(1, "mit,notice-mit", 1.0), (1, "", 0.0), (None, "mit,notice-mit", 1.0), (None, "", 0.0), (2, "", 0.0)])


def _plain_labels(text, templates):
    words = [w for w in re.split(license_scan.GAP, (text or "").translate(set_sketch.UPPER)) if w]
    out = set()
    for k, t in templates.items():
        need, kinds, reach = license_scan._need(list(set(t.split())), 80), set(t.split()), license_scan._reach(t.split())
        out |= {k for i in range(max(len(words), 1)) if len(kinds & set(words[i : i + reach])) >= need}
    return out


@pytest.mark.parametrize("offset", [0, 1, 13, 31, 32, 33, 50, 64, 127])
def test_long_templates_are_found_at_every_offset(spark, offset):
    rng = np.random.default_rng(offset)
    templates = {"long-50": " ".join(f"l{i}" for i in range(50)), "long-70": " ".join(f"m{i}" for i in range(70)), "long-200": " ".join(f"q{i % 150}" for i in range(200)), "none": ""}
    texts = [" ".join(f"pad{i}" for i in range(offset)) + " " + t + " end" for t in templates.values()]
    texts += [" ".join(w for w in t.split() if rng.random() < 0.85) + " tail" * 3 for t in templates.values()]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs_of(spark, list(enumerate(texts))), templates).collect()}
    real = {k: t for k, t in templates.items() if t}
    assert got == {i: ",".join(sorted(_plain_labels(t, real))) for i, t in enumerate(texts)}
    assert all(k in got[i] for i, k in enumerate(real))


def test_scattered_template_words_count_in_any_window(spark):
    rng, template = np.random.default_rng(4), license_scan.TEMPLATES["text-gpl"]
    texts = []
    for k in range(60):
        words = [f"z{i}" for i in range(260)]
        for w, at in zip(template.split(), np.sort(rng.choice(int(rng.integers(20, 200)), len(template.split()), replace=False)) + int(rng.integers(0, 60))):
            words[at] = w
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs_of(spark, list(enumerate(texts)))).collect()}
    want = {i: ",".join(sorted(_plain_labels(t, license_scan.TEMPLATES))) for i, t in enumerate(texts)}
    assert got == want and 5 < sum(map(bool, want.values())) < 60


# Personal data


def test_whole_result_of_op3_against_plain_rules(spark):
    """Counts and digest of the query on the table; its spans hold the base ones, in order."""
    got = {r["doc_id"]: r for r in registry.queries()["op3_pii"](spark, SF).collect()}
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == text.keys()
    forms = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = (lambda m: True, lambda m: all(int(p) <= 255 for p in m[0].split(".")), lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15)
    for doc, r in got.items():
        want = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(f, text[doc] or "") if ok(m)] for k, f, ok in zip(pii.BASE, forms, tests)]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == list(map(len, want))
        base = [x for xs in want for x in xs]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in (x.split(":") for x in spans)]
        assert [x for x in spans if x.split(":")[0] in pii.BASE] == base and order == sorted(order) and r["n_spans"] == len(spans)


TRUE = ["iban DE89 3704 0044 0532 0130 00", "account GB29 NWBK 6016 1331 9268 19", "ssn 123-45-6789", "token = ghp_16C7e42F292c6912E7710c838347Ae178B4a", "Contact: Mr Peter Miller", "call (222) 555-0100 now", "phone 2025550143 home", "api key sk_live4eC39HqLyjWDarjtT1zdp7dc"]
FALSE = ["commit sha 4b825dc642cb6eb9a060e54bf8d69288fbee4904", "version 202401150930", "model AB12 3456 7890 1234 5678", "part no 000-00-0000", "order 900000000000", "section donaudampfschiff1fahrtsgesellschaft", "Then Grace Period ended", "isbn 978316148410"]


def test_false_candidates_are_rejected_and_labellers_weighed(spark):
    pad = "some plain words stand here "
    texts = [pad + t + " and " + pad for t in TRUE for _ in range(12)] + [pad + t + " and " + pad for t in FALSE for _ in range(12)]
    df = docs_of(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["n_spans"] for r in pii.find(df).collect()}
    n = 12 * len(TRUE)
    wrong = {texts[i] for i in got if (got[i] > 0) != (i < n)}
    assert not wrong, wrong
    model = pii.train(pii.judged(df))
    assert {"account", "national_id", "number", "key", "name"} <= set(model.reliabilities)
    assert model.reliabilities["number"]["context"] > 0.9 > model.reliabilities["number"]["isolation"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert all(clean[i] == texts[i] for i in range(n, len(texts))) and all("[" in clean[i] for i in range(n))


def test_pii_on_long_and_awkward_texts(spark):
    import time

    long = ["a" * 400_000, "a@" * 100_000, "1." * 200_000, "9" * 400_000, "+1 " * 100_000, "AB12 " * 80_000, "x." * 100_000 + "@", "Peter Miller " * 30_000, "a@b.c " * 50_000 + "token=abcdefgh1 " * 20_000]
    for t in long:
        began = time.time()
        pii.judged_spans(t)
        assert time.time() - began < 12, t[:20]
    df = docs_of(spark, [(1, "mail me@x.org"), (1, "mail you@x.org"), (None, "mail a@b.de"), (2, None)]).selectExpr("*", "1 as spans", "2 as row", "3 as `p.q`", "4 as new")
    out = pii.redact(df)
    assert out.columns == df.columns and Counter(r["text"] for r in out.collect()) == {"mail [email]": 3, None: 1}
    assert all((r["spans"], r["row"], r["p.q"], r["new"]) == (1, 2, 3, 4) for r in out.collect())


def test_kinds_have_reliabilities_of_their_own():
    rng = np.random.default_rng(9)
    y, kinds = rng.random(6000) < 0.6, rng.integers(0, 2, 6000)
    sure = np.where(kinds[:, None] == 0, (0.95, 0.9, 0.55), (0.55, 0.9, 0.95))
    votes = np.where(rng.random((6000, 3)) < sure, y[:, None], ~y[:, None]).astype(int) + 1
    seen = Counter(map(tuple, np.column_stack([votes, kinds])))
    keys = np.array(list(seen))
    post, chances, shares = weak_labels.estimate_by_kind(keys[:, :3], np.array(list(seen.values()), dtype=float), keys[:, 3], 0.6)
    a, b = (weak_labels.reliability(chances[k], shares[k]) for k in (0, 1))
    assert a[0] > 0.85 > 0.75 > a[2] and b[2] > 0.85 > 0.75 > b[0]


# Quality, toxicity, packing, chat


def test_quality_labellers_are_weighed_and_ties_agree(spark):
    model = quality_classifier.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert set(model.accuracy) == set(quality_classifier.LABELLERS) and all(0.5 < v <= 1 for v in model.accuracy.values())
    got = quality_classifier.score_documents(odd(spark)).collect()
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    cache = quality_classifier._Slots(15)
    assert cache["abcdefghijklm9Z"] != cache["abcdefghijklm9Q!"] and cache["x" * 100_000]


def test_toxicity_on_odd_tables(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    extra = docs.unionByName(docs.limit(20)).selectExpr("*", "1 as toxic", "2 as h", "3 as last", "'x' as score")
    first, again = (toxicity.score_documents(extra, labels).toPandas().sort_values(["doc_id", "score"]) for _ in range(2))
    assert first["score"].tolist() == again["score"].tolist() and len(first) == docs.count() + 20
    assert (first.groupby("doc_id")["score"].nunique() == 1).all()
    none = toxicity.score_documents(docs_of(spark, [(None, LONG * 20), (1, None), (1, "you idiot")]), labels.limit(0)).collect()
    assert Counter((r["doc_id"], r["held_out"], r["predicted"]) for r in none) == Counter([(None, False, 0), (1, False, 0), (1, False, 1)])


def test_packing_of_the_table_and_odd_rows(spark):
    from tokenizers import Tokenizer
    import zlib

    tok = Tokenizer.from_file(packing.default_tokenizer())
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (table, docs_of(spark, [(1, "a b c"), (1, "a b c"), (None, "x y"), (None, None), (2, LONG)])):
        want = Counter()
        for r in df.collect():
            ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
            for k in range(0, len(ids), 2048):
                part = ids[k : k + 2048]
                want[(r["doc_id"], k, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
        got = packing.pack(df).collect()
        assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
        filled = {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == filled.get(r["sequence_id"], 0)
            filled[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(filled.values()) <= 2048
    assert sum(filled.values()) > 0


def test_chat_on_long_conversations_and_odd_tables(spark):
    turns = [(1, k, "user" if k % 5 < 3 else "assistant", f"<{k}>#é😀\\" * (1 + k % 3)) for k in range(1500)] + [(2, 0, "assistant", "x" * 300_000), (2, 1, "assistant", None)]
    df = spark.createDataFrame([(*t, "clash", 1) for t in turns], "conv_id long, turn int, role string, text string, formatted string, loss_spans int")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    for conv in (1, 2):
        mine = [(r, t or "") for c, _, r, t in turns if c == conv]
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_shared_folder_is_asked_for():
    from spanloom.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app-1"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())
