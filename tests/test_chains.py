"""Stored chains: written, checked in stretches, digested and compared, against plain versions."""

import hashlib
import random
import re

import pytest

from spanloom.operators import chains as H

REC = "k int, seq long, payload string, payload_hash string, previous_hash string, chain_hash string"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def chain(k, payloads):
    out, head = [], H.ZEROS
    for i, p in enumerate(payloads):
        h = sha(p)
        out.append((k, i, p, h, head, sha(head + h)))
        head = out[-1][-1]
    return out


def plain(records):
    out = []
    for k, seq, p, h, before, c in records:
        p, h, before, own = p or "", h or "", before or "", c or ""
        codes = ["payload_changed"] * (sha(p) != h) + ["hash_wrong"] * (sha(before + h) != own)
        if seq is None or seq < 0:
            codes.append("unplaced")
        else:
            met = [r[5] or "" for r in records if r[0] == k and r[1] == seq - 1]
            codes += ["repeated"] * (sum(r[0] == k and r[1] == seq for r in records) > 1)
            codes += ["missing_before"] * (seq > 0 and not met)
            codes += ["link_broken"] * (before != H.ZEROS if seq == 0 else bool(met) and before not in met)
        if codes:
            out.append((k, seq, c, tuple(codes)))
    return sorted(out, key=str)


def test_link_writes_what_a_loop_writes(spark):
    rows = [(1, 3, "c"), (1, 1, "a"), (1, 1, "a"), (2, 0, None), (None, 5, "z"), (1, None, "first"), (None, 4, "y")]
    got = H.link(spark.createDataFrame(rows, "k int, ts int, payload string"), "k", ["ts"]).collect()
    want = chain(1, ["first", "a", "a", "c"]) + chain(2, [""]) + chain(None, ["y", "z"])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert H.link(spark.createDataFrame([], "k int, ts int, payload string"), "k", ["ts"]).count() == 0


@pytest.mark.parametrize("stretch", [1, 4, 1024])
def test_breaks_equal_a_plain_check(spark, stretch):
    rng, records = random.Random(stretch), []
    for k in (1, 2, 3, None):
        c = chain(k, [str(rng.random()) for _ in range(37)])
        assert plain(c) == []
        for i in rng.sample(range(37), 9):
            r, part = list(c[i]), rng.randrange(1, 6)
            r[part] = rng.choice([None, -1, 5]) if part == 1 else rng.choice([None, "x", H.ZEROS])
            c[i] = tuple(r)
        del c[rng.randrange(37)]
        records += c + rng.sample(c, 3)
    df = spark.createDataFrame(records, REC)
    got = H.breaks(df, "k", stretch).collect()
    assert sorted(((*r[:3], tuple(r["codes"])) for r in got), key=str) == plain(records)
    assert {x for r in got for x in r["codes"]} == {"payload_changed", "hash_wrong", "repeated", "missing_before", "link_broken", "unplaced"}


def test_sound_chains_and_empty_tables_have_no_break(spark):
    assert H.breaks(spark.createDataFrame(chain(1, "abcdefghij") + chain(2, "z"), REC), "k", 3).count() == 0
    none = spark.createDataFrame([], REC)
    assert H.breaks(none, "k").count() == H.divergence(none, none, "k").count() == H.roots(H.digests(none, "k"), "k").count() == 0


def test_long_chains_are_checked_by_stretches(spark):
    long = chain(1, map(str, range(20000)))
    long[9999] = (*long[9999][:5], "x")
    plan = H.breaks(spark.createDataFrame(long, REC), "k")
    assert [(r["seq"], list(r["codes"])) for r in plan.orderBy("seq").collect()] == [(9999, ["hash_wrong"]), (10000, ["link_broken"])]
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", plan._jdf.queryExecution().executedPlan().toString())
    assert shuffles and all(x.count("#") == 2 for x in shuffles)  # by chain and stretch


def test_copies_are_told_apart_by_digests(spark):
    a = chain(1, map(str, range(50))) + chain(2, "ab") + chain(None, "abc")
    b = list(a)
    b[17] = (*b[17][:3], "other", *b[17][4:])
    b = [r for r in b if r[:2] != (None, 2)] + chain(3, "q") + [b[50]]
    x, y = spark.createDataFrame(a, REC), spark.createDataFrame(b, REC)
    assert H.divergence(x, x, "k", 4).count() == 0
    got = sorted(map(tuple, H.divergence(x, y, "k", 4).collect()), key=str)
    assert got == sorted([(1, 17, 1, 1), (2, 0, 0, 1), (3, 0, 0, 1), (None, 2, 1, 0)], key=str)
    first, second = ({r["k"]: r["digest"] for r in H.roots(H.digests(t, "k", 4), "k", 2, 3).collect()} for t in (x, y))
    assert set(first) == {1, 2, None} and all(first[k] != second[k] for k in first)
    again = {r["k"]: (r["n"], r["digest"]) for r in H.roots(H.digests(x.repartition(5), "k", 4), "k", 2, 3).collect()}
    assert again == {k: (sum(r[0] == k for r in a), d) for k, d in first.items()}
