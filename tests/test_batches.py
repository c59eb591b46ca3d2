"""Replies to reconciliation batches of every shape, and the runs that facts come from."""

import json

import pytest

from spanloom.operators import reconcile as M

SOUND = [
    ({"groups": [["a", ["a", "b"]]], "rejected": []}, [("a", ["a", "b"])], []),
    ({"groups": [["a", "a"]], "rejected": ["b", ["c"], ["d", "invented_span"]]}, [("a", ["a"])], [("b", "reconciler_rejected"), ("c", "reconciler_rejected"), ("d", "invented_span")]),
    ({"groups": json.dumps([["a", "a"]]), "rejected": "[]"}, [("a", ["a"])], []),
    (json.dumps({"groups": [], "rejected": json.dumps([["x"]])}), [], [("x", "reconciler_rejected")]),
]
FAULTY = [
    ("{", "not_json"), (None, "not_json"), ('""', "not_json"), ("null", "not_object"), ("3", "not_object"), ({"groups": [], "rejected": [], "k": 1}, "unknown_key"),
    ({"rejected": []}, "groups_not_list"), ({"groups": {}, "rejected": []}, "groups_not_list"), ({"groups": [], "rejected": "x"}, "rejected_not_list"),
    ({"groups": ["a"], "rejected": []}, "bad_group"), ({"groups": [["a", ["a"], 1]], "rejected": []}, "bad_group"), ({"groups": [[1, ["a"]]], "rejected": []}, "bad_group"), ({"groups": [["a", ["a", None]]], "rejected": []}, "bad_group"),
    ({"groups": [["", [""]]], "rejected": []}, "bad_group"), ({"groups": [], "rejected": [" \t"]}, "bad_rejection"), ({"groups": [], "rejected": [[]]}, "bad_rejection"), ({"groups": [], "rejected": [4]}, "bad_rejection"), ({"groups": [], "rejected": [["a", 4]]}, "unknown_code"),
    ({"groups": [], "rejected": [["a", "invented_span", 1]]}, "bad_rejection"), ({"groups": [["a", ["b"]]], "rejected": []}, "source_not_member"), ({"groups": [["a", []]], "rejected": []}, "source_not_member"),
    ({"groups": [["a", ["a", "b", "b"]]], "rejected": []}, "members_repeated"), ({"groups": [], "rejected": ["a", ["a"]]}, "rejected_repeated"),
]


def as_text(x):
    return x if x is None or (isinstance(x, str) and not x.startswith('{"g')) else json.dumps(x)


def test_shapes_of_replies(spark):
    every = [as_text(x[0]) for x in SOUND] + [as_text(x[0]) for x in FAULTY]
    # Columns of the input that bear the names of the result's give way to them.
    df = spark.createDataFrame([(i, p, "old", "keep") for i, p in enumerate(every)], "doc_id int, payload string, groups string, note string")
    got = {r["doc_id"]: r for r in M.decode_batches(df).collect()}
    for i, (_, groups, rejected) in enumerate(SOUND):
        assert got[i]["error"] is None and got[i]["note"] == "keep"
        assert [(g["source_id"], list(g["member_ids"])) for g in got[i]["groups"]] == groups and [tuple(x) for x in got[i]["rejected"]] == rejected
    for i, (payload, error) in enumerate(FAULTY, len(SOUND)):
        assert (got[i]["error"], got[i]["groups"], got[i]["rejected"]) == (error, None, None), payload
    decoded = M.decode_batches(df)
    assert [tuple(r)[1:3] for r in M.batch_groups(decoded).orderBy("doc_id").collect()] == [(1, "a")] * 3 and M.batch_rejections(decoded).count() == 4
    assert M.decode_batches(df.limit(0)).count() == 0


def test_a_long_batch_is_read_whole(spark):
    ids = [f"c{i}" for i in range(5000)]
    text = json.dumps({"groups": [[i, [i]] for i in ids], "rejected": [f"r{i}" for i in ids]})
    decoded = M.decode_batches(spark.createDataFrame([(1, text)], "doc_id int, payload string"))
    assert M.batch_groups(decoded).agg({"group_pos": "max"}).first()[0] == 5000 and M.batch_rejections(decoded).distinct().count() == 5000


@pytest.mark.parametrize("manifests, want", [([("m", 9), ("m", 9), (None, 1)], [("m", 9)]), ([], [("p", 1), ("p", 2)]), (None, [("p", 1), ("p", 2)])])
def test_input_runs(spark, manifests, want):
    points = spark.createDataFrame([("p", 1), ("p", 2), ("p", 1), (None, 3)], "run_id string, doc_id int")
    m = None if manifests is None else spark.createDataFrame(manifests, "run_id string, doc_id int")
    assert sorted(map(tuple, M.input_runs(points, m).collect())) == want
