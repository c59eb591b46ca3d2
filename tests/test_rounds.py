"""Replies over several attempts: tables against a plain simulation, and the stream against the tables."""

import random

from conftest import rows
from pyspark.sql import functions as F

from spanloom import oracles, registry
from spanloom.operators import rounds as N
from spanloom.streaming import rounds as stream

ASKED = "candidate_id string, at long"
REPLY = "candidate_id string, attempt int, at long, pos int, decision string, code string, fault string"
MOST, WAIT = 3, 100


def plain(at, replies):
    """(status, attempt, decision, asked, closed) and what was asked again, in the order of time."""
    again, open_, since, seen = [], 1, at, set()
    for r in sorted(replies, key=lambda r: (r[2], r[6] is not None, r[1] or 0, r[3])):
        while open_ <= MOST and since + WAIT < r[2]:
            open_, since = open_ + 1, since + WAIT
            if open_ <= MOST:
                again.append((open_, since, N.MISSING))
            else:
                return ("failed", None, None, MOST, since), again
        if r[1] is None or not 1 <= r[1] <= MOST or r[1] in seen:
            continue
        seen.add(r[1])
        if r[6] is None:
            return ("settled", r[1], r[4], open_, r[2]), again
        if r[1] == open_ and r[2] >= since:
            open_, since = open_ + 1, r[2]
            if open_ > MOST:
                return ("failed", None, None, MOST, since), again
            again.append((open_, since, r[6]))
    while open_ <= MOST:
        open_, since = open_ + 1, since + WAIT
        if open_ <= MOST:
            again.append((open_, since, N.MISSING))
    return ("failed", None, None, MOST, since), again


def sample(seed, n=400):
    r = random.Random(seed)
    asked = [(f"c{i}", r.randint(1, 50)) for i in range(n)]
    replies = []
    for i, (name, at) in enumerate(asked):
        for _ in range(r.choice([0, 1, 2, 3, 6])):
            fault = r.choice([None, "no_code", "unknown_decision"])
            replies.append((name, r.choice([1, 1, 2, 2, 3, 4]), at + r.randint(0, 380), r.randint(0, 1), r.choice(["accept", "reject"]), None, fault))
    return asked, replies


def test_tables_equal_a_plain_run(spark):
    asked, replies = sample(3)
    # A row of the asking twice, replies of an unknown and of a null id, and an attempt that is null.
    more = [("nobody", 1, 5, 0, "accept", None, None), (None, 1, 5, 0, "accept", None, None), ("c0", None, 5, 0, "accept", None, None)]
    a = spark.createDataFrame([*asked, asked[0], (None, 3)], ASKED)
    p = spark.createDataFrame([*replies, *more], REPLY).withColumn("note", F.lit("x"))
    got = {r["candidate_id"]: r for r in N.outcomes(a, p, MOST, WAIT).collect()}
    asks = {}
    for r in N.requests(a, p, MOST, WAIT).collect():
        asks.setdefault(r["candidate_id"], []).append((r["attempt"], r["at"], r["complaint"]))
    assert len(got) == len(asked) + 1 and got["nobody"]["status"] == "unknown_id"
    for name, at in asked:
        want, again = plain(at, [r for r in replies if r[0] == name])
        r = got[name]
        assert (r["status"], r["attempt"], r["decision"], r["n_asked"], r["closed_at"]) == want, name
        assert sorted(asks.get(name, [])) == again, name
    assert N.outcomes(a.limit(0), p.limit(0)).count() == 0 == N.requests(a.limit(0), p).count()


def test_stream_of_late_double_and_wrong_replies_equals_the_tables(spark, tmp_path):
    asked, replies = sample(9, 60)
    every = sorted([(n, 0, at, 0, None, None, None) for n, at in asked] + replies + replies[::3], key=lambda r: (r[2], r[1] == 0 and -1 or 0))
    # Four batches in the order of time, then one row long after that lets all timers run out.
    # Times begin at 1, as a row of time 0 is late from the start: the watermark begins there.
    size = len(every) // 4 + 1
    parts = [every[i : i + size] for i in range(0, len(every), size)] + [[("end", 0, 10_000_000, 0, None, None, None)], [("end", 0, 20_000_000, 0, None, None, None)]]
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    frame = lambda part: spark.createDataFrame(part, REPLY).withColumn("at", F.timestamp_millis("at"))
    schema = frame(parts[0]).schema
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            frame(part).coalesce(1).write.mode("append").parquet(source)
            # Each part is a run of its own: state and timers are read back from the checkpoint.
            q = stream.events(spark.readStream.schema(schema).parquet(source), MOST, WAIT, "1 millisecond")
            q.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset(store)
    got = spark.read.parquet(out).where("candidate_id <> 'end'").collect()
    a, p = spark.createDataFrame(asked, ASKED), spark.createDataFrame(replies, REPLY)
    want = {r["candidate_id"]: (r["status"], r["attempt"] if r["status"] == "settled" else MOST, r["closed_at"], r["decision"], r["fault"]) for r in N.outcomes(a, p, MOST, WAIT).collect()}
    closed = [r for r in got if r["event"] in ("settled", "failed")]
    assert len(closed) == len(asked) and {r["candidate_id"]: (r["event"], r["attempt"], r["at"], r["decision"], r["complaint"]) for r in closed} == want
    again = sorted((r["candidate_id"], r["attempt"], r["at"], r["complaint"]) for r in got if r["event"] == "ask_again")
    assert again == sorted(map(tuple, N.requests(a, p, MOST, WAIT).collect()))


def test_queries_equal_sql(spark, duck):
    sql = oracles.oracle_sql()
    for name in ("retry_outcomes", "retry_requests"):
        assert rows(registry.queries()[name](spark, "/root/testdata/sf0.001").toPandas()) == rows(duck.execute(sql[name]).df())
