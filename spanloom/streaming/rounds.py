"""Replies over several attempts as a stream: the rules of :mod:`spanloom.operators.rounds`, kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from ..operators.rounds import MISSING

EVENTS = "candidate_id string, event string, attempt long, at long, decision string, code string, complaint string"
#: Built by hand, as workers have no session that could read it from text.
STATE = StructType().add("attempt", IntegerType()).add("since", LongType()).add("seen", LongType()).add("closed", BooleanType())


def _event(key, event, attempt=None, at=None, decision=None, code=None, complaint=None) -> Row:
    return Row(candidate_id=key, event=event, attempt=attempt, at=at, decision=decision, code=code, complaint=complaint)


class _Rounds(StatefulProcessor):
    """A candidate's state: the open attempt, since when, which attempts have replied (bits), whether closed."""

    def __init__(self, most: int, wait: int):
        self.most, self.wait = most, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("round", STATE)

    def close(self) -> None:
        pass

    def _ends(self, key, s, at, complaint):
        """The open attempt ends: the next is asked, or the candidate has failed."""
        attempt, _, seen, _ = s
        if attempt < self.most:
            return (attempt + 1, at, seen, False), _event(key, "ask_again", attempt + 1, at, complaint=complaint)
        return (attempt, at, seen, True), _event(key, "failed", attempt, at, complaint=complaint)

    def _expired(self, key, s, now):
        """Attempts whose time was over before ``now``."""
        while not s[3] and s[1] + self.wait < now:
            s, out = self._ends(key, s, s[1] + self.wait, MISSING)
            yield s, out

    def _wake(self, before, s):
        """The timer of the open attempt in place of the one before."""
        if before and not before[3]:
            self.handle.deleteTimer(before[1] + self.wait)
        if not s[3]:
            self.handle.registerTimer(s[1] + self.wait)

    def _first(self, rows):
        """Of many rows the asking, and the first reply of each attempt: no more than the attempts are held."""
        asked, firsts = None, {}
        for r in rows:
            if r.attempt == 0:
                asked = r.at if asked is None else min(asked, r.at)
            elif r.attempt is not None and 1 <= r.attempt <= self.most:
                rank = (r.at, r.fault is not None, r.attempt, r.pos)
                if r.attempt not in firsts or rank < firsts[r.attempt][0]:
                    firsts[r.attempt] = (rank, r)
        return asked, [r for _, r in sorted(firsts.values(), key=lambda x: x[0])]

    def handleInputRows(self, key, rows, timerValues):
        name = key[0]
        asked, replies = self._first(rows)
        before = s = self.state.get()
        if s is None:
            if asked is None:
                yield _event(name, "unknown_id")
                return
            s = (1, asked, 0, False)
        for r in replies:
            for s, out in self._expired(name, s, r.at):
                yield out
            bit = 1 << r.attempt
            if s[3] or s[2] & bit:
                continue
            s = (s[0], s[1], s[2] | bit, False)
            if r.fault is None:
                s = (s[0], s[1], s[2], True)
                yield _event(name, "settled", r.attempt, r.at, r.decision, r.code)
            elif r.attempt == s[0] and r.at >= s[1]:
                s, out = self._ends(name, s, r.at, r.fault)
                yield out
        self._wake(before, s)
        self.state.update(s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = s = self.state.get()
        if s is None or s[3] or s[1] + self.wait > expiredTimerInfo.getExpiryTimeInMs():
            return
        # The watermark may be past several attempts' ends by now.
        for s, out in self._expired(key[0], s, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)):
            yield out
        if not s[3]:
            self.handle.registerTimer(s[1] + self.wait)
        self.state.update(s)


def events(stream: DataFrame, most: int = 3, wait: int = 60_000, late: str = "1 minute") -> DataFrame:
    """Events of a stream of askings (attempt 0) and replies: settled, ask_again, failed, unknown_id.

    ``stream`` has candidate_id, attempt, at (timestamp), pos, decision, code, fault. Replies of a candidate
    come in the order of time, or in one batch; what comes twice is told once. Attempts without reply
    end by timers of the event time, which moves on with any row. Closed candidates keep a small state, so that
    replies that come afterwards change nothing. The state lies in the store of keyed state (RocksDB),
    with the query's checkpoint.
    """
    rows = stream.where("candidate_id is not null and at is not null").withWatermark("at", late)
    rows = rows.select("candidate_id", F.col("attempt").cast("int").alias("attempt"), F.unix_millis("at").alias("at"), "pos", "decision", "code", "fault", F.col("at").alias("event_at"))
    return rows.groupBy("candidate_id").transformWithState(_Rounds(most, wait), StructType.fromDDL(EVENTS), "Append", "EventTime")
