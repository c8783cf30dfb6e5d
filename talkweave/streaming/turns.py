"""Chunks of speech -> what has been heard of each turn, in order and once.

The state of a session is keyed by its id and lives in the state store: the turns that are open with the text heard so far, chunks that came
ahead of their place, and the numbers of the turns that have ended.  Only sessions with new chunks or a due timer are touched in a
micro-batch.  Three clocks end things, all on the watermark of the chunks' time ``at``:

* a chunk that is older than the watermark is dropped by the operator;
* an open turn that stays silent for ``silence_s`` ends with what has been heard, gaps left out;
* a session that stays silent for ``idle_s`` goes, with everything the store held for it.

A chunk that is repeated, or comes after its turn has ended, changes nothing.  A chunk ahead of its place waits for the ones before; a
cumulative chunk replaces what was heard before it and does not wait.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HEARD_DDL = "session_id string, turn int, seq int, t double, at_ms long, text string, complete boolean, ended_by string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turns(StatefulProcessor):
    """One row for each chunk that extends what has been heard of a turn; ``complete`` in the row that ends it."""

    def __init__(self, silence_s: float, idle_s: float):
        self.silence, self.idle = int(1000 * silence_s), int(1000 * idle_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "turn int", "next int, text string, t double, at_ms long")
        self.ahead = handle.getMapState("ahead", "turn int, seq int", "t double, text string, cumulative boolean, is_end boolean, at_ms long")
        self.closed = handle.getMapState("closed", "turn int", "at_ms long")
        self.clock = handle.getValueState("clock", "last long, silence long, idle long")

    def _rows_ahead(self, turn: int) -> list[int]:
        return sorted(k[1] for k in self.ahead.keys() if k[0] == turn)

    def _end(self, key, turn: int, seq: int, t: float, at: int, text: str, why: str) -> Row:
        self.open.removeKey((turn,))
        for seq_ahead in self._rows_ahead(turn):
            self.ahead.removeKey((turn, seq_ahead))
        self.closed.updateValue((turn,), (at,))
        return Row(session_id=key[0], turn=turn, seq=seq, t=t, at_ms=at, text=text, complete=True, ended_by=why)

    def _advance(self, key, turn: int, gaps: bool) -> Iterator[Row]:
        """Takes the chunks that are next in turn, or all that wait when gaps don't count any more."""
        nxt, text, t, at = self.open.getValue((turn,)) if self.open.containsKey((turn,)) else (0, "", 0.0, 0)
        for seq in self._rows_ahead(turn):
            c = self.ahead.getValue((turn, seq))
            if seq > nxt and not gaps and not c[2]:
                continue                                         # a later one may be cumulative
            self.ahead.removeKey((turn, seq))
            if seq < nxt:
                continue
            said = (c[1] or "").strip()
            text = said if c[2] else f"{text} {said}".strip()
            nxt, t, at = seq + 1, c[0], max(at, c[4])
            if c[3]:
                yield self._end(key, turn, seq, t, at, text, "chunk")
                return
            yield Row(session_id=key[0], turn=turn, seq=seq, t=t, at_ms=at, text=text, complete=False, ended_by=None)
        if gaps:
            yield self._end(key, turn, max(nxt - 1, 0), t, at, text, "silence")
        else:
            self.open.updateValue((turn,), (nxt, text, t, at))

    def _set_clock(self, last: int) -> None:
        if self.clock.exists():
            old = self.clock.get()
            for at in {old[1], old[2]}:
                self.handle.deleteTimer(at)
        due = last + self.silence, last + self.idle
        for at in set(due):
            self.handle.registerTimer(at)
        self.clock.update((last, *due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        touched, last = set(), self.clock.get()[0] if self.clock.exists() else 0
        for r in rows:
            last = max(last, r.at_ms)
            if self.closed.containsKey((r.turn,)) or (self.open.containsKey((r.turn,)) and r.seq < self.open.getValue((r.turn,))[0]):
                continue
            self.ahead.updateValue((r.turn, r.seq), (r.t, r.text, bool(r.cumulative), bool(r.is_end), r.at_ms))
            touched.add(r.turn)
        for turn in sorted(touched):
            yield from self._advance(key, turn, False)
        self._set_clock(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.clock.exists():
            return
        now, last = expiredTimerInfo.getExpiryTimeInMs(), self.clock.get()[0]
        if now >= last + self.silence:
            for turn in sorted({k[0] for k in self.open.keys()} | {k[0] for k in self.ahead.keys()}):
                yield from self._advance(key, turn, True)
        if now >= last + self.idle:
            for state in (self.open, self.ahead, self.closed, self.clock):
                state.clear()

    def close(self) -> None:
        pass


def heard(chunks: DataFrame, silence_s: float = 30, idle_s: float = 3600, delay: str = "10 seconds") -> DataFrame:
    """``chunks(session_id, turn, seq, t, at, text, cumulative, is_end)`` -> ``HEARD_DDL``.

    ``seq`` counts a turn's chunks from 0.  ``at`` is when a chunk was recorded; where it is null, ``t`` seconds after 1970 stand for it.
    """
    spark: SparkSession = chunks.sparkSession
    spark.conf.set(STATE_STORE, ROCKS)                           # the only store that keeps maps and timers
    at = F.coalesce(F.col("at"), F.timestamp_seconds(F.coalesce("t", F.lit(0.0))))
    c = chunks.filter("session_id IS NOT NULL AND turn IS NOT NULL AND seq IS NOT NULL").withColumn("at", at)
    c = c.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    return c.groupBy("session_id").transformWithState(Turns(silence_s, idle_s), HEARD_DDL, "Append", "EventTime")
