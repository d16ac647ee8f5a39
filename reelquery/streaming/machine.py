"""The multi-turn search as a live state machine: one state for each sample, fed with the turns as they are answered.

Turn 1 retrieves with the sample's query. A turn answered `matched` ends the search; else the next turn retrieves with the
query and, on a line below it, the turn's instruction if it gave one; after `max_turns` turns the search ends. Turns are worked
off in order of their number whatever the order in which they arrive: early ones wait in the sample's state, turns of a
search that has ended and turns that were answered before change nothing.

State is bounded: of a sample at most `max_turns` waiting turns and one small row. A search in which nothing happens for `idle`
(by event time) ends as `expired` if it was open, and its state is removed; so do searches that have ended.

`turns.search_turns` gives the same rows from a table of all turns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_TURN = "query string, answer string, instruction string, retrieved string, truth string"
OUT = "idx bigint, turn int, search_query string, answer string, answer_ok boolean, instruction_ok boolean, correct_accept boolean, correct_reject boolean, state string, next_query string"
_Out = Row(*[x.split()[0] for x in OUT.split(", ")])


def step(turn: int, base: str, used: str, t: tuple, max_turns: int) -> tuple:
    """The row of a turn (without idx): t is query, answer, instruction, retrieved, truth."""
    _, answer, instruction, retrieved, truth = t
    matched, refused = answer == "matched", answer == "not_matched"
    right = retrieved is not None and retrieved == truth
    state = "matched" if matched else "max_turn" if turn >= max_turns else "active"
    following = None if state != "active" else f"{base}\n{instruction}" if instruction else base
    return turn, used, answer, matched or refused, refused and bool(instruction), right and matched, not right and refused, state, following


class Search(StatefulProcessor):
    """State of a sample: the next turn's number, the sample's query, the query of the next turn, how it ended, the time of its
    last turn, and which turns wait (a bit for each; the turns themselves are a map)."""

    def __init__(self, max_turns: int, idle_ms: int):
        self.max_turns, self.idle_ms = max_turns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next int, base string, used string, ended string, last bigint, held bigint")
        self.waiting = handle.getMapState("waiting", "turn int", _TURN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.place.get()
        after, base, used, ended, last, held = known or (1, None, None, None, timerValues.getCurrentWatermarkInMs(), 0)
        new: dict[int, tuple] = {}
        for r in rows:
            last = max(last, r.at_ms)
            if ended is None and after <= r.turn and not held >> r.turn & 1:  # the one that came first counts
                new.setdefault(r.turn, (r.query, r.answer, r.instruction, r.retrieved, r.truth))
        while ended is None and (after in new or held >> after & 1):
            if after in new:
                t = new.pop(after)
            else:
                t = tuple(self.waiting.getValue((after,)))
                self.waiting.removeKey((after,))
                held ^= 1 << after
            if after == 1:
                base = used = t[0]
            row = step(after, base or "", used or "", t, self.max_turns)
            yield _Out(key[0], *row)
            used, after = row[-1], after + 1
            ended = None if row[-2] == "active" else row[-2]
        if ended is None:
            for turn, t in new.items():
                self.waiting.updateValue((turn,), t)
                held |= 1 << turn
        elif held:
            self.waiting.clear()
            held = 0
        if not known:
            self.handle.registerTimer(last + self.idle_ms)
        self.place.update((after, base, used, ended, last, held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        after, _, used, ended, last, _ = self.place.get()
        if last + self.idle_ms > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(last + self.idle_ms)  # something has happened since the timer was set
            return
        self.place.clear()
        self.waiting.clear()
        if ended is None:
            yield _Out(key[0], after, used, None, None, None, None, None, "expired", None)


def search(turns: DataFrame, max_turns: int, idle: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """A stream of turn rows, each as it is worked off. turns: a stream of idx, turn (from 1), at (a timestamp), query, answer,
    instruction, retrieved, truth. Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).

    Rows without idx, turn or at are left out, and turns beyond max_turns (62 at most) never reach the state.
    """
    if not 1 <= max_turns <= 62:
        raise ValueError("max_turns is from 1 to 62")
    spark = turns.sparkSession
    idle_ms = int(spark.range(1).select((F.unix_millis(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"interval {idle}")) - F.unix_millis(F.lit("1970-01-01 00:00:00").cast("timestamp"))).alias("ms")).first()[0])
    rows = turns.where("idx is not null and at is not null").where(F.col("turn").between(1, max_turns)).withWatermark("at", late)
    text = [F.col(c).cast("string").alias(c) for c in ("query", "answer", "instruction", "retrieved", "truth")]
    rows = rows.select(F.col("idx").cast("bigint").alias("idx"), F.col("turn").cast("int").alias("turn"), "at", F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), *text)
    return rows.groupBy("idx").transformWithState(statefulProcessor=Search(max_turns, idle_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
