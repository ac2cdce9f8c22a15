"""Conversations ingested as they grow (M1, M2, K18): turns come in any order and any split over files,
and what is kept is what the batch operator gives for all turns so far.

State per conversation is what the next turns may still change: the open exchange, turns that came before
their time, and how far the run of turns has come. Each micro-batch writes the exchanges that it
changed, under its number; a batch that is repeated overwrites its own folder, so each is there once.
`current` is the last form of every exchange. No conversation is closed at first sight, and no batch
reads a ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EXCHANGE = "conv_id long, exchange long, question string, answers array<string>, n_answers int, closed boolean"


class OpenExchanges(StatefulProcessor):
    """W3 over a stream. A user turn opens an exchange and closes the one before; assistant turns go to the open
    one; what stands before the first user turn, and other roles, are left out. Turns are used in
    the order of their numbers, from `first_turn` on without gaps; those beyond a gap wait, and are shown as
    if nothing came between. With `idle`, a conversation that is silent for so many seconds gives up waiting for
    what lies in its gaps; a turn that comes after that is not lost but given as a row without exchange number.
    A turn that was there already is left out."""

    def __init__(self, first_turn: int = 0, idle: float | None = None):
        self.first_turn, self.idle = first_turn, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "next long, exchange long, question string, answers array<string>, gaps array<long>")
        self.waiting = handle.getMapState("waiting", "turn long", "role string, text string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        turns = (t for frame in rows for t in zip(frame["turn"], frame["role"], frame["text"].where(frame["text"].notna(), None), strict=True))
        yield self._rows(key, self._changed(turns, timerValues))

    def _changed(self, turns: Iterable[tuple[int, str, str | None]], timers: Any) -> list[tuple]:
        """The exchanges that turns change. A call of the state is a message to the JVM, so there are as few as can be: what
        waits is read once, and not for a conversation that is seen first."""
        known = self.run.get()
        place, exchange, question, answers, gaps = self._state(known)
        before = {} if known is None else {int(t[0]): tuple(v) for t, v in self.waiting.iterator()}
        out, early = [], dict(before)
        for turn, role, text in turns:
            turn = int(turn)
            if turn < place:
                if any(a <= turn < b for a, b in zip(gaps[::2], gaps[1::2], strict=True)):
                    out.append((None, text, [], True))
            elif turn not in early:
                early[turn] = (role, text)
        while place in early:
            exchange, question, answers = self._take(early.pop(place), exchange, question, answers, out)
            place += 1
        if before and not early:
            self.waiting.clear()
        for turn in before.keys() - early.keys() if early else ():
            self.waiting.removeKey((turn,))
        for turn in early.keys() - before.keys():
            self.waiting.updateValue((turn,), early[turn])
        if (now := (place, exchange, question, answers, gaps)) != known:
            self.run.update(now)
        self._alarm(timers)
        return out + self._shown(early, exchange, question, answers)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._rows(key, self._given_up())

    def _given_up(self) -> list[tuple]:
        """The exchanges of a conversation that waits no longer."""
        place, exchange, question, answers, gaps = self._state(self.run.get())
        out, early = [], {int(t[0]): tuple(v) for t, v in self.waiting.iterator()}
        for turn in sorted(early):
            gaps = gaps + [place, turn] if turn > place else gaps
            exchange, question, answers = self._take(early[turn], exchange, question, answers, out)
            place = turn + 1
        self.waiting.clear()
        self.run.update((place, exchange, question, answers, gaps))
        return out + self._shown({}, exchange, question, answers)

    def close(self) -> None:
        pass

    def _state(self, known: tuple | None) -> tuple[int, int, str | None, list[str | None], list[int]]:
        if known is None:
            return self.first_turn, 0, None, [], []
        place, exchange, question, answers, gaps = known
        return int(place), int(exchange), question, [*answers] if answers is not None else [], [int(g) for g in gaps] if gaps is not None else []

    @staticmethod
    def _take(turn: tuple, exchange: int, question: str | None, answers: list, out: list) -> tuple[int, str | None, list]:
        role, text = turn
        if role == "user":
            if exchange:
                out.append((exchange, question, answers, True))
            return exchange + 1, text, []
        return exchange, question, [*answers, text] if role == "assistant" and exchange else answers

    def _shown(self, early: dict[int, tuple], exchange: int, question: str | None, answers: list) -> list[tuple]:
        """The open exchange, and those that the waiting turns make, for now."""
        out: list[tuple] = []
        for turn in sorted(early):
            exchange, question, answers = self._take(early[turn], exchange, question, answers, out)
        return [(e, q, a, False) for e, q, a, _ in out] + ([(exchange, question, answers, False)] if exchange and answers else [])

    @staticmethod
    def _rows(key: Any, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame({"conv_id": [key[0]] * len(rows), "exchange": pd.array([r[0] for r in rows], dtype="Int64"), "question": pd.Series([r[1] for r in rows], dtype=object), "answers": pd.Series([r[2] for r in rows], dtype=object), "n_answers": [len(r[2]) for r in rows], "closed": [r[3] for r in rows]})
        return frame.astype({"conv_id": "int64", "n_answers": "int32", "closed": "bool"})

    def _alarm(self, timers: Any) -> None:
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.idle * 1000))


class OpenExchangeRows(OpenExchanges):
    """The same with rows in and out: a data frame for each conversation costs more than its turns."""

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        yield from self._listed(key, self._changed(((r["turn"], r["role"], r["text"]) for r in rows), timerValues))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802
        yield from self._listed(key, self._given_up())

    @staticmethod
    def _listed(key: Any, rows: list[tuple]) -> Iterator[Row]:
        return (Row(conv_id=key[0], exchange=e, question=q, answers=a, n_answers=len(a), closed=c) for e, q, a, c in rows)


def open_exchanges(turns: DataFrame, first_turn: int = 0, idle: float | None = None) -> DataFrame:
    """M1. The exchanges that every micro-batch changes, from a stream of conv_id, turn, role and text. The
    session's state store must be RocksDB."""
    given = turns.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return given.groupBy("conv_id").transformWithState(OpenExchangeRows(first_turn, idle), EXCHANGE, "Update", "ProcessingTime" if idle is not None else "None")


def ingest(turns: DataFrame, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None, first_turn: int = 0, idle: float | None = None) -> StreamingQuery:
    """M1, M2. Runs over what is there and writes, for every micro-batch, the exchanges changed to out/exchanges, and
    what `process` makes of them (chunks, say, with conv_id and exchange) to out/chunks."""
    spark = turns.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)

    def each(batch: DataFrame, number: int) -> None:
        here = f"{out}/exchanges/batch={number}"
        batch.write.mode("overwrite").parquet(here)
        if process is not None:
            changed = batch.sparkSession.read.schema(EXCHANGE).parquet(here)
            process(changed.where("exchange is not null")).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")

    try:
        changes = open_exchanges(turns, first_turn, idle)
        return changes.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _latest(written: DataFrame, columns: list[str]) -> DataFrame:
    last = written.groupBy("conv_id", "exchange").agg(F.max("batch").alias("batch"))
    return written.join(last, ["conv_id", "exchange", "batch"], "left_semi").select(*columns)


def current(spark: SparkSession, out: str) -> DataFrame:
    """W3. The exchanges so far: of each the form that the last batch gave it."""
    written = spark.read.schema(f"{EXCHANGE}, batch long").parquet(f"{out}/exchanges").where("exchange is not null")
    return _latest(written, ["conv_id", "exchange", "question", "answers", "n_answers"])


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """R16. The chunks of the exchanges in their present form: an exchange that grew replaces its chunks."""
    exchanges = spark.read.schema(f"{EXCHANGE}, batch long").parquet(f"{out}/exchanges").where("exchange is not null")
    last = exchanges.groupBy("conv_id", "exchange").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/chunks").join(last, ["conv_id", "exchange", "batch"], "left_semi").drop("batch")


def late_turns(spark: SparkSession, out: str) -> DataFrame:
    """Turns that came after their conversation had given up waiting for them: conv_id and text."""
    return spark.read.schema(f"{EXCHANGE}, batch long").parquet(f"{out}/exchanges").where("exchange is null").select("conv_id", F.col("question").alias("text"))


def processed(spark: SparkSession, out: str) -> DataFrame:
    """K18, M2. The ledger, as a view of what is written: conv_id, exchanges, and the last batch with a change."""
    written = spark.read.schema(f"{EXCHANGE}, batch long").parquet(f"{out}/exchanges").where("exchange is not null")
    return written.groupBy("conv_id").agg(F.max("exchange").alias("exchanges"), F.max("batch").alias("last_batch"))
