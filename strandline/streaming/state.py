"""Stateful stream operators by transformWithStateInPandas: typed state, entries with a time to live, event-time timers.

They need the RocksDB state store, which with_rocksdb() sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, ROCKSDB)


class LastAfterQuiet(StatefulProcessor):
    """The last event of a key once no other came for quiet_ms of event time."""

    def __init__(self, quiet_ms: int, columns: list[str], key: str, schema: str):
        self.quiet_ms, self.columns, self.key, self.schema = quiet_ms, columns, key, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"at long, due long, {self.schema}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        done: list[tuple] = []
        events = pd.concat(list(rows))
        events = events.assign(_at=events["at"].astype("int64")).sort_values(["_at", "place"], kind="stable")
        due = held[1] if held else None
        for row in events[["_at", *self.columns]].itertuples(index=False):
            at, values = int(row[0]), tuple(row[1:])
            if held and at - held[0] >= self.quiet_ms:
                done.append(held)  # it was quiet before this one came
            if not held or at >= held[0]:
                held = (at, at + self.quiet_ms, *values)
        if due is not None and due != held[1]:
            self.handle.deleteTimer(due)
        if due != held[1]:
            self.handle.registerTimer(held[1])
        self.last.update(held)
        yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        if held and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            yield self._rows(key, [held])

    def _rows(self, key, held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], h[0], *h[2:]) for h in held], columns=[self.key, "at", *self.columns])

    def close(self) -> None:
        pass


def last_after_quiet(events: DataFrame, key: str, columns: dict[str, str], at: str = "at", place: str = "place", quiet_ms: int = 1000, key_type: str = "string") -> DataFrame:
    """key, at (ms) and columns of each event that no other of its key follows within quiet_ms: the debounced stream.

    events: key, at (event time in ms as a long), place (tells events of one time apart), an event-time column with a watermark, and
    columns with their types. An event comes out when the watermark has passed its quiet time, or when a later one ends it.
    """
    schema = ", ".join(f"{c} {t}" for c, t in columns.items())
    processor = LastAfterQuiet(quiet_ms, list(columns), key, schema)
    return events.groupBy(key).transformWithStateInPandas(processor, f"{key} {key_type}, at long, {schema}", "append", "eventTime")


class ShownIds(StatefulProcessor):
    """Distinct ids of a session: an entry of a map each, which expire together when the session falls silent."""

    def __init__(self, gap_ms: int, ttl_ms: int | None):
        self.gap_ms, self.ttl_ms = gap_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getMapState("shown", "id long", "at long", self.ttl_ms)
        self.session = handle.getValueState("session", "last long, n long, due long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, due = self.session.get() if self.session.exists() else (None, 0, None)
        events = pd.concat(list(rows))
        pairs = sorted(zip(events["at"].astype("int64").tolist(), events["id"].tolist(), strict=True))
        for at, i in pairs:
            if last is not None and at - last > self.gap_ms:
                self.shown.clear()
                n = 0
            if not self.shown.containsKey((i,)):
                self.shown.updateValue((i,), (at,))
                n += 1
            last = at if last is None else max(last, at)
        if due is not None:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(last + self.gap_ms)
        self.session.update((last, n, last + self.gap_ms))
        yield pd.DataFrame({"session_id": [key[0]], "last": [last], "n_shown": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.session.exists() and self.session.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            last = self.session.get()[0]
            self.shown.clear()
            self.session.clear()
            yield pd.DataFrame({"session_id": [key[0]], "last": [last], "n_shown": [0]})

    def close(self) -> None:
        pass


def shown_in_session(log: DataFrame, gap_ms: int = 30 * 60 * 1000, ttl_ms: int | None = None) -> DataFrame:
    """session_id, last (ms) and n_shown: after each batch, the distinct ids shown in a session, and 0 when it has ended.

    log: session_id, id, at (event time in ms as a long), and an event-time column with a watermark. Ids seen after a gap are a new session's.
    ttl_ms: state that wasn't written for so long by the clock goes, even if no watermark passes.
    """
    return log.groupBy("session_id").transformWithStateInPandas(ShownIds(gap_ms, ttl_ms), "session_id long, last long, n_shown long", "update", "eventTime")
