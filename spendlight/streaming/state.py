"""Streams with state of their own: exact windows of repeated keys, and the newest status of a case."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The store that keeps state beside timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started in the block keep their state in a store that has timers."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


class FirstInTtl(StatefulProcessor):
    """Takes an event if its key wasn't taken within the ttl before; each taken event arms the ttl anew.

    The state of a key is the time it was last taken, and a timer clears it when event time has passed the ttl.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get()
        last = known[0] if known else None
        before = last
        for at, event_id in sorted((r["at"], r["event_id"]) for r in rows):
            if last is None or at >= last + self.ttl:
                last = at
                yield Row(idempotency_key=key[0], event_id=event_id)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.last.update((last,))
            self.handle.registerTimer(self._end(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if known and self._end(known[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def _end(self, at: int) -> int:
        """The first millisecond at which the ttl of an event is over."""
        return -(-(at + self.ttl) // 1000)

    def close(self) -> None:
        pass


def first_in_ttl(events: DataFrame, ttl_seconds: int = 3600, delay: str = "1 hour") -> DataFrame:
    """``(idempotency_key, event_id)`` of the events of a stream that are taken; ``events`` has a timestamp ``ts``.

    Events that come in order of time up to ``delay`` are decided as the batch form decides them; null keys and times have no place in a stream.
    Start the stream inside ``timed_state``.
    """
    dated = events.where("idempotency_key is not null and ts is not null").withWatermark("ts", delay)
    slim = dated.selectExpr("idempotency_key", "event_id", "unix_micros(ts) as at", "ts")
    kinds = dict(events.dtypes)
    shape = f"idempotency_key {kinds['idempotency_key']}, event_id {kinds['event_id']}"
    return slim.groupBy("idempotency_key").transformWithState(statefulProcessor=FirstInTtl(ttl_seconds), outputStructType=shape, outputMode="Append", timeMode="EventTime")
