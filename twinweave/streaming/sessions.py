"""Session and folder status while a scan runs, as stateful operators on a stream.

A session's state is one value, and for folders one entry a root below which it
met something. It ends when the session has finished or was silent for long: an
event-time timer then emits its row, once, and clears the state, so what is
kept is bounded by the sessions that are open. (Time-to-live counts by the
clock of the machine, not by event time, so timers do its work here.)

Streams need the RocksDB state store (``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SESSION_SCHEMA = "session_id {key}, items long, errors long, phase string, completed_us long"
FOLDER_SCHEMA = "session_id {key}, root string, items long, errors long"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state with timers needs."""
    spark.conf.set(_PROVIDER, _ROCKSDB)
    return spark


class _Ending(StatefulProcessor):
    """When a session ends: at its finish, or ``silence`` after its last event. Subclasses fold rows and emit."""

    _CLOCK = "last_us long, completed_us long, timer_ms long"

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", self._CLOCK)
        self.open(handle)

    def tick(self, last_us: int, completed_us: int | None) -> None:
        """Move the timer to where the session now ends."""
        before = tuple(self.clock.get()) if self.clock.exists() else (None, None, None)
        last = max(x for x in (before[0], last_us) if x is not None)
        done = max((x for x in (before[1], completed_us) if x is not None), default=None)
        timer = -(-done // 1000) if done is not None else -(-last // 1000) + self.silence_ms
        if timer != before[2]:
            if before[2] is not None:
                self.handle.deleteTimer(before[2])
            self.handle.registerTimer(timer)
        self.clock.update((last, done, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return
        completed = self.clock.get()[1]
        self.clock.clear()
        yield self.emit(key[0], completed)

    def close(self) -> None:
        pass


def _merged_clock(pdf: pd.DataFrame) -> tuple[int, int | None]:
    done = pdf.loc[pdf["kind"] == "finished", "us"]
    return int(pdf["us"].max()), int(done.max()) if len(done) else None


class SessionFold(_Ending):
    """Items, errors, total on finish and last phase of a session."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "items long, errors long, total long, phase string, us long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items, errors, total, phase, at, event = tuple(self.state.get()) if self.state.exists() else (0, 0, 0, None, -1, -1)
        for pdf in rows:
            items += int((pdf["kind"] == "item").sum())
            errors += int((pdf["kind"] == "error").sum())
            total = max(total, int(pdf["total"].max()))
            last = pdf.sort_values(["us", "event_id"]).iloc[-1]
            if (last["us"], last["event_id"]) >= (at, event):
                phase, at, event = last["kind"], int(last["us"]), int(last["event_id"])
            self.tick(*_merged_clock(pdf))
        self.state.update((items, errors, total, phase, at, event))
        return iter(())

    def emit(self, session, completed) -> pd.DataFrame:
        items, errors, total, phase, _, _ = self.state.get()
        self.state.clear()
        return pd.DataFrame({"session_id": [session], "items": [max(items, total)], "errors": [errors], "phase": [phase], "completed_us": pd.array([completed], dtype="Int64")})


class FolderFold(_Ending):
    """Items and errors of a session below each root; a path belongs to the longest root above it."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.roots = handle.getMapState("roots", "root string", "items long, errors long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # an event comes once for each root above it, and all of these in one micro-batch
        longest: dict[int, tuple[int, str, str]] = {}
        for pdf in rows:
            self.tick(*_merged_clock(pdf))
            known = pdf[pdf["root"].notna() & pdf["kind"].isin(["item", "error"])]
            for event, kind, root in zip(known["event_id"], known["kind"], known["root"], strict=True):
                longest[event] = max(longest.get(event, (0, "", "")), (len(root), root, kind))
        found: dict[str, list[int]] = {}
        for _, root, kind in longest.values():
            found.setdefault(root, [0, 0])[kind == "error"] += 1
        for root, (items, errors) in found.items():
            before = self.roots.getValue((root,)) if self.roots.containsKey((root,)) else (0, 0)
            self.roots.updateValue((root,), (before[0] + items, before[1] + errors))
        return iter(())

    def emit(self, session, completed) -> pd.DataFrame:
        found = [(session, k[0], v[0], v[1]) for k, v in self.roots.iterator()]
        self.roots.clear()
        return pd.DataFrame(found, columns=["session_id", "root", "items", "errors"])


def _key_type(events: DataFrame) -> str:
    return events.schema["session_id"].dataType.simpleString()


def _clocked(events: DataFrame, delay: str, *more: Column | str) -> DataFrame:
    return events.withWatermark("ts", delay).select("session_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "kind", *more)


def _folded(rows: DataFrame, processor: StatefulProcessor, schema: str | StructType) -> DataFrame:
    return rows.groupBy("session_id").transformWithStateInPandas(processor, schema, outputMode="append", timeMode="EventTime")


def session_stream(events: DataFrame, delay: str = "1 hour", silence_s: int = 86_400) -> DataFrame:
    """(session_id, items, errors, phase, completed_at) of each session, once it is over.

    It is over when the watermark passes its last ``finished`` event, or
    ``silence_s`` after its last event. An event of a session that is over
    opens it anew, as a second row; one later than the watermark is dropped.
    """
    total = F.coalesce(F.when(F.col("kind") == "finished", F.floor("value").cast("long")), F.lit(0).cast("long")).alias("total")
    out = _folded(_clocked(events, delay, total), SessionFold(silence_s * 1000), SESSION_SCHEMA.format(key=_key_type(events)))
    return out.select("session_id", "items", "errors", "phase", F.timestamp_micros("completed_us").alias("completed_at"))


def folder_stream(events: DataFrame, roots: DataFrame, above: Column, delay: str = "1 hour", silence_s: int = 86_400) -> DataFrame:
    """(session_id, root, items, errors) of each session and root below which it met something, once the session is over.

    ``above`` is the array of folders above an event's path, which is met with
    the static ``roots`` by an equi-join. ``event_id`` tells events apart.
    """
    rows = _clocked(events, delay, F.explode_outer(above).alias("folder"))
    known = roots.select(F.col("root").alias("folder"), F.col("root")).distinct()
    return _folded(rows.join(known, "folder", "left").drop("folder"), FolderFold(silence_s * 1000), FOLDER_SCHEMA.format(key=_key_type(events)))
