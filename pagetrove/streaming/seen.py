"""Repeat sightings in a stream."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What a session needs while a query with ``seen_in_order`` is started.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass",
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

# Instants of a piece of what a key has waiting.
PIECE_ROWS = 4_096


def drop_seen(sightings: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """No key twice within the TTL, by watermark.

    State is dropped when the watermark passes, and that trails the newest
    sighting: a repeat may stay suppressed for longer than the TTL, never for
    less. ``seen_stream`` follows the rule to the instant.
    """
    return sightings.withWatermark(ts, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark([key])


def seen_stream(sightings: DataFrame, ttl: int, lateness: int = 0) -> DataFrame:
    """``seen_within_ttl`` over a stream (key, t, id); ``t`` and ``ttl`` in microseconds.

    Equal to the batch form if micro-batches arrive in time order. Spark keeps each key's last
    emitted instant, and drops it TTL plus ``lateness`` later. A sighting older than its
    key's last emitted one is suppressed. A task holds the instants of one key in one micro-batch.
    """
    kind = sightings.schema["key"].dataType.simpleString()

    def emit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([p[["t", "id"]] for p in parts]).sort_values(["t", "id"])
        t = rows["t"].to_numpy()
        due = state.get[0] + ttl if state.exists else None
        at, kept = 0 if due is None else int(np.searchsorted(t, due)), []
        while at < len(t):
            kept.append(at)
            due = int(t[at]) + ttl
            at = int(np.searchsorted(t, due))
        if due is not None:
            state.update((due - ttl,))
            forget = (due + lateness) // 1000 + 1
            state.setTimeoutTimestamp(max(forget, state.getCurrentWatermarkMs() + 1))
        if kept:
            out = rows.iloc[kept].copy()
            out.insert(0, "key", key[0])
            yield out

    timed = sightings.where(F.col("key").isNotNull()).select("key", "t", "id").withColumn(
        "_ts", F.timestamp_micros("t")
    ).withWatermark("_ts", f"{lateness} microseconds")
    return timed.groupBy("key").applyInPandasWithState(
        emit, f"key {kind}, t long, id long", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def seen_in_order(sightings: DataFrame, ttl: int, lateness: int = 0) -> DataFrame:
    """``seen_within_ttl`` over a stream (key, t, id) whose rows come in any order within ``lateness``.

    ``t``, ``ttl`` and ``lateness`` in microseconds, ``t`` after 1970. A row waits in RocksDB until the watermark
    has passed its millisecond; then the key's timer takes what was passed, in order, so the result
    is that of the batch form, whatever the micro-batches. A row is at once let go if it falls into the TTL of what
    its key emitted. Rows not after the watermark are too late and count for nothing. What waits is kept in
    pieces of at most PIECE_ROWS instants, one id each, that follow each other in time, so few calls serve many rows and no step
    holds a key's rows together but for the first instants of its pieces. A key is forgotten a TTL after its last emission.
    What the watermark has not passed when the stream ends is still waiting.

    A row without a key moves the watermark and is dropped. Start the query with ROCKSDB set.
    """
    kind = sightings.schema["key"].dataType.simpleString()

    # Inside, so that executors need not have this module.
    def least_ids(t: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct instants in order, each with its smallest id."""
        order = np.lexsort((own, t))
        t, own = t[order], own[order]
        first = np.r_[True, t[1:] != t[:-1]]
        return t[first], own[first]

    class Sightings(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # The last emission, the instant of the timer and the first instant of each piece, in order.
            self.head = handle.getValueState("head", "last long, timer long, starts array<long>")
            self.waiting = handle.getMapState("waiting", "start long", "t array<long>, id array<long>")

        def _head(self) -> tuple[int | None, int | None, list[int]]:
            head = self.head.get()
            return (None, None, []) if head is None else (head[0], head[1], list(head[2]))

        def _keep(self, last: int | None, timer: int | None, starts: list[int], passed: int) -> None:
            """Keeps the state with one timer: for the first instant that waits, else to forget the key."""
            due = starts[0] // 1000 + 1 if starts else None if last is None else (last + ttl) // 1000 + 1
            if due is not None and not starts and due <= passed:
                due = None
            if timer is not None and timer != due:
                self.handle.deleteTimer(timer)
            if due is None:
                self.head.clear()
                return
            if timer != due:
                self.handle.registerTimer(due)
            self.head.update((last, due, starts))

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            (last, timer, starts), passed = self._head(), timerValues.getCurrentWatermarkInMs()
            least = passed * 1000 if last is None else max(passed * 1000, last + ttl)
            changed = False
            for part in rows:
                live = part[part["t"] >= least]
                if len(live):
                    t, own = (live[name].astype("int64").to_numpy() for name in ("t", "id"))
                    starts, changed = self._put(starts, *least_ids(t, own)), True
            if changed:
                self._keep(last, timer, starts, passed)
            yield from ()

        def _put(self, starts: list[int], t: np.ndarray, own: np.ndarray) -> list[int]:
            """Merges sorted instants into the pieces they belong to; pieces that grow too long are split."""
            place = np.maximum(np.searchsorted(np.array(starts, dtype="int64"), t, side="right") - 1, 0)
            cuts = np.flatnonzero(np.diff(place)) + 1
            new = dict.fromkeys(starts)
            for at, more, ids in zip(place[np.r_[0, cuts]], np.split(t, cuts), np.split(own, cuts)):
                if starts:
                    old = starts[at]
                    there = self.waiting.getValue((old,))
                    more, ids = least_ids(np.r_[there[0], more], np.r_[there[1], ids])
                    if more[0] != old:
                        self.waiting.removeKey((old,))
                        del new[old]
                n = PIECE_ROWS if len(more) <= PIECE_ROWS else max(PIECE_ROWS // 2, 1)
                for i in range(0, len(more), n):
                    self.waiting.updateValue((int(more[i]),), (more[i : i + n].tolist(), ids[i : i + n].tolist()))
                    new[int(more[i])] = None
            return sorted(new)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            last, _, starts = self._head()
            passed = timerValues.getCurrentWatermarkInMs()
            done = 0  # pieces taken
            while done < len(starts) and starts[done] < passed * 1000:
                t, own = (np.array(a, dtype="int64") for a in self.waiting.getValue((starts[done],)))
                self.waiting.removeKey((starts[done],))
                end, at, kept = int(np.searchsorted(t, passed * 1000)), 0, []
                if last is not None:
                    at = int(np.searchsorted(t, last + ttl))
                while at < end:
                    last = int(t[at])
                    kept.append(at)
                    at = max(at + 1, int(np.searchsorted(t, last + ttl)))
                if kept:
                    yield pd.DataFrame({"key": [key[0]] * len(kept), "t": t[kept], "id": own[kept]})
                if end < len(t):
                    starts[done] = int(t[end])
                    self.waiting.updateValue((starts[done],), (t[end:].tolist(), own[end:].tolist()))
                    break
                done += 1
            self._keep(last, None, starts[done:], passed)

        def close(self) -> None:
            pass

    # The condition names the instant, else it would be moved below the watermark, which then missed those rows.
    timed = sightings.select("key", "t", "id", F.timestamp_micros("t").alias("_ts")).withWatermark(
        "_ts", f"{lateness} microseconds").where(F.col("key").isNotNull() | F.col("_ts").isNull())
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Sightings(), outputStructType=f"key {kind}, t long, id long", outputMode="append", timeMode="EventTime")
