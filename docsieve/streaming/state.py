"""State carried over streams: machines of states and questions that are asked again after a time, by ``transformWithState``.

Each has a batch form, an ordered fold, that gives the same rows for the same events. On a stream the rows of a
key within one batch are taken in order of time; rows later than the watermark are dropped. State that
can't matter any more is cleared by a timer on event time, so that what is kept is bounded by the keys
of the last days. Streams need a state store with virtual column families: ``STORE`` names one.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docsieve.operators.folds import ordered_fold

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = 24 * 60 * 60 * 1000
NONE = "none"


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one batch."""
    return pd.concat(list(rows)).sort_values(by)


class Machine(StatefulProcessor):
    """Takes the wanted moves that are allowed from the state of the key; the others leave it."""

    def __init__(self, allowed: dict[str, tuple[str, ...]]):
        self.allowed = {**allowed}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.now.get()[0] if self.now.exists() else NONE
        frame = in_order(rows, ["ts", "event_id"])
        states, taken = [], []
        for wanted in frame["wanted"]:
            taken.append(wanted in self.allowed.get(now, ()))
            now = wanted if taken[-1] else now
            states.append(now)
        self.now.update((now,))
        yield pd.DataFrame({"event_id": frame["event_id"], "key": key[0], "state": states, "taken": taken})

    def close(self) -> None:
        pass


def status_moves(events: DataFrame, key: str, allowed: dict[str, tuple[str, ...]], late: str = "1 hour") -> DataFrame:
    """``event_id``, ``key``, ``state`` after it and ``taken`` of each wanted move (``event_id``, ``ts``, ``wanted``); keys begin in ``NONE``."""
    slim = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col(key).alias("key"), "wanted")
    if slim.isStreaming:
        timed = slim.withWatermark("ts", late).groupBy("key")
        schema = f"event_id bigint, key {dict(slim.dtypes)['key']}, state string, taken boolean"
        return timed.transformWithStateInPandas(Machine(allowed), schema, "Append", "EventTime")

    def step(now: list[str], wanted: str) -> str:
        if wanted in allowed.get(now[0], ()):
            now[0] = wanted
            return f"+{wanted}"
        return now[0]

    moved = ordered_fold(slim, ["key"], ["ts", "event_id"], ["wanted"], lambda: [NONE], step, "moved", "string")
    return moved.select("event_id", "key", F.ltrim("moved", F.lit("+")).alias("state"), F.startswith("moved", F.lit("+")).alias("taken"))


class Asked(StatefulProcessor):
    """Asks at the first occasion and, from then on, when ``days`` have passed since it last did."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        frame = in_order(rows, ["ts", "event_id"])
        ask = []
        for at in frame["ts"]:
            ask.append(last is None or at - last >= pd.Timedelta(days=self.days))
            last = at if ask[-1] else last
        self.last.update((last.to_pydatetime(),))
        self.handle.registerTimer(int(last.timestamp() * 1000) + self.days * DAY_MS)
        yield pd.DataFrame({"event_id": frame["event_id"], "key": key[0], "ask": ask})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What was asked so long ago is as if never; a key asked again since then has a later timer."""
        if self.last.exists():
            last = pd.Timestamp(self.last.get()[0])
            if int(last.timestamp() * 1000) + self.days * DAY_MS <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def asked_again(events: DataFrame, key: str, days: int = 90, late: str = "1 day") -> DataFrame:
    """``event_id``, ``key`` and ``ask`` of each occasion (``event_id``, ``ts``): whether the last question is ``days`` old, or there was none."""
    slim = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col(key).alias("key"))
    if slim.isStreaming:
        schema = f"event_id bigint, key {dict(slim.dtypes)['key']}, ask boolean"
        return slim.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Asked(days), schema, "Append", "EventTime")
    span = datetime.timedelta(days=days)

    def step(last: list, at: datetime.datetime) -> bool:
        ask = not last or at - last[0] >= span
        if ask:
            last[:] = [at]
        return ask

    return ordered_fold(slim, ["key"], ["ts", "event_id"], ["ts"], list, step, "ask", "boolean").select("event_id", "key", "ask")


def into_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch has a folder of its own, which a repeated one writes over, so that it changes nothing."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """Appends what is there to the batches' folders, and stops; to be run again for what comes later."""
    return rows.writeStream.foreachBatch(into_batches(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of upserts, each key's last row by ``order``: what is current."""
    others = F.struct(*order, *[c for c in rows.columns if c not in (*keys, *order)])
    return rows.groupBy(*keys).agg(F.max(others).alias("_last")).select(*keys, "_last.*")
