"""Jobs of many items as a stateful processor: state and open items kept per job, one item a step, a cancel seen between items.

Commands (enqueue with items, claim, cancel, recover) arrive on a stream. A running
job takes one item at each turn of its timer, so that a cancel that arrives
meanwhile is seen before the next item. State is a value, open items are a map by place, so a
turn reads and writes one of them; both outlive a restart with the stream's checkpoint,
after which timers run again with the first new command. RocksDB must be the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.merges import TRANSITIONS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "job_id string, state string, done bigint, total bigint, item string"


def use_rocksdb(spark: SparkSession) -> None:
    """What the session needs before a stream of :func:`processed` starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class JobProcessor(StatefulProcessor):
    """One job: its state, how many items are done of how many, and the items still open.

    A row is put out for every item taken and for every change of state. Commands of
    a batch are taken in the order of ``seq``; one that does not fit the state is passed over. An
    item whose turn has come is done at once, the next one in another batch, ``wait_ms`` later at least; with no item left the job finishes.
    """

    def __init__(self, wait_ms: int = 1):
        # A timer set again for the very time at which it fires is lost.
        self.wait_ms = max(1, wait_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, done bigint, total bigint")
        self.open = handle.getMapState("open", "place bigint", "item string")

    def _now(self) -> tuple[str, int, int]:
        return tuple(self.state.get()) if self.state.exists() else ("none", 0, 0)

    def _put(self, state: str, done: int, total: int) -> None:
        self.state.update((state, done, total))

    def _tick(self, timers) -> None:
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.wait_ms)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["job_id", "state", "done", "total", "item"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, done, total = self._now()
        out = []
        for _, r in pd.concat(list(rows)).sort_values("seq").iterrows():
            to = TRANSITIONS.get((state, r["event"]))
            if to is None:
                continue
            if r["event"] == "enqueue":
                items = [] if r["items"] is None else list(r["items"])
                for at, item in enumerate(items):
                    self.open.updateValue((at,), (item,))
                done, total = 0, len(items)
            state = to
            out.append((key[0], state, done, total, None))
            if state == "running":
                self._tick(timerValues)
        self._put(state, done, total)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, done, total = self._now()
        if state not in ("running", "cancel_requested"):
            yield self._frame([])
            return
        out = []
        if state == "running" and done < total:
            item = self.open.getValue((done,))[0]
            self.open.removeKey((done,))
            done += 1
            out.append((key[0], state, done, total, item))
        if state == "cancel_requested" or done == total:
            state = TRANSITIONS[state, "finish"]
            self.open.clear()
            out.append((key[0], state, done, total, None))
        else:
            self._tick(timerValues)
        self._put(state, done, total)
        yield self._frame(out)

    def close(self) -> None:
        pass


def processed(commands: DataFrame, wait_ms: int = 1) -> DataFrame:
    """A stream of commands (job_id, seq, event, items) to a stream of ``OUT`` rows."""
    return commands.groupBy("job_id").transformWithStateInPandas(JobProcessor(wait_ms), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")
