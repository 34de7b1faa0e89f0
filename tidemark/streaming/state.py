"""Streams with state: notebooks carried from step to step, and runs that can be stopped.

Both keep what they know in the checkpoint, so a query that is started again goes on where
it stopped: a file that was read is not read again, and each output row is written once (the
file sink's log and the checkpoint belong to one batch). Restart with the same folders.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

UNIT = ["event_id", "rollout_idx"]


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep keyed state in RocksDB, on the executors' disks; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Carry(StatefulProcessor):
    """Per event: the next step to emit, what the step before left, and the steps that came too early."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.upto = handle.getValueState("upto", "step_idx long, notebook string")
        self.early = handle.getMapState("early", "step_idx long", "notebook string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 (names of the interface)
        step, left = self.upto.get() if self.upto.exists() else (0, None)
        out = []
        for batch in rows:
            for at, notebook in zip(batch["step_idx"], batch["notebook"], strict=True):
                if at >= step and not self.early.containsKey((int(at),)):
                    self.early.updateValue((int(at),), (None if pd.isna(notebook) else notebook,))
        while self.early.containsKey((step,)):
            notebook = self.early.getValue((step,))[0]
            self.early.removeKey((step,))
            out.append((key[0], step, notebook, left))
            step, left = step + 1, notebook
        self.upto.update((step, left))
        yield pd.DataFrame(out, columns=["event_id", "step_idx", "notebook", "prev_notebook"]).astype({"step_idx": "int64"})

    def close(self) -> None:
        pass


def carried_notebook(steps: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Steps (event_id, step_idx from 0 on, notebook) as Parquet with prev_notebook, in whatever order they arrive.

    A step waits in the state until those before it are there. One that comes twice counts once, the
    first time. The state holds one notebook per event and the steps that wait.
    """
    rows = steps.select("event_id", F.col("step_idx").cast("long"), "notebook")
    kind = steps.schema["event_id"].dataType.simpleString()
    with keyed_state(steps.sparkSession):
        out = rows.groupBy("event_id").transformWithStateInPandas(_Carry(), f"event_id {kind}, step_idx long, notebook string, prev_notebook string", "Append", "None")
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Bins(StatefulProcessor):
    """Per event and bin: the best day so far and the places that have come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bins = handle.getMapState("bins", "bin long", "weight double, t long, day string, seen array<long>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        out = []
        for batch in rows:
            for r in batch.itertuples():
                number = min(r.k, r.n)  # bin i holds the places from n i // k to n (i + 1) // k
                at, size = int(r.bin), r.n * (r.bin + 1) // number - r.n * r.bin // number
                best, t, day, seen = self.bins.getValue((at,)) if self.bins.containsKey((at,)) else (-math.inf, -1, None, [])
                if r.t in seen or day == "":  # told before
                    continue
                seen = [*seen, int(r.t)]
                if (r.weight, r.t) > (best, t):
                    best, t, day = float(r.weight), int(r.t), r.day
                if len(seen) == size:
                    out.append((key[0], at, day, best))
                    day, seen = "", []
                self.bins.updateValue((at,), (best, t, day, seen))
        yield pd.DataFrame(out, columns=["event_id", "bin", "day", "weight"]).astype({"bin": "int64", "weight": "float64"})

    def close(self) -> None:
        pass


def dates_by_bin(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The day of greatest weight in each equal bin of an event's horizon, as Parquet, told as soon as the bin is complete.

    ``days``: event_id, day, t (place from 0 on), n (places of the event), k, bin, weight, as
    ``dates.weigh_dates`` gives them, in whatever order they arrive; later days win ties. The
    state holds the places of a bin until it is complete.
    """
    kind = days.schema["event_id"].dataType.simpleString()
    rows = days.select("event_id", "day", *[F.col(c).cast("long") for c in ("t", "n", "k", "bin")], F.col("weight").cast("double"))
    with keyed_state(days.sparkSession):
        out = rows.groupBy("event_id").transformWithStateInPandas(_Bins(), f"event_id {kind}, bin long, day string, weight double", "Append", "None")
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def evaluation_log(units: DataFrame, done: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """The records that ``work`` makes of units (event_id, rollout_idx, ...) as they arrive, appended to a log of JSON lines.

    Left out are units of an earlier run (``done``) and units that the stream has had
    before, also before a stop: those are the state. A missing index is 0.
    """
    named = lambda df: df.withColumn("rollout_idx", F.coalesce("rollout_idx", F.lit(0)))
    fresh = named(units).join(named(done.select(*UNIT)).distinct(), UNIT, "left_anti").dropDuplicates(UNIT)
    with keyed_state(units.sparkSession):
        return work(fresh).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
