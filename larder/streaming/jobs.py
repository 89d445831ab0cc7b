"""Continuous forms of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.functions import fixed
from larder.operators import pages as pg
from larder.operators.shaping import spread


def append_batches(
    stream: DataFrame, job: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str
) -> StreamingQuery:
    """Run a batch job on every micro-batch and keep its rows under `folder/batch=n`.

    A batch that is run again after a failure replaces its own rows, so each is kept once.
    Nothing already written is rewritten; see `tables.fold_changes` for the current state.
    """

    def write(batch: DataFrame, number: int) -> None:
        job(spread(batch)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def extract_stream(stream: DataFrame, folder: str, checkpoint: str, now: Column) -> StreamingQuery:
    """Recipe rows of arriving pages that pass the gate, one per url and batch."""

    def job(batch: DataFrame) -> DataFrame:
        return pg.last_per_url(pg.gate(pg.extract(batch, now))[0])

    return append_batches(stream, job, folder, checkpoint)


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """Everything written by `append_batches`, with its batch number."""
    return spark.read.parquet(folder)


def accept_stream(
    events: DataFrame, key: str, at: str, gap_seconds: int = fixed.MIN_INTERVAL_SECONDS,
    late: str | None = None,
) -> DataFrame:
    """Accepted events of a stream `(key, at)`, decided at once and for good. The state of a key is the
    time of its last accepted event. Batches are decided in the order they arrive: an event that comes in
    a later batch than a newer one is not dropped, but cannot be accepted within the interval any more;
    `streaming.intervals` corrects what was decided instead. With `late`, a watermark, the state of a key
    is dropped once it can no longer hold anything back, and so are events older than the watermark.

    A task holds the distinct times of one key in one micro-batch, which the source's limit per
    trigger bounds; `intervals.accepted` is the form for a whole history."""
    gap = gap_seconds * 1_000_000
    kind = events.schema[key].dataType.simpleString()

    def step(
        name: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        found: set[int] = set()
        for part in parts:
            found.update(part["us"].tolist())
        times = sorted(found)
        taken = []
        for t in times:
            if last is None or t >= last + gap:
                taken.append(t)
                last = t
        state.update((last,))
        expiry = (last + gap) // 1000 + 1
        if late and expiry > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expiry)
        yield pd.DataFrame({key: [name[0]] * len(taken), "us": taken})

    timed = events.select(key, F.col(at).cast("timestamp").alias("at")).withColumn(
        "us", F.unix_micros("at")
    )
    if late:
        timed = timed.withWatermark("at", late)
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return timed.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, us bigint", "last bigint", "append", timeout
    )
