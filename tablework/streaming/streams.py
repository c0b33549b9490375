"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import normalize_key
from tablework.sources.ingest import ingest_rows, packed_rows, payload_status


def dedupe_stream(stream: DataFrame, keys: Sequence[str], event_time: str | None = None, watermark: str | None = None) -> DataFrame:
    """First row per key (trimmed text).  With a watermark the state is dropped after the delay; without
    one every key seen is remembered."""
    made = {f"__k{i}": normalize_key(F.col(f"`{k}`"), "trim", stream.schema[k].dataType) for i, k in enumerate(keys)}
    keyed = stream.withColumns(made)
    if watermark:
        out = keyed.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(made))
    else:
        out = keyed.dropDuplicates(list(made))
    return out.drop(*made)


def ingest_stream(payloads: DataFrame, target: str, checkpoint: str, cap: int | None = None, received: str | None = None, remember: str | None = None):
    """Append the rows of pushed payloads to ``target``; a job is written once, however often and in whatever batch it is pushed.

    The jobs seen are state of the query, kept in its checkpoint beside the offsets: the first usable payload of a job counts, whole; payloads without
    rows or text do not use a job up. With ``received`` and ``remember`` (a time column and a duration) a job is forgotten that long after the
    watermark passed it, which bounds the state. Payloads without a job id are never replays. A batch that is run again after a failure overwrites its
    own folder. Returns the started query."""
    usable = payloads.where(payload_status(F.col("rows")) == "ok")
    usable = packed_rows(usable)
    named, unnamed = usable.where("job_id IS NOT NULL"), usable.where("job_id IS NULL")
    if remember:
        first = named.withWatermark(received, remember).dropDuplicatesWithinWatermark(["job_id"])
    else:
        first = named.dropDuplicates(["job_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_rows(batch, cap).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return first.unionByName(unnamed).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flag_repeat_fetch_stream(log: DataFrame, host: str = "host", ts: str = "ts", hours: float = 24, late: str = "1 hour") -> DataFrame:
    """Per fetch the one before it of the same host, as the batch form has it, also where fetches come out of order.

    A fetch waits in the state of its host until the watermark (the latest time seen less ``late``) has passed it; then no earlier one can come, and it
    is placed behind the last one that went out. So a row comes out ``late`` after it happened, and what is still waiting when the input ends comes
    out as soon as the stream goes on. Fetches that come later than ``late`` are left out by the watermark. State of a host: its waiting
    fetches, in order, and the last time that went out. Fetches without a time pass at once, with no fetch before them; a null host is a host.
    """
    kind = log.schema[host].dataType.simpleString()
    window = hours * 3.6e9

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        fresh = [pdf["_at"].to_numpy(np.int64) for pdf in frames] if not state.hasTimedOut else []
        stamps = np.sort(np.concatenate([np.array(waiting, dtype=np.int64), *fresh]), kind="stable")
        passed = state.getCurrentWatermarkMs() * 1000
        ready, rest = stamps[stamps < passed], stamps[stamps >= passed]
        if len(ready):
            before = np.concatenate([[ready[0] if last is None else last], ready[:-1]])
            known = np.ones(len(ready), dtype=bool)
            known[0] = last is not None
            last = int(ready[-1])
            previous = pd.Series(before.astype("datetime64[us]")).where(pd.Series(known))
            yield pd.DataFrame({host: [key[0]] * len(ready), ts: ready.astype("datetime64[us]"), "previous_fetch": previous, "repeat_fetch": known & (ready - before < window)})
        state.update((last, rest.tolist()))
        if len(rest):
            state.setTimeoutTimestamp(int(rest[0]) // 1000 + 1)

    out = f"`{host}` {kind}, `{ts}` timestamp, previous_fetch timestamp, repeat_fetch boolean"
    timed = log.select(host, ts).where(F.col(ts).isNotNull()).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withWatermark(ts, late)
    placed = timed.groupBy(host).applyInPandasWithState(step, out, "last long, waiting array<long>", "append", "EventTimeTimeout")
    untimed = log.where(F.col(ts).isNull()).select(host, F.col(ts).cast("timestamp").alias(ts), F.lit(None).cast("timestamp").alias("previous_fetch"), F.lit(False).alias("repeat_fetch"))
    return placed.unionByName(untimed)
