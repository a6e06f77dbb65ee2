"""Incremental work and event-time windows with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def incremental(spark: SparkSession, source: str, schema, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, per_trigger: int = 100) -> StreamingQuery:
    """Works on files that arrived since the last run, in bounded batches, then stops; the checkpoint makes it resumable.

    A batch is written under its number, so one that is repeated after a failure replaces itself.
    """
    arrived = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until_done(step: Callable[[], None], remaining: Callable[[], int], then: Callable[[], None], rounds: int = 100, pause: float = 1.0) -> int:
    """Runs step while rows remain, then what follows. Gives up when a round leaves as many as before it."""
    before = remaining()
    for k in range(rounds):
        if not before:
            then()
            return k
        step()
        left = remaining()
        if left >= before:
            raise RuntimeError(f"{left} rows remain and none was done")
        before = left
        time.sleep(pause if left else 0)
    raise RuntimeError(f"{before} rows remain after {rounds} rounds")


def windowed(events: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; rows later than the watermark are dropped by a stream."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("w.start", "w.end", *keys, "n", "value")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Event-time sessions by a gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def place_sessions(events: DataFrame, key: str, ts: str, gap_hours: float, late: str = "1 hour") -> DataFrame:
    """Sessions that end at a gap or a change of country, from keyed state: key, start, end, country, n.

    A session is reported once it is over: by a later row that does not belong, or by the watermark.
    """
    gap = pd.Timedelta(hours=gap_hours)

    def advance(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, now = [], None
        if state.exists:
            start, end, country, n = state.get
            now = [pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), country, n]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*k, *now)], columns=[key, "start", "end", "country", "n"])
            return
        for row in pd.concat(list(batches)).sort_values(ts).itertuples():
            t, country = getattr(row, ts), row.country
            if now and t - now[1] <= gap and country == now[2]:
                now[1], now[3] = max(t, now[1]), now[3] + 1
            else:
                if now:
                    done.append((*k, *now))
                now = [t, t, country, 1]
        micros = lambda t: t.value // 1000
        state.update((micros(now[0]), micros(now[1]), now[2], now[3]))
        state.setTimeoutTimestamp(max(now[1].value // 1_000_000 + int(gap.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[key, "start", "end", "country", "n"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(ts, late)
    return rows.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, start timestamp, end timestamp, country string, n long", "start long, end long, country string, n long", "append", GroupStateTimeout.EventTimeTimeout)
