"""Structured Streaming: windows over event time, an agreement tracker with state, feeds and snapshots.

Every function takes a streaming (or, where it says so, a batch) DataFrame; batch and stream share one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums by window and kind; rows later than `late` are dropped in a stream."""
    marked = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if marked.isStreaming:
        marked = marked.withWatermark(ts, late)
    out = marked.groupBy(F.window(ts, length, slide) if slide else F.window(ts, length), by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("window.start").alias("start"), by, "n", "cents")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", ts: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    marked = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if marked.isStreaming:
        marked = marked.withWatermark(ts, late)
    out = marked.groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def final_days(events: DataFrame, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Counts by day; in append mode a day comes out once it is over."""
    return windowed(events, "1 day", late=late, ts=ts).withColumn("day", F.to_date("start")).drop("start")


def promotions(checks: DataFrame, needed: int = 3, days: int = 7) -> DataFrame:
    """(field, at, status): changes of each field's status as checks arrive, and the end of its shadow window.

    checks: field long, ts timestamp with a watermark, seq long, agree boolean. A field is `promoted` at the needed agreement in a row, `demoted`
    at a mismatch; `shadow over` comes by a timer once the watermark has passed `days` days after the run's first agreement, if no mismatch
    came before. A field promoted later than that isn't shadowed, and has no such row. Rows of a batch are taken in the order of seq.
    """
    span = days * 86_400_000

    class Tracker(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.state = handle, handle.getValueState("run", "n int, first long, status string")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            n, first, status = self.state.get() if self.state.exists() else (0, 0, "pending")
            out = []
            taken = pd.concat(list(rows)).sort_values("seq")
            for ts, agree in zip(taken["ts"], taken["agree"], strict=True):
                now, before = int(ts.timestamp() * 1000), status
                if not agree:
                    # A mismatch after the window leaves its end as it is, even if the timer is still to come.
                    if status == "promoted" and now - first <= span and first + span + 1 in set(self.handle.listTimers()):
                        self.handle.deleteTimer(first + span + 1)
                    n, first, status = 0, 0, "demoted"
                else:
                    n, first = n + 1, first if n else now
                    status = "promoted" if n >= needed else status
                    if status == "promoted" != before and now - first <= span:
                        self.handle.registerTimer(first + span + 1)
                if status != before:
                    out.append((key[0], pd.Timestamp(now, unit="ms"), status))
            self.state.update((n, first, status))
            if out:
                yield pd.DataFrame(out, columns=["field", "at", "status"])

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs() - 1, unit="ms")
            yield pd.DataFrame([(key[0], at, "shadow over")], columns=["field", "at", "status"])

        def close(self) -> None:
            pass

    return checks.groupBy("field").transformWithStateInPandas(Tracker(), "field long, at timestamp, status string", "Append", "eventTime")


def after(events: DataFrame, seq: int, key: str = "event_id") -> DataFrame:
    """Events past a cursor."""
    return events.where(F.col(key) > seq)


def only_new(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose digest wasn't computed before."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def uncovered(wanted: tuple[str, str], covered: tuple[str, str] | None) -> list[tuple[str, str]]:
    """Edges of a wanted range of days that a covered one leaves open."""
    if covered is None or wanted[1] < covered[0] or wanted[0] > covered[1]:
        return [wanted]
    day = lambda d, n: str((pd.Timestamp(d) + pd.Timedelta(days=n)).date())
    out = [(wanted[0], day(covered[0], -1))] if wanted[0] < covered[0] else []
    return out + ([(day(covered[1], 1), wanted[1])] if wanted[1] > covered[1] else [])


def halves(start: str, end: str) -> list[tuple[str, str]]:
    """A range of days cut in two that cover it; one day can't be cut."""
    a, b = pd.Timestamp(start), pd.Timestamp(end)
    if a >= b:
        return [(start, end)]
    mid = a + (b - a) // 2
    mid = mid.normalize()
    return [(start, str(mid.date())), (str((mid + pd.Timedelta(days=1)).date()), end)]


def drain(stream: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, name: str = "out") -> None:
    """Runs a stream over what is there and stops; to a memory table or, batch by batch, to a function."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)).start()
    query.awaitTermination()


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def snapshots(rows: DataFrame, key: str, day: str) -> DataFrame:
    """Rows with how many days of the key there were up to each, as a warm-up count."""
    from pyspark.sql import window as W

    return rows.withColumn("seen", F.row_number().over(W.Window.partitionBy(key).orderBy(day)))
