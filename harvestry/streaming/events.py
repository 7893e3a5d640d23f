"""Event lines as a stream: totals per task, terminal states, persistence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import runs
from ..sources.readers import event_lines

LOG_BUCKETS = 64
#: What a processor with several states and timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Events of an append-only folder of JSON-line files. The checkpoint takes
    the place of remembered file positions."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return event_lines(lines)


def running_totals(events: DataFrame) -> DataFrame:
    """The batch fold on a stream (use update mode)."""
    return runs.fold_events(events)


_CLOSED = "task_id long, total_new long, total_skip long, total_error long, final_status string, by_timeout boolean"


class TerminalStates(StatefulProcessor):
    """Folds the events of a task in their own order (ts, seq).

    Events wait until the watermark has passed them, so what a task's state
    holds doesn't depend on which batch brought them. A closed task keeps a
    mark that swallows later events, until that too expires.
    """

    def __init__(self, idle_ms: int, keep_ms: int):
        self.idle, self.keep = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, seq long, type string, new_count long")
        self.folded = handle.getValueState("folded", "errors long, new long, skipped long, last long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not (self.folded.exists() and self.folded.get()[4]):
            first = None
            for batch in rows:
                micros = batch["ts"].astype("datetime64[us]").astype("int64")
                counts = batch["new_count"].fillna(0).astype("int64")
                self.waiting.appendList(list(zip(micros.tolist(), batch["seq"].tolist(), batch["type"].tolist(), counts.tolist())))
                first = int(micros.min()) if first is None else min(first, int(micros.min()))
            if first is not None:
                self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        errors, new, skipped, last, closed = self.folded.get() if self.folded.exists() else (0, 0, 0, None, False)
        if closed:
            if now > last + self.keep:
                self.folded.clear()
            return
        rest = sorted(self.waiting.get()) if self.waiting.exists() else []
        by_timeout, at = False, 0
        while at < len(rest) and rest[at][0] // 1000 < now:
            ts, _, kind, count = rest[at]
            if last is not None and ts // 1000 - last > self.idle:
                closed = by_timeout = True
                break
            last, at = ts // 1000, at + 1
            errors += kind == "error"
            skipped += kind == "skip"
            new += count if kind == "complete" else 0
            if kind == "summary":
                closed = True
                break
        if not closed and last is not None and now > last + self.idle:
            closed = by_timeout = True
        self.waiting.clear()
        if closed:
            self.handle.registerTimer(last + self.keep)
        else:
            if rest[at:]:
                self.waiting.put([tuple(r) for r in rest[at:]])
            self.handle.registerTimer(rest[at][0] // 1000 if rest[at:] else last + self.idle)
        if last is not None:
            self.folded.update((errors, new, skipped, last, closed))
        if closed:
            status = "failed" if errors else "success"
            yield pd.DataFrame({"task_id": [key[0]], "total_new": [new], "total_skip": [skipped], "total_error": [errors], "final_status": [status], "by_timeout": [by_timeout]})


def terminal_states(events: DataFrame, idle_seconds: int = 600, late_seconds: int = 60, keep_seconds: int = 7 * 86_400) -> DataFrame:
    """One row per finished task: at its first summary event, or where no event
    follows for ``idle_seconds`` (the producer has gone).

    Events (task_id, ts, seq, type, new_count) count in the order of ts and
    seq, whatever batch they come in, as long as none is more than
    ``late_seconds`` behind the newest; those behind the summary or the gap
    are ignored for ``keep_seconds``, after which an id may be used anew. Time
    is the events' own, so a replay gives the same rows. A task whose end the
    watermark hasn't passed has no row yet. The state is kept in RocksDB.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    narrow = events.select("task_id", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "type", F.col("new_count").cast("bigint").alias("new_count"))
    timed = narrow.withWatermark("ts", f"{late_seconds} seconds")
    return timed.groupBy("task_id").transformWithStateInPandas(TerminalStates(idle_seconds * 1000, keep_seconds * 1000), _CLOSED, "append", "EventTime")


def persist_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events under a hash bucket of their task: one task's log is read
    from one folder, and the number of folders does not grow with the tasks."""
    rows = events.withColumn("task_bucket", F.pmod(F.xxhash64("task_id"), F.lit(LOG_BUCKETS)).cast("int"))
    return rows.writeStream.partitionBy("task_bucket").format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def replay_task(spark: SparkSession, path: str, task_id: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64(F.lit(task_id).cast("bigint")), F.lit(LOG_BUCKETS)).cast("int")
    return runs.replay(spark.read.parquet(path).filter(F.col("task_bucket") == bucket), task_id)
