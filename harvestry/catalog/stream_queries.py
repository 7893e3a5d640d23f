"""Structured Streaming runs over the given tables, read back as tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_folder
from ..sources import writers
from ..streaming import batches, events
from . import query
from .fixtures import EVENTS_SQL, task_events
from .record_queries import FOLD_SQL, RULE_V2, _lines


class Streams:
    """The tables of ``Tables`` as append-only file streams."""

    def __init__(self, t):
        self._t = t

    def __getattr__(self, name):
        path = f"{self._t.folder}/{name}.parquet"
        # As a glob the path may name one file or a folder of files.
        df = self._t.spark.readStream.schema(self._t.spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
        return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def _to_table(stream, t, mode, **trigger):
    """Run a stream to its end and return what its batches put out."""
    out = scratch_folder(t.spark)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return t.spark.read.parquet(f"{out}/rows")


@query("stream_task_totals", f"SELECT * EXCLUDE (done), CASE WHEN summaries > 0 THEN done ELSE 'running' END AS final_status FROM ({FOLD_SQL})")
def _(t):
    rows = _to_table(events.running_totals(task_events(Streams(t))), t, "update")
    values = [c for c in rows.columns if c not in ("task_id", "batch")]
    last = rows.groupBy("task_id").agg(F.max_by(F.struct(*values), "batch").alias("r"))
    return last.select("task_id", "r.*")


def _in_cuts(events, t, cuts):
    """The events as a stream of so many files, one a batch, in order of time."""
    out = scratch_folder(t.spark)
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    width = (last - first) // cuts + 1
    for k in range(cuts):
        here = F.floor((F.unix_micros("ts") - first) / width) == k
        events.filter(here).coalesce(1).write.parquet(f"{out}/{k}")
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/*")


@query(
    "stream_terminal_states",
    f"""WITH {EVENTS_SQL}, bound AS (SELECT epoch_ms(max(ts)) - 21600000 AS w FROM task_events),
    ordered AS (SELECT task_events.*, epoch_ms(ts) AS ms, w, row_number() OVER o AS i, lead(epoch_ms(ts)) OVER o AS following FROM task_events, bound WHERE epoch_ms(ts) < w WINDOW o AS (PARTITION BY task_id ORDER BY ts, seq)),
    ends AS (SELECT task_id, min(i) AS last FROM ordered WHERE type = 'summary' OR coalesce(following, w) - ms > 86400000 GROUP BY task_id)
    SELECT task_id, coalesce(sum(new_count) FILTER (type = 'complete'), 0)::BIGINT AS total_new, count(*) FILTER (type = 'skip') AS total_skip, count(*) FILTER (type = 'error') AS total_error,
        CASE WHEN count(*) FILTER (type = 'error') > 0 THEN 'failed' ELSE 'success' END AS final_status, count(*) FILTER (type = 'summary') = 0 AS by_timeout
    FROM ordered JOIN ends USING (task_id) WHERE i <= last GROUP BY task_id""",
)
def _(t):
    stream = _in_cuts(task_events(t), t, 5)
    return _to_table(events.terminal_states(stream, idle_seconds=86_400, late_seconds=21_600, keep_seconds=90 * 86_400), t, "append").drop("batch")


@query("stream_event_lines", f"WITH {EVENTS_SQL} SELECT type, count(*) AS events, sum(CASE WHEN type = 'complete' THEN new_count END)::BIGINT AS new_count FROM task_events WHERE type IN ('error', 'skip', 'complete') GROUP BY type")
def _(t):
    # Lines of all events as files; blank and broken ones are among them.
    path = f"{scratch_folder(t.spark)}/lines"
    writers.save_events(_lines(t), path, "run")
    rows = _to_table(events.event_stream(t.spark, path).select("type", "new_count"), t, "append")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.sum("new_count").alias("new_count"))


@query("stream_event_log", "SELECT user_id AS task_id, count(*) AS events FROM events GROUP BY user_id")
def _(t):
    out = scratch_folder(t.spark)
    events.persist_events(task_events(Streams(t)), f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/log").groupBy("task_id").agg(F.count(F.lit(1)).alias("events"))


@query("stream_incremental_dedup", "SELECT 'kept' AS kind, source || '_' || doc_id AS id FROM documents UNION ALL SELECT 'registered', source || '_' || doc_id FROM documents")
def _(t):
    out = scratch_folder(t.spark)
    key = F.concat("platform", F.lit("_"), "raw_id").alias("id")
    docs = Streams(t).documents.select(F.col("source").alias("platform"), F.col("doc_id").cast("string").alias("raw_id"), F.lit("u").alias("url"))
    # The second pass over the same documents must find all of them registered.
    for run in ("first", "second"):
        batches.dedup_stream(docs, f"{out}/registry", f"{out}/{run}", f"{out}/checkpoint-{run}").awaitTermination()
        docs = docs.withColumn("url", F.lit("v"))
    kept = t.spark.read.parquet(f"{out}/first").select(F.lit("kept").alias("kind"), key)
    return kept.unionByName(t.spark.read.parquet(f"{out}/registry").select(F.lit("registered").alias("kind"), "id"))


@query(
    "stream_governed_pages",
    """WITH li AS (SELECT unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS title FROM pages)
    SELECT DISTINCT trim(title) AS title, trim(url) AS url, nullif(regexp_extract(url, '/([a-zA-Z0-9_]+)$', 1), '') AS raw_id FROM li""",
)
def _(t):
    out = scratch_folder(t.spark)
    batches.governed_stream(Streams(t).pages, RULE_V2, f"{out}/registry", f"{out}/out", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/out/items").select("title", "url", "raw_id")
