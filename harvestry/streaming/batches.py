"""Streams of items: unseen ones by keyed state, each micro-batch through the
batch operators, so that there is one code path for both."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import dedup
from ..operators.governance import Policy
from ..plans import collect
from ..session import cut_lineage
from .events import STATE_STORE

REGISTRY = "id string, platform string, raw_id string, url string"
#: Keys of the state, each with the ids of one hash; a checkpoint depends on it.
_BUCKETS = 4096


def stream_name(checkpoint: str) -> str:
    """The name under which a stream registers ids: one for each checkpoint."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def _registry(spark: SparkSession, path: str, stream: str, before: int = 0) -> DataFrame | None:
    """Registry rows of other streams, and of this one's batches before that
    one: a batch that is run again does not see the rows of its own first
    attempt. None if there is no registry yet; other faults are raised, as all
    items would pass as new."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(REGISTRY + ", stream string, batch_id long").parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.filter((F.col("stream") != stream) | (F.col("batch_id") < before))


class SeenIds(StatefulProcessor):
    """Lets the items of an id pass that no earlier batch has brought. A key of
    the state is a bucket of ids, so that Python is called for many at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "seen boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for i in initialState["seen_id"]:
            self.seen.updateValue((i,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, bool] = {}  # the bucket's ids of this batch
        for some in rows:
            for i in some["seen_id"].dropna().unique():
                if i not in fresh:
                    fresh[i] = not self.seen.containsKey((i,))
                    if fresh[i]:
                        self.seen.updateValue((i,), (True,))
            passed = some["seen_id"].map(lambda i: fresh.get(i, True)).astype(bool)
            yield some[passed].drop(columns=["seen_id", "seen_bucket"], errors="ignore")


def unseen(items: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """The items of a stream whose id (platform and raw_id) no earlier batch
    has brought and the registry (id), if there is one, doesn't hold. Copies
    inside a batch pass together; items without an id always do.

    Ids are entries of the stream's state in RocksDB, in buckets by their hash:
    a batch looks up its own ids where they lie, and neither reads nor shuffles
    what is remembered. A bucket's ids of one batch are held in a worker. The
    registry is read once, as the state that a new checkpoint starts from. A
    batch that is run again starts from the state before it. Checkpoints of
    versions that had a key for each id can't be read.
    """
    spark = items.sparkSession
    spark.conf.set(*STATE_STORE)

    def bucket(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(_BUCKETS)).cast("int")

    # Items without an id spread over the buckets, and none is remembered.
    own = F.when(F.col("seen_id").isNull(), bucket(F.struct(*items.columns))).otherwise(bucket(F.col("seen_id")))
    keyed = items.withColumn("seen_id", dedup.registry_id()).withColumn("seen_bucket", own)
    start = registry.filter("id IS NOT NULL").select(bucket(F.col("id")).alias("seen_bucket"), F.col("id").alias("seen_id")).distinct().groupBy("seen_bucket") if registry is not None else None
    return keyed.groupBy("seen_bucket").transformWithStateInPandas(SeenIds(), items.schema, "append", "None", initialState=start)


def _register(fresh: DataFrame, batch_id: int, path: str, stream: str) -> None:
    """Write the ids of a batch under its stream and number, so that a retry
    replaces them."""
    keyed = fresh.withColumn("id", dedup.registry_id()).filter("id IS NOT NULL").select("id", "platform", "raw_id", "url")
    additions = dedup.first_per_key(keyed, ["id"], ["url"]).withColumns({"stream": F.lit(stream), "batch_id": F.lit(batch_id).cast("bigint")})
    additions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch_id").parquet(path)


def dedup_batch(batch: DataFrame, batch_id: int, registry_path: str, stream: str = "batch") -> DataFrame:
    """Unseen items of one batch against the registry's table, for batch jobs;
    their ids are registered under ``stream`` and ``batch_id``."""
    registry = _registry(batch.sparkSession, registry_path, stream, batch_id)
    fresh = cut_lineage(dedup.drop_seen(batch, registry.select("id")) if registry is not None else batch)
    _register(fresh, batch_id, registry_path, stream)
    return fresh


def _append_once(df: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch so that a retry replaces it."""
    rows = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(items: DataFrame, registry_path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Incremental de-duplication: unseen items under ``out``, and their ids in
    the registry's table, which later streams start from."""
    stream = stream_name(checkpoint)

    def work(batch: DataFrame, batch_id: int) -> None:
        fresh = cut_lineage(batch)  # state is looked up once, though there are two writes
        _register(fresh, batch_id, registry_path, stream)
        _append_once(fresh, batch_id, out)

    return _start(unseen(items, _registry(items.sparkSession, registry_path, stream)), work, checkpoint)


def governed_stream(pages: DataFrame, rule: dict, registry_path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Pages as they arrive: extract, de-duplicate, govern, append."""
    stream = stream_name(checkpoint)
    items = collect.collect_items(pages, rule, ["page_id"]).drop("seq")
    fields = list(dict.fromkeys([*collect.rule_fields(rule), "raw_id"]))
    if "url" not in items.columns:
        items = items.withColumn("url", F.lit(None).cast("string"))

    def work(batch: DataFrame, batch_id: int) -> None:
        fresh = cut_lineage(batch)
        _register(fresh, batch_id, registry_path, stream)
        run = fresh.withColumns({"run_id": F.lit(f"batch-{batch_id}"), "seq": F.struct("page_id", "pos")})
        outcome = collect.run_items(run, None, Policy.from_rule(rule), fields, materialise=True)
        _append_once(outcome.governed.drop("seq"), batch_id, f"{out}/items")
        _append_once(outcome.summary, batch_id, f"{out}/summary")

    return _start(unseen(items, _registry(pages.sparkSession, registry_path, stream)), work, checkpoint)
