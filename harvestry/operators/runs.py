"""Run tables, task look-ups and the totals drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import duration_seconds, task_state
from .dedup import first_per_key

STAGES = ("raw", "deduped", "filtered")
TASK_WINDOW_SECONDS = 300


# --- payloads --------------------------------------------------------------


def run_rows(runs: DataFrame) -> DataFrame:
    """``collection_runs`` rows with their defaults."""
    return runs.select(
        "run_id", "rule_name", F.coalesce("rule_path", F.lit("")).alias("rule_path"), "subject", "platform",
        F.coalesce("status", F.lit("success")).alias("status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_collected", "saved_count", "dedup_filtered")],
        F.coalesce("output_path", F.lit("")).alias("output_path"), "started_at", "finished_at",
        duration_seconds("started_at", "finished_at", 2).alias("duration_seconds"), F.substring("error", 1, 500).alias("error"),
    )


def _payload_json(items: DataFrame, fields: list[str]) -> Column:
    kept = [f for f in fields if not f.startswith("_")]
    return F.to_json(F.struct(*kept)) if kept else F.lit("{}")


def item_rows(items: DataFrame, fields: list[str]) -> DataFrame:
    """``collection_items`` rows: promoted columns plus the record as JSON."""
    has = lambda c, kind: F.col(c) if c in items.columns else F.lit(None).cast(kind)
    return items.select(
        F.sha2(F.concat_ws("|", "platform", F.coalesce(has("raw_id", "string"), F.lit("")), F.coalesce(has("content_hash", "string"), F.lit(""))), 256).alias("item_id"),
        has("run_id", "string").alias("run_id"), "platform", has("raw_id", "string").alias("raw_id"), has("url", "string").alias("url"),
        has("title", "string").alias("title"), has("content_hash", "string").alias("content_hash"),
        has("field_completeness", "double").alias("field_completeness"),
        F.coalesce(has("injection_risk", "boolean"), F.lit(False)).alias("injection_risk"), _payload_json(items, fields).alias("data"),
    )


def run_item_rows(items: DataFrame, stage: str, fields: list[str]) -> DataFrame:
    """``collection_run_items`` rows of one stage."""
    has = lambda c, kind="string": F.col(c) if c in items.columns else F.lit(None).cast(kind)
    governance = [c for c in ("content_hash", "field_completeness", "injection_risk") if c in items.columns]
    return items.select(
        has("run_id").alias("run_id"), F.lit(stage).alias("item_stage"), "platform", has("raw_id").alias("raw_id"), has("url").alias("url"),
        has("title").alias("title"), has("content_hash").alias("content_hash"), has("filter_reason").alias("filter_reason"),
        has("matched_existing_id").alias("matched_existing_id"), _payload_json(items, fields).alias("data"),
        (F.to_json(F.struct(*governance)) if governance else F.lit("{}")).alias("governance"),
    )


def stage_union(raw: DataFrame, deduped: DataFrame, filtered: DataFrame, fields: list[str]) -> DataFrame:
    parts = [run_item_rows(df, s, fields) for df, s in zip((raw, deduped, filtered), STAGES)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def governance_rows(summary: DataFrame) -> DataFrame:
    """``collection_governance_records`` rows with their defaults."""
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    full = lambda c: F.coalesce(c, F.lit(1.0)).alias(c)
    return summary.select(
        "run_id", *[count(c) for c in ("item_count", "duplicate_count", "injection_risk_count")],
        *[full(c) for c in ("field_completeness", "quality_score")], F.coalesce("status", F.lit("SUCCESS")).alias("status"),
    )


def append_records(items: DataFrame, extra: DataFrame | None, output_mode: str = "append") -> DataFrame:
    """Page items followed by recognised rows, or only those."""
    if output_mode == "ocr_rows_only":
        return extra if extra is not None else items.limit(0)
    return items if extra is None else items.unionByName(extra, allowMissingColumns=True)


# --- joins -----------------------------------------------------------------


def match_runs(tasks: DataFrame, runs: DataFrame, zone: str = "Asia/Shanghai", seconds: int = TASK_WINDOW_SECONDS) -> DataFrame:
    """tasks + ``run_id, run_started_at``: the latest run started within
    ``seconds`` of the task's local time whose rule path ends with the task's
    (any run when the task has none).

    Works on distinct (path, time) pairs of either side, so a busy minute or
    rule is one row per instant. Times are cut into windows twice as wide as
    the tolerance; each run also counts in the next window, and a running
    maximum inside (path, window) finds the match without pairing rows.
    """
    width = 2 * seconds * 1_000_000
    micros = lambda c: F.unix_micros(c)
    local = F.to_utc_timestamp(F.col("created_at"), zone)
    asks = tasks.select(F.coalesce("rule_path", F.lit("")).alias("path"), micros(local).alias("t")).filter(F.col("t").isNotNull()).distinct()
    starts = runs.groupBy(F.coalesce("rule_path", F.lit("")).alias("run_path"), micros(F.col("started_at")).alias("s")).agg(F.max("run_id").alias("run_id"))

    # Every suffix of every distinct run path, matched to the task paths.
    suffixes = starts.select("run_path").distinct().select("run_path", F.explode(F.sequence(F.lit(0), F.length("run_path"))).alias("i"))
    suffixes = suffixes.select("run_path", F.expr("substring(run_path, i + 1)").alias("path"))
    wanted = suffixes.join(asks.select("path").distinct(), "path")
    known = starts.join(wanted, "run_path").groupBy("path", "s").agg(F.max("run_id").alias("run_id"))

    # A run counts for tasks in [s - tolerance, s + tolerance].
    upper = F.col("t") + seconds * 1_000_000
    left = asks.select("path", F.floor(upper / width).alias("w"), upper.alias("at"), F.lit(1).alias("kind"), "t", F.lit(None).cast("struct<s:bigint,run_id:string>").alias("run"))
    first = F.floor(F.col("s") / width)
    right = known.select(
        "path", F.explode(F.array(first, first + 1)).alias("w"), F.col("s").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("t"),
        F.struct("s", F.col("run_id").cast("string").alias("run_id")).alias("run"),
    )
    order = W.partitionBy("path", "w").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = left.unionByName(right).withColumn("best", F.max("run").over(order)).filter("kind = 1")
    found = merged.filter(F.col("best.s") >= F.col("t") - seconds * 1_000_000).select(
        F.col("path").alias("_path"), F.col("t").alias("_t"), F.col("best.run_id").alias("run_id"), F.timestamp_micros("best.s").alias("run_started_at")
    )
    keyed = tasks.withColumns({"_path": F.coalesce("rule_path", F.lit("")), "_t": micros(local)})
    return keyed.join(found, ["_path", "_t"], "left").drop("_path", "_t")


def match_older_items(run_items: DataFrame, stored: DataFrame) -> DataFrame:
    """run items + ``old_*``: for filtered rows the newest stored item of the
    same platform and raw id that is not the matched one.

    The two newest stored items per key are enough to leave one out, so a key
    with very many items is two rows before the join.
    """
    body = F.struct("collected_at", F.col("id"), "title", "url", "content_hash")
    asked = run_items.filter(F.col("item_stage") == "filtered").select("platform", "raw_id").distinct()
    newest = stored.join(asked, ["platform", "raw_id"], "left_semi").withColumn(
        "rn", F.row_number().over(W.partitionBy("platform", "raw_id").orderBy(F.col("collected_at").desc(), F.col("id").desc()))
    ).filter("rn <= 2")
    pairs = newest.groupBy("platform", "raw_id").agg(
        F.max(F.when(F.col("rn") == 1, body)).alias("_n1"), F.max(F.when(F.col("rn") == 2, body)).alias("_n2")
    )
    key = F.when(F.col("item_stage") == "filtered", F.col("raw_id"))
    left = run_items.withColumn("_key", F.coalesce(key, F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))))
    joined = left.join(pairs.withColumnRenamed("raw_id", "_key"), ["platform", "_key"], "left")
    skip = F.coalesce("matched_existing_id", F.lit(""))
    old = F.when(F.col("_n1.id") != skip, F.col("_n1")).otherwise(F.col("_n2"))
    return joined.withColumn("_old", old).select(
        *run_items.columns, *[F.col(f"_old.{c}").alias(f"old_{c}") for c in ("title", "url", "content_hash", "collected_at")], F.col("_old.id").alias("old_item_id")
    )


def latest_archive(pages: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """The newest archived page per source URL, of ``urls(url)`` if given."""
    if urls is not None:
        pages = pages.join(urls.select(F.col("url").alias("source_url")), "source_url", "left_semi")
    ranked = pages.withColumn("_at", -F.coalesce(F.unix_micros("fetched_at"), F.lit(0)))
    return first_per_key(ranked, ["source_url"], ["_at", "id"]).drop("_at")


def attach_archive(items: DataFrame, archive: DataFrame) -> DataFrame:
    """items + ``archive`` struct of their URL."""
    fields = [c for c in archive.columns if c != "source_url"]
    packed = archive.select(F.col("source_url").alias("url"), F.struct(*fields).alias("archive"))
    return items.join(packed, "url", "left")


def archive_texts(pages: DataFrame, blocks: DataFrame, ocr: DataFrame) -> DataFrame:
    """pages + body_text, ocr_text from the child tables. Children are folded
    per page first, so the joins do not multiply."""
    body = F.col("block_type").isin("paragraph", "heading")
    texts = blocks.filter(F.coalesce("text", F.lit("")) != "")
    joined = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda x: x["text"]), "\n\n")
    per_page = texts.groupBy("page_id").agg(
        joined(F.when(body, F.struct("block_order", "text"))).alias("body_text"), F.count(F.lit(1)).alias("text_blocks")
    )
    per_ocr = ocr.filter(F.coalesce("ocr_text", F.lit("")) != "").groupBy("page_id").agg(
        joined(F.struct("ocr_no", F.col("ocr_text").alias("text"))).alias("ocr_text")
    )
    out = pages.join(per_page, pages["id"] == per_page["page_id"], "left").drop("page_id")
    out = out.join(per_ocr, out["id"] == per_ocr["page_id"], "left").drop("page_id")
    return out.withColumns({"body_text": F.coalesce("body_text", F.lit("")), "ocr_text": F.coalesce("ocr_text", F.lit("")), "text_blocks": F.coalesce("text_blocks", F.lit(0))})


def archive_by_hash(pages: DataFrame, scopes: DataFrame, content_hash: str | Column, blocks: DataFrame, assets: DataFrame, records: DataFrame) -> DataFrame:
    """One stored page by content hash, if it is in scope, with the number of
    its blocks, assets and structured records."""
    wanted = F.lit(content_hash) if isinstance(content_hash, str) else content_hash
    out = in_scope(pages.filter(F.col("content_hash") == wanted), scopes)
    for name, child in (("block_count", blocks), ("asset_count", assets), ("record_count", records)):
        own = child.join(out.select(F.col("id").alias("page_id")), "page_id", "left_semi")
        counts = own.groupBy(F.col("page_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def in_scope(df: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows whose (subject, platform) a current rule declares."""
    return df.join(scopes.select("subject", "platform").distinct(), ["subject", "platform"], "left_semi")


def rules_with_last_run(rules: DataFrame, runs: DataFrame) -> DataFrame:
    return rules.join(rule_stats(runs), "rule_name", "left")


def task_history(tasks: DataFrame, limit: int = 50) -> DataFrame:
    newest = tasks.orderBy(F.col("created_at").desc(), F.col("task_id").desc()).limit(limit)
    return newest.withColumn("ng_status", task_state("status"))


# --- totals ----------------------------------------------------------------


def global_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.coalesce(F.sum("total_collected"), F.lit(0)).alias("total_collected"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("total_failed"),
    )


def rule_stats(runs: DataFrame) -> DataFrame:
    """Totals per rule and what its last finished run said."""
    last = lambda c: F.max_by(c, F.struct("finished_at", "run_id"))
    return runs.groupBy("rule_name").agg(
        F.max("finished_at").alias("last_run_at"),
        last("status").alias("last_status"),
        last("total_collected").alias("last_collected"),
        last("dedup_filtered").alias("last_dedup_filtered"),
        last(F.substring(F.coalesce("error", F.lit("")), 1, 200)).alias("last_error"),
        F.count(F.lit(1)).alias("total_runs"),
        F.coalesce(F.sum("total_collected"), F.lit(0)).alias("total_collected"),
    )


def batch_totals(runs: DataFrame) -> DataFrame:
    """Totals over all rules: anything that is neither success nor skipped is
    an error, partial success included."""
    done = F.col("status") == "success"
    return runs.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.coalesce(F.sum(F.when(done, F.col("saved_count"))), F.lit(0)).alias("total_new"),
        F.count_if(F.col("status") == "skipped").alias("total_skipped"),
        F.count_if(~F.col("status").isin("success", "skipped")).alias("total_errors"),
        F.count_if(F.col("status") == "partial_success").alias("total_partial"),
    )


def registry_stats(registry: DataFrame, requirement: str | None = None) -> DataFrame:
    rows = registry if requirement is None else registry.filter(F.col("requirement") == requirement)
    return rows.groupBy("platform").agg(F.count(F.lit(1)).alias("count"))


def subject_rules(rules: DataFrame) -> DataFrame:
    """(subject, rule_name, position): the rules of a subject in the order they
    first came. Long form, so a subject may hold any number."""
    first = rules.groupBy("subject", "rule_name").agg(F.min("seq").alias("seq"))
    return first.withColumn("position", F.row_number().over(W.partitionBy("subject").orderBy("seq", "rule_name"))).drop("seq")


def stage_counts(run_items: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("item_stage") == s).alias(s) for s in STAGES]
    return run_items.groupBy("run_id").agg(*counts)


def fold_events(events: DataFrame) -> DataFrame:
    """Totals and state per task from its events (task_id, seq, type,
    new_count, message). A task without a summary event is still running."""
    kind = F.col("type")
    is_error = kind == "error"
    folded = events.groupBy("task_id").agg(
        F.coalesce(F.sum(F.when(kind == "complete", F.coalesce("new_count", F.lit(0)))), F.lit(0)).alias("total_new"),
        F.count_if(kind == "skip").alias("total_skip"),
        F.count_if(is_error).alias("total_error"),
        F.max_by(F.when(is_error, F.coalesce("message", F.lit("Unknown error"))), F.when(is_error, F.col("seq"))).alias("last_error"),
        F.count_if(kind == "summary").alias("summaries"),
        F.max("seq").alias("last_seq"),
    )
    done = F.when(F.coalesce("last_error", F.lit("")) != "", "failed").otherwise("success")
    return folded.withColumn("final_status", F.when(F.col("summaries") > 0, done).otherwise("running"))


def close_tasks(folded: DataFrame, return_code: str | None = None) -> DataFrame:
    """Terminal status of tasks whose stream ended without a summary."""
    code = F.coalesce(return_code, F.lit(0)) if return_code else F.lit(0)
    ended = F.when((F.coalesce("last_error", F.lit("")) != "") | (code != 0), "failed").otherwise("success")
    return folded.withColumn("final_status", F.when(F.col("final_status") == "running", ended).otherwise(F.col("final_status")))


def replay(events: DataFrame, task: int | DataFrame) -> DataFrame:
    """Events of a task in their order; ``task`` is its id, or a table
    (task_id) of those to replay one after another."""
    if isinstance(task, DataFrame):
        return events.join(task.select("task_id"), "task_id", "left_semi").orderBy("task_id", "seq")
    return events.filter(F.col("task_id") == task).orderBy("seq")
