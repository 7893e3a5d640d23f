"""Sinks: each is written twice and read once."""

from pyspark.sql import functions as F

from ..operators import archive, runs
from ..session import cut_lineage, scratch_folder
from ..sources import commits, writers
from . import query
from .archive_queries import _page
from .fixtures import EVENTS_SQL, task_events


@query(
    "result_meta_records",
    """SELECT lang AS subject, source AS platform, 'rule ' || lang AS rule_name, count(*) AS n, 3::BIGINT AS dedup_filtered, 1.0::DOUBLE AS quality_score, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS runs
    FROM documents GROUP BY lang, source""",
)
def _(t):
    out = f"{scratch_folder(t.spark)}/results"
    docs = t.documents.select(F.col("lang").alias("subject"), F.col("source").alias("platform"), F.lit("2024-01-02").alias("collected_date"), "doc_id")
    summary = t.region.limit(1).select(F.lit(1.0).alias("quality_score"))
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    for run_id, rows in (("r1", docs), ("r1", docs), ("r2", docs.filter("subject = 'en'"))):
        writers.save_results(rows, out, run_id, "rule", at, 3, summary)
    meta = writers.result_meta(t.spark, out)
    each = meta.groupBy("subject", "platform").agg(F.max("rule_name").alias("r"), F.max("count").alias("n"), F.max("dedup_filtered").alias("dedup_filtered"), F.max("governance.quality_score").alias("quality_score"), F.count(F.lit(1)).cast("int").alias("runs"))
    return each.select("subject", "platform", F.concat_ws(" ", "r", "subject").alias("rule_name"), "n", "dedup_filtered", "quality_score", "runs")


@query(
    "combined_view_meta",
    """SELECT o_orderpriority AS subject, 'combined' AS platform, strftime(max(date_trunc('month', o_orderdate)), '%Y-%m') AS collected, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority""",
)
def _(t):
    month = F.date_trunc("month", "o_orderdate")
    rows = t.orders.select(F.col("o_orderpriority").alias("subject"), F.date_format("o_orderdate", "yyyy-MM").alias("file"), month.alias("modified_at"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"))
    view = writers.combined_meta(writers.combined_latest(rows), rows.select("subject", F.col("modified_at").alias("collected_at")))
    return view.select("subject", "platform", F.date_format("collected_at", "yyyy-MM").alias("collected"), F.col("count").alias("n"))


@query(
    "run_tables_written_twice",
    """SELECT source AS run_id, 'raw' AS item_stage, doc_id::VARCHAR AS raw_id FROM documents UNION ALL SELECT source, 'deduped', doc_id::VARCHAR FROM documents WHERE doc_id % 3 <> 0
    UNION ALL SELECT source, 'filtered', doc_id::VARCHAR FROM documents WHERE doc_id % 3 = 0""",
)
def _(t):
    root = scratch_folder(t.spark)
    docs = t.documents.select(F.col("source").alias("run_id"), F.col("lang").alias("platform"), F.col("doc_id").cast("string").alias("raw_id"), F.substring("text", 1, 40).alias("title"), F.lit("").alias("url"), F.when(F.col("doc_id") % 3 == 0, "seen").alias("filter_reason"))
    stages = runs.stage_union(docs.drop("filter_reason"), docs.filter("filter_reason IS NULL"), docs.filter("filter_reason IS NOT NULL"), ["title"]).select("run_id", "item_stage", "raw_id")
    counts = docs.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_collected"))
    # The first try of the unit is half of it; a try without a manifest line is not seen at all.
    writers.save_run_tables({"collection_run_items": stages.filter("item_stage = 'raw'"), "collection_runs": counts.limit(0)}, root, "batch 1")
    for _ in range(2):
        writers.save_run_tables({"collection_run_items": stages, "collection_runs": counts}, root, "batch 1")
    stages.withColumns({commits.UNIT: F.lit("batch 2"), commits.ATTEMPT: F.lit("lost")}).write.mode("append").partitionBy(commits.UNIT, commits.ATTEMPT).parquet(f"{root}/collection_run_items")
    held = commits.committed(t.spark, root, "collection_run_items")
    return held.join(commits.committed(t.spark, root, "collection_runs"), "run_id", "left_semi").select("run_id", "item_stage", "raw_id")


_PAGE_ID = "sha256(sha256('https://c.example.org:8080/' || c_custkey || chr(10) || chr(10) || '<p>' || c_name || '</p>' || chr(10)))"


@query(
    "archive_written_twice",
    f"SELECT {_PAGE_ID} AS page_id, 5::BIGINT AS blocks, count(*) OVER (PARTITION BY c_custkey) AS pages, CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END::BIGINT AS recognised FROM customer",
)
def _(t):
    root = scratch_folder(t.spark)
    pages = cut_lineage(archive.build_pages(_page(t)))
    some = pages.filter(F.col("page_id") % 2 == 0)
    for unit, rows in (("first", some), ("second", pages.unionByName(some)), ("second", pages.unionByName(some))):
        writers.save_archive(archive.storage_tables(rows), root, unit)
    # Two runs side by side: the second has not seen the first's pages.
    commits.commit(archive.storage_tables(some), root, "third")
    found = writers.read_archive(t.spark, root)
    per = lambda name, n: found[name].groupBy("page_id").agg(F.count(F.lit(1)).alias(n))
    own = found["archive_pages"].groupBy(F.col("id").alias("page_id")).agg(F.count(F.lit(1)).alias("pages"))
    return own.join(per("archive_blocks", "blocks"), "page_id", "left").join(per("ocr_results", "recognised"), "page_id", "left").select("page_id", "blocks", "pages", F.coalesce("recognised", F.lit(0)).alias("recognised"))


@query(
    "packages_written_twice",
    "SELECT 'crm' AS platform, c_mktsegment AS subject, c_name AS title, 'https://c.example.org:8080/' || c_custkey AS source_url, CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS recognised FROM customer",
)
def _(t):
    root = scratch_folder(t.spark)
    pages = archive.build_pages(_page(t))
    for unit in ("first", "first", "second"):
        writers.save_packages(pages, root, unit)
    recognised = F.size(F.filter("blocks", lambda b: F.coalesce(b["ocr_text"], F.lit("")) != ""))
    return writers.read_packages(t.spark, root).select("platform", "subject", "meta.title", "meta.source_url", recognised.alias("recognised"))


_CLICK = "CASE seq % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'status' WHEN 2 THEN 'progress' ELSE 'item' END"


@query(
    "event_lines_written_twice",
    f"""WITH {EVENTS_SQL}, k AS (SELECT *, CASE WHEN type = 'progress' THEN {_CLICK} ELSE type END AS kind, '"r' || task_id || '"' AS rule FROM task_events)
    SELECT kind, '{{"type":"' || kind || '","ts":' || epoch_us(ts) // 1000000 || CASE WHEN kind = 'summary' THEN '' ELSE ',"rule":' || rule END || CASE kind WHEN 'start' THEN ''
        WHEN 'status' THEN ',"status":"running","msg":"' || replace(message, '"', '\\"') || '"' WHEN 'progress' THEN ',"phase":"detail","current":' || seq || ',"total":10' WHEN 'item' THEN ',"data":"' || seq || '"'
        WHEN 'error' THEN ',"message":"' || replace(message, '"', '\\"') || '","detail":""' WHEN 'skip' THEN ',"reason":"seen"' WHEN 'complete' THEN ',"new_count":' || new_count || ',"skip_count":0,"duration":' || round(value, 2)
        ELSE ',"total_rules":1,"total_new":' || new_count || ',"total_skip":0,"total_error":2,"duration":' || round(value, 2) END || '}}' AS value FROM k""",
)
def _(t):
    path = f"{scratch_folder(t.spark)}/events"
    e = task_events(t)
    turn = F.col("seq") % 4
    kind = F.when(F.col("type") != "progress", F.col("type")).when(turn == 0, "start").when(turn == 1, "status").when(turn == 2, "progress").otherwise("item")
    values = {
        "start": {}, "status": {"status": F.lit("running"), "msg": F.col("message")}, "progress": {"phase": F.lit("detail"), "current": F.col("seq"), "total": F.lit(10)}, "item": {"data": F.col("seq").cast("string")},
        "error": {"message": F.col("message"), "detail": F.lit("")}, "skip": {"reason": F.lit("seen")}, "complete": {"new_count": F.col("new_count"), "skip_count": F.lit(0), "duration": F.col("value")},
        "summary": {"total_rules": F.lit(1), "total_new": F.col("new_count"), "total_skip": F.lit(0), "total_error": F.lit(2), "duration": F.col("value")},
    }
    rule = F.concat(F.lit("r"), F.col("task_id").cast("string"))
    line = F.lit(None).cast("string")
    for name, own in values.items():
        line = F.when(kind == name, writers.event_json(name, F.unix_seconds("ts"), rule=rule, **own)).otherwise(line)
    rows = e.select(line.alias("value"))
    for unit in ("run 1", "run 1"):
        writers.save_events(rows, path, unit)
    return t.spark.read.text(path).select(F.get_json_object("value", "$.type").alias("kind"), "value")
