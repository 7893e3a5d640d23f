"""De-duplication, governance, run tables and their look-ups."""

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.text import strip
from ..operators import dedup, governance, lists, runs as run_ops
from ..operators.governance import Policy
from ..plans import collect
from ..session import spread
from ..sources import readers, writers
from . import query
from .fixtures import EVENTS_SQL, ITEMS_SQL, REGISTRY_SQL, RUNS_SQL, WS, items, registry, runs, task_events
from .text_queries import SIMHASH_SQL, simhash_sql

GONE = "trim(regexp_replace(X, '(?i)ignore previous instructions|忽略之前的指令|system prompt|developer message', '', 'g'), ' 。.，,')"
RISK = "contains(lower(title || ' ' || content), 'ignore previous instructions')"


@query("incremental_dedup", f"WITH {ITEMS_SQL}, {REGISTRY_SQL} SELECT doc_id FROM items WHERE platform || '_' || raw_id NOT IN (SELECT id FROM registry)")
def _(t):
    return dedup.drop_seen(items(t), registry(t)).select("doc_id")


@query(
    "incremental_dedup_detail",
    f"WITH {ITEMS_SQL}, {REGISTRY_SQL} SELECT doc_id, r.id AS matched_existing_id, CASE WHEN r.id IS NOT NULL THEN 'dedup_incremental_existing_raw_id' END AS filter_reason FROM items i LEFT JOIN registry r ON r.id = i.platform || '_' || i.raw_id",
)
def _(t):
    return dedup.split_seen(items(t), registry(t)).select("doc_id", "matched_existing_id", "filter_reason")


@query(
    "incremental_dedup_blank_ids",
    f"WITH {ITEMS_SQL}, {REGISTRY_SQL} SELECT doc_id FROM items WHERE lang = 'en' OR platform || '_' || raw_id NOT IN (SELECT id FROM registry)",
)
def _(t):
    rows = items(t).withColumn("raw_id", F.when(F.col("lang") != "en", F.col("raw_id")))
    return dedup.drop_seen(rows, registry(t)).select("doc_id")


@query("registry_upsert", f"WITH {ITEMS_SQL} SELECT platform || '_' || raw_id AS id, min(doc_id) AS doc_id FROM items WHERE NOT known GROUP BY 1")
def _(t):
    twice = items(t).unionByName(items(t)).withColumn("id", dedup.registry_id())
    return dedup.registry_additions(twice.select("id", "doc_id"), registry(t), ["doc_id"])


@query("registry_counts", f"WITH {REGISTRY_SQL} SELECT platform, count(*) AS count FROM registry WHERE requirement = 'en' GROUP BY platform")
def _(t):
    return run_ops.registry_stats(registry(t), "en")


@query(
    "exact_dedup",
    f"WITH {ITEMS_SQL}, h AS (SELECT *, sha256('content=' || content || chr(10) || 'title=' || title) AS content_hash FROM items) SELECT lang, content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM h GROUP BY ALL",
)
def _(t):
    rows = items(t)
    hashed = rows.withColumn("content_hash", hashing.record_hash(rows, ["title", "content"])).select("lang", "content_hash", "doc_id")
    return dedup.exact(hashed, "content_hash", ["doc_id"], ["lang"], copies="copies")


PAIRS_SQL = f"""WITH {SIMHASH_SQL},
  first AS (SELECT fp, min(doc_id) AS seq FROM prints GROUP BY fp)
  SELECT a.seq AS a_seq, b.seq AS b_seq, upper(to_hex(a.fp)) AS a_fp, upper(to_hex(b.fp)) AS b_fp, bit_count(xor(a.fp, b.fp)::UBIGINT::BIT)::INTEGER AS distance
  FROM first a JOIN first b ON a.seq < b.seq AND bit_count(xor(a.fp, b.fp)::UBIGINT::BIT) <= 3"""


def _fps(t):
    prints = t.even("documents").select("doc_id", hashing.simhash64("text").alias("fp"))
    return dedup.distinct_fingerprints(prints, "fp", "doc_id")


@query("near_duplicate_pairs", PAIRS_SQL)
def _(t):
    return dedup.near_pairs(_fps(t), "fp", 3).withColumns({"a_fp": F.hex("a_fp"), "b_fp": F.hex("b_fp")})


@query("near_duplicate_pairs_by_scope", f"SELECT s.scope, p.* FROM ({PAIRS_SQL}) p, (VALUES (NULL), ('all')) s(scope)")
def _(t):
    both = _fps(t).withColumn("scope", F.explode(F.array(F.lit(None).cast("string"), F.lit("all"))))
    return dedup.near_pairs(both, "fp", 3, ["scope"]).withColumns({"a_fp": F.hex("a_fp"), "b_fp": F.hex("b_fp")})


# Greedy survivors in input order, by recursion over the rank of the document.
@query(
    "near_duplicate_survivors",
    f"""WITH RECURSIVE {SIMHASH_SQL},
    pairs AS (SELECT a.seq AS early, b.seq AS late FROM (SELECT fp, min(doc_id) AS seq FROM prints GROUP BY fp) a JOIN (SELECT fp, min(doc_id) AS seq FROM prints GROUP BY fp) b
              ON a.seq < b.seq AND bit_count(xor(a.fp, b.fp)::UBIGINT::BIT) <= 3),
    ranked AS (SELECT seq, row_number() OVER (ORDER BY seq) AS r FROM (SELECT DISTINCT late AS seq FROM pairs)),
    walk(r, gone) AS (SELECT 0, CAST([] AS BIGINT[]) UNION ALL
      SELECT w.r + 1, CASE WHEN len(list_filter((SELECT list(early) FROM pairs WHERE late = k.seq), lambda e: NOT list_contains(w.gone, e))) > 0 THEN list_append(w.gone, k.seq) ELSE w.gone END
      FROM walk w JOIN ranked k ON k.r = w.r + 1)
    SELECT f.seq AS doc_id FROM (SELECT min(doc_id) AS seq FROM prints GROUP BY fp) f WHERE NOT list_contains((SELECT gone FROM walk ORDER BY r DESC LIMIT 1), f.seq)""",
)
def _(t):
    prints = t.dealt("documents").select("doc_id", hashing.simhash64("text").alias("fp"))
    return dedup.near_survivors(prints, "fp", "doc_id", 3).select("doc_id")


@query("body_dedup", "SELECT min(doc_id) AS seq, sha256(text || chr(10)) AS body_hash FROM documents GROUP BY 2")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("seq"), hashing.body_hash(F.col("text"), F.lit("")).alias("body_hash"))
    return dedup.by_body(rows)


@query("url_dedup", "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS detail_url, min(page_id) AS pos, 1 AS page_no FROM pages GROUP BY 1")
def _(t):
    rows = t.pages.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("detail_url"), F.lit(1).alias("page_no"), F.col("page_id").alias("pos"))
    return dedup.by_url(rows)


@query("archived_skip", f"WITH {ITEMS_SQL} SELECT doc_id FROM items WHERE sha256(content) NOT IN (SELECT sha256(content) FROM items WHERE known)")
def _(t):
    rows = items(t).withColumn("content_hash", F.sha2("content", 256))
    return dedup.drop_archived(rows, rows.filter("known")).select("doc_id")


@query(
    "archived_skip_by_engine",
    f"""WITH {ITEMS_SQL}, h AS (SELECT doc_id, sha256(content) AS hash, known, lang FROM items),
    stored AS (SELECT CASE WHEN lang = 'fr' THEN sha256(hash || chr(10) || 'ocr_engine:tess') ELSE hash END AS hash, lang IN ('fr', 'de') AS ocr, CASE WHEN lang = 'de' THEN 'tess' END AS meta FROM h WHERE known)
    SELECT doc_id FROM h WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE (s.hash = sha256(h.hash || chr(10) || 'ocr_engine:tess') OR (s.hash = h.hash AND (NOT s.ocr OR s.meta = 'tess'))))""",
)
def _(t):
    rows = items(t).select("doc_id", F.sha2("content", 256).alias("content_hash"), F.lit("tess").alias("ocr_engine"), "known", "lang")
    k = rows.filter("known")
    stored = k.select(
        F.col("doc_id").alias("page_id"),
        F.when(F.col("lang") == "fr", hashing.variant_hash(F.col("content_hash"), F.lit("tess"))).otherwise(F.col("content_hash")).alias("content_hash"),
        F.col("lang").isin("fr", "de").alias("contains_ocr"), F.when(F.col("lang") == "de", "tess").alias("ocr_engine"),
    )
    ocr = stored.filter("contains_ocr").select("page_id", F.lit("tess").alias("engine"))
    return dedup.drop_archived_by_engine(rows, stored, ocr).select("doc_id")


# --- governance ------------------------------------------------------------

GOVERNED_SQL = f"""{ITEMS_SQL},
  c AS (SELECT *, sha256('content=' || trim(content, {WS}) || chr(10) || 'title=' || trim(title, {WS})) AS dh FROM items),
  k AS (SELECT *, {RISK} AS risk, row_number() OVER (PARTITION BY lang, dh ORDER BY doc_id) AS rn FROM c),
  g AS (SELECT doc_id, lang, platform, risk AS injection_risk, CASE WHEN risk THEN {GONE.replace('X', f'trim(title, {WS})')} ELSE trim(title, {WS}) END AS title,
        CASE WHEN risk THEN {GONE.replace('X', f'trim(content, {WS})')} ELSE trim(content, {WS}) END AS content FROM k WHERE rn = 1)"""

POLICY = Policy(required_fields=("title", "content", "summary"), min_completeness=0.6, dedup="hash")
FIELDS = ["title", "content"]


@query(
    "governed_items",
    f"""WITH {GOVERNED_SQL} SELECT doc_id, lang, injection_risk, sha256('content=' || content || chr(10) || 'title=' || title) AS content_hash,
        round((CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN content <> '' THEN 1 ELSE 0 END) / 3.0, 4) AS field_completeness FROM g""",
)
def _(t):
    out = governance.govern(items(t).drop("url", "raw_id", "known"), POLICY, ["doc_id"], ["lang"], FIELDS)
    return out.select("doc_id", "lang", "injection_risk", "content_hash", "field_completeness")


SUMMARY_SQL = f"""WITH {GOVERNED_SQL}, s AS (SELECT lang, count(*) AS item_count, count(*) FILTER (injection_risk) AS injection_risk_count,
    round(avg(round((CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN content <> '' THEN 1 ELSE 0 END) / 3.0, 4)), 4) AS field_completeness FROM g GROUP BY lang),
  n AS (SELECT lang, count(*) AS total FROM items GROUP BY lang)
  SELECT lang, item_count, total - item_count AS duplicate_count, injection_risk_count, field_completeness, round(greatest(0.0, field_completeness - injection_risk_count * 0.1), 4) AS quality_score,
    round(injection_risk_count / item_count, 4) AS risk_rate, CASE WHEN field_completeness >= 0.6 THEN 'SUCCESS' ELSE 'PARTIAL_SUCCESS' END AS status FROM s JOIN n USING (lang)"""


def governance_summary(t):
    rows = items(t).select("doc_id", "lang", "title", "content")
    return governance.summarise_kept(governance.govern(rows, POLICY, ["doc_id"], ["lang"], FIELDS, "copies"), "copies", ["lang"], POLICY.min_completeness)


query("governance_summary", SUMMARY_SQL)(governance_summary)


@query(
    "simhash_governance",
    f"""WITH {ITEMS_SQL}, c AS (SELECT *, trim(title, {WS}) || ' ' || trim(content, {WS}) AS body FROM items), {simhash_sql('c', 'body')}
    SELECT i.lang, min(i.doc_id) AS doc_id FROM prints p JOIN items i USING (doc_id) GROUP BY i.lang, p.fp""",
)
def _(t):
    rows = spread(items(t).select("doc_id", "lang", "title", "content"))
    return governance.govern(rows, Policy((), 0.8, "simhash", 0), ["doc_id"], ["lang"], FIELDS).select("lang", "doc_id")


# --- run tables ------------------------------------------------------------


@query("run_rows", f"WITH {RUNS_SQL} SELECT run_id, rule_name, rule_path, '' AS subject, platform, status, total_collected, saved_count, dedup_filtered, '' AS output_path, strftime(started_at, '%Y-%m-%d') AS day, 3600.0::DOUBLE AS duration_seconds, error FROM runs")
def _(t):
    rows = runs(t).withColumns({"subject": F.lit(""), "output_path": F.lit(None).cast("string")})
    return run_ops.run_rows(rows).withColumn("day", F.date_format("started_at", "yyyy-MM-dd")).drop("started_at", "finished_at")


@query(
    "item_rows",
    f"WITH {ITEMS_SQL} SELECT sha256(platform || '|' || raw_id || '|') AS item_id, platform, raw_id, url, title, false AS injection_risk, to_json({{'title': title, 'url': url}})::VARCHAR AS data FROM items",
)
def _(t):
    return run_ops.item_rows(items(t), ["title", "url", "_governance"]).drop("run_id", "content_hash", "field_completeness")


@query(
    "stage_union",
    f"""WITH {ITEMS_SQL}, {REGISTRY_SQL}, m AS (SELECT i.*, r.id AS hit FROM items i LEFT JOIN registry r ON r.id = i.platform || '_' || i.raw_id)
    SELECT 'raw' AS item_stage, raw_id, url, NULL::VARCHAR AS filter_reason FROM m UNION ALL SELECT 'deduped', raw_id, url, NULL FROM m WHERE hit IS NULL
    UNION ALL SELECT 'filtered', raw_id, url, 'dedup_incremental_existing_raw_id' FROM m WHERE hit IS NOT NULL""",
)
def _(t):
    marked = dedup.split_seen(items(t), registry(t))
    new = F.col("filter_reason").isNull()
    return run_ops.stage_union(items(t), marked.filter(new), marked.filter(~new), ["title"]).select("item_stage", "raw_id", "url", "filter_reason")


@query(
    "stage_counts",
    f"""WITH {ITEMS_SQL} SELECT lang AS run_id, count(*) AS raw, count(*) FILTER (NOT known) AS deduped, count(*) FILTER (known) AS filtered FROM items GROUP BY lang""",
)
def _(t):
    rows = items(t).withColumn("run_id", F.col("lang"))
    return run_ops.stage_counts(run_ops.stage_union(rows, rows.filter("not known"), rows.filter("known"), ["title"]))


@query("governance_record_rows", f"SELECT lang AS run_id, item_count, duplicate_count, injection_risk_count, field_completeness, quality_score, status FROM ({SUMMARY_SQL}) UNION ALL SELECT 'empty', 0, 0, 0, 1.0, 1.0, 'SUCCESS'")
def _(t):
    blank = t.region.limit(1).select(F.lit("empty").alias("lang"))
    return run_ops.governance_rows(governance_summary(t).unionByName(blank, allowMissingColumns=True).withColumnRenamed("lang", "run_id"))


@query("append_modes", "SELECT 'page' AS kind, count(*) AS n, count(*) AS titled FROM documents UNION ALL SELECT 'ocr', count(*), 0 FROM pages UNION ALL SELECT 'only', count(*), 0 FROM pages")
def _(t):
    page = t.documents.select(F.lit("page").alias("kind"), F.col("text").alias("title"))
    ocr = t.pages.select(F.lit("ocr").alias("kind"), F.col("html").alias("ocr_text"))
    both = run_ops.append_records(page, ocr)
    only = run_ops.append_records(page, ocr, "ocr_rows_only").withColumn("kind", F.lit("only"))
    return both.unionByName(only, allowMissingColumns=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("titled"))


@query(
    "match_task_runs",
    """WITH tasks AS (SELECT event_id AS task_id, ts AS at, CASE WHEN event_type = 'error' THEN '' ELSE event_type || '.yaml' END AS path FROM events),
    runs AS (SELECT event_id AS run_id, ts AS s, 'rules/' || event_type || '.yaml' AS path FROM events),
    m AS (SELECT t.task_id, r.run_id, row_number() OVER (PARTITION BY t.task_id ORDER BY r.s DESC, r.run_id DESC) AS rn
          FROM tasks t JOIN runs r ON r.s BETWEEN t.at - INTERVAL 5 MINUTE AND t.at + INTERVAL 5 MINUTE AND ends_with(r.path, t.path))
    SELECT t.task_id, CAST(m.run_id AS VARCHAR) AS run_id FROM tasks t LEFT JOIN m ON m.task_id = t.task_id AND m.rn = 1""",
)
def _(t):
    path = F.concat("event_type", F.lit(".yaml"))
    tasks = t.events.select(F.col("event_id").alias("task_id"), F.from_utc_timestamp("ts", "Asia/Shanghai").alias("created_at"), F.when(F.col("event_type") != "error", path).alias("rule_path"))
    rows = t.events.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.concat(F.lit("rules/"), path).alias("rule_path"))
    return run_ops.match_runs(tasks, rows).select("task_id", "run_id")


@query(
    "match_older_item",
    """WITH stored AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS platform, CAST(o_custkey AS VARCHAR) AS raw_id, o_orderdate AS at FROM orders),
    ri AS (SELECT o_orderkey AS k, o_orderpriority AS platform, CAST(o_custkey AS VARCHAR) AS raw_id, o_orderstatus = 'F' AS filtered, CAST(o_orderkey AS VARCHAR) AS matched FROM orders),
    m AS (SELECT ri.k, s.id, row_number() OVER (PARTITION BY ri.k ORDER BY s.at DESC, s.id DESC) AS rn FROM ri JOIN stored s ON ri.filtered AND s.platform = ri.platform AND s.raw_id = ri.raw_id AND s.id <> ri.matched)
    SELECT ri.k, m.id AS old_item_id FROM ri LEFT JOIN m ON m.k = ri.k AND m.rn = 1""",
)
def _(t):
    raw = F.col("o_custkey").cast("string").alias("raw_id")
    key = F.col("o_orderkey").cast("string")
    stored = t.orders.select(key.alias("id"), F.col("o_orderpriority").alias("platform"), raw, F.col("o_orderdate").alias("collected_at"), F.lit("").alias("title"), F.lit("").alias("url"), F.lit("").alias("content_hash"))
    ri = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("platform"), raw, F.when(F.col("o_orderstatus") == "F", "filtered").otherwise("raw").alias("item_stage"), key.alias("matched_existing_id"))
    return run_ops.match_older_items(ri, stored).select("k", "old_item_id")


@query(
    "latest_archive_per_url",
    """WITH a AS (SELECT o_orderkey, 'https://p' || o_custkey || '.example.org/' AS source_url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
    SELECT c.c_custkey, a.o_orderkey AS page FROM customer c LEFT JOIN a ON a.rn = 1 AND a.source_url = 'https://p' || c.c_custkey || '.example.org/'""",
)
def _(t):
    url = lambda c: F.concat(F.lit("https://p"), F.col(c).cast("string"), F.lit(".example.org/"))
    pages = t.orders.select(F.col("o_orderkey").alias("id"), url("o_custkey").alias("source_url"), F.col("o_orderdate").alias("fetched_at"))
    rows = t.customer.select("c_custkey", url("c_custkey").alias("url"))
    return run_ops.attach_archive(rows, run_ops.latest_archive(pages)).select("c_custkey", F.col("archive.id").alias("page"))


@query(
    "run_totals",
    f"WITH {RUNS_SQL} SELECT count(*) AS total_runs, sum(total_collected)::BIGINT AS total_collected, count(*) FILTER (error <> '') AS total_failed FROM runs",
)
def _(t):
    return run_ops.global_stats(runs(t))


@query(
    "rule_stats",
    f"""WITH {RUNS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY finished_at DESC, run_id DESC) AS rn FROM runs)
    SELECT platform AS rule_name, strftime(max(finished_at), '%Y-%m-%d %H') AS last_run_at, max(status) FILTER (rn = 1) AS last_status, max(total_collected) FILTER (rn = 1) AS last_collected,
      max(dedup_filtered) FILTER (rn = 1) AS last_dedup_filtered, max(error) FILTER (rn = 1) AS last_error, count(*) AS total_runs, sum(total_collected)::BIGINT AS total_collected FROM l GROUP BY platform""",
)
def _(t):
    out = run_ops.rule_stats(runs(t).withColumn("rule_name", F.col("platform")))
    return out.withColumn("last_run_at", F.date_format("last_run_at", "yyyy-MM-dd HH"))


@query(
    "rules_with_last_run",
    f"""WITH {RUNS_SQL}, s AS (SELECT rule_name, count(*) AS n FROM runs GROUP BY rule_name) SELECT source AS rule_name, s.n AS total_runs FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN s ON s.rule_name = d.source
    UNION ALL SELECT rule_name, n FROM s""",
)
def _(t):
    rules = t.documents.select(F.col("source").alias("rule_name")).distinct().unionByName(runs(t).select("rule_name").distinct())
    return run_ops.rules_with_last_run(rules, runs(t)).select("rule_name", "total_runs")


@query(
    "batch_totals",
    f"WITH {RUNS_SQL} SELECT count(*) AS total_rules, (sum(saved_count) FILTER (status = 'success'))::BIGINT AS total_new, 0::BIGINT AS total_skipped, count(*) FILTER (status <> 'success') AS total_errors, count(*) FILTER (status = 'partial_success') AS total_partial FROM runs",
)
def _(t):
    return run_ops.batch_totals(runs(t))


@query(
    "subject_rules",
    "WITH f AS (SELECT lang AS subject, source AS rule_name, min(doc_id) AS seq FROM documents GROUP BY ALL) SELECT subject, rule_name, CAST(row_number() OVER (PARTITION BY subject ORDER BY seq, rule_name) AS INTEGER) AS position FROM f",
)
def _(t):
    return run_ops.subject_rules(t.documents.select(F.col("lang").alias("subject"), F.col("source").alias("rule_name"), F.col("doc_id").alias("seq")))


FOLD_SQL = f"""WITH {EVENTS_SQL} SELECT task_id, coalesce(sum(new_count) FILTER (type = 'complete'), 0)::BIGINT AS total_new, count(*) FILTER (type = 'skip') AS total_skip, count(*) FILTER (type = 'error') AS total_error,
    arg_max(message, seq) FILTER (type = 'error') AS last_error, count(*) FILTER (type = 'summary') AS summaries, max(seq) AS last_seq,
    CASE WHEN count(*) FILTER (type = 'error') > 0 THEN 'failed' ELSE 'success' END AS done FROM task_events GROUP BY task_id"""


@query("task_event_fold", f"SELECT * EXCLUDE (done), CASE WHEN summaries > 0 THEN done ELSE 'running' END AS final_status FROM ({FOLD_SQL})")
def _(t):
    return run_ops.fold_events(task_events(t))


@query("closed_tasks", f"SELECT task_id, done AS final_status FROM ({FOLD_SQL})")
def _(t):
    return run_ops.close_tasks(run_ops.fold_events(task_events(t))).select("task_id", "final_status")


@query("task_event_replay", f"WITH {EVENTS_SQL} SELECT seq, type, message FROM task_events WHERE task_id = (SELECT max(user_id) FROM events)")
def _(t):
    top = t.events.agg(F.max("user_id").alias("task_id"))
    return run_ops.replay(task_events(t), top).select("seq", "type", "message")


@query(
    "task_history",
    "SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS ng_status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
)
def _(t):
    s = F.col("o_orderstatus")
    rows = t.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("created_at"), F.when(s == "F", "failed").when(s == "P", "partial_success").otherwise("completed").alias("status"))
    return run_ops.task_history(rows).select("task_id", "ng_status")


# --- events as JSON lines --------------------------------------------------


def _lines(t):
    e = task_events(t)
    ts = F.unix_seconds("ts")
    rule = F.concat(F.lit("r"), F.col("task_id").cast("string"))
    line = (
        F.when(F.col("type") == "complete", writers.event_json("complete", ts, rule=rule, new_count=F.col("new_count"), skip_count=F.lit(0), duration=F.col("value")))
        .when(F.col("type") == "error", writers.event_json("error", ts, rule=rule, message=F.col("message"), detail=F.lit("")))
        .when(F.col("type") == "skip", writers.event_json("skip", ts, rule=rule, reason=F.lit("seen")))
        .when(F.col("type") == "progress", F.lit("  "))
        .otherwise(F.lit("{broken"))
    )
    return e.select("seq", line.alias("value"))


@query(
    "event_line_writing",
    f"""WITH {EVENTS_SQL} SELECT seq, CASE type WHEN 'error' THEN '{{"type":"error","ts":' || epoch_us(ts) // 1000000 || ',"rule":"r' || task_id || '","message":"' || replace(message, '"', '\\"') || '","detail":""}}'
       ELSE '{{"type":"skip","ts":' || epoch_us(ts) // 1000000 || ',"rule":"r' || task_id || '","reason":"seen"}}' END AS value FROM task_events WHERE type IN ('error', 'skip')""",
)
def _(t):
    return _lines(t).filter(F.col("value").contains('"error"') | F.col("value").contains('"skip"'))


@query(
    "event_line_scan",
    f"""WITH {EVENTS_SQL} SELECT seq, type, epoch_us(ts) // 1000000 AS ts, 'r' || task_id AS rule, CASE WHEN type = 'error' THEN message END AS message,
       CASE WHEN type = 'complete' THEN new_count END AS new_count, CASE WHEN type = 'complete' THEN round(value, 2) END AS duration FROM task_events WHERE type IN ('complete', 'error', 'skip')""",
)
def _(t):
    return readers.event_lines(_lines(t)).select("seq", "type", "ts", "rule", "message", "new_count", "duration")


# --- whole runs ------------------------------------------------------------

RUN_SQL = f"""{ITEMS_SQL}, {REGISTRY_SQL},
  m AS (SELECT i.*, r.id IS NOT NULL AS hit, sha256('content=' || trim(content, {WS}) || chr(10) || 'title=' || trim(title, {WS})) AS dh FROM items i LEFT JOIN registry r ON r.id = i.platform || '_' || i.raw_id),
  kept AS (SELECT *, {RISK} AS risk, row_number() OVER (PARTITION BY lang, dh ORDER BY doc_id) AS rn FROM m WHERE NOT hit),
  tot AS (SELECT lang, count(*) AS total_collected, count(*) FILTER (hit) AS dedup_filtered, count(*) FILTER (NOT hit) AS fresh FROM m GROUP BY lang),
  gov AS (SELECT lang, count(*) AS item_count, count(*) FILTER (risk) AS injection_risk_count FROM kept WHERE rn = 1 GROUP BY lang)"""


def _run(t):
    rows = items(t).withColumns({"run_id": F.col("lang"), "seq": F.col("doc_id")})
    return collect.run_items(rows, registry(t), Policy(("title",), 0.8, "hash"), ["title", "content"])


@query(
    "collect_run_summary",
    f"""WITH {RUN_SQL} SELECT lang AS run_id, total_collected, dedup_filtered, coalesce(item_count, 0) AS item_count, fresh - coalesce(item_count, 0) AS duplicate_count, coalesce(injection_risk_count, 0) AS injection_risk_count
    FROM tot LEFT JOIN gov USING (lang)""",
)
def _(t):
    return _run(t).summary.select("run_id", "total_collected", "dedup_filtered", "item_count", "duplicate_count", "injection_risk_count")


@query(
    "collect_run_stages",
    f"""WITH {RUN_SQL} SELECT lang AS run_id, 'raw' AS item_stage, raw_id FROM m UNION ALL SELECT lang, 'deduped', raw_id FROM kept WHERE rn = 1 UNION ALL SELECT lang, 'filtered', raw_id FROM m WHERE hit""",
)
def _(t):
    return _run(t).stages().select("run_id", "item_stage", "raw_id")


@query(
    "run_all_rules",
    f"""WITH {RUN_SQL}, r AS (SELECT lang AS run_id, CASE lang WHEN 'de' THEN 'skipped' WHEN 'es' THEN 'failed' ELSE 'success' END AS status, CASE WHEN lang IN ('de', 'es') THEN 0 ELSE coalesce(item_count, 0) END AS saved_count FROM tot LEFT JOIN gov USING (lang))
    SELECT count(*) AS total_rules, (sum(saved_count) FILTER (status = 'success'))::BIGINT AS total_new, count(*) FILTER (status = 'skipped') AS total_skipped, count(*) FILTER (status = 'failed') AS total_errors, 0::BIGINT AS total_partial FROM r""",
)
def _(t):
    rules = t.documents.select(F.col("lang").alias("run_id")).distinct().withColumns(
        {"enabled": F.col("run_id") != "de", "source_enabled": F.lit(None).cast("boolean"), "error": F.when(F.col("run_id") == "es", "boom")}
    )
    rows = items(t).withColumns({"run_id": F.col("lang"), "seq": F.col("doc_id")})
    _, done = collect.run_all(rows, registry(t), rules, Policy((), 0.8, "hash"), ["title", "content"])
    return run_ops.batch_totals(done)


RULE_V2 = {
    "name": "docs", "rule_id": "docs", "source_id": "docs", "list": {"items_path": "css:nav li"},
    "extract": {"title": {"selector": "a"}, "url": {"type": "attribute", "selector": "a", "attribute": "href"}},
    "governance": {"dedup": "hash", "required_fields": ["title", "url"]}, "dedup": {"url_to_id_pattern": r"/(\w+)$"},
}


@query(
    "rule_run_over_pages",
    """WITH li AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS title FROM pages),
    r AS (SELECT trim(title) AS title, trim(url) AS url, nullif(regexp_extract(url, '/([a-zA-Z0-9_]+)$', 1), '') AS raw_id FROM li)
    SELECT DISTINCT title, url, raw_id, round((CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN url <> '' THEN 1 ELSE 0 END) / 2.0, 4) AS field_completeness FROM r""",
)
def _(t):
    out = collect.run_rule(t.pages, RULE_V2, None, "r1")
    return out.governed.select("title", "url", "raw_id", "field_completeness")


@query(
    "rule_preview",
    """WITH li AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS title,
        generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2), 1) AS pos FROM pages),
    f AS (SELECT trim(title) AS title, trim(url) AS url, min(page_id * 100000 + pos) AS seq FROM li GROUP BY ALL) SELECT title, url FROM f ORDER BY seq LIMIT 20""",
)
def _(t):
    return collect.preview_rule(t.pages, RULE_V2, 50).select("title", "url")
