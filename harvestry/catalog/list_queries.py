"""Sources, lists, result files and logs."""

from pyspark.sql import functions as F

from ..operators import lists, runs as run_ops, sources_registry as sources
from ..sources import readers, writers
from . import query
from .fixtures import ITEMS_SQL, RUNS_SQL, WS, items, runs

# --- rules and sources -----------------------------------------------------

# One rule per document source and language; labels switch some of them off.
RULES_SQL = """rules AS (
  SELECT 'rules/' || d.source || '/' || d.lang || '.yaml' AS rule_path, d.lang || ' of ' || d.source AS name, CASE WHEN d.lang = 'en' THEN d.source || '-en' ELSE '' END AS source_id,
         d.lang AS subject, CASE WHEN d.lang = 'fr' THEN '' ELSE d.source END AS platform, CASE WHEN d.lang = 'de' THEN 'api' ELSE 'html' END AS source_type,
         'https://' || d.source || '.example.org:81/list' AS source_url, count(l.doc_id) > 1 AS enabled, sum(l.quality) IS NULL OR sum(l.quality) > 0 AS source_enabled
  FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source, d.lang)"""


def rules(t):
    d = t.documents.select("doc_id", "source", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    g = d.groupBy("source", "lang").agg((F.count("quality") > 1).alias("enabled"), (F.sum("quality").isNull() | (F.sum("quality") > 0)).alias("source_enabled"))
    null = F.lit(None).cast("string")
    return g.select(
        F.concat(F.lit("rules/"), "source", F.lit("/"), "lang", F.lit(".yaml")).alias("rule_path"), F.concat("lang", F.lit(" of "), "source").alias("name"),
        F.when(F.col("lang") == "en", F.concat("source", F.lit("-en"))).otherwise("").alias("source_id"), F.col("lang").alias("subject"), null.alias("source_subject"),
        F.when(F.col("lang") == "fr", "").otherwise(F.col("source")).alias("platform"), null.alias("source_name"), F.when(F.col("lang") == "de", "api").otherwise("html").alias("source_type"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org:81/list")).alias("source_url"), "enabled", "source_enabled", F.when(F.col("lang") == "es", "basic").alias("auth_type"),
        F.array("lang").alias("tags"), F.lit(None).cast("int").alias("update_frequency"), null.alias("anti_crawl_level"), null.alias("language"),
    )


DERIVED_SQL = f"""{RULES_SQL}, derived AS (
  SELECT CASE WHEN source_id <> '' THEN source_id ELSE rule_path END AS id, name, regexp_extract(source_url, '//([^/]*)', 1) AS domain, CASE source_type WHEN 'api' THEN 'api' ELSE 'website' END AS type, subject AS category,
    CASE WHEN enabled AND source_enabled THEN 0.85 ELSE 0.3 END::DOUBLE AS base, 3600 AS update_frequency, source_type AS parser_strategy, CASE WHEN subject = 'es' THEN 1 ELSE 0 END AS auth_required,
    CASE WHEN enabled AND source_enabled THEN 1 ELSE 0 END AS enabled, CASE WHEN enabled AND source_enabled THEN 'ACTIVE' ELSE 'PAUSED' END AS lifecycle_status, rule_path,
    CASE WHEN platform <> '' THEN platform WHEN source_id <> '' THEN source_id ELSE subject END AS platform FROM rules)"""


@query("enabled_rules", f"WITH {RULES_SQL} SELECT rule_path FROM rules WHERE enabled AND source_enabled")
def _(t):
    return rules(t).filter(sources.is_enabled()).select("rule_path")


@query("subject_fallback", "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE source END AS subject FROM documents")
def _(t):
    rows = t.documents.select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("").alias("a"), F.when(F.col("lang") == "fr", "fr").alias("b"), F.col("source").alias("c"))
    return rows.select("doc_id", sources.resolve_subject("a", "b", "c").alias("subject"))


@query("source_derivation", f"WITH {DERIVED_SQL} SELECT id, name, domain, type, category, base AS trust_score, update_frequency, 'low' AS anti_crawl_level, parser_strategy, auth_required, 'zh-CN' AS language, enabled, lifecycle_status, rule_path, platform FROM derived")
def _(t):
    return sources.derive_sources(rules(t)).drop("tags")


HISTORY_SQL = f"""{RUNS_SQL}, h AS (SELECT platform, price / 1000000 AS q, row_number() OVER (PARTITION BY platform ORDER BY started_at DESC, o_orderkey DESC) AS rn FROM runs),
  history AS (SELECT platform, round(avg(q), 4) AS history FROM h WHERE rn <= 20 GROUP BY platform)"""


def _records(t):
    return runs(t).select("platform", (F.col("price") / 1000000).alias("quality_score"), F.col("started_at").alias("created_at"), "o_orderkey")


@query("trust_history", f"WITH {HISTORY_SQL} SELECT * FROM history")
def _(t):
    return sources.history_trust(_records(t), ("created_at", "o_orderkey"))


@query(
    "trust_blend",
    f"""WITH {HISTORY_SQL} SELECT 'p' || c_custkey AS platform, coalesce(round(0.6 * history + 0.4 * CASE WHEN c_acctbal > 0 THEN 0.85 ELSE 0.3 END, 4), CASE WHEN c_acctbal > 0 THEN 0.85 ELSE 0.3 END)::DOUBLE AS trust_score
    FROM customer LEFT JOIN history ON history.platform = 'p' || c_custkey""",
)
def _(t):
    rows = t.customer.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("platform"), F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("enabled"), F.lit(0.0).alias("trust_score"))
    return sources.blend_trust(rows, sources.history_trust(_records(t), ("created_at", "o_orderkey"))).select("platform", "trust_score")


@query(
    "source_sync",
    f"""WITH {DERIVED_SQL}, old AS (SELECT 'rules/' || s_suppkey || '.yaml' AS id, s_name AS name, 'rules/' || s_suppkey || '.yaml' AS rule_path FROM supplier
      UNION ALL SELECT s_name, s_name, 'manual/' || s_suppkey FROM supplier UNION ALL SELECT id, 'stale name', rule_path FROM derived WHERE category = 'en')
    SELECT id, name, rule_path FROM derived UNION ALL SELECT id, name, rule_path FROM old WHERE id NOT IN (SELECT id FROM derived) AND NOT starts_with(rule_path, 'rules/')""",
)
def _(t):
    derived = sources.derive_sources(rules(t))
    key = F.col("s_suppkey").cast("string")
    gone = F.concat(F.lit("rules/"), key, F.lit(".yaml"))
    old = t.supplier.select(gone.alias("id"), F.col("s_name").alias("name"), gone.alias("rule_path"))
    manual = t.supplier.select(F.col("s_name").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("manual/"), key).alias("rule_path"))
    stale = derived.filter("category = 'en'").select("id", F.lit("stale name").alias("name"), "rule_path")
    return sources.sync_sources(old.unionByName(manual).unionByName(stale), derived)


@query("source_list", f"WITH {DERIVED_SQL} SELECT id, enabled, category, name FROM derived ORDER BY enabled DESC, category, name")
def _(t):
    return sources.list_sources(sources.derive_sources(rules(t))).select("id", "enabled", "category", "name")


@query("source_summary", f"WITH {DERIVED_SQL} SELECT count(*) AS total, count(*) FILTER (enabled = 1) AS active, count(*) FILTER (enabled = 0) AS paused, round(avg(base), 4) AS avg_trust_score FROM derived")
def _(t):
    return sources.source_summary(sources.derive_sources(rules(t)))


@query("dom_baseline_upsert", "SELECT 'rules/' || page_id AS rule_path, sha256(CASE WHEN contains(html, '<b>') THEN html ELSE url END) AS dom_hash FROM pages")
def _(t):
    path = F.concat(F.lit("rules/"), F.col("page_id").cast("string")).alias("rule_path")
    old = t.pages.select(path, F.sha2("url", 256).alias("dom_hash"))
    return sources.set_baseline(old, t.pages.filter(F.contains("html", F.lit("<b>"))).select(path, F.sha2("html", 256).alias("dom_structure_hash")))


# --- list filters ----------------------------------------------------------


@query("title_keyword_filter", f"WITH {ITEMS_SQL} SELECT doc_id, contains(title, 'the') OR contains(title, 'de') AS hit, true AS no_keywords FROM items")
def _(t):
    return items(t).select("doc_id", lists.any_keyword("title", ["the", "de"]).alias("hit"), lists.any_keyword("title", []).alias("no_keywords"))


@query("archive_list_filter", "SELECT page_id FROM pages WHERE regexp_extract(url, '//([^/]*)', 1) <> '' AND contains(html, '<b>') AND contains(lower('page ' || page_id || chr(10) || url || chr(10) || regexp_extract(url, '//([^/?#]*)', 1) || chr(10) || 'Web'), 'example.org')")
def _(t):
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    rows = t.pages.select("page_id", F.lit("docs").alias("platform"), F.contains("html", F.lit("<b>")).alias("contains_ocr"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.col("url").alias("source_url"), host.alias("domain"), F.lit("Web").alias("subject"))
    return lists.filter_archives(rows, "docs", True, "Example.ORG").select("page_id")


@query("source_list_filter", f"WITH {DERIVED_SQL} SELECT id FROM derived WHERE lifecycle_status = 'ACTIVE' AND type = 'website' AND contains(lower(id || chr(10) || name || chr(10) || domain || chr(10) || category || chr(10) || rule_path), 'src1')")
def _(t):
    return lists.filter_sources(sources.derive_sources(rules(t)), "ACTIVE", "website", "SRC1").select("id")


@query("rule_list_filter", f"WITH {RULES_SQL} SELECT rule_path FROM rules WHERE platform = 'src3' AND enabled AND contains(lower(name || chr(10) || subject || chr(10) || platform || chr(10) || rule_path), 'es')")
def _(t):
    return lists.filter_rules(rules(t), "src3", True, "ES").select("rule_path")


@query("scope_filter", f"WITH {RULES_SQL} SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM rules r WHERE r.enabled AND r.subject = d.lang AND r.platform = d.source)")
def _(t):
    rows = t.documents.select("doc_id", F.col("lang").alias("subject"), F.col("source").alias("platform"))
    return run_ops.in_scope(rows, rules(t).filter("enabled")).select("doc_id")


# --- heads and pages -------------------------------------------------------


@query("list_page", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100 OFFSET 200")
def _(t):
    return lists.page_of(t.customer, [F.col("c_acctbal").desc(), "c_custkey"], 3, 500).select("c_custkey")


@query("latest_runs", f"WITH {RUNS_SQL} SELECT run_id, status FROM runs ORDER BY started_at DESC, o_orderkey DESC LIMIT 100")
def _(t):
    return lists.newest(runs(t), [F.col("started_at").desc(), F.col("o_orderkey").desc()], 100).select("run_id", "status")


@query("latest_errors", f"WITH {RUNS_SQL} SELECT run_id, error FROM runs WHERE error <> '' ORDER BY started_at DESC, o_orderkey DESC LIMIT 50")
def _(t):
    return lists.newest(runs(t).filter("error <> ''"), [F.col("started_at").desc(), F.col("o_orderkey").desc()], 50).select("run_id", "error")


@query("newest_archives", "SELECT page_id FROM pages ORDER BY url DESC LIMIT 200")
def _(t):
    return lists.newest(t.pages, [F.col("url").desc()], 200).select("page_id")


@query("run_item_order", f"WITH {ITEMS_SQL} SELECT doc_id, lang AS item_stage FROM items ORDER BY lang, title NULLS LAST, raw_id NULLS LAST")
def _(t):
    return lists.run_item_order(items(t).withColumn("item_stage", F.col("lang"))).select("doc_id", "item_stage")


@query(
    "details_limit_per_run",
    "WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) SELECT l_orderkey, l_partkey FROM r WHERE rn <= 3",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("page_no"), F.struct("l_partkey", "l_suppkey").alias("pos"))
    return lists.first_details(rows, lists.details_limit("3"), ["l_orderkey"]).select("l_orderkey", "l_partkey")


# --- result files ----------------------------------------------------------


def _files(t):
    """Result files out of documents: one object file per document, a JSON-line
    file for French ones, a broken object for Spanish ones."""
    item = F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("x").alias("title")))
    meta = F.to_json(F.struct(F.col("lang").alias("subject"), F.col("source").alias("platform"), F.struct(F.length("text").alias("item_count"), F.when(F.col("lang") == "en", 0.5).alias("field_completeness")).alias("governance")))
    obj = F.concat(F.lit(' {"meta":'), meta, F.lit(',"data":['), item, F.lit(","), item, F.lit("]}\n"))
    jsonl = F.concat(item, F.lit("\n\n{bad\n"), item, F.lit("\n"))
    # A JSON-line file must not start with "{".
    body = F.when(F.col("lang") == "fr", F.concat(F.lit("[1]\n"), jsonl)).when(F.col("lang") == "es", "{broken").otherwise(obj)
    name = F.concat(F.lit("data_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".json"))
    return t.documents.select("doc_id", F.col("lang").alias("subject"), F.col("source").alias("platform"), name.alias("file_name"), body.alias("body"), "text")


FILES_SQL = "files AS (SELECT doc_id, lang AS subject, source AS platform, 'data_' || lpad(doc_id::VARCHAR, 12, '0') || '.json' AS file_name, CASE lang WHEN 'fr' THEN 4 WHEN 'es' THEN 0 ELSE 2 END AS item_count, text FROM documents)"


@query("result_file_counts", f"WITH {FILES_SQL} SELECT doc_id, item_count FROM files")
def _(t):
    return readers.result_counts(_files(t)).select("doc_id", "item_count")


@query(
    "result_file_items",
    f"WITH {FILES_SQL} SELECT doc_id, item_count AS total, CASE WHEN p = 0 AND subject = 'fr' THEN '[1]' ELSE '{{\"id\":' || doc_id || ',\"title\":\"x\"}}' END AS item FROM files, (VALUES (0), (1), (2)) v(p) WHERE (subject = 'fr' OR (subject <> 'es' AND p < 2))",
)
def _(t):
    return readers.result_items(_files(t), ["doc_id"]).select("doc_id", "total", "item")


@query("result_file_place", f"WITH {FILES_SQL} SELECT doc_id, subject || ' x' AS subject, platform, file_name FROM files")
def _(t):
    file = F.concat(F.lit("file:/out/"), "subject", F.lit("%20x/"), "platform", F.lit("/"), "file_name")
    place = readers.place_of(file)
    return _files(t).select("doc_id", *[place[c].alias(c) for c in ("subject", "platform", "file_name")])


@query("latest_file_per_platform", f"WITH {FILES_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY subject, platform ORDER BY file_name DESC) AS rn FROM files) SELECT subject, platform, file_name, item_count FROM m WHERE rn = 1")
def _(t):
    return lists.file_counts(readers.result_counts(_files(t)))


@query(
    "subject_platform_counts",
    f"""WITH {FILES_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY subject, platform ORDER BY file_name DESC) AS rn FROM files)
    SELECT subject, platform, sum(item_count)::BIGINT AS total, count(*) AS platforms, max(file_name) AS latest_file, grouping(platform) AS is_subject FROM m WHERE rn = 1 GROUP BY GROUPING SETS ((subject, platform), (subject))""",
)
def _(t):
    return lists.subject_counts(readers.result_counts(_files(t)))


@query(
    "preview_union",
    f"WITH {FILES_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY subject, platform ORDER BY file_name DESC) AS rn FROM files) SELECT subject, platform, file_name AS source_file, count(*) AS items FROM m, range(0, 3) r(p) WHERE rn <= 5 AND subject <> 'es' AND (subject = 'fr' OR p < 2) GROUP BY ALL",
)
def _(t):
    top = lists.latest_files(_files(t), 5)
    found = readers.result_items(top.withColumnRenamed("file_name", "source_file"), ["subject", "platform", "source_file"])
    return found.groupBy("subject", "platform", "source_file").agg(F.count(F.lit(1)).alias("items"))


@query("distinct_platforms", "SELECT DISTINCT lang AS subject, source AS platform FROM documents ORDER BY 1, 2")
def _(t):
    return lists.distinct_sorted(_files(t), "subject", "platform")


REC_SQL = f"""{FILES_SQL}, rec AS (SELECT subject, platform, file_name, length(text) AS item_count, 0 AS duplicate_count, 0 AS injection_risk_count, CASE subject WHEN 'en' THEN 0.5 ELSE 1.0 END::DOUBLE AS field_completeness FROM files WHERE subject IN ('en', 'de')
   UNION ALL SELECT '', '', file_name, 0, 0, 0, 0.0 FROM files WHERE subject NOT IN ('en', 'de'))"""


@query("governance_file_records", f"WITH {REC_SQL} SELECT *, field_completeness AS quality_score, CASE WHEN field_completeness >= 0.8 THEN 'SUCCESS' ELSE 'PARTIAL_SUCCESS' END AS status FROM rec")
def _(t):
    return lists.governance_records(readers.result_meta(_files(t)))


@query(
    "governance_totals",
    f"""WITH {REC_SQL}, top AS (SELECT * FROM rec WHERE subject = 'en' ORDER BY file_name DESC LIMIT 100)
    SELECT count(*) AS file_count, sum(item_count)::BIGINT AS total_items, sum(injection_risk_count)::BIGINT AS injection_risk_count, round(avg(field_completeness), 4) AS avg_field_completeness, round(avg(field_completeness), 4) AS avg_quality_score FROM top""",
)
def _(t):
    recs = lists.governance_records(readers.result_meta(_files(t)))
    scopes = t.documents.filter("lang = 'en'").select(F.col("lang").alias("subject"), F.col("source").alias("platform"))
    return lists.governance_totals(run_ops.in_scope(recs, scopes), 100)


@query(
    "governance_latest",
    f"WITH {REC_SQL}, top AS (SELECT * FROM rec WHERE subject = 'en' ORDER BY file_name DESC, subject, platform LIMIT 100) SELECT subject, platform, file_name, item_count FROM top ORDER BY file_name DESC, subject, platform LIMIT 30",
)
def _(t):
    recs = lists.governance_records(readers.result_meta(_files(t)))
    return lists.governance_latest(recs.filter("subject = 'en'")).select("subject", "platform", "file_name", "item_count")


@query(
    "governance_totals_equal_names",
    """WITH rec AS (SELECT lang AS subject, source AS platform, 'data_' || doc_id % 3 AS file_name, sum(length(text))::BIGINT AS item_count FROM documents GROUP BY ALL), top AS (SELECT * FROM rec ORDER BY file_name DESC, subject, platform LIMIT 20)
    SELECT count(*) AS file_count, sum(item_count)::BIGINT AS total_items FROM top""",
)
def _(t):
    # Every platform has a file of each name.
    rows = t.documents.groupBy(F.col("lang").alias("subject"), F.col("source").alias("platform"), F.concat(F.lit("data_"), F.col("doc_id") % 3).alias("file_name")).agg(F.sum(F.length("text")).alias("item_count"))
    full = rows.withColumns({"injection_risk_count": F.lit(0), "field_completeness": F.lit(1.0), "quality_score": F.lit(1.0)})
    return lists.governance_totals(full, 20).select("file_count", "total_items")


@query("log_list", "SELECT 'run_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey || '.log' AS name, length(o_orderpriority) AS size FROM orders WHERE o_orderkey % 4 <> 0")
def _(t):
    name = F.concat(F.lit("run_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 4 == 0, ".txt").otherwise(".log"))
    return lists.log_list(t.orders.select(name.alias("name"), F.length("o_orderpriority").cast("bigint").alias("size")))


@query(
    "combined_latest",
    """WITH o AS (SELECT o_orderpriority AS subject, date_trunc('month', o_orderdate) AS seen, o_orderkey AS pos, 'u' || o_custkey AS url FROM orders),
    f AS (SELECT subject, seen, row_number() OVER (PARTITION BY subject ORDER BY seen DESC) AS rn FROM (SELECT DISTINCT subject, seen FROM o)),
    w AS (SELECT o.*, row_number() OVER (PARTITION BY o.subject, url ORDER BY o.seen DESC, pos) AS n FROM o JOIN f ON f.subject = o.subject AND f.seen = o.seen WHERE f.rn <= 20)
    SELECT subject, url, strftime(seen, '%Y-%m') AS file, pos FROM w WHERE n = 1""",
)
def _(t):
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = t.orders.select(F.col("o_orderpriority").alias("subject"), month.alias("file"), F.date_trunc("month", "o_orderdate").alias("modified_at"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"))
    return writers.combined_latest(rows, 20).select("subject", "url", "file", "pos")


@query("table_upsert", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'new' ELSE c_name END AS name FROM customer")
def _(t):
    old = t.customer.select("c_custkey", F.col("c_name").alias("name"))
    return writers.upsert(old, t.customer.filter("c_acctbal > 0").select("c_custkey", F.lit("new").alias("name")), ["c_custkey"])


@query(
    "log_tail",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), k AS (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS x FROM l),
    u AS (SELECT doc_id AS name, len(x) AS total, unnest(x) AS line, generate_subscripts(x, 1) AS line_no FROM k) SELECT name, CAST(total AS INTEGER) AS total, CAST(line_no AS INTEGER) AS line_no, line FROM u WHERE line_no > total - 3""",
)
def _(t):
    return lists.log_tail(t.documents.select(F.col("doc_id").alias("name"), F.col("text").alias("content")), 3)


# --- task detail -----------------------------------------------------------


@query(
    "task_items_detail",
    """WITH ev AS (SELECT *, 'rules/' || event_type || '.yaml' AS path FROM events),
    tasks AS (SELECT event_id AS task_id, ts AS at, path FROM ev WHERE event_type = 'signup'),
    m AS (SELECT t.task_id, r.event_id AS run_id, row_number() OVER (PARTITION BY t.task_id ORDER BY r.ts DESC, r.event_id DESC) AS rn FROM tasks t JOIN ev r ON r.ts BETWEEN t.at - INTERVAL 5 MINUTE AND t.at + INTERVAL 5 MINUTE AND r.path = t.path),
    pg AS (SELECT user_id, arg_max(event_id, (ts, -event_id)) AS page FROM events GROUP BY user_id)
    SELECT m.task_id, e.event_id AS raw_id, CASE WHEN e.value > 20 THEN 'filtered' ELSE 'raw' END AS item_stage, pg.page,
      CASE WHEN e.value > 20 THEN (SELECT max(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND x.event_id <> e.event_id) END AS old_item
    FROM m JOIN ev e ON e.event_id = m.run_id AND m.rn = 1 LEFT JOIN pg ON pg.user_id = e.user_id""",
)
def _(t):
    from ..plans import reports

    e = t.events.withColumn("path", F.concat(F.lit("rules/"), "event_type", F.lit(".yaml")))
    key, user, blank = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.lit("")
    tasks = e.filter("event_type = 'signup'").select(F.col("event_id").alias("task_id"), F.from_utc_timestamp("ts", "Asia/Shanghai").alias("created_at"), F.col("path").alias("rule_path"))
    run_table = e.select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.col("path").alias("rule_path"))
    ri = e.select(key.alias("run_id"), F.col("event_id"), F.col("event_type").alias("platform"), user.alias("raw_id"), F.when(F.col("value") > 20, "filtered").otherwise("raw").alias("item_stage"), key.alias("matched_existing_id"), user.alias("url"))
    stored = e.select(key.alias("id"), F.col("event_type").alias("platform"), user.alias("raw_id"), F.col("event_id").alias("collected_at"), blank.alias("title"), blank.alias("url"), blank.alias("content_hash"))
    pages = e.select(F.col("event_id").alias("id"), user.alias("source_url"), F.col("ts").alias("fetched_at"))
    out = reports.task_detail(tasks, run_table, ri, stored, pages)
    return out.select("task_id", F.col("event_id").alias("raw_id"), "item_stage", F.col("archive.id").alias("page"), F.col("old_item_id").cast("bigint").alias("old_item"))
