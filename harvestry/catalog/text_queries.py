"""Scalar and string functions."""

from pyspark.sql import functions as F

from ..functions import hashing, ocr, text, transforms, urls
from ..operators import governance
from ..sources.html_nodes import with_fragment
from ..operators import dom
from . import query
from .fixtures import ITEMS_SQL, RUNS_SQL, WS, items, runs

D = "documents"


@query("strip_html", "SELECT doc_id, regexp_replace('<b class=\"x\">' || text || '</b>', '<[^>]+>', '', 'g') AS value FROM documents")
def _(t):
    return t.documents.select("doc_id", text.strip_html(F.concat(F.lit('<b class="x">'), "text", F.lit("</b>"))).alias("value"))


@query("trim_unicode_space", f"SELECT doc_id, trim(chr(12288) || chr(10) || text || chr(9) || chr(160), {WS}) AS value FROM documents")
def _(t):
    return t.documents.select("doc_id", text.strip(F.concat(F.lit("　\n"), "text", F.lit("\t "))).alias("value"))


@query(
    "epoch_to_iso",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS from_seconds,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) // 1000 % 1000 = 0 THEN '' ELSE '.' || lpad(CAST((epoch_us(ts) // 1000 % 1000) * 1000 AS VARCHAR), 6, '0') END AS from_millis,
       props AS bad_value FROM events""",
)
def _(t):
    return t.events.select(
        "event_id", text.epoch_to_iso(F.unix_seconds("ts")).alias("from_seconds"), text.epoch_to_iso(F.unix_millis("ts")).alias("from_millis"),
        text.epoch_to_iso("props").alias("bad_value"),
    )


@query("transform_chain", f"SELECT doc_id, trim(regexp_replace(' <i>' || text || '</i>' || chr(10), '<[^>]+>', '', 'g'), {WS}) AS value FROM documents")
def _(t):
    return t.documents.select("doc_id", transforms.apply_transforms(F.concat(F.lit(" <i>"), "text", F.lit("</i>\n")), "strip_html, unknown ,trim").alias("value"))


@query("sql_function_registry", "SELECT doc_id, regexp_replace('<p>' || text || '</p>', '<[^>]+>', '', 'g') AS value FROM documents")
def _(t):
    transforms.register_sql_functions(t.spark)
    t.documents.createOrReplaceTempView("_harvestry_documents")
    return t.spark.sql("SELECT doc_id, strip_html(concat('<p>', text, '</p>')) AS value FROM _harvestry_documents")


_CLEAN = f"trim(regexp_replace(regexp_replace(replace(X, '&amp;', '&'), '<[^>]+>', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), {WS})"


@query(
    "clean_record",
    f"SELECT doc_id, {_CLEAN.replace('X', chr(39) + ' <p>' + chr(39) + ' || title || chr(1) || ' + chr(39) + '</p> &amp;' + chr(39))} AS title, {_CLEAN.replace('X', 'content')} AS content, known FROM (WITH {ITEMS_SQL} SELECT * FROM items)",
)
def _(t):
    rows = items(t).withColumn("title", F.concat(F.lit(" <p>"), "title", F.lit("\x01</p> &amp;")))
    return text.clean_record(rows.select("doc_id", "title", "content", "known"))


@query("record_text", f"WITH {ITEMS_SQL} SELECT doc_id, title || ' ' || content || ' ' || url AS value FROM items")
def _(t):
    return items(t).select("doc_id", text.record_text(["title", "content", "url"]).alias("value"))


@query(
    "record_content_hash",
    f"WITH {ITEMS_SQL} SELECT doc_id, sha256('content=' || content || chr(10) || 'known=' || CASE WHEN known THEN 'True' ELSE 'False' END || chr(10) || 'missing=None' || chr(10) || 'tags=[''' || platform || ''', ''' || lang || ''']' || chr(10) || 'title=' || title) AS content_hash FROM items",
)
def _(t):
    rows = items(t).withColumns({"missing": F.lit(None).cast("string"), "tags": F.array("platform", "lang"), "_skip": F.lit("x")})
    return rows.select("doc_id", hashing.record_hash(rows, ["title", "content", "missing", "known", "tags", "_skip"]).alias("content_hash"))


@query(
    "page_hashes",
    """SELECT page_id, sha256(url || chr(10) || url || chr(10) || html || chr(10)) AS page_hash, sha256(html || chr(10)) AS body_hash,
       sha256(sha256(html) || chr(10) || 'ocr_engine:tesseract') AS variant_hash, sha256(html) AS plain_hash FROM pages""",
)
def _(t):
    html, blank = F.col("html"), F.lit(None).cast("string")
    h = F.sha2(html, 256)
    return t.pages.select(
        "page_id", hashing.page_hash(F.col("url"), F.col("url"), html, blank).alias("page_hash"), hashing.body_hash(html, F.lit("")).alias("body_hash"),
        hashing.variant_hash(h, F.lit("tesseract")).alias("variant_hash"), hashing.variant_hash(h, blank).alias("plain_hash"),
    )


@query("dom_structure_hash", "SELECT page_id, sha256(array_to_string(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1), ' ')) AS dom_hash FROM pages")
def _(t):
    return with_fragment(t.pages).select("page_id", dom.structure_hash("dom").alias("dom_hash"))


@query("injection_flag", f"WITH {ITEMS_SQL} SELECT doc_id, contains(lower(title || ' ' || content), 'ignore previous instructions') OR contains(lower(title || ' ' || content), 'system prompt') OR contains(lower(title || ' ' || content), 'developer message') OR contains(lower(title || ' ' || content), '忽略之前的指令') AS injection_risk FROM items")
def _(t):
    return items(t).select("doc_id", text.has_injection(["title", "content"]).alias("injection_risk"))


_GONE = "trim(regexp_replace(X, '(?i)ignore previous instructions|忽略之前的指令|system prompt|developer message', '', 'g'), ' 。.，,')"


@query(
    "injection_removal",
    f"""WITH {ITEMS_SQL}, f AS (SELECT *, contains(lower(content), 'ignore previous instructions') AS injection_risk FROM items)
    SELECT doc_id, injection_risk, CASE WHEN injection_risk THEN {_GONE.replace('X', 'title')} ELSE title END AS title,
           CASE WHEN injection_risk THEN {_GONE.replace('X', 'content')} ELSE content END AS content,
           CASE WHEN injection_risk THEN {_GONE.replace('X', 'url')} ELSE url END AS url FROM f""",
)
def _(t):
    rows = items(t).select("doc_id", "title", "content", "url")
    return governance.neutralise(rows, ["title", "content", "url"])


@query(
    "field_completeness",
    f"""WITH {ITEMS_SQL} SELECT doc_id, round((CASE WHEN trim(title, {WS}) <> '' THEN 1 ELSE 0 END + CASE WHEN NOT known THEN 1 ELSE 0 END
        + 1) / 4.0, 4) AS field_completeness, 1.0::DOUBLE AS nothing_required FROM items""",
)
def _(t):
    rows = items(t).withColumn("note", F.when(~F.col("known"), "x").otherwise(" \n"))
    return rows.select(
        "doc_id", governance.completeness(rows, ["title", "note", "url", "absent"]).alias("field_completeness"), governance.completeness(rows, []).alias("nothing_required")
    )


_TOKENS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')"


@query(
    "simhash_tokens",
    f"""WITH src AS (SELECT doc_id, '数据集' || source || ' ' || text AS text FROM documents)
    SELECT doc_id, array_to_string(flatten(list_transform({_TOKENS}, lambda s: CASE WHEN regexp_matches(s, '^[\\x{{4e00}}-\\x{{9fff}}]') THEN string_split(s, '') ELSE [s] END)), '|') AS tokens FROM src""",
)
def _(t):
    return t.even("documents").select("doc_id", F.array_join(hashing.simhash_tokens(F.concat(F.lit("数据集"), "source", F.lit(" "), "text")), "|").alias("tokens"))


def simhash_sql(source: str = "documents", text: str = "text") -> str:
    """CTE ``prints(doc_id, fp)`` with the fingerprint of a text expression."""
    return f"""tok AS (SELECT doc_id, unnest({_TOKENS.replace('text', text)}) AS tok FROM {source}),
  cnt AS (SELECT doc_id, tok, count(*) AS c FROM tok GROUP BY ALL),
  hashed AS (SELECT doc_id, c, CAST('0x' || substr(sha256(tok), 49, 16) AS UBIGINT) AS h FROM cnt),
  votes AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1::UBIGINT = 1 THEN c ELSE -c END) AS v FROM hashed, range(0, 64) r(b) GROUP BY ALL),
  prints AS (SELECT d.doc_id, coalesce(sum(CASE WHEN v > 0 THEN 1::UBIGINT << b::UBIGINT ELSE 0 END), 0)::UBIGINT AS fp
             FROM {source} d LEFT JOIN votes USING (doc_id) GROUP BY d.doc_id)"""


SIMHASH_SQL = simhash_sql()


@query("simhash_fingerprint", f"WITH {SIMHASH_SQL} SELECT doc_id, upper(to_hex(fp)) AS simhash FROM prints")
def _(t):
    return t.even("documents").select("doc_id", hashing.simhash64("text").alias("f")).select("doc_id", F.hex("f").alias("simhash"))


@query(
    "text_quality_profile",
    f"""SELECT doc_id, length(text) AS text_length, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {WS}) <> '')) AS non_empty_lines,
        len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) AS chinese_chars, len(regexp_extract_all(text, '[A-Za-z]')) AS ascii_letters,
        len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[^\\sA-Za-z0-9\\x{{4e00}}-\\x{{9fff}}，。；：、（）()《》“”‘’！？,.|/\\\\\\-_%+]')) AS weird_chars,
        round(len(regexp_extract_all(text, '[^\\sA-Za-z0-9\\x{{4e00}}-\\x{{9fff}}，。；：、（）()《》“”‘’！？,.|/\\\\\\-_%+]')) / greatest(length(text), 1), 4) AS weird_char_ratio
        FROM documents""",
)
def _(t):
    return t.even("documents").withColumns(ocr.text_profile("text")).drop("text", "lang", "source", "n_chars")


@query(
    "word_confidence_profile",
    """SELECT l_orderkey, l_linenumber, 3 AS word_count, round((l_quantity + CASE WHEN l_discount > 0 THEN l_discount * 100 ELSE 0 END) / (1 + CASE WHEN l_discount > 0 THEN 1 ELSE 0 END), 2) AS avg_word_conf,
       l_returnflag = 'A' AS table_grid_detected, CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END AS table_cell_rows FROM lineitem""",
)
def _(t):
    conf = lambda c: F.struct(c.cast("double").alias("conf"))
    words = F.array(conf(F.col("l_quantity")), conf(F.when(F.col("l_discount") > 0, F.col("l_discount") * 100).otherwise(-1)), conf(F.lit(-1)))
    grid = F.when(F.col("l_returnflag") == "A", F.array(F.lit(1), F.lit(2), F.lit(3)))
    cells = F.when(F.col("l_linestatus") == "F", F.array(F.array(F.lit("a")), F.array(F.lit("b"))))
    prof = ocr.word_profile("words", "grid", "cells")
    return t.lineitem.select("l_orderkey", "l_linenumber", words.alias("words"), grid.alias("grid"), cells.alias("cells")).select(
        "l_orderkey", "l_linenumber", *[c.alias(n) for n, c in prof.items()]
    )


@query(
    "ocr_quality_verdict",
    f"""SELECT part.p_partkey, CASE WHEN body = '' THEN 'empty' WHEN length(body) < 10 OR (p_size < 2 AND w * w >= 200000) THEN 'success_low_confidence' ELSE 'success' END AS status,
        CASE WHEN body = '' THEN 'empty' WHEN length(body) < 10 OR (p_size < 2 AND w * w >= 200000) THEN 'manual_review_required' ELSE 'usable' END AS quality_status,
        CASE WHEN body = '' THEN 'empty_text' WHEN length(body) < 10 THEN 'text_too_short' WHEN p_size < 2 AND w * w >= 200000 THEN 'large_image_too_few_lines' END AS reason,
        body = '' OR length(body) < 10 OR (p_size < 2 AND w * w >= 200000) AS review
        FROM (SELECT p_partkey, p_size, CASE WHEN p_type = 'PROMO' THEN '' ELSE trim(p_name, {WS}) END AS body, CAST(floor(p_retailprice) AS BIGINT) AS w FROM part) part""",
)
def _(t):
    body = F.when(F.col("p_type") == "PROMO", " ").otherwise(F.col("p_name"))
    side = F.floor("p_retailprice").cast("int")
    v = t.part.select("p_partkey", body.alias("body"), ocr.quality_verdict(body, F.col("p_size"), side, side, min_text_length=10).alias("v"))
    return v.select("p_partkey", "v.status", "v.quality_status", "v.reason", ocr.needs_review(F.col("v.status"), F.col("body"), F.col("v.quality_status")).alias("review"))


@query(
    "ocr_item_fields",
    """SELECT p_partkey, 'tesseract' AS ocr_plugin, 'tesseract' AS ocr_engine, p_type AS ocr_status, p_name AS ocr_text, p_size::DOUBLE AS ocr_elapsed_seconds, false AS ocr_empty,
       p_brand AS ocr_quality_status, p_brand AS ocr_quality_reasons, true AS manual_review_required FROM part""",
)
def _(t):
    r = F.struct(
        F.lit("tesseract").alias("plugin"), F.col("p_type").alias("status"), F.col("p_name").alias("text"), F.lit(None).cast("string").alias("error"),
        F.col("p_size").cast("double").alias("elapsed_seconds"), F.col("p_brand").alias("quality_status"), F.array("p_brand").alias("quality_reasons"),
    )
    out = t.part.select("p_partkey", r.alias("r"))
    fields = ocr.ocr_item_fields(F.col("r"))
    fields["ocr_quality_reasons"] = F.array_join(fields["ocr_quality_reasons"], ",")
    return out.select("p_partkey", *[c.alias(n) for n, c in fields.items() if n != "ocr_error"])


@query("ocr_best_text", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_type WHEN p_size > 25 THEN p_brand ELSE p_name END AS value FROM part")
def _(t):
    a = F.when(F.col("p_type") == "PROMO", F.col("p_type")).otherwise("")
    b = F.when(F.col("p_size") > 25, F.col("p_brand"))
    return t.part.select("p_partkey", ocr.best_text(a, b, F.col("p_name")).alias("value"))


@query(
    "task_state_mapping",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'PARTIAL_SUCCESS' ELSE 'PENDING' END AS ng_status FROM orders""",
)
def _(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", text.task_state(F.when(s == "F", "Failed").when(s == "P", "partial_success").otherwise(s)).alias("ng_status"))


@query("rule_path_normalisation", "SELECT DISTINCT 'rules/' || source || '/' || lang || '.yaml' AS rule_path FROM documents")
def _(t):
    raw = F.concat(F.lit("/srv/engine/rules\\"), "source", F.lit("\\"), "lang", F.lit(".yaml"))
    return t.documents.select(text.normalize_rule_path(F.replace(raw, F.lit("/srv/engine/rules\\"), F.lit("/srv/engine/rules/")), "/srv/engine").alias("rule_path")).distinct()


@query("url_domain", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain, 'docs' AS fallback FROM pages")
def _(t):
    return t.pages.select("page_id", urls.domain_of("url", F.lit("docs")).alias("domain"), urls.domain_of(F.lit("/no/host"), F.lit("docs")).alias("fallback"))


@query(
    "resolve_relative_url",
    """WITH o AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^(https?):', 1) AS scheme, regexp_extract(url, '^(https?://[^/?#]+[^?#]*/)', 1) AS dir, regexp_extract(url, '^([^#]*)', 1) AS plain FROM pages)
    SELECT page_id, origin || '/a/b?x=1' AS rooted, scheme || '://cdn.example.org/i.png' AS other_host, dir || 'c.html' AS sibling, 'https://x.example.org/y' AS absolute, plain || '#part' AS part FROM o""",
)
def _(t):
    j = lambda ref: urls.resolve_url("url", F.lit(ref))
    return t.pages.select("page_id", j("/a/b?x=1").alias("rooted"), j("//cdn.example.org/i.png").alias("other_host"), j("c.html").alias("sibling"),
                          j("https://x.example.org/y").alias("absolute"), j("#part").alias("part"))


@query("decode_redirect_link", "SELECT page_id, url AS target, '/link?type=2' AS no_param, '/link?url=%%%' AS broken FROM pages")
def _(t):
    packed = F.regexp_replace(F.base64(F.col("url").cast("binary")), r"[=\r\n]", "")
    once = F.url_encode(F.concat(packed, F.lit("..")))
    link = F.concat(F.lit("/link?url="), F.url_encode(once), F.lit("&amp;type=2"))
    return t.pages.select("page_id", urls.transform_url(link, "sogou_link").alias("target"), urls.transform_url(F.lit("/link?type=2"), "sogou_link").alias("no_param"),
                          urls.transform_url(F.lit("/link?url=%%%"), "sogou_link").alias("broken"))


@query(
    "cell_text_functions",
    """SELECT p_partkey, p_name AS clean, p_name || '\\|' || p_brand AS cell, regexp_extract(p_brand, '[0-9]+', 0) AS first_id, p_name AS no_id, false AS name_is_id, true AS key_is_id FROM part""",
)
def _(t):
    messy = F.concat(F.lit(" \n"), F.replace("p_name", F.lit(" "), F.lit("\t \n")), F.lit(" "))
    return t.part.select(
        "p_partkey", text.cell_text(messy).alias("clean"), text.markdown_cell(F.concat("p_name", F.lit("|"), "p_brand")).alias("cell"), text.first_integer("p_brand").alias("first_id"),
        text.first_integer(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("no_id"), text.is_integer_text("p_name").alias("name_is_id"),
        text.is_integer_text(F.concat(F.col("p_partkey").cast("string"), F.lit(" "))).alias("key_is_id"),
    )


@query("run_duration_and_error", f"WITH {RUNS_SQL} SELECT run_id, 3600.0::DOUBLE AS state_seconds, 3600.0::DOUBLE AS event_seconds, left(repeat(error, 30), 200) AS short_error, left(repeat(error, 60), 500) AS long_error FROM runs")
def _(t):
    r = runs(t)
    return r.select("run_id", text.duration_seconds("started_at", "finished_at", 1).alias("state_seconds"), text.duration_seconds("started_at", "finished_at", 2).alias("event_seconds"),
                    F.substring(F.repeat("error", 30), 1, 200).alias("short_error"), F.substring(F.repeat("error", 60), 1, 500).alias("long_error"))


@query(
    "run_status_derivation",
    f"""WITH {RUNS_SQL} SELECT run_id, CASE WHEN rule_name = '5-LOW' THEN 'skipped' WHEN error <> '' THEN 'failed' WHEN status = 'partial_success' THEN 'partial_success' ELSE 'success' END AS run_status FROM runs""",
)
def _(t):
    gov = F.when(F.col("status") == "partial_success", "PARTIAL_SUCCESS").otherwise("SUCCESS")
    return runs(t).select("run_id", text.run_status(F.col("rule_name") != "5-LOW", F.col("error"), gov).alias("run_status"))


@query(
    "json_safe_rows",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_totalprice AS DECIMAL(12,2))::DOUBLE AS price,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS nested FROM orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").alias("at"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
                           F.struct(F.array("o_orderdate").alias("xs")).alias("nested"))
    return text.json_safe(rows).withColumn("nested", F.col("nested.xs")[0])
