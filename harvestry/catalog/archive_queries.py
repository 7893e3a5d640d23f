"""Archive pages, their blocks and assets, storage tables and reports."""

from pyspark.sql import functions as F

from ..functions.text import exploded, strip
from ..operators import archive, dom, lists, runs as run_ops
from ..plans import archiving, reports
from ..sources import writers
from ..sources.html_nodes import with_fragment
from . import query
from .fixtures import WS
from .markup_queries import LI_SQL, _decoded, with_images

# A customer as a page with four blocks and three assets: a heading, an image
# named by its block, an image named by its URL, and OCR text of each.
def _page(t):
    key = F.col("c_custkey").cast("string")
    b, a = archive.make_block, archive.make_asset
    blocks = F.array(
        b(block_type=F.lit("heading"), text=F.col("c_name")),
        b(id=F.lit("i1"), block_type=F.lit("image"), storage_uri=F.concat(F.lit("/img/"), key, F.lit(".png"))),
        b(id=F.lit("i2"), block_type=F.lit("image"), block_order=F.lit(9), source_url=F.concat(F.lit("https://img.example.org/"), key)),
        b(id=F.lit("o1"), block_type=F.lit("ocr"), parent_block_id=F.lit("i2"), ocr_text=F.col("c_mktsegment"), engine=F.lit("tess")),
        b(id=F.lit("o2"), block_type=F.lit("paragraph"), text=F.lit("x"), ocr_text=F.when(F.col("c_acctbal") > 0, F.col("c_name")), source_url=F.concat(F.lit("https://img.example.org/"), key)),
    )
    assets = F.array(
        a(id=F.lit("old"), source_url=F.concat(F.lit("https://img.example.org/"), key)),
        a(source_url=F.concat(F.lit("https://img.example.org/"), key), storage_uri=F.lit("/a/b.c/pic.JPG")),
        a(id=F.lit("third"), storage_uri=F.concat(F.lit("/img/"), key, F.lit(".png"))),
    )
    return t.dealt("customer").select(
        F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://c.example.org:8080/"), key).alias("source_url"), F.lit("crm").alias("platform"),
        F.col("c_mktsegment").alias("subject"), F.col("c_name").alias("title"), F.concat(F.lit("<p>"), "c_name", F.lit("</p>")).alias("html"), blocks.alias("blocks"), assets.alias("assets"),
    )


BLOCKS = "VALUES (1, 'block-1', 'heading', 1), (2, 'i1', 'image', 2), (3, 'i2', 'image', 9), (4, 'o1', 'ocr', 4), (5, 'o2', 'paragraph', 5)"


@query("block_defaults", f"SELECT c_custkey AS page_id, id, block_type, block_order FROM customer, ({BLOCKS}) b(n, id, block_type, block_order)")
def _(t):
    rows = exploded(_page(t), ["page_id"], archive.normalize_blocks(F.col("blocks")), "b")
    return rows.select("page_id", "b.id", "b.block_type", "b.block_order")


@query("asset_defaults", "SELECT c_custkey AS page_id, id FROM customer, (VALUES ('old'), ('asset-2'), ('third')) a(id)")
def _(t):
    return exploded(_page(t), ["page_id"], archive.normalize_assets(F.col("assets")), "a").select("page_id", "a.id")


@query(
    "asset_links",
    """SELECT c_custkey AS page_id, id, CASE WHEN id = 'o2' AND c_acctbal <= 0 THEN NULL ELSE asset_id END AS asset_id
       FROM customer, (VALUES ('block-1', NULL), ('i1', 'third'), ('i2', 'asset-2'), ('o1', 'asset-2'), ('o2', 'asset-2')) b(id, asset_id)""",
)
def _(t):
    pages = archive.build_pages(_page(t))
    return exploded(pages, ["page_id"], "blocks", "b").select("page_id", "b.id", "b.asset_id")


@query("asset_claims", "SELECT c_custkey AS page_id, id, block_id FROM customer, (VALUES ('old', NULL), ('asset-2', 'i2'), ('third', 'i1')) a(id, block_id)")
def _(t):
    pages = archive.build_pages(_page(t))
    return exploded(pages, ["page_id"], "assets", "a").select("page_id", "a.id", "a.block_id")


@query(
    "ocr_result_rows",
    """SELECT c_custkey AS page_id, 'o1' AS block_id, 'i2' AS parent_block_id, 'tess' AS engine, 'success' AS status, c_mktsegment AS ocr_text, '{}' AS structured_data, false AS manual_review_required FROM customer
       UNION ALL SELECT c_custkey, 'o2', NULL, NULL, 'success', c_name, '{}', false FROM customer WHERE c_acctbal > 0""",
)
def _(t):
    rows = exploded(archive.build_pages(_page(t)), ["page_id"], "ocr_results", "o")
    return rows.select("page_id", *[f"o.{c}" for c in ("block_id", "parent_block_id", "engine", "status", "ocr_text", "structured_data", "manual_review_required")])


@query(
    "archive_page_assembly",
    """SELECT c_custkey AS page_id, 'https://c.example.org:8080/' || c_custkey AS final_url, 'c.example.org:8080' AS domain, sha256('https://c.example.org:8080/' || c_custkey || chr(10) || chr(10) || '<p>' || c_name || '</p>' || chr(10)) AS content_hash,
       true AS contains_ocr, false AS contains_table, true AS requires_structuring, 5 AS block_count, 1 AS ocr_block_count, 2 AS image_block_count FROM customer""",
)
def _(t):
    pages = archive.build_pages(_page(t))
    return pages.select("page_id", *[f"meta.{c}" for c in ("final_url", "domain", "content_hash", "contains_ocr", "contains_table", "requires_structuring")], *[c.alias(n) for n, c in archive.page_counters(F.col("blocks")).items()])


@query(
    "page_texts",
    "SELECT c_custkey AS page_id, c_name || chr(10) || chr(10) || 'x' AS body_text, c_mktsegment || CASE WHEN c_acctbal > 0 THEN chr(10) || chr(10) || c_name ELSE '' END AS ocr_text FROM customer",
)
def _(t):
    pages = archive.build_pages(_page(t))
    return pages.select("page_id", *[c.alias(n) for n, c in archive.page_text(F.col("blocks"), F.col("ocr_results")).items()])


@query(
    "storage_table_ids",
    """WITH p AS (SELECT *, sha256(sha256('https://c.example.org:8080/' || c_custkey || chr(10) || chr(10) || '<p>' || c_name || '</p>' || chr(10))) AS id FROM customer)
    SELECT sha256(id || '|' || local_id) AS id, id AS page_id, local_id, CASE WHEN local_id = 'o1' THEN sha256(id || '|i2') END AS parent_block_id, CASE local_id WHEN 'block-1' THEN c_name WHEN 'o2' THEN 'x' ELSE '' END AS text
    FROM p, (VALUES ('block-1'), ('i1'), ('i2'), ('o1'), ('o2')) b(local_id)""",
)
def _(t):
    return archive.storage_tables(archive.build_pages(_page(t)))["archive_blocks"].select("id", "page_id", "local_id", "parent_block_id", "text")


@query(
    "storage_asset_rows",
    """WITH p AS (SELECT *, sha256(sha256('https://c.example.org:8080/' || c_custkey || chr(10) || chr(10) || '<p>' || c_name || '</p>' || chr(10))) AS id FROM customer)
    SELECT sha256(id || '|asset:' || a) AS id, CASE a WHEN 'asset-2' THEN sha256(id || '|i2') WHEN 'third' THEN sha256(id || '|i1') END AS block_id,
      CASE a WHEN 'asset-2' THEN 'pic.JPG' WHEN 'third' THEN c_custkey || '.png' END AS file_name, CASE a WHEN 'asset-2' THEN 'JPG' WHEN 'third' THEN 'png' END AS extension, false AS downloaded
    FROM p, (VALUES ('old'), ('asset-2'), ('third')) x(a)""",
)
def _(t):
    return archive.storage_tables(archive.build_pages(_page(t)))["archive_assets"].select("id", "block_id", "file_name", "extension", "downloaded")


@query(
    "storage_ocr_and_page_rows",
    """WITH p AS (SELECT *, sha256(sha256('https://c.example.org:8080/' || c_custkey || chr(10) || chr(10) || '<p>' || c_name || '</p>' || chr(10))) AS id FROM customer)
    SELECT id AS page_id, 'success' AS archive_status, 1 + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS ocr_rows, sha256(id || '|asset:asset-2') AS asset_id FROM p""",
)
def _(t):
    tabs = archive.storage_tables(archive.build_pages(_page(t)))
    ocr = tabs["ocr_results"].groupBy("page_id").agg(F.count(F.lit(1)).alias("ocr_rows"), F.max("asset_id").alias("asset_id"))
    return tabs["archive_pages"].select(F.col("id").alias("page_id"), "archive_status").join(ocr, "page_id")


@query(
    "archive_text_lookup",
    "SELECT c_custkey AS id, c_name || chr(10) || chr(10) || 'x' AS body_text, c_mktsegment || CASE WHEN c_acctbal > 0 THEN chr(10) || chr(10) || c_name ELSE '' END AS ocr_text, 2 AS text_blocks FROM customer",
)
def _(t):
    pages = archive.build_pages(_page(t))
    blocks = exploded(pages, ["page_id"], "blocks", "b").select("page_id", "b.block_order", "b.block_type", "b.text")
    ocr = exploded(pages, ["page_id"], "ocr_results", "o", "ocr_no").select("page_id", "ocr_no", "o.ocr_text")
    return run_ops.archive_texts(t.customer.select(F.col("c_custkey").alias("id")), blocks, ocr).select("id", "body_text", "ocr_text", "text_blocks")


@query(
    "archive_point_lookup",
    "SELECT title, 5 AS block_count, 3 AS asset_count, 0 AS record_count FROM (SELECT c_name AS title FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer) AND c_mktsegment IN (SELECT c_mktsegment FROM customer))",
)
def _(t):
    tabs = archive.storage_tables(archive.build_pages(_page(t)))
    scopes = t.customer.select(F.col("c_mktsegment").alias("subject"), F.lit("crm").alias("platform"))
    last = t.customer.agg(F.max("c_custkey").alias("k"), F.max_by("c_name", "c_custkey").alias("n")).first()
    url = F.concat(F.lit("https://c.example.org:8080/"), F.lit(str(last.k)))
    wanted = F.sha2(F.concat_ws("\n", url, F.lit(""), F.concat(F.lit("<p>"), F.lit(last.n), F.lit("</p>")), F.lit("")), 256)
    none = tabs["archive_blocks"].select("page_id").limit(0)
    return run_ops.archive_by_hash(tabs["archive_pages"], scopes, wanted, tabs["archive_blocks"], tabs["archive_assets"], none).select("title", "block_count", "asset_count", "record_count")


@query("block_type_histogram", "SELECT c_custkey AS page_id, 1 AS heading, 2 AS image, 1 AS ocr, 1 AS paragraph FROM customer")
def _(t):
    rows = _page(t).select("page_id", F.explode("blocks.block_type").alias("kind"))
    return rows.groupBy("page_id").pivot("kind", ["heading", "image", "ocr", "paragraph"]).count()


@query("block_histogram", f"SELECT c_custkey AS page_id, block_type, count(*)::INTEGER AS blocks FROM customer, ({BLOCKS}) b(n, id, block_type, block_order) WHERE n <= c_custkey % 6 GROUP BY ALL")
def _(t):
    # Pages of none to five blocks.
    rows = _page(t).withColumn("blocks", F.slice("blocks", 1, (F.col("page_id") % 6).cast("int")))
    return rows.select("page_id", F.explode(archive.block_histogram(F.col("blocks"))).alias("block_type", "blocks"))


@query("block_type_filter", "SELECT c_custkey AS page_id, id FROM customer, (VALUES ('i1'), ('i2'), ('o1')) b(id)")
def _(t):
    rows = _page(t).select("page_id", F.explode("blocks").alias("b")).select("page_id", "b.id", "b.block_type")
    return lists.filter_blocks(rows, ["image", "ocr"]).select("page_id", "id")


@query(
    "debug_packages",
    "SELECT 'crm' AS platform, c_mktsegment AS subject, 5 AS blocks FROM customer",
)
def _(t):
    return writers.package_rows(archive.build_pages(_page(t))).select("platform", "subject", F.size("blocks").alias("blocks"))


# --- discovery and archive runs --------------------------------------------

RULE = {
    "name": "docs", "subject": "web", "source": {"platform": "docs", "url": "https://docs.example.org/"},
    "discovery": {"enabled": True, "list": {"items_path": "css:nav li", "title": {"selector": "a"}, "detail_url": {"selector": "a"}}, "filters": {"title_keywords": ["th", "en"]}},
    "archive": {"enabled": True, "detail": {"metadata": {"content": {"selector": "article"}}}},
}

CAND_SQL = f"""{LI_SQL}, f AS (SELECT page_id AS page_no, pos, trim(regexp_replace(body, '<[^>]+>', '', 'g'), {WS}) AS title, 'https://docs.example.org' || regexp_extract(body, 'href="([^"]*)"', 1) AS detail_url FROM li),
  k AS (SELECT *, row_number() OVER (PARTITION BY detail_url ORDER BY page_no, pos) AS rn FROM f WHERE contains(title, 'th') OR contains(title, 'en'))"""


def _list_pages(t):
    return t.pages.select(F.col("page_id").alias("page_no"), "html")


@query("detail_candidates", f"WITH {CAND_SQL} SELECT page_no, pos, title, detail_url FROM k WHERE rn = 1")
def _(t):
    return archiving.discover_candidates(_list_pages(t), RULE)


@query("detail_candidates_limited", f"WITH {CAND_SQL} SELECT page_no, pos, title, detail_url FROM k WHERE rn = 1 ORDER BY page_no, pos LIMIT 25")
def _(t):
    return archiving.discover_candidates(_list_pages(t), RULE | {"discovery": RULE["discovery"] | {"max_details": 25}})


@query("first_candidate", f"WITH {CAND_SQL} SELECT title, detail_url FROM k WHERE rn = 1 ORDER BY page_no, pos LIMIT 1")
def _(t):
    return archiving.discover_candidates(_list_pages(t), RULE | {"discovery": RULE["discovery"] | {"max_details": 1}}).select("title", "detail_url")


# Each page is captured under the address of its own first link.
@query(
    "archive_run",
    f"""WITH {CAND_SQL}, own AS (SELECT 'https://docs.example.org' || regexp_extract(html, '<a href="([^"]*)"', 1) AS url, arg_min(html, page_id) AS html FROM pages GROUP BY 1)
    SELECT url AS source_url, trim({_decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}, {WS}) AS title, sha256(url || chr(10) || url || chr(10) || html || chr(10)) AS content_hash, 'web' AS subject,
      len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>')) + 1 AS blocks FROM own JOIN k ON k.detail_url = own.url AND k.rn = 1""",
)
def _(t):
    own = F.concat(F.lit("https://docs.example.org"), F.regexp_extract("html", '<a href="([^"]*)"', 1))
    captured = t.pages.groupBy(own.alias("url")).agg(F.min_by("html", "page_id").alias("html"))
    pages, _records = archiving.archive_run(_list_pages(t), captured, RULE)
    return pages.select("meta.source_url", "meta.title", "meta.content_hash", "meta.subject", F.size("blocks").alias("blocks"))


@query(
    "archive_single_pages",
    f"""SELECT url AS source_url, trim({_decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}, {WS}) AS title, sha256(url || chr(10) || url || chr(10) || html || chr(10)) AS content_hash FROM pages""",
)
def _(t):
    titles = t.pages.select("page_id", "url", F.lit("first item").alias("title"))
    pages, _records = archiving.archive_single(t.pages, RULE, titles)
    return pages.select("meta.source_url", "meta.title", "meta.content_hash")


@query("archive_title_fallback", "SELECT url AS source_url, 'first item of ' || page_id AS title FROM pages")
def _(t):
    bare = t.pages.withColumn("html", F.replace(F.replace("html", F.lit("<h1>"), F.lit("<h2>")), F.lit("</h1>"), F.lit("</h2>")))
    titles = t.pages.select("page_id", "url", F.concat(F.lit("first item of "), F.col("page_id").cast("string")).alias("title"))
    return archiving.archive_single(bare, RULE, titles)[0].select("meta.source_url", "meta.title")


IMAGE_RULE = RULE | {
    "archive": RULE["archive"] | {"image_ocr": {"enabled": True, "images": {"max_images": 3}, "ocr": {"plugin": "tess"}}},
    "structuring": {"enabled": True, "strategies": [{"applies_to": {"keywords": ["No"]}, "record_type": "row"}]},
}


def _page_ocr(t):
    """Recognised text of every image address of the pages."""
    images = archive.discover_images(with_images(t), ["page_id"], {"max_images": 3})
    address = F.col("source_img_url")
    text = F.concat(F.lit("head\nNo Name\n1 "), F.regexp_extract(address, r"([^/]*)\z", 1))
    null = F.lit(None).cast("string")
    return images.select("source_img_url").distinct().select(
        "source_img_url", F.concat(F.lit("/store/"), F.sha1(address), F.lit(".png")).alias("storage_uri"), text.alias("ocr_text"), F.lit("success").alias("status"), null.alias("error"),
        F.lit(0.5).alias("elapsed_seconds"), null.alias("structured_data"), F.lit(False).alias("manual_review_required"), F.lit(10).cast("bigint").alias("size_bytes"), F.sha2(address, 256).alias("content_hash"),
    )


IMG_SQL = f"""{LI_SQL}, i AS (SELECT p.page_id, p.url, li.pos, trim(regexp_extract(body, 'href="([^"]*)"', 1), {WS}) AS src,
  regexp_extract(p.url, '^(https?://[^/?#]+)', 1) || trim(regexp_extract(body, 'href="([^"]*)"', 1), {WS}) AS addr FROM li JOIN pages p USING (page_id) WHERE pos < 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n, len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>')) + 1 AS last FROM i JOIN (SELECT page_id, html FROM pages) USING (page_id) WHERE src <> '')"""


@query("archive_image_blocks", f"WITH {IMG_SQL} SELECT url, 'b' || (last + 1 + n * 2) AS image_id, addr AS source_url, 'b' || (last + 2 + n * 2) AS ocr_id, 'No Name' || chr(10) || '1 ' || regexp_extract(src, '([^/]*)$', 1) AS ocr_tail FROM r")
def _(t):
    pages, _records = archiving.archive_single(with_images(t), IMAGE_RULE, ocr=_page_ocr(t))
    image = F.transform(F.filter("blocks", lambda b: b["block_type"] == "image"), lambda b: F.struct(b["id"].alias("image_id"), b["source_url"].alias("source_url")))
    text = F.transform(F.filter("blocks", lambda b: b["block_type"] == "ocr"), lambda b: F.struct(b["id"].alias("ocr_id"), F.substring(b["ocr_text"], 6, 1 << 20).alias("ocr_tail")))
    return pages.select(F.col("meta.source_url").alias("url"), F.explode(F.arrays_zip(image.alias("i"), text.alias("o"))).alias("z")).select("url", "z.i.*", "z.o.*")


@query("archive_structured_records", f"WITH {IMG_SQL} SELECT count(*) AS records, count(DISTINCT url) AS pages, sum(length(regexp_extract(src, '([^/]*)$', 1)))::BIGINT AS chars FROM r")
def _(t):
    # An address that was captured twice is one page here.
    pages, _records = archiving.archive_single(with_images(t), IMAGE_RULE, ocr=_page_ocr(t))
    records = archiving.page_records(pages, IMAGE_RULE, ("content_hash", "source_url"))
    return records.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source_url").alias("pages"), F.sum(F.length(F.col("data")["Name"])).alias("chars"))


# --- paging ----------------------------------------------------------------


@query(
    "next_page_chain",
    """SELECT 'u' || o.o_custkey AS start_url, 'u' || (o.o_custkey + k) AS url, k + 1 AS page_no FROM (SELECT DISTINCT o_custkey FROM orders) o, range(0, 4) r(k)
       WHERE (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) x WHERE x.o_custkey > o.o_custkey AND x.o_custkey <= o.o_custkey + k) = k""",
)
def _(t):
    keys = t.orders.select("o_custkey").distinct()
    url = lambda n: F.concat(F.lit("u"), (F.col("o_custkey") + n).cast("string"))
    links = keys.select(url(0).alias("url"), url(1).alias("next_url"))
    return lists.next_page_chain(links, links.select("url"), 4)


@query(
    "list_page_chain",
    """WITH p AS (SELECT page_id FROM pages) SELECT 'https://docs.example.org/p' || a.page_id AS start_url, k + 1 AS page_no, 'https://docs.example.org/p' || (a.page_id + k) AS url
       FROM p a, range(0, 3) r(k) WHERE a.page_id + k IN (SELECT page_id FROM p)""",
)
def _(t):
    number = F.col("page_id").cast("string")
    html = F.concat("html", F.lit('<a class="next-page" href="/p'), (F.col("page_id") + 1).cast("string"), F.lit('">next</a>'))
    pages = t.pages.select(F.concat(F.lit("https://docs.example.org/p"), number).alias("url"), html.alias("html"))
    rule = {"source": {"url": "https://docs.example.org/p0"}, "discovery": {"pagination": {"enabled": True, "max_pages": 3, "next_page": {"selector": "a.next-page"}}}}
    return archiving.list_page_chain(pages, pages.select("url"), rule).select("start_url", "page_no", "url")


@query(
    "pages_until_empty",
    """WITH p AS (SELECT l_orderkey, l_linenumber, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS stop, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn
       FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) WHERE l_linenumber <= 5),
    g AS (SELECT *, min(CASE WHEN l_linenumber > rn THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS cut FROM p)
    SELECT l_orderkey, l_linenumber AS page_no FROM g WHERE l_linenumber < coalesce(stop, 6) AND l_linenumber < coalesce(cut, 6)""",
)
def _(t):
    pages = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("page_no")).agg(F.when(F.min("l_returnflag") == "R", 0).otherwise(1).alias("item_count"))
    return lists.stop_at_empty(pages, ["l_orderkey"], 5).select("l_orderkey", "page_no")


# --- health ----------------------------------------------------------------

HEALTH_RULE = {
    "list": {"items_path": "css:nav li"}, "extract": {"ad": {"selector": "div.ad"}, "gone": {"selector": "table td"}},
    "discovery": {"list": {"title": {"selector": "h1"}, "detail_url": {"selector": "bad::part"}}},
}


@query(
    "selector_health",
    f"""SELECT page_id, 5 AS total_selectors, (CASE WHEN contains(html, '<li>') THEN 1 ELSE 0 END) + (CASE WHEN contains(html, '<div class="ad">') THEN 1 ELSE 0 END) + 1 AS working_selectors,
       round(((CASE WHEN contains(html, '<li>') THEN 1 ELSE 0 END) + (CASE WHEN contains(html, '<div class="ad">') THEN 1 ELSE 0 END) + 1) / 5.0, 4) AS health_score,
       len(regexp_extract_all(html, '<li>')) AS list_hits, trim(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), {WS}) AS ad_sample,
       sha256(array_to_string(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1), ' ')) AS dom_structure_hash FROM pages""",
)
def _(t):
    out = reports.selector_report(t.pages, HEALTH_RULE, ["page_id"])
    return out.withColumns({"list_hits": F.get("selectors", F.lit(0))["hits"], "ad_sample": F.array_join(F.get("selectors", F.lit(1))["sample"], "")}).drop("selectors")


@query(
    "dom_drift",
    """SELECT 'rules/' || page_id AS rule_path, CASE WHEN contains(html, '<b>') THEN true ELSE false END AS dom_drifted FROM pages
       UNION ALL SELECT 'new/' || page_id, false FROM pages""",
)
def _(t):
    path = F.concat(F.lit("rules/"), F.col("page_id").cast("string")).alias("rule_path")
    old = t.pages.select(path, F.replace(F.replace("html", F.lit("<b>"), F.lit("")), F.lit("</b>"), F.lit("")).alias("html"))
    base = reports.selector_report(old, {}, ["rule_path"]).select("rule_path", F.col("dom_structure_hash").alias("dom_hash"))
    now = t.pages.select(path, "html").unionByName(t.pages.select(F.concat(F.lit("new/"), F.col("page_id").cast("string")).alias("rule_path"), "html"))
    return reports.health_report(now, HEALTH_RULE, base, ["rule_path"]).select("rule_path", "dom_drifted")
