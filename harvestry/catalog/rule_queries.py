"""Many rules as one plan over the pages."""

from pyspark.sql import functions as F

from ..operators import runs
from ..plans import rules
from . import query
from .markup_queries import LI_SQL

#: Rules that have nothing in common: selectors, fields, ids, modes and limits.
RULES = [
    {"rule_id": "links", "source": {"platform": "nav"}, "list": {"items_path": "css:nav li"}, "dedup": {"url_to_id_pattern": r"/(\w+)$"},
     "extract": {"title": {"selector": "a"}, "url": {"type": "attribute", "selector": "a", "attribute": "href"}}, "governance": {"dedup": "hash", "required_fields": ["title", "url", "raw_id"], "min_completeness": 1.0}},
    {"rule_id": "ads", "source": {"platform": "ad"}, "list": {"items_path": "xpath://div[@class='ad']"}, "extract": {"body": {}, "title": {"selector": "p"}}, "governance": {"dedup": "", "required_fields": ["title", "body"], "min_completeness": 0.5}},
    {"rule_id": "heads", "source": {"platform": "head"}, "list": {"items_path": "css:body > nav"},
     "extract": {"title": {"selector": "li:first-child", "transform": "trim"}, "links": {"type": "list", "selector": "a::attr(href)"}}, "governance": {"dedup": "simhash", "simhash_threshold": 0, "required_fields": ["title"]}},
    {"rule_id": "off", "enabled": False, "list": {"items_path": "css:p"}, "extract": {"title": {}}},
    {"rule_id": "broken", "list": {"items_path": "css:p:hover"}, "extract": {"title": {}}},
    {"rule_id": "links", "list": {"items_path": "css:p"}, "extract": {"title": {}}},
]

_SQL = f"""WITH {LI_SQL},
    l AS (SELECT DISTINCT trim(regexp_replace(body, '<[^>]+>', '', 'g')) AS title, trim(regexp_extract(body, 'href="([^"]*)"', 1)) AS url FROM li),
    lk AS (SELECT title, url, nullif(regexp_extract(url, '/([a-zA-Z0-9_]+)$', 1), '') AS raw_id FROM l),
    hd AS (SELECT DISTINCT trim(regexp_replace(body, '<[^>]+>', '', 'g')) AS t FROM li WHERE pos = 0)"""
_FULL = "round((CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN url <> '' THEN 1 ELSE 0 END + CASE WHEN raw_id IS NOT NULL THEN 1 ELSE 0 END) / 3.0, 4)"


@query(
    "run_rules",
    f"""{_SQL} SELECT 'links' AS run_id, (SELECT count(*) FROM li) AS total_collected, count(*) AS saved_count, CASE WHEN round(avg({_FULL}), 4) >= 1 THEN 'success' ELSE 'partial_success' END AS status, '' AS error FROM lk
    UNION ALL SELECT 'ads', count(*), count(*), 'success', '' FROM pages
    UNION ALL SELECT 'heads', (SELECT count(*) FROM pages), count(*), 'success', '' FROM hd
    UNION ALL SELECT 'off', 0, 0, 'skipped', '' UNION ALL SELECT 'broken', 0, 0, 'failed', 'unsupported selector: ' || chr(39) || 'p:hover' || chr(39)
    UNION ALL SELECT 'links (6)', 0, 0, 'failed', 'the name ' || chr(39) || 'links' || chr(39) || ' is taken'""",
)
def _(t):
    _, rows = rules.run_rules(t.pages, RULES)
    return rows.select("run_id", "total_collected", "saved_count", "status", "error")


@query(
    "run_rules_items",
    f"""{_SQL} SELECT 'links' AS run_id, 'nav' AS platform, title, NULL::VARCHAR AS body, raw_id, {_FULL} AS field_completeness FROM lk
    UNION ALL SELECT 'ads', 'ad', '', trim(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)), NULL, 0.5 FROM pages""",
)
def _(t):
    outcome, _ = rules.run_rules(t.pages, RULES[:2])
    return outcome.governed.select("run_id", "platform", "title", "body", "raw_id", "field_completeness")


@query(
    "run_rules_of_own_pages",
    f"""WITH {LI_SQL} SELECT CASE WHEN page_id % 2 = 0 THEN 'links' ELSE 'titles' END AS run_id, item_stage, count(*) AS n FROM (
        SELECT page_id, 'raw' AS item_stage FROM li WHERE page_id % 2 = 0 UNION ALL SELECT page_id, CASE WHEN regexp_extract(body, 'href="/([^"]*)"', 1) = 'the' THEN 'filtered' ELSE 'deduped' END FROM li WHERE page_id % 2 = 0
        UNION ALL SELECT page_id, unnest(['raw', 'deduped']) FROM pages WHERE page_id % 2 = 1) GROUP BY 1, 2""",
)
def _(t):
    own = [RULES[0] | {"governance": {}}, {"rule_id": "titles", "list": {"items_path": "css:title"}, "extract": {"title": {}}}]
    pages = t.pages.withColumn("run_id", F.when(F.col("page_id") % 2 == 0, "links").otherwise("titles"))
    registry = t.region.limit(1).select(F.lit("nav_the").alias("id"))
    outcome, _ = rules.run_rules(pages, own, registry)
    return runs.stage_union(outcome.raw, outcome.governed, outcome.filtered, outcome.fields).groupBy("run_id", "item_stage").agg(F.count(F.lit(1)).alias("n"))
