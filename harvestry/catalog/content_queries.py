"""Classes of contents and degrees of structure drift."""

from pyspark.sql import functions as F

from ..operators import classify, drift, trend
from ..session import scratch_folder
from ..sources import line_files
from ..sources.html_nodes import with_fragment
from . import query
from .stream_queries import _in_cuts, _to_table

RULES = [
    ("spam", "url", "spam-farm"), ("spam", "url", "casino"), ("spam", "keyword", "FREE"), ("de", "keyword", " und "), ("de", "keyword", " nicht "), ("fr", "keyword", " les "), ("es", "keyword", " una "),
    ("secure", "url", "^https://"), ("index", "url", "/$"), ("tracked", "url", "utm_"),
]


@query(
    "content_classes",
    """WITH r(label, kind, pattern) AS (VALUES ('spam', 'url', 'spam-farm'), ('spam', 'url', 'casino'), ('spam', 'keyword', 'free'), ('de', 'keyword', ' und '), ('de', 'keyword', ' nicht '), ('fr', 'keyword', ' les '), ('es', 'keyword', ' una '), ('tracked', 'url', 'utm_'))
    SELECT DISTINCT page_id, label FROM pages, r WHERE contains(lower(CASE WHEN kind = 'url' THEN url ELSE html END), pattern)
    UNION SELECT page_id, 'secure' FROM pages WHERE starts_with(lower(url), 'https://') UNION SELECT page_id, 'index' FROM pages WHERE ends_with(url, '/')""",
)
def _(t):
    rules = t.spark.createDataFrame(RULES, "label string, kind string, pattern string")
    found = classify.classify(t.pages.select("page_id", "url", "html"), rules, "html", "url")
    return found.select("page_id", F.explode("classes").alias("c")).select("page_id", "c.label")


@query(
    "content_words",
    """WITH w AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS k FROM part UNION SELECT 'the' UNION SELECT 'ou' UNION SELECT lower(substr(text, 1, 5)) FROM benchmark WHERE length(text) > 4),
    h AS (SELECT doc_id, k, (length(text) - length(replace(lower(text), k, ''))) // length(k) AS hits FROM documents, w WHERE contains(lower(text), k) AND k IN ('the', 'ou'))
    SELECT doc_id, k AS label, hits::BIGINT AS hits FROM h""",
)
def _(t):
    # A rule table made of the data: many patterns that cost nothing more.
    first = t.part.select(F.lower(F.split("p_name", " ")[0]).alias("pattern")).union(t.benchmark.filter(F.length("text") > 4).select(F.lower(F.substring("text", 1, 5))))
    rules = first.union(t.region.limit(1).select(F.explode(F.array(F.lit("the"), F.lit("ou"))))).distinct().select(F.col("pattern").alias("label"), F.lit("keyword").alias("kind"), "pattern")
    found = classify.classify(t.documents.select("doc_id", "text"), rules)
    return found.select("doc_id", F.explode("classes").alias("c")).filter(F.col("c.label").isin("the", "ou")).select("doc_id", "c.label", "c.hits")


@query(
    "drift_degrees",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'changed' ELSE 'unknown' END AS kind FROM pages""",
)
def _(t):
    # Baselines: the page as it is, with another tag around its text, or none.
    kind = F.when(F.col("page_id") % 3 == 0, "same").when(F.col("page_id") % 3 == 1, "changed").otherwise("unknown")
    older = F.when(F.col("page_id") % 3 == 1, F.replace(F.replace("html", F.lit("<article>"), F.lit("<section>")), F.lit("</article>"), F.lit("</section>"))).otherwise(F.col("html"))
    base = with_fragment(t.pages.filter(F.col("page_id") % 3 != 2).select("page_id", older.alias("html"))).select("page_id", drift.profile("dom").alias("profile"))
    found = drift.drift_degrees(t.pages, base, ["page_id"])
    degree = F.col("drift_degree")
    return found.select("page_id", F.when(degree.isNull(), "unknown").when(degree == 0, "same").when((degree > 0) & (degree < 1), "changed").alias("kind"))


# Items of the event table: a field that errors lack, one that hardly any lacks.
def _timed(events):
    title = F.when(F.col("event_type").isin("error", "view") & (F.dayofmonth("ts") > 15) | (F.col("event_type") == "error"), F.lit(" ")).otherwise(F.col("event_type"))
    return events.select("ts", F.concat(F.lit("u"), F.col("user_id") % 7).alias("platform"), title.alias("title"), F.when(F.col("value") > 1, F.col("props")).alias("props"))


_RATES = """items AS (SELECT 'u' || user_id % 7 AS source, date_trunc('day', ts) AS start, ts, (event_type IN ('error', 'view') AND day(ts) > 15) OR event_type = 'error' AS no_title, NOT coalesce(value > 1, false) AS no_props FROM events),
    lacks AS (SELECT source, start, 'title' AS field, no_title AS lacks FROM items UNION ALL SELECT source, start, 'props', no_props FROM items),
    rates AS (SELECT source, field, start, count(*) AS items, count(*) FILTER (lacks) AS missing, count(*) FILTER (lacks) * 1000000 // count(*) AS rate FROM lacks GROUP BY ALL)"""


@query(
    "missing_rate_alerts",
    f"""WITH {_RATES}, e AS (SELECT *, coalesce(sum(rate) OVER b // count(*) OVER b, rate)::BIGINT AS expected FROM rates WINDOW b AS (PARTITION BY source, field ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, sum(rate - expected - 20000) OVER (PARTITION BY source, field ORDER BY start) AS upto FROM e),
    d AS (SELECT *, (upto - least(0, min(upto) OVER (PARTITION BY source, field ORDER BY start)))::BIGINT AS drift FROM s)
    SELECT source, field, start, items, missing, rate, expected, drift, drift > 100000 AS alert FROM d""",
)
def _(t):
    return trend.missing_alerts(trend.missing_rates(_timed(t.events), ["title", "props"]))


@query("stream_missing_rates", f"WITH {_RATES} SELECT source, field, start, items, missing, rate FROM rates WHERE epoch_ms(start) + 86400000 <= (SELECT epoch_ms(max(ts)) - 21600000 FROM events)")
def _(t):
    # Three batches in order of time; the stretches that can still grow stay inside.
    stream = _in_cuts(t.events, t, 3)
    return _to_table(trend.missing_rates(_timed(stream), ["title", "props"], late="6 hours"), t, "append").drop("batch")


def _in_parts(rows, t):
    """Rows (n, value) as lines of one file in parts, in order of n."""
    path = f"{scratch_folder(t.spark)}/lines"
    rows.repartitionByRange("n").sortWithinPartitions("n").select("value").write.option("lineSep", "\n").text(path)
    return path


_LINES = "l AS (SELECT o_orderkey AS n, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '{broken' ELSE '{\"k\":' || o_orderkey || '}' END AS value FROM orders)"


def _order_lines(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("n"), F.when(k % 7 == 0, "").when(k % 7 == 1, "{broken").otherwise(F.concat(F.lit('{"k":'), k, F.lit("}"))).alias("value"))


@query("file_tail", f"WITH {_LINES}, m AS (SELECT count(*) OVER () AS total, row_number() OVER (ORDER BY n) AS line_no, value AS line FROM l) SELECT * FROM m WHERE line_no > total - 50")
def _(t):
    return line_files.file_tail(t.spark, _in_parts(_order_lines(t), t), 50, parts=True).select("total", "line_no", "line")


@query("file_line_items", f"WITH {_LINES} SELECT (SELECT count(*) FROM l WHERE value <> '') AS total, row_number() OVER (ORDER BY n) - 1 AS pos, value AS item FROM l WHERE n % 7 > 1")
def _(t):
    return line_files.line_items(t.spark, _in_parts(_order_lines(t), t), parts=True).select("total", "pos", "item")
