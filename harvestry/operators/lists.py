"""Filters, paging and ordered heads behind the list views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col
from ..functions.urls import hostname_of
from ..session import cut_lineage


def any_keyword(c: Column | str, keywords: list[str]) -> Column:
    """Some keyword occurs; no keywords pass everything."""
    if not keywords:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(col(c), F.lit(k)), F.lit(False)) for k in keywords])


def _search(df: DataFrame, keyword: str, columns: list[str]) -> Column:
    if not keyword:
        return F.lit(True)
    text = F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in columns]))
    return F.contains(text, F.lit(keyword.lower()))


def filter_archives(pages: DataFrame, platform: str = "", ocr: bool | None = None, keyword: str = "") -> DataFrame:
    out = pages.filter(F.col("platform") == platform) if platform else pages
    out = out if ocr is None else out.filter(F.coalesce("contains_ocr", F.lit(False)) == F.lit(ocr))
    return out.filter(_search(out, keyword, ["title", "source_url", "domain", "subject"]))


def filter_sources(sources: DataFrame, status: str = "", kind: str = "", keyword: str = "") -> DataFrame:
    out = sources.filter(F.col("lifecycle_status") == status) if status else sources
    out = out.filter(F.col("type") == kind) if kind else out
    return out.filter(_search(out, keyword, ["id", "name", "domain", "category", "rule_path"]))


def filter_rules(rules: DataFrame, platform: str = "", enabled: bool | None = None, keyword: str = "") -> DataFrame:
    out = rules.filter(F.col("platform") == platform) if platform else rules
    out = out if enabled is None else out.filter(F.col("enabled") == F.lit(enabled))
    return out.filter(_search(out, keyword, ["name", "subject", "platform", "rule_path"]))


def filter_blocks(blocks: DataFrame, types: list[str]) -> DataFrame:
    return blocks.filter(F.col("block_type").isin(*types)) if types else blocks


def image_matches(url: Column | str, alt: Column | str, keywords: list[str]) -> Column:
    """Some keyword occurs in the lower-cased address and caption."""
    text = F.lower(F.concat_ws(" ", col(url), col(alt)))
    return any_keyword(text, [k.lower() for k in keywords])


def domain_matches(page_url: Column | str, domains: list[str]) -> Column:
    return any_keyword(hostname_of(page_url), domains) if domains else F.lit(False)


def image_filter(images: DataFrame, trigger: dict, page_url: str = "url") -> DataFrame:
    """Images to recognise: a keyword hit or a configured domain."""
    hit = image_matches("source_img_url", "source_img_alt", trigger.get("img_keywords") or [])
    return images.filter(hit | domain_matches(page_url, trigger.get("domains") or []))


def image_trigger(pages: DataFrame, images: DataFrame, config: dict, keys: list[str], page_url: str = "url", items: str = "item_count") -> DataFrame:
    """pages + ``triggered``: recognition is on, and the page gave no items, or
    its host is configured, or one of its images matches."""
    trigger = config.get("trigger") or {}
    hit = image_matches("source_img_url", "source_img_alt", trigger.get("img_keywords") or [])
    matched = images.groupBy(*keys).agg(F.bool_or(hit).alias("_hit"))
    empty = (F.col(items) == 0) if trigger.get("when_empty") else F.lit(False)
    wanted = empty | domain_matches(page_url, trigger.get("domains") or []) | F.coalesce("_hit", F.lit(False))
    return pages.join(matched, keys, "left").withColumn("triggered", F.lit(bool(config.get("enabled"))) & wanted).drop("_hit")


def image_run_summary(images: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per run from its images (downloaded, ocr_status, review, error)."""
    return images.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("images_found"),
        F.count_if("downloaded").alias("images_downloaded"),
        F.count_if(F.col("ocr_status") == "success").alias("ocr_success"),
        F.count_if("manual_review_required").alias("manual_review_required"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("error_count"),
    )


# --- heads and pages -------------------------------------------------------


def details_limit(value) -> int | None:
    """Number of detail pages; empty, 0, all and unlimited mean no limit."""
    if value in (None, "", 0) or str(value).lower() in ("0", "all", "unlimited"):
        return None
    return int(value) if int(value) > 0 else None


def first_details(candidates: DataFrame, limit: int | None, scope: list[str] | None = None, order: tuple[str, ...] = ("page_no", "pos")) -> DataFrame:
    """The first ``limit`` candidates of a run over its list pages."""
    if limit is None:
        return candidates
    if not scope:
        return candidates.orderBy(*order).limit(limit)
    return top_per_key(candidates, scope, [F.col(c).asc() for c in order], limit)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def preview_size(limit: int | None = 5) -> int:
    return max(1, min(int(limit or 5), 20))


def page_of(df: DataFrame, order: list[Column | str], page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of an ordered list; ``page_size`` is at most 100."""
    size = min(100, max(1, page_size))
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def run_item_order(items: DataFrame) -> DataFrame:
    return items.orderBy("item_stage", F.col("title").asc_nulls_last(), F.col("raw_id").asc_nulls_last())


def log_tail(logs: DataFrame, n: int = 100) -> DataFrame:
    """Last lines of each log with its line count: (name, total, line_no,
    line). A log is one row of text, so the cut is made inside the row."""
    parts = F.split("content", "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    tail = F.slice("_lines", F.greatest(F.col("total") - n + 1, F.lit(1)), n)
    rows = logs.withColumn("_lines", whole).withColumn("total", F.size("_lines"))
    first = F.greatest(F.col("total") - n, F.lit(0))
    return rows.select("name", "total", first.alias("_first"), F.posexplode(tail).alias("_p", "line")).select(
        "name", "total", (F.col("_first") + F.col("_p") + 1).alias("line_no"), "line"
    )


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, modified_at) of the log files of a folder; their contents
    are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))


def log_list(logs: DataFrame) -> DataFrame:
    """Logs (name, ...) from the highest name, which for dated names is the
    newest; other names than ``*.log`` are no logs."""
    return logs.filter(F.endswith("name", F.lit(".log"))).orderBy(F.desc("name"))


# --- result files ----------------------------------------------------------


def latest_files(files: DataFrame, n: int = 1, keys: tuple[str, ...] = ("subject", "platform"), name: str = "file_name") -> DataFrame:
    """Files with the ``n`` highest names per platform; ``combined*`` excluded."""
    plain = files.filter(~F.startswith(name, F.lit("combined")))
    return top_per_key(plain, list(keys), [F.col(name).desc()], n)


def file_counts(files: DataFrame) -> DataFrame:
    """(subject, platform, file_name, item_count): the newest file of each."""
    return latest_files(files).select("subject", "platform", "file_name", "item_count")


def subject_counts(files: DataFrame) -> DataFrame:
    """Subject and platform totals of the newest files in one pass: a row per
    platform and one per subject (platform NULL)."""
    top = file_counts(files)
    return top.rollup("subject", "platform").agg(
        F.sum("item_count").alias("total"), F.count(F.lit(1)).alias("platforms"), F.max("file_name").alias("latest_file"), F.grouping("platform").alias("is_subject")
    ).filter("subject IS NOT NULL")


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def governance_records(files: DataFrame) -> DataFrame:
    """Governance values of result files with their defaults."""
    count = F.coalesce("data_count", F.lit(0))
    full = F.coalesce("field_completeness", F.when(count > 0, 1.0).otherwise(0.0))
    return files.select(
        "subject", "platform", "file_name", F.coalesce("item_count", count).alias("item_count"),
        F.coalesce("duplicate_count", "dedup_filtered", F.lit(0)).alias("duplicate_count"),
        F.coalesce("injection_risk_count", F.lit(0)).alias("injection_risk_count"), full.alias("field_completeness"),
        F.coalesce("quality_score", full).alias("quality_score"),
        F.coalesce(F.nullif("status", F.lit("")), F.when(full >= 0.8, "SUCCESS").otherwise("PARTIAL_SUCCESS")).alias("status"),
    )


def governance_totals(records: DataFrame, files: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Totals over all files, or the ``files`` newest, of equal names by subject
    and platform; means are 0 when there are none."""
    top = records if files is None else newest(records, order or [F.col("file_name").desc(), F.col("subject"), F.col("platform")], files)
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))
    return top.agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("total_items"),
        F.coalesce(F.sum("injection_risk_count"), F.lit(0)).alias("injection_risk_count"),
        mean("field_completeness").alias("avg_field_completeness"), mean("quality_score").alias("avg_quality_score"),
    )


def governance_latest(records: DataFrame, files: int = 100, shown: int = 30, order: list[Column] | None = None) -> DataFrame:
    """The first ``shown`` records of the ``files`` newest that the limited
    totals cover, in that order."""
    own = order or [F.col("file_name").desc(), F.col("subject"), F.col("platform")]
    return newest(newest(records, own, files), own, shown)


def stop_at_empty(pages: DataFrame, keys: list[str], max_pages: int = 10, keep_empty: bool = False, start: int = 1) -> DataFrame:
    """Pages of a run before its first empty one (with it under
    ``keep_empty``), at most ``max_pages``. A gap in the numbers ends a run
    like an empty page."""
    inside = pages.filter((F.col("page_no") >= start) & (F.col("page_no") < start + max_pages))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("page_no"))
    inside = inside.withColumn("_gap", F.col("page_no") - start + 1 > rank)
    stops = inside.groupBy(*keys).agg(
        F.min(F.when(F.col("item_count") == 0, F.col("page_no"))).alias("_stop"), F.min(F.when(F.col("_gap"), F.col("page_no"))).alias("_cut")
    )
    end = F.lit(start + max_pages)
    stop = F.coalesce("_stop", end)
    kept = F.col("page_no") <= stop if keep_empty else F.col("page_no") < stop
    return inside.join(stops, keys).filter(kept & (F.col("page_no") < F.coalesce("_cut", end))).drop("_stop", "_cut", "_gap")


def next_page_chain(links: DataFrame, starts: DataFrame, max_pages: int) -> DataFrame:
    """(start_url, url, page_no): follow ``links(url, next_url)`` from each
    start at most ``max_pages - 1`` times, while the target is captured.

    ``max_pages`` comes from the rule and is small; each hop is one equi-join.
    """
    # One row per page, however often it was captured, and parsed only once.
    links = cut_lineage(links.groupBy("url").agg(F.min("next_url").alias("next_url")))
    captured = links.select(F.col("url").alias("next_url"))
    hops = links.select(F.col("url").alias("_from"), "next_url").join(captured, "next_url", "left_semi")
    step = starts.select(F.col("url").alias("start_url"), "url", F.lit(1).alias("page_no"))
    out = step
    for number in range(2, max_pages + 1):
        step = step.join(hops, F.col("url") == F.col("_from")).select("start_url", F.col("next_url").alias("url"), F.lit(number).alias("page_no"))
        step = cut_lineage(step) if number % 4 == 0 else step
        out = out.unionByName(step)
    return out
