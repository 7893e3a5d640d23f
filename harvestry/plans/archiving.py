"""Archive runs: list pages to archived detail pages and their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import body_hash, page_hash, variant_hash
from ..functions.text import strip
from ..functions.urls import resolve_url
from ..operators import archive, dedup, dom, lists, tables
from ..session import cut_lineage
from ..sources import writers
from ..sources.html_nodes import with_fragment


def discover_candidates(list_pages: DataFrame, rule: dict, keys: list[str] | None = None) -> DataFrame:
    """(keys, page_no, pos, title, detail_url) in list order, de-duplicated by
    URL within and across pages, cut to ``max_details``."""
    keys = keys or []
    config = rule.get("discovery") or {}
    listing = config.get("list") or {}
    title_path = (listing.get("title") or {}).get("selector", "")
    detail = listing.get("detail_url") or {}
    attr = (detail.get("attribute") or "href").lower()
    items = dom.elements(list_pages, listing.get("items_path", ""), [*keys, "page_no"])
    item = F.col("item")
    title = dom.all_text(item, title_path) if title_path else strip(item["text"].cast("string"))
    if detail.get("selector"):
        raw = dom.first_attr(item, detail["selector"], attr)
    else:
        raw = F.coalesce(item["nodes"][0]["attrs"][attr], F.lit(""))
    base = (rule.get("source") or {}).get("base_url") or (rule.get("source") or {}).get("url") or ""
    rows = items.select(*keys, "page_no", "pos", title.alias("title"), raw.alias("_raw"))
    found = rows.filter((F.col("_raw") != "") & lists.any_keyword("title", (config.get("filters") or {}).get("title_keywords") or []))
    found = found.withColumn("detail_url", resolve_url(F.lit(base), F.col("_raw"))).drop("_raw")
    limit = lists.details_limit(config.get("max_details"))
    # Within a page first: the limit also applies there.
    per_page = dedup.by_url(found, order=("page_no", "pos"), scope=[*keys, "page_no"])
    if limit is not None:
        per_page = lists.top_per_key(per_page, [*keys, "page_no"], [F.col("pos").asc()], limit)
    unique = dedup.by_url(per_page, scope=keys)
    return lists.first_details(unique.select(*keys, "page_no", "pos", "title", "detail_url"), limit, keys)


def list_page_chain(pages: DataFrame, starts: DataFrame, rule: dict) -> DataFrame:
    """(start_url, page_no, url, html): list pages reached by next-page links,
    each in its newest capture."""
    pages = dedup.latest_capture(pages)
    paging = (rule.get("discovery") or {}).get("pagination") or {}
    selector = (paging.get("next_page") or {}).get("selector") or ""
    first = starts.select(F.col("url").alias("start_url"), F.lit(1).alias("page_no"), "url")
    if paging.get("enabled") and selector:
        attr = (paging.get("next_page") or {}).get("attribute") or "href"
        base = (rule.get("source") or {}).get("url") or ""
        raw = with_fragment(pages.select("url", "html")).select("url", dom.first_attr("dom", selector, attr).alias("_raw"))
        links = raw.select("url", F.when(F.col("_raw") != "", resolve_url(F.lit(base), F.col("_raw"))).alias("next_url"))
        first = lists.next_page_chain(links, starts, int(paging.get("max_pages") or 1))
    return first.join(pages.select("url", "html"), "url")


def archive_details(
    details: DataFrame,
    rule: dict,
    archived: DataFrame | None = None,
    archived_ocr: DataFrame | None = None,
    ocr: DataFrame | None = None,
) -> DataFrame:
    """Archive rows of detail pages (url, html, seq, optional title).

    Known content is skipped before anything is parsed. Of pages with one body
    the first stays.
    """
    config = rule.get("archive") or {}
    image_config = config.get("image_ocr") or {}
    plugin = (image_config.get("ocr") or {}).get("plugin") or "tesseract"
    engine = plugin if image_config.get("enabled") else None
    blank = F.lit("")
    hashed = details.withColumns(
        {"content_hash": page_hash(F.col("url"), F.col("url"), F.col("html"), blank), "ocr_engine": F.lit(plugin), "body_hash": body_hash(F.col("html"), blank)}
    )
    if archived is not None:
        known = archived_ocr if archived_ocr is not None else archived.select("page_id", F.lit("").alias("engine")).filter(F.lit(False))
        hashed = dedup.drop_archived_by_engine(hashed, archived, known)
    unique = dedup.by_body(hashed, "body_hash", ("seq",))
    unique = unique.withColumnRenamed("title", "list_title") if "title" in unique.columns else unique
    if engine and ocr is not None:
        # What one parse of a page gives is kept, without the page, for its two uses.
        read = cut_lineage(archive.read_details(unique.select("body_hash", "url", "html"), rule, images=image_config.get("images") or {}).drop("html"))
        parsed = unique.join(read.select("body_hash", "title", "blocks"), "body_hash")
    else:
        parsed = archive.read_details(unique, rule)
    if "list_title" in parsed.columns:
        parsed = parsed.withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("list_title")))
    if engine and ocr is not None:
        images = archive.listed_images(read, ["body_hash"])
        extra = archive.image_ocr_blocks(images, ocr, ["body_hash"], engine)
        parsed = parsed.join(extra, "body_hash", "left")
        blocks, assets = archive.append_image_blocks(F.col("blocks"), F.col("image_blocks"), F.col("image_assets"))
        parsed = parsed.withColumns({"blocks": blocks, "assets": assets})
    source = rule.get("source") or {}
    ready = parsed.withColumns(
        {
            "source_url": F.col("url"), "entry_url": F.lit(source.get("url")).cast("string"), "final_url": F.col("url"),
            "platform": F.lit(source.get("platform") or rule.get("name")).cast("string"), "subject": F.lit(rule.get("subject") or source.get("subject")).cast("string"),
            "source_name": F.lit(source.get("name") or rule.get("name")).cast("string"), "markdown": blank,
        }
    )
    pages = archive.build_pages(ready)
    if not engine:
        return pages
    has_ocr = F.col("meta.contains_ocr")
    stored = F.when(has_ocr, variant_hash(F.col("meta.content_hash"), F.lit(engine))).otherwise(F.col("meta.content_hash"))
    return pages.withColumn("meta", F.col("meta").withField("content_hash", stored).withField("ocr_engine", F.when(has_ocr, engine)))


def page_records(pages: DataFrame, rule: dict, keys: tuple[str, ...] = ("content_hash",)) -> DataFrame:
    """Structured records of archived pages, by content hash (or by the fields
    ``keys`` of their meta)."""
    rows = pages.select(*[F.col(f"meta.{k}").alias(k) for k in keys], F.explode("blocks").alias("b")).select(
        *keys, "b.id", "b.block_type", "b.text", "b.ocr_text"
    )
    return tables.structured_records(rows, rule.get("structuring") or {}, list(keys))


def archive_run(list_pages: DataFrame, pages: DataFrame, rule: dict, **known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archived pages, structured records) of a rule with discovery. Of
    several captures of a detail page the newest counts."""
    candidates = discover_candidates(list_pages, rule)
    captured = dedup.latest_capture(pages).withColumnRenamed("url", "detail_url")
    details = candidates.join(captured, "detail_url").select(F.col("detail_url").alias("url"), "html", F.col("title"), F.struct("page_no", "pos").alias("seq"))
    archived = archive_details(details, rule, **known)
    return archived, page_records(archived, rule)


def save_run(archived: DataFrame, rule: dict, root: str, run_id: str) -> str:
    """Commit archived pages and their records as one run. The pages are
    checkpointed first, so the five tables come from one parse."""
    pages = cut_lineage(archived)
    return writers.save_archive(archive.storage_tables(pages, page_records(pages, rule)), root, run_id)


def archive_single(pages: DataFrame, rule: dict, first_titles: DataFrame | None = None, **known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archive pages as they are, without discovery. An empty title falls back
    to the page's first item: that of its page_id and url where ``first_titles(url,
    title)`` has a page_id as well, else the smallest of its url's."""
    details = pages.select("url", "html", F.struct(F.col("page_id")).alias("seq"))
    if first_titles is not None:
        keys = [c for c in ("page_id", "url") if c in first_titles.columns]
        titles = first_titles.groupBy(*keys).agg(F.min("title").alias("title"))
        own = pages.select("url", "html", "page_id", F.struct("page_id").alias("seq"))
        details = own.join(titles, keys, "left").select("url", "html", "seq", F.coalesce("title", F.lit("")).alias("title"))
    archived = archive_details(details, rule, **known)
    return archived, page_records(archived, rule)
