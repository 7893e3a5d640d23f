"""Quality measures of recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, lines, strip

# Fixed patterns: character classes counted by the quality profile.
_CJK = r"[\x{4e00}-\x{9fff}]"
_ODD = r"(?U)[^\sA-Za-z0-9\x{4e00}-\x{9fff}，。；：、（）()《》“”‘’！？,.|/\\\-_%+]"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def text_profile(c: Column | str) -> dict[str, Column]:
    """Counts that describe one text; use with ``withColumns``."""
    value = F.coalesce(col(c), F.lit(""))
    odd = _count(value, _ODD)
    return {
        "text_length": F.length(value),
        "non_empty_lines": F.size(lines(value)),
        "chinese_chars": _count(value, _CJK),
        "ascii_letters": _count(value, "[A-Za-z]"),
        "digits": _count(value, r"(?U)\d"),
        "weird_chars": odd,
        "weird_char_ratio": F.round(odd / F.greatest(F.length(value), F.lit(1)), 4),
    }


def word_profile(words: Column | str, grid_rows: Column | str, cells: Column | str) -> dict[str, Column]:
    w = col(words)
    known = F.filter(F.transform(w, lambda x: x["conf"]), lambda x: x >= 0)
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return {
        "word_count": F.coalesce(F.size(w), F.lit(0)),
        "avg_word_conf": F.when(F.size(known) > 0, F.round(total / F.size(known), 2)),
        "table_grid_detected": F.coalesce(F.size(col(grid_rows)) > 0, F.lit(False)),
        "table_cell_rows": F.greatest(F.coalesce(F.size(col(cells)), F.lit(0)), F.lit(0)),
    }


def quality_verdict(
    text: Column,
    line_count: Column,
    width: Column,
    height: Column,
    structure_html: Column | None = None,
    structure_rows: Column | None = None,
    min_text_length: int = 20,
    min_line_count: int = 2,
    large_image_pixels: int = 200_000,
) -> Column:
    """struct(status, quality_status, reason) for one recognised image."""
    html = F.coalesce(structure_html, F.lit("")) if structure_html is not None else F.lit("")
    rows = F.coalesce(structure_rows, F.lit(0)) if structure_rows is not None else F.lit(0)
    body = strip(F.when(html != "", html).otherwise(F.coalesce(text, F.lit(""))))
    n_lines = F.when((strip(html) != "") & (rows > 0), rows).otherwise(F.coalesce(line_count, F.lit(0)))
    pixels = F.coalesce(width, F.lit(0)).cast("bigint") * F.coalesce(height, F.lit(0)).cast("bigint")

    def verdict(status: str, quality: str, reason: str | None) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            F.lit(quality).alias("quality_status"),
            F.lit(reason).cast("string").alias("reason"),
        )

    return (
        F.when(body == "", verdict("empty", "empty", "empty_text"))
        .when(F.length(body) < min_text_length, verdict("success_low_confidence", "manual_review_required", "text_too_short"))
        .when(
            (n_lines < min_line_count) & (pixels >= large_image_pixels),
            verdict("success_low_confidence", "manual_review_required", "large_image_too_few_lines"),
        )
        .otherwise(verdict("success", "usable", None))
    )


def needs_review(status: Column, text: Column, quality_status: Column) -> Column:
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    return (status != "success") | blank | (F.coalesce(quality_status, F.lit("")) != "usable")


def ocr_item_fields(prefix: Column) -> dict[str, Column]:
    """``ocr_*`` record fields from an OCR result struct."""
    r = prefix
    return {
        "ocr_plugin": r["plugin"],
        "ocr_engine": r["plugin"],
        "ocr_status": r["status"],
        "ocr_text": r["text"],
        "ocr_error": r["error"],
        "ocr_elapsed_seconds": r["elapsed_seconds"],
        "ocr_empty": strip(F.coalesce(r["text"], F.lit(""))) == "",
        "ocr_quality_status": r["quality_status"],
        "ocr_quality_reasons": F.coalesce(r["quality_reasons"], F.array().cast("array<string>")),
        "manual_review_required": needs_review(r["status"], r["text"], r["quality_status"]),
    }


def best_text(structure_markdown: Column, table_markdown: Column, raw: Column) -> Column:
    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    return F.coalesce(filled(structure_markdown), filled(table_markdown), raw)
