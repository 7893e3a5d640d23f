"""Regex, JSON and legacy field extraction as projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, strip
from ..functions.transforms import apply_transforms
from ..functions.urls import transform_url
from ..sources.html_nodes import with_fragment
from . import dedup, dom
from .jsonpath import compiled, find_texts

_CLASS_PATH = re.compile(r"//(\w+)\[@class=['\"]([^'\"]+)['\"]\]")
_CONTAINS_PATH = re.compile(r"//(\w+)\[contains\(@class,\s*'([^']+)'\)\]")

# Fixed patterns: what the short class paths mean when read as regexes.
_CONTAINS_HREF = r"""(?s)<{tag}[^>]*class=['"]?[^"']*{cls}[^"']*['"]?[^>]*href=['"]([^"']+)['"][^>]*>"""
_CLASS_OPENING = r"""(?s)<{tag}[^>]*class=['"]?{cls}['"]?[^>]*>"""
_CLASS_ELEMENT = r"""(?s)<{tag}[^>]*class=['"]{cls}['"][^>]*>"""
_CLASS_TEXT = r"""(?s)<{tag}[^>]*class=['"]{cls}['"][^>]*>([^<]+)</{tag}>"""


def java_regex(pattern: str) -> str:
    """Named groups are spelled differently in Java."""
    return pattern.replace("(?P<", "(?<")


def _filled(template: str, found: re.Match) -> str:
    return template.format(tag=found[1], cls=re.escape(found[2]))


def regex_elements(pages: DataFrame, pattern: str, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, pos, href, title) per match: two groups give href and title, one
    group href, none nothing."""
    groups = re.compile(pattern).groups
    source = "(?s)" + java_regex(pattern)
    null = F.lit(None).cast("string")
    if groups == 0:
        return pages.select(*keys, F.lit(0).alias("pos"), null.alias("href"), null.alias("title")).filter(F.lit(False))
    found = [F.regexp_extract_all(F.col(html), F.lit(source), F.lit(i)) for i in range(1, min(groups, 2) + 1)]
    zipped = F.arrays_zip(*[f.alias(n) for f, n in zip(found, ("href", "title"))])
    rows = pages.select(*keys, F.posexplode(zipped).alias("pos", "m"))
    return rows.select(*keys, "pos", F.col("m.href").alias("href"), (F.col("m.title") if groups > 1 else null).alias("title"))


def legacy_elements(pages: DataFrame, path: str, keys: list[str], html: str = "html") -> DataFrame:
    """``//tag[contains(@class,'x')]`` gives hrefs, ``//tag[@class='x']`` gives
    opening tags."""
    null = F.lit(None).cast("string")
    contains = _CONTAINS_PATH.search(path) if "contains(@class" in path else None
    if contains:
        hits = F.regexp_extract_all(F.col(html), F.lit(_filled(_CONTAINS_HREF, contains)), F.lit(1))
        return pages.select(*keys, F.posexplode(hits).alias("pos", "href")).withColumn("html", null)
    exact = _CLASS_PATH.search(path)
    if not exact:
        return pages.select(*keys, F.lit(0).alias("pos"), null.alias("href"), null.alias("html")).filter(F.lit(False))
    hits = F.regexp_extract_all(F.col(html), F.lit(_filled(_CLASS_OPENING, exact)), F.lit(0))
    return pages.select(*keys, F.posexplode(hits).alias("pos", "html")).select(*keys, "pos", null.alias("href"), "html")


def parse_items(pages: DataFrame, path: str, keys: list[str], html: str = "html") -> DataFrame:
    """Element rows for any path form: css:, xpath:, regex: or a class path."""
    if path.startswith(("css:", "xpath:")):
        return dom.elements(pages, path, keys, html)
    if path.startswith("regex:"):
        found = regex_elements(pages, path[6:], keys, html)
        return found.withColumns({"text": F.lit(None).cast("string"), "html": F.lit(None).cast("string")})
    return legacy_elements(pages, path, keys, html).withColumns(
        {"title": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}
    )


def attr_of(html: Column | str, path: str, attr: str, fragment: Column | str | None = None) -> Column:
    """Attribute of the first match of an xpath or a class path; '' if none."""
    if path.startswith("xpath:"):
        return dom.first_attr(fragment, path, attr)
    found = _CLASS_PATH.search(path)
    if not found:
        return F.lit("")
    element = F.regexp_extract(col(html), _filled(_CLASS_ELEMENT, found), 0)
    return F.regexp_extract(element, rf"""{attr}=['"]([^'"]+)['"]""", 1)


def text_of(html: Column | str, path: str, fragment: Column | str | None = None) -> Column:
    """Text of the first match; '' if none."""
    if path.startswith("xpath:"):
        return dom.first_text(fragment, path)
    found = _CLASS_PATH.search(path)
    if not found:
        return F.lit("")
    return strip(F.regexp_extract(col(html), _filled(_CLASS_TEXT, found), 1))


def _needs_fragment(fields: list[dict]) -> bool:
    return any(str(f.get("path", "")).startswith("xpath:") for f in fields)


def html_fields(rows: DataFrame, fields: list[dict], html: str = "html") -> DataFrame:
    """Add one column per legacy definition: constant, attr or xpath."""
    if _needs_fragment(fields):
        rows = with_fragment(rows, html, "_dom")
    columns = {}
    for f in fields:
        if f["type"] == "constant":
            columns[f["name"]] = F.lit(f["value"])
        elif f["type"] == "attr":
            columns[f["name"]] = attr_of(html, f.get("path", ""), f.get("attr", "href"), "_dom")
        elif f["type"] == "xpath":
            columns[f["name"]] = text_of(html, f.get("path", ""), "_dom")
    return rows.withColumns(columns).drop("_dom")


def legacy_records(elements: DataFrame, rule: dict, keys: list[str]) -> DataFrame:
    """Records of a v1 rule from element rows, with raw_id from the URL."""
    fields = (rule.get("list") or {}).get("fields", [])
    blank = F.lit("")
    if _needs_fragment(fields):
        elements = with_fragment(elements.drop("item"), "html", "_dom")
    columns: dict[str, Column] = {}
    for f in fields:
        name, kind = f["name"], f["type"]
        if kind in ("constant", "computed"):
            columns[name] = F.lit(f.get("value"))
        elif kind == "attr":
            attr = f.get("attr", "href")
            columns[name] = F.coalesce(F.col(attr), blank) if attr in elements.columns else blank
        elif kind == "element_text":
            title = F.coalesce(F.col("title"), blank)
            columns[name] = F.when(title != "", title).otherwise(F.coalesce(F.col("text"), blank))
        elif kind == "element_href":
            columns[name] = transform_url(F.coalesce(F.col("href"), blank), f.get("transform"))
        elif kind == "xpath":
            columns[name] = text_of(F.coalesce(F.col("html"), blank), f.get("path", ""), "_dom")
    records = elements.select(*keys, *[c.alias(n) for n, c in columns.items()])
    pattern = (rule.get("dedup") or {}).get("url_to_id_pattern")
    return fill_raw_id(records, pattern) if pattern else records


def raw_id_of(url: Column, pattern: str) -> Column:
    """Group 1 of ``pattern`` on a URL; null without a match."""
    target, source = F.coalesce(url, F.lit("")), java_regex(pattern)
    return F.when(target.rlike(source), F.regexp_extract(target, source, 1))


def fill_raw_id(items: DataFrame, pattern: str, url: str = "url") -> DataFrame:
    """raw_id from group 1 of ``pattern`` on the URL, only where it is empty
    and only on a match."""
    present = F.col("raw_id") if "raw_id" in items.columns else F.lit(None).cast("string")
    found = raw_id_of(F.col(url) if url in items.columns else F.lit(""), pattern)
    empty = F.coalesce(present, F.lit("")) == ""
    return items.withColumn("raw_id", F.when(empty, F.coalesce(found, present)).otherwise(present))


# --- JSON ------------------------------------------------------------------


_PATH = re.compile(r"\$(?:\.[\w-]+|\['[^']+'\]|\[\d+\]|\[\*\])*\Z")
_NONE = "CAST(ARRAY() AS ARRAY<VARIANT>)"


def _json_path(path: str) -> list[str] | None:
    """Path text between ``[*]`` wildcards, each as a ``$`` path; None when the
    path cannot be read."""
    body = (path or "$.data").strip()
    if not body.startswith("$"):
        body = "$" + (body if body.startswith("[") else "." + body)
    return ["$" + part for part in body[1:].split("[*]")] if _PATH.match(body) else None


def _find(parsed: Column, path: str) -> Column:
    parts = _json_path(path)
    if parts is None:
        return F.expr(_NONE)
    found = F.filter(F.array(parsed), lambda v: v.isNotNull())
    for i, part in enumerate(parts):
        found = _step(found, part, i + 1 < len(parts))
    return F.coalesce(F.flatten(F.transform(found, _spread)), F.expr(_NONE))


def _spread(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _step(found: Column, part: str, wildcard: bool) -> Column:
    if wildcard:
        return F.flatten(F.transform(found, lambda v: F.coalesce(F.try_variant_get(v, part, "array<variant>"), F.expr(_NONE))))
    return F.filter(F.transform(found, lambda v: F.try_variant_get(v, part, "variant")), lambda v: v.isNotNull())


def _find_first(parsed: Column, path: str) -> Column:
    compiled(path)
    parts = _json_path(path)
    if parts is None:
        return F.try_parse_json(F.try_element_at(find_texts(F.to_json(parsed), path), F.lit(1)))
    if parts is None or len(parts) > 1:
        return F.try_element_at(_find(parsed, path), F.lit(1))
    many = F.try_variant_get(parsed, parts[0], "array<variant>")
    return F.when(many.isNotNull(), F.get(many, F.lit(0))).otherwise(F.try_variant_get(parsed, parts[0], "variant"))


def json_find(value: Column | str, path: str) -> Column:
    """All matches of a JSONPath as ``array<variant>``; a match that is a list
    gives its elements, bad JSON an empty array. An empty path means
    ``$.data``; one that can't be read is refused with a ValueError.

    Names, indexes and ``[*]`` are looked up in the parsed document; descent,
    slices, unions, filters and wildcards over names take a walk over it."""
    compiled(path)
    if _json_path(path) is not None:
        return _find(F.try_parse_json(col(value)), path)
    return F.transform(find_texts(col(value), path), F.try_parse_json)


def json_text(v: Column) -> Column:
    """A JSON value as text: strings bare, the rest as JSON."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def json_items(docs: DataFrame, body: str, path: str, keys: list[str]) -> DataFrame:
    """One row per item of an API response: (keys, pos, item)."""
    values = F.transform(json_find(body, path), json_text)
    return docs.select(*keys, F.posexplode(values).alias("pos", "item"))


def json_first(value: Column | str, path: str) -> Column:
    """First match as text, '' when there is none."""
    return F.coalesce(json_text(_find_first(F.try_parse_json(col(value)), path)), F.lit(""))


def _shown(first: Column) -> Column:
    text = F.coalesce(json_text(first), F.lit(""))
    return F.when(text.isin("true", "false") & (F.schema_of_variant(first) == "BOOLEAN"), F.initcap(text)).otherwise(text)


def api_records(items: DataFrame, fields: list[dict], keys: list[str], item: str = "item") -> DataFrame:
    """Records from JSON items: constant, field with transforms, template.
    Each item is parsed once for all of its fields."""
    parsed = F.col("_json")
    columns = []
    for f in fields:
        if f["type"] == "constant":
            value = F.lit(f["value"])
        elif f["type"] == "field":
            value = F.coalesce(json_text(_find_first(parsed, f.get("path", ""))), F.lit(""))
            if f.get("transform"):
                value = apply_transforms(value, f["transform"])
        elif f["type"] == "computed":
            value = F.lit(f.get("value", ""))
            for name, path in (f.get("vars") or {}).items():
                value = F.replace(value, F.lit("{" + name + "}"), _shown(_find_first(parsed, path)))
        else:
            continue
        columns.append(value.alias(f["name"]))
    return items.withColumn("_json", F.try_parse_json(item)).select(*keys, *columns)


def pick_capture(desktop: DataFrame, mobile: DataFrame, min_chars: int = 5000, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """(url, html): the newest desktop capture of each url, unless it is short
    and a mobile one exists, of which the newest counts as well. ``keys`` says
    what is one page where several pages share a url."""
    m = dedup.latest_capture(mobile, keys=keys).withColumnRenamed("html", "_mobile")
    short = F.length("html") < min_chars
    return dedup.latest_capture(desktop, keys=keys).join(m, list(keys), "left").select(*keys, F.when(short, F.coalesce("_mobile", "html")).otherwise(F.col("html")).alias("html"))
