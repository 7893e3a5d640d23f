"""Selection over parsed pages with array functions, no shuffle.

A *fragment* is a struct of a node slice and its byte buffers. Whole pages and
single items are both fragments, so a field selector sees only its item, the
way a selector applied to an item's own HTML does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let, strip
from ..functions.urls import resolve_url
from ..sources.html_nodes import node_bytes, with_fragment
from .selectors import Path, node_numbers, node_values, selector_paths

def _single(paths: tuple[Path, ...]) -> bool:
    """Whether every node can be told by its own tag and attributes."""
    plain = ("has", "=", "~=", "|=", "^=", "$=", "*=")
    tests = [t for p in paths for t in p.steps[0].tests]
    return all(len(p.steps) == 1 and p.steps[0].link == " " for p in paths) and all(t[0] == "tag" or t[0] == "attr" and t[2] in plain for t in tests)


def _test(n: Column, test: tuple) -> Column:
    if test[0] == "tag":
        return n["tag"] == test[1]
    _, name, op, value = test
    attr = n["attrs"][name]
    if op == "has":
        return attr.isNotNull()
    if op == "=":
        return F.coalesce(attr == value, F.lit(False))
    if not value:
        return F.lit(False)
    tests = {
        "~=": lambda: F.array_contains(F.split(attr, r"\s+"), value),
        "|=": lambda: (attr == value) | F.startswith(attr, F.lit(value + "-")),
        "^=": lambda: F.startswith(attr, F.lit(value)),
        "$=": lambda: F.endswith(attr, F.lit(value)),
        "*=": lambda: F.contains(attr, F.lit(value)),
    }
    return F.coalesce(tests[op](), F.lit(False))


def select_nodes(fragment: Column | str, path: str) -> Column:
    """Array of matching nodes in document order.

    A selector that tells each node by its own tag and attributes is a filter;
    one that relates nodes is a structural join over the whole batch, whose
    result are places in the node array. A path that ends in an attribute or
    text gives the nodes which that is taken from.
    """
    f = col(fragment)
    nodes, paths = f["nodes"], selector_paths(path)
    if not _single(paths):
        return F.transform(node_numbers(f, path), lambda i: F.get(nodes, i))
    passes = lambda n, p: reduce(lambda a, b: a & b, [_test(n, t) for t in p.steps[0].tests], F.lit(True))
    return F.filter(nodes, lambda n: reduce(lambda a, b: a | b, [passes(n, p) for p in paths]))


def values(fragment: Column | str, path: str) -> Column:
    """Array of strings in document order: what a path that ends in ``@name``,
    ``text()``, ``::attr(name)`` or ``::text`` takes, or the whole text of each
    node that any other path leads to."""
    f = col(fragment)
    if selector_paths(path)[0].value:
        return node_values(f, path)
    return F.transform(select_nodes(f, path), lambda n: node_text(f, n))


def node_text(fragment: Column | str, n: Column) -> Column:
    """String value of a node: all text below it, as it stands."""
    f = col(fragment)
    return node_bytes(f["text"], n["t0"] - f["text_at"], n["t1"] - f["text_at"])


def node_html(fragment: Column | str, n: Column) -> Column:
    f = col(fragment)
    return node_bytes(f["html"], n["h0"] - f["html_at"], n["h1"] - f["html_at"])


def sub_fragment(fragment: Column | str, n: Column) -> Column:
    """The part of a fragment below (and with) node ``n``."""
    f = col(fragment)
    base = f["nodes"][0]["id"]
    return F.struct(
        F.slice(f["nodes"], n["id"] - base + 1, n["end"] - n["id"] + 1).alias("nodes"),
        F.substring(f["text"], n["t0"] - f["text_at"] + 1, n["t1"] - n["t0"]).alias("text"),
        n["t0"].alias("text_at"),
        F.substring(f["html"], n["h0"] - f["html_at"] + 1, n["h1"] - n["h0"]).alias("html"),
        n["h0"].alias("html_at"),
    )


def _first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def all_text(fragment: Column | str, path: str) -> Column:
    """Text of every match, joined and stripped; '' without a match."""
    f = col(fragment)
    if not path:
        return strip(F.coalesce(f["text"].cast("string"), F.lit("")))
    return strip(F.array_join(values(f, path), ""))


def text_list(fragment: Column | str, path: str) -> Column:
    f = col(fragment)
    if not path:
        return F.array(all_text(f, ""))
    return F.transform(values(f, path), strip)


def first_text(fragment: Column | str, path: str) -> Column:
    f = col(fragment)
    if selector_paths(path)[0].value:
        return F.coalesce(strip(_first(node_values(f, path))), F.lit(""))
    return F.coalesce(let(_first(select_nodes(f, path)), lambda n: strip(node_text(f, n))), F.lit(""))


def first_attr(fragment: Column | str, path: str, attr: str) -> Column:
    if not path:
        return F.lit("")
    return F.coalesce(_first(select_nodes(fragment, path))["attrs"][attr.lower()], F.lit(""))


def first_html(fragment: Column | str, path: str) -> Column:
    f = col(fragment)
    if not path:
        return F.coalesce(f["html"].cast("string"), F.lit(""))
    return F.coalesce(let(_first(select_nodes(f, path)), lambda n: node_html(f, n)), F.lit(""))


def hit_count(fragment: Column | str, path: str) -> Column:
    return F.size(select_nodes(fragment, path))


def structure_hash(fragment: Column | str) -> Column:
    """sha256 of the tag sequence in document order."""
    tags = F.transform(col(fragment)["nodes"], lambda n: n["tag"])
    return F.sha2(F.array_join(tags, " "), 256)


def elements(pages: DataFrame, path: str, keys: list[str], html: str = "html", dom: str | None = None) -> DataFrame:
    """Element rows (keys, pos, href, title, text, html, item fragment).

    Each item carries only its own slice of the page. XPath rows have no
    ``text`` value.
    """
    source = pages if dom else with_fragment(pages.select(*keys, html), html)
    name = dom or "dom"
    page = F.col(name)
    found = F.transform(select_nodes(page, path), lambda n: sub_fragment(page, n))
    item = F.col("item")
    root = item["nodes"][0]
    own = F.coalesce(root["attrs"]["href"], F.lit(""))
    inner = F.coalesce(
        _first(F.filter(item["nodes"], lambda n: (n["tag"] == "a") & (n["id"] != root["id"]) & n["attrs"]["href"].isNotNull()))["attrs"]["href"],
        F.lit(""),
    )
    href = own if path.startswith("xpath:") else F.when(own != "", own).otherwise(inner)
    rows = source.select(*keys, F.posexplode(found).alias("pos", "item"))
    rows = rows.withColumn("title", strip(item["text"].cast("string")))
    text = F.lit(None).cast("string") if path.startswith("xpath:") else F.col("title")
    return rows.select(
        *keys, "pos", href.alias("href"), "title", text.alias("text"), item["html"].cast("string").alias("html"), "item"
    )


def links(pages: DataFrame, path: str, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, pos, href, title) of every match, own href only."""
    page = F.col("dom")
    found = F.transform(
        select_nodes(page, path),
        lambda n: F.struct(F.coalesce(n["attrs"]["href"], F.lit("")).alias("href"), strip(node_text(page, n)).alias("title")),
    )
    return (
        with_fragment(pages.select(*keys, html), html)
        .select(*keys, F.posexplode(found).alias("pos", "l"))
        .select(*keys, "pos", "l.href", "l.title")
    )


def field_column(fragment: Column | str, definition: dict) -> Column:
    """One field of a record from an item fragment."""
    kind = definition.get("type", "text")
    path = definition.get("selector", "")
    if kind in ("attribute", "attr"):
        raw = first_attr(fragment, path, definition.get("attribute") or definition.get("attr", ""))
        base = definition.get("base_url", "")
        return F.when(raw != "", resolve_url(F.lit(base), raw)).otherwise(raw) if base else raw
    if kind == "html":
        return first_html(fragment, path)
    if kind == "list":
        return text_list(fragment, path)
    return all_text(fragment, path)


def extract_records(items: DataFrame, extract: dict[str, dict], keys: list[str], item: str = "item") -> DataFrame:
    """One record per item, columns compiled from the rule's field list."""
    from ..functions.transforms import apply_transforms

    columns = []
    for name, definition in extract.items():
        value = field_column(item, definition)
        if definition.get("transform") and definition.get("type") != "list":
            value = apply_transforms(value, definition["transform"])
        columns.append(value.alias(name))
    return items.select(*keys, *columns)
