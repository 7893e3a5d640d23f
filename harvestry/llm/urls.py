"""URL filter: host and path rules, and a list of URLs behind a Bloom filter.

The listed URLs, in canonical form, set bits in a blocked Bloom filter: a hash
picks one block of four 64-bit words and one bit in each. Pages probe the
filter where they lie; only possible hits are shuffled to an exact join with
the list, which removes the false ones. All of it are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, without

#: (verdict, host, path)
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the addresses of one page: no scheme, no www., m. or
    default port, no fragment, no closing slashes, no utm_ parameters, the
    other parameters in order; null without ://."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^(?:www|m)\.", ""), r":(?:80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.contains(url, F.lit("://")), F.concat(name, F.regexp_replace(path(url), r"/+$", ""), tail))


def matching_rule(name: Column, place: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits the host or one above it, and whose path
    begins the page's; as struct(rule, verdict), null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((name == rule_host) | name.endswith("." + rule_host)) & place.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(text: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block and the four words, of one bit each, of a text's hash."""
    place, bits = F.xxhash64(text), F.xxhash64(text, F.lit(1))
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return F.pmod(place, F.lit(blocks)).cast("int"), words


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(block, w0 to w3): at most ``blocks`` rows, merged before they move."""
    block, words = _bits(F.col(url), blocks)
    marked = listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], blocks: int = 1 << 16) -> DataFrame:
    """Every row with host, path, ``rule`` (the longest that fits; else null),
    ``listed`` (whether the canonical URL is in the list) and ``verdict``: the
    rule's, else block for listed pages and allow for others.

    pages need a column url; listed a column url with the addresses to block.
    Null URLs and those without :// have an empty host and path, are never
    listed, and are allowed. Nulls and repeats in the list count for nothing.
    Repeated rows give repeated results; an empty table an empty one, an empty
    list lists nothing. Input columns with the names of results are replaced.

    The filter has ``blocks`` blocks of 256 bits at most (2.6 MB as rows at the
    default), so it can be sent to all executors however long the list is; a
    list far beyond blocks * 16 URLs only makes more pages take the exact join.
    """
    own = without(pages, ["host", "path", "rule", "listed", "verdict"])
    exact = listed.select(canonical(F.col("url")).alias("__listed")).filter(F.col("__listed").isNotNull()).distinct()
    block, words = _bits(F.col("__url"), blocks)
    keyed = own.withColumn("__url", canonical(F.col("url"))).withColumns({"__block": block, **{f"__m{i}": w for i, w in enumerate(words)}})
    filled = F.broadcast(bloom(exact, "__listed", blocks))  # bounded by blocks
    probed = keyed.join(filled, F.col("__block") == F.col("block"), "left")
    hit = F.lit(True)
    for i in range(4):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"__m{i}")) != 0)
    probed = probed.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    columns = [column(c) for c in own.columns]
    missed = probed.filter(~F.col("__hit")).select(*columns, F.lit(False).alias("listed"))
    asked = probed.filter("__hit").select(*columns, "__url")
    joined = asked.join(exact, F.col("__url") == F.col("__listed"), "left").select(*columns, F.col("__listed").isNotNull().alias("listed"))
    judged = missed.unionByName(joined).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule = judged.withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return rule.select(*columns, "host", "path", F.col("__rule.rule").alias("rule"), "listed", verdict.alias("verdict"))
