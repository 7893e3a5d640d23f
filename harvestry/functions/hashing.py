"""Content hashes and SimHash fingerprints as native expressions."""

from __future__ import annotations

from collections import Counter
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _WS, col


def _quoted(x: Column) -> Column:
    """Text as a Python string literal, the form list values take in a hash."""
    body = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    single, double = F.contains(x, F.lit("'")), F.contains(x, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def _as_text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(_quoted(x.cast("string")), F.lit("None"))), ", "), F.lit("]"))
        return F.coalesce(shown, F.lit("None"))
    if isinstance(field.dataType, T.BooleanType):
        return F.when(c, "True").when(~c, "False").otherwise("None")
    return F.coalesce(c.cast("string"), F.lit("None"))


def record_hash(df: DataFrame, fields: list[str]) -> Column:
    """sha256 over ``key=value`` lines with sorted keys; ``_`` keys skipped."""
    chosen = sorted(f for f in fields if not f.startswith("_"))
    parts = [F.concat(F.lit(f + "="), _as_text(df.schema[f])) for f in chosen]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def page_hash(source_url: Column, final_url: Column, html: Column, markdown: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(x, F.lit("")) for x in (source_url, final_url, html, markdown)]), 256)


def body_hash(html: Column, markdown: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(html, F.lit("")), F.lit("\n"), F.coalesce(markdown, F.lit(""))), 256)


def variant_hash(content_hash: Column, ocr_engine: Column) -> Column:
    """Hash of one page as read by one recogniser."""
    h, e = F.coalesce(content_hash, F.lit("")), F.coalesce(ocr_engine, F.lit(""))
    return F.when((h != "") & (e != ""), F.sha2(F.concat(h, F.lit("\nocr_engine:"), e), 256)).otherwise(content_hash)


def simhash_tokens(c: Column | str) -> Column:
    """White-space segments; one that starts with a CJK ideograph is split
    into characters, any other stays whole."""
    segments = F.split(F.coalesce(col(c), F.lit("")), rf"(?U){_WS}+")
    pieces = F.transform(
        segments,
        lambda s: F.when(s.rlike(r"\A[\x{4e00}-\x{9fff}]"), F.regexp_extract_all(s, F.lit(r"(?s)."), F.lit(0))).otherwise(F.array(s)),
    )
    return F.filter(F.flatten(pieces), lambda t: t != "")


_CHUNK = 1 << 16


def _fingerprint(text: str | None) -> int:
    """Vote of the low 64 bits of sha256 over all tokens; ties give 0."""
    tokens: Counter[str] = Counter((text or "").split())
    for segment in [s for s in tokens if "\u4e00" <= s[0] <= "\u9fff"]:
        n = tokens.pop(segment)
        for character in segment:
            tokens[character] += n
    votes = np.zeros(64, np.int64)
    items = iter(tokens.items())
    while chunk := list(islice(items, _CHUNK)):
        low = b"".join([sha256(t.encode("utf-8", "replace")).digest()[24:] for t, _ in chunk])
        bits = np.unpackbits(np.frombuffer(low, np.uint8).reshape(-1, 8), axis=1)
        votes += np.fromiter((n for _, n in chunk), np.int64, len(chunk)) @ bits.astype(np.int64)
    bits = votes * 2 > sum(tokens.values())
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


@F.arrow_udf(T.LongType())
def _simhash_batch(texts: pa.Array) -> pa.Array:
    return pa.array([_fingerprint(t) for t in texts.to_pylist()], pa.int64())


def simhash64(text: Column | str) -> Column:
    """64-bit SimHash as a signed long; 0 for a text without tokens.

    A narrow Arrow function: one long per row leaves the task. Exploding the
    tokens and summing 64 votes natively was measured at five times the cost
    and needs a shuffle.
    """
    # Never NULL: a join on it then infers no IS NOT NULL filter, which would
    # be pushed below the function and run it twice.
    return F.coalesce(_simhash_batch(col(text)), F.lit(0).cast("bigint"))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def is_near(a: Column | str, b: Column | str, threshold: int = 3) -> Column:
    return hamming(a, b) <= threshold
