"""URL resolution and redirect decoding."""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col, unescape


@F.arrow_udf(T.StringType())
def _join_batch(base: pa.Array, ref: pa.Array) -> pa.Array:
    out = []
    for b, r in zip(base.to_pylist(), ref.to_pylist()):
        out.append(_joined(b or "", r))
    return pa.array(out, pa.string())


def resolve_url(base: Column | str, ref: Column | str) -> Column:
    """RFC 3986 resolution.

    The forms that fill real link lists (absolute, ``//host``, ``/path``
    without dot segments, fragments, empty) are native; only dot segments and
    plain relative paths are sent to Python.
    """
    b, r = F.coalesce(col(base), F.lit("")), col(ref)
    scheme = F.regexp_extract(b, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(b, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    hierarchical = origin != ""
    dots = r.rlike(r"(\A|/)\.\.?(/|\z|\?|#)")
    absolute = r.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/|\z)") & ~dots & ~r.rlike(r"[#?]\z")
    rooted = F.startswith(r, F.lit("/")) & ~F.startswith(r, F.lit("//")) & hierarchical & ~dots & ~r.rlike(r"[#?]\z|\A/[?#]")
    native = (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(r == "", b)
        .when(b == "", r)
        .when(absolute, r)
        .when(r.rlike(r"\A//[^/?#]+(/|\z)") & (scheme != "") & ~dots & ~r.rlike(r"[#?]\z"), F.concat(scheme, F.lit(":"), r))
        .when(rooted, F.concat(origin, r))
    )
    settled = (r.isNull()) | (r == "") | (b == "") | native.isNotNull()
    return F.coalesce(native, _join_batch(F.when(~settled, b), F.when(~settled, r)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _join_lists(base: pa.Array, refs: pa.Array) -> pa.Array:
    out = []
    for b, many in zip(base.to_pylist(), refs.to_pylist()):
        out.append(None if many is None else [_joined(b or "", r) for r in many])
    return pa.array(out, pa.list_(pa.string()))


def _joined(base: str, ref: str | None) -> str | None:
    try:
        return None if ref is None else urljoin(base, ref)
    except ValueError:
        return ref


def resolve_urls(base: Column | str, refs: Column) -> Column:
    """``resolve_url`` for every element of an array column."""
    return _join_lists(col(base), F.when(F.size(refs) > 0, refs))


def domain_of(url: Column | str, platform: Column | str) -> Column:
    """Network location (port and user part kept), else the platform."""
    netloc = F.regexp_extract(F.coalesce(col(url), F.lit("")), r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.when(netloc != "", netloc).otherwise(col(platform))


def hostname_of(url: Column | str) -> Column:
    netloc = F.regexp_extract(F.coalesce(col(url), F.lit("")), r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r"\A.*@", ""), r":\d*\z", ""))


def decode_redirect(url: Column | str) -> Column:
    """Target of a redirect link whose ``url`` query value is base64 text,
    percent-encoded, with dots as extra padding. The link itself on failure."""
    link = unescape(url)
    param = F.regexp_extract(link, r"[?&]url=([^&#]+)", 1)
    value = F.try_url_decode(F.try_url_decode(F.when(param != "", param)))
    value = F.regexp_replace(value, r"\.+\z", "")
    value = F.when(F.length(value) % 4 == 0, value).otherwise(F.rpad(value, (F.ceil(F.length(value) / 4) * 4).cast("int"), F.lit("=")))
    target = F.decode(F.try_to_binary(value, F.lit("base64")), "UTF-8")
    return F.coalesce(target, link)


URL_TRANSFORMS = {"sogou_link": decode_redirect}


def transform_url(url: Column | str, name: str | None) -> Column:
    return URL_TRANSFORMS[name](url) if name in URL_TRANSFORMS else col(url)
