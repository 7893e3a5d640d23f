"""Column functions for cleaning and measuring text."""

from __future__ import annotations

import html as _html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that str.strip() and str.split() count as space.
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE_SPACE = "".join(map(chr, _SPACES))
# The same as a character class, for splitting.
_WS = r"[\s\x1c-\x1f]"
_TAG = r"<[^>]+>"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

# Prompt-injection phrases, matched case-insensitively.
INJECTION_PHRASES = (
    "ignore previous instructions",
    "忽略之前的指令",
    "system prompt",
    "developer message",
)
# Fixed value: characters trimmed from a field after phrase removal.
INJECTION_TRIM = " 。.，,"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside a larger expression.

    Sub-expressions inside a lambda are evaluated per element; going through a
    one-element array makes the value a lambda variable, computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(df: DataFrame, keep: list, array: Column | str, name: str, position: str = "_no") -> DataFrame:
    """(keep, position, name): a row per element, none for an empty array.

    Spark infers ``size(array) > 0`` from a plain explode and pushes it down to
    the scan, where it works out a costly array a second time, before the rows
    have been dealt out; from an outer explode it infers nothing.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).filter(F.col(position).isNotNull())


def strip(c: Column | str) -> Column:
    """Trim Unicode white space on both ends (plain ``trim`` only takes
    U+0020). Looks at the ends alone, so long texts cost nothing extra."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def words(c: Column | str) -> Column:
    """White-space split without empty parts."""
    return F.filter(F.split(col(c), rf"(?U){_WS}+"), lambda w: w != "")


def collapse_ws(c: Column | str) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.array_join(words(F.coalesce(col(c), F.lit(""))), " ")


def lines(c: Column | str) -> Column:
    """Non-blank lines, each trimmed."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def strip_html(c: Column | str) -> Column:
    return F.regexp_replace(col(c), _TAG, "")


def epoch_to_iso(c: Column | str) -> Column:
    """Epoch seconds, or milliseconds above 1e12, to ISO text in the session
    zone. Values that are no integer come back unchanged."""
    raw = col(c).cast("string")
    value = F.when(raw.rlike(r"\A\s*[+-]?\d+\s*\z"), F.trim(raw).try_cast("bigint"))
    seconds = F.when(value > F.lit(10**12), value.cast("double") / 1000).otherwise(value.cast("double"))
    micros = F.round(seconds * 1_000_000).cast("bigint")
    ts = F.timestamp_micros(micros)
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.pmod(micros, F.lit(1_000_000))
    iso = F.when(frac == 0, base).otherwise(F.concat(base, F.lit("."), F.lpad(frac.cast("string"), 6, "0")))
    return F.when((value == 0) | value.isNull(), raw).otherwise(F.coalesce(iso, raw))


@F.arrow_udf(T.StringType())
def _unescape_batch(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else _html.unescape(v) for v in values.to_pylist()], pa.string())


def unescape(c: Column | str) -> Column:
    """HTML5 entity decoding. Only values that hold an ampersand cross to
    Python; the others stay on the JVM side as they are."""
    value = col(c)
    return F.coalesce(_unescape_batch(F.when(F.contains(value, F.lit("&")), value)), value)


def clean_value(c: Column | str, sanitize: bool = True) -> Column:
    """Entities, then tags, then control characters, then white space."""
    value = unescape(c)
    if sanitize:
        value = F.regexp_replace(strip_html(value), _CONTROL, "")
    return strip(value)


def string_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def clean_record(df: DataFrame, fields: list[str] | None = None, sanitize: bool = True) -> DataFrame:
    """Clean the string fields of a record; other types are left alone."""
    strings = set(string_fields(df))
    picked = [f for f in (fields or df.columns) if f in strings and not f.startswith("_")]
    return df.withColumns({f: clean_value(f, sanitize) for f in picked})


def record_text(fields: list[str]) -> Column:
    """String values joined by a space, in field order; NULL is skipped."""
    return F.concat_ws(" ", *[F.col(f) for f in fields])


def has_injection(fields: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.col(f) for f in fields]))
    hit = F.lit(False)
    for phrase in INJECTION_PHRASES:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def remove_injection(c: Column | str) -> Column:
    pattern = "(?iu)" + "|".join(INJECTION_PHRASES)
    return F.btrim(F.regexp_replace(col(c), pattern, ""), F.lit(INJECTION_TRIM))


def cell_text(c: Column | str) -> Column:
    return collapse_ws(c)


def markdown_cell(c: Column | str) -> Column:
    return F.replace(collapse_ws(c), F.lit("|"), F.lit("\\|"))


def first_integer(c: Column | str) -> Column:
    """First run of digits, else the trimmed text."""
    value = F.coalesce(col(c), F.lit(""))
    hit = F.regexp_extract(value, r"\d+", 0)
    return F.when(hit != "", hit).otherwise(strip(value))


def is_integer_text(c: Column | str) -> Column:
    return F.coalesce(strip(c).rlike(r"\A\d+\z"), F.lit(False))


def normalize_rule_path(c: Column | str, root: str = "") -> Column:
    """Rule path relative to ``root`` with forward slashes."""
    path = F.coalesce(col(c), F.lit(""))
    if root:
        prefix = root.rstrip("/") + "/"
        path = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    return F.replace(path, F.lit("\\"), F.lit("/"))


# Stored task status to canonical state.
TASK_STATES = {
    "running": "RUNNING",
    "success": "SUCCESS",
    "completed": "SUCCESS",
    "failed": "FAILED",
    "cancelled": "CANCELLED",
    "partial_success": "PARTIAL_SUCCESS",
}


def task_state(c: Column | str, states: dict[str, str] | None = None) -> Column:
    """Canonical task state, PENDING when unknown."""
    table = F.create_map(*[F.lit(x) for kv in (states or TASK_STATES).items() for x in kv])
    return F.coalesce(table[F.lower(col(c))], F.lit("PENDING"))


def duration_seconds(started: Column | str, finished: Column | str, digits: int) -> Column:
    millis = lambda c: F.unix_millis(col(c).cast("timestamp"))
    return F.round((millis(finished) - millis(started)) / 1000, digits)


def run_status(enabled: Column, error: Column, governance_status: Column) -> Column:
    return (
        F.when(~F.coalesce(enabled, F.lit(True)), "skipped")
        .when(F.coalesce(error, F.lit("")) != "", "failed")
        .when(governance_status == "PARTIAL_SUCCESS", "partial_success")
        .otherwise("success")
    )


def json_safe(df: DataFrame) -> DataFrame:
    """Dates and timestamps to ISO text, decimals to double, at any depth."""

    def convert(c: Column, dt: T.DataType) -> Column:
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(c, "SSSSSS")
            return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))
        if isinstance(dt, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(dt, T.DecimalType):
            return c.cast("double")
        if isinstance(dt, T.ArrayType):
            return F.transform(c, lambda x: convert(x, dt.elementType))
        if isinstance(dt, T.MapType):
            return F.transform_values(c, lambda _k, v: convert(v, dt.valueType))
        if isinstance(dt, T.StructType):
            packed = F.struct(*[convert(c[f.name], f.dataType).alias(f.name) for f in dt])
            return F.when(c.isNotNull(), packed)
        return c

    return df.select(*[convert(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
