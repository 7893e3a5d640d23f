"""Scans: captured pages, JSON bodies, result files, archive packages, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

# Fixed schema: fields that event lines of any type may carry.
EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("rule", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("current", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("new_count", T.LongType()),
        T.StructField("skip_count", T.LongType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("total_rules", T.LongType()),
        T.StructField("total_new", T.LongType()),
        T.StructField("total_skip", T.LongType()),
        T.StructField("total_error", T.LongType()),
    ]
)


def captured_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(page_id, url, html, ...): one row per captured page."""
    return spark.read.format(fmt).load(path)


def json_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(file, body): one response document per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def place_of(file: Column) -> dict[str, Column]:
    """subject, platform and file name from ``.../<subject>/<platform>/<file>``."""
    pattern = r"([^/]+)/([^/]+)/([^/]+)\z"
    return {n: F.url_decode(F.regexp_extract(file, pattern, i)) for i, n in enumerate(("subject", "platform", "file_name"), start=1)}


def result_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, subject, platform, file_name, modified_at, body) of result files
    at ``<root>/<subject>/<platform>/*.json``, ``combined*`` left out."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(f"{root.rstrip('/')}/*/*/*.json", wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"), F.col("value").alias("body"))
    return rows.withColumns(place_of(F.col("file"))).filter(~F.startswith("file_name", F.lit("combined")))


def is_object_file(body: Column | str) -> Column:
    body = F.col(body) if isinstance(body, str) else body
    return F.startswith(strip(body), F.lit("{"))


def _data_items(body: Column) -> Column:
    parsed = F.try_parse_json(strip(body))
    return F.try_variant_get(parsed, "$.data", "array<variant>")


def _jsonl(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n"), strip), lambda x: x != "")


def result_counts(files: DataFrame, body: str = "body") -> DataFrame:
    """files + ``item_count``: length of ``data`` for an object, number of
    non-blank lines otherwise, 0 for a broken object."""
    b = F.col(body)
    objects = F.coalesce(F.size(_data_items(b)), F.lit(0))
    count = F.when(is_object_file(b), F.greatest(objects, F.lit(0))).otherwise(F.size(_jsonl(b)))
    return files.withColumn("item_count", F.coalesce(count, F.lit(0)))


def result_items(files: DataFrame, keys: list[str], body: str = "body", limit: int | None = None) -> DataFrame:
    """(keys, total, pos, item): items of result files as JSON text. A broken
    object gives no rows, a broken line none but it counts in ``total``."""
    b = F.col(body)
    from_object = F.transform(_data_items(b), lambda v: F.to_json(v))
    all_lines = _jsonl(b)
    from_lines = F.filter(all_lines, lambda x: F.try_parse_json(x).isNotNull())
    rows = files.select(
        *keys,
        F.coalesce(F.when(is_object_file(b), from_object).otherwise(from_lines), F.array().cast("array<string>")).alias("_items"),
        F.greatest(F.when(is_object_file(b), F.coalesce(F.size(from_object), F.lit(0))).otherwise(F.size(all_lines)), F.lit(0)).alias("total"),
    )
    shown = F.col("_items") if limit is None else F.slice("_items", 1, limit)
    return rows.select(*keys, "total", F.posexplode(shown).alias("pos", "item"))


def result_meta(files: DataFrame, body: str = "body") -> DataFrame:
    """Governance values held in the ``meta`` of result files (see
    ``operators.lists.governance_records`` for the defaults)."""
    doc = F.try_parse_json(strip(F.col(body)))
    get = lambda path, kind: F.try_variant_get(doc, path, kind)
    return files.select(
        F.coalesce(get("$.meta.subject", "string"), F.lit("")).alias("subject"), F.coalesce(get("$.meta.platform", "string"), F.lit("")).alias("platform"),
        "file_name", F.greatest(F.coalesce(F.size(_data_items(F.col(body))), F.lit(0)), F.lit(0)).alias("data_count"),
        get("$.meta.governance.item_count", "bigint").alias("item_count"), get("$.meta.governance.duplicate_count", "bigint").alias("duplicate_count"),
        get("$.meta.dedup_filtered", "bigint").alias("dedup_filtered"), get("$.meta.governance.injection_risk_count", "bigint").alias("injection_risk_count"),
        get("$.meta.governance.field_completeness", "double").alias("field_completeness"), get("$.meta.governance.quality_score", "double").alias("quality_score"),
        get("$.meta.governance.status", "string").alias("status"), get("$.meta.collected_at", "string").alias("collected_at"),
    )


def archive_packages(spark: SparkSession, root: str) -> DataFrame:
    """(file, subject, platform, body) of archive packages."""
    raw = spark.read.text(f"{root.rstrip('/')}/*/*/archives/*/page.json", wholetext=True)
    place = r"([^/]+)/([^/]+)/archives/[^/]+/page\.json\z"
    file = F.col("_metadata.file_path")
    return raw.select(
        file.alias("file"), F.url_decode(F.regexp_extract(file, place, 1)).alias("subject"), F.url_decode(F.regexp_extract(file, place, 2)).alias("platform"), F.col("value").alias("body")
    )


def event_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events from JSON lines; blank and invalid lines are dropped. Works on a
    batch and on a stream."""
    others = [c for c in lines.columns if c != value]
    parsed = lines.withColumn("_e", F.from_json(strip(value), EVENT, {"mode": "PERMISSIVE"}))
    valid = F.try_parse_json(strip(value)).isNotNull() & F.startswith(strip(value), F.lit("{"))
    return parsed.filter(valid).select(*others, "_e.*")


def assets_from_files(spark: SparkSession, path: str) -> DataFrame:
    """(storage_uri, size_bytes, content_hash, file_name, extension,
    mime_type) of asset files."""
    from ..operators.archive import extension, file_name, mime_type

    files = spark.read.format("binaryFile").load(path)
    uri = F.col("path")
    return files.select(
        uri.alias("storage_uri"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), file_name(uri).alias("file_name"),
        extension(uri).alias("extension"), mime_type(extension(uri)).alias("mime_type"),
    )


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, modified_at, content) of log files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified_at"), F.col("value").alias("content"))
