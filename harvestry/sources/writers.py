"""Sinks: governed results, run tables, archive tables, packages, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_per_key
from ..operators.lists import top_per_key
from ..session import cut_lineage
from . import commits

_RESULT_KEYS = ("subject", "platform", "collected_date", "run_id")


def save_results(governed: DataFrame, path: str, run_id: str, rule_name: str | None = None, collected_at: Column | None = None, dedup_filtered: int = 0, summary: DataFrame | None = None) -> bool:
    """Write governed items under subject / platform / collected_date; nothing
    at all for an empty run. A repeated run replaces its own files only.

    With each place goes a meta record: subject, platform, rule_name,
    collected_at (now, unless given), count, dedup_filtered and, from the
    run's one-row ``summary``, the governance figures (see ``result_meta``)."""
    if governed.isEmpty():
        return False
    rows = governed.withColumn("run_id", F.lit(run_id)).filter(F.assert_true(F.coalesce("subject", F.lit("")) != "", "no subject").isNull())
    _replace(rows, path, _RESULT_KEYS)
    counts = rows.groupBy(*_RESULT_KEYS).agg(F.count(F.lit(1)).alias("count"))
    meta = counts.withColumns({"rule_name": F.lit(rule_name).cast("string"), "collected_at": collected_at if collected_at is not None else F.current_timestamp(), "dedup_filtered": F.lit(dedup_filtered).cast("bigint")})
    if summary is not None:
        meta = meta.crossJoin(F.broadcast(summary.limit(1).select(F.struct(*[c for c in summary.columns if c != "run_id"]).alias("governance"))))
    _replace(meta, f"{path}/_meta", _RESULT_KEYS)
    return True


def _replace(rows: DataFrame, path: str, partition: tuple[str, ...]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def result_meta(spark: SparkSession, path: str) -> DataFrame:
    """The meta records of the results under ``path``, one for each run and place."""
    return spark.read.parquet(f"{path}/_meta")


def combined_meta(latest: DataFrame, meta: DataFrame) -> DataFrame:
    """(subject, platform, collected_at, count) of each subject's combined
    view: the latest time at which any of its results was collected, and the
    items in the view (0 where every item lacks a URL)."""
    newest = meta.groupBy("subject").agg(F.max("collected_at").alias("collected_at"))
    sizes = latest.groupBy("subject").agg(F.count(F.lit(1)).alias("_n"))
    return newest.join(sizes, "subject", "left").select("subject", F.lit("combined").alias("platform"), "collected_at", F.coalesce("_n", F.lit(0)).alias("count"))


def combined_latest(items: DataFrame, files: int | None = None) -> DataFrame:
    """Newest view per subject over its files (the ``files`` newest, if a number is given): the first item
    per URL, newest file first; items without a URL are left out.

    ``items(subject, file, modified_at, pos, url, ...)``. ``combined_meta``
    gives the view's meta record.
    """
    kept = items.filter(F.coalesce("url", F.lit("")) != "")
    if files is not None:
        listed = items.select("subject", "file", "modified_at").distinct()
        newest = top_per_key(listed, ["subject"], [F.col("modified_at").desc(), F.col("file").desc()], files)
        kept = kept.join(newest.select("subject", "file"), ["subject", "file"], "left_semi")
    ranked = kept.withColumn("_age", -F.unix_micros("modified_at"))
    return first_per_key(ranked, ["subject", "url"], ["_age", "file", "pos"]).drop("_age")


def save_run_tables(tables: dict[str, DataFrame], root: str, run_id: str) -> str:
    """Commit the tables of a run as one unit: all of its rows show at once,
    and a repeated run replaces its first rows. Read them with
    ``commits.committed``."""
    return commits.commit(tables, root, run_id)


def save_archive(tables: dict[str, DataFrame], root: str, unit: str) -> str:
    """Commit the archive tables of a run as one unit, with pages whose
    content hash no other unit has archived, each once, and what belongs to
    them. Read them with ``read_archive``."""
    every = tables["archive_pages"]
    own = first_per_key(every.select("content_hash", "source_url", F.col("id").alias("page_id")), ["content_hash"], ["source_url"]).select("page_id", "content_hash")
    known = commits.committed(every.sparkSession, root, "archive_pages", origin=True)
    if known is not None:
        others = known.filter(F.col(commits.UNIT) != unit).select("content_hash")
        own = own.join(others, "content_hash", "left_anti").select("page_id", "content_hash")
    # What is new is worked out once for all tables.
    own = cut_lineage(own)
    pages = first_per_key(every.join(own.select("content_hash"), "content_hash", "left_semi").select(*every.columns), ["content_hash"], ["source_url"])
    return commits.commit(_belonging(tables | {"archive_pages": pages}, own), root, unit)


def _belonging(tables: dict[str, DataFrame], pages: DataFrame) -> dict[str, DataFrame]:
    """Tables with the rows that belong to pages (page_id, content_hash), ids once."""
    out = {}
    for name, rows in tables.items():
        if name != "archive_pages":
            key = "page_id" if "page_id" in rows.columns else "content_hash"
            rows = rows.join(pages.select(key), key, "left_semi").select(*rows.columns)
            rows = rows.dropDuplicates(["id"]) if "id" in rows.columns else rows.dropDuplicates(["page_id", "ocr_no"]) if "ocr_no" in rows.columns else rows
        out[name] = rows
    return out


ARCHIVE_TABLES = ("archive_pages", "archive_blocks", "archive_assets", "ocr_results", "structured_records")


def read_archive(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The committed archive tables. A content hash is one page even if two
    runs archived it side by side: the one committed first holds."""
    found = {name: commits.committed(spark, root, name, origin=True) for name in ARCHIVE_TABLES}
    tables = {name: rows for name, rows in found.items() if rows is not None}
    if "archive_pages" not in tables:
        return {}
    pages = tables["archive_pages"]
    mark = F.struct(commits.COMMITTED, commits.UNIT)
    holds = pages.groupBy("content_hash").agg(F.min(mark).alias("m")).select("content_hash", F.col(f"m.{commits.UNIT}").alias(commits.UNIT))
    own = pages.join(holds, ["content_hash", commits.UNIT], "left_semi")
    ids = own.select(F.col("id").alias("page_id"), "content_hash", commits.UNIT)
    out = {}
    for name, rows in tables.items():
        if name != "archive_pages":
            key = "page_id" if "page_id" in rows.columns else "content_hash"
            rows = rows.join(ids.select(key, commits.UNIT), [key, commits.UNIT], "left_semi")
        else:
            rows = own
        out[name] = rows.select(*[c for c in tables[name].columns if c not in (commits.UNIT, commits.COMMITTED)])
    return out


def package_rows(pages: DataFrame) -> DataFrame:
    """One row per page for the debug package; fails on a missing hash."""
    checked = pages.filter(F.assert_true(F.coalesce("meta.content_hash", F.lit("")) != "", "content_hash is missing").isNull())
    return checked.select(F.col("meta.subject").alias("subject"), F.col("meta.platform").alias("platform"), F.col("meta.content_hash").alias("content_hash"),
                          "meta", "content", "blocks", "assets", "ocr_results")


def save_packages(pages: DataFrame, root: str, unit: str) -> str:
    """Commit the debug packages of a run as JSON, a line each, under their
    subject and platform."""
    return commits.commit({"packages": package_rows(pages)}, root, unit, ["subject", "platform"], "json")


def read_packages(spark: SparkSession, root: str) -> DataFrame | None:
    """The committed packages, one for each content hash: the newest.

    Packages are told by the place where they are read, and a hash table of
    places picks them, so that no whole package is ever sorted."""
    rows = commits.committed(spark, root, "packages", "json", origin=True, place="_place")
    if rows is None:
        return None
    newest = rows.groupBy("content_hash").agg(F.max(F.struct(commits.COMMITTED, commits.UNIT, "_place")).alias("m")).select("content_hash", "m._place")
    return rows.join(newest.hint("shuffle_hash"), ["content_hash", "_place"], "left_semi").drop(commits.UNIT, commits.COMMITTED, "_place")


# Fields of each event type, after type and ts.
EVENT_FIELDS = {
    "start": ("rule",),
    "status": ("rule", "status", "msg"),
    "progress": ("rule", "phase", "current", "total"),
    "item": ("rule", "data"),
    "error": ("rule", "message", "detail"),
    "skip": ("rule", "reason"),
    "complete": ("rule", "new_count", "skip_count", "duration"),
    "summary": ("total_rules", "total_new", "total_skip", "total_error", "duration"),
}


def event_json(kind: str, ts: Column, **values: Column) -> Column:
    """One event as a JSON line; durations have two digits."""
    fields = [F.lit(kind).alias("type"), ts.cast("bigint").alias("ts")]
    for name in EVENT_FIELDS[kind]:
        value = values.get(name, F.lit(None).cast("string"))
        fields.append((F.round(value, 2) if name == "duration" else value).alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def save_events(events: DataFrame, path: str, unit: str, value: str = "value") -> None:
    """Write the event lines of a run; a repeated run replaces its own."""
    lines = events.select(F.col(value).alias("value"), F.lit(unit).alias(commits.UNIT))
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(commits.UNIT).text(path)


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``existing`` with the same key."""
    return existing.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)
