"""Writes that show whole or not at all, and once however often they are tried.

The rows of a unit of work (a run) go to folders of their attempt, table by
table; nothing reads them yet. One line in the manifest then names the attempt
for all its tables. Readers take for each unit the attempt that was named last,
so a write that broke off is not seen, and one that is repeated replaces the
first. Appending a file is all that is asked of the storage.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT, ATTEMPT, COMMITTED = "_unit", "_attempt", "_committed_at"
_MANIFEST = "_commits"
_LINE = "unit string, attempt string, committed_at timestamp, tables map<string,string>"


def commit(tables: dict[str, DataFrame], root: str, unit: str, partition: list[str] | None = None, fmt: str = "parquet") -> str:
    """Write the rows of a unit to ``root``/table and name them in the
    manifest; the attempt's name. Tables without rows are named as well."""
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        staged = rows.withColumns({UNIT: F.lit(unit), ATTEMPT: F.lit(attempt)})
        with _open_writers(spark, fmt):
            staged.write.mode("append").partitionBy(UNIT, ATTEMPT, *(partition or [])).format(fmt).save(f"{root}/{name}")
    schemas = {name: rows.schema.json() for name, rows in tables.items()}
    line = spark.createDataFrame([(unit, attempt, datetime.now(timezone.utc), schemas)], _LINE)
    line.coalesce(1).write.mode("append").json(f"{root}/{_MANIFEST}")
    return attempt


@contextmanager
def _open_writers(spark: SparkSession, fmt: str) -> Iterator[None]:
    """Lines go to a few open files side by side, rather than be sorted by
    folder first; files of other formats hold much in memory until they close."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    old = spark.conf.get(key)
    if fmt == "json":
        spark.conf.set(key, "32")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _lines(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LINE).json(f"{root}/{_MANIFEST}")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commits(spark: SparkSession, root: str) -> DataFrame | None:
    """(unit, attempt, committed_at, tables) of the attempt that holds for each
    unit; None where nothing has been committed."""
    lines = _lines(spark, root)
    if lines is None:
        return None
    last = F.max_by(F.struct("attempt", "committed_at", "tables"), F.struct("committed_at", "attempt"))
    return lines.groupBy("unit").agg(last.alias("l")).select("unit", "l.*")


def committed(spark: SparkSession, root: str, table: str, fmt: str = "parquet", origin: bool = False, place: str | None = None) -> DataFrame | None:
    """The rows of a table that hold; with ``origin`` also the unit that wrote
    them and when. None for a table that no unit has written. ``place`` names
    a column that numbers the rows of all files as they are read: no filter
    goes below it, so each use of the table within one query numbers alike.

    The table has the columns that the unit committed last gave it."""
    units = commits(spark, root)
    named = None if units is None else units.filter(F.col("tables")[table].isNotNull())
    newest = None if named is None else named.orderBy(F.desc("committed_at"), F.desc("attempt")).first()
    if newest is None:
        return None
    schema = T.StructType.fromJson(json.loads(newest["tables"][table]))
    marks = [UNIT, ATTEMPT]
    try:
        rows = spark.read.schema(T.StructType([*schema.fields, *[T.StructField(m, T.StringType()) for m in marks]])).format(fmt).load(f"{root}/{table}")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], T.StructType([*schema.fields, *[T.StructField(m, T.StringType()) for m in marks]]))
    rows = rows.withColumn(place, F.monotonically_increasing_id()) if place else rows
    own = named.select(F.col("unit").alias(UNIT), F.col("attempt").alias(ATTEMPT), F.col("committed_at").alias(COMMITTED))
    held = rows.join(own, marks)
    return held.select(*schema.names, *([UNIT, COMMITTED] if origin else []), *([place] if place else []))
