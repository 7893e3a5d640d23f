"""Large line files, read in splits by several tasks, with line numbers.

A split knows its lines but not how many lie before it in the file. Counts of
all splits, one row each, are summed up in order of their bytes, and what a
split's first line is numbered comes back to its lines by a small join: lines
themselves neither move nor are sorted. With ``parts`` the files of a folder
are one, in the order of their names, as Spark's writers leave them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip


def _before(lines: DataFrame, **counts: Column) -> DataFrame:
    """(_part, _split, _first) with, for each count, what the splits before it
    in the file hold of it (name) and the whole file (name_all). The first
    count's lines, numbered alone, start at ``_start`` in the split."""
    sums = lines.groupBy("file", "_part", "_split").agg(F.min("_row").alias("_first"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    file = W.partitionBy("file").orderBy("_part", "_split").rowsBetween(W.unboundedPreceding, -1)
    # A task's rows are numbered without a gap, one of its splits after the other.
    task = F.shiftright("_first", 33)
    before = F.sum(next(iter(counts))).over(W.partitionBy(task).orderBy("_first").rowsBetween(W.unboundedPreceding, -1))
    start = (F.shiftleft(task, 33) + F.coalesce(before, F.lit(0))).alias("_start")
    earlier = [F.coalesce(F.sum(n).over(file), F.lit(0)).alias(n) for n in counts]
    # A row for each split: fewer than the driver holds to deal the splits out.
    return F.broadcast(sums.select("_part", "_split", start, *earlier, *[F.sum(n).over(W.partitionBy("file")).alias(f"{n}_all") for n in counts]))


def _lines(spark: SparkSession, path: str, parts: bool) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    file = F.lit(path) if parts else meta["file_path"]
    return raw.select(file.alias("file"), meta["file_path"].alias("_part"), meta["file_block_start"].alias("_split"), F.col("value").alias("line"))


def _numbered(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_row", F.monotonically_increasing_id())


def file_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, total, line_no, line) of every line of the files under path."""
    lines = _numbered(_lines(spark, path, parts))
    placed = _before(lines, n=F.lit(True))
    number = F.col("n") + F.col("_row") - F.col("_start") + 1
    return lines.join(placed, ["_part", "_split"]).select("file", F.col("n_all").alias("total"), number.alias("line_no"), "line")


def file_tail(spark: SparkSession, path: str, n: int = 100, parts: bool = False) -> DataFrame:
    """The last n lines of each file, as ``file_lines`` gives them."""
    return file_lines(spark, path, parts).filter(F.col("line_no") > F.col("total") - n)


def line_items(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, total, pos, item) of JSON-line files: the readable lines in their
    order, from 0, and the number of lines that aren't blank."""
    lines = _lines(spark, path, parts).withColumn("line", strip("line"))
    readable = F.try_parse_json("line").isNotNull()
    placed = _before(_numbered(lines), good=readable, n=F.col("line") != "")
    good = _numbered(lines.filter(readable)).join(placed, ["_part", "_split"])
    return good.select("file", F.col("n_all").alias("total"), (F.col("good") + F.col("_row") - F.col("_start")).alias("pos"), F.col("line").alias("item"))
