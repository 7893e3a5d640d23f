"""Share of missing field values over time, and alerts where it rises.

Shares are whole parts in a million, so that a batch and a stream, in whatever
order they add up, give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip

MILLION = 1_000_000


def missing_rates(items: DataFrame, fields: list[str], ts: str = "ts", source: str = "platform", every: str = "1 day", late: str | None = None) -> DataFrame:
    """(source, field, start, items, missing, rate): for each source, field and
    stretch of event time how many items lack the field (null or blank) and
    their share in parts of a million.

    On a stream ``late`` has to be given: a stretch comes out, once, when an
    item that much younger than its end has come, and items for it that come
    later still are left out. A batch counts every item."""
    timed = items.withWatermark(ts, late) if late else items
    lacking = [F.coalesce(strip(F.col(f).cast("string")) == "", F.lit(True)) for f in fields]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), m.alias("lacks")) for f, m in zip(fields, lacking, strict=True)])).alias("x")
    counted = timed.select(F.col(source).alias("source"), F.col(ts).alias("ts"), pairs).groupBy(F.window("ts", every).alias("w"), "source", "x.field")
    sums = counted.agg(F.count(F.lit(1)).alias("items"), F.count_if("x.lacks").alias("missing"))
    return sums.select("source", "field", F.col("w.start").alias("start"), "items", "missing", F.expr(f"missing * {MILLION} div items").alias("rate"))


def missing_alerts(rates: DataFrame, slack: int = 20_000, limit: int = 100_000) -> DataFrame:
    """rates with ``expected`` (the mean of the source's and field's earlier
    stretches; its own for the first), ``drift`` and ``alert``.

    Drift adds up how far a share lies above what is expected and ``slack``,
    and falls back to 0 at least; beyond ``limit`` it is an alert. It equals
    the sum so far less the smallest sum before, which needs one ordering of
    the stretches of each source and field, not a walk."""
    run = W.partitionBy("source", "field").orderBy("start")
    before = run.rowsBetween(W.unboundedPreceding, -1)
    known = rates.withColumns({"_n": F.count("rate").over(before), "_sum": F.sum("rate").over(before)})
    expected = F.when(F.col("_n") > 0, F.expr("_sum div _n")).otherwise(F.col("rate"))
    stepped = known.withColumn("expected", expected).withColumn("_step", F.col("rate") - F.col("expected") - slack)
    upto: Column = F.sum("_step").over(run)
    summed = stepped.withColumn("_upto", upto)
    drift = F.col("_upto") - F.least(F.lit(0), F.min("_upto").over(run))
    return summed.withColumn("drift", drift).withColumn("alert", F.col("drift") > limit).drop("_n", "_sum", "_step", "_upto")
