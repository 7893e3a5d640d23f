"""Mix sources to target weights with nested hash thresholds, natively.

Every document has a fixed draw, a hash of its id and text. A source that is
to give r times its size gives every document floor(r) times and once more
those whose draw lies below a threshold. The threshold comes from histograms:
sizes are summed by source and draw bucket, the running sum finds the bucket
in which the budget ends, and only the rows of that bucket are summed again by
finer buckets, until it holds one draw. Nothing is sorted but bucket sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import column, without, written

DRAW_BITS = 60


def draw(doc_id: Column, text: Column) -> Column:
    """A number of 60 bits that depends on the id and the text alone, so that
    reruns agree and copies under other ids have draws of their own."""
    content = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(content), 1, DRAW_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size) with ``target``: the sum of all sizes shared by
    weight, where no source gets more than cap times its size and the excess
    goes to the others by weight until none is above.

    weights repeat over the sources in code-point order, null last. A source
    of size 0 gets 0. One row for each source, so the windows stay small.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = sources.withColumns({"__w": weight, "__cap": F.lit(float(cap)) * F.col("source_size")}).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    # Filled in the order of cap by weight, all sources before the level that
    # the rest can share evenly are full.
    fill = W.orderBy("__ratio", F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    levels = caps.withColumn("__level", level)
    share = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level"))).over(W.partitionBy())
    filled = levels.withColumn("__share", share)
    target = F.when(F.col("__ratio") < F.col("__share.__ratio"), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__share.__level") * F.col("__w")))
    return filled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def thresholds(sized: DataFrame, sources: DataFrame, level_bits: int) -> DataFrame:
    """For each source ``copies``, ``below`` and ``some``: a document is taken
    copies times, and once more if its draw is less than ``below``, or if it is
    one of ``some`` rows whose draw is ``below``.

    sized: (source, draw, size). The documents that are taken once more are
    those, in draw order, whose middle lies within the budget, so a source
    misses its budget by half a document at most. Of rows of equal draw (equal
    in id and text) as many are taken as have their middle there.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = sources.withColumn("copies", F.floor(ratio).cast("int")).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    state = cut_lineage(state.withColumns({"bucket": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "below": F.lit(None).cast("long"), "some": F.lit(0).cast("long"), "done": F.lit(False)}))
    for level in range(1, DRAW_BITS // level_bits + 1):
        shift = DRAW_BITS - level * level_bits
        bounds = state.filter(~F.col("done")).select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), "before", "budget")
        inside = F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("draw", shift + level_bits) == F.col("__b"))
        sums = (
            sized.join(bounds, inside)
            .groupBy("source", F.shiftright("draw", shift).alias("bucket"))
            .agg(F.sum("size").alias("in_bucket"), F.count(F.lit(1)).alias("rows"), F.min("draw").alias("least"), F.max("draw").alias("most"), F.first("before").alias("before"), F.first("budget").alias("budget"))
        )
        running = F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket"))  # at most 2 ** level_bits rows a source
        at_end = sums.withColumn("before", F.col("before") + running - F.col("in_bucket")).filter(F.col("before") + F.col("in_bucket") > F.col("budget"))
        end = at_end.groupBy("source").agg(F.min(F.struct("bucket", "before", "in_bucket", "rows", "least", "most")).alias("e")).select(F.col("source").alias("__s"), F.lit(True).alias("__found"), "e.*")
        single = F.col("e.least") == F.col("e.most")
        # Equal rows have one size: the k-th lies within while before + (k - 1/2) * size does.
        own_size = F.col("e.in_bucket") / F.col("e.rows")
        fitting = F.floor(F.try_divide(F.col("s.budget") - F.col("e.before"), own_size) + 0.5)
        taken = F.greatest(F.lit(0), F.least(F.col("e.rows"), F.coalesce(fitting, F.col("e.rows")))).cast("long")
        fresh = F.col("__found")
        open_ = ~F.col("s.done")
        state = cut_lineage(
            state.alias("s")
            .join(end.alias("e"), F.col("s.source").eqNullSafe(F.col("e.__s")), "left")
            .select(
                *[F.col(f"s.{c}") for c in ("source", "source_size", "target", "copies", "budget")],
                F.coalesce(F.when(open_, F.col("e.bucket")), F.col("s.bucket")).alias("bucket"),
                F.coalesce(F.when(open_, F.col("e.before")), F.col("s.before")).alias("before"),
                F.when(open_ & fresh & single, F.col("e.least") + (taken == F.col("e.rows")).cast("long")).otherwise(F.col("s.below")).alias("below"),
                F.when(open_ & fresh & single & (taken < F.col("e.rows")), taken).otherwise(F.col("s.some")).alias("some"),
                (F.col("s.done") | F.coalesce(~fresh | single, F.lit(True))).alias("done"),
            )
        )
        if state.filter(~F.col("done")).isEmpty():
            break
    # No bucket reaches beyond the budget: only of sources without any size.
    return state.select("source", "source_size", "target", "copies", F.coalesce("below", F.lit(0).cast("long")).alias("below"), "some")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (__source, ...) with ``__nth``, a number from 1 within the source:
    places within each of the table's parts, plus the rows of the parts before.
    No part's order matters, as rows of a source are equal here."""
    placed = written(rows.withColumns({"__part_no": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    in_part = F.row_number().over(W.partitionBy("__source", "__part_no").orderBy("__row"))
    sizes = placed.groupBy("__source", "__part_no").agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(W.partitionBy("__source").orderBy("__part_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select(F.col("__source").alias("__s"), F.col("__part_no").alias("__p"), earlier.alias("__before"))
    joined = placed.withColumn("__in", in_part).join(before, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__part_no") == F.col("__p")))
    return joined.withColumn("__nth", F.col("__before") + F.col("__in"))


def mix(docs: DataFrame, size: Column, weights: Sequence[int] = (5, 2, 1), cap: int = 3, level_bits: int = 12) -> DataFrame:
    """Every row with ``source_size``, ``target`` and ``copies``: how often
    the mix takes the document (0 to cap).

    docs need doc_id, text and source; size is what a document counts for.
    Rows of a null source form a source of their own, ordered last. Null ids
    and texts count as the texts ``null`` and empty; rows equal in both share
    one draw, and where the budget ends among them, as many are taken as it
    holds (which of them doesn't matter, they are equal). Documents of size 0 are taken or not like
    others. An empty table gives an empty result. Input columns named
    source_size, target or copies are replaced. The driver learns only whether
    a source is still open. level_bits: histogram levels split a bucket into
    2 ** level_bits.
    """
    own = without(docs, ["source_size", "target", "copies"])
    sized = written(own.select("source", draw(F.col("doc_id"), F.col("text")).alias("draw"), size.alias("size")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    # A table whose size Spark knows: it is sent to all tasks while it is small
    # enough for that, and joined by a shuffle beyond.
    limits = written(thresholds(sized, sources, level_bits).select(F.col("source").alias("__source"), "source_size", "target", F.col("copies").alias("__copies"), "below", F.col("some").alias("__some")))
    own_draw = draw(F.col("doc_id"), F.col("text"))
    joined = own.join(limits, F.col("source").eqNullSafe(F.col("__source")))
    copies = F.least(F.lit(cap), F.col("__copies") + (own_draw < F.col("below")).cast("int"))
    results = [*[column(c) for c in own.columns], "source_size", "target"]
    whole = joined.select(*results, copies.alias("copies"))
    if limits.filter("__some > 0").isEmpty():
        return whole
    split = (F.col("__some") > 0) & (own_draw == F.col("below"))
    others = joined.filter(~split).select(*results, copies.alias("copies"))
    some = F.least(F.lit(cap), F.col("__copies") + (F.col("__nth") <= F.col("__some")).cast("int"))
    return others.unionAll(_numbered(joined.filter(split)).select(*results, some.alias("copies")))
