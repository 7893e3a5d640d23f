"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: what follows reads
    files that outlive the executors and does not compute ``df`` again."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less its columns of these names, in any case: an operator's own
    output columns take the place of input columns of the same name."""
    taken = {n.lower() for n in names}
    return df.select(*[column(c) for c in df.columns if c.lower() not in taken])


def column(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    """Words of a whole text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterable[pa.RecordBatch], at: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of the texts in
    column ``at``, or one row: what a step makes of a slice is a small multiple
    of that, however large Arrow's batches are."""
    for b in batches:
        sizes = pc.binary_length(b.column(at)).fill_null(0).to_numpy(False)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        for start, end in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            yield b.slice(start, end - start)
