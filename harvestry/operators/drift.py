"""Structure drift of pages as a degree.

A page's profile is the bag of its pq-grams: of each node its tag and its
parent's, with every window of three neighbouring children. Equal trees have
equal profiles, and a changed node changes the few grams it is in, so the
share of grams that two profiles don't have in common grows with the change.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col
from ..sources.html_nodes import RUN, in_runs, with_fragment

#: Children in a window; beyond the first and the last there is nothing.
WINDOW = 3
_NONE = "*"


def grams(tags: list[str], parents: list[int]) -> Counter[str]:
    """The pq-grams of a tree in document order; parents: places, -1 for none."""
    children: list[list[str]] = [[] for _ in tags]
    for tag, parent in zip(tags, parents, strict=True):
        if parent >= 0:
            children[parent].append(tag)
    out: Counter[str] = Counter()
    for tag, parent, own in zip(tags, parents, children, strict=True):
        stem = f"{tags[parent] if parent >= 0 else _NONE} {tag} "
        row = [_NONE] * (WINDOW - 1) + own + [_NONE] * (WINDOW - 1) if own else [_NONE] * WINDOW
        out.update(stem + " ".join(row[i : i + WINDOW]) for i in range(len(row) - WINDOW + 1))
    return out


@F.arrow_udf(T.MapType(T.StringType(), T.IntegerType()))
def _profiles(nodes: pa.Array) -> pa.Array:
    return in_runs(nodes, pc.list_value_length(nodes).fill_null(0).to_numpy(False).astype("int64"), _bags, RUN >> 4)


def _bags(nodes: pa.Array) -> pa.Array:
    out = []
    for page in nodes:
        rows = page.values
        if rows is None or not len(rows):
            out.append([])
            continue
        ids, parents, tags = (rows.field(c).to_pylist() for c in ("id", "parent", "tag"))
        out.append(list(grams(tags, [p - ids[0] if p >= ids[0] else -1 for p in parents]).items()))
    return pa.array(out, pa.map_(pa.string(), pa.int32()))


def profile(fragment: Column | str) -> Column:
    """The pq-grams of a page with their numbers."""
    return _profiles(col(fragment)["nodes"])


def distance(a: Column, b: Column) -> Column:
    """0 for equal profiles to 1 for profiles without a gram in common, in
    four digits; two empty ones are equal."""
    size = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda t, n: t + n)
    common = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))), F.lit(0).cast("bigint"), lambda t, n: t + n)
    return F.round(F.coalesce(1 - F.try_divide(2 * common, size(a) + size(b)), F.lit(0.0)), 4)


def drift_degrees(pages: DataFrame, baselines: DataFrame, keys: list[str], html: str = "html", limit: float = 0.3) -> DataFrame:
    """(keys, drift_degree, drifted): how far each page's structure lies from
    its baseline's (keys, profile), and whether beyond ``limit``. A page
    without a baseline has a null degree and hasn't drifted."""
    now = with_fragment(pages.select(*keys, html), html).select(*keys, profile("dom").alias("_now"))
    degree = F.when(F.col("profile").isNotNull(), distance(F.col("_now"), F.col("profile")))
    joined = now.join(baselines.select(*keys, "profile"), keys, "left").withColumn("drift_degree", degree)
    return joined.select(*keys, "drift_degree", F.coalesce(F.col("drift_degree") > limit, F.lit(False)).alias("drifted"))
