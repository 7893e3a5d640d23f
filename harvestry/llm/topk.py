"""Exact top k of inner products by distributed histogram selection.

Queries and candidates lie in blocks. Every block of queries meets every group
of candidate blocks in some task, which scores all pairs as one product of
matrices. Scores are counted in bins; the sums over all tasks tell in which
bin a query's kth score lies, and the next round splits that bin, until it is
one score wide. A last pass keeps the scores above it, and of those equal to
it the smallest ids. Only bins that can still hold the kth score leave a task:
those down to the task's own kth.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import written

#: Rows of a block of queries and of candidates, bins of a histogram.
QUERIES, CANDIDATES, BINS = 1024, 4096, 256
_BLOCK = "block long, n long, ids binary, no_id binary, vectors binary, reach double"
#: Whole components beyond this are no numbers to the search: the sum of as
#: many products as a vector has would not fit a decimal of 38 digits.
_LARGEST = float(1 << 59)


def _pack(rows: int, dim: int, scale: float):
    """Batches of (id, vector) as blocks of at most ``rows`` valid vectors."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, none = np.empty(0, np.int64), np.empty(0, np.int8)
        vectors = np.empty((0, dim), np.int64)
        for b in [*batches, None]:
            if b is not None:
                matrix, good = _matrix(b.column(1), dim)
                whole = np.floor(np.where(good[:, None], matrix, 0.0) * scale)
                good &= (np.abs(whole) < _LARGEST).all(1)
                vectors = np.concatenate([vectors, whole[good].astype(np.int64)])
                none = np.concatenate([none, np.asarray(b.column(0).is_null())[good].astype(np.int8)])
                ids = np.concatenate([ids, b.column(0).fill_null(0).to_numpy(False)[good].astype(np.int64)])
            while len(ids) >= rows or b is None and len(ids):
                v = vectors[:rows]
                reach = float(np.sqrt((v.astype(float) ** 2).sum(1).max()))
                out = [block, len(v), ids[:rows].tobytes(), none[:rows].tobytes(), v.astype("<i8").tobytes(), reach]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], [c.split()[0] for c in _BLOCK.split(", ")])
                block, ids, none, vectors = block + 1, ids[rows:], none[rows:], vectors[rows:]

    return step


def _matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of dim doubles, and which rows are wholly finite; shorter vectors
    are filled with zeros."""
    flat = lists.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(False)
    sizes = lists.value_lengths().fill_null(0).to_numpy(False).astype(np.int64)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out, np.isfinite(out).all(1) & ~np.asarray(lists.is_null())


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums stay exact, in 64 bits
    where the products fit them, else in Python's whole numbers."""
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    norms = [float(np.sqrt((x.astype(float) ** 2).sum(1).max())) for x in (q, c)]
    if norms[0] * norms[1] < 1 << 62:  # sums that pass 64 bits on the way come back
        return q @ c.T
    return q.astype(object) @ c.T.astype(object)


def _blocks(b: pa.RecordBatch, dim: int) -> Iterator[tuple]:
    """(query block, ids, matrix, candidate ids, matrix, row) of each row."""
    for r in b.to_pylist():
        q = np.frombuffer(r["q_vectors"], "<i8").reshape(-1, dim)
        c = np.frombuffer(r["vectors"], "<i8").reshape(-1, dim)
        q_ids, ids, none = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["no_id"], np.int8) > 0
        s = _scores(q, c)
        other = (q_ids[:, None] != ids[None, :]) | none[None, :]
        yield r, q_ids, ids, none, s, other


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding", groups: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query
    over all rows of other ids, ties to the smaller id; all, if there are fewer.

    Components are floor(scale * x) in doubles; the score is their inner
    product. is_query: a condition that says which rows are queries. Vectors
    that are null, or hold null or non-finite components, take no part; shorter
    vectors count as filled with zeros. A vector with a component of 2 ** 59 or
    more in size after scaling takes no part either. Scores are compared as they
    are, however large; one beyond 64 bits is returned as the nearest long. A row without an id is a candidate, last among equal scores, and
    never a query unless is_query says so of null. A repeated query row has
    each of its results again. Columns other than the two are not read. An
    empty table gives an empty result.

    Queries grow with the table, so nothing is broadcast: each block of
    queries is joined with each of ``groups`` groups of candidate blocks on
    (query block, group). Candidates move once for each 1024 queries.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    dim = own.agg(F.max(F.size("v"))).first()[0] or 1
    dim = max(1, dim)
    blocks = written(own.select("id", "v").mapInArrow(_pack(CANDIDATES, dim, scale), _BLOCK))
    n_queries = own.filter("is_query").count()
    asked = written(own.filter("is_query").select("id", "v").repartition(max(1, -(-n_queries // QUERIES))).mapInArrow(_pack(QUERIES, dim, scale), _BLOCK))
    facts = blocks.agg(F.max("reach"), F.count(F.lit(1))).first()
    reach = (facts[0] or 0.0) * (asked.agg(F.max("reach")).first()[0] or 0.0)
    groups = groups or max(1, min(spark.sparkContext.defaultParallelism, facts[1]))
    limit = int(reach * (1 + 1e-9)) + 2
    # Scores beyond 62 bits are counted by their upper bits.
    shift = max(0, limit.bit_length() - 61)
    limit = (limit >> shift) + 1

    queries = asked.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    # Which group meets which block of queries is the same for all: every
    # candidate block goes to each query block's task of its own group.
    dealt = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    spread = dealt.join(queries.select("q", "g"), "g").select("q", "g", "ids", "no_id", "vectors")
    pairs = spread.join(queries, ["q", "g"])

    def histogram(width: int, span: int):
        """Counts of the scores within span of each row's low, in bins."""

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for r, q_ids, _, _, s, other in _blocks(b, dim):
                    over = (s >> shift).astype(np.int64) - np.array(r["lows"])[:, None]
                    inside = other & (over >= 0) & (over < span)
                    flat = (np.arange(len(q_ids))[:, None] * BINS + over // width)[inside]
                    counts = np.bincount(flat, minlength=len(q_ids) * BINS).reshape(-1, BINS)
                    sums[r["q"]] = sums[r["q"]] + counts if r["q"] in sums else counts
            for q, counts in sums.items():
                above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts  # in higher bins of this task
                row, at = np.nonzero((counts > 0) & (above < k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), q)), pa.array(row), pa.array(at), pa.array(counts[row, at])], ["q", "row", "bin", "n"])

        return step

    # For each row of a query block: the range still open, and how many
    # scores lie above it. A query with fewer than k scores keeps all.
    start = asked.select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row"))
    span = 2 * limit + 1
    state = cut_lineage(start.withColumns({"low": F.lit(-limit).cast("long"), "above": F.lit(0).cast("long")}))
    while True:
        width = -(-span // BINS)
        counted = pairs.join(_lows(state), "q").mapInArrow(histogram(width, span), "q long, row long, bin long, n long")
        sums = counted.groupBy("q", "row", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("q", "row").orderBy(F.desc("bin"))
        running = sums.withColumn("upto", F.sum("n").over(down)).join(state.select("q", "row", "above"), ["q", "row"])
        hit = running.filter((F.col("above") + F.col("upto") >= k) & (F.col("above") + F.col("upto") - F.col("n") < k))
        hit = hit.select("q", "row", "bin", (F.col("above") + F.col("upto") - F.col("n")).alias("now_above"))
        step = state.join(hit, ["q", "row"], "left")
        low = F.coalesce(F.col("low") + F.col("bin") * width, F.col("low"))
        state = cut_lineage(step.select("q", "row", low.alias("low"), F.coalesce("now_above", "above").alias("above")))
        if width == 1:
            break
        span = width

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, q_ids, ids, none, s, other in _blocks(b, dim):
                low = np.array(r["lows"])[:, None]
                high = (s >> shift).astype(np.int64)
                row, at = np.nonzero(other & (high >= low))
                score, cand, tie = s[row, at], ids[at], high[row, at] == low[row, 0]
                # Of a row's scores in the last bin only the k best can be in.
                order = np.lexsort((cand, row)) if not shift else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], cand[i])), np.int64)
                order = order[tie[order]]
                rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                keep = np.concatenate([np.flatnonzero(~tie), order[rank < k]])
                known = ~none[at[keep]]
                shown = pa.array(score[keep].astype(np.int64)) if not shift else pa.array([decimal.Decimal(int(x)) for x in score[keep]], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keep), r["q"])), pa.array(row[keep]), pa.array(q_ids[row[keep]]), pa.array(cand[keep], mask=~known), shown], ["q", "row", "query_id", "vec_id", "score"]
                )

    found = pairs.join(_lows(state), "q").mapInArrow(final, f"q long, row long, query_id long, vec_id long, score {'decimal(38,0)' if shift else 'long'}")
    rank = F.row_number().over(W.partitionBy("q", "row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    ends = [F.lit(x).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1)]
    score = F.greatest(ends[0], F.least(ends[1], F.col("score"))).cast("long") if shift else F.col("score")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _lows(state: DataFrame) -> DataFrame:
    """(q, lows): the lower ends of a block's rows in order, a block's rows
    at most."""
    rows = F.array_sort(F.collect_list(F.struct("row", "low")))
    return state.groupBy("q").agg(rows.alias("rows")).select("q", F.col("rows.low").alias("lows"))
