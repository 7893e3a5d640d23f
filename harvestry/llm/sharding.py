"""Histogram sort: cut a table into shards of near equal bytes, in key order.

A position is (key, hash of the whole row). The driver keeps a few probe
positions; every round counts the exact bytes and rows below each probe over
all partitions and places new probes only where a wanted boundary still lies
between two known ones. When all splitters are close enough, the rows move
once, straight to the piece of the shard that the counts have assigned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, without, written

_HALF = 1 << 63
_TOP = 1 << 128
_PLACE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())])


def _packed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Positions as 16 bytes whose byte order is the numeric order."""
    out = np.empty((len(hi), 2), dtype=">u8")
    out[:, 0] = hi.astype(np.int64).view(np.uint64) ^ np.uint64(_HALF)
    out[:, 1] = lo.astype(np.int64).view(np.uint64) ^ np.uint64(_HALF)
    return out.view("S16").ravel()


def _packed_ints(positions: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(p.to_bytes(16, "big") for p in positions), dtype="S16")


def _histogram(keyed: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """(bytes, rows) between neighbouring probes, by the probe's number from
    below; at most one row for each probe comes to the driver."""
    edges = _packed_ints(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(edges) + 1), dtype=np.int64)
        for b in batches:
            at = np.searchsorted(edges, _packed(b.column(0).to_numpy(False), b.column(1).to_numpy(False)), side="right")
            np.add.at(total[0], at, b.column(2).to_numpy(False))
            np.add.at(total[1], at, 1)
        bins = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(total[0][bins]), pa.array(total[1][bins])], ["bin", "bytes", "rows"])

    per_task = keyed.mapInArrow(count, "bin long, bytes long, rows long")
    sums = per_task.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return {r["bin"]: (r["bytes"], r["rows"]) for r in sums.collect()}


def _spaced(low: int, high: int, n: int) -> list[int]:
    """Up to n whole numbers evenly spread between low and high, both left out."""
    step = high - low
    return sorted({low + step * i // (n + 1) for i in range(1, n + 1)} - {low, high})


def _splitters(keyed: DataFrame, shards: int, tolerance: float, piece_bytes: int, fan: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """The shard boundaries, and all known positions with (bytes, rows) below."""
    first = keyed.agg(F.sum("size"), F.count(F.lit(1)), F.min("hi"), F.max("hi")).first()
    size, rows = first[0] or 0, first[1]
    known = {0: (0, 0), _TOP: (size, rows)}
    if not rows:
        return [_TOP] * (shards - 1), known
    low, high = (first[2] + _HALF) << 64, (first[3] + _HALF + 1) << 64
    known[low] = (0, 0)
    known[min(high, _TOP)] = (size, rows)
    pieces = max(shards, -(-size // piece_bytes))
    probes = _spaced(low, min(high, _TOP), fan * pieces)
    slack = tolerance * size / shards
    while probes:
        found = _histogram(keyed, probes)
        below = (0, 0)
        for i, p in enumerate(probes):
            b, n = found.get(i, (0, 0))
            below = known[p] = (below[0] + b, below[1] + n)
        places = sorted(known)
        weights = [known[p][0] for p in places]
        probes = []
        wanted = set()
        for j in range(1, shards):
            target = size * j / shards
            at = int(np.searchsorted(weights, target, side="right"))  # weights[at - 1] <= target
            near = min(abs(weights[at - 1] - target), abs(weights[min(at, len(weights) - 1)] - target))
            if at < len(places) and near > slack:
                wanted.add(at)
        wanted.update(at for at in range(1, len(places)) if weights[at] - weights[at - 1] > piece_bytes)
        for at in sorted(wanted):
            a, b = places[at - 1], places[at]
            if known[b][1] - known[a][1] > 1:  # a single row can't be cut
                probes += _spaced(a, b, fan)
    cuts = []
    for j in range(1, shards):
        target = size * j  # in 1 / shards of a byte
        at = int(np.searchsorted([w * shards for w in weights], target, side="left"))
        # The nearest known position; of two equally near ones the lower.
        around = [k for k in (at - 1, at) if 0 <= k < len(places)]
        cuts.append(places[min(around, key=lambda k: (abs(weights[k] * shards - target), k))])
    return cuts, known


def shard_by_bytes(docs: DataFrame, key: Column, size: Column, shards: int = 40, tolerance: float = 0.0, piece_bytes: int = 64 << 20, fan: int = 32) -> DataFrame:
    """All rows and columns with ``shard`` (0 to shards - 1) and ``slot``
    (gapless from 0 in each shard, in the order of key and row hash).

    key: a whole number; null sorts first. size: bytes that a row counts for.
    tolerance: how far a splitter may lie from its ideal place, as a share of
    a shard's bytes; 0 means the nearest row boundary. piece_bytes: a shard
    above this many bytes is sorted in several tasks; the counts give each its
    first slot, so no shard has to fit one task. fan: probes for each open
    boundary in each round.

    Equal keys are told apart by a hash of the whole row, so a key that holds
    a third of the rows is cut as well; rows equal in every column share a
    position and stay in one shard. An empty table gives an empty result. Input
    columns named shard or slot are replaced. The narrow (key, hash, size) rows
    are written once to the shared folder, so that each round reads 24 bytes a
    row and not the texts. The driver holds fan numbers for each piece.
    """
    own = without(docs, ["shard", "slot"])
    lo = F.xxhash64(*[column(c) for c in own.columns])
    hi = F.coalesce(key.cast("long"), F.lit(-_HALF))
    keyed = written(own.select(hi.alias("hi"), lo.alias("lo"), F.coalesce(size.cast("long"), F.lit(0)).alias("size")))
    cuts, known = _splitters(keyed, shards, tolerance, piece_bytes, fan)

    places = sorted(known)
    at_cut = Counter(cuts)
    starts, shard_of = [0], [at_cut[0] if known[_TOP][0] else 0]
    for a, b in zip(places, places[1:], strict=False):
        crossed = at_cut[b]
        heavy = known[b][0] - known[starts[-1]][0] > piece_bytes and a > starts[-1]
        if heavy:
            starts.append(a)
            shard_of.append(shard_of[-1])
        if crossed and b < _TOP:
            starts.append(b)
            shard_of.append(shard_of[-1] + crossed)
    rows_at = [known[s][1] for s in starts]
    shard_rows: dict[int, int] = {}
    for s, n in zip(shard_of, rows_at, strict=True):
        shard_rows.setdefault(s, n)
    base = np.array([n - shard_rows[s] for s, n in zip(shard_of, rows_at, strict=True)], dtype=np.int64)
    edges, shard_no = _packed_ints(starts[1:]) if len(starts) > 1 else np.empty(0, "S16"), np.array(shard_of, dtype=np.int32)

    @F.pandas_udf(_PLACE)
    def place(hi: pd.Series, lo: pd.Series) -> pd.DataFrame:
        piece = np.searchsorted(edges, _packed(hi.to_numpy(), lo.to_numpy()), side="right").astype(np.int32)
        return pd.DataFrame({"piece": piece, "shard": shard_no[piece], "base": base[piece]})

    names = {"__hi": hi, "__lo": lo}
    placed = own.withColumns(names).withColumn("__at", place("__hi", "__lo"))
    # Piece p is partition p: the low 33 bits of the row's id count the rows
    # of its partition in sorted order.
    dealt = placed.repartitionById(len(starts), F.col("__at.piece")).sortWithinPartitions("__hi", "__lo")
    slot = F.col("__at.base") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.select(*[column(c) for c in own.columns], F.col("__at.shard").alias("shard"), slot.alias("slot"))
