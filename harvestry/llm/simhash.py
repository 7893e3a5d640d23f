"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

A node of the trie is a prefix of fingerprints. The join starts with the pairs
of nodes at the first level and replaces a pair of nodes by the pairs of their
children some bits further down, adding up the bits in which they differ and
dropping a pair as soon as it differs in more than the budget. A node has 256
children at most, so no key of these joins is hot, and equal fingerprints are one leaf.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, without, written

SEED = 42
_LAST = (1 << 63) - 1
#: Odd factors that turn one hash into several (successive odd multiples of
#: the golden ratio's bits).
_FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64)) for i in range(64)]


def plain_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of so many words of a text, A-Z lower-cased, repeats
    included; of the whole sequence if it is shorter; none without a word."""
    own = plain_words(text)
    if not own:
        return np.empty(0, np.uint64)
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts))


def majorities(hashes: np.ndarray) -> np.ndarray:
    """For each column of hashes the number of which a bit is 1 if it is set
    in over half of the rows; zeros without a row."""
    n, width = hashes.shape
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8 * width), axis=1, bitorder="little")
    set_in = np.zeros(64 * width, np.int64)
    for at in range(0, n, 255):  # a byte holds the sum of 255 bits
        set_in += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * set_in > n, bitorder="little").view("<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    return int(majorities(hashes.reshape(-1, 1))[0])


def _drawn(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` fingerprints of the hashes and of hashes drawn from them."""
    return majorities(np.stack([hashes, *[_mixed(hashes, i) for i in range(1, count)]], axis=1)).view(np.int64)


def _mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash drawn from each hash."""
    with np.errstate(over="ignore"):
        x = hashes * _FACTORS[i]
        x ^= x >> np.uint64(32)
        return x * _FACTORS[-1 - i]


def fingerprints(docs: DataFrame, key: str, text: str = "text", words: int = 3, count: int = 1) -> DataFrame:
    """(key, fps): ``count`` fingerprints of 64 bits of each whole text; the
    first is that of the shingle hashes themselves."""
    ordered = docs.select(column(key), column(text))
    schema = T.StructType([ordered.schema[0], T.StructField("fps", T.ArrayType(T.LongType()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for t in b.column(1):
                made.append(_drawn(shingle_hashes(t.as_py(), words), count))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], [key, "fps"])

    return ordered.mapInArrow(step, schema)


def close_pairs(leaves: DataFrame, bits: int, budget: int) -> DataFrame:
    """(tree, a, b, diff): pairs a, b of different fingerprints of one tree
    that differ in ``budget`` bits at most, each pair once.

    leaves: distinct (tree, fp), fp a long of which the lowest ``bits`` (a
    multiple of 8, 64 at most) count. The 256 nodes of the first level meet by
    the masks of few bits; then levels are four bits deep as long as nodes can
    be full of children, and eight from there.
    """
    nodes, step = _walk(leaves, bits, budget)
    kids = collect_kids(leaves, bits, bits - step, step)
    pairs = _down(nodes, kids, step, budget).select("tree", _child("a", "x", step), _child("b", "y", step), _differ())
    return pairs.filter(F.col("a") != F.col("b"))


def collect_kids(leaves: DataFrame, bits: int, depth: int, step: int) -> DataFrame:
    """(tree, node, kids): the nodes of a depth with their children ``step``
    bits further down (k)."""
    node = F.shiftrightunsigned("fp", bits - depth - step)
    kid = F.struct(node.bitwiseAND(F.lit((1 << step) - 1)).cast("int").alias("k"))
    return leaves.groupBy("tree", F.shiftrightunsigned(node, step).alias("node")).agg(F.collect_set(kid).alias("kids"))


def _child(end: str, kid: str, step: int) -> Column:
    return F.shiftleft(end, step).bitwiseOR(F.col(f"{kid}.k")).alias(end)


def _differ() -> Column:
    return (F.col("diff") + F.bit_count(F.col("x.k").bitwiseXOR(F.col("y.k")))).alias("diff")


def _down(pairs: DataFrame, kids: DataFrame, step: int, budget: int) -> DataFrame:
    """Pairs of nodes with each pair x, y of their children that is within the
    budget; other pairs never become rows."""
    left = kids.select("tree", F.col("node").alias("a"), F.col("kids").alias("of_a"))
    right = kids.select("tree", F.col("node").alias("b"), F.col("kids").alias("of_b"))
    both = pairs.join(left, ["tree", "a"]).join(right, ["tree", "b"]).withColumn("x", F.explode("of_a")).drop("of_a")

    def near(y: Column) -> Column:
        x = F.col("x")
        return (F.bit_count(y["k"].bitwiseXOR(x["k"])) + F.col("diff") <= budget) & ((F.col("a") != F.col("b")) | (y["k"] >= x["k"]))

    return both.withColumn("y", F.explode(F.filter("of_b", near)))


def _walk(leaves: DataFrame, bits: int, budget: int) -> tuple[DataFrame, int]:
    """Pairs of nodes one level above the leaves, and the bits of that level."""
    top = leaves.select("tree", F.shiftrightunsigned("fp", bits - 8).alias("a")).distinct()
    masks = F.array(*[F.lit(m).cast("long") for m in range(256) if m.bit_count() <= budget])
    met = top.withColumn("mask", F.explode(masks)).withColumn("b", F.col("a").bitwiseXOR(F.col("mask"))).filter(F.col("a") <= F.col("b"))
    pairs = met.join(top.withColumnRenamed("a", "b"), ["tree", "b"], "left_semi").select("tree", "a", "b", F.bit_count("mask").alias("diff"))
    depth, step = 8, 4
    while depth + step < bits:
        kids = collect_kids(leaves, bits, depth, step)
        pairs = _down(pairs, kids, step, budget).select("tree", _child("a", "x", step), _child("b", "y", step), _differ())
        depth += step
        step = 4 if depth < 32 else 8
    return pairs, step


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root_rank, root): the smallest (rank, node) that each node
    reaches. nodes: distinct (node, rank); edges: (a, b) of nodes.

    Every round takes the smallest label of all neighbours and then the label
    of that label, so the rounds grow with the logarithm of the longest chain.
    Only nodes with an edge go round; each round is a table in the shared
    folder. A label that very many nodes share is a hot key of the second
    join only, which Spark splits as skewed.
    """
    labels = _labels(nodes, edges)
    return nodes.join(labels, "node", "left").select("node", F.coalesce(F.col("label.rank"), F.col("rank")).alias("root_rank"), F.coalesce(F.col("label.node"), F.col("node")).alias("root"))


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes with an edge; label: rank and node of the
    smallest one that it reaches."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    own = F.struct(F.col("rank").alias("rank"), F.col("node").alias("node"))
    labels = written(nodes.join(both.select(F.col("a").alias("node")).distinct(), "node").select("node", own.alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy("b").agg(F.min("label").alias("near"))
        hooked = labels.join(seen.withColumnRenamed("b", "node"), "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = hooked.withColumn("at", F.col("label.node")).join(jump, "at").select("node", "before", F.least("label", "further").alias("label"))
        fresh = written(jumped)
        labels = fresh.select("node", "label")
        if fresh.filter(F.col("label") != F.col("before")).isEmpty():
            return labels


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: the SimHash as 16
    hexadecimal digits and the smallest doc_id that is reached over
    fingerprints that differ in ``budget`` bits at most.

    Null and empty texts, and those without a word, have fingerprint zero and
    link like others. Shorter texts than a shingle are one shingle. Null ids
    are never the smallest; a component of null ids alone has a null id.
    Repeated rows give repeated results; an empty table an empty one. Other
    columns are not read. Texts are read once; equal fingerprints meet by a
    pre-aggregated minimum, and only distinct ones enter the trie.
    """
    printed = written(fingerprints(docs, doc_id, text, words).select(column(doc_id).alias("doc_id"), F.col("fps")[0].alias("fp")))
    nodes = written(printed.groupBy(F.col("fp").alias("node")).agg(F.coalesce(F.min(F.col("doc_id").cast("long")), F.lit(_LAST)).alias("rank")))
    edges = written(close_pairs(nodes.select(F.lit(0).alias("tree"), F.col("node").alias("fp")), 64, budget).select("a", "b"))
    found = components(nodes, edges).select(F.col("node").alias("fp"), F.nullif("root_rank", F.lit(_LAST)).alias("component_id"))
    return printed.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marked(rows: DataFrame, words: int, count: int) -> DataFrame:
    """(rank, row, node, fps) of rows (rank, row, text): a hash of the words of
    the text, null without a word, and fingerprints of its distinct shingles,
    on which near-duplicates are judged as well."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, nodes = [], []
            for t in b.column(2):
                text = t.as_py()
                own = plain_words(text)
                digest = xxhash.xxh64_intdigest(b" ".join(own), SEED)
                nodes.append(digest - (digest >> 63 << 64) if own else None)
                made.append(_drawn(np.unique(shingle_hashes(text, words)), count))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(made, pa.list_(pa.int64()))], ["rank", "row", "node", "fps"])

    return rows.mapInArrow(step, "rank long, row long, node long, fps array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of each text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(step, "node long, shingles array<long>")


def _jaccard() -> Column:
    both = F.size(F.array_intersect("left", "right"))
    return both / (F.size("left") + F.size("right") - both)


def _apart(left: Column, right: Column) -> Column:
    """Bits in which two arrays of fingerprints differ."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def _most(count: int, similarity: float) -> float:
    """Bits in which ``count`` fingerprints of a pair at the bound differ, give
    or take; a pair far beyond is no near-duplicate."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return float(64 * count * share + 4.5 * np.sqrt(64 * count * share * (1 - share)))


def _sifted(rows: DataFrame, key: Column, wanted: DataFrame, most: int) -> DataFrame:
    """rows with ``__hit``: true for every row whose key (a long) ``wanted``
    has in its first column, and for one in nine others or so. most: the rows
    of wanted, or more.

    Lets a large table stay where it is but for the rows that a join needs.
    Some eight bits a key are sent to all tasks, 2 ** 26 at most; beyond that
    more rows pass, and the join drops them as it does the others.
    """
    slots = 1 << min(26, max(6, (8 * most).bit_length()))

    def slot(k: Column) -> Column:
        return F.xxhash64(k).bitwiseAND(F.lit(slots - 1))

    bit = F.expr("shiftleft(1L, cast(__slot & 63 AS int))")
    marks = wanted.select(slot(column(wanted.columns[0])).alias("__slot")).select(F.shiftright("__slot", 6).alias("__at"), bit.alias("__bit")).groupBy("__at").agg(F.bit_or("__bit").alias("__bits"))
    asked = rows.withColumn("__slot", slot(key)).withColumn("__at", F.shiftright("__slot", 6))
    return asked.join(F.broadcast(marks), "__at", "left").withColumn("__hit", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__at", "__bits", "__slot")


def _among(rows: DataFrame, key: str, wanted: DataFrame, most: int) -> DataFrame:
    """The rows whose key is in ``wanted``, and a few others."""
    return _sifted(rows, F.col(key), wanted, most).filter("__hit").drop("__hit")


def _row_pairs(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(k, i, j), at most so many at once: for each k the pairs of a place i of
    the of_a[k] from a[k] on with a place j of the of_b[k] from b[k] on."""
    ends = np.cumsum(of_a * of_b)
    for start in range(0, int(ends[-1]) if len(ends) else 0, most):
        at = np.arange(start, min(start + most, int(ends[-1])))
        k = np.searchsorted(ends, at, "right")
        at -= ends[k] - of_a[k] * of_b[k]
        yield k, a[k] + at // of_b[k], b[k] + at % of_b[k]


def _tops(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each place the smallest one that it reaches over the links i, j."""
    top = np.arange(count)
    while (unlike := top[i] != top[j]).any():
        i, j = i[unlike], j[unlike]
        np.minimum.at(top, np.maximum(top[i], top[j]), np.minimum(top[i], top[j]))
        while (top[top] != top).any():
            top = top[top]
    return top


class _Pairs:
    """Pairs of ``count`` items. A pair of which an end has more than
    ``crowded`` partners is only kept as a way from item to item, so what is
    held grows with the items and not with the square of a crowd."""

    def __init__(self, count: int, crowded: int | None) -> None:
        self.count, self.crowded = count, crowded
        self.partners, self.top = np.zeros(count, np.int64), np.arange(count)
        self.sparse = np.empty((3, 0), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray, more: np.ndarray) -> None:
        self.partners += np.bincount(np.concatenate([i, j]), minlength=self.count)
        self.sparse = np.concatenate([self.sparse, np.stack([i, j, more.astype(np.int64)])], axis=1)
        if self.crowded is not None:
            dense = (self.partners[self.sparse[:2]] > self.crowded).any(0)
            ways = np.concatenate([self.sparse[:2, dense], np.stack([np.arange(self.count), self.top])], axis=1)
            self.top, self.sparse = _tops(self.count, *ways), self.sparse[:, ~dense]


def _meeting(fp: np.ndarray, root: np.ndarray, node: np.ndarray, sketch: np.ndarray, masks: Sequence[int], most: float, every: bool, crowded: int | None) -> list[np.ndarray]:
    """a, b, a_root, b_root, more, dense of ``_meetings`` for the texts of a
    subtrie; sketch: a row for each text."""
    order = np.lexsort((node, root, fp))
    fp, root, node, sketch = fp[order], root[order], node[order], sketch[order]
    start = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (root[1:] != root[:-1])]))  # of each group in each leaf
    size = np.diff(np.append(start, len(fp)))
    leaf = np.flatnonzero(np.concatenate([[True], np.diff(fp[start]) != 0]))
    groups, leaves = np.diff(np.append(leaf, len(start))), fp[start][leaf]
    pairs = _Pairs(len(node) if every else len(start), crowded)
    for mask in masks:
        other = np.minimum(np.searchsorted(leaves, leaves ^ mask), len(leaves) - 1)
        met = np.flatnonzero((leaves[other] == leaves ^ mask) & ((leaves < leaves[other]) | ((mask == 0) & (groups > 1))))
        for _, x, y in _row_pairs(leaf[met], groups[met], leaf[other[met]], groups[other[met]]):
            apart = (root[start[x]] != root[start[y]]) & ((x < y) | (mask != 0))
            x, y = x[apart], y[apart]
            for k, i, j in _row_pairs(start[x], size[x], start[y], size[y]):
                alike = _unlike_bits(sketch[i], sketch[j]) <= most
                if every:
                    pairs.add(i[alike], j[alike], np.ones(alike.sum(), bool))
                else:
                    k = np.unique(k[alike])
                    pairs.add(x[k], y[k], size[x[k]] * size[y[k]] > 1)
    at = np.arange(len(node)) if every else start
    far = np.flatnonzero(root[at] != root[at[pairs.top]])
    i, j = at[np.concatenate([pairs.sparse[0], far])], at[np.concatenate([pairs.sparse[1], pairs.top[far]])]
    dense = np.arange(len(i)) >= pairs.sparse.shape[1]
    more = np.concatenate([pairs.sparse[2] > 0, np.zeros(len(far), bool)])
    swap = node[i] > node[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return [node[i], node[j], root[i], root[j], more, dense]


def _unlike_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits in which rows of sketches differ."""
    return np.bitwise_count((left ^ right).view(np.uint64)).sum(-1, dtype=np.int64)  # of negative numbers it would count the absolute value


def _meetings(leaves: DataFrame, bits: int, budget: int, most: float, every: bool = False, crowded: int | None = None) -> DataFrame:
    """(a, b, a_root, b_root, more, dense): texts a < b of different groups
    whose leaves in a tree differ in ``budget`` bits at most and whose sketches
    do in ``most``, some of them more than once.

    leaves: (tree, fp, node, root, sketch), more columns that begin with
    sketch lengthen it. A group has for each of its leaves its smallest text
    there stand for all, if a text there is alike to one of the other group;
    more: there are others. every: all pairs of such texts.

    crowded: pairs of which an end has more partners than that in a place are
    no rows. Each text there has one dense row instead, and a text reaches
    over dense rows and groups all that it would have met.

    The trie is hung once from each of budget + 1 parts of the bits, as two
    leaves within the budget agree in one part at least: leaves that agree in
    the first bits of a part are a subtrie in one place, where a leaf looks up
    those that differ from it in other parts.
    """
    sketches = [c for c in leaves.columns if c.startswith("sketch")]
    parts = np.array_split(np.arange(bits), budget + 1)
    first = min(5, *map(len, parts))
    masks = []
    for k, p in enumerate(parts):  # equal leaves meet in the first place
        others = [1 << i for i in range(bits) if i not in p]
        masks.append([sum(c) for n in range(min(k, 1), budget + 1) for c in combinations(others, n)])
    hung = [F.struct(F.lit(i).alias("part"), F.shiftrightunsigned("fp", int(p[-1]) + 1 - first).bitwiseAND(F.lit((1 << first) - 1)).cast("int").alias("top")) for i, p in enumerate(parts)]
    dealt = leaves.withColumn("hung", F.explode(F.array(*hung))).select(((F.col("tree") * len(parts) + F.col("hung.part")) * (1 << first) + F.col("hung.top")).cast("int").alias("place"), F.col("fp").cast("long").alias("fp"), "node", F.nullif("root", "node").alias("root"), *sketches)

    def step(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        of = masks[key[0].as_py() // (1 << first) % len(parts)]
        node = table.column("node").to_numpy()
        root = pc.coalesce(table.column("root"), table.column("node")).to_numpy()
        sketch = np.stack([table.column(c).to_numpy() for c in sketches], axis=1)
        return pa.table(_meeting(table.column("fp").to_numpy(), root, node, sketch, of, most, every, crowded), names=["a", "b", "a_root", "b_root", "more", "dense"])

    return dealt.groupBy("place").applyInArrow(step, "a long, b long, a_root long, b_root long, more boolean, dense boolean")


def _settle(texts: DataFrame, firsts: DataFrame, roots: DataFrame, sets: DataFrame | None, candidates: DataFrame, words: int, similarity: float, count: int, per_round: int) -> tuple[DataFrame, DataFrame | None]:
    """roots (node, root) that hold once every candidate (a, b) is compared or
    lies within a group, and sets with the shingles that this took.

    A round joins groups by their roots alone: what goes round are the links
    just found, not those of earlier rounds. Each round asks eight times as
    far down a node's candidates as the one before, so the rounds grow with
    the logarithm of the most candidates that a node has. Texts and
    fingerprints of other nodes stay where they are."""
    pairs = written(candidates.select("a", "b").distinct())
    if not (n := pairs.count()):
        return roots, sets
    ends = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    own = written(_among(firsts, "node", ends, 2 * n).join(ends, "node").join(roots, "node").select("node", "rank", "row", "fps", "root"))
    signs = [own.select(F.col("node").alias(x), F.col("fps").alias(f"{x}_fps"), F.col("root").alias(f"{x}_root")) for x in ("a", "b")]
    close = (_apart(F.col("a_fps"), F.col("b_fps")) <= _most(count, similarity)) & (F.col("a_root") != F.col("b_root"))
    # A node asks its smallest candidates first, as far as it is the larger end.
    turn = F.row_number().over(W.partitionBy("b").orderBy("a")).alias("turn")
    open_ = written(pairs.join(signs[0], "a").join(signs[1], "b").filter(close).select("a", "b", "a_root", "b_root", turn))
    n = open_.count()
    touched = open_.select(F.col("a").alias("node")).union(open_.select("b")).distinct()
    sets = _with_sets_of(touched, 2 * n, texts, own, sets, words)
    nodes = firsts.select("node", "rank")
    while n:
        asked = open_.filter(F.col("turn") <= per_round)
        left, right = (_among(sets, "node", asked.select(x), n).select(F.col("node").alias(x), F.col("shingles").alias(side)) for x, side in (("a", "left"), ("b", "right")))
        near = written(asked.join(left, "a").join(right, "b").filter(_jaccard() >= similarity).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        open_ = open_.filter(F.col("turn") > per_round)
        per_round *= 8
        if not near.isEmpty():
            labels = _labels(nodes, near).select("node", F.col("label.node").alias("top"))
            roots = written(_moved(roots, labels, "root"))
            open_ = written(_moved(_moved(open_, labels, "a_root"), labels, "b_root").filter(F.col("a_root") != F.col("b_root")))
        n = open_.count()
    return roots, sets


def _with_sets_of(touched: DataFrame, most: int, texts: DataFrame, own: DataFrame, sets: DataFrame | None, words: int) -> DataFrame:
    """sets, and those of the nodes touched that it lacks. own: (node, rank,
    row, ..) of these at least; most: as many as they are, or more."""
    lacking = written((touched if sets is None else touched.join(_among(sets, "node", touched, most), "node", "left_anti")).join(own, "node").select("node", "rank", "row"))
    heads = _among(texts, "row", lacking.select("row"), most).join(lacking, ["rank", "row"])
    made = written(_sets(heads.select("node", "text").dropDuplicates(["node"]), words))
    return made if sets is None else sets.unionByName(made)


def _alike(root: np.ndarray, side: np.ndarray, sketch: np.ndarray, size: np.ndarray, shingles: np.ndarray, most: float, similarity: float) -> list[tuple[int, int]]:
    """Links between groups that hold near-duplicates: places of texts, one
    link for any two groups that others don't link. Texts of one side don't
    meet. shingles: of all texts one after the other."""
    _, own, held = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((own, -held[own]))  # a large group first: its texts needn't meet each other
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    ids = np.unique(shingles, return_inverse=True)[1]
    of, side, sketch, n, begin = own[order], side[order], sketch[order], size[order], begin[order]
    before = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    before = np.repeat(before, np.diff(np.append(before, len(of))))
    marked, links = np.zeros(len(ids), bool), []
    for p in np.flatnonzero(before):
        q = slice(0, before[p])
        fits = (of[q] != of[p]) & (np.minimum(n[q], n[p]) >= similarity * np.maximum(n[q], n[p])) & (side[q] != side[p])
        near = np.flatnonzero(fits)
        near = near[_unlike_bits(sketch[near], sketch[p]) <= most]
        marked[ids[begin[p] : begin[p] + n[p]]] = True
        for some in np.split(near, np.flatnonzero(np.diff(np.cumsum(n[near]) >> 20)) + 1):
            if len(some):
                ends = np.cumsum(n[some])
                at = np.arange(ends[-1]) + np.repeat(begin[some] - ends + n[some], n[some])
                both = np.add.reduceat(marked[ids[at]], ends - n[some], dtype=np.int64)
                for r in some[both / (n[some] + n[p] - both) >= similarity]:
                    if of[r] != of[p]:
                        links.append((int(order[p]), int(order[r])))
                        of[of == of[r]] = of[p]
        marked[ids[begin[p] : begin[p] + n[p]]] = False
    return links


def _crowd_links(held: DataFrame, most: float, similarity: float) -> DataFrame:
    """(a, b): roots of groups of a crowd that hold near-duplicates; any two
    such groups are linked over others at least. held: (crowd, node, root,
    shingles) and columns that begin with sketch.

    All texts of a crowd meet, block by block: each task has two blocks of
    some 2 ** 21 shingles, and a text is sent once for every block of its crowd."""
    sketches = [c for c in held.columns if c.startswith("sketch")]
    blocks = F.greatest(F.ceil(F.sum(F.size("shingles")) / (1 << 21)), F.least(F.lit(4), F.ceil(F.count(F.lit(1)) / 512))).cast("int")
    crowds = written(held.groupBy("crowd").agg(blocks.alias("blocks")))
    own = held.join(crowds, "crowd").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = sent.select("crowd", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "root", "shingles", *sketches)

    def step(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        root = table.column("root").to_numpy()
        side = table.column("block").to_numpy() if key[1] != key[2] else np.arange(len(root))
        sketch = np.stack([table.column(c).to_numpy() for c in sketches], axis=1)
        size = pc.list_value_length(table.column("shingles")).to_numpy().astype(np.int64)
        links = _alike(root, side, sketch, size, pc.list_flatten(table.column("shingles")).to_numpy(), most, similarity)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table([root[a], root[b]], names=["a", "b"])

    return cells.groupBy("crowd", "low", "high").applyInArrow(step, "a long, b long")


def _settle_crowds(texts: DataFrame, firsts: DataFrame, roots: DataFrame, sets: DataFrame | None, dense: DataFrame, words: int, similarity: float, most: float) -> tuple[DataFrame, DataFrame | None]:
    """roots (node, root) that hold once all texts that reach each other over
    groups and dense (a_root, b_root) are compared, and the crowd of each of
    these (node, crowd). firsts: with sketches."""
    top = roots.withColumnRenamed("root", "top")
    ways = written(_moved(_moved(dense.select("a_root", "b_root").distinct(), top, "a_root"), top, "b_root").filter("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    if ways.isEmpty():
        return roots, None
    nodes = firsts.select("node", "rank")
    crowds = _labels(nodes, ways).select(F.col("node").alias("root"), F.col("label.node").alias("crowd"))
    members = written(roots.join(crowds, "root").select("node", "root", "crowd"))
    n = members.count()
    own = written(_among(firsts, "node", members, n).join(members, "node"))
    sets = _with_sets_of(members.select("node"), n, texts, own, sets, words)
    held = written(own.drop("rank", "row").join(_among(sets, "node", members, n), "node"))
    links = written(_crowd_links(held, most, similarity))
    if not links.isEmpty():
        roots = written(_moved(roots, _labels(nodes, links).select("node", F.col("label.node").alias("top")), "root"))
    return roots, members.select("node", "crowd")


def _moved(rows: DataFrame, labels: DataFrame, root: str) -> DataFrame:
    """rows with each root replaced by its top, if it has one in labels (node, top)."""
    own = rows.join(labels.withColumnRenamed("node", root), root, "left")
    return own.withColumn(root, F.coalesce("top", root)).select(*rows.columns)


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, trees: int = 48, bits: int = 24, budget: int = 1, per_round: int = 4, crowded: int = 4) -> DataFrame:
    """The rows of docs less near-duplicates: of each group the row with the
    smallest doc_id stays (of rows with that id, the one of the smallest text
    hash, and of equal ones any one).

    Two texts are near-duplicates if the Jaccard similarity of their sets of
    ``words``-word shingles is ``similarity`` or more; groups are connected.
    Candidates come from ``trees`` tries of ``bits``-bit SimHash fingerprints
    that differ in ``budget`` bits at most, and are then compared exactly on
    their shingle sets. One tree finds a pair of similarity 0.9 with
    probability 0.27 and one of 0.8 with 0.10, all 48 with over 0.9999 and 0.994;
    ``bits`` should exceed the logarithm of the number of different texts by a
    few, or too many candidates are compared in vain.

    Equal texts (A-Z lower-cased, white space aside) are one node from the
    start. Texts of equal fingerprints go first: each is a candidate of the
    smallest of its leaf. Then the trie, hung from each half of its bits, is
    joined with the groups found so
    far: a leaf holds its texts by group, and groups of one leaf or of near
    leaves meet unless they are the same, at first by their smallest texts
    there, and if they are still apart after that by every pair of their texts.
    So any two texts that meet in a tree are compared or lie in one group.
    A text that meets more than ``crowded`` others in a place of a tree is in a
    crowd with them, say of copies that are less alike than ``similarity``.
    Pairs of a crowd are no rows: all its texts are compared within tasks, each
    of which has two blocks of the crowd and returns a link for groups that
    turn out to be one. The time of that grows with the square of the crowd,
    its rows with the texts, times the crowd's blocks of some 2 ** 21 shingles.
    In the first round a node compares itself with at most per_round candidates
    outside its group and in each later one with eight times as many; candidates that have been
    tried are gone, and those within a group need no try, so a group of n
    copies costs some n comparisons and not its square. Texts without a word are no duplicates of anything and stay.
    Null ids come last. An empty table gives an empty result; all columns of
    docs are kept as they are.
    """
    rank, row = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(*[column(c) for c in docs.columns])
    texts = docs.select(rank.alias("rank"), row.alias("row"), "text")
    per_word = 64 // bits
    count = -(-trees // per_word)
    marked = _marked(texts, words, count).filter("node IS NOT NULL")
    firsts = written(marked.groupBy("node").agg(F.min(F.struct("rank", "row", "fps")).alias("first")).select("node", "first.*"))
    roots = firsts.select("node", F.col("node").alias("root"))
    cut = [F.shiftrightunsigned(F.col("fps")[i // per_word], bits * (i % per_word)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(trees)]
    in_trees = F.posexplode(F.array(*cut)).alias("tree", "fp")

    leaf = F.shiftleft(F.col("tree").cast("long"), bits).bitwiseOR(F.col("fp"))
    spread = firsts.select("node", in_trees).select(leaf.alias("leaf"), "node")
    same = spread.withColumn("a", F.min("node").over(W.partitionBy("leaf"))).select("a", F.col("node").alias("b")).filter(F.col("a") != F.col("b"))
    roots, sets = _settle(texts, firsts, roots, None, same, words, similarity, count, per_round)

    # Two words of the fingerprints travel along and stop nearly all chance
    # meetings before they are rows.
    most = _most(2, similarity)
    firsts = firsts.withColumns({"sketch": F.element_at("fps", -1), "sketch_2": F.element_at("fps", -min(2, count))})
    sketched = firsts.drop("fps")

    def leaves(of: DataFrame, grouped: DataFrame) -> DataFrame:
        return of.join(grouped, "node").select("node", "root", "sketch", "sketch_2", in_trees)

    met = written(_meetings(leaves(firsts, roots), bits, budget, most, crowded=crowded))
    before = roots
    roots, sets = _settle(texts, firsts, roots, sets, met.filter("NOT dense"), words, similarity, count, per_round)
    roots, crowds = _settle_crowds(texts, sketched, roots, sets, met.filter("dense"), words, similarity, most)

    # Groups that are still apart, but for those of a crowd: every member of
    # one with every near one of the other.
    top = before.select("root", F.col("root").alias("node")).distinct().join(roots.withColumnRenamed("root", "top"), "node").select("node", "top")
    apart = met.filter("more AND NOT dense").select("a_root", "b_root").distinct()
    for labels in (top, None if crowds is None else crowds.withColumnRenamed("crowd", "top")):
        if labels is not None:
            ends = apart.withColumns({"a_top": F.col("a_root"), "b_top": F.col("b_root")})
            apart = _moved(_moved(ends, labels, "a_top"), labels, "b_top").filter("a_top <> b_top").select("a_root", "b_root")
    still = written(apart.select(F.col("a_root").alias("before")).union(apart.select("b_root")).distinct())
    if not still.isEmpty():
        members = written(before.select("node", F.col("root").alias("before")).join(still, "before").join(roots, "node").select("node", "root"))
        some = _among(firsts, "node", members, members.count())
        met = written(_meetings(leaves(some, members), bits, budget, most, every=True, crowded=crowded))
        roots, sets = _settle(texts, firsts, roots, sets, met.filter("NOT dense"), words, similarity, count, per_round)
        roots, _ = _settle_crowds(texts, sketched, roots, sets, met.filter("dense"), words, similarity, most)
    keep = written(firsts.join(roots, "node").groupBy("root").agg(F.min(F.struct("rank", "row")).alias("k")).select("k.*"))

    # Only rows that go, or of which there are equal ones, are joined with
    # what stays; the others needn't move. Rows equal in every column are one;
    # the hash of its own lets them meet only after a first reduction.
    own = [column(c) for c in docs.columns]
    with_word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.withColumns({"__rank": rank, "__row": row, "__word": with_word})
    times = keyed.filter("__word").groupBy(F.col("__rank").alias("rank"), F.col("__row").alias("row")).agg(F.count(F.lit(1)).alias("n"))
    unsure = written(times.join(keep.withColumn("stays", F.lit(True)), ["rank", "row"], "left").filter("stays IS NULL OR n > 1").select("row").distinct())
    sifted = _sifted(keyed, F.col("__row"), unsure, unsure.count())
    stays = sifted.filter("__word AND __hit").join(keep, (F.col("__rank") == F.col("rank")) & (F.col("__row") == F.col("row")), "left_semi")
    once = stays.withColumn("__equal", F.xxhash64(F.lit("equal"), *own)).dropDuplicates(["__equal"]).select(*own)
    return sifted.filter("NOT __word OR NOT __hit").select(*own).unionByName(once)
