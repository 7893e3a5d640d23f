"""MinHash near-duplicates by an LSH forest.

A text's label in an order is a row of minima of its shingles under different
hashes. Each order sorts all labels, so texts that share a prefix of the label
are neighbours, the longer the prefix the closer. A region is a prefix that few
labels share: how many minima that takes depends on how crowded it is there.
The texts of a region are candidates, and where it stays crowded next neighbours
are. Candidates are confirmed on their whole shingle sets. In a crowd, say of a
thousand copies of one text, a neighbour is mostly another copy and not the one
that a text is near to. So texts of a crowd that are still apart after that are
compared with all of it, within tasks: their pairs are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, written
from .simhash import _labels, _moved, components, plain_words, shingle_hashes

_LAST = (1 << 63) - 1
#: Hashes of which labels are made, minima of a label, labels of a region at most.
POOL, DEPTH, REGION = 128, 16, 8
#: Of a label's minima so many have to agree; 0.8 similar texts fail that once in 4,000 meetings.
AGREE = 7
#: Neighbours that are candidates where a region stays crowded.
BESIDE = 2
#: More labels than a region's that share so many minima are a crowd, as far as
#: so many of the 16 agree; of labels that share 5, those of texts 0.8 alike fail that once in 20 meetings.
CROWD, ALIKE = 5, 12
#: Shingles and texts of a block of a crowd, about.
BLOCK, TEXTS = 1 << 20, 2048
#: Rows of a sorted partition, and nodes that a broadcast may hold.
ROWS, SENT = 200_000, 1_000_000
_ODD = (np.arange(1, 2 * POOL, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LEAF = "tree int, hi long, lo long, tie long, node long, n long, root long"
_FOUND = f"part int, side int, {_LEAF}, a long, b long"


def signature(shingles: np.ndarray) -> bytes:
    """A byte of the minimum under each hash of the pool; none without shingles."""
    if not len(shingles):
        return b""
    least = np.full(POOL, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            x = shingles[at : at + 2048, None] * _ODD
            x ^= x >> np.uint64(32)
            x *= _MIX
            np.minimum(least, x.min(0), out=least)
        return (least * _MIX >> np.uint64(56)).astype(np.uint8).tobytes()


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n, signature, shingles): a hash of the words of each text,
    null without a word; its distinct shingles and how many."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, marks, sets, held = [], [], [], [], 0
            first = 0
            for i, t in enumerate(b.column(1)):
                text = t.as_py()
                own = np.unique(shingle_hashes(text, words))
                keys.append(xxhash.xxh3_128_digest(b" ".join(plain_words(text))) if len(own) else None)
                sizes.append(len(own))
                marks.append(signature(own))
                sets.append(own.view(np.int64))
                held += len(own)
                if held >= 1 << 20 or i + 1 == b.num_rows:
                    made = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(sets, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, i + 1 - first), *made], ["doc_id", "key", "n", "signature", "shingles"])
                    keys, sizes, marks, sets, held, first = [], [], [], [], 0, i + 1

    return docs.mapInArrow(step, "doc_id long, key binary, n long, signature binary, shingles array<long>")


def _orders(orders: int) -> np.ndarray:
    """The hashes of each order's labels: permutations of the pool, cut up."""
    rng = np.random.default_rng(11)
    a_pass = POOL // DEPTH
    rows = [rng.permutation(POOL)[: a_pass * DEPTH].reshape(a_pass, DEPTH) for _ in range(-(-orders // a_pass))]
    return np.concatenate(rows)[:orders]


def _leaves(heads: DataFrame, trees: range, orders: int) -> DataFrame:
    """A row of each of the trees for each of heads (node, n, root, signature)."""
    picks = _orders(orders)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                node, n, root = (part.column(k).to_numpy(False) for k in range(3))
                marks = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, POOL)
                for t in trees:
                    label = np.ascontiguousarray(marks[:, picks[t]]).view(">i8").astype(np.int64)
                    with np.errstate(over="ignore"):
                        tie = ((node.astype(np.uint64) + np.uint64(1)) * _ODD[t % POOL] * _MIX).view(np.int64)
                    columns = [np.full(len(node), t, np.int32), label[:, 0], label[:, 1], tie, node, n, root]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _LEAF.split(", ")])

    return heads.select("node", "n", "root", "signature").mapInArrow(step, _LEAF)


def near_in_order(group: np.ndarray, hi: np.ndarray, lo: np.ndarray, region: int = REGION) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of sorted labels that are candidates; labels of different
    groups have no prefix in common."""
    size = len(hi)
    if size < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = np.empty((size, DEPTH), np.uint8)
    label[:, :8] = hi.astype(">i8").view(np.uint8).reshape(-1, 8)
    label[:, 8:] = lo.astype(">i8").view(np.uint8).reshape(-1, 8)
    unlike = np.ones((size - 1, DEPTH + 1), bool)
    unlike[:, :DEPTH] = label[1:] != label[:-1]
    shared = unlike.argmax(1)  # length of the prefix in common with the next
    shared[group[1:] != group[:-1]] = 0
    place = np.full(size, -1, np.int64)
    made = 0
    for depth in range(1, DEPTH + 1):
        run = np.concatenate([[0], np.cumsum(shared < depth)])
        held = np.bincount(run)
        small = (place < 0) & (held[run] <= region)
        place[small] = run[small] + made
        made += len(held)
        if (place >= 0).all():
            break
    left, right = [], []
    reach = np.minimum.reduce
    for apart in range(1, region):
        i = np.flatnonzero((place[:-apart] == place[apart:]) & (place[:-apart] >= 0)) if apart < size else np.empty(0, np.int64)
        if apart <= BESIDE and apart < size:
            close = reach([shared[k : size - apart + k] for k in range(apart)]) > 0
            i = np.union1d(i, np.flatnonzero(close & ((place[:-apart] != place[apart:]) | (place[:-apart] < 0))))
        if not len(i) and apart > BESIDE:
            break
        alike = (label[i] == label[i + apart]).sum(1) >= AGREE
        left.append(i[alike])
        right.append(i[alike] + apart)
    return np.concatenate(left), np.concatenate(right)


def _agreeing(marks: np.ndarray, own: np.ndarray) -> np.ndarray:
    """In how many bytes each row of marks agrees with own, up to 255 of them."""
    eights = (marks == own).view(np.uint64).sum(1)
    return (eights * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)


def _fit(n: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be so much alike."""
    return 100 * np.minimum(n, own) >= percent * np.maximum(n, own)


def ways_in_crowd(label: np.ndarray, n: np.ndarray, root: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between roots, over which all labels of a crowd reach those that
    agree with them in ALIKE minima or more. A label is compared with all that
    it doesn't reach yet, one of the largest group with none."""
    own, of, held = np.unique(root, return_inverse=True, return_counts=True)
    top = of.copy()
    most = int(np.flatnonzero(of == held.argmax())[0])
    a, b = [], []
    for p in np.flatnonzero(of != of[most]):
        if top[p] == top[most]:
            continue
        q = np.flatnonzero(top != top[p])
        q = q[_fit(n[q], n[p], percent)]
        q = q[_agreeing(label[q], label[p]) >= ALIKE]
        met, at = np.unique(top[q], return_index=True)
        a += [own[of[p]]] * len(met)
        b += own[of[q[at]]].tolist()
        top[np.isin(top, met)] = top[p]
    return np.array(a, np.int64), np.array(b, np.int64)


def _ways(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``ways_in_crowd`` of all crowds of sorted leaves."""
    tree, hi, lo, n, root = (t.column(c).to_numpy() for c in ("tree", "hi", "lo", "n", "root"))
    head = hi >> (64 - 8 * CROWD)
    start = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (head[1:] != head[:-1])]))
    mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    ends = np.append(start[1:], len(root))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for i, j in zip(start[mixed], ends[mixed], strict=True):
        if j - i > REGION:
            label = np.stack([hi[i:j], lo[i:j]], axis=1).view(np.uint8)
            found.append(ways_in_crowd(label, n[i:j], root[i:j], percent))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def _columns(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    own = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(own).combine_chunks() if own else None


def _candidates(leaves: DataFrame, rows: int, percent: int) -> DataFrame:
    """The pairs of ``_meetings`` of labels side by side."""
    return _meetings(leaves, rows, percent)[0]


def _meetings(leaves: DataFrame, rows: int, percent: int, crowds: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of nodes that an order brings together, of different
    roots and of sizes that the similarity allows; pairs may repeat. And, with
    crowds, (a, b): links between roots, over which the texts of a crowd reach
    all that they would have met.

    Every partition is a stretch of the sorted orders. Its ends go out as well,
    and the two sides of each cut meet in a second, small step. With crowds, no
    cut goes through one."""

    def wanted(t: pa.Table, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, root, node = (t.column(c).to_numpy() for c in ("n", "root", "node"))
        fits = (root[i] != root[j]) & _fit(n[i], n[j], percent)
        return np.minimum(node[i], node[j])[fits], np.maximum(node[i], node[j])[fits]

    names = [c.split()[0] for c in _FOUND.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (t := _columns(batches)) is None:
            return
        part = TaskContext.get().partitionId()
        a, b = wanted(t, *near_in_order(t.column("tree").to_numpy(), t.column("hi").to_numpy(), t.column("lo").to_numpy()))
        none = [pa.nulls(len(a), k) for k in [pa.int32()] * 3 + [pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([*none, pa.array(a), pa.array(b)], names)
        if crowds:
            a, b = _ways(t, percent)
            none = [pa.nulls(len(a), k) for k in [pa.int32()] * 2 + [pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1, np.int32)), *none, pa.array(a), pa.array(b)], names)
        for side, ends in ((1, t.slice(0, REGION)), (0, t.slice(max(0, t.num_rows - REGION)))):
            size = ends.num_rows
            marks = [pa.array(np.full(size, v, np.int32)) for v in (part - side, side)]
            own = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in ends.columns]
            yield pa.RecordBatch.from_arrays([*marks, *own, pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())], names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := _columns(batches)) is None:
            return
        group = t.column("part").to_numpy().astype(np.int64) << 32 | t.column("tree").to_numpy()
        i, j = near_in_order(group, t.column("hi").to_numpy(), t.column("lo").to_numpy())
        side = t.column("side").to_numpy()
        crossing = side[i] != side[j]
        a, b = wanted(t, i[crossing], j[crossing])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    order = ["tree", "hi", "lo", "tie", "node"]
    whole = ["tree", F.shiftright("hi", 64 - 8 * CROWD)] if crowds else order
    stretches = leaves.repartitionByRange(max(1, -(-rows // ROWS)), *whole).sortWithinPartitions(*order)
    found = written(stretches.mapInArrow(scan, _FOUND))
    cuts = found.filter("b IS NULL").drop("a", "b").repartition("part").sortWithinPartitions("part", *order)
    pairs = found.filter("b IS NOT NULL AND part IS NULL").select("a", "b").union(cuts.mapInArrow(across, "a long, b long"))
    return pairs, found.filter("b IS NOT NULL AND part IS NOT NULL").select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose sets (node, shingles) share ``percent``
    of their union or more. Sets of other nodes don't move, as long as the
    nodes in question are few enough to be sent to all tasks."""
    asked = written(pairs.distinct())
    touched = written(asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct())
    few = touched.count() <= SENT
    own = written(sets.join(F.broadcast(touched) if few else touched, "node", "left_semi"))
    left = own.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = own.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    close = 100 * both >= percent * (F.size("left") + F.size("right") - both)
    return written(asked.join(left, "a").join(right, "b").filter(close).select("a", "b"))


def crowd_links(asking: np.ndarray, node: np.ndarray, root: np.ndarray, main: np.ndarray, marks: np.ndarray, n: np.ndarray, shingles: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between groups that share ``percent`` of the union of two texts or
    more: places of texts, one link for any two groups that others don't link.

    A text that asks meets all that don't, of other groups: those most alike by
    their signatures first, at first a few and then eight times as many. Two
    texts outside the main group ask both; the larger one's question counts.
    shingles: of all texts one after the other."""
    share = percent / 100
    least = int(POOL * share - 4 * np.sqrt(POOL * share * (1 - share)))
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    ids = np.unique(shingles, return_inverse=True)[1]
    _, top = np.unique(root, return_inverse=True)
    there = np.flatnonzero(~asking)
    marked, links = np.zeros(len(ids), bool), []
    for p in np.flatnonzero(asking):
        q = there[(top[there] != top[p]) & (main[there] | (node[there] < node[p]))]
        q = q[_fit(n[q], n[p], percent)]
        agree = _agreeing(marks[q], marks[p])
        near, agree = q[agree >= least], agree[agree >= least]
        near = near[np.argsort(-agree, kind="stable")]
        marked[ids[begin[p] : begin[p] + n[p]]] = True
        few = 8
        while len(near):
            some = near[: max(1, min(few, np.searchsorted(np.cumsum(n[near[:few]]), 1 << 20)))]
            near, few = near[len(some) :], 8 * few
            ends = np.cumsum(n[some])
            at = np.arange(ends[-1]) + np.repeat(begin[some] - ends + n[some], n[some])
            both = np.add.reduceat(marked[ids[at]], ends - n[some], dtype=np.int64)
            for r in some[100 * both >= percent * (n[some] + n[p] - both)]:
                if top[r] != top[p]:
                    links.append((int(p), int(r)))
                    top[top == top[r]] = top[p]
            near = near[top[near] != top[p]]
        marked[ids[begin[p] : begin[p] + n[p]]] = False
    return links


def _settled_crowds(roots: DataFrame, nodes: DataFrame, ways: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """roots (node, root, root_rank) that hold once all texts that reach each
    other over groups and ways are compared. marked: (node, n, signature,
    shingles) of these at least.

    The texts of a crowd's largest group meet all others, but not each other.
    A task has a block of those that ask, which are all others, and a block of
    the crowd, each of some 2 ** 20 shingles or 2,048 texts. So a text is sent
    once for each block of those that ask, and one that asks once for each of
    the crowd too."""
    top = roots.select("node", F.col("root").alias("top"))
    apart = written(_moved(_moved(ways.distinct(), top, "a"), top, "b").filter("a <> b").distinct())
    if apart.isEmpty():
        return roots
    crowds = _labels(nodes, apart).select(F.col("node").alias("root"), F.col("label.node").alias("crowd"))
    sizes = marked.select("node", "n")
    members = written(roots.join(crowds, "root").join(sizes, "node").select("node", "n", "root", "crowd"))
    few = members.count() <= SENT
    first = F.row_number().over(W.partitionBy("crowd").orderBy(F.desc("texts"), "root")) == 1
    ranked = written(members.groupBy("crowd", "root").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("size")).withColumn("main", first))
    texts, size = F.sum("texts"), F.sum("size")
    blocks = F.greatest(F.ceil(size / BLOCK), F.ceil(texts / TEXTS), F.least(F.lit(4), F.ceil(texts / 512))).cast("int")
    texts, size = (F.sum(F.when(~F.col("main"), F.col(c))) for c in ("texts", "size"))
    askers = F.greatest(F.lit(1), F.ceil(size / BLOCK), F.ceil(texts / TEXTS)).cast("int")
    of_crowd = ranked.groupBy("crowd").agg(blocks.alias("blocks"), askers.alias("askers"))
    known = written(members.drop("n").join(ranked.select("crowd", "root", "main"), ["crowd", "root"]).join(of_crowd, "crowd"))

    def cells(count: str, block: Callable[[Column], Column], asker: Callable[[Column], Column], asking: bool) -> Column:
        cell = lambda k: F.struct(block(k).alias("block"), asker(k).alias("asker"), F.lit(asking).alias("asking"))
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), cell)

    own = [F.pmod(F.xxhash64("node"), F.col(count)).cast("int") for count in ("blocks", "askers")]
    there = cells("askers", lambda k: own[0], lambda k: k, False)
    asks = cells("blocks", lambda k: k, lambda k: own[1], True)
    held = marked.join(F.broadcast(known) if few else known, "node")
    sent = held.withColumn("cell", F.explode(F.when(F.col("main"), there).otherwise(F.concat(there, asks))))
    dealt = sent.select("crowd", "cell.block", "cell.asker", "cell.asking", "node", "root", "main", "signature", "shingles")

    def step(table: pa.Table) -> pa.Table:
        asking, main = (table.column(c).to_numpy().astype(bool) for c in ("asking", "main"))
        node, root = (table.column(c).to_numpy() for c in ("node", "root"))
        marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, POOL)
        n = pc.list_value_length(table.column("shingles")).to_numpy().astype(np.int64)
        links = crowd_links(asking, node, root, main, marks, n, pc.list_flatten(table.column("shingles")).to_numpy(), percent)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table([root[a], root[b]], names=["a", "b"])

    links = written(dealt.groupBy("crowd", "block", "asker").applyInArrow(step, "a long, b long"))
    if links.isEmpty():
        return roots
    final = _labels(nodes, links).select(F.col("node").alias("root"), "label")
    moved = roots.join(F.broadcast(final) if few else final, "root", "left")
    return moved.select("node", F.coalesce("label.node", "root").alias("root"), F.coalesce("label.rank", "root_rank").alias("root_rank"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 2, percent: int = 80, orders: int = 32, first: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the distinct
    ``words``-word shingles of its text, the smallest doc_id that is reached
    over texts that share ``percent`` of the union of their shingles or more,
    and whether that is its own.

    A-Z are lower-cased; a text of fewer words is one shingle. Texts without a
    word, null and empty ones, have no shingles, reach nothing and are kept.
    Texts of equal words are one node from the start. Candidates come from
    ``orders`` sorted orders; a pair that shares J of its shingles is found in
    one of them with probability J to the power of the region's depth, about
    log(texts / 8) / log(100) minima for prose: with 32 orders pairs at 0.8 are
    missed once in 10,000 at depth 6 (10 ** 13 texts). ``first`` orders are
    settled first; the others only bring together what is still apart, so a
    group of n near copies costs some n comparisons. In these others texts that
    share CROWD minima meet, however many they are: at 0.8 a pair is missed in
    all 28 once in 34,000. In a crowd they do so in a step of its own, for which
    the texts outside the crowd's largest group are compared with all of it: by
    signatures, and by whole sets until they are linked or none is left that
    may be near. So its time grows with the crowd times these, its rows with
    the texts, times blocks of some 2 ** 20 shingles or 2,048 texts.

    Null ids are the largest; a group of null ids alone has a null id, and its
    rows are kept. Repeated rows give repeated results; an empty table an empty
    one. Other columns are not read. Texts are read once; shingle sets are
    written and only those of candidates are read again.
    """
    own = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    marked = written(_marked(own, words).withColumn("row", F.monotonically_increasing_id()))
    rank = F.coalesce("doc_id", F.lit(_LAST))
    heads = marked.filter("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("node"), F.min(rank).alias("rank"))
    heads = written(heads.select("key", "node", "rank"))
    # The rows that stand for their words, read where they lie.
    single = written(marked.select(F.col("row").alias("node"), "n", "signature").join(heads.select("node"), "node"))
    sets = marked.select(F.col("row").alias("node"), "shingles")
    nodes = heads.select("node", "rank")
    many = single.count()

    start = single.withColumn("root", F.col("node"))
    links = _confirmed(_candidates(_leaves(start, range(first), orders), many * first, percent), sets, percent)
    roots = written(components(nodes, links).select("node", "root"))
    rest = single.join(roots, "node")
    beside, ways = _meetings(_leaves(rest, range(first, orders), orders), many * (orders - first), percent, crowds=True)
    later = _confirmed(beside, sets, percent)
    settled = written(components(nodes, links.union(later)).select("node", "root", "root_rank"))
    own = marked.select(F.col("row").alias("node"), "n", "signature", "shingles")
    settled = _settled_crowds(settled, nodes, ways, own, percent)
    groups = settled.select("node", F.nullif("root_rank", F.lit(_LAST)).alias("component_id"))
    of_key = heads.join(groups, "node").select("key", "component_id")
    joined = marked.select("doc_id", "n", "key").join(of_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
