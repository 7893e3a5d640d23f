"""Phrase collocations by direct-address tiling.

Texts become blocks of word numbers, one language each. Frequent words are
ranked by frequency and their ids take the numbers' place; neighbouring ids
are pairs. A block's pairs fall into tiles of the pair plane: tiles of the
head, where frequent ids meet, are counted in a dense array addressed by the
pair itself, all others as sorted coordinates. Counts are summed over blocks,
frequent pairs are ranked in their turn, and neighbouring pairs of overlapping
phrases are the pairs of the next round, one word longer.

Ids come to the blocks from a table sent to every task while frequent words or
pairs are few enough, and beyond that by a join on each block's own ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, slices, written

#: Text of a block (a longer one is a block of its own), and of what is split
#: at once; neighbouring ids that are counted at once.
BLOCK, CHUNK, COUNTED = 4 << 20, 1 << 20, 750_000
#: Ids of a row in which a block is kept.
STRETCH = 1 << 14
#: Frequent words or pairs that may be sent to every task.
SENT = 500_000
#: Ids along the side of a tile; a tile is dense if it holds as many pairs as
#: every DENSE-th of its cells.
TILE, DENSE = 256, 8
#: Rows of a batch of a block's entries.
ENTRIES = 1 << 16
# The characters that end a piece of a text.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ")
_EMPTY, _BREAK = -2, -1


def word_numbers(data: bytes, chunk: int = CHUNK) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of lower-cased data in which a line feed ends a
    piece, and for each word its number among them; -1 between pieces."""
    numbers = {b"": _EMPTY, b"\n": _BREAK}
    words: list[bytes] = []
    parts, at = [], 0
    while at < len(data):
        end = at + chunk
        if end < len(data):
            end = max(data.rfind(b" ", at + 1, end), data.rfind(b"\n", at + 1, end))
            if end < 0:
                end = min((x for x in (data.find(b" ", at + chunk), data.find(b"\n", at + chunk)) if x >= 0), default=len(data))
        coded = pa.array(data[at:end].replace(b"\n", b" \n ").split(b" "), pa.binary()).dictionary_encode()
        own: list[int] = []
        for w in coded.dictionary.to_numpy(False).tolist():
            if (number := numbers.get(w)) is None:
                number = numbers[w] = len(words)
                words.append(w)
            own.append(number)
        found = np.array(own, np.int32)[coded.indices.to_numpy(False)]
        parts.append(found[found != _EMPTY])
        at = end
    return words, np.concatenate(parts) if parts else np.empty(0, np.int32)


def count_pairs(a: np.ndarray, b: np.ndarray, tile: int = TILE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) of the distinct pairs of ids. Ids are ranks, so low ones are
    frequent and the tiles where they meet are full."""
    if not len(a):
        none = np.empty(0, np.int64)
        return none, none, none
    base, key, span = _keys(a, b, tile)
    side = span // tile
    in_tile = key // (span * tile) * side + key % span // tile
    tiles, held = np.unique(in_tile, return_counts=True) if side > 1024 else (np.arange(side * side), np.bincount(in_tile, minlength=side * side))
    pairs, counts = [], []
    rest = np.ones(len(a), bool)
    for t in tiles[held >= tile * tile // dense].tolist():
        here = in_tile == t
        rest &= ~here
        own = key[here]
        n = np.bincount(own // span % tile * tile + own % tile, minlength=tile * tile)
        full = np.flatnonzero(n)
        pairs.append((full // tile + t // side * tile) * span + full % tile + t % side * tile)
        counts.append(n[full])
    sparse, n = np.unique(key[rest], return_counts=True)
    key, n = np.concatenate([*pairs, sparse]), np.concatenate([*counts, n])
    return key // span + base, key % span + base, n


def _keys(a: np.ndarray, b: np.ndarray, tile: int = 1) -> tuple[int, np.ndarray, int]:
    """Pairs as whole numbers (a - base) * span + b - base; span is a whole
    number of tiles."""
    base = min(int(a.min()), int(b.min()))
    span = (max(int(a.max()), int(b.max())) - base) // tile * tile + tile
    if span >= 3_000_000_000:
        raise OverflowError("more than 3e9 frequent phrases in one language")
    return base, (a - base) * span + (b - base), span


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Batches of (lang, text) as blocks: language, distinct words, and the
    number of the word at each place."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def blocks() -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang in list(held):
            yield lang, *word_numbers(b"\n".join(held.pop(lang)).lower().translate(_PLAIN))

    for b in slices(batches, 1):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
        if size >= BLOCK:
            yield from blocks()
            size = 0
    yield from blocks()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each block's distinct words, and of null for all of them."""
    for lang, words, at in _texts(batches):
        n = np.bincount(at[at >= 0], minlength=len(words))
        yield _batch({"lang": pa.array([lang]), "word": pa.nulls(1, pa.string()), "n": pa.array([int(n.sum())])})
        for start in range(0, len(words), ENTRIES):
            part = pa.array(words[start : start + ENTRIES], pa.binary()).cast(pa.string())
            yield _batch({"lang": pa.array([lang] * len(part), pa.string()), "word": part, "n": pa.array(n[start : start + ENTRIES])})


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their distinct words, a row each (block, lang, i, word), and
    then the number of the word at each place (i -1, at)."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for lang, words, at in _texts(batches):
        for start in range(0, len(words), ENTRIES):
            part = pa.array(words[start : start + ENTRIES], pa.binary()).cast(pa.string())
            rows = len(part)
            yield _batch({"block": pa.array(np.full(rows, block)), "lang": pa.array([lang] * rows, pa.string()), "i": pa.array(np.arange(start, start + rows)), "word": part, "at": pa.nulls(rows, pa.binary())})
        yield _batch({"block": pa.array([block]), "lang": pa.array([lang]), "i": pa.array([-1]), "word": pa.nulls(1, pa.string()), "at": pa.array([at.astype("<i4").tobytes()], pa.binary())})
        block += 1


def _looked_up(at: np.ndarray, i: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ids of the numbers i in the place of these; -1 for others."""
    table = np.full(max(int(at.max(initial=0)), int(i.max(initial=0))) + 2, -1, np.int64)
    table[i] = ids
    return table[at]  # -1 between pieces is the table's last entry


def _word_ids(shared: Broadcast, width: str):
    """Batches of (lang, text) as blocks of word ids, with all frequent words
    at hand: by language, the words in order and their ids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for lang, words, at in _texts(batches):
            known = shared.value.get(lang, {})
            met = [(i, known[w]) for i, w in enumerate(words) if w in known]
            if met:
                i, ids = np.array(met, np.int64).T
                yield _stretches(block, lang, _looked_up(at, i, ids), width)
            block += 1

    return step


def _stretches(block: int, lang: str, ids: np.ndarray, width: str) -> pa.RecordBatch:
    """A block in rows of some STRETCH ids, cut where no id is: no pair lies
    there, and small values are what readers and writers of tables like."""
    gaps = np.flatnonzero(ids < 0)
    at = np.searchsorted(gaps, np.arange(STRETCH, len(ids), STRETCH))
    cuts = np.unique(gaps[at[at < len(gaps)]])
    parts = [p.astype(width) for p in np.split(ids, cuts) if (p >= 0).any()]
    return _batch({"block": pa.array(np.full(len(parts), block)), "lang": pa.array([lang] * len(parts), pa.string()), "ids": pa.array([p.tobytes() for p in parts], pa.binary())})


def _block(block: int, lang: str, ids: np.ndarray, width: str) -> pa.RecordBatch:
    return _batch({"block": pa.array([block]), "lang": pa.array([lang], pa.string()), "ids": pa.array([ids.astype(width).tobytes()], pa.binary())})


def _blocks(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, pa.RecordBatch, int]]:
    """(block, lang, ids, places whose next place has an id too, batch, row)."""
    for b in batches:
        for row, (block, lang, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):
            ids = np.frombuffer(raw.as_buffer(), width).astype(np.int64)
            yield block, lang, ids, np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)), b, row


def _pairs(width: str, keep_block: bool):
    """Blocks of ids as distinct neighbouring pairs: (a, b, n), of blocks of one
    language together, or with the block in n's place, each for itself."""

    def counted(block: int, firsts: list[np.ndarray], seconds: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b, n = count_pairs(np.concatenate(firsts), np.concatenate(seconds))
        for start in range(0, len(n), ENTRIES):
            own = slice(start, start + ENTRIES)
            third = {"block": pa.array(np.full(len(n[own]), block))} if keep_block else {"n": pa.array(n[own])}
            yield _batch({"a": pa.array(a[own]), "b": pa.array(b[own]), **third})

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for block, lang, ids, both, _, _ in _blocks(batches, width):
            firsts, seconds = held.setdefault(lang, ([], []))
            firsts.append(ids[both])
            seconds.append(ids[both + 1])
            if keep_block or sum(map(len, firsts)) >= COUNTED:
                yield from counted(block, *held.pop(lang))
            if sum(len(x) for f, _ in held.values() for x in f) >= 2 * COUNTED:
                for lang in list(held):
                    yield from counted(block, *held.pop(lang))
        for firsts, seconds in held.values():
            yield from counted(0, firsts, seconds)

    return step


def _paired(ids: np.ndarray, both: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray | None:
    """The ids of known pairs (a, b, id) at the places where they begin; -1
    elsewhere; None if the block has none."""
    out = np.full(len(ids), -1, np.int64)
    if not len(both) or not len(known[0]):
        return None
    base, key, span = _keys(ids[both], ids[both + 1])
    a, b, own = known
    inside = (a >= base) & (a < base + span) & (b >= base) & (b < base + span)
    wanted = (a[inside] - base) * span + (b[inside] - base)
    if not len(wanted):
        return None
    order = np.argsort(wanted)
    wanted, own = wanted[order], own[inside][order]
    place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    out[both] = np.where(wanted[place] == key, own[place], -1)
    return out


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with ``id``, its place in that order from 0, in as many tasks as
    there are partitions: places in a partition, plus the rows of those before."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    sorted_ = written(placed.withColumn("__part", F.shiftright("__at", 33)))
    sizes = sorted_.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = sizes.select("__part", F.coalesce(F.sum("__rows").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return written(sorted_.join(before, "__part").withColumn("id", place).drop("__at", "__part", "__before"))


def _level_one(own: DataFrame, words: DataFrame, count: int, sent: int, width: str) -> DataFrame:
    """(block, lang, ids): the blocks of own (lang, text) with the id of the
    frequent word (lang, word, id) at each place, -1 for other words and
    between pieces. Up to ``sent`` words go to every task; more are joined with
    the distinct words of each block."""
    spark, schema = own.sparkSession, "block long, lang string, ids binary"
    if count <= sent:
        by_lang: dict[str, dict[bytes, int]] = {}
        for lang, word, number in zip(*(c.to_pylist() for c in words.select("lang", "word", "id").toArrow().columns), strict=True):
            by_lang.setdefault(lang, {})[word.encode()] = number
        return own.mapInArrow(_word_ids(spark.sparkContext.broadcast(by_lang), width), schema)
    table = written(own.mapInArrow(_numbered, "block long, lang string, i long, word string, at binary"))
    known = table.filter("i >= 0").select("block", "lang", "i", "word").join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("i", "id")).alias("known"))
    places = table.filter("i < 0").select("block", "lang", "at").join(known, "block").select("block", "lang", "at", "known")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lang, at, met in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                i, ids = (met.values.field(k).to_numpy(False) for k in (0, 1))
                yield _stretches(block, lang, _looked_up(np.frombuffer(at.as_buffer(), "<i4"), i, ids), width)

    return places.mapInArrow(step, schema)


def _next_level(table: DataFrame, pairs: DataFrame, count: int, sent: int, width: str, next_width: str) -> DataFrame:
    """The blocks of table with the ids of frequent pairs (a, b, id) in the
    place of their first id. Pairs come to the blocks like words."""
    spark, schema = table.sparkSession, "block long, lang string, ids binary"
    if count <= sent:
        shared = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in pairs.select("a", "b", "id").toArrow().columns))

        def with_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, lang, ids, both, _, _ in _blocks(batches, width):
                if (out := _paired(ids, both, shared.value)) is not None:
                    yield _block(block, lang, out, next_width)

        return table.mapInArrow(with_all, schema)
    met = table.mapInArrow(_pairs(width, True), "a long, b long, block long").join(pairs, ["a", "b"])
    known = met.groupBy("block").agg(F.collect_list(F.struct("a", "b", "id")).alias("known"))

    def with_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lang, ids, both, b, row in _blocks(batches, width):
            own = b.column(3)[row].values
            if (out := _paired(ids, both, tuple(own.field(k).to_numpy(False) for k in range(3)))) is not None:
                yield _block(block, lang, out, next_width)

    return table.join(known, "block").select("block", "lang", "ids", "known").mapInArrow(with_own, schema)


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, text: str = "text", lang: str = "lang", sent: int = SENT) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n): all word occurrences; and for each length from 1 a table of
    the phrases with ``least`` or more contiguous occurrences within pieces:
    id, lang, words, f, prefixes and suffixes (f of the first and last 1, 2, ...
    words), and from two words on left and right, the ids of the phrase without
    its last and first word."""
    own = docs.select(F.coalesce(column(lang), F.lit("und")).alias("lang"), F.coalesce(column(text), F.lit("")).alias("text"))
    counts = own.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    held = written(counts.filter((F.col("f") >= least) | F.col("word").isNull()))
    totals = held.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    one = F.array("f")
    found = held.filter("word IS NOT NULL").select("lang", F.array("word").alias("words"), "f", one.alias("prefixes"), one.alias("suffixes"))
    levels: list[DataFrame] = []
    table, width = own, ""
    while True:
        # Rows of one language are neighbours, so its ids are near its ranks.
        ids = ranked(found, [F.col("lang"), F.col("f").desc(), F.col("words")])
        levels.append(ids)
        count = ids.count()
        if len(levels) == longest or not count:
            return totals, levels
        next_width = "<i4" if count < 1 << 31 else "<i8"
        if len(levels) == 1:
            table = written(_level_one(own, ids.select("lang", F.col("words")[0].alias("word"), "id"), count, sent, next_width))
        else:
            table = written(_next_level(table, ids.select(F.col("left").alias("a"), F.col("right").alias("b"), "id"), count, sent, width, next_width))
        width = next_width
        counted = table.mapInArrow(_pairs(width, False), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        ends = [ids.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("lang", "words", "prefixes", "suffixes")]) for x in ("a", "b")]
        found = written(counted).join(ends[0], "a").join(ends[1], "b").select(
            F.col("a_lang").alias("lang"),
            F.concat("a_words", F.slice("b_words", -1, 1)).alias("words"),
            "f",
            F.concat("a_prefixes", F.array("f")).alias("prefixes"),
            F.concat("b_suffixes", F.array("f")).alias("suffixes"),
            F.col("a").alias("left"),
            F.col("b").alias("right"),
        )


def _best_cut(size: int) -> Column:
    """The cut of a phrase of so many words with the lowest score, the
    shortest first part first. Products have up to 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for k in range(1, size):
        left, right = F.col("prefixes")[k - 1], F.col("suffixes")[size - k - 1]
        score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole(F.col("f")) * whole(F.col("n")), whole(left) * whole(right))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, most: int = 2000, absorb: int = 100, text: str = "text", lang: str = "lang", sent: int = SENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best
    phrases of 2 to ``longest`` words with ``least`` or more occurrences.

    A-Z are lower-cased, texts are split at . , ; : ! ? and line ends into
    pieces and those at blanks and tabs into words; phrases lie within pieces,
    and overlapping occurrences count. n are all words of the language, a the
    phrase's occurrences, l and r those of its two parts at the cut with the
    lowest score floor(1000 * a * n / (l * r)), ties to the shorter first part;
    all whole numbers, exact. A phrase goes if a longer candidate (of up to
    ``longest`` words) that contains it has ``absorb`` percent of its
    occurrences or more; it is enough to look one word further, as phrases
    between the two are no rarer than the longer one. Order: score and a
    falling, phrase rising in bytes.

    Null languages are ``und``, null texts empty. Repeated rows count again. A
    text of any length is read whole, a word too. Other columns are not read.
    An empty table gives an empty result. Each round writes its blocks and
    counts to the shared folder, which lost tasks read again. ``sent``: frequent
    words or pairs up to which their ids go to every task.
    """
    totals, levels = frequent_phrases(docs, longest, least, text, lang, sent)
    parts = []
    for size, level in enumerate(levels[1:], 2):
        own = level
        if size < len(levels):
            longer = levels[size].select("left", "right", F.col("f").alias("of"))
            ends = longer.select(F.col("left").alias("id"), "of").union(longer.select(F.col("right").alias("id"), "of"))
            above = ends.groupBy("id").agg(F.max("of").alias("of"))
            own = level.join(above, "id", "left").filter(F.coalesce(100 * F.col("of") < absorb * F.col("f"), F.lit(True)))
        cut = own.join(totals, "lang").withColumn("cut", _best_cut(size))
        parts.append(cut.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")))
    every = parts[0] if parts else totals.select("lang", F.lit("").alias("phrase"), *[F.col("n").alias(c) for c in ("a", "l", "r", "n", "score")]).limit(0)
    for p in parts[1:]:
        every = every.union(p)
    # A language's best are among the best of each of its parts.
    by_rank = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(W.partitionBy("lang", "__part").orderBy(*by_rank))
    best = every.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("__rank", some).filter(F.col("__rank") <= most)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*by_rank)).cast("long")
    return best.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
