"""De-duplication: across runs, exact, by URL, by body, and near-duplicate.

"First wins" is always an aggregate with a map-side combine, never a window
over the raw rows: a key that holds a third of the table reaches the reducer
as one row per map task.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hamming, variant_hash
from ..session import cut_lineage

SEEN_REASON = "dedup_incremental_existing_raw_id"


def first_per_key(df: DataFrame, keys: list[str], order: list[str], copies: str | None = None) -> DataFrame:
    """The row with the smallest ``order`` per key, whole."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    aggs = [F.min_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_row")]
    if copies:
        aggs.append(F.count(F.lit(1)).alias("_copies"))
    out = df.groupBy(*keys).agg(*aggs)
    extra = [F.col("_copies").alias(copies)] if copies else []
    picked = {c: F.col(f"_row.`{c}`").alias(c) for c in rest}
    return out.select(*[F.col(c) if c in keys else picked[c] for c in df.columns], *extra)


# --- across runs -----------------------------------------------------------


def registry_id(platform: str = "platform", raw_id: str = "raw_id", strict_reference: bool = False) -> Column:
    """``platform_rawid``. An item without an id has no key and never matches;
    ``strict_reference`` keys all of them as ``platform_`` instead."""
    raw = F.coalesce(F.col(raw_id).cast("string"), F.lit(""))
    key = F.concat(F.col(platform), F.lit("_"), raw)
    return key if strict_reference else F.when(raw != "", key)


def mark_seen(items: DataFrame, registry: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Add ``matched_existing_id``: the registry id the item was seen under.

    ``registry(id, ...)`` may hold an id several times. Items without a key get a
    row number that matches nothing, so they spread instead of meeting in one task.
    """
    known = registry.select(F.col("id").alias("_seen")).distinct()
    key = registry_id(strict_reference=strict_reference)
    salted = F.coalesce(key, F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string")))
    return (
        items.withColumn("_key", salted)
        .join(known, F.col("_key") == F.col("_seen"), "left")
        .withColumnRenamed("_seen", "matched_existing_id")
        .drop("_key")
    )


def drop_seen(items: DataFrame, registry: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Items not seen in an earlier run. Copies inside the batch survive."""
    marked = mark_seen(items, registry, strict_reference)
    return marked.filter(F.col("matched_existing_id").isNull()).drop("matched_existing_id")


def split_seen(items: DataFrame, registry: DataFrame, strict_reference: bool = False) -> DataFrame:
    """All items with ``filter_reason`` set on those seen before."""
    reason = F.when(F.col("matched_existing_id").isNotNull(), SEEN_REASON)
    return mark_seen(items, registry, strict_reference).withColumn("filter_reason", reason)


def registry_additions(new: DataFrame, registry: DataFrame, order: list[str]) -> DataFrame:
    """Rows to append so that every new id is registered once."""
    first = first_per_key(new, ["id"], order)
    return first.join(registry.select("id"), "id", "left_anti")


# --- inside a batch --------------------------------------------------------


def exact(items: DataFrame, content_hash: str, order: list[str], scope: list[str] | None = None, copies: str | None = None) -> DataFrame:
    """First row per content hash and run."""
    return first_per_key(items, [*(scope or []), content_hash], order, copies)


def by_url(candidates: DataFrame, url: str = "detail_url", order: tuple[str, ...] = ("page_no", "pos"), scope: list[str] | None = None) -> DataFrame:
    return first_per_key(candidates, [*(scope or []), url], list(order))


def by_body(pages: DataFrame, body: str = "body_hash", order: tuple[str, ...] = ("seq",), scope: list[str] | None = None) -> DataFrame:
    return first_per_key(pages, [*(scope or []), body], list(order))


def latest_capture(pages: DataFrame, order: tuple[str, ...] = ("captured_at", "page_id"), keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """(url, html): the newest capture of each url (or of other ``keys``), by those of the ``order``
    columns that pages has and then by the hash of the html. Pages without a
    url are left out."""
    rank = F.struct(*[F.col(c) for c in order if c in pages.columns], F.xxhash64("html"))
    return pages.filter(F.col("url").isNotNull()).groupBy(*keys).agg(F.max_by("html", rank).alias("html"))


# --- against the archive ---------------------------------------------------


def drop_archived(pages: DataFrame, archived: DataFrame) -> DataFrame:
    """Pages whose content hash is not stored yet."""
    return pages.join(archived.select("content_hash"), "content_hash", "left_anti")


def drop_archived_by_engine(pages: DataFrame, archived: DataFrame, ocr_results: DataFrame) -> DataFrame:
    """Pages not yet archived as read by their recogniser.

    ``pages(content_hash, ocr_engine, ...)`` is dropped when a stored page has
    its plain or variant hash and no OCR, or has OCR rows of that engine under
    the variant hash, or under the plain hash with that engine on record
    (``archived.ocr_engine``). The alternatives become keys of one semi-join
    over the distinct (hash, engine) pairs.
    """
    stored = archived.select("page_id", "content_hash", F.coalesce("contains_ocr", F.lit(False)).alias("ocr"), "ocr_engine")
    read_by = ocr_results.select("page_id", "engine").distinct()
    key = lambda kind, *parts: F.concat_ws("|", F.lit(kind), *parts).alias("key")
    plain = stored.filter(~F.col("ocr")).select(key("any", "content_hash"))
    read = stored.filter("ocr").join(read_by, "page_id")
    variant = read.select(key("read", "content_hash", "engine"))
    recorded = read.filter(F.col("ocr_engine") == F.col("engine")).select(key("same", "content_hash", "engine"))
    known = plain.unionByName(variant).unionByName(recorded).distinct()
    own = variant_hash(F.col("content_hash"), F.col("ocr_engine"))
    asked = pages.select("content_hash", "ocr_engine").filter(F.coalesce("content_hash", F.lit("")) != "").distinct()
    keys = F.array(key("any", own), key("any", "content_hash"), key("read", own, "ocr_engine"), key("same", "content_hash", "ocr_engine"))
    skip = asked.select("content_hash", "ocr_engine", F.explode(keys).alias("key")).join(known, "key", "left_semi")
    skip = skip.select("content_hash", F.coalesce("ocr_engine", F.lit("")).alias("_engine")).distinct()
    out = pages.withColumn("_engine", F.coalesce("ocr_engine", F.lit("")))
    return out.join(skip, ["content_hash", "_engine"], "left_anti").select(*pages.columns)


# --- near duplicates -------------------------------------------------------


def _mask(bits: range | list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    edges = [round(len(bits) * i / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def band_masks(threshold: int, agree: int = 2) -> list[int]:
    """Bit masks such that two fingerprints within ``threshold`` bits agree on
    at least one: 64 bits in ``threshold + agree`` blocks, any ``agree`` of
    them. More agreeing blocks make longer keys and more copies."""
    blocks = _blocks(list(range(64)), threshold + agree)
    return [_mask([b for block in pick for b in block]) for pick in combinations(blocks, agree)]


def distinct_fingerprints(items: DataFrame, fp: str, seq: str, scope: list[str] | None = None) -> DataFrame:
    """One row per fingerprint with its first position and number of copies.
    A group of copies, however large, is one row from here on."""
    return items.groupBy(*(scope or []), fp).agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("copies"))


def near_pairs(fps: DataFrame, fp: str, threshold: int = 3, scope: list[str] | None = None, agree: int = 3) -> DataFrame:
    """Pairs of distinct fingerprints within ``threshold`` bits.

    Input is the result of ``distinct_fingerprints``. A banded equi-join finds
    the candidates, on the same keys whatever a band holds: ``agree`` blocks
    of ``threshold + agree``, 32 bits at the defaults. A pair that meets in
    several bands is kept in the first one, so no distinct is needed afterwards.
    """
    own, scope = scope or [], ["_scope"] if scope else []
    if threshold <= 0:
        scope, none = own, fps.limit(0)
        return none.select(*scope, F.col("first_seq").alias("a_seq"), F.col("first_seq").alias("b_seq"),
                           F.col(fp).alias("a_fp"), F.col(fp).alias("b_fp"), F.lit(0).alias("distance"))
    masks = band_masks(threshold, agree)
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    # Nulls within a struct are equal, so a null scope has its pairs as well.
    run = [F.struct(*own).alias("_scope")] if own else []
    keyed = fps.select(*run, fp, "first_seq", F.explode(bands).alias("b")).select(*scope, fp, "first_seq", "b.band", "b.key")
    at = [*scope, "band", "key"]
    a = keyed.select(*at, F.col(fp).alias("a_fp"), F.col("first_seq").alias("a_seq"))
    b = keyed.select(*at, F.col(fp).alias("b_fp"), F.col("first_seq").alias("b_seq"))
    diff = F.col("a_fp").bitwiseXOR(F.col("b_fp"))
    first_band = reduce(lambda acc, im: F.when(diff.bitwiseAND(F.lit(im[1])) == 0, im[0]).otherwise(acc),
                        reversed(list(enumerate(masks))), F.lit(-1))
    return (
        a.join(b, at)
        .filter((F.col("a_seq") < F.col("b_seq")) & (hamming("a_fp", "b_fp") <= threshold))
        .filter(first_band == F.col("band"))
        .select(*[F.col("_scope")[c].alias(c) for c in own], "a_seq", "b_seq", "a_fp", "b_fp", hamming("a_fp", "b_fp").alias("distance"))
    )


def near_survivors(items: DataFrame, fp: str, seq: str, threshold: int = 3, scope: list[str] | None = None) -> DataFrame:
    """Greedy removal in input order: an item goes when it is within
    ``threshold`` bits of an earlier item that stays.

    Runs on the pair table of distinct fingerprints. Each round keeps the
    fingerprints with no undecided earlier neighbour and drops theirs; the
    number of rounds is the longest chain of such decisions. A null scope is a
    scope like others: nulls within a struct are equal in joins.
    """
    if scope:
        items, scope = items.withColumn("_scope", F.struct(*scope)), ["_scope"]
    else:
        scope = []
    # Both uses of the items read what is worked out once.
    items = cut_lineage(items)
    fps = cut_lineage(distinct_fingerprints(items, fp, seq, scope))
    pairs = near_pairs(fps, fp, threshold, scope)
    edges = cut_lineage(pairs.select(*scope, F.col("a_fp").alias("early"), F.col("b_fp").alias("late")))
    dropped: list[DataFrame] = []
    while not edges.isEmpty():
        early = edges.select(*scope, F.col("early").alias(fp)).distinct()
        late = edges.select(*scope, F.col("late").alias(fp)).distinct()
        kept = early.join(late, [*scope, fp], "left_anti").withColumnRenamed(fp, "early")
        gone = cut_lineage(edges.join(kept, [*scope, "early"], "left_semi").select(*scope, F.col("late").alias(fp)).distinct())
        dropped.append(gone)
        edges = cut_lineage(
            edges.join(gone.withColumnRenamed(fp, "late"), [*scope, "late"], "left_anti")
            .join(gone.withColumnRenamed(fp, "early"), [*scope, "early"], "left_anti")
            .select(*scope, "early", "late")
        )
    keep = fps
    if dropped:
        keep = keep.join(reduce(DataFrame.unionByName, dropped), [*scope, fp], "left_anti")
    winners = keep.select(*scope, fp, F.col("first_seq").alias(seq))
    return items.join(winners, [*scope, fp, seq], "left_semi").drop("_scope")
