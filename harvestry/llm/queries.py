"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Tables
from ..session import scratch_folder
from . import bpe, collocations, forest, licenses, mixing, quality, quotes, records, sharding, simhash, topk, urls, whitening
from .common import word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return wrap


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


@query()
def op1_histogram_shards(t: Tables) -> DataFrame:
    """40 shards of near equal bytes in doc_id order."""
    docs = t.documents.select("doc_id", "text")
    size = _bytes(F.col("text")) + 16
    shards = sharding.shard_by_bytes(docs, F.col("doc_id"), size, shards=40)
    return shards.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS draw, row_number() OVER () AS row
  FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM named
), filled AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM weighed
), levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled
), pick AS (
  SELECT ratio AS full_to, level AS share FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1
), goals AS (
  SELECT source, source_size, CASE WHEN ratio < full_to THEN cap ELSE least(cap, share * w) END AS target FROM levels, pick
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM goals
), running AS (
  SELECT s.*, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS budget,
    sum(size) OVER (PARTITION BY s.source ORDER BY draw, row ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (size * least(3, copies + CASE WHEN source_size > 0 AND 2 * upto - size <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""


@query(_MIX_SQL)
def op2_source_mix(t: Tables) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = t.documents.select("doc_id", "text", "source")
    size = word_count(F.col("text"))
    mixed = mixing.mix(docs, size)
    return mixed.select("doc_id", size.alias("size"), "source_size", "target", (F.col("copies") * size).cast("long").alias("taken"))


def vocabulary() -> str:
    """Place of the public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op3_trie_bpe(t: Tables) -> DataFrame:
    """Token ids of every text and the text they decode to."""
    coded = bpe.encode(t.documents.select("doc_id", "text"), vocabulary(), decoded=True)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query()
def op4_token_records(t: Tables) -> DataFrame:
    """Token ids written to record files and read back."""
    folder = scratch_folder(t.spark)
    records.write_records(t.documents, folder, vocabulary(), end_id=1)
    read = records.read_records(t.spark, folder).select("file", "record", "doc_id", F.crc32("ids").alias("ids_crc32"))
    places = records.read_index(t.spark, folder).select("file", "record", "start", "n_tokens")
    return read.join(places, ["file", "record"]).select("doc_id", "start", "n_tokens", "ids_crc32")


_TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query(_TOP_SQL)
def op5_top_k_search(t: Tables) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    return topk.top_k(t.embeddings, F.col("vec_id") % 20 == 0, k=20)


@query()
def op6_distribution_quality(t: Tables) -> DataFrame:
    """Plain rules and distances to language references for every document."""
    judged = quality.judge(t.documents.select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


@query()
def op9_simhash_components(t: Tables) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_classes(t.documents.select("doc_id", "text"), words=3, budget=2)


def quoting(messages: DataFrame) -> DataFrame:
    """The conversations as mail would carry them: every message after the
    first quotes the one before it in full, and that one's answer to its own
    predecessor a level deeper."""
    marked = lambda text, mark: F.regexp_replace(F.concat(F.lit(mark), text), "\n", "\n" + mark)
    earlier = [messages.select(F.col("conv_id").alias("c"), (F.col("turn") + k).alias("t"), F.col("text").alias(f"text{k}")) for k in (1, 2)]
    joined = messages
    for e in earlier:
        joined = joined.join(e, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t")
    text = F.concat_ws("\n", marked(F.col("text2"), ">> "), marked(F.col("text1"), "> "), F.col("text"))
    return joined.select("conv_id", "turn", "role", text.alias("text"))


@query()
def op7_quotation_threads(t: Tables) -> DataFrame:
    """Threads of all conversations, sent as mail that quotes."""
    return quotes.link(quoting(t.conversations.select("conv_id", "turn", "role", "text")))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Names that a host of the block list has among its labels.
BAD_NAMES = ["spam-farm", "cheap-pills", "casino", "free-money"]
_URL_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS params
  FROM pages
), forms AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^(?:www|m)\.', ''), ':(?:80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
  FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM forms WHERE len(list_filter(string_split(host, '.'), lambda p: p IN ('spam-farm', 'cheap-pills', 'casino', 'free-money'))) > 0
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM forms
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query(_URL_SQL)
def op8_url_filter(t: Tables) -> DataFrame:
    """Verdict on every page; the list holds the addresses of bad hosts."""
    listed = t.pages.filter(F.arrays_overlap(F.split(urls.host(F.col("url")), r"\."), F.array(*[F.lit(n) for n in BAD_NAMES]))).select("url")
    judged = urls.judge(t.pages.select("page_id", "url"), listed, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op10_license_notices(t: Tables) -> DataFrame:
    """License phrases and fuzzy notices of every document."""
    found = licenses.scan(t.documents.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_PHRASE_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 100
), cut AS (
  SELECT *, array_to_string(w[1:j], ' ') AS first_part, array_to_string(w[j + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates)
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, t.n, j, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut c JOIN totals t ON t.lang = c.lang JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM candidates q WHERE q.lang = s.lang AND q.k > s.k AND 100 * q.a >= 100 * s.a AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


@query(_PHRASE_SQL)
def op11_phrase_collocations(t: Tables) -> DataFrame:
    """Each language's best collocations of two to five words."""
    return collocations.collocations(t.documents.select("lang", "text"))


@query()
def op12_minhash_forest(t: Tables) -> DataFrame:
    """Group of every document whose word pairs are 0.8 alike."""
    return forest.near_groups(t.documents.select("doc_id", "text"), words=2, percent=80)


@query()
def op13_embedding_whitening(t: Tables) -> DataFrame:
    """Every embedding on its first eight principal components, whitened."""
    return whitening.whiten(t.embeddings, components=8)
