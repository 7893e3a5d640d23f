"""A corpus from raw documents to token ids: quality rules, near-duplicates,
mix of sources, encoding. Each stage works on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import bpe, common, mixing, quality, simhash
from harvestry.llm.queries import vocabulary
from harvestry.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules.

    Null and empty texts go, as do all under 20 words. The verdict is joined
    back by a hash of the whole row, so repeated rows are judged alike and all
    stay or go."""
    configure(spark)
    row = F.xxhash64(*[common.column(c) for c in docs.columns])
    judged = quality.judge(docs.select(row.alias("row"), "text", "lang"))
    kept = judged.filter("kept").select("row").distinct()
    return docs.withColumn("__row", row).join(kept, F.col("__row") == F.col("row"), "left_semi").drop("__row")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, of
    which 0.8 or more are shared."""
    configure(spark)
    return simhash.deduplicate(docs, words=5, similarity=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: sources weigh 5, 2, 1 in
    turn and share as many words as there are, at most three times their own."""
    configure(spark)
    mixed = mixing.mix(docs, common.word_count(F.col("text")))
    repeated = mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[common.column(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with what they decode to as a digest."""
    configure(spark)
    coded = bpe.encode(docs.select("doc_id", "source", "text"), vocabulary(), decoded=True)
    return coded.select("doc_id", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("mixing sources to target weights", source_mix), ("BPE encoding and decoding", token_ids)]

# Hashes of shingles and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
