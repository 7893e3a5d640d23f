"""Source registry: derivation from rules, trust, synchronisation, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_rule_path
from ..functions.urls import domain_of

HISTORY_RUNS = 20
# Base trust and the weight of history.
TRUST_ENABLED, TRUST_DISABLED = 0.85, 0.3
WEIGHT_HISTORY, WEIGHT_BASE = 0.6, 0.4


def is_enabled(rule_flag: str = "enabled", source_flag: str = "source_enabled"):
    """Both flags, each true when absent."""
    return F.coalesce(rule_flag, F.lit(True)) & F.coalesce(source_flag, F.lit(True))


def resolve_subject(*candidates: str):
    """First non-empty of rule subject, source subject, platform."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in candidates])


def derive_sources(rules: DataFrame) -> DataFrame:
    """Registry rows from a rules table (rule_path, name, source_id, subject,
    source_subject, platform, source_name, source_type, source_url, enabled,
    source_enabled, auth_type, tags, update_frequency, anti_crawl_level,
    language)."""
    stem = F.regexp_replace(F.regexp_extract(F.replace("rule_path", F.lit("\\"), F.lit("/")), r"([^/]+)\z", 1), r"\.ya?ml\z", "")
    platform = F.coalesce(F.nullif("platform", F.lit("")), F.nullif("source_id", F.lit("")), stem)
    rows = rules.withColumns({"_platform": platform, "_enabled": is_enabled()})
    on = F.col("_enabled")
    kind = F.coalesce("source_type", F.lit("html"))
    return rows.select(
        F.coalesce(F.nullif("source_id", F.lit("")), normalize_rule_path("rule_path")).alias("id"),
        F.coalesce(F.nullif("source_name", F.lit("")), F.nullif("name", F.lit("")), F.col("_platform")).alias("name"),
        domain_of("source_url", F.lit("")).alias("domain"),
        F.when(kind == "api", "api").otherwise("website").alias("type"),
        F.coalesce(F.nullif("subject", F.lit("")), F.nullif("source_subject", F.lit("")), F.lit("")).alias("category"),
        F.when(on, TRUST_ENABLED).otherwise(TRUST_DISABLED).alias("trust_score"),
        F.coalesce("update_frequency", F.lit(3600)).alias("update_frequency"),
        F.coalesce("anti_crawl_level", F.lit("low")).alias("anti_crawl_level"),
        kind.alias("parser_strategy"),
        F.when(F.coalesce("auth_type", F.lit("none")) != "none", 1).otherwise(0).alias("auth_required"),
        F.coalesce("language", F.lit("zh-CN")).alias("language"),
        "tags", F.when(on, 1).otherwise(0).alias("enabled"),
        F.when(on, "ACTIVE").otherwise("PAUSED").alias("lifecycle_status"),
        normalize_rule_path("rule_path").alias("rule_path"), F.col("_platform").alias("platform"),
    )


def history_trust(records: DataFrame, order: tuple[str, ...] = ("created_at",), runs: int = HISTORY_RUNS) -> DataFrame:
    """Mean quality of the latest runs per platform. The row-number filter is
    applied before the shuffle too, so a busy platform sends few rows."""
    latest = W.partitionBy("platform").orderBy(*[F.col(c).desc() for c in order])
    top = records.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= runs)
    return top.groupBy("platform").agg(F.round(F.avg("quality_score"), 4).alias("history"))


def blend_trust(sources: DataFrame, history: DataFrame) -> DataFrame:
    """60 % history and 40 % base; the base alone without history."""
    base = F.when(F.col("enabled") == 1, TRUST_ENABLED).otherwise(TRUST_DISABLED)
    mixed = F.round(WEIGHT_HISTORY * F.col("history") + WEIGHT_BASE * base, 4)
    return sources.drop("trust_score").join(history, "platform", "left").withColumn("trust_score", F.coalesce(mixed, base)).drop("history")


def sync_sources(registry: DataFrame, derived: DataFrame) -> DataFrame:
    """Registry after an upsert by id; rows under ``rules/`` whose rule is gone
    are removed."""
    columns = [c for c in registry.columns if c in derived.columns]
    fresh = derived.select(*columns)
    kept = registry.select(*columns).join(fresh.select("id"), "id", "left_anti")
    path = F.replace("rule_path", F.lit("\\"), F.lit("/"))
    current = fresh.select(path.alias("_path")).distinct()
    orphan = kept.withColumn("_path", path).filter(F.startswith("_path", F.lit("rules/"))).join(current, "_path", "left_anti").select("id")
    return kept.join(orphan, "id", "left_anti").unionByName(fresh)


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.col("enabled").desc(), "category", "name")


def source_summary(sources: DataFrame) -> DataFrame:
    return sources.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("lifecycle_status") == "ACTIVE").alias("active"),
        F.count_if(F.col("lifecycle_status") == "PAUSED").alias("paused"),
        # As decimals: a sum of doubles depends on the order of its rows, and with it a tie.
        F.coalesce(F.round(F.avg(F.col("trust_score").cast("decimal(20,10)")), 4).cast("double"), F.lit(0.0)).alias("avg_trust_score"),
    )


def mark_drift(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """current(rule_path, dom_structure_hash) + baseline and ``dom_drifted``;
    without a baseline nothing has drifted."""
    base = baselines.select("rule_path", F.col("dom_hash").alias("dom_baseline_hash"))
    drift = F.coalesce((F.col("dom_baseline_hash") != "") & (F.col("dom_baseline_hash") != F.col("dom_structure_hash")), F.lit(False))
    return current.join(base, "rule_path", "left").withColumn("dom_drifted", drift)


def set_baseline(baselines: DataFrame, current: DataFrame) -> DataFrame:
    """Baselines with the rules of ``current`` replaced."""
    fresh = current.select("rule_path", F.col("dom_structure_hash").alias("dom_hash"))
    return baselines.select("rule_path", "dom_hash").join(fresh.select("rule_path"), "rule_path", "left_anti").unionByName(fresh)
