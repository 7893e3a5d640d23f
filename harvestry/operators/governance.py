"""Record governance: clean, de-duplicate, mark risks, score, summarise."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import record_hash, simhash64
from ..session import spread
from . import dedup


@dataclass(frozen=True)
class Policy:
    """Governance settings of a rule."""

    required_fields: tuple[str, ...] = ()
    min_completeness: float = 0.8
    dedup: str = ""
    simhash_threshold: int = 3
    sanitize: bool = True
    fields: tuple[str, ...] = field(default=())

    @classmethod
    def from_rule(cls, rule: dict) -> "Policy":
        config = rule.get("governance") or {}
        required = config.get("required_fields") or (rule.get("output") or {}).get("fields") or []
        return cls(
            required_fields=tuple(required),
            min_completeness=float(config.get("min_completeness", 0.8)),
            dedup=config.get("dedup", ""),
            simhash_threshold=int(config.get("simhash_threshold", 3)),
            sanitize=bool(config.get("sanitize", True)),
            fields=tuple((rule.get("extract") or {}).keys()),
        )


def completeness(df: DataFrame, required: tuple[str, ...] | list[str]) -> Column:
    """Share of required fields that hold something, 4 digits."""
    if not required:
        return F.lit(1.0)
    present = F.lit(0)
    for name in required:
        if name in df.columns:
            filled = F.coalesce(text.strip(F.col(name).cast("string")) != "", F.lit(False))
            present = present + F.when(filled, 1).otherwise(0)
    return F.round(present / len(required), 4)


def neutralise(df: DataFrame, fields: list[str]) -> DataFrame:
    """Set ``injection_risk`` and clear the phrases from flagged records."""
    strings = [f for f in text.string_fields(df) if f in fields]
    flagged = df.withColumn("injection_risk", text.has_injection(strings))
    return flagged.withColumns({f: F.when(F.col("injection_risk"), text.remove_injection(f)).otherwise(F.col(f)) for f in strings})


def annotate(df: DataFrame, fields: list[str], required: tuple[str, ...] | list[str]) -> DataFrame:
    """Risk removal, then completeness and the stored content hash."""
    safe = neutralise(df, fields)
    return safe.withColumns({"field_completeness": completeness(safe, required), "content_hash": record_hash(safe, fields)})


def govern(items: DataFrame, policy: Policy, order: list[str], scope: list[str] | None = None, fields: list[str] | None = None, copies: str | None = None) -> DataFrame:
    """Governed items of a run with their governance columns.

    ``fields`` are the record's own columns; everything else passes through.
    The de-duplication hash is taken after cleaning and before risk removal.
    ``copies`` names a column with the number of items that each kept one
    stands for; near-duplicates (``simhash``) have none.
    """
    scope = scope or []
    names = list(fields or policy.fields)
    cleaned = text.clean_record(spread(items), names, policy.sanitize)
    if policy.dedup in ("hash", "minhash"):
        hashed = cleaned.withColumn("dedup_hash", record_hash(cleaned, names))
        cleaned = dedup.exact(hashed, "dedup_hash", order, scope, copies)
    elif policy.dedup == "simhash":
        strings = [n for n in names if n in text.string_fields(cleaned)]
        printed = cleaned.withColumn("simhash", simhash64(text.record_text(strings)))
        cleaned = dedup.near_survivors(printed, "simhash", order[0], policy.simhash_threshold, scope)
    elif copies:
        cleaned = cleaned.withColumn(copies, F.lit(1).cast("bigint"))
    return annotate(cleaned, names, policy.required_fields)


def governance_struct(df: DataFrame) -> DataFrame:
    """Fold the governance columns into one ``_governance`` struct."""
    names = ("content_hash", "field_completeness", "injection_risk")
    return df.withColumn("_governance", F.struct(*names)).drop(*names)


def score(item_count: Column, mean_completeness: Column, risk_count: Column, min_completeness: Column | float) -> dict[str, Column]:
    full = F.round(F.coalesce(mean_completeness, F.lit(1.0)), 4)
    floor = F.lit(min_completeness) if isinstance(min_completeness, (int, float)) else min_completeness
    return {
        "field_completeness": full,
        "quality_score": F.round(F.greatest(F.lit(0.0), full - risk_count * 0.1), 4),
        "risk_rate": F.when(item_count > 0, F.round(risk_count / item_count, 4)).otherwise(F.lit(0.0)),
        "status": F.when(full >= floor, "SUCCESS").otherwise("PARTIAL_SUCCESS"),
    }


def summarise_kept(governed: DataFrame, copies: str, scope: list[str], min_completeness: float = 0.8) -> DataFrame:
    """The same from governed items that know how many ``copies`` they stand
    for: one pass over the items."""
    rows = governed.groupBy(*scope).agg(F.count(F.lit(1)).alias("_kept"), F.sum(copies).alias("_in"), F.count_if("injection_risk").alias("_risk"), F.avg("field_completeness").alias("_full"))
    return _summary(rows, scope, F.col("_kept"), F.col("_risk"), min_completeness)


def _summary(rows: DataFrame, scope: list[str], items: Column, risk: Column, min_completeness: float) -> DataFrame:
    parts = score(items, F.col("_full"), risk, min_completeness)
    return rows.select(*scope, items.alias("item_count"), (F.col("_in") - items).alias("duplicate_count"), risk.alias("injection_risk_count"), *[c.alias(n) for n, c in parts.items()])


def summarise(governed: DataFrame, incoming: DataFrame, scope: list[str], min_completeness: float = 0.8) -> DataFrame:
    """One row per run: counts, completeness, quality, status.

    ``incoming`` are the items before governance. Runs that appear only there
    end with zero items, completeness 1.0. Where governed items know their
    copies, ``summarise_kept`` needs no second look at the items.
    """
    total = incoming.groupBy(*scope).agg(F.count(F.lit(1)).alias("_in"))
    kept = governed.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("_kept"),
        F.count_if("injection_risk").alias("_risk"),
        F.avg("field_completeness").alias("_full"),
    )
    if not scope:  # two one-row aggregates
        total, kept = total.withColumn("_one", F.lit(1)), kept.withColumn("_one", F.lit(1))
    else:  # nulls within a struct are equal, so a null run finds its items
        total, kept = total.withColumn("_run", F.struct(*scope)), kept.withColumn("_run", F.struct(*scope)).drop(*scope)
    both = total.join(kept, "_run" if scope else "_one", "left")
    items, risk = F.coalesce(F.col("_kept"), F.lit(0)), F.coalesce(F.col("_risk"), F.lit(0))
    return _summary(both, scope, items, risk, min_completeness)
