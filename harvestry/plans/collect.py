"""Collection runs: pages to governed items, one plan for one or many rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import run_status
from ..operators import dedup, dom, extract, governance, lists, runs
from ..operators.governance import Policy
from ..session import cut_lineage


@dataclass
class RunOutcome:
    """DataFrames of a run; nothing has been executed yet."""

    raw: DataFrame
    deduped: DataFrame
    filtered: DataFrame
    governed: DataFrame
    summary: DataFrame
    fields: list[str]

    def stages(self) -> DataFrame:
        return runs.stage_union(self.raw, self.governed, self.filtered, self.fields)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "collection_items": runs.item_rows(self.governed, self.fields),
            "collection_run_items": self.stages(),
            "collection_governance_records": runs.governance_rows(self.summary),
        }


def rule_fields(rule: dict) -> list[str]:
    if rule.get("extract"):
        return list(rule["extract"])
    return [f["name"] for f in (rule.get("list") or {}).get("fields", [])]


def rule_platform(rule: dict) -> str:
    source = rule.get("source") or {}
    return source.get("platform") or rule.get("source_id") or rule.get("name") or ""


def collect_items(pages: DataFrame, rule: dict, keys: list[str]) -> DataFrame:
    """Raw items of a rule with run columns ``platform`` and ``seq``.

    ``keys`` identify and order the pages; ``seq`` orders items as they are met.
    """
    path = (rule.get("list") or {}).get("items_path") or "css:html"
    found = extract.parse_items(pages, path, keys)
    at = [*keys, "pos"]
    if rule.get("extract"):
        items = dom.extract_records(found, rule["extract"], at)
    else:
        items = extract.legacy_records(found, rule, at)
    pattern = (rule.get("dedup") or {}).get("url_to_id_pattern")
    if pattern:
        items = extract.fill_raw_id(items, pattern)
    elif "raw_id" not in items.columns:
        items = items.withColumn("raw_id", F.lit(None).cast("string"))
    return items.withColumns({"platform": F.lit(rule_platform(rule)), "seq": F.struct(*at)})


def run_items(items: DataFrame, registry: DataFrame | None, policy: Policy, fields: list[str], scope: list[str] | None = None, strict_reference: bool = False, materialise: bool = False) -> RunOutcome:
    """De-duplicate against earlier runs, govern, and summarise per ``scope``.

    ``materialise`` checkpoints the items and the governed items, for runs
    whose stages go to several tables: pages are then parsed once.
    """
    scope = scope or ["run_id"]
    if registry is None:
        marked = items.withColumns({"matched_existing_id": F.lit(None).cast("string"), "filter_reason": F.lit(None).cast("string")})
    else:
        marked = dedup.split_seen(items, registry, strict_reference)
    marked = cut_lineage(marked) if materialise else marked
    fresh = F.col("matched_existing_id").isNull()
    if not materialise and policy.dedup != "simhash":
        return _run_once(marked, policy, fields, scope)
    kept, filtered = marked.filter(fresh).drop("matched_existing_id", "filter_reason"), marked.filter(~fresh)
    governed = governance.govern(kept, policy, ["seq"], scope, fields)
    governed = cut_lineage(governed) if materialise else governed
    totals = marked.groupBy(*scope).agg(F.count(F.lit(1)).alias("total_collected"), F.count_if(~fresh).alias("dedup_filtered"), F.count_if(fresh).alias("_fresh"))
    kept_stats = governed.groupBy(*scope).agg(F.count(F.lit(1)).alias("_kept"), F.count_if("injection_risk").alias("_risk"), F.avg("field_completeness").alias("_full"))
    run = F.struct(*scope)  # nulls within a struct are equal
    joined = totals.withColumn("_run", run).join(kept_stats.withColumn("_run", run).drop(*scope), "_run", "left")
    items_n, risk = F.coalesce("_kept", F.lit(0)), F.coalesce("_risk", F.lit(0))
    parts = governance.score(items_n, F.col("_full"), risk, policy.min_completeness)
    summary = joined.select(
        *scope, "total_collected", "dedup_filtered", items_n.alias("item_count"), (F.col("_fresh") - items_n).alias("duplicate_count"),
        risk.alias("injection_risk_count"), *[c.alias(n) for n, c in parts.items()],
    )
    raw = marked.drop("matched_existing_id", "filter_reason")
    return RunOutcome(raw, kept, filtered, governed, summary, fields)


def _run_once(marked: DataFrame, policy: Policy, fields: list[str], scope: list[str]) -> RunOutcome:
    """The outcome with totals that come from the governed items: those seen
    before go along emptied, as a group of their own, and every item kept
    tells how many it stands for. So no table of the run reads the items twice."""
    fresh = F.col("matched_existing_id").isNull()
    bare = marked.drop("matched_existing_id", "filter_reason")
    emptied = {c: F.when(fresh, F.col(c)) for c in bare.columns if c not in (*scope, "seq")}
    both = governance.govern(marked.withColumn("_seen", ~fresh).withColumns(emptied).drop("matched_existing_id", "filter_reason"), policy, ["seq"], [*scope, "_seen"], fields, "_copies")
    new = ~F.col("_seen")
    totals = both.groupBy(*scope).agg(
        F.sum("_copies").alias("total_collected"), F.coalesce(F.sum(F.when(~new, F.col("_copies"))), F.lit(0)).alias("dedup_filtered"), F.count_if(new).alias("_kept"),
        F.coalesce(F.sum(F.when(new, F.col("_copies"))), F.lit(0)).alias("_fresh"), F.count_if(new & F.col("injection_risk")).alias("_risk"), F.avg(F.when(new, F.col("field_completeness"))).alias("_full"),
    )
    parts = governance.score(F.col("_kept"), F.col("_full"), F.col("_risk"), policy.min_completeness)
    summary = totals.select(
        *scope, "total_collected", "dedup_filtered", F.col("_kept").alias("item_count"), (F.col("_fresh") - F.col("_kept")).alias("duplicate_count"),
        F.col("_risk").alias("injection_risk_count"), *[c.alias(n) for n, c in parts.items()],
    )
    kept, filtered = marked.filter(fresh).drop("matched_existing_id", "filter_reason"), marked.filter(~fresh)
    return RunOutcome(bare, kept, filtered, both.filter(new).drop("_seen", "_copies"), summary, fields)


def run_rule(pages: DataFrame, rule: dict, registry: DataFrame | None, run_id: str, keys: list[str] | None = None, materialise: bool = False) -> RunOutcome:
    """A whole collection run of one rule over its captured pages."""
    items = collect_items(pages, rule, keys or ["page_id"]).withColumn("run_id", F.lit(run_id))
    fields = rule_fields(rule)
    if "raw_id" in items.columns and "raw_id" not in fields:
        fields = [*fields, "raw_id"]
    return run_items(items, registry, Policy.from_rule(rule), fields, materialise=materialise)


def run_record(outcome: RunOutcome, rule: dict, rule_path: str, started_at: Column, finished_at: Column, output_path: str = "") -> DataFrame:
    """``collection_runs`` rows of a finished run."""
    source = rule.get("source") or {}
    subject = rule.get("subject") or source.get("subject") or rule_platform(rule)
    status = run_status(F.lit(rule.get("enabled", True) and source.get("enabled", True)), F.lit(""), F.col("status"))
    rows = outcome.summary.select(
        "run_id", F.lit(rule.get("name") or rule_path).alias("rule_name"), F.lit(rule_path).alias("rule_path"), F.lit(subject).alias("subject"), F.lit(rule_platform(rule)).alias("platform"),
        status.alias("status"), "total_collected", F.col("item_count").alias("saved_count"), "dedup_filtered", F.lit(output_path).alias("output_path"),
        started_at.alias("started_at"), finished_at.alias("finished_at"), F.lit(None).cast("string").alias("error"),
    )
    return runs.run_rows(rows)


def run_all(items: DataFrame, registry: DataFrame | None, rules: DataFrame, policy: Policy, fields: list[str]) -> tuple[RunOutcome, DataFrame]:
    """All rules as one plan with ``run_id`` in every key, and the run rows
    (run_id, status, saved_count, ...). Disabled rules are skipped."""
    flags = rules.select("run_id", "enabled", "source_enabled", "error")
    active = rules.filter(F.coalesce("enabled", F.lit(True)) & F.coalesce("source_enabled", F.lit(True)) & (F.coalesce("error", F.lit("")) == "")).select("run_id")
    # Rules are few, and a shuffle by rule would send a rule's items to one task.
    outcome = run_items(items.join(F.broadcast(active), "run_id", "left_semi"), registry, policy, fields)
    on = F.coalesce("enabled", F.lit(True)) & F.coalesce("source_enabled", F.lit(True))
    rows = flags.join(outcome.summary.withColumnRenamed("status", "governance_status"), "run_id", "left").select(
        "run_id", run_status(on, F.col("error"), F.col("governance_status")).alias("status"),
        F.coalesce("total_collected", F.lit(0)).alias("total_collected"), F.coalesce("item_count", F.lit(0)).alias("saved_count"),
        F.coalesce("dedup_filtered", F.lit(0)).alias("dedup_filtered"),
    )
    return outcome, rows


def preview_rule(pages: DataFrame, rule: dict, limit: int | None = 5, keys: list[str] | None = None) -> DataFrame:
    """First governed items without registry or sinks. The cut comes after
    governance over all rows."""
    outcome = run_rule(pages, rule, None, "preview", keys)
    return outcome.governed.orderBy("seq").limit(lists.preview_size(limit))
