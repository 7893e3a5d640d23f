"""Many collection rules as one plan over their captured pages.

Rules are compiled by shape: a list selector, a field definition, a set of
required fields or a policy that several rules share is one expression, taken
for the rows of those rules. Every page is parsed once, and its items are one
table from there on, whatever rule they belong to; the settings that differ
are columns of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import record_hash, simhash64
from ..functions.text import run_status
from ..operators import dedup, dom, extract, governance
from ..operators.governance import Policy
from ..operators.selectors import selector_paths
from ..session import cut_lineage
from ..sources.html_nodes import with_fragment
from .collect import RunOutcome, rule_fields, rule_platform


@dataclass(frozen=True)
class Compiled:
    """Rules by run id, and those that don't run: switched off or faulty."""

    rules: dict[str, dict]
    skipped: dict[str, dict] = field(default_factory=dict)
    faulty: dict[str, str] = field(default_factory=dict)

    def policy(self, run: str) -> Policy:
        return Policy.from_rule(self.rules[run])

    def fields(self, run: str) -> list[str]:
        return list(dict.fromkeys([*rule_fields(self.rules[run]), "raw_id"]))


def run_of(rule: dict) -> str:
    return rule.get("rule_id") or rule.get("name") or ""


def _check(rule: dict) -> None:
    path = (rule.get("list") or {}).get("items_path") or "css:html"
    if not path.startswith(("css:", "xpath:")):
        raise ValueError(f"unsupported path: {path!r}")
    if not rule.get("extract"):
        raise ValueError("the rule has no extract section")
    if selector_paths(path)[0].value:
        raise ValueError(f"items have to be nodes: {path!r}")
    for definition in rule["extract"].values():
        if definition.get("selector"):
            selector_paths(definition["selector"])
    if Policy.from_rule(rule).dedup not in ("", "none", "hash", "minhash", "simhash"):
        raise ValueError(f"unknown dedup mode: {rule['governance']['dedup']!r}")


def compile_rules(rules: list[dict]) -> Compiled:
    """Rules in their order. A rule that can't be read is set aside with its
    fault and leaves the others alone; so is the second of one name."""
    good: dict[str, dict] = {}
    skipped, faulty = {}, {}
    for at, rule in enumerate(rules):
        run = run_of(rule) or f"rule {at + 1}"
        if run in good or run in skipped or run in faulty:
            faulty[f"{run} ({at + 1})"] = f"the name {run!r} is taken"
        elif not (rule.get("enabled", True) and (rule.get("source") or {}).get("enabled", True)):
            skipped[run] = rule
        else:
            try:
                _check(rule)
                good[run] = rule
            except ValueError as fault:
                faulty[run] = str(fault)
    return Compiled(good, skipped, faulty)


def by_rule(values: dict[str, Hashable], make: Callable[[Hashable, Column], Column | None]) -> Column:
    """One expression for each distinct value, for the rows of its rules;
    null for a value of which nothing is made. ``make`` gets the value and the
    condition that a row belongs to it."""
    groups: dict[Hashable, list[str]] = {}
    for run, value in values.items():
        groups.setdefault(value, []).append(run)
    out: Column | None = None
    for value, runs in groups.items():
        own = F.col("run_id").isin(*runs)
        made = make(value, own)
        if made is not None:
            out = F.when(own, made) if out is None else out.when(own, made)
    return out if out is not None else F.lit(None)


def rule_items(pages: DataFrame, compiled: Compiled, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, pos, run_id, platform, seq, raw_id and the fields of all rules)
    of every item. ``pages`` may name the rule of each page in ``run_id``;
    without that column every rule reads every page. A list field that
    other rules define otherwise is JSON text."""
    named = "run_id" in pages.columns
    paths: dict[str, list[str]] = {}
    for run, rule in compiled.rules.items():
        paths.setdefault((rule.get("list") or {}).get("items_path") or "css:html", []).append(run)
    parsed = with_fragment(pages.select(*keys, *(["run_id"] if named else []), html), html)
    page = F.col("dom")
    found = []
    for path, runs in paths.items():
        own = F.col("run_id").isin(*runs) if named else F.lit(True)
        nodes = F.coalesce(dom.select_nodes(F.when(own, page), path), F.slice(page["nodes"], 1, 0))
        names = F.array(*[F.lit(r) for r in runs])
        found.append(F.transform(nodes, lambda n, i: F.struct(i.alias("pos"), names.alias("runs"), dom.sub_fragment(page, n).alias("item"))))  # noqa: B023
    marked = parsed.select(*keys, *([F.col("run_id").alias("own_run")] if named else []), F.explode(F.concat(*found)).alias("x"))
    items = marked.select(*keys, *(["own_run"] if named else []), "x.pos", F.explode("x.runs").alias("run_id"), "x.item")
    if named:
        items = items.filter(F.col("run_id") == F.col("own_run")).drop("own_run")

    names = list(dict.fromkeys(f for run in compiled.rules for f in rule_fields(compiled.rules[run])))
    columns = []
    for name in names:
        definitions = {run: json.dumps(rule["extract"][name], sort_keys=True) if name in rule["extract"] else None for run, rule in compiled.rules.items()}
        kinds = {json.loads(d).get("type") == "list" for d in definitions.values() if d}
        columns.append(by_rule(definitions, lambda d, own, mixed=len(kinds) > 1: _field(json.loads(d), own, mixed) if d else None).alias(name))
    rows = items.select(*keys, "pos", "run_id", *columns)
    patterns = {run: (rule.get("dedup") or {}).get("url_to_id_pattern") for run, rule in compiled.rules.items()}
    raw = F.col("raw_id") if "raw_id" in names else F.lit(None).cast("string")
    url = F.col("url") if "url" in names else F.lit("")
    rows = rows.withColumn("raw_id", F.coalesce(F.when(F.coalesce(raw, F.lit("")) == "", by_rule(patterns, lambda p, _: extract.raw_id_of(url, p) if p else None)), raw))
    platform = by_rule({run: rule_platform(rule) for run, rule in compiled.rules.items()}, lambda p, _: F.lit(p))
    return rows.withColumns({"platform": platform, "seq": F.struct(*keys, "pos")})


def _field(definition: dict, own: Column, mixed: bool) -> Column:
    """A field of the items of some rules; items of others cost nothing."""
    from ..functions.transforms import apply_transforms

    value = dom.field_column(F.when(own, F.col("item")), definition)
    if definition.get("type") == "list":
        return F.to_json(value) if mixed else value
    return apply_transforms(value, definition["transform"]) if definition.get("transform") else value


def govern_rules(items: DataFrame, compiled: Compiled) -> DataFrame:
    """Governed items, each by its rule's settings: cleaned or not, alike by
    hash, by fingerprint within the rule's distance, or not at all."""
    runs = list(compiled.rules)
    policies = {run: compiled.policy(run) for run in runs}
    fields = {run: tuple(compiled.fields(run)) for run in runs}
    every = list(dict.fromkeys(f for own in fields.values() for f in own))
    strings = [f for f in text.string_fields(items) if f in every]
    sanitised = by_rule({run: p.sanitize for run, p in policies.items()}, lambda s, _: F.lit(s))
    flagged = items.withColumn("_sanitise", sanitised)
    cleaned = flagged.withColumns({f: F.when(F.col("_sanitise"), text.clean_value(f, True)).otherwise(text.clean_value(f, False)) for f in strings if not f.startswith("_")}).drop("_sanitise")

    modes = {run: (p.dedup, p.simhash_threshold if p.dedup == "simhash" else 0) for run, p in policies.items()}
    parts = []
    for mode, threshold in dict.fromkeys(modes.values()):
        of = cleaned.filter(F.col("run_id").isin(*[run for run, m in modes.items() if m == (mode, threshold)]))
        if mode in ("hash", "minhash"):
            hashed = of.withColumn("dedup_hash", by_rule(fields, lambda f, _: record_hash(of, list(f))))
            of = dedup.exact(hashed, "dedup_hash", ["seq"], ["run_id"]).drop("dedup_hash")
        elif mode == "simhash":
            printed = of.withColumn("simhash", simhash64(by_rule(fields, lambda f, _: text.record_text([c for c in f if c in strings]))))
            of = dedup.near_survivors(printed, "simhash", "seq", threshold, ["run_id"]).drop("simhash")
        parts.append(of)
    kept = parts[0]
    for p in parts[1:]:
        kept = kept.unionByName(p)
    safe = governance.neutralise(kept, every)
    required = {run: tuple(p.required_fields) for run, p in policies.items()}
    return safe.withColumns(
        {"field_completeness": by_rule(required, lambda r, _: governance.completeness(safe, r)), "content_hash": by_rule(fields, lambda f, _: record_hash(safe, list(f)))}
    )


def run_rules(pages: DataFrame, rules: list[dict], registry: DataFrame | None = None, keys: list[str] | None = None) -> tuple[RunOutcome, DataFrame]:
    """All rules over their pages, and a row for each: run_id, status
    (success, partial_success, failed, skipped), total_collected, saved_count,
    dedup_filtered and error. Each rule keeps its own list selector, fields,
    id pattern, registry platform, cleaning, de-duplication mode and distance,
    required fields and completeness; a rule that is off or faulty has a row
    and nothing else. Rules whose pages hold no items end with zero.

    The items are checkpointed once: stages, governed items and totals come
    from one parse of each page."""
    spark, compiled = pages.sparkSession, compile_rules(rules)
    flags = [(run, True, "") for run in compiled.rules] + [(run, False, "") for run in compiled.skipped] + [(run, True, fault) for run, fault in compiled.faulty.items()]
    listed = spark.createDataFrame(flags, "run_id string, enabled boolean, error string")
    if not compiled.rules:
        none = spark.createDataFrame([], "run_id string")
        zero = [F.lit(0).cast("bigint").alias(n) for n in ("total_collected", "saved_count", "dedup_filtered")]
        return RunOutcome(none, none, none, none, none, []), listed.select("run_id", run_status(F.col("enabled"), F.col("error"), F.lit("")).alias("status"), *zero, "error")
    items = rule_items(pages, compiled, keys or ["page_id"])
    if registry is None:
        marked = items.withColumns({"matched_existing_id": F.lit(None).cast("string"), "filter_reason": F.lit(None).cast("string")})
    else:
        marked = dedup.split_seen(items, registry)
    marked = cut_lineage(marked)
    fresh = F.col("matched_existing_id").isNull()
    kept, filtered = marked.filter(fresh).drop("matched_existing_id", "filter_reason"), marked.filter(~fresh)
    governed = cut_lineage(govern_rules(kept, compiled))

    totals = marked.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_collected"), F.count_if(~fresh).alias("dedup_filtered"), F.count_if(fresh).alias("_fresh"))
    stats = governed.groupBy("run_id").agg(F.count(F.lit(1)).alias("_kept"), F.count_if("injection_risk").alias("_risk"), F.avg("field_completeness").alias("_full"))
    floors = spark.createDataFrame([(run, compiled.policy(run).min_completeness) for run in compiled.rules], "run_id string, _floor double")
    joined = floors.join(totals, "run_id", "left").join(stats, "run_id", "left").fillna(0, ["total_collected", "dedup_filtered", "_fresh", "_kept", "_risk"])
    parts = governance.score(F.col("_kept"), F.col("_full"), F.col("_risk"), F.col("_floor"))
    summary = joined.select(
        "run_id", "total_collected", "dedup_filtered", F.col("_kept").alias("item_count"), (F.col("_fresh") - F.col("_kept")).alias("duplicate_count"),
        F.col("_risk").alias("injection_risk_count"), *[c.alias(n) for n, c in parts.items()],
    )
    rows = listed.join(summary.withColumnRenamed("status", "_status"), "run_id", "left").select(
        "run_id", run_status(F.col("enabled"), F.col("error"), F.col("_status")).alias("status"),
        *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("total_collected", "total_collected"), ("item_count", "saved_count"), ("dedup_filtered", "dedup_filtered"))], "error",
    )
    every = list(dict.fromkeys(f for run in compiled.rules for f in compiled.fields(run)))
    raw = marked.drop("matched_existing_id", "filter_reason")
    return RunOutcome(raw, kept, filtered, governed, summary, every), rows
