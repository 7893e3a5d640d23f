"""Content classes by keywords and URL patterns, all found in one pass.

The patterns of a rule table become one automaton, built once in a worker, and
a text is read once whatever the number of patterns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

#: Rows of a rule table at most; it is settings, not data.
MOST_RULES = 1_000_000
_HITS = "array<struct<label:string,hits:bigint>>"


class Patterns:
    """Labelled patterns as an automaton. ``^`` at the start and ``$`` at the
    end of a pattern tie it to the text's ends; case doesn't matter."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        owners: dict[str, list[tuple[str, bool, bool]]] = {}
        for label, pattern in rules:
            first, last = pattern.startswith("^"), pattern.endswith("$")
            literal = pattern[first : len(pattern) - last].lower()
            if not literal:
                raise ValueError(f"empty pattern of {label!r}")
            owners.setdefault(literal, []).append((label, first, last))
        self.automaton = ahocorasick.Automaton()
        for literal, own in owners.items():
            self.automaton.add_word(literal, (len(literal), sorted(set(own))))
        if owners:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> Counter[str]:
        """Occurrences by label, overlapping ones as well."""
        found: Counter[str] = Counter()
        if text and len(self.automaton):
            low = text.lower()
            for end, (size, own) in self.automaton.iter(low):
                for label, first, last in own:
                    if not (first and end + 1 != size or last and end + 1 != len(low)):
                        found[label] += 1
        return found


_BUILT: dict[str, tuple[Patterns, Patterns]] = {}


def classify(rows: DataFrame, rules: DataFrame, text: Column | str = "text", url: Column | str | None = None) -> DataFrame:
    """rows with ``classes``, (label, hits) by falling hits and then label,
    and ``label``, the first of them or null.

    rules: (label, kind, pattern), kind ``keyword`` for the text and ``url``
    for the address. Null texts have no hits. The rule table is read to the
    driver once, and refused beyond a million rows."""
    table = rules.select("label", "kind", "pattern").filter("pattern IS NOT NULL AND label IS NOT NULL").distinct().limit(MOST_RULES + 1).collect()
    if len(table) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    unknown = {r.kind for r in table} - {"keyword", "url"}
    if unknown:
        raise ValueError(f"unknown kinds of rules: {sorted(map(str, unknown))}")
    split = [sorted((r.label, r.pattern) for r in table if r.kind == kind) for kind in ("keyword", "url")]
    for own in split:
        Patterns(own)  # faults show here and not in a task
    shared = rows.sparkSession.sparkContext.broadcast(split)
    key = str(shared._jbroadcast.id()) if hasattr(shared, "_jbroadcast") else str(id(shared))

    @F.arrow_udf(_HITS)
    def found(texts: pa.Array, urls: pa.Array) -> pa.Array:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = (Patterns(shared.value[0]), Patterns(shared.value[1]))
        words, places = _BUILT[key]
        out = []
        for t, u in zip(texts.to_pylist(), urls.to_pylist(), strict=True):
            both = words.hits(t) + places.hits(u)
            out.append([{"label": label, "hits": n} for label, n in sorted(both.items(), key=lambda x: (-x[1], x[0]))])
        return pa.array(out, pa.list_(pa.struct([("label", pa.string()), ("hits", pa.int64())])))

    address = col(url) if url is not None else F.lit(None).cast("string")
    marked = rows.withColumn("classes", found(col(text), address))
    return marked.withColumn("label", F.get("classes", F.lit(0))["label"])
