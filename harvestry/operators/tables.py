"""Tables out of recognised text: lines, word boxes, grids and cells.

One image is one row and its words, lines and cells are arrays in that row, so
every step is a projection without a shuffle. Parsers return a struct
``records, errors, semi`` or NULL, which makes the cascade a ``coalesce``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.ocr import ocr_item_fields
from ..functions.text import collapse_ws, col, first_integer, is_integer_text, let, lines, markdown_cell, strip, words as split_words
from ..functions.transforms import WORD

# Marker texts of half-structured results.
REVIEW_TITLE = "OCR 半结构化结果"
ERROR_NO_HEADER = "未识别到表头或列数不一致"
ERROR_NO_PAIRS = "未识别到键值字段"
ERROR_EMPTY = "OCR 结果为空"
ARITY_ERROR = ("第 ", " 行列数不一致")
PARTIAL_ERROR = ("第 ", " 行字段不完整")
REPAIR_REASON = "连续序号纠错"
LINE_TABLE_HEADER = ("序号", "案例名称", "牵头单位", "参与单位")
DELIMITERS = ("|", "\t", ",")
NOISE_TEXTS = ("I", "l", "|", "丨")
MISREAD_ONE = ("11", "I1", "l1", "|1")
COLUMN_SHARES = (0.13, 0.43, 0.66)

RECORD = T.MapType(T.StringType(), T.StringType())
_STRINGS = T.ArrayType(T.StringType())


def _mapping(pairs: dict[str, str] | None) -> Column:
    items = [F.lit(x) for kv in (pairs or {}).items() for x in kv if kv[1]]
    return F.create_map(*items) if items else F.map_from_arrays(F.array().cast(_STRINGS), F.array().cast(_STRINGS))


def _mapped(mapping: Column, label: Column) -> Column:
    return F.try_element_at(mapping, label)


def _result(records: Column, errors: Column, semi: Column) -> Column:
    return F.struct(records.cast(T.ArrayType(RECORD)).alias("records"), errors.cast(_STRINGS).alias("errors"), semi.alias("semi"))


def _no_strings() -> Column:
    return F.array().cast(_STRINGS)


def last_wins(keys: Column, values: Column) -> Column:
    """Map from two arrays; of equal keys the last one counts."""
    entries = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))

    def unique(es: Column) -> Column:
        n = F.size(es)
        return F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, n), lambda later: later["key"] == e["key"]))

    return F.map_from_entries(let(entries, unique))


def _entry(key: Column | str, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.cast("string").alias("value"))


def review_result(text: Column, error: str) -> Column:
    """The single record that asks for manual review."""
    record = F.create_map(F.lit("title"), F.lit(REVIEW_TITLE), F.lit("ocr_text"), F.coalesce(text, F.lit("")))
    return _result(F.array(record), F.array(F.lit(error)), F.lit(True))


# --- text tables -----------------------------------------------------------


def header_rows(text: Column | str, keywords: list[str]) -> Column:
    """Rows below the first line that holds a keyword: struct(data map by
    header word, raw_columns). Missing columns are ''."""
    if not keywords:
        return F.array().cast(T.ArrayType(T.StructType([T.StructField("data", RECORD), T.StructField("raw_columns", _STRINGS)])))

    def has_keyword(line: Column) -> Column:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(line, F.lit(k))
        return hit

    def below(ls: Column) -> Column:
        return let(F.array_position(F.transform(ls, has_keyword), True).cast("int"), lambda at: build(ls, at))

    def build(ls: Column, at: Column) -> Column:
        head = split_words(F.try_element_at(ls, F.when(at > 0, at).otherwise(1)))
        body = F.transform(F.slice(ls, at + 1, F.size(ls) + 1), split_words)
        rows = let(head, lambda h: F.transform(body, lambda tokens: F.struct(
            last_wins(h, F.transform(h, lambda _c, j: F.coalesce(F.get(tokens, j), F.lit("")))).alias("data"), tokens.alias("raw_columns"))))
        return F.when(at > 0, rows)

    return let(lines(text), below)


def structured_records(blocks: DataFrame, config: dict, keys: list[str]) -> DataFrame:
    """Records from block rows (keys, id, block_type, text, ocr_text) for each
    strategy: (keys, strategy_no, source_block_id, row_no, record_type, data,
    raw_columns)."""
    schema_keys = [F.col(k) for k in keys]
    out = None
    strategies = (config or {}).get("strategies") or [] if (config or {}).get("enabled") else []
    for number, strategy in enumerate(strategies or [{}]):
        applies = strategy.get("applies_to") or {}
        text = F.when(F.coalesce("ocr_text", F.lit("")) != "", F.col("ocr_text")).otherwise(F.coalesce("text", F.lit("")))
        chosen = blocks.filter(F.col("block_type").isin(*(applies.get("block_types") or ["ocr"])))
        rows = chosen.select(*schema_keys, F.col("id").alias("source_block_id"), F.posexplode(header_rows(text, applies.get("keywords") or [])).alias("row_no", "r"))
        part = rows.select(*schema_keys, F.lit(number).alias("strategy_no"), "source_block_id", "row_no",
                           F.lit(strategy.get("record_type") or "generic_row").alias("record_type"), F.col("r.data").alias("data"), F.col("r.raw_columns").alias("raw_columns"))
        out = part if out is None else out.unionByName(part)
    return out


def split_line(line: Column, delimiters: list[str] | tuple[str, ...] | None = None) -> Column:
    """Cells by the first delimiter of the list that occurs in the line."""
    parts = F.array(line)
    for d in reversed(list(delimiters or DELIMITERS)):
        parts = F.when(F.contains(line, F.lit(d)), F.split(line, r"\Q" + d + r"\E")).otherwise(parts)
    return F.transform(parts, strip)


def parse_delimited(text: Column | str, config: dict) -> Column:
    """Delimited table under the first line with a mapped header that has at
    least one row of its own width. Other widths are errors."""
    mapping = _mapping(config.get("column_mapping"))
    delimiters = config.get("delimiters") or DELIMITERS
    text = col(text)
    row = lambda l: F.struct(l.alias("line"), split_line(l, delimiters).alias("cells"))

    def choose(rows: Column) -> Column:
        n = F.size(rows)
        usable = F.transform(
            rows,
            lambda r, i: F.exists(r["cells"], lambda c: _mapped(mapping, c).isNotNull())
            & F.exists(F.slice(rows, i + 2, n), lambda x: F.size(x["cells"]) == F.size(r["cells"])),
        )
        return let(F.array_position(usable, True).cast("int"), lambda at: F.when(at > 0, build(rows, at)))

    def build(rows: Column, at: Column) -> Column:
        targets = F.transform(F.element_at(rows, at)["cells"], lambda h: _mapped(mapping, h))
        below = F.transform(F.slice(rows, at + 1, F.size(rows)), lambda r, i: F.struct((i + 1).alias("no"), r["line"].alias("line"), r["cells"].alias("cells")))

        def result(fields: Column) -> Column:
            fits = lambda r: F.size(r["cells"]) == F.size(fields)

            def record(r: Column) -> Column:
                used = F.filter(F.zip_with(fields, r["cells"], lambda f, v: F.struct(f.alias("f"), v.alias("v"))), lambda e: e["f"].isNotNull())
                ks = F.concat(F.transform(used, lambda e: e["f"]), F.array(F.lit("ocr_text")))
                return last_wins(ks, F.concat(F.transform(used, lambda e: e["v"]), F.array(r["line"])))

            records = F.transform(F.filter(below, fits), record)
            bad = F.transform(F.filter(below, lambda r: ~fits(r)), lambda r: F.concat(F.lit(ARITY_ERROR[0]), r["no"].cast("string"), F.lit(ARITY_ERROR[1])))
            return _result(records, bad, F.lit(False))

        return let(targets, result)

    return F.coalesce(let(F.transform(lines(text), row), choose), review_result(text, ERROR_NO_HEADER))


def parse_pairs(text: Column | str, config: dict) -> Column:
    """One record from ``label: value`` lines with mapped labels."""
    mapping = _mapping(config.get("column_mapping"))
    text = col(text)
    pattern = r"\A([^:：]+)[:：](?U)\s*(.+)\z"
    pairs = F.transform(
        F.filter(lines(text), lambda l: l.rlike(pattern)),
        lambda l: F.struct(_mapped(mapping, strip(F.regexp_extract(l, pattern, 1))).alias("f"), strip(F.regexp_extract(l, pattern, 2)).alias("v")),
    )

    def build(used: Column) -> Column:
        ks = F.concat(F.transform(used, lambda e: e["f"]), F.array(F.lit("ocr_text")))
        record = last_wins(ks, F.concat(F.transform(used, lambda e: e["v"]), F.array(text)))
        return F.when(F.size(used) > 0, _result(F.array(record), _no_strings(), F.lit(False)))

    return F.coalesce(let(F.filter(pairs, lambda p: p["f"].isNotNull()), build), review_result(text, ERROR_NO_PAIRS))


def parse_text(text: Column | str, config: dict) -> Column:
    return parse_pairs(text, config) if config.get("mode", "table") == "key_value" else parse_delimited(text, config)


# --- word boxes ------------------------------------------------------------


def _sorted(ws: Column, *by) -> Column:
    """Stable sort of an array of structs: the position settles equal keys."""
    ranked = F.transform(ws, lambda w, i: F.struct(*[b(w).alias(f"k{n}") for n, b in enumerate(by)], i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(ranked), lambda r: r["w"])


def _left(w: Column) -> Column:
    return F.coalesce(w["left"], F.lit(0.0))


def _top(w: Column) -> Column:
    return F.coalesce(w["top"], F.lit(0.0))


def word_center(w: Column) -> Column:
    return _left(w) + F.coalesce(w["width"], F.lit(0.0)) / 2


def _middle(w: Column) -> Column:
    return _top(w) + F.coalesce(w["height"], F.lit(0.0)) / 2


def _join(ws: Column, sep: str) -> Column:
    return F.array_join(F.transform(ws, lambda w: w["text"]), sep)


def reading_text(ws: Column, sep: str = " ") -> Column:
    """Words by (top, left)."""
    return _join(_sorted(ws, _top, _left), sep)


def across_text(ws: Column) -> Column:
    """Words by (left, top)."""
    return _join(_sorted(ws, _left, _top), " ")


def row_text(ws: Column) -> Column:
    return _join(_sorted(ws, _left), " ")


def word_rows(ws: Column | str, tolerance: float = 8) -> Column:
    """Rows of words: taken by (top, left), a word joins the first row whose
    mean top is within ``tolerance``, else it opens a row."""
    named = F.filter(F.transform(col(ws), lambda w: w.withField("text", strip(F.coalesce(w["text"], F.lit(""))))), lambda w: w["text"] != "")
    row = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("sum", T.DoubleType()), T.StructField("words", T.ArrayType(WORD))])
    start = F.array().cast(T.ArrayType(row))
    as_word = lambda w: F.struct(*[w[f.name].cast(f.dataType).alias(f.name) for f in WORD])

    def add(rows: Column, w: Column) -> Column:
        near = F.transform(rows, lambda r: F.abs(_top(w) - r["sum"] / r["n"]) <= tolerance)
        fresh = F.array(F.struct(F.lit(1).alias("n"), _top(w).alias("sum"), F.array(w).alias("words")))

        def place(at: Column) -> Column:
            grown = lambda r: F.struct((r["n"] + 1).alias("n"), (r["sum"] + _top(w)).alias("sum"), F.concat(r["words"], F.array(w)).alias("words"))
            merged = F.transform(rows, lambda r, i: F.when(i + 1 == at, grown(r)).otherwise(r))
            return F.when(at == 0, F.concat(rows, fresh)).otherwise(merged)

        return let(F.array_position(near, True), place).cast(T.ArrayType(row))

    rows = F.aggregate(F.transform(_sorted(named, _top, _left), as_word), start, add)
    return F.transform(rows, lambda r: _sorted(r["words"], _left))


def _is_id_row(row: Column) -> Column:
    return F.coalesce(is_integer_text(F.try_element_at(row, F.lit(1))["text"]), F.lit(False))


def record_groups(rows: Column) -> Column:
    """A row that starts with an integer opens a group, later rows join it,
    rows before the first one are left out."""

    def group(rs: Column) -> Column:
        starts = F.filter(F.transform(rs, lambda r, i: F.when(_is_id_row(r), i)), lambda x: x.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda at, k: F.flatten(F.slice(rs, at + 1, F.coalesce(F.get(s, k + 1), F.size(rs)) - at))))

    return let(rows, group)


def line_groups(positions: Column | str, gap: int = 2) -> Column:
    """Centres of runs of positions at most ``gap`` apart."""

    def centres(p: Column) -> Column:
        starts = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (x - F.get(p, i - 1) > gap), i)), lambda x: x.isNotNull())
        last = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(p)) - 1
        return let(starts, lambda s: F.transform(s, lambda at, k: F.floor((F.get(p, at) + F.get(p, last(s, k))) / 2).cast("int")))

    return let(col(positions), centres)


def header_fields(row: Column, mapping: Column) -> Column:
    """Fields named by up to six words in a row: struct(center, field), by
    centre, the first per field."""

    def named(ws: Column) -> Column:
        n = F.size(ws)

        def spans(i: Column) -> Column:
            def one(j: Column) -> Column:
                a, b = F.get(ws, i), F.get(ws, j)
                right = _left(b) + F.coalesce(b["width"], F.lit(0.0))
                phrase = F.array_join(F.transform(F.slice(ws, i + 1, j - i + 1), lambda w: w["text"]), "")
                return F.struct(((_left(a) + right) / 2).alias("center"), (i * 8 + j - i).alias("no"), _mapped(mapping, phrase).alias("field"))

            return F.transform(F.sequence(i, F.least(n, i + 6) - 1), one)

        found = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), spans)), lambda h: h["field"].isNotNull())
        return F.when(n > 0, let(F.array_sort(found), unique))

    def unique(hs: Column) -> Column:
        names = F.transform(hs, lambda x: x["field"])
        firsts = F.filter(hs, lambda h, i: F.array_position(names, h["field"]) == i + 1)
        return F.transform(firsts, lambda h: F.struct(h["center"].alias("center"), h["field"].alias("field")))

    return let(row, named)


def inferred_id_center(rows: Column, first_center: Column) -> Column:
    """Middle centre of the leading integers left of the first header."""
    leads = F.filter(F.transform(rows, lambda r: F.when(_is_id_row(r), word_center(F.get(r, F.lit(0))))), lambda c: c.isNotNull())
    left = F.array_sort(F.filter(leads, lambda c: first_center.isNull() | (c < first_center)))
    return let(left, lambda c: F.get(c, F.floor(F.size(c) / 2).cast("int")))


def column_ranges(headers: Column) -> Column:
    """struct(field, start, end): midpoints to the neighbours, open ends."""
    mid = lambda a, b: (a["center"] + b["center"]) / 2
    inf = F.lit(float("inf"))
    return let(
        headers,
        lambda hs: F.transform(
            hs,
            lambda h, i: F.struct(
                h["field"].alias("field"),
                F.coalesce(F.when(i > 0, mid(F.get(hs, i - 1), h)), -inf).alias("start"),
                F.coalesce(mid(h, F.get(hs, i + 1)), inf).alias("end"),
            ),
        ),
    )


def _ranges_for(row: Column, after: Column, mapping: Column) -> Column:
    def complete(hs: Column) -> Column:
        first = F.array_min(F.transform(hs, lambda h: h["center"]))
        guess = inferred_id_center(after, first)
        has_id = F.exists(hs, lambda h: h["field"] == "id")
        with_id = let(guess, lambda g: F.when(has_id | g.isNull(), hs).otherwise(
            _sorted(F.concat(hs, F.array(F.struct(g.alias("center"), F.lit("id").alias("field")))), lambda h: h["center"])))
        return let(with_id, ready)

    def ready(hs: Column) -> Column:
        both = F.exists(hs, lambda h: h["field"] == "id") & F.exists(hs, lambda h: h["field"] == "name")
        return F.when(both, column_ranges(hs))

    return let(header_fields(row, mapping), complete)


def _partial(id_value: Column, text: Column) -> Column:
    return F.map_from_entries(F.array(_entry("id", id_value), _entry("title", F.lit(REVIEW_TITLE)), _entry("ocr_text", text)))


def _split_records(built: Column) -> Column:
    """Result struct from an array of struct(record, error)."""

    def split(bs: Column) -> Column:
        errors = F.filter(F.transform(bs, lambda b: b["error"]), lambda e: e.isNotNull())
        failed = F.exists(bs, lambda b: b["error"].isNotNull())
        return F.when(F.size(bs) > 0, _result(F.transform(bs, lambda b: b["record"]), errors, failed))

    return let(built, split)


def parse_positioned(ws: Column | str, config: dict) -> Column:
    """Records from word boxes: header row, column ranges, row groups."""
    mapping = _mapping(config.get("column_mapping"))

    def whole(rows: Column) -> Column:
        n = F.size(rows)
        after = lambda i: F.slice(rows, i + 2, n)
        headers = F.transform(rows, lambda r, i: F.when(F.exists(after(i), _is_id_row), _ranges_for(r, after(i), mapping)))

        def pick(rs: Column) -> Column:
            at = F.array_position(F.transform(rs, lambda r: r.isNotNull()), True).cast("int")
            return let(at, lambda k: F.when(k > 0, build(F.element_at(rs, F.when(k > 0, k).otherwise(1)), F.slice(rows, k + 1, n))))

        return let(headers, pick)

    def build(ranges: Column, body: Column) -> Column:
        return _split_records(F.transform(record_groups(body), lambda g: let(_sorted(g, _left), lambda ordered: one(ordered, ranges))))

    def one(ordered: Column, ranges: Column) -> Column:
        inside = lambda w, r: (word_center(w) >= r["start"]) & (word_center(w) < r["end"])
        cells = F.transform(ranges, lambda r: _entry(r["field"], _join(F.filter(ordered, lambda w: inside(w, r)), " ")))
        lead = F.get(ordered, F.lit(0))["text"]
        text = across_text(ordered)

        def finish(filled: Column) -> Column:
            has = lambda name: F.exists(filled, lambda e: e["key"] == name)
            own_id = F.get(F.filter(filled, lambda e: e["key"] == "id"), F.lit(0))["value"]
            id_value = F.coalesce(own_id, lead)
            with_id = F.when(has("id"), filled).otherwise(F.concat(F.array(_entry("id", lead)), filled))
            error = F.concat(F.lit(PARTIAL_ERROR[0]), id_value, F.lit(PARTIAL_ERROR[1]))
            return F.struct(
                F.when(has("name"), F.map_from_entries(F.concat(with_id, F.array(_entry("ocr_text", text))))).otherwise(_partial(id_value, text)).alias("record"),
                F.when(~has("name"), error).alias("error"),
            )

        return let(F.filter(cells, lambda e: e["value"] != ""), finish)

    return let(word_rows(ws), whole)


# --- grids and cells -------------------------------------------------------


def cell_words(ws: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """Words whose centre lies in a cell."""
    return F.filter(ws, lambda w: (word_center(w) >= left) & (word_center(w) < right) & (_middle(w) >= top) & (_middle(w) < bottom))


def _numbers(lists: pa.Array) -> list[np.ndarray]:
    """Each list as doubles; a missing value is in no cell."""
    flat = lists.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(False)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _in_cells(xs: pa.Array, ys: pa.Array, rows: pa.Array, columns: pa.Array) -> pa.Array:
    words, in_cell, in_row, in_grid = [], [np.zeros(1, np.int64)], [0], [0]
    for x, y, r, c in zip(_numbers(xs), _numbers(ys), _numbers(rows), _numbers(columns), strict=True):
        down, across = max(0, len(r) - 1), max(0, len(c) - 1)
        i, j = np.searchsorted(r, y, "right") - 1, np.searchsorted(c, x, "right") - 1
        inside = np.flatnonzero((i >= 0) & (i < down) & (j >= 0) & (j < across))
        cell = i[inside] * across + j[inside]
        words.append(inside[np.argsort(cell, kind="stable")])
        in_cell.append(np.bincount(cell, minlength=down * across))
        in_row += [in_row[-1] + across * (k + 1) for k in range(down)]
        in_grid.append(in_grid[-1] + down)
    cells = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(in_cell)), pa.int32()), pa.array(np.concatenate([*words, np.empty(0, np.int64)]), pa.int32()))
    return pa.ListArray.from_arrays(pa.array(in_grid, pa.int32()), pa.ListArray.from_arrays(pa.array(in_row, pa.int32()), cells))


def grid_words(ws: Column, rows: Column, columns: Column) -> Column:
    """For each row and column of sorted lines the places of the words whose
    centres lie there, in their order: every word is looked up once among the
    lines, by halving, so time grows with words and cells and not with both."""
    found = F.arrow_udf(_in_cells, T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType()))))
    return found(*[c.cast("array<double>") for c in (F.transform(ws, word_center), F.transform(ws, _middle), rows, columns)])


def parse_grid(ws: Column | str, grid_rows: Column | str, grid_columns: Column | str, config: dict) -> Column:
    """Records from word boxes over detected table lines; NULL without three
    lines each way or without id and name headers."""
    mapping = _mapping(config.get("column_mapping"))
    ws, rows, cols = col(ws), F.array_sort(col(grid_rows)), F.array_sort(col(grid_columns))

    def whole(placed: Column) -> Column:
        return F.when((F.size(rows) >= 3) & (F.size(cols) >= 3), headed(placed))

    def words_at(placed: Column, i: Column, j: Column) -> Column:
        return F.transform(F.get(F.get(placed, i), j), lambda k: F.get(ws, k))

    def headed(placed: Column) -> Column:
        def header(j: Column) -> Column:
            return F.struct(j.alias("j"), _mapped(mapping, reading_text(words_at(placed, F.lit(0), j), "")).alias("field"))

        found = F.filter(F.transform(F.sequence(F.lit(0), F.size(cols) - 2), header), lambda c: c["field"].isNotNull())

        def ready(fields: Column) -> Column:
            both = F.exists(fields, lambda c: c["field"] == "id") & F.exists(fields, lambda c: c["field"] == "name")
            return F.when(both, body(placed, fields))

        return let(found, ready)

    def body(placed: Column, fields: Column) -> Column:
        def line(i: Column) -> Column:
            def cell(c: Column) -> Column:
                value = strip(reading_text(words_at(placed, i, c["j"])))
                return _entry(c["field"], F.when(c["field"] == "id", first_integer(value)).otherwise(value))

            return F.filter(F.transform(fields, cell), lambda e: e["value"] != "")

        built = F.transform(F.sequence(F.lit(1), F.size(rows) - 2), line)
        return _split_records(F.transform(F.filter(built, lambda es: F.size(es) > 0), finish))

    def finish(entries: Column) -> Column:
        text = F.array_join(F.transform(entries, lambda e: e["value"]), " ")
        value = lambda name: F.element_at(F.filter(entries, lambda e: e["key"] == name), -1)["value"]
        get = lambda name: F.when(F.exists(entries, lambda e: e["key"] == name), value(name))
        ok = get("id").isNotNull() & get("name").isNotNull()
        shown = F.coalesce(get("id"), F.lit("?"))
        ks = F.concat(F.transform(entries, lambda e: e["key"]), F.array(F.lit("ocr_text")))
        full = last_wins(ks, F.concat(F.transform(entries, lambda e: e["value"]), F.array(text)))
        return F.struct(
            F.when(ok, full).otherwise(_partial(shown, text)).alias("record"),
            F.when(~ok, F.concat(F.lit(PARTIAL_ERROR[0]), shown, F.lit(PARTIAL_ERROR[1]))).alias("error"),
        )

    return let(grid_words(ws, rows, cols), whole)


def parse_cells(cells: Column | str, config: dict) -> Column:
    """Records from recognised cells. Needs id and name; ids are renumbered
    consecutively from the first numeric one."""
    cells = col(cells)
    order = list(config.get("column_order") or [])
    mapping = _mapping(config.get("column_mapping"))
    if order:
        fields = F.array(*[F.lit(f) for f in order])
    else:
        fields = F.transform(F.get(cells, F.lit(0)), lambda c: F.coalesce(_mapped(mapping, F.replace(collapse_ws(c), F.lit(" "), F.lit(""))), F.lit("")))

    def whole(fs: Column) -> Column:
        known = F.array_contains(fs, "id") & F.array_contains(fs, "name")
        return F.when((F.size(cells) >= 2) & known, body(fs))

    def body(fs: Column) -> Column:
        def line(row: Column) -> Column:
            def cell(f: Column, j: Column) -> Column:
                value = collapse_ws(F.get(row, j))
                return _entry(f, F.when(f == "id", first_integer(value)).otherwise(value))

            return F.filter(F.transform(fs, cell), lambda e: (e["key"] != "") & (e["value"] != ""))

        has = lambda es, name: F.exists(es, lambda e: e["key"] == name)
        kept = F.filter(F.transform(F.slice(cells, 2, F.size(cells)), line), lambda es: has(es, "id") & has(es, "name"))
        return let(kept, number)

    def number(rows: Column) -> Column:
        ids = F.transform(rows, lambda es: F.element_at(F.filter(es, lambda e: e["key"] == "id"), -1)["value"])
        first = F.get(F.filter(ids, lambda v: is_integer_text(v)), F.lit(0)).cast("bigint")

        def renumber(es: Column, k: Column, base: Column) -> Column:
            new_id = (base + k).cast("string")
            parts = F.concat(F.array(new_id), F.slice(F.transform(es, lambda e: e["value"]), 2, F.size(es)))
            values = F.transform(es, lambda e: F.when(e["key"] == "id", new_id).otherwise(e["value"]))
            ks = F.concat(F.transform(es, lambda e: e["key"]), F.array(F.lit("ocr_text")))
            return last_wins(ks, F.concat(values, F.array(F.array_join(parts, " "))))

        records = let(F.coalesce(first, F.lit(1).cast("bigint")), lambda base: F.transform(rows, lambda es, k: renumber(es, k, base)))
        return F.when(F.size(rows) > 0, _result(records, _no_strings(), F.lit(False)))

    return let(fields, whole)


def parse_result(config: dict, text: str = "text", ws: str = "words", grid_rows: str = "grid_rows", grid_columns: str = "grid_columns", cells: str = "table_cells") -> Column:
    """Cells, then grid, then positions, then text: the first that gives records."""
    return F.coalesce(
        parse_cells(cells, config),
        parse_grid(ws, grid_rows, grid_columns, config),
        parse_positioned(ws, config),
        parse_text(text, config),
    )


# --- records of images -----------------------------------------------------


def merge_records(parsed: DataFrame, keys: list[str], renumber: bool = False) -> DataFrame:
    """One row per record with its image and OCR fields.

    ``parsed`` has ``image_no``, ``page_url``, the image columns, an ``ocr``
    struct and ``parsed`` (a parser result). With ``renumber`` the ids of a
    page's records run on over its images, which are few per page.
    """
    blank = strip(F.coalesce("ocr.text", F.lit(""))) == ""
    empty = blank & (F.coalesce(F.size("ocr.words"), F.lit(0)) <= 0)
    rows = parsed.withColumn("parsed", F.when(empty, review_result(F.lit(""), ERROR_EMPTY)).otherwise(F.col("parsed")))
    has_id = lambda r: F.coalesce(F.try_element_at(r, F.lit("id")), F.lit("")) != ""
    records = F.col("parsed.records")
    if renumber:
        numbered = rows.withColumn("_ids", F.size(F.filter("parsed.records", has_id)))
        before = W.partitionBy(*keys).orderBy("image_no").rowsBetween(W.unboundedPreceding, -1)
        rows = numbered.withColumn("_base", F.coalesce(F.sum("_ids").over(before), F.lit(0)))

        def shift(r: Column, i: Column) -> Column:
            rank = F.size(F.filter(F.slice(F.col("parsed.records"), 1, i + 1), has_id)) + F.col("_base")
            fresh = rank.cast("string")
            text = strip(F.regexp_replace(F.coalesce(F.try_element_at(r, F.lit("ocr_text")), F.lit("")), r"\A[^ ]*", fresh))
            changed = F.map_concat(F.map_filter(r, lambda k, _v: ~k.isin("id", "ocr_text")), F.create_map(F.lit("id"), fresh, F.lit("ocr_text"), text))
            return F.when(has_id(r), changed).otherwise(r)

        records = F.transform("parsed.records", shift)
    flat = rows.withColumn("_records", records).select(*rows.columns, F.posexplode("_records").alias("row_no", "record"))
    fields = ocr_item_fields(F.col("ocr"))
    semi, errors = F.col("parsed.semi"), F.col("parsed.errors")
    fields["manual_review_required"] = fields["manual_review_required"] | semi | (F.size(errors) > 0)
    own = F.try_element_at("record", F.lit("ocr_text"))
    fields["ocr_text"] = F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.col("ocr.text"))
    return flat.select(
        *keys, "image_no", "row_no", "record", F.col("page_url").alias("source_url"), "source_img_url", "source_img_path", "source_img_alt",
        *[c.alias(n) for n, c in fields.items()], semi.alias("semi_structured"), errors.alias("parse_errors"),
    )


# --- markdown --------------------------------------------------------------


def _markdown(rows: Column, cell) -> Column:
    """Markdown table from rows of cells, padded to the widest."""
    width = F.array_max(F.transform(rows, F.size))

    def line(row: Column, n: Column) -> Column:
        padded = F.concat(F.transform(row, cell), F.array_repeat(F.lit(""), n - F.size(row)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    def build(n: Column) -> Column:
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
        body = F.transform(rows, lambda r: line(r, n))
        return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.size(body))), "\n")

    return F.when(F.size(rows) > 0, let(width, build)).otherwise("")


def _row_cells(pages: pa.Array) -> pa.Array:
    out = []
    for page in pages:
        nodes = page.values
        rows: dict[int, list[int]] = {}
        if nodes is not None and len(nodes):
            ids, parents, tags = (nodes.field(c).to_pylist() for c in ("id", "parent", "tag"))
            row_of: list[int] = []  # the nearest row above each node
            for i, tag in enumerate(tags):
                above = parents[i] - ids[0]
                row_of.append(-1 if above < 0 else above if tags[above] == "tr" else row_of[above])
                if tag == "tr":
                    rows[i] = []
                elif tag in ("td", "th") and row_of[i] >= 0:
                    rows[row_of[i]].append(i)
        out.append(list(rows.values()))
    return pa.array(out, pa.list_(pa.list_(pa.int32())))


def html_table_rows(fragment: Column | str) -> Column:
    """Cell texts of every table row of a parsed page; blank rows dropped. A
    cell belongs to the nearest row above it, so a table within a cell has rows
    of its own, behind the outer one, whose cell shows all of its text."""
    from . import dom

    f = col(fragment)
    nodes = f["nodes"]
    places = F.arrow_udf(_row_cells, T.ArrayType(T.ArrayType(T.IntegerType())))(nodes)
    rows = F.transform(places, lambda row: F.transform(row, lambda i: let(F.get(nodes, i), lambda n: collapse_ws(dom.node_text(f, n)))))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def html_table_markdown(fragment: Column | str) -> Column:
    return let(html_table_rows(fragment), lambda rows: _markdown(rows, markdown_cell))


def cells_markdown(cells: Column | str) -> Column:
    return F.coalesce(_markdown(col(cells), collapse_ws), F.lit(""))


def table_row_count(html: Column | str) -> Column:
    return F.greatest(F.regexp_count(F.coalesce(col(html), F.lit("")), F.lit(r"(?i)<tr\b")) - 1, F.lit(0))


def first_table_payload(payloads: Column | str) -> Column:
    """First markdown in any payload struct, else the first html; ''."""
    p = col(payloads)

    def first(name: str) -> Column:
        return F.get(F.filter(F.transform(p, lambda x: x[name]), lambda v: strip(F.coalesce(v, F.lit(""))) != ""), F.lit(0))

    return F.coalesce(first("markdown"), first("html"), F.lit(""))


# --- recognised lines ------------------------------------------------------


def box_polygon(box: Column) -> Column:
    """[x1, y1, x2, y2] to four corners."""
    x1, y1, x2, y2 = (F.get(box, F.lit(i)).cast("double") for i in range(4))
    return F.when(F.size(box) == 4, F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2)))


def box_center(box: Column) -> Column:
    points = F.filter(F.coalesce(box, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda a, p: a + F.get(p, F.lit(axis))) / F.size(points)
    zero = F.lit(0.0)
    return F.struct(F.when(F.size(points) > 0, mean(0)).otherwise(zero).alias("x"), F.when(F.size(points) > 0, mean(1)).otherwise(zero).alias("y"))


def zip_lines(texts: Column, scores: Column, polygons: Column) -> Column:
    """struct(index, text, score, box) per recognised text."""
    return F.transform(texts, lambda t, i: F.struct(i.alias("index"), t.alias("text"), F.get(scores, i).alias("score"), F.get(polygons, i).alias("box")))


def is_noise(line: Column) -> Column:
    """A low-score lone stroke; lines without a score are kept."""
    low = F.coalesce(line["score"] < 0.5, F.lit(False))
    return low & strip(F.coalesce(line["text"], F.lit(""))).isin(*NOISE_TEXTS)


def lines_text(lines_: Column | str) -> Column:
    return F.array_join(F.filter(F.transform(col(lines_), lambda x: x["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")


_POSITIONED = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _positioned(line: Column, i: Column) -> Column:
    return let(box_center(line["box"]), lambda c: F.struct(i.alias("no"), strip(F.coalesce(line["text"], F.lit(""))).alias("text"), c["x"].alias("x"), c["y"].alias("y")))


def visual_rows(lines_: Column | str, tolerance: float = 14.0) -> Column:
    """Lines by (y, x); a line joins the last row while its mean y is within
    ``tolerance``."""
    row = T.StructType([T.StructField("sum", T.DoubleType()), T.StructField("items", T.ArrayType(_POSITIONED))])
    ordered = _sorted(F.transform(col(lines_), _positioned), lambda p: p["y"], lambda p: p["x"])

    def add(rows: Column, p: Column) -> Column:
        fresh = F.array(F.struct(p["y"].alias("sum"), F.array(p).alias("items")))
        last = F.try_element_at(rows, F.lit(-1))
        near = F.abs(p["y"] - last["sum"] / F.size(last["items"])) <= tolerance
        grown = F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(F.struct((last["sum"] + p["y"]).alias("sum"), F.concat(last["items"], F.array(p)).alias("items"))))
        return F.when(F.coalesce(near, F.lit(False)), grown).otherwise(F.concat(rows, fresh)).cast(T.ArrayType(row))

    rows = F.aggregate(ordered, F.array().cast(T.ArrayType(row)), add)
    return F.transform(rows, lambda r: _sorted(r["items"], lambda p: p["x"]))


def repair_first_id(rows: Column) -> Column:
    """rows with the first id corrected to 1 when it was misread and the next
    row is 2."""
    one = lambda r: F.concat(F.array(F.lit("1")), F.slice(r, 2, F.size(r)))
    return let(rows, lambda rs: F.when(_misread(rs), F.transform(rs, lambda r, i: F.when(i == 0, one(r)).otherwise(r))).otherwise(rs))


def _misread(rows: Column) -> Column:
    first, second = (strip(F.get(F.get(rows, F.lit(i)), F.lit(0))) for i in range(2))
    return F.coalesce(first.isin(*MISREAD_ONE) & (second == "2"), F.lit(False))


def id_correction(rows: Column) -> Column:
    """Correction records that belong to ``repair_first_id``."""
    one = F.struct(F.lit("1").alias("row"), F.lit("0").alias("cell"), strip(F.get(F.get(rows, F.lit(0)), F.lit(0))).alias("source"),
                   F.lit("1").alias("target"), F.lit(REPAIR_REASON).alias("reason"))
    return F.when(_misread(rows), F.array(one)).otherwise(F.slice(F.array(one), 1, 0))


def anchor_bands(positioned: Column, image_width: Column) -> Column:
    """Integer texts in the first column by y, each with its row band: half way
    to its neighbours, below the header line, open at the end."""

    def bands(found: Column) -> Column:
        anchors = _sorted(F.filter(found, lambda p: p["text"].rlike(r"(?U)\A\d+\z") & (p["x"] < image_width * COLUMN_SHARES[0])), lambda p: p["y"])
        ys = F.transform(found, lambda p: p["y"])
        header = let(F.array_min(ys), lambda top: F.coalesce(F.array_max(F.filter(ys, lambda y: F.abs(y - top) <= 18)), top, F.lit(0.0)))
        return let(F.struct(anchors.alias("anchors"), header.alias("header")), lambda known: F.transform(known["anchors"], lambda p, i: band(known, p, i)))

    def band(known: Column, p: Column, i: Column) -> Column:
        return F.struct(
            p.alias("anchor"),
            F.when(i == 0, known["header"] + 12).otherwise((F.get(known["anchors"], i - 1)["y"] + p["y"]) / 2).alias("start"),
            F.coalesce((p["y"] + F.get(known["anchors"], i + 1)["y"]) / 2, F.lit(float("inf"))).alias("end"),
        )

    return let(positioned, bands)


def _column_of(x: Column, width: Column) -> Column:
    b = [width * s for s in COLUMN_SHARES]
    return F.when((x < 0) | (x >= width + 1), 0).when(x < b[0], 0).when(x < b[1], 1).when(x < b[2], 2).otherwise(3)


def lines_table(lines_: Column | str, image_width: Column) -> Column:
    """struct(markdown, corrections): the four-column table that recognised
    lines form, by its integer anchors, else by visual rows."""
    source = col(lines_)
    width = image_width.cast("double")
    kept = F.filter(
        F.transform(F.filter(source, lambda x: ~is_noise(x)), _positioned), lambda p: ~((p["x"] <= 0) & (p["y"] <= 0))
    )

    def rendered(head: Column, rows: Column) -> Column:
        text = F.array_join(
            F.concat(F.array(head, F.lit("| --- | --- | --- | --- |")), F.transform(repair_first_id(rows), lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))),
            "\n",
        )
        return F.struct(text.alias("markdown"), id_correction(rows).alias("corrections"))

    def by_anchor(found: Column) -> Column:
        def row(band: Column) -> Column:
            mine = F.filter(found, lambda p: (p["y"] >= band["start"]) & (p["y"] < band["end"]) & (p["no"] != band["anchor"]["no"]) & (p["text"] != ""))
            return let(_sorted(mine, lambda p: p["y"], lambda p: p["x"]), lambda ordered: cells_of(ordered, band))

        def cells_of(ordered: Column, band: Column) -> Column:
            digits = F.filter(ordered, lambda p: (_column_of(p["x"], width) == 0) & p["text"].rlike(r"(?U)\A\d+\z"))
            lead = F.coalesce(F.try_element_at(digits, F.lit(-1))["text"], band["anchor"]["text"])
            part = lambda k: F.array_join(F.transform(F.filter(ordered, lambda p: _column_of(p["x"], width) == k), lambda p: collapse_ws(p["text"])), "")
            return F.transform(F.array(lead, part(1), part(2), part(3)), markdown_cell)

        head = F.lit("| " + " | ".join(LINE_TABLE_HEADER) + " |")
        return let(anchor_bands(found, width), lambda bands: F.when(F.size(bands) > 0, let(F.transform(bands, row), lambda rows: rendered(head, rows))))

    def by_rows(vrows: Column) -> Column:
        as_cells = lambda r: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array_join(
            F.transform(F.filter(r, lambda p: (_column_of(p["x"], width) == k) & (p["text"] != "")), lambda p: collapse_ws(p["text"])), ""))

        def attach(rows: Column, cells: Column) -> Column:
            first = F.get(cells, F.lit(0))
            opens = (first == LINE_TABLE_HEADER[0]) | first.rlike(r"(?U)\A\d+\z")
            last = F.try_element_at(rows, F.lit(-1))
            joined = F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(F.zip_with(last, cells, lambda a, b: F.concat(strip(a), b))))
            return F.when(opens, F.concat(rows, F.array(cells))).when(F.size(rows) > 0, joined).otherwise(rows)

        rows = F.aggregate(F.transform(vrows, as_cells), F.array().cast("array<array<string>>"), attach)
        head = lambda rs: F.concat(F.lit("| "), F.array_join(F.get(rs, F.lit(0)), " | "), F.lit(" |"))
        return let(rows, lambda rs: F.when(F.size(rs) >= 2, rendered(head(rs), F.slice(rs, 2, F.size(rs)))))

    any_box = F.exists(source, lambda x: F.coalesce(F.size(x["box"]) > 0, F.lit(False)))
    return F.when(any_box, F.coalesce(let(kept, by_anchor), let(visual_rows(source), by_rows)))
