"""Tables from recognised text. One part, customer or line item is one image."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import exploded
from ..functions.transforms import OCR_RESULT, WORD, RecognizerRegistry
from ..operators import archive, tables
from ..plans import reports
from ..sources.html_nodes import with_fragment
from . import query
from .fixtures import WS
from .markup_queries import LI_SQL, with_images

NAMES = {"No": "id", "Title": "name", "Brand": "brand", "Kind": "kind"}


def word(text, left, top, width=20.0, height=10.0):
    values = {"text": text, "left": left, "top": top, "width": width, "height": height, "conf": 90.0}
    lift = lambda v: v if not isinstance(v, (str, int, float)) else F.lit(v)
    return F.struct(*[lift(values[f.name]).cast(f.dataType).alias(f.name) for f in WORD])


def entry(record, name):
    return F.try_element_at(record, F.lit(name))


def rows_of(df, column, keys):
    return exploded(df, [*keys, F.size(f"{column}.errors").alias("errors"), F.col(f"{column}.semi").alias("semi")], f"{column}.records", "record", "row_no")


# --- text tables -----------------------------------------------------------


@query(
    "structured_header_rows",
    """SELECT n_nationkey AS page_id, row_no, k AS "No", CASE WHEN row_no = 2 THEN '' ELSE n_name END AS "Name", CASE WHEN row_no = 2 THEN 1 ELSE 3 END AS raw FROM nation, (VALUES (0, 'a'), (1, 'b'), (2, 'c')) r(row_no, k)""",
)
def _(t):
    text = F.concat(F.lit("list of\n\nNo Name Extra\na "), "n_name", F.lit(" x\n b  "), "n_name", F.lit(" y\n\nc"))
    blocks = t.nation.select(F.col("n_nationkey").alias("page_id"), F.lit("b1").alias("id"), F.lit("ocr").alias("block_type"), F.lit("").alias("text"), text.alias("ocr_text"))
    cfg = {"enabled": True, "strategies": [{"applies_to": {"keywords": ["Name", "?"]}}]}
    out = tables.structured_records(blocks, cfg, ["page_id"])
    return out.select("page_id", "row_no", F.col("data")["No"].alias("No"), F.col("data")["Name"].alias("Name"), F.size("raw_columns").alias("raw"))


@query(
    "delimited_table",
    """SELECT p_partkey, CAST(row_no AS INTEGER) AS row_no, CASE row_no WHEN 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'last' END AS id, CASE row_no WHEN 0 THEN p_name ELSE p_brand END AS name,
       CASE row_no WHEN 0 THEN p_partkey || ' | ' || p_name || ' | x' ELSE 'last | ' || p_brand || ' | y' END AS ocr_text, 1 AS errors, false AS semi FROM part, (VALUES (0), (1)) r(row_no)""",
)
def _(t):
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("report\nNo | Title | Rest\n"), key, F.lit(" | "), "p_name", F.lit(" | x \n"), "p_brand", F.lit("\nlast | "), "p_brand", F.lit(" | y"))
    out = t.part.select("p_partkey", tables.parse_delimited(text, {"column_mapping": NAMES}).alias("r"))
    return rows_of(out, "r", ["p_partkey"]).select("p_partkey", "row_no", *[entry("record", c).alias(c) for c in ("id", "name", "ocr_text")], "errors", "semi")


@query("key_value_text", "SELECT c_custkey, c_mktsegment AS segment, c_name AS name, 'name：x' || chr(10) || 'other: z' || chr(10) || ' segment :  ' || c_mktsegment || chr(10) || 'name: ' || c_name AS ocr_text, false AS semi FROM customer")
def _(t):
    text = F.concat(F.lit("name：x\nother: z\n segment :  "), "c_mktsegment", F.lit("\nname: "), "c_name")
    cfg = {"mode": "key_value", "column_mapping": {"segment": "segment", "name": "name"}}
    out = t.customer.select("c_custkey", tables.parse_text(text, cfg).alias("r"))
    return rows_of(out, "r", ["c_custkey"]).select("c_custkey", *[entry("record", c).alias(c) for c in ("segment", "name", "ocr_text")], "semi")


@query("unreadable_text", "SELECT doc_id, 'OCR 半结构化结果' AS title, text AS ocr_text, '未识别到表头或列数不一致' AS error, true AS semi FROM documents")
def _(t):
    out = t.documents.select("doc_id", tables.parse_text("text", {"column_mapping": {"\u0001none": "x"}}).alias("r"))
    return out.select("doc_id", *[entry(F.get("r.records", F.lit(0)), c).alias(c) for c in ("title", "ocr_text")], F.get("r.errors", F.lit(0)).alias("error"), "r.semi")


# --- word boxes ------------------------------------------------------------


def _part_words(t):
    """A header row and two records; the second has no name when the part is
    large. Positions come from the part's own numbers."""
    key, shift = F.col("p_partkey").cast("string"), (F.col("p_size") % 5).cast("double")
    ws = F.array(
        word("No", 10, shift), word("Tit", 100, shift + 2, 30), word("le", 135, shift), word("Brand", 300, shift, 60), word("Kind", 500, shift),
        word(key, 12, shift + 40, 10), word(F.col("p_name"), 90, shift + 41, 60), word(F.col("p_brand"), 300, shift + 39, 50), word(F.col("p_type"), 495, shift + 40),
        word("more", 95, shift + 55), word("7", 12, shift + 80, 10), word(F.when(F.col("p_size") <= 25, F.col("p_type")).otherwise(" "), 110, shift + 80),
    )
    return t.dealt("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", ws.alias("words"))


@query(
    "word_row_clusters",
    """SELECT p_partkey, CAST(row_no AS INTEGER) AS row_no, CASE row_no WHEN 0 THEN 'No Tit le Brand Kind' WHEN 1 THEN p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type WHEN 2 THEN 'more' ELSE '7' || CASE WHEN p_size <= 25 THEN ' ' || p_type ELSE '' END END AS row_text
       FROM part, (VALUES (0), (1), (2), (3)) r(row_no)""",
)
def _(t):
    return _part_words(t).select("p_partkey", F.posexplode(F.transform(tables.word_rows("words"), tables.row_text)).alias("row_no", "row_text"))


@query(
    "visual_line_rows",
    "SELECT p_partkey, p_brand || '|' || p_name AS first, p_type AS second FROM part",
)
def _(t):
    box = lambda x, y: F.array(F.array(F.lit(x - 5.0), F.lit(y - 5.0)), F.array(F.lit(x + 5.0), F.lit(y + 5.0)))
    line = lambda text, x, y: F.struct(F.col(text).alias("text"), F.lit(0.9).alias("score"), box(x, y).alias("box"))
    rows = tables.visual_rows(F.array(line("p_type", 50.0, 40.0), line("p_name", 90.0, 10.0), line("p_brand", 20.0, 20.0)))
    text = lambda i: F.array_join(F.transform(F.get("r", F.lit(i)), lambda p: p["text"]), "|")
    return t.part.select("p_partkey", rows.alias("r")).select("p_partkey", text(0).alias("first"), text(1).alias("second"))


@query("record_row_groups", "SELECT p_partkey, CAST(g AS INTEGER) AS g, CASE g WHEN 0 THEN 4 + 1 ELSE 1 + CASE WHEN p_size <= 25 THEN 1 ELSE 0 END END AS words FROM part, (VALUES (0), (1)) x(g)")
def _(t):
    groups = tables.record_groups(tables.word_rows("words"))
    return _part_words(t).select("p_partkey", F.posexplode(F.transform(groups, F.size)).alias("g", "words"))


@query("line_position_groups", "SELECT l_orderkey, l_linenumber, CAST(floor((2 * l_linenumber + 3) / 2.0) AS INTEGER) AS first, CAST(l_linenumber + 50 AS INTEGER) AS second, CAST(l_linenumber + 100 + floor(l_quantity) AS INTEGER) AS third, 3 AS n FROM lineitem")
def _(t):
    n = F.col("l_linenumber")
    p = F.array(n, n + 1, n + 3, n + 50, (n + 100 + F.floor("l_quantity")).cast("int"))
    g = t.lineitem.select("l_orderkey", "l_linenumber", tables.line_groups(p).alias("g"))
    return g.select("l_orderkey", "l_linenumber", *[F.get("g", F.lit(i)).alias(c) for i, c in enumerate(("first", "second", "third"))], F.size("g").alias("n"))


@query("header_words_and_ranges", "SELECT p_partkey, field, a AS start, b AS \"end\" FROM part, (VALUES ('id', NULL, 73.75), ('name', 73.75, 228.75), ('brand', 228.75, 420.0), ('kind', 420.0, NULL)) r(field, a, b)")
def _(t):
    head = F.get(tables.word_rows("words"), F.lit(0))
    ranges = tables.column_ranges(tables.header_fields(head, tables._mapping(NAMES)))
    finite = lambda c: F.when(F.abs(c) < 1e300, c)
    return exploded(_part_words(t), ["p_partkey"], ranges, "r").select("p_partkey", "r.field", finite(F.col("r.start")).alias("start"), finite(F.col("r.end")).alias("end"))


@query("inferred_id_column", "SELECT l_orderkey, l_linenumber, l_linenumber + CASE WHEN l_tax > 0.04 THEN 6.0 WHEN l_quantity > 25 THEN 7.0 ELSE 5.0 END AS center FROM lineitem")
def _(t):
    n = F.col("l_linenumber").cast("double")
    row = lambda left, text: F.array(word(text, left, 0, 10.0), word("x", 300.0, 0))
    rows = F.array(row(n, "1"), row(n + 1, F.when(F.col("l_tax") > 0.04, "2").otherwise("no")), row(n + 900, "3"), row(n + 2, F.when(F.col("l_quantity") > 25, "4").otherwise("no")), row(n - 5, "x"))
    return t.lineitem.select("l_orderkey", "l_linenumber", tables.inferred_id_center(rows, F.lit(100.0)).alias("center"))


@query(
    "positioned_table",
    """SELECT p_partkey, 0 AS row_no, CAST(p_partkey AS VARCHAR) AS id, p_name || ' more' AS name, p_brand AS brand, p_type AS kind, NULL AS title, p_partkey || ' ' || p_name || ' more ' || p_brand || ' ' || p_type AS ocr_text, CASE WHEN p_size <= 25 THEN 0 ELSE 1 END AS errors, p_size > 25 AS semi FROM part
       UNION ALL SELECT p_partkey, 1, '7', CASE WHEN p_size <= 25 THEN p_type END, NULL, NULL, CASE WHEN p_size > 25 THEN 'OCR 半结构化结果' END, '7' || CASE WHEN p_size <= 25 THEN ' ' || p_type ELSE '' END, CASE WHEN p_size <= 25 THEN 0 ELSE 1 END, p_size > 25 FROM part""",
)
def _(t):
    out = _part_words(t).select("p_partkey", tables.parse_positioned("words", {"column_mapping": NAMES}).alias("r"))
    return rows_of(out, "r", ["p_partkey"]).select("p_partkey", "row_no", *[entry("record", c).alias(c) for c in ("id", "name", "brand", "kind", "title", "ocr_text")], "errors", "semi")


def _grid_words():
    key = F.col("p_partkey").cast("string")
    return F.array(
        word("No", 20, 10), word("le", 130, 15, 30), word("Tit", 110, 10, 30), word("Brand", 300, 10), word(F.concat(F.lit("#"), key), 20, 75), word(F.col("p_name"), 110, 85),
        word("top", 130, 55), word(F.col("p_brand"), 300, 70), word(F.col("p_type"), 110, 150), word(F.when(F.col("p_size") > 25, "99").otherwise(" "), 20, 150),
    )


@query(
    "grid_table",
    """SELECT p_partkey, 0 AS row_no, CAST(p_partkey AS VARCHAR) AS id, 'top ' || p_name AS name, p_brand AS brand, p_partkey || ' top ' || p_name || ' ' || p_brand AS ocr_text, CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS errors FROM part
       UNION ALL SELECT p_partkey, 1, CASE WHEN p_size > 25 THEN '99' ELSE '?' END, CASE WHEN p_size > 25 THEN p_type END, NULL, CASE WHEN p_size > 25 THEN '99 ' ELSE '' END || p_type, CASE WHEN p_size > 25 THEN 0 ELSE 1 END FROM part""",
)
def _(t):
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs])
    ws = F.filter(_grid_words(), lambda w: F.trim(w["text"]) != "")
    rows = t.dealt("part").select("p_partkey", ws.alias("words"), ints(0, 130, 40, 260).alias("rows"), ints(0, 80, 260, 420).alias("cols"))
    out = rows.select("p_partkey", tables.parse_grid("words", "rows", "cols", {"column_mapping": NAMES}).alias("r"))
    return rows_of(out, "r", ["p_partkey"]).select("p_partkey", "row_no", *[entry("record", c).alias(c) for c in ("id", "name", "brand", "ocr_text")], "errors")


@query("cell_words", "SELECT p_partkey, 'top|' || p_name AS inside FROM part")
def _(t):
    d = lambda x: F.lit(float(x))
    return t.part.select("p_partkey", tables.reading_text(tables.cell_words(_grid_words(), d(80), d(260), d(40), d(130)), "|").alias("inside"))


@query("word_reading_orders", "SELECT p_partkey, 'b' || p_name || 'a' AS joined, 'b ' || p_name || ' a' AS reading, p_name || ' b a' AS across FROM part")
def _(t):
    ws = F.array(word("a", 50, 20), word(F.col("p_name"), 5, 10), word("b", 20, 5))
    return t.part.select("p_partkey", tables.reading_text(ws, "").alias("joined"), tables.reading_text(ws).alias("reading"), tables.across_text(ws).alias("across"))


def _cells():
    key = F.col("p_partkey").cast("string")
    return F.array(
        F.array(F.lit("No"), F.lit("Ti\ntle"), F.lit("Brand")), F.array(F.lit(""), F.lit(""), F.lit("rest")), F.array(F.concat(key, F.lit(" )")), F.concat(F.lit(" "), "p_name", F.lit("\n")), F.col("p_brand")),
        F.array(F.lit("$"), F.col("p_type")),
    )


@query(
    "cell_table",
    """SELECT p_partkey, row_no, CAST(p_partkey + row_no AS VARCHAR) AS id, CASE row_no WHEN 0 THEN p_name ELSE p_type END AS name, CASE row_no WHEN 0 THEN p_brand END AS brand,
       (p_partkey + row_no) || ' ' || CASE row_no WHEN 0 THEN p_name || ' ' || p_brand ELSE p_type END AS ocr_text FROM part, (VALUES (0), (1)) r(row_no)""",
)
def _(t):
    out = t.dealt("part").select("p_partkey", tables.parse_cells(_cells(), {"column_mapping": NAMES}).alias("r"))
    return rows_of(out, "r", ["p_partkey"]).select("p_partkey", "row_no", *[entry("record", c).alias(c) for c in ("id", "name", "brand", "ocr_text")])


@query(
    "parser_cascade",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'cells' WHEN p_type = 'ECONOMY' THEN 'grid' WHEN p_type = 'STANDARD' THEN 'positions' ELSE 'text' END AS parser,
       CASE WHEN p_type = 'PROMO' THEN p_name WHEN p_type = 'ECONOMY' THEN 'top ' || p_name WHEN p_type = 'STANDARD' THEN p_name || ' more' ELSE 'plain' END AS name FROM part""",
)
def _(t):
    k = F.col("p_type")
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs])
    grid = F.filter(_grid_words(), lambda w: F.trim(w["text"]) != "")
    rows = _part_words(t).select(
        "p_partkey", k.alias("k"), F.lit("No,Title\n1,plain").alias("text"), F.when(k == "ECONOMY", grid).when(k == "STANDARD", F.col("words")).alias("words"),
        F.when(k == "ECONOMY", ints(0, 40, 130, 260)).alias("grid_rows"), F.when(k == "ECONOMY", ints(0, 80, 260, 420)).alias("grid_columns"), F.when(k == "PROMO", _cells()).alias("table_cells"),
    )
    label = F.when(F.col("k") == "PROMO", "cells").when(F.col("k") == "ECONOMY", "grid").when(F.col("k") == "STANDARD", "positions").otherwise("text")
    return rows.select("p_partkey", label.alias("parser"), entry(F.get(tables.parse_result({"column_mapping": NAMES})["records"], F.lit(0)), "name").alias("name"))


# --- markdown --------------------------------------------------------------


@query(
    "html_table_markdown",
    """SELECT p_partkey, '| No | Name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey || ' | ' || p_name || '\\|' || p_brand || ' |' || chr(10) || '| & |  |' AS markdown, 3 AS row_count FROM part""",
)
def _(t):
    html = F.concat(F.lit("<table><tr><td>No<td> Name</tr><tr><th>"), F.col("p_partkey").cast("string"), F.lit("</th><th><b>"), "p_name", F.lit("</b>|"), "p_brand", F.lit("</th></tr><TR><td> </td></tr><tr><td>&amp;</td></tr></table>"))
    rows = with_fragment(t.dealt("part").select("p_partkey", html.alias("html")))
    return rows.select("p_partkey", tables.html_table_markdown("dom").alias("markdown"), tables.table_row_count("html").alias("row_count"))


@query(
    "html_table_nested",
    "SELECT p_partkey, '| a | ' || p_name || ' x |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | x |' || chr(10) || '| b | ' || p_brand || ' |' AS markdown FROM part",
)
def _(t):
    inner = F.concat(F.lit("<table><tr><td>"), F.col("p_name"), F.lit("</td><td> x</td></tr></table>"))
    html = F.concat(F.lit("<table><tbody><tr><td>a</td><td>"), inner, F.lit("</td></tr><tr><th>b</th><td>"), F.col("p_brand"), F.lit("</td></tr></tbody></table>"))
    rows = with_fragment(t.dealt("part").select("p_partkey", html.alias("html")))
    return rows.select("p_partkey", tables.html_table_markdown("dom").alias("markdown"))


@query("cells_markdown", "SELECT p_partkey, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' |  |' AS markdown, '' AS nothing FROM part")
def _(t):
    cells = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("\n")))))
    return t.part.select("p_partkey", tables.cells_markdown(cells).alias("markdown"), tables.cells_markdown(F.lit(None).cast("array<array<string>>")).alias("nothing"))


@query("first_table_payload", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_name END AS value FROM part")
def _(t):
    one = lambda md, html: F.struct(md.alias("markdown"), html.alias("html"))
    null = F.lit(None).cast("string")
    payloads = F.array(one(F.lit(" "), F.col("p_name")), one(F.when(F.col("p_size") > 25, F.col("p_brand")), F.lit("x")), one(null, null))
    return t.part.select("p_partkey", tables.first_table_payload(payloads).alias("value"))


def _line(text, x, y, score=0.9):
    lift = lambda v: v if not isinstance(v, (str, int, float)) else F.lit(v)
    x, y = lift(x), lift(y)
    flat = F.array(*[c.cast("double") for c in (x - 5, y - 5, x + 5, y + 5)])
    return F.struct(lift(text).alias("text"), F.lit(score).cast("double").alias("score"), tables.box_polygon(flat).alias("box"))


@query(
    "line_table_by_anchor",
    """SELECT p_partkey, '| 序号 | 案例名称 | 牵头单位 | 参与单位 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| 1 | ' || p_name || ' | ' || p_brand || ' |  |' || chr(10) || '| 2 | a' || p_type || ' |  | end |' AS markdown, '11' AS source, 1 AS n FROM part""",
)
def _(t):
    lines = F.array(_line("h", 40, 20), _line("I", 100, 60, 0.2), _line("11", 40, 60), _line(F.col("p_name"), 190, 55), _line(F.col("p_brand"), 430, 62), _line("2", 40, 100), _line("a", 190, 95), _line(F.col("p_type"), 180, 105), _line("end", 610, 100))
    out = t.dealt("part").select("p_partkey", tables.lines_table(lines, F.lit(686)).alias("r"))
    return out.select("p_partkey", "r.markdown", F.get("r.corrections", F.lit(0))["source"].alias("source"), F.size("r.corrections").alias("n"))


@query(
    "line_anchor_bands",
    "SELECT p_partkey, CAST(i AS INTEGER) AS i, CASE i WHEN 0 THEN 32.0 ELSE 70.0 + p_size % 7 END AS start, CASE i WHEN 0 THEN 70.0 + p_size % 7 END AS \"end\" FROM part, (VALUES (0), (1)) x(i)",
)
def _(t):
    y = F.lit(80) + (F.col("p_size") % 7) * 2
    pos = F.transform(F.array(_line("head", 200, 20), _line("1", 40, 60), _line("2", 40, y)), tables._positioned)
    bands = exploded(t.dealt("part"), ["p_partkey", "p_size"], tables.anchor_bands(pos, F.lit(686.0)), "b", "i")
    return bands.select("p_partkey", "i", "b.start", F.when(F.col("b.end") < 1e300, F.col("b.end")).alias("end"))


@query("recognised_lines", "SELECT p_partkey, CAST(i AS INTEGER) AS \"index\", CASE i WHEN 0 THEN p_name ELSE p_brand END AS text, CASE i WHEN 0 THEN 0.5 END AS score, CASE i WHEN 0 THEN p_size + 5.0 ELSE 0.0 END AS x, CASE i WHEN 0 THEN 20.0 ELSE 0.0 END AS y FROM part, (VALUES (0), (1)) r(i)")
def _(t):
    s = F.col("p_size").cast("double")
    poly = tables.box_polygon(F.array(s, F.lit(10.0), s + 10, F.lit(30.0)))
    lines = tables.zip_lines(F.array("p_name", "p_brand"), F.array(F.lit(0.5)), F.array(poly))
    return t.part.select("p_partkey", F.explode(lines).alias("l")).select("p_partkey", "l.index", "l.text", "l.score", tables.box_center(F.col("l.box"))["x"].alias("x"), tables.box_center(F.col("l.box"))["y"].alias("y"))


@query("noise_lines", "SELECT l_orderkey, l_linenumber, l_discount < 0.05 AND l_returnflag = 'R' AS noise, l_returnflag = 'R' AS kept_without_score FROM lineitem")
def _(t):
    text = F.when(F.col("l_returnflag") == "R", " l ").otherwise("word")
    scored = F.struct(text.alias("text"), (F.col("l_discount") * 10).alias("score"))
    bare = F.struct(text.alias("text"), F.lit(None).cast("double").alias("score"))
    return t.lineitem.select("l_orderkey", "l_linenumber", tables.is_noise(scored).alias("noise"), (~tables.is_noise(bare) & (F.trim(text) == "l")).alias("kept_without_score"))


@query("lines_plain_text", "SELECT p_partkey, p_name || chr(10) || p_brand AS value FROM part")
def _(t):
    lines = F.array(F.struct(F.col("p_name").alias("text")), F.struct(F.lit("").alias("text")), F.struct(F.col("p_brand").alias("text")))
    return t.part.select("p_partkey", tables.lines_text(lines).alias("value"))


@query("sequence_id_repair", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '1' WHEN l_returnflag = 'R' THEN 'I1' ELSE '12' END AS first_id, l_returnflag = 'R' AND l_linestatus = 'F' AS corrected FROM lineitem")
def _(t):
    rows = F.array(F.array(F.when(F.col("l_returnflag") == "R", "I1").otherwise("12"), F.lit("a")), F.array(F.when(F.col("l_linestatus") == "F", "2").otherwise("3"), F.lit("b")))
    first = F.get(F.get(tables.repair_first_id(rows), F.lit(0)), F.lit(0))
    return t.lineitem.select("l_orderkey", "l_linenumber", first.alias("first_id"), (F.size(tables.id_correction(rows)) > 0).alias("corrected"))


# --- images of pages -------------------------------------------------------

IMAGE_CONFIG = {"enabled": True, "images": {"max_images": 3}, "trigger": {"when_empty": True}, "parse": {"column_mapping": NAMES, "renumber_rows": True}}


def _recognised(t):
    """Recogniser results by image address, through the plug-in registry."""
    images = archive.discover_images(with_images(t), ["page_id"], {"max_images": 3})
    address = F.col("source_img_url")
    tail = F.regexp_extract(address, r"([^/]*)\z", 1)
    values = {
        "image_id": address, "text": F.concat(F.lit("No,Title\n5,"), F.translate(tail, ",", ";"), F.lit("\n6,second")), "status": F.lit("success"), "plugin": F.lit("tess"),
        "elapsed_seconds": F.lit(0.5), "quality_status": F.lit("usable"),
    }
    rows = images.select("source_img_url").distinct().select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OCR_RESULT])
    registry = RecognizerRegistry()
    registry.register("tess", rows)
    found = registry.recognize(images.select(address.alias("image_id")), {"plugin": "tess"})
    return found.select(F.col("image_id").alias("source_img_url"), F.lit("/store/x.png").alias("source_img_path"), F.struct(*[f.name for f in OCR_RESULT]).alias("ocr"))


@query(
    "image_records",
    f"""WITH {LI_SQL}, i AS (SELECT page_id, pos, trim(regexp_extract(body, 'href="([^"]*)"', 1), {WS}) AS src FROM li WHERE pos < 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n FROM i WHERE src <> '')
    SELECT page_id, CAST(pos + 1 AS INTEGER) AS image_no, row_no, CAST(n * 2 + row_no + 1 AS VARCHAR) AS id, CASE row_no WHEN 0 THEN translate(regexp_extract(src, '([^/]*)$', 1), ',', ';') ELSE 'second' END AS name,
      false AS manual_review_required, (n * 2 + row_no + 1) AS text_id FROM r, (VALUES (0), (1)) x(row_no)""",
)
def _(t):
    pages = with_images(t).withColumn("item_count", F.lit(0))
    out = reports.recognise_images(pages, _recognised(t), IMAGE_CONFIG, ["page_id"])
    lead = F.regexp_extract("ocr_text", r"\A(\d+)", 1).cast("int")
    return out.select("page_id", "image_no", "row_no", entry("record", "id").alias("id"), entry("record", "name").alias("name"), "manual_review_required", lead.alias("text_id"))


@query("image_run_summary", "SELECT p_type AS run_id, count(*) AS images_found, count(*) FILTER (p_size > 5) AS images_downloaded, count(*) FILTER (p_size > 25) AS ocr_success, count(*) FILTER (p_size < 30) AS manual_review_required, count(*) FILTER (p_size <= 5) AS error_count FROM part GROUP BY p_type")
def _(t):
    from ..operators import lists

    s = F.col("p_size")
    rows = t.part.select(F.col("p_type").alias("run_id"), (s > 5).alias("downloaded"), F.when(s > 25, "success").otherwise("empty").alias("ocr_status"), (s < 30).alias("manual_review_required"), F.when(s <= 5, "download failed").alias("error"))
    return lists.image_run_summary(rows, ["run_id"])
