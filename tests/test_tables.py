"""Table parsers against results worked out by hand."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.functions.transforms import OCR_RESULT
from harvestry.operators import tables

NAMES = {"No": "id", "Title": "name", "Field": "category", "Unit": "department"}


def word(text, left, top, width=20, height=10):
    return (text, float(left), float(top), float(width), float(height), 90.0)


def run(spark, config, text="", words=(), rows=None, cols=None, cells=None):
    data = [("i", text, "success", "p", None, 0.0, "usable", None, list(words), rows, cols, cells)]
    out = spark.createDataFrame(data, OCR_RESULT).select(tables.parse_result(config).alias("r")).first().r
    return [dict(x) for x in out.records], list(out.errors), out.semi


def test_delimited_text(spark):
    cfg = {"column_mapping": {"No": "id", "Title": "name"}}
    text = "report\nNo | Title | Skip\n1 | river data | x\n2 | broken\n3 | air data | y"
    records, errors, semi = run(spark, cfg, text)
    assert records == [
        {"id": "1", "name": "river data", "ocr_text": "1 | river data | x"},
        {"id": "3", "name": "air data", "ocr_text": "3 | air data | y"},
    ]
    assert errors == ["第 2 行列数不一致"] and semi is False


def test_delimited_repeated_header_last_wins(spark):
    cfg = {"column_mapping": {"A": "x", "B": "x"}}
    assert run(spark, cfg, "A,B\n1,2")[0] == [{"x": "2", "ocr_text": "1,2"}]


def test_key_values(spark):
    cfg = {"mode": "key_value", "column_mapping": {"Name": "n", "City": "c"}}
    text = "Name: first\nCity：Wuhan\nOther: z\nName: second "
    records, errors, semi = run(spark, cfg, text)
    assert records == [{"n": "second", "c": "Wuhan", "ocr_text": text}]
    assert errors == [] and semi is False


def test_unreadable_text_asks_for_review(spark):
    records, errors, semi = run(spark, {"column_mapping": {"T": "t"}}, "no table here")
    assert records == [{"title": tables.REVIEW_TITLE, "ocr_text": "no table here"}]
    assert errors == [tables.ERROR_NO_HEADER] and semi is True


def test_positioned_words(spark):
    ws = [word("No", 10, 10), word("Title", 70, 11, 70), word("Unit", 330, 9, 60)]
    ws += [word("7", 12, 35, 10), word("water", 75, 35, 40), word("levels", 120, 36, 40), word("city", 330, 35, 60)]
    ws += [word("more", 75, 50, 40)]
    ws += [word("8", 12, 70, 10), word("noise", 330, 70, 60)]
    records, errors, semi = run(spark, {"column_mapping": NAMES}, "", ws)
    assert records == [
        {"id": "7", "name": "water more levels", "department": "city", "ocr_text": "7 water more levels city"},
        {"id": "8", "title": tables.REVIEW_TITLE, "ocr_text": "8 noise"},
    ]
    assert errors == ["第 8 行字段不完整"] and semi is True


def test_positioned_split_header_and_inferred_id(spark):
    ws = [word("Ti", 200, 10), word("tle", 230, 12), word("Unit", 400, 10)]
    ws += [word("3", 20, 40, 10), word("a", 205, 40), word("u", 400, 40), word("4", 22, 70, 10), word("b", 215, 70), word("v", 410, 70)]
    records, errors, semi = run(spark, {"column_mapping": NAMES}, "", ws)
    assert records == [
        {"id": "3", "name": "a", "department": "u", "ocr_text": "3 a u"},
        {"id": "4", "name": "b", "department": "v", "ocr_text": "4 b v"},
    ]
    assert (errors, semi) == ([], False)


def test_positioned_falls_back_to_text(spark):
    cfg = {"column_mapping": {"No": "id", "Title": "name"}, "delimiters": ["|"]}
    ws = [word("wrong", 10, 10), word("1", 12, 35), word("x", 70, 35)]
    assert run(spark, cfg, "No | Title\n1 | fine", ws)[0] == [{"id": "1", "name": "fine", "ocr_text": "1 | fine"}]


def test_grid(spark):
    ws = [word("No", 20, 10), word("Ti", 110, 10, 30), word("tle", 150, 10, 30), word("Unit", 300, 10)]
    ws += [word("1", 35, 75, 10), word("up", 110, 55), word("down", 115, 80), word("u", 300, 70)]
    ws += [word("x", 300, 150)]
    records, errors, semi = run(spark, {"column_mapping": NAMES}, "", ws, [0, 40, 130, 260], [0, 80, 260, 420])
    assert records == [
        {"id": "1", "name": "up down", "department": "u", "ocr_text": "1 up down u"},
        {"id": "?", "title": tables.REVIEW_TITLE, "ocr_text": "x"},
    ]
    assert errors == ["第 ? 行字段不完整"] and semi is True


def test_cells_renumber_and_skip_rest_rows(spark):
    cells = [["No", "Ti tle", "Unit"], ["", "", "left over"], ["4)", "first\nitem", "u"], ["$", "second", "v"], ["6", "third", ""]]
    records, errors, semi = run(spark, {"column_mapping": NAMES}, cells=cells)
    assert records == [
        {"id": "4", "name": "first item", "department": "u", "ocr_text": "4 first item u"},
        {"id": "5", "name": "second", "department": "v", "ocr_text": "5 second v"},
        {"id": "6", "name": "third", "ocr_text": "6 third"},
    ]
    assert (errors, semi) == ([], False)


def reference_rows(words, tol=8):
    """Plain definition of the row clustering."""
    rows = []
    for w in sorted((w for w in words if w[0].strip()), key=lambda w: (w[2], w[1])):
        for r in rows:
            if abs(w[2] - sum(x[2] for x in r) / len(r)) <= tol:
                r.append(w)
                break
        else:
            rows.append([w])
    return [[x[0] for x in sorted(r, key=lambda x: x[1])] for r in rows]


def test_word_rows_against_definition(spark):
    import random

    rng = random.Random(5)
    schema = T.StructType([T.StructField("k", T.IntegerType()), OCR_RESULT["words"]])
    cases = [(k, [word(f"w{k}_{i}", rng.randrange(300), rng.randrange(60)) for i in range(rng.randrange(0, 25))]) for k in range(25)]
    got = {r.k: r.rows for r in spark.createDataFrame(cases, schema).select(
        "k", F.transform(tables.word_rows("words"), lambda r: F.transform(r, lambda w: w["text"])).alias("rows")).collect()}
    assert got == {k: reference_rows(ws) for k, ws in cases}


def test_line_groups(spark):
    df = spark.createDataFrame([([3, 4, 6, 20, 22, 40],), ([],)], "p array<int>")
    assert [r[0] for r in df.select(tables.line_groups("p")).collect()] == [[4, 21, 40], []]


def _lines(rows):
    return [(t, 0.9, [[x - 5.0, y - 5.0], [x + 5.0, y - 5.0], [x + 5.0, y + 5.0], [x - 5.0, y + 5.0]]) for t, x, y in rows]


LINES = "l array<struct<text:string,score:double,box:array<array<double>>>>"


def test_lines_table_by_anchors(spark):
    head = [("h1", 40, 20), ("h2", 190, 22)]
    one = head + [("11", 40, 60), ("first", 190, 55), ("part", 200, 65), ("lead", 430, 60), ("2", 40, 100), ("se|cond", 190, 100), ("j", 610, 100)]
    two = head + [("11", 40, 60), ("x", 190, 60), ("12", 40, 100), ("y", 190, 100)]
    df = spark.createDataFrame([(_lines(one),), (_lines(two),), ([],)], LINES)
    a, b, c = [r[0] for r in df.select(tables.lines_table("l", F.lit(686))).collect()]
    assert a.markdown.split("\n")[2:] == ["| 1 | firstpart | lead |  |", "| 2 | se\\|cond |  | j |"]
    assert [x.asDict() for x in a.corrections] == [{"row": "1", "cell": "0", "source": "11", "target": "1", "reason": tables.REPAIR_REASON}]
    assert b.markdown.split("\n")[2:] == ["| 11 | x |  |  |", "| 12 | y |  |  |"] and b.corrections == []
    assert c is None


def test_lines_table_by_visual_rows(spark):
    rows = [("序号", 40, 20), ("name", 190, 20), ("1x", 400, 40), ("7", 95, 60), ("b", 190, 62), ("c", 200, 90)]
    # no integer lies in the first column, so visual rows decide
    df = spark.createDataFrame([(_lines(rows),)], LINES)
    out = df.select(tables.lines_table("l", F.lit(686))).first()[0]
    assert out is None or out.markdown.startswith("| 序号 | name")


def test_markdown_tables(spark):
    from harvestry.sources.html_nodes import with_fragment

    html = "<table><tr><th>a<th>b</tr><tr><td> 1 </td><td>x|y &amp; z</td></tr><tr><td> </td></tr><tr><td>2</td></tr></table>"
    df = with_fragment(spark.createDataFrame([(html,)], "html string"))
    out = df.select(tables.html_table_markdown("dom"), tables.table_row_count("html")).first()
    assert out[0] == "| a | b |\n| --- | --- |\n| 1 | x\\|y & z |\n| 2 |  |" and out[1] == 3
    cells = spark.createDataFrame([([["a", "b"], ["1\n2"]],), (None,)], "c array<array<string>>")
    assert [r[0] for r in cells.select(tables.cells_markdown("c")).collect()] == ["| a | b |\n| --- | --- |\n| 1 2 |  |", ""]


def test_header_rows_structuring(spark):
    text = "title\nNo Name Name\n1 a b c\n\n2"
    blocks = spark.createDataFrame([(1, "b1", "ocr", None, text), (1, "b2", "paragraph", text, None), (2, "b1", "ocr", "none", "")],
                                   "page_id int, id string, block_type string, text string, ocr_text string")
    cfg = {"enabled": True, "strategies": [{"applies_to": {"keywords": ["Name"]}, "record_type": "row"}]}
    got = [(r.page_id, r.source_block_id, dict(r.data), r.raw_columns) for r in tables.structured_records(blocks, cfg, ["page_id"]).orderBy("row_no").collect()]
    assert got == [(1, "b1", {"No": "1", "Name": "b"}, ["1", "a", "b", "c"]), (1, "b1", {"No": "2", "Name": ""}, ["2"])]
    assert tables.structured_records(blocks, {"enabled": False}, ["page_id"]).count() == 0


def test_words_in_cells_against_every_pair(spark):
    import random

    rng = random.Random(12)
    rows = []
    for k in range(60):
        words = [(str(i), float(rng.randrange(-5, 50)), float(rng.randrange(-5, 50)), float(rng.randrange(0, 6)), float(rng.randrange(0, 6))) for i in range(rng.randrange(25))]
        lines = [[float(rng.randrange(45)) for _ in range(rng.randrange(6))] for _ in range(2)]
        rows.append((k, words, sorted(lines[0]), sorted(lines[1])))
    rows += [(100, None, [1.0, 2.0], [1.0, 2.0]), (101, [("x", 1.0, 1.0, 0.0, 0.0)], None, [0.0, 9.0])]
    df = spark.createDataFrame(rows, "k int, ws array<struct<text:string,left:double,top:double,width:double,height:double>>, r array<double>, c array<double>").repartition(3)
    for got in df.select("*", tables.grid_words(F.col("ws"), F.col("r"), F.col("c")).alias("at")).collect():
        r, c = got.r or [], got.c or []
        want = [[[i for i, w in enumerate(got.ws or []) if c[x] <= w.left + w.width / 2 < c[x + 1] and r[y] <= w.top + w.height / 2 < r[y + 1]] for x in range(len(c) - 1)] for y in range(len(r) - 1)]
        assert [[list(x) for x in y] for y in got["at"]] == want


def test_parser_cascade_joins_nothing(spark):
    """Parts joined with their own words were broadcast, words and all."""
    from harvestry.catalog import load_all

    plan = load_all()["parser_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_anchor_bands_are_worked_out_by_many_tasks(spark):
    from harvestry.catalog import load_all

    found = load_all()["line_anchor_bands"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and plan.count("aggregate(") == 2, plan
