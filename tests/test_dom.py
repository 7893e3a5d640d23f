"""Parsing and selection on small pages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harvestry.operators import archive, dom, extract, jsonpath, lists, selectors
from harvestry.sources.html_nodes import node_table, parse_nodes, with_fragment

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="<p>";</script></head>
<body><!-- c --><ul class="news list"><li class=x><a href="/1" title='q"'>One</a><li><b>b</b><a href='/2?a=1&amp;b=2'>Two <i>i</i></a></ul>
<div id="main"><p>first<p>second <br>line<div class="inner"><p>third</p></div></div><img src="p.png"></body></html>"""


def tags(html):
    return [r[4] for r in parse_nodes(html)[0]]


def test_tree_shape():
    assert tags(PAGE) == "html head title script body ul li a li b a i div p p br div p img".split()
    rows, text = parse_nodes(PAGE)
    for r in rows:
        assert r[2] < r[0] <= r[1] and r[6] <= r[7] and r[8] < r[9]
    by_tag = {r[4]: r for r in rows}
    assert rows[by_tag["p"][2]][4] == "div"
    assert b"var a" in text and "T & t".encode() in text


@pytest.mark.parametrize(
    "html,want",
    [
        ("", []), ("plain", ["html", "body"]), ("<p>a<p>b", ["html", "body", "p", "p"]), ("<li>x", ["html", "body", "li"]), ("<title>t</title><p>x", ["html", "head", "title", "body", "p"]),
        ("a < b <b>c</b>", ["html", "body", "b"]), ("<table><tr><td>1<td>2<tr><td>3", ["html", "body", "table", "tr", "td", "td", "tr", "td"]), ("</p><p>x</p></div>", ["html", "body", "p"]),
        ("<a href='x", []), ("<script>if (a<b) {}", ["html", "head", "script"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["html", "body", "ul", "li", "ul", "li", "li"]), ("<p><b>x<p>y", ["html", "body", "p", "b", "p"]),
    ],
)
def test_tree_rules(html, want):
    got = tags(html)
    assert got == want or (html == "<a href='x" and got in ([], ["html", "body"]))


def test_deep_nesting_does_not_repeat_text():
    rows, text = parse_nodes("<b>x" * 3000)
    assert len(rows) == 3002 and len(text) == 3000


def frag(spark, html):
    return with_fragment(spark.createDataFrame([(1, html)], "page_id int, html string"))


def pick(spark, html, column):
    return frag(spark, html).select(column).first()[0]


@pytest.mark.parametrize(
    "path,want",
    [
        ("li a", ["One", "Two i"]), ("css:ul.news > li > a", ["One", "Two i"]), ("ul.list.news li.x a", ["One"]), ("#main p", ["first", "second line", "third"]), ("#main > p", ["first", "second line"]),
        ("div.inner, li.x", ["One", "third"]), ("a[href]", ["One", "Two i"]), ("a[href='/1']", ["One"]), ("a[href^='/2']", ["Two i"]), ("a[href*='b=2']", ["Two i"]), ("a[href$='1']", ["One"]), ("ul[class~=list] b", ["b"]),
        ("xpath://li[@class='x']/a", ["One"]), ("xpath://ul[contains(@class,'ews')]//a", ["One", "Two i"]), ("xpath:/html/body/ul/li/b", ["b"]), ("xpath://a[@title]", ["One"]), ("div div", ["third"]), ("span", []), ("*[id=main] i", []),
    ],
)
def test_selectors(spark, path, want):
    assert pick(spark, PAGE, dom.text_list("dom", path)) == want


@pytest.mark.parametrize("path", ["a:hover", "xpath:count(//a)", "a::before", "", "a +", "a:nth-child(x)", ":not(", "xpath://a[", "xpath://a[//b]", "xpath://a/@href/b", "a::text, b", "xpath://a/ancestor::*[1]", "a[b!=c]"])
def test_unsupported_selectors_are_refused(path):
    with pytest.raises(ValueError):
        selectors.selector_paths(path)


FORMS = """<body><h1>H</h1><p class="a x">one</p>t0<p lang="de-AT">two <b>bold</b> tail</p><div id="d"><p>three</p><span/></span><p>four</p><p>five</p><ul><li>1</li><li class="s">2</li><li>3</li><li>4</li></ul></div><p>six</p><a href=" /x ">l</a></body>"""


@pytest.mark.parametrize(
    "path,want",
    [
        ("h1 + p", ["one"]), ("h1 ~ p", ["one", "two bold tail", "six"]), ("p + p", ["two bold tail", "five"]), ("li.s ~ li", ["3", "4"]), ("p:first-child", ["three"]), ("li:last-child", ["4"]),
        ("li:nth-child(2n+1)", ["1", "3"]), ("li:nth-child(odd)", ["1", "3"]), ("li:nth-child(even)", ["2", "4"]), ("li:nth-child(-n+2)", ["1", "2"]), ("li:nth-child(3)", ["3"]), ("li:nth-last-child(1)", ["4"]),
        ("p:nth-of-type(2)", ["two bold tail", "four"]), ("div > p:last-of-type", ["five"]), ("h1:only-of-type", ["H"]), ("b:only-child", ["bold"]), ("li:not(.s)", ["1", "3", "4"]), ("p:not([class], [lang])", ["three", "four", "five", "six"]),
        ("p:not(div p)", ["one", "two bold tail", "six"]), ("p:has(b)", ["two bold tail"]), ("div:has(> ul) > p", ["three", "four", "five"]), ("p:has(+ div)", ["two bold tail"]), ("p:is(.a, [lang|=de])", ["one", "two bold tail"]), ("span:empty", [""]),
        ("p.a::text", ["one"]), ("p::text", ["one", "two", "tail", "three", "four", "five", "six"]), ("a::attr(href)", ["/x"]), ("p[class~='x'], li.s", ["one", "2"]),
        ("xpath://li[2]", ["2"]), ("xpath://li[last()]", ["4"]), ("xpath://li[last()-1]", ["3"]), ("xpath://li[position()<3]", ["1", "2"]), ("xpath://li[position()>1 and not(@class)]", ["3", "4"]), ("xpath://p[1]", ["one", "three"]),
        ("xpath://p[@class or @lang]", ["one", "two bold tail"]), ("xpath://p[@class='a x' or text()='six']", ["one", "six"]), ("xpath://p[contains(text(),'ou')]", ["four"]), ("xpath://p[contains(.,'bold')]", ["two bold tail"]),
        ("xpath://p[starts-with(@lang,'de')]/b", ["bold"]), ("xpath://p[b]", ["two bold tail"]), ("xpath://div[.//li[@class='s']]/p[2]", ["four"]), ("xpath://p[@class!='a']", ["one"]), ("xpath://p[normalize-space()='two bold tail']/b", ["bold"]),
        ("xpath://b/..", ["two bold tail"]), ("xpath://b/ancestor::p", ["two bold tail"]), ("xpath://li[@class='s']/following-sibling::li", ["3", "4"]), ("xpath://li[@class='s']/preceding-sibling::li", ["1"]),
        ("xpath://p/text()", ["one", "two", "tail", "three", "four", "five", "six"]), ("xpath://p[@lang]//text()", ["two", "bold", "tail"]), ("xpath://a/@href", ["/x"]), ("xpath://body//@class", ["a x", "s"]), ("xpath://h1 | //a", ["H", "l"]),
        ("xpath://a[normalize-space(@href)='/x']", ["l"]), ("xpath:/html/body/div/ul/li[3]", ["3"]), ("xpath://li[position()!=last()][2]", ["2"]), ("xpath://p[not(@class) and not(ancestor::div)]", ["two bold tail", "six"]), ("xpath://ul/li[self::li]/@class", ["s"]),
    ],
)
def test_selector_forms(spark, path, want):
    assert pick(spark, FORMS, dom.text_list("dom", path)) == want


def test_selectors_keep_to_their_fragment(spark):
    pages = spark.createDataFrame([(1, FORMS), (2, None), (3, ""), (4, FORMS.replace("six", "6"))], "page_id int, html string").repartition(1)
    rows = with_fragment(pages).select("page_id", dom.text_list("dom", "h1 ~ p").alias("p"), dom.text_list("dom", "xpath://p[last()]/text()").alias("t")).orderBy("page_id").collect()
    assert [r.p for r in rows] == [["one", "two bold tail", "six"], [], [], ["one", "two bold tail", "6"]]
    assert [r.t for r in rows] == [["five", "six"], [], [], ["five", "6"]]
    # An item is a tree of its own: its root is a first and last child.
    items = dom.elements(pages.filter("page_id = 1"), "css:div > p", ["page_id"]).select("pos", dom.text_list("item", "p:first-child").alias("x"), dom.text_list("item", "body p").alias("y")).orderBy("pos").collect()
    assert [(r.x, r.y) for r in items] == [(["three"], []), (["four"], []), (["five"], [])]


def _slow(rows, link, a, b):
    """Nodes of tag b in the relation to a node of tag a, pair by pair."""
    def holds(x, y):
        if link == " ":
            return x[0] < y[0] <= x[1]
        if link == ">":
            return y[2] == x[0]
        later = x[2] == y[2] and x[0] < y[0]
        return later if link == "~" else later and not any(z[2] == x[2] and x[0] < z[0] < y[0] for z in rows)
    return [y[0] for y in rows if y[4] == b and any(x[4] == a and holds(x, y) for x in rows)]


def test_relations_against_pairs():
    import random

    import pyarrow as pa

    from harvestry.sources.html_nodes import NODE

    random.seed(5)
    pages = []
    for _ in range(30):
        parts, depth = [], 0
        for _ in range(60):
            if depth and random.random() < 0.45:
                parts.append("</" + parts_open.pop() + ">")
                depth -= 1
            else:
                if not depth:
                    parts_open = []
                tag = random.choice(["div", "b", "i"])
                parts_open.append(tag)
                parts.append(f"<{tag}>")
                depth += 1
        pages.append("".join(parts))
    trees = [parse_nodes(p)[0] for p in pages]
    kinds = {"tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string())}
    lists = pa.array([[dict(zip([f.name for f in NODE], r)) for r in t] for t in trees], pa.list_(pa.struct([(f.name, kinds.get(f.name, pa.int32())) for f in NODE])))
    for batch, own in ((lists, trees), (lists.slice(7, 11), trees[7:18])):
        nodes = selectors.Nodes(batch)
        for link in (" ", ">", "+", "~"):
            (path,) = selectors.css_paths("div b" if link == " " else f"div {link} b")
            got = nodes.met(path)
            want = [x for t, start in zip(own, nodes.bounds) for x in (start + n for n in _slow(t, link, "div", "b"))]
            assert got.nonzero()[0].tolist() == want, link


def test_large_page_is_linear(spark):
    """100,000 nodes, half of which are met by the first step."""
    import time

    html = "<ul>" + "<li><a href='/x'>t</a>" * 50_000 + "</ul>"
    page = frag(spark, html).persist()
    page.count()
    started = time.time()
    row = page.select(F.size(dom.select_nodes("dom", "ul li a")), F.size(dom.select_nodes("dom", "li ~ li:nth-child(3n)")), F.size(dom.values("dom", "xpath://li[a]/a/@href"))).first()
    assert tuple(row) == (50_000, 16_666, 50_000) and time.time() - started < 30
    page.unpersist()


def test_first_values(spark):
    assert pick(spark, PAGE, dom.first_attr("dom", "li a", "title")) == 'q"'
    assert pick(spark, PAGE, dom.first_attr("dom", "b", "href")) == ""
    assert pick(spark, PAGE, dom.first_html("dom", "li.x a")) == "<a href=\"/1\" title='q\"'>One</a>"
    assert pick(spark, PAGE, dom.all_text("dom", "li")) == "OnebTwo i"


def test_non_ascii_offsets(spark):
    html = "<p>é漢😀</p><a href='/ü'>ß &eacute;</a><p>z</p>"
    assert pick(spark, html, dom.text_list("dom", "p, a")) == ["é漢😀", "ß é", "z"]
    assert pick(spark, html, dom.first_html("dom", "a")) == "<a href='/ü'>ß &eacute;</a>"


def test_elements_and_v2_records(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>")], "page_id int, html string")
    found = dom.elements(pages, "css:li", ["page_id"])
    assert [(r.pos, r.href, r.title) for r in found.orderBy("pos").collect()] == [(0, "/1", "One"), (1, "/2?a=1&b=2", "bTwo i")]
    rule = {
        "title": {"selector": "a"}, "link": {"type": "attribute", "selector": "a", "attribute": "href", "base_url": "https://e.org/x/"}, "parts": {"type": "list", "selector": "li > a"},
        "outer": {"selector": "ul li a"}, "self": {"type": "attr", "selector": "li", "attr": "class"}, "gone": {"selector": "h1"}, "shout": {"selector": "b", "transform": "trim"},
    }
    rows = dom.extract_records(found, rule, ["page_id", "pos"]).orderBy("pos").collect()
    assert [tuple(r)[2:] for r in rows] == [("One", "https://e.org/1", ["One"], "", "x", "", ""), ("Two i", "https://e.org/2?a=1&b=2", ["Two i"], "", "", "", "b")]
    xp = dom.elements(pages, "xpath://li", ["page_id"]).orderBy("pos").collect()
    assert [(r.href, r.title, r.text) for r in xp] == [("", "One", None), ("", "bTwo i", None)]


def test_node_table(spark):
    nodes = node_table(spark.createDataFrame([(1, PAGE)], "page_id int, html string"), ["page_id"])
    inner = nodes.filter("tag = 'li'").orderBy("node_id").collect()
    assert [r.text for r in inner] == ["One", "bTwo i\n"] or [r.text.strip() for r in inner] == ["One", "bTwo i"]
    a, b = nodes.alias("a"), nodes.alias("b")
    inside = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & F.col("b.node_id").between(F.col("a.node_id") + 1, F.col("a.end_id"))).filter("a.tag = 'li' AND b.tag = 'a'")
    assert inside.count() == 2


def test_structure_hash_ignores_text(spark):
    h = lambda x: pick(spark, x, dom.structure_hash("dom"))
    assert h("<p>a</p>") == h("<p class=x>bc</p>") != h("<div>a</div>")


def test_detail_blocks(spark):
    def blocks(html, content="body"):
        rows = archive.read_details(spark.createDataFrame([(html,)], "html string"), {"archive": {"detail": {"metadata": {"content": {"selector": content}}}}}).first()
        return rows.title, [(b.id, b.block_type, b.block_order, b.text) for b in rows.blocks]

    assert blocks("<h1> T </h1><p>a</p><p> </p><p>b</p>") == ("T", [("b1", "heading", 1, "T"), ("b2", "paragraph", 2, "a"), ("b4", "paragraph", 4, "b")])
    assert blocks("<section><div>x</div><span><div>y</div></span></section>", "section") == ("", [("b2", "paragraph", 2, "x")])


def test_discover_images_caps_before_dropping(spark):
    html = "<img src=''><img src=' a.png ' alt=' A '><img src='b.png'><img src='c.png'>"
    pages = spark.createDataFrame([(1, "https://e.org/d/", html)], "page_id int, url string, html string")
    rows = archive.discover_images(pages, ["page_id"], {"max_images": 3}).orderBy("image_no").collect()
    assert [(r.image_no, r.source_img_url, r.source_img_alt) for r in rows] == [(2, "https://e.org/d/a.png", "A"), (3, "https://e.org/d/b.png", "")]


def test_legacy_paths(spark):
    html = "<a class=\"type-post\" href='/1'>x</a><A class='type-post' href=\"/2\"></A><h1 class='t'> Head </h1><a class='s type-post big' rel=n href='/3'>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r.href for r in extract.legacy_elements(pages, "//a[contains(@class, 'type-post')]", ["page_id"]).collect()] == ["/1", "/3"]
    assert [r.html for r in extract.legacy_elements(pages, "//h1[@class='t']", ["page_id"]).collect()] == ["<h1 class='t'>"]
    assert extract.legacy_elements(pages, "nonsense", ["page_id"]).count() == 0
    fields = [{"name": "h", "type": "xpath", "path": "//h1[@class='t']//text()"}, {"name": "c", "type": "attr", "path": "//h1[@class='t']", "attr": "class"}, {"name": "k", "type": "constant", "value": "v"}, {"name": "m", "type": "xpath", "path": "//h2[@class='t']"}]
    r = extract.html_fields(pages, fields).first()
    assert (r.h, r.c, r.k, r.m) == ("Head", "t", "v", "")


def test_regex_elements_and_raw_id(spark):
    pages = spark.createDataFrame([(1, "<a href='/p/12'>x\ny</a><a href='/q'>z</a>")], "page_id int, html string")
    found = extract.regex_elements(pages, r"<a href='([^']*)'>(.*?)</a>", ["page_id"])
    assert [(r.pos, r.href, r.title) for r in found.collect()] == [(0, "/p/12", "x\ny"), (1, "/q", "z")]
    assert extract.regex_elements(pages, "<a", ["page_id"]).count() == 0
    ids = extract.fill_raw_id(found.withColumnRenamed("href", "url"), r"/p/(?P<n>\d+)").orderBy("pos").collect()
    assert [r.raw_id for r in ids] == ["12", None]


def test_json_paths(spark):
    body = '{"data":[{"id":1},{"id":2}],"a":{"b":["x",["y"]],"t":true,"s":"[no]"},"e":[]}'
    df = spark.createDataFrame([(body,), ("{bad",), (None,)], "v string")

    def found(path):
        return [None if r[0] is None else list(r[0]) for r in df.select(F.transform(extract.json_find("v", path), extract.json_text)).collect()]

    assert found("")[0] == ['{"id":1}', '{"id":2}'] and found("")[1:] == [[], []]
    assert found("data[*].id")[0] == ["1", "2"] and found("$.a.b")[0] == ["x", '["y"]'] and found("a.s")[0] == ["[no]"]
    assert found("e")[0] == [] and found("$.zz[*].q")[0] == []
    first = lambda p: df.select(extract.json_first("v", p)).first()[0]
    assert [first(p) for p in ("a.b", "data", "e", "a.t", "none", "data[1].id", "$.data[*].id")] == ["x", '{"id":1}', "", "true", "", "2", "1"]
    rec = extract.api_records(df.limit(1), [{"name": "u", "type": "computed", "value": "{t}/{i}", "vars": {"t": "a.t", "i": "data[0].id"}}], [], "v").first()
    assert rec.u == "True/1"


STORE = """{"a": {"b": [{"id": 1, "p": 8.50, "t": "x"}, {"id": 2, "p": 12, "t": "y", "sub": {"id": 9}}, {"id": 3, "t": null}], "id": 0}, "list": [0, 1, 2, 3, 4, 5], "o": {"k": 1, "m": [2, 3]}, "q'r": "s", "big": 12345678901234567890, "e": 1e3}"""


@pytest.mark.parametrize(
    "path,want",
    [
        ("$..id", ["0", "1", "2", "9", "3"]), ("$.a..id", ["0", "1", "2", "9", "3"]), ("$.a.b..id", ["1", "2", "9", "3"]), ("$.list[1:3]", ["1", "2"]), ("$.list[-2:]", ["4", "5"]), ("$.list[::2]", ["0", "2", "4"]), ("list[::-3]", ["5", "2"]),
        ("$.list[0,2,9]", ["0", "2"]), ("$.list[-1]", ["5"]), ("$.o.*", ["1", "2", "3"]), ("$.a.b[0]['id','t']", ["1", '"x"']), ("$.a.b[?(@.p > 9)].id", ["2"]), ("$.a.b[?(@.p < 9 || @.id == 3)].id", ["1", "3"]),
        ("$.a.b[?(@.t == 'x' && @.p)].p", ["8.50"]), ("$.a.b[?(!@.p)].id", ["3"]), ("$.a.b[?(@.t != 'x')].id", ["2", "3"]), ("$.a.b[?(@.sub.id >= 9)].t", ['"y"']), ("$.a.b[?(@.t == null)].id", ["3"]), ("$['q\\'r']", ['"s"']),
        ("$.big | $.e", ["12345678901234567890", "1e3"]), ("$..m", ["2", "3"]), ("$..*[?(@.id == 9)]", ['{"id":9}']), ("$.o..*", ["1", "2", "3", "2", "3"]), ("$.list[?(@ >= 4)]", ["4", "5"]), ("$.none..x", []),
    ],
)
def test_json_path_forms(path, want):
    assert jsonpath.found(STORE, path) == want


def test_json_path_forms_as_columns(spark):
    df = spark.createDataFrame([(STORE,), ("{bad",), (None,), ('{"a": NaN}',), ('{"id": 1, "id": 2}',)], "v string")
    rows = df.select(F.transform(extract.json_find("v", "$..id"), extract.json_text).alias("x"), extract.json_first("v", "$.list[3:]").alias("f")).collect()
    assert [list(r.x) for r in rows] == [["0", "1", "2", "9", "3"], [], [], [], []] and [r.f for r in rows] == ["3", "", "", "", ""]
    # Both ways of looking up agree on what both can do.
    for path in ("$.a.b[*].id", "list", "a.b[1].sub.id", "$['o']['m']", "$.a.b", "e", "big"):
        plain = df.limit(1).select(F.transform(extract.json_find("v", path), extract.json_text)).first()[0]
        walked = df.limit(1).select(F.transform(jsonpath.find_texts(F.col("v"), path), lambda t: extract.json_text(F.try_parse_json(t)))).first()[0]
        assert list(plain) == list(walked), path
    for bad in ("$..[bad", "$.a[", "$[?(@.x =! 1)]", "$.a[0:1:0]", "a b", "$..", "$.a[]", "$.a['x'"):
        with pytest.raises(ValueError):
            extract.json_find("v", bad)


def test_details_limit_values():
    assert [lists.details_limit(v) for v in (None, "", 0, "0", "all", "Unlimited", -3, "5", 7)] == [None] * 7 + [5, 7]
    assert [lists.preview_size(v) for v in (None, 0, 1, 20, 99)] == [5, 5, 1, 20, 20]


def test_pages_until_empty(spark):
    rows = [("a", 1, 3), ("a", 2, 0), ("a", 3, 4), ("b", 1, 1), ("b", 3, 1), ("c", 1, 1), ("c", 2, 1), ("c", 3, 1)]
    df = spark.createDataFrame(rows, "run string, page_no int, item_count int")
    got = lambda **k: sorted((r.run, r.page_no) for r in lists.stop_at_empty(df, ["run"], **k).collect())
    assert got(max_pages=2) == [("a", 1), ("b", 1), ("c", 1), ("c", 2)]
    assert got(max_pages=9, keep_empty=True) == [("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2), ("c", 3)]


def test_references_need_their_semicolon():
    html = "<title>a &amp &amp; &notit; &lt;</title><a href='/x?a=1&copy=2&amp;b=3'>&#65 &#x42; &eacute;&amp</a>"
    rows, text = parse_nodes(html)
    assert text.decode() == "a &amp & &notit; <A B é&amp"
    assert dict(next(r[5] for r in rows if r[4] == "a")) == {"href": "/x?a=1&copy=2&b=3"}


def test_captures_of_pages_that_share_a_url(spark):
    rows = spark.createDataFrame([(1, "u", "long " * 9), (2, "u", "s"), (3, "v", "t")], "page_id int, url string, html string")
    mobile = rows.withColumn("html", F.concat(F.lit("m"), "html"))
    picked = extract.pick_capture(rows, mobile, 10, ("page_id", "url"))
    assert {tuple(r) for r in picked.collect()} == {(1, "u", "long " * 9), (2, "u", "ms"), (3, "v", "mt")}


def test_pages_are_parsed_in_runs():
    from harvestry.sources import html_nodes

    pages = pa.array(["<p>a</p>" * n for n in (1, 50, 2, 0, 40)] + [None])
    runs = []

    def work(some):
        runs.append(len(some))
        return html_nodes._parsed(some)

    sizes = np.array([len(p or "") for p in pages.to_pylist()])
    assert html_nodes.in_runs(pages, sizes, work, 100).equals(html_nodes._parsed(pages)) and runs == [1, 3, 2]
    assert len(html_nodes.in_runs(pages[:0], sizes[:0], work, 100)) == 0
