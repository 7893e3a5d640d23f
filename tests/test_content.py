"""Classes by patterns and structure drift against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from harvestry.operators import classify, drift, trend
from harvestry.sources.html_nodes import parse_nodes, with_fragment


def test_patterns_against_search(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    rules = [(rng.choice("XYZ"), "keyword", w) for w in words] + [("start", "keyword", "^ab"), ("end", "keyword", "ca$"), ("whole", "keyword", "^abc$"), ("url", "url", "/News/")]
    texts = ["".join(rng.choice("abcABC ") for _ in range(rng.randrange(25))) for _ in range(200)] + [None, "", "abc", "ABCA"]
    table = spark.createDataFrame(rules + rules[:3], "label string, kind string, pattern string")
    df = spark.createDataFrame([(i, t, "https://e.org/news/" if i % 2 else None) for i, t in enumerate(texts)], "i int, text string, url string")

    def hits(pattern, text):
        first, last = pattern.startswith("^"), pattern.endswith("$")
        p = pattern.strip("^$").lower()
        at = [i for i in range(len(text) - len(p) + 1) if text.startswith(p, i)]
        return sum(not (first and i or last and i + len(p) != len(text)) for i in at)

    for r in classify.classify(df, table, "text", "url").collect():
        want = {}
        for label, kind, pattern in dict.fromkeys(rules):
            n = hits(pattern, ((r.text if kind == "keyword" else r.url) or "").lower())
            if n:
                want[label] = want.get(label, 0) + n
        assert [(c.label, c.hits) for c in r.classes] == sorted(want.items(), key=lambda x: (-x[1], x[0]))
        assert r.label == (r.classes[0].label if r.classes else None)


def test_rules_that_are_refused(spark):
    df = spark.createDataFrame([("x",)], "text string")
    for rule in (("a", "keyword", "^$"), ("a", "regex", "x")):
        with pytest.raises(ValueError):
            classify.classify(df, spark.createDataFrame([rule], "label string, kind string, pattern string"))
    none = spark.createDataFrame([], "label string, kind string, pattern string")
    assert [(list(r.classes), r.label) for r in classify.classify(df, none).collect()] == [([], None)]


def _tree(html):
    rows, _ = parse_nodes(html)
    return [r[4] for r in rows], [r[2] for r in rows]


def test_grams_of_a_small_tree():
    # html > body > (a, b > c)
    assert drift.grams(["html", "body", "a", "b", "c"], [-1, 0, 1, 1, 3]) == {
        "* html * * body": 1, "* html * body *": 1, "* html body * *": 1, "html body * * a": 1, "html body * a b": 1, "html body a b *": 1, "html body b * *": 1,
        "body a * * *": 1, "body b * * c": 1, "body b * c *": 1, "body b c * *": 1, "b c * * *": 1,
    }


def test_drift_grows_with_the_change(spark):
    parts = [f"<li><a>{i}</a></li>" for i in range(40)]
    pages = []
    for changed in range(0, 41, 5):
        own = [p.replace("a>", "b>") if i < changed else p for i, p in enumerate(parts)]
        pages.append((changed, f"<ul>{''.join(own)}</ul>"))
    df = spark.createDataFrame([*pages, (99, None), (100, "<p>x")], "k int, html string")
    base = with_fragment(spark.createDataFrame([(pages[0][1],)], "html string")).select(drift.profile("dom").alias("profile"))
    known = df.filter("k < 100").select("k").crossJoin(base)
    rows = {r.k: r for r in drift.drift_degrees(df, known, ["k"], limit=0.2).collect()}
    degrees = [rows[k].drift_degree for k, _ in pages]
    assert degrees[0] == 0 and all(a < b for a, b in zip(degrees, degrees[1:])) and rows[99].drift_degree == 1
    assert (rows[100].drift_degree, rows[100].drifted) == (None, False) and [rows[k].drifted for k, _ in pages] == [d > 0.2 for d in degrees]
    one = drift.grams(*_tree(pages[0][1]))
    for k, html in pages:
        two = drift.grams(*_tree(html))
        assert rows[k].drift_degree == pytest.approx(1 - 2 * sum((one & two).values()) / (sum(one.values()) + sum(two.values())), abs=5e-5)


def test_alerts_against_a_walk(spark):
    rng = random.Random(6)
    rows = []
    for source in ("a", None):
        for day in range(40):
            share = 0.1 if day < 25 or source is None else 0.5
            rows += [(source, day * 86_400 + rng.randrange(86_400), rng.choice(["", None, " \t"]) if rng.random() < share else "x") for _ in range(30)]
    df = spark.createDataFrame(rows, "platform string, s long, title string").withColumn("ts", F.timestamp_seconds("s"))
    got = trend.missing_alerts(trend.missing_rates(df, ["title"]), 20_000, 200_000).orderBy("source", "start").collect()
    for source in ("a", None):
        own = [r for r in got if r.source == source]
        earlier, drift_ = [], 0
        for day, r in enumerate(own):
            here = [x for x in rows if x[0] == source and x[1] // 86_400 == day]
            rate = sum(not (x[2] or "").strip() for x in here) * 1_000_000 // len(here)
            expected = sum(earlier) // len(earlier) if earlier else rate
            drift_ = max(0, drift_ + rate - expected - 20_000)
            earlier.append(rate)
            assert (r.rate, r.expected, r.drift, r.alert) == (rate, expected, drift_, drift_ > 200_000)
    assert [r.alert for r in got if r.source == "a"][25:].count(True) > 10


def test_log_files_newest_first(spark, tmp_path):
    from harvestry.operators import lists

    for name in ("run_2024.log", "run_2023.log", "notes.txt"):
        (tmp_path / name).write_text("x" * len(name))
    rows = lists.log_list(lists.log_files(spark, str(tmp_path))).collect()
    assert [(r.name, r["size"]) for r in rows] == [("run_2024.log", 12), ("run_2023.log", 12)] and rows[0].modified_at is not None


def test_lines_of_files_in_many_splits(spark, tmp_path):
    from harvestry.sources import line_files

    rng = random.Random(2)
    want, items = {}, {}
    for name in ("a", "b", "c d"):
        own = [rng.choice(["", "  ", "{bad", '{"k": %d}' % i, "x" * rng.randrange(300), "[1]"]) for i in range(400)]
        (tmp_path / name).write_text("\n".join(own) + rng.choice(["", "\n"]))
        own = own[:-1] if own[-1] == "" else own
        want[name] = own
        good = [x.strip() for x in own if x.strip() in ("[1]",) or x.startswith('{"k"')]
        items[name] = (sum(bool(x.strip()) for x in own), good)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = line_files.file_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = lines.collect()
        got = line_files.line_items(spark, str(tmp_path)).collect()
        tail = line_files.file_tail(spark, str(tmp_path), 7).count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, own in want.items():
        mine = sorted((r.line_no, r.line, r.total) for r in rows if r.file.replace("%20", " ").endswith("/" + name))
        assert [m[1] for m in mine] == own and [m[0] for m in mine] == list(range(1, len(own) + 1)) and {m[2] for m in mine} == {len(own)}
        total, good = items[name]
        mine = sorted((r.pos, r["item"], r.total) for r in got if r.file.replace("%20", " ").endswith("/" + name))
        assert [m[1] for m in mine] == good and [m[0] for m in mine] == list(range(len(good))) and {m[2] for m in mine} == {total}
    assert tail == 21


def test_files_of_a_folder_are_one_in_parts(spark, tmp_path):
    from harvestry.sources import line_files

    rng = random.Random(3)
    own = [rng.choice(["", "  ", "{bad", '{"k": %d}' % i, "x" * rng.randrange(300)]) for i in range(500)]
    for at in range(0, 500, 100):
        (tmp_path / f"part-{at:05}").write_text("".join(x + "\n" for x in own[at : at + 100]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = sorted((r.line_no, r.line, r.total) for r in line_files.file_lines(spark, str(tmp_path), parts=True).collect())
        tail = sorted(r.line_no for r in line_files.file_tail(spark, str(tmp_path), 150, parts=True).collect())
        items = line_files.line_items(spark, str(tmp_path), parts=True)
        got = sorted((r.pos, r.item, r.total) for r in items.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert lines == [(i + 1, x, 500) for i, x in enumerate(own)] and tail == list(range(351, 501))
    good = [x for x in own if x.startswith('{"k"')]
    assert got == [(i, x, sum(bool(x.strip()) for x in own)) for i, x in enumerate(good)]


def test_lines_of_a_large_file_are_written_by_many_tasks(spark):
    from harvestry.catalog import Tables, content_queries

    rows = spark.range(200_000, 0, -1).selectExpr("id AS n", "id || sha2(CAST(id AS STRING), 256) AS value")
    path = content_queries._in_parts(rows, Tables(spark, "."))
    files = spark.read.text(path).selectExpr("_metadata.file_name AS f", "CAST(left(value, length(value) - 64) AS INT) AS v").groupBy("f").agg({"v": "min"}).orderBy("f").collect()
    assert len(files) > 1 and [r[1] for r in files] == sorted(r[1] for r in files)
