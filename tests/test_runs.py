"""Run look-ups against brute force, storage round trips and streams."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from harvestry.operators import archive, lists, runs, sources_registry
from harvestry.plans import archiving, collect, reports
from harvestry.sources import commits, readers, writers
from harvestry.streaming import batches, events

T0 = dt.datetime(2024, 1, 1)


def test_match_runs_against_brute_force(spark):
    rng = random.Random(7)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(4000))
    paths = ["rules/a.yaml", "rules/x/a.yaml", "rules/b.yaml", "za.yaml"]
    run_rows = [(f"{i:03d}", at(), rng.choice(paths)) for i in range(60)]
    tasks = [(i, at() + dt.timedelta(hours=8), rng.choice(["a.yaml", "rules/b.yaml", None, "", "c.yaml"])) for i in range(80)] + [(900, None, "a.yaml")]
    run_df = spark.createDataFrame(run_rows, "run_id string, started_at timestamp, rule_path string")
    task_df = spark.createDataFrame(tasks, "task_id int, created_at timestamp, rule_path string")
    got = {r.task_id: r.run_id for r in runs.match_runs(task_df, run_df).collect()}
    for tid, created, path in tasks:
        want = None
        if created is not None:
            t = created - dt.timedelta(hours=8)
            hits = [(s, i) for i, s, p in run_rows if abs((s - t).total_seconds()) <= 300 and p.endswith(path or "")]
            want = max(hits)[1] if hits else None
        assert got[tid] == want, (tid, created, path)


def test_older_items_skip_the_matched_one(spark):
    stored = spark.createDataFrame([("1", "p", "k", 1), ("2", "p", "k", 2), ("3", "p", "k", 3), ("4", "p", None, 9)], "id string, platform string, raw_id string, collected_at int")
    stored = stored.withColumns({c: F.lit("") for c in ("title", "url", "content_hash")})
    ri = spark.createDataFrame([("a", "filtered", "p", "k", "3"), ("b", "filtered", "p", "k", None), ("c", "raw", "p", "k", None), ("d", "filtered", "p", None, None), ("e", "filtered", "q", "k", None)],
                               "n string, item_stage string, platform string, raw_id string, matched_existing_id string")
    got = {r.n: r.old_item_id for r in runs.match_older_items(ri, stored).collect()}
    assert got == {"a": "2", "b": "3", "c": None, "d": None, "e": None}


def test_trust(spark):
    rec = spark.createDataFrame([("p", 0.9, 3), ("p", 0.8, 2), ("p", 0.7, 1)], "platform string, quality_score double, created_at int")
    assert sources_registry.history_trust(rec).first().history == 0.8
    assert sources_registry.history_trust(rec, runs=2).first().history == 0.85
    src = spark.createDataFrame([("p", 1, 0.0), ("q", 0, 0.0)], "platform string, enabled int, trust_score double")
    got = {r.platform: r.trust_score for r in sources_registry.blend_trust(src, sources_registry.history_trust(rec)).collect()}
    assert got == {"p": 0.82, "q": 0.3}


ITEMS = [("s1", "p1", "2024-01-01", "u1", "a"), ("s1", "p2", "2024-01-01", "u2", "b")]


def test_result_sink_and_repeat(spark, tmp_path):
    df = spark.createDataFrame(ITEMS, "subject string, platform string, collected_date string, url string, title string")
    path = str(tmp_path / "out")
    assert writers.save_results(df, path, "r1") and writers.save_results(df, path, "r1") and writers.save_results(df, path, "r2")
    assert spark.read.parquet(path).count() == 4
    assert os.path.isdir(f"{path}/subject=s1/platform=p2/collected_date=2024-01-01/run_id=r1")
    assert writers.save_results(df.filter("false"), str(tmp_path / "none"), "r1") is False and not os.path.exists(tmp_path / "none")
    with pytest.raises(Exception, match="no subject"):
        writers.save_results(df.withColumn("subject", F.lit("")), str(tmp_path / "bad"), "r1")


def test_result_files_from_disk(spark, tmp_path):
    def put(rel, body):
        file = tmp_path / rel
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(body, encoding="utf-8")

    put("s1/p1/data_1.json", json.dumps({"meta": {"subject": "s1", "platform": "p1", "governance": {"quality_score": 0.5}}, "data": [{"url": "a"}, {"url": "b"}]}))
    put("s1/p1/data_2.json", '[9]\n{"url": "c"}\n\nnot json\n')
    put("s1/p2/data_1.json", "{broken")
    put("s1/p2/combined_latest.json", '{"data": [1, 2, 3]}')
    put("s1/p2/archives/h1/page.json", '{"meta": {}}')
    files = readers.result_files(spark, str(tmp_path))
    counts = {(r.platform, r.file_name): r.item_count for r in readers.result_counts(files).collect()}
    assert counts == {("p1", "data_1.json"): 2, ("p1", "data_2.json"): 3, ("p2", "data_1.json"): 0}
    got = sorted((r.file_name, r.total, r.item) for r in readers.result_items(files, ["file_name"]).collect())
    assert got == [("data_1.json", 2, '{"url":"a"}'), ("data_1.json", 2, '{"url":"b"}'), ("data_2.json", 3, "[9]"), ("data_2.json", 3, '{"url": "c"}')]
    assert readers.result_items(files, ["file_name"], limit=1).count() == 2
    assert [(r.subject, r.platform) for r in readers.archive_packages(spark, str(tmp_path)).collect()] == [("s1", "p2")]
    rec = {r.file_name: r for r in lists.governance_records(readers.result_meta(files.filter("platform = 'p1'"))).collect()}
    assert (rec["data_1.json"].item_count, rec["data_1.json"].quality_score, rec["data_1.json"].field_completeness, rec["data_2.json"].status) == (2, 0.5, 1.0, "PARTIAL_SUCCESS")
    assert [r.file_name for r in lists.file_counts(readers.result_counts(files)).orderBy("platform").collect()] == ["data_2.json", "data_1.json"]
    assert readers.json_bodies(spark, str(tmp_path / "s1/p1/data_1.json")).count() == 1


def test_assets_and_logs_from_disk(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"abc")
    (tmp_path / "l.log").write_text("1\n2\n3\n")
    a = readers.assets_from_files(spark, str(tmp_path / "a.PNG")).first()
    import hashlib

    assert (a.size_bytes, a.content_hash, a.file_name, a.extension, a.mime_type) == (3, hashlib.sha256(b"abc").hexdigest(), "a.PNG", "PNG", "image/png")
    assert [(r.total, r.line_no, r.line) for r in lists.log_tail(readers.log_files(spark, str(tmp_path / "l.log")), 2).collect()] == [(3, 2, "2"), (3, 3, "3")]


def test_event_lines(spark):
    lines = ['{"type":"error","ts":5,"message":"m"}', "", "  ", "{bad", "[1]", ' {"type":"complete","new_count":2,"duration":1.239} ']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [(r.type, r.message, r.new_count) for r in readers.event_lines(df).collect()] == [("error", "m", None), ("complete", None, 2)]
    out = spark.range(1).select(writers.event_json("complete", F.lit(5), rule=F.lit("r"), new_count=F.lit(1), skip_count=F.lit(0), duration=F.lit(1.239))).first()[0]
    assert json.loads(out) == {"type": "complete", "ts": 5, "rule": "r", "new_count": 1, "skip_count": 0, "duration": 1.24}
    assert set(writers.EVENT_FIELDS) == {"start", "status", "progress", "item", "error", "skip", "complete", "summary"}


LIST = """<ul class="news">{}</ul>"""
RULE = {
    "name": "news", "subject": "web", "source": {"platform": "docs", "url": "https://e.org/list/"}, "list": {"items_path": "css:ul.news > li"},
    "extract": {"title": {"selector": "a"}, "url": {"type": "attribute", "selector": "a", "attribute": "href", "base_url": "https://e.org/"}}, "dedup": {"url_to_id_pattern": r"/d/(\w+)"},
    "governance": {"dedup": "hash", "required_fields": ["title", "url"]}, "discovery": {"enabled": True, "list": {"items_path": "css:ul.news > li", "detail_url": {"selector": "a"}}},
    "archive": {"enabled": True, "detail": {"metadata": {"content": {"selector": "div.c"}}}},
    "structuring": {"enabled": True, "strategies": [{"applies_to": {"block_types": ["paragraph"], "keywords": ["No"]}, "record_type": "r"}]},
}


def list_html(*pairs):
    return LIST.format("".join(f'<li><a href="{u}">{t}</a></li>' for u, t in pairs))


def test_collect_run(spark):
    pages = spark.createDataFrame([(1, list_html(("/d/1", "a"), ("/d/2", "b"))), (2, list_html(("/d/2", "b"), ("/x", "c"), ("", " ")))], "page_id int, html string")
    registry = spark.createDataFrame([("docs_1",)], "id string")
    run = collect.run_rule(pages, RULE, registry, "r1")
    assert sorted((r.title, r.url, r.raw_id) for r in run.governed.collect()) == [("", "", None), ("b", "https://e.org/d/2", "2"), ("c", "https://e.org/x", None)]
    s = run.summary.first()
    assert (s.total_collected, s.dedup_filtered, s.item_count, s.duplicate_count, s.field_completeness, s.status) == (5, 1, 3, 1, 0.6667, "PARTIAL_SUCCESS")
    assert {(r.item_stage, r["count"]) for r in run.stages().groupBy("item_stage").count().collect()} == {("raw", 5), ("deduped", 3), ("filtered", 1)}
    assert run.stages().filter("item_stage = 'filtered'").first().filter_reason == "dedup_incremental_existing_raw_id"
    data = json.loads(run.tables()["collection_items"].filter("raw_id = '2'").first().data)
    assert data == {"title": "b", "url": "https://e.org/d/2", "raw_id": "2"}
    assert [r.title for r in collect.preview_rule(pages, RULE, 2).collect()] == ["a", "b"]


def test_run_tables_commit(spark, tmp_path):
    pages = spark.createDataFrame([(1, list_html(("/d/1", "a")))], "page_id int, html string")
    run = collect.run_rule(pages, RULE, None, "r1", materialise=True)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    record = collect.run_record(run, RULE, "rules/news.yaml", start, start + F.expr("INTERVAL 90 SECONDS"))
    root = str(tmp_path)
    for run_id in ("r1", "r1", "r2"):
        writers.save_run_tables(run.tables() | {"collection_runs": record}, root, run_id)
    assert sorted(os.listdir(tmp_path)) == ["_commits", "collection_governance_records", "collection_items", "collection_run_items", "collection_runs"]
    r = commits.committed(spark, root, "collection_runs").first()
    assert (r.rule_name, r.subject, r.platform, r.status, r.saved_count, r.duration_seconds) == ("news", "web", "docs", "success", 1, 90.0)
    assert commits.committed(spark, root, "collection_run_items").count() == 4 and commits.committed(spark, root, "none") is None


def test_broken_write_is_not_seen(spark, tmp_path):
    """Rows without a line in the manifest don't show; the retry replaces them."""
    root = str(tmp_path)
    good = spark.createDataFrame([(1, "a")], "id int, v string")
    bad = good.select("id", F.raise_error(F.lit("lost")).cast("string").alias("v"))
    assert commits.committed(spark, root, "first") is None
    with pytest.raises(Exception, match="lost"):
        commits.commit({"first": good, "second": bad}, root, "u/1")
    assert commits.committed(spark, root, "first") is None and os.listdir(f"{root}/first")
    commits.commit({"first": good, "second": good}, root, "u/1")
    commits.commit({"first": good.filter("false"), "second": good.withColumn("w", F.lit(2))}, root, "u 2")
    assert [tuple(r) for r in commits.committed(spark, root, "first").collect()] == [(1, "a")]
    assert {(r.id, r.v, r.w) for r in commits.committed(spark, root, "second").collect()} == {(1, "a", 2), (1, "a", None)}
    commits.commit({"first": spark.createDataFrame([(7, "z")], "id int, v string")}, root, "u/1")
    assert [tuple(r) for r in commits.committed(spark, root, "first").collect()] == [(7, "z")]


def test_archive_hashes_are_unique_across_runs(spark, tmp_path):
    root = str(tmp_path)
    pages = archive.build_pages(spark.createDataFrame([(f"https://e.org/{i}", f"<p>{i}</p>") for i in (1, 2)], "source_url string, html string"))
    one, two = (archive.storage_tables(pages.filter(F.col("meta.source_url").endswith(x))) for x in ("1", "2"))
    both = archive.storage_tables(pages.union(pages))
    writers.save_archive(one, root, "a")
    writers.save_archive(both, root, "b")  # page 1 is known, page 2 twice in the run
    writers.save_archive(both, root, "b")
    found = writers.read_archive(spark, root)
    assert sorted(r.source_url for r in found["archive_pages"].collect()) == ["https://e.org/1", "https://e.org/2"]
    # Side by side neither run sees the other: the one committed first holds.
    commits.commit(two, root, "c")
    found = writers.read_archive(spark, root)
    assert found["archive_pages"].count() == 2 and set(found) == {"archive_pages", "archive_blocks", "archive_assets", "ocr_results"}
    assert found["archive_blocks"].count() == found["archive_blocks"].select("id").distinct().count()


def test_result_meta(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(ITEMS, "subject string, platform string, collected_date string, url string, title string")
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    summary = spark.createDataFrame([("r1", 2, 0.5)], "run_id string, item_count int, quality_score double")
    for _ in range(2):
        writers.save_results(df, path, "r1", "news", at(3), 4, summary)
    writers.save_results(df.filter("platform = 'p1'"), path, "r2", "news", at(2))
    assert spark.read.parquet(path).count() == 3
    meta = writers.result_meta(spark, path)
    assert sorted((r.platform, r.run_id, r["count"], r.dedup_filtered) for r in meta.collect()) == [("p1", "r1", 1, 4), ("p1", "r2", 1, 0), ("p2", "r1", 1, 4)]
    rows = spark.read.parquet(path).select("subject", F.col("run_id").alias("file"), at(1).alias("modified_at"), F.lit(1).alias("pos"), "url")
    view = writers.combined_meta(writers.combined_latest(rows), meta).first()
    assert (view.subject, view.platform, str(view.collected_at), view["count"]) == ("s1", "combined", "2024-01-03 00:00:00", 2)


def test_archive_run_orders_and_dedups(spark, tmp_path):
    lp = spark.createDataFrame([(1, list_html(("/d/2", "two"), ("/d/1", "one"), ("/d/2", "again"))), (2, list_html(("/d/3", "three"), ("/d/1", "one"), ("/gone", "g")))], "page_no int, html string")
    body = "<h1>{}</h1><div class=c><p>No Name\n1 x</p><p></p></div>"
    pages = spark.createDataFrame([("https://e.org/d/1", body.format("A")), ("https://e.org/d/2", body.format("B")), ("https://e.org/d/3", body.format("B"))], "url string, html string")
    cand = archiving.discover_candidates(lp, RULE).orderBy("page_no", "pos").collect()
    assert [(c.title, c.detail_url) for c in cand] == [("two", "https://e.org/d/2"), ("one", "https://e.org/d/1"), ("three", "https://e.org/d/3"), ("g", "https://e.org/gone")]
    arch, records = archiving.archive_run(lp, pages, RULE)
    rows = arch.collect()
    # d/3 has the body of d/2, which comes first.
    assert sorted((r.meta.source_url, r.meta.title, r.meta.domain, r.meta.source_name) for r in rows) == [("https://e.org/d/1", "A", "e.org", "news"), ("https://e.org/d/2", "B", "e.org", "news")]
    assert [b.id for b in rows[0].blocks] == ["b1", "b2"]
    assert [(dict(r.data), r.raw_columns) for r in records.collect()] == [({"No": "1", "Name": "x"}, ["1", "x"])] * 2
    stored = arch.select(F.monotonically_increasing_id().alias("page_id"), "meta.content_hash", "meta.contains_ocr", F.lit(None).cast("string").alias("ocr_engine"))
    # Known pages are skipped before bodies are compared, so d/3, whose own hash
    # is not stored, is archived by the second run.
    second = archiving.archive_run(lp, pages, RULE, archived=stored)[0]
    assert [r.meta.source_url for r in second.collect()] == ["https://e.org/d/3"]
    for unit in ("r1", "r1", "r2"):
        writers.save_packages(arch, str(tmp_path / "pkg"), unit)
    assert writers.read_packages(spark, str(tmp_path / "pkg")).count() == 2
    for unit in ("r1", "r1", "r2"):
        archiving.save_run(arch, RULE, str(tmp_path / "db"), unit)
    db = writers.read_archive(spark, str(tmp_path / "db"))
    assert {n: t.count() for n, t in db.items()}.items() >= {"structured_records": 2, "archive_blocks": 4, "archive_pages": 2}.items()
    assert db["archive_pages"].select("id").distinct().count() == 2


def test_archive_takes_the_newest_capture(spark):
    lp = spark.createDataFrame([(1, list_html(("/d/1", "one")))], "page_no int, html string")
    body = "<h1>{}</h1><div class=c><p>No</p></div>"
    captures = [(1, "https://e.org/d/1", body.format("old")), (3, "https://e.org/d/1", body.format("new")), (2, "https://e.org/d/1", body.format("mid")), (4, None, body.format("none"))]
    pages = spark.createDataFrame(captures, "page_id long, url string, html string")
    assert [r.meta.title for r in archiving.archive_run(lp, pages, RULE)[0].collect()] == ["new"]


def test_package_without_hash_fails(spark):
    page = archive.build_pages(spark.createDataFrame([("https://e.org", "<p>")], "source_url string, html string"))
    broken = page.withColumn("meta", F.col("meta").withField("content_hash", F.lit("")))
    with pytest.raises(Exception, match="content_hash is missing"):
        writers.package_rows(broken).collect()


def test_health_report(spark):
    pages = spark.createDataFrame([("r1", list_html(("/1", "a"), ("/2", ""))), ("r2", "<p>")], "rule_path string, html string")
    base = reports.selector_report(pages, {}, ["rule_path"]).select("rule_path", F.col("dom_structure_hash").alias("dom_hash"))
    base = base.withColumn("dom_hash", F.when(F.col("rule_path") == "r2", "other").otherwise(F.col("dom_hash")))
    got = {r.rule_path: r for r in reports.health_report(pages, RULE, base, ["rule_path"]).collect()}
    a, b = got["r1"], got["r2"]
    assert (a.health_score, a.working_selectors, a.total_selectors, a.dom_drifted) == (1.0, 4, 4, False)
    assert (b.health_score, b.dom_drifted) == (0.0, True)
    assert [(s.selector_name, s.hits, s.sample) for s in a.selectors][1] == ("extract.title", 2, ["a"])


# --- streams ---------------------------------------------------------------


def _write(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r) for r in rows))


EVENTS = [
    {"type": "start", "rule": "1"}, {"type": "complete", "rule": "1", "new_count": 2}, {"type": "error", "rule": "1", "message": "m"}, {"type": "complete", "rule": "2", "new_count": 5}, {"type": "summary", "rule": "2"},
    {"type": "skip", "rule": "3"},
]


def _task_events(df):
    return df.withColumns({"task_id": F.col("rule").cast("long"), "seq": F.col("ts")})


def test_event_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [e | {"ts": i} for i, e in enumerate(EVENTS)]
    _write(src, "1.jsonl", rows[:4])
    _write(src, "2.jsonl", rows[4:])
    stream = events.running_totals(_task_events(events.event_stream(spark, src)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = runs.fold_events(_task_events(readers.event_lines(spark.read.text(src))))
    cols = ["task_id", "total_new", "total_skip", "total_error", "last_error", "final_status"]
    assert sorted(map(tuple, spark.table("totals").select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert {r.task_id: r.final_status for r in runs.close_tasks(want).collect()} == {1: "failed", 2: "success", 3: "success"}


def _folded(rows, idle, late):
    """Terminal states of (task, ts, seq, type, new) by a plain loop."""
    bound = max(r[1] for r in rows) - late
    out = []
    for task in sorted({r[0] for r in rows}):
        own = sorted(r[1:] for r in rows if r[0] == task and r[1] < bound)
        met = []
        for i, (ts, _, kind, new) in enumerate(own):
            met.append((kind, new))
            gap = (own[i + 1][0] if i + 1 < len(own) else bound) - ts > idle
            if kind == "summary" or gap:
                kinds = [k for k, _ in met]
                out.append((task, sum(n or 0 for k, n in met if k == "complete"), kinds.count("skip"), kinds.count("error"), "failed" if "error" in kinds else "success", kind != "summary"))
                break
    return out


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_terminal_states_do_not_depend_on_the_cut(spark, tmp_path, cuts):
    import random

    random.seed(17)
    kinds = ["start", "complete", "error", "skip", "skip", "summary", "progress"]
    rows = [(i % 9, 1_000_000 + random.randrange(4_000), i, random.choice(kinds), random.choice([None, 1, 5])) for i in range(200)]
    # Within a cut in any order, and up to 300 seconds behind what has come.
    rows.sort(key=lambda r: r[1] + random.randrange(300))
    src = str(tmp_path / "in")
    size = -(-len(rows) // cuts)
    for k in range(cuts):
        own = [dict(zip(("task_id", "ts", "seq", "type", "new_count"), r)) for r in rows[k * size : (k + 1) * size]]
        _write(src, f"{k}.jsonl", own)
        os.utime(os.path.join(src, f"{k}.jsonl"), (1_000 + k, 1_000 + k))
    stream = spark.readStream.schema("task_id long, ts long, seq long, type string, new_count long").option("maxFilesPerTrigger", 1).json(src)
    out = events.terminal_states(stream, idle_seconds=250, late_seconds=600, keep_seconds=1_000_000)
    q = out.writeStream.outputMode("append").format("memory").queryName(f"closed{cuts}").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted(tuple(r) for r in spark.table(f"closed{cuts}").collect())
    want = _folded(rows, 250, 600)
    assert got == want and {r[5] for r in want} == {True, False}


def test_persist_and_replay(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "log")
    _write(src, "1.jsonl", [e | {"ts": i} for i, e in enumerate(EVENTS)])
    events.persist_events(_task_events(events.event_stream(spark, src)), out, str(tmp_path / "ck")).awaitTermination(120)
    assert [r.type for r in events.replay_task(spark, out, 1).collect()] == ["start", "complete", "error"]


def test_dedup_stream_state_and_retry(spark, tmp_path):
    src, reg, out = (str(tmp_path / n) for n in ("in", "reg", "out"))
    schema = "platform string, raw_id string, url string"

    def go():
        stream = spark.readStream.schema(schema).json(src)
        batches.dedup_stream(stream, reg, out, str(tmp_path / "ck")).awaitTermination(120)

    _write(src, "1.jsonl", [{"platform": "p", "raw_id": i, "url": f"u{i}"} for i in ("1", "2", "2")])
    go()
    _write(src, "2.jsonl", [{"platform": "p", "raw_id": i, "url": f"v{i}"} for i in ("2", "3")] + [{"platform": "p", "url": "w"}])
    go()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u1", "u2", "u2", "v3", "w"]
    assert sorted(r.id for r in spark.read.parquet(reg).collect()) == ["p_1", "p_2", "p_3"]
    # A batch that is run again sees what it saw the first time.
    again = spark.createDataFrame([("p", "2", "v2"), ("p", "3", "v3")], schema)
    own = batches.stream_name(str(tmp_path / "ck"))
    assert sorted(r.url for r in batches.dedup_batch(again, 1, reg, own).collect()) == ["v3"]
    assert spark.read.parquet(reg).filter("id = 'p_3'").count() == 1


def test_seen_ids_are_state(spark, tmp_path):
    """What a batch reads does not grow with what is remembered, and another
    stream starts from the registry."""
    src, reg = str(tmp_path / "in"), str(tmp_path / "reg")
    schema = "platform string, raw_id string, url string"
    read, plan = [], ""
    for k in range(4):
        _write(src, f"{k}.jsonl", [{"platform": "p", "raw_id": str(i), "url": f"{k}"} for i in range(100 * k, 100 * k + 150)])
        os.utime(os.path.join(src, f"{k}.jsonl"), (1_000 + k, 1_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    q = batches.dedup_stream(stream, reg, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(240)
    plan = q._jsq.explainInternal(False)
    progress = [p for p in q.recentProgress if p["numInputRows"]]
    read = [p["numInputRows"] for p in progress]
    assert read == [150] * 4 and reg not in plan and "TransformWithState" in plan
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress] == [150, 250, 350, 450]
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(reg).count() == 450
    _write(src, "4.jsonl", [{"platform": "p", "raw_id": "new", "url": "n"}])
    later = spark.readStream.schema(schema).json(src)
    batches.dedup_stream(later, reg, str(tmp_path / "out2"), str(tmp_path / "ck2")).awaitTermination(240)
    assert [r.raw_id for r in spark.read.schema(schema).parquet(str(tmp_path / "out2")).collect()] == ["new"]
    assert spark.read.parquet(reg).count() == 451


def test_governed_stream(spark, tmp_path):
    src, reg, out = (str(tmp_path / n) for n in ("in", "reg", "out"))
    _write(src, "1.jsonl", [{"page_id": 1, "html": list_html(("/d/1", "a"), ("/d/1", "a"), ("/d/2", "b"))}])
    stream = spark.readStream.schema("page_id long, html string").json(src)
    batches.governed_stream(stream, RULE, reg, out, str(tmp_path / "ck")).awaitTermination(180)
    assert sorted(r.title for r in spark.read.parquet(f"{out}/items").collect()) == ["a", "b"]
    s = spark.read.parquet(f"{out}/summary").first()
    assert (s.total_collected, s.item_count, s.duplicate_count) == (3, 2, 1)


def test_first_titles_of_pages_that_share_a_url(spark):
    rule = {"archive": {"detail": {"title": {"selector": "h1"}, "metadata": {"content": {"selector": "article"}}}}, "source": {"platform": "p", "url": "https://e.org/"}}
    pages = spark.createDataFrame([(1, "https://e.org/a", "<article><p>x</p></article>"), (2, "https://e.org/a", "<article><p>y</p></article>")], "page_id int, url string, html string")
    titles = pages.selectExpr("page_id", "url", "concat('first ', page_id) AS title")
    found = archiving.archive_single(pages, rule, titles)[0].select("meta.title").collect()
    assert sorted(r.title for r in found) == ["first 1", "first 2"]
    assert [r.title for r in archiving.archive_single(pages, rule, titles.drop("page_id"))[0].select("meta.title").collect()] == ["first 1"] * 2


def test_records_by_address(spark):
    block = archive.make_block(id=F.lit("o"), block_type=F.lit("ocr"), ocr_text=F.lit("No Name\n1 x"))
    pages = spark.range(2).select(F.struct(F.col("id").cast("string").alias("content_hash"), F.lit("u").alias("source_url")).alias("meta"), F.array(block).alias("blocks"))
    rule = {"structuring": {"enabled": True, "strategies": [{"applies_to": {"keywords": ["No"]}, "record_type": "row"}]}}
    found = archiving.page_records(pages, rule, ("content_hash", "source_url")).collect()
    assert sorted((r.content_hash, r.source_url) for r in found) == [("0", "u"), ("1", "u")]


def test_mean_trust_at_a_tie(spark):
    """58 of 0.85 and 22 of 0.3: 0.69875, in whatever order they are added up."""
    for scores in ([0.85] * 58 + [0.3] * 22, [0.3] * 22 + [0.85] * 58, ([0.85, 0.3] * 22) + [0.85] * 36):
        rows = spark.createDataFrame([(s, "ACTIVE") for s in scores], "trust_score double, lifecycle_status string").coalesce(1)
        assert sources_registry.source_summary(rows).first().avg_trust_score == 0.6988


def test_new_pages_are_worked_out_once(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([("p", "h", "u")], "id string, content_hash string, source_url string")
    blocks = spark.createDataFrame([("b", "p"), ("x", "q")], "id string, page_id string")
    saved = {}
    monkeypatch.setattr(writers.commits, "commit", lambda tables, *_: saved.update(tables))
    writers.save_archive({"archive_pages": pages, "archive_blocks": blocks}, str(tmp_path), "a")
    assert [r.id for r in saved["archive_blocks"].collect()] == ["b"]
    assert "min_by" not in saved["archive_blocks"]._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_not_shuffled_by_rule(spark):
    from harvestry.operators.governance import Policy
    from harvestry.plans import collect

    items = spark.createDataFrame([("a", 1, "p", "1", "t"), ("b", 2, "p", "2", "u")], "run_id string, seq int, platform string, raw_id string, title string")
    rules = spark.createDataFrame([("a", True, None, None), ("b", False, None, None)], "run_id string, enabled boolean, source_enabled boolean, error string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        outcome, rows = collect.run_all(items, None, rules, Policy((), 0.8, "hash"), ["title"])
        plan = outcome.raw._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
        assert sorted((r.run_id, r.saved_count) for r in rows.collect()) == [("a", 1), ("b", 0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_packages_are_not_sorted(spark, tmp_path):
    from harvestry.sources import commits, writers

    root = str(tmp_path / "p")
    meta = "named_struct('subject', {0}, 'platform', 'p', 'content_hash', {1}, 'title', {2}) AS meta"
    rest = ["'c' AS content", "array('b') AS blocks", "array('a') AS assets", "array('o') AS ocr_results"]
    for unit, title, n in (("first", "'old'", 6), ("second", "'new'", 4)):
        # Every hash twice within a unit, over two subjects.
        rows = spark.range(2 * n).selectExpr(meta.format("CAST(id % 2 AS STRING)", "CAST(id DIV 2 AS STRING)", title), *rest)
        writers.save_packages(rows, root, unit)
    found = writers.read_packages(spark, root)
    assert sorted((r.content_hash, r.meta.title) for r in found.collect()) == [(str(i), "new" if i < 4 else "old") for i in range(6)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan, plan
    with commits._open_writers(spark, "json"):
        assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) > 1
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_seen_ids_call_python_by_bucket(spark, tmp_path, monkeypatch):
    """Ids share keys of the state: Python is not called once for each of them."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(src, "1.jsonl", [{"platform": "p", "raw_id": str(i % 400), "url": f"{i}"} for i in range(500)] + [{"platform": "p", "url": f"n{i}"} for i in range(20)] * 2)
    monkeypatch.setattr(batches, "_BUCKETS", 4)
    stream = spark.readStream.schema("platform string, raw_id string, url string").json(src)
    call = batches.SeenIds.handleInputRows
    folder = str(tmp_path / "calls")
    os.makedirs(folder)

    class Counted(batches.SeenIds):
        def handleInputRows(self, key, rows, timerValues):
            open(os.path.join(folder, str(key[0])), "a").write("x\n")
            yield from call(self, key, rows, timerValues)

    monkeypatch.setattr(batches, "SeenIds", Counted)
    batches.dedup_stream(stream, str(tmp_path / "reg"), out, str(tmp_path / "ck")).awaitTermination(120)
    grouped = [len(open(os.path.join(folder, f)).readlines()) for f in os.listdir(folder)]
    assert spark.read.parquet(out).count() == 540 and spark.read.parquet(str(tmp_path / "reg")).count() == 400
    assert grouped == [1] * 4
