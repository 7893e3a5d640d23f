"""The operators of the llm subpackage against brute force on small tables."""

import hashlib
import random
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from harvestry.llm import bpe, licenses, mixing, quality, quotes, records, sharding, simhash, topk, urls
from harvestry.llm.common import word_count
from harvestry.llm.queries import QUERIES, RULES, SQL, vocabulary
from harvestry.session import scratch_folder
from tools.check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, Copies string"
LONG = " ".join(f"word{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeats, and columns
    with the names of results."""
    rows = [
        (1, "a b c d e f g h", "en", "s1", 15, "x", "y"),
        (1, "a b c d e f g h", "en", "s1", 15, "x", "y"),
        (1, "other text", "en", "s1", 10, None, None),
        (None, None, None, None, None, None, None),
        (None, "no id here", "fr", None, 10, None, None),
        (5, "", "en", "s2", 0, None, None),
        (6, " \n\t ", "en", "s2", 4, None, None),
        (7, LONG, "en", "s2", len(LONG), None, None),
        (8, "Ünïcödé ΑΣ İstanbul <|endoftext|> 's 12 中文", "de", "s3", 9, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twins(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    if name not in QUERIES:
        pytest.skip("not a query of this module")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def size(text="text"):
    return F.coalesce(F.octet_length(text), F.lit(0)) + 16


@pytest.mark.parametrize("shards,piece", [(3, 64 << 20), (40, 2000)])
def test_shards(spark, odd, shards, piece):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    out = sharding.shard_by_bytes(docs, F.col("doc_id"), size(), shards, piece_bytes=piece).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in docs.collect())
    rows = sorted(out, key=lambda r: (r.shard, r.slot))
    for s in range(shards):
        assert [r.slot for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    bytes_of = [len((r.text or "").encode()) + 16 for r in rows]
    cut, total, largest = Counter(), sum(bytes_of), max(bytes_of)
    for r, n in zip(rows, bytes_of):
        cut[r.shard] += n
    assert all(abs(cut[s] - total / shards) <= largest for s in range(shards))


def test_shards_of_nothing(empty, odd):
    assert sharding.shard_by_bytes(empty, F.col("doc_id"), size()).count() == 0
    out = sharding.shard_by_bytes(odd, F.col("doc_id"), size(), 4)
    assert out.count() == 9 and [c.lower() for c in out.columns].count("shard") == 1


def test_mix_meets_targets(spark, empty, odd):
    rows = [(i, "w " * (i % 7 + 1), None if i % 11 == 0 else "abc"[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, word_count(F.col("text"))).withColumn("size", word_count(F.col("text"))).collect()
    taken = Counter()
    for r in out:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    goal = {r.source: (r.target, r.source_size) for r in out}
    assert abs(sum(t for t, _ in goal.values()) - sum(s for _, s in goal.values())) < 1e-6
    for s, (t, whole) in goal.items():
        assert t <= 3 * whole and abs(taken[s] - t) <= 4
    assert mixing.mix(empty, word_count(F.col("text"))).count() == 0
    assert mixing.mix(odd, word_count(F.col("text"))).count() == 9


def test_mix_fills_in_rounds():
    """The level found in one go is that of resharing the excess in rounds."""
    random.seed(3)
    for _ in range(50):
        sizes = [random.choice([0, 1, 10, 1000, 50000]) for _ in range(6)]
        weight = [5, 2, 1] * 2
        total, goal, full = sum(sizes), [0.0] * 6, set()
        while True:
            rest = total - sum(3 * sizes[i] for i in full)
            w = sum(weight[i] for i in range(6) if i not in full)
            goal = [3.0 * sizes[i] if i in full else rest * weight[i] / w for i in range(6)] if w else [3.0 * s for s in sizes]
            over = {i for i in range(6) if goal[i] > 3 * sizes[i]}
            if not over:
                break
            full |= over
        assert abs(sum(goal) - total) < 1e-6


def test_bpe_equals_the_library(spark, odd, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    for r in bpe.encode(odd.select("doc_id", "text"), vocabulary(), decoded=True).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(odd, vocabulary()), vocabulary())
    assert again.count() == 9 and bpe.encode(empty, vocabulary(), decoded=True).count() == 0
    mine, theirs = bpe.Tokenizer(vocabulary()), records.LibraryEncoder(vocabulary())
    random.seed(5)
    letters = list("abcdeins'tréÀÉΣςİß0123456789²Ⅷ.,!?<>|_-́̀​ \x1c\x85\n\t中文😀🏽क्षि한") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "ﬁ", "Å"]
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 14)))
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert mine.encode_batch([text])[0] == want == theirs.encode_batch([text])[0], repr(text)


def test_records_round_trip(spark, odd, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    folder = scratch_folder(spark)
    records.write_records(odd, folder, vocabulary(), end_id=1, file_bytes=50_000)
    index = records.read_index(spark, folder).collect()
    read = {(r.file, r.record): r for r in records.read_records(spark, folder).collect()}
    assert len(index) == len(read) == 9
    start, seen = 0, []
    for p in sorted(index, key=lambda p: (p.file, p.record)):
        r = read[p.file, p.record]
        assert p.start == start and p.doc_id == r.doc_id and len(r.ids) == 4 * p.n_tokens
        start += p.n_tokens
        seen.append((r.doc_id, bytes(r.ids)))
    want = [(r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in odd.collect()]
    assert Counter(seen) == Counter(want)
    assert [d for d, _ in seen] == sorted((d for d, _ in seen), key=lambda d: -1 if d is None else d)
    some = records.read_index(spark, folder).filter("record % 2 = 0")
    assert {(r.file, r.record, bytes(r.ids)) for r in records.read_at(spark, folder, some).collect()} == {(k[0], k[1], bytes(v.ids)) for k, v in read.items() if k[1] % 2 == 0}
    none = scratch_folder(spark)
    records.write_records(empty, none, vocabulary())
    assert records.read_records(spark, none).count() == 0


def test_damaged_records_are_found():
    whole = records.framed(4, struct.pack("<3H", 5, 6, 7), 2) + b"\n"
    assert [(i, ids.tolist()) for _, _, i, ids in records.records(whole)] == [(4, [5, 6, 7])]
    for at in range(len(whole) - 1):
        with pytest.raises(ValueError):
            list(records.records(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]))
    with pytest.raises(ValueError):
        list(records.records(whole[:-2]))


def test_top_k_by_brute_force(spark):
    random.seed(7)
    rows = [(i, [random.choice([0.5, -0.25, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0]), (340, [1.0, float("nan"), 0.0, 0.0]), (None, [1.0] * 4), (20, [1.0] * 4)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5).collect()
    valid = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for q, v in valid:
        if q is not None and q % 20 == 0:
            scored = sorted((-int(v @ c), i is None, i or 0) for i, c in valid if i != q)
            want.update((q, n + 1, None if s[1] else s[2], -s[0]) for n, s in enumerate(scored[:5]))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert topk.top_k(few, F.col("vec_id") % 20 == 0).count() == 2
    assert topk.top_k(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quality_counters(spark, odd, empty):
    texts = ["one two three four five six seven eight nine\n" * 3, "# * x\n\n# * x\n", *[r.text for r in odd.collect()]]
    counted = quality._count(texts)
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert counted["n_words"][i] == len(words)
        assert counted["word_chars"][i] == sum(len(w.decode()) for w in words)
        assert counted["n_symbols"][i] == sum((text or "").count(c) for c in "#*$%&|<>")
        assert counted["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert counted["n_repeat_words"][i] == len(covered)
    judged = quality.judge(odd).collect()
    assert len(judged) == 9 and all(r.kept is not None for r in judged)
    assert quality.judge(empty).count() == 0


def test_quality_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shout = spark.createDataFrame([(10**6, "THE ER!! ORES,!! THTINT!! " * 3 + " ".join(f"QX{i}!!" for i in range(60)), "en", "s", 1)], docs.schema)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = {r.doc_id: r for r in quality.judge(docs.unionByName(shout)).collect()}
    assert not judged[10**6].kept and not judged[10**6].base_failed
    clean = [r for i, r in judged.items() if labels.get(i) == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.995 * len(clean)
    assert abs(quality.distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] - 1) < 1e-12


def test_quality_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    # Words that are common nowhere, in clean letters: short and long.
    soup = [(10**6 + n, " ".join(f"qu{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}" for i in range(n)), "en", "s", 1) for n in (60, 140, 160, 400)]
    judged = {r.doc_id: r for r in quality.judge(docs.unionByName(spark.createDataFrame(soup, docs.schema))).collect()}
    for i, *_ in soup:
        assert not judged[i].kept and not judged[i].base_failed and judged[i].class_distance <= 0.2
    bad = [r for i, r in judged.items() if labels.get(i) == 0 and not r.base_failed]
    assert len(bad) > 20 and sum(r.kept for r in bad) <= 0.1 * len(bad)
    clean = [r for i, r in judged.items() if labels.get(i) == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.995 * len(clean)


def test_threads(spark):
    mail = [
        (1, 0, "a", "Hello there.\nSecond line"),
        (1, 1, "b", "> hello  there.\nMy answer"),
        (1, 2, "a", ">> Hello there.\n> My answer\nThanks"),
        (1, 3, "b", "> nothing that was said\nNew"),
        (1, 4, "b", None),
        (2, 0, "a", "Hello there."),
        (2, 5000, "b", "> Hello there.\nLate"),
        (None, 3, "b", "> Hello there.\nx"),
        (3, None, "b", "y"),
        (1, 1, "b", "> hello  there.\nMy answer"),
    ]
    out = quotes.link(spark.createDataFrame(mail, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("old"))).collect()
    got = Counter((r.conv_id, r.turn, r.text, r.n_quoted, r.n_linked, r.parent_turn, r.thread_turn, r.depth) for r in out)
    assert got == Counter(
        [
            (1, 0, "Hello there.\nSecond line", 0, 0, None, 0, 0),
            (1, 1, "My answer", 1, 1, 0, 0, 1),
            (1, 1, "My answer", 1, 1, 0, 0, 1),
            (1, 2, "Thanks", 2, 2, 1, 0, 2),
            (1, 3, "New", 1, 0, None, 3, 0),
            (1, 4, "", 0, 0, None, 4, 0),
            (2, 0, "Hello there.", 0, 0, None, 0, 0),
            (2, 5000, "Late", 1, 1, 0, 0, 1),
            (None, 3, "x", 0, 0, None, 3, 0),
            (3, None, "y", 0, 0, None, None, 0),
        ]
    )
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_url_filter(spark):
    pages = [(1, "https://www.Bad.example.org/x/?b=2&a=1&utm_source=q#f"), (2, "http://bad.example.org/x?a=1&b=2"), (3, "http://a.example.net/en/1"), (4, "http://b.net/x"), (5, None), (6, "no scheme"), (7, "http://example.com/de/"), (8, "ftp://x.org/fr/1"), (8, "ftp://x.org/fr/1")]
    listed = spark.createDataFrame([("http://bad.example.org/x/?a=1&b=2",), (None,), ("nothing",)], "url string")
    for blocks in (1, 1 << 10):
        df = urls.judge(spark.createDataFrame(pages, "page_id long, url string").withColumn("HOST", F.lit(1)), listed, RULES, blocks)
        got = sorted((r.page_id, r.host, r.path, r.rule, r.listed, r.verdict) for r in df.collect())
        assert [g[5] for g in got] == ["block", "block", "allow", "block", "allow", "allow", "block", "allow", "allow"]
        assert got[2][3] == "example.net/en/" and got[0][1:3] == ("www.bad.example.org", "/x/") and got[5][1:3] == ("", "")
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, listed, RULES).count() == 0
    assert urls.judge(spark.createDataFrame(pages, "page_id long, url string"), none.select("url"), RULES).filter("listed").count() == 0


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, odd, empty):
    random.seed(11)
    text = [random.choice("abcdefgh") * 2 for _ in range(300)]
    rows = [(i, " ".join(text[:k] + ["zz"] + text[k + 1 :])) for i, k in enumerate(range(0, 300, 3))] + [(r.doc_id, r.text) for r in odd.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_classes(docs).collect()
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    while True:
        fresh = [min(group[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(rows))]
        if fresh == group:
            break
        group = fresh
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((rows[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(rows)))
    assert simhash.near_classes(empty).count() == 0


def test_close_pairs_by_brute_force(spark):
    random.seed(2)
    centre = random.getrandbits(64)
    prints = {centre ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) & (1 << 64) - 1 for _ in range(200)} | {0, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(0, p) for p in signed], "tree int, fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.close_pairs(df, 64, 2).collect()}
    mask = (1 << 64) - 1
    assert got == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_deduplicate(spark, odd, empty):
    random.seed(1)
    base = [f"{random.choice('abcdefghij')}{random.randrange(50)}" for _ in range(400)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (50, 120, 200)]
    half = " ".join(base[:200] + [f"n{i}" for i in range(200)])
    rows = [(9, near[0]), (4, near[1]), (6, near[2]), (4, near[1]), (5, " ".join(base).upper()), (1, half), (2, None), (None, ""), (3, "a b"), (None, "a b")]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(r.doc_id for r in got.collect()) == Counter([4, 1, 2, None, 3])
    assert simhash.deduplicate(empty).count() == 0
    assert simhash.deduplicate(odd).count() == 8 and simhash.deduplicate(odd).columns == odd.columns


def five_word_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def jaccard_groups(texts, similarity=0.8):
    """The smallest index of each text's group, of all pairs; None without a word."""
    sets = five_word_sets(texts)
    of = list(range(len(texts)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= similarity * len(a | sets[j]):
                low, high = sorted((top(i), top(j)))
                of[high] = low
    return [top(i) if sets[i] else None for i in range(len(texts))]


def variants(seed, groups, copies, changes):
    """Texts of 300 words in groups; each copy changes words of the one before
    it, so only neighbours in a chain are near-duplicates for sure."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(copies):
            out.append(" ".join(words))
            for at in rng.sample(range(300), changes):
                words[at] = f"c{rng.randrange(10**6)}"
    rng.shuffle(out)
    return out


def test_deduplicate_unlike_texts_in_one_leaf(spark):
    """Eight bits a tree: each leaf holds texts of several groups."""
    texts = variants(4, 120, 3, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.deduplicate(docs, trees=1, bits=16, budget=4).collect())
    prints = simhash.fingerprints(docs, "doc_id", words=5).collect()
    low = {r.doc_id: r.fps[0] & 0xFFFF for r in prints}
    sets, of = five_word_sets(texts), list(range(len(texts)))
    changed = True
    while changed:  # groups over the pairs that meet in the tree
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if of[i] != of[j] and (low[i] ^ low[j]).bit_count() <= 4 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    keep, gone = sorted((of[i], of[j]))
                    of = [keep if x == gone else x for x in of]
                    changed = True
    assert got == sorted(set(of))


def test_deduplicate_at_the_bound(spark):
    """Chains of texts of which neighbours are just above 0.8, far beyond 0.64."""
    texts = variants(8, 60, 4, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = jaccard_groups(texts)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == sorted(set(want))


@pytest.mark.parametrize("times", [5, 10])
def test_deduplicate_repeated_phrase(spark, times):
    """The repeats of a phrase are one set of shingles: a Jaccard of 0.9."""
    rows = []
    for g in range(20):
        words = [f"g{g}w{i}" for i in range(200)]
        phrase = [f"g{g}p{i}" for i in range(8)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words + phrase * times))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == list(range(0, 40, 2))


def test_licenses(spark, odd, empty):
    texts = {
        "Released under the MIT License. Under the mit license": (2, "mit", "mit", 1.0),
        "Releesed undr the MIT Licence, ok": (0, "", "mit", None),
        "This work is licensed under the GNU General Public License, version 3.": (0, "", "gpl-3", 1.0),
        "CC-BY-NC cc by nc": (2, "cc-by-nc", "cc-by-nc", 1.0),
        "a plain text about licenses": (0, "", "", 0.0),
        "É released undér the mit license": (0, "", "mit", None),
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("Score", F.lit("old"))
    for r in licenses.scan(docs).collect():
        n, base, labels, score = list(texts.values())[r.doc_id]
        assert (r.n_base, r.base_labels, r.labels) == (n, base, labels), r
        assert r.score == score if score is not None else 0.8 < r.score < 1
        text = list(texts)[r.doc_id]
        assert all(text[s.start : s.end].lower()[:3] in ("rel", "thi") for s in r.spans)
    assert licenses.scan(odd).count() == 9 and licenses.scan(empty).count() == 0
    for r in licenses.scan(odd.select("doc_id", "text")).collect():
        assert (r.n_words == 0) == (r.doc_id in (5, 6) or r.doc_id is None and r.n_words == 0)


def test_neighbouring_notices_are_all_found():
    bad, good = "relesed undr the mit license", "released under the mit license"
    for notices in ([bad, good], [good, bad], [bad, good, bad, good, bad], [bad, bad], [good] * 30):
        text = "Foo " + " and foo ".join(notices) + " bar"
        at, want = 0, []
        for n in notices:
            at = text.index(n, at)
            want.append((at, at + len(n), 0 if n == good else 2))
            at += len(n)
        assert [(s["start"], s["end"], s["edits"]) for s in licenses.scan_text(text)[-1]] == want


def test_digests_of_queries(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    start = 0
    written = {r.doc_id: r for r in QUERIES["op4_token_records"](spark, FOLDER).collect()}
    for r in sorted(QUERIES["op3_trie_bpe"](spark, FOLDER).collect(), key=lambda r: r.doc_id):
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        w = written[r.doc_id]
        assert (w.start, w.n_tokens, w.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        start += len(ids) + 1


def test_pipeline(spark, odd, empty):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, empty.select(*docs.columns)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, FOLDER).count() >= 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def verdicts(texts, langs):
    """Which texts the quality rules keep, from their counts one by one."""
    made = quality._count(texts)
    passes = [n >= 20 and 100 * r <= 30 * n for n, r in zip(made["n_words"], made["n_repeat_words"])]
    classes, words = [list(c[quality._COMPARED]) for c in made["classes"]], [list(w) for w in made["words"]]
    refs = {}
    for lang in set(langs) & set(quality.COMMON_WORDS):
        own = [i for i in range(len(texts)) if passes[i] and langs[i] == lang]
        refs[lang] = [[sum(x) for x in zip(*(h[i] for i in own))] for h in (classes, words)]

    def apart(p, q):
        p, q = [x / max(sum(p), 1) for x in p], [x / max(sum(q), 1) for x in q]
        part = lambda a, b: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
        return max(0.0, (part(p, q) + part(q, p)) / 2) ** 0.5

    chance = {k: quality.chance_distance(np.array(r[1], float)) for k, r in refs.items()}
    kept = []
    for i, n in enumerate(made["n_words"]):
        far = min(apart(classes[i], r[0]) for r in refs.values()) if passes[i] and made["word_chars"][i] >= 200 else 0
        beyond = min(apart(words[i], r[1]) - np.interp(np.log(n), np.log(quality._LENGTHS), chance[k]) for k, r in refs.items()) if passes[i] else 0
        kept.append(passes[i] and far <= 0.2 and beyond <= 0.1)
    return kept


def test_pipeline_by_brute_force(spark, tmp_path):
    """The rows of every stage and of the whole run, from plain Python; the mix
    from the SQL of its query."""
    duckdb, tokenizers = pytest.importorskip("duckdb"), pytest.importorskip("tokenizers")
    import corpus_pipeline

    rng = random.Random(6)
    read = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in read.orderBy("doc_id").limit(250).collect()]
    for i, r in enumerate([r for r in rows if 100 < len((r[1] or "").split()) < 1000][:40]):
        words = r[1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((10**6 + i, " ".join(words + words[:5] * (i % 3)), *r[2:]))
    rows += [(10**7, None, "en", "s", None), (10**7 + 1, "", None, None, 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, read.schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, rules), (_, dedup), (_, mix), (_, encode) = corpus_pipeline.STAGES

    judged = [r for r, k in zip(rows, verdicts([r[1] for r in rows], [r[2] for r in rows])) if k]
    one = rules(spark, docs, folder)
    assert 100 < len(judged) < len(rows) and Counter(tuple(r) for r in one.collect()) == Counter(judged)
    judged.sort()
    single = [judged[i] for i in sorted(set(jaccard_groups([r[1] for r in judged])))]
    two = dedup(spark, spark.createDataFrame(judged, read.schema), folder)
    assert len(single) < len(judged) - 10 and Counter(tuple(r) for r in two.collect()) == Counter(single)

    path = f"{folder}/single"
    spark.createDataFrame(single, read.schema).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    cur = con.execute(SQL["op2_source_mix"])
    names = [c[0] for c in cur.description]
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in (dict(zip(names, x)) for x in cur.fetchall())}
    mixed = Counter({r: copies[r[0]] for r in single if copies[r[0]]})
    assert Counter(tuple(r) for r in mix(spark, spark.read.parquet(path), folder).collect()) == mixed

    library = tokenizers.Tokenizer.from_file(vocabulary())
    want = Counter()
    for r, n in mixed.items():
        ids = library.encode(r[1], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r[0], r[3], len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(decoded.encode()).hexdigest()] += n
    seen = lambda df: Counter((r.doc_id, r.source, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in df.collect())
    assert seen(encode(spark, spark.createDataFrame(list(mixed.elements()), read.schema), folder)) == want
    assert seen(corpus_pipeline.run(spark, folder)) == want


@pytest.mark.parametrize("largest", [1.0, 3e6, 5e9, 4e13])
def test_top_k_of_large_components(spark, largest):
    """Scores are exact whole numbers, beyond 64 bits as well."""
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 1]) * largest * rng.random() for _ in range(4)]) for i in range(60)] + [(100, [largest, 0.0, 0.0, 0.0]), (101, [1e300, 0.0, 0.0, 0.0])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5)
    whole = {i: [int(np.floor(64 * x)) for x in e] for i, e in rows if i != 101}
    want = []
    for q in sorted(i for i in whole if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:5]
        want += [(q, r + 1, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, c) in enumerate(best)]
    assert [tuple(r) for r in out.orderBy("query_id", "rank").collect()] == want


def test_long_word_in_little_memory():
    import tracemalloc

    import tokenizers

    library = tokenizers.Tokenizer.from_file(vocabulary())
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefghinoprst") for _ in range(200_000))
    coder = bpe.Tokenizer(vocabulary())
    tracemalloc.start()
    got = coder.encode_batch([word, "a " + word[:300] + " b"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and not coder.known.young.keys() - {"a", "b"}
    assert np.frombuffer(got[0], "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def _plain_edits(notice, words):
    """For each end in words the fewest edits of the notice that ends there."""
    row = list(range(len(notice) + 1))
    best = []
    for c in words:
        above = row
        row = [0]
        for i, n in enumerate(notice):
            row.append(min(above[i] + (n != c), above[i + 1] + 1, row[i] + 1))
        best.append(row[-1])
    return best


def test_notices_against_edit_distance():
    rng = random.Random(9)
    notices = list(licenses.NOTICES)
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            own = list(rng.choice(notices))
            for _ in range(rng.randrange(9)):
                i = rng.randrange(len(own))
                own[i : i + 1] = rng.choice(["", "x", "q" + own[i]])
            parts.append("".join(own))
        text = " some words between ".join(parts)
        words = " ".join(text.split())
        labels = set()
        best = 0.0
        for n, label in licenses.NOTICES.items():
            edits = min(_plain_edits(n, words))
            if edits <= licenses.budget(n):
                labels.add(label)
                best = max(best, 1 - edits / len(n))
        got = licenses.scan_text(text)
        assert set(filter(None, got[5].split(","))) == labels | set(filter(None, got[4].split(",")))
        assert got[6] == (1.0 if got[1] else pytest.approx(best))


def test_repeated_notices_in_linear_time():
    import time

    for text in ("released under the mit license ", "relesed undr the mit licence foo "):
        started = time.time()
        found = licenses.scan_text(text * 20_000)
        assert len(found[7]) == 20_000 and time.time() - started < 5


@pytest.mark.parametrize("coder", [bpe.Tokenizer, records.LibraryEncoder])
def test_encoders_on_odd_texts(coder):
    """Marks, capitals, added tokens and characters that change when normalised."""
    import tokenizers

    library = tokenizers.Tokenizer.from_file(vocabulary())
    own, rng = coder(vocabulary()), random.Random(3)
    letters = "aAbÉé.,;:!?'\"() \t\n\x0b\x1c\x85\u00a0\u3000ΣσςİiÍ\u0301\u0307\u0958中文١2<|>s "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts = [t + rng.choice(["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>."]) + "A." if rng.random() < 0.1 else t for t in texts]
    for k in range(0, len(texts), 7):
        got = own.encode_batch(texts[k : k + 7])
        for text, ids in zip(texts[k : k + 7], got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_mix_splits_equal_rows(spark):
    """A third of a table and more in rows that are all the same."""
    rows = [(7, "w " * 20, "a")] * 400 + [(i, "w " * (i % 5 + 1), "b") for i in range(900)] + [(None, "v " * 9, None)] * 300 + [(8, "", "c")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__part", F.lit("clash")).repartition(6)
    out = mixing.mix(docs, word_count(F.col("text"))).withColumn("size", word_count(F.col("text"))).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "source", "__part", "source_size", "target", "copies", "size"}
    taken, goal = Counter(), {}
    for r in out:
        taken[r.source] += r.copies * r.size
        goal[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert all(abs(taken[s] - goal[s]) <= 10 for s in goal) and len({r.copies for r in out if r.source == "a"}) == 2


def test_meetings_by_brute_force(spark):
    """Near leaves of texts in groups, with sketches of either sign."""
    rng = random.Random(8)
    most, texts = 20, []
    for node in range(-150, 150):
        base = rng.choice((0, 0xABCDEF, 0x00F00F, 0x555555))
        fp = base ^ sum(1 << rng.randrange(24) for _ in range(rng.randrange(3)))
        texts.append((0, fp, node, node - node % rng.choice((1, 1, 5)), rng.choice((0, -1)) ^ rng.getrandbits(8)))
    leaves = spark.createDataFrame(texts, "tree int, fp long, node long, root long, sketch long")
    near = set()
    for x, y in combinations(texts, 2):
        if x[3] != y[3] and (x[1] ^ y[1]).bit_count() <= 1 and ((x[4] ^ y[4]) & (1 << 64) - 1).bit_count() <= most:
            near.add((x[2], y[2], x[3], y[3], x[1], y[1]))
    assert Counter((r.a, r.b) for r in simhash._meetings(leaves, 24, 1, most, every=True).collect()) == Counter(n[:2] for n in near)
    got = simhash._meetings(leaves, 24, 1, most).collect()
    assert {frozenset((r.a_root, r.b_root)) for r in got} == {frozenset(n[2:4]) for n in near}
    assert len(got) == len({frozenset(((n[2], n[4]), (n[3], n[5]))) for n in near})


def test_deduplicate_moves_few_texts(spark):
    """What the step shuffles is a small multiple of its texts, which stay
    where they are unless they have a near-duplicate."""
    texts = variants(1, 300, 1, 0) + variants(2, 10, 3, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s := stages.apply(i)).stageId(): s.shuffleWriteBytes() for i in range(stages.size())}

    before = shuffled()
    assert simhash.deduplicate(docs).count() == 310
    assert sum(n for k, n in shuffled().items() if k not in before) < 2.5 * sum(map(len, texts))


def test_deduplicate_crowd_in_linear_rows(spark, monkeypatch):
    """Near copies of each other that are no near-duplicates, some of them with
    one: rows for each text, not for each pair of them, and right groups."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(620):
        words = list(base)
        for at in rng.sample(range(150), 3):
            words[at] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(words))
        if i % 20 == 0:
            texts.append(" ".join(words + ["tail"]))
    meetings, made = simhash._meetings, []

    def counted(*args, **more):
        out = simhash.written(meetings(*args, **more))
        made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "_meetings", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.deduplicate(docs).collect())
    assert got == sorted(set(jaccard_groups(texts)))
    assert sum(made) < 100 * len(texts)


def test_meetings_of_crowds_reach_all(spark):
    """Over sparse and dense pairs and groups a text reaches as many as over all pairs."""
    rng = random.Random(9)
    texts = []
    for node in range(400):
        base = rng.choice((0, 0xABCDEF, 0x00F00F, 0x555555, rng.getrandbits(24)))
        fp = base ^ sum(1 << rng.randrange(24) for _ in range(rng.randrange(4)))
        texts.append((0, fp, node, node - node % rng.choice((1, 1, 5)), rng.getrandbits(8)))
    leaves = spark.createDataFrame(texts, "tree int, fp long, node long, root long, sketch long")

    def reached(pairs):
        of = {t[2]: t[2] for t in texts}
        for a, b in [*pairs, *[(t[2], t[3]) for t in texts]]:
            low, high = sorted((of[a], of[b]))
            of = {k: low if v == high else v for k, v in of.items()}
        return of

    for every in (False, True):
        whole = [(r.a, r.b) for r in simhash._meetings(leaves, 24, 1, 20, every).collect()]
        some = simhash._meetings(leaves, 24, 1, 20, every, crowded=2).collect()
        assert any(r.dense for r in some) and not all(r.dense for r in some) and len(some) < len(whole)
        assert {(r.a, r.b) for r in some if not r.dense} <= set(whole)
        assert reached([(r.a, r.b) for r in some]) == reached(whole)


@pytest.mark.parametrize("sides", [1, 2])
def test_alike_by_brute_force(sides):
    rng = random.Random(sides)
    sets = []
    for _ in range(150):
        start = rng.randrange(0, 120, 2)
        sets.append(sorted({start + k for k in range(rng.choice((9, 10, 11)))} | {1000 + rng.randrange(40)}))
    root = np.array([i - i % rng.choice((1, 1, 4)) for i in range(150)])
    side = np.array([rng.randrange(2) for _ in sets]) if sides == 2 else np.arange(150)
    sizes, flat = np.array([len(x) for x in sets]), np.concatenate([np.array(x) for x in sets])
    links = simhash._alike(root, side, np.zeros((150, 2), np.int64), sizes, flat, 0.0, 0.8)
    want = [(i, j) for i, j in combinations(range(150), 2) if side[i] != side[j] and root[i] != root[j] and len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})]

    def groups(pairs):
        of = root.copy()
        for i, j in pairs:
            of[of == of[j]] = of[i]
        return {frozenset(np.flatnonzero(of == v).tolist()) for v in of}

    assert want and groups(links) == groups(want) and {tuple(sorted(x)) for x in links} <= set(want)
    assert len(links) == len(set(root.tolist())) - len(groups(links))
