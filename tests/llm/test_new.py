"""Collocations, the MinHash forest and whitening against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.llm import collocations, forest, whitening

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- collocations ----------------------------------------------------------


def plain_collocations(rows, longest, least, most, absorb):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {p: f for p, f in counts.items() if f >= least and len(p[1]) > 1}

    def covered(lang, p, a):
        return any(q[0] == lang and len(q[1]) > len(p) and 100 * f >= absorb * a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) for q, f in found.items())

    out = {}
    for (lang, p), a in found.items():
        if covered(lang, p, a):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, left, right, totals[lang], score))
    return sorted((lang, r + 1, x[2].decode(), *x[3:]) for lang, own in out.items() for r, x in enumerate(sorted(own)[:most]))


def collocation_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["A", "b", "c", "é", "new", "york", "city", "\x00", "x\x0b"]
    return [(" ".join(rng.choices(words, [9, 5, 3, 2, 2, 2, 2, 1, 1], k=rng.randrange(14))).replace("york city", "york city" + rng.choice(["", ".", "\t", ", "])), rng.choice(["en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("sent,absorb", [(10**6, 100), (0, 100), (0, 70)])
def test_collocations(spark, sent, absorb, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 400)
    monkeypatch.setattr(collocations, "CHUNK", 50)
    monkeypatch.setattr(collocations, "STRETCH", 30)
    rows = collocation_rows(3) + [("new york city hall " * 30, "en"), ("", "en"), (None, None), (" .,; ", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit("clash"))
    got = collocations.collocations(docs, 5, 6, 25, absorb, sent=sent).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 5, 6, 25, absorb) and got


def test_collocations_of_odd_tables(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []
    few = spark.createDataFrame([("one two", "en"), (None, None)], "text string, lang string")
    assert collocations.collocations(few).collect() == []
    # A word and a text of any length; all rows the same.
    long = "w" * 3_000_000
    rows = [(f"{long} tail", "en")] * 2 + [("a b " * 200_000, "en")]
    out = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), 3, 2, 5).collect()
    assert {(r.phrase if len(r.phrase) < 99 else "long tail", r.a) for r in out} == {("long tail", 2), ("a b a", 199_999), ("b a b", 199_999)} | {(r.phrase, r.a) for r in out if r.phrase == "a b"}


@pytest.mark.parametrize("dense", [1, 10**9])
def test_pairs_dense_and_sparse(dense):
    rng = np.random.default_rng(2)
    a, b = 50 + rng.zipf(1.4, 5000) % 90, 50 + rng.zipf(1.4, 5000) % 90
    x, y, n = collocations.count_pairs(a, b, tile=8, dense=dense)
    assert dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) == Counter(zip(a.tolist(), b.tolist())) and len(x) == len(set(zip(x.tolist(), y.tolist())))


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    row = spark.createDataFrame([(big, 3 * big, [big + 1, big], [big + 2, big])], "f long, n long, prefixes array<long>, suffixes array<long>")
    cut = row.select(collocations._best_cut(2).alias("c")).first().c
    assert cut.score == 1000 * big * 3 * big // ((big + 1) * (big + 2))


# --- MinHash forest ---------------------------------------------------------


def shingles(text, words=2):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1)))


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    last = 1 << 63
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, last), last if d is None else d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[root(i)] if sets[i] else (last if d is None else d)
        c = None if c == last else c
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def near_copies(seed, groups, size, words):
    """Texts at and just below the bound, of several lengths."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice(words))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 12)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 10_007, " ".join(own)))
    return rows


@pytest.mark.parametrize("words", [[5, 6, 8], [10, 20], [100, 200]])
def test_forest_against_all_pairs(spark, words):
    rows = near_copies(len(words) + words[0], 60, 6, words)
    out = forest.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_groups(rows)
    got = sorted((tuple(r) for r in out), key=repr)
    assert len(got) == len(want) and sum(a != b for a, b in zip(got, want)) <= len(want) // 200


def test_forest_of_one_large_group(spark):
    """Many near copies of one text over several partitions, all in one group."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1500):
        own = list(base)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(120)] = f"v{i}"
        rows.append((i + 1, " ".join(own)))
    out = forest.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in out.collect()} == {1}


def test_forest_of_odd_rows(spark):
    rows = [(5, "a b c"), (3, "A  b\tC"), (None, "a b c"), (7, ""), (8, None), (8, " \n"), (9, "one"), (2, "ONE"), (None, "only null"), (None, "only null"), (4, "x " * 20_000), (5, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "component_id": F.lit("clash")})
    assert sorted((tuple(r) for r in forest.near_groups(docs).collect()), key=repr) == plain_groups(rows)
    assert forest.near_groups(docs.filter("false")).collect() == []


def test_cuts_lose_no_neighbours(monkeypatch, spark):
    """All candidates whether the orders lie in one partition or many."""
    rng = np.random.default_rng(5)
    rows = [(0, int(rng.integers(0, 4)) << 56, 0, int(rng.integers(0, 1 << 40)), i, 10, i) for i in range(900)]
    leaves = spark.createDataFrame(rows, "tree int, hi long, lo long, tie long, node long, n long, root long")
    monkeypatch.setattr(forest, "AGREE", 1)
    one = {tuple(r) for r in forest._candidates(leaves, 900, 80).collect()}
    monkeypatch.setattr(forest, "ROWS", 60)
    many = {tuple(r) for r in forest._candidates(leaves, 900, 80).collect()}
    # A cut may make a crowded region look like a small one, never the other way.
    assert one <= many and len(many) < 1.1 * len(one) and len(one) > 900


def crowd_of_copies(seed, count, most, words=120):
    """A text, copies of it with up to so many words replaced, and doc_ids."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, count):
        own = list(base)
        for _ in range(rng.randrange(1, most)):
            own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        rows.append((i * 7 % 10_007, " ".join(own)))
    return rows


@pytest.mark.parametrize("rows_a_part, block", [(200_000, 1 << 20), (1_000, 1 << 14)])
def test_forest_of_a_crowd(monkeypatch, spark, rows_a_part, block):
    """Copies that are near to the first text alone are found among 800 others,
    and those a little further off are left apart."""
    monkeypatch.setattr(forest, "ROWS", rows_a_part)
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "TEXTS", block >> 9)
    rows = crowd_of_copies(8, 800, 12)
    out = forest.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in out), key=repr) == plain_groups(rows)


def test_links_of_a_crowd_against_all_pairs():
    """Groups joined by the links are those of all pairs, whichever texts ask."""
    rows = crowd_of_copies(9, 300, 12)
    sets = [np.unique(forest.shingle_hashes(t, 2)) for _, t in rows]
    n = np.array([len(s) for s in sets])
    marks = np.frombuffer(b"".join(forest.signature(s) for s in sets), np.uint8).reshape(-1, forest.POOL)
    node = np.arange(300)
    near = [(i, j) for i in node for j in node[:i] if 100 * len(both := np.intersect1d(sets[i], sets[j])) >= 80 * (n[i] + n[j] - len(both))]
    root = forest_roots(300, [p for p in near if max(p) < 40])
    root[40:] = node[40:]
    main = root == np.bincount(root).argmax()
    twice = np.concatenate([node, node[~main]])
    asking = np.arange(len(twice)) >= 300
    links = forest.crowd_links(asking, twice, root[twice], main[twice], marks[twice], n[twice], np.concatenate([sets[i] for i in twice]).view(np.int64), 80)
    groups = forest_roots(300, [(i, root[i]) for i in node] + [(twice[i], twice[j]) for i, j in links])
    assert (groups == forest_roots(300, near)).all() and len(links) == len(set(root)) - len(set(groups))


def forest_roots(count, links):
    top = np.arange(count)
    for i, j in links:
        top[top == max(top[i], top[j])] = min(top[i], top[j])
    return top


def test_ways_in_a_crowd_reach_all_that_agree():
    """Labels that agree in enough minima reach each other, of any group; labels
    of sizes too different, or that agree in fewer, do not by themselves."""
    rng = np.random.default_rng(6)
    kind = rng.integers(0, 3, 90)
    label = np.zeros((90, 16), np.uint8)
    label[:, 5:] = (kind[:, None] + 1) * 10 + np.arange(11)
    for own in label:
        own[5 + rng.choice(11, 2, replace=False)] = rng.integers(100, 256, 2)
    n = np.where(kind == 2, 300, 100)
    root = np.where(np.arange(90) < 20, np.flatnonzero(kind == 0)[0] + 1000, 1000 + np.arange(90))
    root[kind != 0] = 1000 + np.flatnonzero(kind != 0)
    a, b = forest.ways_in_crowd(label, n, root, 80)
    reached = forest_roots(90, list(zip(a - 1000, b - 1000, strict=True)))[root - 1000]
    assert all((reached[i] == reached[j]) == (kind[i] == kind[j]) for i in range(90) for j in range(90))
    assert len(a) == len(set(root)) - 3


# --- whitening --------------------------------------------------------------


def plain_whitening(vectors, components):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    c = (n * x - sums) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return c @ basis / np.sqrt(values), ((n * x - sums) ** 2).sum(1), values / np.trace(c.T @ c / n)


@pytest.mark.parametrize("rows,dim,block", [(700, 40, 10), (300, 12, None), (60, 5, None)])
def test_whitening(spark, rows, dim, block):
    rng = np.random.default_rng(rows)
    data = (rng.normal(size=(rows, dim)) @ np.diag(np.linspace(3, 0.5, dim)) + rng.normal(size=dim)).tolist()
    odd = [(10_000, None), (10_001, [float("nan")] * dim), (10_002, [None] * dim), (10_003, [1.0] * (dim - 1)), (10_004, []), (10_005, [float("inf")] + [0.0] * (dim - 1)), (10_006, [1e300] * dim)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)] + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).repartition(5)
    out = whitening.whiten(df, 8, block=block).toPandas().sort_values(["vec_id", "component"])
    k = min(8, dim)
    white, deviation, explained = plain_whitening(data, k)
    got = out.whitened.to_numpy().reshape(rows, k)
    assert np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-9
    assert out.deviation.to_numpy().reshape(rows, k)[:, 0].tolist() == deviation.tolist() and set(out.n) == {rows}
    assert np.abs(out.explained.to_numpy().reshape(rows, k)[0] / explained - 1).max() < 1e-9 and out.identity_error.max() < 1e-9


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).collect() == []  # no variance
    line = whitening.whiten(spark.createDataFrame([(None, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], kind)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in line) == [(0, 1), (2, 1), (2, 1)]  # rank one
    assert all(abs(r.explained - 1) < 1e-12 for r in line)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 5.0]), (3, [3.0, 4.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in huge} == {None}  # beyond 64 bits


def test_encoders_are_freed_where_files_are_read():
    from harvestry.llm import records

    records._ENCODERS["x"] = object()
    records._forget()
    assert not records._ENCODERS
