"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared
with references of four languages by Jensen-Shannon distance. The references
are sums over all documents that name the language and pass the plain rules.
The fewer words a document has, the further chance alone takes it from its
reference; words are therefore judged by what goes beyond that distance.
Documents too short for a class histogram are not judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, slices, without, written

# Frequent words of each language, from general knowledge.
COMMON_WORDS = {
    "en": "the of and to a in is that for it was on with be as by this are at from",
    "de": "der die und in den von zu das sich mit auf des für ist nicht im dem ein eine als",
    "es": "de la que el en y los se del las por un no con su una es para al lo",
    "fr": "de la le et les des en un du une que pour est qui dans par pas au sur avec",
}
#: All common words in a fixed order; the last bin of a histogram is any other word.
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
_SLOT = {w.encode(): i for i, w in enumerate(VOCABULARY)}
CLASSES = ["lower case", "upper case", "digit", "sentence mark", "symbol", "other ASCII", "other letter"]
#: How many digits a clean text holds depends on its matter: not compared.
_COMPARED = [i for i, name in enumerate(CLASSES) if name != "digit"]
_SPACE, _INNER = len(CLASSES), len(CLASSES) + 1
_COUNTERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _class_table() -> np.ndarray:
    """The class of each byte of UTF-8; inner bytes of a character have none."""
    out = np.full(256, CLASSES.index("other ASCII"), np.uint8)
    for name, letters in (("lower case", range(97, 123)), ("upper case", range(65, 91)), ("digit", range(48, 58)), ("sentence mark", b".,;:?!'\"-()"), ("symbol", b"#*$%&|<>@^~=+_/\\{}[]`")):
        out[list(letters)] = CLASSES.index(name)
    out[list(b" \t\n\v\f\r")] = _SPACE
    out[0x80:0xC0] = _INNER
    out[0xC0:] = CLASSES.index("other letter")
    return out


_TABLE = _class_table()
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_MARKS = b".,;:?!'\"-()#*$%&|<>@^~=+_/\\{}[]`"


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of a run of values for each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[np.concatenate([[0], ends])])


def _repeats(words: np.ndarray, ends: np.ndarray, size: int = 8) -> np.ndarray:
    """For each text the words in windows of 8 words that it holds twice or
    more. Windows are told apart exactly: pairs of numbers of halves get
    numbers of their own."""
    n = len(words)
    code, span = words.astype(np.int64), 1
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    while span < size:
        m = max(0, n - 2 * span + 1)
        code = pd.factorize(code[:m] * (n + 1) + code[span : span + m])[0]
        span *= 2
    covered = np.zeros(n + 1, np.int64)
    whole = np.flatnonzero(text[: len(code)] == text[size - 1 : size - 1 + len(code)])
    if len(whole):
        own = pd.factorize(text[whole].astype(np.int64) * (n + 1) + code[whole])[0]
        found = whole[np.bincount(own)[own] > 1]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + size, -1)
    return _per_text(np.cumsum(covered)[:n] > 0, ends)


def _count(texts: list[str | None]) -> dict[str, np.ndarray | list]:
    """Counters and both histograms of a batch of whole texts."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    split = [t.split() for t in raw]  # of bytes: at ASCII white space alone
    n_words = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(n_words)
    flat = np.empty(int(n_words.sum()), object)
    flat[:] = [w for words in split for w in words]
    codes, names = pd.factorize(flat)
    slots = np.array([_SLOT.get(w.strip(_MARKS).lower(), len(VOCABULARY)) for w in names] or [0], np.int64)
    width = len(VOCABULARY) + 1
    text = np.repeat(np.arange(len(raw)), n_words)
    words = np.bincount(text * width + slots[codes], minlength=len(raw) * width).reshape(-1, width) if len(raw) else np.zeros((0, width), np.int64)

    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(t) for t in raw], np.int64)
    kinds = _TABLE[data]
    many = _INNER + 1
    classes = np.bincount(np.repeat(np.arange(len(raw)), sizes) * many + kinds, minlength=len(raw) * many).reshape(-1, many)[:, : len(CLASSES)]
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in raw]
    return {
        "n_words": n_words,
        "word_chars": classes.sum(1),
        "n_symbols": _per_text(_SYMBOL[data], np.cumsum(sizes)),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": _repeats(codes, ends),
        "classes": list(classes),
        "words": list(words),
    }


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """docs with the counters and histograms in place of the text."""
    rest = [c for c in docs.columns if c != text]
    ordered = docs.select(*[column(c) for c in [text, *rest]])
    schema = T.StructType([*[ordered.schema[c] for c in rest], *[T.StructField(c, T.LongType()) for c in _COUNTERS], T.StructField("classes", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.LongType()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, 4 << 20):
            made = _count(b.column(0).to_pylist())
            arrays = [pa.array(v, pa.int64() if k in _COUNTERS else pa.list_(pa.int64())) for k, v in made.items()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *arrays], [*rest, *made])

    return ordered.mapInArrow(step, schema)


def base_failed() -> Column:
    """Under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def references(counted: DataFrame, lang: str) -> dict[str, tuple[list[int], list[int]]]:
    """Class and word sums of each language over all its documents that pass
    the plain rules; four rows at most come to the driver."""
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in (("classes", len(CLASSES)), ("words", len(VOCABULARY) + 1)) for i in range(n)]
    rows = counted.filter(column(lang).isin(list(COMMON_WORDS)) & ~base_failed()).groupBy(column(lang).alias("__lang")).agg(*sums).collect()
    return {r["__lang"]: ([r[f"classes{i}"] for i in range(len(CLASSES))], [r[f"words{i}"] for i in range(len(VOCABULARY) + 1)]) for r in rows}


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (0 to 1) of each row of counts p to counts q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


#: Lengths in words for which the chance distance is drawn.
_LENGTHS = np.unique(np.round(20 * 2 ** (np.arange(25) / 2)).astype(int))


def chance_distance(reference: np.ndarray) -> np.ndarray:
    """Mean distance to the reference of 200 samples of each of _LENGTHS words
    that are drawn from it; the seed is fixed, so it is the same every time."""
    rng = np.random.default_rng(42)
    share = reference / max(reference.sum(), 1)
    return np.array([distance(rng.multinomial(n, share, 200).astype(float), reference).mean() for n in _LENGTHS])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", max_class: float = 0.2, word_margin: float = 0.1, min_chars: int = 200, min_words: int = 20) -> DataFrame:
    """Every row of docs, without its text, with the counters n_words,
    word_chars, n_symbols, n_dup_lines and n_repeat_words, ``base_failed``,
    ``class_distance``, ``word_distance`` and ``kept``.

    The distances are to the nearest language reference. A document is kept if
    it passes the plain rules, lies within max_class, and its words lie at most
    word_margin further from some reference than a sample of as many words of
    that reference does on average. The class histogram counts from min_chars
    characters, the word histogram from min_words words, and below that the
    distance is null and judges nothing.
    Null and empty texts have no words and fail the plain rules. Null and
    unknown languages are judged like others but add to no reference; without
    any reference the distances are null. Repeated rows give repeated results;
    an empty table an empty one. Input columns with the names of results are
    replaced. The texts are read once, whole; what is written to the shared
    folder are some 90 small counts for each document.
    """
    results = [*_COUNTERS, "classes", "words", "base_failed", "class_distance", "word_distance", "kept"]
    own = without(docs, results)
    counted = written(_counted(own, text))
    found = references(counted, lang)
    class_refs = [np.array(c, float)[_COMPARED] for c, _ in found.values()]
    word_refs = [np.array(w, float) for _, w in found.values()]

    chance = [chance_distance(r) for r in word_refs]

    def nearest_class(counts: pd.Series) -> pd.Series:
        rows = np.array(counts.tolist(), float).reshape(len(counts), -1)[:, _COMPARED]
        return pd.Series(reduce(np.minimum, [distance(rows, r) for r in class_refs]))

    def nearest_words(counts: pd.Series) -> pd.DataFrame:
        rows = np.array(counts.tolist(), float).reshape(len(counts), -1)
        length = np.log(np.maximum(rows.sum(1), 1))
        far = [distance(rows, r) for r in word_refs]
        beyond = [d - np.interp(length, np.log(_LENGTHS), c) for d, c in zip(far, chance, strict=True)]
        return pd.DataFrame({"distance": reduce(np.minimum, far), "beyond": reduce(np.minimum, beyond)})

    double = T.DoubleType()
    both = T.StructType([T.StructField("distance", double), T.StructField("beyond", double)])
    none = F.lit(None)
    class_distance = F.when(F.col("word_chars") >= min_chars, F.pandas_udf(nearest_class, double)("classes")) if found else none.cast(double)
    of_words = F.when(F.col("n_words") >= min_words, F.pandas_udf(nearest_words, both)("words")) if found else none.cast(both)
    judged = counted.withColumns({"class_distance": class_distance, "__words": of_words, "base_failed": base_failed()})
    judged = judged.withColumn("word_distance", F.col("__words.distance"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("__words.beyond", F.lit(0.0)) <= word_margin)
    return judged.withColumn("kept", ~F.col("base_failed") & near).drop("classes", "words", "__words")
