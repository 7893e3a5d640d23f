"""License scan: exact phrases, and fuzzy search of short notices.

A notice that occurs with at most e edits leaves one of any e + 1 pieces of it
untouched. So every piece is searched as it stands, a hit names the stretch of
text in which the notice would lie, and the regex library's bounded-error
matching decides there and counts the edits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, without

# Phrases that are told by their words alone, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices that are searched with errors, from the public texts.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
}
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z, and everything that is in no word to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("notice", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]))),
    ]
)
_ARROW = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))]


def budget(notice: str) -> int:
    """Edits that a notice may have: one for every ten characters."""
    return len(notice) // 10


@lru_cache(maxsize=1)
def _seeds() -> dict[bytes, list[tuple[str, int]]]:
    """The pieces of all notices: (notice, offset of the piece in it)."""
    out: dict[bytes, list[tuple[str, int]]] = {}
    for notice in NOTICES:
        for a, piece in _pieces(notice):
            out.setdefault(piece.encode(), []).append((notice, a))
    return out


@lru_cache(maxsize=None)
def _pieces(notice: str) -> list[tuple[int, str]]:
    parts = budget(notice) + 1
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=None)
def _pattern(notice: str) -> regex.Pattern:
    return regex.compile(f"(?:{regex.escape(notice)}){{e<={budget(notice)}}}", regex.BESTMATCH)


def _places(text: bytes, piece: bytes) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def _matches(notice: str, window: str) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the best match in a window and of those in what
    lies before and behind it."""
    found, open_ = [], [(0, len(window))]
    while open_:
        a, b = open_.pop()
        # Without an untouched piece there is no match.
        if b - a < len(notice) - budget(notice) or not any(window.find(piece, a, b) >= 0 for _, piece in _pieces(notice)):
            continue
        m = _pattern(notice).search(window, a, b)
        if m:
            found.append((*m.span(), sum(m.fuzzy_counts)))
            open_ += [(a, m.start()), (m.end(), b)]
    return found


def _apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of finds that overlap the one with the fewest edits, then the first."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for start, end, edits in sorted(found, key=lambda f: (f[2], f[0], f[1])):
        at = bisect_left(starts, start)
        if (at == 0 or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= end):
            starts.insert(at, start)
            ends.insert(at, end)
            kept.append((start, end, edits))
    return kept


def fuzzy(words: bytes) -> list[tuple[str, int, int, int]]:
    """(notice, start, end, edits) of every notice in words with a space
    between, in characters; of overlapping finds of a notice the best.

    Each place where a notice may begin is searched once, in a window that
    holds it whole with any edits, so time grows with the number of places."""
    hits: dict[str, set[int]] = {}
    for seed, owners in _seeds().items():
        for at in _places(words, seed):
            for notice, offset in owners:
                hits.setdefault(notice, set()).add(at - offset)
    if not hits:
        return []
    # Characters that begin before a byte.
    begins = None if words.isascii() else np.flatnonzero((np.frombuffer(words, np.uint8) & 0xC0) != 0x80)
    found = []
    for notice, places in hits.items():
        most, exact = budget(notice), notice.encode()
        met: set[tuple[int, int, int]] = set()
        known: dict[str, list[tuple[int, int, int]]] = {}
        for s in places:
            # Bytes of a window: a character that an edit puts in has four at most.
            whole = s >= 0 and words.startswith(exact, s)
            a, b = (s, s + len(exact)) if whole else (max(0, s - 4 * most), s + len(exact) + 4 * most)
            while a < len(words) and words[a] & 0xC0 == 0x80:
                a += 1
            base = a if begins is None else int(np.searchsorted(begins, a))
            if whole:
                met.add((base, base + len(notice), 0))
                continue
            window = words[a:b].decode(errors="ignore")
            if window not in known:
                if len(known) >= 4096:
                    known.clear()
                known[window] = _matches(notice, window)
            met.update((base + start, base + end, edits) for start, end, edits in known[window])
        found += [(notice, *f) for f in _apart(met)]
    return found


def scan_text(text: str | None) -> tuple:
    """The result columns of one text."""
    split = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    words = b" ".join(split)
    hay = b" " + words + b" "
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        for p in _places(hay, b" " + phrase.encode() + b" "):
            starts.append(p)
            base.add(label)
    at = np.searchsorted(np.flatnonzero(np.frombuffer(hay, np.uint8) == 32), starts).tolist() if starts else []
    found = fuzzy(words)
    spans = []
    if found:
        # From characters of the joined words to characters of the text: the
        # table keeps the length of every character in bytes, so words match.
        places = [m.span() for m in _WORD.finditer((text or "").translate(_LOWER))]
        ends, total = [], -1
        for w in split:
            total += len(w.decode()) + 1
            ends.append(total)
        for notice, start, end, edits in sorted(found, key=lambda f: (f[1], f[0])):
            first, last = _at(ends, start), _at(ends, max(start, end - 1))
            spans.append({"label": NOTICES[notice], "notice": notice, "start": places[first][0], "end": places[last][1], "edits": edits})
    best = max([1 - f[3] / len(f[0]) for f in found] + [float(bool(at))])
    labels = sorted(base | {s["label"] for s in spans})
    return len(split), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(labels), best, spans


_LOWER = {i: i + 32 for i in range(65, 91)}


def _at(ends: list[int], character: int) -> int:
    """The word in which a character of the joined words lies."""
    return min(bisect_left(ends, character + 1), len(ends) - 1)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of docs, without its text, with n_words; n_base, first_word,
    last_word and base_labels of the exact phrases; ``labels`` of phrases and
    fuzzy notices; ``score``, 1 for an exact find and less by the share of
    edits, 0 without any; and ``spans`` of the fuzzy finds with their label,
    place in the text's characters, and edits.

    Words are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased. Null and empty texts have no words, empty labels and score 0.
    Repeated rows give repeated results; an empty table an empty one. Input
    columns with the names of results are replaced. No row moves.
    """
    own = without(docs, [f.name for f in _RESULT])
    rest = [c for c in own.columns if c != text]
    ordered = own.select(*[column(c) for c in [text, *rest]])
    names = [f.name for f in _RESULT]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t.as_py()) for t in b.column(0)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(c, k) for c, k in zip(columns, _ARROW, strict=True)]], [*rest, *names])

    return ordered.mapInArrow(step, T.StructType([*[ordered.schema[c] for c in rest], *_RESULT]))
