"""BPE encoding by prefix-sharing trie traversal, and decoding.

Distinct words go into a trie in sorted order. A state of a prefix is the last
token of its encoding and where that token starts; it follows from the state
at that start, because a sequence of tokens is an encoding exactly if every
two neighbours are the encoding of their concatenation. The depth-first walk
keeps the states of the current path, so a prefix shared by many words is
encoded once. A word's tokens are read off the states from its end.

Texts are encoded in the partitions they lie in: the step moves no rows. A
worker keeps what it knows of words and of white-space separated chunks in
tables of bounded size.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, without

#: Bounds of a worker's tables, in entries for each of two generations, and
#: the longest chunk or word that they keep.
CHUNKS, WORDS, PAIRS = 200_000, 200_000, 600_000
LONG = 256
#: White space that separates words in this tokenizer (Unicode White_Space).
_SPACE = regex.compile(r"[\t\n\v\f\r \x85\xa0  -     　]+")
#: Characters that str.split() takes for white space and the tokenizer doesn't.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_END = "</w>"


def chunks(text: str) -> list[str]:
    """The runs between white space; no token reaches over white space."""
    if any(c in text for c in _NOT_SPACE):
        return [c for c in _SPACE.split(text) if c]
    return text.split()


#: A sentence mark behind a letter that stays one letter when normalised.
_ENDED = r"([0-9A-Za-zÀ-ÖØ-öø-įı-ſ])([.,;:!?])(\s|$)"


def chunk_lists(texts: pa.Array, mark: str) -> pa.ListArray:
    """The chunks of each text; of null none. Runs of white space at a text's
    ends leave empty chunks, which have no ids.

    So that there are fewer distinct chunks, a sentence mark between a Latin
    letter or a digit and white space is a chunk of its own, as it is a word of its own
    anyway, and A-Z are lower-cased here, unless ``mark`` tells that a text may
    hold added tokens, which are found as they are written."""
    texts = texts.fill_null("")
    if not pc.any(pc.match_substring(texts, mark)).as_py():
        texts = pc.ascii_lower(texts)
    texts = pc.replace_substring_regex(texts, _ENDED, r"\1 \2\3")
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
        return pa.array([chunks(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


def _byte_letters() -> list[str]:
    """The printable letter of each byte in the vocabulary: itself where it is
    printable and no space, else the next free letter from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class TrieEncoder:
    """Token ids of words by a walk over the trie of the words."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.vocab = vocab
        self.rank = {pair: i for i, pair in enumerate(map(tuple, merges))}
        self.names = {i: s for s, i in vocab.items()}
        self.longest = max((len(s.removesuffix(_END)) for s in vocab), default=1)
        self.coded = {i: i.to_bytes(4, "little") for i in vocab.values()}
        self.pairs: dict[int, bool] = {}

    def _symbols(self, token: str) -> list[str]:
        letters = token.removesuffix(_END)
        out = list(letters)
        if token != letters:
            out[-1] += _END
        return out

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols: the lowest merge first, leftmost first."""
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((symbols[at - 1], symbols[at]), none)
            if at < len(ranks):
                ranks[at] = rank((symbols[at], symbols[at + 1]), none)
        return symbols

    def _follows(self, last: int, token: int) -> bool:
        """Whether the two tokens are the encoding of their concatenation;
        last -1: whether the token is that of its own letters."""
        names = ([self.names[last]] if last >= 0 else []) + [self.names[token]]
        valid = tuple(names) not in self.rank and self._merged([s for n in names for s in self._symbols(n)]) == names
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[last << 20 | token] = valid
        return valid

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct word, given in the vocabulary's letters, as
        little-endian 32-bit numbers."""
        out: dict[str, bytes] = {}
        vocab, pairs, coded, longest = self.vocab.get, self.pairs, self.coded, self.longest
        # Of the path's prefix of d letters: its last token, and where that starts.
        last, begins, path = [-1], [0], ""
        for word in sorted(set(words)):  # the paths of the trie in depth-first order
            inner = len(word) - 1
            shared, most = 0, min(len(path), inner)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], begins[shared + 1 :]
            path = word[:inner]
            for end in range(shared + 1, inner + 2):
                tail = _END if end > inner else ""
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    if (token := vocab(word[start:end] + tail)) is None:
                        continue
                    known = pairs.get(last[start] << 20 | token)
                    if known or known is None and self._follows(last[start], token):
                        break
                else:
                    raise ValueError(f"no encoding of {word[:end]!r}")
                if tail:
                    tokens = [coded[token]]
                    while start:
                        tokens.append(coded[last[start]])
                        start = begins[start]
                    out[word] = b"".join(tokens[::-1])
                else:
                    last.append(token)
                    begins.append(start)
        return out


class Recent:
    """A table of two generations: when the young one is full it becomes the
    old one, from which entries in use come back."""

    def __init__(self, bound: int):
        self.bound = bound
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.young) > self.bound:
            self.young, self.old = {}, self.young

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Of distinct keys those in neither generation; those of the old one
        are young again."""
        young, old = self.young, self.old
        lacking = [k for k in keys if k not in young]
        if not old:
            return lacking
        young.update({k: old[k] for k in lacking if k in old})
        return [k for k in lacking if k not in old]

    def forget_long(self, keys: Iterable[str]) -> None:
        for k in keys:
            if len(k) > LONG:
                self.young.pop(k, None)


class Tokenizer:
    """Encodes and decodes texts as the tokenizer file says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.trie = TrieEncoder(model["vocab"], (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]))
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        # Added tokens are found in the raw text, before it is lower-cased.
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._mark = os.path.commonprefix(list(self.added)) if self.added else "\0\0"
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        # The same for ASCII, where the standard library's patterns do.
        self._ascii = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)
        self._letters = _byte_letters()
        names = self.trie.names | {i: s for s, i in self.added.items()}
        self._names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.known = Recent(CHUNKS)
        self.words = Recent(WORDS)

    def _lowered(self, chunk: str) -> str:
        """Normalised as a whole; lower case letter by letter, without the
        rule for a final sigma."""
        if chunk.isascii():
            return chunk.lower()  # the common case
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def _pieces(self, chunk: str) -> list[str | int]:
        """The words of a chunk, and the ids of added tokens in it."""
        low = self._lowered(chunk)
        if low.isalpha():
            return [low]
        if self._mark not in chunk:
            return (self._ascii if low.isascii() else self._words).findall(low)
        out: list[str | int] = []
        for part in self._added.split(chunk) if self._added else [chunk]:
            if part in self.added:
                out.append(self.added[part])
            else:
                out += self._words.findall(self._lowered(part))
        return out

    def learn(self, fresh: Iterable[str]) -> None:
        """Encode chunks not met lately."""
        single: dict[str, str] = {}
        ended: dict[str, tuple[str, str]] = {}
        pieces: dict[str, list[str | int]] = {}
        for c in fresh:
            if c.isalpha() and (low := c.lower() if c.isascii() else self._lowered(c)).isalpha():  # most of them: one word
                single[c] = low
            elif c.isascii() and c[:-1].isalpha() and not c[-1].isdigit():  # or one and a mark
                ended[c] = c[:-1].lower(), c[-1]
            else:
                pieces[c] = self._pieces(c)
        met = set(single.values()).union(*ended.values())
        new = self.words.missing(met.union(p for own in pieces.values() for p in own if p.__class__ is str))
        table, known = self.words.young, self.known.young
        table.update(self.code_words(new))
        known.update({c: table[p] for c, p in single.items()})
        known.update({c: table[p] + table[q] for c, (p, q) in ended.items()})
        known.update({c: b"".join([table[p] if p.__class__ is str else int(p).to_bytes(4, "little") for p in own]) for c, own in pieces.items()})
        self.words.forget_long(new)

    def code_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words that are no longer than a piece of the pattern."""
        letters = self._letters
        spelt = {p: p if p.isascii() and p.isprintable() else "".join([letters[b] for b in p.encode()]) for p in words}
        ids = self.code_spelt(set(spelt.values()))
        return {p: ids[s] for p, s in spelt.items()}

    def code_spelt(self, spelt: set[str]) -> dict[str, bytes]:
        """Ids of words in the vocabulary's letters."""
        return self.trie.encode(spelt)

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids as little-endian 32-bit numbers; none for null. Distinct chunks
        are looked up once, and their ids gathered for all places."""
        split = chunk_lists(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), self._mark)
        self.known.turn()
        self.words.turn()
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(False).tolist()
        if fresh := self.known.missing(distinct):
            self.learn(fresh)
        own = [self.known.young[c] for c in distinct]
        self.known.forget_long(fresh)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        every, at = np.frombuffer(b"".join(own), "<u4"), coded.indices.to_numpy(False)
        size = sizes[at]
        ends = np.cumsum(size)
        gathered = every[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [gathered[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: bytes) -> str:
        """The tokens' names with a space between, as a tokenizer file without
        a decoder says; special tokens are kept."""
        return b" ".join(map(self._names.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One for each worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Every row with ``ids``: the token ids of its whole text as
    little-endian unsigned 32-bit numbers in one binary value; with
    ``decoded``, if asked for, the text that these ids stand for.

    path: a tokenizer file that every executor has. Null and empty texts get
    an empty value. Other columns pass as they are; input columns named ids or
    decoded are replaced. An empty table gives an empty result. No row moves; a
    text is encoded whole, and a lost task encodes its rows again.
    """
    fields = [("ids", T.BinaryType(), pa.binary()), ("decoded", T.StringType(), pa.string())][: 1 + decoded]
    own = without(docs, [f[0] for f in fields])
    at = own.columns.index(text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for b in slices(batches, at):
            ids = coder.encode_batch(b.column(at))
            made = [pa.array(ids, pa.binary())] + [pa.array(map(coder.decode, ids), pa.string())] * decoded
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *(f[0] for f in fields)])

    return own.mapInArrow(step, T.StructType([*own.schema.fields, *[T.StructField(n, k) for n, k, _ in fields]]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Every row with ``decoded``, the text that its ``ids`` stand for; null
    ids decode to an empty text. An input column named decoded is replaced."""
    own = without(encoded, ["decoded"])
    at = own.columns.index("ids")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for b in slices(batches, at):
            made = pa.array([coder.decode(i or b"") for i in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, "decoded"])

    return own.mapInArrow(step, T.StructType([*own.schema.fields, T.StructField("decoded", T.StringType())]))
