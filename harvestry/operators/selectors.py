"""CSS and XPath selectors as structural joins over node ranges.

A selector is compiled once into steps; a step joins the nodes met so far with
all nodes by their place in the tree. As the range of a node holds its whole
subtree and ranges nest, each join is one pass over the nodes of a batch of
pages: below a met node lies whatever starts before the furthest end so far,
and sums over a range tell whether something in it was met. Time grows with
the number of nodes, however deep or alike they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A condition of a step: its kind and what it is about.
Test = tuple


@dataclass(frozen=True)
class Step:
    """One compound selector and how it hangs on the step before it: " " below,
    ">" child, "+" next and "~" later sibling, "<" parent, "^" above,
    "-" earlier sibling, "." the same node, "*" the same node or below."""

    link: str = " "
    tests: tuple[Test, ...] = ()


@dataclass(frozen=True)
class Path:
    """Steps, whether they start at the root, and what is taken of the nodes
    met: None for themselves, ("attr", name), or ("text",) for their own text."""

    steps: tuple[Step, ...]
    rooted: bool = False
    value: tuple | None = None


@dataclass
class _Reader:
    source: str
    at: int = 0
    error: str = field(default="unsupported selector")

    def fail(self) -> ValueError:
        return ValueError(f"{self.error}: {self.source!r}")

    def take(self, pattern: str) -> re.Match | None:
        found = re.compile(pattern, re.S).match(self.source, self.at)
        if found:
            self.at = found.end()
        return found

    def need(self, pattern: str) -> re.Match:
        found = self.take(pattern)
        if not found:
            raise self.fail()
        return found

    @property
    def done(self) -> bool:
        return self.at >= len(self.source)


# --- CSS ---------------------------------------------------------------------

_NAME = r"[\w\u0080-\U0010ffff-]+"
_STRING = r""""([^"]*)"|'([^']*)'"""
# Pseudo-classes that are an nth-child formula of their own
# (step, offset, counted from the end, among the same tag).
_NTH = {
    "first-child": [(0, 1, False, False)],
    "last-child": [(0, 1, True, False)],
    "only-child": [(0, 1, False, False), (0, 1, True, False)],
    "first-of-type": [(0, 1, False, True)],
    "last-of-type": [(0, 1, True, True)],
    "only-of-type": [(0, 1, False, True), (0, 1, True, True)],
}


def _formula(r: _Reader) -> tuple[int, int]:
    """The step and offset of an+b, of odd, even or a plain number."""
    if m := r.take(r"\s*(odd|even)\s*"):
        return (2, 1) if m[1] == "odd" else (2, 0)
    if m := r.take(r"\s*([+-]?\d*)n\s*(?:([+-])\s*(\d+))?\s*"):
        step = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
        return step, int((m[2] or "+") + (m[3] or "0"))
    return 0, int(r.need(r"\s*([+-]?\d+)\s*")[1])


def _compound(r: _Reader) -> tuple[tuple[Test, ...], tuple | None]:
    tests: list[Test] = []
    start = r.at
    if m := r.take(rf"\*|[A-Za-z]{_NAME[:-1]}*"):
        if m[0] != "*":
            tests.append(("tag", m[0].lower()))
    while not r.done:
        if m := r.take(rf"#({_NAME})"):
            tests.append(("attr", "id", "=", m[1]))
        elif m := r.take(rf"\.({_NAME})"):
            tests.append(("attr", "class", "~=", m[1]))
        elif m := r.take(rf"\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:{_STRING}|([^\]\s]+))\s*)?\]"):
            value = next((v for v in m.groups()[2:] if v is not None), "")
            tests.append(("attr", m[1].lower(), m[2] or "has", value))
        elif m := r.take(r"::text\b"):
            return tuple(tests), ("text",)
        elif m := r.take(r"::attr\(\s*([\w:-]+)\s*\)"):
            return tuple(tests), ("attr", m[1].lower())
        elif m := r.take(r":nth-(last-)?(child|of-type)\("):
            tests.append(("nth", *_formula(r), m[1] is not None, m[2] == "of-type"))
            r.need(r"\)")
        elif m := r.take(r":(not|is|where|has)\("):
            inner = _css_list(r, relative=m[1] == "has")
            r.need(r"\s*\)")
            if any(p.value for p in inner):
                raise r.fail()
            test = ("any", tuple(inner)) if m[1] != "has" else ("exists", tuple(inner))
            tests.append(("not", test) if m[1] == "not" else test)
        elif m := r.take(r":([a-z-]+)"):
            if m[1] in _NTH:
                tests += [("nth", *n) for n in _NTH[m[1]]]
            elif m[1] in ("empty", "root"):
                tests.append((m[1],))
            else:
                raise r.fail()
        else:
            break
    if r.at == start:
        raise r.fail()
    return tuple(tests), None


def _css_list(r: _Reader, relative: bool = False) -> list[Path]:
    paths = []
    while True:
        steps: list[Step] = []
        r.take(r"\s*")
        link = r.need(r"([>+~]?)\s*")[1] or " " if relative else " "
        while True:
            tests, value = _compound(r)
            steps.append(Step(link, tests))
            m = None if value else r.take(r"\s*([>+~])\s*|\s+(?![\s,)]|$)")
            if not m:
                break
            link = m[1] or " "
        paths.append(Path(tuple(steps), value=value))
        if not r.take(r"\s*,"):
            r.take(r"\s*")
            return paths


def css_paths(selector: str) -> list[Path]:
    """The alternatives of a CSS selector."""
    r = _Reader(selector)
    paths = _css_list(r)
    if not r.done or len({p.value for p in paths}) > 1:
        raise r.fail()
    return paths


# --- XPath -------------------------------------------------------------------

_AXES = {"child": ">", "descendant": " ", "parent": "<", "ancestor": "^", "following-sibling": "~", "preceding-sibling": "-", "self": "."}


def _xpath(r: _Reader) -> Path:
    steps: list[Step] = []
    rooted, value = True, None
    if m := r.take(r"\.?(//?)"):
        link = " " if m[1] == "//" else ">"
        rooted = not m[0].startswith(".")
    elif r.take(r"\.(?=\s*[\])=!,|]|\s*$)"):
        return Path((Step("."),), False)
    else:
        rooted, link = False, ">"
    while True:
        if m := r.take(r"@([\w:-]+)"):
            value = ("attr", m[1].lower())
        elif r.take(r"text\(\)"):
            value = ("text",)
        if value:
            if link == " ":
                steps.append(Step("*"))
            break
        if r.take(r"\.\."):
            steps.append(Step("<"))
        else:
            m = r.need(r"(?:([a-z-]+)::)?(\*|node\(\)|[A-Za-z][\w-]*)(?!\()")
            if m[1]:
                if m[1] not in _AXES or link == " ":
                    raise r.fail()
                link = _AXES[m[1]]
            tests: list[Test] = [] if m[2] in ("*", "node()") else [("tag", m[2].lower())]
            while r.take(r"\s*\["):
                tests.append(_either(r))
                r.need(r"\s*\]")
            if link not in " >" and any(_has_position(t) for t in tests):
                raise r.fail()
            steps.append(Step(link, tuple(tests)))
        m = r.take(r"//?")
        if not m:
            break
        link = " " if m[0] == "//" else ">"
    return Path(tuple(steps), rooted, value)


def _has_position(test: Test) -> bool:
    return test[0] == "position" or test[0] in ("and", "or", "not") and any(_has_position(t) for t in test[1:])


def _either(r: _Reader) -> Test:
    tests = [_both(r)]
    while r.take(r"\s+or\s+"):
        tests.append(_both(r))
    return tests[0] if len(tests) == 1 else ("or", *tests)


def _both(r: _Reader) -> Test:
    tests = [_condition(r)]
    while r.take(r"\s+and\s+"):
        tests.append(_condition(r))
    return tests[0] if len(tests) == 1 else ("and", *tests)


def _literal(r: _Reader) -> str:
    m = r.need(rf"\s*(?:{_STRING})")
    return m[1] if m[1] is not None else m[2]


def _condition(r: _Reader) -> Test:
    r.take(r"\s*")
    if r.take(r"not\("):
        test = ("not", _either(r))
        r.need(r"\s*\)")
        return test
    if r.take(r"\("):
        test = _either(r)
        r.need(r"\s*\)")
        return test
    if m := r.take(r"\d+"):
        return ("position", "=", int(m[0]), False)
    if m := r.take(r"last\(\)(?:\s*-\s*(\d+))?"):
        return ("position", "=", -int(m[1] or 0), True)
    if m := r.take(r"position\(\)\s*(!=|<=|>=|=|<|>)\s*(?:(\d+)|last\(\)(?:\s*-\s*(\d+))?)"):
        return ("position", m[1], int(m[2]), False) if m[2] else ("position", m[1], -int(m[3] or 0), True)
    if m := r.take(r"(contains|starts-with)\(\s*"):
        what = _operand(r)
        r.need(r"\s*,")
        test = _compared(what, m[1], _literal(r))
        r.need(r"\s*\)")
        return test
    what = _operand(r)
    if m := r.take(r"\s*(!?=)"):
        return _compared(what, m[1], _literal(r))
    return _compared(what, "has", "")


def _operand(r: _Reader) -> tuple[Path, bool]:
    """A path, and whether its white space is normalised."""
    if r.take(r"normalize-space\(\s*"):
        path = Path((Step("."),)) if r.source.startswith(")", r.at) else _xpath(r)
        r.need(r"\s*\)")
        return path, True
    if r.take(r"string\(\s*\.?\s*\)"):
        return Path((Step("."),)), False
    path = _xpath(r)
    if path.rooted:
        raise r.fail()
    return path, False


def _compared(what: tuple[Path, bool], op: str, value: str) -> Test:
    """A comparison of what a path leads to, as a test of the node it starts from."""
    path, spaced = what
    if path.value and path.value[0] == "attr":
        test: Test = ("attr", path.value[1], {"contains": "*=", "starts-with": "^="}.get(op, op), value) if not spaced else ("attr", path.value[1], "spaced " + op, value)
    elif path.value:
        test = ("own_text", op, value, spaced)
    else:
        test = ("text", op, value, spaced) if op != "has" else ("all",)
    steps = path.steps
    if not steps or steps == (Step("."),):
        return test
    last = Step(steps[-1].link, (*steps[-1].tests, test))
    return ("exists", (Path((*steps[:-1], last)),))


def xpath_paths(expr: str) -> list[Path]:
    """The alternatives of an XPath."""
    r = _Reader(expr, error="unsupported path")
    paths = []
    while True:
        r.take(r"\s*")
        paths.append(_xpath(r))
        if not r.take(r"\s*\|"):
            break
    r.take(r"\s*")
    if not r.done or len({p.value for p in paths}) > 1 or any(not p.steps for p in paths):
        raise r.fail()
    return paths


@lru_cache(maxsize=1024)
def selector_paths(path: str) -> tuple[Path, ...]:
    """What ``css:``, ``xpath:`` or a plain CSS selector compiles to; refused
    with a ValueError if it has parts that are not supported."""
    return tuple(xpath_paths(path[6:]) if path.startswith("xpath:") else css_paths(path.removeprefix("css:")))


# --- matching ----------------------------------------------------------------


#: The relation that leads back.
_BACK = {" ": "^", ">": "<", "<": ">", "^": " ", "~": "-", "-": "~", "*": "@", ".": "."}


class Nodes:
    """The nodes of a batch of fragments as columns. Places are numbers over
    the whole batch; no range reaches over the end of its fragment."""

    def __init__(self, fragments: pa.ListArray, texts: pa.Array | None = None, text_at: pa.Array | None = None):
        self.bounds = fragments.offsets.to_numpy()
        first, last = int(self.bounds[0]), int(self.bounds[-1])
        self.bounds = self.bounds - first
        rows = fragments.values.slice(first, last - first)
        columns = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
        self.size = last - first
        self.page = np.repeat(np.arange(len(fragments)), np.diff(self.bounds))
        ids = columns["id"].to_numpy(False).astype(np.int64)
        shift = np.arange(self.size) - ids  # from numbers of a page to places
        self.end = columns["end"].to_numpy(False) + shift
        parent = columns["parent"].to_numpy(False) + shift
        self.parent = np.where(parent >= self.bounds[self.page], parent, -1)
        self.depth = columns["depth"].to_numpy(False)
        self.tag = columns["tag"]
        self.starts, self.stops = (columns[c].to_numpy(False).astype(np.int64) for c in ("t0", "t1"))
        self.attrs = columns["attrs"]
        self.texts, self.text_at = texts, text_at
        self._siblings: np.ndarray | None = None

    # Relations: which nodes stand in the relation to a node of the mask.

    def below(self, mask: np.ndarray) -> np.ndarray:
        furthest = np.maximum.accumulate(np.where(mask, self.end, -1))
        out = np.zeros(self.size, bool)
        out[1:] = furthest[:-1] >= np.arange(1, self.size)
        return out

    def above(self, mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[self.end + 1] > upto[1:]

    def children(self, mask: np.ndarray) -> np.ndarray:
        return np.append(mask, False)[self.parent]

    def parents(self, mask: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size + 1, bool)
        out[self.parent[mask]] = True
        return out[:-1]

    @property
    def family(self) -> np.ndarray:
        """The same number for nodes of one parent."""
        if self._siblings is None:
            self._siblings = np.where(self.parent >= 0, self.parent, -1 - self.page)
        return self._siblings

    def _by_family(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.family, kind="stable")
        own = self.family[order]
        return order, np.concatenate([[True], own[1:] != own[:-1]]) if self.size else np.zeros(0, bool)

    def next_to(self, mask: np.ndarray, back: bool = False) -> np.ndarray:
        order, first = self._by_family()
        out = np.zeros(self.size, bool)
        same = ~first[1:]
        if back:
            out[order[:-1]] = mask[order[1:]] & same
        else:
            out[order[1:]] = mask[order[:-1]] & same
        return out

    def beside(self, mask: np.ndarray, back: bool = False) -> np.ndarray:
        """Later siblings of the mask's nodes; with ``back`` earlier ones."""
        order, first = self._by_family()
        if not self.size:
            return mask
        met = mask[order].astype(np.int64)
        upto = np.cumsum(met)
        group = np.cumsum(first) - 1
        before = (upto - met)[np.flatnonzero(first)][group]
        whole = np.bincount(group, weights=met).astype(np.int64)[group]
        out = np.zeros(self.size, bool)
        out[order] = (whole - (upto - before) > 0) if back else (upto - met - before > 0)
        return out

    def places(self, key: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the nodes of the mask their place from 1 among those of equal
        key, and how many those are; 0 for others."""
        at = np.flatnonzero(mask)
        place, of = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        if len(at):
            order = at[np.argsort(key[at], kind="stable")]
            own = key[order]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sizes = np.diff(np.append(start, len(own)))
            place[order] = np.arange(len(own)) - np.repeat(start, sizes) + 1
            of[order] = np.repeat(sizes, sizes)
        return place, of

    # Tests of single nodes.

    def attribute(self, name: str) -> tuple[np.ndarray, pa.Array]:
        """The nodes that have the attribute, and their values."""
        bounds = self.attrs.offsets.to_numpy()
        first, size = int(bounds[0]), int(bounds[-1] - bounds[0])
        named = np.flatnonzero(pc.equal(self.attrs.keys.slice(first, size), name).to_numpy(False))
        owner = np.repeat(np.arange(self.size), np.diff(bounds))
        return owner[named], self.attrs.items.slice(first, size).take(pa.array(named))

    def _attr(self, name: str, op: str, value: str) -> np.ndarray:
        owner, values = self.attribute(name)
        if op.startswith("spaced "):
            values, op = pc.utf8_trim_whitespace(pc.replace_substring_regex(values, r"\s+", " ")), op[7:]
        word = rf"(?:^|\s){re.escape(value)}(?:\s|$)"
        if op == "has":
            hit = np.ones(len(owner), bool)
        elif op in ("=", "!="):
            hit = pc.equal(values, value).to_numpy(False)
            hit = ~hit if op == "!=" else hit
        elif not value or op == "~=" and re.search(r"\s", value):
            hit = np.zeros(len(owner), bool)  # CSS: such tests match nothing
        elif op == "|=":
            hit = (pc.equal(values, value) if not value else pc.or_(pc.equal(values, value), pc.starts_with(values, value + "-"))).to_numpy(False)
        else:
            tests = {"~=": lambda: pc.match_substring_regex(values, word), "^=": lambda: pc.starts_with(values, value), "starts-with": lambda: pc.starts_with(values, value),
                     "$=": lambda: pc.ends_with(values, value), "*=": lambda: pc.match_substring(values, value), "contains": lambda: pc.match_substring(values, value)}
            hit = tests[op]().to_numpy(False)
        out = np.zeros(self.size, bool)
        out[owner[hit]] = True
        return out

    def _slice(self, page: int, start: int, stop: int) -> str:
        shift = self.text_at[page].as_py() or 0
        return self.texts[page].as_buffer()[start - shift : stop - shift].to_pybytes().decode("utf-8", "replace")

    def pieces(self, node: int) -> list[tuple[int, str]]:
        """The pieces of text that lie in the node and in none of its children,
        with their places in the page's text."""
        out, at = [], int(self.starts[node])
        child = node + 1
        while child <= self.end[node]:
            out.append((at, int(self.starts[child])))
            at, child = int(self.stops[child]), int(self.end[child]) + 1
        out.append((at, int(self.stops[node])))
        return [(a, self._slice(self.page[node], a, b)) for a, b in out if a < b]

    def own_texts(self, node: int) -> list[str]:
        return [piece for _, piece in self.pieces(node)]

    def text(self, node: int) -> str:
        return self._slice(self.page[node], int(self.starts[node]), int(self.stops[node]))

    def _texts(self, mask: np.ndarray, own: bool, op: str, value: str, spaced: bool) -> np.ndarray:
        out = np.zeros(self.size, bool)
        for node in np.flatnonzero(mask):
            found = self.own_texts(node) if own else [self.text(node)]
            if spaced:
                found = [" ".join(f.split()) for f in found]
            if op == "has":
                out[node] = bool(found)
            elif op == "=":
                out[node] = value in found
            elif op == "!=":
                out[node] = any(f != value for f in found)
            else:  # of several pieces a function takes the first
                first = found[0] if found else ""
                out[node] = value in first if op == "contains" else first.startswith(value)
        return out

    def test(self, test: Test, mask: np.ndarray) -> np.ndarray:
        """Which nodes pass; mask: those that have passed so far."""
        kind, *of = test
        if kind == "all":
            return np.ones(self.size, bool)
        if kind == "tag":
            return pc.equal(self.tag, of[0]).to_numpy(False)
        if kind == "attr":
            return self._attr(*of)
        if kind in ("own_text", "text"):
            return self._texts(mask, kind == "own_text", *of)
        if kind == "nth":
            step, offset, from_end, of_type = of
            key = self.family
            if of_type:
                tags = self.tag.dictionary_encode()
                key = (key + len(self.bounds)) * (len(tags.dictionary) + 1) + tags.indices.to_numpy(False)
            place, count = self.places(key, np.ones(self.size, bool))
            place = count + 1 - place if from_end else place
            return place == offset if step == 0 else ((place - offset) % step == 0) & ((place - offset) // step >= 0)
        if kind == "position":
            op, number, from_last = of
            place, count = self.places(self.family, mask)
            wanted = count + number if from_last else np.full(self.size, number)
            hit = {"=": place == wanted, "!=": place != wanted, "<": place < wanted, ">": place > wanted, "<=": place <= wanted, ">=": place >= wanted}[op]
            return hit & mask
        if kind == "empty":
            return (self.end == np.arange(self.size)) & (self.starts == self.stops)
        if kind == "root":
            return self.parent < 0
        if kind == "not":
            return ~self.test(of[0], mask)
        if kind == "and":
            return np.logical_and.reduce([self.test(t, mask) for t in of])
        if kind == "or":
            return np.logical_or.reduce([self.test(t, mask) for t in of])
        if kind == "any":
            return np.logical_or.reduce([self.met(p) for p in of[0]])
        return np.logical_or.reduce([self.leads(p) for p in of[0]])  # exists

    def passed(self, step: Step, mask: np.ndarray) -> np.ndarray:
        for t in step.tests:
            mask = mask & self.test(t, mask)
        return mask

    def related(self, link: str, mask: np.ndarray) -> np.ndarray:
        if link == " ":
            return self.below(mask)
        if link == ">":
            return self.children(mask)
        if link == "<":
            return self.parents(mask)
        if link == "^":
            return self.above(mask)
        if link == "+":
            return self.next_to(mask)
        if link in "~-":
            return self.beside(mask, back=link == "-")
        if link in "*@":
            return mask | (self.below(mask) if link == "*" else self.above(mask))
        return mask

    def met(self, path: Path) -> np.ndarray:
        """The nodes that a path leads to."""
        everywhere = np.ones(self.size, bool)
        first = path.steps[0]
        start = self.depth == 0 if first.link == ">" else everywhere
        mask = self.passed(first, start)
        for step in path.steps[1:]:
            mask = self.passed(step, self.related(step.link, mask))
        return mask

    def leads(self, path: Path) -> np.ndarray:
        """The nodes from which a path leads somewhere, found from its end."""
        mask = np.ones(self.size, bool)
        for i in range(len(path.steps) - 1, -1, -1):
            step = path.steps[i]
            counted = any(_has_position(t) for t in step.tests)  # among all siblings
            mask = mask & self.passed(step, np.ones(self.size, bool) if counted else mask)
            if step.link == "+":
                mask = self.next_to(mask, back=True)
            else:
                mask = self.related(_BACK[step.link], mask)
        return mask


def _needs_text(paths: tuple[Path, ...]) -> bool:
    def in_test(t: Test) -> bool:
        if t[0] in ("text", "own_text"):
            return True
        if t[0] in ("any", "exists"):
            return _needs_text(t[1])
        return t[0] in ("and", "or", "not") and any(in_test(x) for x in t[1:])

    return any((p.value or ("",))[0] == "text" or any(in_test(t) for s in p.steps for t in s.tests) for p in paths)


def _by_page(nodes: Nodes, found: np.ndarray, values: pa.Array) -> pa.Array:
    """Values of the places found, a list for each fragment."""
    cuts = np.searchsorted(found, nodes.bounds)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def _places(paths: tuple[Path, ...], nodes: Nodes) -> np.ndarray:
    return np.flatnonzero(np.logical_or.reduce([nodes.met(p) for p in paths]))


def _udf(path: str, kind: str, of: Callable[[tuple[Path, ...], Nodes], pa.Array]):
    """An Arrow function over (nodes) or (nodes, text, text_at)."""
    paths = selector_paths(path)

    @F.arrow_udf(kind)
    def without_text(nodes: pa.Array) -> pa.Array:
        return of(selector_paths(path), Nodes(nodes))

    @F.arrow_udf(kind)
    def with_text(nodes: pa.Array, text: pa.Array, text_at: pa.Array) -> pa.Array:
        return of(selector_paths(path), Nodes(nodes, text, text_at))

    def apply(fragment: Column) -> Column:
        if _needs_text(paths):
            return with_text(fragment["nodes"], fragment["text"], fragment["text_at"])
        return without_text(fragment["nodes"])

    return apply


def node_numbers(fragment: Column, path: str) -> Column:
    """Array of the places (from 0) of matching nodes, in document order."""

    def of(paths: tuple[Path, ...], nodes: Nodes) -> pa.Array:
        found = _places(paths, nodes)
        return _by_page(nodes, found, pa.array(found - nodes.bounds[nodes.page[found]], pa.int32()))

    return _udf(path, "array<int>", of)(fragment)


def node_values(fragment: Column, path: str) -> Column:
    """Array of the attributes or own texts that a path with such an end
    takes of the nodes it leads to, in document order."""

    def of(paths: tuple[Path, ...], nodes: Nodes) -> pa.Array:
        found = _places(paths, nodes)
        if paths[0].value[0] == "attr":
            owner, values = nodes.attribute(paths[0].value[1])
            wanted = np.isin(owner, found)
            return _by_page(nodes, owner[wanted], values.filter(pa.array(wanted)))
        pieces = sorted((start, node, piece) for node in found for start, piece in nodes.pieces(node))
        at = np.array([n for _, n, _ in pieces], np.int64)
        page = nodes.page[at] if len(at) else at
        order = np.argsort(page, kind="stable")
        cuts = np.searchsorted(page[order], np.arange(len(nodes.bounds)))
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array([pieces[i][2] for i in order], pa.string()))

    return _udf(path, "array<string>", of)(fragment)
