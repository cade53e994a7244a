"""Union-free regular expressions over the tags and texts of one host's pages, and what they say.

An expression is a tree: each element's content is a sequence of groups of elements. A group of one is
the element, optional if an instance of its parent lacked it, repeated if one had several; a group of
more is a repeated group of optional elements. A text place holds one constant, or differs: a slot.
Aligning two expressions lines up their sequences by the longest run of common elements in order:
what only one side has becomes optional, what the sides order differently or repeat becomes a
repeated group, differing texts become slots. Every element of a sequence has a label of its own, so
an expression is bounded by the number of labels, not by pages.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterable

from rankweave.llm.markup import DEEPEST, HEADINGS, INLINE, Tags, events

LEAST_PAGES = 5  # that repeat a text before it counts as part of the template
WIDEST = 64  # labels below one element; beyond, classes and ids are generalised away
SLOT = ""  # in place of a constant: texts differ
_SUMS = ("seen", "times", "pages", "chars", "linked")


def _tag(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


class Element:
    """One place of an expression, with sums over the pages aligned so far.

    ``seen``: instances of its parent that hold it, ``times``: its own instances, ``pages``; ``chars`` of
    its own text, ``linked``: those inside links; ``constant``: digest of its text wherever it has one.
    """

    __slots__ = (*_SUMS, "constant", "noise", "plain", "order", "below", "_page")

    def __init__(self, noise: bool = False):
        self.seen = self.times = self.pages = self.chars = self.linked = 0
        self.constant: str | None = None
        self.noise, self.plain, self._page = noise, False, -1
        self.order: list[list[str]] = []
        self.below: dict[str, Element] = {}

    def label(self, full: str) -> str:
        """What an element is called below this one."""
        return _tag(full) if self.plain else full

    def text(self, digest: str) -> None:
        if digest != self.constant:
            self.constant = digest if self.constant is None else SLOT

    def dump(self) -> list:
        below = {x: child.dump() for x, child in self.below.items()}
        return [*(getattr(self, x) for x in _SUMS), self.constant, self.noise, self.plain, self.order, below]

    @staticmethod
    def load(held: list) -> Element:
        out = Element(held[6])
        for name, value in zip(_SUMS, held):
            setattr(out, name, value)
        out.constant, out.plain, out.order = held[5], held[7], held[8]
        out.below = {x: Element.load(child) for x, child in held[9].items()}
        return out


def folded(groups: Iterable[list[str]]) -> list[list[str]]:
    """Groups in which every label occurs once: what comes again makes all since then one group."""
    out: list[list[str]] = []
    at: dict[str, int] = {}
    for group in groups:
        where = min((at[x] for x in group if x in at), default=len(out))
        if where == len(out):
            out.append(list(dict.fromkeys(group)))
        elif where < len(out) - 1 or not at.keys() >= set(group):
            out[where:] = [list(dict.fromkeys(x for g in [*out[where:], group] for x in g))]
        for x in out[where]:
            at[x] = where
    return out


def aligned(a: list[list[str]], b: list[list[str]]) -> list[list[str]]:
    """One sequence of groups that both ``a`` and ``b`` fit."""
    if a == b or not b:
        return a
    if not a:
        return b
    at = {x: i for i, group in enumerate(a) for x in group}
    pairs = [(min(at[x] for x in group if x in at), j) for j, group in enumerate(b) if any(x in at for x in group)]
    ends: list[int] = []  # of the best strictly rising runs of places in ``a``, by length
    before: list[int] = []
    for n, (i, _) in enumerate(pairs):
        length = bisect_left([pairs[e][0] for e in ends], i)
        before.append(ends[length - 1] if length else -1)
        ends[length : length + 1] = [n]
    common, n = [], ends[-1] if ends else -1
    while n >= 0:
        common.append(pairs[n])
        n = before[n]
    out, i, j = [], 0, 0
    for to_a, to_b in [*reversed(common), (len(a), len(b))]:
        out += [*a[i:to_a], *b[j:to_b]]
        if to_a < len(a):
            out.append([*a[to_a], *b[to_b]])
        i, j = to_a + 1, to_b + 1
    return folded(out)


def _generalise(element: Element) -> None:
    """Drop classes and ids from the labels below."""
    if element.plain:
        return
    element.plain = True
    held, element.below = element.below, {}
    element.order = folded([element.label(x) for x in group] for group in element.order)
    for full, child in held.items():
        _join(element, element.label(full), child)


def _join(element: Element, label: str, child: Element) -> None:
    if label in element.below:
        absorb(element.below[label], child)
    else:
        element.below[label] = child


def absorb(into: Element, other: Element) -> None:
    """Align ``other`` with ``into``, which then stands for both."""
    if into.plain or other.plain:
        _generalise(into)
        _generalise(other)
    for x in _SUMS:
        setattr(into, x, getattr(into, x) + getattr(other, x))
    if other.constant is not None:
        into.text(other.constant)
    into.noise &= other.noise
    into.order = aligned(into.order, other.order)
    for label, child in other.below.items():
        _join(into, label, child)
    if len(into.below) > WIDEST:
        _generalise(into)


def merged(dumps: Iterable[str]) -> Element:
    root = Element()
    for held in dumps:
        absorb(root, Element.load(json.loads(held)))
    return root


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def add_page(root: Element, page: str, tags: Tags) -> None:
    """Align one page with the expression."""
    number = root.pages
    root.pages += 1
    root.times += 1
    stack: list[tuple[Element, list[list[str]], set[str], list[str]]] = [(root, [], set(), [])]
    links = 0

    def finish() -> None:
        element, sequence, _, texts = stack.pop()
        element.order = aligned(element.order, folded(sequence))
        own = " ".join("".join(texts).split())
        if own:
            element.text(digest(own))
        if len(element.below) > WIDEST:
            _generalise(element)

    for event, what in events(page, tags):
        element, sequence, met, texts = stack[-1]
        if event == "text":
            size = len(what) - what.count(" ")
            element.chars += size
            element.linked += size if links else 0
            texts.append(what)
        elif event == "link":
            links += what
        elif event == "space":
            texts.append(" ")
        elif event == "close":
            finish()
        elif len(stack) > DEEPEST:
            stack.append((element, [], met, texts))
        else:
            label = element.label(what[1])
            child = element.below.get(label)
            if child is None:
                child = element.below[label] = Element(what[2])
            child.noise &= what[2]
            if label not in met:
                met.add(label)
                child.seen += 1
            if child._page != number:
                child._page = number
                child.pages += 1
            child.times += 1
            sequence.append([label])
            stack.append((child, [], set(), []))
    while stack:
        finish()


def expression(element: Element) -> str:
    """The wrapper as text: ``#`` slots, ``=`` constants, ``?`` optional, ``+`` repeated, ``(a|b)+`` groups."""
    parts = [] if element.constant is None else ["#" if element.constant == SLOT else "="]
    for group in element.order:
        one = []
        for label in group:
            child = element.below[label]
            flag = "+" if child.times > child.seen else ""
            flag = {"": "?", "+": "*"}[flag] if child.seen < element.times and len(group) == 1 else flag
            inner = expression(child)
            one.append(f"{label}{f'({inner})' if inner else ''}{flag}")
        parts.append(one[0] if len(one) == 1 else f"({'|'.join(one)})+")
    return " ".join(parts)


def decide(root: Element) -> dict:
    """Which places of an expression hold the main text.

    ``first``: articles, or else main parts; a repeated article beside a single one is a teaser. ``second``,
    for pages without those: the smallest element with most of the text that is neither noise nor in links.
    ``drop``: menus and site headers inside it. ``fixed``: places whose text is the template's, where the
    text around them differs. ``plain``: elements below which labels have no class or id.
    """
    found: dict[str, list[tuple[str, Element]]] = {"article": [], "main": []}
    plain: list[str] = []
    mass: dict[str, int] = {}

    def visit(path: str, element: Element, inside: frozenset[str]) -> int:
        if element.plain:
            plain.append(path)
        total = 0 if element.constant not in (None, SLOT) and element.pages > 1 else element.chars - element.linked
        for label, child in element.below.items():
            if child.noise:
                if child.plain or child.below:
                    visit_noise(f"{path}/{label}", child)
                continue
            tag, where = _tag(label), f"{path}/{label}"
            if tag in found and tag not in inside:
                found[tag].append((where, child))
            held = visit(where, child, inside | {tag} if tag in found else inside)
            total += 0 if tag in found else held
        mass[path] = total
        return total

    def visit_noise(path: str, element: Element) -> None:
        if element.plain:
            plain.append(path)
        for label, child in element.below.items():
            visit_noise(f"{path}/{label}", child)

    visit("", root, frozenset())
    first = [(p, e) for p, e in found["article"] if mass[p]] or [(p, e) for p, e in found["main"] if mass[p]] or found["article"]
    single = [(p, e) for p, e in first if e.times == e.pages]
    if single and any(mass[p] for p, _ in single):
        first = single
    second, element = "", root
    while True:
        heavy = [
            (f"{second}/{x}", c) for x, c in element.below.items()
            if not c.noise and c.below and _tag(x) not in found and mass[f"{second}/{x}"] > 0.6 * mass[second]
        ]
        if not heavy or not mass[second]:
            break
        second, element = heavy[0]
    drop: set[str] = set()
    fixed: set[str] = set()

    def prune(path: str, element: Element, menus: bool, varied: bool) -> None:
        constant = element.constant not in (None, SLOT) and element.pages >= LEAST_PAGES and element.times == element.pages
        if varied and constant and _tag(path) not in HEADINGS:
            fixed.add(path)
        for label, child in element.below.items():
            where = f"{path}/{label}"
            if child.noise or _tag(where) in INLINE:
                continue
            chars, linked = _total(child)
            if menus and (child.below and linked > 0.6 * chars or where == "/header"):
                drop.add(where)
            else:
                prune(where, child, menus, varied)

    for path, e in first:
        prune(path, e, False, 2 * mass[path] > _total(e)[0])
    if mass[""]:
        prune(second, element, True, 2 * mass[second] > _total(element)[0])
    return {
        "first": [p for p, _ in first], "second": second if mass[""] else None,
        "drop": sorted(drop), "fixed": sorted(fixed), "plain": plain,
    }


def _total(element: Element) -> tuple[int, int]:
    """Characters below that are no noise, and those of them inside links."""
    chars, linked = element.chars, element.linked
    for child in element.below.values():
        if not child.noise:
            more = _total(child)
            chars, linked = chars + more[0], linked + more[1]
    return chars, linked


class Rules:
    """``decide``'s answer, ready to be laid over pages."""

    def __init__(self, held: dict):
        self.first, self.drop, self.fixed, self.plain = (frozenset(held[x]) for x in ("first", "drop", "fixed", "plain"))
        self.second = held["second"]

    def blocks(self, page: str, tags: Tags) -> list[str]:
        """The page's blocks of main text, in order."""
        chosen: tuple[list[str], list[str]] = ([], [])
        buffer: list[str] = []
        # Path; whether inside first, inside second, dropped with all below, of constant text, apart from its line.
        stack = [("", False, self.second == "", "" in self.drop, "" in self.fixed, True)]

        def flush() -> None:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            for blocks, inside in zip(chosen, stack[-1][1:3]):
                if text and inside:
                    blocks.append(text)

        for event, what in events(page, tags):
            path, first, second, dropped, fixed, apart = stack[-1]
            if event == "text":
                if not dropped and not fixed:
                    buffer.append(what)
            elif event == "space":
                buffer.append(" ")
            elif event == "open":
                tag, label, noise = what
                apart = tag not in INLINE
                if apart:
                    flush()
                if len(stack) <= DEEPEST:
                    path = f"{path}/{_tag(label) if path in self.plain else label}"
                first, second = first or path in self.first, second or path == self.second
                stack.append((path, first, second, dropped or noise or path in self.drop, path in self.fixed, apart))
            elif event == "close":
                if apart:
                    flush()
                stack.pop()
        while stack:
            if stack[-1][-1]:
                flush()
            stack.pop()
        return chosen[0] or chosen[1]
