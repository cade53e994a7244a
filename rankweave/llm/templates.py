"""Texts as templates: numbers, units and names become typed placeholders, the rest lower-case words.

A token is a word without its outer punctuation; words of punctuation alone are skipped. A number
is a figure (with separators, a sign, a currency or a per cent mark) or a number word; a unit is a
known unit right after a number, or joined to it; a name is a capitalised word that does not open a
sentence or a line. A run of names is one name, a number with the number words after it one number.
Words in capitals throughout are ordinary words, so shouted text meets plain text. A capitalised
word that opens a sentence may be a name or not: windows with one have two hashes.

Words are cut, classed and hashed as arrays of bytes; only words with a digit or with a sign outside
ASCII at an edge go through expressions, once per run of texts. A character is lower-cased where
that keeps its length in UTF-8.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from rankweave.llm.kernels import Texts, U, chain, hash_spans, mix, words

# English number words and common units of measurement.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "million billion dozen half".split()
)
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram "
    "kilograms oz ounce ounces lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kph hz khz mhz ghz v volt volts w watt watts kw j joule joules cal kcal k c f degree degrees "
    "percent dollar dollars cent cents euro euros usd eur kb mb gb tb meter meters metre metres".split()
)
_FIGURE = re.compile(r"[+-]?[$€£¥]?[0-9][0-9.,:/]*[%€$£]?(?:st|nd|rd|th)?")
_JOINED = re.compile(r"([+-]?[$€£¥]?[0-9][0-9.,]*)([A-Za-z%]+)")
_EDGES = re.compile(r"^[^\w$€£¥+-]+|[^\w%€$£]+$")
_ENDS = re.compile(r"[.!?:]\W*$")
LITERAL, NUMBER, NUMBER_WORD, UNIT_WORD, CAPITAL, SKIPPED, JOINED = range(7)
_NUMBER, _UNIT, _NAME = (U(k) for k in (0x6E756D626572, 0x756E6974, 0x6E616D65))


def _bytes(chars: str, more: range = range(0)) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*map(ord, chars), *more]] = True
    return out


_ALNUM = _bytes("", range(256)) & ~_bytes("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
_WORD = _ALNUM | _bytes("_")
_LEADS, _TRAILS = _WORD | _bytes("$+-"), _WORD | _bytes("%$")
_DIGIT, _STOP, _LAST = _bytes("0123456789"), _bytes(".!?:"), _bytes('.!?:")')
_UPPER, _LOWER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz")
_LETTER_LEAD = _bytes("", range(0xC3, 0xCA))  # two-byte Latin letters
_HIGH = _bytes("", range(128, 256))


def _hashes(values: list[str]) -> np.ndarray:
    raw = [v.encode("utf-8", "surrogatepass") for v in values]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    starts = ends - np.array([len(r) for r in raw], np.int64)
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), starts, ends)


_NUMBER_HASHES, _UNIT_HASHES = (np.sort(_hashes(sorted(w))) for w in (NUMBER_WORDS, UNITS))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def lowered(texts: Texts) -> np.ndarray:
    """The bytes with every character lower-cased whose lower case is as long."""
    data = texts.data
    plain = data.copy()
    plain[_UPPER[data]] += 32
    wide = np.flatnonzero(texts.per_row(_HIGH[data]) > 0)
    for row in wide:
        low, high = texts.offsets[row], texts.offsets[row + 1]
        text = data[low:high].tobytes().decode("utf-8", "surrogatepass")
        small = text.lower().encode("utf-8", "surrogatepass")
        if len(small) != high - low:
            same = (c.lower() if len(c.lower().encode("utf-8", "surrogatepass")) == len(c.encode("utf-8", "surrogatepass")) else c for c in text)
            small = "".join(same).encode("utf-8", "surrogatepass")
        plain[low:high] = np.frombuffer(small, np.uint8)
    return plain


def _slow(word: str) -> tuple[int, str, str, bool]:
    """Kind, value, second value and whether it ends a sentence, of any word."""
    core = _EDGES.sub("", word)
    lower = core.lower()
    ends = word[-1] in ".!?:\"”»)" and bool(_ENDS.search(word))
    if not any(c.isalnum() for c in core):
        return SKIPPED, "", "", ends
    if _FIGURE.fullmatch(core):
        return NUMBER, lower, "", ends
    if lower in NUMBER_WORDS:
        return NUMBER_WORD, lower, "", ends
    if (joined := _JOINED.fullmatch(core)) and joined[2].lower() in UNITS:
        return JOINED, joined[1], joined[2].lower(), ends
    if lower in UNITS:
        return UNIT_WORD, lower, "", ends
    return CAPITAL if core[0].isupper() and any(c.islower() for c in core[1:]) else LITERAL, lower, "", ends


def _class_words(texts: Texts):
    """(row, kind, value, second, opening) of every word; ``opening``: it opens a sentence or a line."""
    data, small = texts.data, lowered(texts)
    found = words(texts)
    start, end = found.start, found.end
    n = len(start)
    before = lambda mask: np.concatenate([[0], np.cumsum(mask[data])])
    firsts, lasts, solid = (np.flatnonzero(mask[data]) for mask in (_LEADS, _TRAILS, _WORD))
    bound = np.append(firsts, len(data))
    core_start = np.minimum(bound[before(_LEADS)[start]], end)
    last = before(_TRAILS)[end] - 1
    core_end = np.where(last >= 0, lasts[np.maximum(last, 0)] + 1 if len(lasts) else 0, 0)
    core_end = np.maximum(core_end, core_start)
    alnum, digits, stops, breaks = before(_ALNUM), before(_DIGIT), before(_STOP), before(_bytes("\n"))
    kind = np.where(alnum[core_end] > alnum[core_start], LITERAL, SKIPPED).astype(np.int8)
    value = hash_spans(small, core_start, core_end)
    second = np.zeros(n, np.uint64)
    kind[(kind == LITERAL) & _among(value, _NUMBER_HASHES)] = NUMBER_WORD
    kind[(kind == LITERAL) & _among(value, _UNIT_HASHES)] = UNIT_WORD
    # Capitalised: the first character changed when lower-cased, a later one did not and has letters.
    changed = np.append(data != small, False)
    at = np.minimum(core_start, max(len(data) - 1, 0))
    lead = data[at] if n else np.zeros(0, np.uint8)
    wide = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    upper = changed[at] | (changed[np.minimum(at + 1, len(data))] & (wide > 1))
    letters = np.concatenate([[0], np.cumsum((_LOWER | _HIGH)[data] & (data == small))])
    rest = np.minimum(core_start + wide, core_end)
    kind[(kind == LITERAL) & upper & (letters[core_end] > letters[rest])] = CAPITAL
    tail = before(_WORD)[end] - 1
    after = np.maximum(np.where(tail >= 0, solid[np.maximum(tail, 0)] + 1 if len(solid) else 0, 0), start)
    ends = (stops[end] > stops[after]) & _LAST[data[end - 1]] if n else np.zeros(0, bool)
    odd = (digits[core_end] > digits[core_start]) | (_HIGH[data[start]] & ~_LETTER_LEAD[data[start]]) if n else np.zeros(0, bool)
    if n:
        odd |= _HIGH[data[end - 1]] & ~_LETTER_LEAD[data[np.maximum(end - 2, 0)]]
        odd |= _HIGH[data[at]] & ~_LETTER_LEAD[data[at]]
    which = np.flatnonzero(odd)
    if len(which):
        raw = data.tobytes()
        spelt = [raw[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())]
        known = {w: k for k, w in enumerate(dict.fromkeys(spelt))}
        kinds, values, seconds, closing = zip(*(_slow(w.decode("utf-8", "surrogatepass")) for w in known))
        index = np.fromiter(map(known.__getitem__, spelt), np.int64, len(spelt))
        kind[which] = np.array(kinds, np.int8)[index]
        value[which], second[which] = _hashes(list(values))[index], _hashes(list(seconds))[index]
        ends[which] = np.array(closing, bool)[index]
    opening = np.ones(n, bool)
    opening[1:] = ends[:-1] | (found.row[1:] != found.row[:-1]) | (breaks[start[1:]] > breaks[end[:-1]])
    return found.row, kind, value, second, opening


def canonical(texts: Texts) -> Canonical:
    row, kind, value, second, opening = _class_words(texts)
    # Marks that are skipped keep the opening they had.
    real = kind != SKIPPED
    marked = np.concatenate([[0], np.cumsum(opening)])
    at = np.flatnonzero(real)
    opening = marked[at + 1] > marked[np.concatenate([[-1], at[:-1]]) + 1] if len(at) else np.zeros(0, bool)
    row, kind, value, second = row[at], kind[at], value[at], second[at]
    # A joined number and unit is two tokens.
    source = np.repeat(np.arange(len(at)), np.where(kind == JOINED, 2, 1))
    tail = np.zeros(len(source), bool)
    tail[1:] = source[1:] == source[:-1]
    row, opening, value = row[source], opening[source], np.where(tail, second[source], value[source])
    kind = np.where(tail, UNIT_WORD, np.where(kind == JOINED, NUMBER, kind)[source])
    same = np.zeros(len(kind), bool)
    same[1:] = row[1:] == row[:-1]
    number, said = (kind == NUMBER) | (kind == NUMBER_WORD), kind == NUMBER_WORD
    after_number = np.zeros(len(kind), bool)
    after_number[1:] = number[:-1] & same[1:]
    unit = (kind == UNIT_WORD) & after_number
    capital = kind == CAPITAL
    name = capital & ~opening
    # Runs: number words after a number, names after a name.
    joins = said & after_number
    joins[1:] |= name[1:] & name[:-1] & same[1:]
    row, number, unit, name, capital, opening, value = _fold(joins, value, row, number, unit, name, capital, opening)
    code = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, mix(value))))
    counts = np.bincount(row, minlength=texts.rows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return Canonical(row, place, code, value, number | unit | name, capital & opening, name)


def _fold(joins: np.ndarray, value: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens that join the one before become one with it; a run's value is a hash of its values in order."""
    if not joins.any():
        return *columns, value
    first = np.flatnonzero(~joins)
    run = np.cumsum(~joins) - 1
    place = (np.arange(len(joins)) - first[run]).astype(np.uint64)
    value = np.where(np.bincount(run)[run] > 1, mix(value + place * U(0x9E3779B97F4A7C15)), value)
    return *(x[first] for x in columns), np.add.reduceat(value, first)


@dataclass
class Canonical:
    """Tokens of some texts: their row and place there, template code, value hash, whether they are
    slots, capitalised words that open a sentence (maybe names), and names."""

    row: np.ndarray
    place: np.ndarray
    code: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    may_be_name: np.ndarray
    name: np.ndarray

    def with_names(self) -> Canonical:
        """A copy in which every capitalised word that opens a sentence is a name, one with names after it."""
        which = self.may_be_name
        joins = np.zeros(len(which), bool)
        joins[1:] = which[:-1] & self.name[1:] & (self.row[1:] == self.row[:-1])
        row, place, code, slot, which, name, value = _fold(
            joins, self.value, self.row, self.place, np.where(which, _NAME, self.code), self.slot | which, which, self.name | which
        )
        return Canonical(row, place, code, value, slot, which, name)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, slots used) of all windows; one with fewer words than slots hashes its values.

        None starts at a name behind a capitalised word that opens a sentence: it may be cut in two.
        """
        template, start = chain(self.code, self.row, size)
        if not len(start):
            return start, template, np.zeros(0, bool)
        cut = np.zeros(len(self.row), bool)
        cut[1:] = self.name[1:] & self.may_be_name[:-1] & (self.row[1:] == self.row[:-1])
        slots = self._inside(self.slot, start, size)
        open_slots = 2 * slots <= size
        if not open_slots.all():
            plain, _ = chain(mix(self.value + U(7)), self.row, size)
            template = np.where(open_slots, template, plain)
        whole = ~cut[start]
        return start[whole], template[whole], (open_slots & (slots > 0))[whole]

    @staticmethod
    def _inside(mask: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(mask)])
        return before[start + size] - before[start]

    def versions(self, size: int) -> list[tuple[Canonical, np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens, start, hash, slots used): the windows as they are, then those that openings as names change."""
        out = [(self, *self.windows(size))]
        if self.may_be_name.any():
            named = self.with_names()
            start, hashed, used = named.windows(size)
            changed = named._inside(named.may_be_name, start, size) > 0
            out.append((named, start[changed], hashed[changed], used[changed]))
        return out
