"""A grouping genetic algorithm for bin packing, on arrays of item lengths (Falkenauer, 1996).

An individual is an array that gives every item its bin. Crossover injects whole well-filled bins of one
parent into the other, drops the other's bins that hold an injected item, and places the displaced
items by best fit, longest first; mutation empties a few poorly filled bins in the same way.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class GaSettings:
    """``generations`` for every bin above the bound, ``most_generations`` at most; none where there is no gap."""

    capacity: int = 4096
    population: int = 16
    generations: int = 50
    most_generations: int = 400
    well_filled: float = 0.99
    injected: float = 0.6
    emptied: int = 3


def best_fit(bins: np.ndarray, order: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Place the items of ``order`` (bin -1 in ``bins``) one by one into the fullest bin they fit."""
    bins = bins.copy()
    placed = bins >= 0
    count = int(bins.max(initial=-1)) + 1
    fill = np.bincount(bins[placed], weights=lengths[placed], minlength=count).astype(np.int64)
    free = sorted((capacity - int(f), b) for b, f in enumerate(fill) if f < capacity)
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        at = bisect_left(free, (length, -1))
        if at < len(free):
            room, chosen = free.pop(at)
        else:
            room, chosen = capacity, count
            count += 1
        bins[item] = chosen
        if room > length:
            insort(free, (room - length, chosen))
    return bins


def _score(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones; smaller is better."""
    fill = np.bincount(bins, weights=lengths) / capacity
    return len(fill), -float(np.square(fill).sum())


def _renumber(bins: np.ndarray) -> np.ndarray:
    """Bins without gaps; -1 stays."""
    held = bins >= 0
    out = np.full(len(bins), -1)
    out[held] = np.unique(bins[held], return_inverse=True)[1]
    return out


def crossover(
    giver: np.ndarray, taker: np.ndarray, lengths: np.ndarray, s: GaSettings, rng: np.random.Generator
) -> np.ndarray:
    fill = np.bincount(giver, weights=lengths) / s.capacity
    chosen = (fill >= s.well_filled) & (rng.random(len(fill)) < s.injected)
    injected = chosen[giver]
    hit = np.zeros(int(taker.max()) + 1, bool)
    hit[taker[injected]] = True
    held = np.bincount(taker, weights=lengths) / s.capacity
    poor = np.argsort(np.where(hit, 2.0, held))[: s.emptied]
    hit[poor[rng.random(len(poor)) < 0.8]] = True
    child = np.where(injected, len(hit) + giver, np.where(hit[taker], -1, taker))
    displaced = np.flatnonzero(child < 0)
    order = displaced[np.argsort(-lengths[displaced] * rng.uniform(0.9, 1.0, len(displaced)), kind="stable")]
    return best_fit(_renumber(child), order, lengths, s.capacity)


def bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: by length, and by the items of which no two share a bin."""
    return max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))


def first_packing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit, longest first."""
    return best_fit(np.full(len(lengths), -1), np.argsort(-lengths, kind="stable"), lengths, capacity)


def evolve(
    lengths: np.ndarray, given: list[np.ndarray], s: GaSettings, rng: np.random.Generator
) -> np.ndarray:
    """The best individual after ``generations``, starting from the ``given`` ones and random ones."""
    nothing = np.full(len(lengths), -1)
    people = list(given) or [first_packing(lengths, s.capacity)]
    least = bound(lengths, s.capacity)
    gap = min(_score(p, lengths, s.capacity)[0] for p in people) - least
    while len(people) < s.population and _score(people[0], lengths, s.capacity)[0] > least:
        noisy = lengths * rng.uniform(0.7, 1.0, len(lengths))
        people.append(best_fit(nothing, np.argsort(-noisy, kind="stable"), lengths, s.capacity))
    ranked = sorted(((_score(p, lengths, s.capacity), i, p) for i, p in enumerate(people)), key=lambda x: x[:2])
    for turn in range(min(s.most_generations, s.generations * gap)):
        if ranked[0][0][0] <= least or len(ranked) < 2:
            break
        one, two = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[min(one, two)][2], ranked[max(one, two)][2], lengths, s, rng)
        score = _score(child, lengths, s.capacity)
        if score < ranked[-1][0] and all(score != r[0] for r in ranked):
            ranked[-1] = (score, len(people) + turn, child)
            ranked.sort(key=lambda x: x[:2])
    return ranked[0][2]
