"""Boolean trigram queries from regular expressions, worked out on the driver from a rule's syntax.

A query is a list of conjunctions, each a set of lower-case trigrams; a text that matches the rule has
all trigrams of at least one conjunction. An empty conjunction means that nothing is mandatory. After
Cox, "Regular Expression Matching with a Trigram Index", 2012.
"""

from __future__ import annotations

from re import _parser as syntax

Query = list[frozenset[str]]
_MOST_STRINGS, _MOST_CLAUSES = 32, 64
ALWAYS: Query = [frozenset()]


def _simplified(query: Query) -> Query:
    """Without conjunctions that hold another one; too many are given up for no condition."""
    kept = [q for q in set(query) if not any(other < q for other in query)]
    return sorted(kept, key=sorted) if len(kept) <= _MOST_CLAUSES else ALWAYS


def _all(one: Query, two: Query) -> Query:
    both = [a | b for a in one for b in two]
    return _simplified(both) if len(both) <= 4 * _MOST_CLAUSES else one


def _of_strings(strings: set[str]) -> Query:
    return _simplified([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _class(items: list) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            out.add(chr(value).lower())
        elif str(kind) == "RANGE" and value[1] - value[0] < _MOST_STRINGS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def _exact(node) -> set[str] | None:
    """All lower-cased strings that a syntax node matches, if they are few."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return {chr(value).lower()}
    if kind == "IN":
        found = _class(value)
    elif kind == "SUBPATTERN":
        return _exact_run(value[-1])
    elif kind == "BRANCH":
        parts = [_exact_run(branch) for branch in value[1]]
        found = None if None in parts else set().union(*parts)
    elif kind == "MAX_REPEAT" and value[1] == 1:
        inner = _exact_run(value[2])
        found = None if inner is None else inner | ({""} if value[0] == 0 else set())
    else:
        return None
    return found if found is not None and len(found) <= _MOST_STRINGS else None


def _exact_run(nodes) -> set[str] | None:
    run = {""}
    for node in nodes:
        part = _exact(node)
        if part is None or len(run) * len(part) > _MOST_STRINGS:
            return None
        run = {a + b for a in run for b in part}
    return run


def _within(node) -> Query:
    """What a node without a short list of strings still demands."""
    kind, value = str(node[0]), node[1]
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "BRANCH":
        return _simplified([q for branch in value[1] for q in _sequence(branch)])
    if kind == "MAX_REPEAT" and value[0] > 0:
        return _sequence(value[2])
    return ALWAYS


def _sequence(nodes) -> Query:
    query, run = ALWAYS, {""}
    for node in nodes:
        part = _exact(node)
        if part is not None and len(run) * len(part) <= _MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        query = _all(query, _of_strings(run))
        if part is None:
            query, run = _all(query, _within(node)), {""}
        else:
            run = part
    return _all(query, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """The conjunctions of ``pattern``, a regular expression without look-around."""
    return _sequence(syntax.parse(pattern))
