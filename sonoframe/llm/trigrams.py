"""Boolean trigram queries derived from regular expressions.

A query is a set of conjunctions; a text can only match the expression if it holds all trigrams of at least one of
them. A query that holds the empty conjunction says nothing, so every text has to be scanned. Trigrams are in lower case.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser

Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])
#: Literal alternatives and conjunctions followed at most; beyond, the part of the expression says nothing.
MOST_STRINGS, MOST_CONJUNCTIONS = 64, 64


def _absorb(conjunctions) -> Query:
    kept = set(conjunctions)
    kept = {c for c in kept if not any(other < c for other in kept)}
    return frozenset(kept) if len(kept) <= MOST_CONJUNCTIONS else ANYTHING


def _both(left: Query, right: Query) -> Query:
    return _absorb(a | b for a, b in product(left, right))


def _grams(strings: set[str]) -> Query:
    return _absorb(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _strings(node) -> set[str] | None:
    """All strings that a node matches, if they are few."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        if value[0][0] is op.NEGATE:
            return None
        found: set[str] = set()
        for member, what in value:
            if member is op.LITERAL:
                found.add(chr(what).lower())
            elif member is op.RANGE and what[1] - what[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None
        return found if len(found) <= 6 else None
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[3])
    if kind is op.BRANCH:
        branches = [_sequence_strings(b) for b in value[1]]
        return set().union(*branches) if all(b is not None for b in branches) else None
    if kind is op.MAX_REPEAT:
        low, high, inner = value
        once = _sequence_strings(inner)
        if once is None or high is op.MAXREPEAT or len(once) ** high > MOST_STRINGS:
            return None
        return {"".join(p) for n in range(low, high + 1) for p in product(once, repeat=n)}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    runs = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(runs) * len(more) > MOST_STRINGS:
            return None
        runs = {r + m for r in runs for m in more}
    return runs


def _inner(node) -> Query:
    kind, value = node
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        return _absorb(c for b in value[1] for c in _sequence(b))
    if kind is op.MAX_REPEAT and value[0] > 0:
        return _sequence(value[2])
    return ANYTHING


def _sequence(nodes) -> Query:
    runs, query = {""}, ANYTHING
    for node in nodes:
        more = _strings(node)
        if more is not None and len(runs) * len(more) <= MOST_STRINGS:
            runs = {r + m for r in runs for m in more}
        else:
            query, runs = _both(_both(query, _grams(runs)), _inner(node)), {""}
    return _both(query, _grams(runs))


def trigram_query(pattern: str) -> Query:
    """The weakest condition on trigrams that this derivation can prove for a pattern."""
    return _sequence(_parser.parse(pattern))
