"""Boolean trigram queries of regular expressions, worked out on the driver from the parsed pattern.

A query is a list of alternatives, each a set of lower-case trigrams; a text that matches the pattern contains, lower-cased,
all trigrams of one alternative at least. An empty set among them means that the pattern has no mandatory trigrams.
"""

from __future__ import annotations

import re
from re import _parser as parser  # the standard library's own parse tree

Query = list[frozenset[str]]
#: Strings that a run of literals and small classes may spell, and alternatives of a query; beyond either a weaker query is used.
MOST_STRINGS, MOST_ALTERNATIVES, SMALL_CLASS = 64, 64, 8
EVERYTHING: Query = [frozenset()]


def _grams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _any_of(strings: set[str]) -> Query:
    return _least([_grams(s) for s in strings])


def _least(query: Query) -> Query:
    """Without alternatives that hold another one whole."""
    kept: Query = []
    for q in sorted(set(query), key=lambda q: (len(q), sorted(q))):
        if not any(k <= q for k in kept):
            kept.append(q)
    return kept


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_ALTERNATIVES:
        return a
    return _least([x | y for x in a for y in b])


def _item(op, arg) -> tuple[set[str] | None, Query]:
    """The strings that the item can match, if they are few, else what it requires."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}, EVERYTHING
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= SMALL_CLASS:
        return {chr(a) for _, a in arg}, EVERYTHING
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        found = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
            return set().union(*(s for s, _ in found)), EVERYTHING
        return None, _least([q for s, r in found for q in (r if s is None else _any_of(s))])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and int(high) == 1 and low == 0:
            return strings | {""}, EVERYTHING
        if strings is not None and low == high and int(low) <= 4 and len(strings) ** int(low) <= MOST_STRINGS:
            spelt = {""}
            for _ in range(int(low)):
                spelt = {a + b for a in spelt for b in strings}
            return spelt, EVERYTHING
        if low == 0:
            return None, EVERYTHING
        return None, query if strings is None else _any_of(strings)
    if name == "AT":
        return {""}, EVERYTHING
    return None, EVERYTHING


def _sequence(tree) -> tuple[set[str] | None, Query]:
    run, query, spelt = {""}, EVERYTHING, True
    for op, arg in tree:
        strings, more = _item(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        spelt = False
        query = _both(query, _any_of(run))
        query = _both(query, more if strings is None else _any_of(strings))
        run = {""}
    return (run, EVERYTHING) if spelt else (None, _both(query, _any_of(run)))


def trigram_query(pattern: str) -> Query:
    strings, query = _sequence(parser.parse(pattern, re.ASCII))
    return query if strings is None else _any_of(strings)
