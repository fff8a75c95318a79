"""Boolean trigram queries that a text must satisfy if a regular expression is to match.

After R. Cox, "Regular Expression Matching with a Trigram Index" (2012): literals are
concatenated as far as they form a small set of strings; each such set gives an OR over
its strings of the AND of their trigrams. A query is kept as a list of alternatives,
each a set of trigrams that must all occur; None means that nothing is mandatory, so
every text has to be scanned. Trigrams are in lower case.

Defined results: an empty pattern, one whose every match may be shorter than three characters
and one with a branch that asks for nothing give None; sets of more than ``_MOST`` strings or
alternatives are weakened, never dropped, so that no match is lost.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser as parser

Query = list[frozenset[str]] | None
_MOST = 64


def trigram_query(pattern: str) -> Query:
    exact, query = _sequence(parser.parse(pattern))
    return _both(query, _of_strings(exact)) if exact is not None else query


def _of_strings(strings: set[str]) -> Query:
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _absorb([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _absorb(sets: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without the alternatives that another one implies."""
    out: list[frozenset[str]] = []
    for s in sorted(set(sets), key=lambda x: (len(x), sorted(x))):
        if not any(t <= s for t in out):
            out.append(s)
    return out


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > _MOST:
        return min(a, b, key=len)
    return _absorb([x | y for x in a for y in b])


def _either(queries: list[Query]) -> Query:
    if any(q is None for q in queries):
        return None
    return _absorb([s for q in queries for s in q])


def _sequence(items) -> tuple[set[str] | None, Query]:
    """The exact strings of a sequence, if they are few; else None and its query."""
    now, query, whole = {""}, None, True
    for op, value in items:
        exact, own = _item(op, value)
        if exact is not None and len(now) * len(exact) <= _MOST:
            now = {a + b for a in now for b in exact}
            continue
        query = _both(query, _of_strings(now))
        if exact is not None:
            now = exact
        else:
            query, now = _both(query, own), {""}
        whole = False
    if whole:
        return now, None
    return None, _both(query, _of_strings(now))


def _item(op, value) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(value).lower()}, None
    if op is sre.AT:
        return {""}, None
    if op is sre.IN:
        if len(value) <= 8 and all(kind is sre.LITERAL for kind, _ in value):
            return {chr(c).lower() for _, c in value}, None
        return None, None
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(exact is not None for exact, _ in parts):
            strings = set().union(*(exact for exact, _ in parts))
            if len(strings) <= _MOST:
                return strings, None
        return None, _either([_of_strings(e) if e is not None else q for e, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, body = value
        exact, own = _sequence(body)
        if exact is not None and (least, most) == (0, 1):
            return exact | {""}, None
        if exact is not None and least == most and len(exact) == 1:
            return {next(iter(exact)) * least}, None
        if least == 0:
            return None, None
        return None, _of_strings(exact) if exact is not None else own
    return None, None
