"""Boolean trigram queries that a text must meet to match a regular expression.

A query is ``None`` (nothing is known: every text may match), or a list of conjunctions, one of
which must hold: a set of trigrams that all occur.  Letters matched in either case are folded to lower case,
and the index is then asked for the folded text.
"""

from __future__ import annotations

import re
from re import _parser

#: An expression is followed as a set of exact strings only up to so many; beyond, less is derived, never wrongly.
MOST_STRINGS = 64

Query = list[frozenset[str]] | None


def _strings(items, ignore_case: bool) -> tuple[set[str] | None, Query]:
    """Exact strings that a sequence can be (None: too many), and the query known besides."""
    exact: set[str] = {""}
    known: Query = None

    def close() -> None:
        nonlocal exact, known
        known = both(known, of_strings(exact))
        exact = {""}

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            part: set[str] | None = {chr(arg).lower() if ignore_case else chr(arg)}
            inner: Query = None
        elif name == "IN" and _letters(arg):
            part, inner = {c.lower() if ignore_case else c for c in _letters(arg)}, None
        elif name == "SUBPATTERN":
            part, inner = _strings(arg[3], ignore_case or bool(arg[1] & re.IGNORECASE))
        elif name == "BRANCH":
            sides = [_strings(side, ignore_case) for side in arg[1]]
            if all(s is not None for s, _ in sides):
                part, inner = set().union(*[s for s, _ in sides]), None
            else:
                part, inner = None, either([q if s is None else both(q, of_strings(s)) for s, q in sides])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
            one, _ = _strings(arg[2], ignore_case)
            part, inner = (one | {""} if one is not None else None), None
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            one, inner = _strings(arg[2], ignore_case)
            if one is not None:
                inner = both(inner, of_strings(one))
            part = None
        elif name == "AT":
            continue
        else:
            part, inner = None, None
        known = both(known, inner)
        if part is None:
            close()
        elif len(exact) * len(part) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in part}
        else:
            close()
            exact = part
    if known is None and not any(_open(op, arg) for op, arg in items):
        return exact, None
    close()
    return None, known


def _letters(arg) -> set[str] | None:
    """The characters of a small class that lists them one by one."""
    listed = {chr(c) for kind, c in arg if str(kind) == "LITERAL"}
    return listed if len(listed) == len(arg) <= 8 else None


def _open(op, arg) -> bool:
    """Whether an item can be more than a few exact strings."""
    name = str(op)
    if name in ("LITERAL", "AT"):
        return False
    if name == "IN":
        return not _letters(arg)
    if name == "SUBPATTERN":
        return any(_open(*x) for x in arg[3])
    if name == "BRANCH":
        return any(_open(*x) for side in arg[1] for x in side)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
        return any(_open(*x) for x in arg[2])
    return True


def of_strings(strings: set[str]) -> Query:
    """One conjunction for each string; None if one of them is too short for a trigram."""
    parts = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in parts else _least(parts)


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    return _least({x | y for x in a for y in b})


def either(parts: list[Query]) -> Query:
    return None if any(p is None for p in parts) else _least({x for p in parts for x in p})


def _least(parts: set[frozenset[str]]) -> list[frozenset[str]]:
    """Without conjunctions that another one implies."""
    return sorted((p for p in parts if not any(q < p for q in parts)), key=sorted)


def query(pattern: str, ignore_case: bool) -> Query:
    """The Boolean query of an expression; ``ignore_case``: of the folded text."""
    exact, known = _strings(_parser.parse(pattern), ignore_case)
    return known if exact is None else both(known, of_strings(exact))
