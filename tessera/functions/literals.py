"""Literal strings that every match of a pattern must hold, so that most texts are ruled out without running the pattern."""

from __future__ import annotations

import functools
from re import _constants as C
from re import _parser as parser

#: A literal this short rules out little.
LEAST = 3


def _best(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The one that rules out more: the longer its shortest string, and of those as few strings as may be."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _of(items) -> frozenset[str] | None:
    best, run = None, ""
    for op, arg in [*items, (None, None)]:
        if op is C.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            best, run = _best(best, frozenset([run])), ""
        if op is C.SUBPATTERN:
            best = _best(best, _of(arg[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            best = _best(best, _of(arg[2]))
        elif op is C.BRANCH:
            each = [_of(x) for x in arg[1]]
            if all(each):
                best = _best(best, frozenset().union(*each))
    return best


@functools.cache
def required(pattern: str, least: int = LEAST) -> tuple[str, ...] | None:
    """Lower-case strings of which every match, lower-cased, holds one; None if none is told or one is shorter than least.

    The pattern is in the syntax that Java, RE2 and Python share.
    """
    found = _of(parser.parse(pattern))
    return tuple(sorted(found)) if found and min(map(len, found)) >= least else None
