"""Boolean trigram queries out of regular expressions, after the published method of code search by trigram index.

For every part of an expression four things are kept: the strings it can match if they are few (`exact`), strings of which each match
has one as its start (`prefix`) and one as its end (`suffix`), and a query that each match fulfils (`need`). Parts are put together up to
the whole expression. Letters are lowered, so one index of lowered bytes serves expressions of either case.

A query is None (all documents), a trigram of bytes, or ("and" | "or", frozenset of queries).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as kind
from re import _parser

import numpy as np

#: Sets of strings of more members are given up for what is known of their trigrams.
FEW = 64
ANY = frozenset([b""])


def both(*queries):
    """All of the queries hold."""
    parts = {q for q in queries if q is not None}
    flat = frozenset().union(*[q[1] if isinstance(q, tuple) and q[0] == "and" else {q} for q in parts])
    return None if not flat else next(iter(flat)) if len(flat) == 1 else ("and", flat)


def either(*queries):
    """One of the queries holds."""
    if any(q is None for q in queries):
        return None
    flat = frozenset().union(*[q[1] if isinstance(q, tuple) and q[0] == "or" else {q} for q in queries])
    return next(iter(flat)) if len(flat) == 1 else ("or", flat)


def trigrams_of(strings: frozenset[bytes]):
    """One of the strings is there; says nothing if one is shorter than three bytes."""
    if not strings or min(map(len, strings)) < 3:
        return None
    return either(*[both(*[s[i:i + 3] for i in range(len(s) - 2)]) for s in strings])


@dataclass(frozen=True)
class Part:
    exact: frozenset[bytes] | None
    prefix: frozenset[bytes]
    suffix: frozenset[bytes]
    need: object = None

    @staticmethod
    def of(strings: frozenset[bytes]) -> Part:
        return Part(strings, strings, strings)

    def short(self, loose: bool = False) -> Part:
        """The same with sets that stay small: long or many strings become trigrams of `need`."""
        if self.exact is not None and len(self.exact) <= FEW and not loose:
            return self
        prefix, suffix = frozenset(s[:2] for s in self.prefix), frozenset(s[-2:] for s in self.suffix)
        return Part(None, prefix if len(prefix) <= FEW else ANY, suffix if len(suffix) <= FEW else ANY,
                    both(self.need, trigrams_of(self.prefix), trigrams_of(self.suffix)))

    def query(self):
        return self.short(loose=True).need


NOTHING_KNOWN = Part(None, ANY, ANY)


def _cross(a: frozenset[bytes], b: frozenset[bytes]) -> frozenset[bytes]:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= FEW * FEW else ANY


def joined(a: Part, b: Part) -> Part:
    """a, then b."""
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= FEW * FEW:
        return Part.of(_cross(a.exact, b.exact)).short()
    between = _cross(a.suffix, b.prefix)
    prefix = _cross(a.exact, b.prefix) if a.exact is not None else a.prefix
    suffix = _cross(a.suffix, b.exact) if b.exact is not None else b.suffix
    return Part(None, prefix, suffix, both(a.need, b.need, trigrams_of(between))).short()


def other(a: Part, b: Part) -> Part:
    """a or b."""
    if a.exact is not None and b.exact is not None:
        return Part.of(a.exact | b.exact).short()
    a, b = a.short(loose=True), b.short(loose=True)
    return Part(None, a.prefix | b.prefix, a.suffix | b.suffix, either(a.need, b.need))


def _class(members: list) -> Part:
    out = set()
    for op, value in members:
        if op is kind.LITERAL:
            out.add(chr(value).lower().encode() if value < 128 else chr(value).encode())
        elif op is kind.RANGE and value[1] - value[0] < FEW:
            out |= {chr(c).lower().encode() if c < 128 else chr(c).encode() for c in range(value[0], value[1] + 1)}
        else:
            return NOTHING_KNOWN
    return Part.of(frozenset(out)) if len(out) <= 4 else NOTHING_KNOWN


def _part(tree) -> Part:
    out = Part.of(ANY)
    for op, value in tree:
        if op is kind.LITERAL:
            new = _class([(op, value)])
        elif op is kind.IN:
            new = _class(value)
        elif op is kind.SUBPATTERN:
            new = _part(value[-1])
        elif op is kind.ATOMIC_GROUP:
            new = _part(value)
        elif op is kind.BRANCH:
            new = _part(value[1][0])
            for branch in value[1][1:]:
                new = other(new, _part(branch))
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
            least, most, inner = value
            inner, new = _part(inner), Part.of(ANY)
            for _ in range(min(least, 8)):
                new = joined(new, inner)
            if most == 1 and not least:
                new = other(new, inner)
            elif not least:
                new = NOTHING_KNOWN
            elif most > least or least > 8:  # starts and ends as the fewest repeats do
                new = new.short(loose=True)
        elif op in (kind.AT, kind.ASSERT, kind.ASSERT_NOT):
            new = Part.of(ANY)
        else:  # any character, a class by its complement, a reference: unknown
            new = NOTHING_KNOWN
        out = joined(out, new)
    return out


def query_of(pattern: str, flags: int = 0):
    """What every match of the expression holds, None if no trigram is sure."""
    if flags & re.IGNORECASE and not flags & re.ASCII:
        raise ValueError("case beyond ASCII is not in the index: give re.ASCII, too")
    return _part(_parser.parse(pattern, flags)).query()


def named(query) -> set[bytes]:
    """All trigrams of a query."""
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(named, query[1]))


def holds(query, find: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """Documents (as a mask) that fulfil a query, `find` giving those of a trigram."""
    if isinstance(query, bytes):
        return find(query)
    masks = [holds(q, find) for q in query[1]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(masks)
