"""The grammar of full-text queries: terms, phrases and their boolean combinations."""

from __future__ import annotations

import re
from itertools import product

#: Ways in which a row can match: places of terms that it must hold, and of terms that it must not.
Ways = list[tuple[frozenset[int], frozenset[int]]]
_LEXEMES = re.compile(r'\s+|"((?:[^"]|"")*)"|([()*])|([A-Za-z0-9_\u0080-\U0010ffff]+)')


def _lexemes(query: str) -> list[tuple[str, str]] | None:
    """(kind, text) in order, kind being one of ( ) * AND OR NOT and term; None if something is no lexeme."""
    out, at = [], 0
    while at < len(query):
        m = _LEXEMES.match(query, at)
        if m is None:
            return None
        at = m.end()
        if m[1] is not None:
            out.append(("term", m[1].replace('""', '"')))
        elif m[2]:
            out.append((m[2], m[2]))
        elif m[3]:
            out.append((m[3] if m[3] in ("AND", "OR", "NOT") else "term", m[3]))
    return out


def _both(a: Ways, b: Ways) -> Ways:
    joined = {(x[0] | y[0], x[1] | y[1]) for x, y in product(a, b)}
    return [w for w in joined if not w[0] & w[1]]


def _neither(b: Ways) -> Ways:
    """Ways not to match b: of each of its ways, a term that is missing or one that is there."""
    out: Ways = [(frozenset(), frozenset())]
    for need, without in b:
        out = _both(out, [(frozenset(), frozenset([t])) for t in need] + [(frozenset([t]), frozenset()) for t in without])
    return out


def parse(query: str | None, least: int = 3) -> tuple[list[str], Ways] | None:
    """(terms, ways) of a query; None if it is no query of the grammar.

    Terms side by side must all be there and bind closest, then NOT, AND and OR (in capitals);
    parentheses group, quotes make a phrase one term, a star behind a term means nothing here.
    A term is a piece of text, found anywhere.  One of fewer than `least` characters can't be
    looked up: beside others it is left out, elsewhere nothing matches it.
    """
    words = _lexemes(query or "")
    if words is None:
        return None
    terms: list[str] = []
    at = 0

    def peek() -> str:
        return words[at][0] if at < len(words) else ""

    def several() -> Ways:
        nonlocal at
        if peek() == "(":
            at += 1
            out = either()
            if peek() != ")":
                raise ValueError
            at += 1
            return out
        found: list[Ways] = []
        while peek() == "term":
            text = words[at][1]
            at += 1
            if peek() == "*":
                at += 1
            if len(text) >= least:
                if text not in terms:
                    terms.append(text)
                found.append([(frozenset([terms.index(text)]), frozenset())])
            else:
                found.append([])
        if not found or peek() == "(":
            raise ValueError
        out: Ways = []
        for f in filter(None, found):
            out = _both(out, f) if out else f
        return out

    def but() -> Ways:
        nonlocal at
        out = several()
        while peek() == "NOT":
            at += 1
            out = _both(out, _neither(several()))
        return out

    def all_of() -> Ways:
        nonlocal at
        out = but()
        while peek() == "AND":
            at += 1
            out = _both(out, but())
        return out

    def either() -> Ways:
        nonlocal at
        out = all_of()
        while peek() == "OR":
            at += 1
            out = out + [w for w in all_of() if w not in out]
        return out

    if not words:
        return [], []
    try:
        ways = either()
    except ValueError:
        return None
    return (terms, sorted(ways, key=lambda w: (sorted(w[0]), sorted(w[1])))) if at == len(words) else None
