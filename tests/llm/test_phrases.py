"""Collocations against counts of every phrase, one after the other."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from recollect.llm import phrases as P

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows: list[tuple], least: int, longest: int, most: int | None) -> list[tuple]:
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i : i + m]) for p, a in cand.items() for m in range(2, len(p) - 1) for i in range(1, len(p) - m + 1) if a >= f[(p[0], *p[i : i + m])]}
    out = {}
    for p, a in cand.items():
        if p not in gone:
            lang, ws = p[0], p[1:]
            score, cut = min((1000 * a * n[lang] // (f[(lang, *ws[:c])] * f[(lang, *ws[c:])]), c) for c in range(1, len(ws)))
            out.setdefault(lang, []).append((score, a, " ".join(ws), f[(lang, *ws[:cut])], f[(lang, *ws[cut:])]))
    rows = []
    for lang, xs in out.items():
        xs.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows += [(lang, i, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(xs[:most], 1)]
    return sorted(rows)


def texts(seed: int = 3, n: int = 400) -> list[tuple]:
    rng = np.random.default_rng(seed)
    words = ["the", "of", "New", "york", "city", "hall", "naïve", "Über", "a", "I'm", "日本", "x1", *[f"rare{i}" for i in range(60)]]
    p = np.array([12, 9, 6, 6, 4, 4, 3, 3, 3, 3, 2, 2, *[0.3] * 60])
    out = []
    for _ in range(n):
        ws = list(rng.choice(words, rng.integers(0, 40), p=p / p.sum()))
        if rng.random() < 0.5:
            ws += "the new york city hall of a".split()
        sep = rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ! "], len(ws), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        out.append((str(rng.choice(["en", "de"])) if rng.random() < 0.9 else None, "".join(w + s for w, s in zip(ws, sep, strict=True))))
    return out


ODD = [("en", None), ("en", ""), (None, "the the the the"), ("und", "the the"), ("en", "!!! ... \n\r"), ("fr", "é " * 300), ("en", "of " * 5000), ("en", "New York\x0bcity\x0chall")]


@pytest.mark.parametrize(("least", "longest", "most"), [(5, 5, None), (20, 3, 7), (3, 2, 10)])
def test_phrases_are_those_of_plain_counts(spark, least, longest, most):
    rows = texts() + ODD
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in P.collocations(df, least=least, longest=longest, most=most).collect())
    want = brute(rows, least, longest, most)
    assert got == want
    assert len(want) > 9


def test_many_blocks_and_ranges(spark):
    rows = texts(5, 900)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(24)
    got = sorted(tuple(r) for r in P.collocations(df, least=4, most=None).collect())
    assert got == brute(rows, 4, 5, None)


def test_wide_numbers_sort_and_count():
    """Dictionaries of more than 65,535 words take three bytes a number or more."""
    rng = np.random.default_rng(1)
    g = rng.integers(1, 1 << 20, 3000) * (rng.random(3000) > 0.1)
    g[100:200] = g[300:400]
    at, keys = P._pairs(g, 3)
    distinct, counts, which = P.runs(keys)
    want = Counter((int(a), int(b)) for a, b in zip(g[:-1], g[1:], strict=True) if a and b)
    assert counts.sum() == len(at) == sum(want.values())
    assert sorted(counts.tolist()) == sorted(want.values())
    assert (distinct[which] == keys).all()
    assert P.held_in(keys, distinct[counts > 1]).sum() == sum(c for c in want.values() if c > 1)
    assert (np.diff(P.prefixes(distinct)) >= 0).all()


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert P.collocations(none).count() == 0
    assert P.collocations(none).dtypes == [tuple(c.replace("long", "bigint").split()) for c in P.RESULT.split(", ")]
    odd = spark.createDataFrame([("en", "a b " * 50, 1, 2, 3)], "lang string, text string, block int, word int, n int")
    assert [tuple(r) for r in P.collocations(odd, least=10, longest=2).collect()] == brute([("en", "a b " * 50)], 10, 2, 2000)
    assert P.collocations(odd, least=1000).count() == 0
