"""Vector codes against Lloyd's algorithm in plain integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from recollect.llm import codes as K


def brute(rows: list[tuple], rounds: int = 6) -> tuple[list[tuple], list]:
    """(key, code, error) of rows (key, vector, label), and the codebooks, one integer after the other."""
    kept = [(k, [math.floor(4096 * x) if abs(x) < 2**40 else int(x) * 4096 for x in v], lab) for k, v, lab in rows if v and len(v) % 8 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 8
    kept = [r for r in kept if len(r[1]) == 8 * w]
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(r[1], p) for r in kept[:16]] for p in range(8)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda j: (away(part(v, p), books[p][j]), j))
    for _ in range(rounds):
        new = []
        for p in range(8):
            mine = [[] for _ in books[p]]
            for r in kept:
                mine[near(r[1], p)].append(part(r[1], p))
            new.append([[sum(c) // len(m) for c in zip(*m, strict=True)] if m else books[p][j] for j, m in enumerate(mine)])
        books = new
    out = []
    for k, v, lab in kept:
        e = [near(v, p) for p in range(8)]
        out.append((k, "".join(f"{j:02x}" for j in e), sum(away(part(v, p), books[p][e[p]]) for p in range(8)), lab))
    return out, books


def tables(kind: str) -> list[tuple]:
    rng = np.random.default_rng(7)
    f = lambda a: [[float(np.float32(x)) for x in v] for v in a]
    if kind == "clustered":
        centres = rng.normal(size=(6, 16))
        v = f(centres[rng.integers(0, 6, 500)] + rng.normal(scale=0.02, size=(500, 16)))
    elif kind == "ties":
        v = f(rng.integers(-2, 3, (400, 16)) / 4096)
    elif kind == "wild":
        v = f(rng.normal(size=(60, 8)))
        v[3][2], v[20][5], v[40][0] = float(np.float32(1e30)), float(np.float32(-3e38)), 2.0**45
    else:
        v = f(rng.normal(size=(30, 24)))
    return [(i * 7 % len(v), x, i % 3 if i % 5 else None) for i, x in enumerate(v)]


@pytest.mark.parametrize("kind", ["clustered", "ties", "wild", "few"])
def test_codes_are_those_of_plain_lloyd(spark, kind):
    rows = tables(kind)[: 9 if kind == "few" else None]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    want, books = brute(rows)
    got = {r["vec_id"]: r for r in K.compress(df).collect()}
    assert len(got) == len(want)
    labels = {}
    for _, _, e, lab in want:
        labels[lab] = labels.get(lab, 0) + e
    for k, code, e, lab in want:
        fits = e < 2**63
        assert (got[k]["code"], got[k]["error"]) == (code, e if fits else None)
        if labels[lab] < 2**63:
            assert got[k]["label_error"] == labels[lab]
        assert got[k]["codebooks_sha256"] == K.digest(books)


def test_subtrees_are_assigned_whole():
    points = K.whole(np.array([r[1][:8] for r in tables("clustered")]))
    tree = K.tree_of(points)
    book = points[::40][:12]
    entry, sums, counts, cheap = K.walk(tree, book)
    want = ((tree["points"][:, None].astype(np.int64) - book) ** 2).sum(axis=2).argmin(axis=1)
    assert (entry == want).all()
    assert cheap > len(points) / 3
    for j in range(len(book)):
        assert counts[j] == (want == j).sum()
        assert (sums[j] == tree["points"][want == j].sum(axis=0)).all()


def test_odd_rows(spark):
    good = [(i, [float(i % 4)] * 8, i % 2) for i in range(20)]
    odd = [(100, None, 1), (101, [], 1), (102, [1.0, None] * 4, 0), (103, [float("nan")] * 8, 0), (104, [float("inf")] * 8, None), (105, [1.0] * 7, 1), (106, [1.0] * 16, 1)]
    again = [(3, [3.0] * 8, 1), (None, [2.0] * 8, None)]
    schema = "vec_id long, embedding array<double>, label int, code string, rows int"
    df = spark.createDataFrame([(*r, "x", 1) for r in [*good, *odd, *again]], schema)
    got = K.compress(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in [*good, *again])
    assert {r["code"] for r in got if r["vec_id"] == 3} == {next(r["code"] for r in got if r["vec_id"] == 7)}
    assert all(r["error"] == 0 for r in got)
    assert K.compress(df.limit(0)).count() == 0
    assert K.compress(df.where("vec_id > 99")).count() == 1  # the first of its length says how long vectors are


def test_codes_decode_to_their_entries(spark):
    rows = tables("clustered")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    _, books = K.fitted(df, carry=["label"])
    got = K.decoded(K.compress(df), books).collect()
    at = dict((r[0], r[1]) for r in rows)
    for r in got:
        away = sum((math.floor(4096 * x) - y * 4096) ** 2 for x, y in zip(at[r["vec_id"]], r["decoded"], strict=True))
        assert round(away) == r["error"]
