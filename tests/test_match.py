"""The best observation of each cluster against a comparison of all pairs."""

import random

import pytest

from recollect.operators import consolidate as K

WORDS = [f"w{i}" for i in range(40)]


def best(clusters, observations, linked, least):
    out = {}
    for seed, scope, domain, text, tags, names in clusters:
        for oid, s2, d2, t2, g2, n2 in observations:
            a, b = set((text or "").split()), set((t2 or "").split())
            if (scope or "global", domain or "general") != (s2 or "global", d2 or "general") or (seed, oid) in linked:
                continue
            common = lambda x, y: bool(({*(x or [])} - {None}) & {*(y or [])})
            score = round((len(a & b) / len(a | b) if a and b else 0.0) + (0.35 if common(names, n2) else 0.0) + (0.15 if common(tags, g2) else 0.0), 6)
            if score >= least and (seed not in out or (score, -oid) > (out[seed][0], -out[seed][1])):
                out[seed] = (score, oid)
    return sorted((seed, oid, score) for seed, (score, oid) in out.items())


@pytest.mark.parametrize(("chars", "tile"), [(64_000_000, 2048), (30_000, 7)])
def test_blocks_give_the_best_of_all_pairs(spark, monkeypatch, chars, tile):
    for name, value in (("CHARS", chars), ("TILE", tile), ("SLICE", 2 * tile)):
        monkeypatch.setattr(K, name, value)
    rng = random.Random(5)
    row = lambda i: (i, rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice([None, "", *(" ".join(rng.sample(WORDS, rng.randint(1, 12))) for _ in range(8))]), rng.choice([None, [], ["t1"], ["t2", None]]), rng.choice([None, [], ["e1"], ["e2", "e3"]]))
    clusters, observations = [row(i) for i in range(150)], [row(1000 + i) for i in range(120)]
    observations += [(5000 + i, *observations[i][1:]) for i in range(20)]  # equals go to the earlier one
    linked = {(i, 1000 + j) for i in range(150) for j in range(120) if (i * 7 + j) % 5 == 0}
    shape = "long, scope string, domain string, statement string, tags array<string>, entities array<string>"
    c = spark.createDataFrame(clusters, f"seed {shape}")
    o = spark.createDataFrame([(*r, "active") for r in observations], f"id {shape}, status string")
    for known in (linked, set()):
        table = spark.createDataFrame(sorted(known), "seed long, observation long") if known else None
        got = K.match_observations(c, o, linked=table)
        assert sorted(tuple(r) for r in got.collect()) == best(clusters, observations, known, 0.35)
    assert K.match_observations(c.limit(0), o).count() == 0 and K.match_observations(c, o.limit(0)).count() == 0


def test_no_row_of_a_pair_leaves_a_block():
    """400 clusters that all share a word with 100 observations leave a row each, not 40,000 pairs."""
    import pyarrow as pa

    words = lambda name, n, held: pa.table({name: pa.array(range(n), pa.int64()), **{k: pa.array([v] * n, pa.list_(pa.string())) for k, v in held.items()}})
    left = words("seed", 400, {"cw": ["one", "two"], "ce": [], "ct": ["t"]}).append_column("held", pa.array([[]] * 400, pa.list_(pa.int64())))
    right = words("observation", 100, {"ow": ["one", "three"], "oe": [], "ot": ["t"]})
    got = K._best(0.35)(left, right).to_pylist()
    assert len(got) == 400 and {(r["observation"], round(r["score"], 6)) for r in got} == {(0, 0.483333)}
