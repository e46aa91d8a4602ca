import random

import numpy as np

from recollect.operators import consolidate as K
from recollect.plans.queries import QUERIES


def fold(vectors, least):
    """Greedy clusters in id order, pair by pair."""
    owner = {}
    for i in sorted(vectors):
        if i not in owner:
            owner[i] = i
            for j in sorted(vectors):
                if j not in owner and vectors[i] is not None and vectors[j] is not None and round(float(np.dot(vectors[i], vectors[j])), 6) >= least:
                    owner[j] = i
    return sorted(owner.items())


def test_vector_clusters_match_fold(spark):
    rng = random.Random(7)
    rows = {i: [float(x) for x in np.array(v) / np.linalg.norm(v)] for i, v in ((i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(1, 301))}
    rows |= {i: rows[1] for i in range(400, 440)} | {500: [0.0] * 6, 501: [0.0] * 6, 502: None, 503: None}
    df = spark.createDataFrame(list(rows.items()), "id long, embedding array<double>")
    for least, chunk in ((0.6, 16), (0.9, 50)):
        got = K.vector_clusters(df, least, chunk).collect()
        assert sorted((r["id"], r["seed"]) for r in got) == fold(rows, least)
    assert K.vector_clusters(df.where("id < 0"), 0.5).count() == 0


def test_every_vector_looks_for_its_seed(spark):
    got = QUERIES["greedy_clusters"](spark, "/root/testdata/sf0.001").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    assert sorted((r["id"], r["seed"]) for r in got) == fold(vectors, 0.35)


def test_links_of_a_large_cluster_are_dealt(spark):
    """All pairs of each cluster once either way, from many tasks."""
    df = spark.createDataFrame([(i, 0) for i in range(3500)] + [(i, 1) for i in range(4000, 4003)] + [(5000, 2)], "id long, seed long")
    links = K.evolution_links(df)
    assert links.count() == links.select("src", "dst").distinct().count() == 3500 * 3499 + 3 * 2
    assert links.where("(src < 4000) <> (dst < 4000) or src = dst").isEmpty()
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert any(" i#" in x and " j#" in x or "(i#" in x and "(j#" in x for x in plan.splitlines() if "Join Inner" in x)
