"""The vector index against a comparison with all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import retrieval as R
from recollect.operators import vectors as V


def vectors(kind):
    rng = np.random.default_rng(2)
    if kind == "clustered":
        c = rng.normal(size=(20, 16))
        m = c[rng.integers(0, 20, 800)] + rng.normal(scale=0.1, size=(800, 16))
    else:
        m = rng.normal(size=(300, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]


@pytest.mark.parametrize("kind", ["clustered", "even"])
@pytest.mark.parametrize(("least", "k"), [(0.5, 30), (0.2, 7)])
def test_rows_are_those_of_all_vectors(spark, tmp_path, kind, least, k):
    df = spark.createDataFrame([*vectors(kind), (9001, None), (9002, [0.0] * 16)], "id long, embedding array<float>")
    q = df.where("id % 40 = 0").select(F.col("id").alias("query_id"), "embedding")
    V.write_cells(df, f"file://{tmp_path}/index")
    index = V.read_cells(spark, f"file://{tmp_path}/index")
    assert index["vectors"].count() == df.count()
    out = V.search_cells(index, q, least, k, probes=2)
    show = lambda d: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in d.collect())
    assert show(out["rows"]) == show(R.semantic(df, q, least, k))
    audit = out["audit"].collect()
    assert len(audit) == q.count() and all(0 <= r["recall"] <= 1 and r["probed"] <= r["read"] <= r["cells"] for r in audit)
    if kind == "clustered":
        assert sum(r["read"] for r in audit) < 0.5 * sum(r["cells"] for r in audit)


def test_empty_and_single(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    V.write_cells(df, f"file://{tmp_path}/one")
    out = V.search_cells(V.read_cells(spark, f"file://{tmp_path}/one"), df.withColumnRenamed("id", "query_id"))
    assert [tuple(r) for r in out["rows"].collect()] == [(1, 1, 1.0, 1)] and out["audit"].first()["recall"] == 1.0


def test_compared_gives_the_pairs_of_all_vectors(spark, monkeypatch):
    """In packs: the sums' order, nulls, lengths and the least value as X.dot has them; nothing is sent to all tasks beyond few packs."""
    from recollect.functions import exprs as X

    monkeypatch.setattr(V, "PACK", 7)
    rows = [*vectors("even")[:120], (500, None), (501, [0.0] * 16), (502, [1.0, None]), (503, [0.6, 0.8]), (504, [1.0, 0.0]), (505, [])]
    rows += [(600 + i, rows[0][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    q = df.where("id % 10 = 0 or id > 500").select(F.col("id").alias("query_id"), "embedding")
    plain = df.join(q.withColumnRenamed("embedding", "q")).select("query_id", "id", X.dot(F.col("embedding"), F.col("q")).alias("product"))
    show = lambda d: sorted(map(tuple, d.where(F.round("product", 6) >= 0.3).collect()))
    assert show(V.compared(df, q, 0.3)) == show(plain)
    assert len(show(plain)) > 400


def test_many_equal_vectors_leave_k_rows_a_part(spark, tmp_path):
    m = vectors("even")[0][1]
    df = spark.createDataFrame([(i, m) for i in range(500)], "id long, embedding array<float>")
    V.write_cells(df, f"file://{tmp_path}/same")
    index = V.read_cells(spark, f"file://{tmp_path}/same")
    q = df.where("id < 3").withColumnRenamed("id", "query_id")
    pairs = q.crossJoin(index["cells"].select("cell")).select("query_id", "cell", F.lit(0.5).alias("least"))
    assert 21 <= V._scored(index, pairs, q, 7).count() <= 21 * index["cells"].count() < 1500
    assert sorted(r["id"] for r in V.search_cells(index, q, 0.5, 7)["rows"].where("query_id = 1").collect()) == list(range(7))
