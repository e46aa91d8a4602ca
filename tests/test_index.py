"""Ranking over a written index against ranking over texts."""

import pytest

from recollect.operators import retrieval as R

DOCS = [(i, " ".join(w for j, w in enumerate(("the", "cache", "policy", "for", "query", "plans", "naïve", "记忆检索")) if (i * 7 + j * 3) % 5 < 2) or None) for i in range(200)] + [(900, ""), (901, None), (902, "the the the cache")]


@pytest.mark.parametrize("most", [10_000, 2])
def test_an_index_ranks_as_its_texts_do(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(R, "SMALL", most)
    docs = spark.createDataFrame(DOCS, "id long, text string")
    asked = spark.createDataFrame([(1, "the cache"), (2, "policy policy query"), (3, "记忆"), (4, "unknown"), (5, "")], "query_id long, query string")
    R.write_index(docs, f"file://{tmp_path}/index")
    index = R.read_index(spark, f"file://{tmp_path}/index")
    show = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert index["lengths"].count() == len(DOCS)
    whole = show(R.bm25(docs, asked))
    assert show(R.bm25(docs, asked, index=index)) == whole and len(whole) > 60
    some = docs.where("id % 3 <> 0")
    assert show(R.bm25(some, asked, index=index)) == show(R.bm25(some, asked))
