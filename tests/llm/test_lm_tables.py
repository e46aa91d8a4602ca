import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import common as C
from recollect.llm import hpylm


def chances(c, most, d, weight):
    """p(t) ~ S_d(c, t) weight**t for t from 0 to most, by the recurrence of the Stirling numbers."""
    t, log = np.arange(most + 1), np.where(np.arange(most + 1) == 0, 0.0, -np.inf)
    with np.errstate(divide="ignore"):
        for n in range(c):
            log = np.logaddexp(np.log(np.maximum(n - t * d, 0)) + log, np.concatenate(([-np.inf], log[:-1])))
    p = np.exp(log + t * np.log(weight) - (log + t * np.log(weight)).max())
    return p / p.sum()


@pytest.mark.parametrize("c,d,weight", [(2, 0.5, 0.3), (40, 0.3, 2.0), (1000, 0.6, 0.01), (1000, 0.6, 5.0), (3000, 0.9, 0.5), (10_000, 0.4, 30.0)])
def test_drawn_tables_have_their_exact_distribution(c, d, weight):
    p = chances(c, min(c, 3000), d, weight)
    t = np.arange(len(p))
    mean, sd = (p * t).sum(), np.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
    w = np.full(1500, weight)
    x = hpylm.Tables(np.full(1500, c), d, w, np.random.default_rng(1))
    for _ in range(20):
        x.draw(w)
    assert ((x.t >= 1) & (x.t <= c)).all()
    assert abs(x.t.mean() - mean) < 5 * sd / np.sqrt(1500) and abs(x.t.std() / max(sd, 1e-9) - 1) < 0.12


def test_draws_agree_with_moves_of_single_customers():
    rng, c, d, weight = np.random.default_rng(2), 30, 0.5, 0.8
    s = hpylm.Seating(np.full(800, c), d, 0.0, rng)
    at = np.arange(800)
    for _ in range(1500):
        s.leave(at)
        s.enter(at, np.full(800, weight / d), np.ones(800))
    x = hpylm.Tables(np.full(800, c), d, np.full(800, weight), rng)
    x.draw(np.full(800, weight))
    assert abs(s.t.mean() - x.t.mean()) < 5 * np.sqrt((s.t.var() + x.t.var()) / 800)


def whole_model(count, n=40, d=0.6):
    """Totals of n equally frequent words of one context, settled as lm_scores settles them."""
    word, context, count = np.arange(n), np.zeros(n, np.int64), np.full(n, count)
    held = lambda v: np.bincount([0], weights=[v], minlength=hpylm.CONTEXTS)
    totals = hpylm.Totals(held(count.sum()), held(1.1 * n), float(n), n, int(count.sum()), d, 0.5)
    for _ in range(2):
        _, tables, root_tables, root, sent = hpylm._sampled(word, context, count, n, totals, 10, 2, 2, 1)
        ahead, above = hpylm.foretell(word, context, count, totals, root, sent)
        tables = held(hpylm.settled(totals.tables[0], tables[0], ahead[:, 0], d, 1.0))
        totals = hpylm.Totals(totals.customers, tables, hpylm.settled(totals.root_tables, root_tables, above, 0.5, 1.0), n, totals.tokens, d, 0.5)
    return word, context, count, totals


@pytest.mark.parametrize("count", [10**3, 10**4])
def test_a_sweep_reaches_every_customer(count):
    word, context, counts, totals = whole_model(count)
    _, tables, _, root = hpylm.sample(word, context, counts, len(word), totals, 10, 10, 2, 1)
    w, most = totals.strength + totals.discount * totals.tables[0], min(count, 2500)
    p = chances(count, most, totals.discount, w * root.mean())
    assert abs(tables[0] / len(word) / (p * np.arange(most + 1)).sum() - 1) < 0.1
    assert abs(tables[0] / totals.tables[0] - 1) < 0.1  # the settled total reproduces itself


def test_frequent_words_are_counted_in_all_batches(spark):
    # "thin" is too rare in each long row to be a 4096th of it, but outnumbers "short" by far
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(9000)) + " thin thin") for i in range(150)] + [(900, "short " * 260)]
    rows += [(1000 + k, f"f{k} " * 280) for k in range(hpylm.TOP - 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    thin = C.word_hashes(pa.array(["thin", "short"]), C.LOWER)[0]
    for parts in (1, 40):
        got = hpylm.classes(docs.repartition(parts).select("text"))
        assert len(got.keys) == hpylm.TOP and thin[0] in got.keys and thin[1] not in got.keys


def test_what_the_language_model_shuffles_is_compressed(spark):
    rng = np.random.default_rng(7)
    words = np.array(["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(3000)])
    texts = [" ".join(words[np.minimum(rng.zipf(1.3, 400) - 1, 2999)]) for _ in range(400)]
    store, jvm = spark._jsc.sc().statusStore(), spark._jvm
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    old = {stages().apply(i).stageId() for i in range(stages().size())}
    got = hpylm.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") % 10 != 0).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == {(i, 401) for i in range(400)}
    new = [x for x in (stages().apply(i) for i in range(stages().size())) if x.stageId() not in old]
    moved = sum(x.shuffleWriteBytes() for x in new) / sum(map(len, texts))
    assert 0 < moved < 1.35
