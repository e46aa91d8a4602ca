import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import common as C
from recollect.llm import minhash
from recollect.llm.minhash import near_duplicates
from recollect.llm.substrings import COVERS, cover_of, dedup_substrings

DOCS = "doc_id long, text string, score double, kept string, component_id string, chunk int"


def frame(spark, texts, ids=None):
    """Documents with further columns whose names clash with those of results."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 0.5, "x", "y", 7) for i, t in zip(ids, texts, strict=True)], DOCS)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    out = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 90))]
        if i % 4 == 0:
            t = t[:20] + passage[: rng.randrange(10, 40)] + t[20:]
        if i % 5 == 1 and out:
            t = rng.choice(out).split()
            for _ in range(rng.randrange(3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out + ["", "  \n\t ", None, "one", "One", "a b c", "a b c", " ".join(["x"] * 500), "é ü 漢字 a b c d"]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t, k):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", lowered(t)) if x]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return sets, label


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, k):
    texts = corpus(k)
    got = {r["doc_id"]: r for r in near_duplicates(frame(spark, texts), k=k, small_bucket=2, block=2).collect()}
    sets, label = brute_components(texts, k, 80)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), label[i], label[i] == i)


def test_near_duplicates_of_a_gradual_group(spark):
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(40):  # each differs from the base in more and more words
        t = list(base)
        for j in range(i // 4):
            t[(j * 37 + i) % 120] = f"x{i}-{j}"
        texts.append(" ".join(t))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, texts), k=4, small_bucket=3, block=4).collect()}
    assert [got[i] for i in range(40)] == brute_components(texts, 4, 80)[1]


def test_texts_are_not_shuffled_to_find_those_of_candidates(spark):
    rows = spark.range(-10000, 10000, 1, 8).selectExpr("nullif(id, 77) AS doc_id", "repeat('text ', 5) || id AS text")
    ids = spark.range(-9000, 9000, 90).selectExpr("id AS rep")
    got, wanted = {r["doc_id"] for r in minhash._likely(rows, "doc_id", ids.toDF("doc_id")).collect()}, set(range(-9000, 9000, 90))
    assert wanted <= got and len(got) < 220 and None not in got
    sig = rows.mapInArrow(minhash._sign(4), minhash.SIGNATURE).select("doc_id", "class").join(ids, F.expr("doc_id = rep")).cache()
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        sets = minhash._sets_of(rows, sig, 4)
        assert "hashpartitioning(doc_id" not in sets._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
        assert {r["class"] for r in sets.collect()} == {r["class"] for r in sig.collect()}
    finally:
        spark.conf.set(threshold, before)
        sig.unpersist()


def test_near_duplicates_with_null_and_repeated_ids(spark):
    texts = ["a b c d e f", "a b c d e f", "a b c d e f", "q r s t u v", "a b c d e f"]
    rows = near_duplicates(frame(spark, texts, [5, 5, None, 5, 9])).collect()
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in rows), key=repr)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, None, None), (5, 5, True), (9, 5, False)], key=repr)


def test_empty_table(spark):
    empty = frame(spark, [])
    assert near_duplicates(empty).count() == 0 and dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("period", list(COVERS))
def test_covers_are_difference_covers(period):
    d = COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


def brute_cut(texts, ids, n):
    words = [[w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w] for t in texts]
    least = {}
    for i, w in zip(ids, words, strict=True):
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = {p for s in range(len(w) - n + 1) if least[tuple(w[s : s + n])] < i for p in range(s, s + n)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n", [3, 13, 25])
def test_substring_dedup_matches_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(C, "chunk_count", lambda docs, chunk_mb=8: 5)
    texts = corpus(n + 1)
    ids = list(range(100, 100 + len(texts)))
    ids[3] = ids[2]  # a repeated id
    random.Random(1).shuffle(ids)
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in dedup_substrings(frame(spark, texts, ids), window=n).collect())
    assert got == sorted(brute_cut(texts, ids, n))
    assert cover_of(n)[0] <= max(3, n)


def test_substring_dedup_carries_columns_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(20))
    rows = dedup_substrings(frame(spark, [t, t, None], [None, 4, 6]), carry=["score", "kept"], with_text=True).select("*", "carried.*").collect()
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"], r["score"]) for r in rows}
    assert got == {None: (20, "", 0.5), 4: (0, t, 0.5), 6: (0, None, 0.5)}


def test_packed_keys_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert np.array_equal(C.unpack(C.pack(keys)), keys)
    assert len(C.unpack(C.pack(keys[:0]))) == 0


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == label


def test_words_are_split_as_the_pattern_says():
    import re

    texts = ["a b c d", "\x1c\x1d x\x0by\x0cz", "", None, "é\tü"]
    _, first = C.word_hashes(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]
    assert F is not None


def thue_morse(n):
    """Two different words of n letters whose prefix sums under any polynomial hash modulo 2**64 agree."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_defeat_polynomial_hashes_stay_apart(spark):
    x, y = thue_morse(4096)
    plain, first = C.word_hashes(pa.array([x, y, x]))
    assert plain[0] != plain[1] and plain[0] == plain[2] and first.tolist() == [0, 1, 2, 3]
    rows = near_duplicates(frame(spark, [f"{x} {x} {x} {x} {x}", f"{y} {y} {y} {y} {y}"]), k=4).collect()
    assert all(r["component_id"] == r["doc_id"] for r in rows)
    out = dedup_substrings(frame(spark, [" ".join([x] * 13), " ".join([y] * 13), " ".join([x] * 13)]), window=13).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {0: 0, 1: 0, 2: 13}
