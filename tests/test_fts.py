"""The full-text grammar, and searches by index and by scan against plain Python."""

import math
import random

import numpy as np
import pytest

from recollect.functions.fts import parse
from recollect.operators import retrieval as R

CASES = {
    "abc def": "need 0,1", "abc OR def": "need 0 | need 1", "abc NOT def": "need 0 without 1", "abc AND def OR ghi": "need 0,1 | need 2", "abc OR def ghi": "need 0 | need 1,2",
    "abc NOT def ghi": "need 0 without 1 | need 0 without 2", '"ab c" xyz': "need 0,1", "ab": "", "ab xyz": "need 0", "ab AND xyz": "", "ab OR xyz": "need 0", "xyz NOT ab": "need 0", "ab NOT xyz": "",
    "(abc OR def) AND ghi": "need 0,2 | need 1,2", "abc NOT (def OR ghi)": "need 0 without 1,2", "abc NOT (def NOT ghi)": "need 0 without 1 | need 0,2", "abc*": "need 0", "": "", "and or not": "need 0,1", "日本語 のテスト": "need 0,1",
}


@pytest.mark.parametrize("query", CASES)
def test_ways(query):
    terms, ways = parse(query)
    shown = lambda w: "need " + ",".join(map(str, sorted(w[0]))) + (" without " + ",".join(map(str, sorted(w[1]))) if w[1] else "")
    assert " | ".join(map(shown, ways)) == CASES[query]
    assert all(len(t) >= 3 for t in terms)


@pytest.mark.parametrize("query", ["it's", "a-b", "v1.2", "abc AND", "OR abc", "(abc", "abc)", "abc (def)", "(abc) def", 'abc "def', "abc NOT", "title:abc", "abc + def"])
def test_no_queries(query):
    assert parse(query) is None


DOCS = [(1, "The quick Brown fox"), (2, "brown bread and butter"), (3, "a fox, a fox! and 'brown'"), (4, None), (5, "naïve Übung über alles"), (6, "quick quick quick"), (7, ""), (5000, "brown fox far away"), (9000, "x" * 50)]
QUERIES = ["brown fox", "quick OR butter", "fox NOT quick", '"brown fox"', "BROWN", "it's", "ab", "übung", "nowhere", "fox NOT (quick OR away)", "xxx", "bro AND own", '"fox, a"']


def brute(k=30):
    texts = [(i, (t or "").lower()) for i, t in DOCS]
    sizes = {i: max(0, len(t) - 2) for i, t in texts}
    mean, out = sum(sizes.values()) / len(texts), []
    for q, query in enumerate(QUERIES, 1):
        got = parse(query)
        if got is None:
            continue
        terms, ways = [t.lower() for t in got[0]], got[1]
        df = {t: sum(t in x for _, x in texts) for t in terms}
        rows = []
        for i, x in texts:
            has = {j for j, t in enumerate(terms) if t in x}
            if any(n <= has and not w & has for n, w in ways):
                score = sum(max(1e-6, math.log((len(texts) - df[t] + 0.5) / (df[t] + 0.5))) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) for j, t in enumerate(terms) if j in has)
                rows.append((-round(score, 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("indexed", [False, True])
def test_searches_are_those_of_plain_python(spark, tmp_path, indexed):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    asked = spark.createDataFrame(list(enumerate(QUERIES, 1)), "query_id long, query string")
    trigrams = None
    if indexed:
        R.write_trigrams(docs, f"file://{tmp_path}/index", ["text"])
        trigrams = R.read_trigrams(spark, f"file://{tmp_path}/index")
        docs = None
    got = sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in R.fts_search(docs, asked, ["text"], trigrams=trigrams).collect())
    want = brute()
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))


def test_an_index_of_trigrams_shuffles_texts_and_lists_only(spark, tmp_path):
    rng = random.Random(3)
    signs = "abcdefgh \n\u00e9\u4e2d\U0001f600"
    texts = [(i * 37, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 300)))) for i in range(300)]
    texts += [(74, "a second text of one id"), (None, "a text without id"), (111111, None)]
    store, jvm = spark._jsc.sc().statusStore(), spark._jvm
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    old = {stages().apply(i).stageId() for i in range(stages().size())}
    R.write_trigrams(spark.createDataFrame(texts, "id long, text string"), f"file://{tmp_path}/index", ["text"], 2)
    got, held = R.read_trigrams(spark, f"file://{tmp_path}/index")["grams"].collect(), {}
    for i, t in texts:
        for at in range(len(t or "") - 2) if i is not None else ():
            held.setdefault((t.lower()[at : at + 3], i // R.IDS), set()).add(i)
    assert {(r["gram"], r["block"]): r["ids"] for r in got} == {k: sorted(v) for k, v in held.items()} and len(got) == len(held)
    new = [x for x in (stages().apply(i) for i in range(stages().size())) if x.stageId() not in old]
    assert 0 < sum(x.shuffleWriteRecords() for x in new) < 3 * len(texts) + 2 * len(held)
    assert sum(map(len, held.values())) > 3 * len(texts) + 2 * len(held)


def test_trigrams_of_more_signs_than_a_number_holds():
    texts = ["".join(map(chr, range(0x10000 + i * 60000, 0x10000 + i * 60000 + 60000))) for i in range(16)] * 5
    gram, of = R._grams(texts)
    assert len(gram) == 80 * 59998 and np.bincount(of).tolist() == [59998] * 80
    assert gram.min() == 0x10000 << 42 | 0x10001 << 21 | 0x10002


def test_no_text_is_read_for_what_the_index_lacks(spark, tmp_path):
    R.write_trigrams(spark.createDataFrame(DOCS, "id long, text string"), f"file://{tmp_path}/index", ["text"])
    trigrams = R.read_trigrams(spark, f"file://{tmp_path}/index")
    trigrams["texts"] = trigrams["texts"].selectExpr("raise_error('a text was read') AS id", "len", "all", "block")
    asked = spark.createDataFrame([(1, "nowhere"), (2, "zzzz OR qqqq")], "query_id long, query string")
    assert R.fts_search(None, asked, trigrams=trigrams).count() == 0


def test_recall_tries_full_text_first(spark):
    m = spark.createDataFrame([(1, "deploy-script needs care", "active"), (2, "deploy the script", "active"), (3, "deploy-script gone", "retired")], "id long, text string, status string")
    cols = "cast(null as string) as scope", "cast(null as string) as domain", "array('x') as tags", "'raw' as layer", "text as statement", "timestamp'2024-01-01' as learned_at", "0.5D as strength", "1L as frequency", "1L as turns", "1L as proof", "0L as evidence", "0L as sources", "5L as confidence", "'do' as polarity", "false as consolidated", "0L as positive", "0L as negative", "0L as adopted"
    m = m.selectExpr("*", *cols)
    bridge, edges = spark.createDataFrame([], "memory_id long, entity string"), spark.createDataFrame([], "src long, dst long, type string, weight double")
    q = spark.createDataFrame([(1, "eploy-scr"), (2, '"eploy-scr"'), (3, "the care"), (4, "script")], "query_id long, query string")
    got = R.recall(q, m, bridge, edges)["bm25"].collect()
    by = {i: sorted(r["id"] for r in got if r["query_id"] == i) for i in range(1, 5)}
    assert by == {1: [], 2: [1, 3], 3: [1, 2], 4: [1, 2, 3]}
