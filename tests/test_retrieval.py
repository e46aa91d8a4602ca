import math
import random
from collections import Counter

from pyspark.sql import functions as F

from recollect.operators import admin as A
from recollect.operators import consolidate as K
from recollect.operators import lifecycle as L
from recollect.operators import retrieval as R


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bm25_matches_formula(spark):
    texts = {1: "dark mode dark", 2: "light mode", 3: "", 4: "unrelated words here"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r["id"]: r["score"] for r in R.bm25(docs, spark.createDataFrame([(1, "dark mode mode")], "query_id long, query string")).collect()}
    toks = {i: t.split() for i, t in texts.items()}
    avg = sum(map(len, toks.values())) / 4
    for i, ts in toks.items():
        tf = Counter(ts)
        want = 0.0
        for q in ("dark", "mode", "mode"):
            df = sum(q in x for x in toks.values())
            want += math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf[q] * 2.2 / (tf[q] + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        assert (round(want, 6) == got.get(i, 0)) or abs(want - got[i]) < 1e-5


def test_fusion_prefers_consensus(spark):
    lists = [spark.createDataFrame([(1, ord(c), i + 1) for i, c in enumerate(x)], "query_id long, id long, rank int") for x in ("ABC", "BDA")]
    order = [chr(r["id"]) for r in R.fuse(lists).orderBy("rank").collect()]
    assert order[0] == "B" and order.index("A") < order.index("D")


def test_trim_skips_and_goes_on(spark):
    big, small = "x" * 4000, "y" * 40
    df = spark.createDataFrame([(1, 1, "raw", 1, big), (1, 2, "raw", 2, small), (1, 3, "observation", 3, small)], "query_id long, id long, layer string, rank int, statement string")
    assert rows(R.trim(df, 1000), "id") == [(2,), (3,)]


def test_spread_first_writer_wins(spark):
    seeds = spark.createDataFrame([(1, 1, 1.0, 1), (1, 2, 0.9, 2)], "query_id long, id long, score double, rank int")
    edges = spark.createDataFrame([(1, 3, 0.5, 1), (2, 3, 1.0, 2), (3, 4, 1.0, 3), (4, 5, 0.1, 4)], "src long, dst long, weight double, ord long")
    assert rows(R.spread(seeds, edges), "id", "score", "round") == [(1, 1.0, 0), (2, 0.9, 0), (3, 0.35, 1), (4, 0.245, 2)]


def test_temporal_edges_match_brute_force(spark):
    rng = random.Random(5)
    at = {i: rng.randrange(0, 100_000) for i in range(120)}
    df = spark.createDataFrame(list(at.items()), "id long, s long").select("id", F.timestamp_seconds("s").alias("learned_at"))
    got = rows(R.temporal_edges(df), "src", "dst")
    assert got == sorted((a, b) for a in at for b in at if a < b and abs(at[a] - at[b]) <= 7200)


def test_greedy_clusters_match_fold(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    owner: dict[int, int] = {}
    for i in range(40):
        if i not in owner:
            owner[i] = i
            for a, b in pairs:
                for x, y in ((a, b), (b, a)):
                    if x == i and y not in owner:
                        owner[y] = i
    got = K.greedy_clusters(spark.range(40), spark.createDataFrame(list(pairs), "a long, b long"))
    assert rows(got, "id", "seed") == sorted(owner.items())


def test_feedback_is_folded_in_order(spark):
    log = [(1, i, i, s) for i, s in enumerate(["positive"] * 6 + ["negative"])]
    df = spark.createDataFrame(log, "memory_id long, ts long, ord long, signal string")
    r = L.feedback_fold(df).first()
    assert (r["storage"], r["strength"], r["confidence"]) == (0.85, 0.7, 9)


def test_dedup_actions(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c"), (4, None)], "id long, text string")
    got = {r["id"]: (r["action"], r["target"]) for r in L.dedup_actions(df).collect()}
    assert got[1] == ("ADD", 1) and got[2] == ("SKIP", 1) and got[3] == ("ADD", 3)


def test_three_way_merge_rules(spark):
    t = lambda d: spark.createDataFrame(list(d.items()), "id long, value string")
    got = A.three_way_merge(t({1: "a", 2: "theirs", 4: "new"}), t({1: "ours", 2: "b", 5: "mine"}), t({1: "a", 2: "b", 3: "c"}))
    assert rows(got, "id", "value") == [(1, "ours"), (2, "theirs"), (4, "new"), (5, "mine")]


def test_learning_keeps_first_of_equal_statements(spark):
    df = spark.createDataFrame([(1, "remember that the port is 8443"), (2, "hi"), (3, None), (4, "")], "id long, text string")
    got = [(r["id"], r["rule"], r["statement"]) for r in L.candidates(df, ["id"]).orderBy("rule_ord").collect()]
    assert got == [(1, "remember", "the port is 8443")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "id long, text string")
    q = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    assert R.bm25(docs, q).count() == 0
    assert R.temporal_edges(spark.createDataFrame([], "id long, learned_at timestamp")).count() == 0
    assert K.greedy_clusters(docs.select("id"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_time_pairs_meet_from_one_side_and_keep_their_digits(spark):
    """All pairs once, whatever their order in time; halves of the sixth digit as round() has them; the join makes few rows that are too far apart."""
    import re

    from pyspark.sql import functions as F

    at = {i: (i * 7919 % 5000) * 1_800 + (i % 3) * 1_000_000_000 for i in range(160)} | {500: 0, 501: 0, 502: 7_200_000_000, 503: 7_200_000_001, 504: -1, 505: 3_600}
    df = spark.createDataFrame(list(at.items()), "id long, us long").select("id", F.timestamp_micros("us").alias("learned_at"))
    plain = df.join(df.select(F.col("id").alias("dst"), F.col("learned_at").alias("u"))).where("id < dst").withColumn("apart", F.abs(F.unix_micros("learned_at") - F.unix_micros("u")))
    plain = plain.where("apart <= 7200000000").select("id", "dst", F.round(1 - F.col("apart") / 7_200_000_000, 6))
    got = R.temporal_edges(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    wide = spark.range(4000).select("id", F.timestamp_micros(F.col("id") * 60_000_000).alias("learned_at"))
    joined = R.temporal_edges(wide)._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].splitlines()[0]
    assert re.search(r"t1#\d+L < t#\d+L", joined)
    assert R.temporal_edges(wide).count() == sum(min(120, 3999 - i) for i in range(4000))
