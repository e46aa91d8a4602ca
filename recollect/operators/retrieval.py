"""Retrieval: ranked signals for batches of queries, their fusion, ranking and trimming.

Every function takes and returns DataFrames keyed by query_id, so one plan answers a whole
batch.  Ties end by the id, scores are rounded before they rank.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.functions import fts
from recollect.functions import rules as R
from recollect.sources.store import stored

K1, LENGTH_WEIGHT, RRF_K = 1.2, 0.75, 60


def ranked(scored: DataFrame, k: int | None, by: str = "query_id", score: str = "score") -> DataFrame:
    """rank 1, 2, ... within a query by falling score, then id; the first k of each."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "id")))
    return out.where(F.col("rank") <= k) if k else out


def document_frequency(docs: DataFrame) -> DataFrame:
    """(token, df): how many documents hold each token."""
    return X.exploded(docs.select("text"), F.array_distinct(X.tokens("text")), "token").groupBy("token").agg(F.count("*").alias("df"))


SMALL = 10_000


def is_small(rows: DataFrame, most: int = SMALL) -> bool:
    """Whether rows are few enough to send to every task; looks at `most` + 1 of them."""
    return rows.limit(most + 1).count() <= most


def near(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """rows, to be sent to every task if they are few; else they join as any others."""
    return F.broadcast(rows) if is_small(rows, most) else rows


def counted(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(id, dl, hits) of docs (id, text): length in tokens, and how often each token (of words, or any) stands in it."""
    held = docs.select("id", X.tokens("text").alias("ts")).select("id", "ts", F.size("ts").alias("dl"))
    if words is not None:
        held = held.select("id", "dl", F.filter("ts", lambda t: t.isin(words)).alias("ts"))
    one = F.transform(F.array_distinct("ts"), lambda t: F.struct(t.alias("token"), (F.size("ts") - F.size(F.array_remove("ts", t))).alias("tf")))
    return held.select("id", "dl", one.alias("hits"))


def write_index(docs: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes an index of docs (id, text): lengths by id, and postings in ranges of (token, id).

    A query's tokens lie in few row groups; a token that most documents hold is cut into ranges
    of its ids, as many as its postings fill.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = docs.select("id", X.tokens("text").alias("ts")).select("id", F.size("ts").alias("dl"), "ts")
    held = stored(held, "tokens")
    held.select("id", "dl").repartitionByRange(parts, "id").write.option("compression", "zstd").parquet(f"{path}/lengths")
    tf = held.select("id", "dl", F.explode("ts").alias("token")).groupBy("id", "dl", "token").agg(F.count("*").alias("tf"))
    tf.repartitionByRange(parts, "token", "id").sortWithinPartitions("token", "id").write.option("compression", "zstd").parquet(f"{path}/postings")


def read_index(spark, path: str) -> dict[str, DataFrame]:
    """postings (id, dl, token, tf) and lengths (id, dl)."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths")}


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 30, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """(query_id, id, score, rank) of docs (id, text) for queries (query_id, query).

    A token that a query repeats counts as often; empty documents count in the mean length.
    Texts are read once: each document leaves its length and how often it holds the queries'
    tokens, and all else follows from these.  Up to SMALL tokens are looked up in place, more by
    a join.  index: of `read_index`; then no text is read, and docs (id) only say which count.
    """
    wanted = queries.select("query_id", F.explode(X.tokens("query")).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    words = [r[0] for r in wanted.select("token").distinct().limit(SMALL + 1).collect()]
    few = len(words) <= SMALL
    if index is None:
        held = stored(counted(docs, words if few else None), "postings")
        found, sizes = held.select("id", "dl", F.explode("hits").alias("h")).select("id", "dl", "h.*"), held
    else:
        ids = docs.select("id")
        found = index["postings"].where(F.col("token").isin(words)) if few else index["postings"]
        found = found.join(ids, "id", "left_semi").select("id", "dl", "token", "tf")
        sizes = index["lengths"].join(ids, "id", "left_semi")
    if not few:
        found = found.join(wanted.select("token").distinct(), "token", "left_semi")
    size = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    df = found.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(size)).select("token", idf.alias("idf"), "avgdl")
    terms = near(stored(df.join(wanted, "token"), "terms"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * F.col("dl") / F.col("avgdl")))
    scores = found.join(terms, "token").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(scores.where("score > 0"), k)


PARSED = "query_id long, terms array<string>, ways array<struct<need:array<int>,without:array<int>>>"


def parsed(queries: DataFrame) -> DataFrame:
    """PARSED of those queries (query_id, query) that are of the full-text grammar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way = pa.struct([("need", pa.list_(pa.int32())), ("without", pa.list_(pa.int32()))])
        for batch in batches:
            rows = _parsed(zip(batch["query_id"].to_pylist(), batch["query"].to_pylist(), strict=True))
            ways = [[{"need": n, "without": w} for n, w in r[2]] for r in rows]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array(ways, pa.list_(way))], names=["query_id", "terms", "ways"])

    asked = queries.select(F.col("query_id").cast("long"), "query")
    few = asked.limit(SMALL + 1).collect()
    if len(few) <= SMALL:  # a batch that is sent to every task anyway
        return asked.sparkSession.createDataFrame(_parsed(map(tuple, few)), PARSED)
    return stored(asked.mapInArrow(run, PARSED), "parsed")


def _parsed(queries: Iterable[tuple[int, str | None]]) -> list[tuple]:
    return [(i, p[0], [(sorted(n), sorted(w)) for n, w in p[1]]) for i, q in queries if (p := fts.parse(q)) is not None]


#: Ids of a block of postings.
IDS = 4096
#: Texts of a block whose trigrams are told apart at once.
PIECE = 256
GRAM = "(?s)(?=(...))"


def searched(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(id, len, all): length of all fields in trigrams, and their lower-cased text."""
    grams = sum((F.greatest(F.lit(0), F.length(F.coalesce(F.col(f), F.lit(""))) - 2) for f in fields), F.lit(0))
    return rows.select("id", grams.alias("len"), F.lower(F.concat_ws("\n", *fields)).alias("all"))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct trigrams, as three code points of 21 bits, and whose they are."""
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    seen = np.zeros(0x110000, dtype=bool)
    seen[signs] = True
    known = np.flatnonzero(seen)
    k, n = len(known), len(texts)
    if k**3 * n >= 1 << 63:  # so many signs that a number can't hold a trigram of them and a text
        (a, of_a), (b, of_b) = _grams(texts[: n // 2]), _grams(texts[n // 2 :])
        return np.concatenate([a, b]), np.concatenate([of_a, of_b + n // 2])
    code, of = (np.cumsum(seen) - 1)[signs], np.repeat(np.arange(n), [len(t) for t in texts])
    key = np.unique((((code[:-2] * k + code[1:-1]) * k + code[2:]) * n + of[2:])[of[2:] == of[:-2]])
    gram, of = np.divmod(key, max(n, 1))
    return known[gram // (k * k)] << 42 | known[gram // k % k] << 21 | known[gram % k] if len(gram) else gram, of


def _postings(table: pa.Table) -> pa.Table:
    """Posting lists (gram, block, ids) of one block of texts (id, block, all)."""
    ids, at = np.unique(table["id"].to_numpy(), return_inverse=True)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(table), PIECE):
        gram, of = _grams([t.decode("utf-8", "replace") for t in table["all"].slice(i, PIECE).cast(pa.binary()).to_pylist()])
        found.append((gram, at[i + of]))
    grams, which = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    which, of = np.divmod(np.unique(which * len(ids) + np.concatenate([o for _, o in found])), len(ids))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(len(grams) + 1)).astype(np.int32)), pa.array(ids[of]))
    signs = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    words = [signs[i : i + 3] for i in range(0, len(signs), 3)]
    return pa.table({"gram": pa.array(words, pa.string()), "block": pa.array(np.full(len(grams), table["block"][0].as_py())), "ids": lists})


def write_trigrams(rows: DataFrame, path: str, fields: list[str], parts: int | None = None) -> None:
    """Writes an index of rows (id, fields): posting lists of trigrams by blocks of ids, texts by id, and their size.

    Both lie in ranges of their keys, so that a query reads the few row groups that it needs; a
    list holds IDS ids at most, so a trigram that all texts hold is many rows.  A block's texts
    make its lists in one task, so what is shuffled is texts and lists, not a row a text and trigram.
    """
    sized = searched(rows, fields).withColumn("block", F.floor(F.col("id") / IDS))
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = sized.repartitionByRange(parts, "id").sortWithinPartitions("id")
    texts.write.option("compression", "zstd").parquet(f"{path}/texts")
    sized = rows.sparkSession.read.parquet(f"{path}/texts")
    of_blocks = sized.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "block", "all").groupBy("block")
    lists = stored(of_blocks.applyInArrow(_postings, "gram string, block long, ids array<long>"), "postings")
    lists.repartitionByRange(parts, "gram", "block").sortWithinPartitions("gram", "block").write.option("compression", "zstd").parquet(f"{path}/grams")
    sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).write.parquet(f"{path}/size")


def read_trigrams(spark, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("texts", "grams", "size")}


def found_by_grams(trigrams: dict[str, DataFrame], terms: DataFrame) -> DataFrame:
    """(term, id): which rows hold all trigrams of a term, by intersecting posting lists block by block; the term itself need not be there."""
    grams = F.array_distinct(F.regexp_extract_all("term", F.lit(GRAM), 1))
    wanted = terms.select("term", F.size(grams).alias("need"), F.explode(grams).alias("gram"))
    few = [r[0] for r in wanted.select("gram").distinct().limit(SMALL + 1).collect()]
    lists = trigrams["grams"].where(F.col("gram").isin(few)) if len(few) <= SMALL else trigrams["grams"]
    met = lists.join(F.broadcast(wanted) if len(few) <= SMALL else wanted, "gram").groupBy("term", "need", "block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("need"))
    shared = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(1))), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    return met.select("term", F.explode(shared).alias("id"))


def fts_search(rows: DataFrame | None, queries: DataFrame, fields: list[str] = (), k: int | None = 30, trigrams: dict[str, DataFrame] | None = None) -> DataFrame:
    """(query_id, id, score, rank): rows that a full-text query matches, by recollect.functions.fts.

    A term matches where some field holds it, whatever its case; the score weighs how often each
    of a query's terms stands, by the fields' length in trigrams.  Queries that are not of the
    grammar find nothing.  trigrams: of `read_trigrams`; then the lists say which texts to look
    at, and none is read for a term that the index lacks.  Else all rows are looked at.
    """
    asked = parsed(queries)
    terms = asked.select("query_id", F.posexplode("terms").alias("pos", "term")).withColumn("term", F.lower("term"))
    distinct = terms.select("term").distinct()
    tf = (F.length("all") - F.length(F.replace("all", "term", F.lit("")))) / F.length("term")
    if trigrams is None:
        sized = searched(rows, fields)
        total = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
        hits = sized.join(near(distinct), F.expr("contains(all, term)"))
    else:
        total, cands = trigrams["size"], stored(found_by_grams(trigrams, distinct), "candidates")
        blocks = [r[0] for r in cands.select(F.floor(F.col("id") / IDS)).distinct().limit(SMALL + 1).collect()]
        if not blocks:
            return asked.select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        texts = trigrams["texts"].where(F.col("block").isin(blocks)) if len(blocks) <= SMALL else trigrams["texts"]
        hits = texts.join(near(cands), "id").where(F.contains("all", "term"))
    hits = stored(hits.select("id", "len", "term", tf.alias("tf")), "hits")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    scored = hits.join(df.join(F.broadcast(total)).join(terms, "term"), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"), F.collect_set("pos").alias("has"))
    fits = F.exists("ways", lambda w: (F.size(F.array_except(w["need"], F.col("has"))) == 0) & ~F.arrays_overlap(w["without"], F.col("has")))
    return ranked(scored.join(asked.select("query_id", "ways"), "query_id").where(fits).select("query_id", "id", "score"), k)


def substring_rank(rows: DataFrame, queries: DataFrame, fields: list[str], k: int | None = 30) -> DataFrame:
    """fts_search over all rows."""
    return fts_search(rows, queries, fields, k)


def fts_fields(memories: DataFrame) -> tuple[DataFrame, list[str]]:
    """memories with the fields that full-text queries look at, and their names: id, text, title or reason, tags, scope, domain."""
    tags = F.array_join("tags", " ") if "tags" in memories.columns else F.lit(None).cast("string")
    have = [F.col(c).cast("string") if c in memories.columns else F.lit(None).cast("string") for c in ("text", "title", "scope", "domain")]
    names = ["f_id", "f_text", "f_title", "f_scope", "f_domain", "f_tags"]
    return memories.select("id", *[c.alias(n) for n, c in zip(names, [F.col("id").cast("string"), *have, tags], strict=True)]), names


def semantic(vectors: DataFrame, queries: DataFrame, least: float = 0.5, k: int | None = 30) -> DataFrame:
    """(query_id, id, score, rank) of unit vectors (id, embedding) by cosine with queries (query_id, embedding).

    A stated set of queries goes against all vectors, in blocks of the vectors' partitions.
    """
    q = near(queries.select("query_id", F.col("embedding").alias("q")))
    scored = vectors.join(q).select("query_id", "id", F.round(F.greatest(F.lit(0.0), X.dot(F.col("embedding"), F.col("q"))), 6).alias("score"))
    return ranked(scored.where(F.col("score") >= least), k)


#: Days around a date beyond which nothing is relevant to it.
DAYS = 17


def temporal(memories: DataFrame, queries: DataFrame, now: datetime = X.NOW, least: float = 0.2, k: int | None = 50) -> DataFrame:
    """(query_id, id, score, rank) of memories (id, learned_at) near the date that a query names.

    Memories meet the dates that are asked for by day; each date is ranked once, however many
    queries name it.
    """
    day = 86_400_000_000
    at = queries.select("query_id", F.unix_micros(X.time_reference("query", now).cast("timestamp")).alias("at")).where("at is not null")
    asked = at.select("at").distinct().select("at", F.explode(F.sequence(F.floor(F.col("at") / day) - DAYS, F.floor(F.col("at") / day) + DAYS)).alias("day"))
    m = memories.select("id", F.unix_micros(F.col("learned_at").cast("timestamp")).alias("t")).withColumn("day", F.floor(F.col("t") / day))
    days = (F.col("t") - F.col("at")) / float(day)
    scored = m.join(near(asked), "day").where(F.abs(days) < DAYS).select("at", "id", F.round(X.time_relevance(days), 6).alias("score"))
    return at.join(ranked(scored.where(F.col("score") > least), k, by="at"), "at").select("query_id", "id", "score", "rank")


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = 3, fade: float = 0.7, least: float = 0.1) -> DataFrame:
    """seeds (query_id, id, score, rank) and what they reach over directed edges (src, dst, weight, ord).

    Each round passes score * weight * fade on, if that is `least` or more; the first to reach
    an id, by the order in which ids came and then of edges, keeps it.
    """
    reached = stored(seeds.select("query_id", "id", "score", F.struct(F.lit(0).alias("round"), F.col("rank").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("came")), "front")
    front = reached
    for i in range(1, rounds + 1):
        passed = F.round(F.col("score") * F.col("weight") * fade, 6)
        step = front.join(edges, F.col("id") == F.col("src")).select("query_id", F.col("dst").alias("id"), passed.alias("score"), F.col("came").alias("by"), "ord").where(F.col("score") >= least)
        step = step.join(reached.select("query_id", "id"), ["query_id", "id"], "left_anti")
        first = step.groupBy("query_id", "id").agg(F.min_by("score", F.struct("by", "ord")).alias("score"), F.min(F.struct("by", "ord")).alias("way"))
        order = Window.partitionBy("query_id").orderBy("way")
        front = first.withColumn("a", F.row_number().over(order).cast("long")).select("query_id", "id", "score", F.struct(F.lit(i).alias("round"), "a", F.lit(0).cast("long").alias("b")).alias("came"))
        front = stored(front, "front")  # else each round would compute all before it once more
        reached = reached.union(front)
    return reached.select("query_id", "id", "score", F.col("came.round").alias("round"))


def entity_neighbors(seeds: DataFrame, bridge: DataFrame) -> DataFrame:
    """(query_id, seed, id, shared): memories that share entities with a seed, without the seed."""
    s = seeds.select("query_id", F.col("id").alias("seed"))
    held = bridge.join(near(s.select(F.col("seed").alias("memory_id")).distinct()), "memory_id", "left_semi")
    own = stored(s.join(held.select(F.col("memory_id").alias("seed"), "entity"), "seed"), "own")
    return near(own).join(bridge, "entity").where("memory_id <> seed").groupBy("query_id", "seed", F.col("memory_id").alias("id")).agg(F.count("*").alias("shared"))


def links(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, seed, id, type, weight): edges at a seed, either way."""
    s = seeds.select("query_id", F.col("id").alias("seed"))
    out = s.join(edges, F.col("seed") == F.col("src")).select("query_id", "seed", F.col("dst").alias("id"), "type", "weight")
    back = s.join(edges, F.col("seed") == F.col("dst")).select("query_id", "seed", F.col("src").alias("id"), "type", "weight")
    return out.union(back)


def graph_expansion(seeds: DataFrame, bridge: DataFrame, edges: DataFrame, k: int | None = 30) -> DataFrame:
    """(query_id, id, score, rank): shared entities and semantic, causal and co-access edges, summed over seeds."""
    shared = entity_neighbors(seeds, bridge).select("query_id", "id", F.tanh(F.col("shared") * 0.5).alias("w"))
    kind = F.when(F.col("type") == "semantic", F.col("weight")).when(F.col("type") == "causal", F.col("weight") + 1).when(F.col("type") == "co_accessed", F.col("weight") * 0.8)
    linked = links(seeds, edges).select("query_id", "id", kind.alias("w")).where("w is not null")
    return ranked(shared.union(linked).groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score")), k)


def temporal_edges(memories: DataFrame, hours: float = 2.0, left: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight) of memories (id, learned_at) at most `hours` apart: a banded join on time buckets.

    Each pair is given once, by the smaller id first; left (id): only pairs with one of these.
    A dense bucket is dealt over the other side's ids, as one bucket may hold a third of all.
    Of all pairs each is met from its earlier memory, in buckets of half the span, so
    few meet that are further apart; the pairs grow with the square of the memories, as the
    result does.
    """
    span, deal, cut = int(hours * 3.6e9), 16, 2
    t = memories.select("id", F.unix_micros(F.col("learned_at").cast("timestamp")).alias("t")).where("t is not null").withColumn("b", F.floor(F.col("t") / span))
    if left is None:
        step = max(1, span // cut)
        t = t.withColumn("b", F.floor(F.col("t") / step))
        ahead = F.sequence(F.col("b"), F.floor((F.col("t") + span) / step))
        first = t.select(F.col("id").alias("id1"), F.col("t").alias("t1"), F.explode(ahead).alias("b")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
        both = first.join(t.withColumn("s", F.pmod("id", F.lit(deal)).cast("int")), ["b", "s"])
        both = both.where((F.col("t1") < F.col("t")) | ((F.col("t1") == F.col("t")) & (F.col("id1") < F.col("id")))).where("id1 <> id")
    else:
        own = t.join(near(left.select("id")), "id", "left_semi")
        first = own.select(F.col("id").alias("id1"), F.col("t").alias("t1"), F.explode(F.array(F.col("b") - 1, "b", F.col("b") + 1)).alias("b"))
        both = near(first).join(t, "b").where(F.col("id1") != F.col("id"))
    apart = F.abs(F.col("t1") - F.col("t"))
    # six digits in whole numbers, which is far cheaper than round(); halves are left to it
    double = (span - apart) * 2_000_000 + span
    whole = F.when(F.pmod(double, F.lit(2 * span)) == 0, F.round(1 - apart / span, 6)).otherwise((double - F.pmod(double, F.lit(2 * span))) / (2 * span) / 1e6)
    out = both.where(apart <= span).select(F.least("id1", "id").alias("src"), F.greatest("id1", "id").alias("dst"), whole.alias("weight"))
    return out if left is None else out.distinct()


def coaccess_edges(bridge: DataFrame, known: DataFrame | None = None, left: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): memories with common entities; shared over the larger set; known pairs stay out.

    left (id): only pairs with one of these, which is what graph maintenance asks for.
    """
    one = bridge.select("memory_id", "entity").distinct()
    size = one.groupBy("memory_id").agg(F.count("*").alias("n"))
    own = one if left is None else one.join(near(left.select(F.col("id").alias("memory_id"))), "memory_id", "left_semi")
    small = (lambda df: df) if left is None else near
    a = small(own.select(F.col("memory_id").alias("a"), "entity"))
    pairs = a.join(one.withColumnRenamed("memory_id", "b"), "entity").where("a <> b" if left is not None else "a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = pairs.join(size.select(F.col("memory_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("memory_id").alias("b"), F.col("n").alias("nb")), "b")
    out = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.round(F.col("shared") / F.greatest("na", "nb"), 6).alias("weight")).distinct()
    if known is None:
        return out
    return out.join(known.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), ["src", "dst"], "left_anti")


def fuse(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, id, rank); ties by where an id came first."""
    parts = [x.select("query_id", "id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    scored = both.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("came"))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "came")))
    return (out.where(F.col("rank") <= k) if k else out).drop("came")


def activated(fused: DataFrame, memories: DataFrame, now: datetime = X.NOW) -> DataFrame:
    """Fused scores joined to live memories, weighed 7 to 3 with their activation."""
    act = X.activation(F.col("strength"), F.col("frequency"), F.col("turns"))
    live = memories.where("status <> 'retired'").drop("text").withColumn("act", act)
    return fused.select("query_id", "id", F.col("score").alias("rrf")).join(live, "id").withColumn("relevance", F.round(0.7 * F.col("rrf") + 0.3 * F.col("act"), 6))


def dimensions(now: datetime = X.NOW, scope: Column | None = None) -> dict[str, Column]:
    """The ranking's nine sides of a memory, each between 0 and 1."""
    c = F.col
    return {
        "relevance": F.least(F.lit(1.0), c("relevance")),
        "specificity": X.specificity(c("statement")),
        "activation": F.least(F.lit(1.0), c("act")),
        "recency": X.recency(X.days_since("learned_at", now)),
        "evidence": X.evidence_strength(c("proof"), c("evidence"), c("sources")),
        "confidence": c("confidence") / 10.0,
        "scope": X.scope_match(c("scope"), F.lit(None).cast("string") if scope is None else scope),
        "polarity": X.polarity_weight(c("polarity")),
        "quality": X.quality(c("turns"), c("act"), c("consolidated"), c("positive"), c("positive") + c("negative"), c("adopted")),
    }


def rerank(rows: DataFrame, now: datetime = X.NOW, scope: Column | None = None) -> DataFrame:
    """rows with the nine sides, their weighted sum as score, and its rank in the query."""
    sides = dimensions(now, scope)
    total = sum((R.RANK_WEIGHTS[k] * v for k, v in sides.items()), F.lit(0.0))
    out = rows.withColumns({f"d_{k}": F.round(v, 6) for k, v in sides.items()} | {"score": F.round(total, 6)})
    return ranked(out, None)


def trim(rows: DataFrame, budget: int = 2048) -> DataFrame:
    """What fits a token budget: in rank order each layer takes an item if it still fits its share, else goes on.

    A fold over each query's ordered items of a layer; not a running sum, as later items may fit.
    """
    cost = X.estimate_tokens("statement")
    share = F.floor(X.by_layer("layer", {k: budget * v for k, v in R.BUDGET_SHARES.items()})).cast("long")
    ordered = rows.groupBy("query_id", "layer").agg(F.array_sort(F.collect_list(F.struct("rank", "id", cost.alias("cost"), share.alias("share"), F.struct(*rows.columns).alias("row")))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def take(state: Column, x: Column) -> Column:
        fits = state["used"] + x["cost"] <= x["share"]
        return F.struct(F.when(fits, state["used"] + x["cost"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["ids"], F.array(x["id"]))).otherwise(state["ids"]).alias("ids"))

    kept = ordered.withColumn("ids", F.aggregate("xs", start, take, lambda s: s["ids"]))
    return kept.select(F.explode(F.filter("xs", lambda x: F.array_contains("ids", x["id"]))).alias("x")).select("x.row.*")


def injection(rows: DataFrame, queries: DataFrame | None = None, tag: str = R.CONTEXT_TAGS[0]) -> DataFrame:
    """(query_id, text): kept memories under their headings, in rank order, within a tag.

    queries (query_id): those for which nothing was kept get a body that says so.
    """
    section = F.when(F.col("layer") == "mental_model", 0).when(F.col("layer") == "observation", 1).otherwise(2)
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.col("statement"))
    by = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(section.alias("s"), F.col("rank"), line.alias("l")))).alias("xs"))
    part = lambda i: F.when(F.exists("xs", lambda x: x["s"] == i), F.concat(F.lit(R.HEADINGS[i] + "\n"), F.array_join(F.transform(F.filter("xs", lambda x: x["s"] == i), lambda x: x["l"]), "\n")))
    body = by.select("query_id", F.concat_ws("\n\n", part(0), part(1), part(2)).alias("body"))
    if queries is not None:
        body = queries.select("query_id").distinct().join(body, "query_id", "left")
    return body.select("query_id", F.concat(F.lit(f"<{tag}>\n"), F.coalesce("body", F.lit(R.NOTHING)), F.lit(f"\n</{tag}>")).alias("text"))


def explanations(out: dict[str, DataFrame]) -> DataFrame:
    """Why each injected memory is there: rank and score by signal, the four scores on the way, and a reason."""
    names = [n for n in ("bm25", "semantic", "temporal", "graph") if n in out]
    e = out["kept"].select("query_id", "id", "statement", "rrf", "act", "relevance", F.col("score").alias("rerank"))
    for n in names:
        e = e.join(out[n].select("query_id", "id", F.col("rank").alias(f"{n}_rank"), F.col("score").alias(f"{n}_score")), ["query_id", "id"], "left")
    matched = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{n}_rank").isNotNull(), F.lit(n)) for n in names])), ", ")
    return e.withColumn("reason", F.when(matched != "", F.concat(F.lit("Matched retrieval signals: "), matched)).otherwise("No retrieval signals matched"))


def diagnostics(queries: DataFrame, memories: DataFrame, out: dict[str, DataFrame]) -> DataFrame:
    """A row a query: corpus size, how many each signal and step gave, and why nothing came out where nothing did."""
    steps = [n for n in ("bm25", "semantic", "temporal", "graph", "ranked", "kept") if n in out]
    d = queries.select("query_id").join(F.broadcast(memories.agg(F.count_if(F.col("status") != "retired").alias("corpus_size"))))
    for n in steps:
        d = d.join(out[n].groupBy("query_id").agg(F.count("*").alias(n)), "query_id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    why = F.when(F.col("kept") > 0, None).when(F.col("ranked") == 0, "No retrieval signals matched this query.").otherwise("Retrieval candidates were filtered out by token budget or relevance gates.")
    return d.withColumn("reason", why)


def fts_scores(hits: DataFrame) -> DataFrame:
    """hits with score as an index reports it: the best score over a row's own, so 1 for the best and more for worse ones."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("score", F.round(best / F.col("score"), 6))


def recall(queries: DataFrame, memories: DataFrame, bridge: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, now: datetime = X.NOW, budget: int = 2048, index: dict[str, DataFrame] | None = None, trigrams: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The whole query: signals, fusion, activation, ranking and trimming, for a batch of queries (query_id, query).

    Words are looked for by full-text search first, in all memories, and by BM25, in live ones,
    where that finds nothing.  Gives the lists by signal, the ranked memories and the kept ones.
    index and trigrams: of the memories, as `read_index` and `read_trigrams` give them.
    """
    queries = stored(queries, "queries")
    live = memories.where("status <> 'retired'")

    def by_words() -> dict[str, DataFrame]:
        fields, names = fts_fields(memories)
        words = stored(fts_scores(fts_search(fields, queries, names, trigrams=trigrams)), "fts")
        rest = queries.join(words.select("query_id").distinct(), "query_id", "left_anti")
        if not rest.isEmpty():
            words = stored(words.unionByName(bm25(live.select("id", "text"), rest, index=index)), "bm25")
        return {"bm25": words, "graph": stored(graph_expansion(words.where("rank <= 10"), bridge, edges), "graph")}

    def by_time() -> dict[str, DataFrame]:
        # queries that name the same day share what lies around it
        day = queries.select("query_id", X.time_reference("query", now).alias("day")).where("day is not null")
        days = day.select(F.unix_date("day").cast("long").alias("query_id"), F.col("day").cast("string").alias("query")).distinct()
        near_time = temporal(live, days, now)
        passed = ranked(spread(near_time, edges.where("type in ('temporal', 'causal')").withColumn("ord", F.col("dst"))).select("query_id", "id", "score"), 30)
        passed = day.select("query_id", F.unix_date("day").cast("long").alias("_d")).join(passed.withColumnRenamed("query_id", "_d"), "_d").drop("_d")
        return {"temporal": stored(passed, "temporal")}

    def by_vectors() -> dict[str, DataFrame]:
        return {"semantic": stored(semantic(vectors, queries), "semantic")}

    # the signals don't wait for each other
    ways = [by_words, by_time, *([by_vectors] if vectors is not None and "embedding" in queries.columns else [])]
    with ThreadPoolExecutor(len(ways)) as pool:
        found = {k: v for part in pool.map(lambda way: way(), ways) for k, v in part.items()}
    signals = {k: found[k] for k in ("bm25", "temporal", "graph", "semantic") if k in found}
    top = rerank(activated(fuse(list(signals.values())), memories, now), now)
    return {**signals, "ranked": top, "kept": trim(top, budget)}
