"""Steps of consolidation: greedy clusters, their match with known observations, updates and links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.operators.lifecycle import merge_clusters
from recollect.operators.retrieval import near
from recollect.sources.store import stored


def greedy_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, seed): in id order the first free member seeds a cluster and takes every free one similar to it.

    pairs (a, b) of similar members.  A member is a seed once all similar ones before it are
    taken, and taken once one of them is a seed; rounds settle many members at a time, and none
    of them folds the list in one task.
    """
    p = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    state = stored(members.select("id").distinct().withColumn("st", F.lit(0)), "state")
    while True:
        ahead = p.join(state.select(F.col("id").alias("a"), F.col("st").alias("sa")), "a").groupBy(F.col("b").alias("id")).agg(F.max((F.col("sa") == 1).cast("int")).alias("seed"), F.min((F.col("sa") == 2).cast("int")).alias("gone"))
        new = F.when(F.col("st") != 0, F.col("st")).when(F.col("seed") == 1, 2).when(F.coalesce("gone", F.lit(1)) == 1, 1).otherwise(0)
        state = stored(state.join(ahead, "id", "left").select("id", new.alias("st")), "state")
        if state.where("st = 0").isEmpty():
            break
    seeds = state.where("st = 1").select(F.col("id").alias("a"))
    owner = p.join(seeds, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("seed"))
    return state.join(owner, "id", "left").select("id", F.when(F.col("st") == 1, F.col("id")).otherwise(F.col("seed")).alias("seed"))


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows; a null one is a zero vector, which nothing is similar to."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r is not None), default=1)
    return np.array([r if r is not None else [0.0] * width for r in rows], dtype=np.float64).reshape(len(rows), -1)


def vector_clusters(vectors: DataFrame, least: float, chunk: int = 2048) -> DataFrame:
    """(id, seed) as greedy_clusters gives them for all pairs of vectors (id, embedding) with a dot product of `least`, to six digits.

    A member's seed is the first seed that is similar to it, so only seeds are compared with all
    vectors and no pairs are kept.  In each round the first `chunk` free members are folded on
    the driver, and every free one looks for its seed among the new ones.
    """
    least = least - 5e-7
    spark, done = vectors.sparkSession, []
    free = stored(vectors.select("id", "embedding").where("id is not null").dropDuplicates(["id"]), "free")
    while True:
        head = free.orderBy("id").limit(chunk).toArrow()
        if not len(head):
            break
        ids, m = head["id"].to_numpy(), _matrix(head["embedding"])
        near, taken, first = m @ m.T >= least, np.zeros(len(m), dtype=bool), []
        for i in range(len(m)):
            if not taken[i]:
                first.append(i)
                taken |= near[i]
        shared = spark.sparkContext.broadcast((ids[first], m[first]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds, s = shared.value
            for batch in batches:
                for lo in range(0, len(batch), 1000):
                    part = batch.slice(lo, 1000)
                    own, v = part["id"].to_numpy(), _matrix(part["embedding"])
                    hit = (v @ s.T >= least if v.shape[1] == s.shape[1] else np.zeros((len(v), len(s)), dtype=bool)) | (own[:, None] == seeds)
                    seed = pa.array(seeds[hit.argmax(1)], pa.int64(), mask=~hit.any(1))
                    yield pa.record_batch([part["id"], part["embedding"], seed], names=["id", "embedding", "seed"])

        kind = free.schema["embedding"].dataType.simpleString()
        state = stored(free.mapInArrow(run, f"id long, embedding {kind}, seed long"), "state")
        done.append(state.where("seed is not null").select("id", "seed"))
        free = state.where("seed is null").select("id", "embedding")
    out = spark.createDataFrame([], "id long, seed long")
    for d in done:
        out = out.union(d)
    return out


def unmerged(memories: DataFrame, most: int | None = None) -> DataFrame:
    """Active raw memories that no observation holds yet, the oldest `most` of them or all."""
    out = memories.where("layer = 'raw' and status = 'active' and not consolidated")
    return out.orderBy("learned_at", "id").limit(most) if most else out


def facet(scope: str = "scope", domain: str = "domain") -> tuple[Column, Column]:
    """What clusters and observations must share: scope and domain, or what stands for none."""
    return F.coalesce(scope, F.lit("global")).alias("scope"), F.coalesce(domain, F.lit("general")).alias("domain")


#: Characters of a block of clusters or observations, and observations and clusters that are compared at once.
CHARS, TILE, SLICE = 64_000_000, 2048, 512
SCORED = "seed long, observation long, score double"


def _codes(left: pa.Table, right: pa.Table, name: str, other: str) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Of a list column of either table: a number for each item, the same for equal ones, and where each row's items start; null items are dropped."""
    lists = [t[c].combine_chunks() for t, c in ((left, name), (right, other))]
    rows = [np.repeat(np.arange(len(x)), x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for x in lists]
    flat = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    out = []
    for x, row, code in zip(lists, rows, np.split(flat, [len(rows[0])]), strict=True):
        out.append((code[code >= 0], np.concatenate(([0], np.cumsum(np.bincount(row[code >= 0], minlength=len(x)))))))
    return tuple(out)


def _postings(codes: np.ndarray, first: np.ndarray, n: int, often: int):
    """Rows of each of n codes, and those codes that `often` rows hold as columns of a matrix."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    held = np.bincount(codes, minlength=n)
    column = np.full(n, -1)
    column[held >= often] = np.arange((held >= often).sum())
    dense = np.zeros((len(first) - 1, max(1, column.max(initial=-1) + 1)), dtype=np.float32)
    wide = column[codes] >= 0
    dense[rows[wide], column[codes[wide]]] = 1
    codes, rows = codes[~wide], rows[~wide]
    return rows[np.argsort(codes, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=n)))), column, dense


def _shared(codes: np.ndarray, first: np.ndarray, postings) -> np.ndarray:
    """How many items each row has in common with each row of the postings: frequent items by a product of matrices, others by their lists."""
    rows, at, column, dense = postings
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mine = np.zeros((len(first) - 1, dense.shape[1]), dtype=np.float32)
    wide = column[codes] >= 0
    mine[own[wide], column[codes[wide]]] = 1
    out = mine @ dense.T  # whole numbers, far below what these hold exactly
    codes, own = codes[~wide], own[~wide]
    n = at[codes + 1] - at[codes]
    place = np.repeat(at[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())
    if len(place):
        out += np.bincount(np.repeat(own, n) * len(dense) + rows[place], minlength=out.size).reshape(out.shape)
    return out


def _best(least: float):
    """A block of clusters against a block of observations: of each cluster the best scores, unrounded, each with its first observation."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(left) and len(right):
            seeds, ids = left["seed"].to_numpy(), right["observation"].to_numpy()
            kinds = [_codes(left, right, a, b) for a, b in (("cw", "ow"), ("ce", "oe"), ("ct", "ot"))]
            held_at, held = left["held"].combine_chunks().offsets.to_numpy(), left["held"].combine_chunks()
            held, held_at = held.flatten().to_numpy(zero_copy_only=False), held_at - held_at[0]
            for o in range(0, len(ids), TILE):
                end = min(o + TILE, len(ids))
                tiles = []
                for (mine, _), (codes, first) in kinds:
                    n = max(mine.max(initial=-1), codes.max(initial=-1)) + 1
                    tiles.append(_postings(codes[first[o] : first[end]], first[o : end + 1] - first[o], n, max(2, (end - o) // 64)))
                size = np.diff(kinds[0][1][1])[o:end].astype(np.float32)
                for c in range(0, len(seeds), SLICE):
                    stop = min(c + SLICE, len(seeds))
                    words, entities, tags = (_shared(codes[first[c] : first[stop]], first[c : stop + 1] - first[c], tile) for ((codes, first), _), tile in zip(kinds, tiles, strict=True))
                    union = np.diff(kinds[0][0][1])[c:stop, None].astype(np.float32) + size - words
                    score = words / np.maximum(union, 1) + np.minimum(entities, 1) * np.float32(0.35) + np.minimum(tags, 1) * np.float32(0.15)
                    out = slice(held_at[c], held_at[stop])
                    row, taken = np.repeat(np.arange(stop - c), np.diff(held_at[c : stop + 1])), held[out]
                    order = np.argsort(ids[o:end], kind="stable")
                    place = np.minimum(np.searchsorted(ids[o:end][order], taken), end - o - 1)
                    there = ids[o:end][order][place] == taken
                    score[row[there], order[place[there]]] = -1.0
                    i, j = np.nonzero(score >= np.maximum(score.max(1, keepdims=True), least) - 1e-5)
                    exact = words[i, j].astype(np.float64) / np.maximum(union[i, j].astype(np.float64), 1) + np.where(entities[i, j] > 0, 0.35, 0.0) + np.where(tags[i, j] > 0, 0.15, 0.0)
                    top = np.full(stop - c, least)
                    np.maximum.at(top, i, exact)
                    fine = exact >= top[i] - 2e-6  # rounding to six digits may make equals of what lies so near the best
                    i, j, exact = i[fine], j[fine], exact[fine]
                    order = np.lexsort((ids[o + j], exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    new = np.ones(len(i), dtype=bool)
                    new[1:] = (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])
                    for f, x in zip(found, (seeds[c + i[new]], ids[o + j[new]], exact[new]), strict=True):
                        f.append(x)
        return pa.table([pa.array(np.concatenate(f)) for f in found], names=["seed", "observation", "score"])

    return run


def match_observations(clusters: DataFrame, observations: DataFrame, least: float = 0.35, linked: DataFrame | None = None) -> DataFrame:
    """(seed, observation, score): each cluster's best known observation of its scope and domain.

    Similarity of its words and those of title and statement, plus 0.35 for a common entity and 0.15 for a common tag; equals go to
    the earlier observation; retired ones, and those that hold all of a cluster already (linked:
    seed, observation), are out.  clusters (seed, scope, domain, statement, tags, entities),
    observations (id, status, ...).  Blocks of CHARS characters of a scope and domain meet, each
    pair of blocks in one task at most, and leave a few rows a cluster: no pairs are written.
    """
    text = F.concat_ws(" ", *[c for c in ("title", "statement") if c in observations.columns])
    c = clusters.select("seed", *facet(), F.coalesce("statement", F.lit("")).alias("text"), F.col("tags").alias("ct"), F.col("entities").alias("ce"))
    o = observations.where("status <> 'retired'").select(F.col("id").alias("observation"), *facet(), text.alias("text"), F.col("tags").alias("ot"), F.col("entities").alias("oe"))
    size = lambda df, name: df.groupBy("scope", "domain").agg(F.ceil(F.sum(F.length("text") + 400) / CHARS).cast("int").alias(name))
    blocks = near(stored(size(c, "n").join(size(o, "m"), ["scope", "domain"]), "blocks"))
    words = X.token_set("text")
    held = F.array().cast("array<long>")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if linked is not None:
        c = c.join(linked.groupBy("seed").agg(F.collect_set("observation").cast("array<long>").alias("held")), "seed", "left")
        held = F.coalesce("held", held)
    cell = ["scope", "domain", "i", "j"]
    # words come behind the filter on blocks and before rows are dealt to them
    left = c.join(blocks, ["scope", "domain"]).select("scope", "domain", own("seed", "n").alias("i"), "m", F.col("seed").cast("long").alias("seed"), words.alias("cw"), "ct", F.col("ce").cast("array<string>").alias("ce"), held.alias("held")).select(*cell[:3], every("m").alias("j"), "seed", "cw", "ct", "ce", "held")
    right = o.join(blocks, ["scope", "domain"]).select("scope", "domain", own("observation", "m").alias("j"), "n", F.col("observation").cast("long").alias("observation"), words.alias("ow"), "ot", F.col("oe").cast("array<string>").alias("oe")).select("scope", "domain", every("n").alias("i"), "j", "observation", "ow", "ot", "oe")
    scored = left.groupBy(cell).cogroup(right.groupBy(cell)).applyInArrow(_best(least), SCORED).select("seed", "observation", F.round("score", 6).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("seed").agg(F.max(F.struct("score", (-F.col("observation")).alias("o"))).alias("m"))
    return best.select("seed", (-F.col("m.o")).alias("observation"), F.col("m.score").alias("score"))


def evidence(members: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What new members (observation, id, ...) bring to each observation; known (observation, id) are old news."""
    new = members if known is None else members.join(known, ["observation", "id"], "left_anti")
    return new.groupBy(F.col("observation").alias("id")).agg(
        F.count("*").alias("new"), F.avg("confidence").alias("m_confidence"), F.max("strength").alias("m_strength"), F.max("storage").alias("m_storage"),
        F.sum("frequency").alias("m_frequency"), F.sum("turns").alias("m_turns"), F.max("weight").alias("m_weight"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("m_tags"),
    )


def update_observations(observations: DataFrame, found: DataFrame) -> DataFrame:
    """observations after new evidence (of `evidence`).

    Confidence is weighed by proof; two more proofs, or any for a new one, strengthen it; others
    keep their trend.
    """
    out = observations.join(found, "id", "left")
    any_, m = F.col("new").isNotNull(), F.coalesce("new", F.lit(0))
    proof = F.col("proof") + m
    conf = F.least(F.lit(10), X.js_round((F.col("confidence") * F.col("proof") + F.col("m_confidence") * m) / proof + 0.5))
    values = {
        "confidence": F.when(any_, conf).otherwise(F.col("confidence")),
        "trend": F.when(any_ & ((m >= 2) | (F.col("trend") == "new")), "strengthening").otherwise(F.col("trend")),
        "proof": proof,
        "evidence": F.col("evidence") + m,
        "sources": F.col("sources") + m,
        "strength": F.greatest("strength", "m_strength"),
        "storage": F.greatest("storage", "m_storage"),
        "frequency": F.col("frequency") + F.coalesce("m_frequency", F.lit(0)),
        "turns": F.col("turns") + F.coalesce("m_turns", F.lit(0)),
        "weight": F.greatest("weight", "m_weight"),
        "tags": F.when(any_, F.array_union("tags", "m_tags")).otherwise(F.col("tags")),
    }
    kind = {f.name: f.dataType for f in observations.schema}
    return out.select(*[(values[c].cast(kind[c]) if c in values else F.col(c)).alias(c) for c in observations.columns])


#: Members of a cluster that one task links to all others at a time.
LINKED = 1000


def evolution_links(clusters: DataFrame) -> DataFrame:
    """(src, dst, type, weight): members (id, seed) of conflicting clusters, each linked to every other of its own.

    The links are the result, so a cluster gives all its pairs; a pass takes a batch of memories
    (`unmerged`), which bounds them.  A large cluster is cut into parts of about LINKED members,
    and each pair of parts meets on its own, so no task holds a whole cluster's pairs.
    """
    size = clusters.groupBy("seed").agg(F.ceil(F.count("*") / LINKED).cast("int").alias("parts"))
    m = clusters.select("seed", "id").join(size, "seed")
    own, every = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = m.select("seed", F.col("id").alias("src"), own.alias("i"), every.alias("j"))
    other = m.select("seed", F.col("id").alias("dst"), own.alias("j"), every.alias("i"))
    return one.join(other, ["seed", "i", "j"]).where("src <> dst").select("src", "dst", F.lit("semantic").alias("type"), F.lit(0.5).alias("weight"))


def conflicts(members: DataFrame) -> DataFrame:
    """(seed, kinds) of clusters whose members' polarities differ."""
    return members.groupBy("seed").agg(F.count_distinct("polarity").alias("kinds")).where("kinds > 1")


def with_entities(rows: DataFrame, bridge: DataFrame, key: str = "id") -> DataFrame:
    """rows with an array of their entities of bridge (memory_id, entity)."""
    own = bridge.groupBy(F.col("memory_id").alias(key)).agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return rows.join(own, key, "left")


def entities_of_sources(links: DataFrame, bridge: DataFrame, owner: str) -> DataFrame:
    """(owner, entity, type) of the sources of each owner; of one name the kind that the first source (source_id) gives it."""
    b = bridge.select(F.col("memory_id").alias("source_id"), "entity", "type")
    return links.select(owner, "source_id").join(b, "source_id").groupBy(owner, "entity").agg(F.min_by("type", "source_id").alias("type"))


def clusters_of(members: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row a cluster of members (seed, id, ...): the first member's facet, all words, tags and entities."""
    first = F.struct("learned_at", "id")
    own = members.groupBy("seed").agg(F.min_by("scope", first).alias("scope"), F.min_by("domain", first).alias("domain"), F.array_join(F.array_sort(F.collect_set("statement")), " ").alias("statement"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"), F.count("*").alias("n"))
    names = members.select("seed", F.col("id").alias("memory_id")).join(bridge, "memory_id").groupBy("seed").agg(F.collect_set("entity").alias("entities"))
    return own.join(names, "seed", "left")


def consolidate(memories: DataFrame, bridge: DataFrame, vectors: DataFrame, sources: DataFrame, most: int | None = 50, least: float = 0.85) -> dict[str, DataFrame]:
    """A pass over the unmerged memories: what it would write, by name.

    clusters (id, seed) of two members or more; evolution: links of conflicting ones; merged: new
    observations by seed; updated: known ones with their new evidence; marked: ids that are
    consolidated now; sources (memory_id, source_id) of updated observations, and edges from
    them.  All clusters are matched with the observations there were before the pass.
    """
    raw = unmerged(memories, most)
    found = vector_clusters(vectors.join(raw.select("id"), "id", "left_semi"), least)
    several = found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    clusters = stored(found.join(several, "seed").select("id", "seed"), "clusters")
    members = raw.join(clusters, "id")
    bad = conflicts(members).select("seed")
    calm = stored(members.join(bad, "seed", "left_anti"), "calm")
    known = memories.where("layer = 'observation'")
    size = calm.groupBy("seed").agg(F.count("*").alias("n"))
    held = calm.select("seed", F.col("id").alias("source_id")).join(sources, "source_id").groupBy("seed", F.col("memory_id").alias("observation")).agg(F.count("*").alias("both"))
    linked = held.join(size, "seed").where("both = n").select("seed", "observation")
    match = stored(match_observations(clusters_of(calm, bridge), with_entities(known, bridge), linked=linked), "match")
    matched = calm.join(match.select("seed", "observation"), "seed")
    old = sources.select(F.col("memory_id").alias("observation"), F.col("source_id").alias("id"))
    news = evidence(matched, old)
    new_links = matched.select("observation", "id").join(old, ["observation", "id"], "left_anti")
    return {
        "clusters": clusters,
        "evolution": evolution_links(members.join(bad, "seed").select("seed", "id")),
        "merged": merge_clusters(calm.join(match.select("seed"), "seed", "left_anti")),
        "updated": update_observations(known.join(news.select("id"), "id", "left_semi"), news),
        "marked": calm.select("id"),
        "sources": new_links.select(F.col("observation").alias("memory_id"), F.col("id").alias("source_id")),
        "match": match,
        "calm": calm.select("seed", "id"),
    }
