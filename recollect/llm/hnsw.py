"""Embedding near-dedup over hierarchical navigable small-world graphs, one a shard.

Vectors are dealt into shards; each shard builds one graph, audits it with noisy copies of its
own vectors and widens the beam until nearly all of them find their source.  Every vector then
searches every shard, goes on through the graph from each near vector that it finds, and
confirms cosines in double precision.  A task returns sums of links and a spanning forest of
those it has found, never its pairs.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import components, stored

SINGLE = 1e-4  # more than cosines in single precision err by
MARGIN = 0.03  # how far below the threshold a vector still leads on to others


class Graph:
    """Nodes are numbered by falling level, so level l holds the first tops[l] nodes."""

    def __init__(self, x: np.ndarray, adj: list[np.ndarray], ef: int):
        self.x, self.adj, self.ef = x, adj, ef

    def beam(self, q: np.ndarray, level: int, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best-first search of one level for all queries in step: ids and cosines by rank, and who was seen."""
        adj, n, rows = self.adj[level], len(self.adj[level]), np.arange(len(q))
        seen = np.zeros((len(q), n), dtype=bool)
        ids = np.full((len(q), ef), -1, dtype=np.int32)
        sims = np.full((len(q), ef), -2.0, dtype=np.float32)
        open_ = np.zeros((len(q), ef), dtype=bool)
        k = min(ef, entry.shape[1])
        e = entry[:, :k]
        s = np.einsum("qkd,qd->qk", self.x[np.maximum(e, 0)], q)
        s[e < 0] = -2.0
        ids[:, :k], sims[:, :k], open_[:, :k] = e, s, e >= 0
        seen[np.repeat(rows, k), np.maximum(e, 0).ravel()] = True
        live = rows
        while len(live):
            s = np.where(open_[live], sims[live], -3.0)
            best = s.argmax(1)
            go = s[np.arange(len(live)), best] > -2.5
            live, best = live[go], best[go]
            if not len(live):
                break
            open_[live, best] = False
            nb = adj[ids[live, best]]
            fresh = (nb >= 0) & ~seen[live[:, None], nb]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            seen[live[r], nb[r, c]] = True
            sim = np.full(nb.shape, -2.0, dtype=np.float32)
            sim[r, c] = np.einsum("nd,nd->n", self.x[nb[r, c]], q[live[r]])
            all_s = np.concatenate([sims[live], sim], 1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            all_i = np.concatenate([ids[live], np.where(fresh, nb, -1)], 1)
            all_o = np.concatenate([open_[live], fresh], 1)
            sims[live], ids[live], open_[live] = (np.take_along_axis(v, top, 1) for v in (all_s, all_i, all_o))
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), seen

    def search(self, q: np.ndarray, ef: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), dtype=np.int32)
        for level in range(len(self.adj) - 1, down_to, -1):
            entry = self.beam(q, level, entry, 4)[0]
        return self.beam(q, down_to, entry, ef)

    def flood(self, r: np.ndarray, c: np.ndarray, q: np.ndarray, seen: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From nodes c of queries r on along links: (query, node, cosine) of all that is `least` near; nodes MARGIN farther lead on."""
        n, out = len(self.x), []
        while len(r):
            nb = self.adj[0][c]
            r, c = np.repeat(r, nb.shape[1]), nb.ravel()
            ok = (c >= 0) & ~seen[r, c]
            key = np.unique(r[ok].astype(np.int64) * n + c[ok])
            r, c = key // n, key % n
            seen[r, c] = True
            s = np.concatenate([np.einsum("nd,nd->n", self.x[c[i : i + 65536]], q[r[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0, np.float32)])
            hit = s >= least
            out.append((r[hit], c[hit], s[hit]))
            go = s >= least - MARGIN
            r, c = r[go], c[go]
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (r, c, np.zeros(0, np.float32))

    def near(self, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, cosine) of cosine >= least: the beam, then all that is linked to those found.

        Queries whose beam is full of near nodes lie in a dense group.  One of them walks the
        graph out to twice the angle, within which all near nodes of its near queries lie, and
        these are compared with what it met in blocks: a group of g vectors is not walked g times.
        """
        ids, sims, seen = self.search(q, ef)
        full = sims[:, -1] >= least - MARGIN
        fq, slot = np.nonzero((sims >= least - MARGIN) & (ids >= 0) & ~full[:, None])
        fn = ids[fq, slot]
        sure = sims[fq, slot] >= least
        found = [(fq[sure], fn[sure], sims[fq, slot][sure]), self.flood(fq, fn, q, seen, least)]
        wide = 2 * least * least - 1 - MARGIN
        left = np.flatnonzero(full)
        while len(left):
            own, mark = q[left[:1]], np.zeros((1, len(self.x)), dtype=bool)
            start = ids[left[0]][ids[left[0]] >= 0].astype(np.int64)
            mark[0, start] = True
            around = np.concatenate([start, self.flood(np.zeros(len(start), np.int64), start, own, mark, wide)[1]])
            mine = q[left] @ own[0] >= least
            mine[0] = True
            for i in range(0, int(mine.sum()), 256):
                some = left[mine][i : i + 256]
                for lo in range(0, len(around), 65536):
                    s = q[some] @ self.x[around[lo : lo + 65536]].T
                    r, c = np.nonzero(s >= least)
                    found.append((some[r], around[lo + c], s[r, c]))
            left = left[~mine]
        return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` diverse neighbours of each row: nearer to it than to any one chosen before; then the nearest left."""
    order = np.argsort(-sims, axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = x[np.maximum(ids, 0)]
    mutual = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, dtype=bool)
    closest = np.full(ids.shape, -2.0, dtype=np.float32)
    count = np.zeros(len(ids), dtype=np.int64)
    for j in range(ids.shape[1]):
        take = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (count < most)
        chosen[:, j] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, mutual[:, j]), closest)
    rank = np.where(chosen, 0, 1) * 1000 + np.arange(ids.shape[1]) + np.where(ids < 0, 100_000, 0)
    return np.take_along_axis(ids, np.argsort(rank, axis=1)[:, :most], 1)


def build(x: np.ndarray, m: int = 16, ef: int = 64, batch: int = 256, seed: int = 3) -> Graph:
    """Inserts rows of x (unit vectors, float32) in batches: search, in-batch comparison, mutual links."""
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(rng.random(len(x)) + 1e-12) / math.log(m)).astype(int), 8)
    order = np.argsort(-level, kind="stable")
    level, x = level[order], x[order]
    tops = [int((level >= i).sum()) for i in range(int(level[0]) + 1)]
    adj = [np.full((n, 2 * m if i == 0 else m), -1, dtype=np.int32) for i, n in enumerate(tops)]
    g = Graph(x, adj, ef)
    for l in range(len(tops) - 1, -1, -1):
        lower = Graph(x, [np.zeros((0, 1), np.int32)] * l + adj[l:], ef)
        done = 0
        while done < tops[l]:
            end = min(tops[l], done + max(1, min(batch, done)) if done else 32)
            _insert(lower, l, done, end, m, ef)
            done = end
    g.order = order
    return g


def _insert(g: Graph, l: int, s: int, e: int, m: int, ef: int) -> None:
    x, adj = g.x, g.adj[l]
    q = x[s:e]
    own = q @ q.T
    np.fill_diagonal(own, -2.0)
    k = min(e - s - 1, ef // 2)
    ids = np.full((e - s, 0), -1, dtype=np.int32)
    sims = np.zeros((e - s, 0), dtype=np.float32)
    if s:
        full, g.adj[l] = adj, adj[:s]  # only what is linked already
        entry = np.zeros((e - s, 1), dtype=np.int32)
        for up in range(len(g.adj) - 1, l, -1):
            entry = g.beam(q, up, entry, 4)[0]
        entry = np.where((entry >= 0) & (entry < s), entry, 0)[:, :1]  # the level's first nodes come from above
        ids, sims, _ = g.beam(q, l, entry, ef)
        g.adj[l] = full
    if k > 0:
        near = np.argpartition(-own, k - 1, axis=1)[:, :k]
        ids = np.concatenate([ids, near + s], 1)
        sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], 1)
    if not ids.shape[1]:
        return
    links = _choose(x, ids, np.where(ids < 0, -2.0, sims), m)
    adj[s:e, : links.shape[1]] = links
    # back links: what overflows is chosen again
    r, c = np.nonzero(links >= 0)
    to, new = links[r, c], (r + s).astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    node, first, count = np.unique(to, return_index=True, return_counts=True)
    held = (adj[node] >= 0).sum(1)
    width = adj.shape[1]
    many = np.full((len(node), width + int(count.max(initial=0))), -1, dtype=np.int32)
    many[:, :width] = adj[node]
    at = np.repeat(held, count) + np.arange(len(to)) - np.repeat(first, count)
    many[np.repeat(np.arange(len(node)), count), at] = new
    many[_repeats(many)] = -1  # two of a batch may have chosen each other
    many = np.take_along_axis(many, np.argsort(many < 0, axis=1, kind="stable"), 1)
    total = (many >= 0).sum(1)
    over = total > width
    adj[node[~over]] = many[~over, :width]
    for lo in range(0, int(over.sum()), 512):
        rows = np.flatnonzero(over)[lo : lo + 512]
        cand = many[rows][:, : int(total[rows].max())]
        sim = np.einsum("tcd,td->tc", x[np.maximum(cand, 0)], x[node[rows]])
        adj[node[rows]] = _choose(x, cand, np.where(cand < 0, -2.0, sim), width)[:, :width]


def _repeats(a: np.ndarray) -> np.ndarray:
    order = np.argsort(a, axis=1, kind="stable")
    s = np.take_along_axis(a, order, 1)
    again = np.zeros(a.shape, dtype=bool)
    again[:, 1:] = s[:, 1:] == s[:, :-1]
    out = np.empty_like(again)
    np.put_along_axis(out, order, again, 1)
    return out


def audit(g: Graph, least: float, target: float = 0.998, probes: int = 512, seed: int = 5) -> int:
    """Twice the narrowest beam, from g.ef on by doubling, that passes two audits against brute force.

    Noisy copies of `probes` vectors, at cosine `least`, find their source; and the vectors
    themselves find all that are near them.  A beam as wide as the graph ends the search.
    """
    n, d = g.x.shape
    rng = np.random.default_rng(seed)
    at = rng.permutation(n)[:probes]
    noise = rng.standard_normal((len(at), d)).astype(np.float32)
    noise -= (noise * g.x[at]).sum(1, keepdims=True) * g.x[at]
    norm = np.linalg.norm(noise, axis=1, keepdims=True)
    q = least * g.x[at] + math.sqrt(1 - least * least) * np.where(norm > 0, noise / np.maximum(norm, 1e-9), 0)
    truth = np.concatenate([((g.x[at[i : i + 64]] @ g.x.T) >= least).sum(1) for i in range(0, len(at), 64)])
    ef = g.ef
    while ef < n:
        hit = (g.search(q.astype(np.float32), ef)[0] == at[:, None]).any(1).mean()
        found = np.bincount(g.near(g.x[at], least, ef)[0], minlength=len(at))
        if hit >= target and (found / truth).mean() >= target:
            break
        ef *= 2
    return 2 * ef


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


GRAPH_BYTES = 1 << 29
GRAPH = "dim int, shard int, graph binary"
GRAPH_ARROW = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("graph", pa.binary())])


def _build(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        dim = table["dim"][0].as_py()
        raw = _matrix(table["embedding"], dim)
        g = build(_unit(raw).astype(np.float32))
        out = io.BytesIO()
        levels = {f"adj{i}": a for i, a in enumerate(g.adj)}
        np.savez(out, rep=table["rep"].to_numpy()[g.order], weight=table["weight"].to_numpy()[g.order], raw=raw[g.order], ef=np.array([audit(g, least)]), **levels)
        return pa.table([pa.array([dim], pa.int32()), pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([out.getvalue()], pa.binary())], schema=GRAPH_ARROW)

    return run


FOUND = "kind int, a long, b long"
FOUND_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable label of each node once links a-b hold too."""
    while True:
        ra, rb = label[a], label[b]
        if (ra == rb).all():
            return label
        low = np.minimum(ra, rb)
        np.minimum.at(label, ra, low)
        np.minimum.at(label, rb, low)
        while (label[label] != label).any():
            label = label[label]


def _query(least: float, step: int = 512):
    def run(table: pa.Table, graphs: pa.Table) -> pa.Table:
        if not len(table) or not len(graphs):
            return FOUND_ARROW.empty_table()
        with np.load(io.BytesIO(graphs["graph"][0].as_py())) as z:
            rep, weight, raw, ef = z["rep"], z["weight"], z["raw"], int(z["ef"][0])
            unit = _unit(raw)
            g = Graph(unit.astype(np.float32), [z[f"adj{i}"] for i in range(sum(k.startswith("adj") for k in z.files))], ef)
        me = table["rep"].to_numpy()
        mine = _unit(_matrix(table["embedding"], raw.shape[1]))
        nodes, back = np.unique(np.concatenate([me, rep]), return_inverse=True)
        of_me, of_rep = back[: len(me)], back[len(me) :]
        label = np.arange(len(nodes))
        total = np.zeros(len(me), dtype=np.int64)
        for lo in range(0, len(me), step):
            q, n, s = g.near(mine[lo : lo + step].astype(np.float32), least - SINGLE, ef)
            q = q + lo
            # single precision errs by less than SINGLE: only what is that close to the threshold needs double
            sure = s >= least + SINGLE
            for at in np.array_split(np.flatnonzero(~sure), 1 + len(q) // 65536):
                sure[at] = np.einsum("nd,nd->n", mine[q[at]], unit[n[at]]) >= least
            sure &= me[q] != rep[n]
            q, n = q[sure], n[sure]
            total += np.bincount(q, weights=weight[n], minlength=len(me)).astype(np.int64)
            label = _forest(label, of_me[q], of_rep[n])
        some, tree = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(nodes)))
        kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(tree)])
        return pa.table([pa.array(kind), pa.array(np.concatenate([me[some], nodes[tree]])), pa.array(np.concatenate([total[some], nodes[label[tree]]]))], schema=FOUND_ARROW)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, shard_rows: int = 200_000, shards: int = 4, key: str = "vec_id") -> DataFrame:
    """key, n_links, component_id, kept of each row of vectors (key, embedding).

    Equal vectors form one class, searched once; their links to each other count.  Vectors that
    are null, empty, zero, or hold null or non-finite components, or whose key is null, link
    with nothing, nor do vectors of different length.  There are `shards` graphs, or more so
    that each holds about `shard_rows` vectors, fewer of long ones.  Rows that repeat a key are linked each by its
    own vector and then share the smallest component.
    """
    src = vectors.select(F.col(key).cast("long").alias("rep"), F.col("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    good = F.coalesce(~bad & (norm > 0) & (norm < float("inf")), F.lit(False)) & F.col("rep").isNotNull()
    hashed = src.withColumn("good", good).withColumn("h1", F.when(F.col("good"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(5), F.reverse("embedding"))))
    live = hashed.where("good")
    classes = live.groupBy("h1", "h2").agg(F.min_by("embedding", "rep").alias("embedding"), F.min("rep").alias("rep"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("dim", F.size("embedding")), "vectors")
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    # a graph is one value and stays well below what a value may hold; its copies never outweigh the queries
    n_shards = max(shards, math.ceil(n / min(shard_rows, GRAPH_BYTES // (16 * dim + 256))))
    blocks = max(1, min(math.ceil(n / 8192), 4 * n_shards))
    dealt = classes.select("dim", "rep", "embedding", "weight", F.pmod(F.xxhash64("rep"), F.lit(n_shards)).cast("int").alias("shard"))
    graphs = stored(dealt.groupBy("dim", "shard").applyInArrow(_build(least), GRAPH), "graphs")
    cell = ["dim", "shard", "block"]
    queries = classes.select("dim", "rep", "embedding", F.pmod(F.hash("rep"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    copies = graphs.select("dim", "shard", "graph", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = stored(queries.groupBy(cell).cogroup(copies.groupBy(cell)).applyInArrow(_query(least), FOUND), "found")
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n"))
    comp = components(found.where("kind = 1").select("a", "b"), "component")
    known = classes.select("h1", "h2", "rep", "weight").join(links, "rep", "left").join(comp, F.col("rep") == F.col("id"), "left")
    known = known.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = hashed.select("rep", "h1", "h2").join(known, ["h1", "h2"], "left")
    out = out.select(F.col("rep").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "rep").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
