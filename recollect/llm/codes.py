"""Compression of vectors into codes of parts, by codebooks that a filtering Lloyd's algorithm fits.

Each part of a vector is replaced by the number of its codebook's nearest entry.  Every
partition builds, once, kd-trees over its parts in blocks of bounded size, with each node's
bounding box, sum and count.  A round walks the trees with the entries still in question for a
node: an entry that is nowhere in the box the nearest one goes, and where one alone is left, the
whole subtree is its, at the price of an addition.  All arithmetic is of whole numbers.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and of a leaf at most.
BLOCK, LEAF = 4096, 8
_LIMB = 60


# ----------------------------------------------------------------- whole numbers


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles where they hold it exactly, else as Python's integers."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0**40:
        return np.floor(x * SCALE)
    big = np.abs(x) >= 2.0**41  # without a fraction below 1 / SCALE
    low = np.floor(np.where(big, 0.0, x) * SCALE)
    out = np.empty(x.shape, dtype=object)
    for i in np.ndindex(x.shape):
        out[i] = int(x[i]) * SCALE if big[i] else int(low[i])
    return out


def exact(*arrays: np.ndarray) -> bool:
    """Whether squared distances between rows of such values, doubled, are whole numbers that doubles hold."""
    if any(a.dtype == object for a in arrays):
        return False
    most = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return arrays[0].shape[-1] * (4 * most) ** 2 < 2.0**53


def integers(a: np.ndarray) -> np.ndarray:
    if a.dtype == object:
        return a
    out = np.empty(a.shape, dtype=object)
    out.ravel()[:] = [int(v) for v in a.ravel()]
    return out


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all points and entries."""
    if not exact(points, book):
        points, book = integers(points), integers(book)
        return np.stack([((points - b) ** 2).sum(axis=1) for b in book], axis=1)
    return (points**2).sum(axis=1)[:, None] - 2 * (points @ book.T) + (book**2).sum(axis=1)


# ------------------------------------------------------------------------- trees


def edges_of(n: int) -> list[np.ndarray]:
    """Where the nodes of each level begin and end: halves, down to leaves of LEAF points at most."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max(initial=0) > LEAF:
        e = levels[-1]
        both = np.empty(2 * len(e) - 1, dtype=np.int64)
        both[::2], both[1::2] = e, (e[1:] + e[:-1]) // 2
        levels.append(both)
    return levels


def tree_of(points: np.ndarray) -> dict:
    """Points in the order of a kd-tree, that order, and the boxes and sums of each level's nodes."""
    n = len(points)
    levels, order = edges_of(n), np.arange(n)
    if points.dtype == object or not exact(points):
        return {"points": points, "order": order, "levels": None}
    for e in levels[:-1]:
        p = points[order]
        wide = (np.maximum.reduceat(p, e[:-1]) - np.minimum.reduceat(p, e[:-1])).argmax(axis=1)
        node = np.repeat(np.arange(len(e) - 1), np.diff(e))
        order = order[np.lexsort((p[np.arange(n), wide[node]], node))]
    p = points[order]
    kept = []
    for e in levels:
        total = np.add.reduceat(p, e[:-1])
        kept.append((np.minimum.reduceat(p, e[:-1]).astype(np.int32), np.maximum.reduceat(p, e[:-1]).astype(np.int32), total.astype(np.int64)))
    return {"points": p.astype(np.int32), "order": order.astype(np.int32), "levels": kept}


def walk(tree: dict, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each point's entry in tree order, sums and counts by entry, and how many points came by whole subtrees."""
    points, k = tree["points"], len(book)
    n = len(points)
    if tree["levels"] is None or not exact(points.astype(np.float64), book):
        entry = distances(points if points.dtype == object else points.astype(np.float64), book).argmin(axis=1)
        sums = np.zeros(book.shape, dtype=object)
        held = integers(points)
        for j in range(k):
            sums[j] = held[entry == j].sum(axis=0) if (entry == j).any() else 0
        return entry, sums, np.bincount(entry, minlength=k), 0
    entry, sums, counts, cheap = np.zeros(n, dtype=np.int64), np.zeros(book.shape), np.zeros(k, dtype=np.int64), 0
    levels = edges_of(n)
    nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
    for e, (low, high, total) in zip(levels, tree["levels"], strict=True):
        lo, hi = low[nodes].astype(np.float64), high[nodes].astype(np.float64)
        middle = np.where(left, distances(lo + hi, 2 * book), np.inf)
        best = middle.argmin(axis=1)
        star = book[best]
        # the corner of the box where an entry does best against the one nearest to the middle
        corner = np.where(book > star[:, None], hi[:, None], lo[:, None])
        theirs, its = ((corner - book) ** 2).sum(axis=2), ((corner - star[:, None]) ** 2).sum(axis=2)
        left = left & ((theirs < its) | ((theirs == its) & (np.arange(k) <= best[:, None])))
        alone = left.sum(axis=1) == 1
        whose = left.argmax(axis=1)
        for i in np.flatnonzero(alone):
            entry[e[nodes[i]] : e[nodes[i] + 1]] = whose[i]
        size = np.diff(e)[nodes]
        np.add.at(sums, whose[alone], total[nodes[alone]])
        np.add.at(counts, whose[alone], size[alone])
        cheap += int(size[alone].sum())
        nodes, left, e_last = nodes[~alone], left[~alone], e
        if not len(nodes):
            return entry, sums, counts, cheap
        if e is not levels[-1]:
            nodes, left = np.repeat(nodes * 2, 2), np.repeat(left, 2, axis=0)
            nodes[1::2] += 1
    size = np.diff(e_last)[nodes]
    at = np.repeat(e_last[nodes] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    p = points[at].astype(np.float64)
    mine = np.where(np.repeat(left, size, axis=0), distances(p, book), np.inf).argmin(axis=1)
    entry[at] = mine
    np.add.at(sums, mine, p)
    counts += np.bincount(mine, minlength=k)
    return entry, sums, counts, cheap


# ------------------------------------------------------------------------- Spark


def _blocks(names: list[str], dimension: int):
    """Rows (array of what is carried, trees) of up to BLOCK vectors each."""

    def made(held: pa.Table) -> pa.RecordBatch:
        x = held["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(held), dimension)
        trees = [tree_of(whole(p)) for p in np.split(x, PARTS, axis=1)]
        rows = pa.StructArray.from_arrays([held[n].combine_chunks() for n in names], fields=[held.schema.field(n) for n in names])
        return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), rows), pa.array([pickle.dumps(trees)], pa.binary())], names=["rows", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                held.append(part)
                n += len(part)
                if n >= BLOCK:
                    yield made(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield made(pa.Table.from_batches(held))

    return run


def _round(books: list[list[list[int]]]):
    """(part, entry, position, limb, total) of what a task's blocks add up to; position -1 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        arrays = [_array(b) for b in books]
        for batch in batches:
            for blob in batch["trees"]:
                for p, tree in enumerate(pickle.loads(blob.as_buffer())):
                    _, sums, counts, _ = walk(tree, arrays[p])
                    for j in np.flatnonzero(counts).tolist():
                        for i, v in enumerate([*sums[j].tolist(), int(counts[j])]):
                            key = (p, j, i if i < sums.shape[1] else -1)
                            total[key] = total.get(key, 0) + int(v)
        rows = []
        for (p, j, i), v in total.items():
            limb = 0
            while not -(1 << 62) <= v < 1 << 62:
                rows.append((p, j, i, limb, v & ((1 << _LIMB) - 1)))
                v, limb = v >> _LIMB, limb + 1
            rows.append((p, j, i, limb, v))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["part", "entry", "position", "limb", "total"])

    return run


def _array(book: list[list[int]]) -> np.ndarray:
    a = np.empty((len(book), len(book[0])), dtype=object)
    for i, e in enumerate(book):
        a[i] = e
    return a.astype(np.float64) if max(abs(v) for e in book for v in e) < 1 << 50 else a


def _coded(books: list[list[list[int]]], names: list[str]):
    """What is carried, with code and error, of each block's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_array(b) for b in books]
        for batch in batches:
            for i in range(len(batch)):
                rows, trees = batch["rows"].slice(i, 1).flatten(), pickle.loads(batch["trees"][i].as_buffer())
                entries, error = np.zeros((len(rows), PARTS), dtype=np.uint8), np.zeros(len(rows), dtype=object)
                for p, tree in enumerate(trees):
                    entry, _, _, _ = walk(tree, arrays[p])
                    entries[tree["order"], p] = entry
                    away = integers(tree["points"]) - integers(arrays[p])[entry]
                    error[tree["order"]] += (away**2).sum(axis=1)
                codes = [e.tobytes().hex() for e in entries]
                columns = [rows.field(k) for k in range(len(names))]
                yield pa.record_batch([*columns, pa.array(codes, pa.string()), pa.array([e if e < 1 << 63 else None for e in error], pa.int64())], names=[*names, "code", "error"])

    return run


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()


def fitted(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", carry: list[str] = (), rounds: int = ROUNDS) -> tuple[DataFrame | None, list[list[list[int]]]]:
    """(blocks, codebooks): the stored trees of all vectors that are kept, and a codebook a part.

    A codebook starts as the parts of the ENTRIES first kept vectors by key (nulls last), then
    components; with fewer vectors it is shorter.  None and no codebooks without any vector.
    """
    carried = [c for c in carry if c != key]
    rows = vectors.select(key, *carried, F.col(embedding).alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & sound)
    order = [F.col(key).asc_nulls_last(), F.col("embedding")]
    least = rows.orderBy(*order).select(F.size("embedding")).first()
    if least is None:
        return None, []
    d = least[0]
    rows = rows.where(F.size("embedding") == d)
    first = whole(np.array([r["embedding"] for r in rows.orderBy(*order).select("embedding").limit(ENTRIES).collect()], dtype=np.float64))
    books = [[[int(v) for v in e] for e in p] for p in np.split(first, PARTS, axis=1)]
    names = [key, *carried]
    struct = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    blocks = stored(rows.mapInArrow(_blocks(names, d), f"rows array<struct<{struct}>>, trees binary"), "trees")
    for _ in range(rounds):
        moved = blocks.select("trees").mapInArrow(_round(books), "part int, entry int, position int, limb int, total long")
        # as many rows as the codebooks hold numbers
        got = moved.groupBy("part", "entry", "position", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        sums: dict[tuple[int, int, int], int] = {}
        for r in got:
            k = (r["part"], r["entry"], r["position"])
            sums[k] = sums.get(k, 0) + (int(r["total"]) << (_LIMB * r["limb"]))
        for p, j, i in sums:
            if i >= 0:
                books[p][j][i] = sums[p, j, i] // sums[p, j, -1]
    return blocks, books


def compress(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of each vector that is kept.

    A component x counts as floor(SCALE * x).  Vectors that are null or empty, hold a component
    that is null or not finite, or can't be cut into PARTS equal parts go, and so do those of
    another length than the first kept one's.  code: the parts' entries, two hex digits each;
    error: squared distances to them, null where 64 bits don't hold it; label_error: its sum
    over rows of an equal label, null labels together (null if one of them is).  Equal vectors
    have equal codes, and a repeated key stays repeated.  An empty table gives no rows.
    """
    blocks, books = fitted(vectors, key, embedding, [label], rounds)
    if blocks is None:
        return vectors.limit(0).select(key, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    kinds = {f.name: f.dataType.simpleString() for f in vectors.select(key, label).schema}
    coded = stored(blocks.mapInArrow(_coded(books, [key, label]), f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, code string, error long"), "coded")
    whole_sum = F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)")
    by_label = coded.groupBy(F.col(label).alias("_label")).agg(F.when(F.count("error") == F.count("*"), whole_sum).alias("label_error"))
    return coded.join(by_label, F.col(label).eqNullSafe(F.col("_label")), "left").select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decoded(coded: DataFrame, books: list[list[list[int]]], code: str = "code", name: str = "decoded") -> DataFrame:
    """coded with the vector that each code stands for, as doubles: of all entries, bounded by the codebooks' size."""
    lists = F.array(*[F.array(*[F.array(*[F.lit(v / SCALE) for v in e]) for e in b]) for b in books])
    number = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn(name, F.concat(*[lists[p][number(p)] for p in range(len(books))]))
