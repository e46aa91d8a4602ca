"""A vector index: vectors in cells around centroids, and searches that prove which cells they can leave out.

A cell keeps its vectors' widest angle to the centroid and their largest norm.  So a query knows,
before a cell is read, how good its best vector can be; cells that can't reach what the nearest
ones have given already are never read, and the rows are those of a comparison with all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import exprs as X
from recollect.operators.retrieval import near, ranked
from recollect.sources.store import stored

#: Most cells, and most vectors of the sample that centroids are fitted on.
CELLS, SAMPLE = 4096, 20_000
#: Vectors of a cell that one task compares, and how many times its first cells a query looks at next.
PART, WIDER = 20_000, 8


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column of one length; null ones and those of another length are zero."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


#: Vectors and queries that are packed in a row, and products that are looked at once.
PACK, CELL = 512, 1 << 20


def _by_width(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by their length: where they are, and a matrix in double precision; null ones and those that hold null are left out."""
    flat = column.flatten()
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).copy()
    first = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
    if flat.null_count:
        size[np.searchsorted(first, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), "right") - 1] = -1
    values, out = flat.to_numpy(zero_copy_only=False).astype(np.float64), {}
    for w in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == w)
        out[w] = at, values[first[at][:, None] + np.arange(w)]
    return out


def _products(v: np.ndarray, q: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of v, row of q, product) of those that may reach each query's `least` when rounded to six digits.

    A product of matrices finds them; their own products are summed in the order of the
    components, as X.dot does, so that no digit depends on how the pairs were found.
    """
    step = max(1, CELL // max(1, len(q)))
    lower = np.where(least > 0, least - 1e-6 - 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0.0), -np.inf)
    for lo in range(0, len(v), step):
        i, j = np.nonzero(~(v[lo : lo + step] @ q.T < lower))  # not a number stays, as in Spark's order
        total = np.zeros(len(i))
        for d in range(v.shape[1]):
            total += v[lo + i, d] * q[j, d]
        yield lo + i, j, total


def packed(vectors: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Vectors (key, embedding) packed as they lie, PACK in a row: arrays of keys and of vectors."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), PACK):
                part = batch.slice(lo, PACK)
                rows = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part[c]])) for c in range(2)]
                yield pa.record_batch(rows, names=list(names))

    return vectors.select(F.col(key).cast("long"), "embedding").mapInArrow(run, f"{names[0]} array<long>, {names[1]} array<{kind}>")


def compared(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(query_id, id, product) of all vectors (id, embedding) and queries (query_id, embedding) of one length whose product can round to `least`, which is above 0.

    Packs of vectors meet packs of queries, a product of matrices each.
    """
    q = stored(packed(queries, "query_id", ("q_ids", "qs")), "queries")
    both = packed(vectors, "id", ("ids", "vs")).join(near(q, 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                ids, q_ids = (batch[c][r].values.to_numpy(zero_copy_only=False) for c in ("ids", "q_ids"))
                left, right = (_by_width(batch[c][r].values) for c in ("vs", "qs"))
                for w in left.keys() & right.keys():
                    (at, v), (q_at, m) = left[w], right[w]
                    for i, j, product in _products(v, m, np.full(len(m), least)):
                        yield pa.record_batch([pa.array(q_ids[q_at[j]]), pa.array(ids[at[i]]), pa.array(product)], names=["query_id", "id", "product"])

    return both.mapInArrow(run, "query_id long, id long, product double")


def centroids_of(vectors: DataFrame, cells: int | None = None, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means on the SAMPLE vectors of the smallest hash; by default as many as the root of all vectors."""
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"].to_pylist()
    width = len(sample[0]) if sample else 1
    m = _unit(np.array([v for v in sample if len(v) == width and None not in v], dtype=np.float64).reshape(-1, width))
    k = max(1, min(CELLS, cells or int(np.ceil(np.sqrt(n))), len(m) // 4 or 1))
    c = m[np.linspace(0, max(0, len(m) - 1), k).astype(int)] if len(m) else np.zeros((1, width))
    for _ in range(rounds):
        own = (m @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, m)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def write_cells(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Writes vectors (id, embedding) in folders by cell, and a row a cell with its centroid, size, widest angle and largest norm.

    All vectors are kept, of whatever length; the sample only says where centroids lie.
    """
    c = centroids_of(vectors, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                m = _matrix(part["embedding"], c.shape[1])
                norm = np.linalg.norm(m, axis=1)
                cos = _unit(m) @ c.T
                cell = cos.argmax(axis=1)
                angle = np.arccos(np.clip(cos[np.arange(len(m)), cell], -1, 1))
                yield pa.record_batch([part["id"], part["embedding"], pa.array(angle), pa.array(norm), pa.array(cell.astype(np.int32))], names=["id", "embedding", "angle", "norm", "cell"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = vectors.select("id", "embedding").mapInArrow(run, f"id long, embedding {kind}, angle double, norm double, cell int")
    # a cell that many vectors share is several files
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").option("compression", "zstd").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    stats = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("size"), F.max("angle").alias("angle"), F.max("norm").alias("norm"))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, centroid array<double>")
    rows.join(stats, "cell").write.parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("vectors", "cells")}


def cell_bounds(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, cell, place, bound): each query's cells by their centroids' nearness, and the best product a vector of theirs can have."""
    held = index["cells"].orderBy("cell").collect()  # CELLS rows at most
    cell, c = np.array([r["cell"] for r in held], dtype=np.int32), np.array([r["centroid"] for r in held], dtype=np.float64)
    wide, norm = np.array([r["angle"] for r in held]), np.array([r["norm"] for r in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, q in zip(batch["query_id"].to_pylist(), _matrix(batch["embedding"], c.shape[1]), strict=True):
                length = np.linalg.norm(q)
                cos = c @ (q / length if length else q)
                apart = np.maximum(0, np.arccos(np.clip(cos, -1, 1)) - wide - 1e-6)
                bound = np.maximum(0, length * norm * np.cos(apart))
                place = np.empty(len(cos), dtype=np.int32)
                place[np.argsort(-cos, kind="stable")] = np.arange(len(cos))
                yield pa.record_batch([pa.array([i] * len(cos), pa.int64()), pa.array(cell), pa.array(place), pa.array(bound)], names=["query_id", "cell", "place", "bound"])

    return queries.select("query_id", "embedding").mapInArrow(run, "query_id long, cell int, place int, bound double")


def _scored(index: dict[str, DataFrame], pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the best k of each task's part of a cell for each query (query_id, cell, least) that looks there.

    Only those cells' folders are read.  Queries come packed by cell; a cell of many vectors is
    dealt over parts.
    """
    cells = [r[0] for r in pairs.select("cell").distinct().collect()]
    parts = index["cells"].select("cell", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    asked = pairs.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(F.broadcast(parts), "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("query_id").cast("long").alias("query_id"), "least", "q")
    rows = index["vectors"].where(F.col("cell").isin(cells)).join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").cast("long").alias("id"), "embedding")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            ids, q_ids, least = left["id"].to_numpy(), right["query_id"].to_numpy(), right["least"].to_numpy()
            mine, theirs = _by_width(left["embedding"].combine_chunks()), _by_width(right["q"].combine_chunks())
            for w in mine.keys() & theirs.keys():
                (at, v), (q_at, m) = mine[w], theirs[w]
                for lo in range(0, len(m), 512):
                    hits = list(_products(v, m[lo : lo + 512], least[q_at[lo : lo + 512]]))
                    i, j, product = (np.concatenate(x) for x in zip(*hits, strict=True))
                    j = q_at[lo + j]
                    good = np.where(np.isnan(product), np.inf, np.maximum(product, 0))  # as scores are ordered
                    order = np.lexsort((ids[at[i]], -good, j))
                    i, j, product, good = i[order], j[order], product[order], good[order]
                    start, n = np.searchsorted(j, j), np.arange(len(j))
                    kth = good[np.minimum(start + k, np.searchsorted(j, j, "right")) - 1]
                    new = np.ones(len(j), dtype=bool)
                    new[1:] = (j[1:] != j[:-1]) | (good[1:] != good[:-1])
                    # what rounding may set beside the k-th stays, of equals the first k
                    keep = (n - start < k) | ((good >= kth - 2e-6) & (n - np.maximum.accumulate(np.where(new, n, 0)) < k))
                    found.append((q_ids[j[keep]], ids[at[i[keep]]], product[keep]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "id", "score"])

    out = rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(run, "query_id long, id long, score double")
    return out.select("query_id", "id", F.round(F.greatest(F.lit(0.0), "score"), 6).alias("score"))


def search_cells(index: dict[str, DataFrame], queries: DataFrame, least: float = 0.5, k: int = 30, probes: int = 4) -> dict[str, DataFrame]:
    """rows (query_id, id, score, rank) as `retrieval.semantic` gives them, from few cells, and the audit of each query.

    Each query reads its `probes` nearest cells, then, of WIDER times as many and then of all,
    those whose bound reaches its k-th score (or `least`, without k such rows).  audit (query_id, cells, probed, read, recall): how many
    cells there are, were probed and read, and the share of the result that the probes had found.
    """
    q = stored(queries, "asked")
    plan = stored(cell_bounds(index, q), "bounds")
    first = plan.where(F.col("place") < probes).select("query_id", "cell", F.lit(least).cast("double").alias("least"))
    first = stored(ranked(_scored(index, first, q, k).where(F.col("score") >= least), k), "first")
    rows, seen = first, []
    for low, high in ((probes, probes * WIDER), (probes * WIDER, None)):
        reach = rows.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        more = plan.where((F.col("place") >= low) & (F.col("place") < high if high else F.lit(True))).join(near(reach), "query_id", "left").withColumn("least", F.coalesce("kth", F.lit(least)))
        more = stored(more.where(F.col("bound") >= F.col("least") - 2e-6).select("query_id", "cell", "least"), "more")
        if not more.isEmpty():
            other = _scored(index, more, q, k).where(F.col("score") >= least)
            rows = stored(ranked(rows.select("query_id", "id", "score").unionByName(other), k), "rows")
        seen.append(more.select("query_id", "cell"))
    more = seen[0].union(seen[1])
    both = rows.join(first.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    read = more.groupBy("query_id").agg(F.count("*").alias("more"))
    audit = plan.groupBy("query_id").agg(F.count("*").alias("cells"), F.sum((F.col("place") < probes).cast("long")).alias("probed")).join(both, "query_id", "left").join(read, "query_id", "left")
    audit = audit.select("query_id", "cells", "probed", (F.col("probed") + F.coalesce("more", F.lit(0))).alias("read"), F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("n"), F.lit(1.0)).alias("recall"))
    return {"rows": rows, "audit": audit}
