"""MinHash near-duplicates by min-max hashing.

Each permutation gives two signature values, its minimum and its maximum, so 48 permutations
fill 24 bands of 4.  Pairs that share a band are candidates; every link is confirmed on the
full shingle sets.  Two documents at the threshold of 0.8 share no band with probability
(1 - 0.8**4)**24 = 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import LOWER, LOWER_2, U, components, mix, pieces_of, stored, windows, word_hashes

PERMUTATIONS, ROWS = 48, 4
#: Of the bitmap that tells which texts are needed again: 2 MB, however many there are.
BITS = 24
_A = np.random.default_rng(7).integers(1, 1 << 63, PERMUTATIONS, dtype=U) | U(1)
_B = np.random.default_rng(8).integers(1, 1 << 63, PERMUTATIONS, dtype=U)
SIGNATURE = "doc_id long, n_shingles long, class long, bands array<long>"


def shingles(column, k: int, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of each row, and where each row's set starts."""
    h, first = word_hashes(column, table)
    s, room = windows(h, first, k)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    sets, sizes = [], np.zeros(len(counts), dtype=np.int64)
    whole = {}
    for n in np.unique(counts[short]):
        at = short[counts[short] == n]
        whole |= dict(zip(at.tolist(), windows(h, first, int(n), seed=int(n))[0][first[at]], strict=True))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= k:
            x = np.unique(s[a : b - k + 1])
        elif b > a:
            x = np.array([whole[i]], dtype=U)
        else:
            continue
        sizes[i] = len(x)
        sets.append(x)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.concatenate(([0], np.cumsum(sizes)))


def signatures(flat: np.ndarray, first: np.ndarray, n_perm: int, rows: int) -> np.ndarray:
    """Band keys (rows x bands) of non-empty sets: each permutation gives a minimum and a maximum."""
    out = np.empty((2 * n_perm, len(first) - 1), dtype=U)
    for j in range(n_perm):
        x = flat * _A[j] + _B[j]
        out[2 * j] = np.minimum.reduceat(x, first[:-1])
        out[2 * j + 1] = np.maximum.reduceat(x, first[:-1])
    bands = np.zeros((2 * n_perm // rows, out.shape[1]), dtype=U)
    for r in range(rows):
        bands = mix(bands + out[r::rows][: len(bands)] + U(r + 1))
    return bands.T


def _class_id(fp2, fp1, n) -> np.ndarray:
    return mix(fp1 + mix(fp2 + n.astype(U))).view(np.int64)


def _fingerprints(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two order-free sums of every set."""
    sizes = np.diff(first)
    some = np.flatnonzero(sizes)
    fps = np.zeros((2, len(sizes)), dtype=U)
    if len(some):
        for i, salt in enumerate((11, 77)):
            fps[i, some] = np.add.reduceat(mix(flat ^ mix(np.full(1, salt, U))), first[:-1][some])
    return sizes, fps[0], fps[1]


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            flat, first = shingles(batch["text"], k)
            sizes, fp1, fp2 = _fingerprints(flat, first)
            some = np.flatnonzero(sizes)
            n_bands = 2 * PERMUTATIONS // ROWS
            offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, n_bands, 0)))).astype(np.int32)
            bands = np.zeros(0, np.int64)
            if len(some):
                edge = np.append(first[:-1][some], first[-1])
                bands = np.ascontiguousarray(signatures(flat, edge, PERMUTATIONS, ROWS)).view(np.int64).ravel()
            yield pa.record_batch(
                [batch["doc_id"], pa.array(sizes), pa.array(_class_id(fp2, fp1, sizes)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands))],
                names=["doc_id", "n_shingles", "class", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            own = _class_id(*_fingerprints(*shingles(batch["text"], k))[::-1])
            flat, first = shingles(batch["text"], k, LOWER_2)
            yield pa.record_batch([pa.array(own), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.view(np.int64)))], names=["class", "set"])

    return run


def _likely(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is among ids (of that name), and few others.

    A join with the ids would shuffle every text or set.  So a bitmap of the ids' hashes, of at most
    2**BITS bits whatever the input, goes to the rows and drops most others where they are read.
    """
    at = F.pmod(F.xxhash64(column), F.lit(1 << BITS)) + 1
    part, place = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    bitmap = ids.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bitmap), part == F.col("_part")).where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("_part", "_bits")


def _sets_of(src: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """(class, set) of each class of buckets, from the texts of their representatives; no text is shuffled."""
    sets = _likely(src, "doc_id", buckets.select(F.col("rep").alias("doc_id"))).mapInArrow(_sets(k), "class long, set array<long>")
    return sets.join(buckets.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    pairs: (a, b, salt).  A b of many pairs has them dealt over salts, and its set goes to each.
    """
    left = sets.select(F.col("class").alias("a"), F.col("set").alias("sa"))
    right = pairs.select("b", "salt").distinct().join(sets.select(F.col("class").alias("b"), F.col("set").alias("sb")), "b")
    na, nb, common = (x.cast("long") for x in (F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))))
    possible = F.least(na, nb) * 100 >= percent * F.greatest(na, nb)
    return pairs.join(left, "a").join(right, ["b", "salt"]).where(possible).where(100 * common >= percent * (na + nb - common)).select("a", "b")


def _across(percent: int):
    """Links of a block of members to a block of their bucket's members in other components."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (t["class"].to_numpy() for t in (left, right))
        ca, cb = (t["c"].to_numpy() for t in (left, right))
        rows: list[np.ndarray] = []
        if len(a) and len(b):
            xs, ys = (t["set"].combine_chunks() for t in (left, right))
            nx, ny = np.diff(xs.offsets.to_numpy()), np.diff(ys.offsets.to_numpy())
            x, y = xs.flatten().to_numpy(), ys.flatten().to_numpy()
            own, code = np.unique(x, return_inverse=True)
            at = np.minimum(np.searchsorted(own, y), len(own) - 1)
            y = np.where(own[at] == y, at, len(own))
            start = np.cumsum(ny) - ny
            mark = np.zeros(len(own) + 1, dtype=np.int32)
            for i, (n, end) in enumerate(zip(nx.tolist(), np.cumsum(nx).tolist(), strict=True)):
                mine = code[end - n : end]
                mark[mine] = 1
                common = np.add.reduceat(mark[y], start).astype(np.int64)
                mark[mine] = 0
                hit = np.flatnonzero((100 * common >= percent * (n + ny - common)) & (cb != ca[i]))
                hit = hit[np.unique(cb[hit], return_index=True)[1]]  # one link a component is enough
                rows.append(np.stack([np.full(len(hit), a[i]), b[hit]]))
        found = np.concatenate(rows, 1) if rows else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(found.min(0) if found.size else found[0]), pa.array(found.max(0) if found.size else found[0])], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, small_bucket: int = 32, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Rows with equal sets form one class, so a group of exact copies costs one row from there
    on.  Within a bucket every class is compared with one head first, the one that shares most
    buckets.  A bucket whose members then lie in several components stays open: its members
    outside its largest component are compared with all members of other components, pair by
    pair in small buckets, in blocks of `block` members in larger ones.  So no link between
    different components is skipped, and no bucket emits all of its pairs.

    Empty or null text: n_shingles 0, a component of its own.  Null doc_id: never linked,
    component_id and kept null.  Rows that repeat a doc_id are judged each by its own text.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = stored(src.mapInArrow(_sign(k), SIGNATURE), "signatures")
    live = sig.where("n_shingles > 0 and doc_id is not null")
    classes = stored(live.groupBy("class").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep")), "classes")
    at_key = ["band", "key"]
    band = classes.select("class", "rep", F.posexplode("bands").alias("band", "key"))
    # one exchange for the rows and their counts, and no table that grows is sent to every task
    buckets = stored(band.withColumn("size", F.count("*").over(Window.partitionBy(at_key))).where("size > 1"), "buckets")
    degree = buckets.groupBy("class").agg(F.sum("size").alias("degree"))
    heads = buckets.join(degree, "class").groupBy(at_key).agg(F.max(F.struct("degree", "class")).getField("class").alias("head"))
    # two classes may be each other's heads: one pair, at the head of the larger bucket
    pairs = buckets.join(heads, at_key).where("class != head").groupBy(F.least("class", "head").alias("x"), F.greatest("class", "head").alias("y")).agg(F.max(F.struct("size", "head")).alias("at"))
    pairs = pairs.select(F.when(F.col("x") == F.col("at.head"), F.col("y")).otherwise(F.col("x")).alias("a"), F.col("at.head").alias("b"), F.col("at.size").alias("size"))
    tested = stored(pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / block)).alias("salt")), "pairs")
    sets = stored(_sets_of(src, buckets, k), "sets")
    links = stored(_links(tested, sets, percent), "links")
    comp = components(links, "component")

    at = buckets.join(comp, F.col("class") == F.col("id"), "left").select(*at_key, "class", "size", F.coalesce("component", "class").alias("c"))
    parts = at.groupBy(*at_key, "c").agg(F.count("*").alias("n_c"))
    largest = parts.groupBy(at_key).agg(F.max(F.struct("n_c", "c")).alias("top"), F.sum("n_c").alias("n"), F.count("*").alias("parts")).where("parts > 1 and n > 2")
    largest = largest.select(*at_key, F.col("top.c").alias("c0"), (F.col("n") - F.col("top.n_c")).alias("n_rest"))
    at = stored(at.join(largest, at_key), "open")
    sets = _likely(sets, "class", at.select("class"))
    rest = at.where("c != c0")
    small = rest.where(F.col("size") <= small_bucket).select(*at_key, F.col("class").alias("p"), F.col("c").alias("pc"))
    near = small.join(at, at_key).where("c != pc").select(F.least("p", "class").alias("a"), F.greatest("p", "class").alias("b")).distinct()
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _links(stored(near.join(known, ["a", "b"], "left_anti").withColumn("salt", F.lit(0).cast("long")), "pairs"), sets, percent)
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("class"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    wide = at.where(F.col("size") > small_bucket)
    left = wide.where("c != c0").select(*at_key, "class", "c", own("n_rest").alias("i"), every("size").alias("j"))
    right = wide.select(*at_key, "class", "c", own("size").alias("j"), every("n_rest").alias("i"))
    cell = [*at_key, "i", "j"]
    fresh = lambda df: df.join(sets, "class").select(*cell, "class", "c", "set").toDF(*cell, "class", "c", "set")
    across = fresh(left).groupBy(cell).cogroup(fresh(right).groupBy(cell)).applyInArrow(_across(percent), "a long, b long")
    found = stored(more.union(across).distinct(), "links")
    if not found.isEmpty():
        comp = components(links.union(found), "component")
    return _labelled(sig, classes, comp)


def _labelled(sig: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """Each row's component under the smallest doc_id of all its classes."""
    of = stored(classes.join(comp, F.col("class") == F.col("id"), "left").select("class", "rep", F.coalesce("component", "class").alias("c")), "members")
    least = of.join(of.groupBy("c").agg(F.min("rep").alias("least")), "c").select("class", "least")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    out = sig.join(least, "class", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
