"""Phrase collocations: exact counts of frequent word n-grams, and how much each is more than its parts.

Texts are read once and leave blocks: their distinct words, and their words' numbers with a mark
where a piece ends.  Words that are frequent in their language get numbers from a dictionary of
all of them; every other word ends a piece.  N-grams of numbers are packed into binary keys of
one width, sorted by radix and counted by run lengths, in each block and then, dealt by ranges
of the keys, over all.  No phrase is frequent of which a pair of neighbours is not, so pieces
also end between words that are no frequent pair before longer phrases are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import common as C
from recollect.llm.common import stored
from recollect.operators.retrieval import near

#: Bytes of text of a block, keys of a segment, keys of a range and words of a bucket, about.
BLOCK, SEGMENT, RANGE, BUCKET = 8 << 20, 512, 1 << 19, 1 << 18
RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
_BREAK = C._table(b".,;:!?\n\x0b\x0c\r")
_APART = _BREAK | C._table(b" \t")
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


# ------------------------------------------------------------------------- blobs


def squeezed(a: np.ndarray) -> bytes:
    """Rows of bytes, first bytes first, compressed: neighbours of sorted or small numbers share most of them."""
    raw = np.ascontiguousarray(a.T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(blob: bytes, width: int) -> np.ndarray:
    raw = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T)


def numbers(a: np.ndarray, kind: str = "<u4") -> bytes:
    return squeezed(a.astype(kind).view(np.uint8).reshape(len(a), np.dtype(kind).itemsize))


def numbers_of(blob: bytes, kind: str = "<u4") -> np.ndarray:
    return opened(blob, np.dtype(kind).itemsize).view(kind).ravel()


# ------------------------------------------------------------------------ blocks


def words_of(column) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a text column, and each one's piece and row; words of a piece follow each other."""
    buf, off = C.text_bytes(column)
    data, sizes, pieces, rows, done = [], [], [], [], 0
    for i, j in C._slices(off):
        b, o = _LOW[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        s, e = C.spans(b, o, _APART)
        row, ends = np.searchsorted(o, s, "right") - 1, np.flatnonzero(_BREAK[b])
        data.append(b[~_APART[b]])
        sizes.append(e - s)
        rows.append(row + i)
        pieces.append(np.searchsorted(ends, s) + row + done)
        done += len(ends) + j - i + 1
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    ends = np.concatenate(([0], np.cumsum(cat(sizes, np.int64)))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_utf8(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(cat(data, np.uint8))])
    return words, cat(pieces, np.int64), cat(rows, np.int64)


def _block(texts: pa.ChunkedArray, langs: pa.ChunkedArray) -> pa.RecordBatch:
    words, piece, row = words_of(texts)
    words, langs = words.dictionary_encode(), langs.combine_chunks().dictionary_encode()
    n = max(1, len(words.dictionary))
    lang = langs.indices.to_numpy()[row].astype(np.int64)
    pair, local, count = np.unique(lang * n + words.indices.to_numpy(), return_inverse=True, return_counts=True)
    ends = np.concatenate(([0], np.cumsum(piece[1:] != piece[:-1]))) if len(piece) else piece
    seq = np.zeros(len(local) + (int(ends[-1]) if len(ends) else 0), dtype=np.uint32)
    seq[np.arange(len(local)) + ends] = local + 1
    listed = lambda a, t: pa.array([a], pa.list_(t))
    return pa.record_batch(
        [
            listed(langs.dictionary.to_pylist(), pa.string()),
            listed(np.bincount(lang, minlength=len(langs.dictionary)), pa.int64()),
            listed(pair // n, pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, len(pair)], pa.int32()), words.dictionary.take(pa.array(pair % n)).cast(pa.string())),
            listed(count, pa.int64()),
            pa.array([numbers(seq)], pa.binary()),
        ],
        names=["langs", "sizes", "word_lang", "words", "counts", "seq"],
    )


BLOCKS = "langs array<string>, sizes array<long>, word_lang array<int>, words array<string>, counts array<long>, seq binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for part in C.pieces_of([batch], 250):
            held.append(part)
            size += part["text"].nbytes
            if size >= BLOCK:
                t = pa.Table.from_batches(held)
                yield _block(t["text"], t["lang"])
                held, size = [], 0
    if held:
        t = pa.Table.from_batches(held)
        yield _block(t["text"], t["lang"])


# -------------------------------------------------------------------- dictionary


def _sent(buckets: int):
    """A block's words, dealt into buckets."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("langs", pa.list_(pa.string())), ("word_lang", pa.list_(pa.int32())), ("words", pa.list_(pa.string())), ("locals", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words, lang, counts = (batch[c].slice(i, 1).flatten() for c in ("words", "word_lang", "counts"))
                buf, off = C.text_bytes(words)
                bucket = (C.run_hashes(buf, off[:-1], off[1:], C.PLAIN) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                ends, at = pa.array(np.append(cuts, len(order)), pa.int32()), pa.array(order)
                dealt = lambda a: pa.ListArray.from_arrays(ends, a)
                langs = pa.array([batch["langs"][i].as_py()] * len(cuts), pa.list_(pa.string()))
                own = pa.array([batch["block"][i].as_py()] * len(cuts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts], pa.int32()), own, langs, dealt(lang.take(at)), dealt(words.take(at)), dealt(pa.array(order, pa.int32())), dealt(counts.take(at))], schema=schema)

    return run


DICTIONARY = "block long, locals binary, ids binary, langs array<string>, words array<string>, counts array<long>"


def _known(least: int, buckets: int):
    """A bucket's frequent words with numbers of their own (block null), and to each block those of its words that have one."""
    schema = pa.schema([("block", pa.int64()), ("locals", pa.binary()), ("ids", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        sizes, inner = (np.concatenate([np.diff(c.offsets.to_numpy()) for c in table[name].chunks]).astype(np.int64) for name in ("words", "langs"))
        flat = lambda c: pa.concat_arrays([x.flatten() for x in table[c].chunks])
        langs, words = flat("langs").dictionary_encode(), flat("words").dictionary_encode()
        lang = langs.indices.to_numpy()[np.repeat(np.cumsum(inner) - inner, sizes) + flat("word_lang").to_numpy()].astype(np.int64)
        n = max(1, len(words.dictionary))
        pair, which = np.unique(lang * n + words.indices.to_numpy(), return_inverse=True)
        total = np.zeros(len(pair), dtype=np.int64)
        np.add.at(total, which, flat("counts").to_numpy())
        often = np.flatnonzero(total >= least)
        if not len(often):
            return schema.empty_table()
        ids = np.zeros(len(pair), dtype=np.int64)
        ids[often] = np.arange(len(often)) * buckets + table["bucket"][0].as_py() + 1
        rows = [(None, None, numbers(ids[often], "<i8"), langs.dictionary.take(pa.array(pair[often] // n)).to_pylist(), words.dictionary.take(pa.array(pair[often] % n)).to_pylist(), total[often].tolist())]
        local, mine = flat("locals").to_numpy(), ids[which]
        for block, e, size in zip(table["block"].to_pylist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            held = np.flatnonzero(mine[e - size : e]) + e - size
            if len(held):
                rows.append((block, numbers(local[held]), numbers(mine[held], "<i8"), None, None, None))
        return C.table_of(rows, schema)

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, word, f) of a bucket's dictionary."""
    for batch in batches:
        for i in range(len(batch)):
            ids = pa.array(numbers_of(batch["ids"][i].as_py(), "<i8"))
            yield pa.record_batch([ids, *(batch[c].slice(i, 1).flatten() for c in ("langs", "words", "counts"))], names=["id", "lang", "word", "f"])


# -------------------------------------------------------------------------- keys


def packed(ids: np.ndarray, at: np.ndarray, k: int, width: int, whole: int) -> np.ndarray:
    """Keys of the k numbers from each place on: big-endian, `width` bytes a number, filled up to `whole` bytes with zeros."""
    digits = ids.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    out = np.zeros((len(at), whole), dtype=np.uint8)
    for j in range(k):
        out[:, j * width : (j + 1) * width] = digits[at + j]
    return out


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of an even number of bytes, by two bytes at a time, the last ones first."""
    digits = np.ascontiguousarray(keys).view(">u2")
    order = np.arange(len(keys))
    for c in range(digits.shape[1] - 1, -1, -1):
        d = digits[:, c].astype(np.uint16)
        if len(d) and (d != d[0]).any():
            order = order[np.argsort(d[order], kind="stable")]
    return order


def runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their counts, and which of them each given key is."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = radix_order(keys)
    s = keys[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]).any(axis=1)))
    head, which = np.flatnonzero(new), np.empty(len(keys), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    total = np.diff(np.append(head, len(keys))) if counts is None else np.add.reduceat(counts[order], head)
    return s[head], total, which


def prefixes(keys: np.ndarray) -> np.ndarray:
    """The first seven bytes of each key as a number."""
    b = np.zeros((len(keys), 8), dtype=np.uint8)
    n = min(7, keys.shape[1])
    b[:, 1 : 1 + n] = keys[:, :n]
    return b.view(">u8").ravel().astype(np.int64)


def held_in(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are among others."""
    if not len(among):
        return np.zeros(len(keys), dtype=bool)
    one = lambda a: np.ascontiguousarray(a).view(f"S{a.shape[1]}").ravel()
    # of one width, so that the zeros which such strings lose at their end tell nothing apart
    known, asked = one(among[radix_order(among)]), one(keys)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return known[at] == asked


SEGMENTS = "block long, size int, middle long, keys binary, counts binary"


def _segments(block: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    middle, rows = prefixes(keys), []
    for lo in range(0, len(keys), SEGMENT):
        hi = min(lo + SEGMENT, len(keys))
        rows.append((block, hi - lo, int(middle[(lo + hi) // 2]), squeezed(keys[lo:hi]), numbers(counts[lo:hi])))
    return C.table_of(rows, pa.schema([("block", pa.int64()), ("size", pa.int32()), ("middle", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))


def even(n: int) -> int:
    return n + n % 2


def _numbers(block: pa.Table, replies: pa.Table) -> np.ndarray:
    """The dictionary's numbers of a block's words in order; 0 ends a piece."""
    seq = numbers_of(block["seq"][0].as_py())
    known = np.zeros(int(seq.max(initial=0)) + 1, dtype=np.int64)
    for local, ids in zip(replies["locals"].to_pylist(), replies["ids"].to_pylist(), strict=True):
        if local is not None:
            known[numbers_of(local).astype(np.int64) + 1] = numbers_of(ids, "<i8")
    return known[seq]


def _pairs(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs begin, and their keys."""
    at = np.flatnonzero((g[:-1] > 0) & (g[1:] > 0)) if len(g) else np.zeros(0, np.int64)
    return at, packed(g, at, 2, width, even(2 * width))


def _count_pairs(width: int):
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(blocks) or not len(replies):
            return _segments(0, np.zeros((0, even(2 * width)), np.uint8), np.zeros(0))
        _, keys = _pairs(_numbers(blocks, replies), width)
        distinct, counts, _ = runs(keys)
        return _segments(blocks["block"][0].as_py(), distinct, counts)

    return run


def _count_longer(width: int, longest: int):
    """Phrases of three words or more whose neighbours are frequent pairs; replies also hold such pairs."""
    whole = even(longest * width)

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        none = _segments(0, np.zeros((0, whole), np.uint8), np.zeros(0))
        if not len(blocks) or not len(replies):
            return none
        g = _numbers(blocks, replies)
        at, keys = _pairs(g, width)
        often = [opened(b, even(2 * width)) for b in replies["keys"].drop_null().to_pylist()]
        distinct, _, which = runs(keys)
        good = held_in(distinct, np.concatenate(often) if often else keys[:0])
        pair = np.zeros(len(g) + longest, dtype=bool)
        pair[at[good[which]]] = True
        found, here = [], pair[: len(g)].copy()
        for k in range(3, longest + 1):
            here &= pair[k - 2 : k - 2 + len(g)]
            found.append(packed(g, np.flatnonzero(here), k, width, whole))
        if not any(map(len, found)):
            return none
        distinct, counts, _ = runs(np.concatenate(found))
        return _segments(blocks["block"][0].as_py(), distinct, counts)

    return run


def _dealt(splits: np.ndarray, whole: int):
    """Segments cut where ranges of keys end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            rows = []
            for block, blob, sums in zip(batch["block"].to_pylist(), batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                keys, counts = opened(blob, whole), numbers_of(sums)
                of = np.searchsorted(splits, prefixes(keys), "right")
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(keys)]
                one = len(cuts) == 2  # most segments lie in one range
                rows += [(int(of[i]), block, blob if one else squeezed(keys[i:j]), sums if one else numbers(counts[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield from C.table_of(rows, schema).to_batches()

    return run


def _frequent(whole: int, least: int, reply: bool):
    """A range's keys that come `least` times over all blocks (block null), and to each block those of them that it holds."""

    def run(table: pa.Table) -> pa.Table:
        parts = [opened(b, whole) for b in table["keys"].to_pylist()]
        keys = np.concatenate(parts)
        counts = np.concatenate([numbers_of(b) for b in table["counts"].to_pylist()]).astype(np.int64)
        distinct, total, which = runs(keys, counts)
        often = total >= least
        rows = [(None, squeezed(distinct[often]), numbers(total[often], "<i8"))] if often.any() else []
        if reply and rows:
            good, end = often[which], np.cumsum([len(p) for p in parts])
            held: dict[int, list[np.ndarray]] = {}
            for block, part, e in zip(table["block"].to_pylist(), parts, end.tolist(), strict=True):
                if (mine := good[e - len(part) : e]).any():
                    held.setdefault(block, []).append(part[mine])
            rows += [(block, squeezed(np.concatenate(found)), None) for block, found in held.items()]
        return C.table_of(rows, pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return run


def _listed(width: int, whole: int):
    """(ids, f) of packed keys and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, sums in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                keys = opened(blob, whole)
                ids = np.zeros((len(keys), whole // width), dtype=np.int64)
                for i in range(ids.shape[1]):
                    for b in range(width):
                        ids[:, i] = (ids[:, i] << 8) | keys[:, i * width + b]
                sizes = (ids > 0).sum(axis=1)
                flat = pa.array(ids[ids > 0])
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                yield pa.record_batch([pa.ListArray.from_arrays(ends, flat), pa.array(numbers_of(sums, "<i8"))], names=["ids", "f"])

    return run


# ------------------------------------------------------------------------- Spark


def _counted(segments: DataFrame, whole: int, least: int, reply: bool) -> DataFrame:
    """What `_frequent` gives of all segments, dealt by ranges of keys that hold about as many each."""
    spark = segments.sparkSession
    n = segments.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    splits = segments.agg(F.percentile_approx("middle", [i / parts for i in range(1, parts)], 10 * max(parts, 1000))).first()[0] or []
    dealt = segments.drop("middle", "size").mapInArrow(_dealt(np.array(splits, dtype=np.int64), whole), "range int, block long, keys binary, counts binary")
    return stored(dealt.groupBy("range").applyInArrow(_frequent(whole, least, reply), "block long, keys binary, counts binary"), "frequent")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5, most: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    Texts are lower-cased (A to Z) and cut into pieces at .,;:!? and line ends, pieces into words
    at blanks and tabs.  All counts are of one language (null: und): n its words, f(phrase) the
    places, overlaps included, where a phrase stands in a piece.  Phrases of 2 to `longest` words
    with a = f >= least are candidates; of a candidate's cuts in two, with l and r the counts of
    the parts, the one counts that has the lowest floor(1000 a n / (l r)), the first of equals.
    Candidates inside a longer one that comes as often go.  Ranks follow score and a falling, then
    the phrase's bytes; ranks up to `most` stay, or all.

    Null and empty texts have no words, copies count as often as they come, a text of any length
    lies in one block, an empty table gives no rows.
    """
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blocks = stored(src.mapInArrow(_blocks, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks")
    sizes = blocks.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n"))

    # the dictionary: each bucket numbers its frequent words, in steps of the number of buckets
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(blocks.agg(F.sum(F.size("words"))).first()[0] or 0) // BUCKET))
    sent = blocks.select("block", "langs", "word_lang", "words", "counts").mapInArrow(_sent(buckets), "bucket int, block long, langs array<string>, word_lang array<int>, words array<string>, locals array<int>, counts array<long>")
    known = stored(sent.groupBy("bucket").applyInArrow(_known(least, buckets), DICTIONARY), "dictionary")
    words = stored(known.where("block is null").select("ids", "langs", "words", "counts").mapInArrow(_words, "id long, lang string, word string, f long"), "words")
    width = max(1, -(-int(words.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]).bit_length() // 8))
    known = known.where("block is not null").select("block", "locals", "ids")

    seqs = blocks.select("block", "seq").groupBy("block")
    pairs = stored(seqs.cogroup(known.groupBy("block")).applyInArrow(_count_pairs(width), SEGMENTS), "pairs")
    pairs = _counted(pairs, even(2 * width), least, longest > 2)
    grams = [words.select(F.array("id").alias("ids"), "f"), pairs.where("block is null").select("keys", "counts").mapInArrow(_listed(width, even(2 * width)), "ids array<long>, f long")]
    if longest > 2:
        none = F.lit(None).cast("binary")
        told = known.withColumn("keys", none).unionByName(pairs.where("block is not null").select("block", none.alias("locals"), none.alias("ids"), "keys"))
        longer = seqs.cogroup(told.groupBy("block")).applyInArrow(_count_longer(width, longest), SEGMENTS)
        longer = _counted(stored(longer, "longer"), even(longest * width), least, False)
        grams.append(longer.select("keys", "counts").mapInArrow(_listed(width, even(longest * width)), "ids array<long>, f long"))
    every = grams[0]
    for g in grams[1:]:
        every = every.unionByName(g)
    return _scored(stored(every, "grams"), words, sizes, most)


def _scored(every: DataFrame, words: DataFrame, sizes: DataFrame, most: int | None) -> DataFrame:
    """The result from the counts of all frequent phrases (ids, f) of one word or more."""
    k = F.size("ids")
    found = every.where(k > 1)
    slices = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda m: F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: F.slice("ids", i, m))))
    inside = found.where(k > 2).select(F.explode(F.array_distinct(slices)).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    kept = found.join(inside, "ids", "left").where("longer is null or longer < f").select("ids", F.col("f").alias("a"))

    named = kept.select("ids", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "lang", "word"), "id")
    named = named.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.min("lang").alias("lang"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("cut"))).withColumn("right", F.slice("ids", F.col("cut") + 1, F.size("ids") - F.col("cut")))
    cuts = cuts.join(every.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(every.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    # a n is the same for all cuts, so the lowest floor needs n only
    scored = cuts.join(named, "ids").join(near(sizes), "lang").withColumn("score", F.expr(f"cast(1000 as decimal(4, 0)) * {whole('a')} * {whole('n')} div ({whole('l')} * {whole('r')})"))
    best = scored.groupBy("ids", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    out = best.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", rank)
    out = out.where(F.col("rank") <= most) if most else out
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
