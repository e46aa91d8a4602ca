"""Best-fit packing by exact-complement hashing.

Only a document's first piece can be shorter than a sequence, and only its length matters, so
the plan works on how many pieces there are of each length: at most `size` numbers, whatever
the corpus.  For each length, longest first, single, pair and triple sums of lengths that fill
the gap exactly are looked up and consumed in bulk under the counts; what is left goes by best
fit.  Pieces then find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import stored, tidy

Run = tuple[int, int, int, int, int]  # length, first rank, count, first sequence, offset


def plan(counts: dict[int, int], size: int) -> list[Run]:
    """Runs of pieces of one length: piece first + i goes to sequence seq + i, at offset.

    The number of runs depends on `size` alone: each step uses up a length or a kind of sequence.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    used = np.zeros(size + 1, dtype=np.int64)
    runs: list[Run] = []
    state = {"seq": 0}

    def place(lengths: list[int], copies: int) -> None:
        at = 0
        slots: dict[int, int] = {}
        for n in lengths:
            first = int(used[n]) + slots.get(n, 0) * copies
            slots[n] = slots.get(n, 0) + 1
            runs.append((n, first, copies, state["seq"], at))
            at += n
        for n, k in slots.items():
            used[n] += k * copies
            left[n] -= k * copies
        state["seq"] += copies

    def most(lengths: list[int]) -> int:
        return min(int(left[n]) // lengths.count(n) for n in set(lengths))

    def exact(n: int, gap: int) -> list[int] | None:
        """Up to three lengths that sum to gap, the most plentiful such pair or triple."""
        if left[gap] > (n == gap):
            return [gap]
        low = np.arange(1, gap // 2 + 1)
        have = np.minimum(left[low], left[gap - low])
        have[low == gap - low] = left[low[low == gap - low]] // 2
        if len(have) and have.max() > 0:
            a = int(low[have.argmax()])
            return [gap - a, a]
        lengths = np.flatnonzero(left[:gap])
        best, found = 0, None
        for a in lengths[::-1].tolist():
            if 3 * a < gap:
                break
            rest = gap - a
            b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
            if not len(b):
                continue
            have = np.minimum(np.minimum(left[b], left[rest - b]), left[a])
            i = int(have.argmax())
            if have[i] > best:
                trial = [a, int(b[i]), rest - int(b[i])]
                if most([n, *trial]) > 0:
                    best, found = int(have[i]), trial
        return found

    if left[size]:
        place([size], int(left[size]))
    for n in range(size - 1, 0, -1):
        while left[n]:
            fill = exact(n, size - n)
            copies = most([n, *fill]) if fill else 0
            if not copies:
                break
            place([n, *fill], copies)
    # best fit of what is left, longest first: into the fullest sequences that still have room
    room: dict[int, list[tuple[int, int]]] = {}  # sequences (first, how many) by the room they have

    def put(n: int, seq: int, copies: int, free: int) -> None:
        runs.append((n, int(used[n]), copies, seq, size - free))
        used[n] += copies
        left[n] -= copies
        if free > n:
            room.setdefault(free - n, []).append((seq, copies))

    for n in range(size - 1, 0, -1):
        while left[n]:
            fits = [free for free, some in room.items() if free >= n and some]
            if fits:
                free = min(fits)
                seq, many = room[free].pop()
                copies = min(many, int(left[n]))
                if many > copies:
                    room[free].append((seq + copies, many - copies))
                put(n, seq, copies, free)
            else:
                fresh = -(-int(left[n]) // (size // n))
                put(n, state["seq"], fresh, size)
                state["seq"] += fresh
    return runs


def byte_of() -> dict[str, int]:
    """Bytes by the printable signs that byte-level vocabularies write them with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def ranks_of(model: dict) -> dict[bytes, int] | None:
    """Merge ranks by bytes of a tokenizer file, if it is byte-level BPE whose ids rise with its merges; else None.

    Then the file says nothing that these ranks don't: no normaliser, no prefix, the usual split,
    one byte a letter, and each merge's id above those of the merges before it.
    """
    bpe, split = model["model"], model.get("pre_tokenizer") or {}
    plain = bpe.get("type") == "BPE" and not model.get("normalizer") and not any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    to_byte, vocab, special = byte_of(), bpe["vocab"], {t["content"] for t in model.get("added_tokens", [])}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe["merges"]]
    ids = [vocab[m] for m in merged]
    letters = {k: v for k, v in vocab.items() if k not in special and len(k) == 1}
    rest = {k for k in vocab if len(k) > 1 and k not in special}
    if len(letters) != 256 or rest != set(merged) or any(a >= b for a, b in zip([max(letters.values()), *ids], ids, strict=False)):
        return None
    return {bytes(to_byte[c] for c in k): v for k, v in vocab.items() if k not in special}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to the ids that the tokenizer at path gives, without special tokens added.

    A text that holds one of the file's added tokens is the tokenizer's own affair.  For others a
    faster encoder reads the file's ranks, where they say all there is (`ranks_of`).
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    plain = lambda t: np.array(own.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    ranks, added = ranks_of(model), [t["content"] for t in model.get("added_tokens", [])]
    if ranks is None:
        return plain
    try:
        import tiktoken
    except ImportError:
        return plain
    #: Fixed value: the split pattern of byte-level BPE.
    split = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    return lambda t: plain(t) if any(a in t for a in added) else np.array(fast.encode_ordinary(t), dtype=np.uint32)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, size: int, end: int) -> DataFrame:
    """The pieces of each row: its ids and then `end`, in pieces of `size`, the first one shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tidy()
        for batch in batches:
            ids, rows = batch["doc_id"].to_pylist(), []
            for doc, text in zip(ids, batch["text"].to_pylist(), strict=True):
                all_ids = np.append(encode(text or ""), np.uint32(end))
                raw = all_ids.astype("<u4").tobytes()
                head = len(all_ids) % size or size
                starts = [0, *range(head, len(all_ids), size)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(all_ids)], strict=True)):
                    rows.append((doc, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=[c.split()[0] for c in PIECES.split(", ")])
        tidy()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, salt_rows: int = 2000) -> DataFrame:
    """PIECES, then sequence_id and offset, of the pieces of all rows of docs (doc_id, text).

    Null and empty text: one piece of the end id.  Null and repeated ids are packed like any
    row.  A text of any length is cut whole; an empty table gives an empty result.  Pieces of a length are ranked within salts of about `salt_rows` rows and salts are
    added up, so a length that most documents share is not ranked in one task.
    """
    pieces = stored(cut(docs, tokenizer, size, end), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, size)
    salts = max(1, sum(counts.values()) // salt_rows)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(sizes.drop("n"), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch[c].to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            seq = table[at, 3] + rank - table[at, 1]
            yield pa.record_batch([*(batch[c] for c in names), pa.array(seq), pa.array(table[at, 4])], names=[*names, "sequence_id", "offset"])
        tidy()

    return ranked.select(*names, F.col("rank").cast("long")).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
