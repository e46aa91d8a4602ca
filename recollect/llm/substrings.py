"""Exact substring dedup by difference-cover anchors.

A difference cover modulo a period holds, for any two positions, an offset below the period
that brings both into the cover.  So two equal runs of `window` words share an anchor: a run of
window - period + 1 words that starts at a cover position in either document.  Only positions
in the cover are hashed and exchanged; only windows around an anchor that another document
shares are then extended to their full length.  Anchors and full windows are told apart by
hashes of their own, so that words which meet in one stay apart in the other.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common as C

#: Perfect difference covers by their period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
U = np.uint64


def cover_of(window: int) -> tuple[int, np.ndarray]:
    """The longest period that leaves anchors of seven words and a third of the window, and its cover."""
    period = max(p for p in COVERS if p == 3 or window - p + 1 >= max(7, window // 3))
    cover = np.zeros(period, dtype=bool)
    cover[list(COVERS[period])] = True
    return period, cover


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(C.NO_ID).to_numpy()


def _anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the anchors and their hashes."""
    if not len(h):
        return np.zeros(0, np.int64), h
    period, cover = cover_of(window)
    a, room = C.windows(h, first, window - period + 1, seed=1)
    start = np.repeat(first[:-1], np.diff(first))
    at = np.flatnonzero(room & cover[(np.arange(len(h)) - start) % period])
    return at, a[at]


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, with the smallest and the largest id of each."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    i = ids[order]
    return k[head], (np.minimum.reduceat(i, head) if len(k) else i), (np.maximum.reduceat(i, head) if len(k) else i)


def _send_anchors(window: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        C.tidy()
        h, first = C.word_hashes(table["text"])
        at, a = _anchors(h, first, window)
        keys, low, high = _least(a, _ids(table)[C.row_of(first)[at]])
        return C.table_of(C.sends(table["chunk"][0].as_py(), keys, (low != high).astype(np.uint8), bits), C.EXCHANGE_ARROW)

    return run


def _answer_shared(table: pa.Table) -> pa.Table:
    """For each key of each chunk, whether two documents have it."""
    C.tidy()
    chunks, lengths, keys, several = C.gathered(table, np.uint8)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    twin = np.concatenate((k[1:] == k[:-1], [False]))
    twin[1:] |= twin[:-1].copy()
    shared = np.zeros(len(keys), dtype=np.uint8)
    shared[order] = twin
    # a key of one chunk only, but of several of its documents
    return C.answers(chunks, lengths, table["bucket"][0].as_py(), shared | several)


def _candidates(h: np.ndarray, first: np.ndarray, window: int, at: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a shared anchor at a cover position."""
    period, _ = cover_of(window)
    mark = np.zeros(len(h) + period + 1, dtype=np.int64)
    mark[at[shared]] = 1
    total = np.concatenate(([0], np.cumsum(mark)))
    n = np.arange(len(h))
    room = np.repeat(first[1:], np.diff(first)) - n >= window
    return np.flatnonzero(room & (total[n + period] > total[n]))


def _send_windows(window: int, bits: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return C.EXCHANGE_ARROW.empty_table()
        C.tidy()
        h, first = C.word_hashes(table["text"])
        at, a = _anchors(h, first, window)
        keys = np.unique(a)
        shared = C.answer_of(replies, np.uint8).astype(bool)[np.searchsorted(keys, a)]
        at_window = _candidates(h, first, window, at, shared)
        again, _ = C.word_hashes(table["text"], C.PLAIN_2)
        full, low, _ = _least(C.windows(again, first, window, seed=2)[0][at_window], _ids(table)[C.row_of(first)[at_window]])
        return C.table_of(C.sends(table["chunk"][0].as_py(), full, low, bits), C.EXCHANGE_ARROW)

    return run


def _first_of_several(table: pa.Table) -> pa.Table:
    """To each chunk, its windows that several documents have, with the smallest of these."""
    C.tidy()
    chunks, lengths, keys, ids = C.gathered(table, np.int64)
    k, low, _ = _least(keys, ids)
    ends = np.cumsum(lengths)
    bucket, rows = table["bucket"][0].as_py(), []
    for c, n, e in zip(chunks.tolist(), lengths.tolist(), ends.tolist(), strict=True):
        mine = keys[e - n : e]
        rows.append((bucket, c, C.pack(mine), low[np.searchsorted(k, mine)].tobytes()))
    return C.table_of(rows, C.EXCHANGE_ARROW)


def _remove(window: int, names: list[str], with_text: bool, schema: pa.Schema):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        C.tidy()
        h, first = C.word_hashes(table["text"], C.PLAIN_2)
        gone = np.zeros(len(h), dtype=bool)
        if len(replies) and len(h):
            keys = np.concatenate([C.unpack(b.as_buffer()) for b in replies["keys"]])
            low = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in replies["vals"]])
            order = np.argsort(keys)
            keys, low = keys[order], low[order]
            w, room = C.windows(h, first, window, seed=2)
            at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
            mine = _ids(table)[C.row_of(first)]
            hit = np.flatnonzero(room & (keys[at] == w) & (low[at] < mine))
            edge = np.zeros(len(h) + 1, dtype=np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
        buf, off = C.text_bytes(table["text"])
        raw = buf.tobytes()
        n_removed, digest, kept = [], [], []
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            words = raw[off[i] : off[i + 1]].split()
            cut = int(gone[a:b].sum())
            left = b" ".join(compress(words, ~gone[a:b]) if cut else words)
            n_removed.append(cut)
            digest.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left.decode() if cut else table["text"][i].as_py())
        columns = [table[c] for c in names] + [pa.array(np.diff(first)), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        return pa.table(columns + ([pa.array(kept, pa.string())] if with_text else []), schema=schema)

    return run


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def dedup_substrings(docs: DataFrame, window: int = 13, carry: list[str] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; with_text adds kept_text.

    A word goes if a window of `window` words over it also starts in a row with a smaller
    doc_id.  Rows of one doc_id don't cut each other, so the first of several copies stays
    whole.  Null text has no words (kept_text null); a null doc_id is larger than any other.
    kept_text is the text itself where nothing was cut, else the kept words joined by a space.
    Further columns to carry come in one struct, `carried`, so that no name of theirs clashes.
    A text of any length is one row of its chunk; an empty table gives an empty result.
    """
    if window < 3:
        raise ValueError("a window needs three words at least")
    n = C.chunk_count(docs)
    bits = C.bucket_bits(n)
    carried = [F.struct(*carry).alias("carried")] if carry else []
    names = ["doc_id", *(["carried"] if carry else [])]
    src = C.chunked(docs, n, F.col("doc_id").cast("long").alias("doc_id"), *carried, F.col("text").cast("string").alias("text"))
    by_chunk = lambda: src.groupBy("chunk")
    shared = by_chunk().applyInArrow(_send_anchors(window, bits), C.EXCHANGE).groupBy("bucket").applyInArrow(_answer_shared, C.REPLY)
    full = by_chunk().cogroup(shared.groupBy("chunk")).applyInArrow(_send_windows(window, bits), C.EXCHANGE)
    firsts = full.groupBy("bucket").applyInArrow(_first_of_several, C.EXCHANGE)
    out = src.select(*names)
    schema = pa.schema([*_arrow(out), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] if with_text else [])])
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), "n_words long, n_removed long, kept_sha256 string", *(["kept_text string"] if with_text else [])])
    return by_chunk().cogroup(firsts.groupBy("chunk")).applyInArrow(_remove(window, names, with_text, schema), ddl)
