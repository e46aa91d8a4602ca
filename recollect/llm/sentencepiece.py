"""SentencePiece encoding by streaming Viterbi, and decoding.

Pieces and their scores are read from a model file; a path's score is the sum of its pieces'.
Encoding keeps a window of back pointers no longer than the longest piece and commits ids as
soon as all paths that survive in it go through one boundary.  Where a space follows another
character every path has a boundary, since no piece crosses it, so texts are cut there, and
the distinct parts of a batch go through the same recursion in step, each committed where it
ends.  Parts of over 256 bytes without such a place go through `Stream`, byte by byte.

Nothing is normalised, whatever the file's own settings: no prefix is added and no space
removed, spaces are the model's space sign, what no piece covers falls back to byte pieces, and
decoding gives the text back exactly.  Paths are chosen by the sum of scores, also in a file
whose scores are ranks of merges.  So ids differ from those of the library's own encoder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common as C

U = np.uint64
SPACE_SIGN = "▁"
UNKNOWN_COST = 10.0  # how much worse than the worst piece a byte is


class Pieces:
    """Pieces of a model as bytes, with ids and scores; lookup of many byte spans at once."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = [b""] * sp.get_piece_size()
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        self.score_of: dict[bytes, tuple[float, int]] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = piece.replace(SPACE_SIGN, " ").encode()
                self.bytes_of[i] = raw
                if raw not in self.score_of or sp.get_score(i) > self.score_of[raw][0]:
                    self.score_of[raw] = (sp.get_score(i), i)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        self.byte_score = min(s for s, _ in self.score_of.values()) - UNKNOWN_COST
        self.longest = max(map(len, self.score_of))
        self.crossing = any(b" " in p.lstrip(b" ") for p in self.score_of)
        raws = sorted(self.score_of)
        flat = np.frombuffer(b"".join(raws), np.uint8)
        size = np.array([len(p) for p in raws])
        end = np.cumsum(size)
        h = C.span_hashes(flat, end - size, end)
        order = np.argsort(h)
        self.scores = np.array([self.score_of[raws[i]][0] for i in order] + [-np.inf])
        self.ids = np.array([self.score_of[raws[i]][1] for i in order] + [-1])
        # open addressing on the hash's low bits, twice as long again as it needs to be
        self.bits = int(len(raws) * 4).bit_length()
        self.slot_hash = np.zeros(1 << self.bits, dtype=U)
        self.slot_row = np.full(1 << self.bits, len(raws), dtype=np.int32)
        at, todo, h = (h[order] & U((1 << self.bits) - 1)).astype(np.int64), np.arange(len(raws)), h[order]
        while len(todo):
            free = self.slot_row[at] == len(raws)
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            self.slot_row[at[one]], self.slot_hash[at[one]] = todo[one], h[todo[one]]
            left = np.setdiff1d(np.arange(len(todo)), one)
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)
        self.lengths = np.zeros(self.longest + 1, dtype=bool)
        self.lengths[size] = True
        self.offsets = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes_of])))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def rows(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash in scores and ids; the last row if it is no piece."""
        mask, none = (1 << self.bits) - 1, len(self.ids) - 1
        at = (h & U(mask)).astype(np.int64)
        out = np.full(len(h), none, dtype=np.int32)
        todo = np.arange(len(h))
        while len(todo):
            row, same = self.slot_row[at], self.slot_hash[at] == h[todo]
            out[todo[same]] = row[same]
            more = ~same & (row != none)
            todo, at = todo[more], (at[more] + 1) & mask
        return out


class Stream:
    """Encodes bytes as they come, in time that grows with their number.

    Kept are the last `longest` bytes and scores, in which every piece to come starts, and the
    steps back since the last commit.  Each boundary carries its root, the first boundary on its
    path from `mark` on.  Once all boundaries in the window have one root, every path alive goes
    through it, and the ids up to there are final.  A run of one letter may never converge; its
    steps then wait, one a byte.
    """

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.sizes = [k for k in range(1, pieces.longest + 1) if pieces.lengths[k]]
        self.widest = 0  # most bytes of text held at once
        self._start()

    def _start(self) -> None:
        self.text, self.best, self.root = b"", [0.0], [0]  # of the window; best and root have one boundary more
        self.steps: list[int] = []  # since the last commit: how far back, and which piece
        self.ids: list[int] = []
        self.mark = 0

    def feed(self, data: bytes) -> list[int]:
        p, longest, out = self.p, self.p.longest, []
        for b in data:
            self.text = (self.text + bytes((b,)))[-longest:]
            at, room = len(self.steps) + 1, min(len(self.text), len(self.best))
            best, step, own = self.best[-1] + p.byte_score, 1, int(p.byte_ids[b])
            for k in self.sizes:
                if k > room:
                    break
                found = p.score_of.get(self.text[-k:])
                if found and self.best[-k] + found[0] > best:
                    best, step, own = self.best[-k] + found[0], k, found[1]
            self.steps.append(step)
            self.ids.append(own)
            self.root.append(self.root[-step] if at - step >= self.mark else at)
            self.best.append(best)
            if len(self.best) > longest:
                del self.best[:-longest], self.root[:-longest]
            self.widest = max(self.widest, len(self.text))
            if at % longest == 0:
                out += self._commit()
        return out

    def _commit(self) -> list[int]:
        """Ids up to the boundary that every path alive goes through, if there is one."""
        at = len(self.steps)
        to = self.root[-1]
        if to == 0:  # no boundary is marked yet
            self.mark = self.root[-1] = at
            return []
        if at - len(self.best) + 1 < self.mark or any(r != to for r in self.root):
            return []
        out = self._path(to)
        del self.steps[:to], self.ids[:to]
        base = self.best[-1]
        self.best = [x - base for x in self.best]
        self.mark = at - to
        # boundaries before the committed one are behind every path
        keep = min(len(self.best), at - to + 1)
        self.best, self.root = self.best[-keep:], [0] * (keep - 1) + [self.mark]
        return out

    def _path(self, n: int) -> list[int]:
        ids = []
        while n:
            ids.append(self.ids[n - 1])
            n -= self.steps[n - 1]
        return ids[::-1]

    def end(self) -> list[int]:
        ids = self._path(len(self.steps))
        self._start()
        return ids


def encode_parts(p: Pieces, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of byte spans and how many each has: the recursion for all spans in step, over a ring of `longest` scores."""
    order = np.argsort(-size, kind="stable")
    st, sz = start[order], size[order]
    n, longest = len(st), int(sz[0]) if len(sz) else 0
    width = p.longest + 1
    best = np.full((width, n), -np.inf)
    best[0] = 0.0
    first = np.concatenate(([0], np.cumsum(sz)))
    back = np.zeros(int(first[-1]), dtype=np.int16)
    total = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(C.SIGNS[buf] * C.powers(C._BASE, len(buf))[: len(buf)], dtype=U, out=total[1:])
    inverse = C.powers(C._INVERSE, len(buf) + 1)
    row = np.zeros(int(first[-1]), dtype=np.int32)
    none = len(p.ids) - 1
    for i in range(1, longest + 1):
        k = int(np.searchsorted(-sz, -i, "right"))
        end = st[:k] + i
        score = best[(i - 1) % width, :k] + p.byte_score
        step, own = np.ones(k, dtype=np.int16), np.full(k, none, dtype=np.int32)
        for m in range(1, min(i, p.longest) + 1):
            if not p.lengths[m]:
                continue
            h = C.mix((total[end] - total[end - m]) * inverse[end - m] + U(m))
            r = p.rows(h)
            s = best[(i - m) % width, :k] + p.scores[r]
            better = s > score
            score = np.where(better, s, score)
            step[better], own[better] = m, r[better]
        best[i % width, :k] = score
        back[first[:k] + i - 1], row[first[:k] + i - 1] = step, own
    at, ids, owner, rank = sz.copy(), [], [], 0
    live = np.flatnonzero(at > 0)
    while len(live):
        pos = first[live] + at[live] - 1
        r = row[pos]
        ids.append(np.where(r < none, p.ids[r], p.byte_ids[buf[st[live] + at[live] - 1]]))
        owner.append(live)
        at[live] -= back[pos]
        live = live[at[live] > 0]
        rank += 1
    if not ids:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    ids, owner, turn = np.concatenate(ids), np.concatenate(owner), np.repeat(np.arange(len(owner)), [len(o) for o in owner])
    place = np.lexsort((-turn, order[owner]))
    return ids[place].astype(np.int32), np.bincount(order[owner], minlength=n)


def encode_column(p: Pieces, column, longest_part: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows in one array, where each row's ids start, and the rows' bytes and their starts."""
    buf, off = C.text_bytes(column)
    n = len(buf)
    cut = np.zeros(n + 1, dtype=bool)
    if not p.crossing and n:
        cut[1:n] = (buf[1:] == 32) & (buf[:-1] != 32)
    cut[off] = True
    edge = np.flatnonzero(cut)
    start, size = edge[:-1], np.diff(edge)
    h = np.concatenate([C.span_hashes(buf[a:b], s - a, s - a + z) for a, b, s, z in _blocks(edge, start, size)]) if len(start) else np.zeros(0, U)
    _, one, part = np.unique(h, return_index=True, return_inverse=True)
    s1, z1 = start[one], size[one]
    short = np.flatnonzero(z1 <= longest_part)
    n_ids = np.zeros(len(one), dtype=np.int64)
    pieces: list[np.ndarray] = [np.zeros(0, np.int32)] * 2
    begin = np.zeros(len(one), dtype=np.int64)
    if len(short):
        # spans side by side, so that the prefix sums stay short
        flat = buf[np.repeat(s1[short] - (np.cumsum(z1[short]) - z1[short]), z1[short]) + np.arange(int(z1[short].sum()))]
        got, count = encode_parts(p, flat, np.cumsum(z1[short]) - z1[short], z1[short])
        n_ids[short], pieces[0] = count, got
        begin[short] = np.cumsum(count) - count
    done, rest = len(pieces[0]), []
    for i in np.flatnonzero(z1 > longest_part).tolist():
        stream = Stream(p)
        ids = stream.feed(buf[s1[i] : s1[i] + z1[i]].tobytes()) + stream.end()
        begin[i], n_ids[i] = done, len(ids)
        done += len(ids)
        rest.append(np.array(ids, dtype=np.int32))
    store = np.concatenate([pieces[0], *rest]) if len(one) else np.zeros(0, np.int32)
    count = n_ids[part]
    total = np.concatenate(([0], np.cumsum(count)))
    ids = store[np.repeat(begin[part] - total[:-1], count) + np.arange(int(total[-1]))]
    return ids, total[np.searchsorted(start, off, "left")], buf, off


def _blocks(edge: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 1 << 20):
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + most, "right")) - 1)
        j = min(j, len(start))
        yield int(edge[i]), int(edge[j]), start[i:j], size[i:j]
        i = j


def decode_ids(p: Pieces, ids: np.ndarray) -> np.ndarray:
    """The bytes of ids, one after another."""
    size = p.offsets[ids + 1] - p.offsets[ids]
    at = np.cumsum(size) - size
    return p.flat[np.repeat(p.offsets[ids] - at, size) + np.arange(int(size.sum()))]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array<int>) of each row; null text gives null, empty text no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, _, _ = encode_column(pieces(model), batch[1])
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=batch[1].is_null() if batch[1].null_count else None)
            yield pa.record_batch([batch[0], lists], names=[key, "ids"])

    src = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of each row's ids; null ids give null.  Unknown ids and null items add nothing; broken UTF-8 is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = pieces(model)
            out = [None if x is None else decode_ids(p, np.array([i for i in x if i is not None and 0 <= i < len(p.bytes_of)], dtype=np.int64)).tobytes().decode("utf-8", "replace") for x in batch[1].to_pylist()]
            yield pa.record_batch([batch[0], pa.array(out, pa.string())], names=[key, "text"])

    src = rows.select(F.col(key), F.col(ids))
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, text string")


DIGEST = "n_bytes long, n_ids long, ids_crc32 long, round_trip boolean"


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and DIGEST of each row: its ids, and whether decoding them gives its bytes back.

    Null and empty text have no ids.  Null and repeated ids stay; equal texts get equal values.  A
    text of any length is encoded whole; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = pieces(model)
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                ids, first, buf, off = encode_column(p, part["text"])
                raw = ids.astype("<u4").tobytes()
                back = decode_ids(p, ids)
                same = np.zeros(len(part), dtype=bool)
                size = p.offsets[ids + 1] - p.offsets[ids]
                ends = np.concatenate(([0], np.cumsum(size)))[first]
                for i in range(len(part)):
                    same[i] = np.array_equal(back[ends[i] : ends[i + 1]], buf[off[i] : off[i + 1]])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.record_batch([part["doc_id"], pa.array(np.diff(off)), pa.array(np.diff(first)), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", *(c.split()[0] for c in DIGEST.split(", "))])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, {DIGEST}")
