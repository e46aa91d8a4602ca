"""What the corpus operators share: byte-level text access, chunked key exchange, components.

Conventions.  A null text counts as an empty one, a null ``doc_id`` stays null in the result
and sorts behind every number.  Operators read the columns they need by name.  A column that an
operator adds takes the place of one of the same name, as ``withColumn`` does; a caller that
keeps such a column asks for another name (`fresh`).
"""

from __future__ import annotations

import ctypes
import math
import os
import pickle
import subprocess
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recollect.sources.store import scratch, stored

__all__ = ["scratch", "stored"]

NO_ID = np.iinfo(np.int64).max
U = np.uint64


# --------------------------------------------------------------------- Spark


def text_bytes_of(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts of docs, counted: it sizes partitions alike however the rows are stored."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def fresh(rows: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that rows have no such column."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def appended(rows: DataFrame, text: str, columns: str, judge: Callable[[], Callable[[pa.Array], list]], step: int = 1000) -> DataFrame:
    """rows with further columns (DDL) computed from the text column, `step` rows at a time, in place.

    judge() makes, once a task, the function from a text column to the new arrays.  Columns of
    rows under the new names go.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    rows = rows.drop(*(n for n in names if n.lower() != text.lower()))
    schema = StructType(list(rows.schema.fields))
    for c in columns.split(", "):
        schema = schema.add(*c.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = judge()
        for part in pieces_of(batches, step):
            new = of(part.column(part.schema.get_field_index(text)))
            yield pa.record_batch([*part.columns, *new], names=[*part.schema.names, *names])

    return rows.mapInArrow(run, schema)


def tidy() -> None:
    """Gives memory that was freed back to the system: workers are used again, by stages that need theirs elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces_of(batches: Iterator[pa.RecordBatch], step: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of `step` rows at most, whatever the session's batch size."""
    for batch in batches:
        for lo in range(0, len(batch), step):
            yield batch.slice(lo, step)
        tidy()


def apart(function: Callable, *args):
    """What a module's function gives, called in a process of its own, whose memory goes with it.

    For work in a task that needs much memory once: Python workers are used again and keep theirs.
    """
    code = "import pickle, sys; f, a = pickle.load(sys.stdin.buffer); pickle.dump(f(*a), sys.stdout.buffer)"
    env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    done = subprocess.run([sys.executable, "-c", code], input=pickle.dumps((function, args)), stdout=subprocess.PIPE, env=env, check=True)
    return pickle.loads(done.stdout)


# ---------------------------------------------------------------------- bytes


def _table(codes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(codes)] = True
    return t


SPACE = _table([0x20, *range(0x09, 0x0E)])
_rng = np.random.default_rng(20240131)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """A random word for each byte at each of 64 places, and the same with A to Z taken as a to z."""
    plain = _rng.integers(1, 1 << 63, (64, 256), dtype=U) | U(1)
    lower = plain.copy()
    lower[:, 65:91] = plain[:, 97:123]
    return plain, lower


#: A random word for each byte.
SIGNS = _rng.integers(1, 1 << 63, 256, dtype=U) | U(1)
PLAIN, LOWER = _letters()
#: A second, independent pair: what confirms a match must not err where the first one does.
PLAIN_2, LOWER_2 = _letters()
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 1 << 20), base, dtype=U)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=U)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def zipped(raw) -> bytes:
    """Bytes, compressed, behind their number."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unzipped(blob) -> bytes:
    return pa.decompress(memoryview(blob)[8:], int.from_bytes(memoryview(blob)[:8], "little"), codec="zstd", asbytes=True)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def _slices(off: np.ndarray, most: int = 1 << 19):
    """Runs of whole rows of about `most` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes; none crosses a row."""
    m = ~space[buf]
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    edge = off[(off > 0) & (off < n)]
    first[edge] = m[edge]
    last[edge - 1] = m[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = SIGNS) -> np.ndarray:
    """64-bit hashes of byte spans that may overlap, by prefix sums; crafted long ones may collide."""
    if not len(starts):
        return np.zeros(0, U)
    n = len(buf)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(table[buf] * powers(_BASE, n)[:n], dtype=U, out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(U))


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint, non-empty byte runs in order.

    Sums a random word for each byte and its place.  That is no polynomial, so words that cancel
    out in prefix sums (as of `span_hashes`) don't meet here.
    """
    n = len(buf)
    if not len(starts):
        return np.zeros(0, U)
    place = np.zeros(n, dtype=np.int32)
    place[starts] = starts
    np.subtract(np.arange(n, dtype=np.int32), np.maximum.accumulate(place), out=place)
    x = table.ravel().take(((place & 63) << 8) | buf)
    if int((ends - starts).max()) > 64:
        far = np.flatnonzero(place > 63)
        x[far] *= mix((place[far] >> 6).astype(U)) | U(1)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(x, dtype=U, out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(U))


def word_hashes(column, table: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of each row, and where each row's words start."""
    buf, off = text_bytes(column)
    parts, first = [], np.zeros(len(off), dtype=np.int64)
    done = 0
    for i, j in _slices(off):
        b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e = spans(b, o)
        parts.append(run_hashes(b, s, e, table))
        first[i + 1 : j + 1] = done + np.searchsorted(s, o[1:], "left")
        done += len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), first


def windows(h: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether all k lie in one row."""
    n = len(h)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n) >= k
    out = np.full(n, U(seed * 2 + 1), dtype=U)
    step = mix(np.arange(1, k + 1, dtype=U) * U(_BASE) + U(seed)) | U(1)
    for i in range(min(k, n)):
        out[: n - i] += h[i:] * step[i]
    return mix(out), room


def row_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


# -------------------------------------------------------------- chunk exchange
#
# Documents are dealt into chunks of a few megabytes.  A chunk sends each distinct 64-bit key
# once, with what it has summed for it, in blobs by the key's high bits; one task per bucket
# answers each chunk in the order of its keys.  A key that fills the corpus still reaches its
# bucket once per chunk.  Blobs hold differences of sorted keys, byte plane by byte plane, so
# that the shuffle's own compression removes the high planes.

EXCHANGE = "bucket int, chunk int, keys binary, vals binary"
REPLY = "chunk int, bucket int, vals binary"


def pack(keys: np.ndarray) -> bytes:
    d = keys.copy()
    d[1:] -= keys[:-1]
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(blob) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U)


def chunk_count(docs: DataFrame, least_mb: float = 8, most_mb: float = 32) -> int:
    """Chunks of 8 MB of text, of up to 32 MB where there is much of it.

    Blobs are chunks times buckets, and buckets as many as chunks, so that none holds more than
    about a chunk's keys; chunks that grow with the root of the input keep the blobs from shrinking.
    """
    mb = text_bytes_of(docs) / 1e6
    return max(1, math.ceil(mb / min(most_mb, max(least_mb, math.sqrt(mb) / 16))))


def chunked(docs: DataFrame, n: int, *columns: Column | str) -> DataFrame:
    """docs with the chunk of each row; equal rows go together, copies under other ids don't."""
    return docs.select(*columns, F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)).cast("int").alias("chunk"))


def bucket_bits(n: int) -> int:
    return min(24, max(3, math.ceil(math.log2(n + 1))))


def sends(chunk: int, keys: np.ndarray, vals: np.ndarray, bits: int, base: int = 0) -> list[tuple]:
    """Rows of EXCHANGE: sorted keys and their values cut by the keys' high bits."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=U) << U(64 - bits))
    edges = [0, *edges.tolist(), len(keys)]
    return [(base + b, chunk, pack(keys[i:j]), np.ascontiguousarray(vals[i:j]).tobytes()) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


EXCHANGE_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
REPLY_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("vals", pa.binary())])


def gathered(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's chunks, their lengths, all keys and all values."""
    table = table.sort_by("chunk")
    chunks = table["chunk"].to_numpy()
    keys = [unpack(b.as_buffer()) for b in table["keys"]]
    vals = [np.frombuffer(b.as_buffer(), dtype=dtype) for b in table["vals"]]
    return chunks, np.array([len(k) for k in keys]), np.concatenate(keys), np.concatenate(vals)


def answers(chunks: np.ndarray, lengths: np.ndarray, bucket: int, vals: np.ndarray) -> pa.Table:
    ends = np.cumsum(lengths)
    return table_of([(int(c), bucket, vals[e - n : e].tobytes()) for c, n, e in zip(chunks, lengths, ends, strict=True)], REPLY_ARROW)


def answer_of(replies: pa.Table, dtype) -> np.ndarray:
    """What all buckets answered to a chunk, in the order of its sorted keys."""
    replies = replies.sort_by("bucket")
    return np.frombuffer(b"".join(replies["vals"].to_pylist()), dtype=dtype)


# ----------------------------------------------------------------- components


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of each node of edges (a, b): the smallest id that it reaches.

    Alternating large and small stars; every round is one stored table, so no labels, links or
    components reach the driver.  Ends when a round changes nothing.
    """
    spark = edges.sparkSession
    e = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
