"""Telephony audio as media columns: mu-law, A-law and IMA ADPCM payloads in RIFF/WAVE form.

mu-law and A-law expand by 256-entry tables, ADPCM blocks are decoded step by step for all
blocks of a batch at once, and `decode_audio` stores resampled 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import pieces_of, stored

#: WAVE format tags, and the telephone sampling rate.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
TAGS = {"pcm": PCM, "alaw": ALAW, "mulaw": MULAW, "adpcm": ADPCM}
RATE, BLOCK = 8000, 64


def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law code: sign, 3 bits of exponent, 4 of mantissa, all inverted."""
    x = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((x & 15) * 8 + 132) << ((x >> 4) & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law code: even bits inverted, no implied bit in the lowest segment."""
    x = np.arange(256, dtype=np.int32) ^ 0x55
    e, m = (x >> 4) & 7, (x & 15) * 16 + 8
    size = np.where(e == 0, m, (m + 256) << np.maximum(e - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


def adpcm_steps() -> np.ndarray:
    """The 89 step sizes: each about 1.1 times the one before, as whole numbers."""
    #: IMA ADPCM step sizes.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        dtype=np.int32,
    )


#: Change of the step's index by the code's low three bits.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
MU, A, STEPS = mulaw_table(), alaw_table(), adpcm_steps()
_BITS = np.arange(16)
#: What a code adds at a step index: an eighth of the step, and a whole, half and quarter by its bits.
DELTA = np.stack([np.where(c & 8, -1, 1) * ((STEPS >> 3) + np.where(c & 4, STEPS, 0) + np.where(c & 2, STEPS >> 1, 0) + np.where(c & 1, STEPS >> 2, 0)) for c in _BITS], 1).astype(np.int32).ravel()
NEXT = np.stack([np.clip(np.arange(89) + INDEX_STEP[c & 7], 0, 88) for c in _BITS], 1).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (blocks x bytes), one vector step a sample over all blocks.

    A block's head is its first sample, its step index and a reserved byte; codes follow, low
    half of each byte first.  Indices beyond the table are held to its end.
    """
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((2 * (blocks.shape[1] - 4) + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(codes.shape[0]):
        for j, c in enumerate((codes[i] & 15, codes[i] >> 4)):
            at = index * 16 + c
            value += DELTA.take(at)
            np.clip(value, -32768, 32767, out=value)
            index = NEXT.take(at)
            out[2 * i + j + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, up: int = 2, taps: int = 8) -> np.ndarray:
    """pcm at `up` times its rate: windowed-sinc interpolation, one filter a phase, held to 16 bits."""
    if not len(pcm):
        return pcm
    x = np.pad(pcm.astype(np.float32), (taps, taps), mode="edge")
    out = np.empty((len(pcm), up), dtype=np.float32)
    out[:, 0] = pcm
    k = np.arange(-taps + 1, taps + 1)
    for p in range(1, up):
        t = k - p / up
        h = np.sinc(t) * np.cos(np.pi * t / (2 * taps + 1)) ** 2
        h /= h.sum()
        out[:, p] = np.convolve(x, h[::-1].astype(np.float32), "valid")[1 : len(pcm) + 1]
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16).ravel()


def wave(payload: bytes, tag: int, rate: int = RATE) -> bytes:
    """A mono RIFF/WAVE file that holds payload as it is."""
    bits, align = {PCM: (16, 2), ADPCM: (4, BLOCK)}.get(tag, (8, 1))
    extra = struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if tag == ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    speed = rate * BLOCK // (2 * (BLOCK - 4) + 1) if tag == ADPCM else rate * align
    form = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + extra
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Audio:
    tag: int
    rate: int
    payload: bytes

    def pcm(self) -> np.ndarray:
        raw = np.frombuffer(self.payload, dtype=np.uint8)
        if self.tag == MULAW:
            return MU[raw]
        if self.tag == ALAW:
            return A[raw]
        if self.tag == ADPCM:
            return decode_adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
        return raw[: len(raw) // 2 * 2].view("<i2")


def read_wave(data: bytes | None) -> Audio | None:
    """Tag, rate and payload of a mono RIFF/WAVE file; None if it is none or is cut short."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > len(data):
            return None
        if kind == b"fmt " and n >= 16:
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif kind == b"data":
            return Audio(form[0], form[2], bytes(data[at + 8 : at + 8 + n])) if form and form[1] == 1 and form[0] in TAGS.values() else None
        at += 8 + n + n % 2
    return None


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the UTF-8 bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def feature(tag: int, pcm: np.ndarray, up: int) -> str:
    """Level, peak, zero crossings and checksum of the resampled samples."""
    out = resample(pcm, up)
    x = pcm.astype(np.float32)
    sign = pcm >= 0
    level = int(round(float(np.sqrt(np.mean(x * x)))))
    crossings = int(np.count_nonzero(sign[1:] != sign[:-1]))
    return f"{tag}:{len(out)}:{level}:{int(np.abs(pcm.astype(np.int32)).max())}:{crossings}:{zlib.crc32(out.tobytes()):08x}"


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """doc_id, n_bytes and media, a WAVE file of the text's payload as codec's units, of each row of docs (doc_id, text)."""
    tag = TAGS[codec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, 256):
            held = [payload_of(t) for t in part["text"].to_pylist()]
            yield pa.record_batch([part["doc_id"], pa.array([n for n, _ in held], pa.int64()), pa.array([wave(p, tag) for _, p in held], pa.binary())], names=["doc_id", "n_bytes", "media"])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def read_media(files: DataFrame, up: int = 2, with_media: bool = False) -> DataFrame:
    """doc_id and RESULT of each row of `media_column`, all from the bytes of its file; with_media keeps that."""
    names = ["doc_id", *(c.split()[0] for c in RESULT.split(", ")), *(["media"] if with_media else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, 256):
            data = part["media"].to_pylist()
            read = [read_wave(f) for f in data]
            blocks = np.concatenate([np.frombuffer(a.payload, np.uint8).reshape(-1, BLOCK) for a in read] or [np.zeros((0, BLOCK), np.uint8)])
            adpcm = decode_adpcm(blocks)
            ends = np.cumsum([len(a.payload) // BLOCK for a in read], dtype=np.int64)
            features = []
            for a, end in zip(read, ends.tolist(), strict=True):
                steps = adpcm[end - len(a.payload) // BLOCK : end].ravel()
                other = A if a.tag == MULAW else MU
                own = steps if a.tag == ADPCM else a.pcm()
                more = [f"{ALAW if a.tag == MULAW else MULAW}:{zlib.crc32(other[np.frombuffer(a.payload, np.uint8)].tobytes()):08x}", f"{ADPCM}:{zlib.crc32(steps.tobytes()):08x}"]
                features.append(";".join([feature(a.tag, own, up), *more]))
            columns = [
                part["doc_id"],
                part["n_bytes"],
                pa.array([len(a.payload) for a in read], pa.int64()),
                pa.array([hashlib.sha256(a.payload).hexdigest() for a in read], pa.string()),
                pa.array([zlib.crc32(a.payload[-64:]) for a in read], pa.int64()),
                pa.array([len(f) for f in data], pa.int64()),
                pa.array([hashlib.sha256(f).hexdigest() for f in data], pa.string()),
                pa.array(features, pa.string()),
            ]
            yield pa.record_batch(columns + ([part["media"]] if with_media else []), names=names)

    return files.mapInArrow(run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, {RESULT}" + (", media binary" if with_media else ""))


def store_texts(docs: DataFrame, codec: str = "mulaw", up: int = 2, with_media: bool = False) -> DataFrame:
    """doc_id and RESULT for each row of docs (doc_id, text); with_media adds the stored file.

    The payload is written as a column of files of codec's 8-bit codes (or ADPCM blocks), and
    all further columns come from that column read again: features are those of the samples
    that it expands to, at `up` times the rate, and of the same bytes taken as A-law and as
    ADPCM blocks.  Null text is empty text: one payload of 64 zeros.  Null and repeated ids stay
    as they are; a text of any length is one file; an empty table gives an empty result.
    """
    return read_media(stored(media_column(docs, codec), "media"), up, with_media)


def decode_audio(files: DataFrame, media: str = "media", key: str = "doc_id", rate: int = 16_000) -> DataFrame:
    """key, sample_rate, n_samples and pcm (a WAVE file of 16-bit PCM) of each telephony file.

    Files at a divisor of `rate` are brought up to it, others keep their rate.  Null, cut or
    foreign files give nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch[1].to_pylist():
                a = read_wave(data)
                if a is None:
                    rows.append((None, None, None))
                    continue
                up = rate // a.rate if a.rate and rate % a.rate == 0 else 1
                out = resample(a.pcm(), up)
                rows.append((a.rate * up, len(out), wave(out.astype("<i2").tobytes(), PCM, a.rate * up)))
            r, n, p = zip(*rows, strict=True) if rows else ([],) * 3
            yield pa.record_batch([batch[0], pa.array(r, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.binary())], names=[key, "sample_rate", "n_samples", "pcm"])

    src = files.select(F.col(key), F.col(media).cast("binary").alias("media"))
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, sample_rate long, n_samples long, pcm binary")
